"""Problem 6: byte-pair encoding of a whole corpus by recursive DuckDB queries inside each partition.

A partition's distinct pre-tokens (its vocabulary is far smaller than its text) become rows (word, place, token) of single
bytes. One recursive query joins them with their right neighbours to the merge table and contracts, in every word at once,
the leftmost pair of the smallest rank, until no pair can be merged; an ordered aggregation gives each word's ids, and the
texts are put together from their words. In words of over LONG bytes all equal pairs are contracted in one step, which gives
the same result as one after the other, since a merge that needs a new token always has a larger rank. The recursion is cut
after some steps and taken up again for the words that are not yet done, so that intermediate states do not pile up.

The tokenizer file is a parameter; it is read by the driver and its merges (a fixed 50,000 rows) go to every partition.

Defined results: a null or an empty text has an empty list; text that looks like special tokens is ordinary text; one row
for each input row, repeated or not; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairforge.session import spread

#: Splits text before the merges (the published pattern of this vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a worker remembers; beyond, it starts anew.
MEMORY_WORDS = 200_000
#: Bytes of words that one recursive query takes, and the steps after which it is taken up again.
BLOCK_BYTES, STEPS = 1 << 18, 24
#: A longer word, in bytes, has all its smallest pairs contracted in one step.
LONG = 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, more = [], 0
    for b in range(256):
        letters.append(chr(b if b in printable else 256 + more))
        more += b not in printable
    return letters


def read_merges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(id of each byte, merges as rows left, right, result in the order of their ranks)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return np.array([vocab[c] for c in byte_letters()], dtype=np.int32), np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int32)


#: One step for short words. A row knows its right neighbour (next_place, next_token), so neither ordering nor windows are
#: needed: rows join the merge table, each word's leftmost pair of the smallest rank is found, its left row takes the result
#: and its right row's neighbour, its right row goes, and the row before it learns the result.
_MERGE_ONE = """
WITH RECURSIVE state(step, word, place, token, next_place, next_token) AS (
  SELECT 0, word, place, token, next_place, next_token FROM todo
  UNION ALL
  (WITH pairs AS MATERIALIZED (
    SELECT s.*, m.pair_rank, m.result FROM state s LEFT JOIN merges m ON m.l = s.token AND m.r = s.next_token WHERE s.step < $steps
  ), best AS (
    SELECT word, arg_min({'place': place, 'next_place': next_place, 'result': result}, (pair_rank::BIGINT << 21) | place) AS b
    FROM pairs WHERE pair_rank IS NOT NULL GROUP BY word
  ), hit AS (
    SELECT p.word, b.place AS kept, b.next_place AS gone, b.result AS result, p.next_place AS after, p.next_token AS after_token
    FROM best JOIN pairs p ON p.word = best.word AND p.place = b.next_place
  )
  SELECT step + 1, p.word, p.place, CASE WHEN p.place = kept THEN hit.result ELSE p.token END, CASE WHEN p.place = kept THEN after ELSE p.next_place END,
         CASE WHEN p.place = kept THEN after_token WHEN p.next_place = kept THEN hit.result ELSE p.next_token END
  FROM pairs p JOIN hit USING (word) WHERE p.place <> gone)
)
SELECT word, step AS steps, list(token ORDER BY place) AS ids
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step) GROUP BY word, step
"""
#: One step for long words, which may hold long runs of one pair: every word's tokens with their right neighbours, the word's smallest rank, runs of that pair (they overlap
#: only where both halves are the same token, then every other one is taken), and the contracted rows.
_MERGE_ALL = """
WITH RECURSIVE state(step, word, place, token) AS (
  SELECT 0, word, place, token FROM todo
  UNION ALL
  SELECT step + 1, word, place, CASE WHEN hit THEN result ELSE token END
  FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY place), false) AS eaten
    FROM (
      SELECT *, coalesce(pair_rank = best AND row_number() OVER (PARTITION BY word, pair_rank = best, run ORDER BY place) % 2 = 1, false) AS hit
      FROM (
        SELECT *, nth - sum(CASE WHEN pair_rank = best THEN 1 ELSE 0 END) OVER (PARTITION BY word ORDER BY place) AS run
        FROM (
          SELECT n.*, m.pair_rank, m.result, min(m.pair_rank) OVER (PARTITION BY word) AS best
          FROM (
            SELECT step, word, place, token, lead(token) OVER w AS next_token, row_number() OVER w AS nth
            FROM state WHERE step < $steps WINDOW w AS (PARTITION BY word ORDER BY place)
          ) n LEFT JOIN merges m ON m.l = n.token AND m.r = n.next_token
        ) WHERE best IS NOT NULL
      )
    )
  ) WHERE NOT eaten
)
SELECT word, step AS steps, list(token ORDER BY place) AS ids
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step) GROUP BY word, step
"""


class DuckBpe:
    """Ids of words; one in-memory DuckDB for each worker."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        import duckdb

        self.byte_ids = byte_ids
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        rows = pa.table({"l": merges[:, 0], "r": merges[:, 1], "pair_rank": np.arange(len(merges), dtype=np.int32), "result": merges[:, 2]})
        self.con.register("merge_rows", rows)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """In the order of the words."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(words)
        raw = [w.encode("utf-8", "replace") for w in words]
        order = sorted(range(len(words)), key=lambda i: len(raw[i]))  # words of like length need like numbers of steps
        at = 0
        while at < len(order):
            size, end, long = 0, at, len(raw[order[at]]) > LONG
            while end < len(order) and (end == at or size + len(raw[order[end]]) <= BLOCK_BYTES) and (len(raw[order[end]]) > LONG) == long:
                size += len(raw[order[end]])
                end += 1
            block, at = order[at:end], end
            states = [(i, self.byte_ids[np.frombuffer(raw[i], dtype=np.uint8)]) for i in block]
            while states:
                lengths = np.array([len(s) for _, s in states])
                ends = np.cumsum(lengths)
                place = (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32)
                token = np.concatenate([s for _, s in states]).astype(np.int32)
                last = np.zeros(len(token), dtype=bool)
                last[ends - 1] = True
                self.con.register("todo", pa.table({
                    "word": np.repeat(np.arange(len(states), dtype=np.int32), lengths), "place": place, "token": token,
                    "next_place": pa.array(place + 1, mask=last), "next_token": pa.array(np.append(token[1:], 0).astype(np.int32), mask=last),
                }))
                found = self.con.sql(_MERGE_ALL if long else _MERGE_ONE, params={"steps": STEPS}).to_arrow_table().combine_chunks()
                ids = found.column("ids").combine_chunks()
                ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                starts, flat = np.asarray(ids.offsets), np.asarray(ids.values)
                again = []
                for k, steps, a, b in zip(found.column("word").to_pylist(), found.column("steps").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                    if steps < STEPS:
                        out[states[k][0]] = flat[a:b]
                    else:
                        again.append((states[k][0], flat[a:b]))
                states = again
        return out


def _encoder(byte_ids: np.ndarray, merges: np.ndarray, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        bpe, known = DuckBpe(byte_ids, merges), {}
        for batch in batches:
            cut = [split(t) if t else [] for t in batch.column(1).to_pylist()]
            new = set(chain.from_iterable(cut)).difference(known)
            if len(known) + len(new) > MEMORY_WORDS:
                known = {}
                new = set(chain.from_iterable(cut))
            words = sorted(new)
            known.update(zip(words, bpe.encode(words)))
            parts = [[known[w] for w in ws] for ws in cut]
            sizes = np.array([sum(map(len, p)) for p in parts], dtype=np.int64)
            flat = list(chain.from_iterable(parts))
            values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    return encode


def encode_corpus(documents: DataFrame, tokenizer: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text)."""
    byte_ids, merges = read_merges(tokenizer or default_tokenizer())
    return spread(documents.select("doc_id", "text")).mapInArrow(_encoder(byte_ids, merges, pattern), "doc_id BIGINT, ids ARRAY<INT>")
