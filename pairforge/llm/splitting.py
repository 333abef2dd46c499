"""Problem 8: texts over a token limit cut into overlapping pieces at natural boundaries, by lexical cohesion.

Every token boundary has a level: inside a character, between characters, between words, after a sentence, after a line,
after a paragraph. At boundaries from sentences up, the similarity of the words of the blocks before and after is
measured; how far it lies below the nearest peaks on both sides is the depth of that valley, high where the topic changes.
Each piece ends at the deepest valley of its size window (line ends and paragraphs count as deeper), and the next one
starts `overlap` tokens before. Where the window has no sentence end, the last boundary of the highest level is taken.
A start inside a character moves to the character's first token, so that a piece is always valid text; then the two pieces
share up to three tokens more. Among ends of one level those whose overlap starts at a word are preferred.

Defined results: texts of at most `limit` tokens, null and empty ones give no rows; the pieces without their overlaps are
the text again, byte for byte; white space belongs to the word that it precedes in the tokenizer's sense; a document given
twice is cut twice; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pairforge.llm.bpe import PATTERN
from pairforge.session import spread

LIMIT, OVERLAP = 512, 64
#: Sentences of a block, and the hashed vocabulary in which blocks are compared.
BLOCK, DIMENSIONS = 5, 256
IN_CHAR, CHAR, WORD, SENTENCE, LINE, PARAGRAPH = range(6)
#: Added to a valley's depth.
BONUS = {SENTENCE: 0.0, LINE: 0.2, PARAGRAPH: 0.5}

_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[”’」』）]*")
_LINE = re.compile(r"\s*[\r\n]\s*")
_WORDS = re.compile(r"[^\W_]+")
_CJK = ((0x3000, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def levels_of(text: str, ends: np.ndarray) -> np.ndarray:
    """The level of the boundary after each token; ends: bytes up to there."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))  # byte of each character
    at = np.full(starts[-1] + 1, IN_CHAR, dtype=np.int8)
    at[starts] = CHAR
    loose = np.zeros(len(codes), dtype=bool)  # white space, CJK
    for lo, hi in _CJK:
        loose |= (codes >= lo) & (codes <= hi)
    space = np.isin(codes, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000)) | ((codes >= 0x2000) & (codes <= 0x200A))
    loose |= space
    at[starts[1:-1][loose[1:] | loose[:-1]]] = WORD
    for m in _SENTENCE.finditer(text):
        at[starts[m.end()]] = SENTENCE
    for m in _LINE.finditer(text):
        at[starts[m.end()]] = PARAGRAPH if m.group().count("\n") + m.group().count("\r") - m.group().count("\r\n") > 1 else LINE
        at[starts[m.start()] : starts[m.end()]] = np.minimum(at[starts[m.start()] : starts[m.end()]], WORD)  # white space stays together
    at[0] = at[-1] = PARAGRAPH
    return at[ends]


def depths_of(raw: bytes, places: np.ndarray) -> np.ndarray:
    """The depth of the similarity valley at each place (ascending byte offsets)."""
    edges = [0, *places.tolist(), len(raw)]
    rows = np.zeros((len(edges) - 1, DIMENSIONS), dtype=np.float32)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        for w in _WORDS.findall(raw[a:b].decode("utf-8", "ignore").lower()):
            if len(w) > 3 or not w.isascii():
                rows[i, zlib.crc32(w.encode()) % DIMENSIONS] += 1
    total = np.concatenate((np.zeros((1, DIMENSIONS)), np.cumsum(rows, axis=0, dtype=np.float64)))
    gap = np.arange(1, len(edges) - 1)
    left = total[gap] - total[np.maximum(gap - BLOCK, 0)]
    right = total[np.minimum(gap + BLOCK, len(rows))] - total[gap]
    norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    sim = np.where(norm > 0, (left * right).sum(axis=1) / np.maximum(norm, 1e-12), 0.0)
    depth = np.zeros(len(sim))
    for step in (1, -1):  # the peak that is reached by climbing from the gap
        peak, best = np.zeros(len(sim)), -1.0
        before = -1.0
        for i in range(len(sim))[::step]:
            best = max(best, sim[i]) if sim[i] <= before else sim[i]
            peak[i], before = best, sim[i]
        depth += peak - sim
    return depth


def cut_points(levels: np.ndarray, depth: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first token, token after the last) of each piece. levels[i]: of the boundary before token i; depth likewise, in tokens."""
    n, start, out = len(levels) - 1, 0, []
    while n - start > limit:
        end = None
        for least in (limit // 2, limit // 4):
            window = np.arange(start + max(least, overlap) + 1, start + limit + 1)
            natural = window[levels[window] >= SENTENCE]
            for level in (WORD, CHAR):
                good = natural[levels[natural - overlap] >= level]
                if len(good):
                    end = int(good[np.argmax(depth[good])])
                    break
            if end is not None:
                break
        if end is None:
            window = np.arange(start + max(limit // 2, overlap) + 1, start + limit + 1)
            for own, before in ((WORD, WORD), (WORD, CHAR), (CHAR, CHAR), (CHAR, IN_CHAR)):
                good = window[(levels[window] >= own) & (levels[window - overlap] >= before)]
                if len(good):
                    end = int(good[-1])
                    break
        assert end is not None  # a character has four tokens at most
        out.append((start, end))
        start = end - overlap
        while levels[start] == IN_CHAR:
            start -= 1
    out.append((start, n))
    return out


def split_text(text: str, ids: list[int], token_bytes: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first token, token after the last, text) of each piece of a text of more than `limit` tokens."""
    raw = text.encode("utf-8", "replace")
    bounds = np.concatenate(([0], np.cumsum(token_bytes[ids])))
    levels = levels_of(text, bounds)
    natural = np.flatnonzero(levels >= SENTENCE)[1:-1]
    depth = np.zeros(len(levels))
    if len(natural):
        depth[natural] = depths_of(raw, bounds[natural]) + np.array([BONUS[x] for x in levels[natural].tolist()])
    return [(a, b, raw[bounds[a] : bounds[b]].decode("utf-8")) for a, b in cut_points(levels, depth, limit, overlap)]


def _splitter(ranks: dict[bytes, int], pattern: str, limit: int, overlap: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for b, i in ranks.items():
            token_bytes[i] = len(b)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                # A token has a byte at least.
                if text and len(text) * 4 > limit and len(text.encode("utf-8", "replace")) > limit and len(ids := encode(text)) > limit:
                    rows += [(doc, k, a, b, b - a, piece) for k, (a, b, piece) in enumerate(split_text(text, ids, token_bytes, limit, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "token_start", "token_end", "n_tokens", "text"])

    return split


def split_documents(documents: DataFrame, tokenizer: str | None = None, pattern: str = PATTERN, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, piece_no, token_start, token_end, n_tokens, text): the pieces of all texts over the limit."""
    if not 0 <= overlap < limit // 4:
        raise ValueError("the overlap must be below a quarter of the limit")
    ranks = read_ranks(tokenizer or default_tokenizer())  # a fixed vocabulary
    return spread(documents.select("doc_id", "text")).mapInPandas(
        _splitter(ranks, pattern, limit, overlap),
        "doc_id BIGINT, piece_no INT, token_start INT, token_end INT, n_tokens INT, text STRING",
    )
