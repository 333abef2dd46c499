"""Hard negatives of texts: nearest neighbours in a corpus that lies in shared files.

Search is exact, over the whole corpus; inverted lists are for callers that ask for them. The corpus is written once, a row for
each text with its vector. A task takes some thousand records and reads the vectors file by file; all candidates of a record are
met in its own task, so neither candidates nor texts are shuffled. The folder of intermediate tables must be one that Arrow can
read (a shared mount, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.retrieval import FIT_ROWS, ivf_sizes

#: Records that a task searches for at once, and bytes of vectors that it holds of the corpus.
QUERY_ROWS, GROUP_BYTES = 20_480, 32 << 20
#: Distances of one matrix, and hits that are taken up at once.
TILE, HITS = 1 << 18, 1 << 18
#: One of so many texts gives the first bounds of distances.
SHARE = 16
FIT_ROUNDS = 10
_MOST = np.uint64(2**64 - 1)


def keys_of(texts: list[str]) -> np.ndarray:
    """The first 64 bits of md5; they break ties, seed the draw and tell a record's own texts."""
    return np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big") for t in texts], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's last steps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of the same number, in double precision."""
    out = np.empty(len(a))
    for at in range(0, len(a), 16_384):
        d = a[at : at + 16_384].astype(np.float64) - b[at : at + 16_384]
        out[at : at + 16_384] = np.sqrt((d * d).sum(axis=1))
    return out


def nearest_centres(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((len(x), n), dtype=np.int32)
    own = (centres**2).sum(axis=1)
    for at in range(0, len(x), 2048):
        d = own - 2 * (x[at : at + 2048] @ centres.T)
        out[at : at + 2048] = d.argmin(axis=1)[:, None] if n == 1 else np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.arange(n)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows, dtype=np.float32)
    at = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def _matrix(column: pa.Array) -> np.ndarray:
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(np.float32).reshape(len(column), -1)


def _open(uri: str) -> pq.ParquetFile:
    fs, path = FileSystem.from_uri(uri)
    return pq.ParquetFile(fs.open_input_file(path))


class TextLists:
    """Distinct texts in files, as one list, which is exact search; with exact_pairs, beyond that number of pairs each in the list of its nearest centre."""

    def __init__(self, texts: DataFrame, path: str, encoder, prefix: str, queries: int = 0, exact_pairs: int | None = None, seed: int = 22):
        spark = texts.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = b.column(0).to_pylist()
                if t:
                    yield pa.RecordBatch.from_arrays([pa.array(keys_of(t).view(np.int64)), _binary(encoder.encode([prefix + x for x in t])), b.column(0)], ["key", "vector", "text"])

        kind = "key BIGINT, vector BINARY, text STRING"
        texts.select("text").repartition(parts, "text").distinct().mapInArrow(write, kind).write.parquet(f"{path}/texts")
        corpus = spark.read.schema(kind).parquet(f"{path}/texts")
        self.n, self.files, self.centres, self.lists, self.probes = corpus.count(), sorted(corpus.inputFiles()), None, None, 1
        if exact_pairs is not None and self.n * queries > exact_pairs:
            lists, self.probes = ivf_sizes(self.n)
            self.centres = _fit(corpus, self.n, lists, seed)
            self.probes = min(self.probes, len(self.centres))
            centres = self.centres

            def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for uri in b["uri"]:
                        near = [nearest_centres(_matrix(x.column(0)), centres, 1)[:, 0] for x in _open(uri).iter_batches(8192, columns=["vector"])]
                        yield pd.DataFrame({"uri": [uri], "lists": [np.concatenate(near).astype(np.int16).tobytes() if near else b""]})

            named = spark.createDataFrame([(u,) for u in self.files], "uri STRING").repartition(len(self.files))
            named.mapInPandas(assign, "uri STRING, lists BINARY").write.parquet(f"{path}/lists")
            self.lists = sorted(spark.read.schema("uri STRING, lists BINARY").parquet(f"{path}/lists").inputFiles())


def _fit(corpus: DataFrame, n: int, lists: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's method in one task, on a bounded number of texts; every text gets a list."""
    picked = corpus.filter(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n)) < FIT_ROWS).select("key", "vector").repartition(1)

    def lloyd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if len(b)]
        if not got:
            return
        x = np.concatenate([v for _, v in got])[np.argsort(np.concatenate([k for k, _ in got]), kind="stable")]
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(FIT_ROUNDS):
            near = nearest_centres(x, centres, 1)[:, 0]
            order = np.argsort(near, kind="stable")
            found, first, size = np.unique(near[order], return_index=True, return_counts=True)
            centres = x[rng.choice(len(x), len(centres))]  # for those that lost all their texts
            centres[found] = np.add.reduceat(x[order], first, axis=0) / size[:, None]
        yield pa.RecordBatch.from_arrays([_binary(centres)], ["centre"])

    return np.array([np.frombuffer(r.centre, dtype=np.float32) for r in picked.mapInArrow(lloyd, "centre BINARY").collect()])  # 4,096 at most


def _joined(held: list[tuple]) -> list[np.ndarray | None]:
    """The columns of the batches, which are let go."""
    out = [None if x[0] is None else np.concatenate(x) for x in zip(*held)]
    held.clear()
    return out


def _groups(files: list[str], lists: list[str] | None, dims: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(number of the first row, keys, vectors, lists) of the first `most` rows, some files' batches together."""
    own: dict[str, bytes] = {}
    for uri in lists or ():
        for r in _open(uri).read().to_pylist():
            own[r["uri"]] = r["lists"]
    limit, first, held, n = max(1, GROUP_BYTES // (4 * dims)), 0, [], 0
    for uri in files:
        at, own_lists = 0, np.frombuffer(own[uri], dtype=np.int16) if lists is not None else None
        for b in _open(uri).iter_batches(min(limit, 32_768), columns=["key", "vector"]):
            b = b.slice(0, most - first - n)
            held.append((b.column(0).to_numpy().view(np.uint64), _matrix(b.column(1)), None if own_lists is None else own_lists[at : at + len(b)]))
            at, n = at + len(b), n + len(b)
            if n >= limit or first + n >= most:
                yield first, *_joined(held)
                first, n = first + n, 0
            if first >= most:
                return
    if held:
        yield first, *_joined(held)


def _met(group: tuple, probing: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(places among the pairs of query and probe, rows of the group, their vectors) of each list, in pieces of `width` rows."""
    lists, x, order = group[3], group[2], None
    if lists is None:
        starts = np.array([0, len(x)])
    else:
        order = np.argsort(lists, kind="stable")
        starts, x = np.searchsorted(lists[order], np.arange(len(probing[1]))), x[order]
    for at, (a, b) in enumerate(zip(probing[1][:-1], probing[1][1:])):
        for c in range(starts[at], starts[at + 1], width) if b > a else ():
            rows = slice(c, min(c + width, starts[at + 1]))
            yield slice(a, b), np.arange(rows.start, rows.stop) if order is None else order[rows], x[rows]


def _below(asked: np.ndarray, i: np.ndarray, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(places of i, of each hit the place from there on, its row of x) where asked[i] @ x.T is not above 0, some tiles together.

    A tile stays in a core's cache, and hits are few: 64 cells are looked at as one number.
    """
    step = max(1, TILE // len(x))
    whole = len(i) == len(asked)  # then i counts them all, as with one list
    d, hit = np.empty((step, len(x)), dtype=np.float32), np.zeros(-(-step * len(x) // 64) * 64, dtype=bool)
    eights = hit.view(np.uint64).reshape(8, -1)
    held, first, n = [], 0, 0
    for at in range(0, len(i), step):
        end = min(at + step, len(i))
        own, cells = d[: end - at], (end - at) * len(x)
        np.matmul(asked[at:end] if whole else asked[i[at:end]], x.T, out=own)
        np.less_equal(own.ravel(), 0, out=hit[:cells])
        hit[cells:] = False
        some = np.flatnonzero(np.bitwise_or.reduce(eights, axis=0))
        at64 = np.flatnonzero(eights.take(some, axis=1).view(bool))
        line, cell = np.divmod(at64, 8 * max(1, len(some)))
        held.append((line * eights.shape[1] + some[cell >> 3]) * 8 + (cell & 7) + (at - first) * len(x))
        n += len(at64)
        if n >= HITS or end == len(i):
            if n:
                yield slice(first, end), *np.divmod(np.concatenate(held), len(x))
            held, first, n = [], end, 0


def search(q: np.ndarray, files: list[str], lists: list[str] | None, centres: np.ndarray | None, probes: int, total: int, k: int, bounded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances, keys, rows) of each query's k nearest in its lists, ties to nine digits by key; what is missing is infinite.

    A query's first bound is the distance that, by a SHARE of the corpus, enough candidates keep; queries with fewer than k
    within their bound are searched again without one, so the result does not depend on it.
    """
    n_lists, n = 1 if centres is None else len(centres), len(q)
    bound, mean = np.full(n, np.inf), k / SHARE
    r = int(mean + 3 * mean**0.5 + 2)
    if bounded and total > 4 * SHARE * k:
        bound = search(q, files, lists, centres, probes, total // SHARE, r)[0][:, r - 1].copy()
    near = np.zeros((n, 1), dtype=np.int32) if centres is None else nearest_centres(q, centres, probes)
    pairs = np.argsort(near.ravel(), kind="stable")
    probing = (pairs // near.shape[1], np.searchsorted(near.ravel()[pairs], np.arange(n_lists + 1)))
    width = max(128, k + k // 2)
    cap = k + width
    dist, key, row = np.full((n, cap), np.inf), np.full((n, cap), _MOST), np.zeros((n, cap), dtype=np.int64 if total >= 2**31 else np.int32)
    fill, size = np.zeros(n, dtype=np.int64), (q * q).sum(axis=1)
    # Times a vector, its length and 1, a row gives the squared distance over the limit; the slack covers single precision.
    slack = 1e-5 * max(1, q.shape[1] / 64)
    limit = lambda of, far: np.maximum(size[of] * (1 - slack) - (far + 1e-9) ** 2, -1e38)
    asked = np.column_stack([-2 * q, np.ones(n), limit(slice(None), bound)]).astype(np.float32)

    def settle(some: np.ndarray) -> None:
        """Of these queries only the k best stay, in order."""
        for at in range(0, len(some), 2048):
            s = some[at : at + 2048]
            most = int(fill[s].max())
            d, own, rows = dist[s, :most], key[s, :most], row[s, :most]
            order = np.lexsort((own, np.floor(d * 1e9)), axis=-1)[:, :k]
            got = order.shape[1]
            dist[s], key[s] = np.inf, _MOST
            dist[s, :got], key[s, :got], row[s, :got] = (np.take_along_axis(v, order, 1) for v in (d, own, rows))
            fill[s] = np.minimum(fill[s], k)

    for group in _groups(files, lists, q.shape[1], total):
        for p, rows, x in _met(group, probing, width):
            here = probing[0][p]
            for some, a, b in _below(asked, here, np.column_stack([x, (x * x).sum(axis=1) * (1 - slack), np.ones(len(x))]).astype(np.float32)):
                i = here[some]
                count = np.bincount(a, minlength=len(i))
                full = i[fill[i] + count > cap]
                if len(full):
                    settle(full)
                    asked[full, -1] = limit(full, np.minimum(bound[full], dist[full, k - 1]))
                slot = fill[i][a] + np.arange(len(a)) - (np.cumsum(count) - count)[a]
                own = i[a]
                for at in range(0, len(a), 16_384):
                    s = slice(at, at + 16_384)
                    dist[own[s], slot[s]] = distances(q[own[s]], x[b[s]])
                key[own, slot], row[own, slot] = group[1][rows[b]], group[0] + rows[b]
                fill[i] += count
    settle(np.flatnonzero(fill > 0))
    dist, key, row = dist[:, :k].copy(), key[:, :k].copy(), row[:, :k].copy()
    short = np.flatnonzero(np.isfinite(bound) & ~(dist[:, k - 1] <= bound))
    if len(short):
        dist[short], key[short], row[short] = search(q[short], files, lists, centres, probes, total, k, False)
    return dist, key, row


def _once(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all different vectors, and for each row the place of its own among them."""
    _, first, same = np.unique(q.view(np.dtype((np.void, q.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    return first, same


def _texts_at(files: list[str], rows: np.ndarray) -> pa.Array:
    """The texts at these row numbers, which ascend and are all different."""
    got, first = [pa.array([], pa.large_string())], 0
    for uri in files:
        for b in _open(uri).iter_batches(32_768, columns=["text"]):
            a, z = np.searchsorted(rows, (first, first + len(b)))
            if z > a:
                got.append(b.column(0).take(pa.array(rows[a:z] - first)).cast(pa.large_string()))
            first += len(b)
    return pa.concat_arrays(got)


def with_negatives(records: DataFrame, corpus: TextLists, encoder, prefix: str, passage: str, lo: int, hi: int, filter_topk: int | None, seed: int) -> DataFrame:
    """Adds `more` to records (query_id, query, pos, need): up to `need` texts from places lo..hi-1 (from 0), those with the smallest digests.

    A record's own positives and its query are left out. With filter_topk, records that need texts are left out whose
    nearest positive is farther than the neighbour at that place.
    """
    files, lists, centres, probes, total = corpus.files, corpus.lists, corpus.centres, corpus.probes, corpus.n
    k = min(max(hi, 0 if filter_topk is None else filter_topk + 1), total)

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        need = table.column("need").to_numpy()
        asked = np.flatnonzero(need > 0)
        kept, count, more = np.ones(len(need), dtype=bool), np.zeros(len(need), dtype=np.int64), pa.array([], pa.large_string())
        back = np.zeros(0, dtype=np.int64)
        if len(asked) and k:
            own = table.take(pa.array(asked))
            queries, pos = own.column("query").to_pylist(), own.column("pos").to_pylist()
            q = np.ascontiguousarray(encoder.encode([prefix + t for t in queries]), dtype=np.float32)
            once, same = _once(q)
            dist, key, row = (v[same] for v in search(q[once], files, lists, centres, probes, total, k))
            of, flat = np.repeat(np.arange(len(pos)), [len(p) for p in pos]), [t for p in pos for t in p]
            if filter_topk is not None and filter_topk < k:
                closest = np.full(len(q), np.inf)
                for at in range(0, len(flat), 8192):
                    i = of[at : at + 8192]
                    np.minimum.at(closest, i, distances(q[i], np.asarray(encoder.encode([passage + t for t in flat[at : at + 8192]]), dtype=np.float32)))
                kept[asked] = ~(np.floor(closest * 1e9) > np.floor(dist[:, filter_topk] * 1e9))
            dist, key, row = dist[:, lo:hi], key[:, lo:hi], row[:, lo:hi]
            good = np.isfinite(dist) & (key != keys_of(queries)[:, None]) & kept[asked][:, None]
            own_keys, nth = keys_of(flat), np.arange(len(of)) - np.searchsorted(of, of)
            for t in range(int(nth.max(initial=-1)) + 1):
                s = nth == t
                good[of[s]] &= key[of[s]] != own_keys[s][:, None]
            seeds = keys_of([f"{seed}|mine|{x}" for x in own.column("query_id").to_pylist()])
            digest = np.where(good, mixed(seeds[:, None] ^ mixed(key)), _MOST)
            order = np.lexsort((key, digest), axis=-1)
            count[asked] = np.minimum(good.sum(axis=1), need[asked])
            picked = np.arange(order.shape[1]) < count[asked][:, None]
            rows, back = np.unique(np.take_along_axis(row, order, 1)[picked], return_inverse=True)
            more = _texts_at(files, rows)
        ends = np.concatenate([[0], np.cumsum(count)])
        for at in range(0, len(need), 1024):
            own, e = table.slice(at, 1024), ends[at : at + 1025]
            got = more.take(pa.array(back[e[0] : e[-1]])).cast(pa.string())
            own = own.append_column("more", pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), got))
            yield from own.filter(pa.array(kept[at : at + 1024])).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= QUERY_ROWS:
                yield from block(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from block(pa.Table.from_batches(held))

    kinds = dict(records.dtypes)
    return records.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in records.columns) + ", more ARRAY<STRING>")
