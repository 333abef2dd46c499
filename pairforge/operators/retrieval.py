"""Nearest neighbours, exact and by inverted lists; reranking; mining over vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType

from pairforge.functions.rand import det_key
from pairforge.functions.vectors import dot
from pairforge.session import staged, work_dir

#: Queries of one block; a block of vectors goes to every executor (at 1,024 dimensions 32 MB).
BLOCK = 4096
#: Vectors on which the lists' centres are fitted.
FIT_ROWS = 100_000
#: Rows of the corpus in a task, where there are several blocks of queries.
CORPUS_BLOCK = 50_000


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, distance) of each query's k nearest rows; ties to nine digits by id."""
    rough = (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * (q @ x.T)
    m = min(k + 8, x.shape[0])
    near = np.argpartition(rough, m - 1, axis=1)[:, :m] if m < x.shape[0] else np.tile(np.arange(m), (len(q), 1))
    i, j = np.repeat(np.arange(len(q)), m), near.ravel()
    d = np.sqrt(((q[i] - x[j]) ** 2).sum(axis=1))
    order = np.lexsort((ids[j], np.floor(d * 1e9), i))
    keep = np.arange(len(i)) % m < k
    return i[order][keep], j[order][keep], d[order][keep]


def _scan(ids: np.ndarray, labels: np.ndarray | None, q: np.ndarray, k: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        closest = np.full(len(ids), np.inf)
        for batch in batches:
            if not len(batch):
                continue
            x, rows = _matrix(batch["vector"]), batch["id"].to_numpy()
            i, j, d = _top(q, x, rows, k + 1)  # one may be the query itself
            got = pd.DataFrame({"query_id": ids[i], "id": rows[j], "dist": d})
            got = got[got["query_id"] != got["id"]]
            best = got if best is None else pd.concat([best, got])
            best = best.assign(f=np.floor(best["dist"] * 1e9)).sort_values(["query_id", "f", "id"]).groupby("query_id").head(k).drop(columns="f")
            if labels is not None:
                own = batch["label"].to_numpy()
                for label in np.unique(labels):
                    mine, same = np.flatnonzero(labels == label), own == label
                    if same.any():
                        gi, gj, gd = _top(q[mine], x[same], rows[same], 2)
                        other = ids[mine][gi] != rows[same][gj]
                        np.minimum.at(closest, mine[gi[other]], gd[other])
        if best is not None:
            yield best.assign(closest=np.nan)
            if labels is not None:
                seen = np.isfinite(closest)
                yield pd.DataFrame({"query_id": ids[seen], "id": pd.array([None] * seen.sum(), dtype="Int64"), "dist": np.nan, "closest": closest[seen]})

    return scan


def rank(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Adds each pair's rank from 1 by distance (ties to nine digits by id); the first k if given."""
    ranked = pairs.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY floor(dist * 1e9), id)"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _exact(queries: DataFrame, corpus: DataFrame, k: int, block: int) -> DataFrame:
    """One block of queries, by its counted size, goes to every partition of the corpus, which stays where it is.

    More queries are dealt into blocks, and so is the corpus; each pair of blocks meets in one task. Every row is sent once
    for each block of the other side, and no more than two blocks are in a task or, of many, on the driver.
    """
    spark, schema = corpus.sparkSession, "query_id BIGINT, id BIGINT, dist DOUBLE, closest DOUBLE"
    queries = queries.select(*[c for c in ("query_id", "vector", "label") if c in queries.columns])
    corpus = corpus.select(*[c for c in ("id", "vector", "label") if c in corpus.columns and (c != "label" or c in queries.columns)])
    n = queries.count()
    if n <= block:
        q = queries.toPandas()
        return corpus.mapInPandas(_scan(q["query_id"].to_numpy(), q["label"].to_numpy() if "label" in q else None, _matrix(q["vector"]), k), schema) if n else spark.createDataFrame([], schema)
    rows, cols = -(-n // block), max(1, -(-corpus.count() // CORPUS_BLOCK))
    across = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.withColumn("row", F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int")).withColumn("col", across(cols))
    # Names of its own, as both sides may come from one table.
    right = corpus.select(*[F.col(c).alias(f"c_{c}") for c in corpus.columns]).withColumn("col", F.pmod(F.xxhash64("c_id"), F.lit(cols)).cast("int")).withColumn("row", across(rows))

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        x = x.rename(columns=lambda c: c.removeprefix("c_"))
        parts = [pd.DataFrame({"query_id": [], "id": [], "dist": [], "closest": []})]
        for a in range(0, len(q), block):
            own = q.iloc[a : a + block]
            parts += _scan(own["query_id"].to_numpy(), own["label"].to_numpy() if "label" in own else None, _matrix(own["vector"]), k)(iter([x]))
        return pd.concat(parts).astype({"query_id": "int64", "id": "Int64"})

    return left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInPandas(meet, schema)


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, id, dist, rank) of queries (query_id, vector) against corpus (id, vector), others than itself.

    A stated set of queries goes over the corpus in blocks; every block of the corpus keeps its k best for each query, so k
    rows for each query and block are shuffled. With fewer than k others all come out.
    """
    return rank(_exact(queries.select("query_id", "vector"), corpus.select("id", "vector"), k, block).drop("closest"), k)


def ivf_sizes(n: int) -> tuple[int, int]:
    """lists and probes for n vectors."""
    lists = max(1, min(4096, int(n**0.5)))
    return lists, min(lists, 32)


class Ivf:
    """Centres fitted on a bounded sample; every vector is put into the list of its nearest centre."""

    def __init__(self, corpus: DataFrame, lists: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 22):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = corpus.count()
        self.n_lists = min(lists or ivf_sizes(n)[0], max(n, 1))
        picked = corpus.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n, 1))) < fit_rows).select(array_to_vector("vector").alias("features"))
        self.centres = np.array(KMeans(k=self.n_lists, seed=seed, maxIter=10).fit(picked).clusterCenters())
        entries = corpus.select("id", "vector").mapInPandas(_assigner(self.centres, 1), "id BIGINT, vector ARRAY<FLOAT>, list_id INT")
        self.entries = staged(entries, f"{work_dir(corpus.sparkSession)}/lists")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, list_rows: int = 50_000) -> DataFrame:
        """(query_id, id, dist, rank) from each query's nearest lists, by an equi-join on lists; large lists in salted parts."""
        probes = min(probes or min(self.n_lists, 32), len(self.centres))
        asked = queries.select(F.col("query_id").alias("id"), "vector").mapInPandas(_assigner(self.centres, probes), "id BIGINT, vector ARRAY<FLOAT>, list_id INT")
        rows = self.entries.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("parts")).collect()  # 4,096 at most
        n_parts = F.try_element_at(F.create_map(*[F.lit(int(x)) for r in rows for x in r]), F.col("list_id")) if rows else F.lit(1)
        entries = self.entries.withColumn("part", F.pmod(F.xxhash64("id"), n_parts).cast("int"))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(n_parts, F.lit(1)) - 1)))
        found = asked.groupBy("list_id", "part").cogroup(entries.groupBy("list_id", "part")).applyInPandas(_probe(k), "query_id BIGINT, id BIGINT, dist DOUBLE")
        return rank(found, k)


def _assigner(centres: np.ndarray, n: int):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = (centres**2).sum(1)
        for b in batches:
            if len(b):
                d = own[None, :] - 2 * (_matrix(b["vector"]) @ centres.T)
                near = np.argsort(d, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), n), "vector": b["vector"].repeat(n).to_numpy(), "list_id": near.ravel().astype(np.int32)})

    return assign


def _probe(k: int):
    def probe(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": q["id"][:0], "id": q["id"][:0], "dist": []})
        rows, ids = x["id"].to_numpy(), q["id"].to_numpy()
        i, j, d = _top(_matrix(q["vector"]), _matrix(x["vector"]), rows, k + 1)
        own = ids[i] != rows[j]
        return pd.DataFrame({"query_id": ids[i][own], "id": rows[j][own], "dist": d[own]})

    return probe


def search(queries: DataFrame, corpus: DataFrame, k: int, exact_pairs: int = 10_000_000, other_only: bool = True) -> DataFrame:
    """Exact up to a number of pairs, by inverted lists beyond, which find nearly all.

    other_only: an id that is the query's is left out; False where ids of queries and corpus are different things.
    """
    if not other_only:  # ids that no corpus row has
        moved = search(queries.withColumn("query_id", -F.col("query_id") - 1), corpus, k, exact_pairs)
        return moved.withColumn("query_id", -F.col("query_id") - 1)
    if queries.count() * corpus.count() <= exact_pairs:
        return knn_exact(queries, corpus, k)
    return Ivf(corpus).search(queries, k)


def distance(a: Column, b: Column) -> Column:
    from pairforge.functions.vectors import euclidean

    return euclidean(a, b)


def mine(queries: DataFrame, corpus: DataFrame, lo: int = 10, hi: int = 60, negatives: int = 7, filter_topk: int | None = 50, seed: int = 22, block: int = BLOCK) -> DataFrame:
    """(query_id, id, rank, dist) of queries (query_id, vector, label) and corpus (id, vector, label).

    A query whose nearest positive (same label) is farther than its neighbour at place filter_topk (from 0) is left out;
    with fewer neighbours there is no such test. From the neighbours lo..hi-1 (from 0) positives are left out, and of more
    than `negatives` those with the smallest digests stay.
    """
    depth = max(hi, 0 if filter_topk is None else filter_topk + 1)
    found = _exact(queries, corpus, depth, block)
    ranked = rank(found.filter(F.col("id").isNotNull()).drop("closest"), depth)
    if filter_topk is not None:
        closest = found.filter(F.col("id").isNull()).groupBy("query_id").agg(F.min("closest").alias("closest"))
        limit = ranked.filter(F.col("rank") == filter_topk + 1).select("query_id", F.col("dist").alias("limit"))
        bad = closest.join(limit, "query_id").filter(F.floor(F.col("closest") * 1e9) > F.floor(F.col("limit") * 1e9)).select("query_id")
        ranked = ranked.join(bad, "query_id", "left_anti")
    near = ranked.filter((F.col("rank") > lo) & (F.col("rank") <= hi))
    own = queries.select("query_id", F.col("label").alias("own_label"))
    hard = near.join(own, "query_id").join(corpus.select("id", "label"), "id").filter(F.col("label") != F.col("own_label"))
    picked = hard.withColumn("_key", det_key(seed, "mine", "query_id", "id")).withColumn("_n", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY _key, id)"))
    return picked.filter(F.col("_n") <= negatives).select("query_id", "id", "rank", "dist")


def pair_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, id, score) of pairs (query_id, id), the vectors looked up on both sides.

    left: (query_id, q), right: (id, d): for instance stored document states, which are computed once and kept (V19).
    """
    return pairs.join(left, "query_id").join(right, "id").select("query_id", "id", score(F.col("q"), F.col("d")).alias("score"))


def cross_features(q: Column, d: Column, size: int) -> Column:
    """Of two states of `heads` matrices size x size (flattened row by row): for each pair of rows the dot product over all heads."""
    heads = F.floor(F.size(q) / (size * size)).cast("int")
    row = lambda v, s: F.flatten(F.transform(F.sequence(F.lit(0), heads - 1), lambda h: F.slice(v, h * size * size + s * size + 1, size)))
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), f)
    return F.flatten(each(lambda s: each(lambda t: dot(row(q, s), row(d, t)))))


def head_scores(x: np.ndarray, hidden: np.ndarray, out: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Layer norm, hidden layer, positive part, output, for each row of features."""
    x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + eps) * gain + bias
    return np.maximum(x @ hidden.T, 0) @ out


def ranking_head(hidden: np.ndarray, out: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-5):
    """An Arrow function from cross features to scores."""

    @F.pandas_udf(DoubleType())
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(head_scores(_matrix(features), hidden, out, gain, bias, eps))

    return score


def score_features(pairs: DataFrame, hidden: np.ndarray, out: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> DataFrame:
    """(query_id, id, score) of pairs (query_id, id, features), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"query_id": b["query_id"], "id": b["id"], "score": head_scores(_matrix(b["features"]), hidden, out, gain, bias, eps)})

    types = dict(pairs.dtypes)
    return pairs.select("query_id", "id", "features").mapInPandas(run, f"query_id {types['query_id']}, id {types['id']}, score DOUBLE")


def _norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + eps) * gain + bias


def task_heads(rows: DataFrame, heads: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, vector) of (id, task_id, vector): each row through its task's head, a residual layer under a layer norm.

    heads: for each task id the weights in (hidden x size) and out (size x hidden), gain and bias. A row whose task has no head
    gives zeros; a null vector stays null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list = [None] * len(b)
            some = np.flatnonzero(b["vector"].notna())
            if len(some):
                x, task = _matrix(b["vector"].iloc[some]), b["task_id"].iloc[some].to_numpy()
                y = np.zeros_like(x)
                for t, (w1, w2, gain, bias) in heads.items():
                    own = task == t
                    y[own] = _norm(np.maximum(x[own] @ w1.T, 0) @ w2.T + x[own], gain, bias)
                for i, v in zip(some, y):
                    out[i] = v
            yield pd.DataFrame({"id": b["id"], "vector": out})

    return rows.select("id", "task_id", "vector").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, vector ARRAY<DOUBLE>")


def pool_patches(rows: DataFrame, size: int, side: int, gate: np.ndarray, out: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> DataFrame:
    """V25, without the image network: (id, vector) of (id, patches), patches being a square grid of vectors of `size` numbers, row by row.

    The grid is averaged down to side x side cells (a cell takes all patches that it touches), each cell is gated by itself,
    projected and normed. Grids of another shape than a square raise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for p in b["patches"]:
                x = np.asarray(p, dtype=np.float64).reshape(-1, size)
                n = int(len(x) ** 0.5)
                if n * n != len(x):
                    raise ValueError(f"{len(x)} patches are no square")
                cells = [
                    x.reshape(n, n, size)[i * n // side : -(-(i + 1) * n // side), j * n // side : -(-(j + 1) * n // side)].mean(axis=(0, 1)) for i in range(side) for j in range(side)
                ]
                c = np.array(cells)
                found.append(_norm((c / (1 + np.exp(-(c @ gate.T)))) @ out.T, gain, bias).ravel())
            yield pd.DataFrame({"id": b["id"], "vector": found})

    return rows.select("id", "patches").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, vector ARRAY<DOUBLE>")


def rerank(scored: DataFrame, k: int = 100) -> DataFrame:
    """The k best by score (to nine digits, ties by id), ranked anew."""
    ranked = scored.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9) DESC, id)"))
    return ranked.filter(F.col("rank") <= k)


class HashEncoder:
    """An encoder that needs no weights; any object with encode(list of texts) -> matrix may take its place."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        known: dict[str, int] = {}  # a word's place; negative ones, counted from -1, take off
        places, ends = [], [0]
        for t in texts:
            for w in (t or "").lower().split():
                if (p := known.get(w)) is None:
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    known[w] = p = h % self.dimensions if h >> 63 else -1 - h % self.dimensions
                places.append(p)
            ends.append(len(places))
        p, row = np.array(places, dtype=np.int64), np.repeat(np.arange(len(texts)), np.diff(ends))
        at = row * self.dimensions + np.where(p < 0, -1 - p, p)
        out = np.bincount(at, np.where(p < 0, -1.0, 1.0), len(texts) * self.dimensions).reshape(len(texts), self.dimensions).astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def encode(texts: DataFrame, id_col: str, text_col: str, encoder=None, prefix: str = "") -> DataFrame:
    """(id, vector), unit length (a text without words is a zero vector); one encoder for each worker."""
    encoder = encoder or HashEncoder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b[id_col], "vector": list(encoder.encode([prefix + (t or "") for t in b[text_col].tolist()]))})

    return texts.select(id_col, text_col).mapInPandas(run, f"id {dict(texts.dtypes)[id_col]}, vector ARRAY<FLOAT>")


def recur(rows: DataFrame, n: int) -> DataFrame:
    """(id, outputs, state) of (id, steps, state): a state of n x n numbers carried over steps of r, w, k, v, a, b (n numbers each).

    S <- S * exp(-exp(w)) by columns + (S a) b^T + v k^T, output S r. A null state is zero. Rows with as many steps as each
    other go together through each step; a sequence in pieces, each with the state of the one before, gives what it gives whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["steps"].map(len)
            for t, own in batch.groupby(length):
                state = np.stack([np.zeros(n * n) if s is None else np.asarray(s, dtype=np.float64) for s in own["state"]]).reshape(-1, n, n)
                x = np.array([[np.asarray(v, dtype=np.float64) for v in s] for s in own["steps"]]).reshape(len(own), t, 6, n)
                out = np.zeros((len(own), t, n))
                for i in range(t):
                    r, w, k, v, a, b = (x[:, i, j] for j in range(6))
                    state = state * np.exp(-np.exp(w))[:, None, :] + np.einsum("nij,nj->ni", state, a)[:, :, None] * b[:, None, :] + v[:, :, None] * k[:, None, :]
                    out[:, i] = np.einsum("nij,nj->ni", state, r)
                yield pd.DataFrame({"id": own["id"].to_numpy(), "outputs": list(out.reshape(len(own), -1)), "state": list(state.reshape(len(own), -1))})

    return rows.select("id", "steps", "state").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, outputs ARRAY<DOUBLE>, state ARRAY<DOUBLE>")


class OverlapScorer:
    """A pair scorer that needs no weights: shared words over all words. Any object with score(list of pairs) -> numbers may take its place."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for a, b in pairs:
            x, y = ({w for w in t.split(" ") if w} for t in (a, b))
            out.append(len(x & y) / len(x | y) if x or y else 0.0)
        return out


def predict_pairs(pairs: DataFrame, scorer=None, batch: int = 32) -> DataFrame:
    """Adds `score` to pairs (query, text), batch by batch; a null on either side has no score. One scorer for each worker."""
    scorer = scorer or OverlapScorer()

    @F.pandas_udf(DoubleType())
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.full(len(left), np.nan)
        some = np.flatnonzero(left.notna() & right.notna())
        for a in range(0, len(some), batch):
            at = some[a : a + batch]
            out[at] = scorer.score(list(zip(left.iloc[at], right.iloc[at])))
        return pd.Series(out)

    return pairs.withColumn("score", F.nanvl(score("query", "text"), F.lit(None)))


def fold_states(tokens: DataFrame, step: Callable[[np.ndarray, int], np.ndarray], width: int) -> DataFrame:
    """(id, state) of (id, ids): a state carried over a token sequence; a sequence in pieces gives the same state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            states = []
            for ids in b["ids"].tolist():
                s = np.zeros(width)
                for t in ids:
                    s = step(s, t)
                states.append(s)
            yield pd.DataFrame({"id": b["id"], "state": states})

    return tokens.select("id", "ids").mapInPandas(run, f"id {dict(tokens.dtypes)['id']}, state ARRAY<DOUBLE>")
