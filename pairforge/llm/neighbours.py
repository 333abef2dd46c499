"""Problem 3: the k most similar vectors for every vector, by NN-descent; queries by greedy search of the graph.

Equal vectors form a class, and the graph is built over classes: of a class, only its k + 1 smallest ids can be among
anyone's k nearest, so a vector that fills a third of the table costs one node and one short list.

Start: random-projection trees, fitted on a bounded sample, cut the nodes into blocks, once for each tree. A node travels
with its list from block to block; in a block each node's list takes the best of the block. Blocks below what the sample
can resolve are cut further by random planes through their sample mean.

Descent: every node has a home, its block in the last tree. In each round a home gathers, by joins, the vectors of its
nodes' neighbours and of those that name its nodes as neighbours, and compares for each of its nodes the neighbours and
reverse neighbours with each other, if one of the two is new in that relation. Pairs that shared a block have been
compared already and are left out. What beats the end of a list goes to that node's home as an update. Lists and vectors
are kept apart: vectors are written once, lists each round. Only nodes that changed, or were named in an update, are
centres of the next round; the descent goes on until fewer than ENOUGH of all entries change, without a limit of rounds
(lists only ever improve, so it ends). A table of one block is compared whole and needs no descent.

The final lists, of more than k entries, are ordered by similarities from the full vectors in double precision; entries
that half precision tells apart from the k-th place for certain are not measured again.

Approximate by nature: reverse neighbours are sampled (REVERSE for a node and round, new ones first, others each round).
Recall against brute force is measured in tests and in the README.

Defined results: null vectors, those with null or non-finite entries, and zero vectors take no part; vectors of another
length than the first are an error of the table and raise; similarities that agree to nine digits are equal and the
smaller id goes first; with fewer than k others, all of them are neighbours; an empty table gives no rows; repeated rows
of an id are the caller's error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.operators.skew import hot_join
from pairforge.session import drop_dir, staged, work_dir

K = 5
#: Entries of a node's list while the graph is built.
WIDTH = 16
#: Reverse neighbours of a node that take part in a round.
REVERSE = 16
#: Nodes of a block, about; a block is compared whole.
BLOCK = 12_800
TREES = 6
#: Below this share of changed entries there is no further round.
ENOUGH = 0.002
#: Vectors on which the trees are fitted (held by the driver).
SAMPLE = 16_384
LEAST_LEAF = 16
#: Trees in whose blocks queries look for their entries.
DOORS = 3
#: By how much a similarity of half-precision unit vectors may be off.
HALF_ERROR = 0.001


@dataclass(frozen=True)
class Tree:
    """Node i splits at planes[i] . x > cuts[i] into left[i] and right[i]; left[i] < 0: a leaf.

    A leaf that stands for more than a block is cut into 2 ** bits[i] parts by planes through its mean.
    """

    planes: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    means: np.ndarray
    bits: np.ndarray
    first: np.ndarray
    across: np.ndarray

    @property
    def blocks(self) -> int:
        return int(self.first[-1])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        while (inner := self.left[node] >= 0).any():
            at = node[inner]
            above = np.einsum("ij,ij->i", x[inner], self.planes[at]) > self.cuts[at]
            node[inner] = np.where(above, self.right[at], self.left[at])
        return node

    def block_of(self, x: np.ndarray) -> np.ndarray:
        """Blocks are numbered from 0 without gaps."""
        leaf = self.leaf_of(x)
        code = np.zeros(len(x), dtype=np.int64)
        if len(self.across):
            sides = (x - self.means[leaf]) @ self.across.T > 0
            for b in range(len(self.across)):
                code += (sides[:, b] & (b < self.bits[leaf])).astype(np.int64) << b
        return (self.first[leaf] + code).astype(np.int32)


def fit_tree(x: np.ndarray, scale: float, block: int, rng: np.random.Generator) -> Tree:
    """A tree over sample vectors, each of which stands for `scale` of the table."""
    planes, cuts, left, right, means, bits = [], [], [], [], [], []

    def grow(own: np.ndarray) -> int:
        i = len(cuts)
        planes.append(np.zeros(x.shape[1]))
        cuts.append(0.0)
        left.append(-1)
        right.append(-1)
        means.append(x[own].mean(axis=0))
        bits.append(0)
        if len(own) * scale <= block:
            return i
        for _ in range(4 if len(own) >= 2 * LEAST_LEAF else 0):
            a, b = x[rng.choice(own, 2, replace=False)]
            side = x[own] @ (a - b)
            cut = float(np.median(side))
            above = side > cut
            if LEAST_LEAF <= above.sum() <= len(own) - LEAST_LEAF:
                planes[i], cuts[i] = a - b, cut
                left[i] = grow(own[~above])
                right[i] = grow(own[above])
                return i
        bits[i] = int(np.ceil(np.log2(len(own) * scale / block)))
        return i

    grow(np.arange(len(x)))
    sizes = np.where(np.array(left) < 0, 1 << np.array(bits), 0)
    first = np.concatenate(([0], np.cumsum(sizes)))
    return Tree(np.array(planes), np.array(cuts), np.array(left), np.array(right), np.array(means), np.array(bits), first, rng.normal(size=(max(bits), x.shape[1])))


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # tiny and huge vectors keep their direction
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _half(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float16).reshape(len(column), -1).astype(np.float32)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            vectors = b.column("vector")
            sizes = np.asarray(vectors.value_lengths())
            flat = vectors.flatten().to_numpy().astype(np.float32)
            even = (sizes == sizes[0]).all()  # if not, the trees' fit raises
            raw = _binary(flat.reshape(len(sizes), -1)) if even else pa.array([v.tobytes() for v in np.split(flat, np.cumsum(sizes)[:-1])], type=pa.binary())
            yield _batch(key=b.column("key"), id=b.column("id"), raw=raw, first=b.column("first"))


def _by(key: str, *order):
    return Window.partitionBy(key).orderBy(*order)


def classes_of(vectors: DataFrame, k: int, path: str) -> tuple[DataFrame, DataFrame]:
    """((id, raw, first) of each class, (id, class) of the members that do not name their class), both staged; raw: the vector's 4-byte floats.

    A class is named by its smallest id; first: its k + 1 smallest ids.
    """
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").alias("id"), F.transform("vector", lambda x: x + F.lit(0.0).cast("float")).alias("vector")).filter(good)
    keyed = rows.withColumn("key", F.struct(F.xxhash64(F.lit(1), "vector").alias("a"), F.xxhash64(F.lit(2), "vector").alias("b")))
    # The limit is applied before the shuffle too, so no task gets a hot class.
    few = keyed.withColumn("nth", F.row_number().over(_by("key", "id"))).filter(F.col("nth") <= k + 1)
    nodes = few.groupBy("key").agg(F.min("id").alias("id"), F.min_by("vector", "id").alias("vector"), F.sort_array(F.collect_list("id")).alias("first"))
    nodes = staged(nodes.mapInArrow(_packed, "key STRUCT<a: BIGINT, b: BIGINT>, id BIGINT, raw BINARY, first ARRAY<BIGINT>"), f"{path}/nodes")
    several = nodes.filter(F.size("first") > 1).select("key", F.col("id").alias("class"))
    others = hot_join(keyed.select("id", "key").join(several, "key", "left_semi"), several, "key")
    members = staged(others.filter(F.col("id") != F.col("class")).select("id", "class"), f"{path}/members")
    return nodes.drop("key"), members


def _forest(nodes: DataFrame, n: int, block: int, trees: int, seed: int) -> list[Tree]:
    """Fitted on about SAMPLE vectors, those with the smallest digests of their ids."""
    picked = (nodes.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)) < SAMPLE) if n > SAMPLE else nodes).select("id", "raw").toPandas().sort_values("id")["raw"]
    if picked.map(len).nunique() > 1:
        raise ValueError("vectors of different lengths")
    x, rng = _unit(np.frombuffer(b"".join(picked), dtype=np.float32).reshape(len(picked), -1)), np.random.default_rng(seed)
    return [fit_tree(x, n / len(x), block, rng) for _ in range(trees if n > block else 1)]


# Rows travel as fixed-width binary columns, which are read and written without a step for each row.


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """A binary column of equally long entries as rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0), dtype=dtype)
    width = len(column[0].as_py())
    offset = int(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offset : offset + width * len(column)].view(dtype).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _batch(**columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a stream that is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.array([], type=c.type) if not c.num_chunks else pa.concat_arrays(c.chunks)


def _dealt(rows: DataFrame, blocks: int, key: str, *order: Column | str) -> DataFrame:
    """Whole blocks to tasks, one each up to a number of partitions, then in turn; sorted by block."""
    spark = rows.sparkSession
    most = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = max(1, min(blocks, most))
    return rows.repartitionById(parts, F.pmod(F.col(key), F.lit(parts)).cast("int")).sortWithinPartitions(key, *order)


_PLACED = "id BIGINT, block INT, blocks BINARY, vec BINARY"
_NODE = _PLACED + ", codes BINARY, nbrs BINARY, sims BINARY, homes BINARY"
_LISTS = "id BIGINT, home INT, nbrs BINARY, sims BINARY, homes BINARY, fresh BINARY, active BOOLEAN, changed INT"


def _placer(trees: list[Tree]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column("raw"), np.float32))
                blocks = np.stack([t.block_of(x) for t in trees], axis=1)
                yield _batch(id=b.column("id"), block=blocks[:, 0].copy(), blocks=_binary(blocks), vec=_binary(x.astype(np.float16)))

    return place


def _best(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, n: int, width: int, *more: np.ndarray, unique: bool = False) -> tuple[np.ndarray, ...]:
    """For each of n owners the first `width` different ids by similarity (earlier rows of an id win), as padded matrices (-1, -3)."""
    order = np.arange(len(ids))
    if not unique and len(ids):
        order = np.lexsort((ids, owner))
        o, i = owner[order], ids[order]
        order = order[np.concatenate(([True], (o[1:] != o[:-1]) | (i[1:] != i[:-1])))]
    order = order[np.lexsort((ids[order], -sims[order], owner[order]))]
    o = owner[order]
    place = np.arange(len(o)) - np.searchsorted(o, np.arange(n))[o]
    order, o, place = order[place < width], o[place < width], place[place < width]
    out = []
    for values, fill in ((ids, -1), (sims, -3), *((m, -1) for m in more)):
        a = np.full((n, width), fill, dtype=values.dtype)
        a[o, place] = values[order]
        out.append(a)
    return tuple(out)


#: Found entries that are held before they go into the lists.
HELD = 2_000_000


def _compare_block(ids, x, codes, lists, home, width):
    """The lists (nbrs, sims, homes) of a block's nodes, sorted by id, after all of them have met; pairs of an earlier block (codes) have met."""
    n, lists = len(ids), [m.copy() for m in lists]
    worst = lists[1][:, -1].copy()
    if n > 8 * width and (worst < -2).any():  # a first bound from an eighth of the columns
        some = x[::8]
        for a in range(0, n, 1024):
            s = x[a : a + 1024] @ some.T
            bound = -np.partition(-s, width, axis=1)[:, width]  # one may be the node itself
            worst[a : a + 1024] = np.maximum(worst[a : a + 1024], bound)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        i, j, s = (np.concatenate(c) for c in zip(*held))
        held.clear()
        rows, own = np.unique(i, return_inverse=True)
        have = lists[0][rows] >= 0
        new = _best(
            np.concatenate((np.nonzero(have)[0], own)), np.concatenate((lists[0][rows][have], ids[j])), np.concatenate((lists[1][rows][have], s)), len(rows), width,
            np.concatenate((lists[2][rows][have], home[j])), unique=True,
        )
        for m, values in zip(lists, new):
            m[rows] = values
        worst[rows] = np.maximum(worst[rows], new[1][:, -1])

    for a in range(0, n, 512):
        s = x[a : a + 512] @ x[a:].T  # each pair once
        m = len(s)
        s[:, :m][np.tril_indices(m)] = -4
        for hit, turned in ((np.flatnonzero(s >= worst[a : a + m, None]), False), (np.flatnonzero(s >= worst[None, a:]), True)):
            i, j, sim = hit // s.shape[1] + a, hit % s.shape[1] + a, s.ravel()[hit]
            real = (sim > -3) & (codes[i] != codes[j]).all(axis=1) if codes.shape[1] else sim > -3
            i, j, sim = i[real], j[real], sim[real]
            held.append((j, i, sim) if turned else (i, j, sim))
        if sum(len(h[0]) for h in held) > HELD:
            settle()
    settle()
    return lists


def _tree_step(t: int, trees: int, width: int, block: int):
    """All nodes of each block of tree t; a block that is much larger than planned is taken in parts, in the order of a digest."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "block"):
            parts = -(-group.num_rows // (3 * block))
            size = -(-group.num_rows // parts)
            for part in range(parts):
                rows = group.slice(part * size, size).combine_chunks()
                if not rows.num_rows:
                    continue
                n, by = rows.num_rows, np.argsort(_column(rows, "id").to_numpy(), kind="stable")
                ids, vec, blocks = _column(rows, "id").to_numpy()[by], _matrix(_column(rows, "vec"), np.float16)[by], _matrix(_column(rows, "blocks"), np.int32)[by]
                if t:
                    codes, *lists = (_matrix(_column(rows, c), d)[by] for c, d in (("codes", np.int32), ("nbrs", np.int64), ("sims", np.float32), ("homes", np.int32)))
                else:
                    codes = np.full((n, trees), -1, dtype=np.int32)
                    lists = [np.full((n, width), fill, dtype=d) for fill, d in ((-1, np.int64), (-3, np.float32), (-1, np.int32))]
                nbrs, sims, homes = _compare_block(ids, vec.astype(np.float32), codes[:, :t], lists, blocks[:, -1], width)
                codes[:, t] = (int(blocks[0, t]) * 64 + part) & 0x7FFFFFFF
                following = blocks[:, t + 1] if t + 1 < trees else blocks[:, t]
                yield _batch(id=ids, block=following, blocks=_binary(blocks), vec=_binary(vec), codes=_binary(codes), nbrs=_binary(nbrs), sims=_binary(sims), homes=_binary(homes))

    return step


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(home, id): the neighbours, at home elsewhere, whose vectors the homes of active nodes need."""
    for b in batches:
        on = np.flatnonzero(b.column("active").to_numpy(zero_copy_only=False))
        if len(on):
            nbrs, homes, home = _matrix(b.column("nbrs"), np.int64)[on], _matrix(b.column("homes"), np.int32)[on], b.column("home").to_numpy()[on]
            i, j = np.nonzero((nbrs >= 0) & (homes != home[:, None]))
            pairs = np.unique(np.stack((home[i].astype(np.int64), nbrs[i, j])), axis=1)
            yield _batch(home=pairs[0].astype(np.int32), id=pairs[1])


def _backward(reverse: int, seed: int):
    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(home, id, centre, fresh): edges id -> centre to the homes of centres elsewhere.

        Of the edges of a batch to one centre, `reverse` at most are sent: new ones first, then by a digest.
        """
        for b in batches:
            if not b.num_rows:
                continue
            nbrs, homes, fresh = (_matrix(b.column(c), d) for c, d in (("nbrs", np.int64), ("homes", np.int32), ("fresh", np.int8)))
            i, j = np.nonzero((nbrs >= 0) & (homes != b.column("home").to_numpy()[:, None]))
            own, to, is_fresh = b.column("id").to_numpy()[i], nbrs[i, j], fresh[i, j]
            kept = _sampled(to, own, is_fresh, reverse, seed)
            yield _batch(home=homes[i, j][kept], id=own[kept], centre=to[kept], fresh=is_fresh[kept].astype(bool))

    return backward


def _sampled(to: np.ndarray, own: np.ndarray, fresh: np.ndarray, reverse: int, seed: int) -> np.ndarray:
    """Places of `reverse` edges at most for each `to`."""
    mixed = ((own.astype(np.uint64) ^ (to.astype(np.uint64) << np.uint64(21)) ^ np.uint64(seed)) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.lexsort((own, mixed ^ (mixed >> np.uint64(29)), -fresh.astype(np.int8), to))
    sorted_to = to[order]
    starts = np.concatenate(([True], sorted_to[1:] != sorted_to[:-1])) if len(to) else np.zeros(0, dtype=bool)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(to)), 0)) if len(to) else np.zeros(0, dtype=np.int64)
    return order[np.arange(len(to)) - first < reverse]


_OWN, _GUEST, _EDGE = 0, 1, 2


def _local_join(width: int, reverse: int, seed: int):
    """Neighbours and reverse neighbours of each active node of a home against each other: (home, id, nbr, sim, nbr_home) as updates.

    A pair is compared if one of the two is new to the node and they never shared a block. An update with nbr -1 says that
    a pair of this node went to its other end, so that it is a centre of the next round.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "home"):
            kind, id_ = _column(rows, "kind").to_numpy(), _column(rows, "id").to_numpy()
            n_nodes = int((kind < _EDGE).sum())  # sorted by kind: own, guests, edges
            n_own = int((kind == _OWN).sum())
            if not n_own:
                continue
            home = rows.column("home")[0].as_py()
            order = np.argsort(id_[:n_nodes], kind="stable")
            ids = id_[:n_nodes][order]
            at = np.empty(n_nodes, dtype=np.int64)
            at[order] = np.arange(n_nodes)
            part = rows.slice(0, n_nodes).combine_chunks()
            x = _matrix(_column(part, "vec"), np.float16).astype(np.float32)[order]
            codes, worst = _matrix(_column(part, "codes"), np.int32)[order], _column(part, "worst").to_numpy()[order]
            own_home = _column(part, "own_home").to_numpy()[order]
            own = rows.slice(0, n_own).combine_chunks()
            nbrs, fresh, active = _matrix(_column(own, "nbrs"), np.int64), _matrix(_column(own, "fresh"), np.int8), _column(own, "active").to_numpy(zero_copy_only=False).astype(bool)

            def find(wanted: np.ndarray) -> np.ndarray:
                """Places among all nodes; -1: not here."""
                place = np.minimum(np.searchsorted(ids, wanted), n_nodes - 1)
                return np.where(ids[place] == wanted, place, -1)

            members = np.full((n_own, width + reverse), -1, dtype=np.int64)
            is_new = np.zeros((n_own, width + reverse), dtype=bool)
            members[:, :width] = np.where(nbrs >= 0, find(nbrs), -1)
            is_new[:, :width] = fresh > 0
            # Edges to nodes of this home: from nodes of this home, and those that were sent.
            inside = np.full(n_nodes, -1, dtype=np.int64)
            inside[at[:n_own]] = np.arange(n_own)
            i, j = np.nonzero(members[:, :width] >= 0)
            to = inside[members[i, j]]
            i, j, to = i[to >= 0], j[to >= 0], to[to >= 0]
            edges = rows.slice(n_nodes).combine_chunks() if n_nodes < rows.num_rows else None
            sent = find(_column(edges, "centre").to_numpy().astype(np.int64)) if edges is not None else np.zeros(0, dtype=np.int64)
            sent_to = np.where(sent >= 0, inside[sent], -1)
            sent_from = find(id_[n_nodes:])
            good = (sent_to >= 0) & (sent_from >= 0)
            sent_fresh = _column(edges, "is_new").to_numpy(zero_copy_only=False).astype(bool) if edges is not None else np.zeros(0, dtype=bool)
            to, source = np.concatenate((to, sent_to[good])), np.concatenate((at[i], sent_from[good]))
            new = np.concatenate((fresh[i, j] > 0, sent_fresh[good]))
            kept = _sampled(to, source, new, reverse, seed)
            to, source, new = to[kept], source[kept], new[kept]
            place = width + np.arange(len(to)) - np.searchsorted(to, np.arange(n_own))[to] if len(to) else to
            members[to, place], is_new[to, place] = source, new
            centres = np.flatnonzero(active & (is_new & (members >= 0)).any(axis=1))
            keys = [np.zeros(0, dtype=np.int64)]
            values = [np.zeros(0, dtype=np.float32)]
            for a in range(0, len(centres), 1000):
                c = centres[a : a + 1000]
                m, f = members[c], is_new[c]
                v = x[m]
                s = v @ v.transpose(0, 2, 1)
                ok = (s > worst[m][:, :, None]) & (f[:, :, None] | f[:, None, :]) & (m[:, :, None] >= 0) & (m[:, None, :] >= 0)
                z, p, q = np.nonzero(ok)
                l, r = m[z, p], m[z, q]
                away = (l != r) & (codes[l] != codes[r]).all(axis=1)
                keys.append(l[away] * n_nodes + r[away])
                values.append(s[z, p, q][away])
            key, one = np.unique(np.concatenate(keys), return_index=True)
            sim, l, r = np.concatenate(values)[one], key // n_nodes, key % n_nodes
            known = np.sort((np.repeat(at[:n_own], width) * n_nodes + members[:, :width].ravel())[members[:, :width].ravel() >= 0])
            if len(known):
                there = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                l, r, sim = l[~there], r[~there], sim[~there]
            touched = np.unique(r)
            none = np.full(len(touched), -1)
            yield _batch(
                home=np.concatenate((own_home[l], own_home[touched])).astype(np.int32), id=np.concatenate((ids[l], ids[touched])), nbr=np.concatenate((ids[r], none)),
                sim=np.concatenate((sim, none)).astype(np.float32), nbr_home=np.concatenate((own_home[r], none)).astype(np.int32),
            )

    return join


def _merge(width: int):
    """The lists of a home with the updates for its nodes; taken entries are new, all others have been joined."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "home"):
            news = _column(rows, "is_update").to_numpy(zero_copy_only=False).astype(bool)  # sorted: lists first
            n = int((~news).sum())
            if not n:
                continue
            own = rows.slice(0, n).combine_chunks()
            ids, home = _column(own, "id").to_numpy(), _column(own, "home").to_numpy()
            nbrs, sims, homes = (_matrix(_column(own, c), d) for c, d in (("nbrs", np.int64), ("sims", np.float32), ("homes", np.int32)))
            up_id, up_nbr, up_sim, up_home = (np.zeros(0, d) for d in (np.int64, np.int64, np.float32, np.int32))
            if n < rows.num_rows:
                up = rows.slice(n).combine_chunks()
                up_id, up_nbr, up_sim, up_home = (_column(up, c).to_numpy() for c in ("id", "nbr", "sim", "nbr_home"))
            order = np.argsort(ids, kind="stable")
            owner = order[np.minimum(np.searchsorted(ids, up_id, sorter=order), n - 1)]
            active = np.zeros(n, dtype=bool)
            active[owner] = True
            real = up_nbr >= 0
            have = nbrs >= 0
            flags = np.concatenate((np.zeros(have.sum(), dtype=np.int8), np.ones(real.sum(), dtype=np.int8)))
            nbrs, sims, homes, fresh = _best(
                np.concatenate((np.nonzero(have)[0], owner[real])), np.concatenate((nbrs[have], up_nbr[real])), np.concatenate((sims[have], up_sim[real])), n, width,
                np.concatenate((homes[have], up_home[real])), flags,
            )
            fresh = np.maximum(fresh, 0)
            yield _batch(id=ids, home=home, nbrs=_binary(nbrs), sims=_binary(sims), homes=_binary(homes), fresh=_binary(fresh), active=active, changed=fresh.sum(axis=1).astype(np.int32))

    return merge


def _first_lists(width: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            yield _batch(
                id=b.column("id"), home=b.column("block"), nbrs=b.column("nbrs"), sims=b.column("sims"), homes=b.column("homes"),
                fresh=_binary(np.ones((n, width), dtype=np.int8)), active=np.ones(n, dtype=bool), changed=np.zeros(n, dtype=np.int32),
            )

    return lists


def _worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield _batch(id=b.column("id"), worst=_matrix(b.column("sims"), np.float32)[:, -1].copy())


def _round(nodes: DataFrame, lists: DataFrame, t: int, homes: int, width: int, reverse: int) -> DataFrame:
    """The lists after a round of the descent. nodes: (id, own_home, vec, codes)."""
    forward = lists.mapInArrow(_forward, "home INT, id BIGINT")
    edges = lists.mapInArrow(_backward(reverse, t), "home INT, id BIGINT, centre BIGINT, fresh BOOLEAN")
    if t:  # only edges to active centres
        edges = edges.join(lists.filter("active").select(F.col("id").alias("centre")), "centre", "left_semi")
    wanted = forward.unionByName(edges.select("home", "id")).distinct()
    known = nodes.join(lists.mapInArrow(_worst, "id BIGINT, worst FLOAT"), "id")
    guests = wanted.join(known, "id").select("home", F.lit(_GUEST).alias("kind"), "id", "own_home", "vec", "codes", "worst")
    own = known.join(lists.select("id", "nbrs", "fresh", "active"), "id").select(F.col("own_home").alias("home"), F.lit(_OWN).alias("kind"), "id", "own_home", "vec", "codes", "worst", "nbrs", "fresh", "active")
    sent = edges.select("home", F.lit(_EDGE).alias("kind"), "id", "centre", F.col("fresh").alias("is_new"))
    rows = own.unionByName(guests, allowMissingColumns=True).unionByName(sent, allowMissingColumns=True)
    updates = _dealt(rows, homes, "home", "kind").mapInArrow(_local_join(width, reverse, t), "home INT, id BIGINT, nbr BIGINT, sim FLOAT, nbr_home INT")
    both = lists.select("home", F.lit(False).alias("is_update"), "id", "nbrs", "sims", "homes").unionByName(updates.withColumn("is_update", F.lit(True)), allowMissingColumns=True)
    return _dealt(both, homes, "home", "is_update").mapInArrow(_merge(width), _LISTS)


@dataclass
class Graph:
    """nodes: (id, raw, first) of the classes; members: (id, class) of the others; placed: (id, own_home, blocks, vec); lists: (id, home, nbrs, sims) as binary."""

    nodes: DataFrame
    members: DataFrame
    placed: DataFrame
    lists: DataFrame
    trees: list[Tree]
    block: int

    def all_members(self) -> DataFrame:
        """(id, class) of every vector that takes part."""
        return self.members.unionByName(self.nodes.select("id", F.col("id").alias("class")))

    def edges(self) -> DataFrame:
        """(id, nbr)."""

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    nbrs = _matrix(b.column("nbrs"), np.int64)
                    i, j = np.nonzero(nbrs >= 0)
                    yield _batch(id=b.column("id").to_numpy()[i], nbr=nbrs[i, j])

        return self.lists.select("id", "nbrs").mapInArrow(explode, "id BIGINT, nbr BIGINT")


def build_graph(vectors: DataFrame, k: int = K, width: int = WIDTH, block: int = BLOCK, trees: int = TREES, reverse: int = REVERSE, seed: int = 22) -> Graph | None:
    """The neighbour graph of vectors (vec_id, vector); None if none takes part."""
    spark, path, width = vectors.sparkSession, work_dir(vectors.sparkSession), max(width, 2 * k)
    nodes, members = classes_of(vectors, k, path)
    n = nodes.count()
    if not n:
        return None
    forest = _forest(nodes, n, block, trees, seed)
    state = nodes.select("id", "raw").mapInArrow(_placer(forest), _PLACED)
    for t, tree in enumerate(forest):
        digest = F.xxhash64(F.lit(t), "id")
        state = _dealt(state, tree.blocks, "block", digest).mapInArrow(_tree_step(t, len(forest), width, block), _NODE)
    state = staged(state, f"{path}/trees")
    placed = state.select("id", F.col("block").alias("own_home"), "blocks", "vec", "codes")
    lists = state.mapInArrow(_first_lists(width), _LISTS)
    homes, t = forest[-1].blocks, 0
    while len(forest) > 1:
        lists = staged(_round(placed.drop("blocks"), lists, t, homes, width, reverse), f"{path}/round{t}")
        if t:
            drop_dir(spark, f"{path}/round{t - 1}")
        t += 1
        if lists.agg(F.sum("changed")).first()[0] <= ENOUGH * n * width:
            break
    return Graph(nodes, members, placed, lists, forest, block)


def _asked(k: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(home, id, nbr): entries that may be among the k best, and each node with itself, whose vector its home needs."""
        for b in batches:
            if b.num_rows:
                nbrs, sims = _matrix(b.column("nbrs"), np.int64), _matrix(b.column("sims"), np.float32)
                ids, home = b.column("id").to_numpy(), b.column("home").to_numpy()
                i, j = np.nonzero((nbrs >= 0) & (sims >= sims[:, [k - 1]] - 2 * HALF_ERROR))
                yield _batch(home=np.concatenate((home, home[i])), id=np.concatenate((ids, ids[i])), nbr=np.concatenate((ids, nbrs[i, j])))

    return asked


def _rank_exactly(k: int):
    """The k nearest ids of each class of a home, by similarities from the full vectors: (id, nbr, sim, rank, shared).

    A class of several ids has a second list, shared, of k + 1 ids with its own among them, for its other members.
    """

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "home"):
            is_pair = _column(rows, "is_pair").to_numpy(zero_copy_only=False).astype(bool)  # sorted: vectors first
            n = int((~is_pair).sum())
            here, pairs = rows.slice(0, n).combine_chunks(), rows.slice(n).combine_chunks()
            by = np.argsort(_column(here, "nbr").to_numpy())
            ids = _column(here, "nbr").to_numpy()[by]
            x = _unit(_matrix(_column(here, "raw"), np.float32)[by])
            members, sizes = _column(here, "first").flatten().to_numpy(), np.array(_column(here, "first").value_lengths())
            begins, sizes = (np.cumsum(sizes) - sizes)[by], sizes[by]
            i, j = np.searchsorted(ids, _column(pairs, "id").to_numpy()), np.searchsorted(ids, _column(pairs, "nbr").to_numpy())
            own = np.flatnonzero(np.bincount(i[i == j], minlength=n))
            i, j = i[i != j], j[i != j]
            sim = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536))])
            best, sims = _best(i, j, np.round(sim, 9), n, k)
            z, place = np.nonzero(best >= 0)
            of, to, sim = np.concatenate((own, z)), np.concatenate((own, best[z, place])), np.concatenate((np.ones(len(own)), sims[z, place]))
            # All first ids of these classes.
            times = sizes[to]
            at = np.repeat(begins[to] - np.cumsum(times) + times, times) + np.arange(times.sum())
            of, sim, nbr = np.repeat(of, times), np.repeat(sim, times), members[at]
            for shared, kept, most in ((False, nbr != ids[of], k), (True, sizes[of] > 1, k + 1)):
                best, sims = _best(of[kept], nbr[kept], sim[kept], n, most, unique=True)
                z, place = np.nonzero(best >= 0)
                yield _batch(id=ids[z], nbr=best[z, place], sim=sims[z, place], rank=(place + 1).astype(np.int32), shared=np.full(len(z), shared))

    return rank


def exact_lists(graph: Graph, k: int) -> DataFrame:
    """(id, nbr, sim, rank, shared), see _rank_exactly; staged."""
    pairs = graph.lists.mapInArrow(_asked(k), "home INT, id BIGINT, nbr BIGINT")
    wanted = pairs.select("home", "nbr").distinct().join(graph.nodes.withColumnRenamed("id", "nbr"), "nbr").withColumn("is_pair", F.lit(False))
    rows = wanted.unionByName(pairs.withColumn("is_pair", F.lit(True)), allowMissingColumns=True)
    ranked = _dealt(rows, graph.trees[-1].blocks, "home", "is_pair").mapInArrow(_rank_exactly(k), "id BIGINT, nbr BIGINT, sim DOUBLE, rank INT, shared BOOLEAN")
    return staged(ranked, f"{work_dir(graph.nodes.sparkSession)}/ranked")


def nearest(vectors: DataFrame, k: int = K, **how: int) -> DataFrame:
    """(id, nbr, sim, rank): the k nearest others of every vector that takes part."""
    graph = build_graph(vectors, k, **how)
    if graph is None:
        return vectors.sparkSession.createDataFrame([], "id BIGINT, nbr BIGINT, sim DOUBLE, rank INT")
    ranked = exact_lists(graph, k)
    shared = ranked.filter("shared").groupBy(F.col("id").alias("class")).agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "nbr"))).alias("all"))  # k + 1
    return ranked.filter("NOT shared").drop("shared").unionByName(_own_lists(hot_join(graph.members, shared, "class"), k))


def _own_lists(rows: DataFrame, k: int) -> DataFrame:
    """(id, nbr, sim, rank) of members (id, all) from their class's k + 1 ids."""
    mine = rows.select("id", F.slice(F.filter("all", lambda x: x["nbr"] != F.col("id")), 1, k).alias("all"))
    return mine.select("id", F.posexplode("all").alias("rank", "x")).select(
        "id", F.col("x.nbr").alias("nbr"), (-F.col("x.far")).alias("sim"), (F.col("rank") + 1).alias("rank")
    )


def _expand(graph: Graph, near: DataFrame, own: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(id, nbr, sim, rank) of the members asked (id, class), of the classes own (class), from near (class, of, sim): k other classes."""
    lists = near.unionByName(own.select("class", F.col("class").alias("of"), F.lit(1.0).alias("sim")))
    # For each class: the first ids of itself and of its nearest classes, in order, k + 1 of them (one may be the member itself).
    candidates = (
        lists.join(graph.nodes.select(F.col("id").alias("of"), "first"), "of")
        .groupBy("class")
        .agg(F.flatten(F.collect_list(F.transform("first", lambda x: F.struct((-F.col("sim")).alias("far"), x.alias("nbr"))))).alias("all"))
        .select("class", F.slice(F.array_sort("all"), 1, k + 1).alias("all"))
    )
    return _own_lists(hot_join(asked, candidates, "class"), k)


def nearest_pairs(vectors: DataFrame, k: int = K) -> DataFrame:
    """(vec_a, vec_b), the smaller id first: pairs in which one is among the k nearest of the other."""
    return nearest(vectors, k).select(F.least("id", "nbr").alias("vec_a"), F.greatest("id", "nbr").alias("vec_b")).distinct()


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, id, sim) of pairs with their vectors q_raw and raw."""
    for b in batches:
        if b.num_rows:
            q, x = _unit(_matrix(b.column("q_raw"), np.float32)), _unit(_matrix(b.column("raw"), np.float32))
            yield _batch(query_id=b.column("query_id"), id=b.column("id"), sim=np.round(np.einsum("ij,ij->i", q, x), 9))


def _block_doors(entries: int):
    def score(nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The `entries` nodes of a block that are nearest to each query."""
        out = [pd.DataFrame({"query_id": np.zeros(0, dtype=np.int64), "id": np.zeros(0, dtype=np.int64)})]
        if len(nodes) and len(asked):
            nodes = nodes.sort_values("id", kind="stable")
            ids, x, queries, y = nodes["id"].to_numpy(), _half(nodes["vec"]), asked["query_id"].to_numpy(), _half(asked["vec"])
            for a in range(0, len(queries), 512):
                best = np.argsort(-(y[a : a + 512] @ x.T), axis=1, kind="stable")[:, :entries]
                out.append(pd.DataFrame({"query_id": np.repeat(queries[a : a + 512], best.shape[1]), "id": ids[best].ravel()}))
        return pd.concat(out)

    return score


def _tree_blocks(placed: DataFrame, key: str, trees: int) -> DataFrame:
    """(key, vec, tree, block): each row once for each of the first trees."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                blocks = _matrix(b.column("blocks"), np.int32)[:, :trees]
                i = np.repeat(np.arange(b.num_rows), blocks.shape[1])
                yield _batch(id=b.column("id").to_numpy()[i], vec=b.column("vec").take(pa.array(i)), tree=np.tile(np.arange(blocks.shape[1], dtype=np.int32), b.num_rows), block=blocks.ravel())

    return placed.select("id", "blocks", "vec").mapInArrow(explode, "id BIGINT, vec BINARY, tree INT, block INT").withColumnRenamed("id", key)


def _doors(q: DataFrame, graph: Graph, entries: int) -> DataFrame:
    """(query_id, id): where queries (query_id, q_raw) enter the graph. In each of the first trees all nodes of the query's block are scored.

    A block of over twice the planned size is scored in parts, and so are its queries; each part gives its best nodes.
    """
    placed = q.select(F.col("query_id").alias("id"), F.col("q_raw").alias("raw")).mapInArrow(_placer(graph.trees), _PLACED)
    asked, nodes = _tree_blocks(placed, "query_id", DOORS), _tree_blocks(graph.placed, "id", DOORS)
    at, parts = ["tree", "block"], F.ceil(F.count(F.lit(1)) / (2.0 * graph.block))
    sizes = nodes.groupBy(at).agg(parts.alias("parts")).join(asked.groupBy(at).agg(parts.alias("shares")), at)  # a row for each block
    part, share = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("shares")).alias("share")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    nodes = nodes.join(sizes, at).select(*at, "id", "vec", part, each("shares").alias("share"))
    asked = asked.join(sizes, at).select(*at, "query_id", "vec", share, each("parts").alias("part"))
    block = [*at, "part", "share"]
    return nodes.groupBy(block).cogroup(asked.groupBy(block)).applyInPandas(_block_doors(entries), "query_id BIGINT, id BIGINT").distinct()


def greedy_search(queries: DataFrame, graph: Graph, k: int = K, beam: int = 12, entries: int = 4) -> DataFrame:
    """(query_id, nbr, sim, rank) of queries (query_id, raw): classes near any vector (4-byte floats), by walking the graph.

    A query enters at the best nodes of its blocks. Each hop joins the nodes of its beam that were not yet opened to their
    lists, measures the new nodes, and keeps the best. The walk ends when no query has an unopened node in its beam; a beam
    only ever improves, so that comes.
    """
    spark, path = queries.sparkSession, work_dir(queries.sparkSession)
    q = staged(queries.select("query_id", F.col("raw").alias("q_raw")), f"{path}/queries")
    start = _doors(q, graph, entries)

    def measure(pairs: DataFrame) -> DataFrame:
        both = pairs.join(q, "query_id").join(graph.nodes.select("id", "raw"), "id").select("query_id", "id", "q_raw", "raw")
        return both.mapInArrow(_measure, "query_id BIGINT, id BIGINT, sim DOUBLE")

    seen = staged(measure(start).withColumn("opened", F.lit(False)), f"{path}/hop0")
    edges, hop = staged(graph.edges(), f"{path}/edges"), 0
    while True:
        best = seen.withColumn("nth", F.row_number().over(_by("query_id", F.desc("sim"), "id"))).filter(F.col("nth") <= beam)
        best = staged(best.drop("nth"), f"{path}/beam{hop}")
        front = best.filter(~F.col("opened"))
        if front.isEmpty():
            break
        new = front.join(edges, "id").select("query_id", F.col("nbr").alias("id")).distinct()
        new = measure(new.join(best, ["query_id", "id"], "left_anti")).withColumn("opened", F.lit(False))
        seen = staged(best.withColumn("opened", F.lit(True)).unionByName(new), f"{path}/hop{hop + 1}")
        drop_dir(spark, f"{path}/hop{hop}")
        hop += 1
    ranked = seen.withColumn("rank", F.row_number().over(_by("query_id", F.desc("sim"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("id").alias("nbr"), "sim", "rank")


def search_members(graph: Graph, asked: DataFrame, k: int = K, **how: int) -> DataFrame:
    """(query_id, nbr, sim, rank): by greedy search, the k nearest others of members asked (id, class). Equal vectors are searched for once."""
    own = asked.select("class").distinct()
    queries = own.join(graph.nodes.select(F.col("id").alias("class"), "raw"), "class").withColumnRenamed("class", "query_id")
    # One class more, as the query's own may be among them.
    near = greedy_search(queries, graph, k + 1, **how).select(F.col("query_id").alias("class"), F.col("nbr").alias("of"), "sim").filter(F.col("class") != F.col("of"))
    return _expand(graph, near, own, asked, k).withColumnRenamed("id", "query_id")
