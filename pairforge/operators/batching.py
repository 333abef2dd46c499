"""Training batches: collision-free chunks, stratified groups, best-fit bins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.rand import det_key
from pairforge.operators.enrich import small
from pairforge.operators.order import place_in_group
from pairforge.operators.sampling import whole_percentile
from pairforge.session import staged, work_dir

_CHUNK_FIELDS = ("query", "query_image", "pos", "pos_image")


class _Filler:
    """One domain's rows into chunks; holds at most look_ahead * size rows."""

    def __init__(self, size: int, look_ahead: int):
        self.size, self.room = size, size * look_ahead
        self.waiting: list[tuple] = []

    def add(self, row: tuple) -> list[tuple] | None:
        """A chunk, once the look-ahead is full."""
        self.waiting.append(row)
        return self.take() if len(self.waiting) >= self.room else None

    def take(self) -> list[tuple]:
        """Rows in order, those left back whose query or positives are in the chunk already."""
        queries, images, texts, pictures = set(), set(), set(), set()
        chunk, later = [], []
        for i, row in enumerate(self.waiting):
            _, query, image, pos, pos_image = row
            if (query and query in queries) or (image and image in images) or not texts.isdisjoint(pos) or not pictures.isdisjoint(pos_image):
                later.append(row)
                continue
            chunk.append(row)
            if query:
                queries.add(query)
            if image:
                images.add(image)
            texts.update(pos)
            pictures.update(pos_image)
            if len(chunk) == self.size:
                later += self.waiting[i + 1 :]
                break
        self.waiting = later
        return chunk


def _chunker(size: int, look_ahead: int):
    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, number = None, 0
        filler = _Filler(size, look_ahead)
        out: list[tuple] = []

        def put(chunk: list[tuple]) -> None:
            nonlocal number
            out.extend((domain[0], domain[1], number, i, row[0]) for i, row in enumerate(chunk))
            number += 1

        def close() -> None:
            while filler.waiting:
                put(filler.take())

        def frame() -> pd.DataFrame:
            df = pd.DataFrame(out, columns=["domain", "part", "chunk_no", "place", "ord"])
            out.clear()
            return df

        some = lambda x: [v for v in x if v is not None] if x is not None else []
        for batch in batches:
            for d, p, o, q, qi, pos, pi in batch[["domain", "part", "ord", *_CHUNK_FIELDS]].itertuples(index=False, name=None):
                if (d, p) != domain:
                    close()
                    domain, number = (d, p), 0
                if chunk := filler.add((o, q, qi, some(pos), some(pi))):
                    put(chunk)
            yield frame()
        close()
        yield frame()

    return chunks


def chunkify(rows: DataFrame, size: int = 64, look_ahead: int = 3, split_rows: int = 1_000_000) -> DataFrame:
    """(domain, part, chunk_no, place, ord) of rows (domain, ord, query, pos and, if there, query_image, pos_image).

    In a chunk no query, no query image and no positive text or image occurs twice; empty ones never collide. Rows that
    collide wait for a later chunk; all rows come out once, partial chunks too. A domain is filled in the order of ord, and
    begins anew every split_rows rows, so that no task holds a hot domain.
    """
    extra = {"query_image": F.lit(None).cast("string"), "pos_image": F.array().cast("array<string>")}
    full = rows.withColumns({c: v for c, v in extra.items() if c not in rows.columns})
    largest = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > split_rows:
        full = place_in_group(full, ["domain"], "ord", [], "_at").withColumn("part", F.floor(F.col("_at") / split_rows))
    else:
        full = full.withColumn("part", F.lit(0).cast("bigint"))
    cut = full.select("domain", "part", "ord", *_CHUNK_FIELDS).repartition("domain", "part").sortWithinPartitions("domain", "part", "ord")
    return cut.mapInPandas(_chunker(size, look_ahead), "domain STRING, part BIGINT, chunk_no BIGINT, place INT, ord BIGINT")


def full_chunks(chunks: DataFrame, size: int) -> DataFrame:
    """Adds whether a row's chunk is full."""
    return chunks.withColumn("is_full", F.expr("count(1) OVER (PARTITION BY domain, part, chunk_no)") == size)


def round_robin_groups(rows: DataFrame, size: int = 64) -> DataFrame:
    """(domain, slice, sub, place, ord, label) of rows (domain, ord, label).

    Slice i holds each label's i-th row, labels in the order of their first ord. With two or three labels there are as
    many slices as the rarest has rows, else as the 80th percentile; slices of one row are left out; then a slice is split
    every `size` rows.
    """
    own = rows.filter(F.coalesce("label", F.lit("")) != "")
    path = work_dir(rows.sparkSession)
    labels = staged(own.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")), f"{path}/labels")
    depth = labels.groupBy("domain").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), whole_percentile("n", 0.8).alias("p80"))
    depth = depth.select("domain", F.when(F.col("k").isin(2, 3), F.col("least")).otherwise(F.col("p80")).alias("depth"))
    ranked = place_in_group(own.select("domain", "label", "ord"), ["domain", "label"], "ord", [], "slice").join(small(depth), "domain").filter(F.col("slice") < F.col("depth"))
    # At most `depth` rows of each label are left.
    placed = staged(ranked.join(labels.select("domain", "label", "first"), ["domain", "label"]).select("domain", "label", "ord", "slice", "first"), f"{path}/slices")
    placed = place_in_group(placed, ["domain", "slice"], "first", ["label"], "rn")
    in_slice = placed.groupBy("domain", "slice").agg(F.count(F.lit(1)).alias("in_slice")).filter(F.col("in_slice") >= 2)
    return placed.join(in_slice, ["domain", "slice"]).select(
        "domain", F.col("slice").cast("bigint"), F.floor(F.col("rn") / size).alias("sub"), F.pmod("rn", F.lit(size)).cast("bigint").alias("place"), "ord", "label"
    )


def plan_bins(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, on the histogram of group lengths: runs (length, first, last, bin, each).

    A run puts the groups first..last-1 of that length, `each` at a time, into bin, bin + 1, ... Bins with equal room are
    alike, so they are kept as ranges; one that was begun is the best fit until no further group of the length fits. Only
    bins that end up exactly full appear.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for length in sorted(histogram, reverse=True):
        at, n = 0, histogram[length]
        if length <= 0 or length > size:
            continue
        while n:
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                fit, new = size, -(-n // (size // length))
                rooms[size] = [(bins, bins + new)]
                bins += new
            a, b = rooms[fit].pop()
            if not rooms[fit]:
                del rooms[fit]
            each = fit // length
            whole = min(b - a, n // each)
            if whole:
                runs.append((length, at, at + whole * each, a, each))
                rooms.setdefault(fit - each * length, []).append((a, a + whole))
                at, n = at + whole * each, n - whole * each
            if whole < b - a and n:  # fewer than `each` are left
                runs.append((length, at, at + n, a + whole, n))
                rooms.setdefault(fit - n * length, []).append((a + whole, a + whole + 1))
                n, whole = 0, whole + 1
            if whole < b - a:
                rooms.setdefault(fit, []).append((a + whole, b))
    full = sorted(rooms.get(0, []))
    out = []
    for length, first, last, bin_, each in runs:  # the parts of the runs whose bins are full
        for a, b in full:
            lo, hi = max(a, bin_), min(b, bin_ + (last - first) // each)
            if lo < hi:
                out.append((length, first + (lo - bin_) * each, first + (hi - bin_) * each, lo, each))
    return out


def pack_groups(groups: DataFrame, size: int = 64, seed: int = 22) -> DataFrame:
    """(group_id, len, bin) of groups (group_id, len) for the groups in exactly full bins.

    Longer groups count as `size` (they are cut). The plan is made by the driver from the histogram, which has at most
    `size` rows; groups of one length are numbered in a seeded order, within salts.
    """
    spark = groups.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = groups.withColumn("len", F.least("len", F.lit(size))).withColumn("_key", det_key(seed, "pack", "group_id")).withColumn("_salt", F.pmod(F.xxhash64("group_id"), F.lit(salts)))
    counts = g.groupBy("len", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    histogram = {r[0]: r[1] for r in counts.groupBy("len").agg(F.sum("_c")).collect()}  # at most `size` rows
    plan = plan_bins(histogram, size)
    runs = spark.createDataFrame(plan, "len INT, first BIGINT, last BIGINT, bin0 BIGINT, each BIGINT").groupBy("len").agg(F.collect_list(F.struct("first", "last", "bin0", "each")).alias("_runs"))
    before = counts.withColumn("_before", F.expr("coalesce(sum(_c) OVER (PARTITION BY len ORDER BY _salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).join(F.broadcast(runs), "len").drop("_c")
    ranked = g.withColumn("_in", F.expr("row_number() OVER (PARTITION BY len, _salt ORDER BY _key, group_id) - 1")).join(before, ["len", "_salt"])
    ranked = ranked.withColumn("_place", F.col("_before") + F.col("_in")).withColumn("_run", F.expr("get(filter(_runs, r -> r.first <= _place AND _place < r.last), 0)")).filter(F.col("_run").isNotNull())
    return ranked.select("group_id", "len", (F.col("_run.bin0") + F.expr("(_place - _run.first) div _run.each")).alias("bin"))


def bin_statistics(packed: DataFrame) -> DataFrame:
    """Of the filling of bins."""
    fill = packed.groupBy("bin").agg(F.sum("len").alias("fill"))
    return fill.agg(F.count(F.lit(1)).alias("bins"), F.avg("fill").alias("avg"), F.max("fill").alias("max"), F.min("fill").alias("min"), F.var_pop("fill").alias("var"))


def microbatches(rows: DataFrame, size: int, ordinal: str = "ord0") -> DataFrame:
    """Batches of exactly `size` by ordinal; what is left over is dropped, as a loader with drop_last does."""
    batch = F.floor(F.col(ordinal) / size)
    total = rows.agg(F.max(ordinal).alias("_last"))
    return rows.crossJoin(F.broadcast(total)).withColumn("batch_id", batch).filter((F.col("batch_id") + 1) * size <= F.col("_last") + 1).drop("_last")  # one row beside


def length_buckets(rows: DataFrame, length: str, width: int = 64) -> DataFrame:
    """Rows of like length in one bucket, so that a batch of a bucket needs little padding."""
    return rows.withColumn("bucket", F.floor(F.col(length) / width))
