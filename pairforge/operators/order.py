"""Global ordinals, seeded shuffles and shards, none of which sorts in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.rand import det_key, key_int
from pairforge.session import staged, work_dir

#: Bits of monotonically_increasing_id that count rows within a partition.
LOCAL_BITS = 33


def with_ordinal(df: DataFrame, *order: str | Column, name: str = "ord0") -> DataFrame:
    """Adds the row's place, from 0, in the order of the given (together unique) columns: W10, H1.

    Rows are range-partitioned and sorted within partitions; the sizes of the partitions before give each partition's
    first number. The sorted rows are written once, so both passes see the same partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).withColumn("_place", F.monotonically_increasing_id())
    ranged = staged(ranged, f"{work_dir(spark)}/ordered")
    part = F.shiftright("_place", LOCAL_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    first = sizes.select("_part", F.expr("coalesce(sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_first"))
    local = F.col("_place").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return ranged.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + local).drop("_place", "_part", "_first")


#: Cuts that the driver holds when a hot group is numbered by ranges.
MOST_CUTS = 10_000


def number_buckets(df: DataFrame, by: str, rows: DataFrame | None = None) -> DataFrame:
    """Adds `_b`, a bucket from 0, to df: ranges of the number `by` that hold about as many of `rows` (default: df) each, as many as the shuffle has partitions.

    Cuts are approximate quantiles, so values that bunch up are parted as finely as they differ. Nulls come first.
    """
    from pyspark.ml.feature import Bucketizer

    n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_CUTS)
    asked = [i / n for i in range(1, n)]
    cuts = (df if rows is None else rows).agg(F.percentile_approx(F.col(by).cast("double"), asked, 10 * n).alias("q")).first()[0] if asked else None
    splits = [float("-inf"), *sorted(set(cuts or [])), float("inf")]
    if len(splits) < 3:
        return df.withColumn("_b", F.lit(0))
    cut = Bucketizer(splits=splits, inputCol="_by", outputCol="_bucket", handleInvalid="keep")
    return cut.transform(df.withColumn("_by", F.col(by).cast("double"))).withColumn("_b", F.when(F.col(by).isNull(), 0).otherwise(F.col("_bucket").cast("int") + 1)).drop("_by", "_bucket")


def place_in_group(df: DataFrame, group: list[str], by: str, tie: list[str], name: str = "place") -> DataFrame:
    """The row's place, from 0, within its group by the whole number `by`, then the tie columns.

    A group of more than a shuffle partition's share of all rows (there are at most as many as partitions) is counted in
    buckets of ranges of `by`: the sizes of the buckets before, and the place within the bucket. So no task holds it whole,
    unless its rows agree in `by`.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order_by = ", ".join([by, *tie])
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    hot = sizes.filter(F.col("_n") > max(total // parts, 1)).select(*group)
    if hot.isEmpty():
        return df.withColumn(name, F.expr(f"row_number() OVER (PARTITION BY {', '.join(group)} ORDER BY {order_by}) - 1").cast("bigint"))

    def named(small: DataFrame, cols: list[str]) -> tuple[DataFrame, list[Column]]:
        """The small side under names of its own, and the null-safe conditions on it."""
        return small.withColumnsRenamed({c: f"_of_{c}" for c in cols}), [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cols]

    marks, on = named(hot.withColumn("_hot", F.lit(True)), group)
    marked = df.join(F.broadcast(marks), on, "left").select(*df.columns, "_hot")
    cut = number_buckets(marked, by, marked.filter("_hot")).select(*df.columns, F.when(F.col("_hot"), F.col("_b")).otherwise(-1).alias("_b"))
    counts = cut.filter(F.col("_b") >= 0).groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    past = f"OVER (PARTITION BY {', '.join(group)} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before, on = named(counts.select(*group, "_b", F.expr(f"coalesce(sum(_n) {past}, 0)").alias("_before")), [*group, "_b"])
    own = cut.withColumn("_in", F.expr(f"row_number() OVER (PARTITION BY {', '.join([*group, '_b'])} ORDER BY {order_by}) - 1"))
    joined = own.join(before, on, "left")  # partitions squared at most, so left to a join by size
    return joined.select(*df.columns, (F.coalesce("_before", F.lit(0)) + F.col("_in")).cast("bigint").alias(name))


def shuffled(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """A seeded total order, by a digest of seed and id."""
    return df.orderBy(det_key(seed, "shuffle", id_col), id_col)


def shuffled_ordinal(df: DataFrame, seed: int, id_col: str, name: str = "ord0") -> DataFrame:
    """The place of each row in that order."""
    return with_ordinal(df.withColumn("_key", det_key(seed, "shuffle", id_col)), "_key", id_col, name=name).drop("_key")


def shuffled_in_shards(df: DataFrame, seed: int, shard: str, id_col: str) -> DataFrame:
    """The place of each row within its shard; rows of all inputs that share the shard's name are mixed."""
    keyed = df.withColumn("_key", det_key(seed, "shard", shard, id_col)).withColumn("_k", key_int(F.col("_key")))
    return place_in_group(keyed, [shard], "_k", ["_key", id_col]).drop("_key", "_k")


def contiguous_shard(ordinal: Column, total: Column, n: int) -> Column:
    """Shard i holds the places from i * total div n up to (i + 1) * total div n."""
    return F.floor(((ordinal + 1) * n - 1) / total).cast("bigint")


def stride_shard(ordinal: Column, n: int) -> Column:
    """Dealt out one by one."""
    return F.pmod(ordinal, F.lit(n))


def rolling_shard(ordinal: Column, size: int) -> Column:
    """Full shards of `size`, one after the other."""
    return F.floor(ordinal / size).cast("bigint")


def rank_files(df: DataFrame, world: int, rank: int, file: str = "file") -> DataFrame:
    """The rows of every world-th file in the order of names, from file number `rank`."""
    names = df.select(file).distinct().withColumn("_i", F.expr(f"dense_rank() OVER (ORDER BY {file}) - 1"))  # file names, not rows
    return df.join(names.filter(F.pmod("_i", F.lit(world)) == rank).drop("_i"), file, "left_semi")


def limit_per_group(df: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """The first n rows of each group; the limit is applied before the shuffle too."""
    return df.withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY {group} ORDER BY {', '.join(order)})")).filter(F.col("_n") <= n).drop("_n")


def bottom_k(df: DataFrame, seed: int, id_col: str, k: int, name: str | None = None) -> DataFrame:
    """A uniform sample without replacement of exactly k rows, those with the smallest digests; name: their places from 0.

    Rows over a digest that about k rows and a margin stay below cannot be among them and are left out first; the rest is
    numbered by ranges. So no task holds k rows, however large k is.
    """
    n = df.count()
    keyed = df.withColumn("_key", det_key(seed, "pool", id_col))
    share = (k + 10 * k**0.5 + 100) / max(n, 1)
    if share < 1:
        near = keyed.filter(key_int(F.col("_key")) < int(share * 2**32))
        keyed = near if near.count() >= k else keyed
    placed = with_ordinal(keyed, "_key", id_col, name=name or "_nth")
    return placed.filter(F.col(name or "_nth") < k).drop(*(["_key"] if name else ["_key", "_nth"]))
