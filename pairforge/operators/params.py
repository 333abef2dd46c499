"""Parameter tables (ckpt, key, shape, vals): averaging, extraction, renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def average(params: DataFrame, exclude: str | None = None) -> DataFrame:
    """Element-wise mean of each key over all checkpoints but `exclude` (the output of an earlier run)."""
    own = params if exclude is None else params.filter(F.col("ckpt") != exclude)
    long = own.select("key", "shape", F.posexplode("vals").alias("i", "v"))
    means = long.groupBy("key", "i").agg(F.avg("v").alias("v"), F.first("shape").alias("shape"))
    return means.groupBy("key").agg(F.first("shape").alias("shape"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vals"))


def segment_suffix(key: Column, module: str) -> Column:
    """what follows the first path segment that is the module's name; null if none is, or nothing follows."""
    parts = F.split(key, r"\.")
    at = F.array_position(parts, module)
    return F.when((at > 0) & (at < F.size(parts)), F.array_join(F.slice(parts, (at + 1).cast("int"), F.size(parts)), "."))


def prefix_suffix(key: Column, module: str) -> Column:
    """what follows the module's name and a dot at the start of the key, else null."""
    return F.when(F.startswith(key, F.lit(module + ".")), F.substring(key, len(module) + 2, 1 << 30))


def extract(params: DataFrame, module: str, by_prefix: bool = False, strict: bool = True) -> DataFrame:
    """the parameters of a sub-module under their short names; none at all raises if strict."""
    short = (prefix_suffix if by_prefix else segment_suffix)(F.col("key"), module)
    got = params.withColumn("key", short).filter(F.col("key").isNotNull())
    if strict and got.isEmpty():
        raise ValueError(f"no parameter belongs to {module}")
    return got


def nested(params: DataFrame, names: tuple[str, ...] = ("state_dict", "model", "module", "model_state_dict", "params"), key: str | None = None) -> DataFrame:
    """the parameters below one of the usual outer names, if any are; `key` names it. The names' order decides."""
    for name in (key,) if key else names:
        got = params.withColumn("key", prefix_suffix(F.col("key"), name)).filter(F.col("key").isNotNull())
        if not got.isEmpty():
            return got
    if key:
        raise KeyError(key)
    return params


def remap_blocks(params: DataFrame, chosen: list[int]) -> DataFrame:
    """the chosen blocks as 0, 1, ..., and everything that is in no block."""
    block = F.regexp_extract("key", r"(?:^|\.)blocks\.(\d+)\.", 1)
    new = F.create_map(*[F.lit(str(x)) for kv in ((old, i) for i, old in enumerate(chosen)) for x in kv])[block]
    kept = params.withColumn("_block", block).withColumn("_new", new).filter((F.col("_block") == "") | F.col("_new").isNotNull())
    renamed = F.regexp_replace(F.col("key"), F.lit(r"(^|\.)blocks\.\d+\."), F.concat(F.lit("$1blocks."), F.coalesce("_new", F.lit("")), F.lit(".")))
    return kept.withColumn("key", F.when(F.col("_block") == "", F.col("key")).otherwise(renamed)).drop("_block", "_new")


def layer_count(params: DataFrame) -> DataFrame:
    """one more than the largest block number."""
    return params.agg((F.max(F.nullif(F.regexp_extract("key", r"(?:^|\.)blocks\.(\d+)\.", 1), F.lit("")).cast("int")) + 1).alias("layers"))


def compress_names(params: DataFrame) -> DataFrame:
    """(name) with the numbers of a block position gathered, as in blocks.{0,1}.w."""
    parts = F.split("key", r"\.")
    at = F.coalesce(F.array_min(F.transform(F.filter(F.arrays_zip(parts.alias("p"), F.sequence(F.lit(1), F.size(parts)).alias("i")), lambda x: x["p"].rlike(r"^\d+$")), lambda x: x["i"])), F.lit(0))
    cut = params.select("key").distinct().withColumn("_p", parts).withColumn("_at", at)
    rows = cut.select(
        F.when(F.col("_at") > 0, F.array_join(F.expr("slice(_p, 1, _at - 1)"), ".")).otherwise(F.col("key")).alias("prefix"),
        F.when(F.col("_at") > 0, F.array_join(F.expr("slice(_p, _at + 1, size(_p))"), ".")).otherwise("").alias("rest"),
        F.when(F.col("_at") > 0, F.expr("get(_p, _at - 1)").cast("int")).alias("block"),
    )
    grouped = rows.groupBy("prefix", "rest").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    full = F.concat(F.col("prefix"), F.lit(".{"), F.array_join(F.col("blocks").cast("array<string>"), ","), F.lit("}."), F.col("rest"))
    return grouped.select(F.when((F.col("rest") != "") & (F.size("blocks") > 0), full).otherwise(F.col("prefix")).alias("name"))


def freeze(params: DataFrame, layers: int, n_layers: int, emb: bool = False, proj: bool = False, vit: bool = False, core: str = "core") -> DataFrame:
    """Adds `trainable`. The first `layers` blocks of the core are frozen, with all layers everything in it; the parts emb, proj and vit on demand."""
    block = F.regexp_extract("key", rf"^{core}\.blocks\.(\d+)\.", 1)
    frozen = F.lit(False) | (F.nullif(block, F.lit("")).cast("int") < layers)
    if layers == n_layers:
        frozen = frozen | F.startswith("key", F.lit(f"{core}."))
    for on, prefix in ((emb, f"{core}.emb."), (proj, "proj."), (vit, "vit.")):
        if on:
            frozen = frozen | F.startswith("key", F.lit(prefix))
    return params.withColumn("trainable", ~F.coalesce(frozen, F.lit(False)))


def optimizer_groups(params: DataFrame, decay: float, rate: float, rates: DataFrame | None = None) -> DataFrame:
    """(weight_decay, rate, tensors, numbers) of trainable parameters (key, shape, vals and, if there, trainable).

    Tensors of two dimensions or more (those of size one do not count) decay; rates (key, rate) overrides the common rate.
    """
    own = params.filter("trainable") if "trainable" in params.columns else params
    wd = F.when(F.size(F.filter("shape", lambda n: n != 1)) >= 2, F.lit(max(decay, 0.0))).otherwise(F.lit(0.0))
    if rates is not None:
        own = own.join(rates.select("key", F.col("rate").alias("_rate")), "key", "left")
    each = F.coalesce(F.col("_rate"), F.lit(rate)) if rates is not None else F.lit(rate)
    return own.groupBy(wd.alias("weight_decay"), each.alias("rate")).agg(F.count(F.lit(1)).alias("tensors"), F.sum(F.size("vals")).alias("numbers"))


def write_params(params: DataFrame, path: str, name: str) -> None:
    """A checkpoint as a folder name=... of Parquet below path; written whole or not at all."""
    params.drop("ckpt").write.mode("errorifexists").parquet(f"{path}/ckpt={name}")


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """(key, shape, vals, ckpt) of all checkpoints below path."""
    return spark.read.parquet(path)


def saves(epoch: Column, every: int, count: int) -> Column:
    """Whether an epoch (from 0) is saved: the last one, and every `every`-th; the first only if it is the only one or every = 1."""
    regular = (F.pmod(epoch, F.lit(max(every, 1))) == 0) & ((epoch > 0) | F.lit(count == 1 or every == 1))
    return (F.lit(every > 0) & regular) | (epoch == count - 1)
