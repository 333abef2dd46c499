"""Sampling plans, quotas and balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.maths import nearest_multiple
from pairforge.functions.rand import det_key, hash01, key_int
from pairforge.functions.vectors import round6
from pairforge.operators.enrich import small

#: Copies of a group that one row stands for before they are made.
COPY_RUN = 10_000


def round3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def whole_percentile(col: str, q: float) -> Column:
    """An exact percentile with linear interpolation, cut to a whole number."""
    return F.floor(F.round(F.percentile(col, F.lit(q)), 9)).cast("bigint")


def sampling_config(counts: DataFrame, target: int | None = None) -> DataFrame:
    """(file, total_lines, sample_ratio, sampled_lines, dataset_share) of (file, total_lines).

    target: lines wanted from each file; by default the median of all. Windows run over one row for each file.
    """
    goal = counts.agg(whole_percentile("total_lines", 0.5).alias("goal")) if target is None else counts.sparkSession.createDataFrame([(target,)], "goal BIGINT")
    ratio = F.when(F.col("total_lines") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("goal") / F.col("total_lines")))
    rows = counts.crossJoin(F.broadcast(goal)).withColumn("ratio", ratio)  # one row beside
    rows = rows.withColumn("sampled_lines", F.floor(F.col("total_lines") * F.col("ratio"))).withColumn("all_sampled", F.expr("sum(sampled_lines) OVER ()"))
    share = F.when(F.col("all_sampled") > 0, round3(F.col("sampled_lines") / F.col("all_sampled")))
    return rows.select("file", "total_lines", round3(F.col("ratio")).alias("sample_ratio"), "sampled_lines", share.alias("dataset_share"))


def parse_config(config: DataFrame) -> DataFrame:
    """Ratios clamped to 0..1, lines and shares computed anew; sum 0 gives null shares. Nulls count as 0."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("sample_ratio", F.lit(0.0))))
    rows = config.select(F.trim("file").alias("file"), F.coalesce("total_lines", F.lit(0)).alias("total_lines"), ratio.alias("sample_ratio"))
    rows = rows.withColumn("sampled_lines", F.floor(F.col("total_lines") * F.col("sample_ratio"))).withColumn("_all", F.expr("sum(sampled_lines) OVER ()"))
    return rows.select("file", "total_lines", "sample_ratio", "sampled_lines", F.when(F.col("_all") > 0, round6(F.col("sampled_lines") / F.col("_all"))).alias("dataset_share"))


def estimated(sampled: str = "sampled_lines", total: str = "total_lines", ratio: str = "sample_ratio") -> Column:
    """The wanted lines, else lines times ratio, else null."""
    return F.coalesce(F.col(sampled).cast("double"), F.col(total) * F.col(ratio))


def quotas(entries: DataFrame, cap: int | None, order: str = "file") -> DataFrame:
    """Adds `quota` to (order, est): est rounded half to even if all fit under the cap, else largest remainder.

    Ties go to the smaller `order`; a null est has a null quota. One row for each data set.
    """
    if cap is None:
        return entries.withColumn("quota", F.rint("est").cast("bigint"))
    e = entries.withColumn("_e", F.greatest(F.lit(0.0), F.col("est"))).withColumn("_all", F.expr("sum(_e) OVER ()"))
    e = e.withColumn("_scaled", F.when(F.col("_all") > 0, F.col("_e") * cap / F.col("_all")).when(F.col("_e").isNotNull(), 0.0)).withColumn("_floor", F.floor("_scaled"))
    e = e.withColumn("_rest", F.lit(cap) - F.expr("sum(_floor) OVER ()"))
    frac = "round(_scaled - _floor, 9)"
    e = e.withColumn("_nth", F.expr(f"row_number() OVER (ORDER BY {frac} DESC NULLS LAST, {order})"))
    fitted = F.col("_floor") + F.when((F.col("_nth") <= F.col("_rest")) & (F.col("_all") > 0), 1).otherwise(0)
    quota = F.when(F.col("_e").isNull(), None).when(F.col("_all") <= cap, F.rint("est")).otherwise(fitted)
    return e.withColumn("quota", quota.cast("bigint")).drop("_e", "_all", "_scaled", "_floor", "_rest", "_nth")


def bernoulli(df: DataFrame, ratio: Column, seed: int, id_col: str) -> DataFrame:
    """Each row by its own reproducible number; evaluated before any parsing."""
    return df.filter(hash01(seed, "bernoulli", id_col) <= ratio)


def domain_types(records: DataFrame, most_labels: int = 200, least_repeat: int = 5) -> DataFrame:
    """(domain, n, labels, domain_type); domains with few, often repeated positives are classification."""
    rows = records.withColumn("domain", F.coalesce("source", F.lit("unknown")))
    n = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    labels = rows.select("domain", F.explode("pos").alias("label")).groupBy("domain").agg(F.count_distinct("label").alias("labels"))
    got = n.join(labels, "domain", "left").withColumn("labels", F.coalesce("labels", F.lit(0)))
    cls = (F.col("labels") > 0) & (F.col("labels") <= most_labels) & (F.col("n") / F.col("labels") >= least_repeat)
    return got.withColumn("domain_type", F.when(cls, "classification").otherwise("general"))


def balance_targets(sizes: DataFrame, strategy: str, chunk: int) -> DataFrame:
    """(domain, n, goal, target) of (domain, n). target is goal as a multiple of the chunk size."""
    if strategy == "none":
        return sizes.withColumn("goal", F.col("n")).withColumn("target", F.col("n"))
    if strategy == "range":
        q = sizes.agg(F.greatest(whole_percentile("n", 0.25), F.lit(chunk)).alias("lo"), whole_percentile("n", 0.75).alias("hi"))
        goal = F.least(F.greatest("n", "lo"), F.greatest("hi", "lo"))
    elif strategy == "median":
        q = sizes.agg(F.greatest(whole_percentile("n", 0.5), F.lit(chunk)).alias("goal_of_all"))
        goal = F.col("goal_of_all")
    elif strategy == "probability":
        q = None
        goal = F.greatest(F.lit(1), F.rint(F.least(F.lit(1.0), F.pow("n", F.lit(0.75)) / F.col("n")) * F.col("n")).cast("bigint"))
    else:
        raise ValueError(f"unsupported sampling strategy: {strategy}")
    rows = sizes if q is None else sizes.crossJoin(F.broadcast(q))  # one row beside
    return rows.select("domain", "n", goal.cast("bigint").alias("goal")).withColumn("target", nearest_multiple(F.col("goal"), chunk))


def resize(rows: DataFrame, targets: DataFrame, seed: int, id_col: str, group: str = "domain") -> DataFrame:
    """Each group at its target size; adds `copy` (0: the row itself).

    Down: the rows with the smallest digests. Up: all rows and further picks with replacement, by digests of the copy's
    number. targets: (group, n, target). A group is never gathered: places are counted within salts of the group, with the
    sizes of the salts before it. A null group is the group "unknown", in rows and targets.
    """
    named = F.coalesce(group, F.lit("unknown")).alias(group)
    rows = rows.select(*[named if c == group else c for c in rows.columns])
    targets = targets.select(named, "n", "target")
    spark = rows.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = det_key(seed, "resize", group, id_col)
    # Salts by the digest's own order, so that places over all salts follow the digests.
    salted = rows.withColumn("_key", key).withColumn("_salt", F.floor(key_int(F.col("_key")) * salts / F.lit(2**32)).cast("int"))
    counts = salted.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(group, "_salt", F.expr(f"coalesce(sum(_c) OVER (PARTITION BY {group} ORDER BY _salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_before"))
    placed = salted.withColumn("_in", F.expr(f"row_number() OVER (PARTITION BY {group}, _salt ORDER BY _key, {id_col}) - 1"))
    placed = placed.join(before, [group, "_salt"]).withColumn("_place", F.col("_before") + F.col("_in")).drop("_key", "_salt", "_in", "_before")
    goals = targets.select(group, F.col("n").alias("_n"), F.col("target").alias("_target"))
    kept = placed.join(small(goals), group).filter(F.col("_place") < F.col("_target")).withColumn("copy", F.lit(0).cast("bigint"))
    # Copies in runs of COPY_RUN, dealt out before they are made, so that one group's many copies are not one task's.
    short = goals.filter((F.col("_target") > F.col("_n")) & (F.col("_n") > 0)).withColumn("_need", F.col("_target") - F.col("_n"))
    runs = short.select(group, "_n", "_need", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("_need") - 1).cast("bigint"), F.lit(COPY_RUN).cast("bigint"))).alias("_from"))
    more = runs.repartition(group, "_from").select(group, "_n", F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + COPY_RUN, "_need"))).alias("copy"))
    picked = more.withColumn("_place", F.pmod(key_int(det_key(seed, "pick", group, "copy")), F.col("_n"))).drop("_n")
    copies = placed.join(picked, [group, "_place"])
    return kept.drop("_n", "_target").unionByName(copies).drop("_place")


def ranked_pool(df: DataFrame, seed: int, id_col: str, size: int) -> DataFrame:
    """(place, text) of a pool of at most `size` texts in a seeded order; the size is the pool's stated bound."""
    from pairforge.operators.order import bottom_k

    return bottom_k(df, seed, id_col, size, name="place").select("place", "text")


def pad_negatives(records: DataFrame, pool: DataFrame, desired: int, seed: int, id_col: str = "rec_id") -> DataFrame:
    """Exactly up to `desired` negatives: cut, or filled from the pool without the query and positives.

    Twice the missing number is drawn from the pool, at places that follow from the row's digest; what is excluded among
    them may leave a row with fewer.
    """
    size = pool.count()
    neg = F.coalesce("neg", F.array().cast("array<string>"))
    rows = records.withColumn("neg", F.slice(neg, 1, desired)).withColumn("_need", F.lit(desired) - F.size("neg"))
    if not size:
        return rows.drop("_need")
    start = F.pmod(key_int(det_key(seed, "neg", id_col)), F.lit(size))
    short = rows.filter(F.col("_need") > 0)
    draws = short.select(id_col, "query", "pos", "_need", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_need") * 2 - 1), lambda i: F.pmod(start + i, F.lit(size)))).alias("_i", "place"))
    drawn = draws.join(small(pool), "place").filter((F.col("text") != F.col("query")) & ~F.coalesce(F.array_contains("pos", F.col("text")), F.lit(False)))
    fills = drawn.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_i", "text"))).alias("_fills"))  # 2 * desired at most
    texts = F.coalesce(F.transform("_fills", lambda x: x["text"]), F.array().cast("array<string>"))
    return rows.join(fills, id_col, "left").withColumn("neg", F.concat("neg", F.slice(texts, F.lit(1), F.greatest("_need", F.lit(0))))).drop("_need", "_fills")


def random_positive(seed: int, id_col: str) -> Column:
    """One positive by the row's digest; null if it has none."""
    return F.when(F.size("pos") > 0, F.element_at("pos", 1 + F.pmod(key_int(det_key(seed, "pos", id_col)), F.size("pos")).cast("int")))
