"""Aggregating scores, bench logs and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.vectors import dot, round6


def macro_averages(scores: DataFrame) -> DataFrame:
    """(level, name, score) of (task_name, task_type, score): each type's mean, mean over tasks, mean over types."""
    by_type = scores.groupBy("task_type").agg(F.avg("score").alias("score"))
    types = by_type.select(F.lit("type").alias("level"), F.col("task_type").alias("name"), "score")
    tasks = scores.agg(F.avg("score").alias("score")).select(F.lit("mean").alias("level"), F.lit("tasks").alias("name"), "score")
    macro = by_type.agg(F.avg("score").alias("score")).select(F.lit("mean").alias("level"), F.lit("types").alias("name"), "score")
    return types.unionByName(tasks).unionByName(macro).withColumn("score", round6(F.col("score")))


def rank_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """V35 (extension): ndcg, mrr and recall at k, means over queries; ranked: (query_id, id, rank), relevant: (query_id, id)."""
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "id"])
    gain = hits.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"), F.count(F.lit(1)).alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    per = wanted.join(gain, "query_id", "left").select(
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("recall")
    )
    return per.agg(*[round6(F.avg(c)).alias(c) for c in ("ndcg", "mrr", "recall")])


def bench_summary(log: DataFrame) -> DataFrame:
    """By mode and length the mean and least latency, throughput and peak memory."""
    return log.groupBy("mode", "len").agg(
        F.avg("latency_ms").alias("latency"), F.min("latency_ms").alias("least"), F.max("peak_bytes").alias("peak"), (F.sum("batch") / (F.sum("latency_ms") / 1000)).alias("per_second")
    )


def speed_ups(summary: DataFrame, baseline: str) -> DataFrame:
    """Each mode's throughput against the baseline's at the same length."""
    base = summary.filter(F.col("mode") == baseline).select("len", F.col("per_second").alias("base"))
    return summary.join(base, "len", "left").withColumn("speed_up", F.col("per_second") / F.col("base"))


def _lse(pairs: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Log of the sum of exponentials of `logit`, stable by the group's maximum, in one aggregation over collected logits of a batch."""
    top = F.array_max("_l")
    lse = top + F.log(F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return pairs.groupBy(*keys).agg(F.sort_array(F.collect_list("logit")).alias("_l")).select(*keys, lse.alias(out))


def info_nce(rows: DataFrame, temperature: float, symmetric: bool = True, mask_source: bool = False) -> DataFrame:
    """(batch_id, loss) of rows (batch_id, i, q, d and for masking source, weight).

    Each query against all documents of its batch; symmetric adds the other direction. mask_source keeps only documents
    of the query's source, and the mean is weighted. A batch is of fixed size, so its pairs are bounded.
    """
    left = rows.select("batch_id", F.col("i").alias("qi"), "q", *([F.col("source").alias("qs"), F.col("weight")] if mask_source else []))
    right = rows.select("batch_id", F.col("i").alias("di"), "d", *([F.col("source").alias("ds")] if mask_source else []))
    pairs = left.join(right, "batch_id")
    if mask_source:
        pairs = pairs.filter(F.col("qs").eqNullSafe(F.col("ds")))
    pairs = pairs.withColumn("logit", dot(F.col("q"), F.col("d")) / temperature).drop("q", "d")
    own = pairs.filter("qi = di")
    by_q = own.join(_lse(pairs, ["batch_id", "qi"], "lse"), ["batch_id", "qi"]).select("batch_id", (F.col("lse") - F.col("logit")).alias("l"), *(["weight"] if mask_source else []))
    if mask_source:
        return by_q.groupBy("batch_id").agg(round6(F.sum(F.col("l") * F.col("weight")) / F.sum("weight")).alias("loss"))
    loss_q = by_q.groupBy("batch_id").agg(F.avg("l").alias("a"))
    if not symmetric:
        return loss_q.select("batch_id", round6(F.col("a")).alias("loss"))
    by_d = own.join(_lse(pairs, ["batch_id", "di"], "lse"), ["batch_id", "di"]).groupBy("batch_id").agg(F.avg(F.col("lse") - F.col("logit")).alias("b"))
    return loss_q.join(by_d, "batch_id").select("batch_id", round6((F.col("a") + F.col("b")) / 2).alias("loss"))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Stable binary cross-entropy of a logit."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def running_mean(rows: DataFrame, group: str, by: str, tie: str, value: str, scale: int = 10_000, out: str = "mean") -> DataFrame:
    """The mean of all values up to each row, by the whole number `by`, then tie. Nulls do not count.

    Values are added as whole numbers of 1 / scale, so that no order of additions shows. A group is cut into buckets of
    ranges of `by`, whose sums are carried over, so that no task holds a whole group.
    """
    from pairforge.operators.order import number_buckets

    cut = number_buckets(rows, by).withColumn("_v", F.round(F.col(value) * scale).cast("bigint"))
    sums = cut.groupBy(group, "_b").agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("_s"), F.count("_v").alias("_c"))
    past = f"OVER (PARTITION BY {group} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = sums.select(group, "_b", F.expr(f"coalesce(sum(_s) {past}, 0)").alias("_s0"), F.expr(f"coalesce(sum(_c) {past}, 0)").alias("_c0"))
    here = f"OVER (PARTITION BY {group}, _b ORDER BY {by}, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    own = cut.withColumns({"_s1": F.expr(f"coalesce(sum(_v) {here}, 0)"), "_c1": F.expr(f"count(_v) {here}")}).join(carried, [group, "_b"])
    n = F.col("_c0") + F.col("_c1")
    return own.withColumn(out, F.when(n > 0, (F.col("_s0") + F.col("_s1")) / (F.lit(float(scale)) * n))).select(*rows.columns, out)


def previous(rows: DataFrame, group: str, by: str, tie: str, out: str = "previous") -> DataFrame:
    """The value of `by` in the row before, in the order of by and tie; over bucket borders the largest of the buckets before."""
    from pairforge.operators.order import number_buckets

    cut = number_buckets(rows, by)
    tops = cut.groupBy(group, "_b").agg(F.max(by).alias("_top"))
    carried = tops.select(group, "_b", F.expr(f"max(_top) OVER (PARTITION BY {group} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("_last"))
    own = cut.withColumn("_lag", F.expr(f"lag({by}) OVER (PARTITION BY {group}, _b ORDER BY {by}, {tie})")).join(carried, [group, "_b"])
    return own.withColumn(out, F.coalesce("_lag", "_last")).select(*rows.columns, out)


def top_k_top_p(rows: DataFrame, k: int, p: float, temperature: float = 1.0) -> DataFrame:
    """(dist_id, token, prob) of (dist_id, token, logit): softmax, the k largest, then the smallest head whose sum reaches p."""
    top = F.expr("max(logit) OVER (PARTITION BY dist_id)")
    e = rows.withColumn("e", F.exp((F.col("logit") - top) / temperature))
    ranked = e.withColumn("prob", F.col("e") / F.expr("sum(e) OVER (PARTITION BY dist_id)")).withColumn("nth", F.expr("row_number() OVER (PARTITION BY dist_id ORDER BY logit DESC, token)"))
    headed = ranked.filter(F.col("nth") <= k).withColumn("before", F.expr("coalesce(sum(prob) OVER (PARTITION BY dist_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)"))
    return headed.filter(F.round("before", 9) < p).select("dist_id", "token", "prob")


def argmax(rows: DataFrame) -> DataFrame:
    """The token with the largest logit (ties: the smallest token)."""
    return rows.groupBy("dist_id").agg(F.max_by("token", F.struct(F.col("logit"), (-F.col("token")).alias("t"))).alias("token"))
