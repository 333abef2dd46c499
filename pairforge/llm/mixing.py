"""Problem 4: a mix of sources with target shares, by capped water-filling.

Shares are cleaned (see clean_config) and normalised to weights. A source can give at most its records times its
max_repeats. Water-filling: every source over its limit is clamped there, its excess weight goes to the others in
proportion to their weights, again until none is over. Fractions become whole records by largest remainder. A quota of
n records from m available ones is n // m whole repetitions of every record and one more of the n % m records with the
smallest seeded digests; that cut is found by a histogram of digest prefixes, so that no source is ever sorted in one task.

Defined results: blanks around names are ignored; repeated configuration rows count once (the largest value of each
column); ratios are clamped to 0..1; a null, negative or NaN share falls back on the source's part of the upstream size
(ratio times total_lines, null as 0); null max_repeats is 1, under 0 is 0; sources without records, with no share, or
not configured (null among them) give nothing; an empty table gives an empty mix. Where all limits together are below the
wanted size, the mix is that much smaller. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate
from math import frexp, ldexp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.rand import det_key, key_int

BINS = 4096
#: Configuration rows and the sources they name are held by the driver; a configuration is written by hand.
MAX_SOURCES = 1_000_000


@dataclass(frozen=True)
class Quota:
    """What one source gives."""

    source: str
    weight: float
    available: int
    max_repeats: int
    n: int


def clean_config(config: DataFrame) -> DataFrame:
    """(source, share, upstream, max_repeats), one row for each source."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("sample_ratio", F.lit(0.0)), F.lit(0.0))))
    share = F.when(~F.isnan("dataset_share") & (F.col("dataset_share") >= 0), F.col("dataset_share"))
    return (
        config.select(
            F.trim("file").alias("source"),
            share.alias("share"),
            (ratio * F.greatest(F.lit(0), F.coalesce("total_lines", F.lit(0)))).alias("upstream"),
            F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"),
        )
        .filter(F.coalesce("source", F.lit("")) != "")
        .groupBy("source")
        .agg(F.max("share").alias("share"), F.max("upstream").alias("upstream"), F.max("max_repeats").alias("max_repeats"))
    )


def water_fill(weights: list[float], limits: list[int], size: int) -> list[int]:
    """Whole numbers below the limits that sum to size (or to all limits of weighted entries), in proportion where no limit binds."""
    live = [i for i, w in enumerate(weights) if w > 0 and limits[i] > 0]
    amount = [0.0] * len(weights)
    size = min(size, sum(limits[i] for i in live))
    # Times a power of two, which changes no ratio: of the tiniest weights, limit / weight would be infinite and shares lose digits.
    up = max(0, 900 - max((frexp(weights[i])[1] for i in live), default=0))
    weights = [ldexp(w, up) if w > 0 else w for w in weights]
    # The water level rises to the limits in the order of limit / weight; what passes a limit is clamped, one sort for all.
    live.sort(key=lambda i: (limits[i] / weights[i], i))
    left, total = size, list(accumulate(weights[i] for i in reversed(live)))[::-1]  # weights from each one on
    for n, i in enumerate(live):
        if left * weights[i] < limits[i] * total[n]:
            for j in live[n:]:
                amount[j] = left * weights[j] / total[n]
            break
        amount[i] = limits[i]
        left -= limits[i]
    whole = [int(a) for a in amount]
    # Largest remainder; ties by position. A clamped entry has no remainder, so no limit is passed.
    rest = sorted((i for i in range(len(amount)) if amount[i] > whole[i]), key=lambda i: (whole[i] - amount[i], i))
    for i in rest[: size - sum(whole)]:
        whole[i] += 1
    return whole


def plan_mix(records: DataFrame, config: DataFrame, size: int | None = None) -> list[Quota]:
    """One quota for each configured source, sorted by name. size: records wanted; by default as many as the configured sources have."""
    counts = records.groupBy(F.trim("source").alias("source")).agg(F.count(F.lit(1)).alias("available"))
    rows = clean_config(config).join(counts, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"the configuration names more than {MAX_SOURCES} sources")
    upstream = sum(r.upstream for r in rows) or 1.0
    shares = [r.upstream / upstream if r.share is None else r.share for r in rows]
    total = sum(shares) or 1.0
    available = [r.available or 0 for r in rows]
    limits = [a * r.max_repeats for a, r in zip(available, rows)]
    n = water_fill([s / total for s in shares], limits, sum(available) if size is None else size)
    return [Quota(r.source, s / total, a, r.max_repeats, q) for r, s, a, q in zip(rows, shares, available, n)]


def mix(records: DataFrame, quotas: list[Quota], seed: int = 22, id_col: str = "rec_id") -> DataFrame:
    """(id, source, repeat_no from 1): the mix, one row for each use of a record."""
    spark = records.sparkSession
    used = [(q.source, q.n // q.available, q.n % q.available) for q in quotas if q.n]
    plan = F.broadcast(spark.createDataFrame(used, "source STRING, whole BIGINT, part BIGINT"))  # at most MAX_SOURCES short rows
    key = det_key(seed, "mix", F.col(id_col))
    rows = records.select(F.col(id_col), F.trim("source").alias("source"), key.alias("key")).withColumn(
        "bin", F.floor(key_int(F.col("key")) * BINS / F.lit(2**32)).cast("int")
    )
    per_bin = rows.join(plan, "source").filter("part > 0").groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("part").alias("part"))
    # At most BINS rows in each window.
    running = F.expr("sum(n) OVER (PARTITION BY source ORDER BY bin)")
    cut = (
        per_bin.withColumn("upto", running)
        .filter((F.col("upto") >= F.col("part")) & (F.col("upto") - F.col("n") < F.col("part")))
        .select("source", F.col("bin").alias("cut_bin"), (F.col("part") - F.col("upto") + F.col("n")).alias("need"))
    )
    rows = rows.join(plan, "source").join(F.broadcast(cut), "source", "left")  # one row for each source
    inside = rows.withColumn("extra", F.when(F.col("bin") < F.col("cut_bin"), 1).otherwise(0)).filter(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin")))
    edge = (  # a 4096th of each source
        rows.filter(F.col("bin") == F.col("cut_bin"))
        .withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY source ORDER BY key, {id_col})"))
        .withColumn("extra", F.when(F.col("rank") <= F.col("need"), 1).otherwise(0))
        .drop("rank")
    )
    times = (F.col("whole") + F.col("extra")).cast("int")
    return (
        inside.unionByName(edge)
        .filter(times > 0)
        .select(F.col(id_col), "source", F.explode(F.sequence(F.lit(1), times)).alias("repeat_no"))
    )


def report(mixed: DataFrame, quotas: list[Quota]) -> DataFrame:
    """One row for each configured source: target share, limits, and what the mix really holds."""
    spark = mixed.sparkSession
    wanted = spark.createDataFrame(
        [(q.source, q.weight, q.available, q.max_repeats) for q in quotas],
        "source STRING, target_share DOUBLE, available BIGINT, max_repeats INT",
    )
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_mixed"),
        F.count_if(F.col("repeat_no") == 1).alias("n_distinct"),
        F.max("repeat_no").alias("most_repeats"),
    )
    r6 = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
    return (
        wanted.join(got, "source", "left")
        .withColumn("n_mixed", F.coalesce("n_mixed", F.lit(0)))
        .withColumn("total", F.expr("sum(n_mixed) OVER ()"))  # as many rows as the configuration
        .select(
            "source",
            r6(F.col("target_share")).alias("target_share"),
            "available",
            "max_repeats",
            "n_mixed",
            F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.when(F.col("total") > 0, r6(F.col("n_mixed") / F.col("total"))).alias("actual_share"),
        )
    )
