"""Sampling configurations, plans, balancing, shuffles and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.rand import det_key, sql_hash01, sql_key
from pairforge.functions.text import percent_text
from pairforge.functions.vectors import round6
from pairforge.operators import order, sampling
from pairforge.registry import CORE, table

SEED = 22
_COUNTS = "counts AS (SELECT source AS file, count(*) AS total_lines FROM documents GROUP BY 1)"
_CONFIG = f"""WITH {_COUNTS}, goal AS (SELECT floor(round(quantile_cont(total_lines, 0.5), 9)) AS goal FROM counts
), r AS (SELECT file, total_lines, CASE WHEN total_lines = 0 THEN 0.0 ELSE least(1.0, goal / total_lines) END AS ratio FROM counts, goal
), s AS (SELECT *, CAST(floor(total_lines * ratio) AS BIGINT) AS sampled_lines FROM r
), config AS (SELECT file, total_lines, floor(ratio * 1000 + 0.5) / 1000 AS sample_ratio, sampled_lines,
  floor(sampled_lines / sum(sampled_lines) OVER () * 1000 + 0.5) / 1000 AS dataset_share FROM s)"""


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("total_lines"))


@CORE.query("line_counts", "A01", "S04", oracle="SELECT file, count(*) AS total_lines FROM raw_records GROUP BY file")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_records").groupBy("file").agg(F.count(F.lit(1)).alias("total_lines"))


@CORE.query("sampling_config", "A02", "A03", "B01", "B02", "B03", oracle=_CONFIG + " SELECT * FROM config")
def sampling_config(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sampling_config(_counts(spark, sf))


@CORE.query(
    "parse_sampling_config",
    oracle="""WITH r AS (SELECT trim(file) AS file, coalesce(total_lines, 0) AS total_lines, least(1.0, greatest(0.0, coalesce(sample_ratio, 0.0))) AS sample_ratio FROM sampling_config
    ), s AS (SELECT *, CAST(floor(total_lines * sample_ratio) AS BIGINT) AS sampled_lines FROM r)
    SELECT *, floor(sampled_lines / sum(sampled_lines) OVER () * 1e6 + 0.5) / 1e6 AS dataset_share FROM s""",
)
def parse_sampling_config(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.parse_config(table(spark, sf, "sampling_config"))


@CORE.query(
    "sampling_plan_report", "F14", "O14",
    oracle="SELECT DISTINCT trim(file) AS file, coalesce(printf('%.2f%%', dataset_share * 100), 'n/a') AS share FROM sampling_config",
)
def sampling_plan_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "sampling_config").select(F.trim("file").alias("file"), "dataset_share").distinct()
    return rows.orderBy(F.desc_nulls_last("dataset_share"), "file").select("file", percent_text(F.col("dataset_share")).alias("share"))


def _plan_sql(est: str, source: str, cap: int) -> str:
    return f"""e AS (SELECT *, greatest(0.0, est) AS e, sum(greatest(0.0, est)) OVER () AS total FROM (SELECT *, {est} AS est FROM {source})
    ), f AS (SELECT *, e * {cap} / total AS scaled, floor(e * {cap} / total) AS lo FROM e
    ), q AS (SELECT *, {cap} - sum(lo) OVER () AS rest, row_number() OVER (ORDER BY round(scaled - lo, 9) DESC NULLS LAST, file) AS nth FROM f
    ), plan AS (SELECT *, CAST(CASE WHEN e IS NULL THEN NULL WHEN total <= {cap} THEN round_even(est, 0) ELSE lo + CASE WHEN nth <= rest THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM q)"""


@CORE.query(
    "sampling_plan_largest_remainder", "B04", "B05", "W06",
    oracle=f"""WITH c AS (SELECT trim(file) AS file, max(CAST(sampled_lines AS DOUBLE)) AS s, max(total_lines * sample_ratio) AS t FROM sampling_config GROUP BY 1), {_plan_sql('coalesce(s, t)', 'c', 100_000)}
    SELECT file, est, quota FROM plan""",
)
def sampling_plan_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "sampling_config").groupBy(F.trim("file").alias("file")).agg(
        F.coalesce(F.max(F.col("sampled_lines").cast("double")), F.max(F.col("total_lines") * F.col("sample_ratio"))).alias("est")
    )
    return sampling.quotas(c, 100_000).select("file", "est", "quota")


@CORE.query(
    "bernoulli_sample", "B06", "B07",
    oracle=f"""SELECT rec_id FROM normalised JOIN (SELECT trim(file) AS source, max(sample_ratio) AS ratio FROM sampling_config GROUP BY 1) USING (source)
    WHERE {sql_hash01(SEED, 'bernoulli', 'rec_id')} <= ratio""",
)
def bernoulli_sample(spark: SparkSession, sf: str) -> DataFrame:
    ratios = table(spark, sf, "sampling_config").groupBy(F.trim("file").alias("source")).agg(F.max("sample_ratio").alias("ratio"))
    rows = table(spark, sf, "normalised").join(F.broadcast(ratios), "source")  # a row for each configured source
    return sampling.bernoulli(rows, F.col("ratio"), SEED, "rec_id").select("rec_id")


@CORE.query("reservoir_pool", "B08", oracle=f"SELECT doc_id, text FROM documents ORDER BY {sql_key(SEED, 'pool', 'doc_id')}, doc_id LIMIT 500")
def reservoir_pool(spark: SparkSession, sf: str) -> DataFrame:
    return order.bottom_k(table(spark, sf, "documents").select("doc_id", "text"), SEED, "doc_id", 500)


@CORE.query("limit_per_source", "O08", oracle="SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 20")
def limit_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return order.limit_per_group(table(spark, sf, "documents"), "source", 20, "doc_id").select("source", "doc_id")


@CORE.query("global_limit", "O09", oracle=f"SELECT doc_id FROM documents ORDER BY {sql_key(SEED, 'shuffle', 'doc_id')}, doc_id LIMIT 100")
def global_limit(spark: SparkSession, sf: str) -> DataFrame:
    return order.shuffled(table(spark, sf, "documents"), SEED, "doc_id").limit(100).select("doc_id")


@CORE.query(
    "domain_types", "A04", "A05", "A06",
    oracle="""WITH n AS (SELECT coalesce(source, 'unknown') AS domain, count(*) AS n FROM normalised GROUP BY 1
    ), l AS (SELECT domain, count(DISTINCT label) AS labels FROM (SELECT coalesce(source, 'unknown') AS domain, unnest(pos) AS label FROM normalised) GROUP BY 1)
    SELECT domain, n, coalesce(labels, 0) AS labels, CASE WHEN labels > 0 AND labels <= 200 AND n / labels >= 5 THEN 'classification' ELSE 'general' END AS domain_type FROM n LEFT JOIN l USING (domain)""",
)
def domain_types(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.domain_types(table(spark, sf, "normalised"))


CHUNK = 64
_DOMAIN = "coalesce(source, 'unknown')"
_SIZES = f"sizes AS (SELECT {_DOMAIN} AS domain, count(*) AS n FROM normalised GROUP BY 1)"
_GOALS = {
    "range": "least(greatest(n, lo), greatest(hi, lo)) FROM sizes, (SELECT greatest(CAST(floor(round(quantile_cont(n, 0.25), 9)) AS BIGINT), 64) AS lo, CAST(floor(round(quantile_cont(n, 0.75), 9)) AS BIGINT) AS hi FROM sizes)",
    "median": "(SELECT greatest(CAST(floor(round(quantile_cont(n, 0.5), 9)) AS BIGINT), 64) FROM sizes) FROM sizes",
    "probability": "greatest(1, CAST(round_even(least(1.0, pow(n, 0.75) / n) * n, 0) AS BIGINT)) FROM sizes",
}


def _balance_sql(strategy: str) -> str:
    return f"""WITH {_SIZES}, g AS (SELECT domain, n, {_GOALS[strategy].replace(' FROM', ' AS goal FROM', 1) if strategy != 'median' else _GOALS[strategy].replace(') FROM sizes', ') AS goal FROM sizes')}
    ), t AS (SELECT *, greatest({CHUNK}, CAST(round_even(goal / {CHUNK}.0, 0) * {CHUNK} AS BIGINT)) AS target FROM g
    ), p AS (SELECT rec_id, {_DOMAIN} AS domain, row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY {sql_key(SEED, 'resize', _DOMAIN, 'rec_id')}, rec_id) - 1 AS place FROM normalised
    ), more AS (SELECT domain, n, unnest(range(1, target - n + 1)) AS copy FROM t WHERE target > n
    ), picks AS (SELECT domain, copy, CAST('0x' || substr({sql_key(SEED, 'pick', 'domain', 'copy')}, 1, 8) AS BIGINT) % n AS place FROM more)
    SELECT domain, rec_id, 0 AS copy FROM p JOIN t USING (domain) WHERE place < target
    UNION ALL SELECT domain, rec_id, copy FROM picks JOIN p USING (domain, place)"""


def _balance(strategy: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, "normalised").select("rec_id", F.coalesce("source", F.lit("unknown")).alias("domain"))
        sizes = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
        return sampling.resize(rows, sampling.balance_targets(sizes, strategy, CHUNK), SEED, "rec_id").select("domain", "rec_id", "copy")

    return run


for _s, _id in (("range", "B13"), ("median", "B14"), ("probability", "B15")):
    CORE.query(f"balance_{_s}", _id, "A07", "A08", "B10", "B11", "B12", "B16", "B24", oracle=_balance_sql(_s))(_balance(_s))


@CORE.query(
    "min_per_source_floor", "B18", "B19",
    oracle=f"""WITH t AS (SELECT {_DOMAIN} AS domain, count(*) AS n, greatest(count(*), 1000) AS target FROM normalised GROUP BY 1
    ), p AS (SELECT rec_id, {_DOMAIN} AS domain, row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY {sql_key(SEED, 'resize', _DOMAIN, 'rec_id')}, rec_id) - 1 AS place FROM normalised
    ), picks AS (SELECT domain, copy, CAST('0x' || substr({sql_key(SEED, 'pick', 'domain', 'copy')}, 1, 8) AS BIGINT) % n AS place FROM (SELECT domain, n, unnest(range(1, target - n + 1)) AS copy FROM t))
    SELECT domain, rec_id, 0 AS copy FROM p JOIN t USING (domain) UNION ALL SELECT domain, rec_id, copy FROM picks JOIN p USING (domain, place)""",
)
def min_per_source_floor(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalised").select("rec_id", F.coalesce("source", F.lit("unknown")).alias("domain"))
    targets = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).withColumn("target", F.greatest(F.col("n"), F.lit(1000)))
    return sampling.resize(rows, targets, SEED, "rec_id").select("domain", "rec_id", "copy")


POOL = 1000


@CORE.query(
    "pad_negatives", "B09", "B21", "J08", "J10", "O12",
    oracle=f"""WITH pool AS (SELECT row_number() OVER (ORDER BY {sql_key(SEED, 'pool', 'doc_id')}, doc_id) - 1 AS place, text FROM documents WHERE text <> '' QUALIFY place < {POOL}
    ), size AS (SELECT count(*) AS size FROM pool
    ), r AS (SELECT rec_id, query, pos, coalesce(neg, [])[1:3] AS neg, 3 - len(coalesce(neg, [])[1:3]) AS need, CAST('0x' || substr({sql_key(SEED, 'neg', 'rec_id')}, 1, 8) AS BIGINT) % size AS start, size FROM normalised, size
    ), d AS (SELECT rec_id, query, pos, i, (start + i) % size AS place FROM (SELECT *, unnest(range(0, need * 2)) AS i FROM r)
    ), f AS (SELECT rec_id, list(text ORDER BY i) AS fills FROM d JOIN pool USING (place) WHERE text <> query AND NOT coalesce(list_contains(pos, text), false) GROUP BY 1)
    SELECT rec_id, list_concat(neg, CASE WHEN need > 0 THEN coalesce(fills, [])[1:need] ELSE [] END) AS neg FROM r LEFT JOIN f USING (rec_id)""",
)
def pad_negatives(spark: SparkSession, sf: str) -> DataFrame:
    pool = sampling.ranked_pool(table(spark, sf, "documents").filter("text <> ''").select("doc_id", "text"), SEED, "doc_id", POOL)
    return sampling.pad_negatives(table(spark, sf, "normalised").select("rec_id", "query", "pos", "neg"), pool, 3, SEED).select("rec_id", "neg")


@CORE.query(
    "random_positive", "B20",
    oracle=f"SELECT rec_id, CASE WHEN len(pos) > 0 THEN pos[1 + CAST('0x' || substr({sql_key(SEED, 'pos', 'rec_id')}, 1, 8) AS BIGINT) % len(pos)] END AS positive FROM normalised",
)
def random_positive(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "normalised").select("rec_id", sampling.random_positive(SEED, "rec_id").alias("positive"))


@CORE.query(
    "easy_medium_hard_negatives", "B22", "B23", "J09",
    oracle=f"""WITH r AS (SELECT rec_id, query, source, pos[1] AS positive, coalesce(neg, [])[1:2] AS hard FROM normalised WHERE query IS NOT NULL AND len(pos) > 0
    ), slots AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY {sql_key(SEED, 'medium', 'rec_id')}, rec_id) AS place, count(*) OVER (PARTITION BY source) AS size FROM r WHERE positive IS NOT NULL
    ), medium AS (SELECT a.rec_id, list(b.positive ORDER BY i) AS medium FROM (SELECT *, unnest(range(1, 4)) AS i FROM slots) a JOIN slots b ON a.source = b.source AND b.place = 1 + (a.place - 1 + a.i) % a.size
      WHERE b.query <> a.query AND b.positive <> a.positive GROUP BY 1)
    SELECT rec_id, hard, coalesce(medium, []) AS medium FROM r LEFT JOIN medium USING (rec_id)""",
)
def easy_medium_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    from pairforge.operators.mining import mixed_negatives

    return mixed_negatives(table(spark, sf, "normalised"), n_medium=3, n_hard=2, seed=SEED)


@CORE.query("easy_medium_hard_topped", "B22", "J09", "J10")
def easy_medium_hard_topped(spark: SparkSession, sf: str) -> DataFrame:
    from pairforge.operators.mining import topped_negatives

    return topped_negatives(table(spark, sf, "normalised"), n_easy=5, n_medium=3, n_hard=2, seed=SEED)


@CORE.query("shuffle_deterministic", "O01", "O02", "O05", "O06", "W10", oracle=f"SELECT doc_id, row_number() OVER (ORDER BY {sql_key(1337, 'shuffle', 'doc_id')}, doc_id) - 1 AS ord0 FROM documents")
def shuffle_deterministic(spark: SparkSession, sf: str) -> DataFrame:
    return order.shuffled_ordinal(table(spark, sf, "documents").select("doc_id"), 1337, "doc_id")


@CORE.query(
    "merge_shuffle_shards", "O03", "O04", "J11", "U01",
    oracle=f"SELECT shard, id, row_number() OVER (PARTITION BY shard ORDER BY {sql_key(1337, 'shard', 'shard', 'id')}, id) - 1 AS place FROM (SELECT source AS shard, 'd' || doc_id AS id FROM documents UNION ALL SELECT source, 'r' || rec_id FROM normalised)",
)
def merge_shuffle_shards(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").select(F.col("source").alias("shard"), F.concat(F.lit("d"), F.col("doc_id")).alias("id"))
    b = table(spark, sf, "normalised").select(F.col("source").alias("shard"), F.concat(F.lit("r"), F.col("rec_id")).alias("id"))
    return order.shuffled_in_shards(a.unionByName(b), 1337, "shard", "id").withColumn("place", F.col("place").cast("bigint"))


_ORD = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord0, count(*) OVER () AS total FROM documents"


@CORE.query("shards_contiguous", "K02", "W08", oracle=f"SELECT doc_id, CAST(floor(((ord0 + 1) * 7 - 1) / total) AS BIGINT) AS shard FROM ({_ORD})")
def shards_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    return order.with_ordinal(docs, "doc_id").select("doc_id", order.contiguous_shard(F.col("ord0"), F.lit(docs.count()), 7).alias("shard"))


@CORE.query("shards_round_robin", "K03", "W07", oracle=f"SELECT doc_id, ord0 % 7 AS shard FROM ({_ORD})")
def shards_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return order.with_ordinal(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", order.stride_shard(F.col("ord0"), 7).alias("shard"))


@CORE.query("shards_rolling", "K01", "W09", "W11", oracle=f"SELECT doc_id, ord0 // 128 AS shard FROM ({_ORD})")
def shards_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return order.with_ordinal(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", order.rolling_shard(F.col("ord0"), 128).alias("shard"))


@CORE.query("rank_shards", "J17", "S13", oracle="SELECT rec_id, source FROM (SELECT *, dense_rank() OVER (ORDER BY source) - 1 AS i FROM normalised WHERE source IS NOT NULL) WHERE i % 4 = 1")
def rank_shards(spark: SparkSession, sf: str) -> DataFrame:
    return order.rank_files(table(spark, sf, "normalised").select("rec_id", "source").filter("source IS NOT NULL"), 4, 1, "source")
