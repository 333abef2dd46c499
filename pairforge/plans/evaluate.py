"""Score tables, bench logs, schedules, parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import maths, text, vectors as vx
from pairforge.functions.rand import sql_key
from pairforge.operators import enrich, evaluate, params
from pairforge.registry import CORE, table

#: DuckDB: scores of tasks (a part's brand) by type (its size class), from the line items; a bench log from the events.
SCORES = """WITH scores AS (SELECT p_brand || '.v1' AS task_name, CASE p_size % 4 WHEN 0 THEN 'Classification' WHEN 1 THEN 'Retrieval' WHEN 2 THEN 'STS' ELSE 'Other' END AS task_type, avg(l_discount) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
LOG = "WITH log AS (SELECT event_type AS mode, 512 * (1 + user_id % 4) AS len, 1 + abs(value) AS latency_ms, 1 + user_id % 8 AS batch, CAST(floor(abs(value) * 1000) AS BIGINT) AS peak_bytes FROM events)"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    kind = F.when(F.col("p_size") % 4 == 0, "Classification").when(F.col("p_size") % 4 == 1, "Retrieval").when(F.col("p_size") % 4 == 2, "STS").otherwise("Other")
    rows = table(spark, sf, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit(".v1")).alias("task_name"), kind.alias("task_type")), "l_partkey")
    return rows.groupBy("task_name", "task_type").agg(F.avg("l_discount").alias("score"))


@CORE.query(
    "macro_average_scores", "A14", "A15", "O15",
    oracle=SCORES + """, t AS (SELECT task_type, avg(score) AS score FROM scores GROUP BY 1), a AS (
    SELECT 'type' AS level, task_type AS name, score FROM t UNION ALL SELECT 'mean', 'tasks', avg(score) FROM scores UNION ALL SELECT 'mean', 'types', avg(score) FROM t)
    SELECT level, name, floor(score * 1e6 + 0.5) / 1e6 AS score FROM a""",
)
def macro_average_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.macro_averages(_scores(spark, sf))


@CORE.query(
    "filter_task_types", "P22", "P23", "P24", "P25",
    oracle=SCORES + """ SELECT task_name, CASE task_type WHEN 'STS' THEN '[STS]' ELSE '[RETR]' END AS tag, CASE WHEN task_name = 'Brand#11.v1' AND task_type = 'STS' THEN E'Instruct: own\\nQuery: {query}' WHEN task_type = 'STS' THEN E'Instruct: Retrieve semantically similar text\\nQuery: {query}'
        ELSE E'Instruct: Given a query, retrieve documents that answer the query\\nQuery: {query}' END AS instruction,
      regexp_replace(task_name, '\\.[^.]*$', '') AS name FROM scores WHERE task_type IN ('STS', 'Retrieval')""",
)
def filter_task_types(spark: SparkSession, sf: str) -> DataFrame:
    kept = enrich.filter_task_types(_scores(spark, sf), ["STS", "Retrieval"])
    told = enrich.task_instruction(kept, by_task={("STS", "Brand#11"): "own"})
    return told.select("task_name", text.task_tag(F.col("task_type")).alias("tag"), "instruction", text.stem(F.col("task_name")).alias("name"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("mode"), (512 * (1 + F.col("user_id") % 4)).alias("len"), (1 + F.abs("value")).alias("latency_ms"), (1 + F.col("user_id") % 8).alias("batch"), F.floor(F.abs("value") * 1000).alias("peak_bytes")
    )


@CORE.query(
    "throughput_speedup", "A23", "A25", "F10", "F45",
    oracle=LOG + """, s AS (SELECT mode, len, avg(latency_ms) AS latency, min(latency_ms) AS least, max(peak_bytes) AS peak, sum(batch) / (sum(latency_ms) / 1000) AS per_second FROM log GROUP BY ALL)
    SELECT s.mode, s.len, floor(s.latency * 1e6 + 0.5) / 1e6 AS latency, floor(s.least * 1e6 + 0.5) / 1e6 AS least, floor(s.per_second / b.per_second * 1e6 + 0.5) / 1e6 AS speed_up,
      CASE WHEN s.peak < 1024 THEN printf('%d B', s.peak) WHEN s.peak < 1048576 THEN printf('%.2f KB', s.peak / 1024) ELSE printf('%.2f MB', s.peak / 1048576) END AS peak
    FROM s LEFT JOIN s b ON b.len = s.len AND b.mode = 'view'""",
)
def throughput_speedup(spark: SparkSession, sf: str) -> DataFrame:
    got = evaluate.speed_ups(evaluate.bench_summary(_log(spark, sf)), "view")
    r = vx.round6
    return got.select("mode", "len", r(F.col("latency")).alias("latency"), r(F.col("least")).alias("least"), r(F.col("speed_up")).alias("speed_up"), text.memory_text(F.col("peak")).alias("peak"))


@CORE.query(
    "running_mean_loss", "W13", "A22",
    oracle="SELECT event_id, user_id, sum(CAST(round(value * 1e4) AS BIGINT)) OVER w / (1e4 * count(value) OVER w) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def running_mean_loss(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return evaluate.running_mean(e.select("event_id", "user_id", "us", "value"), "user_id", "us", "event_id", "value").select("event_id", "user_id", "mean")


@CORE.query(
    "step_rate", "W14",
    oracle="SELECT event_id, floor(1e6 / (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) * 1e6 + 0.5) / 1e6 AS rate FROM events",
)
def step_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    gap = F.col("us") - F.col("previous")
    return evaluate.previous(e.select("event_id", "user_id", "us"), "user_id", "us", "event_id").select("event_id", vx.round6(F.when(gap != 0, 1e6 / gap)).alias("rate"))


@CORE.query(
    "lr_cosine_schedule", "F37",
    oracle="""WITH s AS (SELECT range AS step, least(1.0, greatest(0.0, (range - 100 + 1) / 4900.0)) AS p FROM range(6000)
    ), l AS (SELECT step, 1e-5 + (1e-3 - 1e-5) * greatest(0.0, 0.5 * (1 + cos(pi() * p))) AS lr FROM s)
    SELECT step, floor(CASE WHEN step < 100 THEN lr * (0.1 + 0.9 * step / 100.0) ELSE lr END * 1e12 + 0.5) / 1e12 AS lr FROM l""",
)
def lr_cosine_schedule(spark: SparkSession, sf: str) -> DataFrame:
    rate = maths.cosine_rate(F.col("id"), 1e-3, 1e-5, 100, 5000)
    return spark.range(6000).select(F.col("id").alias("step"), (F.floor(rate * 1e12 + 0.5) / 1e12).alias("lr"))


@CORE.query(
    "layerwise_lr", "F38",
    oracle="SELECT range AS layer, floor(1e-3 / pow(0.9, 24) * pow(0.9, range) * CASE WHEN range = 24 THEN 5 ELSE 1 END * 1e9 + 0.5) / 1e9 AS lr FROM range(25)",
)
def layerwise_lr(spark: SparkSession, sf: str) -> DataFrame:
    rate = maths.layer_rate(F.col("id"), 25, 1e-3, 0.9, F.col("id") == 24)
    return spark.range(25).select(F.col("id").alias("layer"), (F.floor(rate * 1e9 + 0.5) / 1e9).alias("lr"))


@CORE.query("wd_schedule", "F39", oracle="SELECT range AS step, floor(0.1 * exp(ln(0.001 / 0.1) * range / 1000.0) * 1e9 + 0.5) / 1e9 AS wd FROM range(1001)")
def wd_schedule(spark: SparkSession, sf: str) -> DataFrame:
    wd = maths.decay_schedule(F.col("id") / 1000.0, 0.1, 0.001)
    return spark.range(1001).select(F.col("id").alias("step"), (F.floor(wd * 1e9 + 0.5) / 1e9).alias("wd"))


@CORE.query(
    "prime_3n2", "F40", "F41", "F42",
    oracle="""WITH p AS (SELECT range AS p FROM range(2, 500) WHERE range % 3 = 2 AND len(list_filter(range(2, range), lambda d: range % d = 0)) = 0)
    SELECT x.range AS x, CAST(max(p) AS INTEGER) AS prime, CAST(floor(x.range * 3.5 / 32) * 32 AS BIGINT) AS width, CAST(greatest(1, least(4096, floor(sqrt(x.range)))) AS INTEGER) AS lists FROM range(3, 500) x JOIN p ON p < x.range GROUP BY x.range""",
)
def prime_3n2(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("id")
    return spark.range(3, 500).select(x.alias("x"), maths.prime_3n2_below(x.cast("int")).alias("prime"), maths.ffn_width(x).alias("width"), maths.ivf_sizes(x)["lists"].alias("lists"))


_OPTIONS = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]


@CORE.query(
    "best_resolution", "F43", "F44",
    oracle=f"""WITH o AS (SELECT * FROM (VALUES {', '.join(f'({k}, {w}, {h})' for k, (w, h) in enumerate(_OPTIONS))}) t(k, w, h)
    ), x AS (SELECT p_partkey AS id, 100 + p_partkey % 900 AS pw, 100 + p_size * 17 AS ph FROM part
    ), s AS (SELECT *, least(w / pw, h / ph) AS scale FROM x, o)
    SELECT id, arg_min(w, [abs(w * h - floor(pw * scale) * floor(ph * scale)), k]) AS width, arg_min(h, [abs(w * h - floor(pw * scale) * floor(ph * scale)), k]) AS height, max(pw // 3) AS tile_width FROM s GROUP BY id""",
)
def best_resolution(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (100 + F.col("p_partkey") % 900).alias("pw"), (100 + F.col("p_size") * 17).alias("ph"))
    best = x.select("id", maths.best_resolution(F.col("pw"), F.col("ph"), _OPTIONS).alias("b"), maths.tiles(F.col("pw"), F.col("ph"), 2, 3)[0]["right"].cast("bigint").alias("tile_width"))
    return best.select("id", "b.width", "b.height", "tile_width")


#: Three checkpoints of a parameter table, from a closed formula over the suppliers' keys.
PARAMS = """WITH keys AS (SELECT unnest(['model.core.blocks.0.att.w', 'model.core.blocks.1.att.w', 'model.core.blocks.2.att.w', 'model.core.blocks.3.att.w', 'model.core.ln_out.w', 'head.w']) AS key
), params AS (SELECT 'c' || c AS ckpt, key, [4, 2] AS shape, list_transform(range(8), lambda i: (c + 1) * (i + 1) / 7.0 + length(key) / 3.0) AS vals FROM keys, range(3) t(c))"""
_KEYS = [*(f"model.core.blocks.{i}.att.w" for i in range(4)), "model.core.ln_out.w", "head.w"]


def _params(spark: SparkSession) -> DataFrame:
    keys = spark.createDataFrame([(k,) for k in _KEYS], "key STRING")
    ckpts = F.explode(F.sequence(F.lit(0), F.lit(2)))
    vals = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("c") + 1) * (i + 1) / 7.0 + F.length("key") / 3.0)
    return keys.select("key", ckpts.alias("c")).select(F.concat(F.lit("c"), "c").alias("ckpt"), "key", F.array(F.lit(4), F.lit(2)).alias("shape"), vals.alias("vals"))


@CORE.query(
    "ckpt_average", "A17", "F75",
    oracle=PARAMS + ", m AS (SELECT key, i, avg(vals[i]) AS v FROM (SELECT *, unnest(range(1, 9)) AS i FROM params WHERE ckpt <> 'c2') GROUP BY ALL) SELECT key, [4, 2] AS shape, list(floor(v * 1e6 + 0.5) / 1e6 ORDER BY i) AS vals FROM m GROUP BY key",
)
def ckpt_average(spark: SparkSession, sf: str) -> DataFrame:
    return params.average(_params(spark), exclude="c2").withColumn("vals", F.transform("vals", vx.round6))


@CORE.query("extract_module_segment", "F71", "F75", oracle=PARAMS + " SELECT ckpt, regexp_extract(key, '^(?:[^.]+\\.)*?core\\.(.+)$', 1) AS key FROM params WHERE regexp_matches(key, '(^|\\.)core\\..')")
def extract_module_segment(spark: SparkSession, sf: str) -> DataFrame:
    return params.extract(_params(spark), "core").select("ckpt", "key")


@CORE.query("extract_module_prefix", "F72", oracle=PARAMS + " SELECT ckpt, substr(key, 7) AS key FROM params WHERE starts_with(key, 'model.')")
def extract_module_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return params.nested(_params(spark), key="model").select("ckpt", "key")


@CORE.query(
    "remap_layers", "F73", "F74",
    oracle=PARAMS + """, b AS (SELECT ckpt, key, regexp_extract(key, 'blocks\\.(\\d+)\\.', 1) AS block FROM params)
    SELECT ckpt, CASE block WHEN '' THEN key ELSE regexp_replace(key, 'blocks\\.\\d+\\.', 'blocks.' || CASE block WHEN '1' THEN '0' ELSE '1' END || '.') END AS key, 4 AS layers FROM b WHERE block IN ('', '1', '3')""",
)
def remap_layers(spark: SparkSession, sf: str) -> DataFrame:
    p = _params(spark)
    return params.remap_blocks(p, [1, 3]).select("ckpt", "key").crossJoin(F.broadcast(params.layer_count(p)))  # one row


@CORE.query("compress_names", "A21", oracle="SELECT unnest(['model.core.blocks.{0,1,2,3}.att.w', 'model.core.ln_out.w', 'head.w']) AS name")
def compress_names(spark: SparkSession, sf: str) -> DataFrame:
    return params.compress_names(_params(spark))


@CORE.query(
    "parse_specs", "F12", "F13", "F09", "F11", "P26",
    oracle="""SELECT p_partkey AS id, p_size AS lo, p_size + 50 AS hi, [0, 5, 11] AS layers, regexp_replace(list_extract(string_split(p_name || '/' || p_type || '.bin', '/'), -1), '\\.[^.]*$', '') AS stem FROM part""",
)
def parse_specs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    r = text.parse_range(F.concat_ws("-", F.col("p_size"), F.col("p_size") + 50))
    return p.select(
        F.col("p_partkey").alias("id"), r["lo"].alias("lo"), r["hi"].alias("hi"), text.parse_indices(F.lit("0, 5,-1"), F.lit(12)).alias("layers"), text.stem(F.concat("p_name", F.lit("/"), "p_type", F.lit(".bin"))).alias("stem")
    )


@CORE.query(
    "benchmark_aliases", "S26",
    oracle="SELECT p_partkey AS id, ['BEIR_NL', 'MTEB_CODE_V1', 'VN_MTEB_VIE_V1', 'RAR_B'][1 + p_partkey % 4] AS alias, ['BEIR-NL', 'MTEB(Code, v1)', 'VN-MTEB (vie, v1)', 'RAR-b'][1 + p_partkey % 4] AS name FROM part",
)
def benchmark_aliases(spark: SparkSession, sf: str) -> DataFrame:
    from pairforge.functions.instructions import BENCHMARKS, alias

    known = spark.createDataFrame([(alias(b), b) for b in BENCHMARKS], "alias STRING, name STRING")
    asked = F.array(*[F.lit(a) for a in ("BEIR_NL", "MTEB_CODE_V1", "VN_MTEB_VIE_V1", "RAR_B")])
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.get(asked, (F.col("p_partkey") % 4).cast("int")).alias("alias"))
    return rows.join(F.broadcast(known), "alias").select("id", "alias", "name")  # a fixed table


@CORE.query(
    "synthetic_batch", "S23", "S24", "S25",
    oracle=f"""WITH b AS (SELECT b.range AS id, i.range AS i, 1 + CAST('0x' || substr({sql_key(7, 'batch', 'b.range', 'i.range')}, 1, 8) AS BIGINT) % 65528 AS t FROM range(64) b, range(1, 512) i)
    SELECT id, list_append(list(CAST(t AS INTEGER) ORDER BY i), 65535) AS ids, list_transform(range(512), lambda i: 1) AS mask FROM b GROUP BY id""",
)
def synthetic_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Token batches for benches: reproducible ids with an end, and an attention mask."""
    from pairforge.functions.rand import det_key, key_int

    one = lambda i: (1 + key_int(det_key(7, "batch", F.col("id"), i)) % 65528).cast("int")
    ids = F.array_append(F.transform(F.sequence(F.lit(1), F.lit(511)), one), 65535)
    return spark.range(64).select("id", ids.alias("ids"), F.array_repeat(F.lit(1), 512).alias("mask"))
