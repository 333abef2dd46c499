"""Model arithmetic as queries: the recurrence, the ranking head over states, pair scoring, parameter tables on disk, training rules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import vectors as vx
from pairforge.operators import params, retrieval
from pairforge.plans.evaluate import PARAMS, _params
from pairforge.plans.vectors import E, _corpus
from pairforge.registry import CORE, table
from pairforge.session import work_dir

#: Steps of the recurrence, each of 6 vectors of 2 numbers, from 60 of a vector's 64.
_STEPS = 5
_AT = lambda j, i: f"x[(t - 1) * 12 + {2 * j + i + 1}]"
_SA = [f"(s[{2 * i + 1}] * {_AT(4, 0)} + s[{2 * i + 2}] * {_AT(4, 1)})" for i in range(2)]
_NEXT = ", ".join(f"s[{2 * i + j + 1}] * exp(-exp({_AT(1, j)})) + {_SA[i]} * {_AT(5, j)} + {_AT(3, i)} * {_AT(2, j)}" for i in range(2) for j in range(2))


def _sql_recur() -> str:
    """The recurrence unrolled: each step a subquery over the one before."""
    rows = "SELECT id, x, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS s, CAST([] AS DOUBLE[]) AS y FROM e"
    for t in range(1, _STEPS + 1):
        fixed = lambda text: text.replace("(t - 1) * 12 + ", f"{(t - 1) * 12} + ")  # noqa: B023, E731
        out = ", ".join(f"s[{2 * i + 1}] * {fixed(_AT(0, 0))} + s[{2 * i + 2}] * {fixed(_AT(0, 1))}" for i in range(2))
        rows = f"SELECT id, x, s, list_concat(y, [{out}]) AS y FROM (SELECT id, x, y, [{fixed(_NEXT)}] AS s FROM ({rows}))"
    r6 = "lambda v: floor(v * 1e6 + 0.5) / 1e6"
    return E + f" SELECT id, list_transform(y, {r6}) AS outputs, list_transform(s, {r6}) AS state FROM ({rows})"


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.transform(F.sequence(F.lit(0), F.lit(_STEPS - 1)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.slice("vector", t * 12 + j * 2 + 1, 2)))
    return _corpus(spark, sf).select("id", F.transform(cut, F.flatten).alias("steps"))


@CORE.query("state_recurrence", "V26", "V16", "A18", oracle=_sql_recur())
def state_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    """The sequence in two pieces, the second with the state of the first; the twin takes it whole."""
    steps = _steps(spark, sf)
    none = F.lit(None).cast("array<double>")
    first = retrieval.recur(steps.select("id", F.slice("steps", 1, 3).alias("steps"), none.alias("state")), 2)
    rest = steps.select("id", F.slice("steps", 4, _STEPS).alias("steps")).join(first.select("id", "state"), "id")
    second = retrieval.recur(rest, 2).withColumnRenamed("outputs", "more")
    both = first.select("id", "outputs").join(second, "id")
    return both.select("id", F.transform(F.concat("outputs", "more"), vx.round6).alias("outputs"), F.transform("state", vx.round6).alias("state"))


#: Weights of a ranking head over 4 x 4 cross features, by a formula both engines know.
_HIDDEN = np.array([[math.sin(i * 16 + j + 1) for j in range(16)] for i in range(8)])
_OUT = np.array([math.cos(i + 1) for i in range(8)])


@CORE.query(
    "rank_by_states", "V11", "V12", "V17", "J14", "J16", "O11", "F35",
    oracle=E + """, f AS (SELECT a.id AS query_id, b.id AS id, flatten(list_transform(range(4), lambda s: list_transform(range(4), lambda t:
      list_sum(list_transform(range(4), lambda h: list_dot_product(a.x[CAST(h * 16 + s * 4 + 1 AS BIGINT) : CAST(h * 16 + s * 4 + 4 AS BIGINT)], b.x[CAST(h * 16 + t * 4 + 1 AS BIGINT) : CAST(h * 16 + t * 4 + 4 AS BIGINT)])))))) AS f
      FROM e a JOIN e b ON b.id - a.id BETWEEN 1 AND 8 WHERE a.id % 50 = 0
    ), m AS (SELECT *, list_avg(f) AS mean FROM f), v AS (SELECT *, sqrt(list_avg(list_transform(f, lambda v: (v - mean) ** 2)) + 1e-5) AS sd FROM m
    ), n AS (SELECT query_id, id, list_transform(f, lambda v: (v - mean) / sd) AS n FROM v
    ), s AS (SELECT query_id, id, list_sum(list_transform(range(8), lambda i: cos(i + 1) * greatest(0.0, list_sum(list_transform(range(16), lambda j: n[j + 1] * sin(i * 16 + j + 1)))))) AS score FROM n
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9) DESC, id) AS rank FROM s)
    SELECT query_id, id, rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM r WHERE rank <= 3""",
)
def rank_by_states(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each query scored by the head over the cross features of two states, the best three kept."""
    states = _corpus(spark, sf).select("id", "vector")
    pairs = states.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i")).select("query_id", (F.col("query_id") + F.col("i")).alias("id"))
    features = retrieval.pair_scores(pairs, states.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), states.select("id", F.col("vector").alias("d")), lambda q, d: retrieval.cross_features(q, d, 4))
    scored = retrieval.score_features(features.withColumnRenamed("score", "features"), _HIDDEN, _OUT, np.ones(16), np.zeros(16))
    return retrieval.rerank(scored, 3).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), vx.round6(F.col("score")).alias("score"))


def _heads() -> dict:
    """Heads of three tasks over 8 numbers, by a formula both engines know."""
    w1 = lambda t: np.array([[math.sin(t * 32 + i * 8 + j + 1) for j in range(8)] for i in range(4)])
    w2 = lambda t: np.array([[math.cos(t * 32 + i * 4 + j + 1) for j in range(4)] for i in range(8)])
    return {t: (w1(t), w2(t), np.ones(8), np.zeros(8)) for t in range(3)}


_NORMED = "list_transform({h}, lambda v: floor((v - list_avg({h})) / sqrt(list_avg(list_transform({h}, lambda u: (u - list_avg({h})) ** 2)) + 1e-5) * 1e6 + 0.5) / 1e6)"


@CORE.query(
    "task_gated_head", "V24",
    oracle=E + """, r AS (SELECT id, label % 4 AS t, x[1:8] AS x FROM e
    ), a AS (SELECT *, list_transform(range(4), lambda i: greatest(0.0, list_sum(list_transform(range(8), lambda j: x[j + 1] * sin(t * 32 + i * 8 + j + 1))))) AS a FROM r
    ), h AS (SELECT *, list_transform(range(8), lambda i: x[i + 1] + list_sum(list_transform(range(4), lambda j: a[j + 1] * cos(t * 32 + i * 4 + j + 1)))) AS h FROM a)
    SELECT id, CASE WHEN t < 3 THEN """ + _NORMED.format(h="h") + """ ELSE list_transform(range(8), lambda i: 0.0::DOUBLE) END AS vector FROM h""",
)
def task_gated_head(spark: SparkSession, sf: str) -> DataFrame:
    rows = _corpus(spark, sf).select("id", (F.col("label") % 4).alias("task_id"), F.slice("vector", 1, 8).alias("vector"))
    return retrieval.task_heads(rows, _heads()).select("id", F.transform("vector", vx.round6).alias("vector"))


@CORE.query(
    "image_features", "V25",
    oracle=E + """, c AS (SELECT id, cell, list_transform(range(1, 5), lambda d: (x[(cell // 2 * 8 + cell % 2 * 2) * 4 + d] + x[(cell // 2 * 8 + cell % 2 * 2 + 1) * 4 + d] + x[(cell // 2 * 8 + cell % 2 * 2 + 4) * 4 + d] + x[(cell // 2 * 8 + cell % 2 * 2 + 5) * 4 + d]) / 4) AS c
      FROM (SELECT *, unnest(range(4)) AS cell FROM e)
    ), g AS (SELECT id, cell, list_transform(range(4), lambda i: c[i + 1] / (1 + exp(-list_sum(list_transform(range(4), lambda j: c[j + 1] * sin(i * 4 + j + 1)))))) AS g FROM c
    ), h AS (SELECT id, cell, list_transform(range(3), lambda i: list_sum(list_transform(range(4), lambda j: g[j + 1] * cos(i * 4 + j + 1)))) AS h FROM g
    ), n AS (SELECT id, cell, """ + _NORMED.format(h="h") + """ AS n FROM h)
    SELECT id, flatten(list(n ORDER BY cell)) AS vector FROM n GROUP BY id""",
)
def image_features(spark: SparkSession, sf: str) -> DataFrame:
    """A vector as a grid of 4 x 4 patches of 4 numbers, pooled to 2 x 2 cells, gated and projected to 3 numbers each."""
    gate = np.array([[math.sin(i * 4 + j + 1) for j in range(4)] for i in range(4)])
    out = np.array([[math.cos(i * 4 + j + 1) for j in range(4)] for i in range(3)])
    rows = _corpus(spark, sf).select("id", F.col("vector").alias("patches"))
    return retrieval.pool_patches(rows, 4, 2, gate, out, np.ones(3), np.zeros(3)).select("id", F.transform("vector", vx.round6).alias("vector"))


@CORE.query(
    "predict_pairs", "V14", "F62",
    oracle="""WITH p AS (SELECT rec_id, i - 1 AS pos_no, query, pos[i] AS text FROM (SELECT *, unnest(range(1, len(pos) + 1)) AS i FROM normalised)
    ), w AS (SELECT *, list_distinct(list_filter(string_split(query, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS b FROM p)
    SELECT rec_id, pos_no, floor(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END * 1e6 + 0.5) / 1e6 AS score FROM w""",
)
def predict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalised").select("rec_id", "query", F.posexplode("pos").alias("pos_no", "text"))
    scored = retrieval.predict_pairs(rows)
    return scored.select("rec_id", F.col("pos_no").cast("bigint").alias("pos_no"), vx.round6(F.col("score")).alias("score"))


@CORE.query("ckpt_files", "K11", "S16", "A17", oracle=PARAMS + " SELECT ckpt, key, vals[1] AS first FROM params")
def ckpt_files(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoints written to a folder and all of them scanned again."""
    path, rows = work_dir(spark), _params(spark)
    for c in ("c0", "c1", "c2"):
        params.write_params(rows.filter(F.col("ckpt") == c), path, c)
    return params.read_params(spark, path).select("ckpt", "key", F.get("vals", F.lit(0)).alias("first"))


@CORE.query("nested_by_default", "F70", oracle=PARAMS + " SELECT ckpt, key, 'inner' AS found FROM params UNION ALL SELECT ckpt, key, 'plain' FROM params")
def nested_by_default(spark: SparkSession, sf: str) -> DataFrame:
    """The usual outer names are found without being told, in their order; without any, all keys stay."""
    inner = _params(spark).withColumn("key", F.concat(F.lit("state_dict."), "key")).unionByName(_params(spark).limit(1).withColumn("key", F.lit("params.x")))
    plain = _params(spark).withColumn("key", F.regexp_replace("key", "^model", "m0del"))
    out = params.nested(inner).withColumn("found", F.lit("inner")).unionByName(params.nested(plain).withColumn("key", F.regexp_replace("key", "^m0del", "model")).withColumn("found", F.lit("plain")))
    return out.select("ckpt", "key", "found")


_FROZEN = "regexp_extract(key, '^model\\.core\\.blocks\\.(\\d+)\\.', 1)"


@CORE.query("freeze_masks", "V32", oracle=PARAMS + f" SELECT ckpt, key, NOT (CASE WHEN {_FROZEN} = '' THEN false ELSE CAST({_FROZEN} AS INTEGER) < 2 END) AS some, NOT starts_with(key, 'model.core.') AS whole FROM params")
def freeze_masks(spark: SparkSession, sf: str) -> DataFrame:
    some = params.freeze(_params(spark), 2, 4, core="model.core").withColumnRenamed("trainable", "some")
    return params.freeze(some, 4, 4, core="model.core").select("ckpt", "key", "some", F.col("trainable").alias("whole"))


@CORE.query(
    "optimizer_groups", "V31", "F38",
    oracle=PARAMS + f""", g AS (SELECT CASE WHEN key = 'head.w' THEN 0.0 ELSE 0.01 END AS weight_decay, CASE WHEN {_FROZEN} = '' THEN 0.001 ELSE 0.001 * pow(0.5, 3 - CAST({_FROZEN} AS INTEGER)) END AS rate FROM params
      WHERE ckpt = 'c0' AND NOT (CASE WHEN {_FROZEN} = '' THEN false ELSE CAST({_FROZEN} AS INTEGER) < 1 END))
    SELECT weight_decay::DOUBLE AS weight_decay, rate, count(*) AS tensors, count(*) * 8 AS numbers FROM g GROUP BY 1, 2""",
)
def optimizer_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Trainable tensors by decay and layer-wise rate; the head is a vector and does not decay."""
    rows = _params(spark).filter("ckpt = 'c0'").withColumn("shape", F.when(F.col("key") == "head.w", F.array(F.lit(8), F.lit(1))).otherwise(F.col("shape")))
    rows = params.freeze(rows, 1, 4, core="model.core")
    block = F.nullif(F.regexp_extract("key", r"^model\.core\.blocks\.(\d+)\.", 1), F.lit("")).cast("int")
    rates = rows.select("key", (0.001 * F.pow(F.lit(0.5), 3 - block)).alias("rate")).filter("rate IS NOT NULL")
    return params.optimizer_groups(rows, 0.01, 0.001, rates)


@CORE.query(
    "save_rule", "V33",
    oracle="SELECT range AS epoch, range = 19 OR (range % 5 = 0 AND range > 0) AS every_five, true AS each, range = 19 AS last FROM range(20)",
)
def save_rule(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("id")
    return spark.range(20).select(e.alias("epoch"), params.saves(e, 5, 20).alias("every_five"), params.saves(e, 1, 20).alias("each"), params.saves(e, 0, 20).alias("last"))
