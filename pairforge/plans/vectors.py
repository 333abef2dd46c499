"""Vector scores, search, mining, losses and rank metrics over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import vectors as vx
from pairforge.functions.rand import sql_key
from pairforge.operators import evaluate, retrieval
from pairforge.registry import CORE, table

#: DuckDB: vectors in double precision, and distances of the stated queries (every id that 50 divides) to all others.
E = "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
DIST = E + """, d AS (SELECT q.id AS query_id, c.id AS id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.x[i] - c.x[i]) ** 2))) AS dist, q.label AS ql, c.label AS cl
  FROM e q JOIN e c ON q.id <> c.id WHERE q.id % 50 = 0
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(dist * 1e9), id) AS rank FROM d)"""


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf).filter("id % 50 = 0").withColumnRenamed("id", "query_id")


_TOP = DIST + " SELECT query_id, id, floor(dist * 1e6 + 0.5) / 1e6 AS dist, rank FROM k WHERE rank <= 10"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", vx.round6(F.col("dist"))).withColumn("rank", F.col("rank").cast("bigint"))


@CORE.query(
    "hard_negative_mine", "V08", "J06", "J07", "W04", "W05", "A13", "B23",
    oracle=DIST + f""", p AS (SELECT query_id, min(dist) AS closest FROM d WHERE ql = cl GROUP BY 1
    ), l AS (SELECT query_id, dist AS cut FROM k WHERE rank = 51
    ), bad AS (SELECT query_id FROM p JOIN l USING (query_id) WHERE floor(closest * 1e9) > floor(cut * 1e9)
    ), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {sql_key(22, 'mine', 'query_id', 'id')}, id) AS nth FROM k
      WHERE rank > 10 AND rank <= 60 AND ql <> cl AND query_id NOT IN (SELECT query_id FROM bad))
    SELECT query_id, id, floor(dist * 1e6 + 0.5) / 1e6 AS dist, rank FROM n WHERE nth <= 7""",
)
def hard_negative_mine(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(retrieval.mine(_queries(spark, sf), _corpus(spark, sf)))


@CORE.query("knn_exact_topk", "J06", "V05", "O10", oracle=_TOP)
def knn_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(retrieval.knn_exact(_queries(spark, sf), _corpus(spark, sf), 10))


@CORE.query("knn_ivf_full_probe", "V03", "V04", "F42", oracle=_TOP)
def knn_ivf_full_probe(spark: SparkSession, sf: str) -> DataFrame:
    index = retrieval.Ivf(_corpus(spark, sf))
    return _rounded(index.search(_queries(spark, sf), 10, probes=index.n_lists))


@CORE.query("knn_ivf_recall", "V04", "A15")
def knn_ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    corpus, queries = _corpus(spark, sf), _queries(spark, sf)
    index = retrieval.Ivf(corpus)
    found = index.search(queries, 10).select("query_id", "id", F.lit(1).alias("hit"))
    exact = retrieval.knn_exact(queries, corpus, 10).select("query_id", "id")
    return exact.join(found, ["query_id", "id"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@CORE.query(
    "cosine_scores", "F32", "F33", "V09",
    oracle=E + " SELECT a.id AS a, b.id AS b, floor(list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) * 1e6 + 0.5) / 1e6 AS score FROM e a JOIN e b ON b.id = a.id + 1",
)
def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    left, right = c.select(F.col("id").alias("a"), F.col("vector").alias("x")), c.select(F.col("id").alias("b"), (F.col("id") - 1).alias("a"), F.col("vector").alias("y"))
    return left.join(right, "a").select("a", "b", vx.round6(vx.cosine(F.col("x"), F.col("y"))).alias("score"))


@CORE.query("l2_normalise", "F30", oracle=E + " SELECT id, list_transform(x, lambda v: floor(v / sqrt(list_dot_product(x, x)) * 1e6 + 0.5) / 1e6) AS vector FROM e")
def l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf).select("id", F.transform(vx.l2_normalise(F.col("vector")), vx.round6).alias("vector"))


@CORE.query(
    "euclidean", "F31",
    oracle=E + " SELECT a.id AS a, floor(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.x[i] - b.x[i]) ** 2))) * 1e6 + 0.5) / 1e6 AS dist FROM e a JOIN e b ON b.id = a.id + 1",
)
def euclidean(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    right = c.select((F.col("id") - 1).alias("a"), F.col("vector").alias("y"))
    return c.select(F.col("id").alias("a"), F.col("vector").alias("x")).join(right, "a").select("a", vx.round6(vx.euclidean(F.col("x"), F.col("y"))).alias("dist"))


@CORE.query(
    "maxsim_late_interaction", "F34", "V10", "A19",
    oracle=E + """, m AS (SELECT id, list_transform(range(4), lambda i: x[CAST(i * 16 + 1 AS BIGINT) : CAST(i * 16 + 16 AS BIGINT)]) AS m FROM e)
    SELECT a.id AS query_id, b.id AS id, floor(list_sum(list_transform(a.m, lambda s: list_max(list_transform(b.m, lambda t: list_dot_product(s, t))))) * 1e6 + 0.5) / 1e6 AS score
    FROM m a JOIN m b ON b.id = a.id + 1""",
)
def maxsim_late_interaction(spark: SparkSession, sf: str) -> DataFrame:
    multi = _corpus(spark, sf).select("id", vx.split_vector(F.col("vector"), 4, 16).alias("m"))
    pairs = multi.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("id"))
    scored = retrieval.pair_scores(pairs, multi.select(F.col("id").alias("query_id"), F.col("m").alias("q")), multi.select("id", F.col("m").alias("d")), vx.max_sim)
    return scored.withColumn("score", vx.round6(F.col("score")))


@CORE.query(
    "block_pooling", "A19",
    oracle=E + """, m AS (SELECT id, list_transform(range(8), lambda i: x[CAST(i * 8 + 1 AS BIGINT) : CAST(i * 8 + 8 AS BIGINT)]) AS m FROM e
    ), f AS (SELECT id, list_concat([list_transform(range(8), lambda i: 0.0)], m) AS m FROM m)
    SELECT id, list_transform(range(3), lambda b: list_transform(range(1, 9), lambda i: floor((m[CAST(b * 3 + 1 AS BIGINT)][i] + m[CAST(b * 3 + 2 AS BIGINT)][i] + m[CAST(b * 3 + 3 AS BIGINT)][i]) / 3 * 1e6 + 0.5) / 1e6)) AS pooled FROM f""",
)
def block_pooling(spark: SparkSession, sf: str) -> DataFrame:
    pooled = vx.block_pool(vx.split_vector(F.col("vector"), 8, 8), 3)
    return _corpus(spark, sf).select("id", F.transform(pooled, lambda v: F.transform(v, vx.round6)).alias("pooled"))


@CORE.query(
    "masked_mean", "A16", "V23", "F64",
    oracle=E + """, m AS (SELECT id, list_transform(range(8), lambda i: x[CAST(i * 8 + 1 AS BIGINT) : CAST(i * 8 + 8 AS BIGINT)]) AS m, list_filter(range(8), lambda i: (id + i) % 3 = 0) AS own FROM e)
    SELECT id, list_transform(range(1, 9), lambda j: floor(list_sum(list_transform(own, lambda i: m[i + 1][j])) / len(own) * 1e6 + 0.5) / 1e6) AS pooled FROM m""",
)
def masked_mean(spark: SparkSession, sf: str) -> DataFrame:
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("id") + i) % 3 == 0)
    return _corpus(spark, sf).select("id", F.transform(vx.masked_mean(vx.split_vector(F.col("vector"), 8, 8), mask), vx.round6).alias("pooled"))


@CORE.query(
    "centroid_by_label", "A17", "A18",
    oracle=E + ", l AS (SELECT label, i, avg(x[i]) AS v FROM (SELECT label, x, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL) SELECT label, list(floor(v * 1e6 + 0.5) / 1e6 ORDER BY i) AS centroid FROM l GROUP BY 1",
)
def centroid_by_label(spark: SparkSession, sf: str) -> DataFrame:
    long = _corpus(spark, sf).select("label", F.posexplode("vector").alias("i", "v")).groupBy("label", "i").agg(vx.round6(F.avg(F.col("v").cast("double"))).alias("v"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


@CORE.query(
    "rerank_first_stage", "J14", "J16", "O11", "V19", "F35",
    oracle=DIST + """, s AS (SELECT query_id, k.id, list_dot_product(q.x[1:32], c.x[1:32]) AS score FROM k JOIN e q ON q.id = query_id JOIN e c ON c.id = k.id WHERE rank <= 100
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9) DESC, id) AS rank FROM s)
    SELECT query_id, id, rank, floor(1 / (1 + exp(-score)) * 1e6 + 0.5) / 1e6 AS score FROM r WHERE rank <= 20""",
)
def rerank_first_stage(spark: SparkSession, sf: str) -> DataFrame:
    corpus, queries = _corpus(spark, sf), _queries(spark, sf)
    first = retrieval.knn_exact(queries, corpus, 100).select("query_id", "id")
    half = lambda c: F.slice(c, 1, 32)
    scored = retrieval.pair_scores(first, queries.select("query_id", half(F.col("vector")).alias("q")), corpus.select("id", half(F.col("vector")).alias("d")), vx.dot)
    return retrieval.rerank(scored, 20).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), vx.round6(vx.sigmoid(F.col("score"))).alias("score"))


@CORE.query(
    "rank_metrics", "V35",
    oracle=DIST + """, w AS (SELECT query_id, count(*) AS n FROM d WHERE ql = cl GROUP BY 1
    ), g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first, count(*) AS hits FROM k WHERE rank <= 10 AND ql = cl GROUP BY 1
    ), m AS (SELECT coalesce(dcg / list_sum(list_transform(range(1, CAST(least(n, 10) + 1 AS BIGINT)), lambda i: 1 / log2(i + 1))), 0) AS ndcg, coalesce(1 / first, 0) AS mrr, coalesce(hits / n, 0) AS recall FROM w LEFT JOIN g USING (query_id))
    SELECT floor(avg(ndcg) * 1e6 + 0.5) / 1e6 AS ndcg, floor(avg(mrr) * 1e6 + 0.5) / 1e6 AS mrr, floor(avg(recall) * 1e6 + 0.5) / 1e6 AS recall FROM m""",
)
def rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    corpus, queries = _corpus(spark, sf), _queries(spark, sf)
    relevant = queries.select("query_id", "label").join(corpus.select("id", "label"), "label").filter("query_id <> id").select("query_id", "id")
    return evaluate.rank_metrics(retrieval.knn_exact(queries, corpus, 10), relevant)


BATCH = 32
_PAIRS = E + f""", r AS (SELECT a.id // 2 AS n, a.x AS q, b.x AS d, a.label AS source, 1.0 + a.label % 3 AS weight FROM e a JOIN e b ON b.id = a.id + 1 WHERE a.id % 2 = 0
  ), b AS (SELECT *, n // {BATCH} AS batch_id FROM r
  ), s AS (SELECT a.batch_id, a.n AS qi, c.n AS di, a.source AS qs, c.source AS ds, a.weight, list_dot_product(a.q, c.d) / 0.05 AS logit FROM b a JOIN b c USING (batch_id))"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    left = c.filter("id % 2 = 0").select(F.expr("id div 2").alias("i"), F.col("vector").alias("q"), F.col("label").alias("source"), (1.0 + F.col("label") % 3).alias("weight"))
    right = c.filter("id % 2 = 1").select(F.expr("id div 2").alias("i"), F.col("vector").alias("d"))
    return left.join(right, "i").withColumn("batch_id", F.expr(f"i div {BATCH}"))




@CORE.query(
    "infonce_symmetric", "V20", "J12", "J15",
    oracle=_PAIRS + """, l AS (SELECT batch_id, qi, di, logit, ln(sum(exp(logit - 20)) OVER (PARTITION BY batch_id, qi)) + 20 - logit AS a, ln(sum(exp(logit - 20)) OVER (PARTITION BY batch_id, di)) + 20 - logit AS b FROM s)
    SELECT batch_id, floor((avg(a) + avg(b)) / 2 * 1e6 + 0.5) / 1e6 AS loss FROM l WHERE qi = di GROUP BY 1""",
)
def infonce_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.info_nce(_pairs(spark, sf), 0.05)


@CORE.query(
    "infonce_source_masked", "V21", "J13",
    oracle=_PAIRS + """, l AS (SELECT batch_id, qi, di, weight, ln(sum(exp(logit - 20)) OVER (PARTITION BY batch_id, qi)) + 20 - logit AS a FROM s WHERE qs = ds)
    SELECT batch_id, floor(sum(a * weight) / sum(weight) * 1e6 + 0.5) / 1e6 AS loss FROM l WHERE qi = di GROUP BY 1""",
)
def infonce_source_masked(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.info_nce(_pairs(spark, sf), 0.05, mask_source=True)


@CORE.query(
    "bce_logits", "V22",
    oracle=_PAIRS + " SELECT batch_id, floor(avg(greatest(logit, 0) - logit * CASE WHEN qi = di THEN 1 ELSE 0 END + ln(1 + exp(-abs(logit)))) * 1e6 + 0.5) / 1e6 AS loss FROM s GROUP BY 1",
)
def bce_logits(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf)
    pairs = p.select("batch_id", F.col("i").alias("qi"), "q").join(p.select("batch_id", F.col("i").alias("di"), "d"), "batch_id")
    logit, target = vx.dot(F.col("q"), F.col("d")) / 0.05, (F.col("qi") == F.col("di")).cast("int")
    return pairs.groupBy("batch_id").agg(vx.round6(F.avg(evaluate.bce_with_logits(logit, target))).alias("loss"))


@CORE.query(
    "topk_topp_filter", "O16",
    oracle=E + """, l AS (SELECT id AS dist_id, i AS token, x[i + 1] AS logit FROM (SELECT *, unnest(range(64)) AS i FROM e)
    ), s AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY dist_id) AS prob, row_number() OVER (PARTITION BY dist_id ORDER BY logit DESC, token) AS nth FROM l
    ), h AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY dist_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE nth <= 20)
    SELECT dist_id, CAST(token AS INTEGER) AS token, floor(prob * 1e6 + 0.5) / 1e6 AS prob FROM h WHERE round(before, 9) < 0.3""",
)
def topk_topp_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _corpus(spark, sf).select(F.col("id").alias("dist_id"), F.posexplode("vector").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))
    return evaluate.top_k_top_p(rows, 20, 0.3).withColumn("prob", vx.round6(F.col("prob")))


@CORE.query("argmax_decode", "O17", oracle=E + " SELECT id AS dist_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS token FROM e")
def argmax_decode(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.argmax(_corpus(spark, sf).select(F.col("id").alias("dist_id"), F.posexplode("vector").alias("token", "logit")))


@CORE.query("encode_documents", "V01", "V02", "V13", "V15")
def encode_documents(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.encode(table(spark, sf, "documents"), "doc_id", "text", prefix="Instruct: Represent the text\nQuery: ")


@CORE.query("fold_states", "V16", "C09")
def fold_states(spark: SparkSession, sf: str) -> DataFrame:
    from pairforge.functions import tokens as tk

    def step(state, token):
        state = state * 0.9
        state[token % 8] += 1.0
        return state

    return retrieval.fold_states(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tk.byte_ids(F.col("text")).alias("ids")), step, 8)


@CORE.query(
    "state_cross_features",
    oracle=E + """ SELECT a.id AS query_id, b.id AS id, flatten(list_transform(range(4), lambda s: list_transform(range(4), lambda t:
      floor(list_sum(list_transform(range(4), lambda h: list_dot_product(a.x[CAST(h * 16 + s * 4 + 1 AS BIGINT) : CAST(h * 16 + s * 4 + 4 AS BIGINT)], b.x[CAST(h * 16 + t * 4 + 1 AS BIGINT) : CAST(h * 16 + t * 4 + 4 AS BIGINT)]))) * 1e6 + 0.5) / 1e6))) AS features
    FROM e a JOIN e b ON b.id = a.id + 1""",
)
def state_cross_features(spark: SparkSession, sf: str) -> DataFrame:
    states = _corpus(spark, sf).select("id", "vector")
    pairs = states.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("id"))
    score = lambda q, d: F.transform(retrieval.cross_features(q, d, 4), vx.round6)
    return retrieval.pair_scores(pairs, states.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), states.select("id", F.col("vector").alias("d")), score).withColumnRenamed("score", "features")


@CORE.query(
    "text_vector_lookup", "J05",
    oracle="""WITH t AS (SELECT CASE side WHEN 'query' THEN query WHEN 'pos' THEN pos[item_no + 1] ELSE neg[item_no + 1] END AS text, vec_id FROM text_vectors JOIN normalised USING (rec_id)
    ), v AS (SELECT text, min(vec_id) AS vec_id FROM t WHERE text IS NOT NULL GROUP BY 1
    ), p AS (SELECT rec_id, i - 1 AS pos_no, pos[i] AS text FROM (SELECT rec_id, pos, unnest(range(1, len(pos) + 1)) AS i FROM normalised))
    SELECT rec_id, pos_no, vec_id FROM p JOIN v USING (text)""",
)
def text_vector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of positives by their text; texts are joined by digests, whatever their length."""
    records = table(spark, sf, "normalised")
    at = F.col("item_no").cast("int")
    own = F.when(F.col("side") == "query", F.col("query")).when(F.col("side") == "pos", F.get("pos", at)).otherwise(F.get("neg", at))
    known = table(spark, sf, "text_vectors").join(records, "rec_id").select(F.md5(own).alias("key"), "vec_id").filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("vec_id"))
    asked = records.select("rec_id", F.posexplode("pos").alias("pos_no", "text")).select("rec_id", F.col("pos_no").cast("bigint").alias("pos_no"), F.md5("text").alias("key"))
    return asked.join(known, "key").select("rec_id", "pos_no", "vec_id")
