"""The pN_ queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import bpe, copies, leaks, mixing, neighbours, packing, pairs, splitting
from pairforge.registry import Registry, table

LLM = Registry()

#: Stripping as in copies.stripped, for RE2.
_STRIP = r"replace(replace(lower(regexp_replace({}, '[\x09-\x0d\x1c-\x20\x{{85}}\pZ\x{{180e}}\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}\pP]+', '', 'g')), 'ß', 'ss'), 'ς', 'σ')"
_KEYS = f"""
WITH stripped AS (
  SELECT rec_id, {_STRIP.format("query")} AS q,
         list_filter(list_transform(pos, lambda x: {_STRIP.format("x")}), lambda x: x IS NOT NULL AND x <> '') AS p
  FROM normalised
), keys AS (
  SELECT rec_id, CASE WHEN q <> '' AND len(p) > 0 THEN list_sort(list_concat([q], p)) END AS k FROM stripped
)"""


@LLM.query(
    "p1_found",
    oracle=f"""{_KEYS}, firsts AS (SELECT k, min(rec_id) AS rec_a FROM keys WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)
SELECT rec_a, rec_id AS rec_b FROM keys JOIN firsts USING (k) WHERE rec_id <> rec_a""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.find_copies(table(spark, sf_dir, "normalised"))


@LLM.query(
    "p1_collapsed",
    oracle=f"""{_KEYS}
SELECT min(rec_id) AS rec_id, count(*) AS n_copies FROM keys WHERE k IS NOT NULL GROUP BY k
UNION ALL SELECT rec_id, 1 AS n_copies FROM keys WHERE k IS NULL""",
)
def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapse(table(spark, sf_dir, "normalised"))


#: The plan of the mix in closed form: sources by limit / weight; those that the water level passes are clamped.
_QUOTAS = """
WITH conf AS (
  SELECT trim(file) AS source,
         max(CASE WHEN NOT isnan(dataset_share) AND dataset_share >= 0 THEN dataset_share END) AS share,
         max(least(1.0, greatest(0.0, coalesce(CASE WHEN isnan(sample_ratio) THEN 0.0 ELSE sample_ratio END, 0.0)))
             * greatest(0, coalesce(total_lines, 0))) AS upstream,
         max(greatest(0, coalesce(max_repeats, 1))) AS max_repeats
  FROM sampling_config WHERE coalesce(trim(file), '') <> '' GROUP BY 1
), avail AS (SELECT trim(source) AS source, count(*) AS available FROM normalised GROUP BY 1
), shares AS (
  SELECT source, max_repeats, coalesce(available, 0) AS available, coalesce(share, upstream / (SELECT sum(upstream) FROM conf)) AS share
  FROM conf LEFT JOIN avail USING (source)
), base AS (
  SELECT source, max_repeats, available, share / sum(share) OVER () AS weight, available * max_repeats AS cap,
         sum(available) OVER () AS wanted
  FROM shares
), live AS (
  SELECT *, least(wanted, sum(cap) OVER ()) AS size,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on
  FROM base WHERE weight > 0 AND cap > 0
), flagged AS (SELECT *, (size - cap_before) * weight / weight_on >= cap AS clamped FROM live
), amounts AS (
  SELECT *, CASE WHEN clamped THEN cap ELSE (size - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) * weight / sum(weight) FILTER (NOT clamped) OVER () END AS amount
  FROM flagged
), whole AS (
  SELECT *, CAST(floor(amount) AS BIGINT) AS lo, row_number() OVER (ORDER BY amount - floor(amount) DESC, source) AS pos,
         size - sum(floor(amount)) OVER () AS rest
  FROM amounts
), quotas AS (SELECT source, available, lo + CASE WHEN pos <= rest THEN 1 ELSE 0 END AS n FROM whole
), ranked AS (
  SELECT rec_id, q.source, q.n // q.available AS reps, q.n % q.available AS part,
         row_number() OVER (PARTITION BY q.source ORDER BY md5(concat_ws('|', '22', 'mix', CAST(rec_id AS VARCHAR))), rec_id) AS rk
  FROM normalised r JOIN quotas q ON trim(r.source) = q.source
), mixed AS (
  SELECT rec_id, source, unnest(range(1, CAST(reps + CASE WHEN rk <= part THEN 1 ELSE 0 END + 1 AS BIGINT))) AS repeat_no FROM ranked
)"""


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[mixing.Quota]]:
    records = table(spark, sf_dir, "normalised")
    quotas = mixing.plan_mix(records, table(spark, sf_dir, "sampling_config"))
    return mixing.mix(records, quotas), quotas


@LLM.query("p4_mix", oracle=f"{_QUOTAS} SELECT rec_id, source, CAST(repeat_no AS INTEGER) AS repeat_no FROM mixed")
def p4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


@LLM.query(
    "p4_report",
    oracle=f"""{_QUOTAS}, got AS (
  SELECT source, count(*) AS n_mixed, count(*) FILTER (repeat_no = 1) AS n_distinct, CAST(max(repeat_no) AS INTEGER) AS most_repeats FROM mixed GROUP BY 1)
SELECT source, floor(weight * 1e6 + 0.5) / 1e6 AS target_share, available, max_repeats, coalesce(n_mixed, 0) AS n_mixed,
       coalesce(n_distinct, 0) AS n_distinct, coalesce(most_repeats, 0) AS most_repeats,
       floor(coalesce(n_mixed, 0) / (SELECT sum(n_mixed) FROM got) * 1e6 + 0.5) / 1e6 AS actual_share
FROM base LEFT JOIN got USING (source)""",
)
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(*_mix(spark, sf_dir))


@LLM.query("p5_packed")
def p5_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.items_of(table(spark, sf_dir, "normalised")))
    return packed.withColumnRenamed("id", "rec_id")


@LLM.query("p5_report")
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(packing.pack(packing.items_of(table(spark, sf_dir, "normalised"))))


@LLM.query(
    "p5_invariants",
    oracle="""WITH i AS (SELECT coalesce(source, '') AS source, coalesce(list_sum(list_transform(pos, lambda x: coalesce(length(x), 0))), 0) AS n FROM normalised)
    SELECT source, count(*) AS items, CAST(sum(greatest(1, ceil(n / 2048))) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS chars, 0 AS over_full, 0 AS cut_short, true AS tight FROM i GROUP BY 1""",
)
def p5_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the packing: nothing lost or doubled, no container over its room, no item cut that fits; at most 11 / 9 of the least number of containers and one more."""
    packed = packing.pack(packing.items_of(table(spark, sf_dir, "normalised")))
    items = packed.groupBy("source", "id").agg(F.count(F.lit(1)).alias("k"), F.sum("length").alias("n")).groupBy("source").agg(
        F.count(F.lit(1)).alias("items"), F.sum("k").alias("pieces"), F.sum("n").alias("chars"), F.count_if((F.col("k") > 1) & (F.col("n") <= packing.CAPACITY)).cast("int").alias("cut_short")
    )
    used = packed.groupBy("source", "container").agg(F.sum("length").alias("used")).groupBy("source").agg(
        F.count(F.lit(1)).alias("containers"), F.count_if(F.col("used") > packing.CAPACITY).cast("int").alias("over_full")
    )
    tight = F.col("containers") <= F.ceil(F.col("chars") / packing.CAPACITY) * 11 / 9 + 1
    return items.join(used, "source").select("source", "items", "pieces", "chars", "over_full", "cut_short", tight.alias("tight"))


_LEAKS = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w, regexp_replace(lower(text), '[^\pL\pN]+', '', 'g') AS c FROM documents
), icut AS (
  SELECT item_id, lower(coalesce(lang, '')) = 'zh' AS zh, regexp_extract_all(lower(text), '[\pL\pN]+') AS w,
         regexp_replace(lower(text), '[^\pL\pN]+', '', 'g') AS c FROM eval_items
), iw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM icut WHERE NOT zh)
), ic AS (SELECT DISTINCT item_id, substr(c, i, 24) AS g FROM (SELECT item_id, c, unnest(range(1, len(c) - 22)) AS i FROM icut WHERE zh)
), dw AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM cut)
), dc AS (SELECT doc_id, substr(c, i, 24) AS g FROM (SELECT doc_id, c, unnest(range(1, len(c) - 22)) AS i FROM cut)
), found AS (
  SELECT DISTINCT doc_id, item_id FROM iw JOIN dw USING (g)
  UNION SELECT DISTINCT doc_id, item_id FROM ic JOIN dc USING (g)
)"""


@LLM.query("p7_found", oracle=f"{_LEAKS} SELECT doc_id, item_id FROM found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@LLM.query("p7_matches")
def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@LLM.query("p7_clean", oracle=f"{_LEAKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)")
def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return leaks.remove_leaked(documents, leaks.find_matches(documents, table(spark, sf_dir, "eval_items"))).select("doc_id")


@LLM.query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


@LLM.query("p8_pieces")
def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf_dir, "documents"))


@LLM.query("p8_invariants", oracle="SELECT 0 AS too_long, 0 AS wrong_overlap, 0 AS not_from_start, 0 AS not_to_end, 0 AS elsewhere")
def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pieces: none over the limit, neighbours share 64 to 67 tokens, a text's pieces cover it, and each is a part of it."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"))
    pieces = splitting.split_documents(table(spark, sf_dir, "documents")).join(documents, "doc_id")
    by = "OVER (PARTITION BY doc_id ORDER BY piece_no)"
    pieces = pieces.withColumn("shared", F.expr(f"lag(token_end) {by} - token_start")).withColumn("is_last", F.expr(f"lead(piece_no) {by} IS NULL"))
    bad = lambda c: F.count_if(c).cast("int")
    return pieces.agg(
        bad((F.col("n_tokens") > splitting.LIMIT) | (F.col("n_tokens") != F.col("token_end") - F.col("token_start"))).alias("too_long"),
        bad((F.col("piece_no") > 0) & ~F.col("shared").between(splitting.OVERLAP, splitting.OVERLAP + 3)).alias("wrong_overlap"),
        bad((F.col("piece_no") == 0) & ((F.col("token_start") != 0) | ~F.startswith("whole", "text"))).alias("not_from_start"),
        bad(F.col("is_last") & ~F.endswith("whole", "text")).alias("not_to_end"),
        bad(F.instr("whole", F.col("text")) == 0).alias("elsewhere"),
    )


@LLM.query(
    "p3_found",
    oracle="""
WITH v AS (
  SELECT vec_id, CAST(vector AS DOUBLE[]) AS x FROM text_vectors
  WHERE vector IS NOT NULL AND len(list_filter(vector, lambda a: a <> 0)) > 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.x, b.x), 9) DESC, b.vec_id) AS nth
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM s WHERE nth <= 5""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_pairs(table(spark, sf_dir, "text_vectors"))


@LLM.query(
    "p3_search",
    oracle="""
WITH v AS (
  SELECT vec_id, CAST(vector AS DOUBLE[]) AS x FROM text_vectors
  WHERE vector IS NOT NULL AND len(list_filter(vector, lambda a: a <> 0)) > 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS nbr, round(list_cosine_similarity(a.x, b.x), 9) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT query_id, nbr, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, nbr) AS rank FROM s)
SELECT query_id, nbr, floor(sim * 1e6 + 0.5) / 1e6 AS sim, rank FROM r WHERE rank <= 5""",
)
def p3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "text_vectors")
    graph = neighbours.build_graph(vectors)
    if graph is None:
        return spark.createDataFrame([], "query_id BIGINT, nbr BIGINT, sim DOUBLE, rank BIGINT")
    found = neighbours.search_members(graph, graph.all_members().filter("id % 50 = 0"))
    return found.select("query_id", "nbr", (F.floor(F.col("sim") * 1e6 + 0.5) / 1e6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@LLM.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_defects(table(spark, sf_dir, "normalised"), table(spark, sf_dir, "source_tasks"))
