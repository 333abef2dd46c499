"""Scans, normalising, filters, lookups, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import text
from pairforge.operators import enrich, normalise as nz
from pairforge.registry import CORE, table

#: DuckDB: the raw lines with their JSON value (null if blank or malformed).
RAW = """
WITH raw AS (
  SELECT file, line_no, raw_line, loaded_at, CASE WHEN json_valid(trim(raw_line)) THEN CAST(trim(raw_line) AS JSON) END AS v FROM raw_records
), t AS (
  SELECT *, json_type(v) AS kind, json_type(v, '$.pos') AS tp, json_type(v, '$.neg') AS tn, json_type(v, '$.set') AS ts, json_type(v, '$.query') AS tq,
         CAST(json_extract_string(v, '$[*]') AS VARCHAR[]) AS items, CAST(json_extract(v, '$[*]') AS JSON[]) AS jitems
  FROM raw
), r AS (
  SELECT *, CASE
    WHEN kind = 'ARRAY' AND len(items) IN (2, 3) THEN struct_pack(query := items[1], pos := list_filter([items[2]], lambda x: x IS NOT NULL),
         neg := list_filter(items[3:3], lambda x: x IS NOT NULL))
    WHEN kind = 'OBJECT' AND tq IS NOT NULL THEN struct_pack(query := json_extract_string(v, '$.query'),
      pos := CASE tp WHEN 'ARRAY' THEN list_filter(CAST(json_extract_string(v, '$.pos[*]') AS VARCHAR[]), lambda x: x IS NOT NULL)
                     WHEN 'VARCHAR' THEN [json_extract_string(v, '$.pos')] ELSE CAST([] AS VARCHAR[]) END,
      neg := CASE tn WHEN 'ARRAY' THEN list_filter(CAST(json_extract_string(v, '$.neg[*]') AS VARCHAR[]), lambda x: x IS NOT NULL)
                     WHEN 'VARCHAR' THEN [json_extract_string(v, '$.neg')] ELSE CAST([] AS VARCHAR[]) END)
    WHEN kind = 'OBJECT' AND ts = 'ARRAY' THEN struct_pack(
      query := list_transform(list_filter(json_extract(v, '$.set[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$')[1],
      pos := list_transform(list_filter(json_extract(v, '$.set[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$')[2:],
      neg := CAST([] AS VARCHAR[]))
    END AS rec
  FROM t
)"""

_PART = """CASE json_type(v, '$.{k}') WHEN 'VARCHAR' THEN [json_extract_string(v, '$.{k}')]
           WHEN 'ARRAY' THEN list_transform(list_filter(json_extract(v, '$.{k}[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') ELSE CAST([] AS VARCHAR[]) END"""

#: Sources of the curated list, and those of it whose positives are expanded.
ALLOWED = ["quillmoor_answers.jsonl.gz", "duskfield_forum.jsonl.gz", "glasswharf_qa_zh.jsonl.gz", "saltmarsh_questions.jsonl.gz", "cinderbank_faq.jsonl.gz", "hollowpine_paraphrase.jsonl.gz"]
EXPANDED = ["hollowpine_paraphrase.jsonl.gz", "quillmoor_answers.jsonl.gz"]
_IN = ", ".join(f"'{s}'" for s in ALLOWED)


@CORE.query(
    "normalise_shapes", "P01", "P09", "P10", "F20", "F21", "F23", "F24", "S01",
    oracle=RAW + "SELECT line_no, loaded_at, rec.query AS query, rec.pos AS pos, rec.neg AS neg, file AS source FROM r WHERE rec.query <> '' AND len(rec.pos) > 0",
)
def normalise_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return nz.normalise(table(spark, sf, "raw_records"))


@CORE.query(
    "detect_shape_types", "P03", "U07",
    oracle=RAW + """SELECT file, CASE WHEN kind = 'ARRAY' AND len(items) = 3 THEN 'Triplets' WHEN kind = 'ARRAY' AND len(items) = 2 THEN 'Pairs'
      WHEN tq IS NOT NULL AND tp = 'ARRAY' AND tn = 'ARRAY' THEN 'Query-Triplets' WHEN ts IS NOT NULL THEN 'Sets'
      WHEN tq IS NOT NULL AND tp IS NOT NULL THEN 'Query-Pairs' END AS shape, count(*) AS n FROM t GROUP BY ALL""",
)
def detect_shape_types(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "raw_records")
    return raw.groupBy("file", nz.shape_of(nz.parsed(F.col("raw_line"))).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@CORE.query(
    "files_only_triplets", "P04",
    oracle=RAW + """, n AS (
      SELECT file, (kind = 'ARRAY' AND len(items) = 3) OR (tq IS NOT NULL AND tp = 'ARRAY' AND tn = 'ARRAY') AS good,
             row_number() OVER (PARTITION BY file ORDER BY line_no, raw_line) AS nth FROM t WHERE trim(raw_line) <> '')
    SELECT file, coalesce(bool_and(coalesce(good, false)) FILTER (nth <= 1000), false) AS only_triplets FROM n GROUP BY file
    UNION SELECT DISTINCT file, false FROM raw_records WHERE file NOT IN (SELECT file FROM n)""",
)
def files_only_triplets(spark: SparkSession, sf: str) -> DataFrame:
    return nz.only_triplets(table(spark, sf, "raw_records"))


@CORE.query(
    "extract_all_texts", "P02",
    oracle=RAW + """, x AS (
      SELECT file, line_no, CASE kind WHEN 'VARCHAR' THEN [v ->> '$'] WHEN 'ARRAY' THEN list_transform(list_filter(jitems, lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$')
        WHEN 'OBJECT' THEN list_concat(""" + ", ".join(_PART.replace("{k}", k) for k in ("query", "pos", "neg", "set")) + """) END AS texts FROM t)
    SELECT file, line_no, unnest(texts) AS text FROM x""",
)
def extract_all_texts(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "raw_records")
    return raw.select("file", "line_no", F.explode(nz.all_texts(nz.parsed(F.col("raw_line")))).alias("text"))


@CORE.query("quarantine_lines", "P11", oracle=RAW + "SELECT file, line_no, raw_line FROM raw WHERE trim(raw_line) <> '' AND v IS NULL")
def quarantine_lines(spark: SparkSession, sf: str) -> DataFrame:
    return nz.quarantine(table(spark, sf, "raw_records")).select("file", "line_no", "raw_line")


@CORE.query("filter_not_cls", "P07", oracle="SELECT rec_id, task FROM normalised WHERE task IS DISTINCT FROM '[CLS]'")
def filter_not_cls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "normalised").filter(nz.not_cls()).select("rec_id", "task")


@CORE.query("filter_allowed_sources", "P06", "J03", oracle=f"SELECT rec_id, source FROM normalised WHERE source IN ({_IN})")
def filter_allowed_sources(spark: SparkSession, sf: str) -> DataFrame:
    allowed = spark.createDataFrame([(s,) for s in ALLOWED], "source STRING")
    return enrich.allowed_sources(table(spark, sf, "normalised"), allowed).select("rec_id", "source")


@CORE.query("validate_pairs", "P05", oracle="SELECT rec_id FROM normalised WHERE len(pos) > 0 AND len(neg) > 0")
def validate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "normalised").filter(nz.valid_pair()).select("rec_id")


@CORE.query("drop_query_in_pos", "P08", oracle="SELECT rec_id FROM normalised WHERE NOT coalesce(list_contains(pos, query), false)")
def drop_query_in_pos(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "normalised").filter(nz.query_not_positive()).select("rec_id")


@CORE.query(
    "skip_counters", "A11", "A26", "A27",
    oracle=f"""SELECT source, count(*) AS seen, count(*) FILTER (source NOT IN ({_IN})) AS skipped_source,
      count(*) FILTER (source IN ({_IN}) AND NOT (coalesce(len(pos), 0) > 0 AND coalesce(len(neg), 0) > 0)) AS skipped_invalid,
      count(*) FILTER (source IN ({_IN}) AND coalesce(len(pos), 0) > 0 AND coalesce(len(neg), 0) > 0) AS kept FROM normalised GROUP BY source""",
)
def skip_counters(spark: SparkSession, sf: str) -> DataFrame:
    return nz.skip_counters(table(spark, sf, "normalised"), ALLOWED)


@CORE.query(
    "clean_negatives", "P27", "U04", "F65",
    oracle="""SELECT rec_id, len(list_distinct(list_filter(neg, lambda x: x IS NOT NULL AND NOT coalesce(list_contains(pos, x), false) AND x IS DISTINCT FROM query)))
      + CASE WHEN len(list_filter(neg, lambda x: x IS NULL)) > 0 AND len(list_filter(pos, lambda x: x IS NULL)) = 0 AND query IS NOT NULL THEN 1 ELSE 0 END AS n
      FROM (SELECT rec_id, query, coalesce(pos, []) AS pos, coalesce(neg, []) AS neg FROM normalised)""",
)
def clean_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "normalised").select("rec_id", F.size(nz.clean_negatives()).cast("bigint").alias("n"))


@CORE.query(
    "expand_positives", "B17", "P14", "J04",
    oracle=f"SELECT rec_id, i - 1 AS pos_no, [pos[i]] AS pos, neg FROM (SELECT *, unnest(range(1, len(pos) + 1)) AS i FROM normalised WHERE source IN ({', '.join(repr(s) for s in EXPANDED)}))",
)
def expand_positives(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.createDataFrame([(s,) for s in EXPANDED], "source STRING")
    rows = enrich.flag_sources(table(spark, sf, "normalised"), listed, "mid_range").filter("mid_range")
    return nz.expand_positives(rows).select("rec_id", F.col("pos_no").cast("bigint").alias("pos_no"), "pos", "neg")


@CORE.query("add_task_tag", "J01", "P13", oracle="SELECT rec_id, tag FROM normalised JOIN source_tasks USING (source)")
def add_task_tag(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.add_from_map(table(spark, sf, "normalised"), table(spark, sf, "source_tasks"), "source", "tag", "tag").select("rec_id", "tag")


@CORE.query(
    "add_instruction", "J02", "P24", "F01", "F02", "F03",
    oracle="""SELECT rec_id, CASE WHEN instruction IS NULL OR query LIKE '%Instruct:%' THEN query
      ELSE replace(replace(E'Instruct: {d}\\nQuery: {query}', '{d}', instruction), '{query}', query) END AS text FROM normalised JOIN source_tasks USING (source)""",
)
def add_instruction(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.add_from_map(table(spark, sf, "normalised"), table(spark, sf, "source_tasks"), "source", "instruction", "instruction")
    template = F.when(F.col("instruction").isNotNull(), text.instruction_template(F.col("instruction")))
    return rows.select("rec_id", text.instruct_once(template, F.col("query")).alias("text"))


@CORE.query("corpus_text_concat", "P21", oracle="SELECT doc_id, trim(coalesce(title, '') || ' ' || coalesce(text, ''), ' ') AS text FROM documents")
def corpus_text_concat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.corpus_text(F.col("title"), F.col("text")).alias("text"))


@CORE.query(
    "render_rerank_template", "F04", "F05", "F06", "F07", "F08",
    oracle="""SELECT rec_id, CASE WHEN instruct IS NULL THEN 'Query: ' || query || E'\\nDocument: ' || pos[1]
      ELSE 'Instruct: ' || instruct || E'\\nDocument: ' || pos[1] || E'\\nQuery: ' || query END AS online,
      'Instruct: ' || instruct || E'\\nDocument: ' || pos[1] AS offline, coalesce(instruct, '') || query AS prefixed FROM normalised""",
)
def render_rerank_template(spark: SparkSession, sf: str) -> DataFrame:
    q, i, d = F.col("query"), F.col("instruct"), F.get("pos", F.lit(0))
    return table(spark, sf, "normalised").select(
        "rec_id", text.cross_text(i, q, d).alias("online"), text.offline_document(i, d).alias("offline"), text.prefixed(i, q).alias("prefixed")
    )


@CORE.query(
    "restore_sources_counts", "K04", "P12", "P17",
    oracle="SELECT regexp_replace(source, '\\.gz$', '') AS file, count(*) AS n FROM normalised WHERE coalesce(source, '') <> '' GROUP BY 1",
)
def restore_sources_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalised").filter(F.coalesce("source", F.lit("")) != "")
    return rows.groupBy(text.strip_gz(F.col("source")).alias("file")).agg(F.count(F.lit(1)).alias("n"))


@CORE.query(
    "source_dense_ids", "P19", "P20", "W12",
    oracle="SELECT rec_id, coalesce(sample_id, CAST(rec_id AS VARCHAR)) AS id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS source_id FROM normalised",
)
def source_dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.dense_source_ids(table(spark, sf, "normalised")).select("rec_id", enrich.row_id().alias("id"), "source_id")


@CORE.query(
    "task_ids_weights", "P18", "P28",
    oracle="SELECT rec_id, CASE task WHEN '[CLS]' THEN 0 WHEN '[RETR]' THEN 1 WHEN '[STS]' THEN 2 END AS task_id, CASE WHEN task IN ('[CLS]', '[RETR]', '[STS]') THEN CAST(1.0 AS DOUBLE) END AS task_weight FROM normalised",
)
def task_ids_weights(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.task_numbers(table(spark, sf, "normalised")).select("rec_id", "task_id", "task_weight")


@CORE.query(
    "dedup_corpus", "A12", "U01", "U02", "U03",
    oracle="SELECT DISTINCT text FROM (SELECT unnest(pos) AS text FROM normalised UNION ALL SELECT unnest(neg) FROM normalised UNION ALL SELECT text FROM documents)",
)
def dedup_corpus(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalised")
    both = rows.select(F.explode("pos").alias("text")).unionAll(rows.select(F.explode("neg").alias("text")))
    return both.unionAll(table(spark, sf, "documents").select("text")).distinct()


@CORE.query(
    "candidate_sets", "U08", "U09", "U05", "U06", "O13",
    oracle="""SELECT rec_id, len(list_distinct(list_filter(list_concat(coalesce(pos, []), coalesce(neg, [])), lambda x: x IS NOT NULL)))
      + CASE WHEN len(list_filter(list_concat(coalesce(pos, []), coalesce(neg, [])), lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END AS n_candidates,
      len(list_filter(list_intersect(coalesce(pos, []), coalesce(neg, [])), lambda x: x IS NOT NULL)) = 0 AS apart, substr(query, 1, 32768) AS query FROM normalised""",
)
def candidate_sets(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    pos, neg = F.coalesce("pos", none), F.coalesce("neg", none)
    return table(spark, sf, "normalised").select(
        "rec_id", F.size(F.array_union(pos, neg)).cast("bigint").alias("n_candidates"), (~F.coalesce(F.arrays_overlap(pos, neg), F.lit(False))).alias("apart"), F.substring("query", 1, 32768).alias("query")
    )
