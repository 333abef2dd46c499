"""Queries that run the jobs, sources and sinks on real files, written from the tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge import jobs
from pairforge.functions.rand import sql_hash01
from pairforge.operators import batching, enrich, order
from pairforge.plans.batching import chunkify_collision_free, pack_best_fit
from pairforge.plans.curate import ALLOWED, EXPANDED, RAW
from pairforge.plans.sampling import _plan_sql
from pairforge.registry import CORE, table
from pairforge.session import path_exists, work_dir
from pairforge.sources import jsonl

#: DuckDB: the raw lines as files hold them, numbered from 1.
LINES = """lines AS (SELECT regexp_replace(file, '\\.gz$', '') AS file, row_number() OVER (PARTITION BY file ORDER BY line_no, raw_line) AS line_no, replace(raw_line, '�', '') AS line
  FROM raw_records WHERE raw_line IS NOT NULL AND file IS NOT NULL)"""


def raw_files(spark: SparkSession, sf: str) -> str:
    """The raw lines as one gz file for each of their files, in their order."""
    path = f"{work_dir(spark)}/raw"
    raw = table(spark, sf, "raw_records").filter("raw_line IS NOT NULL AND file IS NOT NULL").withColumn("name", F.regexp_replace("file", r"\.gz$", ""))
    placed = raw.repartition("name").sortWithinPartitions("name", "line_no", "raw_line")
    placed.select(F.col("name").alias("file"), F.col("raw_line").alias("value")).write.partitionBy("file").option("compression", "gzip").text(path)
    return path


def record_files(spark: SparkSession, sf: str, *columns: str) -> str:
    path = f"{work_dir(spark)}/records"
    jsonl.write_records(table(spark, sf, "normalised").select(*(columns or ("query", "pos", "neg", "source"))), path)
    return path


@CORE.query("scan_numbered_lines", "S02", "S07", oracle=f"WITH {LINES} SELECT * FROM lines")
def scan_numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.number_lines(jsonl.read_lines(spark, raw_files(spark, sf), glob="*", recursive=True, skip_blank=False)).select("file", "line_no", "line")


@CORE.query(
    "job_sampling_config", "S04", "S10", "K08", "A01", "A02", "A03", "B01", "B02", "B03",
    oracle=f"""WITH {LINES}, counts AS (SELECT file, count(*) AS total_lines FROM lines WHERE trim(line) <> '' GROUP BY 1
    ), goal AS (SELECT floor(round(quantile_cont(total_lines, 0.5), 9)) AS goal FROM counts
    ), r AS (SELECT file, total_lines, floor(least(1.0, goal / total_lines) * 1000 + 0.5) / 1000 AS sample_ratio FROM counts, goal
    ), s AS (SELECT *, CAST(floor(total_lines * sample_ratio) AS BIGINT) AS sampled_lines FROM r)
    SELECT *, floor(sampled_lines / sum(sampled_lines) OVER () * 1e6 + 0.5) / 1e6 AS dataset_share FROM s""",
)
def job_sampling_config(spark: SparkSession, sf: str) -> DataFrame:
    """The configuration is written as CSV and read again, which computes lines and shares anew from the rounded ratios."""
    out = f"{work_dir(spark)}/config"
    jobs.create_sampling_config(spark, raw_files(spark, sf), out)
    return jsonl.read_config(spark, out)


_CAP = 500
_SAMPLED = RAW + f""", numbered AS (SELECT file, line_no AS given, raw_line, rec, row_number() OVER (PARTITION BY file ORDER BY line_no, raw_line) AS line_no FROM r WHERE raw_line IS NOT NULL AND file IS NOT NULL
), c AS (SELECT regexp_replace(trim(file), '\\.gz$', '') AS file, max(coalesce(total_lines, 0)) AS total_lines, max(least(1.0, greatest(0.0, coalesce(sample_ratio, 0.0)))) AS ratio FROM sampling_config GROUP BY 1
), c2 AS (SELECT *, CAST(floor(total_lines * ratio) AS DOUBLE) AS s FROM c), {_plan_sql('s', 'c2', _CAP)}
, taken AS (SELECT n.line_no, rec.query AS query, rec.pos AS pos, rec.neg AS neg, p.file AS source, quota
  FROM numbered n JOIN plan p ON p.file = regexp_replace(n.file, '\\.gz$', '') WHERE quota > 0 AND {sql_hash01(22, 'sample', 'p.file', 'n.line_no')} < ratio AND rec.query <> '' AND len(rec.pos) > 0
), kept AS (SELECT * FROM taken QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_no) <= quota)"""


def _config_file(spark: SparkSession, sf: str) -> str:
    config = table(spark, sf, "sampling_config").groupBy(F.regexp_replace(F.trim("file"), r"\.gz$", "").alias("file")).agg(
        F.max(F.coalesce("total_lines", F.lit(0))).alias("total_lines"), F.max(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("sample_ratio", F.lit(0.0))))).alias("sample_ratio")
    )
    path = f"{work_dir(spark)}/plan.csv"
    jsonl.write_config(config.select("file", "total_lines", "sample_ratio", F.lit(0).alias("sampled_lines"), F.lit(0.0).alias("dataset_share")), path)
    return path


@CORE.query("job_sample_datasets", "S10", "B04", "B05", "B06", "B07", "W06", "K01", "K09", "O01", "O08", oracle=_SAMPLED + " SELECT line_no, query, pos, neg, source FROM kept")
def job_sample_datasets(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.sample_datasets(spark, raw_files(spark, sf), _config_file(spark, sf), f"{work_dir(spark)}/sampled", max_samples=_CAP, max_samples_per_shard=100)


@CORE.query(
    "job_sample_with_negatives", "B08", "B09", "B21", "J08", "O12",
    oracle=_SAMPLED + " SELECT line_no, source, len(neg[1:2]) AS own, list_sort(neg[1:2]) AS first FROM kept WHERE len(neg) > 0",
)
def job_sample_with_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Own negatives come first, and none is lost or doubled by the filling."""
    kept = jobs.sample_datasets(spark, raw_files(spark, sf), _config_file(spark, sf), None, max_samples=_CAP, negative_samples=2, negative_pool_size=1000)
    plain = jobs.sample_datasets(spark, raw_files(spark, sf), _config_file(spark, sf), None, max_samples=_CAP).filter("size(neg) > 0").select("line_no", "source", F.size("neg").alias("n"))
    own = kept.join(plain, ["line_no", "source"]).withColumn("first", F.slice("neg", F.lit(1), F.least("n", F.lit(2))))
    return own.select("line_no", "source", F.size("first").cast("bigint").alias("own"), F.sort_array("first").alias("first"))


@CORE.query(
    "plan_report_file", "K09", "K12", "F14",
    oracle="""SELECT '| file | share |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL
    SELECT DISTINCT '| ' || coalesce(trim(file), '') || ' | ' || coalesce(printf('%.2f%%', dataset_share * 100), 'n/a') || ' |' FROM sampling_config""",
)
def plan_report_file(spark: SparkSession, sf: str) -> DataFrame:
    from pairforge.plans.sampling import sampling_plan_report

    path = f"{work_dir(spark)}/report"
    jsonl.write_report(sampling_plan_report(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@CORE.query("tag_from_map_file", "S11", "J01", "P13", oracle="SELECT query, n.source, tag AS task FROM normalised n JOIN source_tasks USING (source)")
def tag_from_map_file(spark: SparkSession, sf: str) -> DataFrame:
    """The map is a JSON object in a file, the records are JSON lines; both are written from the tables first."""
    path = f"{work_dir(spark)}/tags.json"
    rows = table(spark, sf, "source_tasks").select("source", "tag")
    jsonl.write_file(spark, path, rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "tag"))))).first()[0])  # a row for each source
    return jobs.add_from_mapping(spark, record_files(spark, sf), f"{work_dir(spark)}/tagged", path).select("query", "source", "task")


@CORE.query(
    "instruction_from_map_file", "S11", "J02", "F02",
    oracle="SELECT query, n.source, instruction FROM normalised n JOIN (SELECT source, instruction FROM source_tasks) USING (source)",
)
def instruction_from_map_file(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_dir(spark)}/instructions.json"
    rows = table(spark, sf, "source_tasks").select("source", F.struct("instruction").alias("v"))
    jsonl.write_file(spark, path, rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "v"))))).first()[0])
    return jobs.add_from_mapping(spark, record_files(spark, sf), None, path, "instruction", "instruction").select("query", "source", "instruction")


@CORE.query("candidate_pool_file", "S09", "U02", oracle="SELECT DISTINCT text FROM documents WHERE text IS NOT NULL")
def candidate_pool_file(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_dir(spark)}/pool"
    jsonl.write_records(table(spark, sf, "documents").select("doc_id", "text"), path)
    return jsonl.read_pool(spark, path).distinct()


@CORE.query("result_files", "S18", "S19", oracle="SELECT task_name AS task, count(*) AS items, count(*) FILTER (split_name = 'test') AS tests FROM eval_items WHERE task_name IS NOT NULL GROUP BY 1")
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Results of each task in a file of its name; tasks without a file would come out with nulls."""
    path = work_dir(spark)
    tasks = table(spark, sf, "eval_items").filter("task_name IS NOT NULL").groupBy("task_name").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("split_name") == "test").alias("tests"))
    for r in tasks.collect():  # a row for each task of a benchmark
        jsonl.write_file(spark, f"{path}/{r.task_name.replace('/', '_')}_default_predictions.json", '{"task_name": %s, "items": %d, "tests": %d}' % (_json(r.task_name), r["items"], r.tests))
    found = jsonl.read_results(spark, path)
    return tasks.select(F.col("task_name").alias("task")).join(found.select(F.col("task_name").alias("task"), "items", "tests"), "task", "left")


def _json(text: str) -> str:
    import json

    return json.dumps(text)


@CORE.query("base64_files", "S12", "S27", oracle="SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def base64_files(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes as base64 text in JSON lines, found as files of a folder, and decoded."""
    path = f"{work_dir(spark)}/images"
    jsonl.write_records(table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("image")), path)
    files = jsonl.read_images(spark, path).filter(F.col("length") > 0).filter(~F.col("path").rlike("/[_.][^/]*$"))
    names = [r.path for r in files.select("path").collect()]  # part files
    return spark.read.schema("doc_id BIGINT, image STRING").json(names).select("doc_id", F.decode(jsonl.decode_image(F.col("image")), "UTF-8").alias("text"))


@CORE.query("write_chunk_files", "K05", "O06", oracle="SELECT doc_id, text, title FROM documents")
def write_chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_dir(spark)}/chunks"
    docs = table(spark, sf, "documents").select("doc_id", "text", "title", F.expr("doc_id div 64").alias("chunk_no"))
    jsonl.write_chunks(docs, path, "chunk_no", "doc_id")
    return spark.read.schema("doc_id BIGINT, text STRING, title STRING").json(path)


@CORE.query("job_filter_cls", "P07", "K06", "K07", oracle="SELECT task, count(*) AS n FROM normalised WHERE task IS DISTINCT FROM '[CLS]' GROUP BY 1")
def job_filter_cls(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_dir(spark)}/kept"
    jobs.filter_cls(spark, record_files(spark, sf, "query", "pos", "task"), path)
    return spark.read.schema("task STRING").json(path).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("append_log_lines", "K14", oracle="SELECT file, line_no, raw_line FROM raw_records UNION ALL SELECT file, line_no, raw_line FROM raw_records")
def append_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = f"{work_dir(spark)}/log", table(spark, sf, "raw_records").select("file", "line_no", "raw_line")
    jsonl.append_log(rows, path)
    jsonl.append_log(rows, path)
    return spark.read.schema("file STRING, line_no BIGINT, raw_line STRING").json(path)


_STRIDE = f"WITH {LINES}, o AS (SELECT line, row_number() OVER (ORDER BY file, line_no) - 1 AS ord0, count(*) OVER () AS total FROM lines WHERE trim(line) <> '')"


@CORE.query("job_distribute", "K03", "K15", "S02", "W07", oracle=_STRIDE + " SELECT CAST(ord0 % 7 AS INTEGER) AS shard, line FROM o")
def job_distribute(spark: SparkSession, sf: str) -> DataFrame:
    """Dealt out; the inputs are deleted once the output is complete."""
    path = raw_files(spark, sf)
    out = jobs.distribute(spark, path, f"{work_dir(spark)}/dealt", 7, delete_input=True)
    if path_exists(spark, path):
        raise RuntimeError("inputs are still there")
    return out


@CORE.query("job_shuffle_lines", "K02", "W08", "O02", oracle=_STRIDE + ", s AS (SELECT CAST(floor(((ord0 + 1) * 5 - 1) / total) AS INTEGER) AS shard FROM o) SELECT shard, count(*) AS n FROM s GROUP BY 1")
def job_shuffle_lines(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.shuffle_lines(spark, raw_files(spark, sf), f"{work_dir(spark)}/shuffled", 5).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("job_merge_shuffle", "O03", "O04", "J11", "K15", "U01", oracle=_STRIDE + " SELECT CAST(ord0 % 3 AS INTEGER) AS shard, line FROM o UNION ALL SELECT CAST(ord0 % 3 AS INTEGER), line FROM o")
def job_merge_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    path, dirs = raw_files(spark, sf), [f"{work_dir(spark)}/{x}" for x in "ab"]
    for d in dirs:
        jobs.distribute(spark, path, d, 3)
    return jobs.merge_shuffle(spark, dirs, f"{work_dir(spark)}/merged", delete_input=True).withColumn("shard", F.col("shard").cast("int"))


@CORE.query("job_restore_sources", "K04", "P12", "P17", "F22", oracle="SELECT regexp_replace(source, '\\.gz$', '') AS file, count(*) AS n FROM normalised WHERE coalesce(source, '') <> '' GROUP BY 1")
def job_restore_sources(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.restore_sources(spark, record_files(spark, sf), f"{work_dir(spark)}/sources")


_MID = ", ".join(f"'{s}'" for s in EXPANDED)


@CORE.query(
    "job_filter_retrieval", "P05", "P06", "P14", "B17", "B18", "B19", "J03", "J04",
    oracle=f"""WITH g AS (SELECT source, CASE WHEN source IN ({_MID}) THEN len(pos) ELSE 1 END AS k FROM normalised WHERE source IN ({", ".join(f"'{s}'" for s in ALLOWED)}) AND len(pos) > 0 AND len(neg) > 0
    ) SELECT source, CAST(sum(k) AS BIGINT) AS own, CAST(greatest(sum(k), 1000) AS BIGINT) AS n FROM g GROUP BY 1""",
)
def job_filter_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.filter_retrieval(spark, record_files(spark, sf), f"{work_dir(spark)}/curated", ALLOWED, EXPANDED)
    return out.groupBy("source").agg(F.count_if(F.col("copy") == 0).alias("own"), F.count(F.lit(1)).alias("n"))


@CORE.query("source_index", "S14", "S15", "P19", "W12", oracle="SELECT rec_id, source, dense_rank() OVER (ORDER BY source) - 1 AS source_id, row_number() OVER (PARTITION BY source ORDER BY rec_id) - 1 AS place FROM normalised WHERE source IS NOT NULL")
def source_index(spark: SparkSession, sf: str) -> DataFrame:
    """A number for each source, and each record's place in its source."""
    rows = table(spark, sf, "normalised").filter("source IS NOT NULL").select("rec_id", "source")
    placed = order.place_in_group(enrich.dense_source_ids(rows), ["source"], "rec_id", [])
    return placed.select("rec_id", "source", F.col("source_id").cast("bigint").alias("source_id"), "place")


@CORE.query("chunk_invariants", "C01", "C04", oracle="SELECT coalesce(source, 'unknown') AS domain, count(*) AS n, count(*) AS apart, 0 AS collisions, 0 AS too_long FROM normalised GROUP BY 1")
def chunk_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Of collision-free chunks: every row once, no query or positive twice in a chunk, none over its size."""
    chunks = chunkify_collision_free(spark, sf)
    rows = table(spark, sf, "normalised").select(F.col("rec_id").alias("ord"), "query", "pos")
    at = ["domain", "part", "chunk_no"]
    texts = chunks.join(rows, "ord").select(*at, "ord", F.explode(F.array_union(F.array(F.concat(F.lit("q"), F.nullif("query", F.lit("")))), F.transform(F.coalesce("pos", F.array().cast("array<string>")), lambda x: F.concat(F.lit("p"), x)))).alias("text"))
    twice = texts.filter("text IS NOT NULL").groupBy(*at, F.md5("text")).agg((F.count_distinct("ord") - 1).alias("k")).groupBy("domain").agg(F.sum("k").alias("collisions"))
    sizes = chunks.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("apart"))
    return sizes.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"), F.count_if(F.col("n") > 64).cast("int").alias("too_long")).join(twice, "domain", "left").select(
        "domain", "n", "apart", F.coalesce("collisions", F.lit(0)).cast("int").alias("collisions"), "too_long"
    )


@CORE.query("bin_invariants", "C03", "A20", oracle="SELECT 64.0::DOUBLE AS avg, 64 AS max, 64 AS min, 0.0::DOUBLE AS var, 0 AS twice")
def bin_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of packed bins: all are exactly full, and no group is in two."""
    packed = pack_best_fit(spark, sf)
    twice = packed.groupBy("group_id").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).cast("int").alias("twice"))
    stats = batching.bin_statistics(packed).select("avg", F.col("max").cast("int").alias("max"), F.col("min").cast("int").alias("min"), "var")
    return stats.crossJoin(F.broadcast(twice))  # one row each


def _chunk_report(placed: DataFrame, size: int) -> DataFrame:
    chunks = placed.groupBy("chunk_no").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))
    twice = placed.groupBy("id", "copy").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).cast("int").alias("twice"))
    full = chunks.agg(F.min("n").cast("int").alias("least"), F.max("n").cast("int").alias("most"), F.max("last").cast("int").alias("last"))
    return full.crossJoin(F.broadcast(twice))  # one row each


for _s in ("none", "range", "median", "probability"):

    @CORE.query(f"job_domain_chunks_{_s}", "C05", "C01", "C02", "C03", "B12", "B16", "A20", oracle="SELECT 64 AS least, 64 AS most, 63 AS last, 0 AS twice")
    def _domain_chunks(spark: SparkSession, sf: str, strategy: str = _s) -> DataFrame:
        """The pipeline's chunks: all are exactly full and no copy of a record is in two."""
        return _chunk_report(jobs.domain_chunks(table(spark, sf, "normalised"), 64, strategy), 64)


@CORE.query("job_chunk_files", "C05", "K05", "S07", oracle="SELECT 64 AS least, 64 AS most, 63 AS last, 0 AS twice")
def job_chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_report(jobs.prepare_domain_chunks(spark, record_files(spark, sf), f"{work_dir(spark)}/chunked"), 64)


@CORE.query("hn_mine_texts", "V07", "V08", "V06", "J06", "J07", "A13", "U08", "P08")
def hn_mine_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All records with a query and positives; no twin, since the encoder is a program (tested against brute force)."""
    return jobs.mine_texts(table(spark, sf, "normalised"))
