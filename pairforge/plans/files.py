"""Round trips through the JSON-lines sinks and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.plans.curate import RAW
from pairforge.registry import CORE, table
from pairforge.session import work_dir
from pairforge.sources import jsonl


@CORE.query(
    "jsonl_scan", "S01", "S02", "S03", "S05", "S06", "S08",
    oracle=RAW + "SELECT rec.query AS query, rec.pos AS pos, rec.neg AS neg, regexp_replace(file, '\\.gz$', '') AS source FROM r WHERE rec.query <> '' AND len(rec.pos) > 0",
)
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines are written to one folder of gz text for each file and read again; the folder names the source."""
    path = work_dir(spark)
    raw = table(spark, sf, "raw_records").filter("raw_line IS NOT NULL").withColumn("name", F.regexp_replace("file", r"\.gz$", ""))
    raw.repartition("name").select("name", F.col("raw_line").alias("value")).write.partitionBy("name").option("compression", "gzip").text(f"{path}/raw")
    lines = jsonl.read_lines(spark, f"{path}/raw", glob="*.txt.gz", recursive=True)
    named = lines.select(F.regexp_extract("path", r"name=([^/]+)/", 1).alias("file"), "line")
    from pairforge.operators.normalise import normalise

    return normalise(named, "line", "file")


@CORE.query("write_by_source", "K04", "F22", oracle="SELECT regexp_replace(source, '\\.gz$', '') AS file, rec_id, query, len(pos) AS n_pos FROM normalised WHERE coalesce(source, '') <> ''")
def write_by_source(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_dir(spark)}/sources"
    jsonl.write_by_source(table(spark, sf, "normalised").select("rec_id", "query", "pos", "source"), path)
    back = spark.read.schema("rec_id BIGINT, query STRING, pos ARRAY<STRING>, source STRING, file STRING").json(path)
    return back.select("file", "rec_id", "query", F.when(F.col("pos").isNotNull(), F.size("pos")).cast("bigint").alias("n_pos"))


@CORE.query("write_rolling_shards", "K01", oracle="SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) // 200 AS INTEGER) AS shard, doc_id, text FROM documents")
def write_rolling_shards(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_dir(spark)}/rolling"
    jsonl.write_rolling(table(spark, sf, "documents").select("doc_id", "text"), path, 200, "doc_id")
    return spark.read.schema("doc_id BIGINT, text STRING, shard INT").json(path).select("shard", "doc_id", "text")


@CORE.query("pending_files", "K13", oracle="SELECT DISTINCT file FROM raw_records WHERE file NOT IN (SELECT source FROM source_tasks WHERE tag = '[RETR]')")
def pending_files(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "source_tasks").filter("tag = '[RETR]'").select(F.col("source").alias("file"))
    return jsonl.pending(table(spark, sf, "raw_records").select("file").distinct(), done)


@CORE.query("image_rows", "P15", "P16", oracle="SELECT 't2vd_colpali_' || source || '_' || doc_id AS id, 'images/' || regexp_replace(source, '\\..*$', '') || '/' || doc_id || '.jpg' AS image FROM documents")
def image_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an image data set as retrieval records: ids (their prefix is a fixed value) and paths by rule; pixels stay outside of the engine."""
    docs = table(spark, sf, "documents")
    folder = F.regexp_replace("source", r"\..*$", "")
    return docs.select(F.concat(F.lit("t2vd_colpali_"), "source", F.lit("_"), "doc_id").alias("id"), F.concat(F.lit("images/"), folder, F.lit("/"), "doc_id", F.lit(".jpg")).alias("image"))
