"""JSON-lines scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import order
from pairforge.session import staged, work_dir

CONFIG_SCHEMA = "file STRING, total_lines BIGINT, sample_ratio DOUBLE, sampled_lines BIGINT, dataset_share DOUBLE"


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl*", recursive: bool = False, skip_blank: bool = True) -> DataFrame:
    """(file, path, split, line) with bytes that are no UTF-8 left out; codecs by suffix; no files raises.

    A file is named by its folder file=NAME, where the sinks made one, else by itself.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    folder = F.regexp_extract("_metadata.file_path", r"/file=([^/]+)/", 1)
    name = F.when(folder != "", folder).otherwise(F.col("_metadata.file_name"))
    df = reader.text(path).select(name.alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")).alias("line"))
    if df.isEmpty() and not reader.format("binaryFile").load(path).select("path").limit(1).count():
        raise FileNotFoundError(f"no {glob} below {path}")
    return df.filter(F.trim("line") != "") if skip_blank else df


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds line_no from 1 within each file, of lines as read_lines gives them, blank ones included.

    Rows count up within a split of a file; the sizes of the splits before it give its first number. So a large plain file
    is numbered split by split, and no task sorts it.
    """
    marked = staged(lines.withColumn("_m", F.monotonically_increasing_id()), f"{work_dir(lines.sparkSession)}/lines")
    splits = marked.groupBy("path", "split").agg(F.min("_m").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = splits.select("path", "split", "_least", F.expr("coalesce(sum(_n) OVER (PARTITION BY path ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_before"))
    return marked.join(before, ["path", "split"]).withColumn("line_no", F.col("_before") + F.col("_m") - F.col("_least") + 1).drop("_m", "_least", "_before")


def read_records(spark: SparkSession, path: str, mode: str = "drop", **how) -> DataFrame:
    """(query, pos, neg, source) of raw lines; source is the file's name, whatever the lines say."""
    from pairforge.operators.normalise import normalise

    return normalise(read_lines(spark, path, **how).select("file", "line"), "line", "file", mode)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """The candidate pool's texts."""
    return spark.read.schema("text STRING").json(path).filter(F.col("text").isNotNull())


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The sampling configuration, cleaned; empty raises."""
    from pairforge.operators.sampling import parse_config

    raw = spark.read.option("header", True).schema(CONFIG_SCHEMA).csv(path)
    if raw.isEmpty():
        raise ValueError(f"no entries in {path}")
    return parse_config(raw)


def read_map(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """(key, value) of a JSON object; field takes that member of each value. Anything but an object raises."""
    v = F.parse_json("value")
    rows = spark.read.option("wholetext", True).text(path).select(v.alias("v"))
    kind = "map<string,string>" if field is None else f"map<string,struct<{field}:string>>"
    got = rows.select(F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.from_json(F.col("v").cast("string"), kind)).otherwise(F.raise_error(F.lit("a mapping must be a JSON object"))).alias("m"))
    flat = got.select(F.explode("m").alias("key", "value"))
    return flat if field is None else flat.select("key", F.col(f"value.{field}").alias("value"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files (one JSON object each) as they are, with the task's name from the file's."""
    return spark.read.option("multiLine", True).json(path).withColumn("task", F.regexp_replace(F.col("_metadata.file_name"), r"(_default_predictions)?\.json$", ""))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def decode_image(text: Column) -> Column:
    """Bytes of base64 text."""
    return F.unbase64(text)


def _gz(df: DataFrame):
    return df.write.mode("errorifexists").option("compression", "gzip").option("ignoreNullFields", False)


def write_rolling(records: DataFrame, path: str, size: int, *by: str, most: int | None = None, drop: list[str] | None = None) -> int:
    """Gz JSON lines in folders shard=00000, ... of exactly `size` records in the order `by`; returns how many."""
    placed = order.with_ordinal(records, *by)
    if most is not None:
        placed = placed.filter(F.col("ord0") < most)
    shard = F.format_string("%05d", order.rolling_shard(F.col("ord0"), size))
    out = placed.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "ord0").drop("ord0", *(drop or []))
    _gz(out).partitionBy("shard").json(path)
    return placed.count()


def write_shards(records: DataFrame, path: str, n: int, *by: str, contiguous: bool = True) -> None:
    """N shards, contiguous or dealt out one by one. Inputs are never deleted (Q21)."""
    total = records.count()
    placed = order.with_ordinal(records, *by)
    shard = order.contiguous_shard(F.col("ord0"), F.lit(total), n) if contiguous else order.stride_shard(F.col("ord0"), n)
    out = placed.withColumn("shard", F.format_string("%03d", shard.cast("bigint"))).repartition("shard").sortWithinPartitions("shard", "ord0").drop("ord0")
    _gz(out).partitionBy("shard").json(path)


def write_by_source(records: DataFrame, path: str, max_records_per_file: int = 1_000_000) -> None:
    """One folder for each source (without .gz); rows without a source are left out.

    Rows of a source spread over several tasks, so a source of any size is written in parallel.
    """
    rows = records.filter(F.coalesce("source", F.lit("")) != "").withColumn("file", F.regexp_replace("source", r"\.gz$", ""))
    _gz(rows.repartition("file", F.pmod(F.xxhash64(*records.columns), F.lit(16)))).option("maxRecordsPerFile", max_records_per_file).partitionBy("file").json(path)


def write_chunks(chunks: DataFrame, path: str, *by: str) -> None:
    """Gz JSON lines in the order of chunks; non-ASCII as it is, nulls kept."""
    _gz(chunks.repartitionByRange(*by).sortWithinPartitions(*by)).json(path)


def write_records(records: DataFrame, path: str) -> None:
    """gz JSON lines, nulls kept."""
    _gz(records).json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as they were read."""
    lines.select(F.rtrim("line").alias("value")).write.option("compression", "gzip").text(path)


def write_config(config: DataFrame, path: str) -> None:
    """CSV with a header."""
    config.coalesce(1).write.option("header", True).csv(path)  # a row for each file


def write_report(rows: DataFrame, path: str) -> None:
    """A table as text, columns parted by bars, in the order of the rows; for small reports."""
    head = " | ".join(rows.columns)
    rule = " | ".join("---" for _ in rows.columns)
    body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |")).alias("value"))
    top = rows.sparkSession.createDataFrame([(f"| {head} |",), (f"| {rule} |",)], "value STRING")
    top.coalesce(1).unionAll(body.coalesce(1)).coalesce(1).write.text(path)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file of that very name (a map, a result), written by the driver."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jvm_path, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def append_log(rows: DataFrame, path: str) -> None:
    """K14."""
    rows.write.mode("append").json(path)


def pending(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """The input files (file) that are not yet in the list of done ones."""
    return inputs.join(done.select("file").distinct(), "file", "left_anti")
