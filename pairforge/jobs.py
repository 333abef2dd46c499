"""Whole jobs over folders of JSON lines: scans, operators and sinks put together, with their customary defaults.

Every job takes a session, input and output folders and its options; it writes gz JSON lines and returns a DataFrame of what
it wrote or planned. Nothing is deleted unless delete_input is set, and then only after the output is complete (K15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.rand import det_key, hash01, key_int
from pairforge.operators import batching, enrich, normalise as nz, order, retrieval, sampling, texts as mined
from pairforge.session import drop_dir, spread, staged, work_dir
from pairforge.sources import jsonl

RECORD = "query STRING, pos ARRAY<STRING>, neg ARRAY<STRING>, source STRING"


def read_training(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records as the jobs write them; folders shard=... add no column."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def create_sampling_config(spark: SparkSession, input_dir: str, output_file: str | None = None, target_lines: int | None = None) -> DataFrame:
    """Lines of each file and the ratio that brings it to target_lines (default: the median)."""
    counts = jsonl.read_lines(spark, input_dir, glob="*", recursive=True).groupBy("file").agg(F.count(F.lit(1)).alias("total_lines"))
    config = sampling.sampling_config(counts, target_lines)
    if output_file:
        jsonl.write_config(config.orderBy("file"), output_file)
    return config


def sample_datasets(
    spark: SparkSession, input_dir: str, sampling_config: str, output_dir: str | None = None, max_samples: int | None = None, max_samples_per_shard: int = 512_000,
    negative_samples: int = 0, negative_pool_size: int = 1_000_000, seed: int = 22,
) -> DataFrame:
    """(file, line_no, query, pos, neg, source) of a sample by plan.

    A line is taken by its own seeded number and its file's ratio, before it is parsed; of the records of a file the first
    by line stay up to the file's quota; negatives are cut or filled to negative_samples from a pool of the file's own texts.
    """
    config = jsonl.read_config(spark, sampling_config)
    plan = sampling.quotas(config.withColumn("est", sampling.estimated()), max_samples).select("file", "sample_ratio", "quota")
    lines = jsonl.number_lines(jsonl.read_lines(spark, input_dir, glob="*", recursive=True, skip_blank=False))
    own = lines.join(enrich.small(plan), "file")
    taken = own.filter((F.col("quota") > 0) & (hash01(seed, "sample", "file", "line_no") < F.col("sample_ratio")))
    records = nz.normalise(taken.select("file", "line_no", "line", "quota"), "line", "file")
    path = work_dir(spark)
    placed = order.place_in_group(staged(records, f"{path}/records"), ["source"], "line_no", [])
    kept = placed.filter(F.col("place") < F.col("quota")).select("line_no", "query", "pos", "neg", "source")
    if negative_samples:
        kept = _fill_negatives(kept, own, negative_samples, negative_pool_size, seed)
    kept = staged(kept, f"{path}/kept")
    if kept.isEmpty():
        raise RuntimeError("no samples were written; check the sampling configuration")
    if output_dir:
        shuffled = kept.withColumn("_key", det_key(seed + 2, "shuffle", "source", "line_no"))
        out = shuffled.withColumnRenamed("line_no", "_line")
        jsonl.write_rolling(out, f"{output_dir}/shards", max(1, max_samples_per_shard), "_key", "source", "_line", most=max_samples, drop=["_key", "_line"])
        share = plan.withColumn("share", F.col("quota") / F.greatest(F.expr("sum(quota) OVER ()"), F.lit(1)))
        jsonl.write_report(share.orderBy(F.desc_nulls_last("share"), "file").select("file", "quota", F.format_string("%.2f%%", F.col("share") * 100).alias("share")), f"{output_dir}/plan")
    return kept


def _fill_negatives(records: DataFrame, lines: DataFrame, wanted: int, pool_size: int, seed: int) -> DataFrame:
    """Negatives of each file's records from a pool of at most pool_size texts of the file: those with the smallest digests, by places."""
    texts = lines.select(F.col("file").alias("source"), "line_no", F.posexplode(nz.all_texts(nz.parsed(F.col("line")))).alias("nth", "text"))
    keyed = texts.withColumn("_key", det_key(seed + 1, "pool", "source", "line_no", "nth")).withColumn("_k", key_int(F.col("_key")))
    pool = order.place_in_group(staged(keyed, f"{work_dir(records.sparkSession)}/texts"), ["source"], "_k", ["_key", "line_no", "nth"]).filter(F.col("place") < pool_size)
    pool = staged(pool.select("source", "place", "text"), f"{work_dir(records.sparkSession)}/pool")
    sizes = pool.groupBy("source").agg(F.count(F.lit(1)).alias("_size"))
    rows = records.join(enrich.small(sizes), "source").withColumn("neg", F.slice(F.coalesce("neg", F.array().cast("array<string>")), 1, wanted))
    rows = rows.withColumn("_need", F.lit(wanted) - F.size("neg")).withColumn("_start", F.pmod(key_int(det_key(seed + 1, "neg", "source", "line_no")), F.col("_size")))
    places = F.transform(F.sequence(F.lit(0), F.col("_need") * 2 - 1), lambda i: F.pmod(F.col("_start") + i, F.col("_size")))
    draws = rows.filter("_need > 0").select("source", "line_no", "query", "pos", F.posexplode(places).alias("_i", "place"))
    own = F.coalesce(F.array_contains("pos", F.col("text")), F.lit(False))
    drawn = draws.join(pool, ["source", "place"]).filter((F.col("text") != F.col("query")) & ~own)
    fills = drawn.groupBy("source", "line_no").agg(F.array_sort(F.collect_list(F.struct("_i", "text"))).alias("_fills"))  # twice the need at most
    more = F.coalesce(F.transform("_fills", lambda x: x["text"]), F.array().cast("array<string>"))
    joined = rows.join(fills, ["source", "line_no"], "left")
    return joined.select("line_no", "query", "pos", F.concat("neg", F.slice(more, F.lit(1), F.greatest("_need", F.lit(0)))).alias("neg"), "source")


def filter_retrieval(
    spark: SparkSession, input_path: str, output_path: str | None, allowed: list[str], mid_range: list[str], least: int = 1000, seed: int = 222
) -> DataFrame:
    """Records of the allowed sources with positives and negatives; those of mid_range once for each
    positive; sources under `least` records are filled up with further copies. (query, pos, neg, source, copy).
    """
    rows = read_training(spark, input_path)
    listed = lambda names: spark.createDataFrame([(s,) for s in names], "source STRING")
    good = enrich.flag_sources(enrich.allowed_sources(rows, listed(allowed)).filter(nz.valid_pair()), listed(mid_range), "_mid")
    each = nz.expand_positives(good.filter("_mid")).drop("pos_no").unionByName(good.filter("NOT _mid")).drop("_mid")
    # Copies are told apart by their place in a total order, so that equal records stay two.
    numbered = order.with_ordinal(each.withColumn("_d", F.md5(F.to_json(F.struct("source", "query", "pos", "neg")))), "_d", name="_id")
    sizes = numbered.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("target", F.greatest(F.col("n"), F.lit(least)))
    out = sampling.resize(numbered, sizes, seed, "_id", "source")
    if output_path:
        shuffled = out.orderBy(det_key(seed, "shuffle", "_id", "copy"), "_id", "copy")
        jsonl.write_records(shuffled.select("query", "pos", "neg", "source"), output_path)
    return out.select("query", "pos", "neg", "source", "copy")


def filter_cls(spark: SparkSession, input_path: str, output_path: str) -> DataFrame:
    """The lines whose record is no classification, as they were read."""
    lines = jsonl.read_lines(spark, input_path, glob="*", recursive=True)
    kept = lines.filter(~nz.member(nz.parsed(F.col("line")), "$.task", "string").eqNullSafe("[CLS]"))
    jsonl.write_lines(kept, output_path)
    return kept.select("line")


def add_from_mapping(spark: SparkSession, input_path: str, output_path: str | None, mapping: str, out: str = "task", field: str | None = None, schema: str = RECORD) -> DataFrame:
    """Each record with what a JSON map file has for its source; a source that is not in the map raises."""
    pairs = jsonl.read_map(spark, mapping, field).withColumnRenamed("key", "source")
    rows = enrich.add_from_map(read_training(spark, input_path, schema), pairs, "source", "value", out)
    if output_path:
        jsonl.write_records(rows, output_path)
    return rows


def distribute(spark: SparkSession, input_dir: str, output_dir: str, num_shards: int = 400, shuffle_shards: bool = False, seed: int = 1337, delete_input: bool = False) -> DataFrame:
    """Lines dealt out one by one to num_shards folders. (shard, line)."""
    return _sharded(spark, input_dir, output_dir, num_shards, seed if shuffle_shards else None, False, delete_input)


def shuffle_lines(spark: SparkSession, input_dir: str, output_dir: str, num_shards: int, seed: int = 1337, delete_input: bool = False) -> DataFrame:
    """All lines in a seeded order, in num_shards shards of (nearly) equal size. (shard, line)."""
    return _sharded(spark, input_dir, output_dir, num_shards, seed, True, delete_input)


def _sharded(spark: SparkSession, input_dir: str, output_dir: str, n: int, seed: int | None, contiguous: bool, delete_input: bool) -> DataFrame:
    lines = jsonl.number_lines(jsonl.read_lines(spark, input_dir, glob="*", recursive=True))
    by: list[str | Column] = ["path", "line_no"] if seed is None else [det_key(seed, "shuffle", "path", "line_no"), "path", "line_no"]
    placed = order.with_ordinal(lines.select("path", "line_no", "line"), *by)
    total = placed.count()
    shard = order.contiguous_shard(F.col("ord0"), F.lit(total), n) if contiguous else order.stride_shard(F.col("ord0"), n)
    out = placed.select(F.format_string("%03d", shard.cast("bigint")).alias("shard"), "ord0", F.col("line").alias("value"))
    out.repartition("shard").sortWithinPartitions("shard", "ord0").drop("ord0").write.partitionBy("shard").option("compression", "gzip").text(output_dir)
    written = spark.read.schema("value STRING, shard INT").text(output_dir)
    if delete_input:
        if written.count() != total:
            raise RuntimeError(f"{output_dir} is not complete; inputs stay")
        drop_dir(spark, input_dir)
    return written.select("shard", F.col("value").alias("line"))


def merge_shuffle(spark: SparkSession, inputs: list[str], output_dir: str, seed: int = 1337, delete_input: bool = False) -> DataFrame:
    """Shards of the same name from several folders become one, mixed. (shard, line)."""
    found = None
    for n, path in enumerate(inputs):
        own = jsonl.number_lines(jsonl.read_lines(spark, path, glob="*", recursive=True)).select(F.regexp_extract("path", r"shard=([^/]+)/", 1).alias("shard"), F.concat_ws("|", F.lit(n), "path", "line_no").alias("id"), "line")
        found = own if found is None else found.unionByName(own)
    placed = order.shuffled_in_shards(found, seed, "shard", "id")
    out = placed.select("shard", "place", F.col("line").alias("value"))
    out.repartition("shard").sortWithinPartitions("shard", "place").drop("place").write.partitionBy("shard").option("compression", "gzip").text(output_dir)
    if delete_input:
        for path in inputs:
            drop_dir(spark, path)
    return spark.read.schema("value STRING, shard STRING").text(output_dir).select("shard", F.col("value").alias("line"))


def restore_sources(spark: SparkSession, input_dir: str, output_dir: str) -> DataFrame:
    """One folder of records for each source. (file, n)."""
    rows = read_training(spark, input_dir)
    jsonl.write_by_source(rows, output_dir)
    return spark.read.schema("query STRING, file STRING").json(output_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def domain_chunks(records: DataFrame, chunk_size: int = 64, strategy: str = "none", seed: int = 22, id_col: str = "rec_id") -> DataFrame:
    """(chunk_no, place, id, copy, domain) of records (id, query, pos, source): chunks of exactly chunk_size in a seeded order.

    Domains are balanced; classification domains give slices of one row for each label (C02), all others collision-free
    chunks (C01), full ones and rests; all of these are packed into bins (C03), of which the full ones come out.
    """
    spark, path = records.sparkSession, work_dir(records.sparkSession)
    rows = records.select(F.col(id_col).alias("id"), "query", F.coalesce("pos", F.array().cast("array<string>")).alias("pos"), F.coalesce("source", F.lit("unknown")).alias("domain"))
    types = sampling.domain_types(records, 200).select("domain", "domain_type", "n")
    if strategy == "none":
        sized = rows.withColumn("copy", F.lit(0).cast("bigint"))
    else:
        sized = sampling.resize(rows, sampling.balance_targets(types.select("domain", "n"), strategy, chunk_size), seed, "id")
    own = staged(order.with_ordinal(sized.join(enrich.small(types.select("domain", "domain_type")), "domain"), "domain", "id", "copy", name="ord"), f"{path}/rows")
    slices = batching.round_robin_groups(own.filter("domain_type = 'classification'").select("domain", "ord", F.get("pos", F.lit(0)).alias("label")), chunk_size)
    chunks = batching.chunkify(own.filter("domain_type <> 'classification'").select("domain", "ord", "query", "pos"), chunk_size)
    name = lambda kind, *cols: F.concat_ws("|", F.lit(kind), *cols)
    members = slices.select(name("s", "domain", "slice", "sub").alias("group_id"), "ord", F.col("place").cast("int").alias("place")).unionByName(
        chunks.select(name("c", "domain", "part", "chunk_no").alias("group_id"), "ord", "place")
    )
    members = staged(members, f"{path}/groups")
    groups = members.groupBy("group_id").agg(F.count(F.lit(1)).cast("int").alias("len"))
    bins = batching.pack_groups(groups, chunk_size, seed).select("group_id", "bin")
    inside = members.join(bins, "group_id").withColumn("place", F.expr("row_number() OVER (PARTITION BY bin ORDER BY group_id, place) - 1")).filter(F.col("place") < chunk_size)
    numbers = order.shuffled_ordinal(bins.select("bin").distinct(), seed, "bin", "chunk_no")
    return inside.join(numbers, "bin").join(own.select("ord", "id", "copy", "domain"), "ord").select("chunk_no", F.col("place").cast("bigint").alias("place"), "id", "copy", "domain")


def prepare_domain_chunks(spark: SparkSession, input_path: str, output_path: str, chunk_size: int = 64, sampling_strategy: str = "none", seed: int = 22) -> DataFrame:
    """The records of a file in chunks, written in the order of chunks. Records are known by their line."""
    lines = jsonl.number_lines(jsonl.read_lines(spark, input_path, glob="*", recursive=True))
    sourced = lines.select("path", "line_no", "line", "file", nz.member(nz.parsed(F.col("line")), "$.source", "string").alias("_source"))
    records = nz.normalise(sourced, "line", "file").withColumn("source", F.col("_source")).drop("_source")
    records = order.with_ordinal(records, "path", "line_no", name="rec_id")
    placed = domain_chunks(records, chunk_size, sampling_strategy, seed)
    out = placed.join(records.select(F.col("rec_id").alias("id"), "query", "pos", "neg", "source"), "id")
    jsonl.write_chunks(out.select("chunk_no", "place", "query", "pos", "neg", "source"), output_path, "chunk_no", "place")
    return placed


def mine_texts(
    records: DataFrame, encoder=None, pool: DataFrame | None = None, lo: int = 10, hi: int = 210, negative_number: int = 15, filter_topk: int | None = None,
    query_instruction: str = "", passage_instruction: str = "", seed: int = 22, id_col: str = "rec_id", exact_pairs: int | None = None,
) -> DataFrame:
    """Records (id, query, pos, neg) with negatives added up to negative_number.

    Records whose query is one of their positives are left out. The corpus is the pool (text), else all positives and
    negatives, each text once. Of a query's neighbours at the places lo..hi-1 (from 0) its positives and the query itself are
    left out; of the rest those with the smallest digests are added. Neighbours are the nearest of the whole corpus, whatever
    its size; only a caller that sets exact_pairs has them from inverted lists beyond that number of pairs. With filter_topk, a
    record that lacks negatives is left out if its nearest positive is farther than the neighbour at that place. Null queries
    and entries take no part.
    """
    spark, path = records.sparkSession, work_dir(records.sparkSession)
    none = F.array().cast("array<string>")
    known = lambda c: F.filter(F.coalesce(c, none), lambda x: x.isNotNull())
    rows = records.filter(F.col("query").isNotNull()).select(F.col(id_col).alias("query_id"), "query", known("pos").alias("pos"), known("neg").alias("neg"))
    rows = rows.filter(~F.array_contains("pos", F.col("query")) & (F.size("pos") > 0)).withColumn("need", F.lit(negative_number) - F.size("neg"))
    texts = pool.select("text").filter("text IS NOT NULL") if pool is not None else rows.select(F.explode(F.concat("pos", "neg")).alias("text"))
    encoder = encoder or retrieval.HashEncoder()
    queries = 0 if exact_pairs is None else rows.filter("need > 0").count()
    corpus = mined.TextLists(texts, path, encoder, passage_instruction, queries, exact_pairs, seed)
    more = mined.with_negatives(spread(rows), corpus, encoder, query_instruction, passage_instruction, lo, hi, filter_topk, seed)
    return more.select(F.col("query_id").alias(id_col), "query", "pos", F.concat("neg", "more").alias("neg"))


def hn_mine(spark: SparkSession, input_file: str, output_file: str, candidate_pool: str | None = None, encoder=None, range_for_sampling: str = "10-210", **options) -> DataFrame:
    """mine_texts over a file of records, written as a file of records."""
    lo, hi = (int(x) for x in range_for_sampling.split("-"))
    rows = order.with_ordinal(read_training(spark, input_file).withColumn("_d", F.md5(F.to_json(F.struct("query", "pos", "neg")))), "_d", name="rec_id")
    found = mine_texts(rows, encoder, None if candidate_pool is None else jsonl.read_pool(spark, candidate_pool), lo, hi, **options)
    jsonl.write_records(found.drop("rec_id"), output_file)
    return found
