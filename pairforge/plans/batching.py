"""Chunks, groups, bins and token batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.functions import tokens as tk
from pairforge.operators import batching, order
from pairforge.registry import CORE, table

CTX, CHUNK = 1024, 512


@CORE.query("chunkify_collision_free", "C01", "P27", "U04", "U05", "U06")
def chunkify_collision_free(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalised").select(F.coalesce("source", F.lit("unknown")).alias("domain"), F.col("rec_id").alias("ord"), "query", "pos")
    return batching.chunkify(rows)


@CORE.query("chunk_split", "C04")
def chunk_split(spark: SparkSession, sf: str) -> DataFrame:
    chunks = batching.full_chunks(chunkify_collision_free(spark, sf), 64)
    return chunks.groupBy("domain", "is_full").agg(F.count(F.lit(1)).alias("n"))


@CORE.query(
    "stratified_round_robin", "C02", "W01", "W02", "W03", "A09", "A10",
    oracle="""WITH r AS (SELECT coalesce(source, 'unknown') AS domain, rec_id AS ord, pos[1] AS label FROM normalised WHERE coalesce(pos[1], '') <> ''
    ), l AS (SELECT domain, label, count(*) AS n, min(ord) AS first FROM r GROUP BY ALL
    ), d AS (SELECT domain, CASE WHEN count(*) IN (2, 3) THEN min(n) ELSE CAST(floor(round(quantile_cont(n, 0.8), 9)) AS BIGINT) END AS depth FROM l GROUP BY 1
    ), s AS (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY ord) - 1 AS slice FROM r
    ), p AS (SELECT s.*, row_number() OVER (PARTITION BY domain, slice ORDER BY first, label) - 1 AS rn, count(*) OVER (PARTITION BY domain, slice) AS k
      FROM s JOIN l USING (domain, label) JOIN d USING (domain) WHERE slice < depth)
    SELECT domain, slice, rn // 64 AS sub, rn % 64 AS place, ord, label FROM p WHERE k >= 2""",
)
def stratified_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalised").select(F.coalesce("source", F.lit("unknown")).alias("domain"), F.col("rec_id").alias("ord"), F.get("pos", F.lit(0)).alias("label"))
    return batching.round_robin_groups(rows)


@CORE.query("pack_best_fit", "C03", "O07")
def pack_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_shipdate").alias("d")).agg(F.count(F.lit(1)).cast("int").alias("len"))
    return batching.pack_groups(groups.select(F.concat_ws("|", "s", F.col("d").cast("string")).alias("group_id"), "len"))


#: DuckDB: byte tokens of documents; empty for null and empty texts.
TOK = """WITH tok AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(list_transform(range(octet_length(encode(text))), lambda i: CAST(('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) + 1), CAST([] AS INTEGER[])) AS ids FROM documents)"""


def _tok(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tk.byte_ids(F.col("text")).alias("ids"))


@CORE.query("tokenize_bytes", "F51", "F52", "F66", oracle=TOK + " SELECT doc_id, ids FROM tok")
def tokenize_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return _tok(spark, sf)


@CORE.query("tokenize_trie_roundtrip", "F51", "F52", "F53", "F54", "F55", "S20", "S21", "S22", oracle="SELECT doc_id, coalesce(text, '') AS text FROM documents")
def tokenize_trie_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = tk.Vocabulary.bytewise(b"the ", b"ing", b" of", "的".encode(), "é".encode())
    docs = table(spark, sf, "documents").select("doc_id", tk.trie_encode(vocabulary, add_eos=True)(F.col("text")).alias("ids"))
    return docs.select("doc_id", tk.trie_decode(vocabulary)(F.col("ids")).alias("text"))


_SPREAD = "flatten(list_transform(range({n}), lambda i: list_concat(own[CAST(i * {per} + 1 AS BIGINT) : CAST((i + 1) * {per} AS BIGINT)], [65535])))"


@CORE.query(
    "eos_chunk_pretrain", "F57", "F50", "F36", "W15",
    oracle=TOK + f""", o AS (SELECT doc_id, ids[greatest(1, len(ids) - {CTX - 2} + 1):] AS own FROM tok
    ), b AS (SELECT doc_id, CASE WHEN len(own) >= {CHUNK} THEN {_SPREAD.format(n=2, per='greatest(1, ceil(len(own) / 2))')} ELSE list_concat(own, [65535], own, [65535]) END AS b FROM o)
    SELECT doc_id, CASE WHEN len(b) >= {CTX} THEN b ELSE list_concat(list_transform(range({CTX} - len(b)), lambda i: 0), b) END AS ids, [true, true] AS eos_mask FROM b""",
)
def eos_chunk_pretrain(spark: SparkSession, sf: str) -> DataFrame:
    return _tok(spark, sf).select("doc_id", tk.eos_pretrain(F.col("ids"), CTX, CHUNK).alias("x")).select("doc_id", "x.ids", "x.eos_mask")


@CORE.query(
    "eos_chunk_sft", "F58", "F59", "F63",
    oracle=TOK + f""", o AS (SELECT doc_id, ids[greatest(1, len(ids) - {CTX - 2} + 1):] AS own FROM tok
    ), n AS (SELECT *, CAST(greatest(1, ceil(len(own) / {CHUNK})) AS BIGINT) AS n FROM o
    ), b AS (SELECT doc_id, CASE WHEN len(own) = 0 THEN [65535, 65535] WHEN n = 1 THEN list_concat([65535], own, [65535])
        ELSE {_SPREAD.format(n=2, per='ceil(len(own) / 2)')} END AS b, CASE WHEN len(own) = 0 THEN [false, false] ELSE [n = 2, true] END AS eos_mask FROM n)
    SELECT doc_id, CASE WHEN len(b) >= {CTX} THEN b ELSE list_concat(list_transform(range({CTX} - len(b)), lambda i: 0), b) END AS ids, eos_mask FROM b""",
)
def eos_chunk_sft(spark: SparkSession, sf: str) -> DataFrame:
    return _tok(spark, sf).select("doc_id", tk.eos_sft(F.col("ids"), CTX, CHUNK).alias("x")).select("doc_id", "x.ids", "x.eos_mask")


@CORE.query(
    "eos_chunk_eval", "F60", "C09",
    oracle=TOK + f""", o AS (SELECT doc_id, ids[1:{8 * CTX}] AS own FROM tok
    ), n AS (SELECT *, len(own) > {CTX - 2} AS is_long, CAST(ceil(len(own) / {CTX}) AS BIGINT) AS splits FROM o
    ), s AS (SELECT doc_id, 0 AS k, own, 1 AS splits FROM n WHERE NOT is_long
      UNION ALL SELECT doc_id, k, own[CAST(k * ceil(len(own) / splits) + 1 AS BIGINT) : CAST((k + 1) * ceil(len(own) / splits) AS BIGINT)], splits FROM (SELECT *, unnest(range(splits)) AS k FROM n WHERE is_long)
    ), b AS (SELECT doc_id, k, splits, CASE WHEN len(own) >= {CHUNK} OR splits > 1 THEN {_SPREAD.format(n=2, per='greatest(1, ceil(len(own) / 2))')} ELSE list_concat(own, [65535], own, [65535]) END AS b FROM s)
    SELECT doc_id, flatten(list(b ORDER BY k)) AS ids, 2 * max(splits) AS n_eos FROM b GROUP BY doc_id""",
)
def eos_chunk_eval(spark: SparkSession, sf: str) -> DataFrame:
    x = _tok(spark, sf).select("doc_id", tk.eos_eval(F.col("ids"), CTX, CHUNK).alias("x"))
    return x.select("doc_id", "x.ids", F.size("x.eos_mask").cast("bigint").alias("n_eos"))


def _batched(spark: SparkSession, sf: str, size: int) -> DataFrame:
    x = _tok(spark, sf).select("doc_id", tk.eos_eval(F.col("ids"), CTX, CHUNK).alias("x"))
    return batching.microbatches(order.with_ordinal(x, "doc_id"), size)


def _pad_sql(kept: str) -> str:
    return f"""WITH n AS (SELECT doc_id, least(coalesce(octet_length(encode(text)), 0), {8 * CTX}) AS own, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id, count(*) OVER () AS total FROM documents
    ), s AS (SELECT *, CASE WHEN own > {CTX - 2} THEN CAST(ceil(own / {CTX}) AS INTEGER) ELSE 1 END AS splits FROM n WHERE {kept}
    ), l AS (SELECT batch_id, doc_id, 2 * splits AS k, CASE WHEN own < {CHUNK} THEN 2 * (own + 1) ELSE own + 2 * splits END AS len FROM s
    ), w AS (SELECT *, max(k) OVER (PARTITION BY batch_id) AS most, max(len) OVER (PARTITION BY batch_id) AS longest FROM l)
    SELECT batch_id, doc_id, CAST(greatest(len + most - k, longest) AS INTEGER) AS n_ids, CAST(most AS INTEGER) AS n_eos, CAST(k AS INTEGER) AS n_on FROM w"""


@CORE.query("batch_pad", "F61", "A28", oracle=_pad_sql("(batch_id + 1) * 32 <= total"))
def batch_pad(spark: SparkSession, sf: str) -> DataFrame:
    b = _batched(spark, sf, 32)
    w = b.groupBy("batch_id").agg(F.max(F.size("x.ids")).alias("longest"), F.max(F.size("x.eos_mask")).alias("most"))
    return _padded(b.join(w, "batch_id"))


def _padded(b: DataFrame) -> DataFrame:
    full = b.select("batch_id", "doc_id", tk.batch_pad(F.col("x.ids"), F.col("x.eos_mask"), F.col("most"), F.col("longest")).alias("p"))
    return full.select("batch_id", "doc_id", F.size("p.ids").alias("n_ids"), F.size("p.eos_mask").alias("n_eos"), F.size(F.filter("p.eos_mask", lambda m: m)).alias("n_on"))


@CORE.query("batch_pad_all", "F61", "A28", oracle=_pad_sql("true"))
def batch_pad_all(spark: SparkSession, sf: str) -> DataFrame:
    """Batches as an evaluation makes them: the last one may be smaller, and no document is left out."""
    # Texts are numbered and moved, not their tokens, which are several times as large.
    docs = order.with_ordinal(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").withColumn("batch_id", F.floor(F.col("ord0") / 32))
    x = docs.repartition("batch_id").select("batch_id", "doc_id", tk.byte_ids(F.col("text")).alias("ids"))
    b = x.select("batch_id", "doc_id", tk.eos_eval(F.col("ids"), CTX, CHUNK).alias("x"))
    batch = Window.partitionBy("batch_id")  # 32 rows at most
    return _padded(b.withColumns({"longest": F.max(F.size("x.ids")).over(batch), "most": F.max(F.size("x.eos_mask")).over(batch)}))


@CORE.query(
    "microbatch_drop_last", "C06", "W11",
    oracle="SELECT doc_id, batch_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 48 AS batch_id, count(*) OVER () AS n FROM documents) WHERE (batch_id + 1) * 48 <= n",
)
def microbatch_drop_last(spark: SparkSession, sf: str) -> DataFrame:
    return batching.microbatches(order.with_ordinal(table(spark, sf, "documents").select("doc_id"), "doc_id"), 48).select("doc_id", "batch_id")


@CORE.query("length_buckets", "C07", "C08", oracle="SELECT coalesce(octet_length(encode(text)), 0) // 64 AS bucket, count(*) AS n FROM documents GROUP BY 1")
def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    return batching.length_buckets(rows, "n_bytes").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@CORE.query(
    "cross_encode", "F62",
    oracle=TOK + """, c AS (SELECT doc_id, CASE WHEN ids[-1] = 65535 THEN ids ELSE list_append(ids, 65535) END AS c FROM tok
    ), p AS (SELECT doc_id, CASE WHEN len(c) >= 2048 THEN c ELSE list_concat(list_transform(range(2048 - len(c)), lambda i: 0), c) END AS p FROM c)
    SELECT doc_id, p[len(p) - 2047:] AS ids FROM p""",
)
def cross_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _tok(spark, sf).select("doc_id", tk.cross_encode(F.col("ids"), 2048).alias("ids"))


@CORE.query(
    "token_totals", "A24",
    oracle="SELECT source, sum(coalesce(octet_length(encode(text)), 0)) AS tokens, max(coalesce(octet_length(encode(text)), 0)) AS longest FROM documents GROUP BY source",
)
def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(n).alias("tokens"), F.max(n).alias("longest"))
