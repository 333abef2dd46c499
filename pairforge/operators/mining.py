"""Negatives from other records (B22, J09, J10), and hard-negative mining over vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.rand import det_key, key_int
from pairforge.operators.enrich import small
from pairforge.operators.order import with_ordinal
from pairforge.operators.skew import hot_join


def mixed_negatives(records: DataFrame, n_medium: int, n_hard: int, seed: int, id_col: str = "rec_id") -> DataFrame:
    """(id, hard, medium) of records with a query and positives.

    Hard: the first n_hard own negatives. Medium: first positives of the n_medium records that follow in a seeded circular
    order of the source, without those of the same query or positive. The neighbour in a circle is an equi-join, so that no
    source is paired with itself; places are counted within salts of the source, of which a source has as many as the
    shuffle has partitions.
    """
    spark = records.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.array().cast("array<string>")
    rows = records.filter(F.col("query").isNotNull() & (F.size("pos") > 0)).select(
        id_col, "query", "source", F.get("pos", F.lit(0)).alias("positive"), F.slice(F.coalesce("neg", none), 1, n_hard).alias("hard")
    )
    keyed = rows.filter(F.col("positive").isNotNull() & F.col("source").isNotNull()).select(id_col, "query", "source", "positive", det_key(seed, "medium", id_col).alias("key"))
    keyed = keyed.withColumn("salt", F.floor(key_int(F.col("key")) * salts / F.lit(2**32)).cast("int"))
    counts = keyed.groupBy("source", "salt").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("before", F.expr("coalesce(sum(c) OVER (PARTITION BY source ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    counts = counts.withColumn("size", F.expr("sum(c) OVER (PARTITION BY source)"))
    slots = keyed.withColumn("nth", F.expr(f"row_number() OVER (PARTITION BY source, salt ORDER BY key, {id_col})")).join(counts, ["source", "salt"])
    slots = slots.select(id_col, "query", "source", "positive", (F.col("before") + F.col("nth") - 1).alias("place"), "size")
    asked = slots.select(id_col, "query", "source", F.col("positive").alias("own"), "place", "size", F.explode(F.sequence(F.lit(1), F.lit(n_medium))).alias("i"))
    asked = asked.withColumn("place", F.pmod(F.col("place") + F.col("i"), F.col("size")))
    other = slots.select("source", "place", F.col("query").alias("q2"), F.col("positive").alias("p2"))
    got = asked.join(other, ["source", "place"]).filter((F.col("q2") != F.col("query")) & (F.col("p2") != F.col("own")))
    medium = got.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p2"))), lambda x: x["p2"]).alias("medium"))  # n_medium at most
    return rows.join(medium, id_col, "left").select(id_col, "hard", F.coalesce("medium", none).alias("medium"))


def topped_negatives(records: DataFrame, n_easy: int, n_medium: int, n_hard: int, seed: int, id_col: str = "rec_id") -> DataFrame:
    """(id, easy, medium, hard) of records with a query and positives, together n_easy + n_medium + n_hard texts.

    Hard: the first n_hard own negatives. Medium: texts (positives or negatives) that records of the same source and another
    query have. Easy: texts of any record; what hard and medium lack is drawn as easy ones. None equals the first positive.
    Fewer come out only where the whole table has no more texts. Null entries are left out; a null source is one source.

    Distinct texts of a source lie in one order in which those that a single query has are neighbours. So what a record may
    not draw is a few ranges of places, and its draws are places among the rest, none of which fails.
    """
    none = F.array().cast("array<string>")
    entries = lambda c: F.filter(F.coalesce(c, none), lambda x: x.isNotNull())
    base = records.filter(F.col("query").isNotNull()).select(id_col, F.coalesce("source", F.lit("")).alias("source"), F.unhex(F.md5("query")).alias("q"), "pos", "neg")
    texts = base.select("source", "q", F.explode(F.concat(entries("pos"), entries("neg"))).alias("text"))
    texts = texts.groupBy("source", F.unhex(F.md5("text")).alias("t")).agg(F.min("q").alias("lo"), F.max("q").alias("hi"), F.min("text").alias("text"))
    texts = texts.select("source", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(b"")).alias("owner"), "t", "text")
    texts = with_ordinal(texts, "source", "owner", "t")
    total = texts.count()
    spans = texts.groupBy("source").agg(F.min("ord0").alias("first"), F.count(F.lit(1)).alias("size"))  # a row for each source

    rows = base.filter(F.size("pos") > 0).select(id_col, "source", "q", F.unhex(F.md5(F.get(entries("pos"), F.lit(0)))).alias("t"), F.slice(entries("neg"), 1, n_hard).alias("hard"))
    rows = rows.withColumns({"of": F.unhex(F.md5(F.concat_ws("|", F.hex("q"), "source"))), "t": F.coalesce("t", F.lit(b""))})
    asked = rows.select(id_col, "source", "of", "t", F.size("hard").alias("n_hard"))
    span = F.struct(F.min("ord0").alias("at"), F.count(F.lit(1)).alias("n"))
    blocks = texts.filter(F.octet_length("owner") > 0).groupBy(F.unhex(F.md5(F.concat_ws("|", F.hex("owner"), "source"))).alias("of")).agg(span.alias("block"))
    places = texts.groupBy("t").agg(F.sort_array(F.collect_list(F.struct(F.col("ord0").alias("at"), F.lit(1).cast("bigint").alias("n"), "source"))).alias("places"))  # one for each source at most
    asked = hot_join(asked, asked.select("of").distinct().join(blocks, "of", "left"), "of")
    asked = hot_join(asked, asked.select("t").distinct().join(places, "t", "left"), "t").join(small(spans), "source", "left")

    kind = "array<struct<at:bigint,n:bigint>>"
    everywhere = F.coalesce(F.transform("places", lambda x: F.struct(x["at"], x["n"])).cast(kind), F.array().cast(kind))
    at, n, b = F.col("block.at"), F.col("block.n"), F.col("block")
    inside = F.transform(F.filter("places", lambda x: (x["source"] == F.col("source")) & (b.isNull() | (x["at"] < at) | (x["at"] >= at + n))), lambda x: F.struct(x["at"], x["n"]))
    here = F.array_sort(F.concat(F.coalesce(inside.cast(kind), F.array().cast(kind)), F.when(b.isNotNull(), F.array(b).cast(kind)).otherwise(F.array().cast(kind))))
    length = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    asked = asked.select(id_col, "n_hard", here.alias("here"), everywhere.alias("everywhere"), F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("size", F.lit(0)).alias("size"))
    asked = asked.withColumns({"left_m": F.col("size") - length("here"), "left_e": F.lit(total) - length("everywhere")})
    asked = asked.withColumn("take_m", F.least(F.lit(n_medium), "left_m"))
    asked = asked.withColumn("take_e", F.least(F.lit(n_easy + n_medium + n_hard) - F.col("n_hard") - F.col("take_m"), "left_e"))

    def draws(salt: str, take: str, left: str, first: Column, out: str) -> Column:
        """One place in each of `take` equal parts of the places left, counted from the record's own start."""
        free, part = F.greatest(left, F.lit(1)), F.greatest(F.floor(F.col(left) / F.greatest(take, F.lit(1))), F.lit(1))
        start = key_int(det_key(seed, salt, id_col))

        def place(i: Column) -> Column:
            nth = F.pmod(start + i * part + F.pmod(key_int(det_key(seed, salt, F.col(id_col), i)), part), free)
            return F.aggregate(out, first + nth, lambda p, x: F.when(p >= x["at"], p + x["n"]).otherwise(p))

        return F.when(F.col(take) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col(take), F.lit(1)).cast("bigint") - 1), place)).otherwise(F.array().cast("array<bigint>"))

    drawn = asked.select(id_col, draws("easy", "take_e", "left_e", F.lit(0).cast("bigint"), "everywhere").alias("easy"), draws("medium", "take_m", "left_m", F.col("first"), "here").alias("medium"))
    marked = lambda c: F.transform(c, lambda x, i: F.struct(F.lit(c).alias("kind"), i.alias("i"), x.alias("ord0")))
    drawn = drawn.select(id_col, F.explode(F.concat(marked("easy"), marked("medium"))).alias("d")).select(id_col, "d.*")
    got = drawn.join(texts.select("ord0", "text"), "ord0").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("kind", "i", "text"))).alias("got"))  # as many as asked for
    of = lambda k: F.coalesce(F.transform(F.filter("got", lambda x: x["kind"] == k), lambda x: x["text"]), none).alias(k)
    return rows.select(id_col, "hard").join(got, id_col, "left").select(id_col, of("easy"), of("medium"), "hard")
