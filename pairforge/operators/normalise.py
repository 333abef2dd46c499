"""Raw lines of mixed shape to the fixed record schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes that make a file a triplet file.
TRIPLET_TYPES = ("Triplets", "Query-Triplets")


def _none() -> Column:
    return F.array().cast("array<string>")


def parsed(line: Column) -> Column:
    """VARIANT; null for blank and malformed lines."""
    return F.try_parse_json(F.trim(line))


def kind(variant: Column) -> Column:
    """ARRAY, OBJECT, STRING or another scalar's type; null if malformed."""
    return F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)


def member(variant: Column, path: str, as_type: str) -> Column:
    return F.try_variant_get(variant, path, as_type)


def _strings(variant: Column, path: str) -> Column:
    """The elements of a list as strings, scalars spelled out (F24), nulls left out; null if it is no list."""
    return F.filter(member(variant, path, "array<string>"), lambda x: x.isNotNull())


def _only_strings(variant: Column, path: str) -> Column:
    """The elements of a list that are strings; null if it is no list."""
    items = F.filter(member(variant, path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(items, lambda x: F.variant_get(x, "$", "string"))


def _is(variant: Column, path: str, what: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(member(variant, path, "variant")), F.lit(what)), F.lit(False))


def _has(variant: Column, key: str) -> Column:
    """Is the key there? A JSON null counts as there."""
    return F.coalesce(member(variant, f"$.{key}", "variant").isNotNull(), F.lit(False))


def _texts(variant: Column, path: str) -> Column:
    """A list's elements, or a single string as a list; else none."""
    single = F.when(_is(variant, path, "STRING"), F.array(member(variant, path, "string")))
    return F.coalesce(F.when(_is(variant, path, "ARRAY"), _strings(variant, path)), single, _none())


def record_of(variant: Column) -> Column:
    """struct(query, pos, neg), or null where the line gives no record.

    Lists of two and three are pairs and triplets; an object's query comes before its set; a set's first string is the
    query. Dropped: null or empty queries (a null is no text, unlike in the tool that this follows), no positives.
    """
    items = member(variant, "$", "array<string>")
    is_list, is_object = kind(variant) == "ARRAY", kind(variant) == "OBJECT"
    of_list = F.when(
        F.size(items).isin(2, 3),
        F.struct(items[0].alias("query"), F.array_compact(F.slice(items, 2, 1)).alias("pos"), F.array_compact(F.slice(items, 3, 1)).alias("neg")),
    )
    of_query = F.struct(member(variant, "$.query", "string").alias("query"), _texts(variant, "$.pos").alias("pos"), _texts(variant, "$.neg").alias("neg"))
    members = _only_strings(variant, "$.set")
    of_set = F.when(F.size(members) >= 2, F.struct(members[0].alias("query"), F.slice(members, F.lit(2), F.size(members)).alias("pos"), _none().alias("neg")))
    rec = F.when(is_list, of_list).when(is_object & _has(variant, "query"), of_query).when(is_object & _has(variant, "set"), of_set)
    return F.when((rec["query"] != "") & (F.size(rec["pos"]) > 0), rec)


def normalise(lines: DataFrame, line: str = "raw_line", source: str = "file", mode: str = "drop") -> DataFrame:
    """(..., query, pos, neg, source): the records of raw lines.

    mode: drop leaves out lines without a record; quarantine keeps them with a null query; fail raises on malformed
    lines that are not blank.
    """
    v = lines.withColumn("_v", parsed(F.col(line)))
    if mode == "fail":
        blank = F.trim(line) == ""
        v = v.withColumn("_v", F.when(F.col("_v").isNull() & ~blank, F.raise_error(F.concat(F.lit("malformed line: "), F.col(line)))).otherwise(F.col("_v")))
    out = v.withColumn("_r", record_of(F.col("_v"))).drop("_v")
    if mode == "drop":
        out = out.filter(F.col("_r").isNotNull())
    return out.select(*[c for c in lines.columns if c not in (line, source)], "_r.query", "_r.pos", "_r.neg", F.col(source).alias("source"))


def quarantine(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """The lines that are neither blank nor JSON, with all their columns."""
    return lines.filter((F.trim(line) != "") & parsed(F.col(line)).isNull())


def all_texts(variant: Column) -> Column:
    """Every string of a record, of whatever shape; an empty list if it has none."""
    whole = F.when(kind(variant) == "STRING", F.array(member(variant, "$", "string"))).when(kind(variant) == "ARRAY", _only_strings(variant, "$"))
    part = lambda k: F.coalesce(
        F.when(_is(variant, f"$.{k}", "STRING"), F.array(member(variant, f"$.{k}", "string"))), _only_strings(variant, f"$.{k}"), _none()
    )
    fields = F.when(kind(variant) == "OBJECT", F.concat(*[part(k) for k in ("query", "pos", "neg", "set")]))
    return F.coalesce(whole, fields, _none())


def shape_of(variant: Column) -> Column:
    """The shape's name by precedence, or null."""
    n = F.size(member(variant, "$", "array<variant>"))
    is_list, is_object = kind(variant) == "ARRAY", kind(variant) == "OBJECT"
    has = {k: _has(variant, k) for k in ("query", "pos", "neg", "set")}
    return (
        F.when(is_list & (n == 3), "Triplets")
        .when(is_list & (n == 2), "Pairs")
        .when(is_object & has["query"] & _is(variant, "$.pos", "ARRAY") & _is(variant, "$.neg", "ARRAY"), "Query-Triplets")
        .when(is_object & has["set"], "Sets")
        .when(is_object & has["query"] & has["pos"], "Query-Pairs")
    )


def only_triplets(lines: DataFrame, limit: int = 1000, file: str = "file", order: str = "line_no", line: str = "raw_line") -> DataFrame:
    """(file, only_triplets) by the first `limit` lines of each file that are not blank; bad JSON and no lines are false."""
    first = lines.filter(F.trim(line) != "").withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY {file} ORDER BY {order}, {line})")).filter(F.col("_n") <= limit)
    good = F.coalesce(shape_of(parsed(F.col(line))).isin(*TRIPLET_TYPES), F.lit(False))
    judged = first.groupBy(file).agg(F.bool_and(good).alias("only_triplets"))
    return lines.select(file).distinct().join(judged, file, "left").select(file, F.coalesce("only_triplets", F.lit(False)).alias("only_triplets"))


def valid_pair() -> Column:
    """Pos and neg both have entries."""
    return F.coalesce(F.size("pos") > 0, F.lit(False)) & F.coalesce(F.size("neg") > 0, F.lit(False))


def not_cls() -> Column:
    """Any task but [CLS]; a missing one passes."""
    return ~F.col("task").eqNullSafe("[CLS]")


def query_not_positive() -> Column:
    """The query is none of its own positives."""
    return ~F.coalesce(F.array_contains("pos", F.col("query")), F.lit(False))


def clean_negatives() -> Column:
    """Negatives without repeats, without the query and without positives."""
    return F.array_except(F.array_distinct(F.coalesce("neg", _none())), F.concat(F.coalesce("pos", _none()), F.array("query")))


def expand_positives(records: DataFrame) -> DataFrame:
    """One row for each positive, with all negatives."""
    rest = [c for c in records.columns if c not in ("pos", "neg")]
    return records.select(*rest, F.posexplode("pos").alias("pos_no", "_p"), "neg").select(*rest, "pos_no", F.array("_p").alias("pos"), "neg")


def skip_counters(records: DataFrame, allowed: list[str]) -> DataFrame:
    """By source, how many rows a curation keeps and why it leaves out the others."""
    ok_source, ok = F.col("source").isin(*allowed), valid_pair()
    return records.groupBy("source").agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~ok_source).alias("skipped_source"),
        F.count_if(ok_source & ~ok).alias("skipped_invalid"),
        F.count_if(ok_source & ok).alias("kept"),
    )
