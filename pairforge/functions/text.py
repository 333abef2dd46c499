"""String and template functions over columns. Ids of the inventory are named in each docstring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The instruction template and the task tags of benchmark task types.
INSTRUCT = "Instruct: {d}\nQuery: {query}"
TASK_TAGS = {
    "Classification": "[CLS]",
    "Clustering": "[CLS]",
    "Retrieval": "[RETR]",
    "Reranking": "[RETR]",
    "STS": "[STS]",
    "BitextMining": "[STS]",
    "PairClassification": "[STS]",
    "MultilabelClassification": "[CLS]",
    "Regression": "[CLS]",
    "InstructionRetrieval": "[RETR]",
    "Summarization": "[STS]",
}


def instruction_template(description: Column) -> Column:
    """a description as a template with a place for the query."""
    return F.replace(F.lit(INSTRUCT), F.lit("{d}"), description)


def fill_query(template: Column, query: Column) -> Column:
    """the query in the template's place, other braces untouched; without a template the query itself."""
    return F.when(template.isNull(), query).otherwise(F.replace(template, F.lit("{query}"), query))


def instruct_once(template: Column, query: Column) -> Column:
    """as fill_query, but a text that already holds an instruction stays (decided for each row)."""
    return F.when(query.contains("Instruct:"), query).otherwise(fill_query(template, query))


def cross_text(instruct: Column, query: Column, document: Column) -> Column:
    """one text for a cross-encoder; without an instruction only query and document."""
    both = F.concat(F.lit("Query: "), query, F.lit("\nDocument: "), document)
    return F.when(instruct.isNull(), both).otherwise(F.concat(F.lit("Instruct: "), instruct, F.lit("\nDocument: "), document, F.lit("\nQuery: "), query))


def offline_document(instruct: Column, document: Column) -> Column:
    """the part of a rerank text that can be encoded before the query is known."""
    return F.concat(F.lit("Instruct: "), instruct, F.lit("\nDocument: "), document)


def prefixed(prefix: Column, text: Column) -> Column:
    """an instruction straight before a text; a null prefix is none."""
    return F.concat(F.coalesce(prefix, F.lit("")), text)


def corpus_text(title: Column, text: Column) -> Column:
    """Title and text with one blank between, trimmed."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def strip_gz(name: Column) -> Column:
    """A file name without a final .gz."""
    return F.regexp_replace(name, r"\.gz$", "")


def stem(name: Column) -> Column:
    """A name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def task_tag(task_type: Column) -> Column:
    """The tag of a task type; null for an unknown one."""
    return F.create_map(*[F.lit(x) for kv in TASK_TAGS.items() for x in kv])[task_type]


def memory_text(n_bytes: Column) -> Column:
    """bytes with a readable unit."""
    unit = lambda k, name: F.format_string(f"%.2f {name}", n_bytes / float(1024**k))
    return F.when(n_bytes < 1024, F.format_string("%d B", n_bytes)).when(n_bytes < 1024**2, unit(1, "KB")).when(n_bytes < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def percent_text(share: Column) -> Column:
    """a share as percent with two digits; n/a if null."""
    return F.when(share.isNull(), "n/a").otherwise(F.format_string("%.2f%%", share * 100))


def parse_range(spec: Column) -> Column:
    """'lo-hi' as a struct."""
    parts = F.split(spec, "-")
    return F.struct(parts[0].cast("int").alias("lo"), parts[1].cast("int").alias("hi"))


def parse_indices(spec: Column, n: Column) -> Column:
    """'0, 5,-1' as indices below n, negative ones counted from the end; one out of bounds raises."""
    raw = F.transform(F.split(spec, ","), lambda x: F.trim(x).cast("int"))
    fixed = F.transform(raw, lambda i: F.when(i < 0, n + i).otherwise(i))
    bad = F.exists(fixed, lambda i: (i < 0) | (i >= n))
    return F.when(bad, F.raise_error(F.concat(F.lit("index out of bounds: "), spec))).otherwise(fixed)
