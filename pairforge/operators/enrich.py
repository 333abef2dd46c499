"""Lookups by source and task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A lookup table up to this many rows is sent to every executor; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Numbers and loss weights of the tasks.
TASK_IDS = {"[CLS]": 0, "[RETR]": 1, "[STS]": 2}
TASK_WEIGHTS = {"[CLS]": 1.0, "[RETR]": 1.0, "[STS]": 1.0}


def small(lookup: DataFrame) -> DataFrame:
    """The table, marked for broadcast if its counted size allows it."""
    return F.broadcast(lookup) if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lookup


def add_from_map(records: DataFrame, mapping: DataFrame, key: str, value: str, out: str, strict: bool = True) -> DataFrame:
    """The value that the mapping has for a record's key.

    mapping: (key, value). strict: a missing key or a null record key raises and names it; else the result is null.
    """
    m = mapping.select(F.col(key).alias("_k"), F.col(value).alias("_value"), F.lit(True).alias("_found"))
    joined = records.join(small(m), records[key] == F.col("_k"), "left")
    got = F.col("_value")
    if strict:
        got = F.when(F.col("_found"), got).otherwise(F.raise_error(F.concat(F.lit("no mapping for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return joined.withColumn(out, got).drop("_k", "_value", "_found")


def allowed_sources(records: DataFrame, allowed: DataFrame) -> DataFrame:
    """The records whose source is in the list (source)."""
    return records.join(small(allowed.select("source").distinct()), "source", "left_semi")


def flag_sources(records: DataFrame, listed: DataFrame, flag: str) -> DataFrame:
    """Whether the source is in the list."""
    marks = listed.select("source").distinct().withColumn(flag, F.lit(True))
    return records.join(small(marks), "source", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def task_numbers(records: DataFrame) -> DataFrame:
    """Number and weight of the task; null for none."""
    of = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("task")]
    return records.withColumn("task_id", of(TASK_IDS)).withColumn("task_weight", of(TASK_WEIGHTS))


def dense_source_ids(records: DataFrame) -> DataFrame:
    """Numbers from 0 by the sorted distinct sources. Ranked over the distinct values, not over the rows."""
    names = records.select("source").filter(F.col("source").isNotNull()).distinct()
    numbers = names.withColumn("source_id", F.expr("CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT)"))
    return records.join(small(numbers), "source", "left")


def row_id(sample_id: str = "sample_id", other: str = "rec_id"):
    """P20: the upstream id, else our own, as a string."""
    return F.coalesce(F.col(sample_id), F.col(other).cast("string"))


def filter_task_types(scores: DataFrame, types: list[str]) -> DataFrame:
    """The scores of the given task types; none of them raises."""
    kept = scores.filter(F.col("task_type").isin(*types))
    if kept.isEmpty():
        raise ValueError(f"no task has one of the types {types}")
    return kept


def task_instruction(tasks: DataFrame, by_type: dict[str, str] | None = None, by_task: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Adds `instruction`, a template, to tasks (task_name, task_type): by type and name without version, else by
    type; an unknown type has the empty one.
    """
    from pairforge.functions.instructions import BY_TASK, BY_TYPE
    from pairforge.functions.text import instruction_template, stem

    by_type, by_task = BY_TYPE if by_type is None else by_type, BY_TASK if by_task is None else by_task
    as_map = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<string,string>")
    own = as_map({f"{t}|{n}": i for (t, n), i in by_task.items()})[F.concat_ws("|", "task_type", stem(F.col("task_name")))]
    told = F.coalesce(own, as_map(by_type)[F.col("task_type")])
    return tasks.withColumn("instruction", F.when(told.isNull(), "").otherwise(instruction_template(told)))
