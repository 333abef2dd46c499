"""The query registry: name -> (Spark callable, DuckDB twin or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Queries in the order of their registration."""

    runs: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)
    ops: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def query(self, name: str, *ops: str, oracle: str | None = None) -> Callable[[Query], Query]:
        """Decorator. ops: the inventory ids that the query exercises; oracle: SQL over the same tables."""

        def add(run: Query) -> Query:
            if name in self.runs:
                raise ValueError(f"query {name} is registered twice")
            self.runs[name] = run
            self.ops[name] = ops
            if oracle is not None:
                self.oracles[name] = oracle
            return run

        return add


CORE = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; a table is a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
