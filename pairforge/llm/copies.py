"""Problem 1: records that are the same text in another dress, counted in an incremental ledger.

The canonical key of a record is a 128-bit digest of the sorted collection of its stripped query and pos entries.
The ledger is a bucketed table (key, n_copies, first_id). Each batch is aggregated to one row for each key (with partial
aggregation before the shuffle, so a key that holds a third of all rows costs no more than any other), full-outer-joined
to the ledger bucket by bucket, and the sums and the earliest representative are written as the next version. The
ledger's side of that join is read by its buckets and never shuffled again.

Defined results: a null or blank query, and null, empty or blank pos, give no key; such a record is a copy of nothing and
counts as itself. Repeated rows of one id are the caller's error (ids are unique). An empty table gives an empty ledger.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.session import drop_dir, path_exists, staged, work_dir
from pairforge.sources.jsonl import write_file

#: Left out of every text: white space of any kind (no-break and zero-width included) and Unicode punctuation.
IGNORED = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}\x{180e}\x{200b}-\x{200d}\x{2060}\x{feff}\p{P}]+"


def stripped(text: Column) -> Column:
    """The text without white space and punctuation, its case folded (sharp s as ss, final sigma as sigma)."""
    lower = F.lower(F.regexp_replace(text, IGNORED, ""))
    return F.replace(F.replace(lower, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def canonical_key(query: Column, pos: Column) -> Column:
    """BINARY(16), or null where the query or all of pos have nothing left. Order within pos is irrelevant, multiplicity is not."""
    q = stripped(query)
    kept = F.filter(F.transform(pos, stripped), lambda x: x.isNotNull() & (x != ""))
    joined = F.array_join(F.array_sort(F.concat(F.array(q), kept)), "\x1f")  # the separator cannot occur in a stripped text
    return F.when((q != "") & (F.size(kept) > 0), F.unhex(F.md5(joined)))


class CopyLedger:
    """(key BINARY, n_copies BIGINT, first_id BIGINT), one row for each key, bucketed by key in a shared folder.

    A version is immutable; merge() writes the next one, then the marker that names it, and removes the one before. A ledger
    lives on in its folder: a later session opens it and merges its own batch, and reads nothing of the days before but the
    ledger. If a merge fails, the marker still names the version before, and the merge can be repeated.
    """

    COLUMNS = "key BINARY, n_copies BIGINT, first_id BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """A new ledger. buckets: by default as many as the shuffle has partitions; fixed for the ledger's life."""
        self.spark, self.path, self.version = spark, path, 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"ledger_{uuid.uuid4().hex}"
        self.table: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CopyLedger:
        """The ledger of an earlier session; FileNotFoundError if there is none."""
        if not path_exists(spark, f"{path}/marker"):
            raise FileNotFoundError(f"no ledger in {path}")
        ledger = cls(spark, path)
        ledger.version, ledger.buckets = spark.read.schema("version INT, buckets INT").json(f"{path}/marker").orderBy(F.desc("version")).first()
        name = f"{ledger.name}_{ledger.version}"
        spark.sql(f"CREATE TABLE {name} ({cls.COLUMNS}) USING parquet CLUSTERED BY (key) INTO {ledger.buckets} BUCKETS LOCATION '{path}/v{ledger.version}'")
        ledger.table = spark.table(name)
        return ledger

    def close(self) -> DataFrame:
        """Takes the ledger out of the session's catalog; its rows, read from the folder, are returned."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{self.version}")  # external: the files stay
        self.table = None
        return self.spark.read.schema(self.COLUMNS).parquet(f"{self.path}/v{self.version}")

    def _write(self, df: DataFrame) -> None:
        old, self.version = self.version, self.version + 1
        name = f"{self.name}_{self.version}"
        drop_dir(self.spark, f"{self.path}/v{self.version}")  # what a failed merge may have left
        df.write.bucketBy(self.buckets, "key").option("path", f"{self.path}/v{self.version}").saveAsTable(name)
        write_file(self.spark, f"{self.path}/marker/v{self.version}.json", f'{{"version": {self.version}, "buckets": {self.buckets}}}')
        self.table = self.spark.table(name)
        if old:
            self.spark.sql(f"DROP TABLE {self.name}_{old}")
            drop_dir(self.spark, f"{self.path}/v{old}")

    def merge(self, batch: DataFrame) -> None:
        """batch: (key, id), null keys ignored; a batch may repeat keys of the ledger and of itself."""
        new = (
            batch.filter(F.col("key").isNotNull())
            .groupBy("key")
            .agg(F.count(F.lit(1)).alias("n_new"), F.min("id").alias("first_new"))
        )
        if self.table is None:
            self._write(new.select("key", F.col("n_new").alias("n_copies"), F.col("first_new").alias("first_id")).repartition(self.buckets, "key"))
            return
        joined = self.table.hint("merge").join(new.repartition(self.buckets, "key"), "key", "full_outer")
        self._write(
            joined.select(
                "key",
                (F.coalesce("n_copies", F.lit(0)) + F.coalesce("n_new", F.lit(0))).alias("n_copies"),
                F.least("first_id", "first_new").alias("first_id"),
            )
        )


def keyed(records: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """(id, key) of each record."""
    return records.select(F.col(id_col).alias("id"), canonical_key(F.col("query"), F.col("pos")).alias("key"))


def build_ledger(keys: DataFrame, path: str, batches: int = 3, buckets: int | None = None) -> CopyLedger:
    """Feeds the keys to a ledger in batches of consecutive ids, as loads would bring them."""
    ledger = CopyLedger(keys.sparkSession, path, buckets)
    low, high = keys.agg(F.min("id"), F.max("id")).first()
    if low is None:
        ledger.merge(keys)
        return ledger
    step = max(1, -(-(high - low + 1) // batches))
    for k in range(batches):
        start = low + k * step
        if start <= high:
            ledger.merge(keys.filter((F.col("id") >= start) & (F.col("id") < start + step)))
    return ledger


def _ledger_of(records: DataFrame, batches: int, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    path = work_dir(records.sparkSession)
    keys = staged(keyed(records), f"{path}/keys")
    return keys, build_ledger(keys, f"{path}/ledger", batches, buckets).close()


def find_copies(records: DataFrame, batches: int = 3, buckets: int | None = None) -> DataFrame:
    """(rec_a, rec_b): in each set of copies the smallest id with each other member."""
    keys, table = _ledger_of(records, batches, buckets)
    keys = keys.filter(F.col("key").isNotNull())
    total = table.agg(F.sum("n_copies")).first()[0] or 0
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keys with more than a partition's share of all rows: by their size there are at most `parts` of them, so they fit a broadcast.
    hot_size = max(total // parts, 1)
    sets = table.filter(F.col("n_copies") > 1)
    hot = sets.filter(F.col("n_copies") > hot_size).select("key", "first_id")
    cold = sets.filter(F.col("n_copies") <= hot_size).select("key", "first_id")
    members = keys.join(F.broadcast(hot), "key").unionByName(keys.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key"))
    return members.filter(F.col("id") != F.col("first_id")).select(F.col("first_id").alias("rec_a"), F.col("id").alias("rec_b"))


def collapse(records: DataFrame, batches: int = 3, buckets: int | None = None) -> DataFrame:
    """(rec_id, n_copies): each set of copies as its earliest record; a record without a key stands for itself."""
    keys, table = _ledger_of(records, batches, buckets)
    alone = keys.filter(F.col("key").isNull()).select(F.col("id").alias("rec_id"), F.lit(1).cast("bigint").alias("n_copies"))
    return table.select(F.col("first_id").alias("rec_id"), "n_copies").unionByName(alone)
