"""Problem 5: items of varying length into containers of fixed capacity, by linear grouping.

Packing depends on lengths alone, and there are at most `capacity` of them. So each source is packed as a histogram of
its lengths, in one small task, and the plan is then applied to the items by their rank within a length:

1. Lengths over capacity / small are large. In descending order they form groups of equal cardinality; each group counts
   as its longest length, so that few sizes remain.
2. Configurations: the largest size that is left, filled up with the subset of other sizes that comes closest to the
   capacity (a bounded subset sum over bit sets); a configuration is used as often as its groups allow.
3. The groups' actual items take the places, which leaves more room than planned.
4. The small lengths go, longest first, where the least room is left (best fit), and into new containers at last.

An item longer than the capacity is cut into pieces of full capacity and a rest, and no other item is cut.

Defined results: null entries have no characters; an item without any (null, empty pos) takes no room and shares a
container with others (they are dealt out over the source's containers); a null source counts as the source ''; ties go by id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.session import staged, work_dir

CAPACITY = 2048
#: A length over capacity / SMALL is large.
SMALL = 16
GROUPS = 96


def pos_length(pos: Column) -> Column:
    """Characters of all entries together."""
    return F.coalesce(F.aggregate(pos, F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.length(x), F.lit(0))), F.lit(0).cast("bigint"))


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """(id, source, piece_no, start, length) of items (id, source, length)."""
    count = F.greatest(F.lit(1), F.ceil(F.col("length") / capacity)).cast("int")
    start = (F.col("piece_no") * F.lit(capacity).cast("bigint")).alias("start")
    return (
        items.select("id", "source", "length", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece_no"))
        .select("id", "source", "piece_no", start, F.least(F.lit(capacity).cast("bigint"), F.col("length") - F.col("piece_no") * capacity).cast("int").alias("length"))
    )


def _best_subset(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size come closest to room; sizes descending."""
    reach, mask = [1], (1 << (room + 1)) - 1
    for size, n in zip(sizes, left):
        bits = reach[-1]
        if size <= room:
            for _ in range(min(n, room // size)):
                more = (bits | bits << size) & mask
                if more == bits:
                    break
                bits = more
        reach.append(bits)
    at, used = reach[-1].bit_length() - 1, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not reach[i] >> at & 1:
            at -= sizes[i]
            used[i] += 1
    return used


class _Group:
    """Items of similar length as runs (length, count), taken from the front."""

    def __init__(self) -> None:
        self.runs: list[list[int]] = []
        self.size, self.left = 0, 0

    def add(self, length: int, first_rank: int, n: int) -> None:
        self.size = max(self.size, length)
        self.runs.append([length, first_rank, n])
        self.left += n

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out, self.left = [], self.left - n
        while n:
            length, rank, have = self.runs[0]
            k = min(n, have)
            out.append((length, rank, k))
            n -= k
            if k == have:
                self.runs.pop(0)
            else:
                self.runs[0] = [length, rank + k, have - k]
        return out


def plan_source(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, rank_from, rank_to, container_from, phase, per_container).

    The item of that length with rank r in [rank_from, rank_to) goes to container_from + (r - rank_from + phase) // per_container.
    """
    segments: list[tuple[int, int, int, int, int, int]] = []
    lengths = sorted((x for x in histogram if x > 0), reverse=True)
    large = [x for x in lengths if x > capacity // small]
    total = sum(histogram[x] for x in large)
    per_group = max(1, -(-total // groups))
    grouped: list[_Group] = []
    for length in large:
        rank, n = 0, histogram[length]
        while n:
            if not grouped or grouped[-1].left == per_group:
                grouped.append(_Group())
            k = min(n, per_group - grouped[-1].left)
            grouped[-1].add(length, rank, k)
            rank, n = rank + k, n - k
    n_containers = 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of containers
    while grouped := [g for g in grouped if g.left]:
        sizes, left = [g.size for g in grouped], [g.left for g in grouped]
        left[0] -= 1
        used = _best_subset(sizes, left, capacity - sizes[0])
        used[0] += 1
        times = min(g.left // u for g, u in zip(grouped, used) if u)
        cuts, taken = {0, times}, []
        for g, u in zip(grouped, used):
            if u:
                runs, offset = g.take(times * u), 0
                for length, rank, k in runs:
                    segments.append((length, rank, rank + k, n_containers + offset // u, offset % u, u))
                    offset += k
                    cuts |= {offset // u, min(times, offset // u + 1)}
                taken.append((u, runs))
        marks = sorted(cuts)
        for a, b in zip(marks, marks[1:]):  # all containers of [a, b) hold the same lengths
            fill = 0
            for u, runs in taken:
                lo, hi, offset = a * u, a * u + u, 0
                for length, _, k in runs:
                    fill += length * max(0, min(hi, offset + k) - max(lo, offset))
                    offset += k
            rooms.setdefault(capacity - fill, []).append((n_containers + a, n_containers + b))
        n_containers += times
    open_rooms = sorted(rooms)
    for length in (x for x in lengths if x <= capacity // small):
        rank, n = 0, histogram[length]
        while n:
            i = bisect.bisect_left(open_rooms, length)
            if i == len(open_rooms):
                new = -(-n // (capacity // length))
                rooms[capacity], open_rooms = [(n_containers, n_containers + new)], open_rooms + [capacity]
                n_containers += new
                continue
            room = open_rooms[i]
            fits, (c0, c1) = room // length, rooms[room].pop()
            if not rooms[room]:
                del rooms[room], open_rooms[i]
            whole = min(c1 - c0, n // fits)
            back: list[tuple[int, int, int]] = []  # (room, from, to)
            if whole:
                segments.append((length, rank, rank + whole * fits, c0, 0, fits))
                back.append((room - fits * length, c0, c0 + whole))
                rank, n = rank + whole * fits, n - whole * fits
            if whole < c1 - c0 and n:  # n < fits are left
                segments.append((length, rank, rank + n, c0 + whole, 0, fits))
                back.append((room - n * length, c0 + whole, c0 + whole + 1))
                rank, n, whole = rank + n, 0, whole + 1
            if whole < c1 - c0:
                back.append((room, c0 + whole, c1))
            for r, a, b in back:
                if r not in rooms:
                    bisect.insort(open_rooms, r)
                rooms.setdefault(r, []).append((a, b))
    if histogram.get(0):  # dealt out over all containers, so that none holds them all; without any, `capacity` to one
        n = histogram[0]
        segments.append((0, 0, n, 0, 0, -(-n // n_containers) if n_containers else capacity))
    return segments


def _planner(capacity: int, groups: int, small: int):
    def plan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = plan_source(dict(zip(rows["length"].tolist(), rows["n"].tolist())), capacity, groups, small)
        out = pd.DataFrame(found, columns=["length", "rank_from", "rank_to", "container_from", "phase", "per_container"])
        out.insert(0, "source", key[0])
        return out

    return plan


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """(source, container, id, piece_no, start, length) of items (id, source, length)."""
    spark = items.sparkSession
    # Salts split a length that holds much of a source; as many as the shuffle has partitions.
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = staged(pieces(items, capacity).withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), F.lit(salts)).cast("int")), f"{work_dir(spark)}/pieces")
    counts = cut.groupBy("source", "length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.expr("sum(n) OVER (PARTITION BY source, length ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    histogram = counts.groupBy("source", "length").agg(F.sum("n").alias("n"))
    plan = histogram.groupBy("source").applyInPandas(  # at most capacity + 1 rows for each source
        _planner(capacity, groups, small),
        "source STRING, length INT, rank_from BIGINT, rank_to BIGINT, container_from BIGINT, phase BIGINT, per_container BIGINT",
    )
    by_length = plan.groupBy("source", "length").agg(
        F.sort_array(F.collect_list(F.struct("rank_from", "rank_to", "container_from", "phase", "per_container"))).alias("segments")
    )
    places = counts.join(by_length, ["source", "length"]).select("source", "length", "salt", F.coalesce("before", F.lit(0)).alias("before"), "segments")
    ranked = cut.withColumn("in_salt", F.expr("row_number() OVER (PARTITION BY source, length, salt ORDER BY id, piece_no) - 1"))
    rank = F.col("before") + F.col("in_salt")
    seg = F.col("seg")
    return (
        ranked.join(places, ["source", "length", "salt"])
        .withColumn("rank", rank)
        .withColumn("seg", F.expr("filter(segments, s -> s.rank_from <= rank AND rank < s.rank_to)[0]"))
        .select(
            "source",
            (seg["container_from"] + F.expr("(rank - seg.rank_from + seg.phase) div seg.per_container")).alias("container"),
            "id",
            "piece_no",
            "start",
            "length",
        )
    )


def items_of(records: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """Each record's pos entries together as one item."""
    return records.select(F.col(id_col).alias("id"), F.coalesce("source", F.lit("")).alias("source"), pos_length(F.col("pos")).alias("length"))


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each source: containers, characters, and the part of the room that they fill."""
    per_container = packed.groupBy("source", "container").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("n"))
    return per_container.groupBy("source").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("n").alias("pieces"),
        F.sum("used").alias("chars"),
        F.max("used").alias("most_used"),
        (F.floor(F.sum("used") / (F.count(F.lit(1)) * capacity) * 1e6 + 0.5) / 1e6).alias("filled"),
    )
