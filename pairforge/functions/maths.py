"""Schedules and small number functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_rate(step: Column, first: float, final: float, warmup: int, total: int) -> Column:
    """cosine decay from first to final, scaled up from a tenth during warm-up."""
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup + 1) / F.lit(float(total - warmup))))
    rate = final + (first - final) * F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * progress))) if first != final else F.lit(first)
    return F.when(step < warmup, rate * (0.1 + 0.9 * step / F.lit(float(max(warmup, 1))))).otherwise(rate)


def layer_rate(index: Column, n_layers: int, first: float, decay: float, is_head: Column, head_scale: float = 5.0) -> Column:
    """a layer's rate, falling towards the input."""
    base = first / decay ** max(n_layers - 1, 0) if decay else first
    return F.lit(base) * F.pow(F.lit(decay), index) * F.when(is_head, head_scale).otherwise(1.0)


def decay_schedule(progress: Column, first: float, final: float) -> Column:
    """exponential from first to final."""
    return F.lit(first) * F.exp(F.lit(math.log(final / first)) * progress)


def prime_3n2_below(x: Column) -> Column:
    """the largest prime of the form 3n + 2 below x; null below 3. Trial division, for x of a few thousand."""
    candidates = F.filter(F.sequence(F.lit(2), F.greatest(x - 1, F.lit(2))), lambda p: p % 3 == 2)
    prime = F.filter(candidates, lambda p: (p == 2) | ~F.exists(F.sequence(F.lit(2), F.greatest(F.ceil(F.sqrt(p)).cast("int"), F.lit(2))), lambda d: (p % d == 0) & (d < p)))
    return F.when(x > 2, F.array_max(prime))


def ffn_width(d: Column) -> Column:
    """F41."""
    return F.floor(d * 3.5 / 32) * 32


def ivf_sizes(n: Column) -> Column:
    """struct(lists, probes)."""
    lists = F.greatest(F.lit(1), F.least(F.lit(4096), F.floor(F.sqrt(n))))
    return F.struct(lists.cast("int").alias("lists"), F.least(lists, F.lit(32)).cast("int").alias("probes"))


def best_resolution(width: Column, height: Column, options: list[tuple[int, int]]) -> Column:
    """the option that wastes least area when the picture is scaled into it; the first one among equals."""
    out = []
    for k, (w, h) in enumerate(options):
        scale = F.least(F.lit(float(w)) / width, F.lit(float(h)) / height)
        waste = F.abs(F.lit(w * h) - F.floor(width * scale) * F.floor(height * scale))
        out.append(F.struct(waste.cast("bigint").alias("waste"), F.lit(k).alias("k"), F.lit(w).alias("width"), F.lit(h).alias("height")))
    return F.array_min(F.array(*out))


def tiles(width: Column, height: Column, rows: int, cols: int) -> Column:
    """the boxes of a rows x cols grid, row by row."""
    w, h = F.floor(width / cols).cast("int"), F.floor(height / rows).cast("int")
    box = lambda r, c: F.struct((c * w).alias("left"), (r * h).alias("top"), ((c + 1) * w).alias("right"), ((r + 1) * h).alias("bottom"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: box(r, c)))
    return F.flatten(grid)


def nearest_multiple(value: Column, multiple: int) -> Column:
    """Half to even, one multiple at least."""
    return F.greatest(F.lit(multiple), (F.rint(value / multiple) * multiple).cast("bigint"))
