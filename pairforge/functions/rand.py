"""The only randomness of the library: md5 of seed, salt and id, which any engine can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def det_key(seed: int | str, salt: str, *ids: Column | str) -> Column:
    """32 hex digits; ordering by them is a seeded shuffle."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[c.cast("string") for c in cols]))


def key_int(key: Column) -> Column:
    """The first 8 hex digits of a key as a BIGINT below 2^32."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def hash01(seed: int | str, salt: str, *ids: Column | str) -> Column:
    """A reproducible uniform number in [0, 1)."""
    return key_int(det_key(seed, salt, *ids)) / F.lit(4294967296.0)


def sql_key(seed: int | str, salt: str, *ids: str) -> str:
    """det_key as DuckDB SQL."""
    return f"md5(concat_ws('|', '{seed}', '{salt}', {', '.join(f'CAST({i} AS VARCHAR)' for i in ids)}))"


def sql_hash01(seed: int | str, salt: str, *ids: str) -> str:
    """hash01 as DuckDB SQL."""
    return f"(CAST('0x' || substr({sql_key(seed, salt, *ids)}, 1, 8) AS BIGINT) / 4294967296.0)"
