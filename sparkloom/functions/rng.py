"""Stateless draws: a hash of seed, stream and key, equal in every run, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def uniform_sql(seed: int, key: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
