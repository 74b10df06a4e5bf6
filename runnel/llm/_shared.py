"""What the training-data operators share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    at = fresh_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Bytes of an Arrow batch at most, so that long texts don't make large ones.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to BATCH_BYTES; a smaller or own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = re.match(r"\d+", spark.conf.get(key, str(1 << 30)))
    if limit is None or not 0 < int(limit.group()) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _murmur3(x: np.ndarray) -> np.ndarray:
    """Spark's hash of an int column, by which rows are dealt to partitions: Murmur3, x86, 32 bits, seed 42."""
    turned = lambda v, by: (v << np.uint32(by)) | (v >> np.uint32(32 - by))
    h = np.uint32(42) ^ (turned(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def apart(n: int) -> np.ndarray:
    """n ints of which repartition(n, column) gives each a partition of its own."""
    tried = np.arange(n * (n.bit_length() + 12), dtype=np.int32)
    at, first = np.unique(_murmur3(tried).astype(np.int64) % n, return_index=True)
    out = np.arange(n, dtype=np.int32)  # a partition that no try hits shares another's
    out[at] = tried[first]
    return out


def longs(values) -> Column:
    """A constant array of whole numbers, of any length: one literal."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def text_of(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def fresh_name(name: str, taken: list[str]) -> str:
    """A column name like `name` that is not taken."""
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name
