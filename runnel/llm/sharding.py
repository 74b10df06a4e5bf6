"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are range-partitioned by them; the exact bytes of every
range are then summed, ranges that are overfull (one hot key, a group of copies) are subdivided by a hash of the record id,
and the resulting cells are packed into shards, largest first. The number of ranges follows the number of records, and an overfull
range has as many subdivisions as it holds times a range's share. Only tables of bounded size reach the driver: the sample
(KEYS a range or so), the splitters and the cells. Texts are read once; keys, sizes and checksums are written and reread.

DataFrame functions only. Null text: size 1, crc32 of nothing. Repeated rows: each gets a slot of its own. Empty table:
no rows. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import longs, partitions, text_of, written

#: Ranges at least and at most, and records in a range, about.
RANGES, MOST_RANGES = 1024, 1 << 16
RECORDS = 1 << 17
#: Sampled keys a range, and at least in all.
KEYS, LEAST_KEYS = 16, 1 << 13
SUBDIVISIONS = 64


def splitters(keyed: DataFrame, ranges: int = RANGES, sample: int | None = None) -> list[int]:
    """At most ranges - 1 boundaries that cut the bytes of `keyed` (key long, id, size long) into about equal parts.

    Each record enters the sample with probability size * sample / total, decided by a hash of its id.
    """
    total = keyed.agg(F.sum("size")).first()[0]
    if not total or ranges < 2:
        return []
    sample = sample or max(LEAST_KEYS, KEYS * ranges)
    chance = F.col("size") * F.lit(sample / total)
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = keyed.where(drawn < chance).groupBy("key").agg(F.sum(F.greatest(chance, F.lit(1.0))).alias("w")).collect()
    rows.sort()
    step, seen, out = sum(r.w for r in rows) / ranges, 0.0, []
    for r in rows:
        seen += r.w
        if seen >= step * (len(out) + 1) and len(out) < ranges - 1:
            out += [r.key]
            while seen >= step * (len(out) + 1) and len(out) < ranges - 1:
                out += [r.key]
    return sorted(set(out))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are below the key: binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    table, n = longs(bounds), len(bounds)
    steps = F.lit([1 << k for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= n) & (F.get(table, lo + s - 1) < key), lo + s).otherwise(lo))


def pack(cells: list[tuple], shards: int) -> dict:
    """Cells (name, bytes) to shards, largest first into the shard with the fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(cells, key=lambda c: (-c[1], c[0])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc id, size, text_crc32, shard and slot: sizes of shards near equal, slots gapless from 0 in each shard.

    The key is a hash of the text, so that equal texts share a range and a shard unless that range is overfull.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    keyed = written(keyed, "shard-keys")
    ranges = ranges or min(MOST_RANGES, max(RANGES, keyed.count() // RECORDS))
    placed = keyed.withColumn("range", range_of(F.col("key"), splitters(keyed, ranges)))
    sums = [F.sum("size").alias("bytes"), F.count("*").alias("n")]
    cells = {(r["range"], -1): [r["bytes"], r["n"]] for r in placed.groupBy("range").agg(*sums).collect()}
    every = sum(c[0] for c in cells.values())
    full, share = max(1, every // (8 * shards)), max(1, every // ranges)
    # an overfull range, and into how many parts it is dealt
    parts = {r: max(SUBDIVISIONS, -(-c[0] // share)) for (r, _), c in cells.items() if c[0] > full}
    hot = sorted(parts)
    cell_sub = F.lit(-1).cast("long")
    if hot:
        counts = F.map_from_arrays(longs(hot), longs(parts[r] for r in hot))
        cell_sub = F.coalesce(F.pmod(F.xxhash64("id", F.lit("sub")), F.element_at(counts, F.col("range").cast("long"))), cell_sub)
    placed = placed.withColumn("cell_sub", cell_sub.cast("int"))
    if hot:
        for r in hot:
            del cells[r, -1]
        split = placed.where("cell_sub >= 0").groupBy("range", "cell_sub").agg(*sums).collect()
        cells |= {(r["range"], r["cell_sub"]): [r["bytes"], r["n"]] for r in split}
    chosen = pack([(k, c[0]) for k, c in cells.items()], shards)
    start, used = {}, [0] * shards
    for k in sorted(cells):
        start[k] = used[chosen[k]]
        used[chosen[k]] += cells[k][1]
    plan = spark.createDataFrame([(*k, chosen[k], start[k]) for k in sorted(cells)], "range int, cell_sub int, shard int, start long")
    w = Window.partitionBy("range", "cell_sub").orderBy("key", "id", "crc", "size")
    ranked = placed.withColumn("rank", F.row_number().over(w) - 1)
    return ranked.join(F.broadcast(plan), ["range", "cell_sub"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("rank")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs written under path in folders shard=0 and so on; returns the assignment."""
    plan = shard(docs, shards, id_col, text_col)
    body = docs.drop("shard", "slot").join(plan.select(id_col, "shard", "slot").dropDuplicates([id_col]), id_col)
    body.repartition(partitions(docs.sparkSession), "shard", F.pmod(F.xxhash64(id_col), F.lit(SUBDIVISIONS))).write.partitionBy("shard").parquet(path)
    return plan
