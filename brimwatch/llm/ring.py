"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (operator 6).

Every shard owns many points of the ring. A row goes to the first point
clockwise from its own position whose shard still has room. The ring is a fixed
number of cells, so placing needs only the load of each cell: the walk over the
cells gives a small table that says which stretch of a cell's rows goes where,
and the rows look their place up in it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import mix, running, stage

#: Positions of the ring; bounds all that the driver sees.
CELLS = 1 << 16
#: Points of each shard.
POINTS = 128
SIZE_OVERHEAD = 16


def points(shards: int, per_shard: int = POINTS, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(cell, shard) of all virtual nodes in ring order. A shard's points do not depend on the others."""
    name = np.arange(shards, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(per_shard, dtype=np.uint64)
    cell = (mix(mix(name.ravel() + np.uint64(1))) >> np.uint64(40)).astype(np.int64) % cells
    shard = np.repeat(np.arange(shards), per_shard)
    order = np.lexsort((shard, cell))
    return cell[order], shard[order]


def capacities(total: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """Most that each shard may hold: the equal share, the remainder one by one, and the slack."""
    room = np.full(shards, total // shards, dtype=np.int64)
    room[: total % shards] += 1
    return room + int(total * slack / shards)


def walk(loads: dict[int, int], shards: int, room: np.ndarray, per_shard: int = POINTS) -> list[tuple]:
    """Clockwise placement of the cells' loads: (cell, from, to, shard, load of the shard before)."""
    cell_of, shard_of = points(shards, per_shard)
    n = len(cell_of)
    room = room.copy()
    held = np.zeros(shards, dtype=np.int64)
    after = list(range(n))  # next point whose shard may have room, with short-cuts

    def find(i: int) -> int:
        trail = []
        for _ in range(2 * n):
            if room[shard_of[i]] > 0:
                break
            trail.append(i)
            i = after[i] if after[i] != i else (i + 1) % n
        for j in trail:
            after[j] = i
        return i

    out = []
    for cell in sorted(loads):
        rest, start = loads[cell], 0
        i = int(np.searchsorted(cell_of, cell)) % n
        while rest > 0:
            i = find(i)
            shard = int(shard_of[i])
            take = int(min(rest, room[shard]))
            out.append((cell, start, start + take, shard, int(held[shard])))
            room[shard] -= take
            held[shard] += take
            start += take
            rest -= take
    return out


def shard_rows(
    docs: DataFrame, shards: int = 40, law: str = "rows", slack: float = 0.0, per_shard: int = POINTS
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``law`` is "rows" (capacity counts rows; without slack the shards' counts are
    at most one apart) or "bytes" (capacity counts bytes; a row goes where its
    first byte has room, so a shard exceeds its share by less than one row). With
    ``slack`` a shard may hold that part more than its share and fewer rows move
    when a shard is added. Within a shard, slots count from 0 without gaps. A null
    text has no bytes and checksum 0, a null doc_id has a place like any value.
    Equal rows, also all rows with one doc_id, are split over shards like others.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    thin = stage(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(SIZE_OVERHEAD)).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(CELLS)).cast("int").alias("cell"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "ring",
    )
    weight = None if law == "rows" else "size"
    load = F.count("*") if law == "rows" else F.sum("size")
    loads = {r.cell: r.load for r in thin.groupBy("cell").agg(load.alias("load")).collect()}  # CELLS rows at most
    plan = walk(loads, shards, capacities(sum(loads.values()), shards, slack), per_shard)
    schema = "cell int, start long, stop long, shard int, held long"
    stretches = F.broadcast(spark.createDataFrame(plan, schema))  # at most CELLS + shards rows
    ranked = running(thin, ["cell"], ["doc_id", "text_crc32", "size", "row"], weight, "at")
    placed = ranked.join(stretches, "cell").where("at >= start AND at < stop")
    if law == "rows":
        placed = placed.withColumn("slot", F.col("held") + F.col("at") - F.col("start"))
    else:
        placed = running(placed, ["shard"], ["cell", "at", "row"], None, "slot")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
