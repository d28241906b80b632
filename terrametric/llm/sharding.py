"""Sharding by histogram sort: shards of near-equal bytes over one sorted order.

Rows are ordered by a 128-bit key, the hash of the text and then of the row's
id, so that equal texts lie together and yet a group of copies of any size can
be split. A boundary that falls into a group is moved to the group's nearer
end unless the group is larger than a given share of a shard. Candidate boundaries are probed in rounds: each partition counts the
exact bytes between neighbouring probes, the sums tell how many bytes lie
below each, and the intervals that hold a wanted boundary are probed more
finely until it is met within the tolerance or the keys there cannot be told
apart. Then all rows are exchanged once.

The exchange goes by parts of a shard whose number follows the corpus, so that
no task holds a shard; counts of the keys tell how many rows lie in the parts
before, which makes slots gapless.

Only histograms of a few thousand probes reach the driver, and a row for each
boundary that falls into a group.

Defined results: null text counts as empty and is in the group of empty texts; rows that share id and text have
the same key and lie together in any order; a null id is a value of its own;
an empty table gives an empty result; more shards than rows leaves shards
empty; other columns are carried along, but for one named like a result column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, carried, ready_workers

KEY_BITS = 128
#: Up to so many parts their counts (some 20 bytes each) are broadcast.
MAX_BROADCAST_PARTS = 100_000
_HALF = 1 << 63


def _packed(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Pairs of signed longs as 16 bytes that sort alike."""
    flip = np.uint64(_HALF)
    both = np.stack([k1.astype(np.int64).view(np.uint64) ^ flip, k2.astype(np.int64).view(np.uint64) ^ flip], axis=1)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], "S16")


def _int(b: bytes) -> int:
    return int.from_bytes(b.ljust(16, b"\0"), "big")


@dataclass
class Boundary:
    """What is known about a wanted boundary: it lies in [low, high], keys below low hold so many bytes."""

    target: float
    tolerance: float
    low: int = 0
    high: int = 1 << KEY_BITS
    key: int | None = None
    bytes_below: int = 0
    rows_below: int = 0


def _histogram(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """Per gap between probes: bytes, rows, least and largest key (0 rows: key fields 0)."""
    edges = _bytes(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(edges) + 1
        size, rows, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), {}, {}
        for b in batches:
            k = _packed(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
            at = np.searchsorted(edges, k, side="right")
            size += np.bincount(at, weights=b.column(2).to_numpy(zero_copy_only=False), minlength=n).astype(np.int64)
            rows += np.bincount(at, minlength=n)
            order = np.lexsort((k, at))
            at, k = at[order], k[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            last = np.append(first[1:], len(at)) - 1
            for g, a, z in zip(at[first].tolist(), k[first].tolist(), k[last].tolist(), strict=True):
                a, z = a.ljust(16, b"\0"), z.ljust(16, b"\0")
                low[g], high[g] = min(a, low.get(g, a)), max(z, high.get(g, z))
        own = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(size[own]), pa.array(rows[own]), pa.array([low[g] for g in own.tolist()], pa.binary()), pa.array([high[g] for g in own.tolist()], pa.binary())], ["gap", "bytes", "rows", "low", "high"])

    parts = keys.mapInArrow(count, "gap int, bytes long, rows long, low binary, high binary")
    found = {r[0]: r[1:] for r in parts.groupBy("gap").agg(F.sum("bytes"), F.sum("rows"), F.min("low"), F.max("high")).collect()}
    return [(x[0], x[1], _int(x[2]), _int(x[3])) if (x := found.get(g)) else (0, 0, 0, 0) for g in range(len(probes) + 1)]


def splitters(keys: DataFrame, boundaries: list[Boundary], fan: int = 2048, rounds: int = 40) -> list[Boundary]:
    """Finds each boundary's key: rows below it hold the target's bytes within the tolerance, or as near as keys allow.

    keys: columns k1, k2 and size.
    """
    for _ in range(rounds):
        todo = [b for b in boundaries if b.key is None]
        if not todo:
            return boundaries
        gaps = sorted({(b.low, b.high) for b in todo})
        each = max(4, fan // len(gaps))
        probes = sorted({a + (z - a) * i // each for a, z in gaps for i in range(each + 1) if 0 < a + (z - a) * i // each < 1 << KEY_BITS})
        counts = _histogram(keys, probes)
        below = np.concatenate([[0], np.cumsum([c[0] for c in counts])])
        rows = np.concatenate([[0], np.cumsum([c[1] for c in counts])])
        for b in todo:
            g = min(int(np.searchsorted(below, b.target, side="right")) - 1, len(counts) - 1)  # the gap that holds it
            ends = [(abs(int(below[i]) - b.target), i) for i in (g, g + 1) if 0 < i <= len(probes)]
            near, i = min(ends, default=(math.inf, 0))
            _, n, low, high = counts[g]
            if near <= b.tolerance:
                b.key, b.bytes_below, b.rows_below = probes[i - 1], int(below[i]), int(rows[i])
            elif n == 0 or low == high:  # nothing to tell apart in there
                down = b.target - below[g] <= below[g + 1] - b.target
                b.key = low if down and n else high + 1 if n else (probes[g - 1] if g else 0)
                b.bytes_below, b.rows_below = (int(below[g]), int(rows[g])) if down or not n else (int(below[g + 1]), int(rows[g + 1]))
            else:
                b.low, b.high = low, high + 1
    raise RuntimeError(f"splitters were not found in {rounds} rounds")


def kept_whole(keys: DataFrame, boundaries: list[Boundary], most: float) -> list[Boundary]:
    """Moves each boundary that cuts through a group of equal texts to the group's nearer end, if the group has at most so many bytes."""
    cut = {b.key: b for b in boundaries if b.key and b.key < 1 << KEY_BITS and b.key & ((1 << 64) - 1)}
    if not cut:
        return boundaries
    inside = F.lit(False)
    for key in cut:
        inside = inside | (F.col("k1") == (key >> 64) - _HALF)
    below = [F.sum(F.when(F.col("k2") < (key & ((1 << 64) - 1)) - _HALF, F.struct("size", F.lit(1).alias("n"))[x]).otherwise(0)).alias(f"{x}{i}") for i, key in enumerate(cut) for x in ("size", "n")]
    found = {r["k1"] + _HALF: r for r in keys.where(inside).groupBy("k1").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *below).collect()}  # a row a boundary at most
    for i, (key, b) in enumerate(cut.items()):
        r = found.get(key >> 64)
        if r is None or r["bytes"] > most:
            continue
        down = 2 * r[f"size{i}"] <= r["bytes"]
        b.key = (key >> 64) + (not down) << 64
        b.bytes_below += (0 if down else r["bytes"]) - r[f"size{i}"]
        b.rows_below += (0 if down else r["rows"]) - r[f"n{i}"]
    return boundaries


def sharded(docs: DataFrame, shards: int = 16, tolerance: float = 0.0005, whole: float = 0.05, part_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The input rows with `size` (UTF-8 bytes and one), `shard` and `slot` (gapless from 0 in each shard).

    tolerance: of a shard's mean bytes, how far a shard's end may be off; single
    documents and rows of equal key may exceed it. whole: groups of equal texts
    up to this share of a shard's mean bytes lie in one shard, which moves its
    ends by half as much at most; larger groups are split where shards end.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    scratch = scratch or Scratch(spark, "sharding")
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(carried(docs, "size", "shard", "slot"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), F.col(id_col).isNull(), F.col(id_col), text).alias("k2"), size.alias("size"))
    keys = scratch.save(keyed.select("k1", "k2", "size"), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    wanted = [Boundary(total * j / shards, tolerance * mean) for j in range(1, shards)]
    found = kept_whole(keys, splitters(keys, wanted), whole * mean) if total else wanted
    edges = _bytes([min(b.key or 0, (1 << KEY_BITS) - 1) for b in found])

    @F.pandas_udf("int")
    def shard(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _packed(k1.to_numpy(), k2.to_numpy()), side="right").astype(np.int32))

    # A shard is dealt into parts by another hash, so that no task holds one, nor a group of equal texts.
    parts = max(1, math.ceil(mean / part_bytes))
    placed = lambda df: df.withColumn("shard", shard("k1", "k2")).withColumn("part", F.pmod(F.xxhash64("k2"), F.lit(parts)).cast("int"))
    sizes = scratch.save(placed(keys).groupBy("shard", "part").count(), "parts")
    before = sizes.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    before = F.broadcast(before) if shards * parts <= MAX_BROADCAST_PARTS else before
    joined = placed(keyed).join(before, ["shard", "part"])
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("k1", "k2"))
    return joined.withColumn("nth", nth).select("row.*", "size", "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"))
