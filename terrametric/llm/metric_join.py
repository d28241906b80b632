"""Near-duplicate vectors by an exact metric range join over pivot cells.

Copies are first reduced to one vector with a multiplicity. Pivots, a sample by
hash, cut the unit sphere into cells of the vectors nearest to each. Two
vectors within the radius either share a cell, or one of them lies so near the
border that it is replicated into the other's cell. By the triangle inequality
that takes d(o, p) - d(o, home) <= 2 r; on the sphere's chords the distance to
the plane between the two pivots, (d(o, p)^2 - d(o, home)^2) / 2 d(home, p)
<= r, says the same more sharply, and both are asked for. A pair of cells is
compared in one of them only, so a vector goes to about half of the cells its
border reaches. Cells then join independently.

A cell is compared by blocks of at most `block` vectors against each other, so
that a task stays bounded whatever a cell holds; the blocks of one cell go to
different tasks. Comparison is by matrix products in single precision with a
margin; what passes is decided by the cosine in double precision. Tasks give
counts a vector and a spanning forest of the links, not all pairs.

Vectors with little structure in many dimensions lie near all borders: the join
is then close to comparing all pairs of distinct vectors, as any exact method
would be; it is spread over all tasks and holds no more in each.

Vectors are compared with those of their own length; each length with more
than `cell_size` vectors has pivots of its own, any other is one cell.

Defined results: null and zero vectors and vectors with null or non-finite
components link with nothing; copies of a vector link with each other; a null id is counted as
a link but never names a component, unless all its members' ids are null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ready_workers, wide_hash
from .components import connected_components

#: More than single precision can be off in a product of unit vectors.
MARGIN = 1e-4
#: More than rounding can be off in a distance.
SLACK = 1e-6


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of vectors: each length, the places of those that have it, and their matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _owner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of two cells compares their pairs: each cell gets about half of its borders."""
    return np.where((a + b) % 2 == 0, np.minimum(a, b), np.maximum(a, b))


class Cells:
    """Home cell and replicas of unit vectors."""

    def __init__(self, pivots: np.ndarray, cosine: float):
        self.pivots = pivots  # none: all vectors are in one cell
        self.radius = math.sqrt(2 - 2 * cosine)
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home per vector, and for all replicas the vector's place and the cell)."""
        if len(self.pivots) < 2:
            return np.zeros(len(x), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        d2 = np.maximum(2 - 2 * x @ self.pivots.T, 0)
        home = d2.argmin(axis=1)
        own = d2[np.arange(len(x)), home][:, None]
        apart = self.apart[home]
        near = (np.sqrt(d2) - np.sqrt(own) <= 2 * self.radius + SLACK) & (d2 - own <= 2 * apart * (self.radius + SLACK) + SLACK)
        cells = np.arange(len(self.pivots))[None, :]
        near &= (cells != home[:, None]) & (_owner(np.broadcast_to(home[:, None], near.shape), cells) == cells)
        return home, *np.nonzero(near)


def _linked(a: np.ndarray, b: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """Row blocks of the links between unit vectors: (first row, Boolean matrix)."""
    a32, b32 = a.astype(np.float32), b.astype(np.float32).T
    for s in range(0, len(a), 256):
        near = a32[s : s + 256] @ b32 >= cosine - MARGIN
        i, j = np.nonzero(near)
        if len(i) > near.size // 64:
            near &= a[s : s + 256] @ b.T >= cosine
        else:
            near[i, j] = np.einsum("ij,ij->i", a[s + i], b[j]) >= cosine
        yield s, near


def _compare(sides: list[tuple[np.ndarray, np.ndarray]], cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links within one side, or between two: weights linked per vector of all sides, and a forest as places."""
    (x, weight), (y, other) = sides[0], sides[-1]
    same = len(sides) == 1
    n = len(x) + (0 if same else len(y))
    shift = 0 if same else len(x)
    label, counts, forest = np.arange(n), np.zeros(n, np.int64), []
    for s, near in _linked(x, y, cosine):
        if same:
            near[np.arange(len(near)), s + np.arange(len(near))] = False
        counts[s : s + len(near)] += (near * other).sum(axis=1)
        if not same:
            counts[shift:] += (near * weight[s : s + len(near), None]).sum(axis=0)
        for i in np.flatnonzero(near.any(axis=1)):
            js = np.flatnonzero(near[i]) + shift
            for l in np.unique(label[js]):
                if l != label[s + i]:
                    forest.append((s + int(i), int(js[label[js] == l][0])))
                    label[label == l] = label[s + i]
    return counts, forest


def linked_vectors(vectors: DataFrame, cosine: float = 0.95, cell_size: int = 4096, max_pivots: int = 1024, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per input row.

    n_links counts the other rows with a cosine of at least `cosine`, and
    component_id is the smallest id that such links reach.
    """
    spark = vectors.sparkSession
    ready_workers(spark)
    scratch = scratch or Scratch(spark, "metric-join")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(F.col("x").isNotNull() & ~odd & F.exists("x", lambda v: v != 0), F.lit(False))
    h1, h2 = wide_hash("x")
    keyed = given.withColumn("sound", sound).withColumn("h1", h1).withColumn("h2", h2)
    distinct = keyed.where("sound").groupBy("h1", "h2").agg(F.any_value("x").alias("x"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    distinct = scratch.save(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    # Lengths with more than a cell of vectors share the pivots by their numbers of vectors.
    large = distinct.groupBy(F.size("x").alias("dim")).count().where(F.col("count") > cell_size).orderBy(F.desc("count"), "dim").limit(max_pivots).collect()
    scale = min(1.0, max_pivots / max(1, sum(-(-r["count"] // cell_size) for r in large)))
    pivots = {}
    for r in large:
        picked = distinct.where(F.size("x") == r["dim"]).orderBy("h1", "h2").limit(max(1, math.floor(scale * -(-r["count"] // cell_size)))).select("x").collect()
        pivots[r["dim"]] = _unit(np.array([p["x"] for p in picked], np.float64))
    of_length = {dim: Cells(p, cosine) for dim, p in pivots.items()}
    one_cell = Cells(np.zeros((0, 0)), cosine)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {dim: np.zeros((2, len(cells.pivots)), np.int64) for dim, cells in of_length.items()}
        for b in batches:
            for dim, _, x in _by_length(b.column(0)):
                if dim in found:
                    home, _, cell = of_length[dim].of(_unit(x))
                    found[dim] += np.stack([np.bincount(c, minlength=found[dim].shape[1]) for c in (home, cell)])
        for dim, n in found.items():
            k = np.arange(n.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), dim, np.int32)), pa.array(k), pa.array(n[0]), pa.array(n[1])], ["dim", "cell", "homes", "guests"])

    blocks = {dim: np.zeros((2, len(cells.pivots)), np.int64) for dim, cells in of_length.items()}
    if blocks:
        for dim, c, h, g in distinct.select("x").mapInArrow(sizes, "dim int, cell int, homes long, guests long").groupBy("dim", "cell").agg(F.sum("homes"), F.sum("guests")).collect():  # a row per pivot
            blocks[dim][:, c] = -(-h // block), -(-g // block)
    # Any other length has at most a cell of vectors, but for lengths beyond the pivots' number.
    few = np.array([[-(-cell_size // block)], [0]])

    tasks_of = "dim int, cell int, left int, right int, side int, uid long, weight long, x binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_uid, all_weight = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for dim, places, raw in _by_length(b.column(2)):
                uid, weight, (home_blocks, guest_blocks) = all_uid[places], all_weight[places], blocks.get(dim, few)
                home, guest, cell = of_length.get(dim, one_cell).of(_unit(raw))
                mixed = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)  # spreads block numbers
                rows: list[tuple] = []  # (place, cell, left block, right block, side)
                for i, c in enumerate(home.tolist()):
                    h, g = int(home_blocks[c]), int(guest_blocks[c])
                    own = int(mixed[i] % np.uint64(h))
                    rows += [(i, c, min(own, k), max(own, k), int(own > k)) for k in range(h)]
                    rows += [(i, c, own, -1 - k, 0) for k in range(g)]  # right block -1 - k: the cell's k-th block of guests
                for i, c in zip(guest.tolist(), cell.tolist(), strict=True):
                    own = int(mixed[i] % np.uint64(guest_blocks[c]))
                    rows += [(i, c, k, -1 - own, 1) for k in range(int(home_blocks[c]))]
                for s in range(0, len(rows), 20_000):
                    part = np.array(rows[s : s + 20_000], np.int64).reshape(-1, 5)
                    at = part[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), *(pa.array(part[:, k], pa.int32()) for k in (1, 2, 3, 4)), pa.array(uid[at]), pa.array(weight[at]), pa.array([raw[i].tobytes() for i in at.tolist()], pa.binary())], ["dim", "cell", "left", "right", "side", "uid", "weight", "x"])

    kind = np.float32 if dict(given.dtypes)["x"] == "array<float>" else np.float64

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        uid, weight = rows["uid"].to_numpy(), rows["weight"].to_numpy()
        x = _unit(np.frombuffer(b"".join(rows["x"].to_pylist()), kind).reshape(-1, key[0].as_py()))
        parts = [np.flatnonzero(side == s) for s in ((0,) if key[2].as_py() == key[3].as_py() else (0, 1))]
        order = np.concatenate(parts)
        counts, forest = _compare([(x[p], weight[p]) for p in parts], cosine)
        own = uid[order]
        some = np.flatnonzero(counts)
        u, v = np.array(forest, np.int64).reshape(-1, 2).T
        return pa.table({"link": pa.array([False] * len(some) + [True] * len(u), pa.bool_()), "a": pa.array(np.concatenate([own[some], own[u]]), pa.int64()), "b": pa.array(np.concatenate([counts[some], own[v]]), pa.int64())})

    dealt = distinct.select("uid", "weight", F.col("x").cast("array<float>" if kind is np.float32 else "array<double>").alias("x")).mapInArrow(deal, tasks_of)
    done = scratch.save(dealt.groupBy("dim", "cell", "left", "right").applyInArrow(join, "link boolean, a long, b long"), "links")
    counts = done.where("not link").groupBy(F.col("a").alias("uid")).agg(F.sum("b").alias("others"))
    roots = connected_components(done.where("link").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    members = distinct.select("uid", "h1", "h2", "weight", "least").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(least, "root").join(counts, "uid", "left").select("h1", "h2", "component_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("linked"))
    joined = keyed.select("vec_id", "h1", "h2", "sound").join(named.withColumn("sound", F.lit(True)), ["h1", "h2", "sound"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
