"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A gene is a whole sequence (a bin), not a document's place. Crossover injects
the well-filled bins of one parent into the other, removes the bins of the
other that hold a document twice, and puts the displaced documents back by
best fit. Documents are dealt into blocks of bounded size; each block is
solved on several islands, each with a population of its own, and between
epochs every island sends its elite to the next one. Bins that the best
solution of a block leaves loose are dealt anew in a second level, so that
blocks don't each end in a few half-empty bins.

Nothing about single documents reaches the driver, blocks are bounded however
many documents there are, and what moves between tasks is two bytes a
document and genome.

Defined results: null text is an empty document (its end id only); a repeated
row is a document of its own; an empty table gives no sequences; input columns
other than the id and the text are ignored, whatever their names; ties in
lengths are broken by the order in a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, ready_workers, release_memory

END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer: str, kind: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Documents cut into pieces of at most `capacity` ids, the end id included.

    keep_ids adds `ids`, the piece's ids as little-endian unsigned 32-bit integers.
    """
    ready_workers(docs.sparkSession)
    schema = PIECES + (", ids binary" if keep_ids else "")
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, kind).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode([text.as_py()])[0] + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, k, start, len(own) // 4, zlib.crc32(own), own)[: 6 if keep_ids else 5])
            names = [x.split()[0] for x in schema.split(", ")]
            types = {"piece": pa.int32(), "ids": pa.binary()}
            cols = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, cols, strict=True)], names)
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


class BestFit:
    """Bins by the room left in them; the fullest bin that a length still fits is found in one step."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has room r
        self.room: list[int] = []

    def add(self, room: int) -> int:
        self.room.append(room)
        if not self.by_room[room]:
            self.rooms |= 1 << room
        self.by_room[room].append(len(self.room) - 1)
        return len(self.room) - 1

    def put(self, length: int) -> int:
        fitting = self.rooms >> length
        if not fitting:
            return self.add(self.capacity - length)
        r = length + (fitting & -fitting).bit_length() - 1
        bins = self.by_room[r]
        b = bins.pop()
        if not bins:
            self.rooms ^= 1 << r
        self.room[b] = left = r - length
        if not self.by_room[left]:
            self.rooms |= 1 << left
        self.by_room[left].append(b)
        return b


def _fill(lengths: np.ndarray, genome: np.ndarray) -> np.ndarray:
    return np.bincount(genome, weights=lengths).astype(np.int64)


def _score(lengths: np.ndarray, genome: np.ndarray, capacity: int) -> tuple[int, float]:
    """Less is better: bins used, then how unevenly they are filled."""
    fill = _fill(lengths, genome)
    fill = fill[fill > 0]
    return len(fill), -float(((fill / capacity) ** 2).sum())


def _best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins, genome = BestFit(capacity), np.empty(len(lengths), np.uint32)
    put = bins.put
    genome[order] = [put(x) for x in lengths[order].tolist()]
    return genome


def _cross(lengths: np.ndarray, giver: np.ndarray, taker: np.ndarray, share: float, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of the giver go into the taker; what they displace is put back by best fit."""
    fill = _fill(lengths, giver)
    weight = (fill / capacity) ** 8 * rng.random(len(fill))  # mostly the full ones
    injected = np.zeros(len(fill), bool)
    injected[np.argsort(-weight, kind="stable")[: max(1, int(share * len(fill)))]] = True
    own = injected[giver]  # documents that come with the giver's bins
    hit = np.zeros(int(taker.max()) + 1, bool)
    hit[taker[own]] = True  # the taker's bins that hold one of them twice now
    stay = ~own & ~hit[taker]
    genome = np.empty(len(lengths), np.uint32)
    _, genome[own] = np.unique(giver[own], return_inverse=True)
    n = int(genome[own].max()) + 1 if own.any() else 0
    if stay.any():
        _, kept = np.unique(taker[stay], return_inverse=True)
        genome[stay] = kept + n
    placed = own | stay
    bins = BestFit(capacity)
    for f in np.bincount(genome[placed], weights=lengths[placed]).astype(np.int64).tolist():
        bins.add(capacity - f)
    out = np.flatnonzero(~placed)
    out = out[np.argsort(-lengths[out] + rng.random(len(out)), kind="stable")]
    genome[out] = [bins.put(x) for x in lengths[out].tolist()]
    return genome


def _first_population(lengths: np.ndarray, size: int, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit in decreasing order, and in orders that noise disturbs more and more."""
    return [_best_fit(lengths, np.argsort(-lengths * (1 + 0.5 * k / size * (rng.random(len(lengths)) - 0.5)) if k else -lengths, kind="stable"), capacity) for k in range(size)]


def _evolve(lengths: np.ndarray, population: list[np.ndarray], children: int, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    scored = sorted(((_score(lengths, g, capacity), i, g) for i, g in enumerate(population)), key=lambda x: x[:2])
    least = -(-int(lengths.sum()) // capacity)
    for k in range(children):
        if scored[0][0][0] <= least:
            break  # as few bins as the sum of lengths allows
        a, b = (int(x) for x in rng.choice(len(scored), 2, replace=len(scored) < 2))
        giver, taker = scored[min(a, b)][2], scored[max(a, b)][2]
        g = _cross(lengths, giver, taker, 0.3 + 0.4 * rng.random(), capacity, rng)
        scored[-1] = min(scored[-1], (_score(lengths, g, capacity), len(population) + k, g), key=lambda x: x[:2])
        scored.sort(key=lambda x: x[:2])
    return [x[2] for x in scored]


_STATE = "block long, island int, home int, uids binary, lengths binary, genomes array<binary>"


def _solve(open_pieces: DataFrame, scratch: Scratch, tag: str, blocks: int, capacity: int, islands: int, population: int, children: int, epochs: int, seed: int) -> DataFrame:
    """(uid, length, block, bin, fill): the best genome of any island of each block."""

    def start(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        lengths, island = rows["length"].to_numpy(np.int64), int(key[1])
        rng = np.random.default_rng([seed, int(key[0]), island])
        found = _evolve(lengths, _first_population(lengths, population, capacity, rng), children, capacity, rng)
        return pd.DataFrame({"block": [key[0]], "island": [island], "home": [island], "uids": [rows["uid"].to_numpy(np.int64).tobytes()], "lengths": [lengths.astype(np.uint32).tobytes()], "genomes": [[g.tobytes() for g in found]]})

    def epoch(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("home", key=lambda h: h != key[1])  # the island's own row, then the guests
        own = rows.iloc[0]
        lengths = np.frombuffer(own["lengths"], np.uint32).astype(np.int64)
        rng = np.random.default_rng([seed, int(key[0]), int(key[1]), len(rows), 1])
        genomes = [np.frombuffer(g, np.uint32) for gs in rows["genomes"] for g in gs]
        found = _evolve(lengths, genomes, children, capacity, rng)[:population]
        return pd.DataFrame({"block": [key[0]], "island": [int(key[1])], "home": [int(key[1])], "uids": [own["uids"]], "lengths": [own["lengths"]], "genomes": [[g.tobytes() for g in found]]})

    def best(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("home")
        lengths = np.frombuffer(rows["lengths"].iloc[0], np.uint32).astype(np.int64)
        genomes = [np.frombuffer(g[0], np.uint32) for g in rows["genomes"]]
        g = min(genomes, key=lambda g: _score(lengths, g, capacity))
        return pd.DataFrame({"uid": np.frombuffer(rows["uids"].iloc[0], np.int64), "length": lengths, "block": key[0], "bin": g.astype(np.int64), "fill": _fill(lengths, g)[g]})

    dealt = open_pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(tag)), F.lit(blocks)).alias("block"))
    state = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).groupBy("block", "island").applyInPandas(start, _STATE)
    for k in range(epochs if islands > 1 else 0):
        state = scratch.save(state, f"{tag}-{k}")
        elite = state.select("block", ((F.col("island") + 1) % islands).alias("island"), "home", "uids", "lengths", F.slice("genomes", 1, 1).alias("genomes"))
        state = state.unionByName(elite).groupBy("block", "island").applyInPandas(epoch, _STATE)
    elites = state.select("block", "home", "uids", "lengths", F.slice("genomes", 1, 1).alias("genomes"))
    return elites.groupBy("block").applyInPandas(best, "uid long, length long, block long, bin long, fill long")


def pack(pieces: DataFrame, capacity: int, islands: int = 3, population: int = 4, children: int = 6, epochs: int = 2, block_size: int = 6000, levels: int = 2, loose: float = 0.985, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a `length` of 1 to `capacity`.

    Sequence ids are any distinct numbers; offsets are gapless from 0. A bin of
    a block is loose if filled below that share: the next level packs its
    pieces anew with those of other blocks.
    """
    spark = pieces.sparkSession
    ready_workers(spark)
    scratch = scratch or Scratch(spark, "packing")
    pieces = scratch.save(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    todo, done = pieces.where(F.col("length") < capacity).select("uid", "length"), []
    whole = pieces.where(F.col("length") >= capacity).select("uid", F.lit(-1).cast("int").alias("level"), F.lit(0).cast("long").alias("block"), F.col("uid").alias("bin"))
    for level in range(levels):
        n = todo.count()
        if not n:
            break
        blocks = -(-n // block_size)
        found = scratch.save(_solve(todo, scratch, f"level{level}", blocks, capacity, islands, population, children, epochs, seed), f"solved{level}")
        last = level == levels - 1 or blocks == 1
        tight = found if last else found.where(F.col("fill") >= int(loose * capacity))
        done.append(tight.select("uid", F.lit(level).alias("level"), "block", "bin"))
        if last:
            break
        todo = found.where(F.col("fill") < int(loose * capacity)).select("uid", "length")
    placed = whole
    for d in done:
        placed = placed.unionByName(d)
    # A sequence's number: the level in the lowest digits, then its block, then its bin.
    number = F.when(F.col("level") < 0, F.col("uid") * 4).otherwise((F.col("block") * (1 << 24) + F.col("bin")) * 4 + F.col("level") + 1)
    placed = placed.select("uid", number.alias("sequence_id"))
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.join(placed, "uid")
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
        .drop("uid")
    )


def packed_documents(docs: DataFrame, tokenizer: str, kind: str = "word", capacity: int = 2048, **parameters) -> DataFrame:
    """One row per piece of a document: where its ids begin in the document and where they lie in a sequence."""
    return pack(tokenised_pieces(docs, tokenizer, kind, capacity), capacity, **parameters)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces that kept their ids: sequence_id, n_tokens, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", joined.alias("ids"))
