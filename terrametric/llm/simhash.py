"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A covering family of bit masks sends every pair of fingerprints within the
radius to the same key in at least one table, so no link is lost. The bits are
cut into parts; of a pair within the radius, one part has at most radius /
parts differing bits. In a part of radius r the bits are labelled by vectors of
GF(2)^(r+1), and a mask holds the bits whose label has odd product with one
nonzero vector; the labels of at most r differing bits always have a vector
that is orthogonal to all of them, and its mask sees no difference. One part
gives few tables with long keys, more parts let the radius be large.

Only distinct fingerprints enter the tables, so exact copies cost nothing. A
key's fingerprints are compared in one task if they are few. A key with more is
split by the bits outside its mask, into radius + 1 groups of bits of which a
pair within the radius agrees on one; that repeats until keys are small or so
few bits are left that all are within the radius. A pair is linked in the
first table it meets in, not in each. Where many of a key's pairs
are near copies, which no bits part, its fingerprints are dealt into blocks
instead, and every two blocks meet in a task. Tasks give a spanning forest of
the links, not all pairs.

Defined results: null text is an empty text; texts without words have
fingerprint zero and are linked like others; rows of one id are fingerprinted
each; a component's id ignores null ids and is null if all are; an empty table
gives an empty result; other columns are carried along by `deduplicated` and
ignored otherwise, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, ready_workers
from .components import connected_components

WORD = 64
#: Fixed value: the seed of XXH64 over shingles; further words of a fingerprint take the next seeds.
SEED = 42
#: Fingerprints of one key that are compared in one task.
KEY_LIMIT = 2048
#: Share of pairs within the radius from which a full key is compared by blocks: splitting would not part near copies.
DENSE = 0.01


def share_within(similarity: float, bits: int, radius: int) -> float:
    """About the share of pairs of that shingle-set similarity that differ in at most `radius` bits, for sets of equal size.

    Sets of other sizes that are as similar differ in fewer bits.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1))


def radius_of(similarity: float, bits: int, share: float = 0.85) -> int:
    """Bits within which about this share of pairs of that shingle-set similarity lie."""
    return next(k for k in range(bits + 1) if k == bits or share_within(similarity, bits, k) >= share)


def shingles_of(text: bytes | None, words_a_shingle: int) -> list[bytes]:
    """Of UTF-8 text, lower-cased A-Z: runs of words between ASCII white space, repeats included, joined by spaces."""
    words = (text or b"").lower().split()
    if len(words) <= words_a_shingle:
        return [b" ".join(words)] if words else []
    # Shingles are slices of the words joined by single spaces.
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words_a_shingle].tolist()
    return [line[a:b] for a, b in zip(starts, ends[words_a_shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None, words_a_shingle: int = 3, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; zero without words."""
    return int(_fingerprints([shingles_of(text, words_a_shingle)], seed)[0])


def _fingerprints(shingles: list[list[bytes]], seed: int) -> np.ndarray:
    import xxhash

    sets = [np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(seed)), np.uint64, len(s)) for s in shingles]
    return np.packbits(2 * bit_totals(sets) > np.array([[len(s)] for s in sets]), axis=1, bitorder="little").view("<u8").ravel()


#: Hashes whose bits are counted at once.
COUNTED = 1 << 14
_LANES = np.uint64(0x0101010101010101)


def bit_totals(sets: list[np.ndarray], derived: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """How many of each array's hashes have each bit set: a row of 64 an array. derived: hashes to count instead of those given."""
    total = np.zeros((len(sets), WORD), np.int64)
    pieces = [(i, s[a : a + COUNTED]) for i, s in enumerate(sets) for a in range(0, len(s), COUNTED)]
    ends = np.cumsum([len(p) for _, p in pieces])
    at = 0
    while at < len(pieces):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] - len(pieces[at][1]) + COUNTED, side="right")))
        n = np.array([len(p) for _, p in pieces[at:upto]])
        x = derived(np.concatenate([p for _, p in pieces[at:upto]]))
        # Every eighth bit is summed in a byte of its own, over runs of at most 255 hashes.
        runs = -(-n // 255)
        first = np.cumsum(runs) - runs
        starts = np.repeat(np.cumsum(n) - n - 255 * first, runs) + 255 * np.arange(runs.sum())
        counts = np.empty((len(n), 8, 8), np.int64)
        for k in range(8):
            lanes = np.add.reduceat((x >> np.uint64(k)) & _LANES, starts)
            counts[:, :, k] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        np.add.at(total, [i for i, _ in pieces[at:upto]], counts.reshape(-1, WORD))
        at = upto
    return total


def covering_masks(radius: int, bits: int = WORD, parts: int = 1) -> list[int]:
    """Masks of which, for any `radius` bits, one in some part holds none of them."""
    r = radius // parts
    labels = (1 << (r + 1)) - 1
    out = []
    for part in range(parts):
        own = range(part, bits, parts)
        out += [sum(1 << i for k, i in enumerate(own) if ((k % labels + 1) & v).bit_count() % 2) for v in range(1, labels + 1)]
    return out


def refined_masks(mask: int, radius: int, bits: int) -> list[int]:
    """The mask with one of radius + 1 groups of the other bits each."""
    rest = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in rest[k :: radius + 1]) for k in range(radius + 1)]


def _words(x: int, n: int) -> list[int]:
    return [x >> (WORD * k) & (2**WORD - 1) for k in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits between all rows of two matrices of words."""
    return sum(np.bitwise_count(a[:, k, None] ^ b[None, :, k]) for k in range(a.shape[1]))


def _forest(prints: np.ndarray, radius: int, earlier: np.ndarray) -> list[tuple[int, int]]:
    """Places of links that join what pairs within the radius join, at most one less than there are prints.

    earlier: masks, as rows of words, of the tables before this one; a pair that
    agrees on one of them has been met there and is left out here.
    """
    n, links = len(prints), []
    label = np.arange(n)
    for at in range(0, n, 256):
        i, j = np.nonzero(np.triu(distances(prints[at : at + 256], prints[at:]) <= radius, 1))
        i, j = i + at, j + at
        differ = prints[i] ^ prints[j]
        for mask in earlier:
            if not len(i):
                break
            new = (differ & mask).any(axis=1)
            i, j, differ = i[new], j[new], differ[new]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        for a, js in zip(i[first].tolist(), np.split(j, first[1:]), strict=True) if len(i) else ():
            for other in np.unique(label[js]):
                if other != label[a]:
                    links.append((a, int(js[label[js] == other][0])))
                    label[label == other] = label[a]
    return links


def _scan(masks: list[int], level: int, radius: int, words: int, limit: int):
    """Over rows (table, key, words) sorted by key: links of small keys, what becomes of large ones.

    A table's number at a level is its parent's times radius + 1 and its own.
    Out come rows (kind, numbers): kind 0 two fingerprints' words, kind 1 a
    table, a key and a fingerprint's words for the next level, kind 2 the same
    for a comparison by blocks. Without a limit all keys are compared at once.
    """
    bits, width = words * WORD, 2 + 2 * words
    names = ["kind", *(f"n{k}" for k in range(width - 1))]

    def mask_of(table: int) -> int:
        path = []
        for _ in range(level):
            table, c = divmod(table, radius + 1)
            path.append(c)
        mask = masks[table]
        for c in reversed(path):
            mask = refined_masks(mask, radius, bits)[c]
        return mask

    table_masks = np.array([_words(m, words) for m in masks], np.uint64)

    def batch(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        n = len(columns[0])
        columns = [*columns, *[np.zeros(n, np.int64)] * (width - 1 - len(columns))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns)], names)

    def finer(table: int, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        for c, mask in enumerate(refined_masks(mask_of(table), radius, bits)):
            key = np.zeros(len(prints), np.uint64)
            for k, m in enumerate(_words(mask, words)):
                key = (key ^ (prints[:, k] & np.uint64(m))) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            yield batch(1, [np.full(len(prints), table * (radius + 1) + c, np.int64), key, *prints.T])

    def crowd(table: int, key: int, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield batch(2, [np.full(len(prints), table, np.int64), np.full(len(prints), key, np.int64), *prints.T])

    def way(table: int, prints: np.ndarray) -> str:
        """How a key with too many fingerprints goes on, by what its mask leaves and by some of its pairs."""
        if bits - mask_of(table).bit_count() <= radius:
            return "chain"  # all are within the radius
        near = (distances(prints[:256], prints) <= radius).sum() - len(prints[:256])  # not each with itself
        near = near / (len(prints[:256]) * (len(prints) - 1))
        return "blocks" if near >= DENSE else "finer"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, mode = np.empty((0, words), np.uint64), None, ""

        def close() -> Iterator[pa.RecordBatch]:
            if mode == "finer":
                yield from finer(at[0], held)
            elif mode == "blocks":
                yield from crowd(*at, held)
            elif len(held) > 1 and (links := _forest(held, radius, table_masks[: at[0] // (radius + 1) ** level])):
                u, v = np.array(links).T
                yield batch(0, [*held[u].T, *held[v].T])

        for b in batches:
            table, key, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            prints = np.stack([np.ascontiguousarray(c).view(np.uint64) for c in rest], axis=1)
            new = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            edges = [0, *new.tolist(), len(prints)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                here = (int(table[a]), int(key[a])) if z > a else at
                if here != at:
                    if mode or len(held) > 1:
                        yield from close()
                    held, at, mode = prints[a:z], here, ""
                else:
                    held = np.concatenate([held, prints[a:z]])
                if limit and len(held) > limit:  # what is held stays bounded
                    mode = mode or way(at[0], held)
                    if mode == "chain":
                        yield batch(0, [*held[:-1].T, *held[1:].T])
                        held = held[-1:]
                    else:
                        yield from finer(at[0], held) if mode == "finer" else crowd(*at, held)
                        held = held[:0]
        yield from close()

    return scan, ", ".join(["kind int", *(f"{n} long" for n in names[1:])])


def links_within(prints: DataFrame, radius: int, scratch: Scratch, words: int = 1, parts: int = 1, limit: int = KEY_LIMIT) -> DataFrame:
    """(u, v): links between the distinct fingerprints `print` that join all pairs within the radius."""
    ready_workers(prints.sparkSession)
    masks = covering_masks(radius, words * WORD, parts)
    tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), *[F.lit(_signed(m)).alias(f"m{k}") for k, m in enumerate(_words(mask, words))]) for t, mask in enumerate(masks)])
    own = [F.col(f"print.w{k}") for k in range(words)]
    rows = prints.select("print", F.explode(tables).alias("m")).select(F.col("m.t").alias("n0"), F.xxhash64(*[p.bitwiseAND(F.col(f"m.m{k}")) for k, p in enumerate(own)]).alias("n1"), *[p.alias(f"n{2 + k}") for k, p in enumerate(own)])
    names = [f"n{k}" for k in range(2 + words)]
    node = lambda first: F.struct(*[F.col(f"n{first + k}").alias(f"w{k}") for k in range(words)])
    by_key = lambda df: df.repartition("n0", "n1").sortWithinPartitions("n0", "n1")
    links, level = None, 0
    while True:
        scan, schema = _scan(masks, level, radius, words, limit)
        found = scratch.save(by_key(rows).mapInArrow(scan, schema), f"scan-{level}")
        crowded = found.where("kind = 2").select(*names)
        if not crowded.isEmpty():
            # Every two blocks of a key meet in one task; a key's tasks are numbered into the key.
            n = crowded.groupBy("n0", "n1").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
            own_block = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int")
            pairs = crowded.join(n, ["n0", "n1"]).withColumn("i", own_block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            task = F.xxhash64("n1", F.least("i", "j"), F.greatest("i", "j")).alias("n1")
            compare, _ = _scan(masks, level, radius, words, 0)
            met = scratch.save(by_key(pairs.select("n0", task, *names[2:])).mapInArrow(compare, schema), f"blocks-{level}")
            found = found.where("kind < 2").unionByName(met)
        now = found.where("kind = 0").select(node(0).alias("u"), node(words).alias("v"))
        links = now if links is None else links.unionByName(now)
        rows = found.where("kind = 1").select(*names)
        if rows.isEmpty():
            return links
        level += 1


def fingerprints(docs: DataFrame, words_a_shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, print): a row per input row; print has the fingerprint's words as signed longs."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [shingles_of(t.as_buffer().to_pybytes() if t.is_valid else None, words_a_shingle) for t in batch.column(2)]
            columns = [_fingerprints(shingles, SEED + k).view(np.int64) for k in range(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns)], ["doc_id", "text_hash", *(f"w{k}" for k in range(words))])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = given.mapInArrow(run, ", ".join(["doc_id long", "text_hash long", *(f"w{k} long" for k in range(words))]))
    return found.select("doc_id", "text_hash", F.struct(*[f"w{k}" for k in range(words)]).alias("print"))


def near_duplicates(docs: DataFrame, radius: int = 3, words_a_shingle: int = 3, words: int = 1, parts: int = 1, scratch: Scratch | None = None, limit: int = KEY_LIMIT, **columns: str) -> DataFrame:
    """(doc_id, text_hash, print, root, component_id): a row per input row.

    words: 64-bit words of a fingerprint; parts: into how many its bits are cut
    for the tables. root is a fingerprint that tells components apart; component_id is the smallest doc_id among all rows whose fingerprints are
    joined by links of at most `radius` differing bits.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    found = scratch.save(fingerprints(docs, words_a_shingle, words, **columns), "prints")
    distinct = scratch.save(found.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    return components_of(found, distinct, links_within(distinct.select("print"), radius, scratch, words, parts, limit), scratch)


def components_of(found: DataFrame, distinct: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows `found` with the components that links join their prints to; distinct: (print, least doc_id)."""
    roots = connected_components(links, scratch)
    # A few prints are linked; the others are components of their own.
    member = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    joined = roots.select(F.col("node").alias("print"), "root").unionByName(roots.select(F.col("root").alias("print"), "root").distinct())
    least = joined.join(distinct.select("print", "least"), "print").groupBy("root").agg(F.min("least").alias("component"))
    named = member.join(least, "root", "left").select("print", "root", F.coalesce("component", "least").alias("component_id"))
    return found.join(named, "print").select("doc_id", "text_hash", "print", "root", "component_id")


def deduplicated(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates, **parameters) -> DataFrame:
    """The input rows without near-duplicates: of each component the row with the smallest id stays.

    find: what gives the components, with these parameters. A null id counts as the smallest. Of rows that share the id, the one with
    the smallest text hash stays; of rows that share both, any one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    found = scratch.save(find(docs, scratch=scratch, id_col=id_col, text_col=text_col, **parameters), "components")
    # Keys without nulls, so that the semi-join's exchange serves the last step too.
    id_known, id_or_zero = F.col("doc_id").isNotNull().alias("id_known"), F.coalesce("doc_id", F.lit(0)).alias("id_or_zero")
    stays = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select("s.*").select(id_known, id_or_zero, "text_hash")
    keyed = docs.select(carried(docs), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash")).select("row", id_known, id_or_zero, "text_hash")
    key = ["id_known", "id_or_zero", "text_hash"]
    return keyed.join(stays, key, "left_semi").dropDuplicates(key).select("row.*")
