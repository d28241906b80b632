"""Near-duplicates by the exact similarity of shingle sets, with candidates from covering SimHash tables.

Rows with equal shingle sets are one node, and a node has a SimHash of its set.
Its bits are cut into parts, each with a covering family of masks (see
simhash): any two nodes within `radius` differing bits of a part meet in one of
its tables, so every pair within parts * (radius + 1) - 1 bits meets for
certain, and of the pairs that are just `similarity` alike all but one in a
thousand meet in some part (`layout`). Width, radius and number of parts follow
from the number of rows, so that keys grow longer with the corpus; this share
does not change with them.

1. In each key, nodes whose first words differ in no more bits than `reach`
   are close. Ties join them, each of a node with the smallest of a joined
   group that is close to it.
2. Ties join loose groups. A node's tie to the least node over all keys is
   verified by the exact similarity of the two texts: shared shingles over all
   shingles of both. Links that hold join clusters.
3. A loose group that is one cluster, or a tied pair, is decided. In any other,
   all nodes of different clusters are compared exactly, in one task, or where
   it has more than `limit` nodes by blocks of which every two meet in a task.

So a large group of near copies costs two texts a node, not one a pair; only
loose groups that are alike but not alike enough are compared as a whole, each
text once if the group is not large. Less alike nodes are joined through other
members of their component only.

A key with more than `limit` nodes is dealt into blocks in the same way.

Defined results: as in simhash, but that texts without words, null included,
are one node that is linked with no other. A set of fewer than similarity /
(1 - similarity) shingles is like no other set and enters no table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, forget_resident, ready_workers, release_memory
from .components import connected_components
from .simhash import SEED, WORD, bit_totals, components_of, covering_masks, distances, radius_of, share_within, shingles_of

#: 64-bit words of a fingerprint that are compared within a key.
COMPARED = 3
#: Share of pairs just alike enough that meet in a key, and that are close there.
MEET, CLOSE = 0.999, 0.995
#: Nodes of one key, or of one group, that are compared in one task.
KEY_LIMIT, GROUP_LIMIT = 2048, 1024
#: Radii of a part that are tried; its bits are at least as many as labels.
RADII = (1, 2, 3, 4)


@dataclass(frozen=True)
class Layout:
    """How fingerprints are cut: parts of `width` bits with masks that cover `radius` of them."""

    parts: int
    width: int
    radius: int

    @property
    def masks(self) -> list[int]:
        return covering_masks(self.radius, self.width)

    @property
    def tables(self) -> int:
        return self.parts * len(self.masks)

    @property
    def words(self) -> int:
        return max(COMPARED, -(-self.parts * self.width // WORD))

    def kept(self, rows: int) -> float:
        """Rows that random fingerprints leave in a key, on average over tables."""
        masks = self.masks
        return sum(rows / 2 ** m.bit_count() for m in masks) / len(masks)


def layout(rows: int, similarity: float = 0.8) -> Layout:
    """The cheapest cut for so many rows in which MEET of the pairs of that similarity have a key in common.

    A table costs a row to shuffle, taken as 1, and its key's comparisons, taken
    as 1 for 500 rows; a fingerprint's bits cost 1 for 8.
    """
    best = None
    for radius in RADII:
        labels = 2 ** (radius + 1) - 1
        for width in range(labels, WORD):
            met = share_within(similarity, width, radius)
            parts = max(1, math.ceil(math.log(1 - MEET) / math.log1p(-met))) if met < MEET else 1
            cut = Layout(parts, width, radius)
            cost = cut.tables * (1 + rows * 2.0 ** (-width * 2**radius / labels) / 500) + cut.words * WORD / 8
            if best is None or cost < best[0]:
                best = cost, cut
    return best[1]


def shingle_set(text: bytes | None, words_a_shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    import xxhash

    shingles = shingles_of(text, words_a_shingle)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """Further hashes from one: a finaliser over each number and k."""
    if not k:
        return x
    x = x + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bits_of(sets: list[np.ndarray], words: int) -> np.ndarray:
    """SimHashes of sorted sets that are not empty, 64 bits a word: what over half of the hashes have, or the least one at a tie."""
    n, least = np.array([[len(s)] for s in sets]).reshape(-1, 1), np.array([s[0] for s in sets], np.uint64)
    out = np.empty((len(sets), words, WORD), np.uint8)
    for k in range(words):
        tie = np.unpackbits(_mixed(least, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[:, k] = 2 * bit_totals(sets, lambda x: _mixed(x, k)) + tie > n  # noqa: B023
    return out.reshape(len(sets), words * WORD)


def _parts(bits: np.ndarray, cut: Layout) -> np.ndarray:
    """Each part's bits as one long, a row for each fingerprint."""
    own = np.zeros((len(bits), cut.parts, WORD), np.uint8)
    own[:, :, : cut.width] = bits[:, : cut.parts * cut.width].reshape(-1, cut.parts, cut.width)
    return np.packbits(own, axis=2, bitorder="little").view("<i8").reshape(-1, cut.parts)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether shared elements are this share of all, for sorted sets."""
    both = len(a) + len(b)
    if (1 + similarity) * min(len(a), len(b)) < similarity * both - 1e-9:
        return False
    return (1 + similarity) * shared(a, b) >= similarity * both - 1e-9


def forest(sets: list[np.ndarray], similarity: float, known: list | None = None) -> list[tuple[int, int]]:
    """Links that join what the pairs that are alike join; of one cluster in `known` are those already joined."""
    groups: list[list[int]] = []  # each in order of size
    of: dict[object, list[int]] = {}
    links = []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own = of.get(known[i]) if known else None
        met, others = [i], []
        for group in groups:
            j = -1
            if group is not own:
                for k in reversed(group):
                    if len(sets[k]) < similarity * len(sets[i]) - 1e-9:
                        break
                    if alike(sets[k], sets[i], similarity):
                        j = k
                        break
            if group is own:
                met += group
            elif j < 0:
                others.append(group)
            else:
                links.append((i, j))
                met += group
        now = sorted(met, key=lambda k: (len(sets[k]), k == i))
        if known:
            for k in met:
                of[known[k]] = now
        groups = [*others, now]
    return links


def nodes_of(docs: DataFrame, cut: Layout, words_a_shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, print, near, parts): a row per input row.

    print names its set of shingles; near and parts are the compared words and
    the parts of its fingerprint, null for a set that is like no other.
    """
    least = similarity / (1 - similarity) if similarity < 1 else math.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget_resident()
        for batch in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None, words_a_shingle) for t in batch.column(2)]
            prints = np.array([[xxhash.xxh64_intdigest(s.tobytes(), SEED + k) if len(s) else 0 for k in range(2)] for s in sets], np.uint64).reshape(-1, 2)
            at = [i for i, s in enumerate(sets) if len(s) >= least - 1e-9]
            bits = bits_of([sets[i] for i in at], cut.words)
            near = np.packbits(bits[:, : COMPARED * WORD], axis=1, bitorder="little").view("<i8").reshape(-1, COMPARED)
            lists = []
            for numbers in (near, _parts(bits, cut)):
                place = np.full(len(sets), -1)
                place[at] = np.arange(len(at))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(numbers.ravel()), numbers.shape[1]).cast(pa.list_(pa.int64()))
                lists.append(rows.take(pa.array(place, mask=place < 0)))
            words = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in prints.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *words, *lists], ["doc_id", "text_hash", "w0", "w1", "near", "parts"])
            release_memory()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = given.mapInArrow(run, "doc_id long, text_hash long, w0 long, w1 long, near array<long>, parts array<long>")
    return found.select("doc_id", "text_hash", F.struct("w0", "w1").alias("print"), "near", "parts")


_NEAR = [f"n{k}" for k in range(COMPARED)]


def _ties_of(prints: np.ndarray, reach: int) -> tuple[list[int], list[int]]:
    """Places of ties that join all close ones of sorted prints, each of a print with the first of a joined group before it."""
    label, later, first = np.arange(len(prints)), [], []
    for at in range(0, len(prints), 256):
        own = prints[at : at + 256]
        close = distances(own, prints[: at + len(own)]) <= reach
        close[:, at:] = np.tril(close[:, at:], -1)
        for i in np.flatnonzero(close.any(axis=1)).tolist():
            js = np.flatnonzero(close[i])
            groups, place = np.unique(label[js], return_index=True)
            later += [at + i] * len(groups)
            first += js[place].tolist()
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]
            label[at + i] = groups[0]
    return later, first


def _scan(reach: int, limit: int):
    """Over rows (key, near) sorted: kind 0 the ties of each key's prints, kind 1 the rows of keys with more than the limit.

    Without a limit all keys are compared at once.
    """
    names = ["kind", "key", *[f"{a}{n}" for a in "uv" for n in _NEAR]]

    def rows(kind: int, key: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        longs = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in [*u.T, *v.T]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), *longs], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, crowd = np.empty(0, np.int64), np.empty((0, COMPARED), np.uint64), None

        def ended(upto: int) -> Iterator[pa.RecordBatch]:
            edges = [0, *(np.flatnonzero(keys[1:upto] != keys[: upto - 1]) + 1).tolist(), upto]
            us, vs = [], []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if z - a > 1 and keys[a] != crowd:
                    u, v = _ties_of(prints[a:z], reach)
                    if u:
                        us.append(prints[a:z][u])
                        vs.append(prints[a:z][v])
                elif z > a and keys[a] == crowd:
                    yield rows(1, keys[a:z], prints[a:z], prints[a:z])
            if us:
                u = np.concatenate(us)
                yield rows(0, np.zeros(len(u), np.int64), u, np.concatenate(vs))

        for b in batches:
            key, *words = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            keys = np.concatenate([keys, key])
            prints = np.concatenate([prints, np.stack([np.ascontiguousarray(w).view(np.uint64) for w in words], axis=1)])
            new = np.ones(len(keys), bool)  # rows of one key and print follow each other
            new[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1]).any(axis=1)
            keys, prints = keys[new], prints[new]
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield from ended(last)
                keys, prints = keys[last:], prints[last:]
            if limit and len(keys) > limit:  # what is held stays bounded
                crowd = keys[0]
                yield from ended(len(keys) - 1)
                keys, prints = keys[-1:], prints[-1:]
        yield from ended(len(keys))

    return scan, ", ".join(["kind int", *(f"{n} long" for n in names[1:])])


def ties(nodes: DataFrame, cut: Layout, reach: int, scratch: Scratch, limit: int = KEY_LIMIT) -> DataFrame:
    """(u0.., v0..): words of prints that join all that are close and have a key in common."""
    masks = F.array(*[F.lit(m) for m in cut.masks])
    keys = F.flatten(F.transform("parts", lambda p, i: F.transform(masks, lambda m, j: F.xxhash64(i, j, p.bitwiseAND(m)))))
    words = [F.element_at("near", k + 1).alias(n) for k, n in enumerate(_NEAR)]
    rows = nodes.where("parts is not null").select(*words, F.explode(keys).alias("key")).select("key", *_NEAR)
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key", *_NEAR)
    scan, schema = _scan(reach, limit)
    found = scratch.save(by_key(rows).mapInArrow(scan, schema), "scan")
    ends = [f"{a}{n}" for a in "uv" for n in _NEAR]
    out = found.where("kind = 0").select(*ends)
    crowded = found.where("kind = 1").select("key", *[F.col(f"u{n}").alias(n) for n in _NEAR])
    if not crowded.isEmpty():
        blocks = crowded.groupBy("key").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
        met, _ = _scan(reach, 0)
        dealt = in_blocks(crowded.join(blocks, "key"), ["key"], _NEAR).select(F.col("task").alias("key"), *_NEAR)
        out = out.unionByName(scratch.save(by_key(dealt).mapInArrow(met, schema), "crowded").select(*ends))
    return out.distinct()


def in_blocks(rows: DataFrame, group: list[str], member: list[str]) -> DataFrame:
    """Rows with `task`, once for each of their group's `blocks`: every two blocks of a group meet in a task."""
    own = rows.withColumn("i", F.pmod(F.xxhash64(*member), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.withColumn("task", F.xxhash64(*group, F.least("i", "j"), F.greatest("i", "j")))


_LINKS = "a0 long, a1 long, b0 long, b1 long"


def _links(rows: DataFrame) -> DataFrame:
    node = lambda x: F.struct(F.col(f"{x}0").alias("w0"), F.col(f"{x}1").alias("w1"))
    return rows.select(node("a").alias("u"), node("b").alias("v"))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, words_a_shingle: int) -> DataFrame:
    """Of pairs (u, v) of nodes (print, text_hash) those that are alike enough, by their texts."""
    both = pairs.select("u.print.w0", "u.print.w1", F.col("v.print.w0").alias("v0"), F.col("v.print.w1").alias("v1"), F.col("u.text_hash").alias("hu"), F.col("v.text_hash").alias("hv"))
    both = both.join(texts.select(F.col("text_hash").alias("hu"), F.col("text").alias("tu")), "hu").join(texts.select(F.col("text_hash").alias("hv"), F.col("text").alias("tv")), "hv")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (tuple(shingle_set(x.as_buffer().to_pybytes(), words_a_shingle) for x in pair) for pair in zip(b.column(4), b.column(5), strict=True))
            holds = pa.array([alike(s, t, similarity) for s, t in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(k).filter(holds) for k in range(4)], ["a0", "a1", "b0", "b1"])
            release_memory()

    return _links(both.select("w0", "w1", "v0", "v1", "tu", "tv").mapInArrow(compare, _LINKS))


def compared(members: DataFrame, texts: DataFrame, similarity: float, words_a_shingle: int) -> DataFrame:
    """Links between members (task, print, cluster, text_hash) of a task and of different clusters that are alike enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, prints, known, sets = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if found := forest(sets, similarity, known):
                ends = [(*prints[a], *prints[b]) for a, b in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ends, strict=True)], ["a0", "a1", "b0", "b1"])

        for b in batches:
            for task, w0, w1, c0, c1, text in zip(*(c.to_pylist() for c in b.columns[:5]), b.column(5), strict=True):
                if task != at:
                    yield from close()
                    at, prints, known, sets = task, [], [], []
                prints.append((w0, w1))
                known.append((c0, c1))
                sets.append(shingle_set(text.as_buffer().to_pybytes(), words_a_shingle))
        yield from close()
        sets = []
        release_memory()

    gathered = members.join(texts, "text_hash").select("task", "print.w0", "print.w1", F.col("cluster.w0").alias("c0"), F.col("cluster.w1").alias("c1"), "text")
    return _links(gathered.repartition("task").sortWithinPartitions("task").mapInArrow(compare, _LINKS))


def links_between(nodes: DataFrame, docs: DataFrame, cut: Layout, similarity: float, words_a_shingle: int, scratch: Scratch, text_col: str = "text", limit: int = KEY_LIMIT, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(u, v): links between nodes (print, text_hash, near, parts) that join all candidates that are alike enough."""
    reach = radius_of(similarity, COMPARED * WORD, CLOSE)
    words = lambda a: F.array(*[F.col(f"{a}{n}") for n in _NEAR])
    tied = scratch.save(ties(nodes, cut, reach, scratch, limit).select(words("u").alias("u"), words("v").alias("v")), "ties")
    # Several nodes can have the same compared words: the least one stands for them.
    node = F.struct("print", "text_hash")
    stands = nodes.where("near is not null").groupBy("near").agg(F.min(node).alias("stand"), F.count("*").alias("n"))
    some = tied.select(F.col("u").alias("near")).unionByName(tied.select(F.col("v").alias("near"))).distinct()
    stands = scratch.save(stands.join(some.withColumn("tied", F.lit(True)), "near", "left").where("tied or n > 1").select("near", "stand"), "stands")
    members = scratch.save(nodes.select("near", node.alias("node")).join(stands, "near").select("node", "stand"), "members")
    ends = tied.join(stands.select(F.col("near").alias("u"), F.col("stand").alias("a")), "u").join(stands.select(F.col("near").alias("v"), F.col("stand").alias("b")), "v")
    loose = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    loose = scratch.save(loose.unionByName(members.where("node <> stand").select(F.col("node").alias("u"), F.col("stand").alias("v"))), "loose")

    # A node's tie to the least node of all, verified.
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    texts = scratch.save(texts.join(members.select("node.text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"]), "texts")
    chosen = scratch.save(loose.groupBy("u").agg(F.min("v").alias("v")), "chosen")
    holds = scratch.save(verified(chosen, texts, similarity, words_a_shingle), "holds")
    clusters = connected_components(holds, scratch, name="holds").select(F.col("node").alias("print"), F.col("root").alias("cluster"))

    # What ties different clusters is compared as a whole.
    placed = scratch.save(members.select("node.*").join(clusters, "print", "left").withColumn("cluster", F.coalesce("cluster", "print")), "placed")
    of = lambda end, name: placed.select(F.col("print").alias(end), F.col("cluster").alias(name))
    open_ties = loose.select(F.col("u.print").alias("u"), F.col("v.print").alias("v")).join(of("u", "a"), "u").join(of("v", "b"), "v").where("a <> b")
    groups = connected_components(open_ties.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), scratch, name="open")
    groups = scratch.save(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("cluster"), F.col("root").alias("group")), "groups")
    grouped = placed.join(groups, "cluster")
    # Two nodes are decided: their tie has been verified.
    blocks = grouped.groupBy("group").agg(F.ceil(F.count("*") / group_limit).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 2").select("group", "blocks")
    tasks = scratch.save(in_blocks(grouped.join(blocks, "group"), ["group"], ["print"]).select("task", "print", "cluster", "text_hash"), "tasks")
    more = scratch.save(compared(tasks, texts, similarity, words_a_shingle), "compared")
    return clusters.select(F.col("print").alias("u"), F.col("cluster").alias("v")).unionByName(more)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words_a_shingle: int = 5, scratch: Scratch | None = None, limit: int = KEY_LIMIT, group_limit: int = GROUP_LIMIT, id_col: str = "doc_id", text_col: str = "text", cut: Layout | None = None) -> DataFrame:
    """(doc_id, text_hash, print, root, component_id): a row per input row, as simhash.near_duplicates gives.

    cut: how fingerprints are cut, by the number of rows where none is given.
    """
    ready_workers(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    cut = cut or layout(docs.count(), similarity)
    found = scratch.save(nodes_of(docs, cut, words_a_shingle, similarity, id_col, text_col), "prints")
    # Copies of a set have one fingerprint.
    nodes = scratch.save(found.groupBy("print").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("near").alias("near"), F.first("parts").alias("parts")), "distinct")
    links = links_between(nodes, docs, cut, similarity, words_a_shingle, scratch, text_col, limit, group_limit)
    return components_of(found, nodes.select("print", "least"), links, scratch)
