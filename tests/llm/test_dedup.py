"""SimHash, components, line windows and vectors against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrametric.llm import line_dedup, metric_join, queries, simhash
from terrametric.llm.common import Scratch
from terrametric.llm.components import connected_components

from ..oracle import rows_of, sql_rows
from .conftest import SMALL


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    r = random.Random(4)
    links = {"random": [(r.randrange(300), r.randrange(300)) for _ in range(200)], "chain": [(i, i + 1) for i in range(120)], "star": [(0, i) for i in range(1, 200)] + [(5, 5)], "none": []}[shape]
    sets = Sets(300)
    for a, b in links:
        sets.join(a, b)
    df = spark.createDataFrame(links + [(None, 1)], "u long, v long")
    got = dict(tuple(x) for x in connected_components(df, Scratch(spark, "test")).collect())
    assert got == {i: sets.root(i) for i in range(300) if sets.root(i) != i}


# --- SimHash ---


def brute_print(text, words=3):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < words else [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


@pytest.mark.parametrize("radius, bits, parts", [(3, 64, 1), (7, 64, 2), (23, 128, 6)])
def test_masks_cover(radius, bits, parts):
    masks, r = simhash.covering_masks(radius, bits, parts), random.Random(1)
    for _ in range(3000):
        flipped = sum(1 << b for b in r.sample(range(bits), radius))
        assert any(not m & flipped for m in masks)


def test_fingerprints(small):
    rows = small.collect()
    assert [simhash.fingerprint((r["text"] or "").encode()) for r in rows[:80]] == [brute_print(r["text"]) for r in rows[:80]]
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    long = " ".join(f"w{i % 5000}" for i in range(70_000))
    assert simhash.fingerprint(long.encode()) == brute_print(long)


def brute_components(ids, prints, radius):
    sets, order = Sets(len(ids)), sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    a = np.array([[p >> (64 * k) & (2**64 - 1) for k in range(2)] for p in (prints[i] for i in order)], np.uint64)
    for i in range(len(order)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]).sum(axis=1) <= radius) + i + 1:
            sets.join(i, int(j))
    return [(ids[order[i]], ids[order[sets.root(i)]]) for i in range(len(order))]


@pytest.mark.parametrize("limit", [2048, 4])
def test_near_duplicates_equal_brute_force(spark, small, limit):
    base = small.limit(60).collect()
    r, rows = random.Random(2), []
    for k, x in enumerate(base):
        words = (x["text"] or "").split(" ")
        for c in range(6):
            w = list(words)
            for _ in range(c):
                w[r.randrange(len(w))] = r.choice(["x", "y"])
            rows.append((k * 10 + c, " ".join(w)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["component_id"]) for x in simhash.near_duplicates(df, limit=limit).collect())
    assert got == sorted(brute_components([i for i, _ in rows], [brute_print(t) for _, t in rows], 3))
    wide = sorted((x["doc_id"], x["component_id"]) for x in simhash.near_duplicates(df, radius=23, words_a_shingle=5, words=2, parts=6, limit=limit).collect())
    prints = [simhash.fingerprint(t.encode(), 5, 42) | simhash.fingerprint(t.encode(), 5, 43) << 64 for _, t in rows]
    assert wide == sorted(brute_components([i for i, _ in rows], prints, 23))


def test_a_full_key_is_split_without_loss(spark):
    """Prints that agree on all of one mask: the key's group exceeds the limit at several levels."""
    r = random.Random(7)
    free = [b for b in range(64) if not simhash.covering_masks(3)[0] >> b & 1]
    prints = list({sum(1 << b for b in r.sample(free, r.randrange(8))) for _ in range(400)})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "w0 long").select(F.struct("w0").alias("print"))
    scratch = Scratch(spark, "test")
    links = simhash.links_within(df, 3, scratch, limit=16).collect()
    sets, want, at = Sets(len(prints)), Sets(len(prints)), {simhash._signed(p): i for i, p in enumerate(prints)}
    for x in links:
        a, b = at[x["u"]["w0"]], at[x["v"]["w0"]]
        assert (prints[a] ^ prints[b]).bit_count() <= 3
        sets.join(a, b)
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                want.join(i, j)
    assert [sets.root(i) for i in range(len(prints))] == [want.root(i) for i in range(len(prints))]


def test_radius_of_similarity():
    assert simhash.radius_of(1.0, 64) == 0 and simhash.radius_of(0.8, 128, 0.8) == 23 and simhash.radius_of(0.9, 128) < 23


def test_deduplicated_keeps_one_of_each_group(odd, clashing, none, small):
    got = simhash.deduplicated(clashing)
    assert got.columns == clashing.columns
    kept = {(r["doc_id"], r["text"]) for r in got.collect()}
    empty = {(1, None), (2, ""), (3, "   \n\t\n "), (None, None)}
    assert len(kept & empty) == 1 and len([k for k in kept if k[1] and k[1].startswith("same text")]) == 1
    assert got.count() == len(kept) == odd.select("text").where("length(trim(text)) > 3").distinct().count() + 1
    assert simhash.deduplicated(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    found = simhash.near_duplicates(small)
    assert simhash.deduplicated(small).count() == found.select("component_id").distinct().count()


# --- lines ---


def test_line_dedup_equals_sql(spark):
    names, wanted = sql_rows(SMALL, line_dedup.SQL)
    assert rows_of(queries.op10_line_dedup(spark, SMALL)) == wanted


def test_line_dedup_cases(spark):
    texts = ["a\nb\nc\nd", " a \n\nb\nc\r\nx", "a\nb", "q\nq\nq\nq\nq", None, "", "a\nb\nc\nd\ne", "b\nc\nd\ny"]
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in line_dedup.deduplicated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("a\nb\nc\nd", 0), 1: ("\nx", 3), 2: ("a\nb", 0), 3: ("q", 4), 4: (None, 0), 5: ("", 0), 6: ("e", 4), 7: ("y", 3)}


def test_line_dedup_of_odd_rows(odd, clashing, none):
    got = line_dedup.deduplicated_lines(clashing)
    assert set(got.columns) == set(clashing.columns) and got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[11]["text"] == "other\n\nend" and by[11]["removed_lines"] == 3 and by[10]["removed_lines"] == 0
    twice = odd.where("doc_id = 10").union(odd.where("doc_id = 10"))
    assert [r["removed_lines"] for r in line_dedup.deduplicated_lines(twice).collect()] == [0, 0]  # one document in two rows
    assert line_dedup.deduplicated_lines(none).count() == 0


# --- vectors ---


def brute_links(rows, cosine):
    """Vectors are compared with those of their own length."""
    sets, degree = Sets(len(rows)), [0] * len(rows)
    by_length = {}
    for i, (_, x) in enumerate(rows):
        if x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            by_length.setdefault(len(x), []).append(i)
    for sound in by_length.values():
        a = np.array([np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in sound])
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        near = a @ a.T >= cosine
        np.fill_diagonal(near, False)
        for i, j in zip(*np.nonzero(near)):
            sets.join(sound[i], sound[j])
        for k, i in enumerate(sound):
            degree[i] = int(near[k].sum())
    return {rows[i][0]: (degree[i], rows[sets.root(i)][0], sets.root(i) == i) for i in range(len(rows))}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base, rows = rng.normal(size=(20, 16)), []
    for i in range(400):
        rows.append((i, (base[rng.integers(20)] + rng.normal(size=16) * rng.choice([0, 0, 0.05, 0.15, 0.25, 1])).astype(np.float32).tolist()))
    for x in (None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0] * 5, [1e-30] * 16, [-0.0] * 15 + [1.0], [0.0] * 15 + [1.0], [], [1.0], [-1.0], [2.0], [1.0, 0.0], [1.0, 0.01], [0.0, 1.0]):
        rows.append((len(rows), x))
    for i in range(150):  # another length with copies and near ones
        rows.append((len(rows), (np.array([[1, 2, 3], [3, -1, 0], [0, 0, -2]][i % 3]) + rng.normal(size=3) * rng.choice([0, 0.1, 2])).astype(np.float32).tolist()))
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("parameters", [{}, {"cell_size": 50, "block": 40}, {"cell_size": 20, "max_pivots": 7}])
def test_vectors_equal_brute_force(vectors, parameters):
    rows, df = vectors
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metric_join.linked_vectors(df, **parameters).collect()}
    assert got == brute_links(rows, 0.95)


def test_vectors_of_odd_tables(spark, vectors):
    _, df = vectors
    assert metric_join.linked_vectors(df.where("false")).count() == 0
    assert [r["n_links"] for r in metric_join.linked_vectors(df.where("vec_id = 401")).collect()] == [0]
    same = spark.range(300).select(F.when(F.col("id") < 299, F.col("id")).alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("uid"), F.lit(2).alias("root"))
    got = metric_join.linked_vectors(same).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)} and sum(r["kept"] for r in got) == 1
