"""Near-duplicates by exact similarity against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from terrametric.llm import similar, simhash

from .test_dedup import Sets


def shingles(text, n=5):
    return set(simhash.shingles_of((text or "").encode(), n))


def brute(rows, similarity, cut):
    """Components by all pairs that are alike enough, and by those of them that share a key and are close."""
    order, every = sorted(rows), Sets(len(rows))
    hashes = [similar.shingle_set((t or "").encode(), 5) for _, t in order]
    sets, own = Sets(len(order)), [shingles(t) for _, t in order]
    bits = [similar.bits_of([h], cut.words)[0] if len(h) > 3 else None for h in hashes]
    reach = simhash.radius_of(similarity, 64 * similar.COMPARED, similar.CLOSE)
    exact = met = 0
    for i, a in enumerate(own):
        for j in range(i):
            if a == own[j]:
                sets.join(i, j)
                every.join(i, j)
            elif a and own[j] and 5 * len(a & own[j]) >= 5 * similarity * len(a | own[j]) - 1e-9:
                exact += 1
                every.join(i, j)
                differ = bits[i] != bits[j]
                parts = [sum(1 << k for k in np.flatnonzero(differ[p * cut.width : (p + 1) * cut.width]).tolist()) for p in range(cut.parts)]
                if differ[: 64 * similar.COMPARED].sum() <= reach and any(not m & d for d in parts for m in cut.masks):
                    met += 1
                    sets.join(i, j)
    return *({order[i][0]: order[x.root(i)][0] for i in range(len(order))} for x in (every, sets)), met / max(1, exact)


def refines(a, b):
    """Whether each class of a lies in one of b."""
    return len({(a[k], b[k]) for k in a}) == len(set(a.values()))


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def copies(r, texts):
    rows = [(0, None), (1, ""), (2, "word"), (3, "word word"), (4, " \n")]
    for text in texts:
        words = (text or "").split() or ["a"]
        for c in range(8):
            rows.append((10 + len(rows), edited(r, words, c * len(words) // 180 + c % 2)))
    return rows


#: As many rows as the cut is made for, and the most nodes of a key and of a group in one task.
@pytest.mark.parametrize("rows_of_cut, limit, group_limit", [(None, 2048, 1024), (20_000, 8, 3), (13_000_000, 2048, 1024)])
def test_components_equal_brute_force(spark, small, rows_of_cut, limit, group_limit):
    rows = copies(random.Random(3), [x["text"] for x in small.limit(40).collect()])
    cut = similar.layout(rows_of_cut or len(rows))
    found = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit, group_limit=group_limit, cut=cut)
    every, sure, met = brute(rows, 0.8, cut)
    got = {x["doc_id"]: x["component_id"] for x in found.collect()}
    assert all(c == min(k for k in got if got[k] == c) for c in got.values())
    assert refines(sure, got) and refines(got, every) and met > 0.98


@pytest.mark.parametrize("rows", [10**4, 10**6, 13 * 10**6, 10**9])
def test_layout(rows):
    """Keys grow longer with the corpus; every pair within the radius meets, and nearly all that are alike."""
    cut, r = similar.layout(rows), random.Random(rows)
    assert cut.kept(rows) < similar.KEY_LIMIT and cut.width <= 63 and cut.words * 64 >= cut.parts * cut.width
    for _ in range(500):
        part = sum(1 << b for b in r.sample(range(cut.width), cut.radius))
        assert any(not m & part for m in cut.masks)
    assert 1 - (1 - simhash.share_within(0.8, cut.width, cut.radius)) ** cut.parts >= similar.MEET


def test_recall_at_the_threshold():
    """Of pairs of sets that share 0.8 of their shingles, some in a thousand have no key in common or are not close."""
    r, reach = np.random.default_rng(1), simhash.radius_of(0.8, 64 * similar.COMPARED, similar.CLOSE)
    for rows, n in [(10**5, 90), (13 * 10**6, 45)]:
        cut, found = similar.layout(rows), 0
        masks = np.array(cut.masks, np.int64)
        for _ in range(400):
            x = r.integers(0, 2**64, n + n // 9 * 2, np.uint64)  # n - n // 9 shared, n // 9 more in each
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[: n - n // 9], x[n : n + n // 9]]))
            bits = similar.bits_of([a, b], cut.words)
            near = (bits[0] != bits[1])[: 64 * similar.COMPARED].sum() <= reach
            u, v = similar._parts(bits, cut)
            found += near and bool((((u ^ v)[:, None] & masks) == 0).any())
        assert found >= 392


def test_ties_of_a_key():
    """Ties are close, and join what is close through others too."""
    r = np.random.default_rng(2)
    prints = np.sort(r.integers(0, 2**64, (600, similar.COMPARED), np.uint64) & np.uint64(0x0000FFF000000000), axis=0)
    close = simhash.distances(prints, prints) <= 8
    got, want = Sets(600), Sets(600)
    for u, v in zip(*similar._ties_of(prints, 8), strict=True):
        assert close[u, v] and u > v
        got.join(u, v)
    for u, v in zip(*np.nonzero(close)):
        want.join(int(u), int(v))
    roots = [want.root(i) for i in range(600)]
    assert [got.root(i) for i in range(600)] == roots and 2 < len(set(roots)) < 400


def test_forest_joins_clusters_that_are_known():
    sets = [np.arange(k, k + 40, dtype=np.uint64) for k in (0, 1, 2, 100, 101, 300)]
    links = similar.forest(sets, 0.8, known=["a", "a", "a", "b", "c", "d"])
    assert [sorted(x) for x in links] == [[3, 4]]
    assert len(similar.forest(sets, 0.8)) == 3


def test_stage_decides_by_exact_similarity(spark):
    """Pairs just above 0.8 that SimHash puts too far apart go; pairs below it, and short texts, stay."""
    r, rows, gone = random.Random(5), [], 0
    for k in range(150):
        words = [f"w{r.randrange(10**9)}" for _ in range(100)]
        a, b = " ".join(words), edited(r, words, 2 if k % 2 else 4)
        s, t = shingles(a), shingles(b)
        gone += len(s & t) >= 0.8 * len(s | t)
        rows += [a, b]
    rows += [" ".join(f"x{r.randrange(10**9)}" for _ in range(6)) for _ in range(300)] + [""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert gone > 20 and corpus_pipeline.dedup_documents(spark, docs, "").count() == len(rows) - gone
