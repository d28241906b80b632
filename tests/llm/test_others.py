"""Mixing, surrogates, quality, language, sharding, the pipeline and the contract."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from terrametric.llm import langid, mixing, pii, quality, queries, sharding

from ..oracle import rows_of, sql_rows
from .conftest import SMALL

# --- mixing ---


def test_mixing_equals_sql(spark):
    assert rows_of(queries.op2_mixing(spark, SMALL)) == sql_rows(SMALL, mixing.SQL)[1]


def test_mixing_reaches_its_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 15_000, "big").when(F.col("id") < 19_990, "mid").otherwise("tiny").alias("source"))
    got = mixing.mixed(df, weights={"big": 1, "mid": 1, "tiny": 2}, total=8000)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 200 and abs(n["mid"] - 2000) < 200 and abs(n["tiny"] - 4000) < 300
    tiny = got.where("source = 'tiny' and copy = 0").select("copies").collect()
    assert len(tiny) == 10 and all(300 < r["copies"] < 500 for r in tiny)  # a rate of 400 takes 25 draws
    copies = [r["copies"] for r in got.where("source = 'mid' and copy = 0").collect()]
    rate = 2000 / 4990
    for k in (1, 2):
        wanted = 4990 * np.exp(-rate) * rate**k / (1, 1, 2)[k]
        assert abs(copies.count(k) - wanted) < 5 * wanted**0.5
    assert got.select("shuffle_key").distinct().count() == got.count()


def test_mixing_salted_join_is_the_same(small, monkeypatch):
    wanted = rows_of(mixing.mixed(small))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert rows_of(mixing.mixed(small)) == wanted


def test_mixing_odd_rows(odd, clashing, none):
    got = mixing.mixed(clashing, total=200)
    assert set(got.columns) == {*clashing.columns, "shuffle_key"}
    same = got.where("doc_id = 5").groupBy("copies").count().collect()
    assert len(same) == 1 and same[0]["count"] == 2 * same[0]["copies"]  # rows of one id get one count
    assert mixing.mixed(odd, by_chars=True).where("source is null").count() >= 0
    assert mixing.mixed(odd, weights={"a": 1.0}).where("source <> 'a' or source is null").count() == 0
    assert mixing.mixed(odd, weights={None: 1.0}).where("source is not null").count() == 0
    assert mixing.mixed(none).count() == 0 and mixing.mixed(odd, total=0).count() == 0


def test_mixing_is_native(small):
    assert not re.search("Python|Arrow|Pandas", mixing.mixed(small)._jdf.queryExecution().executedPlan().toString())


# --- surrogates ---

TEXT = 'Mr. John Smith (john.SMITH@mail3.example.org) met Frau Petra Müller at 10.20.30.140. Smith called +1 (664) 555-5990 or 664-555-5990; card 4111 1111 1111 1111, token = "3e5cb3f9186ce4f749644b4847d287be561795be" iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789 Господин Иван Петров.'


def test_surrogates_keep_type_and_format():
    found = pii.mentions(TEXT)
    assert [m.kind.split("-")[0] for m in found] == ["first", "last", "email", "first", "last", "ip", "last", "phone", "phone", "card", "secret", "iban", "ssn", "first", "last"]
    new = {(m.kind, m.canonical): pii.surrogate(m.kind, m.canonical, b"key", 0) for m in found}
    out, spans = pii.replaced(TEXT, new)
    assert len(spans) == len(found) and all(TEXT[m.start : m.end] not in out for m in found)
    again = pii.mentions(out)
    assert Counter(m.kind for m in again if m.kind in pii.KINDS) == Counter(m.kind for m in found if m.kind in pii.KINDS)
    phones = [m for m in again if m.kind == "phone"]
    assert phones[0].canonical == phones[1].canonical and re.search(r"\+1 \(\d{3}\) 555-\d{4} or \d{3}-555-\d{4}", out)
    card = next(m for m in again if m.kind == "card")
    assert pii._luhn(card.canonical) == 0 and re.search(r"card \d{4} \d{4} \d{4} \d{4},", out)
    iban = next(m for m in again if m.kind == "iban")
    assert pii._iban_rest(iban.canonical) == 1 and iban.canonical.startswith("DE")
    assert out.split("Mr. ")[1].split()[1] == out.split(". ")[2].split()[0]  # the surname by itself
    assert re.search(r"Господин [А-Я][а-я]+ [А-Я][а-я]+\.", out)
    assert pii.replaced(TEXT, {k: pii.surrogate(*k, b"other", 0) for k in new})[0] != out


@pytest.mark.parametrize("text", ["version 1.2.3", "call 12-34", "ISBN 978-3-16-148410-0x", "price 1234567", "a@b", "10:30:15", "x 300.1.1.1 y", "http://a.b/c?d=1", "an Mr", "2024-01-15 12:00"])
def test_ordinary_text_is_left_alone(text):
    assert pii.mentions(text) == []


@pytest.mark.parametrize("text", ["8.8.8.8", "see 1.1.1.1.", "at 1.2.3.4, or"])
def test_an_address_is_found_whatever_else_the_text_holds(text):
    assert [m.kind for m in pii.mentions(text)] == ["ip"]
    assert [m.kind for m in pii.mentions(text + " and 10 more")] == ["ip"]


PEOPLE = [
    ("Госпожа Иванова пришла", ["last-f-cyrillic"]),
    ("Господин Иванов пришёл", ["last-m-cyrillic"]),
    ("Dr Παπαδόπουλος came", ["last-m-greek"]),
    ("Dr 田中 came", ["last-cjk"]),
    ("my name is Akira Tanaka and", ["first-n-latin", "last-latin"]),
    ("Dear Mohammed Ali, welcome", ["first-n-latin", "last-latin"]),
    ("Name: Wang Wei", ["first-n-latin", "last-latin"]),
    ("Old Town Hall is in New York", []),
    ("commit 0123456789abcdef0123456789abcdef01234567", []),
]


@pytest.mark.parametrize("text, kinds", PEOPLE)
def test_people_are_found_and_keep_script_and_gender(text, kinds):
    import unicodedata

    found = pii.mentions(text)
    assert [m.kind for m in found] == kinds
    new = {(m.kind, m.canonical): pii.surrogate(m.kind, m.canonical, b"key", 0) for m in found}
    for m in found:
        out = pii.written(m.kind, text[m.start : m.end], new[m.kind, m.canonical])
        own = unicodedata.name(text[m.start]).split()[0].split("-")[0]
        assert {unicodedata.name(c).split()[0].split("-")[0] for c in out if c.isalpha()} == {own}
        if m.kind.startswith("last-f-cyrillic"):
            assert out.endswith(("ова", "ева", "ина", "ская"))
    assert pii.replaced(text, new)[0] != text if found else pii.replaced(text, new)[0] == text


def test_full_shapes_grow(spark):
    """Every short address is an original already, and so are all surrogates of one letter names."""
    from terrametric.llm.common import Scratch

    rows = [("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)] + [("ssn", "123456789"), ("first-m-latin", "john"), ("last-latin", "john"), ("last-cjk", "田")]
    got = [tuple(r) for r in pii.settled(spark.createDataFrame(rows, "kind string, canonical string"), b"k", Scratch(spark, "test")).collect()]
    assert {(k, c) for k, c, _ in got} == set(rows) and len({s for _, _, s in got}) == len(rows)
    assert not {s for _, _, s in got} & {c for _, c in rows}
    for k in range(pii.FULL, pii.FULL + 3):  # longer and longer
        for kind, original in (("ip", "1.2.3.4"), ("ipv6", "2001:0db8:0000:0000:0000:0000:0000:0001"), ("ssn", "123456789"), ("email", "a@b.org"), ("last-latin", "smith")):
            assert len(pii.surrogate(kind, original, b"k", k + 20)) > len(pii.surrogate(kind, original, b"k", 0))


V6 = ["2001:db8::1", "::1", "2001:DB8::", "fe80::1:2", "1:2:3:4:5:6:7::", "1::3:4:5:6:7:8", "2001:0db8:0000:0000:0000:0000:0000:0001", "2001:db8:0:0:0:0:0:1", "::ffff:192.0.2.1", "1:2:3:4:5:6:192.0.2.1", "0::"]


@pytest.mark.parametrize("text", V6)
def test_ipv6_in_every_notation(text):
    (m,) = pii.mentions(f"from [{text}]:80, then")
    assert (m.kind, m.start, m.end) == ("ipv6", 6, 6 + len(text))
    for attempt in (0, 5, 20):
        new = pii.surrogate(m.kind, m.canonical, b"k", attempt)
        out = pii.written(m.kind, text, new)
        assert [pii.canonical(x.kind, out) for x in pii.mentions(f"[{out}]") if x.kind == "ipv6"] in ([new], [])
        assert pii.canonical("ipv6", out) == new and (attempt or out.count(":") == text.count(":"))


def test_ipv6_notations_are_one_entity_and_settle(spark):
    assert len({pii.canonical("ipv6", t) for t in ("2001:db8::1", "2001:DB8:0:0::1", V6[6], V6[7])}) == 1
    rows = [("ipv6", pii.canonical("ipv6", f"::{i:x}")) for i in range(16)] + [("ip", f"{i}.{j}.1.{k}") for i in range(1, 10) for j in range(1, 10) for k in range(1, 10)]
    from terrametric.llm.common import Scratch

    got = [r["surrogate"] for r in pii.settled(spark.createDataFrame(rows, "kind string, canonical string"), b"k", Scratch(spark, "test")).collect()]
    assert len(set(got)) == len(rows) and not set(got) & {c for _, c in rows}


@pytest.mark.parametrize("text", ["std::vector<int>", "x :: Int", "a::b", "12::3::4", "1:2:3", "::1::2", "v12345::6"])
def test_code_is_no_ipv6(text):
    assert pii.mentions(text) == []


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.lists(st.sampled_from(["a.b@c.org", "1.2.3.4", "4111111111111111", "+1 (664) 555-5990", " ", ". "]), max_size=6))
def test_mentions_never_overlap(text, parts):
    found = pii.mentions(text + " ".join(parts))
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))


def test_surrogates_stay_distinct(spark):
    """So few possible surrogates that most candidates collide at first."""
    rows = [("ssn", f"{i:09d}") for i in range(300)] + [("ip", f"1.1.1.{i}") for i in range(10)] + [("card", f"{i:013d}") for i in range(50)]
    rows += [("secret", f"{i:06d}"[-6:]) for i in range(500)] + [("last-latin", f"name{i}") for i in range(400)]
    from terrametric.llm.common import Scratch

    got = pii.settled(spark.createDataFrame(rows, "kind string, canonical string"), b"k", Scratch(spark, "test")).collect()
    assert {(r["kind"], r["canonical"]) for r in got} == set(rows) and len(got) == len(rows)
    made = [(r["kind"], r["surrogate"]) for r in got]
    assert len(set(made)) == len(made) and not set(made) & set(rows)


def test_surrogates_over_documents(small, odd, clashing, none):
    got = pii.with_surrogates(small, b"k")
    old = {r["doc_id"]: r["text"] for r in small.collect()}
    originals = {(m.kind, m.canonical) for t in old.values() for m in pii.mentions(t)}
    new, n = defaultdict(set), 0
    for r in got.collect():
        spans = r["spans"] or []
        n += len(spans)
        if not spans:
            assert r["text"] == old[r["doc_id"]]
        shift = 0
        for s in spans:
            was = old[r["doc_id"]][s["start"] : s["start"] + s["length"]]
            now = r["text"][s["start"] + shift : s["start"] + shift + s["new_length"]]
            new[s["kind"], pii.canonical(s["kind"], was)].add(pii.canonical(s["kind"], now))
            shift += s["new_length"] - s["length"]
    assert n and set(new) == originals and all(len(v) == 1 for v in new.values())  # one surrogate each, everywhere
    made = [(k, *v) for (k, _), v in new.items()]
    assert len(set(made)) == len(made) and not {(k, s) for k, s in made} & originals
    assert rows_of(pii.with_surrogates(clashing, b"k").select("doc_id", "text")) == rows_of(odd.select("doc_id", "text"))
    assert pii.with_surrogates(none, b"k").count() == 0


# --- quality ---


def brute_statistics(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            covered |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(small, odd):
    for df in (small, odd):
        for r in quality.statistics(df.select("*", F.col("text").alias("row"))).collect():
            assert tuple(r[s] for s in quality.STATISTICS) == brute_statistics(r["row"])


def normal_rows(spark):
    """Two languages with their own spread, and outliers within each."""
    rng = np.random.default_rng(5)
    rows = [(i, "en", "s", int(x), int(x * rng.normal(5, 0.3)), 0, 0, 0) for i, x in enumerate(np.exp(rng.normal(6, 0.5, 600)))]
    rows += [(600 + i, "de", None, int(x), int(x * rng.normal(8, 0.3)), 0, 0, 0) for i, x in enumerate(np.exp(rng.normal(5, 0.5, 600)))]
    rows += [(2000, "en", "s", 400, 12_000, 0, 0, 0), (2001, "en", "s", 400, 2000, 900, 0, 0), (2002, "de", None, 150, 1200, 0, 200, 0), (2003, "fr", "s", 400, 12_000, 0, 0, 0)]
    df = spark.createDataFrame(rows, "id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return rows, df.select("id", "lang", "source", *quality.transformed())


def regular_det(core):
    return np.linalg.slogdet(quality.CONSISTENCY * np.cov(core.T, bias=True) / 1e6 + np.diag(np.square(quality.FLOOR)))[1]


def test_determinant_is_the_smallest_of_all_subsets(spark):
    """Small groups with outliers, against every subset of the core's size."""
    from itertools import combinations

    from terrametric.llm.common import Scratch

    rng, groups = np.random.default_rng(8), {}
    for g in range(5):
        x = np.round(1000 * rng.normal(size=(12, 5)) * [0.4, 0.2, 0.5, 0.5, 0.1]).astype(int)
        x[: g % 4] += rng.integers(2000, 9000, (g % 4, 5))
        groups[g] = x
    df = spark.createDataFrame([(g, *map(int, x)) for g, xs in groups.items() for x in xs], "g long, x0 long, x1 long, x2 long, x3 long, x4 long")
    got = {r["g"]: r for r in quality.estimates(df, Scratch(spark, "test"), True).collect()}
    for g, x in groups.items():
        want = min(regular_det(x[list(c)]) for c in combinations(range(12), 9))
        assert got[g]["det"] <= want + 0.05
        core = min(combinations(range(12), 9), key=lambda c: regular_det(x[list(c)]))
        if got[g]["det"] <= want + 1e-6:
            assert np.allclose([got[g][f"m{i}"] for i in range(5)], x[list(core)].mean(axis=0) / 1000)


def test_outliers_of_large_and_small_groups(spark):
    from terrametric.llm.common import Scratch

    rows, df = normal_rows(spark)
    given, members, few = quality.memberships(df, Scratch(spark, "test"), 50)
    groups = {(r["lang"], r["source"]): r["g"] for r in given.collect()}
    assert few and len(set(groups.values())) == 3 and members.count() == 1203 + 1204  # fr: judged by all rows
    found = quality.estimates(members, Scratch(spark, "test"), True).drop("det")
    named = df.where("lang = 'en'").withColumn("g", F.lit(groups["en", "s"])).unionByName(df.where("lang = 'de'").withColumn("g", F.lit(groups["de", None]))).unionByName(df.where("lang = 'fr'").withColumn("g", F.lit(groups["fr", "s"])))
    got = {r["id"]: r["d2"] for r in quality._with_distance(named, found, True).collect()}
    assert all(got[i] > quality.CUTOFF for i in (2000, 2001, 2002)) and got[2003] > 15  # far from texts of either language
    assert sum(got[i] > quality.CUTOFF for i in range(1200)) == 0


def test_quality_joins_alike(small, monkeypatch):
    wanted = rows_of(quality.judged(small, min_group=2).select("doc_id", "kept"))
    monkeypatch.setattr(quality, "MAX_BROADCAST_GROUPS", 0)
    assert rows_of(quality.judged(small, min_group=2).select("doc_id", "kept")) == wanted


def test_quality_odd_rows(odd, clashing, none, small):
    got = quality.judged(clashing)
    assert got.count() == odd.count() and {r["doc_id"] for r in got.where("not base_failed").collect()} <= {8, 10, 11}
    assert quality.judged(none).count() == 0
    assert not re.search("Python|Arrow|Pandas", quality.judged(small)._jdf.queryExecution().executedPlan().toString())


# --- language ---


def test_language_held_out_accuracy(spark):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def frequencies(rows):
    """Of {key: per-language numbers}."""
    keys, n = list(rows), len(rows)
    return langid.Frequencies(np.zeros(2), keys, 2 * np.arange(n + 1), np.array([0, 1] * n, np.int32), np.array([x for k in keys for x in rows[k]], float))


def test_language_backoff():
    none = frequencies({})
    m = langid.Model(["a", "b"], frequencies({"known": (1.0, -1.0)}), [frequencies({"x": (0.5, -0.5), "q": (-1.0, 1.0)}), none, none, none, frequencies({"_xyz_": (-2.0, 2.0)})])
    assert m.word_scores("known") == [1.0, -1.0]
    assert m.word_scores("xyz") == [-2.0, 2.0]  # its longest known n-gram
    assert m.word_scores("xq") == [-0.25, 0.25] and m.word_scores("zz") == [0.0, 0.0]
    s = langid.Scorer(m)
    assert s.predict("KNOWN known") == ("a", pytest.approx(1 / (1 + np.exp(-4))))
    assert s.predict("zz") == ("a", 0.5)
    assert s.predict(None) == s.predict("123 !?") == s.predict("") == ("und", 0.0)


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅷ ٣ ५", "_ 1_2 …", "³x²y"])
def test_words_are_letters_only(text):
    want, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            want.append(word)
            word = ""
    assert langid.words_of(text) == want


def test_languages_equal_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in small.collect()]
    taught = [(lang, w) for i, t, lang in rows if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2 for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    known, languages = Counter(taught), sorted({lang for lang, _ in taught})
    grams = [Counter() for _ in range(6)]
    for (lang, w), n in known.items():
        p = f"_{w}_"
        for size in range(1, 6):
            for k in range(len(p) - size + 1):
                grams[size][lang, p[k : k + size]] += n
    tables = [known, *grams[1:]]
    sums = [[sum(n for (x, _), n in t.items() if x == lang) for lang in languages] for t in tables]
    vocabulary = [{k for _, k in t} for t in tables]

    def logs(size, keys):
        keys = [k for k in keys if k in vocabulary[size]]
        return [sum(np.log((tables[size][lang, k] + 0.5) / (sums[size][x] + 0.5 * len(vocabulary[size]))) for k in keys) / len(keys) for x, lang in enumerate(languages)] if keys else None

    def word(w):
        p = f"_{w}_"
        return logs(0, [w]) or next((found for size in range(5, 0, -1) if (found := logs(size, [p[k : k + size] for k in range(len(p) - size + 1)]))), [0.0] * len(languages))

    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(small).collect()}
    for i, t, _ in rows:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())[:400]
        if len(words) == 400:
            continue  # the plain way is slow
        if not words:
            assert got[i] == ("und", 0.0)
            continue
        total = np.sum([word(w) for w in words], axis=0)
        assert got[i] == (languages[int(total.argmax())], pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-9))


def test_language_odd_rows(odd, clashing, none):
    got = langid.identified(clashing)
    assert got.count() == odd.count()
    by = defaultdict(set)
    for r in got.collect():
        by[r["text"]].add(r["lang_pred"])
    assert by[None] == by[""] == by["12345 !!! ???"] == {"und"} and all(len(v) == 1 for v in by.values())
    assert langid.identified(none).count() == 0
    assert {r["lang_pred"] for r in langid.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- sharding ---


def check_shards(rows, shards=16):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return [sum(r["size"] for r in by[k]) for k in range(shards)]


@pytest.mark.parametrize("part_bytes", [1 << 26, 5000])
def test_shards_are_even(spark, part_bytes):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.sharded(df, part_bytes=part_bytes).select("doc_id", "text", "size", "shard", "slot").collect()
    sizes, mean = check_shards(got), sum(r["size"] for r in got) / 16
    assert len({r["doc_id"] for r in got}) == df.count() == len(got)
    assert max(abs(s - mean) for s in sizes) <= 2 * max(max(r["size"] for r in got), 0.025 * mean)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    groups = defaultdict(list)
    for r in got:
        groups[r["text"] or ""].append(r)
    assert all(len({r["shard"] for r in g}) == 1 for g in groups.values() if sum(r["size"] for r in g) <= 0.05 * mean)


def brute_shards(keys, shards, whole):
    """Shard by key of rows (k1, k2, size): boundaries after sorting, moved out of small groups."""
    rows = sorted(keys)
    ends, total = np.cumsum([s for *_, s in rows]), sum(s for *_, s in rows)
    out = []
    for j in range(1, shards):
        at = int(np.abs(np.concatenate([[0], ends]) - total * j / shards).argmin())  # rows before the boundary
        group = [i for i, r in enumerate(rows) if 0 < at < len(rows) and rows[at - 1][0] == rows[at][0] == r[0]]
        if group and sum(rows[i][2] for i in group) <= whole * total / shards:
            inside, all_bytes = sum(rows[i][2] for i in group if i < at), sum(rows[i][2] for i in group)
            at = group[0] if 2 * inside <= all_bytes else group[-1] + 1
        out.append(at)
    return [sum(i >= at for at in out) for i in range(len(rows))], rows


def test_shards_equal_brute_force(spark):
    """Groups of three equal texts, every boundary met exactly: the same shards as from sorted rows."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") / 3).cast("int"), F.repeat(F.lit("x"), (F.col("id") / 3).cast("int") % 50)).alias("text"))
    got = sharding.sharded(df, tolerance=0).select("doc_id", "shard", "size", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.lit(False), "doc_id", "text").alias("k2")).collect()
    want, rows = brute_shards([(r["k1"], r["k2"], r["size"]) for r in got], 16, 0.05)
    shard = {(r["k1"], r["k2"]): r["shard"] for r in got}
    assert [shard[k1, k2] for k1, k2, _ in rows] == want


def test_a_hot_text_is_split_and_others_stay_together(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("t"), (F.col("id") / 4).cast("int"))).alias("text"))
    got = sharding.sharded(df).collect()
    sizes = check_shards(got)
    assert max(sizes) - min(sizes) <= 40
    shards = defaultdict(set)
    for r in got:
        shards[r["text"]].add(r["shard"])
    assert len(shards["the same"]) >= 5 and sum(len(v) > 1 for v in shards.values()) == 1


def test_sharding_odd_rows(spark, odd, clashing, none):
    got = sharding.sharded(clashing).collect()
    check_shards(got)
    assert len(got) == odd.count()
    assert sharding.sharded(none).count() == 0
    equal = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    assert len(check_shards(sharding.sharded(equal).collect())) == 16
    out = queries.op9_sharding(spark, SMALL).collect()
    assert {r["law"] for r in out} == {"bytes"} and all(r["grown_shard"] is None for r in out)


# --- the pipeline ---


def test_pipeline_stages(spark, odd, none):
    docs, kept = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]
    assert kept["language_id"] >= 0.99 * 1000 and kept["line_dedup"] == kept["language_id"] > kept["simhash_dedup"] > 800
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
        assert stage(spark, odd, "").count() >= 0


def test_contract_names():
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} == {m[0] for n in names if (m := re.match(r"op\d+", n))}
