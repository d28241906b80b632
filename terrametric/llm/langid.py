"""Language identification by word-first backoff.

A text's words are scored by each language's log frequency where they are
known; an unseen word by the log frequency of its character n-grams, the
longest length first of which at least one n-gram is known, down to single
characters. Scores add up over the whole text; the prediction is the language
with the highest posterior, and the score is that posterior. Words are runs of
letters of the text in lower case, found by one rule in training and prediction.

The model is fitted on a bounded sample of labelled texts, chosen by a hash of
the id: about `max_docs_a_language` a language and `max_docs` in all, so that it
can be broadcast however many labels there are. It keeps every word and n-gram
of the sample, with counts for the languages that have it. Prediction reads
nothing but the text.

Defined results: `und` with score 0 for null text, text without letters, and
where nothing was learned; ties go to the language that sorts first; labelled
rows with null text teach nothing; an empty table gives an empty result;
repeated rows are predicted each; other columns are carried along, but for one
named like a result column.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, ready_workers, resident

UNKNOWN = "und"
LONGEST_GRAM = 5
#: Letters, and numbers that are no digits, such as fractions; the few runs that hold one are cut there.
_RUN = re.compile(r"[^\W\d_]+")
#: Scores of unseen words remembered at once in a worker, over all languages.
MAX_REMEMBERED = 2_000_000
#: Up to so many labels their sampling rates (some 50 bytes each) are broadcast.
MAX_BROADCAST_LABELS = 10_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    runs = _RUN.findall(text.lower()) if text else []
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a mark at each end."""
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Frequencies:
    """Log frequencies of keys by language: a floor for each language, and what the counts of those that have a key add to it."""

    floor: np.ndarray
    keys: list[str] = field(default_factory=list)
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    languages: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    added: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float64))

    @classmethod
    def of(cls, counts: pa.Table, languages: list[str], smoothing: float) -> Frequencies:
        """counts: key and its list of (lang, count)."""
        by = counts.column("by").combine_chunks()
        flat = by.flatten()
        place = {x: i for i, x in enumerate(languages)}
        own = np.array([place[x] for x in flat.field("lang").to_pylist()], np.int32)
        n = flat.field("count").to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.concatenate([[0], np.cumsum(by.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        total = np.bincount(own, weights=n, minlength=len(languages)) + smoothing * max(1, len(counts))
        return cls(np.log(smoothing / total), counts.column("key").to_pylist(), ends, own, np.log1p(n / smoothing))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "lists")}

    def find(self, keys: list[str]) -> list[int]:
        if "place" not in self.__dict__:
            self.place = {k: i for i, k in enumerate(self.keys)}
            # Few numbers a key: plain lists are faster to add up than arrays.
            self.lists = self.floor.tolist(), self.ends.tolist(), self.languages.tolist(), self.added.tolist()
        get = self.place.get
        return [i for k in keys if (i := get(k)) is not None]

    def mean(self, at: list[int]) -> list[float]:
        """Mean log frequencies of the keys at these places, as find() gives them."""
        floor, ends, languages, added = self.lists
        out, n = floor.copy(), len(at)
        for i in at:
            for k in range(ends[i], ends[i + 1]):
                out[languages[k]] += added[k] / n
        return out


@dataclass
class Model:
    languages: list[str]
    words: Frequencies | None = None
    #: By length of the n-grams, from one.
    grams: list[Frequencies] = field(default_factory=list)

    def word_scores(self, word: str) -> list[float]:
        """Log frequencies of a word by language; of its n-grams where it is unseen."""
        if at := self.words.find([word]):
            return self.words.mean(at)
        for n in range(len(self.grams), 0, -1):
            if at := self.grams[n - 1].find(grams_of(word, n)):
                return self.grams[n - 1].mean(at)
        return [0.0] * len(self.languages)


class Scorer:
    """Predicts texts, remembering the scores of words as rows of a matrix."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        """Start anew, with the known words if there is room for them all."""
        words, n = self.model.words, max(1, len(self.model.languages))
        known = words is not None and 2 * len(words.keys) * n <= MAX_REMEMBERED
        self.place: dict[str, int] = {k: i for i, k in enumerate(words.keys)} if known else {}
        self.rows = np.empty((max(1024, 2 * len(self.place)), n))
        if known:
            rows = np.tile(words.floor, (len(words.keys), 1))
            rows[np.repeat(np.arange(len(rows)), np.diff(words.ends)), words.languages] += words.added
            self.rows[: len(rows)] = rows

    def _add(self, word: str) -> int:
        i = len(self.place)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[i] = self.model.word_scores(word)
        self.place[word] = i
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.model.languages or not (words := words_of(text)):
            return UNKNOWN, 0.0
        if len(self.place) * self.rows.shape[1] > MAX_REMEMBERED:
            self._forget()
        get, add = self.place.get, self._add
        at = [i if (i := get(w)) is not None else add(w) for w in words]
        total = self.rows[at].sum(axis=0) if len(at) < 1 << 16 else sum(self.rows[at[k : k + (1 << 16)]].sum(axis=0) for k in range(0, len(at), 1 << 16))
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def training_sample(docs: DataFrame, max_docs_a_language: int, max_docs: int, id_col: str, text_col: str, lang_col: str, scratch: Scratch) -> DataFrame:
    """(lang, text) of labelled rows, about so many a language and in all, by a hash of the id."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("fit"), F.col(id_col)).alias("h"))
    counts = scratch.save(labelled.groupBy("lang").count(), "labels")
    labels = counts.count()
    share = F.least(F.lit(1.0), F.lit(min(max_docs_a_language, max_docs / max(1, labels))) / F.col("count"))
    rates = counts.select("lang", share.alias("share"))
    rated = labelled.join(F.broadcast(rates) if labels <= MAX_BROADCAST_LABELS else rates, "lang")
    return rated.where((F.col("h") / F.lit(float(1 << 63)) + 1) / 2 <= F.col("share")).select("lang", "text")


def fitted(docs: DataFrame, max_docs_a_language: int = 1000, max_docs: int = 20_000, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", scratch: Scratch | None = None) -> Model:
    """A model from labelled rows, of all words and n-grams in the sample."""
    ready_workers(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "langid")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter((lang, w) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in words_of(text))
            langs, words = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "key", "count"])

    sample = training_sample(docs, max_docs_a_language, max_docs, id_col, text_col, lang_col, scratch)
    words = sample.mapInArrow(count, "lang string, key string, count long")
    words = scratch.save(words.groupBy("lang", "key").agg(F.sum("count").alias("count")), "words")
    padded = words.withColumn("p", F.concat(F.lit("_"), "key", F.lit("_")))
    grams = padded.select("lang", "count", F.explode(F.expr(f"flatten(transform(sequence(1, {LONGEST_GRAM}), n -> if(length(p) >= n, transform(sequence(1, length(p) - n + 1), i -> substring(p, i, n)), array())))")).alias("key"))
    grams = scratch.save(grams.groupBy("lang", "key").agg(F.sum("count").alias("count")), "grams")
    # As many as the sample has: what is collected is bounded by it.
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not languages:
        return Model([])

    def frequencies(rows: DataFrame) -> Frequencies:
        by = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lang", "count"))).alias("by"))
        return Frequencies.of(by.toArrow(), languages, smoothing)

    return Model(languages, frequencies(words), [frequencies(grams.where(F.length("key") == n)) for n in range(1, LONGEST_GRAM + 1)])


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input rows with lang_pred and score."""
    spark = docs.sparkSession
    ready_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        given = shared.value
        # The scorer holds its model, so no other one gets its number meanwhile.
        scorer = resident(("language", id(given)), lambda: Scorer(given))
        for texts in batches:
            yield pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang_pred", "score"])

    # Else a filter on the results would be pushed below them and predict every text again.
    predict = predict.asNondeterministic()
    rows = docs.select(carried(docs, "lang_pred", "score")).withColumn("found", predict(F.col("row")[text_col]))
    return rows.select("row.*", "found.lang_pred", "found.score")


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The input rows with held_out, lang_pred and score, by a model fitted on those that are not held out."""
    model = fitted(docs.where(~held_out(id_col)), id_col=id_col, **parameters)
    out = predicted(docs, model, parameters.get("text_col", "text"))
    return out.withColumn("held_out", held_out(id_col))
