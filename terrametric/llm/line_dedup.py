"""Line deduplication by overlapping three-line windows.

Lines with a word are numbered in their document; every three consecutive ones
make a window, whatever blank lines lie between them. A window that occurs more
than once in the corpus stays where it occurs first, by (doc_id, text hash,
place); the lines that its later occurrences cover are removed, each once,
however many windows cover it. A removed line always has an equal line earlier
in that order, so no line's content is lost.

First occurrences come from an aggregation that combines before it shuffles,
so a window found in a third of all documents costs one row a task there. The
join that follows is a plain equi-join, which Spark splits where it is skewed.

Defined results: lines are compared without ASCII white space at their ends;
documents with fewer than three lines with a word are left as they are; null
text stays null; rows equal in id and text count as one document and are
treated alike; a null id orders before all others; a document whose lines are
all removed keeps an empty text; an empty table gives an empty result; other
columns are carried along, but for one named like a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, forget_resident, ready_workers

WINDOW = 3
#: Fixed value: what is cut from both ends of a line, ASCII white space but for the line feed.
BLANKS = " \t\x0b\x0c\r"
_BLANKS = BLANKS.encode()


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, k, h1, h2): 128 bits over the window that begins at the k-th line with a word."""
    ready_workers(docs.sparkSession)
    names = ["doc_id", "text_hash", "k", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        forget_resident()
        for batch in batches:
            counts, digests = [], []
            for text in batch.column(2):
                lines = [x for line in text.as_buffer().to_pybytes().split(b"\n") if (x := line.strip(_BLANKS))]
                own = [xxh3_128_digest(b"\n".join(lines[k : k + WINDOW])) for k in range(len(lines) - WINDOW + 1)]
                counts.append(len(own))
                digests += own
            n = np.array(counts, np.int64)
            at = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names)

    whole = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return whole.mapInArrow(run, "doc_id long, text_hash long, k int, h1 long, h2 long")


def later_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, starts): where windows begin that occur earlier in the corpus."""
    found = windows(docs, id_col, text_col)
    repeated = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "k")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    place = F.struct("doc_id", "text_hash", "k")
    later = found.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("k").alias("starts"))


def without_lines(text: str, starts: list[int]) -> tuple[str, int]:
    """The text without the lines that windows beginning at these places cover, and how many those are."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip(BLANKS)]
    covered = {at[k + j] for k in starts for j in range(WINDOW)}
    return "\n".join([x for i, x in enumerate(lines) if i not in covered]), len(covered)


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, their texts without the lines that repeat earlier ones, and `removed_lines`."""

    @F.pandas_udf("struct<text string, removed int>")
    def cut(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        done = [without_lines(t, s) if s is not None else (None, 0) for t, s in zip(text, starts, strict=True)]
        return pd.DataFrame(done, columns=["text", "removed"])

    numbered = docs.select(carried(docs, "removed_lines"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"))
    later = later_occurrences(docs, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "starts")
    joined = numbered.join(later, numbered["doc_id"].eqNullSafe(later["_id"]) & (numbered["text_hash"] == later["_hash"]), "left").select("row", "starts")
    # Only texts with something to remove go to Python.
    text = F.col("row")[text_col]
    done = joined.withColumn("cut", cut(F.when(F.col("starts").isNotNull(), text), F.col("starts")))
    changed = done.withColumn("row", F.col("row").withField(text_col, F.when(F.col("starts").isNotNull(), F.col("cut.text")).otherwise(text)))
    return changed.select("row.*", F.col("cut.removed").alias("removed_lines"))


#: The same in DuckDB over `documents`, for unique ids.
SQL = r"""
WITH cut AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), line AS (
    SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS place FROM cut
), full_line AS (
    SELECT doc_id, place, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS l,
           row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k
    FROM line WHERE trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), win AS (
    SELECT doc_id, k, l AS a, lead(l, 1) OVER w AS b, lead(l, 2) OVER w AS c
    FROM full_line WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), ranked AS (
    SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS nth FROM win WHERE c IS NOT NULL
), covered AS (
    SELECT DISTINCT doc_id, k + j AS k FROM ranked, (SELECT unnest([0, 1, 2]) AS j) WHERE nth > 1
), gone AS (
    SELECT f.doc_id, f.place FROM full_line f JOIN covered c ON c.doc_id = f.doc_id AND c.k = f.k
), rest AS (
    SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.place) AS text
    FROM line l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place GROUP BY l.doc_id
), removed AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN n IS NULL THEN d.text ELSE coalesce(r.text, '') END AS text, coalesce(n, 0)::INT AS removed_lines
FROM documents d LEFT JOIN removed USING (doc_id) LEFT JOIN rest r USING (doc_id)
"""
