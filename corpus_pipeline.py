"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of `documents`; the text, its length
and the predicted language replace what a stage changed. The last returns the
places of all pieces in sequences. Other columns of the input are left out.

Defined results: documents whose text is null or has no letters have no
language and go in the first stage, so later ones see none. A null id is a
value like any other; of rows that share id and text one stays. Rows that are
alike in all but their ids are one group, of which the smallest id stays. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrametric.llm import langid, line_dedup, mixing, packing, similar, simhash
from terrametric.llm.common import Scratch
from terrametric.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction below this posterior is no decision, and the document goes like one without letters.
MIN_LANGUAGE_SCORE = 0.5
#: Sets of five-word shingles this alike make two documents near-duplicates.
SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; `lang` becomes the predicted one."""
    found = langid.identified(docs.select(*COLUMNS))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier in the corpus."""
    found = line_dedup.deduplicated_lines(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(docs.select(*COLUMNS), find=similar.near_duplicates, words_a_shingle=5, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights, shuffled."""
    return mixing.mixed(docs.select(*COLUMNS), temperature=0.5, seed=42).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and where they lie in sequences of 2048 tokens."""
    return packing.packed_documents(docs.select(*COLUMNS), vocabulary("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The language model and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
