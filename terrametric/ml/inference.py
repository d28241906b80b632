"""Batch inference: rows to a model client and replies to typed columns, in partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators.top import counted_with_first

#: (prompt, uris) -> reply. It is made once per task by a factory, so it may hold a connection.
Client = Callable[[str, list[str]], str]


def replies(df: DataFrame, prompt: Column | str, factory: Callable[[], Client], uris: str | None = None, tasks: int | None = None, retries: int = 2) -> DataFrame:
    """The rows with `reply` and `error`; a call that keeps failing leaves its message, not a failed job.

    Rows are dealt evenly into `tasks` partitions; there is no shared queue, and
    a lost task is run again by Spark.
    """
    asked = df.withColumn("_prompt", F.lit(prompt) if isinstance(prompt, str) else prompt).withColumn("_uris", F.col(uris) if uris else F.array().cast("array<string>"))
    asked = asked.repartition(tasks) if tasks else asked

    @F.pandas_udf("struct<reply string, error string>")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        client = factory()
        for prompts, lists in batches:
            out = []
            for p, u in zip(prompts, lists, strict=True):
                for attempt in range(retries + 1):
                    try:
                        out.append((client(p, list(u)), None))
                        break
                    except Exception as e:  # a model's failure is a row's result
                        if attempt == retries:
                            out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["reply", "error"])

    return asked.withColumn("_r", ask("_prompt", "_uris")).select(*df.columns, "_r.reply", "_r.error")


def cascade(df: DataFrame, column: str, factories: list[Callable[[], Callable[[str], str | None]]], out: str = "resolved") -> DataFrame:
    """The rows with what the first service that knows the value answers, and that service's place; null where none does.

    For lookups such as addresses: a strict service first, broader ones after it.
    """

    @F.pandas_udf("struct<value string, step int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        services = [f() for f in factories]
        for values in batches:
            answers = []
            for v in values:
                tried = ((s(v), k) for k, s in enumerate(services)) if v is not None else ()
                answers.append(next(((a, k) for a, k in tried if a is not None), (None, None)))
            yield pd.DataFrame({"value": [a for a, _ in answers], "step": pd.array([k for _, k in answers], "Int32")})

    return df.withColumn("_c", run(column)).select(*df.columns, F.col("_c.value").alias(out), F.col("_c.step").alias(f"{out}_by"))


def projected(df: DataFrame, schema: str, reply: str = "reply") -> DataFrame:
    """The reply's JSON as columns; a reply without valid JSON keeps its text and an error."""
    text = scalar.fenced_json(reply)
    parsed = F.from_json(text, schema)
    names = [f.split()[0] for f in schema.split(", ")]
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(text.isNull() | (F.try_parse_json(text).isNull()), F.concat(F.lit("no JSON: "), F.coalesce(reply, F.lit(""))))
    out = df.withColumn("_p", parsed).withColumn("error", bad)
    return out.select(*[c for c in df.columns if c not in (reply, "error")], *[F.col(f"_p.{n}").alias(n) for n in names], "error", F.when(F.col("error").isNotNull(), F.col(reply)).alias("raw"))


def agreement(judged: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Judged pairs, those called the same, and their share in percent."""
    same = F.count_if(F.upper(F.trim(verdict)) == "SAME")
    n = F.count_if(F.upper(F.trim(verdict)).isin("SAME", "DIFFERENT"))
    return judged.agg(n.alias("judged"), same.alias("same"), F.round(100 * F.try_divide(same, n), 2).alias("agreement_percent"))


def categories(df: DataFrame, reply: str = "reply", samples: int = 3) -> DataFrame:
    """Replies by how they begin: counts and the first few in order."""
    return counted_with_first(df.select(scalar.category(reply).alias("category"), F.col(reply).alias("reply")), "category", "reply", samples, "n", "samples")
