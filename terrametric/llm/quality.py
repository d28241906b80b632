"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Each text gets a few statistics. Texts that fail a base rule are rejected. Over
the others, transformed statistics are judged by their Mahalanobis distance
from a minimum-covariance-determinant estimate for their language and source.
Three starts are taken: medians and absolute deviations, mean and covariance,
and the covariance of the centred rows' signs. From each, concentration steps
keep the three quarters of a group's rows that lie nearest and estimate mean
and covariance from those, until the determinant falls no more; the estimate
with the smallest determinant judges. A language and source with fewer than
`min_group` texts is judged by its language's estimate, and a language with
fewer by that of all texts.

Statistics are kept as integers in thousandths and summed as decimals, so the
estimates do not depend on how rows are dealt. Per group only counts, medians
and sums by rounded distance move. The estimates are joined to the rows as a
broadcast only up to MAX_BROADCAST_GROUPS groups, else by an equi-join.

A spread below `FLOOR` counts as that much: most texts have no symbols and no
repeated line, and a group's spread of zero would reject any other text.

Defined results: null text has no words; a null language or source makes a
group of its own; an empty table gives an empty result; repeated rows are judged each; other columns are carried
along, but for one named like a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, Scratch, carried

#: Up to so many groups the estimates (some 200 bytes each) are broadcast.
MAX_BROADCAST_GROUPS = 50_000
REPEAT_WINDOW = 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least spread of each transformed statistic.
FLOOR = (0.5, 0.1, 0.35, 0.35, 0.1)
DIMENSIONS = len(FLOOR)
#: Share of a group's rows in a concentration step.
CORE = 0.75
#: Fixed value: what makes the covariance of that core consistent for five normal variables,
#: 0.75 / P(chi2 with 7 degrees <= the 0.75 quantile of chi2 with 5).
CONSISTENCY = 1.412
#: Squared distance beyond which a text is an outlier: chi2 with 5 degrees exceeds it once in 10**9 normal rows.
CUTOFF = 50.5


def statistics(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("row",)) -> DataFrame:
    """The carried columns and the base statistics of `text_col`, as longs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A column that several others use is computed once, below them; lambdas use no column but their own arrays.
    words = docs.select(*carry, text.alias("t")).withColumn("words", F.array_remove(F.split("t", WORD_BREAK), ""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = words.select(
        *carry,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("wh"),
    )
    counted = counted.select(*carry, "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "wh")
    window = F.transform(F.sequence(F.lit(0), F.size("wh") - REPEAT_WINDOW), lambda i: F.xxhash64(*[F.get("wh", i + j) for j in range(REPEAT_WINDOW)]))
    hashed = counted.withColumn("win", F.when(F.size("wh") >= REPEAT_WINDOW, window)).drop("wh")
    # Few texts repeat a window; only theirs are sorted.
    repeats = F.size("win") > F.size(F.array_distinct("win"))
    hashed = hashed.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("win")
    pairs = hashed.withColumn("hs", F.col("sorted.h")).withColumn("at", F.col("sorted.i")).drop("sorted")
    same = F.zip_with(F.slice("hs", F.lit(1), F.size("hs") - 1), F.slice("hs", F.lit(2), F.size("hs") - 1), lambda a, b: a == b)
    marked = pairs.withColumn("same", same).drop("hs")
    no = F.array(F.lit(False))
    met = F.zip_with(F.concat(no, "same"), F.concat("same", no), lambda a, b: a | b)
    places = F.filter(F.zip_with(met, F.col("at"), lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    placed = marked.withColumn("places", F.sort_array(places)).drop("same", "at")
    gaps = F.zip_with(F.slice("places", F.lit(1), F.size("places") - 1), F.slice("places", F.lit(2), F.size("places") - 1), lambda a, b: F.least(F.lit(REPEAT_WINDOW), b - a))
    covered = F.when(F.col("places").isNotNull(), F.aggregate(gaps, F.lit(REPEAT_WINDOW), lambda n, g: n + g)).otherwise(F.lit(0))
    return placed.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def transformed() -> list[Column]:
    """The statistics made nearly symmetric, in thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    parts = [
        F.log(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
    ]
    return [F.round(1000 * x).cast("long").alias(f"x{k}") for k, x in enumerate(parts)]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def _with_distance(rows: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    """Rows (g, x0.., ...) joined with the estimates (g, m0.., l00.., ...), with `d2`, the squared Mahalanobis distance."""
    joined = rows.join(F.broadcast(found) if few else found, "g")
    for i in range(DIMENSIONS):  # forward substitution in the triangular factor
        y = F.col(f"x{i}") / 1000 - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        joined = joined.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, DIMENSIONS)), F.col("y0") * F.col("y0"))
    return joined.withColumn("d2", d2).drop(*[f"{a}{i}" for a in "my" for i in range(DIMENSIONS)], *[f"l{i}{j}" for i, j in _pairs()])


def _factored(moments: DataFrame) -> DataFrame:
    """(g, start, det, m0.., l00..) from m0.. and c00..: the Cholesky factor of the covariance, to whose diagonal the floor's square is added."""
    out = moments
    for i, j in _pairs():
        c = F.col(f"c{i}{j}") + (FLOOR[i] ** 2 if i == j else 0.0)
        for k in range(j):
            c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(DIMENSIONS)), F.lit(0.0))
    return out.select("g", "start", det.alias("det"), *[f"m{i}" for i in range(DIMENSIONS)], *[f"l{i}{j}" for i, j in _pairs()])


def _sums(x, product=lambda i, j: F.col(f"x{i}") * F.col(f"x{j}")) -> list[Column]:
    """Whole-number sums, which do not depend on how rows are dealt."""
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    return [F.count("*").alias("n"), *[whole(F.col(f"{x}{i}")).alias(f"s{i}") for i in range(DIMENSIONS)], *[whole(product(i, j)).alias(f"q{i}{j}") for i, j in _pairs()]]


def _moments(sums: DataFrame, factor: float) -> DataFrame:
    """(g, start, m0.., c00..) from sums in thousandths."""
    mean = {i: F.col(f"s{i}").cast("double") / F.col("n") for i in range(DIMENSIONS)}
    return sums.select("g", "start", *[(mean[i] / 1000).alias(f"m{i}") for i in mean], *[(factor * (F.col(f"q{i}{j}").cast("double") / F.col("n") - mean[i] * mean[j]) / 1e6).alias(f"c{i}{j}") for i, j in _pairs()])


def _starts(members: DataFrame, scratch: Scratch, few: bool) -> DataFrame:
    """Three estimates a group to start from: medians and absolute deviations; mean and covariance; signs of the centred rows."""
    hint = F.broadcast if few else (lambda df: df)
    middles = scratch.save(members.groupBy("g").agg(*[F.percentile(f"x{i}", 0.5).alias(f"p{i}") for i in range(DIMENSIONS)]), "middles")
    centred = members.join(hint(middles), "g")
    spread = centred.groupBy("g").agg(*[F.percentile(F.abs(F.round(F.col(f"x{i}") - F.col(f"p{i}"))), 0.5).alias(f"d{i}") for i in range(DIMENSIONS)])
    # Fixed value: 1.4826 makes the median deviation that of a normal variable.
    spread = scratch.save(middles.join(spread, "g").select("g", *[(F.col(f"p{i}") / 1000).alias(f"m{i}") for i in range(DIMENSIONS)], *[(F.col(f"d{i}") * 1.4826 / 1000).alias(f"w{i}") for i in range(DIMENSIONS)]), "spread")
    medians = spread.select("g", F.lit(0).alias("start"), *[f"m{i}" for i in range(DIMENSIONS)], *[(F.col(f"w{i}") * F.col(f"w{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _pairs()])
    whole = _moments(members.groupBy("g").agg(*_sums("x")).withColumn("start", F.lit(1)), 1.0)
    scaled = members.join(hint(spread), "g").select("g", *[((F.col(f"x{i}") / 1000 - F.col(f"m{i}")) / (F.col(f"w{i}") + FLOOR[i])).alias(f"z{i}") for i in range(DIMENSIONS)])
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIMENSIONS)), F.col("z0") * F.col("z0")))
    signs = scaled.withColumn("norm", norm).select("g", *[F.coalesce(F.round(1000 * F.try_divide(F.col(f"z{i}"), F.col("norm"))), F.lit(0.0)).cast("long").alias(f"u{i}") for i in range(DIMENSIONS)])
    signs = signs.groupBy("g").agg(*_sums("u", lambda i, j: F.col(f"u{i}") * F.col(f"u{j}"))).join(spread, "g")
    scale = lambda i: F.col(f"w{i}") + FLOOR[i]
    signs = signs.select("g", F.lit(2).alias("start"), *[f"m{i}" for i in range(DIMENSIONS)], *[(DIMENSIONS * scale(i) * scale(j) * F.col(f"q{i}{j}").cast("double") / F.col("n") / 1e6).alias(f"c{i}{j}") for i, j in _pairs()])
    return scratch.save(_factored(medians.unionByName(whole).unionByName(signs)), "step-0")


def estimates(members: DataFrame, scratch: Scratch, few: bool, steps: int = 100) -> DataFrame:
    """(g, det, m0.., l00..): minimum-covariance-determinant estimates a group, from rows (g, x0..) in thousandths.

    From each start, steps are taken until the determinant falls no more; the
    smallest of a group stays. det is the determinant's logarithm.
    """
    now, best = _starts(members, scratch, few), None
    # Distances are compared on a logarithmic scale of 64 steps a power of two, which bounds how many sums there are.
    level = F.floor(64 * F.log2(F.greatest(F.col("d2"), F.lit(1e-6)))).cast("int")
    of_start = Window.partitionBy("g", "start")
    for k in range(1, steps + 1):
        near = _with_distance(members, now.drop("det"), few).select("g", "start", level.alias("level"), *[f"x{i}" for i in range(DIMENSIONS)])
        by_level = near.groupBy("g", "start", "level").agg(*_sums("x"))
        # The nearest levels that hold the core.
        upto = by_level.withColumn("below", F.sum("n").over(of_start.orderBy("level")) - F.col("n")).withColumn("all", F.sum("n").over(of_start))
        core = upto.where(F.col("below") < F.ceil(CORE * F.col("all"))).groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(DIMENSIONS)], *[f"q{i}{j}" for i, j in _pairs()])])
        found = scratch.save(_factored(_moments(core, CONSISTENCY)), f"step-{k}")
        if best is None:
            best, now = found, found
            continue
        before = best.select("g", "start", F.col("det").alias("before"))
        falls = found.join(before, ["g", "start"]).withColumn("falls", F.col("det") < F.col("before") - 1e-9).drop("before")
        now = scratch.save(falls.where("falls").drop("falls"), f"falls-{k}")
        if now.isEmpty():
            break
        best = scratch.save(best.join(now.select("g", "start"), ["g", "start"], "left_anti").unionByName(now), f"best-{k}")
    columns = [c for c in best.columns if c != "g"]
    return scratch.save(best.groupBy("g").agg(F.min(F.struct("det", *[c for c in columns if c != "det"])).alias("e")).select("g", *[f"e.{c}" for c in columns if c != "start"]), "estimates")


def memberships(rows: DataFrame, scratch: Scratch, min_group: int) -> tuple[DataFrame, DataFrame, bool]:
    """(lang, source, g) of each language and source, (g, x0..) of each group's rows, and whether the groups are few.

    A language and source with fewer than min_group rows is judged by its
    language's group, and where that has fewer too, by that of all rows.
    """
    sizes = scratch.save(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    few = sizes.count() <= MAX_BROADCAST_GROUPS
    hint = F.broadcast if few else (lambda df: df)
    level = F.when(F.col("n") >= min_group, 0).when(F.sum("n").over(Window.partitionBy("lang")) >= min_group, 1).otherwise(2)
    named = [F.col("level"), F.col("lang").isNull(), F.col("lang"), F.col("source").isNull(), F.col("source")]
    g = F.when(F.col("level") == 0, F.xxhash64(*named)).when(F.col("level") == 1, F.xxhash64(*named[:3])).otherwise(F.xxhash64("level"))
    given = scratch.save(sizes.withColumn("level", level).select("lang", "source", "level", g.alias("g")), "groups")
    other = given.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    x = [f"x{i}" for i in range(DIMENSIONS)]
    own = rows.join(hint(other.where("level = 0")), rows["lang"].eqNullSafe(F.col("g_lang")) & rows["source"].eqNullSafe(F.col("g_source"))).select("g", *x)
    of_lang = rows.join(hint(other.where("level = 1").select("g_lang", "g").distinct()), rows["lang"].eqNullSafe(F.col("g_lang"))).select("g", *x)
    of_all = rows.crossJoin(F.broadcast(other.where("level = 2").select("g").distinct())).select("g", *x)  # one row or none
    return given.select("lang", "source", "g"), scratch.save(own.unionByName(of_lang).unionByName(of_all), "members"), few


def judged(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """The input rows but for their texts, with the base statistics, base_failed, kept and d2."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    prepared = docs.select(carried(docs, *STATISTICS, "base_failed", "kept", "d2"), F.col(text_col).alias("text"))
    counted = statistics(prepared).select(F.struct("row", *STATISTICS).alias("given"), F.col(f"row.{lang_col}").alias("lang"), F.col(f"row.{source_col}").alias("source"), *STATISTICS)
    # What is written is the statistics and the row but for its text, which no later step reads.
    rows = counted.select(F.col("given").withField("row", F.col("given.row").dropFields(text_col)).alias("given"), "lang", "source", base_failed().alias("base_failed"), *transformed())
    rows = scratch.save(rows, "statistics")
    given, members, few = memberships(rows.where("not base_failed").select("lang", "source", *[f"x{i}" for i in range(DIMENSIONS)]), scratch, min_group)
    found = given.join(estimates(members, scratch, few).drop("det"), "g").withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    found = scratch.save(found, "by-group")
    named = rows.join(F.broadcast(found.select("g_lang", "g_source", "g")) if few else found.select("g_lang", "g_source", "g"), rows["lang"].eqNullSafe(F.col("g_lang")) & rows["source"].eqNullSafe(F.col("g_source")) & ~F.col("base_failed"), "left")
    by_g = found.drop("g_lang", "g_source").distinct()
    passed = _with_distance(named.where("g is not null"), by_g, few).select("given", "base_failed", "d2")
    failed = named.where("g is null").select("given", "base_failed", F.lit(None).cast("double").alias("d2"))
    out = passed.unionByName(failed)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)
    return out.select("given.row.*", *[F.col(f"given.{s}") for s in STATISTICS], "base_failed", kept.alias("kept"), "d2")
