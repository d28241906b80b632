"""One query per operator that no catalogue query shows, and extensions, labelled so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import civil, geo, scalar
from ..operators.regularize import regularized
from ..operators.spatial_join import crossing_polygons
from ..operators.threshold import thresholded_agg
from ..sources import driver_tables as tables
from ..sources.driver_tables import with_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name)


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def op_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)")
def op_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = read(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000)).select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT r_name, n_name, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3")
def op_multiway_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact with a chain of small dimensions; Spark broadcasts those that are small."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT p_partkey, (i - 1)::INT AS place, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def op_lateral_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array's elements with their places from zero."""
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word"))


@query("""SELECT n_nationkey, measure, value FROM (SELECT n_nationkey, unnest(['customers', 'suppliers']) AS measure, unnest([c, s]) AS value FROM
(SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation))""")
def op_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda t, key, n: read(spark, sf_dir, t).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(n))
    wide = read(spark, sf_dir, "nation").select("n_nationkey").join(count("customer", "c_nationkey", "customers"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left").na.fill(0)
    return wide.unpivot(["n_nationkey"], ["customers", "suppliers"], "measure", "value")


@query("SELECT c_mktsegment, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def op_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    wide = joined.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return wide.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("SELECT p_brand, CASE WHEN count(*) >= 80 THEN count(*) END AS parts, CASE WHEN count(*) >= 80 THEN round(avg(p_retailprice), 4) END AS mean_price FROM part GROUP BY 1")
def op_threshold_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small groups kept, their aggregates withheld."""
    return thresholded_agg(read(spark, sf_dir, "part"), ["p_brand"], [F.count("*").alias("parts"), F.round(F.avg("p_retailprice"), 4).alias("mean_price")], 80, "null")


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, hour, coalesce(n, 0) AS n FROM (SELECT event_type, hour FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS hour)) g LEFT JOIN d USING (event_type, hour)""")
def op_regularized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each kind of event, days without one included."""
    found = regularized(read(spark, sf_dir, "events"), "ts", [F.count("*").alias("n")], "2023-12-30 00:00:00", "2024-02-02 00:00:00", ["event_type"], "day")
    return found.select("event_type", "hour", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_tables("areas", "segments", body="""
SELECT a.id AS area_id, count(*) AS segments FROM segments s JOIN areas a ON s.lng <= a.east AND s.lng + 0.002::DOUBLE >= a.west AND s.lat BETWEEN a.south AND a.north GROUP BY 1"""))
def op_spatial_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that meet each area: a join on grid cells, each pair once."""
    s = tables.segments(spark, sf_dir).withColumn("segment_id", F.xxhash64("geometry"))
    pairs = crossing_polygons(s.select("segment_id", F.col("geometry").alias("line")), tables.areas(spark, sf_dir).select(F.col("id").alias("area_id"), "geometry"), "line", "geometry", "segment_id", "area_id")
    return pairs.groupBy("area_id").agg(F.count("*").alias("segments"))


@query(r"""SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host, lower(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '[^A-Za-z0-9 ]', '', 'g')) AS title,
strlen(html) AS bytes, len(regexp_extract_all(html, '<a ')) AS links FROM pages""")
def op_strings_and_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    title = F.lower(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)", 1), "[^A-Za-z0-9 ]", ""))
    return p.select("page_id", F.regexp_extract("url", "https?://([^/]+)", 1).alias("host"), title.alias("title"), F.octet_length("html").cast("long").alias("bytes"), F.size(F.regexp_extract_all("html", F.lit("<a "), 0)).cast("long").alias("links"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN json_extract_string(props, '$.k')::BIGINT > 50 THEN 'high' ELSE 'low' END AS band FROM events")
def op_json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = scalar.json_value("props", "k", "long")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k > 50, "high").otherwise("low").alias("band"))


@query("""SELECT event_id, dayofweek(ts)::INT + 1 AS dow, strftime(ts, '%Y-%W') AS year_week, (ts::DATE - dayofweek(ts)::INT)::DATE AS sunday,
date_sub('hour', ts, TIMESTAMP '2024-02-01') AS hours_left, hour(timezone('America/New_York', timezone('UTC', ts)))::INT AS local_hour FROM events""")
def op_civil_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select("event_id", F.dayofweek("ts").alias("dow"), civil.year_week("ts").alias("year_week"), civil.sunday_week("ts").alias("sunday"), civil.elapsed("HOUR", F.col("ts"), end).alias("hours_left"), civil.local_hour("ts").alias("local_hour"))


@query(with_tables("areas", body="SELECT id, 'POLYGON((' || printf('%.2f %.2f', west, south) || '))' AS corner, round(2 * " + geo.haversine_sql("west", "south", "west", "north") + ", 3) AS twice_height FROM areas"))
def op_geometry_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geo.bounds("geometry")
    side = geo.haversine(b["west"], b["south"], b["west"], b["north"])
    return tables.areas(spark, sf_dir).select("id", F.concat(F.lit("POLYGON(("), F.format_string("%.2f %.2f", b["west"], b["south"]), F.lit("))")).alias("corner"), F.round(2 * side, 3).alias("twice_height"))


@query("SELECT event_type, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS nth FROM events) WHERE nth <= 5")
def op_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return read(spark, sf_dir, "events").withColumn("nth", F.row_number().over(w)).where("nth <= 5").select("event_type", "user_id", "value")


# --- extensions: not asked for by any query above ---


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return found.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "lines", "quantity")


@query("SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(c_nationkey, -1) AS nation, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def ext_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "customer").groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return found.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("c_nationkey", F.lit(-1)).alias("nation"), "n")


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events")
def ext_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey").subtract(read(spark, sf_dir, "events").select("user_id"))


@query("""SELECT event_id, rank() OVER w AS rnk, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY event_type ORDER BY value, event_id) AS quarter, lead(value) OVER (PARTITION BY event_type ORDER BY value, event_id) AS next_value
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)""")
def ext_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, unique = Window.partitionBy("event_type").orderBy("value"), Window.partitionBy("event_type").orderBy("value", "event_id")
    return read(spark, sf_dir, "events").select("event_id", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(unique).cast("long").alias("quarter"), F.lead("value").over(unique).alias("next_value"))


@query("SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts - INTERVAL 24 YEAR AS t FROM events) e ASOF JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.t >= o.o_orderdate")
def ext_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order before each event: both sides in one order per key, carried forward."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.timestamp_add("YEAR", F.lit(-24), "ts").alias("t"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("t")).agg(F.max("o_orderkey").alias("o_orderkey")).select("key", "t", F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("key").orderBy("t", F.col("event_id").isNotNull())
    both = e.unionByName(o).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w))
    return both.where("event_id is not null and o_orderkey is not null").select("event_id", "o_orderkey")


@query("SELECT date_trunc('hour', ts) + to_minutes((15 * floor(minute(ts) / 15))::INT) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM n GROUP BY user_id, k""")
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    found = e.groupBy("user_id", F.session_window("t", "2 hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
    return found.select("user_id", "first_ts", "last_ts", "events")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, e.vec_id, round(list_cosine_similarity(v, e.embedding::DOUBLE[]), 9) AS cosine FROM q, embeddings e)
SELECT query_id, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS nth FROM s) WHERE nth <= 3""")
def ext_vector_top_k(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """Cosine neighbours of every vector whose id is divisible by 50, among all vectors."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, cosine): the k rows most alike to each query, ties by id, by brute force.

    Every block of queries meets every block of vectors in a task, which gives its own
    best k; the best of those follow. Pairs without a cosine are left out: null or
    zero vectors, null or non-finite components, unequal lengths.
    """
    shares = [max(1, -(-df.count() // block)) for df in (queries, vectors)]
    deal = lambda df, own, n, other, m: df.withColumn(own, F.floor(F.rand(1) * n).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = deal(queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>")), "qb", shares[0], "eb", shares[1])
    e = deal(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), "eb", shares[1], "qb", shares[0])

    def best(left, right):
        import numpy as np
        import pyarrow as pa

        def units(table, name) -> dict:
            """Ids and unit vectors by length."""
            found: dict = {}
            for i, x in zip(table.column(name).to_pylist(), table.column("embedding").combine_chunks(), strict=True):
                if x.is_valid and len(x) and not x.values.null_count:
                    v = x.values.to_numpy()
                    if np.isfinite(v).all() and (largest := np.abs(v).max()):
                        v = v / largest
                        found.setdefault(len(v), []).append((i, v / np.linalg.norm(v)))
            return found

        rows, among = [], units(right, "vec_id")
        for length, own in units(left, "query_id").items():
            # Ids in order, null last: a stable sort by cosine then breaks ties by id.
            others = sorted(among.get(length, []), key=lambda x: (x[0] is None, x[0] or 0))
            if others:
                cosines = np.round(np.array([v for _, v in own]) @ np.array([v for _, v in others]).T, 9)
                for (i, _), c in zip(own, cosines, strict=True):
                    rows += [(i, others[j][0], c[j]) for j in np.argsort(-c, kind="stable")[:k].tolist()]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "cosine"])

    partial = q.groupBy("qb", "eb").cogroup(e.groupBy("qb", "eb")).applyInArrow(best, "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc_nulls_last("vec_id"))
    return partial.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("query_id", "vec_id", "cosine")
