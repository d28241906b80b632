"""Queries over whole tables, where their SQL states a part."""

import numpy as np
import pytest

from terrametric.plans import assets, operators
from terrametric.sources.driver_tables import with_tables

from .conftest import DATA
from .oracle import rows_of, sql_rows


def test_all_tracks(spark):
    sql = with_tables("observations", body="SELECT DISTINCT 'track-' || asset_key AS track_id, printf('%.6f,%.6f', longitude, latitude) AS place, observation_id, gcs_uri AS signed_url, capture_time FROM observations")
    got = rows_of(assets.sv_tracks(spark, DATA))
    assert got == sql_rows(DATA, sql)[1]
    assert sql_rows(DATA, assets.ORACLES["sv_tracks"])[1] == got  # its SQL states them all


def brute_nearest(rows, queries, k):
    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b) or not np.isfinite(a + b).all():
            return None
        return round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 9)

    out = []
    for q, x in queries:
        found = [(c, i) for i, y in rows if (c := cosine(x, y)) is not None]
        out += [(q, i, c) for c, i in sorted(found, key=lambda z: (-z[0], z[1]))[:k]]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_equals_brute_force(spark, block):
    r = np.random.default_rng(2)
    rows = [(i, r.integers(-3, 4, 4).astype(float).tolist()) for i in range(120)]
    rows += [(120, None), (121, [0.0] * 4), (122, [float("nan")] * 4), (123, [None] * 4), (124, [1.0, 2.0]), (125, [2.0, 4.0]), (150, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = operators.nearest(df, df.withColumnRenamed("vec_id", "query_id"), 3, block)
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, rows, 3)


def test_search_covers_every_fiftieth_row(spark):
    rows = [(x["vec_id"], [float(v) for v in x["embedding"]]) for x in operators.read(spark, DATA, "embeddings").collect()]
    queries = [x for x in rows if x[0] % 50 == 0]
    assert len(queries) > 5
    assert sorted(map(tuple, operators.ext_vector_top_k(spark, DATA).collect())) == brute_nearest(rows, queries, 3)
