"""Every query with SQL against DuckDB at the smallest scale, and the stream against its batch form."""

import duckdb
import pandas as pd
import pytest

from vigil.plans import catalog

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, PATH).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_stream_is_batch(spark):
    assert rows(catalog.QUERIES["stream_drift_detector"](spark, PATH).toPandas()) == rows(catalog.QUERIES["drift_detector_batch"](spark, PATH).toPandas())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"stream_drift_detector", "drift_detector_batch"}))
def test_others_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, PATH).count() > 0


def test_overlay_ties(spark, tmp_path):
    """A step on the bound of the envelope is not clipped in any of many equal episodes, and ties of the ninth digit are rounded as in SQL."""
    some = [u + k for u in (14, 95, 215, 633, 822, 1155, 1207, 1304, 1388, 1441) for k in (0, 10)]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE VIEW given AS SELECT * FROM '/root/testdata/sf0.1/events.parquet'")
    con.execute(f"COPY (SELECT given.* REPLACE (user_id + 1501 * r AS user_id) FROM given, range(20) c(r) WHERE user_id IN {tuple(some)} UNION ALL SELECT * REPLACE (100000 AS user_id, 0.72 AS value) FROM given WHERE event_type = 'error' AND event_id < 9000) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    key = ["episode_id", "t", "service"]
    found = catalog.QUERIES["overlay_residual"](spark, str(tmp_path)).toPandas().sort_values(key, ignore_index=True)
    wanted = con.sql(catalog.ORACLE_SQL["overlay_residual"]).df().sort_values(key, ignore_index=True)
    assert found[key].values.tolist() == wanted[key].values.tolist()
    assert found["clipped"].tolist() == wanted["clipped"].tolist() and found["value"].tolist() == wanted["value"].tolist()
