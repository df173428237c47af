import subprocess
import sys

import __spark_entry__ as entry


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and 0 <= rows[0].recurrence_rate <= 1


def test_oracles_agree(spark):
    import duckdb

    from echoplane.plans.queries import ORACLE, QUERIES

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("events", "orders", "embeddings", "customer"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("rqa_measures", "windowed_measures", "mi_curve", "fnn_r0", "eps_search", "feature_table"):
        df = QUERIES[name](spark, d)
        found = con.execute(ORACLE[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(columns).collect())) == sorted(found.fetchall()), name
