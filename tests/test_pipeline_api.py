import numpy as np
import pytest

from echoplane.operators import features, generate, series
from echoplane.pipeline import Recorder, Rqa, batch
from echoplane.sources import series as sources


def test_fluent_run_and_results(spark, tmp_path):
    t = np.linspace(0, 12, 60)
    table = sources.from_arrays(spark, [np.sin(t), np.cos(2 * t), np.sin(t) + 0.1 * np.random.default_rng(0).normal(size=60)])
    run = Rqa(table, tau=1, m=2)
    rows = run.measures().collect()
    assert len(rows) == 3 and all(0 < r.recurrence_rate <= 1 and 0 <= r.determinism <= 1 for r in rows)
    assert run.measures() is run.measures() and run.windowed(20, 10).count() == 12
    run.save(str(tmp_path / "r"))
    tables, config = sources.load_results(spark, str(tmp_path / "r"))
    assert tables["measures"].count() == 3 and config["lmin"] == 2
    assert "rqa.measures_2()" in run.recorder.script() or run.recorder.n_blocks > 3
    with pytest.raises(ValueError):
        run.windowed(0)
    run.reset()


def test_batch_sets_errors_aside(spark, tmp_path):
    table = sources.from_arrays(spark, [np.sin(np.linspace(0, 9, 50)), np.arange(5.0)], ["good", "short"])
    batch(table, str(tmp_path), tau=1, m=2, eps=0.5)
    assert [r.sid for r in spark.read.parquet(f"{tmp_path}/measures").collect()] == ["good"]
    assert [r.sid for r in spark.read.parquet(f"{tmp_path}/errors").collect()] == ["short"]


def test_sources(spark, tmp_path):
    for k in range(3):
        np.save(tmp_path / f"{k}-x.npy", np.arange(20.0) + k)
    read = sources.load_signals(spark, str(tmp_path))
    assert read.count() == 60 and {r.label for r in sources.labels_from_ids(read.select("sid")).collect()} == {"0", "1", "2"}
    with pytest.raises(TypeError):
        sources.load_signals(spark, 3)
    with pytest.raises(ValueError):
        sources.from_arrays(spark, [np.float64(1)])


def test_feature_table_searches_parameters(spark):
    t = np.linspace(0, 4 * np.pi, 80)
    rng = np.random.default_rng(42)
    table = sources.from_arrays(spark, [np.sin((1 + 2 * (k % 2)) * t) + 0.1 * rng.normal(size=80) for k in range(4)])
    got = features.feature_table(table, 20, 10)
    assert got.count() == 4 and len(got.columns) == 1 + 11 + 33 + 3
    vectors, names = features.feature_vectors(got)
    assert len(vectors.first().features) == len(names) == 47


def test_sample_operators(spark):
    table = sources.from_arrays(spark, [np.arange(10.0)])
    assert [r.x[0] for r in series.moving_average(table, 4).orderBy("t").collect()] == [1.5 + k for k in range(7)]
    assert [r.x[0] for r in series.decimate(table, 4).orderBy("t").collect()] == [0, 4, 8]
    noisy = generate.add_noise(table, 10.0).orderBy("t").collect()
    assert len(noisy) == 10 and noisy[3].x[0] != 3.0


def test_recorder():
    r = Recorder()
    r.record("a", "x = 1\n")
    assert r.n_blocks == 1 and "# a\nx = 1" in r.script()
    r.clear()
    assert r.n_blocks == 0


def test_older_forms_behind_the_setting(spark):
    from echoplane.config import RqaConfig
    from echoplane.operators import information, parameters

    t = np.linspace(0, 9, 60)
    table = sources.from_arrays(spark, [np.sin(t), np.cos(2 * t) + 0.05 * np.random.default_rng(1).normal(size=60)])
    cfg = RqaConfig(compat="legacy", rdiv=20, epsdiv=101)
    run = Rqa(table, config=cfg)
    got = {r.sid: r for r in run.parameters().collect()}
    z = series.zscore(table, 1, 0.0)
    tau = information.delay_legacy(z)
    assert {r.sid: r.tau for r in tau.collect()} == {s: r.tau for s, r in got.items()}
    assert {r.sid: r.m for r in parameters.embedding_dimension_legacy(z, tau, cfg).collect()} == {s: r.m for s, r in got.items()}
    assert "percent_det" in Rqa(table, config=cfg, tau=1, m=2, eps=0.5).measures().columns
    assert Rqa(table, config=cfg, tau=1, m=2, eps=0.5).windowed(20, 10).where("recc_rate > 0").count() == 8
    with pytest.raises(ValueError):
        RqaConfig(compat="other")


def test_memory_guard():
    assert series.fits_memory(100, 200, 300) and not series.fits_memory(1000, 1000, 1000)
