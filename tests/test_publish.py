"""A3: a write that fails or is killed leaves the old table readable."""
import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from riskweave.sources import publish as P
from riskweave.sources.io import read_table, write_contract

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted(r["v"] for r in df.collect())


def failing(spark):
    return spark.range(0, 40, 1, 4).select(F.when(F.col("id") < 35, F.col("id")).otherwise(F.raise_error(F.lit("broken row")).cast("long")).alias("v"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failed_write_changes_nothing(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    write_contract(spark.createDataFrame([(1,), (2,)], "v long"), path, fmt)
    with pytest.raises(Exception, match="broken row"):
        write_contract(failing(spark), path, fmt)
    assert rows(read_table(spark, path, fmt=fmt)) == [1, 2] and os.listdir(tmp_path) == ["t"]
    write_contract(spark.createDataFrame([(3,)], "v long"), path, fmt)
    assert rows(read_table(spark, path, fmt=fmt)) == [3] and os.listdir(tmp_path) == ["t"]
    # a table can be rewritten from itself
    write_contract(read_table(spark, path, fmt=fmt).select((F.col("v") + 1).alias("v")), path, fmt)
    assert rows(read_table(spark, path, fmt=fmt)) == [4]


def test_a_job_that_died_between_the_moves_is_repaired(spark, tmp_path):
    path = str(tmp_path / "t")
    write_contract(spark.createDataFrame([(1,)], "v long"), path)
    os.rename(path, tmp_path / f".t{P._OLD}0")
    assert rows(read_table(spark, path)) == [1]
    assert not P.repaired(spark, path)


def test_versions_are_committed_by_name(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in (1, 2, 3):
        P.publish(spark.createDataFrame([(v,)], "v long"), path)
        assert rows(read_table(spark, path)) == [v]
    assert len(P.versions(spark, path)) == 2                              # the one before stays for its readers
    before = read_table(spark, path)
    P.publish(spark.createDataFrame([(4,)], "v long"), path)
    assert rows(before) == [3] and rows(read_table(spark, path)) == [4]
    with pytest.raises(Exception, match="broken row"):
        P.publish(failing(spark), path)
    assert rows(read_table(spark, path)) == [4]
    assert P.versions(spark, str(tmp_path / "nothing")) == [] and P.current(spark, "plain") == "plain"


def test_a_killed_process_leaves_the_old_table(spark, tmp_path):
    path, started = str(tmp_path / "t"), tmp_path / "started"
    write_contract(spark.createDataFrame([(1,)], "v long"), path)
    P.publish(spark.createDataFrame([(1,)], "v long"), path + "2")
    code = f"""
import time, pathlib
from pyspark.sql import functions as F
from riskweave.session import get_session
from riskweave.sources import publish as P
spark = get_session("local[2]", shuffle_partitions=2)
@F.udf("long")
def slow(v):
    pathlib.Path({str(started)!r}).touch()
    time.sleep(0.2)
    return v
df = spark.range(2000).select(slow("id").alias("v"))
from riskweave.sources.io import write_contract
import threading
threading.Thread(target=lambda: P.publish(df, {path + "2"!r})).start()
write_contract(df, {path!r})
"""
    job = subprocess.Popen([sys.executable, "-c", code], cwd=ROOT, start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        for _ in range(240):
            if started.exists():
                break
            time.sleep(0.5)
        assert started.exists() and job.poll() is None
        time.sleep(1)
    finally:
        os.killpg(job.pid, signal.SIGKILL)                                # the process group that this test started
        job.wait()
    assert rows(read_table(spark, path)) == [1] and rows(read_table(spark, path + "2")) == [1]
    write_contract(spark.createDataFrame([(5,)], "v long"), path)
    assert rows(read_table(spark, path)) == [5]


def test_training_falls_back_to_split_importances(spark, tmp_path, monkeypatch, caplog):
    from riskweave.plans import jobs
    from tests.test_boost import applications
    from riskweave.operators import ml as M
    df = applications(spark).where("TARGET is not null")
    num, cat = M.feature_lists(df)
    model, _, names = M.train_classifier(df, num, cat, "lightgbm", {"n_estimators": 2, "num_leaves": 4})

    def broken(*_):
        raise ValueError("no values for this model")
    monkeypatch.setattr(jobs.SH, "shap_importance", broken)
    path = jobs._explained(model, df, names, "SK_ID_CURR", str(tmp_path / "imp"), "parquet")
    got = spark.read.parquet(path).collect()
    assert {r["feature"] for r in got} == set(names) and "split importances" in caplog.text

    def lost(*_):
        raise RuntimeError("Job aborted due to stage failure")
    monkeypatch.setattr(jobs.SH, "shap_importance", lost)
    with pytest.raises(RuntimeError):
        jobs._explained(model, df, names, "SK_ID_CURR", str(tmp_path / "imp2"), "parquet")
