from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gradloom import suites
from gradloom.sinks.reports import markdown


def test_suites_cover_the_campaign():
    runs = list(suites.suites())
    assert Counter(r.suite for r in runs) == {"convergence": 12, "execution-speed": 6, "convergence-speed": 8, "scalability": 10}
    assert len({r.run_key for r in runs}) == len(runs)


def test_run_and_summary(spark, tmp_path):
    r = np.random.default_rng(0)
    y = r.integers(0, 10, 120)
    x = r.normal(size=(120, 64)) * 0.1 + (np.arange(64) % 10 == y[:, None])
    df = spark.createDataFrame([(k, x[k].tolist(), np.eye(10)[y[k]].tolist()) for k in range(120)], "row_id long, x array<float>, y array<float>")
    runs = [suites.Run("convergence", "small_conv", "all_reduce", 2, lr=1.0, batch_size=10, epochs=4, repeats=2), suites.Run("convergence", "small_conv", "ps_barrier", 2, 1, batch_size=500, epochs=2)]
    out = suites.run_suite(spark, runs, df.filter("row_id < 100"), df.filter("row_id >= 100"), 64, 10, str(tmp_path / "r"))
    row, failed = out.orderBy(F.col("error").isNotNull()).collect()
    assert row["repeats"] == 2 and row["epochs_ran"] == 4 and row["samples_per_sec"] > 0 and row["final_loss"] > 0
    # A configuration whose runs all failed keeps its first record.
    assert failed["strategy"] == "ps_barrier" and "larger than the dataset" in failed["error"] and failed["repeats"] is None
    records = suites.load_history(spark, str(tmp_path / "r"))
    assert records.filter(F.col("error").contains("larger than the dataset")).count() == 1
    assert "small_conv" in markdown(out)
