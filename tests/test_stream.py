"""Sources, and the alert stream: same rows as the batch job, across restarts and repeated batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelspark import registry
from panelspark.operators import label, rank
from panelspark.session import new_path
from panelspark.sources import readers, writers
from panelspark.streaming import alerts as stream


def _drop(df, path, first, last):
    span = df.filter(F.col("dt").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    span.repartition(3, "serial_number").write.mode("append").option("header", True).csv(path)


def _score(df):
    user = F.split_part("serial_number", F.lit("_"), F.lit(2)).cast("int")
    return df.select("serial_number", "model", "dt", (((user * 37 + F.dayofmonth("dt") * 101) % 97) / 97).alias("prob"))


def _alerts(df):
    return {tuple(r) for r in df.collect()}


def test_restart_continues_and_nothing_repeats(spark, sf):
    df = registry.panel(spark, sf).select("serial_number", "model", "dt")
    drop, out, state = new_path(spark, "drop"), new_path(spark, "out"), new_path(spark, "state")
    for first, last in (("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-30")):
        _drop(df, drop, first, last)
        stream.stream_daily_alerts(spark, drop, df.schema, out, state, _score, 0.8, 2, files_per_batch=2).awaitTermination()
    want = _alerts(rank.submission(rank.daily_alerts(_score(df), quantile=0.8, per_day=2)))
    assert _alerts(stream.read_alerts(spark, out)) == want and len(want) > 2


def _batches(spark, sf, n):
    scored = _score(registry.panel(spark, sf)).withColumn("part", F.pmod(F.xxhash64("serial_number", "dt"), F.lit(n)))
    return scored.drop("part"), [scored.filter(F.col("part") == i).drop("part") for i in range(n)]


def test_late_rows_and_a_batch_run_again(spark, sf):
    """Every day comes in every batch; after each one the alerts are those of all rows so far, also if the
    batch runs twice, and a batch that broke off before its mark does not count."""
    whole, parts = _batches(spark, sf, 3)
    out, so_far = new_path(spark, "out"), None
    for i, part in enumerate(parts):
        so_far = part if so_far is None else so_far.unionByName(part)
        want = _alerts(rank.submission(rank.daily_alerts(so_far, quantile=0.8, per_day=3)))
        for _ in range(2):
            stream._alert_batch(part, i, lambda rows: rows, out, 0.8, 3)
            assert _alerts(stream.read_alerts(spark, out)) == want
    folder = stream._Folder(spark, out)
    assert all(folder.numbers(f"state/dt={d.dt}") == [1, 2] for d in whole.select("dt").distinct().collect())  # no older versions
    folder.drop("done/batch=2")
    before = parts[0].unionByName(parts[1])
    assert _alerts(stream.read_alerts(spark, out)) == _alerts(rank.submission(rank.daily_alerts(before, quantile=0.8, per_day=3)))


def test_a_batch_reads_only_the_days_it_touches(spark, sf):
    whole, parts = _batches(spark, sf, 2)
    out = new_path(spark, "out")
    stream._alert_batch(parts[0], 0, lambda rows: rows, out, 0.8, 3)
    asked = []
    plain = stream._state
    stream._state = lambda spark, out, names: asked.extend(names) or plain(spark, out, names)
    try:
        day = parts[1].filter("dt = '2024-01-05'")
        stream._alert_batch(day, 1, lambda rows: rows, out, 0.8, 3)
        for i in range(2, 6):
            stream._alert_batch(day.limit(0), i, lambda rows: rows, out, 0.8, 3)
    finally:
        stream._state = plain
    assert asked == ["dt=2024-01-05/batch=0"]
    state = spark.read.parquet(f"{out}/state")
    assert state.groupBy("dt", "batch").count().agg(F.max("count")).first()[0] <= 3 * 3 + 1  # summary and alerts, however many rows
    so_far = parts[0].unionByName(day)
    assert _alerts(stream.read_alerts(spark, out)) == _alerts(rank.submission(rank.daily_alerts(so_far, quantile=0.8, per_day=3)))


def test_summaries_merge(spark):
    """Ties, missing scores and repeated rows: merged summaries give the alerts of the whole."""
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b"]) + str(rng.randint(0, 30)), 1, f"2024-01-0{rng.randint(1, 3)}", rng.choice([None, float("nan"), *[i / 10 for i in range(10)]])) for _ in range(300)]
    df = spark.createDataFrame(rows, "serial_number string, model int, dt string, prob double").withColumn("dt", F.col("dt").cast("date"))
    parts = [df.filter(F.pmod(F.hash("serial_number"), F.lit(4)) == i) for i in range(4)]
    for quantile, per_day in ((0.5, 4), (0.9, 2), (0.0, 100)):
        merged = rank.merge_day_summaries([rank.summarize_days(p, per_day) for p in parts], per_day)
        columns = ["dt", "prob", "model", "serial_number", "rank"]
        got = sorted(map(tuple, rank.alerts_of_summary(merged, quantile).select(*columns).collect()))
        assert got == sorted(map(tuple, rank.daily_alerts(df, quantile=quantile, per_day=per_day).select(*columns).collect())) and got


def test_csv_columns_go_by_name(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text(",serial_number,smart_5raw,manufacturer,smart_9raw,model,dt\n0,x,1.5,A,NaN,2,20180101\n")
    b.write_text(",serial_number,dt,manufacturer,smart_9raw,model,smart_5raw\n0,y,20180102,A,3,1,4\n")
    got = readers.scan_csv_panel(spark, str(a), ["smart_9raw", "smart_5raw"]).first()
    assert (got.serial_number, got.model, str(got.dt), got.smart_9raw, got.smart_5raw) == ("x", 2, "2018-01-01", None, 1.5)
    with pytest.raises(ValueError):
        readers.scan_csv_panel(spark, str(a), ["smart_1_normalized"])
    with pytest.raises(Exception):
        readers.scan_csv_panel(spark, [str(a), str(b)], ["smart_9raw"]).collect()  # headers differ


def test_first_listed_fault_follows_the_files(spark, tmp_path):
    first, second = tmp_path / "a.csv", tmp_path / "b.csv"
    first.write_text("manufacturer,model,serial_number,fault_time,tag\nA,1,x,2018-03-31,2\nA,1,x,2018-03-10,5\nA,2,y,2018-01-05,0\n")
    second.write_text("manufacturer,model,serial_number,fault_time,tag,key\nA,2,y,2018-01-01,4,k\nA,1,z,2018-02-02,6,k\n")
    log = readers.scan_fault_log(spark, str(first), str(second))
    assert log.count() == 5
    got = {r["serial_number"]: (str(r["fault_time"]), r["fault_tag"]) for r in label.first_listed_fault(log).collect()}
    assert got == {"x": ("2018-03-31", 2), "y": ("2018-01-05", 0), "z": ("2018-02-02", 6)}


def test_daily_paths_cross_a_month():
    assert readers.daily_paths("d", "2018-08-31", "2018-09-01", "s_{day}.csv") == ["d/s_20180831.csv", "d/s_20180901.csv"]


def test_sequences_are_cut_into_files(spark, sf):
    path = new_path(spark, "sequences")
    writers.write_sequences(registry.labelled(spark, sf), path, ["smart_4raw"], length=5, rows_per_file=20)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert sizes <= 20


def test_partitioned_days_are_pruned(spark, sf):
    path = new_path(spark, "days")
    registry.panel(spark, sf).select("dt", "serial_number", "smart_4raw").write.partitionBy("dt").parquet(path)
    df = readers.scan_day_partitions(spark, path, "2024-01-03", "2024-01-04")
    assert "PartitionFilters: [isnotnull(dt" in df._jdf.queryExecution().executedPlan().toString()
    assert {str(r["dt"]) for r in df.select("dt").distinct().collect()} == {"2024-01-03", "2024-01-04"}


def test_store_refuses_another_type(spark, sf):
    path = new_path(spark, "store")
    df = registry.panel(spark, sf).select("dt", "serial_number", "smart_4raw")
    writers.store_panel(df, path)
    with pytest.raises(TypeError, match="smart_4raw"):
        writers.store_panel(df.withColumn("smart_4raw", F.col("smart_4raw").cast("string")), path)
    writers.store_panel(df, path)
    assert writers.read_store(spark, path).count() == df.count()
