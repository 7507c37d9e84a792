"""The weekly rollup over several batches: late and repeated records, replays, full copies and dropped state."""

import datetime as dt
import os

import pytest

from cellweave.streaming import weekly

SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def day(n, hour=12):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    part = next(f for f in os.listdir(f"{folder}/tmp-{name}") if f.startswith("part-"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{folder}/tmp-{name}/{part}", f"{folder}/in/{name}.parquet")


def run(spark, folder, fold=weekly.FOLD):
    weekly.run_available(weekly.rollup(weekly.read_events(spark, f"{folder}/in", files=1)), f"{folder}/out", f"{folder}/state", fold=fold)
    return table(spark, folder)


def table(spark, folder):
    return {(str(r.week)[:10], r.event_type): (r.n, r.value_cents) for r in weekly.merged(spark, f"{folder}/out").collect()}


@pytest.mark.parametrize("fold", [50, 2])
def test_batches_merge_by_key(spark, tmp_path, fold):
    feed(spark, tmp_path, "a", [(1, day(0), "view", 1.0), (2, day(1), "click", 2.5), (3, day(8), "view", 1.0)])
    assert run(spark, tmp_path, fold) == {("2024-01-01", "view"): (1, 100), ("2024-01-01", "click"): (1, 250), ("2024-01-08", "view"): (1, 100)}
    feed(spark, tmp_path, "b", [(4, day(2), "view", 3.0), (1, day(0), "view", 1.0), (5, day(15), "view", 1.0)])  # one more for the first week, one repeat
    assert run(spark, tmp_path, fold)["2024-01-01", "view"] == (2, 400)
    feed(spark, tmp_path, "c", [(6, day(60), "view", 1.0)])
    run(spark, tmp_path, fold)  # a watermark holds for late records from the batch after next on
    feed(spark, tmp_path, "c2", [(60, day(59), "view", 1.0)])
    run(spark, tmp_path, fold)
    feed(spark, tmp_path, "d", [(7, day(1), "view", 9.0), (8, day(58), "click", None)])  # the first is later than the watermark allows
    got = run(spark, tmp_path, fold)
    assert got == {("2024-01-01", "view"): (2, 400), ("2024-01-01", "click"): (1, 250), ("2024-01-08", "view"): (1, 100), ("2024-01-15", "view"): (1, 100), ("2024-02-26", "view"): (2, 200), ("2024-02-26", "click"): (1, None)}
    assert run(spark, tmp_path, fold) == got  # nothing new
    assert weekly.merged(spark, f"{tmp_path}/out").count() == len(got)
    feed(spark, tmp_path, "e", [(9, day(120), "view", 1.0)])
    feed(spark, tmp_path, "f", [(10, day(121), "view", 1.0)])
    run(spark, tmp_path, fold)
    assert max(state_rows(spark, tmp_path)) <= 4  # weeks and ids before the watermark have left the state


def state_rows(spark, folder):
    feed(spark, folder, "g", [(11, day(122), "view", 1.0)])
    stream = weekly.rollup(weekly.read_events(spark, f"{folder}/in", files=1))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(lambda batch, i: weekly.upsert(batch, i, f"{folder}/out")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [s.numRowsTotal for s in query.lastProgress.stateOperators]


@pytest.mark.parametrize("fold", [50, 3])
def test_a_replayed_batch_changes_nothing(spark, tmp_path, fold):
    out = f"{tmp_path}/out"
    assert weekly.merged(spark, out) is None
    make = lambda rows: spark.createDataFrame(rows, "week timestamp, event_type string, n long, value_cents long")
    batches = [[(day(0), "view", i + 1, 100 * i), (day(7 * i), "click", 1, i)] for i in range(7)]
    for i, rows in enumerate(batches):
        weekly.upsert(make(rows), i, out, fold=fold)
        before = table(spark, tmp_path)
        weekly.upsert(make(rows), i, out, fold=fold)
        assert table(spark, tmp_path) == before
    want = {}
    for rows in batches:
        want |= {(str(w)[:10], e): (n, c) for w, e, n, c in rows}
    assert table(spark, tmp_path) == want
    assert sorted(p for p in os.listdir(out) if p.startswith("full")) == (["full=0"] if fold == 50 else ["full=0", "full=1"])
