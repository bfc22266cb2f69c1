"""Streams give what the batch forms give."""

import os
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from pixelmill.operators import catalog as C, frames as FR, ledger as L
from pixelmill.streaming import state as ST, watch as W
from tests_util import png


def stream_of(spark, df, tmp_path, name, parts, part):
    """Replays a table as a stream of `parts` files in order of `part`."""
    folder = str(tmp_path / name)
    for i in range(parts):
        df.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, df, name, tmp_path):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / f"{name}_cp")).start())
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


FAR = datetime(2100, 1, 1)


def shuffled(spark, df, key, at, tmp_path, name, parts=3):
    """A stream of the rows dealt over its files at random; then two rows of far later keys move the watermark past all."""
    df = df.cache()
    folder = str(tmp_path / name)
    for i in range(parts):
        df.where(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(folder)
    one = df.limit(1).toPandas()
    for k in (1, 2):
        last = one.assign(**{key: -k if one[key].dtype != object else f"far{k}", at: FAR + timedelta(days=10 * k)})
        spark.createDataFrame(last, df.schema).coalesce(1).write.mode("append").parquet(folder)
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return live


def states(spark, tmp_path, name, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(str(tmp_path / f"{name}_cp"))


# Rows may be as late as the whole table is long.
LATE = "5000 days"


def test_frame_dedupe_equals_batch_in_any_order(spark, views, tmp_path):
    frames = views.frames().select("anim_id", "frame_no", F.when(F.col("anim_id") % 5 != 0, F.col("sig")).alias("sig"), F.timestamp_seconds(1_600_000_000 + F.col("frame_no") * 60).alias("at"))
    live = shuffled(spark, frames, "anim_id", "at", tmp_path, "frames")
    got = {(r.anim_id, r.frame_no) for r in drain(spark, ST.stream_frame_dedupe(live, LATE), "dedupe", tmp_path).collect()}
    want = {(r.anim_id, r.frame_no) for r in FR.merge_islands(frames.withColumn("duration_ms", F.lit(1))).collect()}
    assert {x for x in got if x[0] >= 0} == want


def test_ready_equals_batch_in_any_order(spark, views, tmp_path):
    looks = views.looks().select("path", "size_bytes", "seen_at", "look_id")
    live = shuffled(spark, looks, "path", "seen_at", tmp_path, "looks")
    got = {r.look_id for r in drain(spark, ST.ready(live, LATE), "ready", tmp_path).where("path NOT LIKE 'far%'").collect()}
    assert got == {r.look_id for r in C.ready_files(looks).collect()}


def test_metrics_equal_batch_and_state_ends(spark, views, tmp_path):
    done = views.ledger().where("status = 'done'").select("run_id", "input_path", "elapsed_s", "ts")
    live = shuffled(spark, done, "run_id", "ts", tmp_path, "done")
    got = {r.input_path: r.ema for r in drain(spark, ST.stream_metrics(live, LATE), "metrics", tmp_path).where("run_id >= 0").collect()}
    want = {r.input_path: r.ema for r in L.ema(done, ["run_id"], ["ts", "input_path"], "elapsed_s").collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    # Of all runs only the far ones are still known: nothing waits and nothing is kept behind the watermark.
    assert {r.key.run_id for r in states(spark, tmp_path, "metrics", "known").collect()} <= {-1, -2}
    assert {r.key.run_id for r in states(spark, tmp_path, "metrics", "waiting").collect()} <= {-1, -2}


def test_settle_batch(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(milliseconds=ms)) for ms in (0, 400, 1300, 5000, 5900)]
    got = W.settle(spark.createDataFrame(rows, "folder string, ts timestamp")).orderBy("start").collect()
    assert [r.n_changes for r in got] == [3, 2]


def test_watched_folder_runs_each_file_once(spark, tmp_path):
    folder, ledger, cp = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "cp")
    os.makedirs(folder / "sub")
    pixels = np.zeros((2, 3, 3), np.uint8)
    png(folder / "old.png", pixels)
    os.utime(folder / "old.png", (1_600_000_000, 1_600_000_000))
    since = datetime.now() - timedelta(hours=1)
    png(folder / "a.PNG", pixels)
    png(folder / "sub" / "hidden.png", pixels)
    (folder / "note.txt").write_text("no picture")
    seen = []

    def process(files):
        seen.append(sorted(os.path.basename(r.path) for r in files.select("path").collect()))
        return files.select(F.col("path").alias("input_path"), F.lit("done").alias("status"))

    for extra in ("", "b.jpg", ""):
        if extra:
            png(folder / extra, pixels)
        W.process_new_files(W.watch_folder(spark, str(folder), since), process, ledger, cp).awaitTermination()
    assert [s for s in seen if s] == [["a.PNG"], ["b.jpg"]]
    # A fresh checkpoint meets the ledger: nothing is done again.
    W.process_new_files(W.watch_folder(spark, str(folder), since), process, ledger, cp + "2").awaitTermination()
    assert spark.read.parquet(ledger).count() == 2


def test_dedupe_of_null_signatures(spark, tmp_path):
    rows = [(1, k, s) for k, s in enumerate([None, None, "a", None, None, "b", "b"])]
    frames = spark.createDataFrame(rows, "anim_id long, frame_no long, sig string").withColumns({"duration_ms": F.lit(10), "at": F.timestamp_seconds(1_600_000_000 + F.col("frame_no"))})
    live = shuffled(spark, frames, "anim_id", "at", tmp_path, "nulls", 2)
    got = sorted(r.frame_no for r in drain(spark, ST.stream_frame_dedupe(live, LATE), "nulls", tmp_path).where("anim_id = 1").collect())
    assert got == sorted(r.frame_no for r in FR.merge_islands(frames).collect()) == [0, 2, 3, 5]


def test_settle_on_a_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(milliseconds=ms), part) for ms, part in ((0, 0), (400, 0), (1300, 0), (5000, 1), (5900, 1), (60_000, 2), (61_500, 2))]
    df = spark.createDataFrame(rows, "folder string, ts timestamp, part int")
    live = stream_of(spark, df, tmp_path, "changes", 3, F.col("part"))
    got = drain(spark, W.settle(live), "settled", tmp_path).orderBy("start").collect()
    assert [r.n_changes for r in got] == [3, 2]


def test_failed_files_are_taken_up_again(spark, tmp_path):
    folder, ledger = tmp_path / "in", str(tmp_path / "ledger")
    os.makedirs(folder)
    for k in (10, 9, 2):
        png(folder / f"img{k}.png", np.zeros((2, 2, 3), np.uint8))
    seen, status = [], "failed"

    def process(files):
        names = [os.path.basename(r.path) for r in files.select("path").collect()]
        seen.append(names)
        state = F.when(F.col("path").endswith("9.png"), status).otherwise("done")
        return files.select(F.col("path").alias("input_path"), state.alias("status"), F.current_timestamp().alias("ts"))

    for k in range(3):
        if k == 2:
            status = "done"
        W.process_new_files(W.watch_folder(spark, str(folder), max_files=2 if k == 0 else None), process, ledger, str(tmp_path / f"cp{k}")).awaitTermination()
    assert sorted(sum(seen[:2], [])) == ["img10.png", "img2.png", "img9.png"] and max(map(len, seen[:2])) == 2
    assert all(names == sorted(names, key=lambda n: int(n[3:-4])) for names in seen)
    assert [s for s in seen[2:] if s] == [["img9.png"], ["img9.png"]]
    assert W.failed_files(spark.read.parquet(ledger)).count() == 0
