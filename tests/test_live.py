"""Live sessions: streams equal batches, deletions, settling, retries."""

import os
import time

import pytest
from pyspark.sql import functions as F

from nightsieve.operators.scoring import quality_score
from nightsieve.schema import ScoredMetric
from nightsieve.sources.files import discover_files
from nightsieve.streaming import folder_source, live

METRICS = [ScoredMetric("fwhm", 3.0), ScoredMetric("star_count", 1.5, lower_is_better=False)]


def events(spark, n=300):
    return spark.range(n).select(
        F.col("id").alias("frame_id"), F.element_at(F.array(F.lit("Ha"), F.lit("ha "), F.lit("OIII"), F.lit("")), (F.col("id") % 4 + 1).cast("int")).alias("filter_name"),
        (F.col("id") * 37 % 101 / 10).alias("fwhm"), (F.col("id") * 13 % 57).cast("int").alias("star_count"),
    )


def scores(df):
    return {r["frame_id"]: (r["group_key"], r["score"]) for r in df.select("frame_id", "group_key", "score").collect()}


def test_stream_equals_batch(spark, tmp_path):
    df = events(spark)
    for part in range(5):
        df.filter(F.col("frame_id") % 5 == part).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    session = live.LiveSession(spark, str(tmp_path / "state"), "frame_id", metrics=METRICS)
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    seen = []
    listener = live.Progress(seen.append, interval=0.0)
    spark.streams.addListener(listener)
    query = stream.writeStream.foreachBatch(session.on_arrivals).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert scores(session.scored()) == scores(quality_score(df, metrics=METRICS))
    gone = df.filter("frame_id % 7 = 0")
    session.apply(None, gone, 1000)
    assert scores(session.scored()) == scores(quality_score(df.filter("frame_id % 7 <> 0"), metrics=METRICS))
    deadline = time.time() + 10
    while time.time() < deadline and not (seen and seen[-1]["batches"] >= 3):
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert seen and seen[-1]["rows"] >= 300


def test_a_batch_run_twice_counts_once(spark, tmp_path):
    df = events(spark, 60)
    session = live.LiveSession(spark, str(tmp_path / "state"), "frame_id", metrics=METRICS)
    session.apply(df.filter("frame_id < 30"), None, 0)
    for _ in range(2):
        session.apply(df.filter("frame_id >= 30"), df.filter("frame_id < 5"), 1)
    assert session.frames().count() == 55
    assert scores(session.scored()) == scores(quality_score(df.filter("frame_id >= 5"), metrics=METRICS))


def measured(files):
    return files.withColumns({
        "filter_name": F.lit("Ha"), "fwhm": F.col("length").cast("double"), "star_count": F.length("path"),
    })


def test_sweeps_see_new_replaced_young_and_deleted_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    session = live.LiveSession(spark, str(tmp_path / "state"), measure=measured, metrics=METRICS)

    def put(name, size, age):
        (folder / name).write_bytes(b"x" * size)
        stamp = 1_700_000_000 - age
        os.utime(folder / name, (stamp, stamp))

    now = F.timestamp_seconds(F.lit(1_700_000_000))
    listing = lambda: discover_files(spark, str(folder))
    names = lambda: sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in session.frames().collect())
    session.sweep(listing(), 0, now)
    assert session.frames() is None
    put("a.fits", 10, 60)
    put("b.fits", 20, 1)
    session.sweep(listing(), 1, now)
    assert names() == [("a.fits", 10)]
    put("b.fits", 20, 5)
    session.sweep(listing(), 2, now)
    assert names() == [("a.fits", 10), ("b.fits", 20)]
    session.sweep(listing(), 3, now)
    (folder / "a.fits").unlink()
    put("b.fits", 30, 4)
    session.sweep(listing(), 4, now)
    assert names() == [("b.fits", 30)]
    put("a.fits", 11, 3)
    session.sweep(listing(), 5, now)
    assert names() == [("a.fits", 11), ("b.fits", 30)]
    assert session.scored().count() == 2


def test_watching_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    session = live.LiveSession(spark, str(tmp_path / "state"), measure=measured, metrics=METRICS)
    query = session.start(str(folder), interval="1 second")
    try:
        (folder / "a.fits").write_bytes(b"x")
        deadline = time.time() + 60
        while time.time() < deadline and (session.scored() is None or session.scored().count() < 1):
            time.sleep(1)
        assert session.scored().count() == 1
    finally:
        query.stop()


def test_arrival_stream_reads_frame_files_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.FITS", "b.txt", "c.xisf"):
        (folder / name).write_bytes(b"x")
    source = live.watch_source(spark, f"{folder};")
    unique = live.dedupe_stream(source, "modificationTime")
    query = unique.writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.table("arrivals").collect()) == ["a.FITS", "c.xisf"]
    with pytest.raises(ValueError):
        live.watch_source(spark, " ; ")


def put(folder, name, size, age=100):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"x" * size)
    os.utime(path, (time.time() - age,) * 2)


def changes(reader, start, end, only=None):
    """{(name, length, change)} of an offset; `only` reads some of the partitions."""
    parts = reader.partitions({"tick": start}, {"tick": end})
    rows = [r for part in parts[:only] for batch in reader.read(part) for r in batch.to_pylist()]
    return sorted((r["path"].rsplit("/", 1)[1], r["length"], r["change"]) for r in rows)


def test_folder_offsets_tell_arrivals_replacements_and_removals(tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    options = {"path": f"{folder};{tmp_path / 'missing'}", "state": str(state), "recursivefilelookup": "true", "buckets": "3"}
    reader = folder_source.FolderReader(options)
    assert reader.latestOffset() == {"tick": 1}
    assert changes(reader, 0, 1) == []
    for name in ("a.fits", "b.XISF", "c.txt", ".d.fits", "deep/er/e.fit"):
        put(folder, name, 5)
    put(folder, "young.fits", 5, age=0)
    assert reader.latestOffset() == {"tick": 2}
    assert changes(reader, 1, 2) == [("a.fits", 5, "arrived"), ("b.XISF", 5, "arrived")]
    assert changes(reader, 2, 3) == []  # the folder `deep` is known, `er` is not yet
    put(folder, "a.fits", 7)
    put(folder, "young.fits", 6)
    (folder / "b.XISF").unlink()
    want = [("a.fits", 7, "arrived"), ("b.XISF", 5, "removed"), ("e.fit", 5, "arrived"), ("young.fits", 6, "arrived")]
    assert changes(reader, 3, 4) == want
    put(folder, "later.fits", 1)
    again = folder_source.FolderReader(options)  # a restart that runs the offset again
    assert changes(again, 3, 4) == want
    again.commit({"tick": 3})
    assert changes(again, 3, 4) == want
    assert again.latestOffset() == {"tick": 5}
    assert changes(again, 4, 5, only=0) == []  # an offset nobody read
    again.commit({"tick": 5})
    (folder / "deep" / "er" / "e.fit").unlink()
    (folder / "deep" / "er").rmdir()
    put(folder, "a.fits", 7, age=0)  # replaced a moment ago: waits, and is not removed
    assert changes(again, 5, 6) == [("e.fit", 5, "removed"), ("later.fits", 1, "arrived")]
    again.commit({"tick": 6})
    assert all(name.endswith("-6.parquet") for name in os.listdir(state))
    with pytest.raises(ValueError):
        folder_source.FolderReader({"path": " ; ", "state": str(state)})


def test_a_session_goes_on_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    for n in range(3):
        put(folder, f"{n}.fits", n + 1)
    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "checkpoint")

    def run_until(done):
        session = live.LiveSession(spark, state, measure=measured, metrics=METRICS)
        query = session.start(str(folder), interval="1 second", checkpoint=checkpoint)
        try:
            deadline = time.time() + 60
            while time.time() < deadline and query.isActive and not done(session.frames()):
                time.sleep(1)
            assert query.exception() is None
            return sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in session.frames().collect())
        finally:
            query.stop()

    assert run_until(lambda f: f is not None and f.count() == 3) == [("0.fits", 1), ("1.fits", 2), ("2.fits", 3)]
    (folder / "0.fits").unlink()  # while nobody watches
    put(folder, "1.fits", 9)
    put(folder, "3.fits", 4)
    wanted = [("1.fits", 9), ("2.fits", 3), ("3.fits", 4)]
    assert run_until(lambda f: sorted(r["length"] for r in f.collect()) == [3, 4, 9]) == wanted
