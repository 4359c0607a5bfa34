"""The recording source: the rows of a batch read, the same as a stream, new files after a restart."""

import numpy as np
import pytest

from epochflow.sources import recordings


def save(folder, name, x, labels, **more):
    np.savez(folder / name, X=x, labels=np.array(labels), fs=np.asarray(250.0), subject=np.asarray(name.split("__")[0]), session=np.asarray("1"), **more)


def test_batches_and_streams_with_a_restart(spark, tmp_path):
    spark.dataSource.register(recordings.Recordings)
    folder = tmp_path / "in"
    folder.mkdir()
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 2, 4))
    save(folder, "a__1.npz", x, ["left"] * 300 + ["idle_far"] * 300)
    save(folder, "b__1.npz", x[:3], ["right", "left", "left"], blocks=np.array([7, 8, 8]))
    (folder / "notes.txt").write_text("no recording")
    read = spark.read.format("recording").option("path", f"file://{folder}")
    rows = {(r.file, r.trial): r for r in read.load().collect()}
    assert len(rows) == 603 and np.allclose([rows["a__1.npz", i].signal for i in range(600)], x)
    assert {rows["a__1.npz", i].block for i in range(300, 600)} == {1} and [rows["b__1.npz", i].block for i in range(3)] == [7, 8, 8]
    assert sum(r.idle for r in rows.values()) == 300 and rows["b__1.npz", 0].subject == "b"
    only = read.option("subjects", "b").load()
    assert only.rdd.getNumPartitions() == 1 and only.count() == 3

    def run():
        out = spark.readStream.format("recording").option("path", f"file://{folder}").load()
        q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(f"file://{tmp_path}/out")

    assert {(r.file, r.trial): r.signal for r in run().collect()} == {k: r.signal for k, r in rows.items()}
    save(folder, "c__1.npz", x[:5], ["left"] * 5)
    assert {r["file"]: r["count"] for r in run().groupBy("file").count().collect()} == {"a__1.npz": 600, "b__1.npz": 3, "c__1.npz": 5}


def test_odd_folders_and_files(spark, tmp_path):
    spark.dataSource.register(recordings.Recordings)
    read = spark.read.format("recording")
    assert read.option("path", f"file://{tmp_path}/none").load().count() == 0
    save(tmp_path, "a__1.npz", np.zeros((2, 1, 1)), ["left"])
    with pytest.raises(Exception, match="2 trials, 1 labels"):
        read.option("path", f"file://{tmp_path}").load().collect()
