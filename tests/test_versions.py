"""Tables in versions: replacement, snapshots, two writers, dead writers, batches that come again."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from siftwell.sources import versions

SHAPE = "x long, source string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def rows_of(df):
    return sorted(((r["x"], r["source"]) for r in df.collect()), key=repr)


def test_replacement_against_a_dict(spark, tmp_path):
    path, rng, held = str(tmp_path / "t"), random.Random(3), {}
    snapshots = {}
    for step in range(5):
        rows = [(rng.randrange(50), rng.choice(["a", "b", "c", "d", "e", None, ""])) for _ in range(rng.randrange(1, 12))]
        rows += rows[:1]  # repeated rows stay
        version = versions.replace(frame(spark, rows), path, buckets=4)
        assert version == step + 1
        for s in {s for _, s in rows}:
            held[s] = [r for r in rows if r[1] == s]
        snapshots[version] = sorted((r for part in held.values() for r in part), key=repr)
        assert rows_of(versions.read(spark, path)) == snapshots[version]
    for version, rows in snapshots.items():
        assert rows_of(versions.read(spark, path, version)) == rows
    assert rows_of(versions.read(spark, path, sources=["a", None])) == [r for r in snapshots[5] if r[1] in ("a", None)]


def test_only_the_asked_buckets_are_opened(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(frame(spark, [(i, f"s{i}") for i in range(200)]), path, buckets=16)
    files = versions.read(spark, path, sources=["s7"])
    assert rows_of(files) == [(7, "s7")] and len({f.split("_bucket=")[1].split("/")[0] for f in files.inputFiles()}) == 1
    assert len(versions.read(spark, path).inputFiles()) == 16


def test_a_frequent_source_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FILE_ROWS", 100)
    path = str(tmp_path / "t")
    many = spark.range(1000).select(F.col("id").alias("x"), F.lit("hot").alias("source"))
    versions.replace(many, path, buckets=4)
    got = versions.read(spark, path)
    assert got.count() == 1000 and got.select(F.input_file_name()).distinct().count() > 4


def test_writers_of_other_buckets_both_commit(spark, tmp_path, monkeypatch):
    """The second writer commits between the first one's reading and its commit."""
    path, commit = str(tmp_path / "t"), versions._commit
    versions.replace(frame(spark, [(1, "a"), (2, "b")]), path, buckets=64)
    done = []

    def late(*args):
        if not done:
            done.append(1)
            assert versions.replace(frame(spark, [(20, "b")]), path) == 2
        return commit(*args)

    monkeypatch.setattr(versions, "_commit", late)
    assert versions.replace(frame(spark, [(10, "a")]), path) == 3
    assert rows_of(versions.read(spark, path)) == [(10, "a"), (20, "b")] and rows_of(versions.read(spark, path, 2)) == [(1, "a"), (20, "b")]


def test_writers_of_one_bucket_conflict_and_the_work_is_done_again(spark, tmp_path, monkeypatch):
    path, commit = str(tmp_path / "t"), versions._commit
    versions.replace(frame(spark, [(1, "a"), (2, "b")]), path, buckets=1)
    left = []

    def late(*args):
        if left:
            left.pop()
            versions.replace(frame(spark, [(20 + len(left), "b")]), path)
        return commit(*args)

    monkeypatch.setattr(versions, "_commit", late)
    left.append(1)
    with pytest.raises(versions.Conflict):
        versions.replace(frame(spark, [(10, "a")]), path, attempts=1)
    assert rows_of(versions.read(spark, path)) == [(1, "a"), (20, "b")]
    left.append(1)
    versions.replace(frame(spark, [(11, "a")]), path)
    assert rows_of(versions.read(spark, path)) == [(11, "a"), (20, "b")]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []
    versions.replace(frame(spark, [(0, "start")]), path, buckets=2)

    def write(i):
        try:
            versions.replace(frame(spark, [(i, f"s{i}")]), path, attempts=10)
        except Exception as e:  # shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 5)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert not failed and versions.versions(spark, path) == [1, 2, 3, 4, 5]
    assert rows_of(versions.read(spark, path)) == [(0, "start")] + [(i, f"s{i}") for i in range(1, 5)]


def test_a_dead_writer_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.replace(frame(spark, [(1, "a")]), path, buckets=2)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            versions.replace(frame(spark, [(2, "a")]), path)
    assert rows_of(versions.read(spark, path)) == [(1, "a")] and len(list((tmp_path / "t/data").iterdir())) == 2
    versions.replace(frame(spark, [(3, "b")]), path)
    assert versions.vacuum(spark, path, keep=1) == [1] and len(list((tmp_path / "t/data").iterdir())) == 3  # young folders stay
    versions.vacuum(spark, path, keep=1, idle_hours=0)
    assert rows_of(versions.read(spark, path)) == [(1, "a"), (3, "b")]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, 1)


def test_batches_apply_once_and_odd_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.replace(frame(spark, []), path, batch=("stream", 0)) == 1
    assert rows_of(versions.read(spark, path)) == [] and rows_of(versions.read(spark, path, sources=["a"])) == []
    assert versions.replace(frame(spark, [(1, "a")]), path, batch=("stream", 1)) == 2
    assert versions.replace(frame(spark, [(9, "a")]), path, batch=("stream", 1)) == 2
    assert versions.replace(frame(spark, [(2, "a")]), path, batch=("other", 1)) == 3
    assert rows_of(versions.read(spark, path)) == [(2, "a")]
    with pytest.raises(ValueError, match="columns"):
        versions.replace(spark.createDataFrame([("a",)], "source string"), path)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))
