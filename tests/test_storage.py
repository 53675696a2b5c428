"""Intermediate tables: runs that hold or interleave with one another keep their own."""

import threading

import pytest
from gridloom import storage


def paths(*frames):
    return [f._gl_path for f in frames]


def there(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def test_scopes_delete_their_own(spark):
    before = storage.mark()
    outside = storage.spool(spark.range(3))
    with storage.scope(spark):
        one = storage.spool(spark.range(4))
        with storage.scope(spark) as inner:
            two, kept = storage.spool(spark.range(5)), storage.spool(spark.range(6), into=inner.rpartition("/")[0])
            assert [f.count() for f in (outside, one, two, kept)] == [3, 4, 5, 6]
        assert [there(spark, p) for p in paths(outside, one, two, kept)] == [True, True, False, True] and one.count() == 4
    assert not there(spark, one._gl_path) and kept.count() == 6
    assert storage.mark() == before + 2
    storage.discard(kept)
    storage.discard(outside)
    assert storage.mark() == before and not there(spark, kept._gl_path)
    with pytest.raises(ValueError, match="boom"), storage.scope(spark):
        lost = storage.spool(spark.range(2))
        raise ValueError("boom")
    assert not there(spark, lost._gl_path)


def test_runs_of_two_threads_interleave(spark):
    turns, found, failed = [threading.Event() for _ in range(4)], {}, []

    def run(name, mine, theirs):
        try:
            with storage.scope(spark):
                frame = storage.spool(spark.range(10 if name == "a" else 20))
                mine[0].set()
                theirs[0].wait(60)
                if name == "b":
                    theirs[1].wait(60)  # the other scope is gone by now
                found[name] = frame.count()
        except Exception as e:  # noqa: BLE001
            failed.append(e)
        finally:
            mine[1].set()

    threads = [threading.Thread(target=run, args=("a", turns[:2], turns[2:])), threading.Thread(target=run, args=("b", turns[2:], turns[:2]))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not failed and found == {"a": 10, "b": 20}


def test_interleaved_without_threads(spark):
    first, second = storage.scope(spark), storage.scope(spark)
    first.__enter__()
    one = storage.spool(spark.range(7))
    second.__enter__()
    two = storage.spool(spark.range(8))
    second.__exit__(None, None, None)
    assert one.count() == 7 and not there(spark, two._gl_path)
    first.__exit__(None, None, None)
    assert not there(spark, one._gl_path)
