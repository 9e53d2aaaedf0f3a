import os
import threading

import pytest
from pyspark.sql import functions as F

from petrel.sources import frozen

SCHEMA = "name string, content binary"


@pytest.fixture(scope="module")
def session(spark):
    return frozen.register(spark)


def freeze(spark, rows, path, parts=3, **options):
    spark.createDataFrame([(n, bytearray(c)) for n, c in rows], SCHEMA).repartition(parts).write.format("frozen").mode("append").options(**options).save(path)


def there(path):
    return {n: open(os.path.join(path, n), "rb").read() for n in sorted(os.listdir(path))} if os.path.isdir(path) else {}


def test_names_keep_their_bytes(session, tmp_path):
    path = str(tmp_path / "f")
    first = {f"n{i}": bytes([i]) * 100 for i in range(7)}
    freeze(session, first.items(), path)
    freeze(session, [("n1", b"\1" * 100), ("n9", b"new")], path)  # the same bytes again are fine
    assert there(path) == first | {"n9": b"new"}
    with pytest.raises(Exception, match="frozen with other bytes: n2"):
        freeze(session, [("a", b"1"), ("n2", b"other"), ("z", b"2")], path)
    assert there(path) == first | {"n9": b"new"}  # nothing of the refused write is left


def test_a_failing_task_leaves_nothing(session, tmp_path):
    path = str(tmp_path / "f")
    df = session.range(40).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        df.write.format("frozen").mode("append").save(path)
    assert there(path) == {}
    with pytest.raises(Exception, match="no plain name"):
        freeze(session, [*((f"n{i}", b"x") for i in range(40)), ("..", b"y")], path, 4)
    assert there(path) == {}


@pytest.mark.parametrize(("rows", "options", "why"), [([("a/b", b"")], {}, "no plain name"), ([("_x", b"")], {}, "no plain name"), ([("a", b"12")], {"size": "3"}, "2 bytes, not 3"), ([("a", b"1"), ("a", b"2")], {}, "two contents|other bytes")])
def test_bad_rows_are_refused(session, tmp_path, rows, options, why):
    path = str(tmp_path / "f")
    with pytest.raises(Exception, match=why):
        freeze(session, rows, path, 1, **options)
    assert there(path) == {}


def test_overwrite_is_refused(session, tmp_path):
    with pytest.raises(Exception, match="never overwritten"):
        session.createDataFrame([("a", bytearray(b"1"))], SCHEMA).write.format("frozen").mode("overwrite").save(str(tmp_path / "f"))


def test_of_concurrent_writers_one_wins(tmp_path):
    """Writers without Spark between them: eight publish the same name with bytes of their own at once."""
    path, failed = str(tmp_path), []
    writers = [frozen.FrozenWriter(path, None) for _ in range(8)]
    messages = [w.write(iter([{"name": "same", "content": b"%d" % i}, {"name": f"own{i}", "content": b"x"}])) for i, w in enumerate(writers)]
    gate = threading.Barrier(8)

    def publish(i):
        gate.wait()
        try:
            writers[i].commit([messages[i]])
        except frozen.Refused:
            failed.append(i)

    threads = [threading.Thread(target=publish, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (won,) = set(range(8)) - set(failed)
    assert there(path) == {"same": b"%d" % won, f"own{won}": b"x"}
