import os
import random

import pytest
from pyspark.sql import functions as F

from petrel.operators import decode
from petrel.sources import files, ranges


@pytest.fixture(scope="module")
def images(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = random.Random(3)
    for name, n in (("a.bin", 65536), ("b.bin", 300), ("c.bin", 70000), ("d.bin", 0)):
        (root / name).write_bytes(rng.randbytes(n))
    ranges.register(spark)
    return str(root)


def scan(spark, path):
    return spark.read.format("image_bytes").load(path)


def test_bytes_equal_the_whole_image_scan(spark, images, rows):
    whole = decode.dump_bytes(files.dumps(spark, images)).withColumn("dump_id", F.regexp_extract("dump_id", "([^/]+)$", 1))
    got = scan(spark, images).withColumn("dump_id", F.regexp_extract("dump_id", "([^/]+)$", 1))
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0 and got.count() == 65536 * 2 + 300


def test_filters_reach_the_scan(spark, images):
    df = scan(spark, images).where("addr >= 256 and addr < 384 and b > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "b#" in plan.split("Filter")[1] and "addr" not in plan.split("Filter")[1].split("\n")[0]  # the source has taken the bounds
    assert df.agg(F.min("addr") >= 256, F.max("addr") < 384).first()[:] == (True, True)
    raw = {n: open(os.path.join(images, n), "rb").read() for n in ("a.bin", "b.bin", "c.bin")}
    assert df.count() == sum(b > 3 for x in raw.values() for b in x[256:384])


def test_bytes_outside_the_range_are_not_read(images, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    r = ranges.ImageReader(images)
    left = list(r.pushFilters([GreaterThanOrEqual(("addr",), 0xC000), LessThan(("addr",), 0xC010), EqualTo(("b",), 7)]))
    assert left == [EqualTo(("b",), 7)]
    asked = []

    class Watched:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            asked.append((at, n))
            return self.f.read_at(n, at)

    class System:
        def open_input_file(self, path):
            return Watched(ranges.fs.LocalFileSystem().open_input_file(path))

    parts = r.partitions()
    assert [len(p.files) for p in parts] == [2]  # b.bin and d.bin have no such address: not opened
    monkeypatch.setattr(ranges, "_system", lambda path: (System(), path))
    batches = [b for p in parts for b in r.read(p)]
    assert asked == [(0xC000, 16)] * 2 and sum(len(b) for b in batches) == 32


def test_one_image_by_name(spark, images):
    name = os.path.join(images, "b.bin")
    assert scan(spark, images).where(F.col("dump_id") == name).count() == 300
    assert scan(spark, images).where((F.col("dump_id") == name) & (F.col("addr") > 1000)).count() == 0


def follow(spark, log, check, out):
    def keep(batch, batch_id):
        out.extend((batch_id, *r) for r in batch.orderBy("pos").collect())

    spark.readStream.format("log_tail").load(log).writeStream.foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def test_tail_goes_on_after_a_restart_and_replays_a_changed_prefix(spark, images, tmp_path, monkeypatch):
    log, check = str(tmp_path / "log.jsonl"), str(tmp_path / "check")

    def take():
        out = []
        follow(spark, log, check, out)
        return [(line, replay) for _, _, line, replay in out]

    with open(log, "w") as f:
        f.write("one\n\ntwo\nthr")
    assert take() == [("one", False), ("two", False)]  # the line that is being written waits
    with open(log, "a") as f:
        f.write("ee\nfour é\n")
    assert take() == [("three", False), ("four é", False)]
    assert take() == []
    with open(log, "w") as f:
        f.write("uno\ndos\ntres\ncuatro\ncinco\n")
    assert take() == [(x, True) for x in ("uno", "dos", "tres", "cuatro", "cinco")]
    with open(log, "w") as f:
        f.write("short\n")
    assert take() == [("short", True)]


def test_slices_share_out_lines(tmp_path, monkeypatch):
    rng = random.Random(6)
    lines = ["x" * rng.randrange(0, 40) for _ in range(300)]
    path = tmp_path / "log"
    path.write_text("\n".join(lines) + "\n")
    monkeypatch.setattr(ranges, "SLICE", 64)
    r = ranges.TailReader(str(path))
    parts = r.partitions(r.initialOffset(), r.latestOffset())
    assert len(parts) > 50 and [x[1] for p in parts for x in r.read(p)] == [x for x in lines if x]
