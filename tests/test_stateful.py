import random

import pytest
from pyspark.sql import functions as F

from petrel.operators import fold
from petrel.streaming import bucketed, incremental, stateful

LOG = "addr int, name string, log_pos long, confidence double"


@pytest.fixture(scope="module")
def state(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield stateful.with_state(spark)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", old)


def run(df, mode, path):
    """All batches that are there, each row with its batch."""
    out = []

    def keep(batch, i):
        out.extend((i, *r) for r in batch.collect())

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_compare_and_swap_state_equals_the_fold(state, tmp_path, rows, seed):
    """Any split of the log, over restarts, with ties and nulls."""
    rng = random.Random(seed)
    data = [(rng.randrange(4), "n", i, rng.choice((None, 0.0, 0.5, 0.7, 0.9))) for i in range(120)]
    cuts = sorted(rng.sample(range(1, 120), 3))
    view = {}
    for a, b in zip([0, *cuts], [*cuts, 120], strict=True):
        part = data[a:b]
        rng.shuffle(part)
        state.createDataFrame(part, LOG).write.mode("append").parquet(f"{tmp_path}/log")
        log = incremental.read_log(state, f"{tmp_path}/log", LOG)
        for _, *r in run(stateful.strongest_stream(log, "addr", "name"), "update", f"{tmp_path}/check"):
            view[r[0], r[1]] = tuple(r)
        want = fold.strongest_write(state.createDataFrame(data[:b], LOG), ["addr", "name"])
        assert sorted(view.values()) == rows(want)


def test_backlog_stream_equals_the_batch_step_by_step(state, tmp_path):
    rng = random.Random(5)
    res, done, seen = "store string, event_id string, ts string, payload string", "store string, events_compacted array<string>", {}
    all_res, all_done, covered = [], [], set()
    state.createDataFrame([], res).write.parquet(f"{tmp_path}/r")
    state.createDataFrame([], done).write.parquet(f"{tmp_path}/s")
    for step in range(4):
        fresh = [("p", f"e{step}_{i}", f"2026-01-{rng.randrange(10, 28)}", "x" * rng.randrange(2000, 9000)) for i in range(18)]
        all_res += fresh
        state.createDataFrame(fresh + fresh[:2], res).write.mode("append").parquet(f"{tmp_path}/r")
        if step:
            ids = [e for e in seen.get(step - 1, [])][:15] + [f"e{step + 1}_0"]  # one before its result comes
            covered |= set(ids)
            all_done.append(("p", ids))
            state.createDataFrame(all_done[-1:], done).write.mode("append").parquet(f"{tmp_path}/s")
        r, s = (state.readStream.schema(x).parquet(f"{tmp_path}/{n}") for x, n in ((res, "r"), (done, "s")))
        got = run(stateful.backlog_stream(r, s), "append", f"{tmp_path}/check")
        last = max((x[0] for x in got), default=None)
        got = [x[3] for x in sorted(x for x in got if x[0] == last)]
        want = fold.backlog_batch(state.createDataFrame(all_res, res), state.createDataFrame(all_done, done) if all_done else state.createDataFrame([], done))
        assert got == [x["event_id"] for x in want.collect()]
        seen[step] = got
    assert any(seen.values()) and len(max(seen.values(), key=len)) == 20


def test_appends_happen_once(state, tmp_path):
    schema = "run_id string, answer string"
    for k in range(3):  # the same rows again in every batch, over restarts
        state.createDataFrame([("r1", "a"), ("r2", "b"), (f"k{k}", "c")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        rows = state.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stateful.append_once_stream(rows, f"{tmp_path}/out", f"{tmp_path}/check", "run_id").awaitTermination()
    assert sorted(r["run_id"] for r in state.read.parquet(f"{tmp_path}/out").collect()) == ["k0", "k1", "k2", "r1", "r2"]


def test_bucketed_view_reads_no_more_than_the_view(spark, tmp_path, rows):
    schema = spark.createDataFrame([], LOG).schema
    view = bucketed.BucketedView(spark, f"{tmp_path}/view", ["addr", "name"], schema, buckets=4)
    data, sizes = [], []
    for k in range(20):
        fresh = [(i % 6, "n", 30 * k + i, ((i * 7 + k) % 10) / 10) for i in range(30)]
        data += fresh
        view.absorb(spark.createDataFrame(fresh, LOG), k)
        sizes.append(view._read(view.sources([0, 1, 2, 3])).count())
    assert sizes == [6] * 20  # what the next batch reads: the view's rows, after 600 rows of log
    assert all(len(view.versions(b)) <= bucketed.KEPT for b in range(4))
    want = rows(fold.strongest_write(spark.createDataFrame(data, LOG), ["addr", "name"]))
    assert rows(view.read()) == want
    view.absorb(spark.createDataFrame(data[-30:], LOG), 19)  # a batch that runs again
    assert rows(view.read()) == want


def test_bucketed_view_follows_a_stream(spark, tmp_path, rows):
    schema = spark.createDataFrame([], LOG).schema
    view = bucketed.BucketedView(spark, f"{tmp_path}/view", ["addr"], schema, buckets=2, merge=fold.last_write)
    data = [(i % 3, str(i), i, None) for i in range(12)]
    for k in range(2):
        spark.createDataFrame(data[6 * k : 6 * k + 6], LOG).write.mode("append").parquet(f"{tmp_path}/log")
        view.follow(incremental.read_log(spark, f"{tmp_path}/log", LOG), f"{tmp_path}/check").awaitTermination()
    assert rows(view.read()) == rows(fold.last_write(spark.createDataFrame(data, LOG), ["addr"]).select(*schema.names))
    assert view.read().where(F.col("addr") == 2).first()["name"] == "11"
