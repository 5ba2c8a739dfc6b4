import hashlib
import random

from quillstone.functions import hashing
from quillstone.plans import records
from quillstone.streaming import events as st
from tests.conftest import rows


def write(spark, path, data):
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def event(i, minute, user=1, kind="view", value=1.0):
    import datetime as dt

    return i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), user, kind, value


def test_a_second_run_goes_on_from_the_first(spark, tmp_path):
    path, folder = str(tmp_path / "log.parquet"), str(tmp_path / "run")
    write(spark, path, [event(1, 0), event(2, 1)])
    assert st.drain(st.log(spark, path).select("event_id"), folder).count() == 2
    write(spark, path, [event(3, 2)])
    assert rows(st.drain(st.log(spark, path).select("event_id"), folder)) == [(1,), (2,), (3,)]


def test_late_rows_are_dropped(spark, tmp_path):
    path, folder = str(tmp_path / "log.parquet"), str(tmp_path / "run")
    write(spark, path, [event(1, 0), event(2, 500)])
    stream = lambda: st.tumbling(st.log(spark, path, files=1), [], "ts", "value", "1 hour", "10 minutes")
    assert st.drain(stream(), folder).count() == 1
    write(spark, path, [event(3, 5), event(4, 900)])
    got = st.drain(stream(), folder).orderBy("start").collect()
    assert [r.events for r in got] == [1, 1]


def test_state_machine_and_its_batch_twin(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    kinds = ["signup", "view", "error", "purchase", "click", "purchase", "nothing"]
    data = [event(i, i, i % 2, k) for i, k in enumerate(kinds * 3)]
    write(spark, path, data)
    streamed = st.latest_state(st.drain(st.state_machine(st.log(spark, path), "user_id", "event_type", "event_id")), "user_id")
    batch = st.replayed(spark.read.parquet(path), "user_id", "event_type", "event_id")
    plain = [(u, *st.fold("NEW", [d[3] for d in data if d[2] == u])) for u in (0, 1)]
    assert rows(streamed) == rows(batch) == plain


def test_a_large_user_is_spread_over_tasks(spark):
    draw = random.Random(3)
    kinds = ["signup", "view", "error", "purchase", "click", "nothing", None]
    data = [(1 if i % 10 else draw.choice([None, 2, 3]), i, draw.choice(kinds)) for i in range(5000)]
    batch = st.replayed(spark.createDataFrame(data, "user_id long, event_id long, event_type string").repartition(5), "user_id", "event_type", "event_id")
    assert rows(batch) == sorted(((u, *st.fold("NEW", [k for w, _, k in data if w == u])) for u in (None, 1, 2, 3)), key=repr)
    text = batch._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(event_id" not in text and "RepartitionByExpression [user_id" in text


def test_texts_are_hashed_as_they_pass(spark):
    data = [(k, r, f"é{r}\n" * (r % 3)) for k in ("a", None, "b") for r in range(300)]
    got = hashing.joined_hash(spark.createDataFrame(data, "k string, r int, t string").repartition(3), "k", ["r"], "t")
    want = [(k, hashlib.sha256("\n".join(t for w, _, t in data if w == k).encode()).hexdigest(), 300) for k in ("a", None, "b")]
    assert rows(got) == sorted(want, key=repr)
    assert "collect_list" not in records.evidence_prompts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_replays_have_no_effect(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    write(spark, path, [event(1, 0), event(1, 1), event(2, 2)])
    assert rows(st.drain(st.once(st.log(spark, path), ["event_id"], "ts", "1 day").select("event_id"))) == [(1,), (2,)]


def test_pages(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    write(spark, path, [event(i, i) for i in range(5)])
    assert [r.event_id for r in st.after_cursor(spark.read.parquet(path), 1, limit=2).collect()] == [2, 3]
    assert st.after_cursor(spark.read.parquet(path), 9).count() == 0
