"""The collection store under several writers, what its writes touch, and the streams' timers and windows."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodex.deploy import ship
from lodex.functions.encode import hashed_embedding
from lodex.operators import fuzzy, retrieve
from lodex.sources import store as S
from lodex.sources.store import Conflict, Store
from lodex.streaming import feedback as streams


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


def points(spark, ids, v="a"):
    return spark.createDataFrame([(i, f"{v}{i}") for i in ids], "id long, text string")


def rows(df):
    return sorted((r.id, r.text) for r in df.collect())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_two_writers_of_one_state(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.recreate("c", points(spark, range(4)))
    number, _ = store.state("c")
    store.upsert("c", points(spark, [1], "first"), base=number)
    with pytest.raises(Conflict):
        store.upsert("c", points(spark, [2], "second"), base=number)
    with pytest.raises(Conflict):
        store.recreate("c", points(spark, [9]), base=number)
    assert rows(store.read("c")) == [(0, "a0"), (1, "first1"), (2, "a2"), (3, "a3")]
    # an upsert that was made from no state goes on top of whatever is there
    store.upsert("c", points(spark, [2], "second"))
    assert (2, "second2") in rows(store.read("c")) and (1, "first1") in rows(store.read("c"))


def test_a_writer_that_loses_the_race_goes_on_top(spark, tmp_path, monkeypatch):
    store, other = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    store.recreate("c", points(spark, range(3)))
    commit, raced = Store._commit, []

    def late(self, name, number, manifest):
        if self is store and not raced:
            raced.append(1)
            other.upsert("c", points(spark, [0], "other"))  # commits the number that this one is about to
        commit(self, name, number, manifest)

    monkeypatch.setattr(Store, "_commit", late)
    store.upsert("c", points(spark, [1], "mine"))
    assert rows(store.read("c")) == [(0, "other0"), (1, "mine1"), (2, "a2")]


def test_an_upsert_of_ten_rows_writes_ten_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.recreate("c", points(spark, range(5000)))
    before = files(tmp_path)
    assert store.upsert("c", points(spark, [*range(5), *range(9000, 9005)], "new")) == 5005
    new = files(tmp_path) - before
    assert before <= files(tmp_path) and spark.read.parquet(*[f"file://{f}" for f in new]).count() == 10
    got = dict(rows(store.read("c")))
    assert got[3] == "new3" and got[9004] == "new9004" and got[7] == "a7"


def test_deletes_compaction_and_new_columns(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.recreate("c", points(spark, range(200)))
    store.upsert("c", points(spark, [3, 4], "b").withColumn("lang", F.lit("de")))
    assert store.delete("c", spark.createDataFrame([(4,), (5,)], "id long")) == 198
    store.upsert("c", points(spark, [5], "back"))
    want = {i: f"a{i}" for i in range(200) if i != 4} | {3: "b3", 5: "back5"}
    assert dict(rows(store.read("c"))) == want
    _, manifest = store.state("c")
    base = {b: f for f, buckets in manifest["base"] for b in buckets}
    touched = store.compact("c")
    _, after = store.state("c")
    later = {b: f for f, buckets in after["base"] for b in buckets}
    assert 0 < len(touched) <= 3 and not after["deltas"] and all((later[b] != base[b]) == (b in touched) for b in base)
    got = store.read("c").collect()
    assert {r.id: r.text for r in got} == want and [r.lang for r in got if r.id == 3] == ["de"] and sum(r.lang is not None for r in got) == 1
    assert store.compact("c") == []
    for k in range(2 * store.MOST_DELTAS):
        store.upsert("c", points(spark, [k], "z"))
    assert len(store.state("c")[1]["deltas"]) < store.MOST_DELTAS and store.read("c").count() == 200  # 4 is back
    assert len(store._pointers("c")) == 2


def test_rows_of_one_upsert_and_other_keys(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    twice = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "id long, text string, ord int")
    assert store.upsert("c", twice) == 1 and store.read("c").first().text == "new"
    with pytest.raises(ValueError):
        store.upsert("c", points(spark, [1]), "text")
    counts = spark.createDataFrame([("q", None, 1)], "query string, url string, n int")
    store.recreate("k", counts.limit(0), key=["query", "url"])
    assert store.upsert("k", spark.createDataFrame([("q", "u", 1), ("q", "w", 1)], counts.schema), ["query", "url"]) == 2
    assert store.upsert("k", spark.createDataFrame([("q", "u", 5)], counts.schema), ["query", "url"]) == 2
    assert {(r.url, r.n) for r in store.read("k").collect()} == {("u", 5), ("w", 1)}


def test_records_without_a_vector_get_one(spark):
    embed = hashed_embedding(8)
    df = spark.createDataFrame([("t", "x y", "u1", [1.0] * 8), ("t", "x z", "u2", None), (None, None, "u3", [])], "title string, content string, url string, embedding array<float>")
    got = {r.url: r for r in S.coalesced(df, "s", embed).collect()}
    assert list(got["u1"].embedding) == [1.0] * 8
    assert got["u2"].embedding == pytest.approx(list(embed(["t x z"])[0])) and got["u3"].embedding == pytest.approx(list(embed(["Unbenannt "])[0]))
    assert "embedding" in S.coalesced(df.drop("embedding"), "s", embed).columns and "embedding" not in S.coalesced(df.drop("embedding"), "s").columns


# --- streams

START = datetime(2024, 1, 1, 12)


def batches(spark, path, *parts):
    """A stream whose files come one a batch."""
    for k, part in enumerate(parts):
        made = spark.createDataFrame([(e, START + timedelta(seconds=s), u) for e, s, u in part], "event_id long, ts timestamp, user_id long").coalesce(1)
        made.write.mode("overwrite").parquet(f"{path}/in{k}")
        os.makedirs(f"{path}/all", exist_ok=True)
        name = next(f for f in os.listdir(f"{path}/in{k}") if f.endswith(".parquet"))
        os.rename(f"{path}/in{k}/{name}", f"{path}/all/{k}.parquet")
        os.utime(f"{path}/all/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{path}/all")


def test_long_clicks_idle_users_end_and_late_events_go(spark, tmp_path):
    far = (99, 100_000, 9)  # moves the watermark on
    stream = batches(
        spark, str(tmp_path),
        [(2, 50, 1), (1, 0, 1), (3, 55, 1), (10, 0, 2)],  # user 1 out of order
        [(4, 4000, 1), (11, 2100, 2)],  # user 2 comes back after a pause: anew
        [far],
        [(98, 100_010, 9)],
        [(5, 4100, 1)],  # behind the watermark of the batch before: dropped
        [(97, 300_000, 9)],
    )
    got = {r.event_id: r.kind for r in streams.run_to_files(streams.long_clicks(stream, 20, "10 minutes", 1800)).collect()}
    assert got == {1: "long_click", 2: "short_click", 3: "short_click", 4: "short_click", 10: "short_click", 11: "short_click", 99: "short_click", 98: "short_click"}


def test_long_clicks_keep_no_state_of_idle_users(spark, tmp_path):
    stream = batches(spark, str(tmp_path), [(k, k, k) for k in range(20)], [(99, 100_000, 99)], [(100, 200_000, 99)])
    path = f"{tmp_path}/out"
    query = streams.to_files(streams.long_clicks(stream, 20, "10 minutes", 1800), path, f"{tmp_path}/cp")
    query.awaitTermination()
    assert spark.read.parquet(path).count() == 21
    state = spark.read.format("statestore").option("stateVarName", "user").load(f"{tmp_path}/cp")
    assert {r.key.user_id for r in state.collect()} == {99}


def test_sessions_count_repeats_once(spark, tmp_path):
    stream = batches(spark, str(tmp_path), [(1, 0, 1), (2, 60, 1), (2, 60, 1), (3, 10_000, 1)], [(1, 0, 1), (4, 90, 1)], [(9, 100_000, 9)], [(10, 110_000, 9)])
    got = sorted((r.user_id, r.n) for r in streams.run_to_files(streams.sessions(stream, "30 minutes", "4 hours")).collect())
    assert got == [(1, 1), (1, 3)]


def test_counters_of_a_stream_touch_their_own_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")

    def run(batch, rows):
        df = spark.createDataFrame(rows, "query string, url string, type string")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        streams.count_clicks(stream, store, "clicks", f"{tmp_path}/cp").awaitTermination()

    run(0, [("a", f"u{i}", "short_click") for i in range(50)])
    before = files(f"{tmp_path}/s")
    run(1, [("A ", "u1", "long_click"), ("new", "u", "short_click")])
    new = files(f"{tmp_path}/s") - before
    assert spark.read.parquet(*[f"file://{f}" for f in new]).count() == 2
    got = {(r.query, r.url): (r.short_clicks, r.long_clicks) for r in store.read("clicks").collect()}
    assert len(got) == 51 and got["a", "u1"] == (1, 1) and got["new", "u"] == (1, 0)
    assert store.state("clicks")[1]["meta"]["epoch"] == 1


# --- plans


def test_near_words_need_no_comparison_of_all(spark):
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 6))) for _ in range(150)})
    a = spark.createDataFrame([(w,) for w in words], "a string")
    b = a.withColumnRenamed("a", "b")
    near = fuzzy.near_words(a, b)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = a.crossJoin(b).withColumn("distance", F.levenshtein("a", "b")).where("distance <= 2")
    assert sorted(near.collect()) == sorted(want.collect())


def test_siblings_take_eleven_of_a_group(spark):
    lectures = spark.createDataFrame([(i, "p", "d", f"t{i:03}") for i in range(300)] + [(900, "q", "d", "x")], "id long, program string, day string, text string")
    first = lectures.select(F.lit(0).alias("query_id"), "id", "program", "day")
    out = retrieve.siblings(first, lectures)
    got = {r.id: r.context.split("; ") for r in out.collect()}
    assert got[0] == [f"t{i:03}" for i in range(1, 11)] and got[5] == [f"t{i:03}" for i in range(11) if i != 5] and got[200] == [f"t{i:03}" for i in range(10)] and 900 not in got
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_a_task_writes_one_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "BUCKET_BYTES", 512)
    kept = Store(spark, f"file://{tmp_path}/s")
    spark.range(2000).select("id", F.concat(F.lit("t"), "id").alias("text")).write.parquet(f"{tmp_path}/rows")
    kept.recreate("old", spark.read.parquet(f"{tmp_path}/rows"))
    manifest = kept.state("old")[1]
    buckets = manifest["base"][0][1]
    tasks = {b: {f.split("-")[1] for f in os.listdir(f"{tmp_path}/s/old/{manifest['base'][0][0]}/_bucket={b}") if f.startswith("part-")} for b in buckets}
    assert len(buckets) > 20 and all(len(t) == 1 for t in tasks.values()) and len(set.union(*tasks.values())) == len(buckets)
    # a migrated collection is dealt as finely as the old one
    assert kept.migrate("old", "new") == 2000
    assert kept.state("new")[1]["buckets"] >= 2 * manifest["buckets"]
