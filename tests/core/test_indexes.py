"""The stored vector and term indexes: their answers against the ranking of all rows, and what they read."""

import ast
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodex.deploy import ship
from lodex.operators import retrieve
from lodex.operators.retrieve import TermIndex
from lodex.operators.vectors import VectorIndex
from lodex.sources.store import Store


def vectors(spark, rows, name="id", vec="vec"):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, {vec} array<double>")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 16))
    rows = [(i, centres[i % 25] + 0.05 * rng.normal(size=16)) for i in range(2000)]
    rows += [(3000 + i, rows[0][1]) for i in range(40)] + [(4000, None), (4001, np.zeros(16))]  # equal rows, and rows without a cosine
    return vectors(spark, rows).cache()


def test_cells_give_what_all_rows_give(spark, clustered):
    index = VectorIndex.build(clustered, cells=40)
    queries = clustered.where("id % 50 = 0 and vec is not null").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    want = sorted(retrieve.dense_top(clustered, queries, 12).collect())
    assert sorted(index.top(queries, 12).collect()) == want and len(want) > 400
    # more rows wanted than there are, and a query that nothing is like
    odd = vectors(spark, [(1, np.ones(16)), (2, -np.ones(16)), (3, np.zeros(16))], "query_id", "qvec")
    assert sorted(index.top(odd, 5000).collect()) == sorted(retrieve.dense_top(clustered, odd, 5000).collect())


def test_few_cells_are_read(spark, clustered):
    index = VectorIndex.build(clustered, cells=40)
    queries = clustered.where("id % 50 = 0 and vec is not null").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    pairs, cells = queries.count(), index.cells.count()
    first, rest = index.plan(queries, 12)
    begun = index.bounds(queries)
    assert index.cells.agg(F.sum("n")).first()[0] == 2040
    assert rest.count() / (pairs * cells) < 0.4 and begun.count() >= pairs * cells - cells
    plan = index.scored(rest.where("query_id = 0"), 9)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dynamicpruning" in plan


def test_vector_index_of_nothing_and_of_one_row(spark):
    none = VectorIndex.build(vectors(spark, []))
    ask = vectors(spark, [(0, [1.0, 2.0])], "query_id", "qvec")
    assert none.top(ask, 5).count() == 0
    one = VectorIndex.build(vectors(spark, [(7, [2.0, 4.0]), (8, [0.0, 0.0])]))
    assert [(r.id, r.score, r["rank"]) for r in one.top(ask, 5).collect()] == [(7, 1.0, 1)]


def test_a_store_keeps_its_vector_index_with_the_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    points = spark.createDataFrame([(i, f"t{i}", [float(i % 5), 1.0]) for i in range(60)], "id long, text string, embedding array<float>")
    store.recreate("c", points)
    assert store.vectors("c") is None
    built = store.vectors("c", build=True)
    assert store.vectors("c").path == built.path
    ask = vectors(spark, [(0, [1.0, 2.0])], "query_id", "qvec")
    assert built.top(ask, 3).collect() == retrieve.dense_top(points.select("id", F.col("embedding").alias("vec")), ask, 3).collect()
    store.recreate("c", points)
    assert store.vectors("c") is None  # another version has none yet


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(5, 40)))) for i in range(4000)]
    rows[17] = (17, "rare1 rare2 w0 w1")
    return spark.createDataFrame(rows + [(9000, None), (9001, "")], "id long, text string").cache()


def test_blocks_give_what_all_postings_give_and_fewer_are_read(spark, texts):
    index = TermIndex.build(texts)
    asked = spark.createDataFrame([(1, "rare1 w0"), (2, "w0 w1"), (3, "w250 w300 w0"), (4, ""), (5, "never"), (6, "w399")], "query_id long, text string")
    wanted = index.wanted(asked)
    for k in (1, 5, 20):
        want = sorted(index.top_of_all(wanted, k).collect())
        assert sorted(index.top(asked, k).collect()) == sorted(index.top_pruned(wanted, k).collect()) == want
    blocks, terms = index._held(wanted)
    _, rest = index.read_plan(blocks, terms, 5, 9)
    left = {r.query_id: r.n for r in rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    live = {r.query_id: r.n for r in blocks.join(terms, "term").groupBy("query_id").agg(F.countDistinct("block").alias("n")).collect()}
    assert live[1] > 25 and index.FIRST + left.get(1, 0) < 0.25 * live[1]
    assert sum(left.values()) + index.FIRST * len(live) < sum(live.values())


def test_blocks_of_copies_keep_their_places_in_any_order_of_rows(spark, monkeypatch):
    """The read plan is worked out twice; rows may come in another order, as after a shuffle."""
    monkeypatch.setattr(TermIndex, "BLOCK", 1)
    words = [f"w{i}" for i in range(9)]
    rows = [(i, " ".join(words)) for i in range(60)] + [(100 + i, " ".join([*words[: i % 8 + 1], *(f"x{j}" for j in range(40))])) for i in range(40)]
    index = TermIndex.build(spark.createDataFrame(rows, "id long, text string"))
    blocks, terms = index._held(spark.createDataFrame([(1, w) for w in words], "query_id long, term string"))
    left, held = [], blocks.collect()
    for seed in range(4):
        mixed = spark.createDataFrame(random.Random(seed).sample(held, len(held)), blocks.schema).coalesce(1)
        left.append(sorted(index.read_plan(mixed, F.broadcast(terms), 5, 4)[1].collect()))
    assert left[0] and all(x == left[0] for x in left)


def test_a_common_term_lies_in_many_rows(spark, texts):
    index = TermIndex.build(texts)
    got = index.blocks.where("term = 'w0'").select(F.size("postings").alias("n")).collect()
    assert len(got) > 20 and max(r.n for r in got) < 3 * index.BLOCK
    assert "PushedFilters: [In(term" in index._held(spark.createDataFrame([(1, "w0"), (1, "w1")], "query_id long, term string"))[0]._jdf.queryExecution().toString()


def test_nothing_here_reads_the_training_data_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder in ("functions", "operators", "sources", "streaming", "plans"):
        for name in os.listdir(f"{root}/lodex/{folder}"):
            if name.endswith(".py"):
                with open(f"{root}/lodex/{folder}/{name}") as f:
                    for node in ast.walk(ast.parse(f.read())):
                        names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                        assert not any("llm" in n.split(".") for n in names), (folder, name)


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


def test_many_long_queries_meet_all_documents_in_parts(spark, texts, monkeypatch):
    from lodex.operators import meet

    monkeypatch.setattr(meet, "PART_ENTRIES", 5_000)
    index = TermIndex.build(texts, blocks=False)
    every = texts.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", "text", F.lit("never seen")).alias("text"))
    assert index.entries > 6 * 5_000
    got = index.top(every, 7, 4)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    whole = TermIndex.build(texts)
    assert sorted(got.collect()) == sorted(whole.top_of_all(whole.wanted(every), 7, 4).collect())
    assert index.top(every.limit(0), 7).count() == 0
    # copies beyond k: the smallest ids
    same = spark.createDataFrame([(i, "alpha beta") for i in range(300)], "id long, text string")
    hits = TermIndex.build(same, blocks=False).top(spark.createDataFrame([(1, "alpha")], "query_id long, text string"), 5).collect()
    assert sorted(r.id for r in hits) == [0, 1, 2, 3, 4] and len({r.score for r in hits}) == 1


def test_dense_parts_give_what_single_scores_give(spark, monkeypatch):
    from lodex.operators import meet

    monkeypatch.setattr(meet, "PART_ROWS", 60)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8)) for i in range(400)] + [(500 + i, rng.normal(size=3)) for i in range(9)]
    rows += [(600, None), (601, np.zeros(8)), (602, [float("nan")] * 8), *[(700 + i, rows[3][1]) for i in range(30)]]
    points = vectors(spark, rows).withColumn("kind", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")))
    queries = points.where("id % 50 < 4").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    show = lambda df: sorted(map(str, df.collect()))
    scores = retrieve.dense_scores(points, queries, keep=("kind",))
    assert show(retrieve.dense_top(points, queries, 6)) == show(retrieve.ranked(scores, ["query_id"], "score", "id", 6).select("query_id", "id", "score", "rank"))
    near = retrieve.ranked(retrieve.dense_near(points, queries, 6, group="kind", keep=("kind",)), ["query_id", "kind"], "score", "id", 6)
    assert show(near.select("query_id", "id", "kind", "score")) == show(retrieve.ranked(scores, ["query_id", "kind"], "score", "id", 6).select("query_id", "id", "kind", "score"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_a_part_has_rows_of_one_group(spark, monkeypatch):
    """Then k rows of a query leave a part, not k for each group; the best rows are those of all scores."""
    from lodex.operators import meet

    assert meet.shared_out([600, 150, 150, 100], 12) == [7, 2, 2, 1] and meet.shared_out([5, 0], 1) == [1, 1]
    monkeypatch.setattr(meet, "PART_ROWS", 100)
    assert meet.shared_out([601, 1], 4) == [7, 1]
    rng = np.random.default_rng(9)
    points = vectors(spark, [(i, rng.normal(size=8)) for i in range(1200)]).withColumn("kind", F.when(F.col("id") % 6 > 0, F.least(F.col("id") % 6, F.lit(3)).cast("string")))
    queries = points.where("id % 60 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    near = retrieve.dense_near(points, queries, 5, group="kind", keep=("kind",)).cache()
    assert near.count() <= 20 * 5 * 16 and near.select("query_id", "kind").distinct().count() == 20 * 4
    best = retrieve.ranked(near, ["query_id", "kind"], "score", "id", 5)
    want = retrieve.ranked(retrieve.dense_scores(points, queries, keep=("kind",)), ["query_id", "kind"], "score", "id", 5)
    show = lambda df: sorted(map(str, df.select("query_id", "kind", "id", "score", "rank").collect()))
    assert show(best) == show(want)
    # groups too many for parts of their own
    monkeypatch.setattr(retrieve, "FEW_GROUPS", 3)
    assert show(retrieve.ranked(retrieve.dense_near(points, queries, 5, group="kind", keep=("kind",)), ["query_id", "kind"], "score", "id", 5)) == show(want)


def test_the_merge_of_two_lists_moves_starts_of_texts_only(spark):
    from lodex.plans.search_queries import r8

    plan = r8(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Project \[doc_id#\d+L? AS id#\d+L?, substring\(text#\d+, 1, 80\) AS text", plan)


def test_single_precision_leaves_what_doubles_find(spark):
    """Random rows, near and equal copies, groups: the best k are those of all scores in double precision, and few are scored."""
    import pyarrow as pa

    from lodex.operators import meet

    rng = np.random.default_rng(8)
    rows = rng.normal(size=(9000, 24))
    rows[2000:3000], rows[5000:5300] = rows[7], rows[8] + 1e-9 * rng.normal(size=(300, 24))
    table = lambda v: pa.table({"id": np.arange(len(v)), "vec": pa.array(list(v), pa.list_(pa.float64())), "norm": np.sqrt((v * v).sum(1)), "g": np.sort(np.arange(len(v)) % 3)})
    asked = table(rows[::300]).to_batches()[0]
    made = meet.Vectors(table(rows))
    assert made.unit is not None and made.unit.dtype == np.float32
    none = np.full(asked.num_rows, np.nan)
    for group in (None, "g"):
        edges = meet._edges(table(rows), group)
        want = meet._best_of(made.scores(asked), edges, 7, 9, none)
        got = made.best(asked, edges, 7, 9, none)
        assert set(zip(*map(np.ndarray.tolist, got[:2]))) == set(zip(*map(np.ndarray.tolist, want[:2]))) and len(got[0]) == len(want[0]) > 200
    who, at = meet._reaching(np.array([[1.0, 3.0] * 40, [5.0, 0.0] * 40]), np.array([3.0, 6.0]))
    assert sorted(at) == list(range(1, 80, 2)) and set(who) == {0}
    # vectors of no common length or of other dimensions are scored in double, as before
    assert meet.Vectors(table(np.vstack([rows[:5], np.zeros(24)]))).unit is None


def test_terms_are_counted_where_texts_are_read(spark):
    """Counts equal those by groups, also for an id of several rows, and only repeated ids move texts."""
    texts = [(1, "Bär bär die x1 x1 \ufb01x"), (2, None), (3, "der und"), (4, "caf\u0065\u0301 \u00dc12 a"), (5, " ".join(f"w{i % 90}" for i in range(4000)))]
    for rows in (texts, [*texts, (1, "bär neu")]):
        docs = spark.createDataFrame(rows, "id long, text string")
        got = retrieve.counted(docs)
        want = retrieve.postings(docs)
        assert sorted(got.select("id", F.inline("postings")).collect()) == sorted(want.collect())
        assert {r.id: r.dl for r in got.collect()} == {r.id: r.dl for r in want.groupBy("id").agg(F.sum("tf").alias("dl")).collect()}
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (len(rows) > len(texts))


def test_hashed_terms_move_no_rows(spark):
    from lodex.functions.text import md5_bucket
    from lodex.sources.store import hashed_terms

    docs = spark.createDataFrame([(1, "Die Maus und die Maus ab12"), (2, None), (3, " ".join(f"t{i}" for i in range(9000)))], "id long, text string")
    got = hashed_terms(docs)
    want = docs.select("id", F.explode(F.split(F.lower("text"), " ")).alias("term")).groupBy("id", md5_bucket(F.col("term")).alias("index")).agg(F.count(F.lit(1)).alias("value"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.dtypes == want.dtypes
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_pieces_leave_a_task_by_slices():
    import pandas as pd

    from lodex.functions.splitters import SLICE, by_slices

    parts = list(by_slices(iter([pd.Series(["ab"] * 200), pd.Series([], dtype=object)]), lambda s: s.map(len)))
    assert max(map(len, parts)) == SLICE and sum(map(len, parts)) == 200 and len(parts) == 5


def test_terms_meet_by_clusters(spark, monkeypatch):
    """Texts of two vocabularies lie apart, and products hold the terms of one of them; the best rows, ties among copies
    too, are those of sums over all pairs. Parts come in whole waves of tasks."""
    import pyarrow as pa

    from lodex.operators import meet

    rng = np.random.default_rng(12)
    texts = [sorted({int(w) for w in 1000 * (i % 2) + 400 * rng.random(60) ** 2} | {5000 + i % 7}) for i in range(900)] + [[], [9999]]
    texts[300:340] = [texts[8]] * 40
    counts = [[float(1 + (i * t) % 3) for t in own] for i, own in enumerate(texts)]
    counts[300:340] = [counts[8]] * 40
    lists = lambda rows, kind: pa.array(rows, pa.list_(kind))
    table = pa.table({"id": np.arange(902), "terms": lists(texts, pa.int64()), "counts": lists(counts, pa.float64())})
    made, asked = meet.Terms(table, 1.2, 0.75, 50.0), [texts[8], texts[9], [], [77777], texts[41] + [2], texts[10]]
    own = pa.table({"query_id": np.arange(6), "terms": lists(asked, pa.int64()), "counts": lists([[1.0 + t % 5 for t in q] for q in asked], pa.float64())}).to_batches()[0]
    want = np.zeros((6, 902))
    for d, (ts, cs) in enumerate(zip(texts, counts)):
        weight = {t: c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sum(cs) / 50.0)) for t, c in zip(ts, cs)}
        want[:, d] = [sum(weight.get(t, 0.0) * (1.0 + t % 5) for t in q) for q in asked]
    assert np.allclose(made.scores(own), np.where(want > 0, want, -np.inf))
    cells = sum(m.size for m in made.matrices)
    assert len(made.edges) > 1 and 0 < cells < 0.7 * 902 * len({t for t, place in zip(made.terms, made.place.max(axis=1)) if place >= 0})
    for edges in ([(0, 902)], [(0, 305), (305, 902)]):
        who, where, values = made.best(own, edges, 25, 4, np.full(6, np.nan))
        best = {(q, int(d)) for q in range(6) for a, b in edges for d in [a + i for i in np.lexsort((np.arange(b - a), -np.round(want[q, a:b], 4)))[:25]] if want[q, d] > 0}
        assert set(zip(who.tolist(), where.tolist())) == best and len(who) == len(best)
        assert np.allclose(values, want[who, where])
    for tf in (np.array([2.5, 1.0, 3.0]), np.array([2.0, 1e18, 3.0]), np.array([2.0, 1.0, 3.0])):
        got = meet._by_term(np.array([1, 0, 1]), np.array([5, 8, 2]), tf, 2, 9)
        assert [x.tolist() for x in got] == [[0, 1, 1], [8, 2, 5], [tf[1], tf[2], tf[0]]]
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(meet, "PART_ROWS", 100)
    assert [meet.parts_for(spark.range(1), n) for n in (1, 100 * cores, 100 * cores + 1)] == [1, cores, 2 * cores]


def test_many_short_queries_shuffle_no_postings_of_pairs(spark, texts):
    """A plan by stored blocks moves the postings of every (query, block) pair; here only a part's best rows are moved."""
    index = TermIndex.build(texts)
    asked = spark.createDataFrame([(i, f"w{i % 50} w{i * 7 % 400} w0") for i in range(300)], "query_id long, text string")
    found = index.top_pruned(index.wanted(asked), 5)
    assert "inline(postings" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == sorted(index.top_of_all(index.wanted(asked), 5).collect())


def test_blocks_of_a_part_are_left_out_and_nothing_is_lost(monkeypatch):
    import pyarrow as pa

    from lodex.operators import meet

    rng = random.Random(3)
    docs = [sorted(set(rng.choices(range(300), [1 / (i + 1) for i in range(300)], k=rng.randint(3, 40)))) for _ in range(3000)]
    table = pa.table({"terms": pa.array(docs), "counts": pa.array([[float(rng.randint(1, 6)) for _ in d] for d in docs])})
    asked = [[0, 250], [1, 2, 3], [299], [5, 7, 100, 280], [9999]]
    queries = pa.record_batch({"terms": pa.array(asked), "counts": pa.array([[1.0 + t % 9 for t in q] for q in asked])})
    read, scored = [], meet.Blocks._scored
    monkeypatch.setattr(meet.Blocks, "_scored", lambda self, pairs, idf, blocks: read.append(len(blocks)) or scored(self, pairs, idf, blocks))
    least = np.full(len(asked), np.nan)
    for k in (1, 5, 5000):
        got, want = ((made := kind(table, 1.2, 0.75, 20.0)).best(queries, [(0, made.n)], k, 9, least) for kind in (meet.Blocks, meet.Terms))
        got, want = (sorted(zip(x[0].tolist(), x[1].tolist(), np.round(x[2], 9).tolist())) for x in (got, want))
        assert got == want and len(got)
        if k == 1:
            assert sum(read) < 0.7 * 4 * -(-3000 // meet.BLOCK)
