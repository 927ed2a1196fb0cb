"""Operators whose shuffles must not grow with pairs, and the results they keep."""

from sparrowmill.operators import recs, tables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attribute_pairs_come_once_without_a_distinct_over_pairs(spark):
    tx = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 12), (3, 99), (None, 12)], "u long, i long")
    items = spark.createDataFrame([(10, "a"), (11, "a"), (11, "b"), (12, "b"), (12, "b"), (13, "b"), (14, None)], "i long, a string")
    got = sorted(map(tuple, tables.through_attribute(tx, items, "u", "i", "a").collect()), key=str)
    assert got == sorted([(1, 10), (1, 11), (1, 12), (1, 13), (2, 11), (2, 12), (2, 13), (None, 11), (None, 12), (None, 13)], key=str)


def test_articles_of_a_name_travel_as_one_list(spark):
    tx = spark.createDataFrame([(1, 10), (1, 10), (1, 12), (2, 14), (3, 99)], "customer_id long, article_id long")
    articles = spark.createDataFrame([(10, "x"), (11, "x"), (11, "y"), (12, "y"), (10, "z"), (14, "w"), (15, None)], "article_id long, prod_name string")
    made = recs.same_product_name(tx, articles)
    assert {r[0]: r[1] for r in made.collect()} == {1: [10, 11, 12], 2: [14]}
    assert not any("Aggregate [customer_id" in line and "article_id#" in line.split("]")[0] for line in _plan(made).splitlines())


def test_negatives_are_offered_as_lists(spark):
    from sparrowmill.operators import graph

    edges = spark.createDataFrame([(u, i) for u in range(30) for i in range(u % 7, 90, 3)], "user_id long, item_id long")
    made = graph.sample_negatives(edges, 5)
    met = {tuple(r) for r in edges.collect()}
    got = [tuple(r) for r in made.collect()]
    assert len(set(got)) == len(got) == 150 and not met & set(got)
    assert "LeftAnti" not in _plan(made)


def test_prompts_are_completed_in_runs_of_bounded_bytes(spark):
    import pyarrow as pa

    from sparrowmill.operators import models

    texts = ["a" * 40, None, "é" * 30, "b" * 500, "", "c"]
    parts = list(models._slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), 0, 100))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert [p.num_rows for p in parts] == [3, 1, 2]


def test_words_become_slots_and_counts_once():
    import pyarrow as pa

    from sparrowmill.operators import embeddings

    slots, counts = embeddings._counted(pa.array(["a b a", "", "B"]), 1 << 16, {})
    (a, b), none, (other,) = slots.to_pylist()
    assert a != b == other and none == [] and counts.to_pylist() == [[2, 1], [], [1]]


def test_rows_shrink_once_for_each_step():
    import numpy as np

    from sparrowmill.operators import embeddings

    matrix = np.ones((3, 2))
    embeddings._shrink(matrix, np.array([0, 2, 2]), 0.5)
    assert matrix.tolist() == [[0.5, 0.5], [1, 1], [0.25, 0.25]]


def test_found_edges_are_not_shuffled_and_come_once(spark):
    import random

    from sparrowmill.operators import graph

    rng = random.Random(1)
    rows = [(rng.randrange(9), rng.randrange(6), rng.randrange(40)) for _ in range(150)]
    rows += rows[:30]  # copies and ties
    edges = spark.createDataFrame(rows, "user_id long, item_id long, time long")
    roots = spark.createDataFrame([(u, u, t) for u, t in ((0, 39), (3, 20), (5, 11))], "root long, user_id long, until long")
    made = graph.khop(edges, roots, ["root"], 3, 4, 3)
    latest = lambda by, x, until, k: sorted((e for e in rows if e[by] == x and e[2] <= until), key=lambda e: (e[2], e[1 - by]), reverse=True)[:k]
    want = set()
    for root, _, until in roots.collect():
        seen, front = {root}, [root]
        walked = latest(0, root, until, 4)
        want |= {(root, *e) for e in walked}
        for _ in range(2):
            users = [e for i in {e[1] for e in walked} for e in latest(1, i, until, 3)]
            front = sorted({e[0] for e in users} - seen, reverse=True)[:3]
            seen |= set(front)
            walked = [e for u in front for e in latest(0, u, until, 4)]
            want |= {(root, *e) for e in users + walked}
    assert sorted(map(tuple, made.collect())) == sorted(want)
    assert _plan(made).startswith("Union")


def test_offered_and_bought_has_each_pair_once_without_a_distinct_over_offers(spark):
    customers = spark.createDataFrame([(1,), (2,), (2,), (None,)], "customer_id long")
    top = spark.createDataFrame([(10,), (11,)], "article_id long")
    tx = spark.createDataFrame([(1, 10), (1, 12), (1, 12), (3, 10), (3, None), (None, 11), (None, 13)], "customer_id long, article_id long")
    made = recs.offered_and_bought(customers, top, tx)
    want = {(c, a) for c in (1, 2, None) for a in (10, 11)} | {tuple(r) for r in tx.collect()}
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    assert _plan(made).startswith("Union")


def test_candidates_meet_articles_before_customers_vectors(spark):
    candidates = spark.createDataFrame([(1, 10, "s"), (1, 11, "s"), (2, 10, "s")], "customer_id long, article_id long, strategy_name string")
    whose = spark.createDataFrame([(1, [1.0, 0.0])], "customer_id long, customer_vector array<double>")
    vectors = spark.createDataFrame([(10, [3.0, 4.0])], "article_id long, embedding array<double>")
    made = recs.cosine_feature(candidates, whose, vectors, "x")
    assert {tuple(r) for r in made.collect()} == {(1, 10, "s", 0.6), (1, 11, "s", 0.0), (2, 10, "s", 0.0)}
    plan = _plan(made)
    joins = [x for x in plan.splitlines() if "Join LeftOuter" in x]
    assert "customer_id" in joins[0] and "article_id" in joins[1]


def test_blocks_of_vectors_grow_with_their_number():
    assert [recs._blocks(n, 4096) for n in (0, 10, 4097, 65_536, 720_000, 2_000_000)] == [1, 1, 2, 16, 16, 31]


def test_models_rank_on_one_shuffle(spark):
    from pyspark.sql import functions as F

    data = spark.createDataFrame([(c, a, (a * 7 + c) % 5, (a * 3) % 4) for c in (1, 2) for a in range(9)], "customer_id long, article_id long, p long, q long")
    scorers = {n: (lambda df, n=n: df.withColumn("score", F.col(n))) for n in ("q", "p")}
    lists = {n: tables.top_lists(f(data), "customer_id", "article_id", "score", 4) for n, f in scorers.items()}
    made = recs.rank_models(data, scorers, 4, 3)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, recs.blend(lists, "customer_id", 3).collect()))
    final = made._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1


def test_small_groups_need_no_intervals(spark, monkeypatch):
    from sparrowmill.operators import quantiles

    kept = []
    inner = quantiles.io.stored
    monkeypatch.setattr(quantiles.io, "stored", lambda df, name: kept.append(name) or inner(df, name))
    df = spark.createDataFrame([(k, float(n)) for k in (1, 2, None) for n in range(1 + 10 * (k or 3))], "k long, x double")
    for most, names in ((100, ["ends"]), (15, None)):
        kept.clear()
        got = {r.k: r.m for r in quantiles.grouped_quantiles(df, ["k"], "x", [0.5], ["m"], most=most).collect()}
        assert got == {1: 5.0, 2: 10.0, None: 15.0}
        assert names is None or kept == names


def test_tasks_of_large_transactions_hold_bounded_rows(spark, monkeypatch):
    """Tasks grow with the tables, so that none sorts or groups more as they grow; small tables stay as they are."""
    from pyspark.sql import functions as F

    from sparrowmill import catalog
    from sparrowmill.sources import io
    from sparrowmill.sources.views import Views

    small = "/root/testdata/sf0.001"
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    names = ("set_union_distinct", "jn_inner_multi")
    before = {q: sorted(map(tuple, catalog.queries()[q](spark, small).collect())) for q in names}
    assert "Repartition" not in _plan(Views(spark, small).tx)
    monkeypatch.setattr(io, "TASK_ROWS", 200)
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert rows > 2000 and most(Views(spark, small).tx) < 600
    for q in names:
        made = catalog.queries()[q](spark, small)
        assert sorted(map(tuple, made.collect())) == before[q] and "Repartition" in _plan(made)
    assert most(made) < 600
