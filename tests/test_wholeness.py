"""Queries that do their whole job, and steps whose disk must not grow with the rows of their result."""

import random

import pyarrow as pa
import pytest

from sparrowmill import catalog
from sparrowmill.operators import graph, recs

SF = "/root/testdata/sf0.001"


def test_each_user_gets_as_many_negatives_as_the_reference_draws(spark):
    got = catalog.queries()["gr_sample_neg"](spark, SF).groupBy("user_id").count().collect()
    users = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().count()
    assert len(got) == users and {r["count"] for r in got} == {100}


@pytest.mark.parametrize(("hops", "most"), [(1, 40), (2, 40), (3, 25)])
def test_walks_in_ranges_of_time_equal_walks_over_all_edges(spark, monkeypatch, hops, most):
    """Small ranges, so that roots, items and users reach back over several; times tie, edges repeat, ids are null."""
    monkeypatch.setattr(graph, "STEP", 3)
    rng = random.Random(hops)
    rows = [(0 if rng.random() < 0.3 else rng.randrange(12), rng.randrange(9), rng.randrange(100)) for _ in range(170)]
    rows += [*rows[:20], (None, 3, 50), (None, 3, 50), (5, None, 60), (5, 2, None), (7, 1, 120)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, time long")
    columns = ["root", "n_items", "user_id", "item_id", "time"]
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    changes = lambda: plain(graph.prefix_changes(edges, hops, 3, 2))
    graphs = lambda: plain(graph.sample_graphs(edges, hops, 3, 2).select(columns))
    whole, spans = graphs(), changes()
    monkeypatch.setattr(graph, "RANGE_EDGES", most)
    assert graphs() == whole and changes() == spans
    assert plain(graph.graphs_at(graph.prefix_changes(edges, hops, 3, 2)).select(columns)) == whole


def test_what_walks_shuffle_does_not_grow_with_what_they_find(spark, monkeypatch):
    """Roots come to their range's edges, and what they find goes nowhere; before, each root's users were shuffled."""
    edges = spark.createDataFrame([(n % 40, n % 5, n) for n in range(400)], "user_id long, item_id long, time long")
    stored = []
    keep = graph.io.stored
    monkeypatch.setattr(graph.io, "stored", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    made = graph.prefix_changes(edges, 2)
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString().splitlines()[1]  # nothing after the walks but their union
    assert made.count() > 5 * max(x.count() for x in stored)


def test_articles_of_names_are_joined_where_customers_are(spark, monkeypatch):
    """Lists of customers are not shuffled: nothing follows their making. Small blocks; articles of several names come once."""
    monkeypatch.setattr(recs, "BLOCK_CUSTOMERS", 7)
    rng = random.Random(2)
    bought = [(rng.choice([*range(40), None]), rng.randrange(60)) for _ in range(150)]
    named = [(rng.randrange(50), rng.choice([*"abcdefgh", None])) for _ in range(70)] + [(None, "a")]
    made = recs.same_product_name(spark.createDataFrame(bought, "customer_id long, article_id long"), spark.createDataFrame(named, "article_id long, prod_name string"))
    want = {}
    for c, a in bought:
        names = {n for x, n in named if x == a and n}
        if names:
            want.setdefault(c, set()).update(x for x, n in named if n in names and x is not None)
    assert {r[0]: r[1] for r in made.collect()} == {c: sorted(x) for c, x in want.items()}
    assert made._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")


def test_lists_are_joined_in_runs_of_bounded_articles():
    names = pa.record_batch({"_block": [0, 0], "_kind": [0, 0], "_name": [5, 3], "_same": [[7, 8, 9], [1, 8]], "customer_id": pa.nulls(2, pa.int64()), "_names": pa.nulls(2, pa.list_(pa.int64()))})
    customers = pa.record_batch({"_block": [0] * 3, "_kind": [1] * 3, "_name": pa.nulls(3, pa.int64()), "_same": pa.nulls(3, pa.list_(pa.int64())), "customer_id": [1, None, 2], "_names": [[3, 5], [5], [3]]})
    made = list(recs._lists_joined(most=4)(iter([names, customers])))
    assert [r for b in made for r in b.to_pylist()] == [{"customer_id": c, "previously_bought_prod_name": x} for c, x in ((1, [1, 7, 8, 9]), (None, [7, 8, 9]), (2, [1, 8]))]
    assert [b.num_rows for b in made] == [1, 1, 1]
