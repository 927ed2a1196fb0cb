"""Latent vectors of texts, and transitions in the order of events against factors that ignore it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import embeddings, graph, models, recs


def test_near_copies_are_nearer_than_others(spark):
    rng = random.Random(1)
    topics = [[f"t{k}w{n}" for n in range(60)] for k in range(6)]
    texts = [" ".join(rng.choice(topics[n % 6]) if rng.random() < 0.8 else f"common{rng.randrange(40)}" for _ in range(80)) for n in range(120)]
    copies = [" ".join(w for w in t.split() if rng.random() > 0.1) for t in texts[:30]]
    data = list(enumerate([*texts, *copies, None, "", "nan"]))
    df = spark.createDataFrame(data, "id long, text string").repartition(3)
    got = {r.id: np.array(r.embedding) for r in embeddings.latent_vectors(df, "id", "text", size=16, slots=1 << 12).collect()}
    assert len(got) == len(data) and all(len(v) == 16 for v in got.values())
    assert not got[151].any() and np.allclose(got[150], got[152]) and abs(np.linalg.norm(got[0]) - 1) < 1e-5
    pairs = [got[n] @ got[120 + n] for n in range(30)]
    other = [got[a] @ got[b] for a in range(0, 120, 7) for b in range(3, 120, 7) if a % 6 != b % 6]
    same = [got[a] @ got[b] for a in range(0, 60, 6) for b in range(60, 120, 6)]
    assert min(pairs) > max(other) and np.mean(pairs) > np.mean(same) > np.mean(other) + 0.3
    again = {r.id: np.array(r.embedding) for r in embeddings.latent_vectors(df, "id", "text", size=16, slots=1 << 12).collect()}
    assert all(np.allclose(again[n], got[n], atol=1e-4) or np.allclose(np.abs(again[n]), np.abs(got[n]), atol=1e-3) for n in got)
    assert embeddings.latent_vectors(df.limit(0), "id", "text", size=4, slots=64).count() == 0


def test_sequences_overlap_by_one(spark):
    events = spark.createDataFrame([("u", 100 + n, n) for n in range(7)] + [("v", 5, 0)], "user string, item int, t int")
    got = sorted((r.user, r.part, r["items"]) for r in embeddings.sequences(events, "user", "item", ["t"], 3).collect())
    assert got == [("u", 0, [100, 101, 102, 103]), ("u", 1, [103, 104, 105, 106]), ("u", 2, [106]), ("v", 0, [5])]


def test_transitions_beat_factors_that_ignore_the_order(spark):
    """A Markov log: from each item two of 60 follow. Factors of users and items can't tell what is next."""
    rng = random.Random(3)
    after = {n: rng.sample(range(60), 2) for n in range(60)}
    rows, truth = [], {}
    for u in range(250):
        at = rng.randrange(60)
        for t in range(20):
            rows.append((u, at, t))
            at = rng.choice(after[at]) if rng.random() < 0.9 else rng.randrange(60)
        truth[u] = at
    events = spark.createDataFrame(rows, "user int, item int, t int")
    lists = embeddings.sequences(events, "user", "item", ["t"]).cache()
    model = embeddings.train_transitions(lists, rank=16, slots=1 << 10, epochs=10, shards=2, window=2)
    users, items = embeddings.transition_vectors(model, lists, "user", events, "item", window=2)
    mine = {u: set() for u in truth}
    for r in recs.nearest(users, items, 12, "user", "v", item_col="item").collect():
        mine[r.query].add(r.item)
    counts = events.groupBy("user", "item").agg(F.count("*").cast("float").alias("n"))
    als = {r.user: set(r.prediction) for r in models.predict_factors(models.train_factors(counts, "user", "item", "n"), 12).collect()}
    recall = lambda found: np.mean([truth[u] in found[u] for u in truth])
    assert recall(mine) > 0.6 and recall(mine) > recall(als) + 0.2


def test_prefix_graphs_equal_one_walk_a_prefix(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(12), rng.randrange(9), t) for t in range(150)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, time long")
    got = {}
    for r in graph.sample_graphs(edges, 2, 3, 2).collect():
        got.setdefault((r.root, r.n_items), set()).add((r.user_id, r.item_id, r.time))
    latest = lambda found, k, key: set(sorted(found, key=key, reverse=True)[:k])
    want = {}
    for u in range(12):
        own = sorted((t, i) for w, i, t in rows if w == u)
        for n in range(2, len(own)):
            until = own[n - 1][0]
            past = [(w, i, t) for w, i, t in rows if t <= until]
            w1 = latest([e for e in past if e[0] == u], 3, lambda e: (e[2], e[1]))
            u1 = set().union(*[latest([e for e in past if e[1] == i], 2, lambda e: (e[2], e[0])) for i in {e[1] for e in w1}])
            front = sorted({e[0] for e in u1} - {u}, reverse=True)[:2]
            w2 = set().union(*[latest([e for e in past if e[0] == f], 3, lambda e: (e[2], e[1])) for f in front])
            want[u, n] = w1 | u1 | w2
    assert got == want


@pytest.mark.parametrize(("hops", "step"), [(2, 32), (3, 4)])
def test_prefix_changes_equal_one_walk_a_prefix(spark, monkeypatch, hops, step):
    """One user holds a third of the events, times tie, and blocks are shorter than its prefixes."""
    monkeypatch.setattr(graph, "STEP", step)
    rng = random.Random(hops)
    rows = [(0 if rng.random() < 0.3 else rng.randrange(12), rng.randrange(9), rng.randrange(100)) for _ in range(150)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, time long")
    columns = ["root", "n_items", "user_id", "item_id", "time"]
    changes = graph.prefix_changes(edges, hops, 3, 2)
    got = sorted(map(tuple, graph.graphs_at(changes).select(columns).collect()))
    assert got == sorted(map(tuple, graph.sample_graphs(edges, hops, 3, 2).select(columns).collect()))
    spans = {}
    for r in changes.collect():
        spans.setdefault((r.root, r.user_id, r.item_id, r.time), []).append((r.first, r.last))
    assert all(b[0] > a[1] + 1 for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:]))  # as long as they can be
    assert sum(map(len, spans.values())) < len(got)


def test_prefix_changes_read_what_came(spark, monkeypatch):
    """An edge that stays in a neighbourhood is met once, not once a prefix; no events give no rows."""
    met = []
    inner = graph._differences
    monkeypatch.setattr(graph, "_differences", lambda *a: met.append(inner(*a)) or met[-1])
    edges = spark.createDataFrame([(0, t, t) for t in range(30)] + [(1, 0, -1)], "user_id long, item_id long, time long")
    graph.prefix_changes(edges, 2).collect()
    assert met[0].count() == 29  # 28 prefixes of up to 29 items: each item enters once
    assert graph.prefix_changes(edges.limit(0), 2).count() == 0


def test_prefix_changes_keep_runs_and_not_edges(spark, monkeypatch):
    """What a hop writes grows with runs and users met, not with the edges of every prefix; spans go on over blocks of 32."""
    rows = [(n // 20 % 4 if n % 20 == 0 else 100 + n % 1500, n % 3, n) for n in range(3000)]  # 4 roots of 37 or 38 events: two blocks
    edges = spark.createDataFrame(rows, "user_id long, item_id long, time long")
    sizes = {}
    inner = graph.io.stored

    def stored(df, name):
        made = inner(df, name)
        sizes[name] = max(sizes.get(name, 0), made.count())
        return made

    monkeypatch.setattr(graph.io, "stored", stored)
    changes = graph.prefix_changes(edges, 2, 30, 40).collect()
    sizes.pop("numbered", None)
    assert max(sizes.values()) < len(changes) / 2, (sizes, len(changes))
    past = {(r.root, n, r.user_id, r.item_id, r.time) for r in changes for n in range(r.first, r.last + 1)}
    walked = graph.sample_graphs(edges, 2, 30, 40).select("root", "n_items", "user_id", "item_id", "time").collect()
    assert len(past) == sum(r.last - r.first + 1 for r in changes) and past == set(map(tuple, walked))
