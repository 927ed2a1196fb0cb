"""Exact values on small frames: boundaries, ties, identities and errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import scalars as fn
from sparrowmill.operators import frames, graph, metrics, models, prep, recs, sampling, series, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tx(spark):
    d = dt.date
    data = [(1, 10, d(2024, 1, 1), 5.0, 1, 1), (1, 10, d(2024, 1, 8), 5.0, 2, 2), (1, 11, d(2024, 1, 31), 7.0, 1, 3), (2, 11, d(2024, 1, 24), 7.0, 1, 4), (2, 12, d(2024, 1, 31), 9.0, 2, 5), (3, 12, d(2024, 1, 30), 9.0, 2, 6)]
    return spark.createDataFrame(data, "customer_id long, article_id long, t_dat date, price double, sales_channel_id int, line_id long")


def test_date_filters(tx):
    assert frames.last_n_days(tx, "t_dat", 7).count() == 4  # the boundary day is in
    assert frames.last_n_weeks(tx, "t_dat", 1).count() == 3  # and here it is out
    for none in (None, 0):
        assert frames.last_n_days(tx, "t_dat", none) is tx and frames.last_n_weeks(tx, "t_dat", none) is tx
    with pytest.raises(ValueError):
        frames.last_n_days(tx, "t_dat", -1)
    assert frames.date_cutoffs(tx, "2024-01-08", "2024-01-30", "t_dat").count() == 3
    with pytest.raises(ValueError):
        frames.date_cutoffs(tx, "2030-01-01", None, "t_dat")


def test_frames(spark, tx):
    df = spark.createDataFrame([(1, "2", "x")], "`i_id` int, `n_a[1]` string, `c_<b>` string")
    assert frames.clean_names(df).columns == ["i_id", "n_a1", "c_b"]
    assert frames.roles(df)["numeric"] == ["n_a[1]"]
    with pytest.raises(ValueError):
        frames.roles(df.withColumn("y_1", F.lit(1)).withColumn("y_2", F.lit(1)))
    with pytest.raises(KeyError):
        frames.cast_categories(df, ["absent"])
    kinds = dict(frames.narrow_types(tx).dtypes)
    assert kinds["customer_id"] == "tinyint" and kinds["price"] == "float"
    forced = frames.force_types(spark.createDataFrame([("1.5",), ("bad",), (None,)], "x string"), ["x"], [])
    assert rows(forced) == [(1.5,), (None,), (None,)]
    assert rows(frames.fill_counts(spark.createDataFrame([(None, None)], "Count_a double, b double"))) == [(0, None)]


def test_scalars(spark):
    micros = spark.createDataFrame([(1606780800000000 + 7 * 3600 * 1000000,)], "m long")  # a Tuesday, 07:00
    assert rows(micros.select(fn.weekday("m"), fn.hour("m"))) == [(1, 7)]
    one = spark.range(1)
    assert rows(one.select(fn.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("d"))))) == [(0.25,)]
    assert rows(one.select(fn.union_arrays(F.lit(None).cast("array<int>"), F.array(F.lit(1), F.lit(1)), F.array(F.lit(2))))) == [([1, 2],)]
    assert rows(spark.createDataFrame([(x,) for x in (0, 1, 3, 6, 9, 10)], "x int").select(fn.bin_case("x"))) == [("1",), ("2",), ("3",), ("4",), ("5",), ("6",)]
    assert rows(one.select(fn.zfill(F.lit(7)), fn.zfill(F.lit(123)))) == [("07", "123")]
    with pytest.raises(Exception, match="not a date"):
        one.select(fn.parse_date(F.lit("nope"), strict=True)).collect()


def test_tables(spark, tx):
    assert rows(tables.most_sold(tx, "article_id", 2)) == [(10, 2), (11, 2)]
    assert tables.most_sold(tx, "article_id", 0).count() == 0
    assert rows(tables.rebuy_share(tx, "customer_id", "article_id")) == [(10, 1.0), (11, 0.0), (12, 0.0)]
    assert rows(tables.average_gap(tx, "customer_id", "t_dat")) == [(1, 15), (2, 7), (3, None)]
    times = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 5, 3), (1, 9, 4)], "u int, t long, id int")
    assert rows(tables.refine_times(times, "u", "t", "id")) == [(1, 5, 1), (1, 6, 2), (1, 7, 3), (1, 9, 4)]
    prefixed = tables.prefixes(tx, "customer_id", "article_id", ["t_dat", "line_id"])
    assert rows(prefixed.select("customer_id", "sequence", "target")) == [(1, [10, 10], 11)]


def test_recommender(spark, tx):
    customers = spark.createDataFrame([(1, 20.0), (2, 40.0), (3, None), (4, 60.0)], "customer_id long, age double")
    assert rows(recs.popular(tx, windows=(7, None), tops=(1, 1))) == [(10,), (11,)]
    found = recs.segment_popular(tx, customers, [20.0, 40.0, 60.0], windows=(None,), tops=(1,))
    assert rows(found) == [(1, [10]), (2, [10]), (3, [12])]  # customer 4's bin sold nothing
    wide = recs.collect(customers.select("customer_id"), recs.previously_bought(tx), found)
    long = recs.unpack(wide, ["previously_bought", "segment_articles"])
    assert ("multiple_strategies",) in rows(long.where("customer_id = 1 and article_id = 10").select("strategy_name"))
    recalls = dict(rows(recs.recall(wide, ["previously_bought", "segment_articles"], tx)))
    assert recalls["previously_bought"] == 1.0 and recalls["all_candidates"] == 1.0 and recalls["segment_articles"] == pytest.approx(2 / 5)
    lists = {"a": spark.createDataFrame([(1, [5, 6, 7])], "id int, prediction array<int>"), "b": spark.createDataFrame([(1, [6, 5, 8])], "id int, prediction array<int>")}
    assert rows(recs.blend(lists, "id", 3)) == [(1, "5 6 7")]


def test_nearest_counts_the_item_itself(spark):
    vectors = spark.createDataFrame([(n, [float(n), 0.0]) for n in range(8)], "article_id long, embedding array<float>")
    got = recs.nearest(vectors.where("article_id = 3"), vectors, 3)
    assert rows(got.select("item", "rank")) == [(2, 2), (3, 1), (4, 3)]


def test_metrics(spark):
    def ap(predicted, actual, k):
        df = spark.createDataFrame([(predicted, actual)], "p array<int>, a array<int>")
        return df.select(metrics.average_precision("p", "a", k)).first()[0]

    assert ap([1, 2, 3, 4], [1, 9, 8, 7], 4) == 0.25
    assert ap([1, 1, 2], [1], 3) == 1.0 and ap([1, 2], [], 2) == 0.0
    assert ap([9, 1], [1, 2], 2) == 0.25
    scored = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.9), (1, 0, 0.1), (2, 1, 0.8), (2, 0, 0.3)], "g int, label int, s double")
    got = metrics.recall_ndcg(scored, "g", "label", "s", (1, 2)).first()
    assert got.recall_1 == 0.5 and got.recall_2 == 1.0 and got.ndcg_2 == pytest.approx((1 + 1 / 1.5849625) / 2)
    assert metrics.auc(scored, "s", "label").first()[0] == pytest.approx(4 / 6)


def test_imputers_and_encoders(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 3.0, None), (4, 2.0, "b"), (5, None, "c")], "id int, n double, c string")
    fills = prep.fit_imputers(df, mean=["n"], mostfreq=["c"])
    assert fills == {"n": 2.0, "c": "b"}
    assert prep.impute(df, prep.fit_imputers(df, zero=["n"], unknown=["c"])).where("n = 0 or c = 'UNKNOWN'").count() == 3
    seen = prep.fit_categories(df, "c", "id")
    assert seen == ["b", "a", "c"]
    assert [r[0] for r in prep.ordinal(df, "c", seen).orderBy("id").select("c").collect()] == [1, 2, -1, 1, 3]
    assert prep.onehot(df, "c", seen).columns == ["id", "n", "c_b", "c_a", "c_c"]
    assert [tuple(r) for r in prep.binary(df.where("c is not null"), "c", seen).orderBy("id").select("c_0", "c_1").collect()] == [(0, 1), (1, 0), (0, 1), (1, 1)]
    with pytest.raises(ValueError):
        prep.uncorrelated(df, ["n"], 1.5)
    with pytest.raises(ValueError):
        prep.uncorrelated(df, ["c"], 0.5)


def test_samples(spark, tx):
    train, val = sampling.split_groups(tx.withColumn("label", F.lit(1)), "customer_id", "label", 0.34)
    ids = lambda df: {r[0] for r in df.select("customer_id").distinct().collect()}
    assert ids(train) | ids(val) == {1, 2, 3} and not ids(train) & ids(val) and len(ids(val)) == 1
    assert sampling.sample_keys(tx, "customer_id", 1.0) is tx and sampling.sample_keys(tx, "customer_id", 0.1).count() == 0
    with pytest.raises(ValueError):
        sampling.sample_keys(tx, "customer_id", 1.5)
    with pytest.raises(ValueError):
        sampling.downsample_negatives(tx.withColumn("label", F.lit(0)), ["line_id"], 99)
    with pytest.raises(ValueError):
        sampling.quantile_edges(spark.createDataFrame([(1.0,)] * 5, "x double"), "x", 4)
    binned = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (9.0,), (None,)], "x double").select(sampling.quantile_bin("x", [0.0, 1.0, 2.0]))
    assert rows(binned) == [("00",), ("00",), ("01",), ("nan",), ("nan",)]
    train, val = sampling.split_weeks(tx, "t_dat", 6, 1)
    assert (train.count(), val.count()) == (3, 3)


def test_graph(spark):
    edges = spark.createDataFrame([(u, i, t) for u, i, t in [(1, 1, 1), (1, 2, 3), (1, 3, 5), (1, 4, 7), (2, 2, 2), (2, 5, 4), (3, 9, 6)]], "user_id long, item_id long, time long")
    count = lambda df: {r[0]: r[1] for r in df.groupBy("split").count().collect()}
    assert count(graph.split(edges, True, True, True)) == {"predict": 3, "test": 2, "val": 1, "train": 1}
    assert count(graph.split(edges, False, False, False)) == {"train": 7}
    assert graph.time_slice(edges, 2, 5).count() == 3 and graph.time_slice(edges, 2, 5, closed=True).count() == 4
    roots = spark.createDataFrame([(1, 7, 1)], "user_id long, until long, root long")
    assert graph.khop(edges, roots, ["root"], 1).count() == 4
    assert {r.item_id for r in graph.khop(edges, roots, ["root"], 2).collect()} == {1, 2, 3, 4, 5}
    ranked = spark.createDataFrame([(1, [1, 0, 2, 3]), (2, [1, 0, 3, 2]), (3, [0, 1, 2, 3]), (4, [1, 2, 0, 3])], "user_id int, prediction array<int>")
    assert graph.borda_list(ranked).first()[0] == [1, 0, 2, 3]
    assert rows(graph.dense_ids(edges, "item_id")) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (9, 5)]
    taken = graph.sample_negatives(edges, 2)
    assert taken.groupBy("user_id").count().where("count = 2").count() == 3
    assert taken.join(edges, ["user_id", "item_id"]).count() == 0
    with pytest.raises(ValueError):
        graph.preprocess(None, None)


def test_series(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("a", day + dt.timedelta(7 * n), 10.0 + n) for n in range(12)] + [("b", day + dt.timedelta(7 * n), 0.0 if n % 3 else 6.0) for n in range(12)], "unique_id string, ds date, y double")
    for name in series.MODELS:
        got = series.forecast(df, 3, [name]).collect()
        assert len(got) == 6 and all(r[name] is not None for r in got)
    best = {r.unique_id: r.AutoETS for r in series.forecast(df, 1, ["AutoETS"]).collect()}
    assert abs(best["a"] - 22) < 0.5  # the trend goes on, naive would say 21
    with pytest.raises(ValueError):
        series.models(["Nothing"])
    cv = series.cross_validate(df, 2, 3, 1, lambda d: series.naive(d, 2), ["Naive"])
    assert cv.count() == 2 * 2 * 3
    assert metrics.cv_errors(cv, ["Naive"]).count() == 3


def test_stateless_stream(spark, tmp_path):
    from sparrowmill.streaming.stateless import run_stateless

    tables_of = spark.createDataFrame([(n, "purchase" if n % 2 else "view") for n in range(6)], "event_id long, event_type string")
    tables_of.write.parquet(str(tmp_path / "in"))
    flagged = lambda df: df.select("event_id", frames.flag(F.col("event_type") == "purchase").alias("bought"))
    run_stateless(spark, str(tmp_path / "in"), tables_of.schema, flagged, str(tmp_path / "out"), str(tmp_path / "state"))
    tables_of.limit(2).write.mode("append").parquet(str(tmp_path / "in"))
    run_stateless(spark, str(tmp_path / "in"), tables_of.schema, flagged, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_prompts_hold_the_whole_text(spark):
    text = " ".join(f"w{n}" for n in range(600))
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    got = {r.id: r for r in models.complete_batch(df, "id", "text", "summarize", lambda p, most: p.str.len().astype(str) + f" {most}").collect()}
    want = "Summarize the following text:\n" + text
    assert got["1"].prompt == want and got["1"].completion == f"{len(want)} 256" and got["2"].prompt is None


def test_orders_by_ranges(spark):
    import numpy as np

    from sparrowmill.operators import ranks

    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, 3000), 2) + 0.0
    x[:1000] = 0.5  # a third of all rows
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 7, "x double").repartition(5)
    points = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    for most in (ranks.SAMPLE, 50):  # all values at hand, or by ranges
        kept, ranks.SAMPLE = ranks.SAMPLE, most
        try:
            assert ranks.quantiles(df, "x", points) == pytest.approx(np.quantile(x, points).tolist())
        finally:
            ranks.SAMPLE = kept
    assert ranks.quantiles(df.where("x is null"), "x", points) == []
    counts = df.where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    values, n = np.unique(x, return_counts=True)
    assert rows(ranks.running(counts, "x", "n", parts=7).select("x", "n", "before")) == sorted(zip(values.tolist(), n.tolist(), (np.cumsum(n) - n).tolist(), strict=True), key=repr)
    words = spark.createDataFrame([(w,) for w in ("b", "a", None, "c", "a")], "w string")
    assert rows(ranks.dense_ids(words, "w")) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(prep.fit_codes(words, "w")) == [("a", 1), ("b", 2), ("c", 3)]
    coded = prep.ordinal(words.union(spark.createDataFrame([("z",)], "w string")), "w", prep.fit_codes(words, "w"))
    assert sorted(r.w for r in coded.collect()) == [-1, -1, 1, 1, 2, 3]


def test_refined_times_fold_a_user_in_order(spark):
    import random

    rng = random.Random(2)
    events = [(rng.choice([1, 2, None]), rng.choice([None, *range(6)]), n) for n in range(200)]
    want, state = [], {}
    for u, t, n in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[1] is not None, e[1] or 0, e[2])):
        last, gap = state.get(u, (None, 1))
        if t is not None:
            out = t if last is None or t > last else t + gap
            state[u] = (out, gap + (last is not None and t <= last))
            t = out
        want.append((u, t, n))
    df = spark.createDataFrame(events, "u int, t long, id int").repartition(7)
    assert rows(tables.refine_times(df, "u", "t", "id")) == sorted(want, key=repr)


def test_nearest_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (150, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)] + [(999, None)], "article_id long, embedding array<float>")
    want = []
    for n, v in enumerate(vectors):
        d = np.sqrt(((vectors - v) ** 2).sum(1))
        want += [(n, int(i), r + 1) for r, i in enumerate(np.lexsort((np.arange(150), d))[:5])]
    for block in (40, 4096):
        assert rows(recs.nearest(df, df, 5, block_rows=block).select("query", "item", "rank")) == sorted(want, key=repr)


def test_neighbourhoods_against_brute_force(spark):
    import random

    rng = random.Random(7)
    edges = [(rng.randrange(12), rng.randrange(8), t) for t in range(150)]

    def latest(by, key, until, k):
        return sorted([e for e in edges if e[by] == key and e[2] <= until], key=lambda e: (e[2], e[1 - by]))[-k:]

    def brute(root, until, hops, item_max, user_max):
        found, seen, front = set(), {root}, [root]
        walked = latest(0, root, until, item_max)
        found.update(walked)
        for _ in range(hops - 1):
            users = [e for i in {e[1] for e in walked} for e in latest(1, i, until, user_max)]
            front = sorted({e[0] for e in users} - seen, reverse=True)[:user_max]
            seen.update(front)
            walked = [e for u in front for e in latest(0, u, until, item_max)]
            found.update(users + walked)
        return found

    df = spark.createDataFrame(edges, "user_id long, item_id long, time long")
    got = graph.sample_graphs(df, 3, item_max=4, user_max=3)
    want = []
    for u in range(12):
        mine = sorted((e for e in edges if e[0] == u), key=lambda e: (e[2], e[1]))
        for n in range(2, len(mine)):
            want += [(u, n, *e) for e in brute(u, mine[n - 1][2], 3, 4, 3)]
    assert rows(got.select("root", "n_items", "user_id", "item_id", "time")) == sorted(want, key=repr)
    ready = {r.user_id: (r.sequence, r.target, r.n_items) for r in graph.user_samples(df, 5, predict=True).collect()}
    for u in {e[0] for e in edges}:
        mine = [e[1] for e in sorted((e for e in edges if e[0] == u), key=lambda e: (e[2], e[1]))]
        assert ready[u] == (mine[-5:], 0, len(mine))


def test_models_rank_and_score_in_batches(spark, tmp_path):
    data = spark.createDataFrame([(n % 9, n, float(n % 7), float(n % 5), float(n % 7 > 3)) for n in range(180)], "customer_id long, article_id long, a double, b double, y double")
    one, two = (models.train_gbt(data, [c], [], "y", maxIter=2, maxDepth=2) for c in ("a", "b"))
    scorer = lambda m: lambda df: models.score(df, m, "score")
    got = recs.rank_models(data, {"one": scorer(one), "two": scorer(two)}, top=5, k=3)
    lists = {n: tables.top_lists(models.score(data, m, "score"), "customer_id", "article_id", "score", 5) for n, m in (("one", one), ("two", two))}
    assert rows(got) == rows(recs.blend(lists, "customer_id", 3)) and got.count() == 9
    path = str(tmp_path / "scores")
    want = rows(models.score(data, one).select("article_id", "probability"))
    assert rows(models.score_batched(data, one, "article_id", path, 3).select("article_id", "probability")) == want
    assert rows(models.score_batched(data.limit(0), one, "article_id", path, 3).select("article_id", "probability")) == want  # nothing left to do


def test_store_behind_a_scheme(spark, tmp_path):
    from sparrowmill.sources import io

    spark.range(5).write.parquet(str(tmp_path / "lake" / "t.parquet"))
    store = io.mount(spark, "lake", "raw", f"file://{tmp_path}/lake", {"fs.lake.retries": "3"})
    assert store == "viewfs://lake/raw" and spark._jsc.hadoopConfiguration().get("fs.lake.retries") == "3"
    df = io.read_parquet(spark, f"{store}/t.parquet", ["id"])
    assert df.count() == 5 and all(f.startswith("viewfs://lake/") for f in df.inputFiles())
    listed = io.objects(spark, store, "*.parquet").collect()
    assert listed and all(r.length > 0 and r.path.startswith("viewfs://lake/raw/t.parquet") for r in listed)
    df.where("id < 2").write.parquet(f"{store}/u.parquet")
    assert spark.read.parquet(str(tmp_path / "lake" / "u.parquet")).count() == 2
