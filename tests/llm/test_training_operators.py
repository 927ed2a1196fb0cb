"""Small tests of the training-data operators against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import bpe, exact_dedup, html_text, licenses, lm_scoring, mixing, near_dedup, quality, repeats, topk
from sparrowmill.llm.queries import oracle_sql, tokenizer_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, schema=DOCS):
    rows = [(n, t, "en", None if n % 7 == 3 else f"s{n % 3}", len(t or "")) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(["th", "er", "on", "ing", "tion", "a", "of"]) + rng.choice(["an", "re", "he", "in", "ed", ""]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 4, 5, 30, 80, 200])) for _ in range(40)]
    shared = prose(rng, 25)
    out = list(base)
    out += [b.replace(" ", "  \n", 2) for b in base[:5]] + base[3:9]  # copies, some with other white space
    out += [base[7] + " " + shared + " " + base[8], prose(rng, 20) + shared + prose(rng, 9), shared]
    long = prose(rng, 120).split()
    out += [" ".join(long)] + [" ".join(w if i != k else "CHANGED" for i, w in enumerate(long)) for k in (10, 60, 100)]
    out += [None, "", "  ", "aaaa" * 60, "aaaa" * 60 + "b", "\U0001d54f é ü " * 20, "x" * 20_000]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def awkward(spark, columns="doc_id long, text string, source string, id string, key string, h int"):
    """Nulls everywhere, repeated rows, and extra columns named like inner ones."""
    data = [(1, "a b", None, None, "k", None), (1, "a b", None, None, "k", None), (None, None, "s", "x", None, 1), (None, "a  b", "s", None, None, 2), (3, "", "s", "y", "z", 3)]
    return spark.createDataFrame(data, columns)


def test_exact_classes_against_sql(spark, texts):
    got = exact_dedup.classes(docs_of(spark, texts)).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    documents = docs_of(spark, texts).toPandas()  # noqa: F841
    want = con.sql(oracle_sql()["op5_exact_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got.astype(str).equals(want[got.columns].astype(str))


def test_exact_collisions_and_splits(spark, texts):
    docs = docs_of(spark, texts)
    want = rows(exact_dedup.classes(docs))
    index = exact_dedup.build_index(docs, key_bits=3, capacity=2)
    assert index.depth == 2 and index.entries.agg(F.max("link")).first()[0] > 1
    assert rows(exact_dedup.classes(docs, index=index)) == want
    deep = exact_dedup.build_index(docs, capacity=4)
    slots = deep.directory.collect()
    assert len(slots) == 2**deep.depth and {s.slot for s in slots} == set(range(2**deep.depth))
    assert all(s.n_keys <= 4 for s in slots) and all(s.local_depth <= deep.depth for s in slots)


def test_exact_answers_come_from_the_directory(spark, texts):
    docs = docs_of(spark, texts)
    index = exact_dedup.build_index(docs, capacity=4)
    buckets = [r[0] for r in index.directory.select("bucket").distinct().orderBy("bucket").collect()]
    want = rows(exact_dedup.classes(docs, index=index))
    assert want == rows(exact_dedup.classes(docs)) and len(buckets) > 2
    wrong = F.create_map(*[F.lit(x) for a, b in zip(buckets, buckets[1:] + buckets[:1], strict=True) for x in (a, b)])
    index.directory = index.directory.withColumn("bucket", F.element_at(wrong, F.col("bucket")))
    assert rows(exact_dedup.classes(docs, index=index)) != want


def test_exact_edges(spark):
    docs = awkward(spark)
    got = exact_dedup.classes(docs).select("doc_id", "keep_id", "group_size", "kept")
    assert rows(got) == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, 3, 2, False), (3, 3, 2, True)], key=repr)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and rows(kept.select("doc_id", "text", "h")) == sorted([(1, "a b", None), (1, "a b", None), (3, "", 3)], key=repr)
    long = "word " * 400_000
    twice = spark.createDataFrame([(7, long), (2, long + " "), (4, long + "x")], "doc_id long, text string")
    assert rows(exact_dedup.classes(twice).select("doc_id", "keep_id")) == [(2, 2), (4, 4), (7, 2)]
    assert exact_dedup.classes(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_mixing_against_sql(spark, texts):
    got = mixing.plan_mix(docs_of(spark, texts)).toPandas().sort_values("doc_id").reset_index(drop=True)
    documents = docs_of(spark, texts).toPandas()  # noqa: F841
    want = duckdb.connect().sql(oracle_sql()["op9_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    for c in ("doc_id", "size", "source_size", "taken"):
        assert got[c].tolist() == want[c].tolist(), c
    assert np.allclose(got["target"], want["target"])
    assert (got["taken"] <= 2 * got["size"]).all()


def test_mixing_rows_hold_the_words(spark, texts):
    docs = docs_of(spark, texts)
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("source").agg(F.sum(mixing.n_words("text")).alias("n")).collect()
    plan = {r.source: (r.n, r.t) for r in docs.select("doc_id", "source").join(mixing.plan_mix(docs), "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()}
    assert {r.source: r.n for r in words} == {s: n for s, (n, _) in plan.items()}
    assert all(abs(n - t) <= 1 for n, t in plan.values())


def test_mixing_edges(spark):
    docs = awkward(spark)
    plan = mixing.plan_mix(docs)
    assert rows(plan.select("doc_id", "size", "source_size")) == sorted([(1, 2, 4), (1, 2, 4), (None, 0, 2), (None, 2, 2), (3, 0, 2)], key=repr)
    assert all(0 <= r.taken <= 2 * r.size for r in plan.collect()) and mixing.mix_rows(docs).columns == docs.columns
    assert mixing.plan_mix(docs.limit(0)).count() == 0 and mixing.mix_rows(docs.limit(0)).count() == 0


def brute_license(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, texts):
    lines = ["Licensed under the MIT License.", "the Apache-License, version 2.0 and MIT license mit LICENSE", "GNU Lesser General Public License v2.1 or later", "permit license", "mit\x00license", "Licensed under CC BY-NC 4.0.",
             "SPDX-License-Identifier: BSD-3-Clause", "mIt" + " x" * 9 + " licensé MIT LICENSE é", "mit license " * 3000]
    every = [*texts, *lines, *[f"{t or ''} {x}" for t, x in zip(texts, lines, strict=False)]]
    got = {r.doc_id: r for r in licenses.license_digest(docs_of(spark, every)).collect()}
    for n, t in enumerate(every):
        r = got[n]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    at = len(texts)
    assert [got[at + k].labels for k in (0, 1, 2, 3, 5, 6)] == ["mit", "apache,mit", "gpl,lgpl", "", "cc-by-nc", "bsd"]
    assert len(licenses.rules()) > 250
    spans = licenses.scan(docs_of(spark, lines)).collect()
    assert not any(a.doc_id == b.doc_id and a.rule != b.rule and a.first <= b.first and b.last <= a.last for a in spans for b in spans if a.doc_id < 8)


def test_license_gates_lose_no_match(spark):
    """Without gates every rule runs on every text, and finds the same."""
    rng = random.Random(12)
    parts = [w for r in licenses.rules() for w in re.sub(r"[^a-z0-9 ]+", " ", r["regex"]).split()]
    pool = sorted(set(parts))
    every = [" ".join([*rng.choices(pool, k=12), *re.sub(r"\\(.*?\\)|[^a-z0-9 ]", "", r["regex"]).split(), *rng.choices(pool, k=5)]) for r in licenses.rules()[::3]]
    table = licenses.rules()
    ungated = [r | {"keyword": "anyhow", "gate": "anyhow"} for r in table]
    df = docs_of(spark, every)
    shown = lambda t, d: rows(licenses.scan(d, table=t).select("doc_id", "rule", "label", "first", "last"))
    assert shown(table, df) == shown(ungated, df.withColumn("text", F.concat("text", F.lit(" anyhow"))))


def test_license_edges(spark):
    docs = awkward(spark)
    got = licenses.license_digest(docs)
    assert rows(got.select("doc_id", "n_words", "n_base", "first_word", "labels", "score")) == sorted([(1, 2, 0, None, "", 0.0)] * 2 + [(None, 0, 0, None, "", 0.0), (None, 2, 0, None, "", 0.0), (3, 0, 0, None, "", 0.0)], key=repr)
    assert licenses.license_digest(docs.limit(0)).count() == 0


def brute_repeats(texts):
    first, out = {}, []
    data = [(t or "").encode() for t in texts]
    for n, b in enumerate(data):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], n)
    for n, b in enumerate(data):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < n:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((n, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_against_brute_force(spark, texts):
    rng = random.Random(3)
    phrase = prose(rng, 14)
    more = [prose(rng, 6) + phrase[k : k + 49 + k % 5] + prose(rng, 5) for k in range(0, 20)] + [prose(rng, 3) + phrase + prose(rng, 2) for _ in range(12)]
    every = [t[:4000] if t else t for t in texts] + more
    for chunk in (2000, 1 << 20):
        got = repeats.remove_repeats(docs_of(spark, every), chunk_bytes=chunk)
        assert rows(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == sorted(brute_repeats(every), key=repr)


def test_prefix_intervals():
    assert sorted(repeats.prefix_intervals([0, 3, 3, 1, 0, 2], 1)) == [(0, 2, 3, 1), (0, 3, 1, 0), (4, 5, 2, 0)]


def test_repeats_edges(spark):
    docs = awkward(spark).union(awkward(spark).withColumn("text", F.repeat(F.lit("long passage "), 9)))
    got = repeats.remove_repeats(docs)
    assert got.count() == 10 and got.where("doc_id = 1").agg(F.sum("n_removed")).first()[0] == 0
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def brute_near(texts, n=5):
    def shingles(t):
        w = (t or "").split()
        return Counter([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else []))

    sets = [shingles(t) for t in texts]
    words = [tuple((t or "").split()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            union = sum((sets[i] | sets[j]).values())
            if words[i] == words[j] or (union and sum((sets[i] & sets[j]).values()) / union >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, find(i)) for i in range(len(texts))]


def test_near_against_brute_force(spark, texts):
    every = [t for t in texts if t is None or t.isascii()]
    rng = random.Random(8)
    original = prose(rng, 150).split()
    for k in range(12):  # edited copies, each like the original and less like each other
        edited = list(original)
        for at in rng.sample(range(0, 150, 5), 3):
            edited[at] = f"edit{k}"
        every.append(" ".join(edited))
    every.append(" ".join(original))
    for options in ({}, {"block_bytes": 3000}):
        got = near_dedup.near_classes(docs_of(spark, every), **options)
        assert rows(got.select("doc_id", "class_id")) == sorted(brute_near(every), key=repr)
    assert near_dedup.keep_one(docs_of(spark, every)).count() == len({c for _, c in brute_near(every)})


def test_near_links_through_a_member_of_the_centre(spark):
    every = []
    for k in range(30):  # A ~ B ~ C, C unlike A; A and its like come first and are the centre
        b = [f"w{k}x{n}" for n in range(50)]
        c = [w if n != 25 else "other" for n, w in enumerate(b)]
        every += [" ".join(x) for x in ([*b, "one"], [*b, "two"], b, c)]
    want = brute_near(every)
    assert all(i // 4 * 4 == c for i, c in want)
    assert rows(near_dedup.near_classes(docs_of(spark, every)).select("doc_id", "class_id")) == sorted(want, key=repr)


def test_near_links_between_crowded_classes(spark):
    """Cut and edited copies: many fail against the original and link, or not, to its other copies."""
    rng = random.Random(11)
    original = [f"w{n}" for n in range(120)]
    every = [" ".join(original)]
    for k in range(120):
        copy = original[: rng.randrange(85, 121)]
        for at in rng.sample(range(len(copy)), rng.randrange(4)):
            copy[at] = f"e{rng.randrange(40)}"
        every.append(" ".join(copy))
    want = brute_near(every)
    for options in ({}, {"block_bytes": 20_000}):
        assert rows(near_dedup.near_classes(docs_of(spark, every), **options).select("doc_id", "class_id")) == sorted(want, key=repr)


def test_near_keeps_the_texts_of_repeated_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (5, "x y z w v u t"), (1, "x y z w v u t")], "doc_id long, text string")
    assert rows(near_dedup.keep_one(docs)) == [(1, "x y z w v u t"), (5, "a b c d e f g")]


def test_near_finds_all_planted_links(spark):
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    want = [(int(docs.doc_id.iloc[i]), int(docs.doc_id.iloc[c])) for i, c in brute_near([re.sub(r"[\x09-\x0d]", " ", t) for t in docs.text])]
    got = near_dedup.near_classes(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "class_id")
    assert rows(got) == sorted(want, key=repr)


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.2, 3, 60), rng.uniform(0.2, 3, 60)
    t = 4000
    s = near_dedup.dart_signatures(np.repeat([0, 1], 60), np.concatenate([e, e]), np.concatenate([a, b]), 2, t)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 5 * math.sqrt(0.25 / t)


def test_near_edges(spark):
    got = near_dedup.near_classes(awkward(spark))
    assert sorted((r.doc_id or 0, r.class_id) for r in got.collect()) == [(0, 1), (0, 3), (1, 1), (1, 1), (3, 3)]
    assert near_dedup.near_classes(awkward(spark).limit(0)).count() == 0
    assert near_dedup.keep_one(awkward(spark)).columns == awkward(spark).columns


def test_bpe_is_the_library(spark, texts):
    import tiktoken

    path, pattern = tokenizer_files()
    ranks = bpe.load_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    every = [*texts, "ab" * 60_000, "don't  stop\n\n 12,345 naïve 日本語 ‍ 🙂🙂", " " * 3000, "ab" * 3000, "\r\n\t x"]
    got = {r.doc_id: r for r in bpe.round_trip(docs_of(spark, every), path, pattern).collect()}
    for n, t in enumerate(every):
        ids = library.encode_ordinary(t or "")
        assert got[n].n_tokens == len(ids) and got[n].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[n].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    tokens = bpe.encode(docs_of(spark, every), path, pattern)
    assert {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(tokens, path, pattern).collect()} == {n: t or "" for n, t in enumerate(every)}


def test_bpe_edges(spark):
    path, pattern = tokenizer_files()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = bpe.round_trip(awkward(spark), path, pattern)
    assert rows(got.select("doc_id", "decoded_sha256")) == sorted([(1, sha("a b")), (1, sha("a b")), (None, sha("")), (None, sha("a  b")), (3, sha(""))], key=repr)
    assert {r.n_tokens for r in got.where("doc_id = 3").collect()} == {0}
    assert bpe.round_trip(awkward(spark).limit(0), path, pattern).count() == 0


def test_lm_scores_against_brute_force(spark, texts):
    docs, good = docs_of(spark, texts), [0, 5, 6, 11, 12]
    targets = spark.createDataFrame([(g,) for g in [*good, 5]] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.score(docs, targets, size=12, mu=3.0).collect()}
    split = [lm_scoring.tokens(t or "") for t in texts]
    counts = Counter(w for s in split for w in s)
    words = sorted(counts, key=lambda w: (-counts[w], w))[:11]
    ids = [[words.index(w) + 1 if w in words else 0 for w in s] for s in split]
    tables = []
    for use in (range(len(texts)), good):
        c = np.zeros((13, 12))
        for n in use:
            for h, w in zip([12, *ids[n][:-1]], ids[n], strict=True) if ids[n] else []:
                c[h, w] += 1
        tables.append(lm_scoring.losses(c, 3.0))
    for n, s in enumerate(ids):
        if not s:
            assert got[n].n_tokens == 0 and got[n].score is None
            continue
        g, t = (np.mean([table[h, w] for h, w in zip([12, *s[:-1]], s, strict=True)]) for table in tables)
        assert abs(got[n].background_loss - g) < 1e-5 and abs(got[n].target_loss - t) < 1e-5 and abs(got[n].score - (t - g)) < 1e-5


@pytest.mark.parametrize("fan", [2, 5])
def test_lm_scores_do_not_hang_on_levels(spark, monkeypatch, fan):
    """Many chunks that exchange in levels give what one chunk gives, and each level sends at most fan messages a chunk."""
    rng = random.Random(3)
    docs = docs_of(spark, [" ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(60))) for _ in range(90)] + [None, ""])
    targets = spark.createDataFrame([(n,) for n in range(0, 90, 7)], "doc_id long")
    want = {r.doc_id: r for r in lm_scoring.score(docs, targets).collect()}
    sent, inner = {}, lm_scoring.materialise

    def counted(df, name):
        made = inner(df, name)
        sent.setdefault(name, []).append(made.count())
        return made

    monkeypatch.setattr(lm_scoring, "_CHUNK_BYTES", 1000)
    monkeypatch.setattr(lm_scoring, "materialise", counted)
    got = lm_scoring.score(docs, targets, fan=fan).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_tokens, r.score is None) == (want[r.doc_id].n_tokens, want[r.doc_id].score is None)
        assert r.score is None or r.score == pytest.approx(want[r.doc_id].score) and r.target_loss == pytest.approx(want[r.doc_id].target_loss)
    assert len(sent["asked"]) >= 1 and max(sent["asked"] + sent["answers"]) <= fan * 14  # 13 chunks or so


def test_lm_levels_grow_with_chunks():
    for chunks in [1, 2, 61, 64, 65, 128, 3700, 4096, 4097, 12_000_000]:
        levels = lm_scoring._levels(chunks, 64)
        senders = [-(-chunks // 64**n) for n in range(len(levels) + 1)]
        assert levels[-1] == (chunks + 1) // 2 and senders[-1] == 1
        assert all(s * r <= 65 * chunks for s, r in zip(senders, levels))
    for chunks in [7, 100, 300]:
        buckets = (chunks + 1) // 2
        h = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
        inside = [lm_scoring._place(h, r, buckets) for r in lm_scoring._levels(chunks, 4)]
        assert all((np.diff(a.astype(np.int64)) >= 0).all() for a in inside)
        assert all(len(set(zip(a, b))) == len(set(b)) for a, b in zip(inside, inside[1:]))  # a range has one range above it


def test_lm_edges(spark):
    none = spark.createDataFrame([], "doc_id long")
    got = lm_scoring.score(awkward(spark), none).select("doc_id", "n_tokens", F.col("score").isNull())
    assert rows(got) == sorted([(1, 2, False), (1, 2, False), (None, 0, True), (None, 2, False), (3, 0, True)], key=repr)
    long = spark.createDataFrame([(1, "one two " * 300_000), (2, "one two")], "doc_id long, text string")
    assert rows(lm_scoring.score(long, none).select("doc_id", "n_tokens")) == [(1, 600_000), (2, 2)]
    assert lm_scoring.score(awkward(spark).limit(0), none).count() == 0


def test_lm_models_hold_every_word(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for _ in range(200)]
    texts += ["rare once again", "rare twice again", None]
    got = {r.doc_id: r for r in lm_scoring.score(docs_of(spark, texts), spark.createDataFrame([(200,)], "doc_id long")).collect()}
    split = [lm_scoring.tokens(t or "") for t in texts]
    v, loss = len({w for s in split for w in s}) + 1, {}
    for name, use in (("background_loss", split), ("target_loss", split[200:201])):
        word, before, pair = Counter(w for s in use for w in s), Counter(h for s in use for h in [None, *s[:-1]] if s), Counter(p for s in use for p in zip([None, *s[:-1]], s))
        total = sum(word.values())
        loss[name] = lambda h, w, word=word, before=before, pair=pair, total=total: -math.log((pair[h, w] + 50 * (word[w] + 1) / (total + v)) / (before[h] + 50))
    for n, s in enumerate(split):
        for name, f in loss.items():
            want = np.mean([f(h, w) for h, w in zip([None, *s[:-1]], s)]) if s else None
            assert getattr(got[n], name) == (want if want is None else pytest.approx(want))
    assert got[200].score < got[201].score  # differs in words beyond the most frequent 1536


def test_quality_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = quality.judge(docs, quality.fit(docs)).join(labels, "doc_id").toPandas()
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert good.kept.mean() > 0.99 and (~bad.kept).mean() > 0.95
    assert docs.columns == quality.keep_good(docs).columns


def test_em_finds_fault_rates():
    """Texts with a fault each, labellers that miss some and raise false alarms."""
    rng = np.random.default_rng(2)
    n = len(quality.LABELLERS)
    good = rng.random(20_000) < 0.8
    kind = rng.integers(0, n, len(good))
    alarm = np.linspace(0.001, 0.004, n)
    rate = np.where(np.arange(n) == kind[:, None], 0.97, 0.06)
    fault = rng.random((len(good), n)) < np.where(good[:, None], alarm, rate)
    votes = np.where(fault, 2, 1).astype(np.int8)
    votes[rng.random(votes.shape) < 0.05] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    shares, chances = quality.fit_labellers(patterns, counts.astype(float))
    assert abs(shares[0] - 0.8) < 0.03
    found = quality.accuracies(shares, chances)
    assert np.abs(1 - found[:, 0] - alarm).max() < 0.01
    assert np.abs(found[:, 1] - (0.97 + (n - 1) * 0.06) / n).max() < 0.05
    p = quality.posterior(votes, shares, chances)
    assert ((p >= 0.5) == good).mean() > 0.95


def test_quality_edges(spark):
    docs = awkward(spark)
    got = quality.judge(docs, quality.fit(docs))
    assert rows(got.select("doc_id", "kept")) == sorted([(1, True), (1, True), (None, True), (None, True), (3, True)], key=repr)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs.limit(0)).count() == 0 and quality.judge(docs.limit(0), quality.fit(docs.limit(0))).count() == 0


def brute_top(vectors, asks, k):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in valid:
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in valid if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_topk_against_brute_force(spark):
    rng = random.Random(4)
    near = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    vectors = [(i, [x + rng.gauss(0, 0.05) for x in near[i % 5]]) for i in range(300)] + [(300 + i, near[0]) for i in range(60)]
    vectors += [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (None, near[0]), (403, [1.0, 2.0]), (404, [float("inf")] * 6), (420, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    for options in ({}, {"pivots": 7, "group_queries": 3, "shard_rows": 50}):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, **options)
        assert rows(got) == sorted(brute_top(stored, lambda i: i % 20 == 0, 5), key=repr)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0 and topk.top_k(df, F.lit(False)).count() == 0
    few = topk.top_k(df.where("vec_id < 3"), F.lit(True))
    assert few.count() == 6


PAGES = [
    (1, "http://a.example/1", "<html><head><title>no</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></ul></nav><article><h1>Head &amp; tail</h1><p>One  two<br>three <b>bold</b>ly &lt;ok&gt;&nbsp;x<aside>side</aside></p><p>Four</article><footer>&copy; f</footer></body></html>", "Head & tail\nOne two\nthree boldly <ok> x\nFour"),
    (2, "http://a.example/2", "<body><div class='ad'>Buy</div><main><p>Main text<div class=\"comments\">nice post</div><form>search</form></main>", "Main text"),
    (3, "http://b.example/1", "<body><div>We sell many good things in this shop every day</div><p>Only here is this text of page three to be found</p></body>", "Only here is this text of page three to be found"),
    (4, "http://b.example/2", "<body><div>We sell many good things in this shop every day</div><p>Quite another story is told on page four by someone</p></body>", "Quite another story is told on page four by someone"),
    (5, None, None, ""), (6, "", "plain &quo text <p", "plain &quo text"), (7, "http://c.example", "<!-- x --><p>a<!-- > --> b</p><style>p{}</style>", "a b"),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h, _ in PAGES], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for i, u, _, text in PAGES:
        assert got[i].text == text and got[i].url == u and got[i].n_chars == len(text)
    twice = html_text.extract(pages.union(pages)).collect()
    assert len(twice) == 2 * len(PAGES) and html_text.extract(pages.limit(0)).count() == 0


ODD_PAGES = [
    ("<html><head><title>T</title><body><article><p>Main story.</p></article></body></html>", "Main story."),
    ("<head><title>T</title><p>No body tag", "No body tag"),
    ("<article><p>One</p><select><option>a<p>Two</p></article>", "One\na\nTwo"),
    ("<article><p>One</p><template>Two<p>Three", "One\nTwo\nThree"),
    ("<article><header><h1>Head</h1></header><div class='product-widget'>a</div><p id='side-effects'>b</p><div class='related-work'>c</div><div class='notice-of-death'>d</div></article>", "Head\na\nb\nc\nd"),
    ("<header>Site</header><article><p>Text</p><div class='x comments'>Nice</div><div class='ad'>Buy</div><form>Mail</form><footer>By</footer></article><p>Outside</p>", "Text"),
    ("<article><p>a<textarea>t</textarea>b</p><svg><text>s</text></svg><noscript>n</noscript></article>", "a\nb"),
]


def test_html_odd_pages(spark):
    df = spark.createDataFrame([(n, f"http://h{n}.example/", h) for n, (h, _) in enumerate(ODD_PAGES)] + [(None, None, None)], "page_id long, url string, html string")
    assert rows(html_text.extract(df).select("page_id", "text")) == sorted([(n, t) for n, (_, t) in enumerate(ODD_PAGES)] + [(None, "")], key=repr)


def test_html_repeats_against_brute_force(spark):
    rng = random.Random(6)
    phrases = [[f"p{k}x{n}" for n in range(rng.randrange(3, 9))] for k in range(6)]
    pages = []
    for n in range(60):
        found = [sum((rng.choice(phrases) if rng.random() < 0.4 else [f"u{n}y{b}z{k}" for k in range(3)] for _ in range(3)), []) for b in range(rng.randrange(1, 4))]
        pages.append(("large" if n < 50 else f"small{n // 4}", found))
    pages += [pages[0], pages[7]]  # published twice
    want = []
    for host, found in pages:
        streams = {tuple(sum(b, [])) for h, b in pages if h == host}
        grams = Counter(g for s in streams for g in {s[i : i + 4] for i in range(len(s) - 3)})
        tokens = [(b, w) for b, block in enumerate(found) for w in block]
        gone = set()
        for i in range(len(tokens) - 3):
            if grams[tuple(w for _, w in tokens[i : i + 4])] >= max(2, min(3, len(streams))):
                gone.update(range(i, i + 4))
        left = [" ".join(w for i, (c, w) in enumerate(tokens) if c == b and i not in gone) for b in range(len(found))]
        want.append("\n".join(x for x in left if x))
    df = spark.createDataFrame([(n, f"http://{h}.example/{n}", "".join(f"<div>{' '.join(b)}</div>" for b in found)) for n, (h, found) in enumerate(pages)], "page_id long, url string, html string")
    for chunk in (40, 10_000):
        got = html_text.extract(df, min_tokens=4, min_pages=3, chunk_tokens=chunk)
        assert [r.text for r in got.orderBy("page_id").collect()] == want


def test_suffix_ranks_sort_suffixes():
    rng = np.random.default_rng(3)
    tokens, pages = rng.integers(0, 3, 200), np.array([50, 1, 80, 69])
    ends = np.repeat(np.cumsum(pages), pages)
    got = html_text.suffix_ranks(tokens, ends - np.arange(200), 6)
    prefix = [tuple(tokens[i : min(i + 6, ends[i])]) for i in range(200)]
    order = {p: n + 1 for n, p in enumerate(sorted(set(prefix)))}
    assert got.tolist() == [order[p] for p in prefix]


def test_html_articles_are_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r, p in zip(html_text.extract(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)
        want = [re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"<(?:/?p|br|/?h1)>", body[1])]
        assert r.text == "\n".join(x for x in want if x)


def test_topk_prunes_groups_that_lie_apart(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 1, (8, 6)) * 50
    vectors = [(n, (middle[n % 8] + rng.normal(0, 0.05, 6)).tolist()) for n in range(800)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    for pool in (0.0, 0.5):
        topk.POOLED = pool
        try:
            assert rows(topk.top_k(df, F.col("vec_id") % 50 == 0)) == sorted(brute_top(stored, lambda i: i % 50 == 0, 5), key=repr)
        finally:
            topk.POOLED = 0.5


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline

    docs = awkward(spark, "doc_id long, text string, source string, lang string, key string, n_chars int").withColumn("row", F.lit("r"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
        assert {r.text for r in out.collect()} <= {"a b", None, "a  b", "", "a"}  # the mix cuts a text at its source's budget
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 5


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    texts = {r.doc_id: r.text for r in kept.collect()}
    ids = sorted(texts)
    unique = {}
    for i in ids:
        unique.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", texts[i]), i)
    after = corpus_pipeline.STAGES[1][1](spark, kept, SF)
    assert sorted(r.doc_id for r in after.collect()) == sorted(unique.values())
    left = sorted(unique.values())
    classes = {left[c] for _, c in brute_near([texts[i] for i in left])}
    near = corpus_pipeline.STAGES[2][1](spark, after, SF)
    assert {r.doc_id for r in near.collect()} == classes
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, near, SF).columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    mixed = corpus_pipeline.STAGES[3][1](spark, near, SF)
    want = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in out.collect()) == want


def test_release_deletes_what_operators_wrote(spark):
    import os

    from sparrowmill.llm import common

    common.release(spark)
    docs = docs_of(spark, ["a b c", "a b c", "long text " * 20])
    assert repeats.remove_repeats(docs).count() == 3 and exact_dedup.classes(docs).count() == 3
    folders, tables = [p.removeprefix("file://") for p in common._WRITTEN], list(common._TABLES)
    assert folders and tables and all(map(os.path.exists, folders))
    common.release(spark)
    assert not any(map(os.path.exists, folders)) and not any(map(spark.catalog.tableExists, tables))
