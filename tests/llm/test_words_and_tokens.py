"""Runs, token counts, spelling variants, licence gates and pages: against brute force, libraries and SQL."""

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparrowmill.llm import exact_dedup, html_text, licenses, mixing, periodic, queries, spelling, token_counts

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, source string, id string, key string, runs int, `a.b` int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def awkward(spark):
    """Nulls, repeated rows, an empty text, and extra columns named like inner ones."""
    data = [(1, "a b", None, None, "k", None, 1), (1, "a b", None, None, "k", None, 1), (None, None, "s", "x", None, 1, None), (None, "a  b", "s", None, None, 2, 2), (3, "", "s", "y", "z", 3, 3)]
    return spark.createDataFrame(data, ODD)


def brute_runs(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 3 * q):
                found.setdefault((start, i + q), q)
            i = i + 1 if i == start else i
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words, goal = [], rng.randint(0, 200)
            while len(words) < goal:
                if rng.random() < 0.5:
                    block = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 12))]
                    words += block * rng.randint(1, 6) + block[: rng.randint(0, len(block))]
                else:
                    words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))]
            texts.append(words)
        least = rng.choice([24, 24, 12, 6])
        assert periodic.find_runs(texts, least) == [brute_runs(t, least) for t in texts]


def test_runs_of_long_texts_take_no_quadratic_time():
    began = datetime.datetime.now()
    assert periodic.find_runs([["a"] * 200_000]) == [[(0, 200_000, 1)]]
    lines = [w for n in range(10_000) for w in [f"l{n}", *[f"c{k}" for k in range(20)]]]  # one line, each time after another word
    assert periodic.find_runs([lines]) == [[]]
    assert (datetime.datetime.now() - began).total_seconds() < 30


def expected_op11(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, n, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in docs] + [(-5, "x \x0b y z " * 30), (10**12, None)]
    df = spark.createDataFrame(short, "doc_id long, text string")
    got = rows(periodic.digest(periodic.scan(periodic.plant(df))))
    assert got == sorted((expected_op11(i, t) for i, t in short), key=repr)
    assert sum(r[2] > 0 for r in got) > 10


def test_runs_edges(spark):
    got = periodic.scan(awkward(spark)).select("doc_id", "n_words", "collapsed")
    assert rows(got) == sorted([(1, 2, "a b")] * 2 + [(None, 0, ""), (None, 2, "a b"), (3, 0, "")], key=repr)
    assert rows(periodic.plant(awkward(spark)).where("doc_id IS NULL")) == [(None, ""), (None, "a  b")]
    assert periodic.digest(periodic.scan(awkward(spark).limit(0))).count() == 0
    tie = periodic.scan(spark.createDataFrame([(1, "a " * 30 + "q " + "b " * 30)], "doc_id long, text string"))
    assert tie.select(periodic.strongest("runs").alias("r")).first().r.asDict() == {"start": 0, "length": 30, "period": 1}


@pytest.fixture(scope="module")
def pieces():
    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_file())
    return model, token_counts.Counter(token_counts.load_scores(queries.piece_file()))


ALPHABET = ["a", "e", "t", "h", "s", "ion", " ", "  ", "   ", "\n", "\t", "▁", "é", "漢", "😀", "th", "ing", "Q", "1", "0", ".", "--", "<s>", "<unk>", "<0x41>", "\x00", "и", "ция", "ß", "        ", "=", " ", "ﬁ"]


def test_prefix_counts_equal_the_library(pieces):
    model, counter = pieces
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25)))
        units = counter.units_of(text)
        want = [len(model.encode(text[:i])) for i in range(1, len(text) + 1)]
        assert list(counter.prefixes(units)) == want and counter.total(units) == (want[-1] if want else 0)
        for budget in (0, 1, 3, 7, 100):
            assert counter.within(units, budget) == max([0, *[i + 1 for i, c in enumerate(want) if c <= budget]])
    for text in ("x" * 20_000, "ab" * 9_000 + "é" * 500, "́" * 300):
        assert counter.total(counter.units_of(text)) == len(model.encode(text))


def test_counts_of_all_characters(pieces):
    model, counter = pieces
    for start in [*range(1, 0xD800, 7), *range(0xE000, 0x20000, 61)]:
        text = "a" + chr(start) + "b"
        assert counter.total(counter.units_of(text)) == len(model.encode(text)), hex(start)


def test_forgetting_changes_nothing(pieces, monkeypatch):
    model, _ = pieces
    for name, value in (("MOST_UNITS", 5), ("MOST_PAIRS", 20), ("MOST_STEMS", 3), ("SHORT", 6)):
        monkeypatch.setattr(token_counts, name, value)
    small, rng = token_counts.Counter(token_counts.load_scores(queries.piece_file())), random.Random(4)
    for _ in range(200):
        text = " ".join("".join(rng.choice(ALPHABET) for _ in range(6)) for _ in range(8))
        assert small.total(small.units_of(text)) == len(model.encode(text))


def test_op12_and_stored_prefixes(spark, pieces):
    model, _ = pieces
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in token_counts.count(docs, queries.piece_file(), 500).collect()}
    for i, t in texts.items():
        n = len(model.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 500)
        assert len(model.encode(t[: got[i].limit_chars])) <= 500 and (n <= 500) == (got[i].limit_chars == len(t))
    table = token_counts.prefix_table(docs.where("doc_id < 20"), queries.piece_file(), block=100).cache()
    asked = [(i, n) for i in range(20) for n in (0, 1, 99, 100, 101, 350, 10**7)]
    for r in token_counts.tokens_at(table, spark.createDataFrame(asked, "doc_id long, n_chars long"), block=100).collect():
        assert r.n_tokens == (len(model.encode(texts[r.doc_id][: r.n_chars])) if r.n_chars <= len(texts[r.doc_id]) else None)
    for r in token_counts.longest_within(table, spark.createDataFrame([(i, b) for i in range(20) for b in (0, 1, 40, 10**6)], "doc_id long, budget int"), block=100).collect():
        t = texts[r.doc_id]
        assert len(model.encode(t[: r.n_chars])) <= r.budget and (r.n_chars == len(t) or len(model.encode(t[: r.n_chars + 1])) > r.budget)


def test_counts_edges(spark, tmp_path):
    got = token_counts.count(awkward(spark), queries.piece_file(), 1)
    assert rows(got) == sorted([(1, 3, 2, True, 1)] * 2 + [(None, 0, 0, False, 0), (None, 4, 3, True, 1), (3, 0, 0, False, 0)], key=repr)
    assert token_counts.count(awkward(spark).limit(0), queries.piece_file()).count() == 0
    assert rows(token_counts.prefix_table(awkward(spark).where("doc_id = 3"), queries.piece_file()))[0][2] == []


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_words_equal_brute_force(monkeypatch):
    rng = random.Random(3)
    for leaf in (64, 4, 1):
        monkeypatch.setattr(spelling, "LEAF", leaf)
        for _ in range(12):
            n, letters = rng.choice([3, 7, 8]), "abcxyzàÿ"[: rng.choice([2, 4, 8])]
            some = lambda k, most: sorted({"".join(rng.choice(letters) for _ in range(k)) for _ in range(most)})
            data = some(n, rng.choice([5, 300]))
            for k in (n, n - 1):
                asked = some(k, rng.choice([5, 200]))
                q, d = spelling.near_words(data, asked)
                assert sorted(zip(q.tolist(), d.tolist(), strict=True)) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(data) if near(a, b)]


def test_long_words_and_anagrams():
    a, b = "ab" * 200 + "c", "ab" * 200
    assert [x.tolist() for x in spelling.near_words([a, "ba" * 200 + "c"], [b])] == [[0], [0]]
    rng = random.Random(6)
    grams = sorted({"".join(rng.sample("aabbccdd", 8)) for _ in range(900)})  # one point with more words than a leaf
    asked = sorted({g[:3] + "z" + g[4:] for g in grams[::9]} | {g[:5] + g[6:] for g in grams[::9]})
    for k in (7, 8):
        some = [w for w in asked if len(w) == k]
        q, d = spelling.near_words(grams, some)
        assert sorted(zip(q.tolist(), d.tolist(), strict=True)) == [(i, j) for i, x in enumerate(some) for j, y in enumerate(grams) if near(x, y)]


def test_cells_reach_all_near_words(spark, monkeypatch):
    """Many small cells, some of them cut into parts, find the same as one."""
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(7, 9))) for _ in range(120)]
    noisy = [w[:k] + rng.choice("abcz") + w[k + rng.randint(0, 1) :] for w in base for k in rng.sample(range(len(w)), 3)]
    words = sorted({w for w in base + noisy if len(w) >= 7})
    df = spark.createDataFrame([(w, rng.choice([2, 3, 40])) for w in words], "word string, n long")
    n = {r.word: r.n for r in df.collect()}
    want = {}
    for w in words:
        found = [v for v in words if near(w, v)]
        if found:
            best = min(found, key=lambda v: (-n[v], v))
            want[w] = (len(found), best, n[best])
    for cell, most in ((8192, 65536), (20, 65536), (20, 6)):
        monkeypatch.setattr(spelling, "CELL", cell)
        monkeypatch.setattr(spelling, "MOST", most)
        got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.near_counts(df).collect()}
        assert got == want


def test_op13_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    want = sorted(map(tuple, con.sql(queries.oracle_sql()["op13_spelling"]).select(*columns).fetchall()), key=repr)
    assert rows(queries.op13_spelling(spark, SF).select(*columns)) == want and any(r[1] for r in want)


def test_words_and_chains(spark):
    counts = {"rightword": 3000, "rightwosd": 200, "rihtwosd": 15, "ritwosd": 1, "àéîõüñç": 2, "aéîõüñç": 3}
    text = " ".join(w for w, n in counts.items() for _ in range(n)) + " Short RIGHTWORD Éàéîõüñ1Éàéîõüñ"
    docs = spark.createDataFrame([(1, text, "x"), (1, None, "y"), (None, "", None)], "doc_id long, text string, word string")
    got = {r.word: r for r in spelling.variants(docs, noise=0).collect()}
    assert set(got) == {"rightword", "rightwosd", "rihtwosd", "àéîõüñç", "aéîõüñç", "Éàéîõüñ"} and got["rightword"].n == 3001
    assert [got[w].form for w in ("rightword", "rightwosd", "rihtwosd", "aéîõüñç")] == [None, "rightword", "rightwosd", None]
    assert got["rihtwosd"].root == "rightword" and got["rihtwosd"].form_n == 200 and got["àéîõüñç"].n_near == 1
    assert spelling.variants(docs.limit(0)).count() == 0
    made = Counter()
    for i, w in [(1, "rightword"), (None, "rightword"), (7, "abcdefgh")]:
        h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
        made[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w] += 2
    noisy = spelling.count_words(spark.createDataFrame([(1, "RightWord rightword"), (None, "rightword\nrightword"), (7, "abcdefgh abcdefgh")], "doc_id long, text string"), noise=3)
    assert dict(rows(noisy)) == {w: n for w, n in made.items() if len(w) >= 7}


def expansions(regex):
    """Matches of a rule with each optional part in and out, one part at a time, and each branch once."""
    from re import _parser

    def texts(tokens, choose):
        out = ""
        for op, arg in tokens:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += chr(next(x[1] if str(x[0]) == "LITERAL" else x[1][0] for x in arg))
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                out += texts(inner, choose) * (high if choose((id(arg), "opt"), 2) and high != _parser.MAXREPEAT else max(low, int(choose((id(arg), "opt"), 2))))
            elif name == "SUBPATTERN":
                out += texts(arg[3], choose)
            elif name == "BRANCH":
                out += texts(arg[1][choose((id(arg), "br"), len(arg[1]))], choose)
            else:
                raise AssertionError(name)
        return out

    tokens, sizes = _parser.parse(regex), {}
    texts(tokens, lambda key, n: sizes.setdefault(key, n) and 0)
    texts(tokens, lambda key, n: sizes.setdefault(key, n) and n - 1)
    made = {texts(tokens, lambda key, n: 0), texts(tokens, lambda key, n: n - 1)}
    for one, n in sizes.items():
        for value in range(n):
            made |= {texts(tokens, lambda key, m, one=one, value=value, rest=rest: value if key == one else (m - 1) * rest) for rest in (0, 1)}
    return made


def test_licence_gates_lose_no_match(spark):
    """Texts made from every rule with each optional part in and out: rules without gates find the same."""
    table = licenses.rules()
    every = sorted({t for r in table for t in expansions(re.search(r"\(\((\?:.*)\)\)\(\?= \)$", r["regex"])[1][2:])})
    assert {"agpl3", "lgpl2", "agpl 3"} <= set(every) and len(every) > len(table)
    df = spark.createDataFrame([(n, f"under {t}, so") for n, t in enumerate(every)], "doc_id long, text string").repartition(8)
    shown = lambda t, d: rows(licenses.scan(d, table=t).select("doc_id", "rule", "label", "first", "last"))
    got = shown(table, df)
    assert got == shown([r | {"keyword": "anyhow", "gate": "anyhow"} for r in table], df.withColumn("text", F.concat("text", F.lit(" anyhow"))))
    assert {n for n, *_ in got} == set(range(len(every)))


def test_licence_labels_and_score_equal_brute_force(spark):
    table, rng = licenses.rules(), random.Random(8)
    samples = [t for r in table[::5] for t in sorted(expansions(re.search(r"\(\((\?:.*)\)\)\(\?= \)$", r["regex"])[1][2:]))[:2]]
    texts = [" ".join(rng.choice([*rng.sample(samples, 3), "some other words", "the", "license"]) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_digest(df).collect()}
    for n, t in enumerate(texts):
        words = " " + t + " "
        places = [(words[: m.start()].count(" ") - 1, words[: m.end()].count(" ") - 1, r) for r in table for m in re.finditer(r["regex"], words)]
        places.sort(key=lambda x: (x[0], -x[1], x[2]["rule"]))
        reach, kept = -1, []
        for _, last, r in places:
            if last > reach:
                kept.append((r["label"], r["confidence"]))
            reach = max(reach, last)
        base = [licenses.BASE[p] for p in licenses.BASE if f" {p} " in words]
        want = ",".join(sorted({x for x, _ in kept} | set(base))), max([c for _, c in kept] + [0.9] * bool(base), default=0.0)
        assert got[n] == want, t


PAGES = [
    ("<article><i class='icon' aria-hidden='true'></i><p>Body</p></article>", "Body"),
    ("<article><a class='share' href='#'>Share</a><p>Story one.</p><p>Two.</p></article>", "Story one.\nTwo."),
    ("<article><p>Price <span class='ad'>x</span> is low.</p></article>", "Price is low."),
    ("<article><p>A</p><a class='related'>more</a><p>B</p><p>C</p></article>", "A\nB\nC"),
    ("<form id='aspnetForm'><article><p>Body</p></article></form>", "Body"),
    ("<body><form id='aspnetForm'><header>H</header><div><h1>Head</h1><p>Body</p></div></form>", "Head\nBody"),
    ("<article><form><input name=q><p>Mail</p></form><p>b</p></article>", "b"),
    ("<article><p>x</p><section class='article-comments'>c</section></article>", "x"),
    ("<article><p>x</p><div class='comments-area'><p>c</p></div><p>y</p></article>", "x\ny"),
    ("<article><p>x</p><ol class='commentlist'><li>c</ol></article>", "x"),
    ("<article><p>x</p><div class='google-ad'>c</div><div class='ad-banner'>d</div>y</article>", "x\ny"),
    ("<div id='sidebar-left'>s</div><p>t</p><div class='footer-links'>f</div>", "t"),
    ("<article><section id='comments-on-method'><p>kept</p></section><div class='no-sidebar'><p>k</p></div><h2 id='ad-hoc'>h</h2><div class='ad-hoc-net'>n</div></article>", "kept\nk\nh\nn"),
    ("<article><p>a <span class='ad'>x <span>y</span> z</span> b</p></article>", "a b"),
    ("<article><p>a <a class='share' href='#'>s <p>b</p></article>", "a s\nb"),
    ("<article><p>a <a class='share' href='#'>s <a href='/q'>b</a> c</p></article>", "a b c"),
    ("<article><p>a<i class='icon share' aria-hidden='true'/>b</p></article>", "ab"),
    ("<article><span class='ad'><div>x</div></span><p>b</p></article>", "b"),
    ("<article><p>The <b class='x'>bold</b> <em>em</em></p></article>", "The bold em"),
    ("<div class='container sidebar-wrapper'><p>b</p></div>", "b"),
    ("<article><p>one <span style='display: none'>two</span><time class='t'>three</time></p></article>", "one three"),
    ("<article><p><span hidden>x</span>" + "w " * 50_000 + "</p></article>", ("w " * 50_000).strip()),
]


def test_pages_as_they_are(spark):
    df = spark.createDataFrame([(n, f"http://h{n}.example/", h) for n, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    assert rows(html_text.extract(df).select("page_id", "text")) == sorted([(n, t) for n, (_, t) in enumerate(PAGES)], key=repr)


def test_names_with_dots_pass_the_stages(spark):
    docs = awkward(spark)
    assert exact_dedup.drop_copies(docs).columns == docs.columns and exact_dedup.drop_copies(docs).select("`a.b`").count() > 0
    assert mixing.mix_rows(docs).columns == docs.columns and {r[0] for r in mixing.mix_rows(docs).select("`a.b`").collect()} <= {1, 2, 3, None}


def an_article(*texts, menu="m"):
    return f"<nav>{menu}</nav><article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article><footer>f</footer>"


def prose(name, n):
    return " ".join(f"{name}w{k}" for k in range(n))


def test_repeats_of_the_host_are_cut_out_of_articles(spark):
    notice = "Sign up for our letter and read all news of the day first"
    pages = [("a", [prose(f"a{n}", 30), notice, f"end {n}"], [0, 2]) for n in range(6)]
    pages.append(("a", [prose("a0", 30), notice, "end 0"], [0, 2]))  # published twice
    pages += [("a", [notice], [0]), ("a", [f"{notice} {prose('own', 12)}", prose("x", 15)], [0, 1]), ("a", [prose("y", 15), "end 9"], [0, 1])]
    pages += [("b", [prose("b", 20), prose("c", 20), prose("d", 20 - n)], [0, 1, 2]) for n in range(6)]  # near copies
    pages += [("c", [prose("b", 20), prose("c", 20)], [0, 1])] * 5  # copies
    pages += [("d", [prose(f"d{n}", 20), notice if n < 3 else prose(f"e{n}", 20)], [0, 1]) for n in range(8)]  # quoted by three of eight
    pages += [("e", [prose(f"e{n}", 20), notice], [0, 1]) for n in range(2)]
    df = spark.createDataFrame([(n, f"http://{h}.example/{n}", an_article(*texts, menu=str(n))) for n, (h, texts, _) in enumerate(pages)], "page_id long, url string, html string")
    got = html_text.extract(df).orderBy("page_id").collect()
    assert [r.text for r in got] == ["\n".join(texts[k] for k in kept) for _, texts, kept in pages]
    assert [r.n_repeated for r in got] == [len(texts) - len(kept) for _, texts, kept in pages]


def test_repeats_in_articles_against_brute_force(spark):
    rng = random.Random(12)
    notices = [prose(f"n{k}", rng.randrange(3, 8)) for k in range(4)] + [prose("n0", 4) + " " + prose("n1", 4)]
    pages = []
    for n in range(70):
        texts = [prose(f"u{n}b{b}", rng.randrange(2, 30)) for b in range(rng.randrange(0, 4))] + [x for x in notices if rng.random() < 0.6]
        rng.shuffle(texts)
        pages.append(("large" if n < 40 else f"small{n // 8}", texts))
    pages += pages[:9] + [("large", [*pages[0][1], f"more {n}"]) for n in range(5)]
    starts = []  # of each page: block, string at its start, minima of the others
    for _, texts in pages:
        code, _, (of, k0, k1, rest) = html_text._article_starts([[(n, t.encode()) for n, t in enumerate(texts)]], 4)
        starts.append((int(code[0]), [(int(b), (int(x), int(y)), int(r)) for b, x, y, r in zip(of, k0, k1, rest, strict=True)]))
    want = []
    for (host, texts), (_, own) in zip(pages, starts, strict=True):
        there = {code: (t, found) for (h, t), (code, found) in zip(pages, starts, strict=True) if h == host and found}
        share = max(3, -(-len(there) // 2))
        draws = {}
        for _, found in there.values():
            for key, r in {k: min(r for _, q, r in found if q == k) for _, k, _ in found}.items():
                draws.setdefault(key, []).append([(r >> 16 * j) & 0xFFFF for j in range(4)])
        hot = {k for k, v in draws.items() if len(v) >= share and len(v) ** 2 >= 3 * max(sum(c * c for c in Counter(x).values()) for x in zip(*v, strict=True))}

        def picked(t, found, hot=hot):
            out = [b for b, k, _ in found if k in hot]
            return [] if len(out) == len(t) else out

        grams = Counter()
        for t, found in there.values():
            w = " ".join(t[b] for b in picked(t, found)).split()
            grams.update({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
        chosen = picked(texts, own)
        w = [(b, x) for b in chosen for x in texts[b].split()]
        gone = {i + j for i in range(len(w) - 3) if grams[tuple(x for _, x in w[i : i + 4])] >= share for j in range(4)}
        cut = {b for b in chosen if all(i in gone for i, (c, _) in enumerate(w) if c == b)}
        want.append("\n".join(t for n, t in enumerate(texts) if n not in cut))
    assert sum("\n".join(t) != x for (_, t), x in zip(pages, want, strict=True)) > 20
    df = spark.createDataFrame([(n, f"http://{h}.example/{n}", an_article(*texts)) for n, (h, texts) in enumerate(pages)], "page_id long, url string, html string")
    for chunk in (30, 10_000):
        got = html_text.extract(df, min_tokens=4, min_pages=3, chunk_tokens=chunk).orderBy("page_id").collect()
        assert [r.text for r in got] == want
