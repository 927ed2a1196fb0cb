"""HTML extraction with boilerplate found by a host suffix array.

A page is cut into blocks of text in page order. A block in the page's article (an article or main element, or one
with that role) belongs to the main text, unless it sits in an element whose name, role or class says menu, footer,
sidebar, notice, advert, form, comment or the like. Scripts, styles and markup are no text at all. What else is
boilerplate, in articles and on pages without one, the repeats of the host decide.

The blocks outside articles make a page's token stream, those of its article another. The streams of a host's pages are put
behind each other and the suffixes of the whole are sorted by prefix doubling to MIN_TOKENS tokens; an interval of suffixes that
agree so far is a string that repeats.

On a page without an article, strings that stand outside articles on at least MIN_PAGES distinct pages (on both, where a host
has but two) are boilerplate, and the runs of tokens that they cover, so all longer repeats, are cut out; what is left of a
block, its unique runs, stays. Pages with equal streams count as one page, so that a page published twice keeps its text.

In an article a repeat may also be a passage that is quoted or an article that is published again, with changes or without, and
those are no boilerplate. So a block of an article goes only as a whole, and only if the host's template puts it there: its first
MIN_TOKENS tokens begin a block in at least MIN_PAGES articles and at least half of the host's, these articles differ in what else
they hold, and strings in as many articles cover all of the block. Articles with equal tokens count as one. How far articles
differ is told by four minima of hashed 3-token shingles over their other blocks: n articles with c_v times the value v are alike
as n * n / sum(c_v * c_v) different ones (the least of the four), so near copies count as little more than one. Articles that hold
nothing else stay whole, and blocks of fewer than MIN_TOKENS tokens in an article are not judged. As the first tokens must repeat,
suffixes at the starts of blocks are counted first, and only blocks that pass enter the suffix array.

A host's stream is dealt to chunks of about CHUNK_TOKENS tokens by page, and chunks of small hosts share a task. A chunk
sends each of its intervals once, with the number of its pages, so no task holds a large host, and gets back those that
repeat over the host. Strings are compared by 128 bits of their tokens' hashes.

Cases: null html is an empty page; null urls share one host; null page ids are pages of their own; rows that repeat
a page are one page to each other. Broken or cut markup is read as far as it goes: head ends with the first element of a body,
elements that are never closed end with their parent, and those that hide what they hold (select, form and so on) then hide nothing.
A form that wraps the page's structure hides nothing either. Marked elements within a line (icons, share links) go, the block around
them stays one.
Ids are read as long. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textkit import U, arrow_rows, batches, mix, pack, shingles, words

MIN_TOKENS = 10
MIN_PAGES = 3
CHUNK_TOKENS = 400_000
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z/!?][^>]*$", re.S | re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_IN_HEAD = frozenset("title base link meta style script noscript template".split())
#: These hide what they hold, if an end tag follows.
_HIDDEN = frozenset("title noscript template svg iframe textarea select option object canvas nav footer aside form button menu dialog fieldset".split())
_BAD_TAGS = _HIDDEN | {"head"}
_MAIN_TAGS = frozenset(("article", "main"))
_BAD_ROLES = frozenset("navigation contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Whole class names and ids, within an article and without.
_BAD_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo comment comments comment-list comments-section comment-section disqus disqus_thread replies reply respond newsletter subscribe signup login form search-form nav navbar navigation menu sidebar cookie cookies cookie-banner cookie-notice consent gdpr popup modal notice share sharing social breadcrumb breadcrumbs related recommended pagination pager toolbar skip-link".split())
#: Names that say so outside an article only, where a header is the page's.
_OUTER_NAMES = frozenset("header footer banner widget side aside masthead site-header site-footer page-header page-footer main-nav main-menu site-nav top-nav".split())
#: In elements that hold blocks, a class whose first or last part (at - or _) is one of these says so, too, unless another part
#: makes it the name of a layout or of a subject. Ids are often made from headings, so theirs count outside articles only.
_BAD_PARTS = frozenset("ad ads advert adverts advertisement comment comments commentlist sidebar newsletter cookie cookies breadcrumb breadcrumbs pagination".split())
_OUTER_PARTS = frozenset("footer nav navbar menu".split())
_NO_PARTS = frozenset("no not non has have had with without hide show layout page main content container wrapper wrap row col grid body free hoc lib infinitum recipe recipes".split())
_HOLDERS = frozenset("div section ul ol dl aside table figure center".split())
_OUTER_TAGS, _OUTER_ROLES = frozenset(("header",)), frozenset(("banner",))
#: These hide nothing if the page's structure stands in them, as where one form wraps the whole page.
_WRAPPING = frozenset("form fieldset object dialog".split())
_STRUCTURE = re.compile(r"<(?:article|main|header|footer|nav|h1)\b|role\s*=\s*[\"']?(?:main|article)\b", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACES = re.compile(r"\s+")


def _marked(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Is this element boilerplate; is it an article? inside: does it stand in an article."""
    bad, article = tag in _BAD_TAGS or (tag in _OUTER_TAGS and not inside), tag in _MAIN_TAGS
    if not attributes.strip():
        return bad, article
    values = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
    role = values.get("role", "").lower()
    names = {*values.get("class", "").lower().split(), *values.get("id", "").lower().split()}
    hidden = values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "") or re.search(r"\shidden(?:[\s=/]|$)", attributes) is not None
    named = tag not in ("html", "body") and bool(names & _BAD_NAMES or (names & _OUTER_NAMES and not inside))
    if tag in _HOLDERS and not named:
        parted = names if not inside else set(values.get("class", "").lower().split())
        parts = [x for x in (re.split(r"[-_]+", n) for n in parted) if not _NO_PARTS.intersection(x)]
        ends = {e for x in parts for e in (x[0], x[-1])}
        named = bool(ends & _BAD_PARTS or (ends & _OUTER_PARTS and not inside))
    return bad or named or hidden or role in _BAD_ROLES or (role in _OUTER_ROLES and not inside), article or role in ("main", "article")


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) in page order; kind 2: main text, 1: outside any article, 0: boilerplate by its element."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, boilerplate, article, boilerplate within a block
    bad = main = cut = 0
    ends: dict[str, int] = {}

    def close() -> None:
        if held:
            text = _SPACES.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, 0 if bad else 2 if main else 1))

    def leave(name: str) -> None:
        nonlocal bad, main, cut
        while stack:
            inner, is_bad, is_main, is_cut = stack.pop()
            bad, main, cut = bad - is_bad, main - is_main, cut - is_cut
            if inner == name:
                break

    def closed(tag: str, at: int) -> bool:
        """Does an end tag follow?"""
        if tag not in ends:
            ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return ends[tag] > at

    def wraps(tag: str, at: int) -> bool:
        """Does the page's structure stand inside this element?"""
        end = re.compile(rf"</{tag}\b", re.I).search(page, at)
        return _STRUCTURE.search(page, at, end.start() if end else len(page)) is not None

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at and not cut:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if inline and not m[4].strip() and not (cut and any(x[0] == tag for x in stack)):
            continue  # nothing marks it, and no element of its name has to be counted
        if m[2]:
            if not inline:
                close()
            if any(x[0] == tag for x in stack):
                leave(tag)
            continue
        if tag not in _IN_HEAD and any(x[0] == "head" for x in stack):
            close()
            leave("head")
        if tag in _VOID or (tag in _HIDDEN and not closed(tag, at)):
            if not inline:
                close()
            continue
        is_bad, is_main = _marked(tag, m[4], main > 0)
        if is_bad and tag in _WRAPPING and wraps(tag, at):
            is_bad = False
        ends_itself = m[4].rstrip().endswith("/")
        if inline:  # the block goes on around it; what a marked one holds is left out
            if tag == "a" and cut and any(x[0] == "a" for x in stack):
                leave("a")
            if ends_itself or not (is_bad or (cut and any(x[0] == tag for x in stack))) or not closed(tag, at):
                continue
            stack.append((tag, False, False, is_bad))
            cut += is_bad
            continue
        close()
        if tag == "p" and stack and stack[-1][0] == "p":
            leave("p")
        if not ends_itself:
            stack.append((tag, is_bad, is_main, False))
            bad, main = bad + is_bad, main + is_main
    if at < len(page) and not cut:
        held.append(page[at:])
    close()
    return out


def _read(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    page = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), page.alias("html"), F.xxhash64(page).alias("code"))


def page_streams(rows: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """id, url, code, host, page, tokens, blocks, article, starts: the streams of each page that has some.

    tokens: the hash of each token outside articles; page: one of that stream. blocks: for a page that is to be judged, each token's
    block, or -1 where its element makes it boilerplate already; empty for pages with an article. article: a hash of the article's
    tokens; starts: of each block of min_tokens tokens in it the string that it starts with, and the minima of the other blocks.
    """

    def run(record_batches):
        for held in batches(arrow_rows(record_batches, "id", "url", "html", "code"), lambda r: len(r[2]), 4 << 20):
            streams, of_block, articles = [], [], []
            for _, _, page, _ in held:
                found = blocks(page)
                articles.append([(n, t.encode("utf-8")) for n, (t, k) in enumerate(found) if k == 2])
                outside = [(n if k else -1, t) for n, (t, k) in enumerate(found) if k < 2]
                streams.append(" ".join(t for _, t in outside).encode("utf-8"))
                judged = any(n >= 0 for n, _ in outside) and len(outside) == len(found)
                of_block.append(np.repeat([n for n, _ in outside], [len(t.split(" ")) for _, t in outside]) if judged else np.zeros(0, np.int64))
            owner, h, _ = words(*pack(streams))
            edge = np.searchsorted(owner, np.arange(len(held) + 1))
            edges = [pa.array(edge, pa.int32()), pa.array(np.concatenate([[0], np.cumsum([len(x) for x in of_block])]), pa.int32())]
            page = _stream_codes(h, edge).view(np.int64)
            article, count, starts = _article_starts(articles, min_tokens)
            starts = [pa.array(x.astype(t)) for x, t in zip(starts, (np.int32, np.int64, np.int64, np.int64), strict=True)]
            begin = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.string()), pa.array([r[3] for r in held], pa.int64()), pa.array(page),
                 pa.ListArray.from_arrays(edges[0], pa.array(h.view(np.int64))), pa.ListArray.from_arrays(edges[1], pa.array(np.concatenate(of_block).astype(np.int32))),
                 pa.array(article), pa.ListArray.from_arrays(begin, pa.StructArray.from_arrays(starts, ["block", "k0", "k1", "rest"]))],
                ["id", "url", "code", "page", "tokens", "blocks", "article", "starts"],
            )

    made = rows.mapInArrow(run, "id long, url string, code long, page long, tokens array<long>, blocks array<int>, article long, starts array<struct<block:int,k0:long,k1:long,rest:long>>")
    return made.where((F.size("tokens") > 0) | (F.size("starts") > 0)).select("id", "url", "code", _host("url").alias("host"), "page", "tokens", "blocks", "article", "starts")


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _stream_codes(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A hash of each stream's tokens in order; edge: where each stream starts, and the end."""
    count = np.diff(edge)
    place = np.arange(len(h)) - np.repeat(edge[:-1], count)
    sums = np.concatenate([[U(0)], np.cumsum(mix(h * _ODD + place.astype(U)), dtype=U)])
    return mix(sums[edge[1:]] - sums[edge[:-1]] + count.astype(U))


def _string_keys(h: np.ndarray, head: np.ndarray, depth: int) -> np.ndarray:
    """128 bits of the strings of `depth` tokens from each head on."""
    keys = np.zeros((len(head), 2), U)
    for k in range(depth):
        for c in (0, 1):
            keys[:, c] = mix(keys[:, c] + h[head + k] * _ODD + U(2 * k + c))
    return keys


def _article_starts(articles: list[list[tuple[int, bytes]]], min_tokens: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Of the blocks of each article: a hash of its tokens, how many blocks have min_tokens tokens, and their block, k0, k1, rest.

    k0, k1: the string at a block's start; rest: 4 x 16 bits of the minima of the article's other blocks.
    """
    flat = [b for a in articles for b in a]
    size = np.array([len(a) for a in articles], np.int64)
    hashes, count, least = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros((4, 0), U)]
    for part in batches(flat, lambda b: len(b[1]), 1 << 20):
        owner, h, _ = words(*pack([t for _, t in part]))
        hashes.append(h)
        count.append(np.bincount(owner, minlength=len(part)))
        of, s = shingles(owner, h, 3)
        order = np.argsort(of, kind="stable")
        s, first = s[order], np.flatnonzero(np.diff(of[order], prepend=-1))
        least.append(np.stack([np.minimum.reduceat(mix(s + x), first) for x in _DRAWS]))
    h, count, least = np.concatenate(hashes), np.concatenate(count), np.concatenate(least, axis=1)
    edge = np.concatenate([[0], np.cumsum(count)])
    ends = np.concatenate([[0], np.cumsum(size)])
    long = np.flatnonzero(count >= min_tokens)
    rest = np.zeros((4, 0), U)
    if len(flat):
        some, article = ends[:-1][size > 0], np.repeat(np.arange((size > 0).sum()), size[size > 0])
        low = np.minimum.reduceat(least, some, axis=1)[:, article]
        lowest = least == low
        alone = lowest & (np.add.reduceat(lowest, some, axis=1, dtype=np.int64)[:, article] == 1)
        second = np.minimum.reduceat(np.where(lowest, U(0xFFFF_FFFF_FFFF_FFFF), least), some, axis=1)[:, article]
        rest = np.where(alone, second, low)[:, long]
    rest = np.bitwise_or.reduce([(rest[j] & U(0xFFFF)) << U(16 * j) for j in range(4)]).view(np.int64)
    keys = _string_keys(h, edge[long], min_tokens).view(np.int64)
    held = np.diff(np.searchsorted(long, ends))
    return _stream_codes(h, edge[ends]).view(np.int64), held, (np.array([n for n, _ in flat], np.int64)[long], keys[:, 0], keys[:, 1], rest)


def template_blocks(streams: DataFrame, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """host, code, article, chosen: the blocks whose start is the host's template's, by page; host, articles: how many it has."""
    key = ["host", "k0", "k1"]
    starts = streams.select("host", "code", "article", F.inline("starts"))
    articles = materialise(streams.where(F.size("starts") > 0).groupBy("host").agg(F.count_distinct("article").alias("articles")), "articles")

    def enough(counts: DataFrame) -> DataFrame:
        return counts.join(articles, "host").where((F.col("n") >= min_pages) & (2 * F.col("n") >= F.col("articles"))).drop("articles")

    rough = materialise(enough(starts.groupBy(key).agg(F.count("*").alias("n"))).select(key), "starts")  # equal articles count again here
    seen = starts.join(rough, key, "left_semi").groupBy(*key, "article").agg(F.min("rest").alias("rest"))
    often = enough(seen.groupBy(key).agg(F.count("*").alias("n")))
    drawn = seen.select(*key, F.posexplode(F.array(*[F.shiftright("rest", 16 * j).bitwiseAND(F.lit(0xFFFF)) for j in range(4)])).alias("draw", "v"))
    alike = drawn.groupBy(*key, "draw", "v").agg(F.count("*").alias("c")).groupBy(*key, "draw").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("same"))
    differ = alike.groupBy(key).agg(F.max("same").alias("same")).join(often, key).where(F.col("n").cast("double") * F.col("n") >= min_pages * F.col("same"))
    chosen = starts.join(differ.select(key), key, "left_semi").groupBy("host", "code", "article").agg(F.collect_set("block").alias("chosen"))
    return materialise(chosen, "chosen"), articles


def article_streams(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """id, url, code, host, page, tokens, blocks: the chosen blocks of articles; page: a hash of the article's tokens."""

    def run(record_batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        for held in batches(arrow_rows(record_batches, "id", "url", "code", "host", "article", "html", "chosen"), lambda r: len(r[5]), 1 << 20):
            out = []
            for *key, page, wanted in held:
                article = [(n, t) for n, (t, k) in enumerate(blocks(page)) if k == 2]
                picked = [(n, t.encode("utf-8")) for n, t in article if n in wanted]
                if 0 < len(picked) < len(article):  # else nothing would be left
                    owner, h, _ = words(*pack([t for _, t in picked]))
                    out.append((*key, h.view(np.int64), np.array([n for n, _ in picked], np.int32)[owner]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "url", "code", "host", "page", "tokens", "blocks"])

    found = rows.withColumn("host", _host("url")).join(chosen, ["host", "code"])
    return found.select("id", "url", "html", "code", "host", "article", "chosen").mapInArrow(run, "id long, url string, code long, host string, page long, tokens array<long>, blocks array<int>")


def suffix_ranks(tokens: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first `depth` tokens, by prefix doubling; room: tokens left on its page, from it on."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    known = 1
    while known < depth:
        step = min(known, depth - known)
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:]
        after[room <= step] = 0  # a page's end sorts first
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        known += step
    return rank


class _Stream:
    """The pages of a chunk behind each other, host by host, and the intervals of suffixes that agree in `depth` tokens."""

    def __init__(self, pages: pa.Table, depth: int):
        lists = pages.column("tokens").combine_chunks()
        count = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.start = np.concatenate([[0], np.cumsum(count)])
        h = lists.flatten().to_numpy().view(U)
        host = pages.column("host").combine_chunks().dictionary_encode()
        self.hosts, self.host = host.dictionary, host.indices.to_numpy()
        owner = np.repeat(np.arange(pages.num_rows), count)
        room = self.start[1:][owner] - np.arange(len(h))
        whole = room >= depth
        rank = suffix_ranks(mix(h + self.host[owner].astype(U) * _ODD), room, depth)
        at = np.flatnonzero(whole)
        self.at = at[np.argsort(rank[at], kind="stable")]  # the suffix array, short suffixes left out
        r = rank[self.at]
        self.first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
        self.interval = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(r))))
        head = self.at[self.first]
        self.keys = _string_keys(h, head, depth)
        page = np.unique(pages.column("page").to_numpy(), return_inverse=True)[1]
        self.inside = pages.column("inside").to_numpy(zero_copy_only=False).astype(bool)[owner[self.at]]
        self.pages, self.articles = (self._distinct(page[owner[self.at]], which, len(head)) for which in (~self.inside, self.inside))
        self.of_host = self.host[owner[head]]
        self.n = len(h)

    def _distinct(self, page: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """On how many pages each interval stands, of the suffixes that are meant."""
        most = int(page.max(initial=0)) + 1
        return np.bincount(np.unique(self.interval[which] * most + page[which]) // most, minlength=n)


_DRAWS = [U(x) for x in (0, 0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ODD = U(0x9E3779B97F4A7C15)


def repeated_runs(streams: DataFrame, articles: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """of_id, of_url, of_code, runs: the covered tokens of each judged page as (block, first token in it, end).

    streams say of each row whether it is inside an article; articles: the number of each host's.
    """
    sized = streams.groupBy("host", "page", "inside").agg(F.sum(F.size("tokens")).alias("n"))
    hosts = sized.groupBy("host").agg(F.sum("n").alias("n"), F.count_if(~F.col("inside")).alias("distinct")).join(articles, "host", "left")
    total = sized.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-total // chunk_tokens))
    hosts = materialise(hosts.select("host", F.ceil(F.col("n") / chunk_tokens).alias("cuts"), F.greatest(F.least("distinct", F.lit(min_pages)), F.lit(2)).alias("need"), F.greatest(F.ceil(F.col("articles") / 2), F.lit(min_pages)).alias("share")), "hosts")
    chunk = F.pmod(F.xxhash64("host", F.pmod("page", "cuts")), F.lit(tasks)).cast("int").alias("chunk")
    dealt = materialise(streams.join(hosts.select("host", "cuts"), "host").select(chunk, "id", "url", "code", "host", "page", "tokens", "blocks", "inside"), "dealt")

    def intervals(pages: pa.Table) -> pa.Table:
        s = _Stream(pages, min_tokens)
        return pa.table([pa.array(np.full(len(s.keys), pages.column("chunk")[0].as_py()), pa.int32()), s.hosts.take(pa.array(s.of_host)), *[pa.array(s.keys[:, c].view(np.int64)) for c in (0, 1)], pa.array(s.pages, pa.int64()), pa.array(s.articles, pa.int64())], ["chunk", "host", "k0", "k1", "n", "m"])

    found = materialise(dealt.groupBy("chunk").applyInArrow(intervals, "chunk int, host string, k0 long, k1 long, n long, m long"), "intervals")
    over, within = F.col("n") >= F.col("need"), F.col("m") >= F.col("share")
    many = found.groupBy("host", "k0", "k1").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).join(hosts.select("host", "need", "share"), "host").select("host", "k0", "k1", over.alias("over"), within.alias("within")).where("over or within")
    answers = found.select("chunk", "host", "k0", "k1").join(many, ["host", "k0", "k1"]).select("chunk", "host", "k0", "k1", "over", "within")

    def cover(pages: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"of_id": [], "of_url": [], "of_code": [], "runs": []}
        if pages.num_rows and answers.num_rows:
            s = _Stream(pages, min_tokens)
            said = zip(*[answers.column(c).to_pylist() for c in ("host", "k0", "k1", "over", "within")], strict=True)
            wanted = {tuple(k): (over, within) for *k, over, within in said}
            keys = zip(s.hosts.take(pa.array(s.of_host)).to_pylist(), *[s.keys[:, c].view(np.int64).tolist() for c in (0, 1)], strict=True)
            hit = np.array([wanted.get(k, (False, False)) for k in keys], bool)
            edge = np.zeros(s.n + 1, np.int64)
            spots = s.at[hit[s.interval, s.inside.astype(np.int64)]]
            np.add.at(edge, spots, 1)
            np.add.at(edge, spots + min_tokens, -1)
            covered = np.cumsum(edge)[:-1] > 0
            for n, (i, u, c, of_block, inside) in enumerate(zip(*[pages.column(x).to_pylist() for x in ("id", "url", "code", "blocks", "inside")], strict=True)):
                here = covered[s.start[n] : s.start[n + 1]]
                if of_block and here.any():
                    b = np.array(of_block)
                    begin = np.flatnonzero(np.diff(b, prepend=-2))
                    place = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
                    if inside:  # an article's block goes as a whole
                        here = np.repeat(np.logical_and.reduceat(here, begin), np.diff(np.append(begin, len(b))))
                    gone = here & (b >= 0)
                    same = np.concatenate([[False], gone[:-1] & (b[1:] == b[:-1])])
                    first, last = np.flatnonzero(gone & ~same), np.flatnonzero(gone & ~np.append(same[1:] & gone[1:], False))
                    if len(first):
                        for k, x in zip(out, (i, u, c, [{"block": int(b[f]), "first": int(place[f]), "end": int(place[e]) + 1} for f, e in zip(first, last, strict=True)]), strict=True):
                            out[k].append(x)
        kinds = (pa.int64(), pa.string(), pa.int64(), _RUNS)
        return pa.table([pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)], list(out))

    marks = dealt.where(F.size("blocks") > 0).select("chunk").distinct()
    judged = dealt.join(marks, "chunk", "left_semi")
    return judged.groupBy("chunk").cogroup(answers.join(marks, "chunk", "left_semi").groupBy("chunk")).applyInArrow(cover, "of_id long, of_url string, of_code long, runs array<struct<block:int,first:int,end:int>>").distinct()


_RUNS = pa.list_(pa.struct([("block", pa.int32()), ("first", pa.int32()), ("end", pa.int32())]))


def _without(text: str, runs: list[dict]) -> str:
    tokens = text.split(" ")
    for r in reversed(runs):
        del tokens[r["first"] : r["end"]]
    return " ".join(tokens)


def main_text(page: str, runs: list[dict] | None = None) -> str:
    """The article; on a page without one, what no element makes boilerplate; without repeats."""
    found = blocks(page)
    kind = 2 if any(k == 2 for _, k in found) else 1
    of_block: dict[int, list[dict]] = {}
    for r in runs or ():
        of_block.setdefault(r["block"], []).append(r)
    left = (_without(t, of_block[n]) if n in of_block else t for n, (t, k) in enumerate(found) if k == kind)
    return "\n".join(t for t in left if t)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per row of pages: id, url, text, n_chars, n_repeated (runs cut out for repetition).

    What was found repeated is a small table; Spark broadcasts it to the pages if its size allows and shuffles otherwise.
    """
    rows = _read(pages, id_col, url_col, html_col)
    streams = materialise(page_streams(rows, min_tokens), "streams")
    chosen, articles = template_blocks(streams, min_pages)
    columns = ["id", "url", "code", "host", "page", "tokens", "blocks"]
    picked = materialise(article_streams(rows, chosen), "article-streams")
    both = streams.where(F.size("tokens") > 0).select(*columns, F.lit(False).alias("inside")).unionAll(picked.select(*columns, F.lit(True).alias("inside")))
    marks = materialise(repeated_runs(both, articles, min_tokens, min_pages, chunk_tokens), "marks")
    same = F.col("id").eqNullSafe(F.col("of_id")) & F.col("url").eqNullSafe(F.col("of_url")) & (F.col("code") == F.col("of_code"))
    both = rows.join(marks, same, "left").select("id", "url", "html", "runs")

    def run(record_batches):
        for b in record_batches:
            runs = b.column("runs").to_pylist()
            texts = [main_text(page, r) for page, r in arrow_rows([b], "html", "runs")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(r or ()) for r in runs], pa.int32())], ["id", "url", "text", "n_chars", "n_repeated"])

    made = both.mapInArrow(run, "id long, url string, text string, n_chars long, n_repeated int")
    return made.withColumnsRenamed({"id": id_col, "url": url_col})
