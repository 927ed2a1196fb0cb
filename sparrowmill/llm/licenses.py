"""License scans by ordered signature rules. DataFrame functions only.

A text is read as words (runs of ASCII letters and digits and of characters beyond ASCII, ASCII letters in lower
case), joined by single spaces. Every rule is a regex over that word string, gated by keywords: texts that hold no rule's
keyword are put aside by one scan, and a regex runs only on texts that hold all words it cannot do without, or, if there is none,
the letters of its keyword. Places that a rule finds become intervals of words; an interval
inside another one is suppressed, the longer winning, then the rule with the smaller priority number, then the
smaller rule number. What stays gives labels and a score (the highest confidence of a rule that stays).

Base phrases are counted at all their places, whatever the rules suppress, and their labels always stay.

Cases: null and empty texts have no words and no places. Rows that repeat an id and text get the same values each.
Null ids are kept. Extra columns are not read. Long texts with many places become rows, not nested arrays.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import nonnull_text

NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Hand-written rules: label, keyword, confidence, regex over the word string. Order is priority.
HAND = """
agpl|license|0.97|gnu affero general public license( version| v)? 3( 0)?( only| or( any)? later( version)?)?
agpl|license|0.95|licensed under( the)?( terms of( the)?)? (gnu )?affero general public license
agpl|license|0.9|affero general public license
agpl|agpl|0.9|agpl( version| v)? ?3( 0)?( only| or later)?
agpl|agplv3|0.9|agplv3
lgpl|license|0.97|gnu lesser general public license( version| v)? [23]( [01])?( only| or( any)? later( version)?)?
lgpl|license|0.95|licensed under( the)?( terms of( the)?)? (gnu )?lesser general public license
lgpl|license|0.9|lesser general public license
lgpl|license|0.9|gnu library general public license
lgpl|lgpl|0.9|lgpl( version| v)? ?[23]( [01])?( only| or later)?
lgpl|lgplv3|0.9|lgplv3
lgpl|lgplv2|0.9|lgplv2( 1)?
gpl|license|0.97|(this (work|program|software|file|library|document) is )?(free software )?licensed under( the)?( terms of( the)?)? gnu general public license( version| v)? [123]( 0)?( only| or( any)? later( version)?)?
gpl|license|0.97|gnu general public license( version| v)? [123]( 0)?( only| or( any)? later( version)?)?
gpl|license|0.95|under the terms of the gnu general public license( as published by the free software foundation)?
gpl|license|0.9|gnu general public license
gpl|gnu|0.85|gnu gpl( version| v)? ?[123]?( 0)?
gpl|gpl|0.85|gpl( version| v) ?[123]( 0)?( only| or later)?
gpl|gplv3|0.9|gplv3
gpl|gplv2|0.9|gplv2
gpl|licensed|0.6|licensed under( the)? gpl
gfdl|license|0.95|gnu free documentation license( version| v)?( 1 [123])?( or( any)? later( version)?)?
apache|license|0.97|licensed under( the)?( terms of( the)?)? apache license( version)? 2( 0)?( the license)?
apache|license|0.97|apache license( version)? 2( 0)?
apache|license|0.9|apache software license( version)?( [12]( [01])?)?
apache|license|0.9|apache public license( version)?( 2( 0)?)?
apache|apache|0.85|(licensed|released|distributed|available) under( the)? apache( 2( 0)?)?
apache|apache|0.8|apache 2 0
apache|license|0.9|www apache org licenses license 2 0
mit|license|0.97|(licensed|released|distributed|available|provided) under( the)?( terms of( the)?)? mit license
mit|license|0.95|the mit license( mit)?
mit|license|0.9|mit license
mit|opensource|0.9|opensource org licenses mit
mit|licensed|0.85|licensed under( the)? mit
mit|license|0.85|expat license
mit|hereby|0.9|permission is hereby granted free of charge to any person obtaining a copy
mit|license|0.8|x11 license
bsd|bsd|0.97|bsd (2|3|4|two|three|four) clause( simplified| new| revised| original)?( license)?
bsd|license|0.95|(simplified|new|revised|modified|original) bsd license
bsd|bsd|0.9|(licensed|released|distributed|available) under( the| a)? bsd( style)?( license)?
bsd|license|0.9|bsd( style)? license
bsd|clause|0.9|(2|3|two|three) clause bsd( license)?
bsd|redistribution|0.9|redistribution and use in source and binary forms with or without modification are permitted
isc|license|0.9|isc license
isc|isc|0.9|(licensed|released) under( the)? isc
isc|permission|0.85|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl|license|0.97|mozilla public license( version| v)? ?[12] [01]
mpl|license|0.9|mozilla public license
mpl|mozilla|0.9|mozilla org mpl( 2 0)?
epl|license|0.97|eclipse public license( version| v)?( [12] 0)?
edl|license|0.9|eclipse distribution license( version| v)?( 1 0)?
cddl|cddl|0.85|cddl( version| v)?( 1 [01])?
cddl|license|0.95|common development and distribution license( version)?( 1 [01])?
cpl|license|0.9|common public license( version)?( 1 0)?
cpal|license|0.9|common public attribution license( version)?( 1 0)?
ipl|license|0.9|ibm public license( version)?( 1 0)?
eupl|european|0.9|european union public licen[cs]e( version| v)?( 1 [012])?
eupl|eupl|0.85|eupl( version| v)?( 1 [012])?
artistic|license|0.9|artistic license( version)?( [12]( 0)?)?
artistic|perl|0.8|same terms as perl( itself)?
psf|license|0.9|python( software foundation)? license( agreement)?( version)?( 2( 0)?)?
php|license|0.9|php license( version)?( 3( 0)?( 01)?)?
ruby|license|0.85|(the )?ruby license
zlib|license|0.9|zlib( libpng)? license
libpng|license|0.9|libpng license( version)?( 2( 0)?)?
boost|license|0.95|boost software license( version)?( 1 0)?
unlicense|unlicense|0.9|(the )?unlicense
unlicense|unlicense|0.9|unlicense org
wtfpl|wtfpl|0.9|wtfpl
wtfpl|license|0.9|do what the fuck you want to public license
cc0|cc0|0.95|cc0( 1 0)?( universal)?
cc0|zero|0.95|creative commons zero( v?1 0)?( universal)?
public-domain|domain|0.8|(placed|released|dedicated|is) (in|into|to) the public domain
public-domain|domain|0.6|public domain dedication
cc-by-nc-nd|cc|0.97|cc by nc nd( [1234] 0)?
cc-by-nc-sa|cc|0.97|cc by nc sa( [1234] 0)?
cc-by-nc|cc|0.97|(licensed under )?cc by nc( [1234] 0)?
cc-by-nd|cc|0.97|cc by nd( [1234] 0)?
cc-by-sa|cc|0.97|cc by sa( [1234] 0)?
cc-by|cc|0.9|(licensed under )?cc by( [1234] 0)?
cc-by-nc-nd|noncommercial|0.97|creative commons attribution noncommercial no ?deriv(ative)?s( works)?( [1234] 0)?( international| unported| generic)?( license)?
cc-by-nc-sa|noncommercial|0.97|creative commons attribution noncommercial share ?alike( [1234] 0)?( international| unported| generic)?( license)?
cc-by-nc|noncommercial|0.97|creative commons attribution noncommercial( [1234] 0)?( international| unported| generic)?( license)?
cc-by-nc|commercial|0.95|creative commons attribution non commercial( [1234] 0)?( international| unported| generic)?( license)?
cc-by-nd|commons|0.97|creative commons attribution no ?deriv(ative)?s( works)?( [1234] 0)?( international| unported| generic)?( license)?
cc-by-sa|commons|0.97|creative commons attribution share ?alike( [1234] 0)?( international| unported| generic)?( license)?
cc-by|commons|0.95|creative commons attribution( [1234] 0)?( international| unported| generic)?( license)?
cc|commons|0.8|creative commons( license| licence)
cc-by-nc-nd|creativecommons|0.95|creativecommons org licenses by nc nd( [1234] 0)?
cc-by-nc-sa|creativecommons|0.95|creativecommons org licenses by nc sa( [1234] 0)?
cc-by-nc|creativecommons|0.95|creativecommons org licenses by nc( [1234] 0)?
cc-by-nd|creativecommons|0.95|creativecommons org licenses by nd( [1234] 0)?
cc-by-sa|creativecommons|0.95|creativecommons org licenses by sa( [1234] 0)?
cc-by|creativecommons|0.95|creativecommons org licenses by( [1234] 0)?
cc0|creativecommons|0.95|creativecommons org publicdomain zero( 1 0)?
odbl|license|0.95|open database license( odbl)?( v?1 0)?
odbl|odbl|0.85|odbl( v?1 0)?
odc-by|license|0.9|open data commons attribution license( v?1 0)?
pddl|license|0.9|public domain dedication and license( v?1 0)?
ofl|ofl|0.85|sil ofl( 1 1)?
ofl|license|0.95|(sil )?open font license( version)?( 1 [01])?
openssl|license|0.9|openssl license
ssleay|license|0.9|(original )?ssleay license
postgresql|license|0.9|postgresql license
sqlite|blessing|0.7|in place of a legal notice here is a blessing
vim|license|0.85|vim license
curl|license|0.85|curl license
ntp|license|0.85|ntp license
icu|license|0.85|icu license
unicode|unicode|0.9|unicode (license agreement|terms of use|license v3)
w3c|license|0.9|w3c (software )?(notice and )?license
json|license|0.85|the json license
json|evil|0.9|shall be used for good not evil
beerware|license|0.9|the beer ?ware license( revision 42)?
beerware|beerware|0.9|beerware
ms-pl|license|0.95|microsoft public license( ms pl)?
ms-rl|license|0.95|microsoft reciprocal license( ms rl)?
apsl|license|0.9|apple public source license( version)?( [12] [012])?
qpl|license|0.85|q(t)? public license( version)?( 1 0)?
osl|license|0.9|open software license( version| v)? ?[123] [01]
afl|license|0.9|academic free license( version| v)?( [123] [01])?
ecl|license|0.9|educational community license( version)?( [12] 0)?
ncsa|license|0.9|(university of illinois )?ncsa open source license
upl|license|0.9|universal permissive license( version| v)?( 1 0)?
mulan|license|0.9|mulan permissive software license( version| v)?( [12])?
zpl|license|0.9|zope public license( version)?( [12] [01])?
sleepycat|license|0.9|sleepycat license
intel|license|0.8|intel open source license
nasa|nasa|0.9|nasa open source agreement( version)?( 1 3)?
sspl|sspl|0.9|sspl( v?1( 0)?)?
sspl|license|0.95|server side public license( version| v)?( 1)?
busl|license|0.95|business source license( version)?( 1 1)?
elastic|license|0.95|elastic license( version)?( 2 0)?
commons-clause|clause|0.9|commons clause( license condition)?( v?1 0)?
polyform|polyform|0.9|polyform (noncommercial|small business|shield|perimeter|strict|free trial)( license)?( 1 0 0)?
openrail|openrail|0.9|(creativeml |bigscience |big code )?openrail( m)?( license)?
llama|license|0.9|llama( [23])?( community)? license( agreement)?
dual|licensed|0.8|dual licensed under
proprietary|reserved|0.5|all rights reserved
proprietary|proprietary|0.7|proprietary and confidential
proprietary|confidential|0.6|confidential and proprietary
proprietary|license|0.6|end user license agreement( eula)?
proprietary|reproduced|0.6|may not be (copied|reproduced|distributed)( or (copied|reproduced|distributed))* without( the)?( prior)?( written)? permission
notice|license|0.4|see( the)? license( file)?( for( more)? details)?
notice|license|0.4|license file for( more)? details
notice|license|0.3|subject to the terms( and conditions)? of( the| this)? license
notice|licensed|0.2|licensed under
"""

#: Identifiers of a public licence list; each gives a tag rule and a file-header rule.
SPDX = """
0bsd afl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0
bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0
cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpal-1.0 cpl-1.0
ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only
gpl-3.0-or-later ipl-1.0 isc json lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later
mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01 postgresql
psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
"""


def _family(spdx: str) -> str:
    name = spdx.removesuffix("-only").removesuffix("-or-later")
    head, _, version = name.rpartition("-")
    name = head if head and version.replace(".", "").isdigit() else name
    return "bsd" if name.startswith("bsd") or name == "0bsd" or name.endswith("clause") else {"x11": "mit", "mit-0": "mit", "python": "psf", "bsl": "boost"}.get(name, name)


def rules() -> list[dict]:
    """All rules in order of priority: tags first, then the hand-written ones."""
    made = []
    for spdx in SPDX.split():
        words = spdx.replace("-", " ").replace(".", " ")
        made.append((_family(spdx), "spdx", 1.0, f"spdx license identifier {words}"))
        made.append((_family(spdx), "license", 0.95, f"license (identifier |id |type |name )?is {words}"))
    for line in HAND.strip().splitlines():
        label, keyword, confidence, regex = line.split("|", 3)
        made.append((label, keyword, float(confidence), regex))
    needs = [_needed(x[3]) for x in made]
    needed = [{f" {w} " for w in n} or {x[1]} for n, x in zip(needs, made, strict=True)]  # words with their spaces, or letters anywhere
    shared = Counter(w for words in needed for w in words)
    gates = [min(words, key=lambda w: (shared[w], -len(w), w)) for words in needed]
    return [{"rule": n, "label": x[0], "keyword": x[1], "gate": g, "needs": sorted(w), "confidence": x[2], "regex": f"(?<= )((?:{x[3]}))(?= )"} for n, (x, g, w) in enumerate(zip(made, gates, needs, strict=True))]


def _needed(regex: str) -> set[str]:
    """Words that stand in every match: those outside groups, with nothing optional in them."""
    while "(" in regex:
        regex = re.sub(r"\(([^()]*)\)\??", lambda m: " # " if m[1].startswith(" ") else "#", regex)
    regex = re.sub(r"[# ]* \?", "#", regex)  # a space that may lack joins words
    return {w for w in regex.split(" ") if re.fullmatch(r"[a-z0-9]*[a-z][a-z0-9]+", w)}


def words_of(text: str) -> Column:
    """The word string: one space before, between and after the words; a single space if there are none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    flat = F.regexp_replace(F.translate(nonnull_text(text), upper, lower), f"[{NOT_WORD}]+", " ")
    return F.concat(F.lit(" "), F.trim(flat), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def detections(texts: DataFrame, key: list[str], words: str, table: list[dict]) -> DataFrame:
    """key, rule, label, confidence, first, last: all places of all rules, before suppression. One row a place."""
    by_gate: dict[str, list[dict]] = {}
    for r in table:
        by_gate.setdefault(r.get("gate") or r["keyword"], []).append({"needs": []} | r)
    kind = "struct<rule:int,label:string,confidence:double,regex:string,needs:array<string>>"
    strings = lambda some: F.array(*[F.lit(x) for x in sorted(some)]).cast("array<string>")
    words_of_gates = {g.strip() for g in by_gate if g.startswith(" ")}
    known = words_of_gates | {w for r in table for w in r.get("needs", ())}
    ruled = F.from_json(F.lit(json.dumps(by_gate)), f"map<string,array<{kind}>>")
    # Which of the rules' words a text holds is found once; a regex runs only where all words that it needs stand.
    noted = texts.select(*key, words, F.array_intersect(F.split(F.col(words), " "), strings(known)).alias("present"))
    by_word = F.transform(F.array_intersect("present", strings(words_of_gates)), lambda g: F.concat(F.lit(" "), g, F.lit(" ")))
    by_letters = F.filter(strings(g for g in by_gate if not g.startswith(" ")), lambda g: F.instr(F.col(words), g) > 0)
    gated = noted.select(*key, words, "present", F.explode(F.concat(by_word, by_letters)).alias("gate"))
    tried = gated.select(*key, words, "present", F.inline(F.element_at(ruled, F.col("gate")))).where(F.size(F.array_except("needs", "present")) == 0)
    marked = tried.select(*key, "rule", "label", "confidence", F.regexp_replace(F.col(words), F.col("regex"), F.lit("\u0001$1\u0002")).alias("marked"))
    found = marked.where(F.contains("marked", F.lit("\u0001"))).select(*key, "rule", "label", "confidence", F.posexplode(F.split("marked", "\u0001")).alias("n", "piece"))
    # Only numbers are shuffled: how many words a piece spans, and how many of them the match before it.
    measured = found.select(*key, "rule", "label", "confidence", "n", _spaces(F.col("piece")).alias("span"), _spaces(F.substring_index("piece", "\u0002", 1)).alias("inside"))
    order = W.partitionBy(*key, "rule").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    placed = measured.withColumn("first", F.sum("span").over(order) - 1).where("n > 0")
    return placed.select(*key, "rule", "label", "confidence", "first", (F.col("first") + F.col("inside")).alias("last"))


def resolve(found: DataFrame, key: list[str]) -> DataFrame:
    """Drop the intervals that lie inside another one."""
    order = W.partitionBy(*key).orderBy("first", F.desc("last"), "rule").rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("reach", F.max("last").over(order)).where(F.col("reach").isNull() | (F.col("reach") < F.col("last"))).drop("reach")


def _gated(docs: DataFrame, id_col: str, text_col: str, table: list[dict]) -> DataFrame:
    """id, hash and word string of the texts in which some rule's keyword stands."""
    text = nonnull_text(text_col)
    keywords = {r["keyword"] for r in table}
    stems = sorted(k for k in keywords if not any(o != k and o in k for o in keywords))
    # One lower-cased copy a text; beyond ASCII it may only let more texts through.
    some = F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in stems]))
    return docs.where(some).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), words_of(text_col).alias("words"))


def _base_rules(base: dict[str, str]) -> list[dict]:
    """Zero-width, so that places which overlap are all found."""
    return [{"rule": -1 - n, "label": base[p], "keyword": max(p.split(), key=len), "gate": f" {p.split()[0]} ", "needs": sorted(set(p.split())), "confidence": 0.0, "regex": f"(?<= )(?={p} )()"} for n, p in enumerate(sorted(base))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[dict] | None = None) -> DataFrame:
    """The places that stay: id, rule, label, confidence, first and last word. One row a place and distinct document."""
    table = table or rules()
    found = detections(_gated(docs, id_col, text_col, table), ["id", "h"], "words", table).distinct()
    return resolve(found, ["id", "h"]).drop("h").withColumnRenamed("id", id_col)


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, table: list[dict] | None = None) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base, table = BASE if base is None else base, rules() if table is None else table
    text = nonnull_text(text_col)
    counted = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("h"),
        F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"),
    )
    everything = [*_base_rules(base), *table]
    found = detections(_gated(docs, id_col, text_col, everything), ["id", "h"], "words", everything).distinct()
    is_base = F.col("rule") < 0
    key = ["id", "h"]
    order = W.partitionBy(*key).orderBy("ordinary", "first", F.desc("last"), "rule").rowsBetween(W.unboundedPreceding, -1)
    kept = found.withColumn("ordinary", ~is_base).withColumn("reach", F.max(F.when(~is_base, F.col("last"))).over(order)).where(is_base | F.col("reach").isNull() | (F.col("reach") < F.col("last")))
    summed = kept.groupBy(*key).agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(is_base, F.lit(0.9)).otherwise(F.col("confidence"))).alias("score"),
    )
    same = counted["id"].eqNullSafe(summed["id"]) & (counted["h"] == summed["h"])
    return counted.join(summed, same, "left").select(
        counted["id"].alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
