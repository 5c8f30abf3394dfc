"""License scans by ordered signature rules.

A rule is a pattern over a document's words, a label, a keyword that must occur and a priority. Documents
without any gate word are never searched; of the rules only those whose keyword occurs are. A detection
that lies inside one of higher priority, or inside a longer one of its own, is suppressed. Only DataFrame
functions are used.

Patterns match words, not characters: every word stands between two spaces of its own, so a match
begins and ends at words, and its place is counted in words.

Nulls, ties and odd input: a null text has no words; equal rows get equal results; detections of equal
place and priority go to the earlier rule; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bind, lower_ascii, stage
from tidemark.llm.registry import query, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose A-Z are not lowered yet.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The phrases that every scan reports, with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Names by which texts call a license: label, versions, names.
FAMILIES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("gpl", ("1", "2", "3"), ("gnu general public license", "gnu gpl", "gpl")),
    ("lgpl", ("2", "2 1", "3"), ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl")),
    ("agpl", ("1", "3"), ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl")),
    ("gfdl", ("1 1", "1 2", "1 3"), ("gnu free documentation license", "gfdl")),
    ("apache", ("1 0", "1 1", "2 0"), ("apache license", "apache software license")),
    ("mpl", ("1 0", "1 1", "2 0"), ("mozilla public license", "mpl")),
    ("epl", ("1 0", "2 0"), ("eclipse public license",)),
    ("cddl", ("1 0", "1 1"), ("common development and distribution license", "cddl")),
    ("eupl", ("1 0", "1 1", "1 2"), ("european union public licence", "eupl")),
    ("artistic", ("1 0", "2 0"), ("artistic license",)),
    ("osl", ("1 0", "2 1", "3 0"), ("open software license",)),
    ("afl", ("2 1", "3 0"), ("academic free license",)),
    ("bsl", ("1 0",), ("boost software license",)),
    ("ofl", ("1 0", "1 1"), ("sil open font license", "open font license")),
    ("mit", (), ("mit license", "expat license")),
    ("bsd", (), ("bsd license", "bsd style license")),
    ("bsd-2-clause", (), ("bsd 2 clause license", "bsd 2 clause", "simplified bsd license", "freebsd license")),
    ("bsd-3-clause", (), ("bsd 3 clause license", "bsd 3 clause", "new bsd license", "modified bsd license")),
    ("isc", (), ("isc license",)),
    ("zlib", (), ("zlib license", "zlib libpng license")),
    ("unlicense", (), ("the unlicense",)),
    ("wtfpl", ("2",), ("do what the fuck you want to public license", "wtfpl")),
    ("psf", ("2",), ("python software foundation license", "psf license")),
    ("php", ("3 0", "3 01"), ("php license",)),
    ("cecill", ("1", "2", "2 1"), ("cecill free software license", "cecill")),
    ("odbl", ("1 0",), ("open database license", "odbl")),
    ("cc-by", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by", "creative commons attribution")),
    ("cc-by-sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike")),
    ("cc-by-nc", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial")),
    ("cc-by-nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by nd", "creative commons attribution noderivs", "creative commons attribution no derivatives")),
    ("cc-by-nc-sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by nc sa", "creative commons attribution noncommercial sharealike")),
    ("cc-by-nc-nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), ("cc by nc nd", "creative commons attribution noncommercial noderivs")),
    ("cc0", ("1 0",), ("cc0", "creative commons zero")),
)

# Sentences of license texts and notices: label, pattern.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of .{1,8} nor the names of its contributors"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", "this library is free software you can redistribute it and or modify it"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "this work is in the public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "unauthorized copying of this file"),
)

#: What stands between words, underscores included; ``\b`` would count those as letters.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
STARTS, ENDS = f"(?<![^{BETWEEN}])", f"(?![^{BETWEEN}])"
#: Any text with a detection holds one of these words or starts of words.
GATE = (
    f"(?i)licen[cs]|{STARTS}cc[{BETWEEN}]+by|gpl|gfdl|{STARTS}mpl{ENDS}|cddl|eupl|wtfpl|cecill|odbl|bsd|{STARTS}cc0|"
    f"creative|permission|redistribut|warranty|contributors|public[{BETWEEN}]+domain|rights|unauthorized"
)


@dataclass(frozen=True)
class Rule:
    pattern: str
    label: str
    keyword: str
    priority: int
    score: float
    base: bool = False


def worded(phrase: str) -> str:
    """A phrase of word patterns as a pattern over spaced words; ``.{a,b}`` skips so many words."""
    out = []
    for word in phrase.split():
        out.append(f"(?: [^ ]+ ){word[1:]}?" if word.startswith(".{") else f" {word} ")
    return "".join(out)


#: Words that many signatures share; they make poor keywords.
COMMON = {"license", "licence", "public", "general", "software", "free", "open", "creative", "commons", "this", "the", "is", "by", "in"}


def keyword(phrase: str) -> str:
    """The most telling plain word of a phrase: cheap to look for, and in every match."""
    plain = [w for w in re.sub(r"\(\?:[^)]*\)", " ", phrase).split() if w.isalnum()]
    return f" {max(plain, key=lambda w: (w not in COMMON, len(w)))} "


def all_rules() -> list[Rule]:
    """The ordered signatures: reported phrases, then names by form and version, then sentences."""
    found = [Rule(worded(p), label, keyword(p), 0, 0.5, True) for p, label in BASE]
    for label, versions, names in FAMILIES:
        for name in names:
            own = worded(name)
            short = len(name.split()) == 1
            # A bare short name says little; in a license sentence or with a version it says more.
            found.append(Rule(own, label, keyword(name), 1, 0.4 if short else 0.7))
            lead = "(?: licensed | released | distributed | available | provided | published )(?: under )(?: the | a | an )?(?: terms  of  the )?"
            found.append(Rule(lead + own, label, keyword(name), 3, 0.95))
            for v in versions:
                number = worded(v[:-2] if v.endswith(" 0") else v) + ("(?: 0 )?" if v.endswith(" 0") else "")
                tag = f"{label}-{v.replace(' ', '.')}"
                found.append(Rule(f"{own}(?: version | v | ver )?{number}", tag, keyword(name), 2, 0.9))
                later = f"{own}(?: version | v | ver )?{number}(?: or )(?: any )?(?: later | newer )"
                found.append(Rule(later, f"{tag}-or-later", keyword(name), 4, 0.95))
                found.append(Rule(lead + later, f"{tag}-or-later", keyword(name), 4, 1.0))
                found.append(Rule(f"{lead}{own}(?: version | v | ver )?{number}", tag, keyword(name), 4, 1.0))
        spdx = " ".join(label.split("-"))
        found.append(Rule(" spdx  license  identifier " + worded(spdx), label, " spdx ", 5, 1.0))
        for v in versions:
            found.append(Rule(" spdx  license  identifier " + worded(f"{spdx} {v}"), f"{label}-{v.replace(' ', '.')}", " spdx ", 5, 1.0))
    for label, phrase in SENTENCES:
        groups = phrase.replace("(?:", "( ").replace("|", " | ").replace(")", " )").split()
        pattern, open_ = "", False
        for w in groups:
            if w == "(":
                pattern, open_ = pattern + "(?:", True
            elif w == ")":
                pattern, open_ = pattern + ")", False
            elif w == "|":
                pattern += "|"
            else:
                pattern += worded(w)
        found.append(Rule(pattern, label, keyword(phrase), 3, 0.9))
    return found


def words_in(spaced: Column) -> Column:
    """Words of a string in which each has two spaces of its own."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def detections(spaced: Column, rules: list[Rule]) -> Column:
    """For each rule that matches: its number, the words before each match and in it."""
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r.keyword).alias("k"), F.lit(r.pattern).alias("p")) for i, r in enumerate(rules)])

    def search(r: Column) -> Column:
        return F.struct(
            r["i"].alias("rule"),
            F.transform(F.split(spaced, r["p"], -1), words_in).alias("gaps"),
            F.transform(F.regexp_extract_all(spaced, r["p"], F.lit(0)), words_in).alias("lens"),
        )

    near = F.filter(listed, lambda r: F.contains(spaced, r["k"]))
    return F.filter(F.transform(near, search), lambda d: F.size(d["lens"]) > 0)


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, and ``found``: the surviving and the reported detections of every row.

    ``found`` holds structs (rule, start, end, suppressed), words counted from 0.
    """
    rules = rules or all_rules()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), 0), "  "), F.lit(" "))
    hits = F.when(text.rlike(GATE), bind(spaced, lambda s: detections(s, rules)))
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(ANY_WORD)).cast("long").alias("n_words"), hits.alias("_hits"))
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "license-hits")

    each = rows.where(F.size("_hits") > 0).select("doc_id", "n_words", "_row", F.explode("_hits").alias("h"))
    places = each.select("doc_id", "n_words", "_row", F.col("h.rule").alias("rule"), F.col("h.gaps").alias("gaps"), F.posexplode("h.lens").alias("k", "len"))
    order = Window.partitionBy("_row", "rule").orderBy("k")
    gap = F.sum(F.element_at("gaps", F.col("k") + 1)).over(order)
    before = F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    facts = docs.sparkSession.createDataFrame([(i, r.priority, r.base) for i, r in enumerate(rules)], "_i int, priority int, base boolean")
    spans = places.select("doc_id", "n_words", "_row", "rule", (gap + before).alias("start"), "len").withColumn("end", F.col("start") + F.col("len"))
    spans = spans.join(F.broadcast(facts), F.col("rule") == F.col("_i")).drop("_i", "len")  # a row per rule

    # Whatever contains a span stands before it in this order, so running maxima of the ends suffice.
    inside = Window.partitionBy("_row", "base").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in sorted({r.priority for r in rules if not r.base}):
        covered = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("end"))).over(inside) >= F.col("end")).otherwise(covered)
    judged = spans.withColumn("suppressed", ~F.col("base") & F.coalesce(covered, F.lit(False)))
    found = judged.groupBy("_row", "doc_id", "n_words").agg(F.collect_list(F.struct("rule", "start", "end", "suppressed")).alias("found")).drop("_row")
    none = rows.where(F.coalesce(F.size("_hits"), F.lit(0)) <= 0).select("doc_id", "n_words")
    return found.unionByName(none.withColumn("found", F.array().cast(found.schema["found"].dataType)))


def labelled(scanned: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The scan's digest: n_base, first_word, last_word, base_labels, labels, score."""
    rules = rules or all_rules()
    facts = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.base).alias("base"), F.lit(r.score).alias("score")) for r in rules])
    of = lambda d: F.element_at(facts, d["rule"] + 1)
    base = F.filter("found", lambda d: of(d)["base"])
    live = F.filter("found", lambda d: ~d["suppressed"])
    join = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: of(d)["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).cast("long").alias("last_word"),
        join(base).alias("base_labels"),
        join(live).alias("labels"),
        F.coalesce(F.array_max(F.transform(live, lambda d: of(d)["score"])), F.lit(0.0)).alias("score"),
    )


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(scan(table(spark, sf_dir, "documents")))
