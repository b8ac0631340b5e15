"""License scans by a positional index of rare tokens, in DataFrame operations only.

Templates are word sequences, whole notices or licences, with mandatory key
phrases. The index has for each template the words of its key phrases that have
the highest inverse document frequency over the whole corpus, with their
offsets (postings). All words of a file that are in the index are looked up;
each posting names a place where its template would start, and the places of a
template's postings are intersected: a start counts if all of its index words
name it. There the key phrases are verified word by word, and the words of the
whole template are compared. As index words are words of mandatory phrases, no
occurrence is lost.

The index and the templates are one constant of the plan, whatever their
number, and a look-up is a hash bucket. All of it is projections over the files
that hold an index word, so nothing is shuffled but the counts of the licence
words.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
Template = tuple[str, str, tuple[tuple[int, int], ...]]
#: Templates: label, words, and the key phrases (by offset of their first word, and count) without which they do not count.
TEMPLATES: tuple[Template, ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ((0, 4), (4, 3))),
    ("mit", "released under the mit license", ((3, 2),)),
    ("mit", "licensed under the mit license", ((3, 2),)),
    ("apache-2.0", "licensed under the apache license version 2 0", ((3, 2),)),
    ("gpl", "licensed under the gnu general public license version 3", ((3, 4),)),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ((5, 4),)),
    ("lgpl", "gnu lesser general public license", ((0, 5),)),
    ("agpl", "gnu affero general public license", ((0, 5),)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ((0, 3), (4, 4))),
    ("mpl", "subject to the terms of the mozilla public license", ((6, 3),)),
    ("cc-by-nc", "licensed under cc by nc", ((2, 3),)),
    ("cc-by-sa", "licensed under cc by sa", ((2, 3),)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ((2, 4),)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ((0, 4),)),
)
#: Index words of a template, the share of its words that must agree, and the first index words that a search of whole texts is made for before splitting them.
RARE, AGREE, SEARCHED = 3, 0.7, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
_INDEX = (
    "struct<buckets:array<array<struct<w:string,t:int,o:int>>>,"
    "templates:array<struct<label:string,base:boolean,words:array<string>,idf:array<double>,keys:array<struct<a:int,n:int>>,postings:int,agree:int>>>"
)


def _words(text: Column) -> Column:
    """The words of a text as an array; none for the empty text."""
    line = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _GAPS, " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def _known(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in (*PHRASES, *(t for _, t, _ in templates)) for w in t.split()})


def document_frequencies(docs: DataFrame, text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """The number of documents, and for each licence word of those that hold it; counted over all documents."""
    known = _known(templates)
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(_words(text), F.lit(known)))).alias("w"))  # "" counts documents
    got = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return got.get("", 0), {w: got.get(w, 0) for w in known}


def _index(templates: Sequence[Template], total: int, df: dict[str, int]) -> tuple[str, list[str]]:
    """The index as JSON of the form _INDEX, and each template's rarest index word."""
    rows, postings, first = [], [], set()
    every = [(label, p, ((0, len(p.split())),), True) for p, label in PHRASES.items()] + [(*t, False) for t in templates]
    idf = {w: log((1 + total) / (1 + n)) + 1 for w, n in df.items()}
    for t, (label, text, keys, base) in enumerate(every):
        ws = text.split()
        inside = sorted({o for a, n in keys for o in range(a, a + n)}, key=lambda o: (-idf[ws[o]], o))[:RARE]
        postings += [(ws[o], t, o) for o in inside]
        first.add(ws[inside[0]])
        agree = len(ws) if base else ceil(AGREE * len(ws))
        rows.append({"label": label, "base": base, "words": ws, "idf": [idf[w] for w in ws], "keys": [{"a": a, "n": n} for a, n in keys], "postings": len(inside), "agree": agree})
    buckets: list[list[dict]] = [[] for _ in range(2 * len(postings) + 1)]
    for w, t, o in postings:
        buckets[zlib.crc32(w.encode()) % len(buckets)].append({"w": w, "t": t, "o": o})
    return json.dumps({"buckets": buckets, "templates": rows}), sorted(first)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES, frequencies: tuple[int, dict[str, int]] | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_words, places (label, phrase, first word), matches (label, first word, weight).

    Words are [0-9a-z] and characters beyond ASCII after lower-casing A-Z.
    places are all occurrences of the base phrases; matches those of the
    templates, with the share of the template's inverse document frequency,
    ln((1 + documents) / (1 + documents with the word)) + 1, that agrees as
    weight. Null and empty texts have neither. Repeated rows and null ids stay;
    an empty table gives no rows; other columns are ignored. frequencies: those
    of another corpus, as document_frequencies gives them.
    """
    made, first = _index(templates, *(frequencies or document_frequencies(docs, text_col, templates)))
    index = F.from_json(F.lit(made), _INDEX)  # a constant, folded once
    buckets = lambda: index["buckets"]
    template = lambda t: F.get(index["templates"], t)
    size = len(json.loads(made)["buckets"])
    vocabulary = sorted({p["w"] for b in json.loads(made)["buckets"] for p in b})
    text = F.coalesce(F.col("_text"), F.lit(""))
    some = text.rlike("(?i)" + "|".join(first)) if len(first) <= SEARCHED else F.lit(True)  # a superset, told without splitting
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    held = src.select("_id", F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), F.when(some, _words(text)).otherwise(F.array().cast("array<string>")).alias("_words"))
    # the file's words that are in the index, each at its place
    hits = F.filter(F.transform("_words", lambda w, p: F.struct(w.alias("w"), p.alias("p"))), lambda h: h["w"].isin(vocabulary))
    held = held.select("*", F.when(F.size("_words") > 0, hits).alias("_hits"))
    # the starts that their postings name; equal ones are next to each other
    posted = lambda h: F.filter(F.get(buckets(), (F.crc32(h["w"]) % size).cast("int")), lambda p: p["w"] == h["w"])
    named = F.flatten(F.transform("_hits", lambda h: F.transform(posted(h), lambda p: F.struct(p["t"].alias("t"), (h["p"] - p["o"]).alias("s")))))
    held = held.select("*", F.when(F.size("_hits") > 0, F.sort_array(named)).alias("_named"))
    # those that all postings of a template name
    met = F.filter("_named", lambda c, i: F.get("_named", i + template(c["t"])["postings"] - 1).eqNullSafe(c))
    held = held.select("*", F.when(F.size("_named") > 0, met).alias("_met"))

    def agrees(c: Column) -> Column:
        t = template(c["t"])
        inside = (c["s"] >= 0) & (c["s"] + F.size(t["words"]) <= F.size("_words"))
        own = lambda k: F.slice("_words", c["s"] + k["a"] + 1, k["n"]) == F.slice(t["words"], k["a"] + 1, k["n"])
        return F.when(inside, F.forall(t["keys"], own)).otherwise(False)

    held = held.select("_id", "n_words", "_words", F.when(F.size("_met") > 0, F.filter("_met", agrees)).alias("_good"))

    def judged(c: Column) -> Column:
        t = template(c["t"])
        same = F.zip_with(F.slice("_words", c["s"] + 1, F.size(t["words"])), t["words"], lambda x, y: x == y)
        weight = F.aggregate(F.zip_with(same, t["idf"], lambda on, x: F.when(on, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
        total = F.aggregate(t["idf"], F.lit(0.0), lambda s, x: s + x)
        count = F.size(F.filter(same, lambda on: on))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), F.array_join(t["words"], " ").alias("phrase"), c["s"].alias("first"), (weight / total).alias("weight"), (count >= t["agree"]).alias("good"))

    held = held.select("_id", "n_words", F.when(F.size("_good") > 0, F.transform("_good", judged)).alias("_all"))
    places = F.transform(F.filter("_all", lambda m: m["base"] & m["good"]), lambda m: F.struct(m["label"].alias("label"), m["phrase"].alias("phrase"), m["first"].alias("first")))
    matches = F.transform(F.filter("_all", lambda m: ~m["base"] & m["good"]), lambda m: F.struct(m["label"].alias("label"), m["first"].alias("first"), m["weight"].alias("weight")))
    return held.select(F.col("_id").alias(id_col), "n_words", places.alias("places"), matches.alias("matches"))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of a scan: n_base, first_word, last_word, base_labels, labels, score.

    A row without places or matches (null) has 0, nulls, empty labels and score
    0. The score is the best weight of a template, 0.5 at least if a base
    phrase occurs, rounded to six digits. Repeated rows and null ids stay.
    """
    starts = F.transform("places", lambda p: p["first"])
    join = lambda labels: F.coalesce(F.array_join(F.array_sort(F.array_distinct(labels)), ","), F.lit(""))
    base = F.transform("places", lambda p: p["label"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["weight"])), F.lit(0.0))
    n = F.coalesce(F.when(F.col("places").isNotNull(), F.size("places")), F.lit(0)).cast("long")
    return scanned.select(
        id_col,
        "n_words",
        n.alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.round(F.least(F.lit(1.0), F.when(n > 0, F.greatest(best, F.lit(0.5))).otherwise(best)), 6).alias("score"),
    )
