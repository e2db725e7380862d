"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined to the places of the same hashes in license templates. A hit
at word p of a text and word t of a template votes for the diagonal p - t. Votes are counted by diagonal, and neighbouring
diagonals (words inserted or left out) make a band. A band with votes for enough of a template is verified: its hits must stand
in the template's order, and each place of the template counts once. Short templates are read by pairs of words, bodies of licenses by
runs of four.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, store

#: Words of a rolling gram, also the shortest template. Templates of BODY words or more are read by grams of twice as many.
GRAM, BODY = 2, 24
#: A band is a diagonal and as many after it as twice NEAR; this share of a template's grams makes a match.
NEAR, SHARE = 3, 0.75
#: Template words in all: the broadcast table of template places stays below this bound.
MOST_TEMPLATE_WORDS = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


#: Exact phrases count wherever their words stand consecutively.
PHRASES = [Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True)]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lines that name a license, and bodies of licenses, as words.
NOTICES = [
    Template("mit", "released under the mit license"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nd", "licensed under cc by nd 4 0"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
        "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
        "and fitness",
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law "
        "or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the "
        "license for the specific language governing permissions and limitations under the license",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form "
        "or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
]


def words(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, after lower-casing A-Z; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_hashes(w: Column, k: int) -> Column:
    places = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def long_hashes(h: Column, k: int) -> Column:
    """Hashes of grams of 2 k words from those of k words."""
    places = F.when(F.size(h) > k, F.sequence(F.lit(0), F.size(h) - k - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + k)))


def template_places(spark, templates: list[Template], k: int, marked: bool) -> tuple[DataFrame, list[int]]:
    """h, tid, k, label, exact, grams, off: a row for each gram of each template; and all hashes, which are bounded as the templates are.

    With marked, a row of tid -1 besides, whose hash is -1."""
    split = [re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t.text)) for t in templates]
    if sum(map(len, split)) > MOST_TEMPLATE_WORDS or any(len(w) < k for w in split):
        raise ValueError(f"templates need {k} words at least, and {MOST_TEMPLATE_WORDS} in all at most")
    texts = spark.createDataFrame(list(enumerate(split)), "tid int, w array<string>").select("tid", gram_hashes(F.col("w"), k).alias("g"))
    rows = []
    for r in texts.select("tid", "g", long_hashes(F.col("g"), k).alias("long")).collect():
        t = templates[r["tid"]]
        size = k if t.exact or len(split[r["tid"]]) < BODY else 2 * k
        g = r["g"] if size == k else r["long"]
        rows += [(h, r["tid"], size, t.label, t.exact, len(g), off) for off, h in enumerate(g)]
    mark = [(-1, -1, 0, "", True, 1, 0)] if marked else []  # a marker before the first word carries each row through the join
    return spark.createDataFrame(rows + mark, "h long, tid int, k int, label string, exact boolean, grams int, off int"), sorted({r[0] for r in rows})


def in_order(hits: list[tuple[int, int]]) -> int:
    """The most hits (at, off) that stand in the order of both the text and the template, each place of either counted once."""
    ends: list[int] = []
    for _, off in sorted(hits, key=lambda h: (h[0], -h[1])):
        i = bisect.bisect_left(ends, off)
        ends[i : i + 1] = [off]
    return len(ends)


def bands(diagonals: list[tuple[int, list[int]]], grams: int, k: int, near: int, share: float) -> list[tuple[int, int, float]]:
    """(from, to, part) of the occurrences of a template among the hits of (diagonal, offsets), in order of diagonals.

    A band from a diagonal on holds an occurrence if its hits in order are at least share of the grams. Of those that overlap
    the most complete stays, then the first."""
    found, end, n = [], 0, 0
    need = share * grams - 1e-9
    for i, (d, offs) in enumerate(diagonals):
        while end < len(diagonals) and diagonals[end][0] <= d + 2 * near:
            n += len(diagonals[end][1])
            end += 1
        if n >= need:
            hits = [(x + o, o) for x, os in diagonals[i:end] for o in os]
            best = in_order(hits)
            if best >= need:
                found.append((-best, min(h[0] for h in hits), max(h[0] for h in hits) + k))
        n -= len(offs)
    out: list[tuple[int, int, float]] = []
    for best, start, stop in sorted(found):
        at = bisect.bisect_left(out, (start,))
        if (at == len(out) or out[at][0] >= stop) and (at == 0 or out[at - 1][1] <= start):
            out.insert(at, (start, stop, -best / grams))
    return out


def verifier(near: int, share: float):
    @F.arrow_udf("array<struct<from:bigint,to:bigint,part:double>>")
    def verified(diagonals: pa.Array, grams: pa.Array, k: pa.Array) -> pa.Array:
        out = []
        for d, g, size in zip(diagonals.to_pylist(), grams.to_pylist(), k.to_pylist(), strict=True):
            out.append([{"from": a, "to": b, "part": p} for a, b, p in bands(sorted((x["diag"], x["offs"]) for x in d), g, size, near, share)])
        return pa.array(out, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("part", pa.float64())])))

    return verified


def spans(hits: DataFrame, keys: list[str], near: int, share: float) -> DataFrame:
    """Votes of hits (keys, tid, k, label, exact, grams, off, at) as rows: keys, label, exact, from, to, part, found.

    A diagonal whose votes make nothing stays as a row that is not found, with its part of the template. Of notices whose spans overlap only
    those found most completely are kept: versions of a license differ in a word or two. All rows of a text are in one task; they
    are no more than its words times the places of a gram in the templates."""
    own = [*keys, "tid", "k", "label", "exact", "grams"]
    voted = hits.repartition(*keys).withColumn("diag", F.col("at") - F.col("off")).groupBy(*own, "diag").agg(F.collect_list("off").alias("offs")).withColumn("votes", F.size("offs"))
    along = Window.partitionBy(*own).orderBy("diag")
    band = F.sum("votes").over(along.rangeBetween(0, 2 * near)) >= share * F.col("grams") - 1e-9
    # written once: both branches below need it, and it is short, while the texts are not
    voted = store(voted.withColumn("_band", band.cast("int")).withColumn("_near", F.max("_band").over(along.rangeBetween(-2 * near, 0)) == 1).drop("_band"))
    full = F.col("votes") == F.col("grams")
    start = (F.col("diag") + F.array_min("offs")).cast("long")
    one = F.array(F.struct(start.alias("from"), (F.col("diag") + F.array_max("offs") + F.col("k")).cast("long").alias("to"), (F.col("votes") / F.col("grams")).alias("part"), (F.col("exact") & full & (F.col("tid") >= 0)).alias("found")))
    plain = voted.filter("exact or not _near").select(*own, F.explode(one).alias("s"))
    close = voted.filter("not exact and _near").groupBy(*own).agg(F.collect_list(F.struct("diag", "offs")).alias("d"), F.max("votes").alias("votes"))
    close = close.withColumn("v", verifier(near, share)("d", "grams", "k"))
    got = F.transform("v", lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["part"].alias("part"), F.lit(True).alias("found")))
    none = F.array(F.struct(F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"), (F.col("votes") / F.col("grams")).alias("part"), F.lit(False).alias("found")))
    noticed = close.select(*own, F.explode(F.when(F.size("v") > 0, got).otherwise(none)).alias("s"))
    span = plain.unionByName(noticed).select(*keys, "tid", "label", "exact", F.when(F.col("tid") < 0, 0.0).otherwise(F.col("s.part")).alias("part"), "s.from", "s.to", "s.found")
    span = span.withColumn("notice", ~F.col("exact") & F.col("found"))
    along = Window.partitionBy(*keys, "notice").orderBy("from", "to", "tid")
    reach = F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1))
    span = span.withColumn("group", F.sum(F.when(reach.isNull() | (F.col("from") >= reach), 1).otherwise(0)).over(along))
    best = F.max("part").over(Window.partitionBy(*keys, "notice", "group"))
    return span.withColumn("found", F.when(F.col("notice"), F.col("part") == best).otherwise(F.col("found")))


def sieve(hashes: list[int]):
    """A test that all these hashes pass and about one in 64 of the others, by their low bits, so that few rows reach the join."""
    bits = max(10, (64 * len(hashes)).bit_length())
    table = [0] * (1 << (bits - 6))
    for h in hashes:
        low = h & ((1 << bits) - 1)
        table[low >> 6] |= 1 << (low & 63)
    known = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in table])

    def passes(h: Column) -> Column:
        low = h.bitwiseAND(F.lit((1 << bits) - 1))
        return F.call_function("shiftright", F.get(known, F.call_function("shiftright", low, F.lit(6)).cast("int")), low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return passes


def hits_of(docs: DataFrame, templates: list[Template] | None, k: int, marked: bool) -> DataFrame:
    """A row for each gram of a text that is one of a template; with marked, a row of tid -1 for each row of docs besides."""
    spark = docs.sparkSession
    known, hashes = template_places(spark, templates if templates is not None else PHRASES + NOTICES, k, marked)
    w = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    w = w.select("uid", "doc_id", F.size("w").cast("long").alias("n_words"), gram_hashes(F.col("w"), k).alias("g")).withColumn("_short", F.size("g"))
    w = w.withColumn("g", F.concat("g", long_hashes(F.col("g"), k)))
    seen = sieve(hashes)
    places = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: seen(F.get("g", i)))
    picked = F.when(F.size("g") > 0, F.transform(places, lambda i: F.struct(i.alias("at"), F.get("g", i).alias("h")))).otherwise(F.array().cast("array<struct<at:int,h:bigint>>"))
    mark = [F.array(F.struct(F.lit(0).alias("at"), F.lit(-1).cast("long").alias("h")))] if marked else []
    g = w.select("uid", "doc_id", "n_words", "_short", F.inline(F.concat(*mark, picked)))
    at = F.when(F.col("at") >= F.col("_short"), F.col("at") - F.col("_short")).otherwise(F.col("at"))
    return g.join(F.broadcast(known), "h").withColumn("at", at).drop("_short")


def scan(docs: DataFrame, templates: list[Template] | None = None, k: int = GRAM, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """One row for each row of docs, with what was found in its whole text.

    doc_id, n_words, n_base, first_word, last_word (occurrences of exact phrases), base_labels, labels, score (the
    largest part of a template found, 1 for an exact phrase; half the largest part on one diagonal where nothing counts), n_spans.
    A notice counts if share of its grams stand in its order on a band of diagonals. A null text has no words: counts 0, labels empty, places null.
    Equal rows are scanned each for itself."""
    span = spans(hits_of(docs, templates, k, True), ["uid", "doc_id", "n_words"], near, share)
    base, start = F.col("exact") & F.col("found"), F.col("from").cast("long")

    def labels(which: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(which, F.col("label")))))

    return span.groupBy("uid", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, start)).alias("first_word"), F.max(F.when(base, start)).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), F.max(F.when(F.col("found"), F.col("part")).otherwise(F.col("part") * 0.5)).alias("score"),
        F.count(F.when(F.col("found"), 1)).alias("n_spans"),
    ).drop("uid")


def found_spans(docs: DataFrame, templates: list[Template] | None = None, k: int = GRAM, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """doc_id, label, start, end (words, end exclusive), part: a row for each span that scan() counts. Null and empty texts have none;
    repeated rows give theirs each."""
    span = spans(hits_of(docs, templates, k, False), ["uid", "doc_id"], near, share)
    return span.filter("found").select("doc_id", "label", F.col("from").alias("start"), F.col("to").alias("end"), "part")
