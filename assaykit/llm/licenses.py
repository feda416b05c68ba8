"""Licence scan: lines, paragraphs, whole documents and stretches of words against templates by Dice over word bigrams.

Texts are normalised (A-Z lower-cased, everything but a-z and 0-9 a separator) and turned into sets of
word bigrams. With a set of m bigrams and a template of n, Dice 2c/(m+n) can reach the threshold only if
m lies in [t/(2-t) n, (2-t)/t n]; templates are joined by that size range, so a text meets only
templates it could match. A match holds most bigrams of its template, so texts and stretches without any of a
few of them, one word beside the other, are left alone before their bigrams are made. Built-in functions only.

A licence that no whole line, paragraph or document gives is looked for in every stretch of as many bigrams as
could match, within a line or over several. The best stretch begins and ends with a bigram of the template, as
others only add to m. Texts are cut into blocks of twice the longest stretch, each begun one stretch after the
last, so that every stretch lies in one whole and a text's blocks hold twice its words, however long it is.
The work in a block that holds enough of a template grows with the square of the template's length.

Defined cases: a null text is empty and matches nothing, nor does a text of fewer than two words;
repeated rows give their rows again; of several matching lines, paragraphs and the document the best counts, and
only without one the best stretch; templates equal in Dice all appear; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import ascii_lower, table, whole

THRESHOLD = 0.8
# The template list is a parameter that a user extends. Both broadcasts grow in proportion to its text: a template's
# bigrams are sent once, and its keys, at most three for every two words, hold its name and a bigram at most.
MOST_TEMPLATE_BYTES = 4 << 20

# Customary wording of licence notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}


def words(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "))
    return F.split(flat, " ")


def pairs_of(tokens: Column) -> Column:
    """Pairs of neighbouring words in order; empty for fewer than two words."""
    pairs = F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>"))


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of neighbouring words; empty for fewer than two words."""
    return F.array_distinct(pairs_of(tokens))


def size_bounds(n: Column, threshold: float) -> tuple[Column, Column]:
    return F.ceil(threshold / (2 - threshold) * n - F.lit(1e-9)), F.floor((2 - threshold) / threshold * n + F.lit(1e-9))


def known_templates(spark, templates: dict[str, str], threshold: float) -> DataFrame:
    """A row per template: its bigrams, the bigram counts that could match it, and its telling bigrams."""
    if sum(len(t.encode()) for t in templates.values()) > MOST_TEMPLATE_BYTES:
        raise ValueError("too much template text to broadcast")
    tells = [F.array(*[F.lit(" ".join(p)) for p in telling_pairs({k: t}, threshold)]).cast("array<string>") for k, t in templates.items()]
    listed = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("template"), a.alias("__tell")) for (k, t), a in zip(templates.items(), tells)])
    known = spark.range(1, numPartitions=1).select(F.inline(listed))
    known = known.select("license", "__tell", bigrams(words(F.col("template"))).alias("__b")).withColumn("__n", F.size("__b")).where("__n > 0")
    least, most = (c.cast("int") for c in size_bounds(F.col("__n"), threshold))
    return known.withColumn("__least", least).withColumn("__most", most)


def template_keys(known: DataFrame) -> DataFrame:
    """(license, key): a row per bigram count that could match a template and one per telling bigram."""
    sizes = F.transform(F.sequence("__least", "__most"), lambda m: m.cast("string"))
    return known.select("license", F.explode(F.concat(sizes, "__tell")).alias("__key"))


def longest_stretch(templates: dict[str, str], threshold: float) -> int:
    """Bigrams of the longest stretch that could match."""
    most = max((len(re.findall("[A-Za-z0-9]+", t)) - 1 for t in templates.values()), default=0)
    return max(1, math.floor((2 - threshold) / threshold * most + 1e-9))


def best_stretch(pairs: Column, template: Column, n: Column, least: Column, most: Column) -> Column:
    """The best Dice of a stretch of ``least`` to ``most`` neighbouring pairs; null where there is none."""
    places = F.sequence(F.lit(0), F.size(pairs) - 1)
    hits = F.filter(places, lambda i: F.array_contains(template, F.get(pairs, i)))

    def dice(i, j):
        own = F.slice(pairs, i + 1, j - i + 1)
        return 2.0 * F.size(F.array_intersect(own, template)) / (F.size(F.array_distinct(own)) + n)

    ends = lambda i: F.filter(hits, lambda j: (j - i + 1).between(least, most))
    return F.array_max(F.flatten(F.transform(hits, lambda i: F.transform(ends(i), lambda j: dice(i, j)))))


def telling_pairs(templates: dict[str, str], threshold: float) -> list[tuple[str, str]]:
    """Bigrams of which any match holds one at least.

    Dice c over m + n reaches the threshold t only with c >= t / (2 - t) n, as m >= c: a match lacks fewer than
    n - c + 1 of a template's n bigrams. Those with the longest words are taken, as they are the rarest.
    """
    out = set()
    for template in templates.values():
        tokens = re.sub("[^A-Za-z0-9]+", " ", template).lower().split()
        pairs = sorted(set(zip(tokens, tokens[1:])), key=lambda p: (-max(map(len, p)), -len(p[0] + p[1]), p))
        out.update(pairs[: len(pairs) - math.ceil(threshold / (2 - threshold) * len(pairs) - 1e-9) + 1])
    return sorted(out)


def may_match(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whether a lower-cased text has a pair's words beside each other: never false for a match.

    Most texts lack the longer word, which a plain search tells; only those with both words meet the pattern.
    """
    by_word: dict[str, list[tuple[str, str]]] = {}
    for a, b in pairs:
        by_word.setdefault(max(a, b, key=len), []).append((a, b))
    either = lambda parts: reduce(lambda x, y: x | y, parts, F.lit(False))
    beside = lambda a, b: text.contains(min(a, b, key=len)) & text.rlike(f"(?<![a-z0-9]){a}[^a-z0-9]+{b}(?![a-z0-9])")
    return either(text.contains(w) & either(beside(a, b) for a, b in found) for w, found in by_word.items())


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice): the best Dice of each row with each licence that reaches the threshold."""
    templates = templates or TEMPLATES
    known = known_templates(docs.sparkSession, templates, threshold)
    pairs, reach = telling_pairs(templates, threshold), longest_stretch(templates, threshold)
    text, own = F.col("__l"), F.col("__p")
    as_unit = lambda units, is_whole: F.transform(units, lambda u: F.struct(u.alias("__u"), F.lit(is_whole).alias("__whole")))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n\s*\n"), F.array(text)))
    starts = F.sequence(F.lit(1), F.size("__w"), F.lit(reach))
    blocks = F.array_distinct(F.transform(starts, lambda at: F.array_join(F.slice("__w", at, 2 * reach + 1), " ")))
    numbered = docs.select("doc_id", ascii_lower(whole()).alias("__l"), F.monotonically_increasing_id().alias("__row")).where(may_match(text, pairs))
    numbered = numbered.withColumn("__w", words(text))
    rows = numbered.select("doc_id", "__row", F.inline(F.concat(as_unit(units, True), as_unit(blocks, False)))).where(may_match(F.col("__u"), pairs))
    made = rows.select("doc_id", "__row", "__whole", pairs_of(words(F.col("__u"))).alias("__p"))
    tells = F.filter(F.array_distinct(own), lambda p: p.isin([" ".join(p) for p in pairs]))
    keys = F.when(F.col("__whole"), F.array(F.size(F.array_distinct(own)).cast("string"))).otherwise(tells)
    met = made.withColumn("__key", F.explode(keys)).join(F.broadcast(template_keys(known)), "__key").join(F.broadcast(known), "license")
    shared = F.size(F.array_intersect("__p", "__b"))
    # a block meets a template once, by the first of its telling bigrams
    met = met.where((shared >= F.col("__least")) & (F.col("__whole") | (F.get(F.array_intersect("__tell", "__p"), F.lit(0)) == F.col("__key"))))
    dice = F.when(F.col("__whole"), 2.0 * shared / (F.size(F.array_distinct(own)) + F.col("__n"))).otherwise(
        best_stretch(own, F.col("__b"), F.col("__n"), F.col("__least"), F.col("__most"))
    )
    scored = met.select("doc_id", "__row", "license", "__whole", dice.alias("dice")).where(F.col("dice") >= threshold)
    best = F.coalesce(F.max(F.when(F.col("__whole"), F.col("dice"))), F.max("dice"))
    return scored.groupBy("doc_id", "__row", "license").agg(best.alias("dice")).drop("__row")


QUERY = "op2_license_scan"
_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_WORDS = "string_split(trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"
_PAIRS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
_REACH = f"BETWEEN {THRESHOLD} / (2 - {THRESHOLD}) * {{n}} - 1e-9 AND (2 - {THRESHOLD}) / {THRESHOLD} * {{n}} + 1e-9"
SQL = f"""
WITH t(license, template) AS (VALUES {_VALUES}),
tw AS (SELECT license, {_WORDS.format('template')} AS w FROM t),
tb AS MATERIALIZED (SELECT license, list_distinct({_PAIRS.format('w')}) AS b FROM tw),
tx AS (SELECT license, len(b) AS n, unnest(b) AS g FROM tb),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
u AS (
  SELECT r, unnest(list_distinct(list_concat(list_concat(string_split(x, chr(10)), string_split_regex(x, '\\n\\s*\\n')), [x]))) AS x FROM d
),
uw AS (SELECT r, {_WORDS.format('x')} AS w FROM u),
ub AS (SELECT r, list_distinct({_PAIRS.format('w')}) AS a FROM uw WHERE len(w) > 1),
units AS (
  SELECT r, license, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice, true AS whole_unit
  FROM ub JOIN tb ON len(a) {_REACH.format(n='len(b)')}
),
dw AS (SELECT r, {_WORDS.format('x')} AS w FROM d),
dp AS MATERIALIZED (SELECT r, {_PAIRS.format('w')} AS p FROM dw WHERE len(w) > 1),
gs AS (SELECT r, unnest(p) AS g, generate_subscripts(p, 1) AS i FROM dp),
hits AS MATERIALIZED (SELECT r, license, n, i FROM gs JOIN tx USING (g)),
ends AS (
  SELECT x.r, license, x.i AS i, y.i AS j FROM hits x JOIN hits y USING (r, license) WHERE y.i - x.i + 1 {_REACH.format(n='x.n')}
),
cut AS (SELECT r, license, b, list_distinct(list_slice(p, i, j)) AS a FROM ends JOIN dp USING (r) JOIN tb USING (license)),
stretches AS (SELECT r, license, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice, false AS whole_unit FROM cut),
s AS (SELECT * FROM units UNION ALL SELECT * FROM stretches)
SELECT doc_id, license, CAST(coalesce(max(dice) FILTER (whole_unit), max(dice)) AS DOUBLE) AS dice
FROM s JOIN d USING (r) WHERE dice >= {THRESHOLD} GROUP BY r, doc_id, license
"""


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
