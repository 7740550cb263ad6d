"""Licence scan by the Dice coefficient of word bigrams.

A text's lines, sentences and paragraphs, the text as a whole, and runs of its
words wherever they stand are candidates.  Each is normalised to lower-case
words of ASCII letters and digits and compared with licence templates.  The threshold bounds how many distinct bigrams a candidate
may have, and how many bigrams of a template it may lack, so that some words of the
template must be there: most texts are dropped by that alone.  What is left is
compared through an equi-join on the bigrams that any template has.

*Runs.*  The best run for a template begins and ends with one of its bigrams: to
cut off others never lowers the coefficient.  From every such bigram that has
enough others of the template near behind it, all ends are tried.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower

THRESHOLD = 0.8

#: Wording of notices and licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit("[0-9a-z]+"), F.lit(0))


def _bind(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.transform(F.array(x), f)[0]


def _once(df: DataFrame, name: str, x: Column) -> DataFrame:
    """``df`` with a column that filters on it don't compute again: they can't be moved below a generator."""
    return df.select("*", F.explode_outer(F.array(x)).alias(name))


def _pairs(words: Column) -> Column:
    """Each two words in a row; a lone word has none."""
    n = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    return _bind(words, lambda w: F.zip_with(F.slice(w, F.lit(1), n(w)), F.slice(w, F.lit(2), n(w)), lambda a, b: F.concat_ws(" ", a, b)))


def _bigrams(words: Column) -> Column:
    """The distinct bigrams."""
    return F.array_distinct(_pairs(words))


def _bigrams_of(text: str) -> bool:
    """Whether a template has two words."""
    return len(re.findall("[0-9A-Za-z]+", text)) > 1


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(template, license, bigram, t_size) of every template."""
    rows = [(k, name, text) for k, (name, text) in enumerate((n, t) for n, ts in templates.items() for t in ts)]
    t = spark.createDataFrame(rows, "template int, license string, t string").withColumn("g", _bigrams(_words(F.col("t"))))
    return t.select("template", "license", F.size("g").alias("t_size"), F.explode("g").alias("bigram"))


def _anchors(rows: list, threshold: float) -> str:
    """A pattern that every candidate matches: of each template so many bigrams that one can't lack them all, by their longest words."""
    by: dict[int, list[str]] = {}
    for r in rows:
        by.setdefault(r["template"], []).append(r["bigram"])
    words: set[str] = set()
    for grams in by.values():
        lacks = len(grams) - math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
        longest = sorted((max(g.split(), key=len) for g in grams), key=lambda w: (-len(w), w))
        words.update(longest[: lacks + 1])
    return r"(?i)(?<![0-9A-Za-z])(?:" + "|".join(sorted(words)) + r")(?![0-9A-Za-z])"


def _known(rows: list, threshold: float) -> Column:
    """The templates as an array: least shared bigrams, longest run, and the bigrams."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["template"], []).append(r)
    known = []
    for k, rs in sorted(by.items()):
        size = len(rs)
        need, span = max(1, math.ceil(threshold / (2 - threshold) * size - 1e-9)), math.floor((2 - threshold) / threshold * size + 1e-9)
        known.append(F.struct(F.lit(k).alias("template"), F.lit(rs[0]["license"]).alias("license"), F.lit(size).alias("size"), F.lit(need).alias("need"), F.lit(span).alias("span"), F.array(*[F.lit(r["bigram"]) for r in rs]).alias("grams")))
    return F.array(*known)


def _runs(b: Column, t: Column, threshold: float) -> Column:
    """(start, n, dice, template, license) of the best run from each start for template ``t``; starts with a better one near are left out."""

    def score(start: Column) -> Column:
        def ends(s: Column) -> Column:
            kind = F.transform(s, lambda x, i: F.when(F.array_position(s, x) <= i, 0).when(F.array_contains(t["grams"], x), 2).otherwise(1))
            zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("hit"), F.lit(0.0).cast("double").alias("dice"), F.lit(0).alias("end"))

            def step(acc: Column, x: Column) -> Column:
                n, hit = acc["n"] + F.when(x > 0, 1).otherwise(0), acc["hit"] + F.when(x > 1, 1).otherwise(0)
                now = F.lit(2.0) * hit / (n + t["size"])
                better = (x > 1) & (now > acc["dice"])
                return F.struct((acc["at"] + 1).alias("at"), n.alias("n"), hit.alias("hit"), F.when(better, now).otherwise(acc["dice"]).alias("dice"), F.when(better, acc["at"] + 1).otherwise(acc["end"]).alias("end"))

            return F.aggregate(kind, zero, step)

        best = lambda r: F.struct(start.alias("start"), r["end"].alias("n"), r["dice"].alias("dice"), t["template"].alias("template"), t["license"].alias("license"))
        return _bind(_bind(F.slice(b, start, t["span"]), ends), best)

    places = F.filter(F.transform(b, lambda x, i: F.when(F.array_contains(t["grams"], x), i + 1)), lambda p: p.isNotNull())
    starts = _bind(places, lambda p: F.filter(p, lambda x, k: F.get(p, k + t["need"] - 1) - x < t["span"]))
    runs = F.filter(F.transform(starts, score), lambda r: r["dice"] >= threshold)
    near = lambda r: F.filter(r, lambda x, k: ~F.exists(F.slice(r, F.greatest(k + 2 - t["size"], F.lit(1)), 2 * t["size"]), lambda y: (F.abs(y["start"] - x["start"]) < t["size"]) & ((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["start"] < x["start"])))))
    return _bind(runs, near)


def _apart(runs: Column, reach: int) -> Column:
    """Of runs that overlap the best: by coefficient, then the first template, then the first start."""

    def keep(r: Column) -> Column:
        better = lambda x, y: (y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & ((y["template"] < x["template"]) | ((y["template"] == x["template"]) & (y["start"] < x["start"]))))
        meet = lambda x, y: (y["start"] < x["start"] + x["n"]) & (x["start"] < y["start"] + y["n"])
        return F.filter(r, lambda x, k: ~F.exists(F.slice(r, F.greatest(k + 1 - reach, F.lit(1)), 2 * reach + 1), lambda y: meet(x, y) & better(x, y)))

    return _bind(F.array_sort(runs), keep)


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Licences found in each text.

    Returns doc_id, license, dice (of the best match of that licence) and
    matches (distinct candidates that match it), a row for each licence of a
    document; rows of one id are one document.  Texts that are null, empty or
    name no licence have no row.  Only distinct bigrams bound a candidate's
    size, so one that repeats itself stays.  A run has as many bigrams, repeated
    ones counted, as the size bound of its template allows distinct ones at most;
    of runs that overlap one counts, and one that has the same words as a line,
    sentence, paragraph or text that matches is no other candidate.  A candidate
    matches the template of the highest coefficient from ``threshold`` on, ties
    to the first template.  An empty table, or no templates at all, gives an
    empty result.
    """
    spark = docs.sparkSession
    if not any(_bigrams_of(t) for ts in templates.values() for t in ts):
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("matches")).limit(0)
    known = template_table(spark, templates)
    # the templates are an argument of the driver's: they have a few hundred bigrams
    rows = known.select("template", "license", "t_size", "bigram").collect()
    grams = sorted({r["bigram"] for r in rows})
    # shares of the threshold, let off what floating point may lose where a bound is met exactly
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    least, most = low * min(r["t_size"] for r in rows), high * max(r["t_size"] for r in rows)
    anchor = _anchors(rows, threshold)
    templates_ = _known(rows, threshold)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").rlike(anchor))
    d = _once(d, "b", _pairs(_words(F.col("text"))))
    d = _once(d, "hit", F.array_intersect("b", F.array(*[F.lit(g) for g in grams])))
    # a text that shares too few bigrams with every template has no candidate that shares more
    near = F.filter(templates_, lambda t: F.size(F.array_intersect(F.col("hit"), t["grams"])) >= t["need"])
    d = _once(d.filter(F.size("hit") > 0), "near", near).filter(F.size("near") > 0).drop("hit")

    units = F.array_distinct(F.flatten(F.array(F.split("text", "\n"), F.split("text", r"(?<=[.!?])\s+"), F.split("text", r"\n[ \t\r]*\n"), F.array(F.col("text")))))
    u = d.select("doc_id", F.explode_outer(F.filter(units, lambda u: u.rlike(anchor))).alias("u"))
    u = u.filter(F.regexp_count("u", F.lit("[0-9A-Za-z]+")) - 1 >= least)
    u = _once(u, "b", _pairs(_words(F.col("u"))))
    u = _once(u, "g", F.array_distinct("b")).withColumn("n", F.size("g")).filter((F.col("n") >= least) & (F.col("n") <= most))
    u = _once(u.select("doc_id", "u", F.xxhash64("b").alias("words"), "n", "g"), "hit", F.array_intersect("g", F.array(*[F.lit(g) for g in grams])))
    # what all templates know of it bounds what one of them shares
    u = u.filter(F.size("hit") >= (threshold / 2 - 1e-9) * (F.col("n") + min(r["t_size"] for r in rows)))
    met = u.select("doc_id", F.xxhash64("u").alias("u"), "words", "n", F.explode("hit").alias("bigram")).distinct().join(F.broadcast(known), "bigram")
    met = met.filter((F.col("n") >= low * F.col("t_size")) & (F.col("n") <= high * F.col("t_size")))
    dice = met.groupBy("doc_id", "u", "words", "n", "template", "license", "t_size").agg((F.lit(2.0) * F.count("*") / (F.col("n") + F.col("t_size"))).alias("dice")).filter(F.col("dice") >= threshold)
    best = dice.groupBy("doc_id", "u", "words").agg(F.max(F.struct("dice", (-F.col("template")).alias("t"), "license")).alias("b"))
    best = best.select("doc_id", "words", "b.license", "b.dice", F.lit(1).alias("unit"))

    sizes = [len({r["bigram"] for r in rows if r["template"] == k}) for k in sorted({r["template"] for r in rows})]
    # so many runs that are left can overlap one: those of a template start at least its size apart
    reach = sum(2 * math.floor(most) // n + 2 for n in sizes)
    runs = F.flatten(F.transform("near", lambda t: _bind(F.col("b"), lambda b: _runs(b, t, threshold))))
    words = lambda r: F.struct(F.xxhash64(F.slice("b", r["start"], r["n"])).alias("words"), r["license"].alias("license"), r["dice"].alias("dice"))
    runs = d.select("doc_id", F.explode_outer(F.transform(_apart(runs, reach), words)).alias("r")).filter("r is not null").select("doc_id", "r.*", F.lit(0).alias("unit"))
    both = best.unionByName(runs).groupBy("doc_id", "license", "words").agg(F.max("dice").alias("dice"), F.greatest(F.sum("unit"), F.lit(1)).alias("n"))
    return both.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.sum("n").alias("matches"))


def oracle(templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for :func:`scan` over ``documents``."""
    rows = [(k, name, text) for k, (name, text) in enumerate((n, t) for n, ts in templates.items() for t in ts)]
    values = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, n, t in rows)
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+')"
    grams = "list_transform(range(len({0}) - 1), lambda i: {0}[i + 1] || ' ' || {0}[i + 2])"
    need, span = f"greatest(1, ceil({threshold} / {2 - threshold} * t_size - 1e-9))", f"floor({2 - threshold} / {threshold} * t_size + 1e-9)"
    better = "y.dice > x.dice or y.dice = x.dice and (y.template < x.template or y.template = x.template and y.a < x.a)"
    return f"""
    with t0(template, license, t) as (values {values}),
    t1 as (select template, license, {words.format("t")} as w from t0),
    t2 as (select template, license, list_distinct({grams.format("w")}) as g, len(list_distinct({grams.format("w")})) as t_size from t1),
    t3 as (select template, license, t_size, unnest(g) as bigram from t2),
    -- lines, sentences, paragraphs and texts
    u0 as (select distinct doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\\1' || chr(1), 'g'), chr(1)), regexp_split_to_array(text, '\n[ \t\r]*\n'), [text]))) as u from documents where text is not null),
    u1 as (select doc_id, u, {words.format("u")} as w from u0),
    u2 as (select doc_id, u, {grams.format("w")} as b from u1),
    u3 as (select doc_id, u, b, len(list_distinct(b)) as n, unnest(list_distinct(b)) as bigram from u2),
    dice as (select doc_id, u, b, template, license, 2.0 * count(*) / (n + t_size) as dice from u3 join t3 using (bigram)
        group by doc_id, u, b, n, template, license, t_size having 2.0 * count(*) / (n + t_size) >= {threshold}),
    best as (select doc_id, u, b, arg_min(license, (-dice, template)) as license, max(dice) as dice from dice group by doc_id, u, b),
    -- runs: from a bigram of a template that has enough others near behind it to the best of them
    d1 as (select row_number() over () as d, doc_id, {words.format("text")} as w from documents where text is not null),
    d2 as (select d, doc_id, {grams.format("w")} as b from d1),
    d3 as (select d, unnest(b) as bigram, unnest(range(len(b))) as p from d2),
    d4 as (select d, p, bigram, lag(p) over (partition by d, bigram order by p) as before from d3 where d in (select d from d3 join t3 using (bigram))),
    place as (select d, p, template, t_size, lead(p, ({need} - 1)::int) over (partition by d, template order by p) - p as far from d4 join t3 using (bigram)),
    start as (select d, p as a, template, t_size, {span} as span from place where far < {span}),
    walk as (select s.*, i.p, (before is null or before < a)::int as new, (t3.bigram is not null)::int as known from start s join d4 i on i.d = s.d and i.p >= a and i.p < a + span left join t3 on t3.template = s.template and t3.bigram = i.bigram),
    sums as (select *, sum(new) over w as n, sum(new * known) over w as hit from walk window w as (partition by d, template, a order by p)),
    ends as (select d, template, t_size, a, p, 2.0 * hit / (n + t_size) as dice from sums where new = 1 and known = 1),
    runs0 as (select d, template, t_size, a, max(dice) as dice, arg_max(p, (dice, -p)) - a + 1 as n from ends group by d, template, t_size, a having max(dice) >= {threshold}),
    runs1 as (select * from runs0 x where not exists (from runs0 y where y.d = x.d and y.template = x.template and abs(y.a - x.a) < x.t_size and (y.dice > x.dice or y.dice = x.dice and y.a < x.a))),
    runs2 as (select * from runs1 x where not exists (from runs1 y where y.d = x.d and y.a < x.a + x.n and x.a < y.a + y.n and ({better}))),
    runs as (select doc_id, license, b[a + 1:a + n] as b, dice, 0 as unit from runs2 join d2 using (d) join t2 using (template)),
    both_ as (select doc_id, license, b, max(dice) as dice, greatest(sum(unit), 1) as n from (select doc_id, license, b, dice, 1 as unit from best union all from runs) group by doc_id, license, b)
    select doc_id, license, max(dice)::double as dice, sum(n)::bigint as matches from both_ group by doc_id, license"""
