"""Licences of files: TF-IDF cosine of their statements to templates, and inheritance along directories.

Only DataFrame functions run here. A text is cut into statements (lines and sentences). The weights of
template terms give, for a given least cosine, a small set of anchor terms without which no statement can
reach it (by the Cauchy-Schwarz inequality), so one pattern picks the statements that are scored at all.
Beside them whole texts, runs of up to ``RUN`` paragraphs, and all between the first and the last paragraph
with an anchor, line breaks and comment marks joined, are compared with whole licences, headers and titles,
again only where an anchor stands, and SPDX lines are read. What holds too few template words to reach the
least cosine, by the number of its words alone, is not scored; the rest is scored in one pass over sorted words.
Scoring stays inside the row: there is no join or shuffle of texts. Files without a licence of their
own take the licence of the licence files in the nearest directory above them, by a join of directories.

Defined cases: null and empty texts have no licence of their own; several finds give the best one,
ties the name last in order, but a bare reservation of rights (``Proprietary``) counts only where no whole
licence, header or SPDX line is found, since licences quote it; several licence files of a directory likewise; null paths lie in the root
directory and inherit from it; repeated rows are judged each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.common import stored
from tenurekit.llm.licence_templates import SPDX, WHOLE

LEAST_COSINE = 0.7
DIGITS = 6
LICENCE_NAME = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$"

#: Usual statements of licences.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
)
#: Words that say little; they only order the choice of anchors.
EVERYDAY = frozenset("a all and by for in into is of on the this to under work".split())
#: Words of prose; they have no weight in whole licences.
PROSE = EVERYDAY | frozenset(
    "an any are as at be been but can do does each either even from has have if it its may more must no not one only other "
    "or our out s shall should so such than that their them then these they those use used was we were what when where which "
    "who will with within without would you your see copy".split()
)
#: Further terms of many texts, less fit as anchors; they do have weight.
FREQUENT = PROSE | frozenset(
    "0 1 2 3 4 19 29 1991 1999 2004 2007 january february june november action application author authors code commercial "
    "conditions copies covered creative distribute distributed domain file following form free general including "
    "international library list mean merge notice option product program provided public related rights source version "
    "view visit works write zero".split()
)
#: Paragraphs that a header or a short licence may run over.
RUN = 8
_MARK = "[ \\t]*(?:#|//|;|--|%)"
#: A marked line before one without a mark ends a comment.
_COMMENT_END = f"(\\n{_MARK}[^\\n]*)\\n(?!{_MARK})"
_BLANK = "\\n[^a-z0-9\\n]*(?=\\n)"
_SPDX_LINE = "spdx-license-identifier:[ \\t]*([a-z0-9.+() \\t-]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_weights(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """Inverse frequencies of template terms, that of any other term, and unit vectors by licence."""
    documents = {name: Counter(_terms(text)) for name, text in templates}
    seen = Counter(t for terms in documents.values() for t in terms)
    inverse = {t: math.log((1 + len(documents)) / (1 + n)) + 1 for t, n in sorted(seen.items())}
    vectors = {}
    for name, terms in documents.items():
        raw = {t: n * inverse[t] for t, n in sorted(terms.items())}
        size = math.sqrt(sum(v * v for v in raw.values()))
        vectors[name] = {t: v / size for t, v in raw.items()}
    return inverse, math.log(1 + len(documents)) + 1, vectors


def anchor_terms(vectors: dict, least: float, rank=lambda term, weight: (term not in EVERYDAY, weight)) -> list[str]:
    """Terms of which every statement within the least cosine of a template holds one.

    A statement that shares only terms with a summed square below ``least ** 2`` stays below the least
    cosine, so such terms may be left out, by rank: everyday words first, then light ones.
    """
    found: set[str] = set()
    for weights in vectors.values():
        left_out = 0.0
        for term, weight in sorted(weights.items(), key=lambda x: (rank(*x), x[0])):
            if left_out + weight * weight < 0.99 * least * least:
                left_out += weight * weight
            else:
                found.add(term)
    return sorted(found)


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _counted(words: Column) -> Column:
    """(w, n) of each different one of sorted words, in one pass."""
    firsts = F.array_compact(F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i)))
    count = lambda at, p, j: (F.coalesce(F.get(at, j + 1), F.size(words)) - p).cast("double")
    return _let(firsts, lambda at: F.transform(at, lambda p, j: F.struct(F.get(words, p).alias("w"), count(at, p, j).alias("n"))))


def _squares(counted: Column) -> Column:
    return F.aggregate(counted, F.lit(0.0), lambda a, e: a + e["n"] * e["n"])


def _best_match(words: Column, weights: tuple[dict[str, float], float, list[dict[str, float]]], names: list[str], least: float) -> Column:
    """The best (score, licence) of words in any order, null where none can reach the least cosine.

    The cosine is at most the share of template terms in the text's length. Where even the greatest weight
    for each of these and one place for each other word stay below, no word is looked up.
    """
    inverse, other, vectors = weights
    places: dict[str, list[dict]] = {t: [] for t in inverse}
    for k, vector in enumerate(vectors):
        for t, w in vector.items():
            places[t].append({"k": k, "w": w * inverse[t]})
    table = F.from_json(
        F.lit(json.dumps({t: {"idf": inverse[t], "at": at} for t, at in places.items()})),
        "map<string, struct<idf: double, at: array<struct<k: int, w: double>>>>",
    )
    ratio = least * least / (1 - least * least) * (other / max(inverse.values())) ** 2 * (1 - 1e-9)
    licences = F.array(*(F.lit(name) for name in names))

    def scored(found: Column, rest: Column) -> Column:
        known = F.aggregate(found, F.lit(0.0), lambda a, e: a + F.pow(e["n"] * e["of"]["idf"], F.lit(2.0)))
        norm = F.sqrt(known + rest * F.lit(other * other))
        hits = F.flatten(F.transform(found, lambda e: F.transform(e["of"]["at"], lambda a: F.struct(a["k"].alias("k"), (a["w"] * e["n"]).alias("w")))))

        def best(hit: Column, size: Column) -> Column:
            dot = lambda k: F.aggregate(F.filter(hit, lambda h: h["k"] == k), F.lit(0.0), lambda a, h: a + h["w"])
            return F.array_max(F.transform(licences, lambda name, k: F.struct(F.round(dot(k) / size, DIGITS).alias("score"), name.alias("licence"))))

        return _let(hits, lambda hit: _let(norm, lambda size: best(hit, size)))

    def among(ws: Column, known: Column, counted: Column) -> Column:
        possible = _squares(counted) >= F.lit(ratio) * (F.size(ws) - F.size(known))
        found = F.transform(counted, lambda e: F.struct(e["n"].alias("n"), F.try_element_at(table, e["w"]).alias("of")))
        others = F.sort_array(F.filter(ws, lambda w: ~w.isin(*inverse)))
        rest = _let(others, lambda x: _squares(_counted(x)))
        return F.when(possible & (F.size(known) > 0), _let(found, lambda f: _let(rest, lambda r: scored(f, r))))

    known_words = lambda ws: F.sort_array(F.filter(ws, lambda w: w.isin(*inverse)))
    return _let(words, lambda ws: _let(known_words(ws), lambda known: _let(_counted(known), lambda counted: among(ws, known, counted))))


def _statement_licence(statement: Column, least: float, templates: tuple[tuple[str, str], ...]) -> Column:
    """The best (score, licence) of one statement, in lower case."""
    inverse, other, vectors = template_weights(templates)
    words = F.regexp_extract_all(statement, F.lit("([a-z0-9]+)"), F.lit(1))
    return _best_match(words, (inverse, other, list(vectors.values())), list(vectors), least)


def whole_weights(whole: tuple[tuple[str, str], ...] = WHOLE) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """As ``template_weights``, for texts of which several may share a name, without words of prose."""
    inverse, other, vectors = template_weights(tuple((str(k), " ".join(t for t in _terms(text) if t not in PROSE)) for k, (_, text) in enumerate(whole)))
    return inverse, other, [vectors[str(k)] for k in range(len(whole))]


def whole_rank(term: str, weight: float) -> float:
    """Order in which terms of whole licences are left out as anchors: light ones first, frequent ones sooner."""
    return weight * weight / (10 if term in FREQUENT else 1)


def _one_of(terms: list[str]) -> str:
    """Pattern of a text that holds one of the terms, by first letters."""
    by_first: dict[str, list[str]] = {}
    for term in terms:
        by_first.setdefault(term[0], []).append(term[1:])
    return "(^|[^a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items())) + ")([^a-z0-9]|$)"


def _whole_licence(unit: Column, least: float, whole: tuple[tuple[str, str], ...]) -> Column:
    """The best (score, licence) of a joined run of paragraphs, in lower case."""
    words = F.filter(F.regexp_extract_all(unit, F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(*sorted(PROSE)))
    return _best_match(words, whole_weights(whole), [name for name, _ in whole], least)


def _units(low: Column, pattern: str) -> Column:
    """The whole text, its runs of paragraphs that hold an anchor, and all from the first to the last of these, each joined."""
    lines = F.concat(F.lit("\n"), F.translate(low, "\r", ""))
    pieces = F.filter(F.split(F.regexp_replace(lines, _COMMENT_END, "$1\n\n"), _BLANK), lambda p: p.rlike("[a-z0-9]"))

    def runs(parts: Column, anchored: Column) -> Column:
        of = lambda i: F.transform(
            F.filter(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size(parts) - i)), lambda n: F.exists(F.slice(anchored, i + 1, n), lambda a: a)),
            lambda n: F.array_join(F.slice(parts, i + 1, n), " "),
        )
        first = F.array_position(anchored, True)
        last = F.size(anchored) + 1 - F.array_position(F.reverse(anchored), True)
        between = F.filter(F.array(F.array_join(F.slice(parts, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), " ")), lambda u: first > 0)
        return F.concat(F.flatten(F.transform(parts, lambda _, i: of(i))), between)

    found = _let(pieces, lambda parts: _let(F.transform(parts, lambda p: p.rlike(pattern)), lambda anchored: runs(parts, anchored)))
    return F.array_distinct(F.concat(F.array(low), found))


def _whole_pattern(least: float, whole: tuple[tuple[str, str], ...]) -> str:
    return _one_of(anchor_terms(dict(enumerate(whole_weights(whole)[2])), least, whole_rank))


def _statement_pattern(least: float, templates: tuple[tuple[str, str], ...]) -> str:
    return _one_of(anchor_terms(template_weights(templates)[2], least))


def whole_licence(low: Column, least: float = LEAST_COSINE, whole: tuple[tuple[str, str], ...] = WHOLE) -> Column:
    """The best (score, licence) of the SPDX lines, headers and the whole of a text in lower case, or null."""
    pattern = _whole_pattern(least, whole)
    scored = F.filter(F.transform(_units(low, pattern), lambda u: _whole_licence(u, least, whole)), lambda x: x["score"] >= least)
    names = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(_SPDX_LINE), F.lit(1)), lambda line: F.split(line, "[^a-z0-9.+-]+")))
    spdx = F.filter(
        F.transform(names, lambda x: F.struct(F.lit(1.0).alias("score"), F.try_element_at(F.create_map(*(F.lit(y) for pair in SPDX.items() for y in pair)), x).alias("licence"))),
        lambda x: x["licence"].isNotNull(),
    )
    by_line = F.when(low.contains("spdx-license-identifier:"), F.array_max(spdx))
    return F.coalesce(by_line, F.when(low.rlike(pattern), F.array_max(scored)))


def own_licence(text: Column, least: float = LEAST_COSINE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """The best licence of a text as (score, licence), null if nothing in it reaches the least cosine."""

    def judged(low: Column) -> Column:
        both = F.struct(whole_licence(low, least).alias("whole"), _stated_licence(low, least, templates).alias("stated"))
        bare = lambda x: x["whole"].isNotNull() & (x["stated"]["licence"] == "Proprietary")
        return _let(both, lambda x: F.when(bare(x), x["whole"]).otherwise(F.greatest(x["whole"], x["stated"])))

    terms = set(anchor_terms(template_weights(templates)[2], least)) | set(anchor_terms(dict(enumerate(whole_weights()[2])), least, whole_rank))
    # The letters' case is left as it is until a text holds an anchor.
    return F.when(text.rlike(f"(?i){_one_of(sorted(terms))}|spdx-license-identifier:"), _let(_lowered(text), judged))


def _stated_licence(low: Column, least: float, templates: tuple[tuple[str, str], ...]) -> Column:
    """The best statement of a text in lower case, null if none reaches the least cosine."""
    pattern = _statement_pattern(least, templates)
    statements = F.filter(F.split(F.regexp_replace(low, "([.!?;]) +", "$1\n"), "\n"), lambda s: s.rlike(pattern))
    found = F.filter(F.transform(statements, lambda s: _statement_licence(s, least, templates)), lambda x: x["score"] >= least)
    return F.when(low.rlike(pattern), F.array_max(found))


def scan(files: DataFrame, least: float = LEAST_COSINE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """file_id, path, licence, score, origin (own, inherited, none) and the directory it comes from.

    ``files`` has file_id, path and text. The texts are read once; the rest works on ids and paths.
    """
    parts = F.split(F.coalesce("path", F.lit("")), "/")
    own, _ = stored(
        files.select(
            "file_id", "path", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"),
            F.element_at(parts, -1).alias("name"), own_licence(F.col("text"), least, templates).alias("own"),
        ),
        "licence-statements",
    )
    by_dir = own.filter(F.col("own").isNotNull() & F.col("name").rlike(LICENCE_NAME)).groupBy("dir").agg(F.max("own").alias("found"))
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    above = own.select("dir").distinct().select("dir", F.posexplode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(up)).alias("depth", "above"))
    nearest = (
        above.join(by_dir.withColumnRenamed("dir", "above"), "above")
        .groupBy("dir").agg(F.max_by(F.struct("above", "found"), "depth").alias("nearest"))
    )
    joined = own.join(nearest, "dir", "left")
    inherits = F.col("own").isNull() & F.col("nearest").isNotNull()
    return joined.select(
        "file_id", "path",
        F.coalesce("own.licence", "nearest.found.licence").alias("licence"),
        F.coalesce("own.score", "nearest.found.score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("nearest.above")).when(F.col("own").isNotNull(), F.col("dir")).alias("from_dir"),
    )
