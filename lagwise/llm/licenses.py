"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into pieces after ``.``, ``!`` or ``?`` before white space (not after ``v.``) and at line
breaks. A piece is normalised to lower-case ASCII letters and digits with single blanks between, which
also takes off comment leaders. A sentence is a piece or a run of pieces that are parted by single line
breaks only: no end sign and no line without letters and digits stands between them. The longest run
from a place on that is among the known licence sentences counts, and the next begins after it, so
that wrapped sentences are known whatever the width. What is known of a text is a sequence of identifiers;
a licence is found where the identifiers of its rule follow one another in that sequence in order,
other known or unknown sentences between them allowed. Whole texts are scanned, row by row; there is
no shuffle. Texts without any of the words that every known sentence holds one of have no known
sentence and are not cut.

Edge cases: null, empty and unlicensed texts have no identifiers and no licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "the mit license mit": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep-notice",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "licensed under the apache license version 2 0 the license": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2-see",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-notice",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by nd 4 0": "cc-by-nd-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4",
    "spdx license identifier mit": "mit-notice",
    "spdx license identifier apache 2 0": "apache-2-notice",
    "spdx license identifier gpl 3 0 only": "gpl-3-notice",
    "spdx license identifier gpl 3 0 or later": "gpl-3-or-later",
    "spdx license identifier bsd 3 clause": "bsd-3-notice",
    "spdx license identifier bsd 2 clause": "bsd-2-notice",
    "all rights reserved": "all-rights-reserved",
}

# Each licence with the rules any of which names it.
RULES = {
    "MIT": [["mit-notice"], ["mit-grant", "mit-keep-notice"]],
    "Apache-2.0": [["apache-2-notice"], ["apache-2-compliance", "apache-2-warranty"]],
    "GPL-3.0": [["gpl-3-notice"], ["gpl-3-or-later"]],
    "GPL-2.0": [["gpl-2-or-later"]],
    "BSD-2-Clause": [["bsd-2-notice"], ["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-3-notice"]],
    "ISC": [["isc-grant"]],
    "MPL-2.0": [["mpl-2-notice"]],
    "CC-BY-4.0": [["cc-by-4"]],
    "CC-BY-SA-4.0": [["cc-by-sa-4"]],
    "CC-BY-NC-4.0": [["cc-by-nc-4"]],
    "CC-BY-ND-4.0": [["cc-by-nd-4"]],
    "proprietary": [["all-rights-reserved"]],
}

# Known sentences and rules that came later. The SQL, which reads single lines, has them not.
LATER_SENTENCES = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2-notice",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
}
LATER_RULES = {"BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]]}
#: An identifier that, next after those of a rule, means another licence.
NOT_BEFORE = {"BSD-2-Clause": "bsd-endorse"}
#: Names that a sentence is filled in with, and what stands for them in the known sentence.
FILLED_IN = [("^neither the name of .+ nor the names of (?:its|their|the) contributors may ", "neither the name of the copyright holder nor the names of its contributors may ")]

# Every known sentence holds one of these.
SIGNAL = "(?i)licen|copyright|warrant|permission|permitted|redistribut|all rights"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def pieces(text: Column) -> Column:
    """Array of the normalised pieces of a text, blank ones included; a ``.`` ends those that end a sentence."""
    cut = F.split(F.regexp_replace(text, r"(?<!\b[vV])([.!?])[ \t\r\n]+", "$1\u0001\n"), "\n")
    return F.transform(cut, lambda s: F.concat(normalised(s), F.when(s.endswith("\u0001") | (normalised(s) == ""), F.lit(".")).otherwise(F.lit(""))))


def rule_pattern(rule: list[str]) -> str:
    """Pattern over the comma-framed identifiers of a text."""
    return "," + ",(?:[^,]+,)*".join(rule) + ","


def _known(sentence: Column) -> Column:
    """Identifier of a normalised sentence."""
    for filled, name in FILLED_IN:
        sentence = F.regexp_replace(sentence, filled, name)
    table = F.create_map(*[F.lit(x) for pair in (SENTENCES | LATER_SENTENCES).items() for x in pair])
    return F.try_element_at(table, sentence)


def _begins() -> str:
    """Pattern of a piece that a known sentence may begin with."""
    pairs = {tuple(s.split()[:2]) for s in SENTENCES | LATER_SENTENCES}
    return "^(?:" + "|".join(sorted(f"{one}(?: {two}\\b.*)?" for one, two in pairs)) + ")\\.?$"


def known_runs(text: Column) -> Column:
    """Array of (place, id) of the known sentences; a place is a number of pieces before."""
    none = F.array().cast("array<struct<place:int,id:string>>")
    longest = 2 * max(len(s.split()) for s in SENTENCES | LATER_SENTENCES)  # a line has a word at least; names take some

    def known_from(cut: Column, place: Column) -> Column:
        # a run ends with the first piece that ends a sentence
        ahead = F.slice(cut, place + 1, longest)
        end = F.array_position(F.transform(ahead, lambda s: s.endswith(".")), True).cast("int")
        lengths = F.sequence(F.when(end > 0, end).otherwise(F.size(ahead)), F.lit(1), F.lit(-1))
        ids = F.transform(lengths, lambda n: F.struct(n.alias("n"), _known(F.rtrim(F.array_join(F.slice(ahead, 1, n), " "), F.lit("."))).alias("id")))
        return F.filter(ids, lambda x: x["id"].isNotNull())

    def step(state: Column, place: Column, cut: Column) -> Column:
        hit = F.transform(
            F.slice(known_from(cut, place), 1, 1),
            lambda x: F.struct((place + x["n"]).alias("free"), F.concat(state["found"], F.array(F.struct(place.alias("place"), x["id"].alias("id")))).alias("found")),
        )
        return F.when(place < state["free"], state).otherwise(F.coalesce(F.get(hit, F.lit(0)), state))

    def runs(cut: Column) -> Column:
        begins = F.filter(F.transform(cut, lambda s, i: F.when(s.rlike(_begins()), i)), lambda i: i.isNotNull())
        start = F.struct(F.lit(0).alias("free"), none.alias("found"))
        return F.aggregate(begins, start, lambda state, place: step(state, place, cut))["found"]

    return F.get(F.transform(F.array(pieces(text)), runs), F.lit(0))


def scan(documents: DataFrame, text: str = "text", sentences_name: str = "license_sentences", licenses_name: str = "licenses") -> DataFrame:
    """``documents`` with known sentences (place from 0, identifier) and the licences found, by name.

    Columns of these names are replaced.
    """
    documents = documents.drop(sentences_name, licenses_name)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = F.when(content.rlike(SIGNAL), known_runs(content))
    none = F.array().cast("array<struct<place:int,id:string>>")
    found = documents.withColumn(sentences_name, F.coalesce(known, none))
    framed = F.concat(F.lit(","), F.array_join(F.col(sentences_name)["id"], ","), F.lit(","))
    named = []
    for name, rules in sorted(RULES.items()):
        other = f"(?!{NOT_BEFORE[name]},)" if name in NOT_BEFORE else ""
        matched = [framed.rlike(rule_pattern(r) + other) for r in rules + LATER_RULES.get(name, [])]
        named.append(F.when(F.greatest(*matched, F.lit(False)), F.lit(name)))
    return found.withColumn(licenses_name, F.array_compact(F.array(*named)))


def sql() -> str:
    """The same per document, for DuckDB."""
    text = lambda value: "'" + value.replace("'", "''") + "'"
    known = ", ".join(f"({text(s)}, {text(i)})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({text(name)}, {text(rule_pattern(r))})" for name, each in RULES.items() for r in each)
    return rf"""
    WITH known(sentence, id) AS (VALUES {known}), rule(license, pattern) AS (VALUES {rules}),
    doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    cut AS (
        SELECT r, generate_subscripts(s, 1) - 1 AS place, unnest(s) AS sentence FROM (
            SELECT r, string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM doc)
    ), found AS (
        SELECT r, place, id FROM cut JOIN known ON known.sentence = trim(regexp_replace(
            translate(cut.sentence, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))
    ), listed AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY place) AS ids FROM found GROUP BY r),
    named AS (
        SELECT r, string_agg(license, ',' ORDER BY license) AS names FROM (
            SELECT DISTINCT r, license FROM listed, rule WHERE regexp_matches(',' || ids || ',', pattern)) GROUP BY r
    )
    SELECT doc_id, coalesce(n, 0) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(names, '') AS licenses,
           names IS NOT NULL AS licensed
    FROM doc LEFT JOIN listed USING (r) LEFT JOIN named USING (r)
    """
