"""Licences in documents, by recognising their sentences.

Each sentence of a text is normalised and looked up among known licence sentences,
which may also go over several lines or marks, as in wrapped notices and comments;
the identifiers found, in order, are matched against ordered rules, each a sequence
of identifiers. Rules come first that say more; what a rule has matched is not open
to the ones after it. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of known licence sentences in normalised form.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-project": "this project is licensed under the mit license",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions"),
    "mit-condition": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the software"),
    "as-is-mit": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement"),
    "apache-under": "licensed under the apache license version 2 0",
    "apache-under-the-license": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied"),
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-under": "licensed under the gnu general public license version 3",
    "gpl2-under": "licensed under the gnu general public license version 2",
    "gpl-redistribute-3": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version"),
    "gpl-redistribute-2": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license or at your option any later "
        "version"),
    "gpl-hope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose"),
    "bsd-redistribution": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met"),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer"),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution"),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission"),
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

# Licence and the sentence sequence that states it, longest first.
RULES = (
    ("Apache-2.0", ("apache-under-the-license", "apache-compliance", "apache-copy", "apache-basis")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("MIT", ("mit-grant", "mit-condition", "as-is-mit")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-hope")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-under",)),
    ("MIT", ("mit-project",)),
    ("Apache-2.0", ("apache-under-the-license",)),
    ("Apache-2.0", ("apache-under",)),
    ("GPL-3.0-or-later", ("gpl-redistribute-3",)),
    ("GPL-2.0-or-later", ("gpl-redistribute-2",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-under",)),
    ("GPL-2.0-only", ("gpl2-under",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("Unlicense", ("unlicense",)),
)

# A sentence ends at a line end, or at a mark before white space or the end.
SENTENCE_END = r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)|\n"


def marked_sentences(text: Column) -> Column:
    """Normalised sentences, each between two bars: A-Z in lower case, other characters
    than a-z and 0-9 as one space. Sentences without such characters stay as empty
    strings, so that the place of a sentence can be told."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ|", "abcdefghijklmnopqrstuvwxyz,")
    cut = F.regexp_replace(F.regexp_replace(lowered, SENTENCE_END, "|"), "[^a-z0-9|]+", " ")
    return F.concat(F.lit("|"), F.regexp_replace(cut, r" ?\| ?", "|"), F.lit("|"))


def known_sentences() -> str:
    """Pattern of a known sentence that is one or several whole sentences of a text, the
    longest first. White space, marks and line ends may stand between its words."""
    longest = sorted(SENTENCES.values(), key=len, reverse=True)
    return r"(?<=\|) ?(?:" + "|".join(s.replace(" ", "[ |]+") for s in longest) + r") ?(?=\|)"


def _rule_key(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, licences, sentence_ids, n_sentences, first_sentence`` for every row with
    a known licence sentence.

    ``licences``: names of the licences whose rules match, by name, joined by commas;
    empty if sentences are known but no rule's sequence is complete.
    ``sentence_ids``: identifiers in order, comma-joined, repeats included;
    ``first_sentence``: place of the first among the text's sentences, from 0. A rule
    matches identifiers that follow each other, whatever unknown sentences lie between.
    A known sentence may be several of the text's that follow each other: its words count,
    not where lines end or marks stand between them. The longest known sentence is taken.
    Null and empty texts have no sentences. Repeated rows and null ids give results
    like others; other columns are not read. An empty table gives no rows.
    """
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    pattern = F.lit(known_sentences())
    found = docs.select(F.col(id_col).alias("id"), marked_sentences(F.col(text_col)).alias("marked")).withColumn(
        "found", F.regexp_extract_all("marked", pattern, F.lit(0))).where(F.size("found") > 0)
    listed = found.select(
        "id", F.transform("found", lambda s: F.element_at(known, F.trim(F.regexp_replace(s, "[ |]+", " ")))).alias("ids"),
        F.substring("marked", F.lit(1), F.regexp_instr("marked", pattern) - 1).alias("before"))
    # Markers stand for positions; a matched rule leaves a gap that nothing spans.
    left = F.concat(*[F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">")))])
    state = listed.withColumn("_left", F.array_join(left, "")).withColumn("_hits", F.array().cast("array<string>"))
    for name, ids in RULES:
        key = _rule_key(ids)
        state = state.withColumn("_hits", F.when(
            F.contains("_left", F.lit(key)), F.array_append("_hits", F.lit(name))).otherwise(F.col("_hits"))).withColumn(
            "_left", F.replace("_left", F.lit(key), F.lit("|")))
    return state.select(
        F.col("id").alias(id_col), F.array_join(F.array_sort(F.array_distinct("_hits")), ",").alias("licences"),
        F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("bigint").alias("n_sentences"),
        (F.length("before") - F.length(F.replace("before", F.lit("|"), F.lit(""))) - 1).cast("bigint").alias("first_sentence"))


def sql() -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    known = ", ".join(f"('{sentence}', '{name}')" for name, sentence in SENTENCES.items())
    # Sentence ends with a mark become line ends first; RE2 has no need for the rest.
    steps = []
    left = "marks0"
    for at, (_, ids) in enumerate(RULES, 1):
        steps.append(f"r{at} as (select *, replace({left}, '{_rule_key(ids)}', '|') as marks{at} from "
                     f"{'marked' if at == 1 else f'r{at - 1}'})")
        left = f"marks{at}"
    hits = ", ".join(
        f"case when contains(marks{at - 1}, '{_rule_key(ids)}') then '{name}' end" for at, (name, ids) in enumerate(RULES, 1))
    return rf"""
with known(sentence, name) as (values {known}),
cut as (
  select doc_id, row_number() over () as rid,
         string_split(regexp_replace(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
           '[.!?;:]+([\x20\x09-\x0D]+|$)', chr(10), 'g'), chr(10)) as parts
  from documents),
each as (
  select doc_id, rid, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as place from cut),
matched as (
  select doc_id, rid, place, name from each
  join known on trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) = sentence),
marked as (
  select any_value(doc_id) as doc_id, rid, string_agg(name, ',' order by place) as sentence_ids,
         count(*) as n_sentences, cast(min(place) as bigint) as first_sentence,
         string_agg('<' || name || '>', '' order by place) as marks0
  from matched group by rid),
{', '.join(steps)}
select doc_id,
       array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x is not null))), ',') as licences,
       sentence_ids, n_sentences, first_sentence
from r{len(RULES)}"""
