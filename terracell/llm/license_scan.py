"""Licence scan by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, letters and digits, single
spaces) and mapped to the identifier of a known licence sentence. The identifiers in their order form
a sequence, on which ordered rules work: a rule is a sequence of identifiers, the longest rules come
first, and what a rule has used is not there for later ones. Sentences that aren't known don't break
a sequence.

Two readings are made of each text: line by line, and with lines joined, where only blank lines and
sentence ends cut (licence texts are wrapped). The findings of both count, but for shorter rules in
sentences that the other reading has used for a longer one. The cut leaves every known
sentence whole (checked on import); where one has a part that varies, such as the name of the program,
its fixed words find it.

Everything is built-in functions over the row's own text: a map without a shuffle. Only texts, and then
sentences, with a cue word are looked at; every known sentence has one (checked on import).

Defined results: null and empty texts have no licence and an empty sequence. Repeated rows get equal
results. Extra columns pass through, columns named like results are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import let, replace_columns, whole

GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, {}"

# Sentences of public licences and of notices that point to them.
SENTENCES = {
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit.named": "Released under the MIT License",
    "mit.under": "Licensed under the MIT License",
    "mit.this": "This project is licensed under the MIT License",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache.named": "Licensed under the Apache License, Version 2.0",
    "apache.the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache.comply": "you may not use this file except in compliance with the License",
    "apache.copy": "You may obtain a copy of the License at",
    "apache.asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl3.named": "This work is licensed under the GNU General Public License, version 3",
    "gpl3.under": "Licensed under the GNU General Public License, version 3",
    "gpl2.under": "Licensed under the GNU General Public License, version 2",
    "gpl.terms": GNU.format("General", "either version 3 of the License, or (at your option) any later version"),
    "gpl2.later": GNU.format("General", "either version 2 of the License, or (at your option) any later version"),
    "gpl2.only": GNU.format("General", "version 2 of the License"),
    "gpl3.only": GNU.format("General", "version 3 of the License"),
    "lgpl2.later": GNU.format("Library General", "either version 2 of the License, or (at your option) any later version"),
    "lgpl21.later": GNU.format("Lesser General", "either version 2.1 of the License, or (at your option) any later version"),
    "lgpl21.only": GNU.format("Lesser General", "version 2.1 of the License"),
    "lgpl3.later": GNU.format("Lesser General", "either version 3 of the License, or (at your option) any later version"),
    "agpl3.later": GNU.format("Affero General", "either version 3 of the License, or (at your option) any later version"),
    "agpl3.only": GNU.format("Affero General", "version 3 of the License"),
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl.under": "Licensed under the GNU Lesser General Public License, version 3",
    "mpl.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ccbync.named": "Licensed under CC BY-NC 4.0",
    "ccby.named": "Licensed under CC BY 4.0",
    "ccbysa.named": "Licensed under CC BY-SA 4.0",
    "ccby.work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbync.work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense.free": "This is free and unencumbered software released into the public domain",
}

#: In order: a licence and the sentences that must follow each other.
RULES = (
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("MIT", ("mit.grant", "mit.notice", "mit.asis")),
    ("MIT", ("mit.grant", "mit.notice")),
    ("ISC", ("isc.grant",)),
    ("Apache-2.0", ("apache.the", "apache.comply", "apache.copy", "apache.asis")),
    ("GPL-3.0-or-later", ("gpl.terms", "gpl.hope")),
    ("GPL-3.0-or-later", ("gpl.terms",)),
    ("GPL-2.0-or-later", ("gpl2.later",)),
    ("GPL-2.0-only", ("gpl2.only",)),
    ("GPL-3.0-only", ("gpl3.only",)),
    ("LGPL-2.0-or-later", ("lgpl2.later",)),
    ("LGPL-2.1-or-later", ("lgpl21.later",)),
    ("LGPL-2.1-only", ("lgpl21.only",)),
    ("LGPL-3.0-or-later", ("lgpl3.later",)),
    ("AGPL-3.0-or-later", ("agpl3.later",)),
    ("AGPL-3.0-only", ("agpl3.only",)),
    ("Apache-2.0", ("apache.the",)),
    ("Apache-2.0", ("apache.named",)),
    ("MIT", ("mit.named",)),
    ("MIT", ("mit.under",)),
    ("MIT", ("mit.this",)),
    ("GPL-3.0", ("gpl3.named",)),
    ("GPL-3.0", ("gpl3.under",)),
    ("GPL-2.0", ("gpl2.under",)),
    ("LGPL-3.0", ("lgpl.under",)),
    ("MPL-2.0", ("mpl.terms",)),
    ("CC-BY-NC-4.0", ("ccbync.named",)),
    ("CC-BY-NC-4.0", ("ccbync.work",)),
    ("CC-BY-SA-4.0", ("ccbysa.named",)),
    ("CC-BY-4.0", ("ccby.named",)),
    ("CC-BY-4.0", ("ccby.work",)),
    ("Unlicense", ("unlicense.free",)),
)

CUES = ("licens", "permission", "warrant", "redistribut", "copyright", "software")
RESULTS = ["sentence_ids", "licenses"]
READINGS = ("joined", "lines")
#: A mark of comments and lists before a sentence, and the ends of sentences.
LINE_START = r"(?m)^[ \t]*(?:#+|//+|\*+|--|;+|>+|[0-9]+\.(?![0-9]))[ \t]*"
#: Not the full stop of "v. 2.0" or of "Foo Inc. nor", and not the marks that the GNU notices have inside.
INC = r"(?:(?<=\binc\.)|(?<=\bltd\.)|(?<=\bcorp\.)|(?<=\bco\.))\s+(?:and|or)"
ENDS = rf"(?:(?<!\bv)\.(?!(?:\s+(?:nor|may (?:not )?be used to endorse)|{INC})\b)|[:;](?!\s+(?:you can redistribute|either version|version [0-9])\b)|[!?])(?=\s|$)"


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {plain(s): i for i, s in SENTENCES.items()}
if any(not any(cue in s for cue in CUES) for s in KNOWN):
    raise ValueError("a known sentence has no cue word")
if any(re.search(ENDS, s.lower()) for s in SENTENCES.values()):
    raise ValueError("a known sentence is cut")
#: Parts that vary, of plain sentences: words that a sentence has, what is replaced and by what.
GNU_NAMED = plain("is free software you can redistribute it")
ENDORSE = plain("may be used to endorse or promote products derived from this software without specific prior written permission")
NOT_ENDORSE = ENDORSE.replace("may be", "may not be")
VARIABLE = (
    (GNU_NAMED, f"^.* {GNU_NAMED} ", f"this program {GNU_NAMED} "),
    (ENDORSE, f"^neither .+ {ENDORSE}$", plain(SENTENCES["bsd.names"])),
    (NOT_ENDORSE, f"^the names? of .+ {NOT_ENDORSE}$", plain(SENTENCES["bsd.names"])),
)


def has_cue(lowered: Column) -> Column:
    found = F.lit(False)
    for cue in CUES:
        found = found | lowered.contains(cue)
    return found


def replaced(words: str, pattern: str, fixed: str):
    return lambda s: F.when(s.contains(words), F.regexp_replace(s, pattern, fixed)).otherwise(s)


def marked(i: str | Column) -> Column:
    """An identifier between marks of its own, so that neighbours share none."""
    return F.concat(F.lit("<"), F.lit(i), F.lit(">"))


def identified(lowered: Column, ends: str) -> Column:
    """Identifiers of the known sentences, in their order, as one string: "<a><b>"."""
    sentences = F.filter(F.split(lowered, ends, -1), has_cue)
    spelled = F.transform(sentences, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    for words, pattern, fixed in VARIABLE:
        spelled = F.transform(spelled, replaced(words, pattern, fixed))
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    ids = F.filter(F.transform(spelled, lambda s: F.try_element_at(names, s)), lambda x: x.isNotNull())
    return F.array_join(F.transform(ids, marked), "")


def times_in(sequence: Column, text: Column) -> Column:
    return F.length(sequence) - F.length(F.replace(sequence, text, F.lit("")))


def licences_in(readings: Column) -> Column:
    """Licences of the two readings, in the order of the rules that found them.

    What only one reading finds counts if that reading holds the rule's sequence more often: else the
    other one has used the same sentences for a longer rule.
    """
    rest = [readings[r].alias(r) for r in READINGS]
    state = F.struct(*rest, readings.alias("all"), F.array().cast("array<string>").alias("out"))

    def use(rule):
        name, ids = rule
        text = F.concat(*map(marked, ids))

        def step(s: Column) -> Column:
            one, two = (s[r].contains(text) for r in READINGS)
            first, second = (times_in(s["all"][r], text) for r in READINGS)
            found = (one & two) | (one & (first > second)) | (two & (second > first))
            left = [F.when(s[r].contains(text), F.replace(s[r], text, F.lit("|"))).otherwise(s[r]).alias(r) for r in READINGS]
            return F.struct(*left, s["all"].alias("all"), F.when(found, F.array_append(s["out"], F.lit(name))).otherwise(s["out"]).alias("out"))

        return step

    for rule in RULES:
        state = let(state, use(rule))
    return F.array_distinct(state["out"])


def scan_licences(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with sentence_ids (the longer reading) and licenses, both arrays of strings."""
    df = replace_columns(df, RESULTS)

    def readings(t: Column) -> Column:
        bare = F.regexp_replace(t, LINE_START, "")
        return F.struct(
            identified(F.regexp_replace(bare, r"(?<!\n)\n(?![ \t]*\n)", " "), rf"{ENDS}|\n").alias("joined"),
            identified(bare, rf"{ENDS}|\n").alias("lines"),
        )

    def found(r: Column) -> Column:
        longer = F.when(F.length(r["joined"]) >= F.length(r["lines"]), r["joined"]).otherwise(r["lines"])
        licences = licences_in(r)
        return F.struct(F.filter(F.split(longer, "[<>]+"), lambda x: x != "").alias("ids"), licences.alias("licenses"))

    nothing = F.array().cast("array<string>")
    lowered = F.lower(whole(text_col))
    result = let(lowered, lambda t: F.when(has_cue(t), let(readings(t), found)))
    return df.withColumn("licenses", result).withColumns(
        {
            "sentence_ids": F.coalesce(F.col("licenses")["ids"], nothing),
            "licenses": F.coalesce(F.col("licenses")["licenses"], nothing),
        }
    )
