"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, each in a normal form; known sentences have identifiers.  A paragraph is read in two ways, as
lines of which some are wrapped and as one run of words, and the way with more text in known sentences counts, by lines if equal.
The sequence of identifiers is matched against ordered rules: a rule takes the runs of identifiers that it names, and what
is taken is not matched again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ends of sentences that white space follows.
SENTENCE_END = r"([.;!?])[ \t\r\f]+"
#: What comments put before a line's words, and what parts paragraphs.
MARKERS = r"(^|\n)[ \t]*(?:/[*]+|[*]+/|//+|#+|[*]+|--+|;+|%+|<!--)[ \t]*"
PARAGRAPH_END = r"\n(?:[ \t\r]*\n)+"
#: Stands for the end of a paragraph while a text is in normal form.
MARK = "\x01"
#: Wrapped lines: the next one goes on in small letters, or both are in capitals; wide white space at its start is dropped.
WRAPPED = (r"([a-z0-9,][ \t]*)\r?\n[ \t]*([a-z(])", r"([A-Z]{2}[,.]?[ \t]*)\r?\n[ \t]*([A-Z]{2})")

#: Normal forms of licence sentences and their identifiers: fixed values.
SENTENCES = {
    "mit_name": "released under the mit license",
    "mit_name_the": "the mit license mit",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_name": "licensed under the apache license version 2 0",
    "apache_file": "licensed under the apache license version 2 0 the license",
    "apache_only": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "gpl3_name": "this work is licensed under the gnu general public license version 3",
    "gpl_notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_free": "this program is free software",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_4": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd_terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "all_rights": "all rights reserved",
    "mit_title": "mit license",
    "gpl_open": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl_open": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl_free": "this library is free software",
    "either_2": "either version 2 of the license or at your option any later version",
    "either_2_1": "either version 2 1 of the license or at your option any later version",
    "either_3": "either version 3 of the license or at your option any later version",
    "gpl2_notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl3_notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl_notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl_form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib_warranty": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc_by_sa_4": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "spdx_mit": "spdx license identifier mit",
    "spdx_bsd2": "spdx license identifier bsd 2 clause",
    "spdx_bsd3": "spdx license identifier bsd 3 clause",
    "spdx_isc": "spdx license identifier isc",
    "spdx_mpl2": "spdx license identifier mpl 2 0",
    "spdx_gpl2": "spdx license identifier gpl 2 0 only",
    "spdx_gpl2_later": "spdx license identifier gpl 2 0 or later",
    "spdx_lgpl21": "spdx license identifier lgpl 2 1 or later",
    "spdx_agpl3": "spdx license identifier agpl 3 0 or later",
    "spdx_unlicense": "spdx license identifier unlicense",
    "spdx_apache": "spdx license identifier apache 2 0",
    "spdx_gpl3": "spdx license identifier gpl 3 0 or later",
}


@dataclass(frozen=True)
class LicenseRule:
    license: str
    #: Identifiers in the order in which they must follow each other among a text's known sentences.
    sentences: tuple[str, ...]
    verdict: str


#: Longer rules come before the shorter ones that they contain.
RULES = (
    LicenseRule("MIT", ("mit_name_the", "mit_grant", "mit_notice", "as_is"), "permissive"),
    LicenseRule("MIT", ("mit_grant", "mit_notice", "as_is"), "permissive"),
    LicenseRule("Apache-2.0", ("apache_file", "apache_only", "apache_copy"), "permissive"),
    LicenseRule("GPL-3.0-or-later", ("gpl_notice",), "copyleft"),
    LicenseRule("GPL-3.0-or-later", ("gpl_free", "gpl_terms"), "copyleft"),
    LicenseRule("GPL-3.0-or-later", ("gpl_free", "gpl_open", "either_3"), "copyleft"),
    LicenseRule("GPL-2.0-or-later", ("gpl_free", "gpl_open", "either_2"), "copyleft"),
    LicenseRule("GPL-2.0-or-later", ("gpl2_notice",), "copyleft"),
    LicenseRule("LGPL-2.1-or-later", ("lgpl_free", "lgpl_open", "either_2_1"), "copyleft"),
    LicenseRule("LGPL-3.0-or-later", ("lgpl3_notice",), "copyleft"),
    LicenseRule("AGPL-3.0-or-later", ("agpl_notice",), "copyleft"),
    LicenseRule("MPL-2.0", ("mpl_form", "mpl_copy"), "copyleft"),
    LicenseRule("BSD-3-Clause", ("bsd_terms", "bsd_source", "bsd_binary", "bsd_names", "bsd_warranty"), "permissive"),
    LicenseRule("BSD-2-Clause", ("bsd_terms", "bsd_source", "bsd_binary", "bsd_warranty"), "permissive"),
    LicenseRule("ISC", ("isc_grant", "isc_warranty"), "permissive"),
    LicenseRule("ISC", ("isc_grant_and", "isc_warranty"), "permissive"),
    LicenseRule("Unlicense", ("unlicense_free", "unlicense_anyone"), "permissive"),
    LicenseRule("Zlib", ("zlib_warranty", "zlib_grant"), "permissive"),
    LicenseRule("ISC", ("isc_grant",), "permissive"),
    LicenseRule("ISC", ("isc_grant_and",), "permissive"),
    LicenseRule("Unlicense", ("unlicense_free",), "permissive"),
    LicenseRule("MIT", ("mit_title",), "permissive"),
    LicenseRule("BSD-2-Clause", ("spdx_bsd2",), "permissive"),
    LicenseRule("BSD-3-Clause", ("spdx_bsd3",), "permissive"),
    LicenseRule("ISC", ("spdx_isc",), "permissive"),
    LicenseRule("MPL-2.0", ("spdx_mpl2",), "copyleft"),
    LicenseRule("GPL-2.0-only", ("spdx_gpl2",), "copyleft"),
    LicenseRule("GPL-2.0-or-later", ("spdx_gpl2_later",), "copyleft"),
    LicenseRule("LGPL-2.1-or-later", ("spdx_lgpl21",), "copyleft"),
    LicenseRule("AGPL-3.0-or-later", ("spdx_agpl3",), "copyleft"),
    LicenseRule("Unlicense", ("spdx_unlicense",), "permissive"),
    LicenseRule("CC-BY-SA-4.0", ("cc_by_sa_4",), "copyleft"),
    LicenseRule("MIT", ("mit_grant",), "permissive"),
    LicenseRule("MIT", ("mit_name",), "permissive"),
    LicenseRule("MIT", ("spdx_mit",), "permissive"),
    LicenseRule("Apache-2.0", ("apache_name",), "permissive"),
    LicenseRule("Apache-2.0", ("spdx_apache",), "permissive"),
    LicenseRule("BSD", ("bsd_terms",), "permissive"),
    LicenseRule("CC-BY-4.0", ("cc_by_4",), "permissive"),
    LicenseRule("GPL-3.0", ("gpl3_name",), "copyleft"),
    LicenseRule("GPL-3.0-or-later", ("spdx_gpl3",), "copyleft"),
    LicenseRule("CC-BY-NC-4.0", ("cc_by_nc_4",), "restricted"),
    LicenseRule("proprietary", ("all_rights",), "restricted"),
)
#: The strictest verdict of a text's licences stands for it.
STRICTEST = ("restricted", "copyleft", "permissive")


def normal_paragraphs(text: Column, joined: bool) -> Column:
    """Paragraphs in normal form: lower case for A to Z, other signs than letters and digits of ASCII as one blank each run.

    A line feed ends a sentence; those of the text are ends where lines aren't wrapped, or none are if ``joined``.
    """
    cut = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), MARKERS, "$1"), PARAGRAPH_END, MARK)
    for pattern, to in [("\n", " ")] if joined else [(p, "$1 $2") for p in WRAPPED]:
        cut = F.regexp_replace(cut, pattern, to)
    cut = F.regexp_replace(cut, SENTENCE_END, "$1\n")
    return F.split(F.regexp_replace(F.translate(cut, UPPER, UPPER.lower()), f"[^a-z0-9\n{MARK}]+", " "), MARK)


def normal_sentences(text: Column, known: Sequence[str]) -> Column:
    """The sentences of a text, each paragraph's in the way in which more of it is known."""
    cut = lambda p: F.filter(F.transform(F.split(p, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    size = lambda s: F.length(F.array_join(F.filter(s, lambda x: x.isin(list(known))), ""))
    ways = F.arrays_zip(F.transform(normal_paragraphs(text, False), cut).alias("lines"), F.transform(normal_paragraphs(text, True), cut).alias("run"))
    return F.flatten(F.transform(ways, lambda w: F.when(size(w["run"]) > size(w["lines"]), w["run"]).otherwise(w["lines"])))


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: Sequence[LicenseRule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_sentences, n_known, sentence_ids, licenses, verdict`` of each row.

    ``sentence_ids`` are the known sentences in order, ``licenses`` the licences of the rules that matched, in the order of
    the rules and each once, both joined by commas; ``verdict`` is the strictest, ``unknown`` if known sentences fit no
    rule, and ``none`` without any.  A null or empty text has no sentences.  Sentences and rules become part of the plan;
    both lists are short.  Repeated rows are scanned each on its own.
    """
    sentences = SENTENCES if sentences is None else sentences
    ids = F.create_map(*[F.lit(x) for name, s in sentences.items() for x in (s, name)])
    known = list(sentences.values())
    rows = docs.select(F.col(key).alias(key), normal_sentences(F.col(text).cast("string"), known).alias("s"))
    rows = rows.select(key, F.size("s").cast("long").alias("n_sentences"), F.filter("s", lambda s: s.isin(known)).alias("s"))
    rows = rows.withColumn("ids", F.transform("s", lambda s: F.try_element_at(ids, s)))
    rows = rows.withColumn("left", F.when(F.size("ids") > 0, F.concat(F.lit(";"), F.array_join("ids", ";;"), F.lit(";"))).otherwise(""))
    hits = []
    for k, rule in enumerate(rules):
        pattern = "".join(f";{s};" for s in rule.sentences)
        hits.append(f"hit{k}")
        rows = rows.withColumns({f"hit{k}": F.contains(F.col("left"), F.lit(pattern)), "left": F.replace("left", F.lit(pattern), F.lit("|"))})
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(h), r.license) for h, r in zip(hits, rules, strict=True)])))
    worst = F.coalesce(*[F.when(F.exists(F.array(*[F.col(h) for h, r in zip(hits, rules, strict=True) if r.verdict == v] or [F.lit(False)]), lambda x: x), v) for v in STRICTEST])
    verdict = F.coalesce(worst, F.when(F.size("ids") > 0, "unknown").otherwise("none"))
    return rows.select(key, "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(found, ",").alias("licenses"), verdict.alias("verdict"))


def scan_sql(sentences: dict[str, str] | None = None, rules: Sequence[LicenseRule] = RULES) -> str:
    """The scan of table ``documents`` in DuckDB's SQL."""
    sentences = SENTENCES if sentences is None else sentences
    names = ", ".join(f"'{n}'" for n in sentences)
    texts = ", ".join(f"'{s}'" for s in sentences.values())
    steps, left = [], "base"
    marked = f"regexp_replace(regexp_replace(coalesce(text, ''), '{MARKERS}', '\\1', 'g'), '{PARAGRAPH_END}', chr(1), 'g')"
    lines, run = marked, f"replace({marked}, '\n', ' ')"
    for pattern in WRAPPED:
        lines = f"regexp_replace({lines}, '{pattern}', '\\1 \\2', 'g')"
    cut = lambda x: (
        f"list_transform(string_split(regexp_replace(translate(regexp_replace({x}, '{SENTENCE_END}', '\\1\n', 'g'), '{UPPER}', '{UPPER.lower()}'), '[^a-z0-9\n\\x01]+', ' ', 'g'), chr(1)), "
        "lambda p: list_filter(list_transform(string_split(p, '\n'), lambda s: trim(s)), lambda s: s <> ''))"
    )
    size = lambda x: f"len(array_to_string(list_filter({x}, lambda s: list_contains([{texts}], s)), ''))"
    for k, rule in enumerate(rules):
        pattern = "".join(f";{s};" for s in rule.sentences)
        taken = ", ".join([*(f"hit{j}" for j in range(k)), f"contains(rest, '{pattern}') AS hit{k}"])
        steps.append(f"r{k} AS (SELECT doc_id, n_sentences, ids, {taken}, replace(rest, '{pattern}', '|') AS rest FROM {left})")
        left = f"r{k}"
    firsts = [next(j for j, q in enumerate(rules) if q.license == r.license) for r in rules]
    any_of = lambda v: " OR ".join([f"hit{k}" for k, r in enumerate(rules) if r.verdict == v] or ["false"])
    distinct = ", ".join(f"CASE WHEN hit{k} AND NOT ({' OR '.join([f'hit{j}' for j in range(k) if firsts[j] == firsts[k]] or ['false'])}) THEN '{r.license}' END" for k, r in enumerate(rules))
    return f"""
WITH ways AS (SELECT doc_id, unnest(list_zip({cut(lines)}, {cut(run)})) AS w, generate_subscripts({cut(lines)}, 1) AS i FROM documents),
cut AS (SELECT doc_id, flatten(list(CASE WHEN {size("w[2]")} > {size("w[1]")} THEN w[2] ELSE w[1] END ORDER BY i)) AS s FROM ways GROUP BY doc_id),
known AS (
  SELECT doc_id, len(s) AS n_sentences, list_transform(list_filter(s, lambda x: list_contains([{texts}], x)),
    lambda x: ([{names}])[list_position([{texts}], x)]) AS ids FROM cut),
base AS (SELECT doc_id, n_sentences, ids, CASE WHEN len(ids) > 0 THEN ';' || array_to_string(ids, ';;') || ';' ELSE '' END AS rest FROM known),
{", ".join(steps)}
SELECT doc_id, n_sentences, len(ids) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter([{distinct}], lambda x: x IS NOT NULL), ','), '') AS licenses,
  CASE {" ".join(f"WHEN {any_of(v)} THEN '{v}'" for v in STRICTEST)} WHEN len(ids) > 0 THEN 'unknown' ELSE 'none' END AS verdict
FROM {left}"""
