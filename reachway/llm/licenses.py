"""Licence recognition by sentences and rules, in DataFrame functions only.

A text is split into sentences, sentences and runs of adjacent ones are normalised and mapped to the identifier of a known licence sentence, and the
sequence of identifiers is matched against ordered rules: a rule is a sequence of identifiers that must occur one after another, other
sentences between them aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import replaced

#: Known sentences in normalised form (lower case, runs of anything but letters and digits as one space).
SENTENCES = {
    "apache-ref": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache-asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3-ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl-grant": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-grant": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2-ref": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by-nc-4": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-4": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-4": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "reserved": ["all rights reserved"],
}
#: (rule, licence, whether it allows commercial reuse, identifiers in order). Longer rules of a licence are listed first.
RULES = [
    ("apache-2.0-header", "Apache-2.0", True, ["apache-ref", "apache-comply", "apache-copy", "apache-asis"]),
    ("apache-2.0-reference", "Apache-2.0", True, ["apache-ref"]),
    ("mit-text", "MIT", True, ["mit-grant", "mit-notice", "mit-asis"]),
    ("mit-reference", "MIT", True, ["mit-ref"]),
    ("gpl-3.0-header", "GPL-3.0", True, ["gpl-grant", "gpl-warranty"]),
    ("gpl-3.0-reference", "GPL-3.0", True, ["gpl3-ref"]),
    ("gpl-2.0-header", "GPL-2.0-or-later", True, ["gpl2-grant", "gpl-warranty"]),
    ("bsd-3-clause-text", "BSD-3-Clause", True, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("bsd-2-clause-text", "BSD-2-Clause", True, ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("mpl-2.0-reference", "MPL-2.0", True, ["mpl2-ref"]),
    ("isc-text", "ISC", True, ["isc-grant"]),
    ("cc-by-nc-4.0-reference", "CC-BY-NC-4.0", False, ["cc-by-nc-4"]),
    ("cc-by-4.0-reference", "CC-BY-4.0", True, ["cc-by-4"]),
    ("cc-by-sa-4.0-reference", "CC-BY-SA-4.0", True, ["cc-by-sa-4"]),
    ("cc0-waiver", "CC0-1.0", True, ["cc0"]),
    ("all-rights-reserved", "LicenseRef-reserved", False, ["reserved"]),
]
#: A sentence ends at a line end that a capital, a list mark or an empty line follows, or at a full stop, semicolon, exclamation or question mark before white space.
_END = r"(?<=[.!?;])[ \t\r\n]+|\n[ \t\r]*\n|\n(?=[ \t]*(?:[A-Z*#/0-9-]))"
_KNOWN = {s: k for k, ss in SENTENCES.items() for s in ss}


def normalised(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


#: Words of which every known sentence has one (tested).
_HINT = "(?i)licen[cs]e|rights|permission|redistribut|warrant"
#: Marks the ends of sentences in normalised text.
_MARK = "\x01"
#: A known sentence that starts and stops at ends of sentences, whatever ends lie within: wrapped lines, comment marks, semicolons. Longer ones first.
_RUN = f"{_MARK} ?(" + "|".join(s.replace(" ", f"[ {_MARK}]+") for s in sorted(_KNOWN, key=len, reverse=True)) + f") ?(?={_MARK})"


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order. A known sentence is one sentence or a run of adjacent ones."""
    marked = F.concat(F.lit(_MARK), F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _MARK, "_"), _END, _MARK), F.lit(_MARK))
    plain = F.regexp_replace(F.lower(marked), f"[^a-z0-9{_MARK}]+", " ")
    known = F.create_map(*[x for k, v in _KNOWN.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(F.regexp_extract_all(plain, F.lit(_RUN), F.lit(1)), lambda s: F.element_at(known, normalised(s)))


def _occurs(seq: Column, ids: list[str]) -> Column:
    """Whether the identifiers occur in this order: each is looked for behind the first place of the last one, so that any number of sentences is one pass for each identifier."""
    at = F.lit(1)
    for x in ids:
        at = F.call_function("locate", F.lit(f"<{x}>"), seq, at)  # 0 if there is none, and from 0 on
    return at > 0


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids (string: identifiers in order, each in angle brackets), rules and licenses (arrays of strings: the matched rules in the
    order of RULES, and their distinct licences in that order) and reusable (boolean: true if every licence found allows commercial
    reuse, null if none is found).

    A null or empty text has no sentences: empty arrays and a null; an empty table gives an empty table. Texts of any length are scanned as a whole, with patterns that
    loop over single characters only, so that neither stack nor time grows faster than the text. Input columns of these names are replaced. One
    narrow pass without a shuffle; rows, repeated or not, are scanned on their own. A rule is not reported where a longer rule of
    the same licence, or one that holds all its sentences, matches. Of known sentences that start at one place the longest counts.
    """
    # sentence ids are made from text in one expression that is evaluated once for each row: rlike keeps most rows from it
    hinted = F.coalesce(F.col(f"`{text}`").rlike(_HINT), F.lit(False))
    joined = F.when(hinted, F.array_join(F.transform(identifiers(F.col(f"`{text}`")), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")).otherwise("")
    out = replaced(docs, sentence_ids=joined)
    seq = F.col("sentence_ids")
    found = []
    for i, (_, name, _, ids) in enumerate(RULES):
        hit = _occurs(seq, ids)
        for _, other, _, longer in RULES[:i]:
            if other == name or set(ids) < set(longer):
                hit = hit & ~_occurs(seq, longer)
        found.append(hit)
    none = F.lit(None).cast("string")
    rules = F.array_compact(F.array(*[F.when(h, F.lit(r[0])).otherwise(none) for h, r in zip(found, RULES, strict=True)]))
    names = F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(r[1])).otherwise(none) for h, r in zip(found, RULES, strict=True)])))
    bad = F.lit(False)
    for h, r in zip(found, RULES, strict=True):
        if not r[2]:
            bad = bad | h
    empty = F.array().cast("array<string>")
    out = replaced(out, rules=F.when(seq == "", empty).otherwise(rules), licenses=F.when(seq == "", empty).otherwise(names))
    return replaced(out, reusable=F.when(F.size("licenses") > 0, ~bad))


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, rules and licenses (joined by commas), reusable."""
    out = scan(docs.select("doc_id", "text"))
    return out.select("doc_id", "sentence_ids", F.array_join("rules", ",").alias("rules"), F.array_join("licenses", ",").alias("licenses"), "reusable")


def _pattern(ids: list[str]) -> str:
    return "<" + ">.*<".join(ids) + ">"


def _sql_list(what: int) -> str:
    parts, seen = [], []
    for i, r in enumerate(RULES):
        cond = f"regexp_matches(s, '{_pattern(r[3])}')"
        for other in RULES[:i]:
            if other[1] == r[1] or set(r[3]) < set(other[3]):
                cond += f" AND NOT regexp_matches(s, '{_pattern(other[3])}')"
        seen.append(cond)
    if what == 2:
        return " OR ".join(f"({c})" for c, r in zip(seen, RULES, strict=True) if not r[2])
    if what == 1:
        names = dict.fromkeys(r[1] for r in RULES)
        parts = ["CASE WHEN " + " OR ".join(f"({c})" for c, r in zip(seen, RULES, strict=True) if r[1] == n) + f" THEN '{n}' END" for n in names]
    else:
        parts = [f"CASE WHEN {c} THEN '{r[0]}' END" for c, r in zip(seen, RULES, strict=True)]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


#: A known sentence between doubled marks, so that one mark is left for the next sentence: RE2 has no look-around. Of several at one place the first listed, the longest, counts here too.
_RUN_SQL = "\x01 ?(" + "|".join(s.replace(" ", "[ \x01]+") for s in sorted(_KNOWN, key=len, reverse=True)) + ") ?\x01"
#: The same by SQL, wrapped sentences and whole licence texts included: sentence ends are marked, known sentences looked up in a table, rules matched by linear-time patterns.
ORACLE = rf"""
WITH known(sentence, id) AS (VALUES {', '.join(f"('{s}', '{k}')" for s, k in _KNOWN.items())}),
marked AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(1), '_'), '([.!?;])[ \t\r\n]+', '\1' || chr(1), 'g'), '\n[ \t\r]*\n', chr(1), 'g'), '\n([ \t]*[A-Z*#/0-9-])', chr(1) || '\1', 'g') AS t FROM documents
), plain AS (
  SELECT doc_id, replace(regexp_replace(lower(chr(1) || t || chr(1)), '[^a-z0-9\x01]+', ' ', 'g'), chr(1), chr(1) || chr(1)) AS t FROM marked
), parts AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS part FROM (SELECT doc_id, regexp_extract_all(t, '{_RUN_SQL}', 1) AS l FROM plain)
), ids AS (
  SELECT doc_id, pos, id FROM parts JOIN known ON trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) = sentence
), seq AS (
  SELECT documents.doc_id, coalesce(string_agg('<' || id || '>', '' ORDER BY pos), '') AS s FROM documents LEFT JOIN ids ON ids.doc_id = documents.doc_id GROUP BY documents.doc_id
)
SELECT doc_id, s AS sentence_ids, {_sql_list(0)} AS rules, {_sql_list(1)} AS licenses,
       CASE WHEN s LIKE '%<%' AND {_sql_list(1)} <> '' THEN NOT ({_sql_list(2)}) END AS reusable
FROM seq
"""
