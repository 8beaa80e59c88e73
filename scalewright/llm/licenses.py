"""Licence recognition by sentence rules, with DataFrame functions only."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, column_at

# Sentences of licences and notices, in normal form, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "licensed under the gnu general public license version 3": "gpl3-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-free",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc4-short",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4-long",
    "licensed under cc by 4 0": "cc-by4-short",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-head",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all rights reserved": "reserved",
}
#: More sentences, which the SQL below doesn't know.
MORE_SENTENCES = {
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "apache license version 2 0 january 2004": "apache2-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-free",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "gpl3-free",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-free",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-free",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-free",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-free",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-warranty",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-free",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "licensed under the bsd 3 clause license": "bsd3-short",
    "licensed under the bsd 2 clause license": "bsd2-short",
    "licensed under the isc license": "isc-short",
    "licensed under the mozilla public license version 2 0": "mpl2-short",
    "licensed under the gnu general public license version 2": "gpl2-short",
    "licensed under the gnu lesser general public license version 3": "lgpl3-short",
    "licensed under the gnu lesser general public license version 2 1": "lgpl21-short",
    "licensed under the gnu affero general public license version 3": "agpl3-short",
}
#: Licence rules: identifiers that follow one another, without regard to other sentences between.
RULES = (
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("apache2-head", "apache2-comply")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-3.0", ("gpl3-free", "gpl-warranty")),
    ("CC-BY-NC-4.0", ("cc-by-nc4-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-long",)),
    ("CC-BY-4.0", ("cc-by4-short",)),
    ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary")),
    ("LicenseRef-reserved", ("reserved",)),
)
#: And their rules.
MORE_RULES = (
    ("Apache-2.0", ("apache2-title",)),
    ("GPL-2.0", ("gpl2-free", "gpl-warranty")),
    ("GPL-2.0", ("gpl2-short",)),
    ("LGPL-2.1", ("lgpl21-free", "lgpl-warranty")),
    ("LGPL-2.1", ("lgpl21-short",)),
    ("LGPL-3.0", ("lgpl3-free", "lgpl-warranty")),
    ("LGPL-3.0", ("lgpl3-free", "gpl-warranty")),
    ("LGPL-3.0", ("lgpl3-short",)),
    ("AGPL-3.0", ("agpl3-free", "gpl-warranty")),
    ("AGPL-3.0", ("agpl3-short",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("MPL-2.0", ("mpl2-short",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-short",)),
    ("Unlicense", ("unlicense-head",)),
    ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd3-short",)),
    ("BSD-4-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd2-short",)),
)
#: Identifiers of which none may follow at once, for a rule to match.
UNLESS = {("bsd-head", "bsd-source", "bsd-binary"): ("bsd-endorse", "bsd-advert")}
#: Every sentence holds one of these; other sentences are not looked up.
MARKS = "licens|permission|copyright|software|redistribut|reserved|warrant"
#: Rewritings of a text in lower case, in turn. At the end "|" stands where a sentence ends for sure (a mark or a blank
#: line), a newline where it may, and all else is a-z, 0-9 and single spaces; comment signs go with the other signs.
NORMAL = (
    (r"\|", " "),
    (r"\r\n?", "\n"),
    (r"(?m)^[ \t]*(?:dnl|rem)\b", " "),
    (r"neither\W+the\W+names?\W+of\W+[^;|]{1,160}?\W+nor\W+the\W+names\W+of\W+(?:(?:its|any)\W+)?contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"\bv\.\s+(?=[0-9])", "v "),
    (r"without\W+any\W+warranty\W+without\W+even", "without any warranty without even"),
    (r"(?m)^[^a-z0-9\n]*(?:[0-9]{1,2}|[a-z])[.)](?=\s)", "|"),
    (r"[.!?;]+(?=\s)", "|"),
    (r"[^a-z0-9\n|]+", " "),
    (r" ?\n ?", "\n"),
    (r" ?\|[ |\n]*|\n\n+", "|"),
    (r"\A[ \n]+|[ \n]+\z", ""),
)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; where several begin, of the longest."""
    table = {**SENTENCES, **MORE_SENTENCES}
    known = F.create_map(*chain.from_iterable((F.lit(s), F.lit(k)) for s, k in table.items()))
    normal = F.lower(text)
    for what, by in NORMAL:
        normal = F.regexp_replace(normal, what, by)
    any_of = "|".join(s.replace(" ", "[ \\n]") for s in sorted(table, key=len, reverse=True))
    found = F.regexp_extract_all(normal, F.lit(f"(?<![^|\\n])(?:{any_of})(?![^|\\n])"), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with sentence_ids, licenses and rules.

    Sentences end at a mark before white space or at a blank line, and may begin and end at
    any newline, so wrapped ones, in comments too, are known as well as those in one line;
    in normal form they have lower case and single spaces for all that is neither a-z nor
    0-9. ``sentence_ids``
    holds the identifiers of the known ones in order, ``licenses`` the distinct licences
    in order of RULES and MORE_RULES, ``rules`` the number of rules that match. A rule matches where its
    identifiers follow one another and none of UNLESS comes next. A null or empty text has none; repeated rows are
    scanned each; columns of these names, in any case, are replaced; an empty table gives no rows.
    One pass without a shuffle.
    """
    missing = [s for s in (*SENTENCES, *MORE_SENTENCES) if not any(m in s for m in MARKS.split("|"))]
    if missing:
        raise ValueError(f"sentences without a mark: {missing}")
    given = docs.columns
    docs = bare(docs)[0]
    text = F.coalesce(F.col(column_at(given, text_col)).cast("string"), F.lit(""))
    rest = [f"_in{k}" for k, c in enumerate(given) if c.lower() not in ("sentence_ids", "licenses", "rules")]
    ids = F.when(F.rlike(F.lower(text), F.lit(MARKS)), identifiers(text)).otherwise(F.array().cast("array<string>"))
    seen = docs.select(*rest, ids.alias("sentence_ids"))
    sequence = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))

    def match(rule: tuple[str, ...]) -> Column:
        run = f",{','.join(rule)},"
        return F.rlike("_seq", F.lit(f"{run}(?!(?:{'|'.join(UNLESS[rule])}),)")) if rule in UNLESS else F.contains(F.col("_seq"), F.lit(run))

    hits = F.array(*(F.when(match(rule), F.lit(name)) for name, rule in (*RULES, *MORE_RULES)))
    return seen.withColumn("_seq", sequence).withColumn("_hits", F.array_compact(hits)).select(*rest, "sentence_ids", F.array_distinct("_hits").alias("licenses"), F.size("_hits").alias("rules")).toDF(*(given[int(c[3:])] for c in rest), "sentence_ids", "licenses", "rules")


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Of the tables as they were at first, and of sentences in one line: it says less where licences are wrapped or in MORE_SENTENCES.
ORACLE = rf"""
WITH known(s, k) AS (VALUES {", ".join(f"({_q(s)}, {_q(k)})" for s, k in SENTENCES.items())}),
rules(n, name, seq) AS (VALUES {", ".join(f"({n}, {_q(name)}, {_q(',' + ','.join(rule) + ',')})" for n, (name, rule) in enumerate(RULES))}),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM (SELECT r, string_split_regex(lower(text), '\n|[.!?;]+[ \t]+') AS parts FROM t)),
m AS (SELECT r, i, k FROM p JOIN known ON known.s = trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g'))),
q AS (SELECT r, count(*) AS n, ',' || string_agg(k, ',' ORDER BY i) || ',' AS seq FROM m GROUP BY r),
h AS (SELECT q.r, name, min(rules.n) AS first, count(*) AS hits FROM q JOIN rules ON contains(q.seq, rules.seq) GROUP BY q.r, name),
o AS (SELECT r, string_agg(name, ',' ORDER BY first) AS licenses, sum(hits) AS rules FROM h GROUP BY r)
SELECT doc_id, coalesce(q.n, 0)::BIGINT AS n_sentences, coalesce(licenses, '') AS licenses, coalesce(rules, 0)::BIGINT AS rules
FROM t LEFT JOIN q USING (r) LEFT JOIN o USING (r)
"""
