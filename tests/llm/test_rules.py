import random
from collections import Counter

import duckdb
import pytest

from scalewright.llm import licenses, quality

from .helpers import WORD, corpus, frame, key

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(9)
    few = [" ".join(rng.choice("a b c dd é".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    return [*few, "a b c a b c", "x x x x x", "# $ %\n# $ %\n\n", "Home | About | News | Contact", "All rights reserved.", "a\x0bb\x0cc d e"]


def test_counts_equal_plain_ones(spark):
    rows = [*enumerate(texts(), 10000), *corpus()]
    got = quality.assess(frame(spark, rows)).collect()
    assert sorted((key((r.doc_id,)), tuple(r[n] for n in NAMES)) for r in got) == sorted((key((i,)), plain(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_colliding_prefixes_take_the_exact_path(spark, monkeypatch):
    monkeypatch.setattr(quality, "_PACKED", 8)
    rows = list(enumerate(texts()))
    got = quality.assess(frame(spark, rows)).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: plain(t)[-1] for i, t in rows}


def test_lines_that_fail_go(spark):
    good = "\n".join(" ".join(f"word{i * 12 + k}" for k in range(12)) + "." for i in range(10))  # no window twice
    menu = "Home | About | News | Contact | Help"
    got = {r.doc_id: r for r in quality.assess(frame(spark, [(1, good), (2, f"{good}\n{menu}\nAll rights reserved.\n"), (3, "\n".join(" | ".join(f"item{i * 9 + k}" for k in range(9)) for i in range(8)))])).collect()}
    assert got[1].kept and got[1].clean_text == good and got[1].n_failed_lines == 0
    assert got[2].kept and got[2].clean_text == f"{good}\n" and got[2].n_failed_lines == 2
    assert not got[3].kept and not got[3].base_failed


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x", 5)], "doc_id long, text string, kept string, n_words int")
    row = quality.assess(df).first()
    assert row.n_words == 0 and row.kept is False and row.clean_text == ""
    assert quality.assess(df.limit(0)).count() == 0 and licenses.scan(df.limit(0)).count() == 0


LICENSED = ["Released under the MIT License.", "Intro. Licensed under the Apache License, Version 2.0. Bye.", "All rights reserved.\nLicensed under CC BY-NC 4.0.", None, "", "the mit license", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nSomething else. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]


def test_licences(spark):
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t, "x") for i, t in enumerate(LICENSED)], "doc_id long, text string, licenses string")).collect()}
    assert [got[i].licenses for i in range(8)] == [["MIT"], ["Apache-2.0"], ["CC-BY-NC-4.0", "LicenseRef-reserved"], [], [], [], ["Apache-2.0"], ["BSD-2-Clause"]]
    assert got[7].sentence_ids == ["bsd-head", "bsd-source", "bsd-binary"]


@pytest.mark.parametrize("which", ["quality", "licenses"])
def test_sql_says_the_same(spark, which):
    rows = [*enumerate([*texts(), *LICENSED], 10000), *corpus()]
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).toPandas())
    if which == "quality":
        want = con.execute(quality.ORACLE).fetchall()
        got = [tuple(r) for r in quality.assess(frame(spark, rows)).select("doc_id", *NAMES, "base_failed", "kept").collect()]
    else:
        want = con.execute(licenses.ORACLE).fetchall()
        got = [(r.doc_id, len(r.sentence_ids), ",".join(r.licenses), r.rules) for r in licenses.scan(frame(spark, rows)).collect()]
    fix = lambda r: tuple(None if isinstance(x, float) and x != x else int(x) if isinstance(x, float) else x for x in r)
    assert sorted(map(fix, got), key=repr) == sorted(map(fix, want), key=repr)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of Foo, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GNU = """This {0} is free software: you can redistribute it and/or modify
it under the terms of the GNU {1} as published by
the Free Software Foundation, either version {2} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {1} for more details.
"""
MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright 2020 Someone
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
WRAPPED = {
    "MIT": MIT, "Apache-2.0": APACHE, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + ENDORSE, "MPL-2.0": MPL, "ISC": ISC,
    "GPL-3.0": GNU.format("program", "General Public License", "3"), "GPL-2.0": GNU.format("program", "General Public License", "2"), "AGPL-3.0": GNU.format("program", "Affero General Public License", "3"),
    "LGPL-2.1": GNU.format("library", "Lesser General Public License", "2.1"), "LGPL-3.0": GNU.format("program", "Lesser General Public License", "3"),
    "Unlicense": "This is free and unencumbered software released into\nthe public domain.\n",
}


@pytest.mark.parametrize("lead, end", [("", ""), (" * ", ""), ("# ", ""), ("// ", "\r"), ("dnl ", "")])
def test_wrapped_licences(spark, lead, end):
    rows = [(i, "Some code here\n" + "\n".join((lead + x).rstrip() + end for x in t.split("\n")) + "\nmore code") for i, t in enumerate(WRAPPED.values())]
    got = {r.doc_id: r.licenses for r in licenses.scan(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [[name] for name in WRAPPED]


@pytest.mark.parametrize("line, fails", [("这一行说完了。", False), ("यह पंक्ति पूरी है।", False), ("هل هذا سطر كامل؟", False), ("Это вся строка.", False), ("ይህ ሙሉ ነው።", False), ("これで終わり！", False), ("A carriage return follows.\r", False), ("Blanks follow. \t", False), ("no mark here", True), ("没有结束", True), ("TOUS DROITS RÉSERVÉS.", True), ("Alle Rechte Vorbehalten.", True), ("All Rights reserved.", True), ("x | y | z | w.", True), ("长" * 199 + "。" + "长", False), ("长" * 150, True)])
def test_marks_and_phrases_of_several_scripts(spark, line, fails):
    r = quality.assess(spark.createDataFrame([(1, line)], "doc_id long, text string")).first()
    assert (r.n_failed_lines == 1) is fails


def test_phrases_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "All rights reserved.\nEigene Worte stehen hier.")], "doc_id long, text string")
    assert [r.clean_text for r in quality.assess(df, phrases=("eigene worte",)).collect()] == ["All rights reserved."]
