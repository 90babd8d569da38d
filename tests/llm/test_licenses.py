"""Licence rules against a plain loop over all rules, places and pairs of detections."""

import re

from compare import database, differences
from orderlens.llm import licenses, queries
from orderlens.llm.license_rules import BASE, RULES

SF = "/root/testdata/sf0.01"
WORD = re.compile(licenses.WORD)
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def detections(text):
    w, out = words(text), []
    for i in range(len(w)):
        ahead = " ".join(w[i:]) + " "
        for n, r in enumerate(RULES):
            m = re.match(f"{r.pattern} ", ahead)
            if m:
                out.append((i, i + m[0].count(" "), r.priority, n))
    return out


def summary(text):
    found = detections(text)
    told = []
    for f in found:
        better = any(
            g != f and g[0] <= f[0] and g[1] >= f[1] and (g[2] < f[2] or (g[2] == f[2] and (g[1] - g[0] > f[1] - f[0] or g[3] < f[3])))
            for g in found
        )
        if RULES[f[3]].base or not better:
            told.append(f)
    base = [f for f in found if RULES[f[3]].base]
    label = lambda fs: ",".join(sorted({RULES[f[3]].label for f in fs}))
    starts = [f[0] for f in base] or [None]
    return (len(words(text)), len(base), min(starts), max(starts), label(base), label(told), max((RULES[f[3]].weight for f in told), default=0.0))


TEXTS = [
    None,
    "",
    " \n.;",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "gnu general public license gnu general\npublic license v3 or later, GPL-2.0-only",
    "# SPDX-License-Identifier: GPL-3.0-or-later\n// MIT License; mit licence; mit  license",
    "cc by cc by 4.0 CC-BY-SA-4.0 creative commons attribution-sharealike 4.0 international license http://creativecommons.org/licenses/by/4.0/",
    "ich komme mit License oder mit Lizenz, die Kinder kommen mit",
    "all rights reserved. Copyright (c) 2019 Foo. Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that",
    "the license is the license of the apache license",
    "Released under the MIT license, the new bsd license, or the zlib license; available under gplv3; license: isc",
    "MİT lIcense, Kcc by Kcc by",
    "mit license " * 3000,
    "x " * 50_000 + "Apache License 2.0",
]


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT2 string").withColumnRenamed("TEXT2", "label")
    out = licenses.summary(licenses.detect(df)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in out), key=str)


def test_against_a_plain_loop(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, TEXTS[4], None), (None, None, None)]
    known = {t: summary(t) if not t or len(t) < 30_000 else None for t in TEXTS}
    known[TEXTS[12]] = (6000, 3000, 0, 5998, "mit", "mit", summary("mit license " * 3)[6])
    known[TEXTS[13]] = (50_004, 1, 50_000, 50_000, "apache", summary("Apache License 2.0")[5], summary("Apache License 2.0")[6])
    assert scanned(spark, rows) == sorted(((i, *known[t]) for i, t, _ in rows), key=str)


def test_base_phrases_in_any_layout(spark):
    for phrase, label in BASE:
        text = f"a {phrase.upper().replace(' ', ' *  ')}. b-{phrase.replace(' ', '-')}"
        got = scanned(spark, [(1, text, None)])[0]
        assert got[2] == 2 and got[5] == label


def test_rules_are_well_formed():
    assert len(RULES) > 300
    for r in RULES:
        re.compile(r.pattern)
        assert r.pattern.count(" ") < licenses.REACH // 2 or r.pattern.count("{") == 0
        assert all(r.pattern.startswith(s.split(" ")[0]) for s in r.starts)


def test_no_texts(spark, no_docs):
    assert licenses.summary(licenses.detect(no_docs)).collect() == []


def test_no_python_in_the_plan(spark, capsys):
    queries.op13_license_rules(spark, SF).explain()
    assert "Python" not in capsys.readouterr().out and "Arrow" not in capsys.readouterr().out


def test_op13_equals_its_twin(spark):
    want = database(SF).sql(queries.ORACLES["op13_license_rules"]).to_arrow_table()
    assert differences(queries.op13_license_rules(spark, SF).toArrow(), want) == []
