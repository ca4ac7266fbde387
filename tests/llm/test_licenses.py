import random

import pytest
from headway.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), max_rows=150)


def test_held_out_paragraphs(model):
    rng = random.Random(99)  # other alterations than in training
    pool = ["lorem", "ipsum", "here", "code", "project"]
    right = total = 0
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            for _ in range(10):
                p = model.chances(licenses._altered(rng, licenses.words(t), pool))
                right += model.families[int(p.argmax())] == family
                total += 1
    assert right >= 0.93 * total
    for t in licenses.NEAR_MISSES + ["Es wurde ein neues Haus gebaut.", "the quick brown fox"]:
        assert model.families[int(model.chances(licenses.words(t)).argmax())] == licenses.OTHER


def test_scan(spark, make_docs, model):
    rows = [(1, "Intro text.\nThis work is licensed under the GNU General Public License, version 3."), (2, "Licensed under CC BY-NC 4.0.\nmore\nReleased under the MIT License."), (3, None), (4, ""), (5, "The driver lost his license."), (1, "x\nAll rights reserved."), (None, "Licensed under the Apache License, Version 2.0."), (6, "word " * 60_000)]
    got = sorted((str(r.doc_id), r.paragraph, r.family) for r in licenses.scan(make_docs(rows).selectExpr("*", "1 as family"), model).collect())
    assert got == [("1", 0, "GPL-3.0"), ("1", 0, "Proprietary"), ("2", 0, "CC-BY-NC-4.0"), ("2", 0, "MIT"), ("None", 0, "Apache-2.0")]
    assert licenses.scan(make_docs(rows).filter("false"), model).count() == 0


def test_planted_lines_of_the_corpus(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id for r in licenses.scan(docs, model).collect()}
    want = {r.doc_id for r in docs.collect() for x in r.text.split("\n") if "icensed under" in x or "All rights reserved" in x or "MIT License" in x}
    assert got >= want and len(got) <= len(want) + 2


NOTICES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices(spark, make_docs, model, mark):
    import textwrap

    rows, want = [], []
    for i, (family, text) in enumerate(NOTICES.items()):
        lines = [mark + x for x in textwrap.wrap(text, 60)]
        rows.append((i, "\n".join(["import os", "", *lines, mark.rstrip(), "def main(): pass"])))
        want.append((i, 1, family))
        rows.append((100 + i, "some words of prose that go on " * 40 + text + " and then more of them" * 40))  # inside a long line
        want.append((100 + i, 0, family))
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(make_docs(rows), model).collect()}
    assert got == set(want)


def test_finds_what_a_plain_scan_finds(spark, make_docs, model):
    """Every stretch of every length of a template, judged alone."""
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(300)]
    rows, want = [], set()
    for i in range(60):
        body = [rng.choice(pool) for _ in range(rng.randrange(5, 200))]
        if i % 3 == 0:
            family = rng.choice(list(licenses.TEMPLATES))
            at = rng.randrange(len(body))
            body[at:at] = licenses.words(rng.choice(licenses.TEMPLATES[family]))
        rows.append((i, " ".join(body)))
        places = []
        for family in licenses.TEMPLATES:
            match, a, z = licenses._best(body, family)
            if match >= 0.7 and model.chances(body[a:z])[model.families.index(family)] >= 0.6:
                places.append((-match * (z - a), family, a, z))
        taken = []
        for _, family, a, z in sorted(places):
            if all(z <= x or a >= y for x, y in taken):
                taken.append((a, z))
                want.add((i, family))
    got = {(r.doc_id, r.family) for r in licenses.scan(make_docs(rows), model).collect() if r.family != "unknown"}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_training_takes_a_document_once(spark, make_docs):
    docs = make_docs([(7, "a b c\nd e f")] * 500 + [(8, "x")])
    assert sorted(r.text for r in licenses._sample(docs, 10).collect()) == ["a b c\nd e f", "x"]


def test_no_corpus(spark, make_docs):
    m = licenses.train(make_docs([(1, "a")]).filter("false"), per_template=2, epochs=1)
    assert len(m.families) == len(licenses.TEMPLATES) + 1


def test_template_window():
    assert licenses.template_match(licenses.words("x y " + licenses.TEMPLATES["MIT"][0] + " z"), "MIT") == 1.0
    assert licenses.template_match([], "MIT") == 0.0
