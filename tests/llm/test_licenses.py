import random

import pytest

from tests.llm.fixtures import corpus, frame
from twinsift.llm import licenses as lic
from twinsift.llm.common import alnum_words

NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
CASES = [
    (1, "x y Released under the MIT\nLicense. and The MIT-license", 2, (5, 9), "mit", "mit"),
    (2, "Licensed under the Apache License, Version 2.0; GNU general public license", 2, (3, 9), "apache,gpl", "apache,gpl"),
    (3, "mit the license, apache licenses, general public", 0, (None, None), "", ""),
    (4, f"bla bla {NOTICE} bla", 0, (None, None), "", "mit"),
    (5, f"bla {NOTICE.replace('granted', 'given')} bla", 0, (None, None), "", ""),  # the mandatory phrase is broken
    (6, NOTICE.replace("documentation", "paper"), 0, (None, None), "", "mit"),
    (7, "Licensed under CC BY-NC 4.0.", 0, (None, None), "", "cc-by-nc"),
    (8, "Licensed under CC BY 4.0.", 0, (None, None), "", "cc-by"),
    (9, "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", 1, (15, 15), "gpl", "gpl,lgpl"),
    (10, "MIT LICENSE " * 3000, 3000, (0, 5998), "mit", "mit"),
    (11, None, 0, (None, None), "", ""),
    (12, "", 0, (None, None), "", ""),
    (None, "mit license", 1, (0, 0), "mit", "mit"),
]


def test_cases(spark):
    rows = [(i, t, "en", 1, "x") for i, t, *_ in CASES] + corpus()
    got = {r["doc_id"]: r for r in lic.scan(frame(spark, [(i, t, "en", 1, "x") for i, t, *_ in CASES])).collect()}
    for i, text, n, ends, base, labels in CASES:
        r = got[i]
        assert (r["n_words"], r["n_base"], (r["first_word"], r["last_word"])) == (len(alnum_words((text or "").encode())), n, ends), i
        assert r["base_labels"] == base and 0 <= r["score"] <= 1, i
        if i not in (2,):
            assert r["labels"] == labels, (i, r["labels"])


def plain(text):
    """First and last places of the phrases by a plain search."""
    w = [x.decode() for x in alnum_words((text or "").encode())]
    places = [i for p, _ in lic.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min(places, default=None), max(places, default=None)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_base_against_plain_search(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = lic.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == plain(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        if "CC BY-NC 4.0" in texts[r["doc_id"]]:
            assert "cc-by-nc" in r["labels"].split(",")


def test_empty(spark):
    assert lic.scan(frame(spark, [])).count() == 0
    assert lic.scan(frame(spark)).count() == len(corpus())


def labels_by_definition(text, idf, templates, anchors=3, coverage=0.6, drift=4):
    """Method labels and score by looking at every shift of every template, word by word."""
    words = alnum_words((text or "").encode())
    labels, best = set(), 0.0
    for label, notice, must in templates:
        t = alnum_words(notice.encode())
        rare = sorted(set(t), key=lambda w: (-idf.get(w, 0.0), w))[:anchors]
        hit = lambda o, q: 0 <= q + o < len(words) and words[q + o] == t[q]  # noqa: E731, B023
        voted = {o: {t[q] for q in range(len(t)) if t[q] in rare and hit(o, q)} for o in range(-len(t), len(words) + drift)}
        for o in range(-len(t), len(words)):
            if not voted[o]:
                continue
            near = set().union(*(voted.get(o + d, set()) for d in range(drift + 1)))
            if len(near) < min(2, len(rare)):
                continue
            shifts = [[hit(o + d, q) for q in range(len(t))] for d in range(-drift, drift + 1)]
            met = max(shifts, key=sum)[:]
            for s in shifts:
                for q in range(len(t) - 2):
                    if s[q] and s[q + 1] and s[q + 2]:
                        met[q] = met[q + 1] = met[q + 2] = True
            place = b" ".join([b"", *words[max(0, o - drift) : max(0, o + len(t) + drift)], b""])
            if sum(met) / len(t) >= coverage and all(b" " + b" ".join(alnum_words(p.encode())) + b" " in place for p in must):
                labels.add(label)
                best = max(best, sum(met) / len(t))
    return labels, best


def damaged(rng, text):
    """A text with some words put in, left out or replaced."""
    words = []
    for w in text.split():
        x = rng.random()
        words += [w] if x > 0.12 else [w, "zz"] if x > 0.08 else ["zz"] if x > 0.04 else []
    return " ".join(words)


def test_labels_against_every_shift(spark):
    rng = random.Random(3)
    texts = []
    for k in range(60):
        parts = ["lorem " * rng.randint(0, 5)]
        for _, notice, _ in rng.sample(lic.TEMPLATES, 2):
            parts += [notice if k % 3 == 0 else damaged(rng, notice), "ipsum the of " * rng.randint(0, 4)]
        texts.append(" ".join(parts))
    docs = frame(spark, [(i, t, "en", 1, "x") for i, t in enumerate(texts)])
    idf = lic.word_idf(docs)
    found = 0
    for r in lic.scan(docs).collect():
        labels, score = labels_by_definition(texts[r["doc_id"]], idf, lic.TEMPLATES)
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == labels | base, texts[r["doc_id"]]
        assert abs(r["score"] - score) < 1e-12
        found += bool(labels)
    assert found > 30


ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def test_whole_licence_of_the_caller(spark):
    words = ISC.split()
    longer = " ".join([*words[:40], "some", "words", "more", *words[40:90], *words[92:]])
    other = " ".join(sorted(words))
    rows = [(1, ISC), (2, f"x y {longer} z"), (3, other), (4, " ".join(words[:30])), (5, None), (6, "isc licence " * 3)]
    docs = frame(spark, [(i, t, "en", 1, "x") for i, t in rows])
    templates = [("isc", ISC, ["hereby granted", "the author be liable"])]
    got = {r["doc_id"]: r for r in lic.scan(docs, templates=templates, phrases=[("isc licence", "isc-name")]).collect()}
    assert [got[i]["labels"] for i in range(1, 7)] == ["isc", "isc", "", "", "", "isc-name"]
    assert got[1]["score"] == 1 and 0.9 < got[2]["score"] < 1 and got[6]["n_base"] == 3
