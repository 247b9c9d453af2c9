"""Plain TF-IDF against a loop over all units, without cues."""

import math
import random
import re
from collections import Counter

import pytest

from polescale.llm import licenses


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def plain():
    bags = [Counter(words(t)) for _, t in licenses.TEMPLATES]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    vector = lambda bag: {w: n * idf.get(w, math.log(1 + len(bags)) + 1) for w, n in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(name, vector(b)) for (name, _), b in zip(licenses.TEMPLATES, bags)]

    def cosines(unit):
        v = vector(Counter(words(unit)))
        return [(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), name) for name, t in known] if v else []

    return cosines


def best(text, cosines):
    units = {*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text}
    found = [(-round(c, 9), name) for u in units for c, name in cosines(u) if round(c, 9) >= licenses.THRESHOLD]
    return min(found, default=(None, None))


def scan(spark, texts):
    files = spark.createDataFrame(list(enumerate(texts)), "_uid long, _text string")
    return {r._uid: (r.licence, r.score) for r in licenses.own_licences(files).collect() if r.licence}


def test_wrapped_header_matches(spark):
    lines = ["it under the terms of the GNU General Public License as published by", "you may not use this file except in compliance with the License.", "words"]
    got = scan(spark, lines)
    assert got[0][0] == "GPL-3.0" and got[0][1] == pytest.approx(0.686, abs=1e-3)
    assert got[1][0] == "Apache-2.0" and got[1][1] == pytest.approx(0.803, abs=1e-3) and 2 not in got


def test_whole_texts_match(spark):
    """A licence file with a copyright line before its text, also wrapped anew."""
    import textwrap

    whole = [(name, t) for name, t in licenses.TEMPLATES if len(t) > 200]
    assert {name for name, _ in whole} >= {"MIT", "ISC", "BSD-3-Clause", "Apache-2.0", "GPL-3.0"}
    texts = [f"Copyright (c) 2020 Jane Doe\n\n{t}" for _, t in whole] + ["\n".join(" * " + x for x in textwrap.wrap(t, 60)) for _, t in whole]
    got = scan(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == [name for name, _ in whole] * 2 and min(got[i][1] for i in range(len(texts))) > 0.9


def test_against_all_units(spark):
    rng, cosines = random.Random(8), plain()
    common = sorted(licenses.COMMON)
    texts = ["it it it the the the as can or you and by of is this under", "are are and and that with in or use the", "be found can that in use by of is this a"]
    for _ in range(250):
        _, t = rng.choice(licenses.TEMPLATES)
        w = [x for x in words(t) if rng.random() < rng.choice([0.4, 0.7, 1])]
        w += rng.choices(common, k=rng.randrange(8)) + [f"u{rng.randrange(99)}" for _ in range(rng.randrange(6))]
        rng.shuffle(w)
        lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)] + rng.choice([[], ["", "x y z"], [" ".join(rng.choices(common, k=12))]])
        texts.append("\n".join(lines))
    for _ in range(150):
        texts.append(" ".join(rng.choices(common, k=rng.randrange(4, 40))))
    want = {i: b for i, t in enumerate(texts) if (b := best(t, cosines))[1]}
    got = scan(spark, texts)
    assert got.keys() == want.keys() and 100 < len(want) < len(texts)
    assert all(got[i] == (name, pytest.approx(-low, abs=1e-8)) for i, (low, name) in want.items())
