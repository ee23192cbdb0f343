"""Licence spans against chains worked out from all common stretches of a document and a template."""

import random

from helixframe.llm import licenses
from tests.llm.test_operators import table, words


def brute_spans(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES):
    """(spans, score) of a text."""
    doc, out = words(text), []
    score = float(any(doc[i : i + len(p.split())] == p.split() for p, _ in phrases for i in range(len(doc))))
    for number, (label, template) in enumerate(templates):
        own = words(template)
        match = []  # start, end, start and end in the template, of stretches that can't be longer on either side
        for i in range(len(doc)):
            for j in range(len(own)):
                if doc[i] == own[j] and not (i and j and doc[i - 1] == own[j - 1]):
                    n = 0
                    while i + n < len(doc) and j + n < len(own) and doc[i + n] == own[j + n]:
                        n += 1
                    if n >= 3:
                        match.append((i, i + n, j, j + n))
        match.sort(key=lambda m: (m[1], m[3], m[1] - m[0]))
        best = {}  # of chains that end with a match: words of most, and where it begins
        for k, (a, b, c, d) in enumerate(match):
            best[k] = (b - a, a)
            for h in range(k):
                e, f, g, i = match[h]
                if e < a and f < b and g < c and i < d and a - f <= 4:
                    best[k] = max(best[k], (best[h][0] + min(b - a, b - f, d - i), best[h][1]))
        taken = []
        for n, a, b in sorted(((n, a, match[k][1]) for k, (n, a) in best.items() if n >= 0.85 * len(own)), key=lambda x: (-x[0], x[2], -x[1])):
            if all(b <= c or d <= a for c, d in taken):
                taken.append((a, b))
                out.append((a, b, number, min(1.0, n / len(own))))
    return [(a, b, templates[o][0]) for a, b, o, _ in sorted(out)], max([score, *[x[3] for x in out]])


def test_spans_against_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for _, t in licenses.TEMPLATES:
        w = t.split()
        docs.append(t)
        docs.append(" ".join(x for x in w if rng.random() > 0.05))
        docs.append(" ".join(y for x in w for y in ([x, "odd"] if rng.random() < 0.05 else [x])))
        cut = rng.randrange(len(w))
        docs.append(" ".join(w[cut:] + w[:cut]))
        docs.append(f"before {t} after {t.upper()} and {' '.join(w[: len(w) // 2])}")
    docs += [None, "", "x " * 2000, "the software is provided " * 300]
    for _ in range(20):
        docs.append(" ".join(" ".join(w[a : a + rng.randint(1, 30)]) for w in rng.choices([t.split() for _, t in licenses.TEMPLATES], k=4) for a in [rng.randrange(len(w))]))
    for r in licenses.scan(table(spark, docs)).collect():
        spans, score = brute_spans(docs[r["doc_id"]])
        assert ([tuple(s) for s in r["spans"]], round(r["score"], 9)) == (spans, round(score, 9)), docs[r["doc_id"]]


def test_order_of_a_template_counts(spark):
    apart = ["Licensed under the Apache, licensed under the Apache", "redistribution and use in " * 5, "Version 2.0, the Apache License, licensed under"]
    whole = [t for _, t in licenses.TEMPLATES]
    rows = {r["doc_id"]: r for r in licenses.scan(table(spark, apart + whole)).collect()}
    assert all(not rows[k]["spans"] and rows[k]["score"] == 0 for k in range(3))
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert rows[3 + k]["score"] == 1.0 and label in {s["label"] for s in rows[3 + k]["spans"]}


def test_nested_templates_and_short_phrases(spark):
    phrases, templates = (("mit", "m"),), (("long", "a b c d e f g h"), ("inner", "c d e f"))
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, ["a b c d e f g h", "zz mit zz", "x c d e f x"]), phrases, templates).collect()}
    assert [tuple(s) for s in got[0]["spans"]] == [(0, 8, "long"), (2, 6, "inner")]
    assert [tuple(p) for p in got[1]["places"]] == [(1, "m")] and [s["label"] for s in got[2]["spans"]] == ["inner"]
