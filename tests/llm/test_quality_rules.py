"""Base measures and distances against plain Python."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm.quality_rules import CLASSES, Rules, apply_rules, base_measures, distance
from brindle.llm.queries import QUERIES
from brindle.sources import Tables

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in lines
            lines.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats,
            len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def plain_distance(p, q):
    def share(h):
        return {k: n / sum(h.values()) for k, n in h.items()}
    p, q = share(p), share(q)
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    half = sum(h[k] * math.log2(h[k] / m[k]) for h in (p, q) for k in h if h[k]) / 2
    return math.sqrt(max(half, 0))


def plain_class(c):
    if c in " \t\n\v\f\r":
        return "space"
    if c in "#*$%&|<>":
        return "symbol"
    kind = unicodedata.category(c)
    if kind in ("Ll", "Lu", "Lt"):
        return "lower" if kind == "Ll" else "upper"
    return {"L": "letter", "M": "letter", "N": "number", "Z": "space", "P": "point"}.get(
        kind[0], "symbol")


def test_base_measures():
    rng = random.Random(1)
    alphabet = ["a", "b", "a b c", " ", "\n", "\t", "#", "x<y", "é", "\x1c", "a\n", "\xa0"]
    texts = ["", " ", "a", "a b c a b c", "a a a a", "x\nx\nx", " \n \n", "a b c d " * 20]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 150))) for _ in range(500)]
    for text in texts:
        assert base_measures(text) == plain_base(text), text


def test_distance():
    assert distance(np.array([1, 0]), np.array([0, 5])) == 1
    assert distance(np.array([2, 4]), np.array([1, 2])) == pytest.approx(0, abs=1e-7)
    p, q = Counter(a=3, b=1), Counter(b=2, c=5)
    assert distance(np.array([3, 1, 0]), np.array([0, 2, 5])) == pytest.approx(plain_distance(p, q))


def test_class_distances_and_guards(spark, documents):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) + rng.choice(["", "", ",", "."])
             for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=100))) for i in range(60)]
    rows += [(100, "&%$ " * 100), (101, "short one"), (102, None), (103, ""), (None, rows[0][1]),
             (5, rows[5][1]), (104, "the " * 60, None), (105, "wenig Text", "de")]
    df = documents(rows).withColumns({"kept": F.lit("own"), "n": F.lit(1)})
    found = apply_rules(df, "text", "lang").collect()
    assert len(found) == len(rows)
    english = Counter()
    for r in rows:
        if len(r) == 2 and r[1]:
            english.update(map(plain_class, r[1]))
    for r in found:
        if r.lang == "en" and len(r.text or "") >= 200:
            own = Counter(map(plain_class, r.text))
            assert r.class_distance == pytest.approx(plain_distance(own, english))
        else:
            assert r.class_distance is None
    by_id = {r.doc_id: r for r in found}
    assert not by_id[100].kept and by_id[100].class_distance > Rules().class_limit
    assert by_id[101].base_failed and by_id[101].word_distance is None
    assert all(by_id[i].kept for i in range(5, 60)) and set(CLASSES) >= set(english)
    assert apply_rules(documents([]), "text", "lang").count() == 0


def test_the_query_on_a_whole_table(spark, medium):
    rows = {r.doc_id: r for r in QUERIES["op4_divergence_rules"](spark, medium).collect()}
    docs = Tables(spark, medium).documents.collect()
    assert len(rows) == len(docs)
    classes, words = {}, {}
    for d in docs:
        assert tuple(rows[d.doc_id])[1:7] == plain_base(d.text)
        classes.setdefault(d.lang, Counter()).update(map(plain_class, d.text))
        words.setdefault(d.lang, Counter()).update(d.text.encode().lower().split())
    rules, compared = Rules(), 0
    for d in docs:
        r = rows[d.doc_id]
        if r.word_distance is not None:
            common = sorted(words[d.lang], key=lambda w: (-words[d.lang][w], w))[:64]
            own, other = Counter(), Counter()
            for counts, found in ((own, Counter(d.text.encode().lower().split())),
                                  (other, words[d.lang])):
                for w, n in found.items():
                    counts[w if w in common else None] += n
            assert r.word_distance == pytest.approx(plain_distance(own, other))
            compared += 1
        if r.class_distance is not None:
            own = Counter(map(plain_class, d.text))
            assert r.class_distance == pytest.approx(plain_distance(own, classes[d.lang]))
        far = ((r.class_distance or 0) > rules.class_limit
               or (r.word_distance or 0) > rules.word_limit)
        assert r.kept == (not r.base_failed and not far)
    assert compared > 500
    labels = {r.doc_id: r.quality for r in Tables(spark, medium).labels.collect()}
    clean = [rows[i] for i, q in labels.items() if q == 1 and not rows[i].base_failed]
    assert sum(r.kept for r in clean) / len(clean) > 0.97


def test_very_many_languages(spark, documents, monkeypatch):
    """References are never gathered: a label of its own for each text, and a few real ones."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=70)), f"l{i}" if i % 2 else "en")
            for i in range(6000)]
    df = documents(rows)

    collect = type(df).collect

    def few(self):
        rows = collect(self)
        assert len(rows) < 10
        return rows

    monkeypatch.setattr(type(df), "collect", few)
    found = apply_rules(df, "text", "lang")
    counts = found.groupBy(F.col("lang") == "en").agg(
        F.count("*").alias("n"), F.count("word_distance").alias("known")).toPandas()
    assert sorted(counts[["n", "known"]].values.tolist()) == [[3000, 0], [3000, 3000]]
