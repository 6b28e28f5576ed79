"""Language and quality: held-out accuracy, what is learned from, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import language, quality_classifier
from brindle.llm.queries import QUERIES
from brindle.llm.texts import id_remainder, least_hashed
from brindle.sources import Tables

ODD = [(1, None), (2, ""), (3, " 123 !?"), (4, "x"), (None, "the and of"), (5, "word " * 50_000),
       (5, "word " * 50_000), (6, "\u4e2d\u6587")]


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_language_of_held_out_documents(spark, medium):
    rows = QUERIES["op1_nearest_centroid_language"](spark, medium).collect()
    docs = {r.doc_id: r for r in Tables(spark, medium).documents.collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98


def test_language_is_learned_from_learnable_rows_only(spark, documents):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["der", "die", "und", "ist"], k=20)), "de") for i in range(40)]
    rows += [(i, " ".join(rng.choices(["the", "and", "of", "is"], k=20)), "en")
             for i in range(40, 80)]
    rows += [(i, "und der", None) for i in range(80, 90)] + [(90, None, "fr"), (None, "le", "fr")]
    df = documents(rows)
    learnable = id_remainder("doc_id", 3) != 1
    model = language.train(df, "doc_id", "text", "lang", learnable, clusters=2)
    assert sorted(set(model.languages)) == ["de", "en"]
    spoiled = df.withColumn("lang", F.when(learnable, F.col("lang")).otherwise("xx"))
    again = language.train(spoiled, "doc_id", "text", "lang", learnable, clusters=2)
    assert np.array_equal(again.centroids, model.centroids)
    assert model.nearest("der und")[0] == "de" and model.nearest("the of")[0] == "en"
    assert model.nearest("\u4e2d\u6587\u4e2d")[2] and model.nearest("12 !") == ("und", 0.0, True)


def test_vectors_against_plain_counts():
    text = "Ab  c\u00e9! 12ab"
    plain = " ab c\u00e9 ab "
    counts = language.ngram_counts(text)
    assert counts.sum() == sum(len(plain) - n + 1 for n in (1, 2, 3))
    assert np.array_equal(counts, language.ngram_counts(" ab c\u00e9 ab "))
    assert language.ngram_counts("12 !") is None and language.ngram_counts("") is None


def test_language_of_odd_rows(spark, documents):
    model = language.train(documents([(i, "the of and", "en") for i in range(9)]), "doc_id", "text",
                           "lang", F.lit(True))
    df = documents(ODD).withColumns({"score": F.lit("own"), "a.b": F.lit(1)})
    found = language.identify(df, "text", model).collect()
    assert len(found) == len(ODD)
    assert {r.doc_id: r.lang_nearest for r in found if r.doc_id in (1, 2, 3, 4)} == {
        1: "und", 2: "und", 3: "und", 4: "en"}
    nothing = language.train(documents([]), "doc_id", "text", "lang", F.lit(True))
    assert {r.lang_pred for r in language.identify(df, "text", nothing).collect()} == {"und"}
    assert language.identify(documents([]), "text", model).count() == 0


def test_quality_of_held_out_documents(spark, medium):
    rows = {r.doc_id: r for r in QUERIES["op8_nb_svm_quality"](spark, medium).collect()}
    t = Tables(spark, medium)
    assert len(rows) == t.documents.count()
    assert all(r.held_out == (remainder(i, 5) == 0) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in t.labels.collect()
            if rows[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_quality_never_learns_from_held_out_labels(spark, documents):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["good", "text", "is", "fine"], k=30))) for i in range(60)]
    rows += [(i, " ".join(rng.choices(["bad&&", "junk##", "x**"], k=30))) for i in range(60, 120)]
    labels = spark.createDataFrame(
        [(i, int(i < 60), 0) for i in range(120)] + [(3, 1, 0), (None, 1, 0), (999, 0, 0)],
        "doc_id long, quality int, toxic int")
    learnable = id_remainder("doc_id", 5) != 0
    args = ("doc_id", "text", "quality", learnable)
    model = quality_classifier.train(documents(rows), labels, *args)
    spoiled = labels.withColumn("quality", F.when(learnable, F.col("quality")).otherwise(
        1 - F.col("quality")))
    again = quality_classifier.train(documents(rows), spoiled, *args)
    assert np.array_equal(model.weights, again.weights) and model.a == again.a
    assert model.score("good text is fine good text") > 0.8 > 0.2 > model.score("junk## x** bad&&")
    empty = quality_classifier.train(documents([]), labels, *args)
    assert empty.score("x") == pytest.approx(0.5)
    found = quality_classifier.score_texts(documents(ODD), "text", model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert quality_classifier.score_texts(documents([]), "text", model).count() == 0


def test_least_hashed_takes_the_same_rows_of_any_table(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7 > 0).cast("int").alias("g"))
    for n in (1, 10, 400, 10_000):
        got = least_hashed(df.repartition(7), "g", "id", n).collect()
        hashed = df.select("id", "g", F.shiftrightunsigned(F.xxhash64("id"), 33).alias("h"))
        for g in (0, 1):
            rows = sorted((r.h, r.id) for r in hashed.where(F.col("g") == g).collect())
            assert sorted(r.id for r in got if r.g == g) == sorted(i for _, i in rows[:n])


def test_descent_finds_the_hinge_loss_minimum():
    """Against many steps of subgradient descent on the primal."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(12) < 0.5).astype(np.int32) for _ in range(80)]
    signs = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    scale, costs = rng.standard_normal(12) + 2, np.full(80, 0.5)
    full = np.zeros(quality_classifier.SIZE)
    full[:12] = scale
    weights, bias = quality_classifier.descend(rows, signs, full, costs, rounds=300)
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        v = scale[r]
        x[i, r] = v / (np.sqrt(v @ v) or 1.0)
    x[:, 12] = 1

    def loss(w):
        return 0.5 * w @ w + (costs * np.maximum(0, 1 - signs * (x @ w))).sum()

    w, best = np.zeros(13), np.inf
    for step in range(20_000):
        over = signs * (x @ w) < 1
        w = w - (w - (costs * signs * over) @ x) / (step + 10)
        best = min(best, loss(w))
    assert loss(np.append(weights[:12], bias)) <= best + 1e-2


def plain_ngrams(text):
    """The hashed n-grams of a text's letters, by loops over characters."""
    line = " "
    for c in text.lower():
        line += c if c.isalpha() else " " if line[-1] != " " else ""
    line += "" if line[-1] == " " else " "
    counts = {}
    for i in range(len(line)):
        n = ord(line[i]) * 0x9E3779B1
        found = [n]
        if i + 1 < len(line):
            n = n * 0x85EBCA77 + ord(line[i + 1]) * 0xC2B2AE3D
            found.append(n)
        if i + 2 < len(line):
            found.append(n * 0x27D4EB2F + ord(line[i + 2]) * 0x165667B1)
        for x in found:
            counts[x % 2 ** 32 >> 19] = counts.get(x % 2 ** 32 >> 19, 0) + 1
    return counts if any(c.isalpha() for c in text) else None


def test_languages_against_plain_cosines(spark, medium):
    t = Tables(spark, medium)
    docs = t.documents.collect()
    learned = [plain_ngrams(d.text) for d in docs
               if remainder(d.doc_id, 3) != 1 and d.lang is not None and d.text is not None]
    learned = [c for c in learned if c is not None]
    held = {}
    for counts in learned:
        for bucket in counts:
            held[bucket] = held.get(bucket, 0) + 1
    model = language.train(t.documents, "doc_id", "text", "lang", id_remainder("doc_id", 3) != 1)
    for bucket in range(language.SIZE):
        assert model.idf[bucket] == pytest.approx(
            np.log((1 + len(learned)) / (1 + held.get(bucket, 0))) + 1)
    rows = {r.doc_id: r for r in QUERIES["op1_nearest_centroid_language"](spark, medium).collect()}
    for d in docs[::7]:
        counts, r = plain_ngrams(d.text or ""), rows[d.doc_id]
        if counts is None:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        weights = {b: np.log(1 + n) * model.idf[b] for b, n in counts.items()}
        length = sum(w * w for w in weights.values()) ** 0.5
        cosines = [sum(w / length * c[b] for b, w in weights.items()) for c in model.centroids]
        best = max(cosines)
        assert r.score == pytest.approx(best, abs=1e-4)
        near = {name for name, c in zip(model.languages, cosines) if c > best - 1e-5}
        assert r.lang_pred in near
        if len(near) == 1 and min(abs(best - x) for x in model.least) > 1e-4:
            assert r.rejected == (best < model.least[int(np.argmax(cosines))])


def test_the_model_has_a_bounded_number_of_languages(spark, documents):
    rows = [(i, "the and of is", "en") for i in range(50)] + [(i, "der die und", "de")
                                                              for i in range(50, 90)]
    rows += [(i, f"word of label {i}", f"l{i}") for i in range(90, 400)]
    model = language.train(documents(rows), "doc_id", "text", "lang", F.lit(True), languages=2)
    assert sorted(set(model.languages)) == ["de", "en"]


def test_quality_scores_against_plain_sums():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(200)]
    good = np.array([(r < 20).sum() + rng.random() > 4 for r in rows])
    model = quality_classifier.fit(rows, good)
    learn = [i for i in range(len(rows)) if i % 5 != 4]
    counts = {True: {}, False: {}}
    for i in learn:
        for f in rows[i].tolist():
            counts[bool(good[i])][f] = counts[bool(good[i])].get(f, 0) + 1
    size = {g: quality_classifier.SIZE + sum(c.values()) for g, c in counts.items()}

    def ratio(f):
        return np.log((1 + counts[True].get(f, 0)) / size[True]
                      / ((1 + counts[False].get(f, 0)) / size[False]))

    assert all(model.scale[f] == pytest.approx(ratio(f), abs=1e-5) for f in range(80))
    text = "some text with words words words words and more"
    found = quality_classifier.features(text).tolist()
    model = quality_classifier.fit([np.array(found[:40]), np.array(found[20:])] * 30,
                                   np.array([True, False] * 30))
    own = [float(model.scale[f]) for f in found]
    length = sum(x * x for x in own) ** 0.5
    margin = sum(float(model.weights[f]) * x / length for f, x in zip(found, own)) + model.bias
    assert model.margin(np.array(found)) == pytest.approx(margin, abs=1e-5)
    assert model.score(text) == pytest.approx(1 / (1 + np.exp(-(model.a * margin + model.b))), abs=1e-5)
