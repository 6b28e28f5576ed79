"""Near-duplicates against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import jaccard
from brindle.llm.components import components
from brindle.llm.jaccard import Join, jaccard_join, shingles, similar
from brindle.llm.queries import QUERIES
from brindle.sources import Tables


def plain_set(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, least=0.8):
    """(doc_id, class_id, n_links) of each row, from all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            shared = len(s & sets[j])
            if shared >= least * (len(s) + len(sets[j]) - shared):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    return sorted(((d, min((x for x in ids[find(i)] if x is not None), default=None), links[i])
                   for i, (d, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near_copies(rng, words, n, changes):
    made = [" ".join(words)]
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(len(own))] = f"w{rng.randint(0, 10 ** 6)}"
        made.append(" ".join(own))
    return made


def corpus(rng):
    """Clusters, copies, and unlike texts that share a long passage."""
    texts = []
    for _ in range(12):
        texts += near_copies(rng, [f"w{rng.randint(0, 10 ** 6)}" for _ in range(200)], 6, 3)
    texts += near_copies(rng, [f"c{i}" for i in range(150)], 120, 4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randint(0, 10 ** 6)}" for _ in range(40))
              for _ in range(150)]
    texts += ["copy of one text that many have " * 3] * 150
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_similarities_and_shingles():
    a, b = "a b c d e f g h", "A b  c d\ne f g x"
    assert len(shingles(a, 5)) == 4 and len(shingles("a b", 5)) == 1 and not len(shingles(" ", 5))
    got = similar([shingles(a, 5), shingles(b, 5)], 0.6)
    assert got[0, 1] and not similar([shingles(a, 5), shingles(b, 5)], 0.61)[0, 1]


@pytest.mark.parametrize("join", [Join(), Join(bucket=20, depth=3)])
def test_classes_and_links(spark, documents, join):
    rows = corpus(random.Random(3))
    df = documents(rows).repartition(6)
    got, wanted = found(jaccard_join(df, "doc_id", "text", join)), brute(rows)
    assert [r[0] for r in got] == [r[0] for r in wanted]
    missed = sum(w[2] for w in wanted) - sum(g[2] for g in got)
    assert 0 <= missed <= 0.01 * sum(w[2] for w in wanted)
    assert sum(g[1] == w[1] for g, w in zip(got, wanted)) >= 0.99 * len(rows)


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "one two three"),
            (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "x y z"),
            (8, "long " * 30_000), (9, "long " * 100), (10, "z " * 5)]
    df = documents(rows).withColumns({"class": F.lit("own"), "path": F.lit(1), "id": F.lit(2)})
    assert found(jaccard_join(df, "doc_id", "text")) == brute(rows)
    assert jaccard_join(documents([]), "doc_id", "text").count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 201), (300, 300), (500, 201)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 500: 200}
    assert components(links.limit(0)).count() == 0


def test_the_query_on_a_whole_table(spark, medium):
    rows = [(r.doc_id, r.text) for r in Tables(spark, medium).documents.collect()]
    got, wanted = found(QUERIES["op5_chosen_path_join"](spark, medium)), brute(rows)
    assert sum(g == w for g, w in zip(got, wanted)) >= 0.995 * len(rows)
    assert all(g[1] == w[1] for g, w in zip(got, wanted) if w[2] == 0)


def test_recall_of_runs():
    assert 0.99 <= 1 - 0.627 ** Join().runs < 0.9999 and np.isclose(Join().chosen * 64 * 0.8, 1)


def test_recall_on_long_paths(spark, documents):
    """Texts of passages that a third of all share: pairs are met after five steps or more."""
    rng = random.Random(8)
    passages = [" ".join(f"p{i}x{j}" for j in range(60)) for i in range(60)]
    rows, wanted = [], 0
    for _ in range(500):
        own = rng.sample(range(60), 22)
        other = rng.choice([i for i in range(60) if i not in own])
        for chosen in (own, own[1:] + [other]):
            chosen = sorted(chosen)
            text = " ".join(passages[i] for i in chosen)
            # words of its own bring the similarity down to the threshold
            text += " " + " ".join(f"u{len(rows)}x{j}" for j in range(85))
            rows.append((len(rows), text))
        sets = [shingles(t, 5) for _, t in rows[-2:]]
        wanted += 2 * int(similar(sets, 0.8)[0, 1])
    join = Join(bucket=4, recall=0.99)
    assert wanted > 700
    found = jaccard_join(documents(rows).repartition(4), "doc_id", "text", join).collect()
    got = sum(r.n_links for r in found)
    print("found", got, "of", wanted)
    assert got >= 0.985 * wanted
    assert join.runs_to(5) > 15 and join.runs_to(8) > 22


def test_one_text_of_a_class_comes_to_a_group(spark, documents, monkeypatch):
    """An id of very many rows, with one text and with many."""
    rng = random.Random(9)
    made = near_copies(rng, [f"w{i}" for i in range(200)], 20, 3)
    rows = [(7, made[0])] * 200 + [(7, t) for t in made[1:]] + [(8, t) for t in made]
    linked = jaccard._linked

    def counted(join):
        run = linked(join)

        def checked(batches):
            batches = list(batches)
            seen = Counter(pair for b in batches for pair in zip(
                *(b.column(i).to_pylist() for i in range(3))))
            assert max(seen.values(), default=1) == 1, max(seen.values())
            return run(iter(batches))
        return checked

    monkeypatch.setattr(jaccard, "_linked", counted)
    assert found(jaccard_join(documents(rows).repartition(4), "doc_id", "text")) == brute(rows)


def test_a_family_is_counted_from_its_size(spark, documents):
    """Many texts close around one, others further off, and unlike ones that share wording."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = near_copies(rng, words, 260, 2) + near_copies(rng, words, 60, 9)
    other = words[:280] + [f"o{i}" for i in range(14)]
    texts += near_copies(rng, other, 120, 2)
    texts += [" ".join(words[:150] + [f"x{rng.randint(0, 10 ** 6)}" for _ in range(150)])
              for _ in range(80)]
    rows = list(enumerate(texts + texts[:40]))
    rng.shuffle(rows)
    df = documents(rows).repartition(5)
    join = Join(bucket=200, family=40)
    own = df.selectExpr("doc_id AS id", "text")
    families = jaccard._families(_classes(own, join), own, join).collect()
    sizes = Counter(r["family"] for r in families)
    assert max(sizes.values()) > 150 and len({r["class"] for r in families}) == len(families)
    # a whole family is linked with each other, by the plain definition
    sets = {jaccard.class_key(shingles(t, 5)): shingles(t, 5) for _, t in rows}
    for family in sizes:
        members = [sets[bytes(r["class"])] for r in families if r["family"] == family]
        assert similar(members, 0.8).sum() == len(members) * (len(members) - 1)
    got, wanted = found(jaccard_join(df, "doc_id", "text", join)), brute(rows)
    assert sum(w[2] for w in wanted) - sum(g[2] for g in got) <= 0.002 * sum(w[2] for w in wanted)
    assert all(g[2] <= w[2] and g[1] == w[1] for g, w in zip(got, wanted))
    # where no path is long nothing is missed by chance: every number is that of the definition
    assert found(jaccard_join(df, "doc_id", "text", Join(bucket=1000, family=40))) == wanted


def _classes(own, join):
    sets = own.mapInArrow(jaccard._sets(join), "id long, class binary, signature binary, size long")
    return sets.where("class IS NOT NULL").groupBy("class").agg(
        F.min("id").alias("least"), F.min("signature").alias("signature"))


def test_common_wording_makes_rows_in_proportion(spark, documents):
    """Texts that share 60 words of 100 are not linked, and are not compared all with all."""
    rows = {}
    for n in (1000, 4000):
        rng = random.Random(n)
        shared = " ".join(f"s{i}" for i in range(60))
        texts = [(i, shared + " " + " ".join(f"u{rng.randint(0, 10 ** 9)}" for _ in range(40)))
                 for i in range(n)]
        own = documents(texts).selectExpr("doc_id AS id", "text")
        join = Join()
        classes = _classes(own, join).withColumn("family", F.lit(None).cast("binary")).checkpoint()
        rows[n] = jaccard._buckets(classes, join).count()
    assert rows[4000] < 6 * rows[1000] + 40_000, rows


def test_sets_are_compared_in_slices(spark, documents):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 10 ** 7)}" for _ in range(20_000)]
    rows = list(enumerate(near_copies(rng, words, 12, 300)))
    assert found(jaccard_join(documents(rows), "doc_id", "text", Join(slice_bytes=1 << 15))) == brute(rows)
    # what a task holds of a group is one slice of it
    sets = [shingles(t, 5) for _, t in rows]
    total, cuts = 0, np.linspace(0, 2.0 ** 64, 9)[1:-1].astype(np.uint64)
    for parts in zip(*(np.split(s, np.searchsorted(s, cuts)) for s in sets)):
        total = total + jaccard.shared(list(parts))
    assert (total == jaccard.shared(sets)).all()


def test_near_copies_without_ids(spark, documents):
    rng = random.Random(2)
    rows = [(None, t) for t in near_copies(rng, [f"w{i}" for i in range(200)], 9, 3)]
    rows += [(5, rows[3][1]), (None, "a b c d e f g"), (9, None)]
    assert found(jaccard_join(documents(rows), "doc_id", "text")) == brute(rows)
    none = [(None, t) for t in near_copies(rng, [f"v{i}" for i in range(200)], 9, 3)]
    assert found(jaccard_join(documents(none), "doc_id", "text")) == brute(none)
