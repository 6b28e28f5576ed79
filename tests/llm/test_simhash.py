"""Fingerprints, tree searches and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import simhash
from brindle.llm.queries import QUERIES
from brindle.llm.simhash import SimHash, Tree, fingerprint, gray_rank, near_links, simhash_join, unite
from brindle.sources import Tables


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    runs = [words[i:i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << bit for bit in range(64)
               if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(codes, most=4):
    """The least position that each code is connected with."""
    codes = np.array(codes, dtype=np.uint64)
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= most).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def some_codes(rng, n, flips=3):
    """Codes of which half are a few bits from another one."""
    codes = [rng.getrandbits(64) for _ in range(max(1, n // 2))]
    while len(codes) < n:
        code = rng.choice(codes)
        for _ in range(rng.randint(0, flips)):
            code ^= 1 << rng.randrange(64)
        codes.append(code)
    return codes


def test_fingerprints(monkeypatch):
    rng = random.Random(3)
    words = ["a", "B", "é", "Ä", "straße", "x y", "　", "0", "\x1c", "\x85"]
    texts = [None, "", " \t\n\x0b\x0c\r", "A", "a b c", "a b c d", "a  b\nc\td",
             *("".join(rng.choice(words) + rng.choice(" \n\t\r") for _ in range(rng.randint(1, 200)))
               for _ in range(60))]
    wanted = [plain_fingerprint(t) for t in texts]
    assert [fingerprint(t) for t in texts] == wanted and wanted[:3] == [0, 0, 0]
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert [fingerprint(t) for t in texts] == wanted


def test_rank_is_the_place_in_the_gray_code(spark):
    places = list(range(9)) + [2 ** 63 - 1, 2 ** 63, 2 ** 64 - 1]
    codes = [i ^ (i >> 1) for i in places]
    rows = [((c ^ 2 ** 63) - 2 ** 63,) for c in codes]
    ranks = [r[0] for r in spark.createDataFrame(rows, "code long").select(
        gray_rank(F.col("code"))).collect()]
    assert [r + 2 ** 63 for r in ranks] == places


@pytest.mark.parametrize("n", [1, 3, 4, 5, 17, 300, 1500])
@pytest.mark.parametrize("frontier", [64, 1 << 21])
def test_tree_search_finds_all(n, frontier, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    codes = np.unique(np.array(some_codes(random.Random(n), n), dtype=np.uint64))
    # the order only makes it fast: any order gives the same pairs
    found = set()
    for q, c in Tree(codes).search(codes, 4):
        found.update(zip(q.tolist(), c.tolist()))
    near = np.bitwise_count(codes[:, None] ^ codes) <= 4
    assert found == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_bits_of_a_code_are_held_once():
    codes = np.sort(np.array(some_codes(random.Random(9), 500), dtype=np.uint64))
    tree = Tree(codes)
    for at in range(len(codes)):
        held, node = 0, at
        for pattern, mask in tree.levels:
            own = int(mask.ravel()[node])
            assert not held & own and int(pattern.ravel()[node]) & own == int(codes[at]) & own
            held, node = held | own, node // simhash.FAN
        assert held == 2 ** 64 - 1


def test_unite():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n, root = 40, np.arange(40)
        a, b = rng.integers(0, n, 25), rng.integers(0, n, 25)
        unite(root, a[:10], b[:10])
        unite(root, a[10:], b[10:])
        groups = {i: {i} for i in range(n)}
        for x, y in zip(a.tolist(), b.tolist()):
            both = groups[x] | groups[y]
            groups.update(dict.fromkeys(both, both))
        assert root.tolist() == [min(groups[i]) for i in range(n)]


@pytest.mark.parametrize("least", [40, 4096])
def test_links_connect_over_blocks(spark, least):
    rng = random.Random(7)
    # a large group of near copies, chains, and codes on their own
    centre = rng.getrandbits(64)
    codes = some_codes(rng, 900, flips=5)
    for _ in range(400):
        code = centre
        for _ in range(rng.randint(0, 4)):
            code ^= 1 << rng.randrange(64)
        codes.append(code)
    codes = sorted(set(codes))
    signed = [((c ^ 2 ** 63) - 2 ** 63,) for c in codes]
    links = near_links(spark.createDataFrame(signed, "code long").repartition(3),
                       SimHash(least=least, blocks=12))
    at, root = {c[0]: i for i, c in enumerate(signed)}, np.arange(len(codes))
    rows = links.collect()
    unite(root, np.array([at[r["a"]] for r in rows]), np.array([at[r["b"]] for r in rows]))
    assert root.tolist() == plain_components(codes)
    assert len(rows) < 4 * len(codes)


def expected(rows):
    codes = [plain_fingerprint(text) for _, text in rows]
    root = plain_components(codes)
    least = {}
    for (doc_id, _), r in zip(rows, root):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return sorted(((doc_id, f"{code:016x}", least.get(r)) for (doc_id, _), code, r
                   in zip(rows, codes, root)), key=repr)


def test_odd_rows(spark, documents):
    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    base = [f"v{rng.randrange(900)}" for _ in range(80)]
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "ONE"), (None, "one two"), (6, long),
            (7, long.upper()), (8, long + " w"), (9, "a b c d"), (9, "a b c d"), (9, "e f g"),
            (None, None)]
    for i in range(60):
        changed = list(base)
        changed[rng.randrange(80)] = rng.choice(base)
        rows.append((100 + i % 50, " ".join(changed)))
    df = documents(rows).selectExpr("doc_id", "text", "lang AS code", "source AS component",
                                    "n_chars AS fingerprint", "lang AS id", "lang AS least")
    found = simhash_join(df, "doc_id", "text").collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)
    assert simhash_join(documents([]), "doc_id", "text").collect() == []


def test_query_against_brute_force(spark, medium):
    rows = [(r["doc_id"], r["text"]) for r in Tables(spark, medium).documents.collect()]
    found = QUERIES["op12_gray_simhash"](spark, medium)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)
