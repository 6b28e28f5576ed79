"""Alignments against loops over tokens, products against dense ones."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brindle.llm import alignment
from brindle.llm.alignment import ByteSide, Csr, PieceSide, align, align_documents, align_texts
from brindle.llm.queries import QUERIES
from brindle.sources import Tables

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@functools.cache
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def ends(spelled):
    return np.cumsum([len(s) for s in spelled]).tolist()


def plain_groups(text):
    """The ids of each group, by walking over both sides' tokens; None without tokens."""
    if not text:
        return None
    a, b = tokenizers()
    meant = {c: bytes([i]) for c, i in alignment.byte_level().items()}
    encoded = a.encode(" " + text, add_special_tokens=False)
    ids_a, ids_b = encoded.ids, b.encode(text)
    spelled_a = [b"".join(meant[c] for c in t) for t in encoded.tokens]
    spelled_b = []
    for piece in map(b.id_to_piece, ids_b):
        byte = re.fullmatch("<0x(..)>", piece)
        spelled_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    if not b"".join(spelled_a) == b"".join(spelled_b) == b" " + text.encode():
        return None
    both = set(ends(spelled_a)) & set(ends(spelled_b))
    groups, i, j = [], 0, 0
    ends_a, ends_b = ends(spelled_a), ends(spelled_b)
    for cut in sorted(both):
        x, y = i, j
        while i < len(ids_a) and ends_a[i] <= cut:
            i += 1
        while j < len(ids_b) and ends_b[j] <= cut:
            j += 1
        groups.append((ids_a[x:i], ids_b[y:j]))
    return groups


def expected(rows):
    groups = [plain_groups(text) for _, text in rows]
    links = [Counter((a, b) for x, y in g or [] for a in x for b in y) for g in groups]
    counts = Counter(pair for found in links for pair in found)
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (doc_id, _), g, found in zip(rows, groups, links):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out.append((
            doc_id, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []),
            sum(found.values()),
            sum(n for pair, n in found.items() if counts[pair] == most[pair[0]]),
            sum(n * counts[pair] for pair, n in found.items()),
            hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def csr(dense):
    return Csr.of(*np.nonzero(dense), dense[np.nonzero(dense)], *dense.shape)


@pytest.mark.parametrize("entries", [1, 4, 1 << 20])
def test_products(entries):
    rng = np.random.default_rng(entries)
    for _ in range(100):
        x = rng.integers(0, 3, (rng.integers(0, 7), rng.integers(1, 6)))
        y = rng.integers(0, 3, (x.shape[1], rng.integers(1, 8)))
        for matrix, dense in ((csr(x).times(csr(y), entries), x @ y), (csr(y).transposed(), y.T)):
            found = np.zeros(dense.shape, dtype=int)
            found[matrix.rows, matrix.at] = matrix.value
            assert (found == dense).all() and len(matrix.begin) == len(dense) + 1


def test_overlaps_and_groups():
    overlap, a, b = align(np.array([2, 3, 1, 4]), np.array([2, 1, 3, 2, 2]))
    found = list(zip(overlap.rows.tolist(), overlap.at.tolist(), overlap.value.tolist()))
    assert found == [(0, 0, 2), (1, 1, 1), (1, 2, 2), (2, 2, 1), (3, 3, 2), (3, 4, 2)]
    assert a.tolist() == [0, 1, 1, 2] and b.tolist() == [0, 1, 1, 2, 2]


TEXTS = ["", "a", " ", "\n", "  two  blanks ", "Straße ßßß", "日本語のテキスト", "🙂🙂 ok", "▁", "a▁b",
         "<|endoftext|>", "</s><s>", "<0x41>", "é" * 40, "́e", "ﬁne", "１２３", "x\x00y", "\x1c",
         "internationalisation" * 3, "​ ", "a" * 500, " " * 50, "don't'll", "\r\n\t"]


def test_texts_of_all_kinds():
    rng = random.Random(8)
    a, b = ByteSide(A), PieceSide(B)
    assert a._ranks is not None
    texts = TEXTS + ["".join(rng.choice(TEXTS)[:9] for _ in range(rng.randint(1, 12)))
                     for _ in range(200)]
    found = align_texts([None, *texts], a, b)
    assert found.n_a[0] == found.n_groups[0] == 0 and found.spelled[0] == ""
    for i, text in enumerate(texts, 1):
        groups = plain_groups(text) or []
        assert found.n_groups[i] == len(groups)
        assert found.spelled[i] == ";".join(
            ",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        pairs = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        own = found.doc == i
        assert dict(zip(found.pair[own].tolist(), found.links[own].tolist())) == {
            x << 32 | y: n for (x, y), n in pairs.items()}
        assert found.n_links[i] == sum(pairs.values())


def test_ids_are_those_of_the_file_library():
    a, library = ByteSide(A), tokenizers()[0]
    texts = [*TEXTS, "a" + " " * 9000 + "b", "\n" * 5000]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert a.encode(texts) == wanted
    a._ranks = None
    assert a.encode(texts) == wanted


@pytest.mark.parametrize("bundle", [{}, {"pairs": 5, "texts": 3}])
def test_odd_rows(spark, documents, bundle):
    rng = random.Random(1)
    words = ["the", "Haus", "été", "naïve", "12345", "tokenization", "x" * 30, "日本", "\n", " "]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (None, "the the"), (5, None)]
    rows += [(7, "the Haus")] * 20
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    rows.append((999, " ".join(rng.choices(words, k=40_000))))
    df = documents(rows).selectExpr("doc_id", "text", "lang AS bundle", "source AS kind",
                                    "n_chars AS n_a", "lang AS pairs", "lang AS id")
    found = align_documents(df.repartition(3), "doc_id", "text", A, B, **bundle)
    assert got(found) == expected(rows)
    assert align_documents(documents([]), "doc_id", "text", A, B).collect() == []


def test_query_against_loops(spark, medium):
    rows = [(r["doc_id"], r["text"]) for r in Tables(spark, medium).documents.collect()]
    found = QUERIES["op13_csr_alignment"](spark, medium)
    assert sorted(found.columns) == sorted(COLUMNS)
    assert got(found) == expected(rows)
