"""Chunked encoding against the encoding of the whole text, and the exact round trip."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from brindle.llm.byte_bpe import chunks_of, codec, encode_texts, stitch
from brindle.llm.queries import QUERIES
from brindle.sources import Tables

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = [*"abAB 'sé  \n\t\r你1²½ \x85\xa0\0!\U0001F600", "can't", "   ", "\n\n", " the", "aaaaaaaaaaaaaaaa"]


def whole(text):
    encoding: tiktoken.Encoding = codec(RANKS, PATTERN)._encoding
    return encoding.encode_ordinary(text or "")


def expected(text):
    ids = whole(text)
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_stitched_chunks_are_the_whole_text():
    rng, known = random.Random(5), codec(RANKS, PATTERN)
    for _ in range(3000):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 60)))
        size = rng.randint(20, 60)
        overlap = rng.randint(9, size // 2)
        parts = [(at, part, [e for e in known.boundaries(part)
                             if e <= overlap or e >= len(part) - overlap])
                 for at, part in chunks_of(text, size, overlap)]
        pieces = list(stitch(parts, known.boundaries))
        assert "".join(pieces) == text
        assert known.encode(pieces) == whole(text), text
        assert known.decode(whole(text)) == text.encode()


def test_long_texts_go_through_chunks(spark, documents):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices(ALPHABET, k=rng.randint(0, 400)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "word " * 300), (62, "x" * 3000), (62, "x" * 3000),
             (63, " " * 2000 + "a"), (64, "\n" * 999)]
    df = documents(rows).withColumns({"n_tokens": F.lit("own"), "row": F.lit(1), "a.b": F.lit(2)})
    found = encode_texts(df, "text", RANKS, PATTERN, chunk=100, overlap=20, with_ids=True)
    assert {"row", "a.b", "lang"} <= set(found.columns)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()),
                 key=repr)
    assert got == sorted(((i, *expected(t)) for i, t in rows), key=repr)
    assert all(len(r.ids) == r.n_tokens for r in found.collect())
    assert encode_texts(documents([]), "text", RANKS, PATTERN).count() == 0


def test_the_query_on_a_whole_table(spark, medium):
    rows = QUERIES["op3_chunked_byte_bpe"](spark, medium).collect()
    texts = {r.doc_id: r.text for r in Tables(spark, medium).documents.collect()}
    assert sorted(map(tuple, rows)) == sorted((i, *expected(t)) for i, t in texts.items())
