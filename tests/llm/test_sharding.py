"""Shards against a plain pass over the sorted rows."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from brindle.llm.queries import QUERIES
from brindle.llm.sharding import byte_shards
from brindle.sources import Tables


def expected(rows, shards):
    sized = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        sized.append((doc_id is not None, doc_id or 0, zlib.crc32(raw), len(raw) + 8, doc_id))
    total, before, found, slots = sum(s[3] for s in sized), 0, [], {}
    for _, _, crc, size, doc_id in sorted(sized, key=lambda s: s[:4]):
        shard = (2 * before + size) * shards // (2 * total)
        found.append((doc_id, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return sorted(found, key=repr)


ROWS = [
    [(i, "x" * (i * 37 % 91)) for i in range(300)],
    [(1, "same")] * 200 + [(None, None), (None, "ä"), (2, None), (3, ""), (4, "y" * 5000)],
    [(7, "one row")],
]


@pytest.mark.parametrize("rows", ROWS)
def test_matches_a_plain_pass(spark, documents, rows):
    df = documents(rows).repartition(5)
    found = [tuple(r) for r in byte_shards(df, "doc_id", "text", 6).collect()]
    assert sorted(found, key=repr) == expected(rows, 6)


def test_empty_table_and_clashing_columns(spark, documents):
    assert byte_shards(documents([]), "doc_id", "text", 6).count() == 0
    df = documents([(1, "a"), (2, "b")]).withColumns(
        {"size": F.lit("x"), "shard": F.lit(9), "_part": F.lit(1), "id": F.lit("z")})
    assert byte_shards(df, "doc_id", "text", 2).count() == 2


def test_the_query_keeps_all_rows_in_even_shards(spark, medium):
    rows = QUERIES["op9_prefix_sum_shards"](spark, medium).collect()
    texts = [(r.doc_id, r.text) for r in Tables(spark, medium).documents.collect()]
    found = sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows), key=repr)
    assert found == expected(texts, 24)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_no_python_in_the_plan(spark, medium):
    plan = QUERIES["op9_prefix_sum_shards"](spark, medium)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
