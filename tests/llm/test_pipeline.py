"""Each stage of the pipeline against the decisions it stands for, taken by brute force."""

from __future__ import annotations

import pickle
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from brindle.llm.quality_classifier import train
from brindle.llm.quality_rules import Reference, Rules, judged, references
from brindle.llm.texts import id_remainder
from brindle.sources import Tables
from test_jaccard import brute
from test_packing import pieces_are_whole

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark, medium, tmp_path_factory):
    """What goes into each stage, and what the last one gives."""
    docs = Tables(spark, medium).documents
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage")) + "/rows"
        stage(spark, found[-1], medium).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "quality rules", "n-gram Jaccard join", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    for df in stages[:-1]:
        assert df.columns == COLUMNS


def test_the_classifier_decides(spark, medium, stages):
    t = Tables(spark, medium)
    model = train(t.documents, t.labels, "doc_id", "text", "quality",
                  id_remainder("doc_id", 5) != 0)
    wanted = Counter(tuple(r) for r in stages[0].collect() if model.score(r.text) >= 0.3)
    assert rows_of(stages[1]) == wanted
    assert 0 < sum(wanted.values()) < stages[0].count()


def test_the_rules_decide(stages):
    known = {r.lang: Reference.of(*pickle.loads(r.reference))
             for r in references(stages[1], "text", "lang").collect()}
    wanted = Counter(tuple(r) for r in stages[1].collect()
                     if judged(known.get(r.lang), Rules(), r.text)[-1])
    assert rows_of(stages[2]) == wanted
    assert 0 < sum(wanted.values()) < stages[1].count()


def test_one_of_each_class_stays(stages):
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    classes = {i: c for i, c, _ in brute(docs)}
    kept = [r.doc_id for r in stages[3].collect()]
    assert len(kept) == len(set(classes.values())) < len(docs)
    assert {classes[i] for i in kept} == set(classes.values())


def test_packing_takes_all_that_is_left(stages):
    pieces_are_whole(stages[4].collect(), {r.doc_id: r.text for r in stages[3].collect()})


def test_run_is_the_registered_query(spark, medium, stages, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda _, label: f"{tmp_path}/{label}")
    found = contract.queries()["pipeline"](spark, medium)
    # what the stages have read is gone
    assert [p.name for p in tmp_path.iterdir()] == ["packing"]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows_of(found.select(columns)) == rows_of(stages[4].select(columns))


def test_odd_rows_go_through_each_stage(spark, medium):
    good = " ".join(r.text for r in Tables(spark, medium).documents.limit(3).collect())
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, good, None, "s", 1),
            (2, good, None, "s", 1), (3, good, "en", None, None), (None, good, "xx", "s", 1),
            (4, "x " * 50_000, "en", "s", 1), (5, "&%$ " * 99, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns(
        {"score": F.lit("own"), "kept": F.lit("own"), "row": F.lit(7), "a.b": F.lit(0)})
    for _, stage in corpus_pipeline.STAGES[:3]:
        whole = stage(spark, docs, medium)
        assert whole.columns == docs.columns
        left = rows_of(whole) - rows_of(docs)
        assert not left  # rows stay as they are
    # one text: equal rows, rows without an id or a language
    kept = corpus_pipeline.keep_one_of_each(spark, docs.where(F.col("text") == good), medium)
    assert kept.count() == 1
    # each of them is packed as often as it comes, under its id
    packed = corpus_pipeline.pack_documents(spark, docs, medium).collect()
    assert sum(r.length for r in packed) == sum(
        r.doc_tokens for r in packed if r.start == 0) and sorted(
        (r.doc_id for r in packed if r.start == 0), key=repr) == sorted(
        (r[0] for r in rows), key=repr)
    # texts without words are copies of nothing
    assert corpus_pipeline.keep_one_of_each(
        spark, docs.where("text is null or text = ''"), medium).count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), medium).count() == 0


def test_rows_keep_their_numbers_when_splits_change(spark, documents, tmp_path, monkeypatch):
    """As when an executor is lost or added between the join and what follows."""
    texts = [f"{i} " + " ".join(f"w{i}x{j}" for j in range(20 + i)) for i in range(60)]
    rows = [(i, texts[i % 60]) for i in range(90)]
    path = str(tmp_path / "docs")
    documents(rows).repartition(6, "doc_id").write.parquet(path)
    settings = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    join = corpus_pipeline.jaccard.jaccard_join

    def moved(*args):
        joined = join(*args)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        return joined

    monkeypatch.setattr(corpus_pipeline.jaccard, "jaccard_join", moved)
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        kept = corpus_pipeline.keep_one_of_each(spark, spark.read.parquet(path), "").collect()
    finally:
        for key in [*settings, "spark.sql.files.maxPartitionBytes"]:
            spark.conf.unset(key)
    assert sorted(r.text for r in kept) == sorted(texts)
