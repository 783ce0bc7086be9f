"""Every stage keeps the columns and does what it says; odd rows pass through all of them."""

import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from patronlens.llm import decontamination, jaccard_join, line_dedup, quality_crf

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, out[-1], FOLDER)
        out.append(spark.createDataFrame(kept.collect(), kept.schema))
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "leaks", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_quality_drops_what_it_scores_low(spark, steps):
    labels = quality_crf.training_labels(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scored = quality_crf.score(steps[0], quality_crf.fit(steps[0], labels), ["doc_id"])
    assert {r.doc_id for r in scored.where("score >= 0.5").collect()} == {r.doc_id for r in steps[1].collect()}


def test_lines_are_those_of_the_operator(steps):
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(steps[1]).collect() if not (r.n_removed and not r.text.strip())}
    assert {r.doc_id: r.text for r in steps[2].collect()} == want


def test_one_document_of_each_class_stays(steps):
    classes = jaccard_join.classes(steps[2]).collect()
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted({r.class_id for r in classes})


def test_no_leak_is_left(spark, steps):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontamination.contamination(steps[3], items, ["doc_id"]).where("not contaminated").count() == steps[4].count()
    assert decontamination.contamination(steps[4], items, ["doc_id"]).where("contaminated").count() == 0


def test_all_ids_are_packed(steps):
    per = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in per} == {r.doc_id for r in steps[4].collect()} and all(r.n == r["all"] for r in per)


def test_run_gives_the_rows_of_the_stages(spark, steps):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, FOLDER).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {(r.doc_id, r.n) for r in got} == {(r.doc_id, r.n) for r in steps[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} and key


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "A plain line of words here.", None, None, 5), (3, "A plain line of words here.", "en", "s", 5), (3, "A plain line of words here.", "en", "s", 5), (4, "x\n" * 3000, "en", "s", 6), (5, "Another plain text, with a second line.\nAnd here it is.", "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, score int")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    packed = corpus_pipeline.pack(spark, docs, FOLDER)
    assert packed.count() == len(rows) + packed.where("start > 0").count() and zlib.crc32(b"") == 0
