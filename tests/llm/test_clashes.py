"""Stages on input columns named like their inner ones; crowds of copies dealt over parts."""

import pytest
from pyspark.sql import functions as F

from recoflow.llm import decontam, line_dedup, ngram_join, quality_fm
from tests.conftest import SF_SMALL

CLASHES = ["gone", "some", "g_id", "g_th", "same", "k_id", "k_th", "row", "id", "th", "fp", "part", "line_id", "line", "n", "band", "many"]


def _docs(spark):
    line = "one line of words that many of the texts have in common here"
    rows = [(i, f"{line}\nown words of text number {i} and some more of them") for i in range(12)]
    rows += [(20 + i, "the very same text in a crowd of copies, word for word") for i in range(150)]
    rows += [(None, line), (300, None), (301, ""), (302, " \n "), (302, " \n ")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")) \
        .withColumn("n_chars", F.length("text").cast("long"))


@pytest.mark.parametrize("stage", [line_dedup.drop_lines, ngram_join.keep_first, decontam.keep_clean, quality_fm.keep_good])
def test_stage_with_clashing_names(spark, stage):
    plain = _docs(spark)
    names = plain.columns
    extra = plain.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))
    want = sorted(map(repr, stage(spark, plain, SF_SMALL).collect()))
    got = stage(spark, extra, SF_SMALL)
    assert got.columns == extra.columns
    rows = got.collect()
    assert sorted(repr(r) for r in got.select(names).collect()) == want
    assert all(tuple(r)[len(names):] == tuple(range(len(CLASHES))) for r in rows)


def test_crowd_of_copies_is_dealt(spark):
    docs = _docs(spark)
    got = {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"], r["first"]) for r in ngram_join.join_copies(docs).where("doc_id >= 20").collect()}
    assert got[20] == (20, 149, 149, True) and all(got[20 + i] == (20, 149, 149, False) for i in range(1, 150))
    assert got[300] == (300, 0, 0, True) and got[301] == (301, 0, 0, True)


def test_stages_on_no_rows(spark):
    none = _docs(spark).where("false")
    for stage in (line_dedup.drop_lines, ngram_join.keep_first, decontam.keep_clean, quality_fm.keep_good):
        assert stage(spark, none, SF_SMALL).count() == 0
