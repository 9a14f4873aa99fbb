"""Histogram sort: every row once, near-equal bytes, gapless slots in key order."""

import zlib

import pytest
from pyspark.sql import functions as F

from recoflow.llm import common as C
from recoflow.llm import histogram_shards as hs
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, shard string, slot int, row int, size int, _w0 int, `a.b` int"


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


def _check(docs, placed, shards, slack=hs.TOLERANCE):
    rows = placed.select("row.doc_id", "row.text", "size", "shard", "slot", "row.`a.b`").collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in rows) == want
    sizes, largest = [0] * shards, 0
    for k in range(shards):
        mine = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert mine == list(range(len(mine)))
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        sizes[r["shard"]] += r["size"]
        largest = max(largest, r["size"])
    share = sum(sizes) / shards
    # each of a shard's two splitters is within the tolerance or half a row of its target
    assert all(abs(s - share) <= 2 * share * slack + largest for s in sizes)
    return rows


def _rows():
    rows = [(i, "copy of one text " * 3) for i in range(700)]  # a third of all rows
    rows += [(i, f"text {i} " + "word " * (i % 37)) for i in range(700, 1900)]
    rows += [(None, f"without id {i}") for i in range(60)] + [(5000 + i, None) for i in range(40)] + [(6000 + i, "") for i in range(40)]
    rows += [(7000, "the same row")] * 90 + [(8000, "long " * 4000)]
    return rows


def test_every_row_once_and_near_equal(spark):
    docs = _table(spark, _rows())
    rows = _check(docs, hs.shard_documents(docs), 16)
    assert {r["a.b"] for r in rows} == {5}
    # texts side by side: a small group of copies lies in one shard or two neighbours
    empty = sorted({r["shard"] for r in rows if not r["text"]})
    assert len(empty) <= 2 and empty[-1] - empty[0] < 2


def test_order_is_that_of_the_key(spark):
    docs = _table(spark, _rows())
    placed = hs.shard_documents(docs, 5)
    key = placed.select("shard", "slot", F.shiftrightunsigned(F.xxhash64(F.coalesce("row.text", F.lit(""))), 2).alias("w0"),
                        F.shiftrightunsigned(F.xxhash64("row.doc_id"), 2).alias("w1")).collect()
    in_order = sorted(key, key=lambda r: (r["shard"], r["slot"]))
    assert [(r["w0"], r["w1"]) for r in in_order] == sorted((r["w0"], r["w1"]) for r in key)


def test_one_row_repeated_is_cut_too(spark):
    docs = _table(spark, [(1, "all the same")] * 960)
    rows = _check(docs, hs.shard_documents(docs, 16, tolerance=0.0), 16)
    assert max(sum(r["shard"] == k for r in rows) for k in range(16)) <= 62


def test_few_rows_and_none(spark):
    _check(_table(spark, [(1, "a"), (2, "bb"), (3, None)]), hs.shard_documents(_table(spark, [(1, "a"), (2, "bb"), (3, None)])), 16)
    assert hs.shard_documents(_table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        hs.shard_documents(_table(spark, []), 0)


def test_probes_are_refined(spark, monkeypatch):
    """With four probes a round the same splitters' quality is reached in more rounds."""
    monkeypatch.setattr(hs, "PROBES", 4)
    docs = _table(spark, _rows())
    _check(docs, hs.shard_documents(docs, 7), 7)


def test_written_shards_keep_rows(spark, tmp_path):
    docs = C.documents(spark, SF_SMALL)
    hs.write_shards(hs.shard_documents(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("row.*").exceptAll(docs).count() == 0 and back.count() == docs.count()


def test_query(spark):
    out = hs.op12(spark, SF_SMALL)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    texts = {r["doc_id"]: r["text"] or "" for r in C.documents(spark, SF_SMALL).collect()}
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" for r in rows)
    assert all(r["grown_shard"] is None and 0 <= r["shard"] < 16 for r in rows)
