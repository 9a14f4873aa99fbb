"""Several benchmark blocks: the same matches, and one index at a time in the plan."""

from recoflow.llm import decontam as D


def test_one_index_at_a_time(spark, monkeypatch):
    items = [(k, " ".join(f"item{k}word{j}" for j in range(12))) for k in range(6)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items] + [(99, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, D.matches(docs, bench).collect()))
    assert {(r[0], r[1]) for r in want} == {(k, k) for k, _ in items}
    blocks = D.benchmark_blocks
    monkeypatch.setattr(D, "benchmark_blocks", lambda b: blocks(b, 200))
    assert len(list(D.benchmark_blocks(bench))) > 1
    got = D.matches(docs, bench)
    assert sorted(map(tuple, got.collect())) == want
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2  # one node, named twice at most
