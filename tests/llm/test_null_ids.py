"""Many rows without doc_id: each comes back as it is, and no task has them all."""

from collections import Counter

from pyspark.sql import functions as F

from recoflow.llm import substring_dedup as S


def test_rows_without_id_are_spread(spark):
    same = " ".join(f"w{k}" for k in range(30))
    rows = [(None, same if k % 2 else f"{k} {same}") for k in range(400)] + [(None, None), (1, same), (2, same + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = S.remove_repeats(df, block_bytes=2000).withColumn("part", F.spark_partition_id()).collect()
    null = [r for r in got if r.doc_id is None]
    assert Counter((r.n_words, r.n_removed, r.kept_text) for r in null) == Counter((len((t or "").split()), 0, t or "") for i, t in rows if i is None)
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got if r.doc_id is not None) == [(1, 30, 0), (2, 31, 30)]
    assert max(Counter(r.part for r in null).values()) < len(null) / 2
