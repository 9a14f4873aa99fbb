"""Headline timings: runs registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed with the ``noop`` sink (no driver collect).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recoflow.registry import load_all  # noqa: E402
from recoflow.operators import sar  # noqa: E402
from recoflow.registry.common import train_test  # noqa: E402
from recoflow.session import local_session  # noqa: E402


def _sim(train, threshold):
    return sar.similarity(sar.cooccurrence(train, threshold=threshold))


def _recommend_th2(spark, sf):
    train, _ = train_test(spark, sf)
    return sar.recommend(train, _sim(train, 2), 10)


def _normalized_th3(spark, sf):
    train, _ = train_test(spark, sf)
    return sar.score_normalized(train, _sim(train, 3))


# scoring at the settings of the first round's bench; the registered queries run the default threshold 1
EXTRA = {"sar_recommend_th2": _recommend_th2, "sar_score_normalized_th3": _normalized_th3}

HEADLINE = [
    "chrono_split", "stratified_split", "timestamp_split",
    "sar_cooccurrence", "sar_recommend_th2", "sar_score_normalized_th3", "sar_predict",
    "ndcg_at_k", "map_at_k", "group_ndcg_hit", "auc",
    "diversity", "serendipity", "novelty",
    "als_recommend", "negative_sample", "expand_history", "tfidf_similar",
    "target_encode_online", "graph_propagate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    reg = load_all()
    timings: dict[str, float] = {}
    failed: dict[str, str] = {}
    # warm-up: JIT, file listing
    reg["popular_topk"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        build = EXTRA.get(name) or (reg[name].build if name in reg else None)
        if build is None:
            continue
        t0 = time.time()
        try:
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as ex:  # noqa: BLE001 - the other timings must survive one failing query
            failed[name] = f"{type(ex).__name__}: {str(ex)[:200]}"
            continue
        timings[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      **({"failed": failed} if failed else {})}))


if __name__ == "__main__":
    main()
