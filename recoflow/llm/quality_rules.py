"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of at most ``bins`` quantiles with the logistic
loss; on features with a direction, a split must order its children that way and
their values stay within bounds handed down (monotone over the whole model). The
forest is flattened into node arrays, and every row of a chunk steps through a
tree at once. Statistics and scores are one Arrow pass over the texts without a
shuffle; only ``bound`` labelled rows (statistics, not texts) reach the driver.

Defined cases: a null text has no words; texts of under 50 words, or with over
half of their words in repeated 3-word windows, fail outright; without labels of
both classes the model keeps what the base rules keep; rows that repeat a
``doc_id`` are judged one by one; extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import common as C
from recoflow.llm import stats as S

LABELLED_ROWS = 6000
OUT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, probability double")


@dataclass
class Forest:
    """Flat nodes of all trees: a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            raw += self.value[node]
        return 1 / (1 + np.exp(-raw))


def grow(x: np.ndarray, y: np.ndarray, direction, trees: int = 60, depth: int = 3, rate: float = 0.2,
         bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Fit on at most a few thousand rows; ``direction`` has +1, -1 or 0 by feature."""
    n, m = x.shape
    share = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []
    start = float(np.log(share / (1 - share)))
    raw = np.full(n, start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), int)

    def node(feature=0, threshold=0.0, value=0.0) -> int:
        k = len(nodes["value"])
        for name, v in zip(nodes, (feature, threshold, k, k, value)):
            nodes[name].append(v)
        return k

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + l2), low, high))
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) > 1:
            for j in range(m):
                if not len(cuts[j]):
                    continue
                c = code[rows, j]
                gl = np.cumsum(np.bincount(c, g[rows], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], len(cuts[j]) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                ok = (hl >= least) & (hr >= least) & ((vr - vl) * direction[j] >= 0)
                # loss of the clipped values, so that bounds count in the choice
                gain = np.where(ok, -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2)
                                + (gs * value + 0.5 * (hs + l2) * value**2), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        if best[1] < 0:
            return node(value=rate * value)
        _, j, k, vl, vr = best
        me = node(j, float(cuts[j][k]))
        mid = (vl + vr) / 2
        lows, highs = ((low, mid), (mid, high)) if direction[j] > 0 else ((mid, high), (low, mid)) if direction[j] < 0 else ((low, high), (low, high))
        to_left = code[rows, j] <= k
        nodes["left"][me] = build(rows[to_left], g, h, level + 1, *lows)
        nodes["right"][me] = build(rows[~to_left], g, h, level + 1, *highs)
        return me

    arrays = lambda: {k: np.array(v) for k, v in nodes.items()}
    if n and 0 < y.mean() < 1:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            roots.append(build(np.arange(n), p - y, p * (1 - p), 0, -8.0, 8.0))
            raw = raw + _step(arrays(), roots[-1], depth, x)
    else:
        start = 4.0
        node()
    return Forest(**arrays(), roots=np.array(roots, int), depth=depth, start=start)


def _step(a: dict, root: int, depth: int, x: np.ndarray) -> np.ndarray:
    node, rows = np.full(len(x), root), np.arange(len(x))
    for _ in range(depth):
        node = np.where(x[rows, a["feature"][node]] <= a["threshold"][node], a["left"][node], a["right"][node])
    return a["value"][node]


def sample(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sampled rows (ids: bounded, hence broadcast)."""
    def run(batches):
        for b in batches:
            for i, j, data, offs in C.chunks(b.column("text")):
                f = S.features(S.text_stats(data, offs)[0]).astype(np.float64)
                yield pa.record_batch({"doc_id": b.column("doc_id")[i:j], "label": b.column("label")[i:j], "f": pa.array(list(f), pa.list_(pa.float64()))})

    got = (docs.select("doc_id", C.whole_text().alias("text")).join(F.broadcast(ids), "doc_id")
           .mapInArrow(run, "doc_id long, label int, f array<double>")
           .groupBy("doc_id").agg(F.min(F.struct("label", "f")).alias("r"))  # one row for an id that repeats
           .select("doc_id", "r.label", "r.f").orderBy("doc_id").toPandas())
    return np.array(got["f"].tolist(), dtype=np.float32).reshape(len(got), len(S.FEATURES)), got["label"].to_numpy(float)


def fit(docs: DataFrame, sf_dir: str, bound: int = LABELLED_ROWS) -> Forest:
    return grow(*sample(docs, S.labelled_ids(docs.sparkSession, sf_dir, bound)), S.DIRECTION)


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """One row per row of ``docs``: base counts, base verdict, final verdict, probability."""
    def run(batches):
        for b in batches:
            for i, j, data, offs in C.chunks(b.column("text")):
                s, _, _ = S.text_stats(data, offs)
                failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
                p = forest.probability(S.features(s))
                cols = {"doc_id": b.column("doc_id")[i:j]}
                cols |= {k: pa.array(s[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                yield pa.record_batch(cols | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= 0.5)), "probability": pa.array(p)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text")).mapInArrow(run, OUT)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return judge(docs, fit(docs, sf_dir))
