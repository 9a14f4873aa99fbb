"""Quality classifier: a factorisation machine on hashed words, structure and length.

score = sigmoid(w0 + x.w + 1/2 * sum_f((x.V_f)^2 - x^2.V_f^2)): the
sum-of-squares identity makes all pairwise interactions linear in the features.
x holds ``buckets`` hashed word counts (logarithmic, unit length), the structure
statistics and the recorded length ``n_chars`` (its own figure where null).
Labels, language, source and ids never enter x. The fit runs on at most
``bound`` labelled rows with crc32(doc_id) mod 3 other than 1, as dense vectors
made by the executors; scoring is one Arrow pass without a shuffle.

Defined cases: null and empty texts are scored (all-zero words); without labels
of both classes every score is the prior (0.5 without labels); rows that repeat
a ``doc_id`` are scored one by one; a null ``doc_id`` is held out; an extra or
clashing column of the input never reaches the score.
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
BUCKETS = 1024
OUT = "doc_id long, held_out boolean, score double, predicted int"


def vectors(data: np.ndarray, offs: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    s, hashes, first = S.text_stats(data, offs)
    n = len(offs) - 1
    at = S._row_of(first) * BUCKETS + (hashes & C.U64(BUCKETS - 1)).astype(np.int64)
    words = np.log1p(np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS)).astype(np.float32)
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-6)
    own = s["word_chars"] + np.maximum(s["n_words"] - 1, 0)
    meta = np.log1p(np.where(n_chars >= 0, n_chars, own)).astype(np.float32)[:, None]
    return np.concatenate([words, S.features(s), meta], axis=1)


def _vectors_of(b: pa.RecordBatch):
    n_chars = np.asarray(b.column("n_chars").fill_null(-1)).astype(np.int64)
    for i, j, data, offs in C.chunks(b.column("text")):
        yield i, j, vectors(data, offs, n_chars[i:j])


@dataclass
class Machine:
    centre: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return self.w0 + z @ self.w + 0.5 * ((z @ self.v) ** 2 - (z * z) @ (self.v * self.v)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rank: int = 8, epochs: int = 14, batch: int = 128, rate: float = 0.01,
          l2: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss; z-scores for structure and length, words as they are."""
    d = BUCKETS + len(S.FEATURES) + 1
    centre, scale = np.zeros(d, np.float32), np.full(d, 0.1, np.float32)
    rng = np.random.default_rng(seed)
    m = Machine(centre, scale, 0.0, np.zeros(d, np.float32), (0.01 * rng.standard_normal((d, rank))).astype(np.float32))
    if not len(y) or not 0 < y.mean() < 1:
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        m.w0, m.v[:] = float(np.log(p / (1 - p))), 0
        return m
    centre[BUCKETS:] = x[:, BUCKETS:].mean(axis=0)
    scale[BUCKETS:] = np.maximum(x[:, BUCKETS:].std(axis=0), 1e-3)
    z = np.clip((x - centre) / scale, -6, 6)
    m.w0 = float(np.log(y.mean() / (1 - y.mean())))
    params = [np.array([m.w0], np.float32), m.w, m.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            zb, yb = z[order[k:k + batch]], y[order[k:k + batch]]
            zv = zb @ params[2]
            raw = params[0][0] + zb @ params[1] + 0.5 * (zv**2 - (zb * zb) @ (params[2] ** 2)).sum(axis=1)
            e = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - yb) / len(yb)).astype(np.float32)
            grads = [np.array([e.sum()], np.float32), zb.T @ e + l2 * params[1],
                     zb.T @ (e[:, None] * zv) - params[2] * ((zb * zb).T @ e)[:, None] + l2 * params[2]]
            step += 1
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.w0 = float(params[0][0])
    return m


def _input(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text"), length.alias("n_chars"))


def fit(docs: DataFrame, sf_dir: str, bound: int = LABELLED_ROWS) -> Machine:
    def run(batches):
        for b in batches:
            for i, j, x in _vectors_of(b):
                yield pa.record_batch({"doc_id": b.column("doc_id")[i:j], "label": b.column("label")[i:j],
                                       "x": pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())})

    ids = S.labelled_ids(docs.sparkSession, sf_dir, bound)
    got = (_input(docs).join(F.broadcast(ids), "doc_id").mapInArrow(run, "doc_id long, label int, x binary")
           .groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r"))
           .select("doc_id", "r.label", "r.x").orderBy("doc_id").toPandas())
    d = BUCKETS + len(S.FEATURES) + 1
    x = np.frombuffer(b"".join(bytes(r) for r in got["x"]), np.float32).reshape(len(got), d)
    return train(x, got["label"].to_numpy(np.float32))


def classify(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    def run(batches):
        for b in batches:
            for i, j, x in _vectors_of(b):
                p = machine.score(x)
                yield pa.record_batch({"doc_id": b.column("doc_id")[i:j], "held_out": b.column("held_out")[i:j],
                                       "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    held = F.coalesce(C.crc_mod("doc_id", 3) == 1, F.lit(True))
    return _input(docs).withColumn("held_out", held).mapInArrow(run, OUT)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return classify(docs, fit(docs, sf_dir))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that the classifier accepts, all columns as they came."""
    machine = fit(docs, sf_dir)
    names = docs.columns
    schema = docs.schema
    extra = docs.select(*names, *(F.lit(None).cast("long").alias(c) for c in ("n_chars",) if c not in names))

    def run(batches):
        for b in batches:
            text = b.column("text").fill_null("")
            view = pa.record_batch({"text": text, "n_chars": b.column("n_chars").cast(pa.int64())})
            good = [machine.score(x) >= 0.5 for _, _, x in _vectors_of(view)]
            if good:
                yield b.select(names).filter(pa.array(np.concatenate(good)))

    return extra.mapInArrow(run, schema)
