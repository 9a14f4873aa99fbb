"""N-gram Jaccard join: MinHash banding, verification on full 5-word n-gram sets.

Rows and bands are chosen for a target recall at the threshold. One Arrow pass
gives each document a fingerprint of its n-gram set and its band hashes;
documents of equal sets (copies) go on as one. Band hashes are shuffled, every
bucket links its members to one of them (a star, not all pairs), and the
components of these stars are where similar sets can be. Members of a component
meet in blocks of bounded size: in a block, the pairs that share a band are
compared on their whole sets. A block returns, per member, the number of linked
documents and an edge of a spanning forest, never its pairs; a second
union-find over verified edges gives the classes.

n-grams are runs of 5 words ``[^\\x20\\x09-\\x0D]+`` as they stand, compared by
64-bit hashes; a text of 1 to 4 words has one n-gram, all of them. A pair is
linked at Jaccard >= 0.8.

Defined cases: a text without words is a class of its own without links; equal
sets are linked whatever their texts; rows that repeat a ``doc_id`` count as
documents of their own; a row without ``doc_id`` takes part, but names a class
only if no member has an id; extra columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import common as C
from recoflow.llm.components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.999
BLOCK = 256


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall within ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, most):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _constants(k: int) -> np.ndarray:
    return C.mix64(np.arange(1, k + 1, dtype=C.U64) * C.U64(0x632BE59BD9B4E019))


def gram_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    starts, ends, first = C.word_spans(data, offs)
    words = C.word_hashes(data, starts, ends)
    roll = C.rolling(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(roll[a:b - n + 1]))
        else:
            out.append(C.mix64(C.rolling(words[a:b], b - a) + C.U64(b - a)) if b > a else np.zeros(0, C.U64))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, band hashes) of non-empty sets. h * m_i + c_i (m_i odd) orders the hashes anew for each i.

    A bare XOR would not: constants of equal leading bits pick the same element.
    """
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    orders = _constants(2 * bands * rows).reshape(-1, 2)
    mins = np.stack([np.minimum.reduceat(flat * (m | C.U64(1)) + c, at) for m, c in orders], axis=1).reshape(len(sets), bands, rows)
    band = np.broadcast_to(np.arange(1, bands + 1, dtype=C.U64) * C.U64(0x8CB92BA72F3D8DD7), (len(sets), bands)).copy()
    for r in range(rows):
        band = C.mix64(band ^ mins[:, :, r]) * C.U64(0x9FB21C651E98DF25)
    print_ = C.mix64(np.add.reduceat(C.mix64(flat), at) + np.diff(np.append(at, len(flat))).astype(C.U64))
    return print_, band


def _describe(n: int, bands: int, rows: int):
    def run(batches):
        for b in batches:
            for i, j, data, offs in C.chunks(b.column("text")):
                sets = gram_sets(data, offs, n)
                full = [k for k, s in enumerate(sets) if len(s)]
                prints = np.zeros(j - i, np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                lists = [None] * (j - i)
                if full:
                    p, band = signatures([sets[k] for k in full], bands, rows)
                    prints[full] = p.view(np.int64)
                    for k, row in zip(full, band.view(np.int64)):
                        lists[k] = row
                yield pa.record_batch({"doc_id": b.column("doc_id")[i:j], "th": b.column("th")[i:j],
                                       "fp": pa.array(prints, mask=sizes == 0), "bands": pa.array(lists, pa.list_(pa.int64()))})
    return run


def _sets(n: int):
    def run(batches):
        for b in batches:
            for i, j, data, offs in C.chunks(b.column("text")):
                sets = gram_sets(data, offs, n)
                yield pa.record_batch({"fp": b.column("fp")[i:j], "grams": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())})
    return run


def _links(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """Linked pairs among sets that share a band; with ``side``, only pairs across the sides."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    vocab, code = np.unique(np.concatenate(sets), return_inverse=True)
    bits = np.zeros((m, -(-len(vocab) // 8)), np.uint8)
    owner = np.repeat(np.arange(m), size)
    np.bitwise_or.at(bits, (owner, code >> 3), (1 << (code & 7)).astype(np.uint8))
    out = []
    for i in range(m - 1):
        later = slice(i + 1, m)
        near = (bands[later] == bands[i]).any(axis=1) & (np.minimum(size[later], size[i]) >= threshold * np.maximum(size[later], size[i]))
        if side is not None:
            near &= side[later] != side[i]
        j = np.flatnonzero(near) + i + 1
        if len(j):
            common = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
            out += [(i, int(k)) for k in j[common >= threshold * (size[j] + size[i] - common) - 1e-9]]
    return out


def _verify(threshold: float):
    def run(table):
        cols = {k: table.column(k).to_pylist() for k in ("part", "side", "fp", "copies", "grams")}
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(table.num_rows, -1)
        out = {"fp": [], "links": [], "to": []}
        groups: dict = {}
        for r, part in enumerate(cols["part"]):
            groups.setdefault(part, []).append(r)
        for rows in groups.values():
            side = np.array([cols["side"][r] for r in rows])
            across = side if (side != side[0]).any() else None  # two blocks: their inner pairs meet elsewhere
            if side[0] < 0 and across is None:
                continue
            links = _links([np.frombuffer(cols["grams"][r], "<u8") for r in rows], bands[rows], across, threshold)
            root = list(range(len(rows)))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            count = [0] * len(rows)
            for i, j in links:
                count[i] += cols["copies"][rows[j]]
                count[j] += cols["copies"][rows[i]]
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            for i, c in enumerate(count):
                if c:
                    out["fp"].append(cols["fp"][rows[i]])
                    out["links"].append(c)
                    out["to"].append(cols["fp"][rows[find(i)]])
        return pa.table(out, schema=pa.schema([("fp", pa.int64()), ("links", pa.int64()), ("to", pa.int64())]))
    return run


def describe(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, text hash, set fingerprint (null without words), band hashes."""
    bands, rows = banding(threshold, recall)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text"))
            .select("doc_id", F.xxhash64("text").alias("th"), "text")
            .mapInArrow(_describe(n, bands, rows), "doc_id long, th long, fp long, bands array<long>"))


def join_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, class_id, n_copies, n_links, first (of its class).

    class_id: the least doc_id of the class; n_copies: other documents of the
    same n-gram set; n_links: all other documents that are linked.
    """
    rows = C.checkpointed(describe(docs, n, threshold, recall))
    reps = (rows.where("fp IS NOT NULL").groupBy("fp")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("rep"),
                 F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
            .select("fp", "rep", "copies", "bands"))
    reps = C.checkpointed(reps)

    # stars: each member of a bucket to the least one
    member = reps.select("fp", F.explode("bands").alias("band"))
    leader = member.groupBy("band").agg(F.min("fp").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = member.join(leader.select("band", "leader"), "band").where("fp <> leader").select(F.col("fp").alias("a"), F.col("leader").alias("b"))
    near = components(stars)
    near = C.checkpointed(near.union(near.select("root", "root").distinct()).toDF("fp", "comp"))

    # the sets of the candidates, from a second pass over the texts of one document each
    want = near.join(reps, "fp").select("fp", F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text"))
    found = (want.join(texts, F.col("r_id").eqNullSafe(F.col("doc_id")) & (F.col("r_th") == F.xxhash64("text")))
             .select("fp", "text").mapInArrow(_sets(n), "fp long, grams binary").dropDuplicates(["fp"]))
    sizes = near.groupBy("comp").agg(F.count(F.lit(1)).alias("m")).withColumn("nb", F.ceil(F.col("m") / block))
    total = near.count()  # one number: how many batches the small components make
    placed = (near.join(sizes, "comp").join(reps.select("fp", "copies", "bands"), "fp").join(found, "fp")
              .withColumn("b", F.pmod(F.xxhash64("fp"), "nb")))
    # a small component joins a batch of such; of a large one, every two blocks meet
    meet = F.when(F.col("nb") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    dealt = (placed.withColumn("o", F.explode(meet))
             .withColumn("part", F.struct("comp", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi")))
             .withColumn("side", F.when((F.col("nb") > 1) & (F.col("b") != F.col("o")), F.when(F.col("b") < F.col("o"), F.lit(-1)).otherwise(F.lit(-2)))
                         .otherwise(F.lit(0)))
             .withColumn("batch", F.when(F.col("nb") == 1, F.pmod(F.xxhash64("comp"), F.lit(total // (4 * block) + 1))).otherwise(F.xxhash64("part")))
             .withColumn("part", F.xxhash64("part"))
             .select("batch", "part", "side", "fp", "copies", "bands", "grams"))
    verified = C.checkpointed(dealt.groupBy("batch").applyInArrow(_verify(threshold), "fp long, links long, to long"))

    classes = components(verified.select(F.col("fp").alias("a"), F.col("to").alias("b")))
    links = verified.groupBy("fp").agg(F.sum("links").alias("links"))
    per_set = (reps.select("fp", "rep", "copies").join(classes.withColumnRenamed("node", "fp"), "fp", "left").join(links, "fp", "left")
               .withColumn("root", F.coalesce("root", "fp")))
    heads = per_set.groupBy("root").agg(F.min("rep").alias("head"))
    info = per_set.join(heads, "root").select("fp", "copies", F.coalesce("links", F.lit(0)).alias("links"), "head")
    head = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    told = _told(rows.select("doc_id", "th", "fp"), info, reps)
    return (told
            .select("doc_id", "th", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
                    F.coalesce(F.col("copies") - 1, F.lit(0)).alias("n_copies"),
                    F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"),
                    (F.col("head").isNull() | F.col("head").eqNullSafe(head)).alias("first")))


HOT_SETS = 1 << 16  # at most so many sets are dealt over several tasks: those with more than 1/HOT_SETS of the rows


def _told(rows: DataFrame, info: DataFrame, reps: DataFrame) -> DataFrame:
    """Every row with what is known of its set; rows without words stay where they are, a crowd of copies is dealt to parts."""
    n = reps.agg(F.sum("copies")).first()[0] or 0  # one number
    bound = max(64, n // HOT_SETS)
    # fewer than HOT_SETS rows by the choice of the bound, or than n / 64 of a small table
    hot = F.broadcast(reps.where(F.col("copies") > bound).select("fp", F.ceil(F.col("copies") / bound).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.where("fp IS NOT NULL").join(hot, "fp", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "th"), parts).cast("int")).drop("parts")
    copied = info.join(hot, "fp", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    without = rows.where("fp IS NULL").select("*", *(F.lit(None).cast(t).alias(c) for c, t in info.dtypes if c != "fp"))
    return dealt.join(copied, ["fp", "part"], "left").drop("part").unionByName(without)


def op7(spark, sf_dir: str) -> DataFrame:
    return join_copies(C.documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class, the row of least doc_id (of equal rows, one); all columns as they came."""
    keep = (join_copies(docs).where("first").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("same"))
            .select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), "same"))
    # the input's columns travel in one struct, so none can clash with those of the decision
    packed = docs.select(C.packed(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(C.whole_text()).alias("th"))
    kept = packed.join(keep, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")))
    once = kept.where("same = 1").select("row.*")
    return once.union(kept.where("same > 1").dropDuplicates(["k_id", "k_th"]).select("row.*"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT d.doc_id, min(r.root) AS class_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links
FROM d JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
