"""User–item graph: symmetric normalised adjacency and embedding propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.cols import DEFAULT, Cols
from recoflow.session import ensure_checkpoint_dir


def normalized_adjacency(train: DataFrame, cols: Cols = DEFAULT, eps: float = 1e-9) -> DataFrame:
    """Edges (src_kind, src, dst_kind, dst, w) both ways, w = 1/√(d_u+eps) · 1/√(d_i+eps)."""
    ui = train.where(F.col(cols.rating) > 0).select(cols.user, cols.item).distinct()
    du = ui.groupBy(cols.user).agg(F.count(F.lit(1)).alias("_du"))
    di = ui.groupBy(cols.item).agg(F.count(F.lit(1)).alias("_di"))
    e = ui.join(du, cols.user).join(di, cols.item).withColumn(
        "w", (1.0 / F.sqrt(F.col("_du") + eps)) * (1.0 / F.sqrt(F.col("_di") + eps)))
    fwd = e.select(F.lit("u").alias("src_kind"), F.col(cols.user).alias("src"), F.lit("i").alias("dst_kind"),
                   F.col(cols.item).alias("dst"), "w")
    back = e.select(F.lit("i").alias("src_kind"), F.col(cols.item).alias("src"), F.lit("u").alias("dst_kind"),
                    F.col(cols.user).alias("dst"), "w")
    return fwd.unionByName(back)


HUB_EDGES = 4096  # edges of one node that meet its vector in one join group


def graph_propagate(edges: DataFrame, emb: DataFrame, layers: int = 3, hub_edges: int = HUB_EDGES) -> DataFrame:
    """Mean over layers 0..L of e^(l+1) = A · e^(l); embeddings in long form (kind, node, dim, val).

    Vertex cut: the edges of a hub are dealt into parts of about ``hub_edges``, to which its vector is copied;
    what arrives at a node is summed inside each task first. A vector travels as one row with a column a
    dimension, so an edge is read once a hop whatever the dimension. Edges are written once, each layer
    as well (reliable checkpoint in the shared folder, which cuts the lineage). The layers are summed once, at the end.
    """
    ensure_checkpoint_dir(emb.sparkSession)
    top = emb.agg(F.max("dim")).first()[0]  # one number: the dimension
    names = [f"v{i}" for i in range(0 if top is None else int(top) + 1)]
    if not names:
        return emb.select("kind", "node", "dim", "val")
    whole = layer = (emb.groupBy("kind", "node")
                     .agg(*(F.coalesce(F.sum(F.when(F.col("dim") == i, F.col("val"))), F.lit(0.0)).alias(n) for i, n in enumerate(names)))
                     .checkpoint())
    hubs = (edges.groupBy("src_kind", "src").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hub_edges)
            .select("src_kind", "src", F.ceil(F.col("_n") / hub_edges).cast("int").alias("_parts")).checkpoint())
    parts = F.coalesce("_parts", F.lit(1))
    dealt = (edges.join(hubs, ["src_kind", "src"], "left")
             .withColumn("_part", F.pmod(F.xxhash64("dst_kind", "dst"), parts).cast("int")).drop("_parts").checkpoint())
    for _ in range(layers):
        sent = (layer.withColumnsRenamed({"kind": "src_kind", "node": "src"}).join(hubs, ["src_kind", "src"], "left")
                .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts"))
        layer = (dealt.join(sent, ["src_kind", "src", "_part"])
                 .groupBy(F.col("dst_kind").alias("kind"), F.col("dst").alias("node"))
                 .agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))).checkpoint()
        whole = whole.unionByName(layer)
    mean = whole.groupBy("kind", "node").agg(F.array(*((F.sum(n) / float(layers + 1)) for n in names)).alias("_v"))
    return mean.select("kind", "node", F.posexplode("_v").alias("dim", "val"))


def to_long(df: DataFrame, kind: str, id_col: str, feature_col: str) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(id_col).alias("node"),
                     F.posexplode(feature_col).alias("dim", "val")).withColumn("val", F.col("val").cast("double"))
