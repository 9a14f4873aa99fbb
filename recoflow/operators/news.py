"""News recommendation features: article words and entities, vocabularies, indices, impressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.cols import DEFAULT, Cols
from recoflow.functions.text import WORD
from recoflow.operators.ordering import global_rank

ENTITIES = "array<struct<SurfaceForms:array<string>,WikidataId:string>>"


def words_and_entities(train: DataFrame, valid: DataFrame, id_col: str, title: str, entities: str) -> DataFrame:
    """(id, words, entities) of the union; an id in both parts has its last (valid) article."""
    both = (train.select(id_col, title, entities, F.lit(0).alias("_part"))
            .unionByName(valid.select(id_col, title, entities, F.lit(1).alias("_part"))))
    last = both.groupBy(id_col).agg(F.max_by(F.struct(title, entities), F.struct("_part", title)).alias("_r"))
    return last.select(id_col, F.regexp_extract_all(F.lower(f"_r.{title}"), F.lit(WORD), 0).alias("words"),
                       F.from_json(f"_r.{entities}", ENTITIES).alias("entities"))


def word_vocabulary(docs: DataFrame, vectors: DataFrame, id_col: str, words: str, word: str = "word") -> DataFrame:
    """(word, index): words that have a vector, numbered from 1 by first appearance (document, place)."""
    each = docs.select(id_col, F.posexplode(words).alias("_p", word))
    known = each.join(vectors.select(word).distinct(), word, "left_semi")
    first = known.groupBy(word).agg(F.min(F.struct(F.col(id_col).alias("d"), F.col("_p").alias("p"))).alias("_f"))
    first = first.select(word, F.col("_f.d").alias("_d"), F.col("_f.p").alias("_p"))
    return global_rank(first, ["_d", "_p", word]).select(word, F.col("_grank").alias("index"))


def _placed(df: DataFrame, id_col: str, value: str, size: int) -> Column:
    """Array of ``size`` places: the values at their places, 0 elsewhere."""
    at = F.map_from_entries(F.collect_list(F.struct("_p", value)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(at, i), F.lit(0).cast("bigint")))


def doc_word_index(docs: DataFrame, vocab: DataFrame, id_col: str, words: str, size: int,
                   entities: DataFrame | None = None, word: str = "word") -> DataFrame:
    """(id, word_index, entity_index): the first ``size`` words of each document as indices, 0 where unknown
    and as padding; an entity index stands where the word is one of the document's surface words.

    ``entities``: (id, surface word, entity_index). ``size`` is the fixed length of the feature.
    """
    each = docs.select(id_col, F.posexplode_outer(F.slice(words, 1, size)).alias("_p", word))
    each = each.join(vocab.select(word, F.col("index").alias("_w")), word, "left")
    if entities is not None:
        one = entities.groupBy(id_col, word).agg(F.max("entity_index").alias("_e"))
        each = each.join(one, [id_col, word], "left")
    else:
        each = each.withColumn("_e", F.lit(None).cast("bigint"))
    each = each.withColumn("_p", F.coalesce("_p", F.lit(-1)))  # a document without words has zeros only
    return each.groupBy(id_col).agg(_placed(each, id_col, "_w", size).alias("word_index"),
                                    _placed(each, id_col, "_e", size).alias("entity_index"))


def embedding_lookup(vocab: DataFrame, vectors: DataFrame, dims: int, word: str = "word", vector: str = "vector") -> DataFrame:
    """(index, vector, found): a row per vocabulary word and row 0; zeros for row 0 and words without a vector."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    rows = (vocab.select(word, "index").join(vectors.select(word, F.col(vector).alias("_v")), word, "left")
            .select("index", F.coalesce("_v", zeros).alias("vector"), F.col("_v").isNotNull().alias("found")))
    pad = vocab.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("index"), zeros.alias("vector"), F.lit(False).alias("found"))
    return rows.unionByName(pad)


def latest_history(behaviors: DataFrame, order: list[str], user: str = "user_id", history: str = "history") -> DataFrame:
    """(user, history) of the user's last line."""
    return behaviors.groupBy(user).agg(F.max_by(history, F.struct(*order)).alias(history))


def impression_features(rows: DataFrame, features: DataFrame, histories: DataFrame, history_size: int, size: int,
                        item: str = "item_id", user: str = "user_id", history: str = "history") -> DataFrame:
    """Rows (label, user, item, …) with the indices of the candidate and of the user's history.

    The history is the first ``history_size`` entries, each an index array of
    ``size``; missing entries are zeros. features: (item, word_index, entity_index).
    """
    feat = features.select(F.col(item).cast("string").alias("_key"), "word_index", "entity_index")
    cand = feat.withColumnsRenamed({"word_index": "candidate_words", "entity_index": "candidate_entities"})
    past = histories.select(user, F.posexplode(F.slice(history, 1, history_size)).alias("_p", "_key")).join(feat, "_key")
    packed = past.groupBy(user).agg(F.map_from_entries(F.collect_list(F.struct("_p", F.struct("word_index", "entity_index")))).alias("_h"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), size)

    def spread(part: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(history_size - 1)),
                           lambda i: F.coalesce(F.element_at(F.col("_h"), i)[part], zeros))
    out = rows.withColumn("_key", F.col(item).cast("string")).join(cand, "_key", "left").join(packed, user, "left")
    out = out.withColumn("_h", F.coalesce("_h", F.expr("cast(map() AS map<int, struct<word_index:array<bigint>,entity_index:array<bigint>>>)")))
    return (out.withColumn("candidate_words", F.coalesce("candidate_words", zeros))
            .withColumn("candidate_entities", F.coalesce("candidate_entities", zeros))
            .withColumn("history_words", spread("word_index")).withColumn("history_entities", spread("entity_index"))
            .drop("_key", "_h"))


def sequence_negatives(inst: DataFrame, k: int, length: int, batch_size: int, order: list[str], history: str,
                       seed: int = 42, cols: Cols = DEFAULT) -> DataFrame:
    """Per instance: next-item targets of its last ``length`` places and, per place, k items of other instances.

    Instances go into runs of ``batch_size`` in ``order``; a place draws from its
    run by a hash, stepping on while the drawn item equals its target. Returns the
    order columns, targets and negatives (k arrays), shorter where the run holds no other item.
    """
    from recoflow.functions.hashing import hash_int

    runs = global_rank(inst, order, rank_col="_g").withColumn("_b", F.floor((F.col("_g") - 1) / batch_size))
    # at most batch_size items a run
    pool = runs.groupBy("_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("_g", cols.item))), lambda x: x[cols.item]).alias("_pool"))
    full = F.concat(F.col(history), F.array(F.col(cols.item)))
    targets = F.slice(full, F.greatest(F.lit(1), F.size(full) - length + 1), length)
    each = (runs.select("_b", *order, targets.alias("targets"))
            .select("_b", *order, "targets", F.posexplode("targets").alias("_p", "_t"))
            .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).join(pool, "_b"))
    m = F.size("_pool")
    start = F.pmod(hash_int(seed, *order, "_p", "_j"), m)
    turned = F.concat(F.slice("_pool", start.cast("int") + 1, m), F.slice("_pool", 1, start.cast("int")))
    drawn = each.withColumn("_n", F.get(F.filter(turned, lambda x: x != F.col("_t")), F.lit(0)))
    per_j = (drawn.where("_n IS NOT NULL").groupBy(*order, "_j")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_n"))), lambda x: x["_n"]).alias("_row")))
    negs = per_j.groupBy(*order).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_row"))), lambda x: x["_row"]).alias("negatives"))
    return runs.select(*order, targets.alias("targets")).join(negs, order, "left")


def sessions(impressions: DataFrame, group: str = "imp_id", cols: Cols = DEFAULT) -> DataFrame:
    """(group, session): impressions numbered from 0 in id order."""
    return global_rank(impressions.select(group).distinct(), [group]).select(group, (F.col("_grank") - 1).alias("session"))


