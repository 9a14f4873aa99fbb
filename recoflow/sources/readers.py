"""Readers for the text formats recommendation data arrives in.

All readers declare a schema (no inference) and parse with built-in
functions; nothing is evaluated row by row in Python.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recoflow.session import written

# Separators and header flags of the supported rating formats.
RATING_FORMATS = {
    "tsv": {"sep": "\t", "header": False},       # user item rating timestamp
    "double_colon": {"sep": "::", "header": False},
    "csv": {"sep": ",", "header": True},
}


def ratings_schema(names_or_schema=None) -> T.StructType:
    """Schema from a list of names (types by role) or a StructType; cut to 4 fields with a warning."""
    roles = [T.LongType(), T.LongType(), T.FloatType(), T.LongType()]
    default = ["user_id", "item_id", "rating", "ts"]
    if names_or_schema is None:
        names_or_schema = default
    if isinstance(names_or_schema, T.StructType):
        fields = list(names_or_schema.fields)
    else:
        fields = [T.StructField(n, roles[i] if i < 4 else T.StringType()) for i, n in enumerate(names_or_schema)]
    if len(fields) > 4:
        warnings.warn("Too many columns in the schema; only the first 4 are used")
        fields = fields[:4]
    return T.StructType(fields)


def read_ratings(spark: SparkSession, path: str, fmt: str = "tsv", schema=None) -> DataFrame:
    """A line that does not fit the schema stops the read; it never turns into nulls."""
    opts = RATING_FORMATS[fmt]
    return spark.read.csv(path, schema=ratings_schema(schema), sep=opts["sep"], header=opts["header"], mode="FAILFAST")


def read_items(spark: SparkSession, path: str, sep: str = "|", encoding: str = "ISO-8859-1") -> DataFrame:
    """item|title (year)|genre|genre... → item_id, title, year (null unless decimal), genres array."""
    raw = spark.read.text(path, wholetext=False).select(F.split("value", sep.replace("|", r"\|")).alias("f"))
    title = raw.f[1]
    parts = F.split(title, "[()]")
    cand = F.element_at(parts, -2)
    year = F.when(F.size(parts) >= 2, F.when(F.trim(cand).rlike("^[0-9]+$"), F.trim(cand).cast("int")))
    return raw.select(raw.f[0].cast("bigint").alias("item_id"), title.alias("title"), year.alias("year"),
                      F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))).alias("genres"))


def items_by_year(items: DataFrame) -> DataFrame:
    return items.groupBy("year").agg(F.count(F.lit(1)).alias("n_items"))


def genres_from_flags(flags: DataFrame, genre_names: list[str], out: str = "genres") -> DataFrame:
    """0/1 genre flag columns → array of genre names, in list order."""
    names = F.array_compact(F.array(*[F.when(F.col(g) == 1, F.lit(g)) for g in genre_names]))
    return flags.withColumn(out, names)


def items_by_genre(items: DataFrame, genres: str = "genres") -> DataFrame:
    """Items per genre; a genre that an item names twice counts once."""
    return (items.select(F.explode(F.array_distinct(genres)).alias("genre"))
            .groupBy("genre").agg(F.count(F.lit(1)).alias("n_items")))


def ratings_with_items(ratings: DataFrame, items: DataFrame, on: str = "item_id", how: str = "left") -> DataFrame:
    """Ratings joined with item attributes; Spark broadcasts the items if their measured bytes allow it."""
    return ratings.join(items, on, how)


def ctr_schema(n_int: int = 13, n_cat: int = 26) -> T.StructType:
    return T.StructType([T.StructField("label", T.IntegerType())]
                        + [T.StructField(f"int{i:02d}", T.IntegerType()) for i in range(n_int)]
                        + [T.StructField(f"cat{i:02d}", T.StringType()) for i in range(n_cat)])


def read_ctr_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=ctr_schema(), sep="\t", header=False, quote="\u0000")


REVIEW_SCHEMA = "reviewerID string, asin string, unixReviewTime long"


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Python-literal style review lines (single quotes) parsed as JSON — never evaluated."""
    raw = spark.read.text(path)
    r = F.from_json("value", REVIEW_SCHEMA, {"allowSingleQuotes": "true"})
    return raw.select(r.alias("r")).select(F.col("r.reviewerID").alias("user_id"), F.col("r.asin").alias("item_id"),
                                           F.col("r.unixReviewTime").alias("ts"))


def read_ffm(spark: SparkSession, path: str) -> DataFrame:
    """`label f:i:v ... [%imp]` → label, array<(field, feature, value)> 0-based, impression id (0 default)."""
    raw = spark.read.text(path).select(F.split("value", "%").alias("p"))
    toks = F.split(F.trim(raw.p[0]), " ")
    feats = F.transform(F.slice(toks, 2, F.size(toks)), lambda t: F.struct(
        (F.split(t, ":")[0].cast("int") - 1).alias("field"), (F.split(t, ":")[1].cast("int") - 1).alias("feature"),
        F.split(t, ":")[2].cast("float").alias("value")))
    imp = F.when(F.size("p") > 1, F.trim(raw.p[1]).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return raw.select(toks[0].cast("float").alias("label"), feats.alias("features"), imp.alias("impression_id"))


def ffm_sparse_index(ffm: DataFrame, row_col: str = "row_id") -> DataFrame:
    """COO (row, feature, value) and the per-(row, field) slot number (0-based, in line order)."""
    e = ffm.select(row_col, F.posexplode("features").alias("pos", "f"))
    from pyspark.sql import Window
    w = Window.partitionBy(row_col, "f.field").orderBy("pos")
    return e.select(row_col, F.col("f.field").alias("field"), F.col("f.feature").alias("feature"),
                    F.col("f.value").alias("value"), (F.row_number().over(w) - 1).alias("slot"))


def read_embeddings(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """`key v1 ... vn` → key, array<float>."""
    raw = spark.read.text(path).select(F.split(F.trim("value"), sep).alias("t"))
    return raw.select(raw.t[0].alias("key"),
                      F.transform(F.slice("t", 2, F.size("t")), lambda x: x.cast("float")).alias("vector"))


def read_sequences(spark: SparkSession, path: str, users: DataFrame | None = None, items: DataFrame | None = None,
                   cates: DataFrame | None = None) -> DataFrame:
    """8-column TSV instances → typed arrays.

    With vocabularies (word, index) the columns ``user_idx``, ``item_idx``, ``cate_idx``, ``item_history_idx`` and
    ``cate_history_idx`` are added; a word that is not listed is 0.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    vocabularies = {"user": users, "item": items, "cate": cates}
    given = {k: v for k, v in vocabularies.items() if v is not None}
    f = F.split("value", "\t", -1)
    typed = [F.get(f, F.lit(0)).cast("int").alias("label"), F.get(f, F.lit(1)).alias("user_id"), F.get(f, F.lit(2)).alias("item_id"),
             F.get(f, F.lit(3)).alias("cate"), F.get(f, F.lit(4)).cast("long").alias("ts"),
             F.split(F.get(f, F.lit(5)), ",").alias("item_history"), F.split(F.get(f, F.lit(6)), ",").alias("cate_history"),
             F.when(F.get(f, F.lit(7)) != "", F.transform(F.split(F.get(f, F.lit(7)), ","), lambda x: x.cast("long"))).alias("time_history")]
    if not given:
        return lines.select(*typed)
    # lines stay in blocks of consecutive ones; a block asks for each of its words once, whatever their places
    fields = [(name, kind, column) for name, kind, column in (
        ("user_idx", "user", "user_id"), ("item_idx", "item", "item_id"), ("cate_idx", "cate", "cate"),
        ("item_history_idx", "item", "item_history"), ("cate_history_idx", "cate", "cate_history")) if kind in given]
    columns = ["label", "user_id", "item_id", "cate", "ts", "item_history", "cate_history", "time_history"]
    whole = [column for name, _, column in fields if name.endswith("history_idx")]  # a line without that field is left out
    block = F.shiftright(F.monotonically_increasing_id(), LINES_A_BLOCK.bit_length() - 1).alias("_block")
    blocks = written(lines.select(block, *typed), "lines").where(" AND ".join([f"{c} IS NOT NULL" for c in whole] or ["true"]))

    def named(kind, column):
        words = F.col(column) if column in whole else F.array(column)
        return F.transform(F.array_distinct(words), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    words = blocks.select("_block", F.explode(F.flatten(F.array(*(named(kind, column) for _, kind, column in fields)))).alias("_p"))
    words = written(words.select("_block", "_p.*").where("word IS NOT NULL").distinct(), "words")
    listed = None
    for kind, v in given.items():
        one = v.select(F.lit(kind).alias("kind"), F.col(v.columns[0]).cast("string").alias("word"), F.col(v.columns[1]).cast("bigint").alias("idx"))
        listed = one if listed is None else listed.unionByName(one)
    found = vocabulary_lookup(words, listed.withColumn("idx", F.coalesce("idx", F.lit(0))), ["kind", "word"], "idx").where("idx IS NOT NULL")
    added = [T.StructField(name, T.ArrayType(T.LongType()) if name.endswith("history_idx") else T.LongType()) for name, _, _ in fields]
    out = T.StructType([*(blocks.schema[c] for c in columns), *added])
    return (blocks.groupBy("_block").cogroup(found.select("_block", "kind", "word", "idx").groupBy("_block"))
            .applyInArrow(_placed(fields, columns, to_arrow_schema(out)), out))


LINES_A_BLOCK = 1 << 12


def _placed(fields: list[tuple[str, str, str]], columns: list[str], out: pa.Schema):
    """A block's lines and the indexes of its words -> the lines with these; a word that is listed twice has both, in order."""
    def run(lines: pa.Table, told: pa.Table) -> pa.Table:
        if not lines.num_rows:
            return out.empty_table()
        told = told.sort_by([("word", "ascending"), ("idx", "ascending")])
        of = {}
        for kind in {kind for _, kind, _ in fields}:
            mine = told.filter(pc.equal(told.column("kind"), kind))
            coded = mine.column("word").combine_chunks().dictionary_encode()
            many = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
            of[kind] = coded.dictionary, np.append(many, 1), np.append(np.cumsum(many) - many, mine.num_rows), np.append(np.asarray(mine.column("idx")), 0)
        added = []
        for name, kind, column in fields:
            words, many, first, idx = of[kind]
            asked = lines.column(column).combine_chunks()
            flat = asked.flatten() if name.endswith("history_idx") else asked
            at = np.asarray(pc.fill_null(pc.index_in(flat, value_set=words.cast(flat.type), skip_nulls=True), len(words))).astype(np.int64)
            if not name.endswith("history_idx"):
                added.append(pa.array(idx[first[at]]))
                continue
            n = many[at]
            places = np.arange(n.sum()) + np.repeat(first[at] - (np.cumsum(n) - n), n)
            ends = np.concatenate([[0], np.cumsum(n)])
            offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(asked)))])
            added.append(pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(idx[places])))
        return pa.table([*(lines.column(c) for c in columns), *added], names=out.names).cast(out)
    return run


def vocabulary_lookup(words: DataFrame, vocabulary: DataFrame, on: list[str], value: str, heavy: int = 1024) -> DataFrame:
    """``words`` with ``value`` of the vocabulary (null: not listed), whatever a word's share of the rows.

    Heavy hitters, words with more than a ``heavy``-th of all rows (so fewer than ``heavy`` words, by a partial
    count), meet their few vocabulary rows by broadcast, without moving; the other words are shuffled.
    """
    counts = words.groupBy(*on).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_all"))
    hot = counts.join(F.broadcast(total)).where(F.col("_c") * heavy > F.col("_all")).select(*on)
    # fewer than ``heavy`` rows by construction
    hot_rows = F.broadcast(hot.join(vocabulary, on, "left").withColumn("_hot", F.lit(True)))
    marked = words.join(hot_rows, on, "left")
    stay = marked.where("_hot").drop("_hot")
    move = marked.where("_hot IS NULL").drop("_hot", value).join(vocabulary, on, "left")
    return stay.select(*words.columns, value).unionByName(move.select(*words.columns, value))


ENTITY_SCHEMA = "array<struct<SurfaceForms:array<string>,WikidataId:string>>"


def news_entities(news: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Entities JSON → one row per (news, surface form, entity id)."""
    ents = news.select(id_col, F.explode(F.from_json(json_col, ENTITY_SCHEMA)).alias("e"))
    return ents.select(id_col, F.explode("e.SurfaceForms").alias("surface"), F.col("e.WikidataId").alias("entity_id"))


NEWS_COLUMNS = ("news_id", "vert", "subvert", "title", "abstract", "url", "title_entities", "abstract_entities")
BEHAVIOR_COLUMNS = ("imp_id", "user_id", "time", "history", "imps")


def _tab_lines(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """Tab-separated lines as string columns, with ``_line``: the order of lines by file and place."""
    raw = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                     F.monotonically_increasing_id().alias("m"))
    f = raw.select(place.alias("_line"), F.split("value", "\t", -1).alias("f"))
    return f.select("_line", *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """News TSV; of lines with the same id the first stays. Quotes are ordinary characters."""
    lines = _tab_lines(spark, path, NEWS_COLUMNS)
    first = lines.groupBy("news_id").agg(F.min_by(F.struct(*NEWS_COLUMNS[1:]), "_line").alias("_r"))
    return first.select("news_id", "_r.*")


def read_behaviors(spark: SparkSession, path: str) -> DataFrame:
    """Impression log: imp_id, user_id, time, history, clicked (pos) and other (neg) items, ``_line`` order."""
    b = _tab_lines(spark, path, BEHAVIOR_COLUMNS)
    items = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    marked = lambda mark: F.transform(F.filter(items("imps"), lambda x: x.endswith(mark)),
                                      lambda x: F.substring_index(x, "-", 1))
    return b.select("_line", "imp_id", "user_id", "time", items("history").alias("history"),
                    marked("-1").alias("pos"), marked("-0").alias("neg"))


def read_review_meta(spark: SparkSession, path: str) -> DataFrame:
    """Python-literal style meta lines → item_id, cate: the last label of the first category path."""
    raw = spark.read.text(path)
    m = F.from_json("value", "asin string, categories array<array<string>>", {"allowSingleQuotes": "true"})
    r = raw.select(m.alias("m"))
    return r.select(F.col("m.asin").alias("item_id"), F.element_at(F.get("m.categories", F.lit(0)), -1).alias("cate"))


BODY = "body_text array<struct<text:string>>"


def fulltext_join(meta: DataFrame, bodies: DataFrame, files: list[str], key: str = "path", body: str = "json") -> DataFrame:
    """Metadata rows with ``full_text``: the paragraphs of the first of ``files`` that is named and holds text.

    Rows without any text are dropped. bodies: (path, json) with body_text paragraphs.
    """
    text = F.concat_ws(" ", F.transform(F.from_json(body, BODY)["body_text"], lambda p: p["text"]))
    read = bodies.select(F.col(key).alias("_k"), text.alias("_t"))
    out = meta
    for i, f in enumerate(files):
        out = out.join(read.withColumnsRenamed({"_k": f"_k{i}", "_t": f"_t{i}"}), F.col(f) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    found = [F.when(F.col(f"_t{i}") != "", F.col(f"_t{i}")) for i in range(len(files))]
    return (out.withColumn("full_text", F.coalesce(*found)).where("full_text IS NOT NULL")
            .drop(*files, *(f"_t{i}" for i in range(len(files)))))


BINDINGS = ("results struct<bindings:array<struct<entity:struct<value:string>,label:struct<value:string>>>>")


def linked_entities(results: DataFrame, name: str, json: str) -> DataFrame:
    """Query-result JSON per name → (name, entity, label); the entity is what follows the last slash of its address."""
    b = results.select(name, F.explode(F.from_json(json, BINDINGS)["results"]["bindings"]).alias("b"))
    return b.select(name, F.substring_index("b.entity.value", "/", -1).alias("entity"), F.col("b.label.value").alias("label"))
