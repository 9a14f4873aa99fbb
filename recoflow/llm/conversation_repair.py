"""Conversation repair by generalised LR parsing with weighted edits.

The roles of a conversation (s, u, a: initials of system, user, assistant) must
follow the grammar  S -> empty | C;  C -> T | s T;  T -> u a | T u a.  Its LR automaton
(states below) reads the rows from left to right. Before a row, turns may be inserted
(cost 3 each); the row is then kept (0), given another role (3) or deleted (4); a truncated
row that stays costs 3 more, a blank or repeated one must go. All stacks that
live after a row form a graph-structured stack: stacks with equal tops have the same
future, so of these only the one with the least (cost, audit) goes on, and a parse
is read back through the links of the survivors. The audit writes D, I, K, R for
the edits; at equal cost the least in ASCII wins.

Audits are never compared letter by letter: two audits that end with an edit of the
same row cannot be prefixes of one another, so the order of two parents decides for their
children, and only ranks (at most six) are carried from row to row.

Conversations of at most ``BLOCK`` rows are shuffled once and streamed in order through the
tasks. Longer ones are ranked (``ordering.rank_within``) and cut into blocks; a block is
parsed from every possible stack, in parallel; the blocks' (start, end, cost) entries, a few numbers a
block, are chained by minimum, and every block then applies its part. So no task
holds a conversation; only the checksum over a conversation's repaired text, which is
sequential by definition, streams one conversation's text through one task, in bounded memory.

Defined results: null roles and texts are one blank, null turns come first, a null
conversation id is an id; rows of one turn are ordered by a hash of role and text, so repeated
rows stand together; roles with other initials can only be given a role or be deleted; a conversation without rows is
repaired at no cost; equality of (role, text) in a conversation is decided by two 64-bit hashes; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recoflow.llm import common as C
from recoflow.operators.ordering import number_digits, rank_within

BLOCK = 2048  # rows of a conversation parsed by one task
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

# LR automaton. 0: start; 1: s.T; 2: u.a; 3: T (whole); 4: sT (whole); 5: ua (complete); 6: Tu.a; 7: Tua (complete)
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}  # complete T: how many symbols it covers
GOTO_T = {0: 3, 1: 4}
ACCEPT = {0, 3, 4}
START = (0,)


def step(stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
    """The stack after one more role, all reductions done; None where the grammar forbids the role."""
    to = SHIFT.get((stack[-1], symbol))
    if to is None:
        return None
    stack = (*stack, to)
    while stack[-1] in REDUCE:
        stack = stack[:-REDUCE[stack[-1]]]
        stack = (*stack, GOTO_T[stack[-1]])
    return stack


def _all_stacks() -> list[tuple[int, ...]]:
    found = [START]
    for stack in found:
        found += [t for t in dict.fromkeys(step(stack, c) for c in "sua") if t and t not in found]
    return found


STACKS = _all_stacks()


def inserted(stack: tuple[int, ...]) -> list[tuple[tuple[int, ...], str]]:
    """Every stack that insertions alone reach, each by its fewest roles."""
    found = {stack: ""}
    todo = [stack]
    for s in todo:
        for c in ROLE:
            t = step(s, c)
            if t is not None and t not in found:
                found[t] = found[s] + c
                todo.append(t)
    return list(found.items())


def _moves(stack: tuple[int, ...], initial: str, must_go: bool, cut: bool) -> list[tuple]:
    """(stack after the row, cost, letters, roles), the least (cost, letters) for each top."""
    out = [(stack, DELETE, "D", "")]
    if not must_go:
        more = TRUNCATED if cut else 0
        for s, roles in inserted(stack):
            base, pre = INSERT * len(roles) + more, "I" * len(roles)
            edits = [(initial, KEEP, "K")] + [(c, REROLE, "R") for c in ROLE]
            out += [(step(s, c), base + cost, pre + letter, roles + c) for c, cost, letter in edits if step(s, c)]
    best: dict[int, tuple] = {}
    for m in sorted(out, key=lambda m: (m[1], m[2])):
        best.setdefault(m[0][-1], m)
    return list(best.values())


MOVES = {(s, c, go, cut): _moves(s, c, go, cut) for s in STACKS for c in "sua?" for go in (False, True) for cut in (False, True)}
CLOSE = {s: [(INSERT * len(r), "I" * len(r), r) for t, r in inserted(s) if t[-1] in ACCEPT] for s in STACKS}


def parse(rows: list[tuple[str, bool, bool]], start: tuple[int, ...]) -> tuple[dict, list[dict]]:
    """(live stacks by top: (cost, rank, stack), links of every row) after rows of (initial, must go, truncated)."""
    live = {start[-1]: (0, 0, start)}
    links = []
    for initial, must_go, cut in rows:
        kind = (initial if initial in ("s", "u", "a") else "?", must_go, cut)
        best: dict[int, tuple] = {}
        for top, (cost, rank, stack) in live.items():
            for to, more, letters, roles in MOVES[(stack, *kind)]:
                new = (cost + more, rank, letters, to, top, roles)
                old = best.get(to[-1])
                if old is None or new[:3] < old[:3]:
                    best[to[-1]] = new
        order = {t: i for i, t in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
        live = {t: (b[0], order[t], b[3]) for t, b in best.items()}
        links.append({t: (b[4], b[2], b[5]) for t, b in best.items()})
    return live, links


def finish(live: dict) -> tuple[int, int, str, str]:
    """(cost, top, letters, roles) of the cheapest accepted parse."""
    cost, _, letters, top, roles = min((cost + more, rank, letters, top, roles) for top, (cost, rank, stack) in live.items()
                                       for more, letters, roles in CLOSE[stack])
    return cost, top, letters, roles


def trace(links: list[dict], top: int) -> list[tuple[str, str]]:
    """(letters, roles) of every row on the way to ``top``."""
    back = []
    for link in reversed(links):
        top, letters, roles = link[top]
        back.append((letters, roles))
    return back[::-1]


def lines(edits: list[tuple[str, str]], rows: list[tuple[str, str]], tail: str = "") -> list[str]:
    """Repaired ``role:text`` lines: edits (letters, roles) of each row of (role, text), then inserted roles."""
    out = []
    for (letters, roles), (role, text) in zip(edits, rows):
        last = letters[-1]
        new = roles if last == "D" else roles[:-1]
        out += [f"{ROLE[c]}:" for c in new]
        if last != "D":
            out.append(f"{role if last == 'K' else ROLE[roles[-1]]}:{text}")
    return out + [f"{ROLE[c]}:" for c in tail]


# ------------------------------------------------------------------ rows
def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: (conv_id, turn, role, text, copy)."""
    c = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), _damage().alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _damage() -> Column:
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(and_, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)))


OF_ROW = ["conv_id", "block", "n_blocks", "pos", "role", "text", "initial", "before", "blank", "repeated", "cut"]


def _faults(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("_h", F.xxhash64("role", "text")).withColumn("_h2", F.xxhash64("text", "role"))
            .withColumn("initial", F.substring("role", 1, 1))
            .withColumn("blank", ~F.col("text").rlike(C.WORD_SQL))
            .withColumn("cut", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that fit a block: one exchange by conversation, everything else inside it."""
    here = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_h", "_h2", "copy")
    told = Window.partitionBy("conv_id", "_h", "_h2").orderBy("pos")
    r = _faults(rows).repartition("conv_id").withColumn("pos", F.row_number().over(here).cast("bigint"))
    r = r.withColumn("before", F.lag("initial").over(Window.partitionBy("conv_id").orderBy("pos")))
    return (r.withColumn("repeated", F.row_number().over(told) > 1)
            .withColumn("block", F.lit(0).cast("bigint")).withColumn("n_blocks", F.lit(1).cast("bigint")).select(OF_ROW)
            .sortWithinPartitions("conv_id", "block", "pos"))


def _long(rows: DataFrame) -> DataFrame:
    """Longer conversations, ranked and cut into blocks; written once, so that positions stay."""
    f = _faults(rows)
    digits = number_digits(f, "turn") + [F.shiftright("_h", 48), F.col("_h"), F.col("_h2")]
    ranked = rank_within(f, ["conv_id"], [F.col("turn").asc_nulls_first(), "_h", "_h2", "copy"], digits, rank_col="pos", count_col="_n")
    path = f"{C.shared_dir(rows.sparkSession)}/conversations-{uuid.uuid4().hex}"
    (ranked.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)).withColumn("n_blocks", F.ceil(F.col("_n") / BLOCK))
     .write.parquet(path))
    k = rows.sparkSession.read.parquet(path)
    first = k.groupBy("conv_id", "_h", "_h2").agg(F.min("pos").alias("_p")).toDF("_c", "_g", "_g2", "_p")
    again = (k.select("conv_id", "block", "pos", "_h", "_h2").join(first, _same(["conv_id", "_h", "_h2"], ["_c", "_g", "_g2"]))
             .where("pos > _p").groupBy("conv_id", "block").agg(F.collect_set("pos").alias("_again")).toDF("_c", "_k", "_again"))
    last = (k.where(F.col("pos") % BLOCK == 0).select("conv_id", (F.col("block") + 1).alias("block"), F.col("initial").alias("_last"))
            .toDF("_c2", "_k2", "_last"))
    r = (k.join(again, _same(["conv_id", "block"], ["_c", "_k"]), "left").join(last, _same(["conv_id", "block"], ["_c2", "_k2"]), "left")
         .withColumn("repeated", F.coalesce(F.array_contains("_again", F.col("pos")), F.lit(False))))
    inside = F.lag("initial").over(Window.partitionBy("conv_id", "block").orderBy("pos"))
    return (r.withColumn("before", F.coalesce(inside, F.when((F.col("pos") - 1) % BLOCK == 0, F.col("_last")))).select(OF_ROW)
            .repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows of one (conversation, block) in a sorted partition; one run is held at a time."""
    key, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            k = (r["conv_id"], r["block"])
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(r)
    if held:
        yield key, held


def _batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + sum(len(v) for v in r.values() if isinstance(v, str))
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _schema(conv: str, extra: str) -> str:
    return f"conv_id {conv}, block long, {extra}"


PARSED = "n_blocks long, start int, top int, rank int, cost long, audit string, lines string, blank long, duplicate long, truncated long, illegal long"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _state(r: dict) -> tuple[str, bool, bool]:
    return r["initial"], r["blank"] or r["repeated"], r["cut"]


def _parse_blocks(ddl: str):
    """One row for a whole conversation; for a block of a longer one, a row for every start and end."""
    schema = _arrow(ddl)

    def run(batches):
        def rows():
            for (conv, block), held in _groups(batches):
                n_blocks = held[0]["n_blocks"]
                blank = sum(r["blank"] for r in held)
                repeated = sum(r["repeated"] and not r["blank"] for r in held)
                cut = sum(r["cut"] and not r["blank"] and not r["repeated"] for r in held)
                illegal = sum(r["before"] is not None and r["before"] + r["initial"] not in LEGAL for r in held)
                out = {"conv_id": conv, "block": block, "n_blocks": n_blocks, "blank": blank, "duplicate": repeated, "truncated": cut,
                       "illegal": illegal}
                states = [_state(r) for r in held]
                if n_blocks == 1:
                    live, links = parse(states, START)
                    cost, top, letters, roles = finish(live)
                    edits = trace(links, top)
                    yield {**out, "start": 0, "top": -1, "rank": 0, "cost": cost, "audit": "".join(e[0] for e in edits) + letters,
                           "lines": "\n".join(lines(edits, [(r["role"], r["text"]) for r in held], roles))}
                    continue
                for i, start in enumerate(STACKS):
                    live, _ = parse(states, start)
                    for top, (cost, rank, stack) in live.items():
                        yield {**out, "start": i, "top": STACKS.index(stack), "rank": rank, "cost": cost, "audit": None, "lines": None}
        yield from _batched(rows(), schema)
    return run


def _chain(ddl: str):
    """Of a long conversation's blocks in order: the stack each starts from and ends at, and the total cost.

    At equal cost the earlier audit of the parents decides, as inside a block; ways of one block
    from one start are in the order of their ranks there.
    """
    schema = _arrow(ddl)

    def run(batches):
        def rows():
            conv, live, back = None, None, []

            def close():
                if live is None:
                    return
                cost, top, _, _ = finish({STACKS[t][-1]: (c, rank, STACKS[t]) for t, (c, rank) in live.items()})
                at = next(t for t in live if STACKS[t][-1] == top)
                for block in range(len(back) - 1, -1, -1):
                    start = back[block][at]
                    yield {"conv_id": conv, "block": block, "start": start, "top": at, "total": cost}
                    at = start
            for (c, block), held in _groups(batches):
                if block == 0:
                    yield from close()
                    conv, live, back = c, {0: (0, 0)}, []
                best: dict[int, tuple] = {}
                for r in held:
                    if r["start"] not in live:
                        continue
                    cost, rank = live[r["start"]]
                    # stacks with equal tops have the same future
                    top = STACKS[r["top"]][-1]
                    new = (cost + r["cost"], rank, r["start"], r["top"], r["rank"])
                    if top not in best or new[:2] < best[top][:2]:
                        best[top] = new
                order = {t: i for i, t in enumerate(sorted(best, key=lambda t: (best[t][1], best[t][4])))}
                live = {b[3]: (b[0], order[t]) for t, b in best.items()}
                back.append({b[3]: b[2] for b in best.values()})
            yield from close()
        yield from _batched(rows(), schema)
    return run


def _apply(ddl: str):
    """A block of a long conversation along its chosen way."""
    schema = _arrow(ddl)

    def run(batches):
        def rows():
            for (conv, block), held in _groups(batches):
                one = held[0]
                live, links = parse([_state(r) for r in held], STACKS[one["start"]])
                top = STACKS[one["top"]][-1]
                edits, letters, roles = trace(links, top), "", ""
                if block == one["n_blocks"] - 1:
                    _, _, letters, roles = finish({top: live[top]})
                text = "\n".join(lines(edits, [(r["role"], r["text"]) for r in held], roles))
                yield {"conv_id": conv, "block": block, "cost": one["total"], "audit": "".join(e[0] for e in edits) + letters,
                       "lines": text, "some": bool(roles) or any(e[0] != "D" for e in edits)}
        yield from _batched(rows(), schema)
    return run


def _digest(ddl: str):
    """Blocks of a conversation in order -> one row, the text hashed as it passes by."""
    schema = _arrow(ddl)

    def run(batches):
        def rows():
            conv, out, sha, some, audit = None, None, None, False, []
            for (c, block), held in _groups(batches):
                if block == 0:
                    if out is not None:
                        yield {**out, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                    out, sha, some, audit = {"conv_id": c, "block": 0, "cost": held[0]["cost"]}, hashlib.sha256(), False, []
                audit.append(held[0]["audit"])
                if held[0]["some"]:
                    sha.update((("\n" if some else "") + held[0]["lines"]).encode())
                    some = True
            if out is not None:
                yield {**out, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
        yield from _batched(rows(), schema)
    return run


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
RESULT = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions("conv_id", "block")


def repair_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(short conversations, blocks of long ones) with cost, audit and repaired lines.

    rows: (conv_id, turn, role, text, copy). Long conversations are those of more than ``BLOCK`` rows; None where there are none.
    """
    conv = dict(rows.dtypes)["conv_id"]
    ddl = _schema(conv, PARSED)
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    big = C.checkpointed(sizes.select(F.col("conv_id").alias("_big")))  # at most 1/BLOCK of the rows
    if big.isEmpty():
        return _short(rows).mapInArrow(_parse_blocks(ddl), ddl), None
    same = F.col("conv_id").eqNullSafe(F.col("_big"))
    short = _short(rows.join(big, same, "left_anti")).mapInArrow(_parse_blocks(ddl), ddl)
    blocks = _long(rows.join(big, same, "left_semi"))
    entries = C.checkpointed(blocks.mapInArrow(_parse_blocks(ddl), ddl))
    chain_ddl = _schema(conv, "start int, top int, total long")
    chosen = _in_order(entries.select("conv_id", "block", "start", "top", "rank", "cost"), "conv_id").mapInArrow(_chain(chain_ddl), chain_ddl)
    counts = (entries.where("start = 0").groupBy("conv_id", "block").agg(*(F.first(c).alias(c) for c in COUNTS))
              .toDF("_c2", "_k2", *COUNTS))
    chosen = chosen.toDF("_c", "_k", "start", "top", "total")
    put = (blocks.join(chosen, _same(["conv_id", "block"], ["_c", "_k"]))
           .select(*OF_ROW, "start", "top", "total").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos"))
    done_ddl = _schema(conv, "cost long, audit string, lines string, some boolean")
    done = put.mapInArrow(_apply(done_ddl), done_ddl)
    return short, done.join(counts, _same(["conv_id", "block"], ["_c2", "_k2"])).drop("_c2", "_k2")


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation: faults, cost, audit and the sha256 of the repaired conversation."""
    conv = dict(rows.dtypes)["conv_id"]
    short, blocks = repair_blocks(rows)
    out = short.withColumn("repaired_sha256", F.sha2(F.col("lines").cast("binary"), 256)).select(RESULT)
    if blocks is None:
        return out
    ddl = _schema(conv, "cost long, audit string, repaired_sha256 string")
    joined = _in_order(blocks.select("conv_id", "block", "cost", "audit", "lines", "some"), "conv_id").mapInArrow(_digest(ddl), ddl)
    counts = blocks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in COUNTS)).withColumnRenamed("conv_id", "_c")
    return out.unionByName(joined.join(counts, _same(["conv_id"], ["_c"])).select(RESULT))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged as the contract says, with its faults and its cheapest repair."""
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    kept = F.when(_damage() != 0, F.col("turn"))
    gaps = F.max(kept) - F.min(kept) + 1 - F.countDistinct(kept)
    every = table.groupBy(F.col("conv_id").alias("_id")).agg(F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"))
    done = repair(damaged(table))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (every.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("_id").cast("bigint").alias("conv_id"), "gaps", *(zero(c) for c in [*COUNTS, "cost"]),
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
