"""Cross-tokenizer alignment: byte-exact groups and links between two vocabularies' tokens.

A text's tokens under A (byte-level BPE of space + text) and under B (sentence pieces,
which adds the space itself) tile the same bytes. Where an A token and a B token end at the same
byte, a group ends; between neighbouring ends of either kind lies the overlap of exactly one A
token and one B token, so every end is one link.

Inside a task all steps are Arrow's, over chunks of about ``CHUNK_BYTES`` of text: the lists of
tokens are flattened with their parent indices, token lengths are summed up within each
document, a full outer hash join (Acero) on the document-end key marks shared ends, back-filled
ids name the two tokens of each link, and ``Table.group_by`` counts the links of a document's id
pairs. A block (some ``BLOCK_BYTES`` of text) keeps its distinct pairs once; its documents refer to
them by number. Blocks are written to the shared folder; Spark sums the blocks' partial counts into the corpus-wide
number of documents a pair, finds the highest of each A id, sends each block the counts it asked
for, and every block adds its documents up. No table of pairs is broadcast or collected.

Tokenising. Both vocabularies cut independently before a blank or a line feed that stands between
two visible characters (A's pre-tokeniser ends there; no B piece holds a blank or line feed after
its first character), so each distinct stretch between such places is encoded once a worker
and kept, up to a bound in bytes. Tests compare with plain encoding of whole texts.

Defined results: a null or empty text, and one whose joined token bytes under A or B differ from
space + text, has no tokens: zeros and an empty string; null ids, repeated rows and extra columns
are rows and columns like any other; ids below 65,536 are required of both vocabularies; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recoflow.llm import common as C
from recoflow.llm.tokens import byte_letters, vocabulary_path

A_VOCABULARY, A_RANKS, B_VOCABULARY = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
KEPT_BYTES = 128 << 20  # of stretches and their tokens kept by a worker; beyond, the store is emptied
ID_SPAN = 1 << 16

# first bytes of characters that may be white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000..., U+3000)
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:] = True
_VISIBLE[0x7F] = False


def stretch_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the texts of a chunk (each begins with its added blank) may be cut: row starts, and safe blanks and line feeds."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    mid = np.zeros(n, bool)
    if n > 2:
        sep = (data[1:-1] == 32) | (data[1:-1] == 10)
        after = _VISIBLE[data[2:]] & ~_WIDE[data[2:]]
        before = _VISIBLE[data[:-2]]
        mid[1:-1] = sep & before & after
        at = np.flatnonzero(mid)
        # the character before may be wide white space of two or three bytes
        at = at[~((at >= 2) & (data[at - 2] == 0xC2)) & ~((at >= 3) & _WIDE[data[at - 3]])]
        # neither neighbour may belong to another row
        at = at[~first[at] & ~first[at + 1]]
        first[at] = True
    return np.flatnonzero(first[:n])


class Vocabularies:
    """Tokens of stretches under both vocabularies; each distinct stretch is encoded once and kept as one string of bytes.

    A stretch of Latin letters goes through A's merge ranks as ``tiktoken`` reads them (the same vocabulary; three
    times faster on short texts), any other through ``tokenizers``.
    """

    HEAD = 3  # 16-bit words before a stretch's ids: number of A ids (low, high), does each vocabulary tile the bytes

    def __init__(self, a_path: str, b_path: str, ranks_path: str):
        import base64
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}
        self.ranks = tiktoken.Encoding("ranks of A", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        code = {c: b for b, c in enumerate(byte_letters())}
        size_a = self.a.get_vocab_size(with_added_tokens=True)
        if size_a > ID_SPAN or self.b.vocab_size() > ID_SPAN:
            raise ValueError("ids of a vocabulary need more than 16 bits")
        entries = (self.a.id_to_token(i) or "" for i in range(size_a))
        a_bytes = [bytes(code[c] for c in t) if all(c in code for c in t) else t.encode() for t in entries]
        if any(a_bytes[i] != t for t, i in ranks.items()):
            raise ValueError("the merge ranks are not those of the vocabulary")
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.blank = self.b.piece_to_id("▁")
        self.sizes = [np.array([len(t) for t in table], np.int64) for table in (a_bytes, self.b_bytes)]
        self.words = _id_words()
        self.known: dict[bytes, bytes] = {}
        self.kept = 0

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _learn(self, new: list[bytes]) -> None:
        texts = [s.decode() for s in new]
        latin = self.ranks.encode_ordinary
        whole = lambda t: self.a.encode(t, add_special_tokens=False).ids
        # B adds a blank of its own: a stretch's blank is left to it, before a line feed the added one is taken off
        in_b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        get_b, known, kept = self.b_bytes.__getitem__, self.known, self.kept
        for s, t, b in zip(new, texts, in_b):
            a = latin(t) if s.isascii() or max(t) < "\u0250" else whole(t)  # bytes of A's ids always are the text's
            if s[0] != 32:
                b = b[1:] if b and b[0] == self.blank else [0]
            n = len(a)
            v = known[s] = array("H", [n & 0xFFFF, n >> 16, b"".join(map(get_b, b)) == s, *a, *b]).tobytes()
            kept += len(s) + len(v) + 200  # 200: Python's own bytes of an entry
        self.kept = kept

    def tokens(self, stretches: pa.Array) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
        """(A ids, B ids, does each tile its bytes) of every stretch."""
        coded = stretches.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.kept > KEPT_BYTES:
            self.known.clear()
            self.kept = 0
        known = self.known
        new = [s for s in distinct if s not in known]
        if new:
            self._learn(new)
        held = [known[s] for s in distinct]
        flat = np.frombuffer(b"".join(held), np.uint16)
        size = np.fromiter(map(len, held), np.int64, len(held)) // 2
        begin = np.cumsum(size) - size
        n_a = flat[begin].astype(np.int64) + (flat[begin + 1].astype(np.int64) << 16) if len(held) else np.zeros(0, np.int64)
        n_b = size - n_a - self.HEAD
        place = np.arange(len(flat)) - np.repeat(begin, size)
        to_a = np.repeat(n_a + self.HEAD, size)
        lists = []
        for part, n in ((flat[(place >= self.HEAD) & (place < to_a)], n_a), (flat[place >= to_a], n_b)):
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=offsets[1:])
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(part)).take(coded.indices))
        good = flat[begin + 2] > 0 if len(held) else np.zeros(0, bool)
        return lists[0], lists[1], good[np.asarray(coded.indices)]


def _id_words() -> pa.Array:
    """Texts of an id followed by ',' , '|' (end of a group's A ids) or ';' (end of a group)."""
    ids = pc.cast(pa.array(np.arange(ID_SPAN)), pa.string())
    return pa.concat_arrays([pc.binary_join_element_wise(ids, pa.scalar(mark), "") for mark in (",", "|", ";")])


_LOADED: dict[tuple[str, ...], Vocabularies] = {}


def vocabularies(*paths: str) -> Vocabularies:
    if paths not in _LOADED:
        _LOADED[paths] = Vocabularies(*paths)
    return _LOADED[paths]


def ends(lists: pa.ListArray, doc_of_stretch: pa.Array, sizes: np.ndarray, side: str) -> pa.Table:
    """(document-end key, id, place) of every token: flattened lists and sums of lengths within each document."""
    ids = lists.flatten()
    doc = doc_of_stretch.take(pc.list_parent_indices(lists))
    width = pa.array(sizes).take(ids)
    total = pc.cumulative_sum(width)
    # segmented: less the running sum before the document's first token
    n = len(ids)
    if n:
        d = np.asarray(doc)
        head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        base = pc.subtract(total.take(pa.array(head)), width.take(pa.array(head)))
        total = pc.subtract(total, pa.array(np.repeat(np.asarray(base), np.diff(np.append(head, n)))))
    key = pc.add(pc.shift_left(pc.cast(doc, pa.int64()), pa.scalar(32, pa.int64())), total)
    return pa.table({"key": key, side: ids})


def align(a: pa.Table, b: pa.Table) -> pa.Table:
    """Links in byte order: (doc, a, b, a_ends, b_ends); a group ends where both end."""
    met = a.append_column("a_ends", pa.repeat(True, a.num_rows)).join(
        b.append_column("b_ends", pa.repeat(True, b.num_rows)), "key", join_type="full outer", use_threads=False)
    met = met.take(pc.sort_indices(met["key"]))
    back = lambda name: pc.fill_null_backward(met[name])  # noqa: E731 - the token that covers the stretch before this end
    flag = lambda name: pc.fill_null(met[name], False)
    return pa.table({"doc": pc.shift_right(met["key"], pa.scalar(32, pa.int64())), "a": back("a"), "b": back("b"),
                     "a_ends": flag("a_ends"), "b_ends": flag("b_ends")})


def group_texts(links: pa.Table, words: pa.Array, n_docs: int) -> list[memoryview]:
    """``a1,a2|b1;a3|b2,b3`` of every document: each token's id with the mark that follows it, put in place by running sums."""
    a_end, b_end = np.asarray(links["a_ends"]), np.asarray(links["b_ends"])
    both = a_end & b_end
    ia, ib = np.flatnonzero(a_end), np.flatnonzero(b_end)
    group = np.cumsum(both) - both
    # tokens of the other kind that stand before: B of earlier groups, A of this group and earlier ones
    n_groups = int(both.sum())
    a_per, b_per = np.bincount(group[ia], minlength=n_groups), np.bincount(group[ib], minlength=n_groups)
    b_before, a_upto = np.cumsum(b_per) - b_per, np.cumsum(a_per)
    place_a = np.arange(len(ia)) + b_before[group[ia]]
    place_b = np.arange(len(ib)) + a_upto[group[ib]]
    code = np.empty(len(ia) + len(ib), np.int64)
    last_a = np.zeros(len(ia), bool)
    last_a[a_upto[a_per > 0] - 1] = True
    code[place_a] = np.asarray(links["a"])[ia].astype(np.int64) + ID_SPAN * last_a
    code[place_b] = np.asarray(links["b"])[ib].astype(np.int64) + 2 * ID_SPAN * both[ib]
    text = words.take(pa.array(code))
    raw, offs = C.utf8_of(text)
    doc = np.asarray(links["doc"])
    per = np.bincount(doc[ia], minlength=n_docs) + np.bincount(doc[ib], minlength=n_docs)
    at = offs[np.concatenate([[0], np.cumsum(per)])]
    view = memoryview(np.ascontiguousarray(raw))
    return [view[at[i]:at[i + 1] - 1] if per[i] else view[:0] for i in range(n_docs)]


def _spaced(arr: pa.Array) -> pa.Array:
    """Every text behind one blank; null and empty texts stay empty."""
    text = pc.fill_null(arr, "")
    empty = pc.equal(pc.binary_length(text), 0)
    return pc.if_else(empty, "", pc.binary_join_element_wise(" ", text, ""))


def _chunk(v: Vocabularies, data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], pa.Table]:
    """(numbers per document, links per document and id pair) of a chunk of spaced texts."""
    n = len(offs) - 1
    starts = stretch_starts(data, offs)
    bounds = np.append(starts, len(data)).astype(np.int32)
    stretches = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    doc = np.searchsorted(offs, starts, side="right") - 1
    in_a, in_b, good = v.tokens(stretches)
    bad = np.unique(doc[~good])
    if len(bad):
        keep = pa.array(~np.isin(doc, bad))
        in_a, in_b, doc = in_a.filter(keep), in_b.filter(keep), doc[np.asarray(keep)]
    doc = pa.array(doc)
    a, b = ends(in_a, doc, v.sizes[0], "a"), ends(in_b, doc, v.sizes[1], "b")
    links = align(a, b).combine_chunks()
    of = np.asarray(links["doc"])
    a_end, b_end = np.asarray(links["a_ends"]), np.asarray(links["b_ends"])
    count = lambda at: np.bincount(of[at], minlength=n)
    texts = group_texts(links, v.words, n)
    numbers = {"n_a": count(a_end), "n_b": count(b_end), "n_groups": count(a_end & b_end), "n_links": np.bincount(of, minlength=n),
               "sha": [hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts]}
    pair = pc.add(pc.multiply(pc.cast(links["a"], pa.int64()), ID_SPAN), pc.cast(links["b"], pa.int64()))
    pairs = pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    return numbers, pairs


DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, sha string, at binary, times binary"
ROW = f"block string, kind int, {DOC}, pairs binary, held binary"
_ROW = ("block", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "at", "times", "pairs", "held")


def _close(name: str, docs: list[dict], tables: list[pa.Table]) -> pa.RecordBatch:
    """A block's rows: its documents (kind 1), and its distinct pairs with the number of its documents that hold each (kind 0)."""
    base, shifted = 0, []
    for n, t in tables:
        shifted.append(t.set_column(t.schema.get_field_index("doc"), "doc", pc.add(t["doc"], base)))
        base += n
    all_ = pa.concat_tables(shifted).combine_chunks()
    held = all_.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    pairs = np.asarray(held["pair"]).astype(np.uint32)
    order = pc.sort_indices(all_, sort_keys=[("doc", "ascending"), ("pair", "ascending")])
    all_ = all_.take(order)
    small = np.uint16 if len(pairs) <= ID_SPAN else np.uint32
    at = np.searchsorted(pairs, np.asarray(all_["pair"]).astype(np.uint32)).astype(small)
    times = np.asarray(all_["count_all"])
    cut = np.searchsorted(np.asarray(all_["doc"]), np.arange(base + 1))
    cols: dict[str, list] = {c: [] for c in _ROW}
    for i, d in enumerate(docs):
        s = slice(cut[i], cut[i + 1])
        t = times[s]
        width = np.uint8 if not len(t) or t.max() < 256 else np.uint32
        row = {**d, "block": name, "kind": 1, "at": at[s].tobytes(), "times": t.astype(width).tobytes()}
        for c in _ROW:
            cols[c].append(row.get(c))
    last = {"block": name, "kind": 0, "pairs": pairs.astype("<u4").tobytes(), "held": np.asarray(held["count_all"]).astype("<u4").tobytes()}
    for c in _ROW:
        cols[c].append(last.get(c))
    types = {"kind": pa.int32(), **{c: pa.string() for c in ("block", "sha")}, **{c: pa.binary() for c in ("at", "times", "pairs", "held")}}
    return pa.record_batch([pa.array(cols[c], types.get(c, pa.int64())) for c in _ROW], names=list(_ROW))


def _blocks(paths: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, serial = TaskContext.get().partitionId(), 0
        v = vocabularies(*paths)
        docs, tables, size = [], [], 0
        for batch in batches:
            ids = batch.column(0)
            spaced = _spaced(batch.column(1))
            for i, j, data, offs in C.chunks(spaced, CHUNK_BYTES):
                numbers, pairs = _chunk(v, data, offs)
                for k, doc_id in enumerate(ids[i:j].to_pylist()):
                    docs.append({"doc_id": doc_id, "sha": numbers["sha"][k], **{c: int(numbers[c][k]) for c in ("n_a", "n_b", "n_groups", "n_links")}})
                tables.append((j - i, pairs))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield _close(f"{part}-{serial}", docs, tables)
                    docs, tables, size, serial = [], [], 0, serial + 1
        if docs:
            yield _close(f"{part}-{serial}", docs, tables)
    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's distinct pairs as rows: (block, place, pair, documents of the block that hold it)."""
    for batch in batches:
        for name, pairs, held in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "held"))):
            p, h = np.frombuffer(pairs, "<u4"), np.frombuffer(held, "<u4")
            for i in range(0, len(p), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.record_batch([pa.repeat(name, len(p[s])), pa.array(np.arange(i, i + len(p[s]))), pa.array(p[s].astype(np.int64)),
                                       pa.array(h[s].astype(np.int64))], names=["block", "place", "pair", "held"])


RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _sum_up(docs: pa.Table, told: pa.Table) -> pa.Table:
    """A block's documents with the corpus-wide counts of its pairs added up."""
    told = told.combine_chunks()
    n = np.zeros(told.num_rows, np.int64)
    best = np.zeros(told.num_rows, np.int64)
    place = np.asarray(told["place"])
    n[place], best[place] = np.asarray(told["n"]), np.asarray(told["best"])
    small = np.uint16 if told.num_rows <= ID_SPAN else np.uint32
    n_best, count_sum = [], []
    for at, times in zip(docs["at"].to_pylist(), docs["times"].to_pylist()):
        i = np.frombuffer(at, small)
        t = np.frombuffer(times, np.uint8 if len(times) == len(i) else np.uint32).astype(np.int64)
        n_best.append(int(t @ best[i]))
        count_sum.append(int(t @ n[i]))
    return pa.table([*(docs[c] for c in RESULT[:5]), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs["sha"]], names=list(RESULT))


def aligned(docs: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """Blocks of aligned documents, written once: document rows (kind 1) and the blocks' distinct pairs (kind 0).

    ``docs``: (doc_id, text). ``at``: places of a document's pairs among its block's, ``times``: links of each.
    """
    path = f"{C.shared_dir(docs.sparkSession)}/aligned-{uuid.uuid4().hex}"
    docs.mapInArrow(_blocks(paths), ROW).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold the pair, and whether no other pair of its A id has more."""
    n = asked.groupBy("pair").agg(F.sum("held").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 16))  # at most one row for each B id
    return n.withColumn("best", (F.col("n") == F.max("n").over(of_a)).cast("int"))


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Per document the numbers of its alignment and sums over corpus-wide pair counts; ``ranks_path``: A's merge ranks."""
    rows = aligned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                   (a_path or vocabulary_path(A_VOCABULARY), b_path or vocabulary_path(B_VOCABULARY), ranks_path or vocabulary_path(A_RANKS)))
    asked = rows.where("kind = 0").select("block", "pairs", "held").mapInArrow(_asked, "block string, place long, pair long, held long")
    told = asked.join(pair_counts(asked), "pair").select("block", "place", "n", "best")
    ddl = ", ".join(f"{c} string" if c == "groups_sha256" else f"{c} long" for c in RESULT)
    of_block = rows.where("kind = 1").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "at", "times")
    return of_block.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_sum_up, ddl)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment between the two public vocabularies."""
    return align_documents(C.documents(spark, sf_dir).select("doc_id", "text"))
