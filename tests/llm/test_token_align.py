"""Alignment of two vocabularies against whole-text encoding and a plain two-pointer walk."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recoflow.llm import common as C
from recoflow.llm import token_align as ta
from recoflow.llm.tokens import byte_letters, vocabulary_path
from tests.conftest import SF_SMALL


def PATHS():
    return [vocabulary_path(n) for n in (ta.A_VOCABULARY, ta.B_VOCABULARY, ta.A_RANKS)]


@pytest.fixture(scope="module")
def plain():
    """text -> ((A id, start, end)..., (B id, start, end)...) by whole-text encoding; None without tokens."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(vocabulary_path(ta.A_VOCABULARY))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(ta.B_VOCABULARY))
    code = {c: i for i, c in enumerate(byte_letters())}

    def spans(ids, pieces):
        at, out = 0, []
        for i, p in zip(ids, pieces):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    def run(text):
        if not text:
            return None
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        pieces_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(text)
        pieces_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + text).encode()
        if b"".join(pieces_a) != want or b"".join(pieces_b) != want:
            return None
        return spans(ids_a, pieces_a), spans(ids_b, pieces_b)
    return run


def _links(a, b):
    """All pairs of tokens whose byte ranges overlap."""
    out, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


def _groups(a, b):
    shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
    at, out = 0, []
    for end in shared:
        out.append(",".join(str(i) for i, s, e in a if at <= s and e <= end) + "|" + ",".join(str(i) for i, s, e in b if at <= s and e <= end))
        at = end
    return out


def _want(rows, plain):
    tokens = [(i, plain(t)) for i, t in rows]
    links = [_links(*t) if t else [] for _, t in tokens]
    held = Counter(p for ls in links for p in set(ls))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (i, t), ls in zip(tokens, links):
        groups = _groups(*t) if t else []
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if t else ""
        out.append((i, len(t[0]) if t else 0, len(t[1]) if t else 0, len(groups), len(ls), sum(held[p] == top[p[0]] for p in ls),
                    sum(held[p] for p in ls), sha))
    return sorted(out, key=repr)


ODD = [None, "", " ", "  two  blanks ", "a\nb", "a\n\nb\n", "\n", "tab\there", "café Été naïve", "a ▁ piece mark",
       "nbsp  here  x", "wide　space 　 y", "thin  space  x", "\x85", "a \x85b", "it's we'll I'd 's",
       "<|endoftext|> is text", "</s> <s> <unk> <0x0A> text", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467", "你好 世界",
       "x" * 3000, "ab " * 2000, "́ accent", "é ́e", "1234567 89,000.12", "end.\nNew line. \nBlank before", "\x00 nul \x1f x",
       "« quote » “x”", "a\r\nb\r c", "﻿bom", "  ", "a ", " a", "\ta\n b", "a  b", "a  b  c", "࿿ x"]


def _texts():
    rng = random.Random(3)
    parts = [t for t in ODD if t] + list("abcXYZ.,!?'\"()-_ \n\t\r  　\x85éßÿ▁你") + ["the", "ing", " of", "\n\n", "  "]
    return ODD + ["".join(rng.choice(parts[-30:] if rng.random() < 0.8 else parts)[:40] for _ in range(rng.randrange(1, 30))) for _ in range(400)]


def test_stretches_encode_like_whole_texts(plain):
    texts = [t for t in _texts() if t]
    v = ta.vocabularies(*PATHS())
    spaced = pa.array([" " + t for t in texts])
    data, offs = C.utf8_of(spaced)
    starts = ta.stretch_starts(data, offs)
    assert set(offs[:-1]) <= set(starts)
    bounds = np.append(starts, len(data))
    stretches = pa.array([data[bounds[i]:bounds[i + 1]].tobytes() for i in range(len(starts))], pa.binary())
    in_a, in_b, good = v.tokens(stretches)
    row = np.searchsorted(offs, starts, side="right") - 1
    for r, t in enumerate(texts):
        mine = np.flatnonzero(row == r)
        want = plain(t)
        assert all(good[mine]) == (want is not None), repr(t)
        if want:
            assert [x for i in mine for x in in_a[i].as_py()] == [x[0] for x in want[0]], repr(t)
            assert [x for i in mine for x in in_b[i].as_py()] == [x[0] for x in want[1]], repr(t)


def _got(df):
    return sorted((tuple(r) for r in df.select(*ta.RESULT).collect()), key=repr)


def test_against_plain_walk(spark, plain, monkeypatch):
    monkeypatch.setattr(ta, "CHUNK_BYTES", 2000)
    rows = list(enumerate(_texts())) + [(None, "the same text")] * 3 + [(2, "the same text"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, pair string").repartition(3)
    assert _got(ta.align_documents(df)) == _want(rows, plain)


def test_whole_small_table(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in C.documents(spark, SF_SMALL).collect()]
    assert _got(ta.op11(spark, SF_SMALL)) == _want(rows, plain)


def test_store_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(ta, "KEPT_BYTES", 1000)
    v = ta.Vocabularies(*PATHS())
    for k in range(5):
        stretches = pa.array([f" word{k}{i}".encode() for i in range(20)], pa.binary())
        in_a, _, good = v.tokens(stretches)
        assert all(good) and len(v.known) <= 40 and len(in_a) == 20


def test_no_rows(spark):
    assert ta.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
