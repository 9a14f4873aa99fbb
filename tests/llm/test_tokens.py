"""Ids against plain encode, round trip of the files, packing as a partition of all ids."""

import random
import zlib

import numpy as np
import pytest

from recoflow.llm import packing as P
from recoflow.llm import token_arrow as A
from recoflow.llm import tokens as T
from recoflow.llm.common import documents
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(T.vocabulary_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "it's 'S I'LL don't", "<|endoftext|> <|ENDOFTEXT|>x<|startoftext|>", "J̌ İ İ KK", "Ünïcode ÀÉß naïve×÷", "a b c\x1cd\x85e",
       "日本語 テキスト 12 34٣", "éé x́", "​zero﻿", "😀😀 ok!!", "A" * 3000, "ΣΑΣ ς", "don`t#*$", "\x00\x01 \x7f", "ÇA ça Ça,", "'re''ve're"]


def texts(spark):
    rng = random.Random(2)
    alphabet = "aAbÉéß 1'.,!?<|>́ \n\t日sSreRE"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    return ODD + made + [r.text for r in documents(spark, SF_SMALL).select("text").collect()]


def test_encoder_equals_the_library(spark, plain, monkeypatch):
    every = texts(spark)
    for cached in (T.CACHED, 50):  # also with a cache that is emptied again and again
        monkeypatch.setattr(T, "CACHED", cached)
        enc = T.Encoder(T.vocabulary_path())
        for i in range(0, len(every), 37):
            part = every[i:i + 37]
            got = [np.frombuffer(b, "<u2").tolist() for b in enc.encode([t.encode() for t in part])]
            assert got == [plain(t) for t in part]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_frame(spark):
    rows = [(5, "b a"), (5, "b a"), (3, None), (None, "null id"), (2**40, ""), (7, "long " * 9000), *((100 + i, t) for i, t in enumerate(ODD))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS ids", "2 AS tie")


def test_files_round_trip(spark, plain, tmp_path):
    rows, df = odd_frame(spark)
    manifest = A.write_token_files(df, f"file:{tmp_path}/out", length=64)
    got = A.read_token_files(manifest).collect()
    got.sort(key=lambda r: r.start)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(plain(t or "") + [2])
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in {(len(x), crc(x)) for x in ids[r.doc_id]}
        at += r.n_tokens
    flat = []
    for m in manifest.orderBy("shard").collect():
        f = A.TokenFile(m.path)
        for k in range(-(-m.n_tokens // 64)):
            keep = f.mask(k).to_numpy(zero_copy_only=False)
            assert len(f.sequence(k)) == 64 and not f.sequence(k)[~keep].any()
            flat += f.sequence(k)[keep].tolist()
    assert len(flat) == at
    assert A.read_token_files(A.write_token_files(df.limit(0), f"file:{tmp_path}/none")).count() == 0


def test_differencing():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randrange(1, 500) for _ in range(rng.randrange(1, 150))]
        k = rng.randrange(1, 9)
        slots = P.differencing(sizes, k)
        assert sorted(i for s in slots for i in s) == list(range(len(sizes))) and len(slots) == k
        sums = [sum(sizes[i] for i in s) for s in slots]
        assert max(sums) - min(sums) <= max(sizes)
        assert all(sum(sizes[i] for i in s) <= 600 for s in P.windows_of(sizes, 600))
    assert P.windows_of([], 10) == []


def check_packed(rows, got, plain, capacity=2048):
    want = sorted(((i, crc(x), len(x)) for i, x in ((i, plain(t or "") + [1]) for i, t in rows)), key=repr)
    pieces, sequences = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    if got and got[0].ids is not None:
        for r in got:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            pieces.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(bytes(r.ids))
        whole = []
        for (i, n), p in pieces.items():
            copies = len(p[0])
            for c in range(copies):
                whole.append((i, zlib.crc32(b"".join(p[s][min(c, len(p[s]) - 1)] for s in sorted(p))), n))
        assert sorted(whole, key=repr) == want
    return sequences


def test_packing(spark, plain):
    rows, df = odd_frame(spark)
    got = P.pack(df).collect()
    check_packed(rows, got, plain)
    assert P.pack(df.limit(0)).count() == 0
    docs = documents(spark, SF_SMALL.replace("0.001", "0.1"))
    packed = P.pack(docs, with_ids=False).collect()
    seq = check_packed([], [r for r in packed], plain)
    used = sum(r.length for r in packed)
    assert used / (2048 * len(seq)) > 0.97
