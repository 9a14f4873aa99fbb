"""Cheapest repair against exhaustive search, a shortest-path search, and a plain program over whole rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from recoflow.llm import conversation_repair as cr
from tests.conftest import SF_SMALL

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def _exhaustive(rows):
    """All edit scripts with up to two insertions in each gap."""
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    options = []
    for initial, go, cut in rows:
        o = [(4, "D", "")]
        if not go:
            more = 3 if cut else 0
            o += [(more, "K", initial), (3 + more, "R", "u"), (3 + more, "R", "a")]
        options.append(o)
    best = None
    for ins in itertools.product(gaps, repeat=len(rows) + 1):
        for edit in itertools.product(*options):
            roles = audit = ""
            cost = 0
            for g, e in itertools.zip_longest(ins, edit, fillvalue=(0, "", "")):
                roles += g + e[2]
                audit += "I" * len(g) + e[1]
                cost += 3 * len(g) + e[0]
            if GRAMMAR.match(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


# the same language as a finite automaton: 0 nothing, 1 s, 2 u, 3 ua
DFA = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def _search(rows):
    """Shortest path by (cost, audit) over (row, state); returns also the roles put out."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        if (i, q, audit[-1:] == "I") in done:
            continue
        done.add((i, q, audit[-1:] == "I"))
        for c in "ua":
            if (q, c) in DFA:
                heapq.heappush(heap, (cost + 3, audit + "I", i, DFA[q, c], (*out, (c, None))))
        if i < len(rows):
            initial, go, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, out))
            if not go:
                more = 3 if cut else 0
                for c, extra, letter in [(initial, 0, "K"), ("u", 3, "R"), ("a", 3, "R")]:
                    if (q, c) in DFA:
                        heapq.heappush(heap, (cost + more + extra, audit + letter, i + 1, DFA[q, c], (*out, (c if letter == "R" else letter, i))))


def _mine(rows):
    live, links = cr.parse(rows, cr.START)
    cost, top, letters, roles = cr.finish(live)
    return cost, "".join(e[0] for e in cr.trace(links, top)) + letters


KINDS = [(c, go, cut) for c in "suax" for go in (False, True) for cut in (False, True)]


def test_against_all_scripts():
    for n in range(3):
        for rows in itertools.product(KINDS, repeat=n):
            assert _mine(list(rows)) == _exhaustive(rows), rows
    rng = random.Random(5)
    for _ in range(12):
        rows = [rng.choice(KINDS) for _ in range(3)]
        assert _mine(rows) == _exhaustive(rows), rows


def test_automaton_accepts_the_grammar():
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            stack = cr.START
            for c in word:
                stack = stack and cr.step(stack, c)
            assert bool(stack and stack[-1] in cr.ACCEPT) == bool(GRAMMAR.match("".join(word))), word
    assert len(cr.STACKS) == 8


# ------------------------------------------------------------ whole rows
def _plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of the rows of one conversation in order."""
    seen, states, faults = set(), [], [0, 0, 0]
    for turn, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        blank, dup, cut = not body, (role, text) in seen, body[-1:] not in tuple(".!?")
        seen.add((role, text))
        for k, f in enumerate((blank, dup, cut)):
            if f:
                faults[k] += 1
                break
        states.append((role[:1], blank or dup, cut))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(states, states[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, out = _search(states)
    names = {"u": "user", "a": "assistant"}
    lines = [f"{names[c]}:" if i is None else f"{rows[i][1] if c == 'K' else names[c]}:{rows[i][2]}" for c, i in out]
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _damage(table):
    """The contract's damage in Python; rows of one turn are expected to be equal."""
    out = {}
    for conv, turn, role, text in table:
        rows = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        rows += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    return out


def _write(spark, tmp_path, table):
    path = tmp_path / "sf"
    spark.createDataFrame([(*r, 1, 2) for r in table], "conv_id long, turn long, role string, text string, block int, cost int") \
        .write.parquet(str(path / "conversations.parquet"))
    return str(path)


def _table():
    rng = random.Random(11)
    words = ["Yes.", "No", "Why?", "", " ", "Do it!", "same words here.", None, "two\nlines.", "tail.  \n", "dots... and"]
    out = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 14)):
            if rng.random() < 0.9:
                out.append((conv if conv else None, turn if rng.random() < 0.97 or turn else None,
                            rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), rng.choice(words)))
    out = [r for r in out if (r[1] is not None)] + [(5, None, "user", "first.")]
    out += [(70, 1, "user", "Twice the same row.")] * 3 + [(71, 4, "user", "w " * 30000 + ".")]
    return out + [(-i, i, "user", "Alone.") for i in range(100, 140)]  # some of these lose their only row


@pytest.mark.parametrize("block", [cr.BLOCK, 3, 1])
def test_query_against_a_plain_program(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    table = _table()
    want = {conv: _plain(rows) for conv, rows in _damage(table).items()}
    assert any(w[6] == "" for w in want.values())
    rows = cr.op13(spark, _write(spark, tmp_path, table)).collect()
    assert rows[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(rows) == len(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_whole_small_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: _plain(rows) for conv, rows in _damage(table).items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.op13(spark, SF_SMALL).collect()}
    assert got == want


def test_no_rows(spark, tmp_path):
    assert cr.op13(spark, _write(spark, tmp_path, [])).count() == 0
