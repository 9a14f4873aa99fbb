"""PII by a semi-Markov conditional random field over whole spans.

Base spans come from the four patterns, found in linear time. Around numbers and
addresses that the patterns leave, a window of tokens is segmented: every run
of at most ``LONGEST`` tokens that could be an entity is scored as a whole
(digit counts, check digit, separators, groups, edges, words before it) for each
type, other tokens score nothing, and bounded-entity dynamic programming picks
boundaries and types together. Base spans are fixed segments of it: a number or address
that touches one is cut there and the rest is searched, however long it is.

The field is fitted by exact forward-backward gradients on windows around base spans of
at most ``bound`` documents (those with the least id hashes), on spans as they stand
and on the same spans rewritten the ways people write them (no plus sign, other
separators, "at" and "dot"), with numbers that fail their check, dates and plain
counts as negatives. Offsets are code points.

Defined cases: null and empty texts have no spans; without base spans to learn
from nothing is added; rows that repeat a ``doc_id`` are searched one by
one; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm import common as C

KINDS = ("email", "ip", "card", "phone")
LONGEST = 28  # tokens of an entity at most
MARGIN = 32   # characters of context on either side
STEP = 512    # tokens whose candidates are held at once
FIT_DOCS = 8000
FIT_WINDOWS = 600
OUT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
       "found array<struct<kind:string,start:long,end:long,base:boolean>>")

_DIGITS = re.compile(r"[0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    groups = [m.span() for m in _DIGITS.finditer(text)]
    if not groups:
        return out
    i = 0
    while i + 3 < len(groups):
        four = groups[i:i + 4]
        if all(b[0] - a[1] == 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(len(text[s:e].lstrip("0")) < 4 and int(text[s:e].lstrip("0") or 0) <= 255 for s, e in four):
                out.append((1, four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    for m in _CARD.finditer(text, groups[0][0]):
        if m.end() - m.start() >= 13:
            digits = _only_digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return out


# ---- windows, tokens and candidate segments

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-]{0,3}[0-9]){6,}")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63})+")
_HINTS = {"mail": 0, "contact": 0, "host": 1, "server": 1, "addr": 1, "ip": 1, "card": 2, "visa": 2, "pay": 2, "tel": 3, "phone": 3, "call": 3, "fax": 3}


def suspects(text: str, first: int = 0) -> list[tuple[int, int]]:
    """Places where an entity may be: long numbers, and addresses with at and dot signs."""
    out = [m.span() for m in _NUMBER.finditer(text, max(0, first - 2))]
    if "@" in text or "at)" in text or "at]" in text or " dot " in text:
        out += [m.span() for m in _SPELLED.finditer(text)]
    return sorted(out)


@dataclass
class Window:
    start: int
    bounds: list[int]  # token boundaries, as offsets in the text
    segments: list[tuple[int, int, tuple[int, ...]]] = field(default_factory=list)  # (first token, end token, features)


_NAMES: dict[str, int] = {}
for _n in ("bias", "d7", "d9", "d13", "d16", "d20", "luhn", "noluhn", "plus", "paren", "at", "spelt", "quad", "badquad", "sep0", "sep ", "sep-", "sep.", "sepmix",
           "g1", "g2", "g3", "g4", "g5", "letters", "left", "right", "long", "labels", "date", "mobile", "four",
           "hint0", "hint1", "hint2", "hint3"):
    _NAMES[_n] = len(_NAMES)


def span_features(text: str, s: int, e: int) -> tuple[int, ...] | None:
    """Features of the whole span, or None where it can't be an entity."""
    span = text[s:e]
    digits = _only_digits(span)
    low = span.lower()
    spelt = "(at)" in low or "[at]" in low or (" at " in low and " dot " in low)
    mail = "@" in span or spelt
    n = len(digits)
    if not mail and (n < 7 or any(c.isalpha() for c in span)):
        return None
    if mail and not re.search(r"\.|dot", low[max(low.find("@"), low.find("at")) + 1:]):
        return None
    out = ["bias"]
    if mail:
        out += ["at" if "@" in span else "spelt", "letters"]
        out += ["labels"] if re.fullmatch(r"[a-z0-9._%+-]+ ?(@|\(at\)|\[at\]| at ) ?[a-z0-9-]+( ?(\.|\(dot\)|\[dot\]| dot ) ?[a-z0-9-]+)+", low) else ["sepmix"]
    else:
        out.append("d7" if n < 9 else "d9" if n < 13 else "d13" if n < 16 else "d16" if n < 20 else "d20")
        if n >= 13:
            out.append("luhn" if luhn(digits) else "noluhn")
        groups = _DIGITS.findall(span)
        out.append(f"g{min(len(groups), 5)}")
        seps = {c for c in span if not "0" <= c <= "9" and c not in "+()"}
        out.append("sep0" if not seps else f"sep{seps.pop()}" if len(seps) == 1 and seps <= set(" -.") else "sepmix")
        out += ["plus"] if span[0] == "+" else []
        out += ["paren"] if "(" in span and ")" in span else []
        if len(groups) == 4 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span):
            out.append("quad" if all(len(g) < 4 and int(g) <= 255 for g in groups) else "badquad")
        if len(groups) >= 3 and [len(g) for g in groups][:3] in ([4, 2, 2], [2, 2, 4]):
            out.append("date")
        if [len(g) for g in groups][-2:] == [3, 4] or [len(g) for g in groups][-3:] == [3, 3, 4]:
            out.append("mobile")
        if len(groups) == 4 and all(len(g) == 4 for g in groups):
            out.append("four")
    if s and (text[s - 1].isalnum() or text[s - 1] in "+-_=\"'/"):
        out.append("left")
    if e < len(text) and (text[e].isalnum() or (text[e] in "-@_" or text[e] == "." and e + 1 < len(text) and text[e + 1].isalnum())):
        out.append("right")
    if e - s > 40:
        out.append("long")
    before = text[max(0, s - 20):s].lower()
    out += {f"hint{k}" for w, k in _HINTS.items() if w in before}
    return tuple(_NAMES[x] for x in out)


def _bounds(text: str, s: int, e: int, margin: int) -> list[int]:
    """Token boundaries of the window around [s, e), as offsets in the text."""
    a, z = max(0, s - margin), min(len(text), e + margin)
    while a > 0 and s - a < 2 * margin and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while z < len(text) and z - e < 2 * margin and text[z - 1].isalnum() and text[z].isalnum():
        z += 1
    return [m.start() for m in _TOKEN.finditer(text, a, z)] + [z]


def _segments(text: str, bounds: list[int], first: int, end: int):
    """(first token, end token, features) of the candidates that begin at tokens first to end - 1."""
    near = text[bounds[first]:bounds[min(end + LONGEST, len(bounds) - 1)]].lower()
    mail = "@" in near or "(at)" in near or "[at]" in near or " at " in near
    for i in range(first, end):
        c = text[bounds[i]]
        if not (c.isalnum() or c in "+("):
            continue
        for j in range(i + 1, min(i + LONGEST, len(bounds) - 1) + 1):
            if bounds[j] - bounds[i] < 7:
                continue
            if not text[bounds[j] - 1].isalnum():
                continue
            f = span_features(text, bounds[i], bounds[j])
            if f is not None:
                yield i, j, f
            elif not mail and j - i > 3 and not any("0" <= ch <= "9" for ch in text[bounds[i]:bounds[j]]):
                break


def window_at(text: str, s: int, e: int, margin: int = MARGIN) -> Window:
    bounds = _bounds(text, s, e, margin)
    return Window(bounds[0], bounds, list(_segments(text, bounds, 0, len(bounds) - 1)))


# ---- the field

def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def marginals(w: Window, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """log Z, and the posterior of each (segment, kind); scores: segments x kinds."""
    n = len(w.bounds) - 1
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, (i, j, _) in enumerate(w.segments):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    whole = [_logsum(r.tolist()) for r in scores]
    fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
    for t in range(1, n + 1):
        fwd[t] = _logsum([fwd[t - 1]] + [fwd[w.segments[k][0]] + whole[k] for k in by_end.get(t, ())])
    for t in range(n - 1, -1, -1):
        bwd[t] = _logsum([bwd[t + 1]] + [bwd[w.segments[k][1]] + whole[k] for k in by_start.get(t, ())])
    lead = np.array([fwd[i] + bwd[j] for i, j, _ in w.segments])
    return fwd[n], np.exp(lead[:, None] + scores - fwd[n])


def decode(w: Window, scores: np.ndarray, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Best segmentation: (kind, start, end) of entities that don't touch ``taken`` spans."""
    n = len(w.bounds) - 1
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    by_end: dict[int, list[int]] = {}
    for k, (i, j, _) in enumerate(w.segments):
        if not any(w.bounds[i] < e and s < w.bounds[j] for s, e in taken):
            by_end.setdefault(j, []).append(k)
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for k in by_end.get(t, ()):
            i, kind = w.segments[k][0], int(scores[k].argmax())
            if best[i] + scores[k, kind] > best[t]:
                best[t], back[t] = best[i] + scores[k, kind], (i, kind)
    out, t = [], n
    while t > 0:
        if back[t] is None:
            t -= 1
        else:
            i, kind = back[t]
            out.append((kind, w.bounds[i], w.bounds[t]))
            t = i
    return out[::-1]


def _scores(w: Window, weights: np.ndarray) -> np.ndarray:
    return np.stack([weights[:, list(f)].sum(axis=1) for _, _, f in w.segments]) if w.segments else np.zeros((0, len(KINDS)))


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 8, rate: float = 0.3, l2: float = 1e-3) -> np.ndarray | None:
    """Weights (kinds x features) by Adagrad on the exact likelihood; None without any entity."""
    data = []
    for text, gold in examples:
        mid = (gold[0][1], gold[0][2]) if gold else (len(text) // 2, len(text) // 2)
        w = window_at(text, *mid, margin=max(MARGIN, len(text)))
        place = {(w.bounds[i], w.bounds[j]): k for k, (i, j, _) in enumerate(w.segments)}
        target = np.zeros((len(w.segments), len(KINDS)))
        for kind, s, e in gold:
            if (s, e) in place:
                target[place[s, e], kind] = 1
        if w.segments and (target.any() or not gold):
            data.append((w, target))
    if not any(t.any() for _, t in data):
        return None
    weights = np.zeros((len(KINDS), len(_NAMES)))
    weights[:, _NAMES["bias"]] = -2.0
    square = np.full_like(weights, 1e-6)
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            w, target = data[k]
            _, post = marginals(w, _scores(w, weights))
            grad = l2 * weights
            for (_, _, f), d in zip(w.segments, post - target):
                grad[:, list(f)] += d[:, None]
            square += grad * grad
            weights -= rate * grad / np.sqrt(square)
    return weights


def variants(kind: int, span: str) -> list[tuple[int | None, str]]:
    """The span as others would write it; None marks what is not an entity any more."""
    digits = _only_digits(span)
    if kind == 0:
        local, _, host = span.partition("@")
        return [(0, f"{local} (at) {host.replace('.', ' (dot) ')}"), (0, f"{local} at {host.replace('.', ' dot ')}"), (0, f"{local}[at]{host.replace('.', '[dot]')}"),
                (None, f"{local}@{host.split('.')[0]}")]
    if kind == 1:
        parts = span.split(".")
        return [(None, ".".join([str(300 + int(parts[0]))] + parts[1:])), (None, ".".join(parts[:3])), (None, f"{parts[0]}{parts[1]}{parts[2]}{parts[3]}")]
    if kind == 2:
        four = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        broken = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [(2, " ".join(four)), (2, "-".join(four)), (2, ".".join(four)), (None, broken), (None, "-".join(broken[i:i + 4] for i in range(0, len(broken), 4))),
                (None, digits[:11]), (None, f"20{digits[:2]}-0{int(digits[2]) % 9 + 1}-1{digits[3]} 1{digits[4]}:2{digits[5]}:3{digits[6]}")]
    tail = digits[-10:]
    if len(tail) < 10:
        return [(None, digits)]
    return [(3, f"({tail[:3]}) {tail[3:6]}-{tail[6:]}"), (3, f"{tail[:3]}-{tail[3:6]}-{tail[6:]}"), (3, f"{tail[:3]}.{tail[3:6]}.{tail[6:]}"),
            (3, f"+{digits}"), (None, tail), (None, f"{tail[:1]}.{tail[1:]}"), (None, f"{tail[:4]}-{tail[4:6]}-{tail[6:8]}")]


def examples_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Training windows around base spans that stand alone, and their rewritten forms."""
    out = []
    for kind, s, e in spans:
        if any(o != (kind, s, e) and o[1] < e + MARGIN and s - MARGIN < o[2] for o in spans) or e - s > 80:
            continue
        a, z = max(0, s - MARGIN), min(len(text), e + MARGIN)
        out.append((text[a:z], [(kind, s - a, e - a)]))
        for k, form in variants(kind, text[s:e]):
            out.append((text[a:s] + form + text[e:z], [] if k is None else [(k, s - a, s - a + len(form))]))
    return out


def fit(docs: DataFrame, bound: int = FIT_DOCS, windows: int = FIT_WINDOWS) -> np.ndarray | None:
    """Weights from at most ``windows`` spans of ``bound`` documents; None without any."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text"))
    ids = texts.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                spans = base_spans(text)
                for kind, s, e in spans:
                    a = max(0, s - 2 * MARGIN)
                    rows.append((doc, kind, s - a, e - a, text[a:e + 2 * MARGIN]))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.string(),))], names=["doc_id", "kind", "s", "e", "near"])

    found = texts.join(F.broadcast(ids), "doc_id").mapInArrow(run, "doc_id long, kind long, s long, e long, near string")
    got = found.distinct().orderBy(F.xxhash64("doc_id", "s", "near"), "doc_id", "s", "kind", "near").limit(windows).collect()
    return train([x for r in got for x in examples_of(r["near"], base_spans(r["near"])) if r["e"] - r["s"] <= 80])


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the union of spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _pieces(s: int, e: int, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """What the taken spans leave of [s, e)."""
    out = []
    k = bisect_right(ends, s)
    while s < e and k < len(starts) and starts[k] < e:
        if s < starts[k]:
            out.append((s, starts[k]))
        s = ends[k]
        k += 1
    return out + [(s, e)] if s < e else out


def decode_at(text: str, s: int, e: int, weights: np.ndarray, starts: list[int], ends: list[int], floor: int) -> list[tuple[int, int, int]]:
    """``decode`` of the window around [s, e) whatever its length: candidates are made ``STEP`` tokens at a time.

    No entity touches the taken spans (starts, ends) or begins before ``floor``.
    """
    bounds = _bounds(text, s, e, MARGIN)
    n = len(bounds) - 1
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    by_end: dict[int, list[tuple[float, int, int]]] = {}
    for first in range(0, n, STEP):
        end = min(first + STEP, n)
        free = []
        for x in _segments(text, bounds, first, end):
            a, z = bounds[x[0]], bounds[x[1]]
            k = bisect_right(ends, a)
            if a >= floor and (k == len(starts) or starts[k] >= z):
                free.append(x)
        scores = _scores(Window(bounds[first], bounds, free), weights)
        for (i, j, _), score, kind in zip(free, scores.max(axis=1).tolist(), scores.argmax(axis=1).tolist()):
            by_end.setdefault(j, []).append((score, i, kind))
        for t in range(first + 1, end + 1):
            best[t] = best[t - 1]
            for score, i, kind in by_end.pop(t, ()):
                if best[i] + score > best[t]:
                    best[t], back[t] = best[i] + score, (i, kind)
    out, t = [], n
    while t > 0:
        if back[t] is None:
            t -= 1
        else:
            i, kind = back[t]
            out.append((kind, bounds[i], bounds[t]))
            t = i
    return out[::-1]


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray | None) -> list[tuple[int, int, int]]:
    """Entities in the suspects, as far as base spans leave them: a suspect is cut at base spans, never left out."""
    out: list[tuple[int, int, int]] = []
    done = 0
    if weights is None:
        return out
    starts, ends = _merged([(s, e) for _, s, e in base])
    for first, last in suspects(text):
        for s, e in _pieces(max(first, done), last, starts, ends):
            s = max(s, done)
            if s >= e or len(_only_digits(text[s:e])) < 7 and not any(c.isalpha() for c in text[s:e]):
                continue  # no entity is in it
            for kind, a, z in decode_at(text, s, e, weights, starts, ends, done):
                if a < e and s < z:
                    out.append((kind, a, z))
                    done = max(done, z)
    return out


def _search(weights: np.ndarray | None):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                out = {k: [] for k in ("n0", "n1", "n2", "n3", "base", "spans", "found")}
                for text in part.column("text").to_pylist():
                    base = base_spans(text)
                    extra = added_spans(text, base, weights)
                    every = sorted(base + extra)
                    say = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in xs)
                    for k in range(4):
                        out[f"n{k}"].append(sum(x[0] == k for x in base))
                    out["base"].append(hashlib.sha256(say(base).encode()).hexdigest())
                    out["spans"].append(say(every))
                    own = set(base)
                    out["found"].append([{"kind": KINDS[k], "start": s, "end": e, "base": (k, s, e) in own} for k, s, e in every])
                kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.record_batch([part.column("doc_id"), *(pa.array(out[f"n{k}"], pa.int64()) for k in range(4)), pa.array(out["base"], pa.string()),
                                       pa.array(out["spans"], pa.string()), pa.array(out["found"], kinds)],
                                      names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"])
    return run


def find_pii(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """One row per row of ``docs``: base counts and digest, all spans (text and rows)."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text"))
            .mapInArrow(_search(weights), OUT))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return find_pii(docs, fit(docs)).drop("found")
