"""Personal data by patterns and a skip-chain conditional random field.

The patterns find the base spans. The field adds what they miss: its nodes are the
tokens with a digit or an at sign, its chain edges join neighbours, its skip edges join
a token to the one before with the same digits or the same address, however far.
Loopy belief propagation makes such tokens agree over the whole document. The weights
are learned by pseudo-likelihood from the base spans of a bounded sample; tokens in a
match that was dropped because several numbers ran together are not learned from.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "card", "card+", "phone", "phone+")  # + goes on what the token before began
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
Span = tuple[int, int, int]  # kind, start, end

_HINT = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINTS = re.compile(r"[0-9@]+")
_EDGE = ".,;:!?\"'[]{}<>*#$%&|"
#: Documents that the weights are learned from, steps of learning, rounds of messages, and the least belief of an added token.
SAMPLE, STEPS, ROUNDS, BELIEF = 1500, 150, 12, 0.9
#: Edges whose messages are worked out at once.
EDGES = 1 << 14


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    """Each at sign with the local part before it, in one pass."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        before = _LOCAL.match(text[after:at][::-1]).end()
        m = _DOMAIN.match(text, at + 1) if before else None
        if m:
            out.append((at - before, m.end()))
        after = m.end() if m else at + 1
        at = text.find("@", after)
    return out


def base(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The spans of the patterns, and the matches that were dropped."""
    spans, dropped = [], []
    if not _HINT.search(text):
        return spans, dropped
    spans += [(0, a, b) for a, b in emails(text)]
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[k : k + 4])) + 3
            (spans.append((1, at, end)) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts[k : k + 4]) else dropped.append((at, end)))
            at = end + 1
    for m in _NUMBER.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            spans.append((2, *m.span()))
        elif len(d) > 19:
            dropped.append(m.span())
    for m in _PHONE.finditer(text):
        (spans.append((3, *m.span())) if 9 <= len(_digits(m.group())) <= 15 else dropped.append(m.span()))
    return spans, dropped


def tokens(text: str) -> list[tuple[int, int]]:
    """The parts between white space that have a digit or an at sign, without punctuation at their ends."""
    out, done = [], 0
    for m in _HINTS.finditer(text):
        if m.start() < done:
            continue
        a, b = m.span()
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        done = b
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


FEATURES = 20


def features(text: str, a: int, b: int) -> tuple[list[float], str]:
    """A token's features, and the key that repeats of it share ('' for none)."""
    s = text[a:b]
    d = _digits(s)
    n = len(d)
    local, at, domain = s.partition("@")
    parts = s.split(".")
    dotted = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    f = [
        1.0, bool(at and local and "." in domain), bool(at), dotted, dotted and all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts),
        n <= 3, n == 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19, 13 <= n <= 19 and luhn(d), n == len(s),
        s[0] == "+", s[0] == "(", s[-1] == ")", "-" in s, any(c.isalpha() for c in s), n >= 13 and len(s) - n > 3, "." in s,
    ]
    return [float(x) for x in f], (local.lower() if at else d if n >= 4 else "")


@dataclass
class Graph:
    """The tokens of several documents, with chain and skip edges inside each."""

    place: np.ndarray  # document, start, end
    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph(of: list[str]) -> Graph:
    place, x, chain, skip = [], [], [], []
    for doc, text in enumerate(of):
        if not _HINT.search(text):
            continue
        last: dict[str, int] = {}
        previous = -1
        for a, b in tokens(text):
            f, key = features(text, a, b)
            here = len(place)
            if previous >= 0 and place[previous][2] + 1 == a and text[a - 1] == " ":
                chain.append((previous, here))
            if key:
                if key in last and (not chain or chain[-1] != (last[key], here)):
                    skip.append((last[key], here))
                last[key] = here
            place.append((doc, a, b))
            x.append(f)
            previous = here
    edges = lambda e: np.array(e, np.int64).reshape(-1, 2)
    return Graph(np.array(place, np.int64).reshape(-1, 3), np.array(x, float).reshape(-1, FEATURES), edges(chain), edges(skip))


def _touched(places: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span the first and after-last of the places (start, end; in order, apart from one another) that it overlaps."""
    if not spans:
        return []
    of = np.array(spans, np.int64)
    first = np.searchsorted(places[:, 1], of[:, 0], side="right")
    return list(zip(first.tolist(), np.maximum(first, np.searchsorted(places[:, 0], of[:, 1])).tolist()))


def weak_labels(of: list[str], g: Graph) -> tuple[np.ndarray, np.ndarray]:
    """Each token's label by the base spans, and whether it is one to learn from."""
    y, known = np.zeros(len(g.place), np.int64), np.ones(len(g.place), bool)
    docs, first = np.unique(g.place[:, 0], return_index=True)
    for doc, at, end in zip(docs.tolist(), first.tolist(), [*first[1:].tolist(), len(g.place)]):
        spans, dropped = base(of[doc])
        places = g.place[at:end, 1:]
        for kind in (3, 2, 1, 0):
            for a, b in _touched(places, [(s, e) for k, s, e in spans if k == kind]):
                y[at + a : at + b] = (1, 2, 3, 5)[kind]
                if kind > 1:
                    y[at + a + 1 : at + b] += 1
        for a, b in _touched(places, dropped):
            known[at + a : at + b] &= y[at + a : at + b] != 0
    return y, known


@dataclass
class Weights:
    node: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # labels: what agreement on each is worth


def learn(of: list[str], steps: int = STEPS) -> Weights:
    """Pseudo-likelihood: each token's label given its neighbours', by gradient steps with momentum terms."""
    g = graph(of)
    y, known = weak_labels(of, g)
    n = len(LABELS)
    one = np.eye(n)[y] * known[:, None]
    params = [np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros(n)]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    count = max(1, int(known.sum()))
    (i, j), (a, b) = g.chain.T, g.skip.T
    agree = np.zeros_like(one)
    np.add.at(agree, a, one[b])
    np.add.at(agree, b, one[a])
    for t in range(1, steps + 1):
        w, c, s = params
        z = g.x @ w + agree * s
        np.add.at(z, j, one[i] @ c)
        np.add.at(z, i, one[j] @ c.T)
        z -= z.max(1, keepdims=True, initial=-np.inf)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        r = (one - p) * known[:, None]
        grads = [g.x.T @ r, one[i].T @ r[j] + r[i].T @ one[j], (r * agree).sum(0)]
        for k in range(3):
            d = grads[k] / count - 1e-4 * params[k]
            mean[k] = 0.9 * mean[k] + 0.1 * d
            var[k] = 0.99 * var[k] + 0.01 * d * d
            params[k] = params[k] + 0.15 * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.99**t)) + 1e-8)
    return Weights(params[0], np.clip(params[1], -4, 4), np.clip(params[2], 0.5, 4))


def _passed(sent: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The messages that go over edges of one factor, EDGES at a time."""
    out = np.empty_like(sent)
    for at in range(0, len(sent), EDGES):
        z = sent[at : at + EDGES, :, None] + factor
        most = z.max(1)
        out[at : at + EDGES] = most + np.log(np.exp(z - most[:, None, :]).sum(1))
    return out - out.max(1, keepdims=True, initial=-np.inf)


def beliefs(g: Graph, w: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Each token's marginals by damped loopy sum-product over both kinds of edges."""
    node = g.x @ w.node
    node -= node.max(1, keepdims=True, initial=-np.inf)
    if len(g.chain) or len(g.skip):
        kinds = [(g.chain[:, 0], g.chain[:, 1], w.chain), (g.chain[:, 1], g.chain[:, 0], w.chain.T), (g.skip[:, 0], g.skip[:, 1], np.diag(w.skip)), (g.skip[:, 1], g.skip[:, 0], np.diag(w.skip))]
        message = [np.zeros((len(source), len(LABELS))) for source, _, _ in kinds]
        for _ in range(rounds):
            total = node.copy()
            for (_, target, _), m in zip(kinds, message):
                np.add.at(total, target, m)
            # the message that came the other way over an edge is not sent back
            new = [_passed(total[source] - message[k ^ 1], factor) for k, (source, _, factor) in enumerate(kinds)]
            message = [0.5 * m + 0.5 * x for m, x in zip(message, new)]
        for (_, target, _), m in zip(kinds, message):
            np.add.at(node, target, m)
    p = np.exp(node - node.max(1, keepdims=True, initial=-np.inf))
    return p / p.sum(1, keepdims=True)


def added(of: list[str], w: Weights, known: list[list[Span]], belief: float = BELIEF) -> list[list[Span]]:
    """The spans that the field finds and that touch no base span."""
    out: list[list[Span]] = [[] for _ in of]
    g = graph(of)
    if not len(g.place):
        return out
    p = beliefs(g, w)
    best, sure = p.argmax(1), p.max(1) >= belief
    linked = {int(b): int(a) for a, b in g.chain}
    kind_of = (-1, 0, 1, 2, 2, 3, 3)
    open_at: dict[int, int] = {}
    for k, (doc, a, b) in enumerate(g.place.tolist()):
        label = int(best[k])
        if not label or not sure[k]:
            continue
        before = open_at.get(linked.get(k, -1))
        if label in (4, 6):
            if before is not None and out[doc][before][0] == kind_of[label]:
                out[doc][before] = (kind_of[label], out[doc][before][1], b)
                open_at[k] = before
            continue
        open_at[k] = len(out[doc])
        out[doc].append((kind_of[label], a, b))
    for doc, spans in enumerate(out):
        if spans:
            taken = _united((a, b) for _, a, b in known[doc])
            free = [a == b for a, b in _touched(taken, [s[1:] for s in spans])]
            out[doc] = [s for s, x in zip(spans, free) if x and _plausible(of[doc][s[1] : s[2]], s[0])]
    return out


def _united(spans: Iterable[tuple[int, int]]) -> np.ndarray:
    """The spans in order, with those that overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)


def _plausible(s: str, kind: int) -> bool:
    """An added span must have what its kind consists of."""
    n = len(_digits(s))
    return ("@" in s, s.count(".") == 3, 13 <= n <= 19, 9 <= n <= 15)[kind]


def train(docs: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from at most ``sample`` texts that have a digit or an at sign, those with the smallest hash of doc_id."""
    of = docs.where(F.col("text").rlike("[0-9@]")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = of.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = of.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return learn([r.text for r in sorted(rows, key=lambda r: r.doc_id)])


def find(of: list[str], w: Weights) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind and place."""
    found = [sorted(base(t)[0]) for t in of]
    more = added(of, w, found)
    return [(b, sorted({*b, *m})) for b, m in zip(found, more)]


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def find_in_documents(docs: DataFrame, w: Weights) -> DataFrame:
    """``doc_id``, the numbers of base spans by kind, ``base_sha256`` and ``spans`` of every document.

    docs: has ``doc_id`` and ``text``; other columns are not read. Places are code
    points, ends exclusive. A null or empty text has no spans: counts of 0, the digest
    of the empty string, and an empty string. Repeated rows give a row each, an empty
    table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find(texts(batch), shared.value)
        counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in range(4)]
        digest = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string())
        return pa.record_batch([batch.column(0), *counts, digest, pa.array([written(s) for _, s in found], pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the union by the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, w: Weights) -> DataFrame:
    """docs, with all their columns, with the personal data in ``text`` replaced.

    A null text stays null, one without personal data as it is; repeated rows are each
    kept, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        of = batch.column(at).to_pylist()
        found = find([t or "" for t in of], shared.value)
        clean = [t if t is None or not s else redact(t, s) for t, (_, s) in zip(of, found)]
        return batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return map_batches(docs, run, docs.schema)
