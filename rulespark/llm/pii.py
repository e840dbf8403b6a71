"""Personal data: base patterns, extended by a skip-chain conditional random field.

Base patterns, leftmost and non-overlapping for each kind, are e-mail addresses, IP numbers, payment cards and phone numbers. Open
mentions are what they leave: runs of 7 to 19 digits over separators, addresses with a spelt-out ``[at]``, and other tokens with a digit
or ``@``. In each document, mentions form a graph: neighbours in the text are linked, and so are mentions of the same or similar
content (the same digits but for separators and a country prefix, the same address but for case and spelt-out signs), each to the
one before and to the nearest base span. Node, neighbour and skip potentials give every open mention a belief by loopy message passing, with the
base spans observed. An open mention becomes a span of a kind if its belief in it is ``threshold`` or more and it is joined by such links to a
base span of the kind; base spans always stay.

The potentials are trained by pseudo-likelihood on all documents, as counts of the kinds of examples (class, features, classes of
neighbours and of alikes), of which there are only so many. Base spans have their kind as label; one that is repeated counts twice more, with
its signs masked and with all features masked, so that the link must tell it. Open mentions that nothing links to a base span are outside; those that
are linked to one have no label and are left out, as are they as neighbours.

Rows: one per input row. Null and empty texts have no spans. Repeated rows stay repeated; other columns are ignored. Work is linear in a
text's length and in its mentions.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, pick, schema_of

KINDS = ("email", "ip", "card", "phone")
CLASSES = ("outside", *KINDS)

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
_SOME = re.compile(r"[0-9@]|[\[(] ?at ?[\])]", re.I)
_RUN = re.compile(r"\(?[0-9](?:[ ()./-]{0,3}[0-9])*+")
_AT, _DOT = re.compile(r"\s*[\[(]\s*at\s*[\])]\s*", re.I), re.compile(r"\s*[\[(]\s*dot\s*[\])]\s*", re.I)
_SIGN = re.compile(r"[\[(] ?at ?[\])]", re.I)
_SPELT_END = re.compile(r"\s?[^\s\[\]()]++(?:\s?[\[(] ?dot ?[\])]\s?[^\s\[\]()]++)*+", re.I)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each ``@`` outward, which finds what a scan from the left finds, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[Span]:
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", start, end))
            start = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    if not _SOME.search(text):
        return []
    found = emails(text) + ips(text)
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return found


def in_listed_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def write_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- mentions

N_FEATURES = 22


def shape(text: str) -> list[int]:
    """Numbers of the features a mention has; none tells whether a base pattern holds, so open mentions can be like base spans."""
    text = signs(text)
    digits = sum(map(len, _DIGITS.findall(text)))
    out = [0, 1 + sum(digits >= b for b in (1, 4, 7, 8, 12, 16, 20))]
    out += [9 + i for i, c in enumerate(("@", "+", "(", "-", ":", "/", "=")) if c in text]
    dots = text.count(".")
    out.append(16 + min(dots, 4))
    if re.search("[A-Za-z]", text):
        out.append(21)
    return out


def signs(text: str) -> str:
    """Spelt-out signs of addresses as signs."""
    return _DOT.sub(".", _AT.sub("@", text)) if "[" in text or "(" in text else text


def likeness_keys(text: str) -> str:
    """Mentions with the same non-empty key are repeated or similar."""
    low = signs(text.lower())
    if "@" in low:
        return low.strip(".,;:!?()<>\"'")
    digits = "".join(_DIGITS.findall(text))
    return digits[-10:] if len(digits) >= 7 else ""


@dataclass
class Graph:
    spans: list[tuple[int, int]]
    observed: np.ndarray  # class, or -1
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]

    def named(self) -> list[set[int]]:
        """For each mention the kinds of base spans among those that skips join it to."""
        group = list(range(len(self.spans)))

        def root(i: int) -> int:
            while group[i] != i:
                group[i] = group[group[i]]
                i = group[i]
            return i

        for a, b in self.skip:
            group[root(a)] = root(b)
        kinds: dict[int, set[int]] = {}
        for i, k in enumerate(self.observed.tolist()):
            kinds.setdefault(root(i), set()).update([k] if k > 0 else [])
        return [kinds[root(i)] for i in range(len(group))]


def spelt(text: str) -> list[tuple[int, int]]:
    """Addresses around a spelt-out ``[at]``: from each sign outward, over characters that are no blanks or brackets."""
    out, done = [], 0
    for m in _SIGN.finditer(text):
        end = _SPELT_END.match(text, m.end())
        start = m.start()
        if start > done and text[start - 1].isspace():
            start -= 1
        stop = start
        while start > done and not (text[start - 1].isspace() or text[start - 1] in "[]()"):
            start -= 1
        if end and start < stop:
            out.append((start, end.end()))
            done = end.end()
        else:
            done = max(done, m.start())
    return out


def graph(text: str, base: list[Span]) -> Graph | None:
    """None if there is no open mention."""
    taken = sorted((a, b, KINDS.index(k) + 1) for k, a, b in base)
    merged: list[tuple[int, int, int]] = []
    for a, b, k in taken:  # of overlapping base spans the first stands for the node
        if not merged or a >= merged[-1][1]:
            merged.append((a, b, k))
    whole = spelt(text)
    whole += [m.span() for m in _RUN.finditer(text) if 7 <= sum(map(len, _DIGITS.findall(m[0]))) <= 19]
    opened = _apart(_trimmed(text, sorted(whole)), merged)
    opened += _apart(_trimmed(text, [m.span() for m in _TOKEN.finditer(text) if _MARK.search(m[0])] if _MARK.search(text) else []), sorted([*merged, *((a, b, -1) for a, b in opened)]))
    if not opened:
        return None
    nodes = sorted([*merged, *((a, b, -1) for a, b in opened)])
    chain = [(j, j + 1) for j in range(len(nodes) - 1) if nodes[j + 1][0] - nodes[j][1] <= 40]
    by_key: dict[str, list[int]] = {}
    for j, (a, b, _) in enumerate(nodes):
        if key := likeness_keys(text[a:b]):
            by_key.setdefault(key, []).append(j)
    skip = set()
    for own in by_key.values():
        skip.update(zip(own, own[1:]))
        base_at = [j for j in own if nodes[j][2] > 0]
        for j in own:
            if base_at and nodes[j][2] < 0:
                k = bisect_left(base_at, j)
                near = min(base_at[max(0, k - 1) : k + 1], key=lambda x: abs(x - j))
                skip.add((min(near, j), max(near, j)))
    return Graph([(a, b) for a, b, _ in nodes], np.array([k for *_, k in nodes]), [shape(text[a:b]) for a, b, _ in nodes], chain, sorted(skip))


def _trimmed(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without punctuation at their ends, and without those that it leaves nothing of."""
    out = []
    for a, b in spans:
        while b > a and text[b - 1] in ".,;:!?)\"'>*#$%&":
            b -= 1
        while a < b and text[a] in "(\"'<":
            a += 1
        if b > a and _SOME.search(text, a, b):
            out.append((a, b))
    return out


def _apart(spans: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans, in order, that overlap none that is taken nor one another."""
    out, i, end = [], 0, 0
    for a, b in spans:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= end and not (i < len(taken) and taken[i][0] < b):
            out.append((a, b))
            end = b
    return out


@dataclass(frozen=True)
class Potentials:
    node: np.ndarray  # features x classes
    chain: np.ndarray  # classes x classes
    skip: np.ndarray


def beliefs(g: Graph, p: Potentials, rounds: int = 1000, close: float = 1e-6) -> np.ndarray:
    """Sum-product on the graph, all messages at once, with damping, until none moves by more than ``close``; loops that never settle are
    read off after so many rounds."""
    n, c = len(g.spans), len(CLASSES)
    unary = np.array([p.node[f].sum(0) for f in g.features])
    seen = g.observed >= 0
    unary[seen] = -40.0
    unary[seen, g.observed[seen]] = 0.0
    pairs = [(a, b, p.chain) for a, b in g.chain] + [(a, b, p.skip) for a, b in g.skip]
    if pairs:
        src = np.array([a for a, *_ in pairs] + [b for _, b, _ in pairs])
        dst = np.array([b for _, b, _ in pairs] + [a for a, *_ in pairs])
        kind = np.array([0] * len(g.chain) + [1] * len(g.skip))
        both = np.stack([p.chain, p.skip])[np.concatenate([kind, kind])]
        both[len(pairs) :] = both[len(pairs) :].transpose(0, 2, 1)
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        msg = np.zeros((len(src), c))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, dst, msg)
            out = total[src] - msg[back]
            new = (out[:, :, None] + both).max(1, keepdims=True)
            new = np.log(np.exp(out[:, :, None] + both - new).sum(1)) + new[:, 0]
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if moved <= close:
                break
        np.add.at(unary, dst, msg)
    unary -= unary.max(1, keepdims=True)
    e = np.exp(unary)
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[int, list[int], list[int], list[int], int]], rounds: int = 600, ridge: float = 1e-4) -> Potentials:
    """Pseudo-likelihood: each mention's class given its features and the classes of its neighbours. Rows: class, features, chain and skip neighbours' classes, how often."""
    c = len(CLASSES)
    width = N_FEATURES + 2 * c
    merged: dict[tuple, float] = {}
    for y, f, near, like, n in rows:
        key = (y, tuple(f), tuple(sorted(near)), tuple(sorted(like)))
        merged[key] = merged.get(key, 0) + n
    x, ys, w = np.zeros((len(merged), width)), np.zeros((len(merged), c)), np.zeros(len(merged))
    for i, ((y, f, near, like), n) in enumerate(sorted(merged.items())):
        np.add.at(x[i], list(f), 1)
        np.add.at(x[i], [N_FEATURES + k for k in near], 1)
        np.add.at(x[i], [N_FEATURES + c + k for k in like], 1)
        ys[i, y], w[i] = 1, n
    theta = np.zeros((width, c))
    theta[0, 0] = 1.0
    theta[N_FEATURES + c :] += 0.5 * np.eye(c)
    if len(merged):
        w = (w / w.sum())[:, None]
        velocity = np.zeros_like(theta)
        for _ in range(rounds):
            z = x @ theta
            z = np.exp(z - z.max(1, keepdims=True))
            grad = x.T @ (w * (ys - z / z.sum(1, keepdims=True))) - ridge * theta
            velocity = 0.9 * velocity + grad
            theta += 0.3 * velocity
    near, like = theta[N_FEATURES : N_FEATURES + c], theta[N_FEATURES + c :]
    return Potentials(theta[:N_FEATURES], (near + near.T) / 2, (like + like.T) / 2)


def examples(text: str) -> list[tuple[int, list[int], list[int], list[int]]]:
    """Class, features, classes of the labelled neighbours and alikes, of each labelled mention."""
    base = base_spans(text)
    g = graph(text, base)
    if g is None:  # base spans alone: the same graph without open mentions
        g = graph(text + " 0", base)
    y = g.observed.copy()
    named = g.named()
    y[[i for i in range(len(y)) if y[i] < 0 and not named[i]]] = 0
    near, like = [[] for _ in y], [[] for _ in y]
    for edges, into in ((g.chain, near), (g.skip, like)):
        for a, b in edges:
            if y[b] >= 0:
                into[a].append(int(y[b]))
            if y[a] >= 0:
                into[b].append(int(y[a]))
    out = []
    for i in range(len(y)):
        if y[i] < 0 or g.spans[i][0] >= len(text):
            continue
        views = [g.features[i]]
        if y[i] > 0 and like[i]:  # a variant has other signs, or is unlike it altogether
            views += [[f for f in g.features[i] if f < 9 or f == 21], [0]]
        out += [(int(y[i]), f, sorted(near[i]), sorted(like[i])) for f in views]
    return out


def train(docs: DataFrame) -> Potentials:
    """Counts over all documents; what is collected are kinds of examples, whose number the features bound."""

    def run(batches: Iterator[list[list]]):
        for (texts,) in batches:
            kinds: Counter = Counter()
            for text in texts:
                if _SOME.search(text):
                    kinds.update((y, tuple(f), tuple(near), tuple(like)) for y, f, near, like in examples(text))
            rows = [(y, list(f), list(near), list(like), n) for (y, f, near, like), n in kinds.items()]
            yield list(zip(*rows)) if rows else [[] for _ in range(5)]

    rows = map_batches(docs.select("text"), run, schema_of("y int, f array<int>, near array<int>, alike array<int>, n long"))
    return fit([tuple(r) for r in rows.groupBy("y", "f", "near", "alike").agg(F.sum("n")).collect()])


def find(text: str, p: Potentials, threshold: float = 0.5) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both in listed order."""
    base = in_listed_order(base_spans(text))
    if not base and not _SOME.search(text):
        return base, base
    g = graph(text, base)
    if g is None:
        return base, base
    named = g.named()
    if not any(kinds and y < 0 for kinds, y in zip(named, g.observed)):
        return base, base
    b = beliefs(g, p)
    more = [(CLASSES[k], *g.spans[i]) for i, k in enumerate(b.argmax(1)) if g.observed[i] < 0 and k in named[i] and b[i, k] >= threshold]
    return base, in_listed_order(base + more) if more else base


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id``, counts of base spans by kind, ``base_sha256``, ``spans``."""
    docs = pick(df, id_col, text_col)
    p = train(docs)

    def run(batches: Iterator[list[list]]):
        for ids, texts in batches:
            out = []
            for key, text in zip(ids, texts):
                base, spans = find(text, p, threshold)
                kinds = [k for k, *_ in base]
                out.append((key, *(kinds.count(k) for k in KINDS), hashlib.sha256(write_spans(base).encode()).hexdigest(), write_spans(spans)))
            yield list(zip(*out)) if out else [[] for _ in range(7)]

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(docs, run, schema_of(f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))


def redact(text: str, spans: list[Span]) -> str:
    """Spans replaced by ``[KIND]``; of overlapping ones the first, then longest, takes the place and the others' rest goes too."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
