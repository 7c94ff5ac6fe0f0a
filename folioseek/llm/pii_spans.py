"""Personal data in one text: base matches, candidate spans and their features; for Python workers."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import batched

import numpy as np

KINDS = ("email", "ip", "card", "phone")
# The base formats.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting inside a run of digits never helps, and runs give nothing back: each is read a few times at most.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider formats: ways to write the same things that the base does not take.
_AT, _DOT = r"(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)", r"(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)"
_LABEL = "[A-Za-z0-9-]{1,64}"
_WIDE_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_%+.-])[A-Za-z0-9_%+-]{{1,64}}(?:\.[A-Za-z0-9_%+-]{{1,64}}){{0,4}}(?:@{_LABEL}(?:{_DOT}{_LABEL}){{0,5}}|{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,5}})", re.I
)
_WIDE_IP = re.compile(r"(?<![0-9])(?=([0-9]{1,4}(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,4}){3})(?![0-9]))")
_BETWEEN = r"[\x20().,/‐-―-]"
_GROUP, _GAP = re.compile("[0-9]+"), re.compile(_BETWEEN + "{1,3}")
_BEFORE, _AFTER = re.compile(f"([0-9]+){_BETWEEN}{{0,3}}$"), re.compile(f"{_BETWEEN}{{0,3}}([0-9]+)")
_FEWEST, _MOST = 7, 19
_NEAR = (
    frozenset("mail email courriel correo contact kontakt".split()),
    frozenset("ip host server address adresse addr client".split()),
    frozenset("card visa carte tarjeta karte credit payment konto".split()),
    frozenset("tel phone call mobile fax telefon telephone téléphone teléfono handy".split()),
    frozenset("version token id isbn license licence secret key code order no nr ref date".split()),
)
_WORDS = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


class Taken:
    """Spans kept so far; tells whether another overlaps one of them."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda c: c[1]):
            if self.starts and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, kinds in order, leftmost and not overlapping inside a kind."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, end := domain.end()))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _only_digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_only_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """Every row of whole digit groups, at most three separators apart, that has the digits of a card or a phone.

    A group ends at most as many rows as the digits allow, so work is linear in the text.
    """
    run: deque[tuple[int, int]] = deque(maxlen=_MOST)
    for m in _GROUP.finditer(text):
        if run and not _GAP.fullmatch(text, run[-1][1], m.start()):
            run.clear()
        run.append(m.span())
        n = 0
        for first, last in reversed(run):
            n += last - first
            if n > _MOST:
                break
            start = first - (text[first - 1 : first] in ("+", "("))
            if n >= 13:
                yield 2, start, m.end()
            if _FEWEST <= n <= 15:
                yield 3, start, m.end()


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """High-recall spans that overlap, also inside a kind: whatever has the outline of an address or a number."""
    yield from ((0, m.start(), m.end()) for m in _WIDE_EMAIL.finditer(text))
    yield from ((1, *m.span(1)) for m in _WIDE_IP.finditer(text))
    yield from _numbers(text)


def _char(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in "\"'=:#_/" else 5


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    s = text[start:end]
    digits = _only_digits(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    parts = [int(g[:6]) for g in re.findall("[0-9]+", s)] if kind == 1 else [0]
    left = _WORDS.findall(text[max(0, start - 40) : start].lower())[-4:]
    right = _WORDS.findall(text[end : end + 24].lower())[:2]
    before, after = _BEFORE.search(text[max(0, start - 24) : start]), _AFTER.match(text[end : end + 24])
    row = [
        kind, end - start, len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        s.count("+"), s.count("("), s.count("."), s.count("-"), s.count(" "), s.count("/") + s.count(","), len(set(re.sub(r"[0-9A-Za-z]", "", s))),
        s.count("@"), len(re.findall("[aA][tT]", s)), len(re.findall("[dD][oO][tT]", s)), sum(c.isalpha() for c in s),
        float(13 <= len(digits) <= 19 and luhn(digits)), max(parts, default=0), len(set(digits)),
        _char(text[start - 1 : start]), _char(text[end : end + 1]), _char(text[max(0, start - 2) : start - 1] if start > 1 else ""),
        len(before[1]) if before else 0, len(after[1]) if after else 0,
    ]
    for words in _NEAR:
        row += [float(any(w in words for w in left)), float(any(w in words for w in right))]
    return [float(x) for x in row]


FEATURES = 27 + 2 * len(_NEAR)


def _rewritten(kind: int, s: str, rng: random.Random) -> list[tuple[str, int]]:
    """Other ways to write a base match (1), and look-alikes that are no personal data (0)."""
    digits = _only_digits(s)
    number = lambda *sizes: [str(rng.randrange(10 ** (k - 1), 10**k)) for k in sizes]
    if kind == 0:
        local, _, domain = s.partition("@")
        at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", ".")])
        return [(local + at + domain.replace(".", dot), 1), (f"{local}@{domain.split('.')[0]}", 0), (f"{domain.split('.')[0]} at {number(2)[0]}", 0)]
    if kind == 1:
        parts = s.split(".")
        return [(rng.choice(["[.]", "(.)", " . "]).join(parts), 1), (".".join(number(3, 4, 1, 2)), 0), (" . ".join([parts[0], "999", *parts[2:]]), 0)]
    if kind == 2:
        sep = rng.choice([".", "/", "  ", " - "])
        quads = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        return [(sep.join(quads), 1), (wrong, 0), (sep.join([*quads[:-1], wrong[-len(quads[-1]) :]]), 0), ("978-" + "-".join(number(1, 2, 6, 1)), 0)]
    d = digits[-10:]
    a, b, c = d[:-7], d[-7:-4], d[-4:]
    good = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}", f"{digits[:-10]} ({a}) {b}-{c}"])
    bad = rng.choice([f"{rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", "".join(number(rng.randint(7, 15))), "-".join(number(4, 4)), ",".join(number(1, 3, 3, 3)), " ".join(number(2, 3, 2))])
    return [(good, 1), (bad, 0)]


def _beside(kind: int, new: str, rng: random.Random) -> tuple[str, bool]:
    """What may stand next to a number, and whether it is of the same kind and format."""
    twin = new if kind == 2 else re.sub("[0-9]", lambda m: str(rng.randint(2, 9)), new)
    zip_code, date = str(rng.randint(10000, 99999)), f"{rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"
    return rng.choice([(twin, True), (twin, True), (zip_code, False), (date, False)])


def _judged(line: str, kind: int, label: int, wholes: list[tuple[int, int]], rng: random.Random) -> Iterator[tuple[list[float], int]]:
    """Examples from one line: the spans ``wholes`` with their label, and a few that cut or join them, which are wrong."""
    taken, parts = Taken(base_spans(line)), []
    low, high = min(w[0] for w in wholes), max(w[1] for w in wholes)
    for c in candidates(line):
        if taken.meets(c[1], c[2]):
            continue
        if c[1:] in wholes:
            yield features(line, c), label if c[0] == kind else 0
        elif c[1] < high and low < c[2]:
            parts.append(c)
    for c in rng.sample(parts, min(len(parts), 4)):
        yield features(line, c), 0


def training_rows(text: str, most: int, seed: int) -> tuple[list[list[float]], list[int]]:
    """Features and labels from one text: base matches (1), other candidates (0), and rewritten base matches in their place.

    Rewritten numbers also stand next to others, so that the trees learn where one ends.
    """
    rng, x, y = random.Random(seed), [], []
    base = base_spans(text)
    taken, others = set(base), Taken(base)
    found: list[tuple[int, int, int]] = []
    for i, c in enumerate(c for c in candidates(text) if c in taken or not others.meets(c[1], c[2])):
        if i < most:
            found.append(c)
        elif (k := rng.randrange(i + 1)) < most:
            found[k] = c
    for c in found:
        x.append(features(text, c))
        y.append(int(c in taken))
    for kind, start, end in rng.sample(base, most) if len(base) > most else base:
        before, after = text[max(0, start - 60) : start], text[end : end + 40]
        for new, label in _rewritten(kind, text[start:end], rng):
            lines = [(before + new + after, [(len(before), len(before) + len(new))])]
            for _ in range(2 if kind > 1 and label else 0):
                other, same = _beside(kind, new, rng)
                gap = rng.choice([", ", " / ", " ", "/", ", "])
                first, second = (new, other) if rng.random() < 0.4 else (other, new)
                at, then = len(before), len(before) + len(first) + len(gap)
                both = [(at, at + len(first)), (then, then + len(second))]
                lines.append((before + first + gap + second + after, both if same else [both[first is other]]))
            for line, wholes in lines:
                for row, right in _judged(line, kind, label, wholes, rng):
                    x.append(row)
                    y.append(right)
    return x, y


class Boosted:
    """Gradient boosted trees of fixed depth on binned features, logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.25, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.ridge = trees, depth, rate, ridge

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, 32))) for j in range(x.shape[1])]
        b, width = self.bins(x), 33
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        f = np.full(len(y), self.start)
        self.split, self.leaf = [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), int), []
            for level in range(self.depth):
                nodes = 1 << level
                best = np.full((nodes, 3), -1.0)
                best[:, 2] = width
                for j in range(b.shape[1]):
                    at = node * width + b[:, j]
                    gs, hs = (np.bincount(at, v, nodes * width).reshape(nodes, width).cumsum(axis=1) for v in (g, h))
                    left = gs**2 / (hs + self.ridge)
                    right = (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.ridge)
                    gain = left + right - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(nodes), k] > np.maximum(best[:, 0], 1e-6)
                    best[better] = np.stack([gain[np.arange(nodes), k], np.full(nodes, j), k], axis=1)[better]
                best[:, 1] = np.maximum(best[:, 1], 0)
                splits.append(best[:, 1:].astype(int))
                node = 2 * node + (b[np.arange(len(y)), splits[-1][node, 0]] > splits[-1][node, 1])
            size = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.ridge)
            self.split.append(splits)
            self.leaf.append(leaf)
            f += leaf[node]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, f = self.bins(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for splits, leaf in zip(self.split, self.leaf):
            node = np.zeros(len(x), int)
            for s in splits:
                node = 2 * node + (b[rows, s[node, 0]] > s[node, 1])
            f += leaf[node]
        return 1 / (1 + np.exp(-f))


class SpanModel:
    """Boosted trees and, per kind, the lowest probability that keeps the wanted precision on texts not learned from.

    ``texts`` names the text of each row: rewritten forms of one match are alike, so a text's rows stay together.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, texts: np.ndarray, precision: float, seed: int):
        names, text = np.unique(texts, return_inverse=True)
        check = (np.random.default_rng(seed).random(len(names)) < 0.25)[text]
        if check.all() or len(np.unique(y[~check])) < 2:  # too few texts to keep some back: nothing is proved, nothing added
            check[:] = False
        self.trees = Boosted().fit(x[~check], y[~check])
        p = self.trees.probability(x[check])
        self.threshold = [2.0] * len(KINDS)
        for kind in range(len(KINDS)):
            own = x[check, 0] == kind
            order = np.argsort(-p[own], kind="stable")
            scores, right = p[own][order], y[check][own][order].cumsum()
            holds = np.flatnonzero((right / (np.arange(len(scores)) + 1.2) >= precision) & (scores >= 0.5))
            if len(holds):
                self.threshold[kind] = float(scores[holds[-1]])

    @classmethod
    def restored(cls, edges, start, split, leaf, threshold) -> "SpanModel":
        model = cls.__new__(cls)
        model.trees, model.threshold = Boosted(), threshold
        model.trees.edges, model.trees.start, model.trees.split, model.trees.leaf = edges, start, split, leaf
        return model

    def extra(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates that overlap no base match and reach their threshold; of overlapping ones the likelier."""
        taken = Taken(base)
        likely: list[tuple[float, tuple[int, int, int]]] = []
        for free in batched((c for c in candidates(text) if not taken.meets(c[1], c[2])), 4096):
            p = self.trees.probability(np.array([features(text, c) for c in free]))
            likely += [(float(v), c) for v, c in zip(p, free) if v >= self.threshold[c[0]]]
        chosen: list[tuple[int, int, int]] = []
        for _, c in sorted(likely, key=lambda v: -v[0]):
            if not taken.meets(c[1], c[2]):
                taken.add(c[1], c[2])
                chosen.append(c)
        return chosen
