"""Periodic runs of words: a suffix automaton whose link tree is accessed, word by word, as link-cut paths.

The states of a text's suffix automaton form a tree by their suffix links; the path from the root to the state of a
prefix holds all suffixes of that prefix.  Appending a word recolours this path with the word's number.  What the
path was coloured before tells where each suffix ended last: a segment of one colour, whose deepest state spells
``m`` words, ended last at the colour.  If that is ``d`` words back and d <= m, the words form a square of period d,
which extends m + d words to the left, no further; where the next word breaks the period, it is a whole run.  A run
of three periods or more is found so with its smallest period, as nearer ends of the same words would have repainted
the segment.  The segments are the preferred paths of a link-cut tree, so n words recolour O(n log n) of them.

Only words that can belong to a run are appended: a run of ``least`` words and three periods repeats every stretch of
2/3 least words inside it one period on.  Stretches are compared by hash; equal hashes of unlike stretches cost time, never a run.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import WORD

Run = tuple[int, int, int]


class SuffixAutomaton:
    """States 1 (root) and on, with length, suffix link and the state of every prefix."""

    def __init__(self, word_ids: list[int]):
        length, link, step = [0, 0], [0, 0], [{}, {}]
        self.prefix = prefix = []
        last = 1
        for w in word_ids:
            new = len(length)
            length.append(length[last] + 1)
            link.append(1)
            step.append({})
            at = last
            while at and w not in step[at]:
                step[at][w] = new
                at = link[at]
            if at:
                to = step[at][w]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    twin = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    step.append(step[to].copy())
                    link[to] = link[new] = twin
                    while at and step[at].get(w) == to:
                        step[at][w] = twin
                        at = link[at]
            prefix.append(new)
            last = new
        self.length, self.link = length, link


class LastOccurrence:
    """The automaton's link tree as preferred paths in splay trees; each path has one colour, kept at its splay root."""

    def __init__(self, automaton: SuffixAutomaton):
        self.length = automaton.length
        self.up = list(automaton.link)
        self.left, self.right = [0] * len(self.up), [0] * len(self.up)
        self.colour = [-1] * len(self.up)

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            p = up[x]
            on_left = left[p] == x
            if not p or not (on_left or right[p] == x):
                return
            g = up[p]
            p_left = left[g] == p
            p_top = not g or not (p_left or right[g] == p)
            if p_top:
                colour[x] = colour[p]
                turns = ((x, p),)
            else:
                gg = up[g]
                if not gg or (left[gg] != g and right[gg] != g):
                    colour[x] = colour[g]
                turns = ((p, g), (x, p)) if on_left == p_left else ((x, p), (x, g))
            for c, b in turns:
                over = up[b]
                if over:
                    if left[over] == b:
                        left[over] = c
                    elif right[over] == b:
                        right[over] = c
                up[c] = over
                if left[b] == c:
                    inner = right[c]
                    left[b], right[c] = inner, b
                else:
                    inner = left[c]
                    right[b], left[c] = inner, b
                if inner:
                    up[inner] = b
                up[b] = c

    def recolour(self, state: int, colour: int) -> list[tuple[int, int]]:
        """Paint the path from the root to a state; the (old colour, longest length) of its segments, deepest first."""
        found, below, at = [], 0, state
        while at:
            self._splay(at)
            found.append((self.colour[at], self.length[at]))
            cut = self.right[at]
            if cut:
                self.colour[cut] = self.colour[at]
            self.right[at] = below
            below, at = at, self.up[at]
        self._splay(state)
        self.colour[state] = colour
        return found


def runs_of(word_ids: list[int], least: int = 24, powers: int = 3) -> list[Run]:
    """All maximal (start, length, period) with length >= max(least, powers * period) of one stretch of words, unordered."""
    n, found = len(word_ids), []
    automaton = SuffixAutomaton(word_ids)
    paths = LastOccurrence(automaton)
    for i, state in enumerate(automaton.prefix):
        for before, m in paths.recolour(state, i):
            if before < 0:
                continue
            d = i - before
            if m + d >= max(least, powers * d) and (i + 1 == n or word_ids[i + 1] != word_ids[i + 1 - d]):
                found.append((i - m - d + 1, m + d, d))
    return found


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _stretch_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each stretch of ``size`` words, equal for equal stretches."""
    join = lambda a, b: (a[: len(b)] ^ (a[: len(b)] >> np.uint64(32))) * _MIX + b
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    out, done, power = None, 0, 1
    while True:
        if size & power:
            out = h if out is None else join(out, h[done:])
            done += power
        if 2 * power > size:
            return out[: len(ids) - size + 1]
        h, power = join(h, h[power:]), 2 * power


def places_of_runs(ids: np.ndarray, least: int = 24, powers: int = 3) -> list[tuple[int, int]]:
    """Disjoint (begin, end) outside which no run has a word.

    In a run of period q a stretch of s words, s at most length - q, is met again q words on, and before that at most
    as far on.  So pairs of neighbouring equal stretches no more than a ``powers``-th of their place apart mark every
    word of a run.  Marked words that touch are a place; pairs too far apart for their place are left out and places formed anew
    until none is.
    """
    n, size = len(ids), least * (powers - 1) // powers
    if n < least:
        return []
    h = _stretch_hashes(ids, size)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    first, second = order[:-1][same], order[1:][same]
    place, begin, end = np.zeros(n, dtype=np.int64), None, np.array([n])
    widths = end
    while len(first):
        fits = (place[first] == place[second]) & ((second - first) * powers <= widths[place[first]])
        if begin is not None and fits.all():
            return [(int(b), int(e)) for b, e in zip(begin, end) if e - b >= least]
        first, second = first[fits], second[fits]
        starts = np.zeros(n - size + 1, dtype=np.int64)
        starts[first] = starts[second] = 1
        marks = np.concatenate([starts, np.zeros(size, dtype=np.int64)])
        marks[size:] -= starts
        covered = np.concatenate([[False], np.cumsum(marks[:n]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        begin, end = edges[::2], edges[1::2]
        widths = end - begin
        place = np.cumsum(np.bincount(begin, minlength=n)[:n]) - 1
    return []


def word_runs(words: list[str], least: int = 24, powers: int = 3) -> list[Run]:
    """All runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
    if len(names) == len(words):
        return []
    found = []
    for begin, end in places_of_runs(ids, least, powers):
        found += [(begin + s, length, q) for s, length, q in runs_of(ids[begin:end].tolist(), least, powers)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length by period, compared exactly; ties to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2] or (r[1] * best[2] == best[1] * r[2] and (r[0], r[2]) < (best[0], best[2])):
            best = r
    return best


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words, of one document in ten (by its id) made periodic from some word on; a null id changes nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


SCHEMA = (
    "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)
_FOUND = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))


def find_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 24, powers: int = 3, plant: bool = False, keep_texts: bool = True
) -> DataFrame:
    """One row per row of ``docs``: the figures of its runs, its strongest run, all runs and the text without repeats.

    A run is a maximal stretch of at least ``least`` words and ``powers`` (two or more) times its smallest period.
    ``plant`` changes one document in ten, known by its integer id, as ``planted`` says.  ``keep_texts=False`` leaves
    the columns runs and collapsed out.  Null and empty texts have no words, no runs and the digests of nothing;
    repeated rows and null ids are handled like any other; an empty table gives none.  Whole texts are read; one document is
    the unit of work, its automaton takes memory in proportion to the words of one place that may hold a run.
    """
    words_of = re.compile(WORD).findall
    kind = docs.schema[id_col].dataType.simpleString()
    schema = SCHEMA.format(kind) if keep_texts else SCHEMA.format(kind).split(", runs array")[0]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            ids = b.column("id").to_pylist()
            rows: list[tuple] = []
            all_runs, texts = [], []
            for key, text in zip(ids, b.column("text")):
                words = words_of(text.as_py() or "")
                words = planted(words, key) if plant else words
                runs = word_runs(words, least, powers)
                best = strongest(runs)
                lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
                left = " ".join(collapsed(words, runs))
                rows.append((len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(left)))
                if keep_texts:
                    all_runs.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                    texts.append(left)
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            out = [b.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds))]
            if keep_texts:
                out += [pa.array(all_runs, _FOUND), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, schema)
