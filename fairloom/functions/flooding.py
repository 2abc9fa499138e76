"""Similarity flooding between two small schema graphs, and the choice of consistent correspondences."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cached_property
from math import isfinite, log10, sqrt
from typing import NamedTuple
from zlib import crc32

import numpy as np

#: Rounds at most, and the change at which the scores count as settled.
ROUNDS, SETTLED = 100, 1e-4
_INF = 0x7FF0000000000000
#: A pair of fields needs this much content in common, and to have one parent or this much of the name, or less of it with more of the content.
CONTENT, NAME, WEAK_NAME, STRONG_CONTENT = 0.25, 0.5, 0.3, 0.6


class Value(NamedTuple):
    """A value by its whole text: its hash, the IEEE bits of a number's magnitude (they sort like it; -1 for other values), the hash of its shape (odd if it has
    digits), characters and words."""

    h: int
    size: int
    shape: int
    chars: int
    words: int

    @classmethod
    def of(cls, text: str, number: float | None = None) -> Value:
        size = -1
        if number is not None:
            try:
                size = int(np.float64(abs(number)).view(np.int64))
            except OverflowError:  # a whole number beyond all doubles
                size = _INF
        shape = _shape(text)
        return cls(_hash(text), size, _hash(shape) << 1 | ("0" in shape), len(text), len(text.split()))


class Totals(NamedTuple):
    """Of all distinct values of a field: their number, median and greatest magnitude, distinct shapes, whether one has digits, mean characters and words."""

    n: int
    median: float
    most: float
    shapes: int
    digits: bool
    chars: float
    words: float


@dataclass(frozen=True)
class Field:
    path: str
    type: str  # integer, number, string, boolean, array, or '' where all values are null
    values: tuple[Value, ...]  # the distinct values; some of them where whole is given
    whole: Totals | None = None

    @classmethod
    def of(cls, path: str, type: str, texts: tuple[str, ...]) -> Field:
        return cls(path, type, tuple(Value.of(t, float(t) if type in ("integer", "number") else None) for t in texts))

    @cached_property
    def hashes(self) -> set[int]:
        return {v.h for v in self.values}

    @cached_property
    def shapes(self) -> set[int]:
        return {v.shape for v in self.values}

    @cached_property
    def totals(self) -> Totals:
        if self.whole is not None or not self.values:
            return self.whole or Totals(0, 0.0, 0.0, 0, False, 0.0, 0.0)
        vs = {v.h: v for v in self.values}.values()
        sizes = np.array([v.size for v in vs if v.size >= 0] or [0], np.int64).view(np.float64)
        mean = lambda xs: sum(xs) / len(vs)
        return Totals(len(vs), float(np.median(sizes)), float(sizes.max()), len(self.shapes), any(s & 1 for s in self.shapes), mean(v.chars for v in vs), mean(v.words for v in vs))


def _hash(text: str) -> int:
    raw = text.encode("utf-8", "replace")
    return crc32(raw) << 30 ^ crc32(raw[::-1])


def magnitude(bits: int) -> float:
    return float(np.int64(bits).view(np.float64))


def words(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name.replace("_", " "))
    stem = lambda w: re.sub(r"(ged|ed|es|s)$", "", w) if len(w) > 3 else w
    return {stem(p.lower()) for p in parts}


def _abbreviates(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)))


def name_likeness(a: str, b: str) -> float:
    """Of dotted paths: the leaves' words, or those of the last two parts where a dot became part of a name; spelling as the weaker sign."""
    x, y = a.split("."), b.split(".")
    if x[-1] == y[-1]:
        return 1.0
    best = 0.0
    for i in (1, 2):
        for j in (1, 2):
            p, q = words("_".join(x[-i:])), words("_".join(y[-j:]))
            if p and q:
                both = sum(any(_abbreviates(w, v) for v in q) for w in p)
                whole = both / max(both, len(p) + len(q) - both)
                part = both / min(len(p), len(q)) if i == j == 1 and both >= min(len(p), len(q)) else 0.0
                best = max(best, whole, 0.9 * part)
    return max(best, 0.8 * SequenceMatcher(None, x[-1].lower(), y[-1].lower()).ratio())


def _shape(v: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"\d+", "0", v))


def content_likeness(a: Field, b: Field, common: Mapping[tuple[str, str], tuple[int, int]] | None = None) -> float:
    """0 to 1 from shared values, shapes of values with digits, magnitudes of numbers, and shares of true. All distinct values count; common: how many values, and
    shapes with digits, two paths share, for fields that do not hold all their values (none where it lacks the pair)."""
    if a.type != b.type:
        return 0.0
    p, q = a.totals, b.totals
    if not p.n or not q.n:
        return 0.5  # nothing known
    if a.whole is None and b.whole is None:
        values, shapes = len(a.hashes & b.hashes), sum(s & 1 for s in a.shapes & b.shapes)
    elif common is None:
        raise ValueError(f"{a.path} and {b.path} need the counts of what they share")
    else:
        values, shapes = common.get((a.path, b.path), (0, 0))
    shared = values / min(p.n, q.n)
    if a.type in ("integer", "number"):
        if not (isfinite(p.most) and isfinite(q.most)):
            return shared
        (m1, h1), (m2, h2) = ((log10(1 + x.median * 100), log10(1 + x.most * 100)) for x in (p, q))
        near = max(0.0, 1 - abs(h1 - h2)) * max(0.0, 1 - 0.5 * abs(m1 - m2))
        return max(shared, 0.9 * near)
    if a.type in ("string", "array"):
        same = shapes / max(1, min(p.shapes, q.shapes))
        # free text is told by its length in words and characters
        ratios = [min(x, y) / max(x, y, 1) for x, y in ((p.words, q.words), (p.chars, q.chars))]
        prose = 0.0 if p.digits or q.digits or min(p.chars, q.chars) < 1 else 0.6 * sqrt(ratios[0] * ratios[1])
        return max(shared, 0.9 * same, prose)
    return 0.5 + 0.5 * shared


def _nodes(fields: list[Field]) -> tuple[list[str], dict[str, int]]:
    paths = {""}
    for f in fields:
        parts = f.path.split(".")
        paths |= {".".join(parts[:i]) for i in range(1, len(parts) + 1)}
    order = sorted(paths)
    return order, {p: i for i, p in enumerate(order)}


def _edges(order: list[str], at: dict[str, int]) -> np.ndarray:
    """Parent by child."""
    e = np.zeros((len(order), len(order)))
    for i, p in enumerate(order):
        if p:
            e[at[p.rpartition(".")[0]], i] = 1
    return e


def flood(old: list[Field], new: list[Field], common: Mapping[tuple[str, str], tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, int], dict[str, int]]:
    """Settled scores of all pairs of nodes, the initial ones, and the places of the paths."""
    a, at_a = _nodes(old)
    b, at_b = _nodes(new)
    fa, fb = {f.path: f for f in old}, {f.path: f for f in new}
    start = np.zeros((len(a), len(b)))
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            if (p in fa) != (q in fb):
                continue
            if p == q:
                start[i, j] = 1.0
            elif p and q:
                n = name_likeness(p, q)
                start[i, j] = 0.4 * n if p not in fa else 0.0 if fa[p].type != fb[q].type else 0.1 + 0.4 * n + 0.4 * content_likeness(fa[p], fb[q], common)
    ea, eb = _edges(a, at_a), _edges(b, at_b)
    # each pair of nodes passes its score on in equal parts: down to all pairs of children, up to the one pair of parents
    down = 1 / np.maximum(ea.sum(1)[:, None] * eb.sum(1)[None, :], 1)
    s = start / start.max()
    for _ in range(ROUNDS):
        t = start + s + ea.T @ (s * down) @ eb + ea @ s @ eb.T
        t /= t.max()
        settled = np.abs(t - s).max() < SETTLED
        s = t
        if settled:
            break
    return s, start, at_a, at_b


def correspondences(
    old: list[Field], new: list[Field], apart: set[tuple[str, str]] = frozenset(), common: Mapping[tuple[str, str], tuple[int, int]] | None = None
) -> list[tuple[str, str]]:
    """(old path, new path) of the fields that live on under another path; apart: pairs known to be different fields; common: see content_likeness."""
    had, has = {f.path for f in old}, {f.path for f in new}
    gone, come = [f for f in old if f.path not in has], [f for f in new if f.path not in had]
    if not gone or not come:
        return []
    s, start, at_a, at_b = flood(old, new, common)
    parent = lambda p: p.rpartition(".")[0]
    ranked = []
    for f in gone:
        for g in come:
            if f.type != g.type or (f.path, g.path) in apart or content_likeness(f, g, common) < CONTENT:
                continue
            p, q = parent(f.path), parent(g.path)
            moved_along = p == q or (p not in has and _took_over(p, q, gone, come))
            n = name_likeness(f.path, g.path)
            if moved_along or n >= NAME or (n >= WEAK_NAME and content_likeness(f, g, common) >= STRONG_CONTENT):
                i, j = at_a[f.path], at_b[g.path]
                # a score counts against the best its two fields have: scores of deep and shallow fields differ in size
                ranked.append((start[i, j] + s[i, j] / max(s[i].max(), s[:, j].max(), 1e-9), f.path, g.path))
    used_a, used_b, out = set(), set(), []
    for _, p, q in sorted(ranked, key=lambda x: (-x[0], x[1], x[2])):
        if p not in used_a and q not in used_b:
            used_a.add(p)
            used_b.add(q)
            out.append((p, q))
    return sorted(out)


def _took_over(p: str, q: str, gone: list[Field], come: list[Field]) -> bool:
    """Whether object q has come to hold what object p held: some leaf name of both."""
    leaf = lambda fs, o: {f.path[len(o) + 1 :] for f in fs if f.path.startswith(o + ".")}
    return bool(leaf(gone, p) & leaf(come, q))
