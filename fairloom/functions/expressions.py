"""Regular expressions of a text column by minimum description length.

Values become shapes: a letter or digit is known by its class (upper case, lower case, digit), other characters stand for themselves; values of more than
LONGEST characters by runs of a class. A shape is worth an expression if stating it and coding its values by it takes fewer bits than spelling them
out. Each class then has one alphabet for the whole column, in all expressions: the characters, among the values of these shapes, whose place
in it takes fewer bits than spelling out the values that need them. The counts of all distinct values enter, scaled to the same total weight, so
that the same share of noise gives the same expressions at every size of the table.

Defined results: values whose runs are more than RUNS (free text) have no shape and no expression; the empty value is a shape; no values, no expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a column's evidence is scaled to; characters and runs a shape is known by; bits of a spelt-out character, of saying that a value is spelt out, and of a run's length.
WEIGHT, LONGEST, RUNS, CHAR_BITS, EXTRA_BITS, RUN_BITS = 1000, 24, 48, 8, 7, 5
#: Bits of stating one more expression, besides its places, and a character of an alphabet.
STATE_BITS, LETTER_BITS = 128.0, 6.0
#: A shape with less than this part of one scaled row cannot pay for an expression: at most WEIGHT / LEAST shapes reach the driver.
LEAST = 0.1
# The classes, their characters and size.
_CLASSES = {"U": ("A-Z", 26), "l": ("a-z", 26), "D": ("0-9", 10)}
_PLACE = re.compile(r"\\[UlD]\+?|[\s\S]")


def _class(c: str) -> str:
    return "U" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "D" if "0" <= c <= "9" else ""


def _shape(v: str) -> str | None:
    kinds = [(f"\\{k}" if (k := _class(c)) else c) for c in v]
    if len(v) > LONGEST:
        runs: list[str] = []
        for k in kinds:
            if len(k) == 1 or not runs or runs[-1] != k + "+":
                runs.append(k if len(k) == 1 else k + "+")
                if len(runs) > RUNS:
                    return None
        kinds = runs
    return "".join(kinds)


def shape_counts(values: DataFrame, value: str, n: str) -> DataFrame:
    """(shape, ch, n): rows of each shape (ch is ''), and how often its values hold each letter and digit; values has distinct values with their row counts n."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            c: Counter = Counter()
            for v, k in zip(p["v"], p["n"]):
                s = None if v is None else _shape(v)
                if s is not None:
                    c[s, ""] += k
                    for ch, m in Counter(v).items():
                        if _class(ch):
                            c[s, ch] += k * m
            yield pd.DataFrame([(*k, x) for k, x in c.items()], columns=["shape", "ch", "n"])

    rows = values.select(F.col(value).alias("v"), F.col(n).alias("n")).mapInPandas(run, "shape string, ch string, n long")
    return rows.groupBy("shape", "ch").agg(F.sum("n").alias("n"))


def _alphabet(counts: Counter, spelt: float) -> str:
    """The characters that pay for their place: counts in scaled rows; spelt: bits a value costs more when it is spelt out."""
    total = sum(counts.values())
    kept = [c for c, n in counts.items() if n * (spelt - log2(total / n) - 1 / 0.693) > LETTER_BITS]
    out, chars = [], sorted(kept)
    while chars:
        j = 1
        while j < len(chars) and ord(chars[j]) == ord(chars[j - 1]) + 1:
            j += 1
        out.append(chars[0] if j == 1 else f"{chars[0]}{'-' if j > 2 else ''}{chars[j - 1]}")
        chars = chars[j:]
    text = "".join(out)
    return text if len(text) == 1 else f"[{text}]"


def induce(counts: list[tuple[str, str, int]], total: int) -> list[tuple[str, int]]:
    """(expression, rows of its shape) worth their bits, most rows first; counts are rows of shape_counts, total all non-NULL rows."""
    size = {s: n for s, ch, n in counts if not ch}
    held: dict[str, Counter] = {}
    for s, ch, n in counts:
        if ch:
            held.setdefault(s, Counter())[ch] += n
    kept: dict[str, float] = {}
    for s, n in size.items():
        weight, places = WEIGHT * n / total, _PLACE.findall(s)
        mean = (sum(held.get(s, {}).values()) / n) + sum(len(p) == 1 for p in places)  # characters of a value
        bits = sum(k * log2(_CLASSES[_class(ch)][1]) for ch, k in held.get(s, {}).items()) / n + sum(RUN_BITS for p in places if p.endswith("+") and len(p) == 3)
        # a long value speaks for its shape no louder than one of LONGEST characters, or a single one would pay for an expression
        fair = min(1.0, LONGEST / max(mean, 1))
        spelt, bits = CHAR_BITS * (mean * fair + 1) + EXTRA_BITS, bits * fair
        state = STATE_BITS + sum((CHAR_BITS if len(p) == 1 else 2) + (2 if p == q else 4) for p, q in zip(places, ["", *places]))
        if weight >= LEAST and weight * (spelt - bits - log2(max(WEIGHT / weight, 1))) > state:
            kept[s] = spelt - bits
    pool: dict[str, Counter] = {k: Counter() for k in _CLASSES}
    for s in kept:
        for ch, n in held.get(s, {}).items():
            pool[_class(ch)][ch] += n * WEIGHT / total
    dearest = max(kept.values(), default=0.0)
    sets = {k: _alphabet(c, dearest) if c else "" for k, c in pool.items()}
    out = []
    for s in kept:
        parts: list[list] = []
        for p in _PLACE.findall(s):
            text = re.escape(p) if len(p) == 1 else sets[p[1]] + p[2:]
            if parts and parts[-1][0] == text and not text.endswith("+"):
                parts[-1][1] += 1
            else:
                parts.append([text, 1])
        out.append(("".join(t if k == 1 else f"{t}{{{k}}}" for t, k in parts), size[s]))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def column_expressions(values: DataFrame, value: str, n: str) -> list[str]:
    """The expressions of a column from its distinct values and their counts."""
    total = values.agg(F.sum(n)).first()[0] or 0
    if not total:
        return []
    c = shape_counts(values, value, n)
    keep = c.where((F.col("ch") == "") & (F.col("n") * (WEIGHT / LEAST) >= total)).select(F.col("shape").alias("kept"))
    rows = c.join(keep, F.col("shape") == F.col("kept"), "left_semi").collect()  # at most WEIGHT / LEAST shapes of at most 62 letters and digits
    return [e for e, _ in induce([tuple(r) for r in rows], total)]


def whole(expressions: list[str]) -> str:
    """One expression for rlike that matches exactly the texts one of the expressions matches; \\z, since $ allows a line end."""
    return r"\A(?:" + "|".join(expressions) + r")\z" if expressions else r"\A\b\B\z"
