"""Problem 9: texts whose end is missing, and how often each source cuts.

One pass reads every text: its closing token and what it left open (endings.py), how all tokens of the corpus are used, and min-hash signatures of its
beginnings. Then every text is looked up among all others and judged.

Near-copies. A cut copy is a beginning of its original, so its similarity to the whole original can be any; its similarity to the beginning of the same
length is that of a near-copy. Each text has a signature (shingles of five words) for its first 6, 12, 24, ... words; a text asks with its longest
one, and all texts answer. Within a bucket the copies must hold the five words before the asking text's last one: bucket and these
words are an equi-join, so no bucket is ever paired with itself. Every answer counts: only answers with all words up to there in common stand for each other
(the one whose line goes on farthest, and another one in case it is the asking text), and only those are left out whose sizes, or whose parities of shingles,
show that they can't be similar. The most promising pair of each text is verified first (SIMILAR of the shorter text's shingles are in the longer one) and
aligned, then all others that could still change the result: a text whose end lies inside a word or line of a copy is cut.

Terminality. All other texts are judged by the odds that a cut, which leaves any beginning of any text, leaves this closing token in this place of
its line, against the odds that a text ends with it: signs at which the corpus passes the token (or words that begin with it) to lines, items and
paragraphs that end there. Unknown tokens are judged by the place and shape alone. What a text opens (header block, part, html, encoded data) is such
a token too, counted by texts: a text that leaves open what most texts close is cut. Short closing lines count as one token. The prior odds are PRIOR;
at lengths at which a source's texts pile up, they are the share of the texts of this length that are cut by the rest.

Defined results: NULL, empty and blank texts are whole, and so is a text that ends with a blank line; a repeated id is judged once; NULL sources are
a source; texts of fewer than six words ask for no copies; an empty table gives no rows. Only the three named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairloom.llm import endings
from fairloom.session import broadcast_if_small, stage

SHINGLE, BANDS, ROWS, SIMILAR = 5, 4, 3, 0.8
#: Words of the shortest beginning that gets a signature, each next one is twice as long; the first WHOLE levels have one key of all rows, since one other
#: word leaves less than SIMILAR of so short a beginning; how much farther than its own end a text's end may lie in a copy.
SHORTEST, WHOLE, SLACK = 6, 3, 0.25
#: Asking texts of a bucket whose words are brought to the answers; where more ask, the answers' words are brought to them, which moves less.
ASKS = 64
#: Words of 64 bits that hold the parities of a beginning's shingles.
PARITIES = 4
#: Share of cut texts before anything is known; share at which a sign of omission stands behind a cut.
PRIOR, MARKED = 0.1, 0.7
#: Uses that the place and shape of a token count for, beside its own; other lines that make a closing line a token of its own, if they are this part of the
#: lines that begin so.
BASE, KNOWN_LINE, KNOWN_PART = 3.0, 2, 0.05
#: Distinct tokens a task counts before it hands them on.
MAX_TOKENS = 400_000
#: First letters by which tokens, and lines, meet the closing words and last lines that they may begin with.
FIRST_OF_TOKEN, FIRST_OF_LINE = 4, 9
#: Texts read at a time, and signs whose words are looked for at a time (a longer text alone).
SLICE, SIGNS = 1000, 500_000
#: Bytes up to which words are coded many at a time; longer ones, and those with signs beyond ASCII, one by one.
LONG = 64
#: Lengths from PILE_FROM on at which a source has PILE_LEAST texts and PILE_TIMES the mean of the PILE_NEAR lengths on both sides are piles.
PILE_FROM, PILE_LEAST, PILE_TIMES, PILE_NEAR = 100, 6, 5, 25
_WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _GOLD)


def body_words(text: str) -> list[str]:
    return _WORD.findall(text[max(endings.header_end(text), 0) :].lower())


@cache
def _word_signs() -> np.ndarray:
    """Whether each sign of Unicode is one of a word."""
    out = np.zeros(0x110000, bool)
    for m in _WORD.finditer("".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


@cache
def _crc_steps(bits: int) -> np.ndarray:
    """What so many bits do to the state of crc32."""
    x = np.arange(1 << bits, dtype=np.uint32)
    for _ in range(bits):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


def _crcs(signs: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of the words of size (at most LONG) bytes from start on; signs: all bytes."""
    order = np.argsort(LONG - size.astype(np.uint16), kind="stable")  # the longest first: those that go on are always the first ones
    at, size = start[order], size[order]
    going = len(size) - np.cumsum(np.bincount(size, minlength=LONG + 1))
    pairs = signs.astype(np.uint16)
    pairs[:-1] |= pairs[1:] << np.uint16(8)
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    two, one = _crc_steps(16), _crc_steps(8)
    for j in range(0, LONG, 2):
        m = going[j + 1]
        if not m:
            break
        x = state[:m] ^ pairs[at[:m] + j]
        state[:m] = two[x & np.uint32(0xFFFF)] ^ (x >> np.uint32(16))
    odd = np.flatnonzero(size & 1)
    x = state[odd] ^ signs[at[odd] + size[odd] - 1]
    state[odd] = one[x & np.uint32(0xFF)] ^ (x >> np.uint32(8))
    out = np.empty(len(at), np.uint64)
    out[order] = ~state
    return out


def _spans(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts after the other: all signs of these, a line end behind each; where the words that _WORD finds begin and end there; how many each text has
    and where it begins."""
    i = 0
    while i < len(texts):
        j, signs = i + 1, len(texts[i])
        while j < len(texts) and signs + len(texts[j]) < SIGNS:
            signs += len(texts[j])
            j += 1
        code = np.frombuffer(("\n".join(texts[i:j]) + "\n").encode("utf-32-le"), np.uint32)
        inner = _word_signs()[code]
        stop = np.cumsum(np.fromiter(map(len, texts[i:j]), np.int64, j - i) + 1)
        start, end = np.flatnonzero(inner & ~np.concatenate([[False], inner[:-1]])), np.flatnonzero(inner[:-1] & ~inner[1:]) + 1
        yield code, start, end, np.diff(np.searchsorted(end, stop), prepend=0), np.concatenate([[0], stop[:-1]])
        i = j


def word_codes(texts: list[str], memory: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all words of the texts, one text after the other, and how many each text has; where each word begins and ends in its text."""
    if len(memory) > MAX_TOKENS:
        memory.clear()
    parts = []
    for code, start, end, n, first in _spans(texts):
        size = end - start
        other = np.zeros(len(start), bool)
        other[np.searchsorted(start, np.flatnonzero((code > 127) & _word_signs()[code]), "right") - 1] = True
        other |= size > LONG
        codes, plain = np.empty(len(start), np.uint64), np.flatnonzero(~other)
        codes[plain] = _crcs(code.astype(np.uint8), start[plain], size[plain])
        for k in np.flatnonzero(other).tolist():
            codes[k] = _code(code[start[k] : end[k]].tobytes().decode("utf-32-le"), memory)
        at = np.repeat(first, n)
        parts.append((codes, n, start - at, end - at))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def levels(n: int) -> int:
    """How many beginnings of n words get a signature: those of SHORTEST, twice as many, ... words."""
    return 0 if n < SHORTEST else (n // SHORTEST).bit_length()


def signatures(texts: list[list[str]], memory: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For word lists: how many levels each has, the band keys of all levels of all texts one after the other, a key of each text's words in order, and one of
    the five words before its last."""
    return _signed(np.array([_code(w, memory) for words in texts for w in words], np.uint64), np.array([len(x) for x in texts], np.int64))


def _signed(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """signatures of the texts of n words, whose codes are flat."""
    start = np.cumsum(n) - n
    mixed = _mix(flat + _GOLD)
    order = np.arange(len(flat), dtype=np.uint64) - np.repeat(start, n).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(mixed ^ _mix(order + _GOLD)))])
    body = _mix(sums[start + n] - sums[start] + n.astype(np.uint64))
    sh = np.append(_shingles(mixed), np.uint64(0))
    tail = np.where(n > SHINGLE, sh[np.maximum(start + n - 1 - SHINGLE, 0)], np.uint64(0))
    depth = np.array([levels(k) for k in n.tolist()], np.int64)
    level = np.concatenate([np.arange(d) for d in depth]) if len(depth) else np.zeros(0, np.int64)
    at = np.repeat(start, depth)
    # a segment holds the shingles that a level has beyond the one before
    cuts = np.column_stack([np.where(level > 0, at + (SHORTEST << np.maximum(level - 1, 0)) - SHINGLE + 1, at), at + (SHORTEST << level) - SHINGLE + 1]).reshape(-1)
    if not len(cuts):
        return depth, np.zeros(0, np.uint64), body, tail
    mins = np.empty((len(level), BANDS * ROWS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        h = (sh ^ seed) * (_GOLD | np.uint64(1))
        mins[:, i] = np.minimum.reduceat(h ^ (h >> np.uint64(29)), cuts)[::2]
    for j in range(1, int(depth.max())):
        rows = np.flatnonzero(level == j)
        mins[rows] = np.minimum(mins[rows], mins[rows - 1])
    keys = np.empty((len(level), BANDS), np.uint64)
    whole = level < WHOLE
    for b in range(BANDS):
        x = _mix(level.astype(np.uint64) * _GOLD + np.uint64(b + 1))
        for r in range(ROWS):
            x = _mix(x + mins[:, b * ROWS + r])
        keys[:, b] = x
    keys[whole, 0] = _mix(keys[whole] * np.arange(1, 2 * BANDS, 2, dtype=np.uint64)).sum(1)
    return depth, keys[~whole[:, None] | (np.arange(BANDS) == 0)], body, tail


def _code(word: str, memory: dict[str, int]) -> int:
    c = memory.get(word)
    if c is None:
        c = memory[word] = crc32(word.encode())
    return c


def _shingles(mixed: np.ndarray) -> np.ndarray:
    """A key of SHINGLE words in a row from each word on."""
    padded = np.concatenate([mixed, np.zeros(SHINGLE, np.uint64)])
    sh = np.zeros(len(mixed), np.uint64)
    for j in range(SHINGLE):
        sh = _mix(sh * np.uint64(3) + padded[j : j + len(mixed)])
    return sh


def _rest(text: str, end: int) -> int:
    """Up to where the line that holds the text's word ending at end has words after it, in characters from there; 0: none."""
    stop = text.find("\n", end)
    return max((m.end() for m in _WORD.finditer(text[end : stop if stop >= 0 else len(text)])), default=0)


def _own(text: str) -> int:
    """How many signs follow a text's last word."""
    own = text.rstrip()
    return len(own) - len(own.rstrip(".,;:!?\"'”’»)]*_…>-"))


def aligned_end(short: str, long: str) -> str:
    """'cut' if short's end lies inside a word or line of its near-copy long, 'end' if at the end of a line, '' if it is no near-copy of a part or doesn't align."""
    a, start = body_words(short), max(endings.header_end(long), 0)
    b = [w.lower() for w in _WORD.findall(long, start)]
    tail = a[-SHINGLE - 1 : -1]
    if len(tail) < SHINGLE or len(b) < len(a):
        return ""
    at = [i for i, w in enumerate(b[:-SHINGLE]) if w == tail[0] and b[i : i + SHINGLE] == tail and b[i + SHINGLE].startswith(a[-1])]
    if not at:
        return ""
    i = min(at, key=lambda i: (abs(i + SHINGLE + 1 - len(a)), i))
    sets = [set(zip(*(x[k:] for k in range(SHINGLE)))) for x in (a[:-1], b[: i + SHINGLE])]
    both = len(sets[0] & sets[1])
    if both < SIMILAR * (len(sets[0]) + len(sets[1]) - both):
        return ""
    if b[i + SHINGLE] != a[-1]:
        return "cut"
    end = next(islice(_WORD.finditer(long, start), i + SHINGLE, None)).end()
    return "cut" if _rest(long, end) > _own(short) else "end"


def _begun(mixed: np.ndarray, shingles: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts of n words, one after the other: keys of all words up to each word k of a text; whether the SHINGLE words before k come once in it; the number of
    distinct shingles that end before k, and their parities: bits of PARITIES words, each changed by the shingles whose key names it. Two sets differ in as
    many shingles as bits, or more. All are 0 where k < SHINGLE."""
    start, text = np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(n)), n)
    order = np.arange(len(mixed)) - start
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(mixed ^ _mix(order.astype(np.uint64) + _GOLD)))])
    # the shingle before each word, and the first of each text's equal ones
    at = np.flatnonzero(order >= SHINGLE)
    own = _mix(shingles[at - SHINGLE] + text[at].astype(np.uint64) * _GOLD)
    by = np.argsort(own, kind="stable")
    edge = np.concatenate([[True], own[by][1:] != own[by][:-1], [True]])
    new, once = np.zeros(len(mixed), bool), np.zeros(len(mixed), bool)
    new[at[by[edge[:-1]]]] = True
    once[at[by[edge[:-1] & edge[1:]]]] = True
    bit = _mix(shingles[at - SHINGLE]) % np.uint64(64 * PARITIES)
    one = np.where(new[at], np.uint64(1) << (bit % np.uint64(64)), np.uint64(0))
    count, odd = np.concatenate([[0], np.cumsum(new)]), []
    for j in range(PARITIES):
        x = np.zeros(len(mixed) + 1, np.uint64)
        x[at + 1] = np.where(bit // np.uint64(64) == j, one, np.uint64(0))
        x = np.bitwise_xor.accumulate(x)
        odd.append((x[1:] ^ x[start]).view(np.int64))
    return (sums[1:] - sums[start]).view(np.int64), once, count[1:] - count[start], *odd


def _among(tails: np.ndarray, wanted: list[int] | None) -> np.ndarray:
    """Places of the wanted ones; None: all."""
    if wanted is None or not len(tails):
        return np.arange(len(tails))
    if len(wanted) > 8:
        return np.flatnonzero(np.isin(tails, wanted))
    return np.flatnonzero(np.logical_or.reduce([tails == w for w in wanted]))


class Truncation:
    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.id_col, self.source_col = id_col, source_col
        self.id_type = df.schema[id_col].dataType
        self.texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("x"))
        self.all = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"))
        self.read = stage(self._read(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("x"), F.col(source_col).cast("string").alias("source")).withColumn("exact", F.xxhash64("x"))))
        self.docs = stage(self.read.where("w is null").drop("w", "n", "prose", "other", "tail", "depth", "bands").dropDuplicates(["id"]))
        self.uses = stage(self.read.where("w is not null").groupBy("w").agg(F.sum("n").alias("n"), F.sum("prose").alias("prose"), F.sum("other").alias("other")))

    def _read(self, rows: DataFrame) -> DataFrame:
        fields = [("source", "string"), ("exact", "long"), ("opened", "array<string>"), ("open", "string"), ("place", "string"), ("shape", "string"), ("closing", "string"), ("line", "string"), ("marked", "boolean"), ("chars", "long"), ("bytes", "long")]
        fields += [("body", "long"), ("tail", "long"), ("depth", "long"), ("bands", "array<long>"), ("w", "string"), ("n", "long"), ("prose", "long"), ("other", "long")]
        arrow = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
        names, kinds = ["id", *(f for f, _ in fields)], [arrow[k] for _, k in fields]
        schema = f"id {self.id_type.simpleString()}, " + ", ".join(f"{f} {k}" for f, k in fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uses, memory, id_arrow = endings.Uses(), {}, None

            def counted() -> pa.RecordBatch:
                got = uses.take()
                cols = [pa.nulls(len(got), id_arrow), *[pa.nulls(len(got), k) for k in kinds[:-4]], *[pa.array([x[i] for x in got], k) for i, k in enumerate(kinds[-4:])]]
                return pa.RecordBatch.from_arrays(cols, names)

            for b in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
                id_arrow = b.column(0).type
                texts = b.column(1).to_pylist()
                keep = [i for i, t in enumerate(texts) if t and t.strip()]
                if not keep:
                    continue
                found, bodies = [], []
                for i in keep:
                    t = texts[i]
                    start, blank = endings.header_end(t), endings.paragraph_ended(t)
                    lines = endings.body_lines(t, start)
                    uses.add(lines, blank)
                    opened, open_ = endings.structure(t, start)
                    end = endings.closing(lines)
                    found.append((opened, open_ or ("blank" if blank or not end[0] else ""), *end, len(t.rstrip("\n")), len(t.rstrip("\n").encode())))
                    bodies.append(t[max(start, 0) :].lower())
                    if len(uses) > MAX_TOKENS:
                        yield counted()
                depth, keys, body, tail = _signed(*word_codes(bodies, memory)[:2])
                at = pa.array(keep)
                cols = [pa.array(list(c), k) for c, k in zip(zip(*found), kinds[2:11])]
                ends = np.concatenate([[0], np.cumsum(np.minimum(depth, WHOLE) + np.maximum(depth - WHOLE, 0) * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
                rest = [pa.array(body.view(np.int64)), pa.array(tail.view(np.int64)), pa.array(depth), bands]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), b.column(3).take(at), *cols, *rest, *[pa.nulls(len(keep), k) for k in kinds[-4:]]], names)
            if id_arrow is not None and len(uses):
                yield counted()

        return rows.mapInArrow(run, schema)

    def copies(self) -> DataFrame:
        """(id, copy_cut) of the texts that have a near-copy of which they are a part: true if one of the copies goes on inside a word or line."""
        b = self.read.where("depth > 0").select("id", "body", "exact", "tail", "depth", F.posexplode("bands").alias("i", "band"))
        b = b.withColumn("level", F.expr(f"cast(if(i < {WHOLE}, i, {WHOLE} + (i - {WHOLE}) div {BANDS}) as int)"))
        b = b.select("id", "body", "exact", "tail", "band", "level", (F.col("level") == F.col("depth") - 1).alias("own"))
        # buckets in which a text asks and another one may answer
        live = b.groupBy("band").agg(F.min("body").alias("p"), F.max("body").alias("q"), F.count(F.when(F.col("own"), 1)).alias("asks")).where("asks > 0 and p <> q").select("band", "asks")
        live = stage(live)
        n = live.count()
        few = b.where("own").join(broadcast_if_small(live.where(F.col("asks") <= ASKS), n), "band").groupBy("band").agg(F.collect_set("tail").alias("tails"))  # at most ASKS
        live = stage(live.join(few, "band", "left").select("band", "tails"))
        words = live.agg(F.sum(1 + F.coalesce(F.size("tails"), F.lit(0)))).first()[0] or 0  # the lists count by their length
        b = b.join(broadcast_if_small(live, words), "band")
        each = stage(b.groupBy("body", "exact").agg(F.min("id").alias("e_id"), F.collect_set(F.struct("band", "level", "own", "tails")).alias("at")))  # a text's own buckets
        texts = self.texts.join(broadcast_if_small(each, each.count()), F.col("id") == F.col("e_id"))
        anchors = stage(self._anchors(texts.select("id", "body", "exact", "at", "x")))
        parity = [f"p{i}" for i in range(PARITIES)]
        asks = anchors.where("own").select("band", "tail", F.col("id").alias("short"), F.col("body").alias("a_body"), F.col("next").alias("last"), F.col("rest").alias("signs"), F.col("size").alias("a_size"), *[F.col(c).alias(f"a_{c}") for c in parity])
        # answers with one beginning stand for each other: the line that goes on farthest decides
        alike = ["band", "tail", "next", "same"]
        answers = anchors.where("not own").groupBy(*alike, "body").agg(F.max(F.struct("rest", "id")).alias("r"), *[F.first(c).alias(c) for c in ("size", *parity)])
        by = Window.partitionBy(*alike).orderBy(F.desc("r.rest"), "body")
        answers = answers.withColumn("rank", F.row_number().over(by)).withColumn("top", F.first("body").over(by)).where("rank <= 2")
        answers = stage(answers.select("band", "tail", "next", "body", F.col("r.rest").alias("rest"), F.col("r.id").alias("long"), "size", *parity, F.when(F.col("rank") == 2, F.col("top")).alias("top")))

        def candidates(asks: DataFrame) -> DataFrame:
            """(short, long, cut, differ): the pairs that may be similar, what an alignment there says, and their least share of shingles that differ."""
            p = asks.join(answers, ["band", "tail"]).where(F.col("next").startswith(F.col("last")) & (F.col("body") != F.col("a_body")) & (F.col("top").isNull() | (F.col("top") == F.col("a_body"))))
            odd = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"a_{c}"))) for c in parity), F.lit(0))
            p = p.withColumn("differ", F.greatest(odd, F.abs(F.col("size") - F.col("a_size"))) / (F.col("size") + F.col("a_size")))
            # the sets differ in (1 - s) / (1 + s) of the sum of their sizes if their similarity is s
            p = p.where(F.col("differ") <= (1 - SIMILAR) / (1 + SIMILAR) + 1e-9)
            return p.select("short", "long", ((F.col("next") != F.col("last")) | (F.col("rest") > F.col("signs"))).alias("cut"), "differ")

        first = candidates(asks).groupBy("short", "cut").agg(F.min(F.struct("differ", "long"))["long"].alias("long"), F.count("*").alias("n"))
        first = stage(first)
        done = stage(self._aligned(first.select("short", "long"), first.count()))
        # a cut is final, an end is not while a copy may go on
        left = first.groupBy("short").agg(*[F.coalesce(F.max(F.when(c, F.col("n") > 1)), F.lit(False)).alias(k) for k, c in (("cuts", F.col("cut")), ("ends", ~F.col("cut")))])
        left = left.join(done.groupBy("short").agg(F.max(F.col("v") == "cut").alias("is_cut")), "short", "left")
        left = left.where("(is_cut is null and (cuts or ends)) or (not is_cut and cuts)").select("short", "is_cut")
        left = stage(left)
        n = left.count()
        if n:
            rest = candidates(asks.join(broadcast_if_small(left, n), "short", "left_semi")).join(broadcast_if_small(left, n), "short").where("cut or is_cut is null")
            rest = stage(rest.select("short", "long").distinct().join(first.select("short", "long"), ["short", "long"], "left_anti"))
            done = done.unionByName(self._aligned(rest, rest.count()))
        found = done.join(each.select("exact", "body", F.col("e_id").alias("short")), "short").groupBy("body", "exact").agg(F.max(F.col("v") == "cut").alias("copy_cut"))
        return self.docs.select("id", "body", "exact").join(found, ["body", "exact"]).select("id", "copy_cut")

    def _aligned(self, pairs: DataFrame, n: int) -> DataFrame:
        """(short, v) of the n pairs (short, long) that are near-copies. Only the texts of pairs travel; the pairs go to the texts as long as they are few."""
        ids = pairs.select(F.explode(F.array("short", "long")).alias("t_id")).distinct()
        texts = stage(self.texts.join(broadcast_if_small(ids, 2 * n), F.col("id") == F.col("t_id"), "left_semi"))
        short = texts.join(broadcast_if_small(pairs, n), F.col("id") == F.col("short")).select("short", "long", F.col("x").alias("a"))
        long = texts.select(F.col("id").alias("long"), F.col("x").alias("b"))

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
                v = [aligned_end(p, q) for p, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.string())], ["short", "v"])

        return short.join(long, "long").select("short", "a", "b").mapInArrow(align, f"short {self.id_type.simpleString()}, v string").where("v <> ''")

    def _anchors(self, rows: DataFrame) -> DataFrame:
        """(id, body, band, tail, next, rest, own, same, size, p0, ...): of an asking text the five words before its last one, that one and the signs after it; of an
        answering one all that can be its copy's end in the bucket, and how far the line goes on; of both a key of all words up to there, and the number and
        parities of the shingles before next."""
        marks = [f"p{i}" for i in range(PARITIES)]
        names = ["id", "body", "band", "tail", "next", "rest", "own", "same", "size", *marks]
        schema = f"id {self.id_type.simpleString()}, body long, band long, tail long, next string, rest int, own boolean, same long, size int, " + ", ".join(f"{c} long" for c in marks)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * PARITIES]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memory: dict[str, int] = {}
            for b in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
                exact, texts = b.column(2).to_pylist(), b.column(4).to_pylist()
                starts = [max(endings.header_end(t), 0) for t in texts]
                bodies = [t[i:].lower() for t, i in zip(texts, starts)]
                codes, n, begin, end = word_codes(bodies, memory)
                mixed = _mix(codes + _GOLD)
                shingles = _shingles(mixed)
                tails = shingles.view(np.int64)
                at, out, ks = [], [], []
                for i, (places, text, body, count, first) in enumerate(zip(b.column(3).to_pylist(), texts, bodies, n.tolist(), (np.cumsum(n) - n).tolist())):
                    ends_at = end[first : first + count] + starts[i]
                    if len(body) != len(text) - starts[i]:  # lower case has other signs
                        ends_at = np.array([m.end() for m in _WORD.finditer(text, starts[i])], np.int64)
                    for p in places:
                        if p["own"]:
                            k = count - 1
                            at.append(i)
                            ks.append(first + k)
                            out.append((p["band"], body[begin[first + k] : end[first + k]], _own(text), True))
                        low, high = max(int((SHORTEST << p["level"]) * (1 - SLACK)), SHINGLE), min(int((SHORTEST << (p["level"] + 1)) * (1 + SLACK)), count)
                        ends = _among(tails[first + low - SHINGLE : first + max(high, low) - SHINGLE], p["tails"])
                        if len(ends) and len(ends_at) == count:  # else lower case has other words
                            for k in (ends + low).tolist():
                                at.append(i)
                                ks.append(first + k)
                                out.append((p["band"], body[begin[first + k] : end[first + k]], _rest(text, int(ends_at[k])), False))
                if not at:
                    continue
                band, word, rest, own = zip(*out)
                places = np.array(ks)
                same, once, size, *odd = _begun(mixed, shingles, n)
                # where the five words come twice, the text stands for itself
                key = np.where(once[places], same[places], _mix(np.array(exact, np.int64).view(np.uint64)[at] + places.astype(np.uint64) * _GOLD).view(np.int64))
                cols = [band, tails[places - SHINGLE], word, rest, own, key, size[places], *(x[places] for x in odd)]
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

        return rows.mapInArrow(run, schema)

    def _begun(self, words: DataFrame, marks: DataFrame) -> DataFrame:
        """(w, p): uses of the tokens that begin with the closing token w and go on, and lines that begin with the last line w and go on."""
        first = F.when(F.col("w").startswith("\n"), FIRST_OF_LINE).otherwise(FIRST_OF_TOKEN)
        # only prefixes of a length that a word with the same first letters has; a shorter word is its own first letters
        heads = words.withColumn("first", first).groupBy(F.expr("left(w, first)").alias("h")).agg(F.collect_set(F.length("w")).alias("lengths"))
        heads = broadcast_if_small(heads, words.count())
        # lengths are exploded, not prefixes: no expression here is one that is interpreted for each row
        u = self.uses.where((F.length("w") > 1) & ~F.col("w").startswith("\0")).select("w", "n", F.length("w").alias("k"), first.alias("first"))
        u = u.select("w", "n", "k", F.explode(F.expr("sequence(1, least(k - 1, first))")).alias("i")).withColumn("h", F.expr("left(w, i)")).join(heads, "h")
        u = u.select("w", "n", "k", F.explode("lengths").alias("l")).where("l < k").select("n", F.expr("left(w, l)").alias("w"))
        return u.join(marks, "w", "left_semi").groupBy("w").agg(F.sum("n").alias("p"))

    def _cells(self) -> tuple[DataFrame, float, float]:
        """(place, shape, passed, ends, share of the shape's passes, share of its ends in prose or other places), and the sums of passes and ends."""
        c = self.uses.where("w like '\\0%'").select(F.substring("w", 2, 1).alias("place"), F.substring("w", 3, 1).alias("shape"), F.col("n").alias("passed"), F.col("prose").alias("ended"))
        rows = [tuple(r) for r in c.collect()]  # one for each place and shape
        by_shape: dict = {}
        for place, shape, n, e in rows:
            for k, x in ((shape, n), ((shape, place in endings.PROSE), e)):
                by_shape[k] = by_shape.get(k, 0) + x
        out = [(p, s, float(n), float(e), n / max(by_shape[s], 1), (e + 0.1) / (by_shape[s, p in endings.PROSE] + 1)) for p, s, n, e in rows]
        schema = "place string, shape string, passed double, ended double, part_passed double, part_ended double"
        return F.broadcast(self.docs.sparkSession.createDataFrame(out, schema)), max(sum(r[2] for r in rows), 1.0), max(sum(r[3] for r in rows), 1.0)

    def _left_open(self) -> list[str]:
        """What the texts that open it close in most cases."""
        opened = dict(self.docs.select(F.explode("opened").alias("k")).groupBy("k").agg(F.count("*")).collect())  # at most four kinds
        left = dict(self.docs.groupBy("open").agg(F.count("*")).collect())
        return [k for k, n in opened.items() if (left.get(k, 0) + PRIOR * BASE) / (n + BASE) < 0.5]

    def _odds(self, asked: DataFrame) -> DataFrame:
        """asked with odds: of a cut against an end, before the prior odds, from the closing line where it is known as a line, else from the closing token."""
        cells, passes, ends = self._cells()
        words = stage(asked.select(F.explode(F.array("closing", "line")).alias("w")).where("w <> ''").distinct())
        marks = broadcast_if_small(words, words.count())
        known = self.uses.join(marks, "w", "left_semi")
        zero = F.lit(0)
        stat = stage(known.join(self._begun(words, marks), "w", "full_outer").select("w", *[F.coalesce(c, zero).alias(c) for c in ("n", "prose", "other", "p")]))
        a = asked.join(stat.withColumnRenamed("w", "closing"), "closing", "left").join(stat.select(F.col("w").alias("line"), F.col("n").alias("lines"), F.col("p").alias("longer")), "line", "left")
        # other texts that end with the line; copies do not vouch for each other
        same = asked.where("line <> ''").select("line", "body").distinct().groupBy("line").agg((F.count("*") - 1).alias("others"))
        a = a.join(same, "line", "left").join(cells, ["place", "shape"], "left")
        n, prose, other, p, lines, longer, others, passed, ended = (F.coalesce(c, zero) for c in ("n", "prose", "other", "p", "lines", "longer", "others", "passed", "ended"))
        blank = F.col("shape") == "_"
        left = F.when(blank, n).otherwise(n + p) * F.coalesce("part_passed", F.lit(0.0)) + BASE
        stops = F.when(blank, 0).when(F.col("place").isin(*endings.PROSE), prose).otherwise(other) * F.coalesce("part_ended", F.lit(1.0)) + BASE * (ended + 0.5) / (passed + 10)
        token = left / stops
        line = (lines + longer + BASE) / (lines + others)
        known = (lines + others >= KNOWN_LINE) & (lines + others >= KNOWN_PART * longer)
        return a.withColumn("odds", F.when(known & ~blank, line).otherwise(token) * (ends / passes))

    def _piles(self, d: DataFrame, c: str) -> DataFrame:
        """(s, limit, prior): lengths of a source at which its texts pile up, and the share of them that is cut; c: chars or bytes, d has found: judged to be cut."""
        n = d.where(F.col(c) >= PILE_FROM).groupBy("source", c).agg(F.count("*").alias("k"), F.count(F.when(F.col("found"), 1)).alias("cut"))
        near = Window.partitionBy("source").orderBy(c).rangeBetween(-PILE_NEAR, PILE_NEAR)
        n = n.withColumn("mean", (F.sum("k").over(near) - F.col("k")) / (2 * PILE_NEAR))
        n = n.where((F.col("k") >= PILE_LEAST) & (F.col("k") >= PILE_TIMES * F.col("mean") + PILE_LEAST / 2))
        return n.select(F.col("source").alias("s"), F.col(c).alias("limit"), ((F.col("cut") + PRIOR * PILE_LEAST) / (F.col("k") + PILE_LEAST)).alias("prior"))

    def judged(self) -> DataFrame:
        """(id, source, truncated, how): every text that is not NULL, empty or blank; how tells what decided: copy, open (something is left open), word (the
        closing token's or line's odds), limit (the odds at a length at which texts pile up), or whole."""
        # written apart: one plan of all would keep the driver busy planning it again after every stage
        copies = stage(self.copies())
        open_ = F.col("open").isin(self._left_open())
        ask = self.docs.where(~open_ & ~F.col("open").isin("closed", "blank")).select("id", "place", "shape", "closing", "line", "marked", "body")
        of = lambda p: p / (1 - p)
        odds = self._odds(stage(ask)).select("id", (F.col("odds") * F.when(F.col("marked"), of(MARKED)).otherwise(of(PRIOR))).alias("odds"), F.when(~F.col("marked"), F.col("odds")).alias("plain_odds"))
        d = self.docs.select("id", "source", "chars", "bytes", open_.alias("left_open")).join(odds, "id", "left").join(copies, "id", "left")
        d = stage(d.withColumn("found", F.coalesce("copy_cut", F.lit(False)) | F.col("left_open") | F.coalesce(F.col("odds") > 1, F.lit(False))))
        higher: list[Column] = []
        for c in ("chars", "bytes"):
            piles = self._piles(d, c).select("s", F.col("limit").alias(f"{c}_"), F.col("prior").alias(f"{c}_prior"))
            d = d.join(piles, F.col("source").eqNullSafe(F.col("s")) & (F.col(c) == F.col(f"{c}_")), "left").drop("s", f"{c}_")
            higher.append(F.coalesce(f"{c}_prior", F.lit(0.0)))
        prior = F.greatest(*higher)
        how = (
            F.when(F.col("copy_cut"), "copy").when(F.col("left_open"), "open").when(F.col("odds") > 1, "word")
            .when((prior > PRIOR) & (F.col("plain_odds") * of(prior) > 1), "limit").otherwise("whole")
        )
        d = d.select("id", "source", how.alias("how"))
        return d.select(F.col("id").alias(self.id_col), F.col("source").alias(self.source_col), (F.col("how") != "whole").alias("truncated"), "how")

    def rates(self) -> DataFrame:
        """Each source's texts (all that are stored, blank ones too), truncated ones and their share."""
        cut = self.judged().where("truncated").groupBy(F.col(self.source_col).alias("s")).agg(F.count("*").alias("truncated"))
        n = self.all.dropDuplicates(["id"]).groupBy("source").agg(F.count("*").alias("documents"))
        r = n.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("truncated", F.coalesce("truncated", F.lit(0)))
        return r.select(F.col("source").alias(self.source_col), "documents", "truncated", (F.col("truncated") / F.col("documents")).alias("rate"))
