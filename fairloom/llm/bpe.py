"""Problem 7: the corpus as token ids of a public byte-level BPE vocabulary.

Per Arrow batch the texts are cut into words by the vocabulary's pattern, and only words not met before are encoded. DuckDB does that: a row for
each token and position joins the merge table, a recursive query contracts the leftmost pair of least rank of every word until no pair is left, and
an ordered read gives the ids. Nothing is shuffled; memory is bounded by a batch and by MAX_WORDS.

Defined results: NULL, empty texts -> empty list; blank texts are encoded like any text; texts that spell a special token are ordinary text; a
repeated row gives a repeated row; an empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of the vocabulary, as its documentation states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a Python worker remembers before it starts anew, bytes that one DuckDB query takes, and the longest word that goes through DuckDB: each
#: contraction is one round over all words, so a single run of thousands of characters would cost thousands of rounds. Longer ones use a heap.
MAX_WORDS, QUERY_BYTES, LONG_WORD = 500_000, 1_000_000, 256
#: Texts whose ids are put together at a time, which bounds what a batch needs besides its texts and words.
SLICE = 500

RECURSION = """
with recursive t(it, wid, pos, tok, npos, ntok) as (
  select 0, wid, pos, tok, npos, ntok from chars
  union all
  (with best as (
     select t.wid, min((m.r::bigint << 32) | t.pos) as b
     from t join merges m on m.k = t.tok::bigint * 65536 + t.ntok where t.ntok >= 0 group by t.wid),
   live as (select t.*, (b >> 32)::int as mr, (b & 4294967295)::int as mp from t join best using (wid)),
   gone as (select r.wid, r.pos as gpos, r.npos as gnpos, r.ntok as gntok from live r join live l on l.wid = r.wid and l.pos = l.mp and l.npos = r.pos)
   select l.it + 1, l.wid, l.pos,
     case when l.pos = l.mp then l.mr else l.tok end,
     case when l.pos = l.mp then g.gnpos else l.npos end,
     case when l.pos = l.mp then g.gntok when l.npos = l.mp then l.mr else l.ntok end
   from live l join gone g using (wid) where l.pos <> g.gpos)
)
select wid, tok from t join (select wid, max(it) as it from t group by wid) using (wid, it) order by wid, pos
"""


class Encoder:
    """Words to ids, with a memory that all batches of a Python worker share."""

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        if max(self.ranks.values()) >= 65536 or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path}: ids must be below 65536 and cover all single bytes")
        self.find = regex.compile(PATTERN).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        made = np.array([(self.ranks[a], self.ranks[b], r) for t, r in self.ranks.items() if len(t) > 1 for a, b in [self._halves(t, r)]], dtype=np.int64)
        self.con.register("made", pa.table({"k": made[:, 0] * 65536 + made[:, 1], "r": made[:, 2].astype(np.int32)}))
        self.con.execute("create table merges as select * from made")
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _halves(self, token: bytes, rank: int) -> list[bytes]:
        """The two tokens whose merge makes this one."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            _, i = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], rank)) < rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _by_query(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        wid = np.repeat(np.arange(len(words)), n)
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
        last = pos + 1 == np.repeat(n, n)
        cols = {"wid": wid, "pos": pos, "tok": tok, "npos": pos + 1, "ntok": np.where(last, -1, np.append(tok[1:], -1))}
        self.con.register("chars", pa.table({k: v.astype(np.int32) for k, v in cols.items()}))
        got = self.con.execute(RECURSION).fetchnumpy()
        return np.bincount(np.asarray(got["wid"]), minlength=len(words)), np.asarray(got["tok"]).astype(np.int32)

    def _by_heap(self, word: bytes) -> list[int]:
        """The same contraction of one long word, with a heap of pairs: n log n steps."""
        tok: list = [word[i : i + 1] for i in range(len(word))]
        nxt, prv = [*range(1, len(tok)), -1], [*range(-1, len(tok) - 1)]
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(len(tok) - 1) if (r := self.ranks.get(tok[i] + tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != a or j < 0 or tok[j] != b:
                continue
            tok[i], tok[j], nxt[i] = a + b, None, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] >= 0 and (r := self.ranks.get(tok[x] + tok[nxt[x]])) is not None:
                    heapq.heappush(heap, (r, x, tok[x], tok[nxt[x]]))
        return [self.ranks[t] for t in tok if t is not None]

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        counts, ids, short, size = np.zeros(len(raw), np.int64), {}, [], 0
        flats: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        for i, w in enumerate(raw):
            if w in self.ranks or len(w) > LONG_WORD:
                ids[i] = [self.ranks[w]] if w in self.ranks else self._by_heap(w)
            else:
                short.append(i)
                size += len(w)
            if short and (size >= QUERY_BYTES or i == len(raw) - 1):
                flats.append((short, *self._by_query([raw[j] for j in short])))
                short, size = [], 0
        if short:
            flats.append((short, *self._by_query([raw[j] for j in short])))
        order: list[int] = []
        chunks: list[np.ndarray] = []
        for idx, n, flat in flats:
            counts[idx] = n
            order += idx
            chunks.append(flat)
        for i, x in ids.items():
            counts[i] = len(x)
            order.append(i)
            chunks.append(np.array(x, np.int32))
        starts = np.zeros(len(raw), np.int64)
        n = counts[order]
        starts[order] = np.cumsum(n) - n + len(self.flat)
        self.start, self.length, self.flat = np.append(self.start, starts), np.append(self.length, counts), np.concatenate([self.flat, *chunks])

    def codes(self, texts: list[str | None]) -> list[np.ndarray]:
        """The words of each text, as places in start and length."""
        if len(self.code) > MAX_WORDS:
            self.forget()
        out, new = [], []
        code = self.code
        for x in texts:
            words = self.find(x) if x else []
            for w in words:
                if w not in code:
                    code[w] = len(code)
                    new.append(w)
            out.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
        if new:
            self._learn(new)
        return out

    def gather(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and all ids one after the other."""
        c = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        n = self.length[c]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = self.flat[np.repeat(self.start[c] - ends[:-1], n) + np.arange(ends[-1])]
        return ends[np.concatenate([[0], np.cumsum([len(x) for x in codes])]).astype(np.int64)], flat

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.gather(self.codes(texts))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _over(df: DataFrame, id_col: str, text_col: str, out: str, vocabulary: str, kind: T.DataType, make) -> DataFrame:
    if out == id_col:
        raise ValueError(f"the output column {out!r} would hide the id column")
    picked = df.select(df[id_col].alias("k"), df[text_col].cast("string").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            codes = enc.codes(b.column(1).to_pylist())
            for i in range(0, len(codes), SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, SLICE), make(enc, codes[i : i + SLICE])], [id_col, out])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out, kind)])
    return picked.mapInArrow(run, schema)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, out): out is the list of ids of the text. Results as in the module's docstring."""

    def make(enc: Encoder, codes: list[np.ndarray]) -> pa.Array:
        ends, flat = enc.gather(codes)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    return _over(df, id_col, text_col, out, vocabulary, T.ArrayType(T.IntegerType()), make)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, out): the number of ids that encode_corpus gives; 0 for NULL and empty texts."""
    return _over(df, id_col, text_col, out, vocabulary, T.LongType(), lambda enc, codes: pa.array([int(enc.length[c].sum()) for c in codes], pa.int64()))
