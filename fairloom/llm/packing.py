"""Problem 8: items of varying length into containers of fixed capacity.

Only the histogram of lengths (at most capacity entries of each container kind) reaches the driver. There the lengths are placed longest first,
always onto the group of equally filled packs with the most room left (shortest pack first); a group is a packing pattern with its count, kept as a
range of container numbers. A second plan with the fullest fitting pack first is made from the same histogram, and the one that needs fewer
containers is used. The documents then look up their place by their rank among the documents of the same length.

Defined results: an item longer than the capacity is cut into full pieces and one rest; no other item is cut. Items of length 0 (NULL and empty
texts) take no room: one row, piece 0, container NULL. Repeated rows are items of their own. Kinds with a NULL or non-positive capacity hold nothing
and give no rows. Empty inputs give empty tables.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairloom.session import broadcast_if_small, stage

#: Documents of one length that one task ranks; more are split by hash. Kinds of containers that are taken.
RANK_ROWS, MAX_KINDS = 500_000, 1000


def plan_packs(histogram: dict[int, int], capacity: int, shortest_first: bool = True) -> tuple[np.ndarray, int]:
    """Places for count items of each length: rows (length, first rank, items, first container, offset), and the number of containers.

    Item number first rank + i lies in container first container + i at the given offset.
    """
    rooms: list[int] = []  # the distinct rooms left, ascending
    packs: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first container, count)
    out, made = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room:
            if room not in packs:
                bisect.insort(rooms, room)
                packs[room] = []
            packs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left > 0:
            i = len(rooms) - 1 if shortest_first else bisect.bisect_left(rooms, length)
            if not rooms or i >= len(rooms) or rooms[i] < length:
                fit = capacity // length  # no pack has room: new ones, each with as many of this length as fit
                n = -(-left // fit)
                for j in range(fit):
                    k = min(n, left)
                    if k:
                        out.append((length, rank, k, made, j * length))
                        rank, left = rank + k, left - k
                    if k < n:  # the last round does not reach every new pack
                        put(capacity - j * length, made + k, n - k)
                        n = k
                if n:
                    put(capacity - fit * length, made, n)
                made = max(made, out[-1][3] + out[-1][2], *(o[3] + o[2] for o in out[-fit:]))
                break
            room = rooms[i]
            first, count = packs[room].pop()
            if not packs[room]:
                del packs[room], rooms[i]
            k = min(count, left)
            out.append((length, rank, k, first, capacity - room))
            if k < count:
                put(room, first + k, count - k)
            put(room - length, first, k)
            rank, left = rank + k, left - k
    return np.array(out, dtype=np.int64).reshape(-1, 5), made


def best_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int, str]:
    a, b = plan_packs(histogram, capacity), plan_packs(histogram, capacity, False)
    return (*a, "shortest") if a[1] <= b[1] else (*b, "longest")


class Packing:
    """The packing of sizes (id_col, size_col) into the containers (kind_col, capacity_col); see the module's docstring."""

    def __init__(self, sizes: DataFrame, containers: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", kind_col: str = "kind_id", capacity_col: str = "capacity_tokens"):
        self.id_col, self.kind_col = id_col, kind_col
        self.id_type, self.kind_type = sizes.schema[id_col].dataType, containers.schema[kind_col].dataType
        rows = containers.select(kind_col, F.col(capacity_col).cast("long")).where(f"`{capacity_col}` > 0").distinct().limit(MAX_KINDS + 1).collect()
        if len(rows) > MAX_KINDS:
            raise ValueError(f"more than {MAX_KINDS} kinds of containers")
        self.kinds = sorted((tuple(r) for r in rows), key=str)
        self.sizes = stage(sizes.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("n")))
        self.histogram = stage(self.sizes.where("n > 0").groupBy("n").agg(F.count("*").alias("c")))
        kind = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("cap")) for i, (_, c) in enumerate(self.kinds)])) if self.kinds else None
        self.plans: list[tuple[np.ndarray, int, str]] = []
        self.lengths: list[dict[int, int]] = []
        self.parts = None
        if kind is not None:
            h = self.histogram.select("n", "c", kind.alias("s")).select("n", "c", "s.k", "s.cap").withColumn("q", F.expr("(n - 1) div cap")).withColumn("r", F.col("n") - F.col("q") * F.col("cap"))
            self.parts = h
            self.lengths = [{} for _ in self.kinds]
            for k, r, c in h.groupBy("k", "r").agg(F.sum("c")).collect():  # at most capacity rows of each kind
                self.lengths[k][r] = c
            self.full = dict(h.groupBy("k").agg(F.sum(F.col("q") * F.col("c"))).collect())
            self.plans = [best_plan(x, cap) for x, (_, cap) in zip(self.lengths, self.kinds)]

    def _schema(self) -> T.StructType:
        return T.StructType([T.StructField(self.kind_col, self.kind_type), T.StructField(self.id_col, self.id_type), *(T.StructField(c, T.LongType()) for c in ("piece_no", "first_token", "n_tokens", "container_no", "first_slot"))])

    def assignments(self) -> DataFrame:
        """One row for each piece: its kind, document, piece_no, first_token and n_tokens of the text, container_no and first_slot in it."""
        spark = self.sizes.sparkSession
        if not self.kinds:
            return spark.createDataFrame([], self._schema())
        top, rows = self.histogram.agg(F.max("c"), F.count("*")).first()
        h = self.histogram.withColumn("b", F.expr(f"(c - 1) div {RANK_ROWS} + 1"))
        ranked = self.sizes.where("n > 0").join(broadcast_if_small(h.select("n", "b"), rows), "n").withColumn("b", F.expr("pmod(xxhash64(id), b)"))
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("n", "b").orderBy("id")) - F.lit(1).cast("long"))
        if (top or 0) > RANK_ROWS:  # only lengths so frequent have more than one bucket
            hot = self.sizes.join(F.broadcast(h.where("b > 1").select("n", "b")), "n").groupBy("n", F.expr("pmod(xxhash64(id), b)").alias("b")).agg(F.count("*").alias("c"))
            before = F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            ranked = ranked.join(hot.select("n", "b", before.alias("o")), ["n", "b"], "left").withColumn("rank", F.col("rank") + F.coalesce("o", F.lit(0)))
        same = Window.partitionBy("k", "r").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        kind = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        offsets = self.parts.select("n", "k", F.coalesce(F.sum("c").over(same), F.lit(0)).alias("o_rest"), F.coalesce(F.sum(F.col("q") * F.col("c")).over(kind), F.lit(0)).alias("o_full"))
        placed = ranked.select("id", "n", "rank").join(broadcast_if_small(offsets, rows * len(self.kinds)), "n").select("id", "n", "rank", "k", "o_rest", "o_full")
        nothing = F.lit(0).cast("long")
        zero = self.sizes.where("n = 0").select("id", "n", nothing.alias("rank"), F.explode(F.sequence(F.lit(0), F.lit(len(self.kinds) - 1))).alias("k"), nothing.alias("o_rest"), nothing.alias("o_full"))
        caps = np.array([c for _, c in self.kinds], np.int64)
        width = int(caps.max()) + 1
        # one sorted key (kind, length) for all plans; within it segments are in order of rank
        segs = np.concatenate([np.column_stack([p[:, 0] + i * width, p[:, 1:]]) for i, (p, _, _) in enumerate(self.plans)])
        segs = segs[np.lexsort((segs[:, 1], segs[:, 0]))]
        first_full = np.array([m for _, m, _ in self.plans], np.int64)
        keys, kind_values, schema = segs[:, 0], [k for k, _ in self.kinds], self._schema()
        group = np.unique(keys, return_index=True)
        kind_arrow = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string()}.get(self.kind_type.typeName())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, rank, k, o_rest, o_full = (np.asarray(b.column(i)).astype(np.int64) for i in range(1, 6))
                cap = caps[k]
                q = np.maximum(n - 1, 0) // cap
                rest = n - q * cap
                row = np.repeat(np.arange(len(n)), q + 1)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(q + 1) - (q + 1), q + 1)
                last = piece == q[row]
                length = np.where(last, rest[row], cap[row])
                box = first_full[k][row] + o_full[row] + rank[row] * q[row] + piece
                slot = np.zeros(len(row), np.int64)
                look = np.flatnonzero(last & (n[row] > 0))
                if len(look):
                    r = row[look]
                    want = k[r] * width + rest[r]
                    at = (o_rest + rank)[r]
                    seg = _segment(keys, segs[:, 1], group, want, at)
                    box[look] = segs[seg, 3] + at - segs[seg, 1]
                    slot[look] = segs[seg, 4]
                empty = n[row] == 0
                kinds = pa.array([kind_values[i] for i in range(len(caps))], type=kind_arrow).take(pa.array(k[row]))
                yield pa.RecordBatch.from_arrays([kinds, b.column(0).take(pa.array(row)), pa.array(piece), pa.array(piece * cap[row]), pa.array(length), pa.array(box, mask=empty), pa.array(slot, mask=empty)], schema.names)

        return placed.unionByName(zero).mapInArrow(run, schema)

    def summary(self) -> DataFrame:
        """One row for each kind: items (pieces), tokens, containers used, the least number that could do, and the share of room used."""
        rows = []
        for i, ((kind, cap), lengths, (_, made, how)) in enumerate(zip(self.kinds, self.lengths, self.plans)):
            full = self.full.get(i) or 0
            tokens, items = sum(n * c for n, c in lengths.items()) + full * cap, sum(lengths.values()) + full
            used = made + full
            rows.append((kind, cap, items, tokens, used, -(-tokens // cap), tokens / (used * cap) if used else None, how))
        schema = T.StructType([T.StructField(self.kind_col, self.kind_type), *(T.StructField(c, T.LongType()) for c in ("capacity", "items", "tokens", "containers", "least_containers")), T.StructField("fill", T.DoubleType()), T.StructField("order_used", T.StringType())])
        return self.sizes.sparkSession.createDataFrame(rows, schema)


def _segment(keys: np.ndarray, firsts: np.ndarray, group: tuple, want: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the segment of key want that holds rank: the last one of the key whose first rank is not above it."""
    big = int(max(firsts.max(), rank.max())) + 1
    if int(keys[-1]) < (1 << 62) // big:  # key and rank fit in one integer
        return np.searchsorted(keys * big + firsts, want * big + rank, side="right") - 1
    lo = group[1][np.searchsorted(group[0], want)]
    hi = np.append(group[1], len(keys))[np.searchsorted(group[0], want) + 1]
    while np.any(hi - lo > 1):
        mid = (lo + hi) // 2
        up = firsts[mid] <= rank
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return lo
