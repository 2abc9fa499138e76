"""Problem 1: one consistent table from records whose fields change from file to file, and a list of the changes.

Executors read the JSON texts once and give, per file and field, its types and its values, or a sketch of them if it has many; then all are counted by a
second reading of the files that are compared. Each file is compared with the one before it in
its feed. Where fields went and others came, similarity flooding over the two schema graphs (names, types, content, nesting) and a one-to-one choice
find those that live on under another path; two paths that stood side by side in an earlier file of the feed are different fields.

For the table, renames lead every path of a feed back to its field: the first path, or a numbered one where another field came to that path while the
first lives on elsewhere. Fields of different feeds are one if they have one name; a name that other feeds know as a later name of a field, or that
flooding pairs with a field of the most typical feed, is that field, if the two never stand in one file. All files are cast and put together under
these names.

Defined results: NULL and invalid texts give no fields (nor do texts nested deeper than the decoder goes); a field is there if one record has the key,
also with null; a field with only nulls has no type and is never retyped; a field with several types in one file has the widest (whole number <
number < string; else string); whole numbers of more than 64 bits are decimals, of more than 38 digits texts; the first file of a feed has no changes;
a gap in file_seq compares with the nearest earlier file; an empty object is no field; files and rows that repeat count once; empty tables give
empty tables. A table of more than MAX_FIELDS fields is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairloom.functions.flooding import Field, Totals, Value, correspondences, magnitude
from fairloom.functions.json_tree import parse
from fairloom.session import broadcast_if_small, stage

# Sections and containers whose content are no fields.
NO_FIELDS = ("body.representation", "body.disparities", "body.proxies")
NO_FIELD_KEYS = ("by_group", "benchmarks", "metrics", "associations")
#: Distinct values kept of a field in a file, those with the least hashes. Where a field has more, and its file or feed is compared with another, all are
#: read again and counted (_whole). Partial sketches that meet at once; canonical fields a table may have; bits of a magnitude below its bucket.
SKETCH, SPREAD, MAX_FIELDS, BUCKET = 256, 32, 2000, 40
_VALUE = "h:long,size:long,shape:long,chars:long,words:long"


def _fields(root: dict) -> dict:
    """Dotted path -> value, in reading order."""
    out: dict = {}
    todo = [("", root)]
    while todo:
        p, v = todo.pop()
        if isinstance(v, dict):
            inner = [(f"{p}.{k}" if p else k, k, x) for k, x in v.items()]
            todo += [(q, x) for q, k, x in reversed(inner) if q not in NO_FIELDS and k not in NO_FIELD_KEYS]
        else:
            out[p] = v
    return out


def _type(x) -> str:
    return "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "number" if isinstance(x, float) else "string" if isinstance(x, str) else "array"


def _width(x) -> list[str]:
    """Marks beside the type: a whole number of more than 64 bits, of more than 38 digits."""
    return [] if type(x) is not int or -(1 << 63) <= x < 1 << 63 else ["wide"] if abs(x) < 10**38 else ["huge"]


def _values(x) -> set[Value]:
    return {Value.of(_text(y), y if type(y) in (int, float) else None) for y in (x if isinstance(x, list) else [x])}


def _merged(part: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches put together by keys."""
    every = F.array_distinct(F.flatten(F.collect_list("values")))
    m = part.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set("types"))).alias("types"), every.alias("values"), F.max("more").alias("more"))
    return m.select(*keys, "types", F.slice(F.array_sort("values"), 1, SKETCH).alias("values"), (F.col("more") | (F.size("values") > SKETCH)).alias("more"))


def _text(x) -> str:
    if isinstance(x, str):
        return x
    try:
        return json.dumps(x, ensure_ascii=False)
    except RecursionError:  # an array as deep as the decoder goes
        return "[...]"


def _widest(types: list[str]) -> str:
    t = set(types) - {"wide", "huge"}
    return "" if not t else next(iter(t)) if len(t) == 1 else "number" if t == {"integer", "number"} else "string"


class SchemaDrift:
    """Drift over files: feed, file and seq name the columns that place a row's file, text the JSON."""

    def __init__(self, df: DataFrame, feed: str = "feed_id", file: str = "file_id", seq: str = "file_seq", text: str = "payload"):
        self.df, self.names = df, (feed, file, seq, text)
        self.rows = df.select(F.col(feed).alias("feed"), F.col(file).alias("file"), F.col(seq).alias("seq"), F.col(text).alias("x"))
        self.fields = stage(self._schema())
        self.files = stage(self._files())

    def _schema(self) -> DataFrame:
        """(file, path, types, values, more): what a file has; more: it has other values than these."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                seen: dict = {}
                for file, text in zip(p["file"], p["x"]):
                    for path, x in _fields(parse(text) or {}).items():
                        types, values = seen.setdefault((file, path), (set(), set()))
                        if x is not None:
                            types.update((_type(x), *_width(x)))
                            values.update(_values(x))
                rows = [(f, path, sorted(t), [v._asdict() for v in sorted(vs)[:SKETCH]], len(vs) > SKETCH) for (f, path), (t, vs) in seen.items()]
                yield pd.DataFrame(rows, columns=["file", "path", "types", "values", "more"])

        kind = self.rows.schema["file"].dataType.simpleString()
        part = self.rows.select("file", "x").mapInPandas(run, f"file {kind}, path string, types array<string>, values array<struct<{_VALUE}>>, more boolean")
        part = part.withColumn("salt", F.spark_partition_id() % SPREAD)
        for keys in (["file", "path", "salt"], ["file", "path"]):  # a file may be spread over many tasks
            part = _merged(part, keys)
        return part

    def _files(self) -> DataFrame:
        """(feed, file, seq, before): each file and the one before it."""
        f = self.rows.select("feed", "file", "seq").where("file is not null").distinct()
        return f.withColumn("before", F.lag("file").over(Window.partitionBy("feed").orderBy("seq", "file")))

    def _apart(self) -> DataFrame:
        """(file, apart): of the paths (old, new) that went and came with a file, those that an earlier file of its feed has side by side. One pass over each feed's
        schemas, of which only the distinct ones are kept."""
        own = self.fields.groupBy("file").agg(F.collect_list("path").alias("paths"))  # a file's schema, not its rows
        f = self.files.select("feed", "seq", "file").join(own, "file", "left").repartition("feed").sortWithinPartitions("feed", "seq", "file")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, had, seen = None, frozenset(), set()
            for p in parts:
                out = []
                for feed, file, paths in zip(p["feed"], p["file"], p["paths"]):
                    has = frozenset(() if paths is None else paths)
                    if feed != now:
                        now, had, seen = feed, has, set()
                    gone, come = had - has, has - had
                    out.append((file, [{"old": a, "new": b} for a in sorted(gone) for b in sorted(come) if any(a in s and b in s for s in seen)]))
                    seen.add(has)
                    had = has
                yield pd.DataFrame(out, columns=["file", "apart"])

        kind = self.rows.schema["file"].dataType.simpleString()
        return f.select("feed", "file", "paths").mapInPandas(run, f"file {kind}, apart array<struct<old:string,new:string>>").where("size(apart) > 0")

    def _whole(self, own: DataFrame, schemas: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For pairs (key, before) of schemas (key, field, more), and own (key, field, file, path, values, more), what their files have: (key, field, whole), the totals of
        all distinct values of each field, and (key, common), how many values and shapes with digits each two fields of a pair share. Only the pairs that
        need it are looked at: some fields went, others came, and one has more values than a sketch holds. Files with such fields are read once more."""
        has = schemas.groupBy("key").agg(F.collect_set("field").alias("fs"), F.max("more").alias("more"))
        had = has.select(F.col("key").alias("before"), F.col("fs").alias("old"), F.col("more").alias("had_more"))
        pairs = pairs.join(has, "key").join(had, "before").where((F.size(F.array_except("fs", "old")) > 0) & (F.size(F.array_except("old", "fs")) > 0) & (F.col("more") | F.col("had_more")))
        pairs = stage(pairs.select("key", "before"))
        keys = pairs.select("key").union(pairs.select("before")).distinct()
        own = own.join(keys, "key", "left_semi").select("key", "field", "file", "path", "values", "more")
        kind = own.schema["key"].dataType.simpleString()
        places = stage(own.where("more").groupBy("file").agg(F.collect_list(F.struct("path", "key", "field")).alias("places")))
        rows = self.rows.join(broadcast_if_small(places, places.agg(F.sum(F.size("places"))).first()[0] or 0), "file").select("x", "places")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                seen: dict = {}
                for text, places in zip(p["x"], p["places"]):
                    fields = _fields(parse(text) or {})
                    for at in places:
                        if fields.get(at["path"]) is not None:
                            seen.setdefault((at["key"], at["field"]), set()).update(_values(fields[at["path"]]))
                yield pd.DataFrame([(*k, *v) for k, vs in seen.items() for v in vs], columns=["key", "field", *Value._fields])

        again = rows.mapInPandas(run, f"key {kind}, field string, {_VALUE.replace(':', ' ').replace(',', ', ')}")
        kept = own.where("not more").select("key", "field", F.explode("values").alias("v")).select("key", "field", "v.*")
        v = stage(kept.unionByName(again).groupBy("key", "field", "h").agg(*[F.max(c).alias(c) for c in Value._fields[1:]]))
        # the two middle magnitudes: the buckets that hold them are sorted
        by = Window.partitionBy("key", "field")
        bins = v.where("size >= 0").withColumn("bin", F.shiftright("size", BUCKET)).groupBy("key", "field", "bin").agg(F.count("*").alias("c"))
        bins = bins.select("*", F.sum("c").over(by).alias("n"), (F.sum("c").over(by.orderBy("bin")) - F.col("c")).alias("first"))
        bins = bins.where("first + c >= (n + 1) div 2 and first + 1 <= n div 2 + 1")
        middle = v.where("size >= 0").withColumn("bin", F.shiftright("size", BUCKET)).join(bins, ["key", "field", "bin"])
        middle = middle.withColumn("rank", F.col("first") + F.row_number().over(Window.partitionBy("key", "field", "bin").orderBy("size")))
        middle = middle.where("rank in ((n + 1) div 2, n div 2 + 1)").groupBy("key", "field").agg(F.min("size").alias("low"), F.max("size").alias("high"))
        shapes = v.groupBy("key", "field", "shape").agg(F.lit(1).alias("one")).groupBy("key", "field").agg(F.count("*").alias("shapes"), F.max(F.col("shape").bitwiseAND(F.lit(1))).alias("digits"))
        whole = v.groupBy("key", "field").agg(F.count("*").alias("n"), F.max("size").alias("most"), F.sum("chars").alias("chars"), F.sum("words").alias("words"))
        whole = whole.join(shapes, ["key", "field"]).join(middle, ["key", "field"], "left")
        whole = whole.select("key", "field", F.struct("n", "low", "high", "most", "shapes", "digits", "chars", "words").alias("whole"))

        def shared(of: DataFrame, out: str) -> DataFrame:
            """of: (key, field, h), distinct. Values in the same fields of both schemas are counted together before the fields are paired."""
            at = of.groupBy("key", "h").agg(F.sort_array(F.collect_list("field")).alias("new"))
            old = at.select(F.col("key").alias("before"), "h", F.col("new").alias("old"))
            n = at.join(pairs, "key").join(old, ["before", "h"]).groupBy("key", "old", "new").agg(F.count("*").alias("c"))
            n = n.select("key", F.explode("old").alias("old"), "new", "c").select("key", "old", F.explode("new").alias("new"), "c").where("old <> new")
            return n.groupBy("key", "old", "new").agg(F.sum("c").alias(out))

        both = shared(v.select("key", "field", "h"), "values").join(shared(v.where("shape & 1 = 1").select("key", "field", F.col("shape").alias("h")).distinct(), "shapes"), ["key", "old", "new"], "full")
        common = both.groupBy("key").agg(F.collect_list(F.struct("old", "new", F.coalesce("values", F.lit(0)).alias("values"), F.coalesce("shapes", F.lit(0)).alias("shapes"))).alias("common"))
        return stage(whole), stage(common)

    def changes(self) -> DataFrame:
        """(file, change, old_path, new_path), one row per change of a file against the one before."""
        more = self.fields.where("more").limit(1).count() > 0
        whole, common = None, None
        if more:
            keyed = self.fields.select(F.col("file").alias("key"), F.col("path").alias("field"), "*")
            whole, common = self._whole(keyed, keyed, self.files.where("before is not null").select(F.col("file").alias("key"), "before"))
        own = _with_whole(self.fields, whole, "file", "path").groupBy("file").agg(F.collect_list(F.struct("path", "types", "values", "whole")).alias("has"))  # a file's schema, not its rows
        both = self.files.where("before is not null").join(own.select("file", "has"), "file", "left")
        both = both.join(own.select(F.col("file").alias("before"), F.col("has").alias("had")), "before", "left").select("file", "had", "has")
        names = self.names

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = []
                for file, had, has, apart_, common_ in zip(p["file"], p["had"], p["has"], p["apart"], p["common"]):
                    old, new = ({f.path: f for f in _schema_of(xs)} for xs in (had, has))
                    no = {(x["old"], x["new"]) for x in ([] if apart_ is None else apart_)}
                    renamed = correspondences(list(old.values()), list(new.values()), no, _common_of(common_))
                    went, came = {a for a, _ in renamed}, {b for _, b in renamed}
                    out += [(file, "renamed", a, b) for a, b in renamed]
                    out += [(file, "removed", a, "") for a in old if a not in new and a not in went]
                    out += [(file, "added", "", b) for b in new if b not in old and b not in came]
                    out += [(file, "retyped", a, a) for a in old if a in new and old[a].type and new[a].type and old[a].type != new[a].type]
                yield pd.DataFrame(out, columns=[names[1], "change", "old_path", "new_path"])

        kind = self.rows.schema["file"].dataType.simpleString()
        both = _with_common(both.join(self._apart(), "file", "left"), common, "file")
        return both.select("file", "had", "has", "apart", "common").mapInPandas(run, f"{names[1]} {kind}, change string, old_path string, new_path string")

    def _named(self, changes: DataFrame) -> DataFrame:
        """(file, path, field) where they differ: each feed's files in order, one pass, with nothing kept but the current paths."""
        file = self.names[1]
        c = changes.where("change in ('added', 'removed', 'renamed')").groupBy(F.col(file).alias("file")).agg(F.collect_list(F.struct("change", "old_path", "new_path")).alias("cs"))
        f = self.files.select("feed", "file", "seq").join(c, "file", "left").repartition("feed").sortWithinPartitions("feed", "seq", "file")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state = None, {}
            for p in parts:
                out = []
                for feed, file, cs in zip(p["feed"], p["file"], p["cs"]):
                    if feed != now:
                        now, state = feed, {}
                    cs = [] if cs is None else list(cs)
                    moved = {c["new_path"]: state.pop(c["old_path"], c["old_path"]) for c in cs if c["change"] == "renamed"}
                    for c in cs:
                        if c["change"] == "removed":
                            state.pop(c["old_path"], None)
                    state.update(moved)
                    for path in sorted(c["new_path"] for c in cs if c["change"] == "added"):
                        name, k = path, 1
                        taken = {v for q, v in state.items() if q != path}
                        while name in taken:  # the field that had this path first lives on elsewhere
                            k += 1
                            name = f"{path} ({k})"
                        state.pop(path, None)
                        if name != path:
                            state[path] = name
                    out += [(file, a, b) for a, b in state.items() if a != b]
                yield pd.DataFrame(out, columns=["file", "path", "field"])

        kind = self.rows.schema["file"].dataType.simpleString()
        return f.select("feed", "file", "cs").mapInPandas(run, f"file {kind}, path string, field string")

    def _canonical(self) -> DataFrame:
        """(file, path, canonical): the field of each path, by one name over all feeds."""
        named = self.fields.join(stage(self._named(self.changes())), ["file", "path"], "left").withColumn("field", F.coalesce("field", "path"))
        named = stage(named.join(self.files.select("file", "feed"), "file"))
        named = named.withColumn("key", F.to_json(F.struct("feed")))  # a feed may be NULL
        feeds = named.withColumn("salt", F.pmod(F.hash("file"), F.lit(SPREAD)))
        for keys in (["feed", "key", "field", "salt"], ["feed", "key", "field"]):
            feeds = _merged(feeds, keys)
        fields = stage(feeds)
        # the feed whose fields most feeds have
        common = fields.groupBy("field").agg(F.count("*").alias("n"))
        first = fields.join(common, "field").groupBy("feed", "key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "feed").first()
        of_first, whole, shared = first["key"] if first else None, None, None
        if fields.where("more").limit(1).count():
            whole, shared = self._whole(named, fields, fields.select("key", F.lit(of_first).alias("before")).where("key <> before").distinct())
        feeds = stage(_with_whole(fields, whole, "key", "field").groupBy("key").agg(F.collect_list(F.struct(F.col("field").alias("path"), "types", "values", "whole")).alias("has")))
        base = feeds.where(F.col("key") == of_first).select("has").first() if first else None
        base = _schema_of(base[0]) if base else []

        def pair(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield pd.DataFrame([(b, a) for has, c in zip(p["has"], p["common"]) for a, b in correspondences(base, _schema_of(has), common=_common_of(c))], columns=["field", "other"])

        votes = _with_common(feeds, shared, "key").select("has", "common").mapInPandas(pair, "field string, other string")
        votes = votes.unionByName(named.where("path <> field").select(F.col("path").alias("field"), F.col("field").alias("other")))
        votes = votes.where("field <> other").groupBy("field", "other").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field", "other").limit(MAX_FIELDS * 4).collect()
        schemas = named.groupBy("file").agg(F.sort_array(F.collect_set("field")).alias("fs")).select("fs").distinct()
        if votes:
            every = F.array(*[F.struct(F.lit(v["field"]).alias("a"), F.lit(v["other"]).alias("b")) for v in votes])
            both = schemas.select(F.explode(F.filter(every, lambda v: F.array_contains("fs", v["a"]) & F.array_contains("fs", v["b"]))).alias("v")).distinct()
            apart = {(r["v"]["a"], r["v"]["b"]) for r in both.collect()}
        to: dict[str, str] = {}
        root = lambda f: root(to[f]) if f in to else f
        met: dict[str, set[str]] = {}  # names put together must not stand in one file, nor must those put together before
        apart = apart if votes else set()
        for v in votes:
            a, b = root(v["field"]), root(v["other"])
            if a != b and a == v["field"] and not any((x, y) in apart or (y, x) in apart for x in met.get(a, {a}) for y in met.get(b, {b})):
                to[a] = b
                met[b] = met.get(b, {b}) | met.get(a, {a})
        names = [(f, root(f)) for f in to]
        if not names:
            return named.withColumn("canonical", F.col("field"))
        m = F.create_map(*[F.lit(x) for pair_ in names for x in pair_])
        return named.withColumn("canonical", F.coalesce(F.try_element_at(m, F.col("field")), F.col("field")))

    def unified(self, keep: list[str]) -> DataFrame:
        """One table: the columns keep of each row, and a column for each canonical field, cast to the type all its files fit in."""
        f = stage(self._canonical().select("file", "path", "canonical", "types"))
        kinds = f.groupBy("canonical").agg(F.array_distinct(F.flatten(F.collect_set("types"))).alias("types")).limit(MAX_FIELDS + 1).collect()
        if len(kinds) > MAX_FIELDS:
            raise ValueError(f"more than {MAX_FIELDS} fields")
        maps = f.where("path <> canonical").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("path", "canonical"))).alias("names"))
        feed, file, seq, text = self.names
        out_names, taken = {}, {c.lower() for c in keep}
        for r in sorted(kinds, key=lambda r: r[0]):
            n = r[0]
            while n.lower() in taken:  # a field named like a kept column, or two fields that differ only in case
                n += "_"
            taken.add(n.lower())
            whole = "string" if "huge" in r[1] else "decimal(38,0)" if "wide" in r[1] else "long"
            out_names[r[0]] = (n, {"integer": whole, "number": "double", "boolean": "boolean"}.get(_widest(r[1]), "string"))

        @F.pandas_udf("map<string,string>")
        def read(x: pd.Series, m: pd.Series) -> pd.Series:
            def one(text_, names_):
                v = parse(text_)
                if v is None:
                    return None
                to = {} if names_ is None else dict(names_)
                return {to.get(k, k): None if y is None else _text(y) for k, y in _fields(v).items()}

            return pd.Series([one(a, b) for a, b in zip(x, m)])

        rows = self.df.select(*[F.col(c) for c in keep], F.col(file).alias("file__"), F.col(text).alias("x__")).distinct()
        rows = rows.join(maps.withColumnRenamed("file", "m_file__"), F.col("file__") == F.col("m_file__"), "left")
        rows = rows.select(*keep, read("x__", "names").alias("v__"))
        return rows.select(*keep, *[F.try_element_at("v__", F.lit(c)).try_cast(t).alias(n) for c, (n, t) in out_names.items()])


def _with_whole(fields: DataFrame, whole: DataFrame | None, key: str, field: str) -> DataFrame:
    kind = "struct<n:long,low:long,high:long,most:long,shapes:long,digits:long,chars:long,words:long>"
    if whole is None:
        return fields.withColumn("whole", F.lit(None).cast(kind))
    return fields.join(whole.select(F.col("key").alias(key), F.col("field").alias(field), F.col("whole").cast(kind).alias("whole")), [key, field], "left")


def _with_common(schemas: DataFrame, common: DataFrame | None, key: str) -> DataFrame:
    if common is None:
        return schemas.withColumn("common", F.lit(None).cast("array<struct<old:string,new:string,values:long,shapes:long>>"))
    return schemas.join(common.withColumnRenamed("key", key), key, "left")


def _common_of(xs) -> dict[tuple[str, str], tuple[int, int]]:
    return {(x["old"], x["new"]): (x["values"], x["shapes"]) for x in ([] if xs is None else xs)}


def _totals(w) -> Totals:
    number = (lambda c: magnitude(w[c])) if w["low"] is not None else lambda c: 0.0
    return Totals(w["n"], (number("low") + number("high")) / 2, number("most"), w["shapes"], bool(w["digits"]), w["chars"] / w["n"], w["words"] / w["n"])


def _schema_of(xs) -> list[Field]:
    """Fields of rows (path, types, values, whole)."""
    return [Field(x["path"], _widest(list(x["types"])), tuple(Value(*(v[c] for c in Value._fields)) for v in x["values"]), None if x["whole"] is None else _totals(x["whole"])) for x in ([] if xs is None else xs)]
