"""Problem 3: nested records as flat tables, linked by interval labels.

A depth-first walk gives every node of a report its pre-order and post-order number. Node tables per type (items, slices, scalar values) keep these
intervals; a node belongs to the item whose interval contains its own. Within a report sorted by pre-order the containing item is the last one begun
that has not ended, so the link needs one sorted pass and no pairs.

A section may be a list, a list of lists, one object, an object with the list under 'items' beside scalars, an object keyed by the name that its items
lack, or any of these as JSON text. A dict is an item if it states a name (attribute, feature) or holds a scalar result or a table of counts.

Defined results: NULL and invalid texts give no nodes, nor do texts nested deeper than the decoder goes; null items and null slices are skipped; sections that hold no item give none; a name stated
nowhere is ''; a repeated report (same id) is taken once; an empty table gives empty tables. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairloom.functions.json_tree import parse, parse_any

# The sections of a detectors report and the names each one's items have, outermost key first.
SECTIONS = {"representation": ("attribute",), "disparities": ("attribute", "feature"), "proxies": ("attribute", "feature")}
# Keys by which an item is known, those that hold scalars and those that hold an object.
SCALARS = ("attribute", "feature", "test", "measure", "pvalue", "chi2_pvalue", "strength", "flagged")
TABLES = ("counts", "proportions")

NODE_SCHEMA = "id string, section string, kind string, pre int, post int, depth int, key string, value string, attribute string, feature string"


def _is_item(v: dict) -> bool:
    return any(k in v and not isinstance(v[k], (dict, list)) and v[k] is not None for k in SCALARS) or any(isinstance(v.get(k), dict) and all(not isinstance(x, (dict, list)) for x in v[k].values()) for k in TABLES)


def _text(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


class _Walk:
    """One report's nodes; kinds: item, slice, value, object, array."""

    def __init__(self, values: bool):
        self.values, self.pre, self.post, self.out = values, 0, 0, []

    def visit(self, root, section: str) -> None:
        """Walks a section with a stack of its own, as a payload may be nested deeper than Python's calls go."""
        todo: list[tuple] = [(root, section, 1, (), "out")]
        while todo:
            top = todo.pop()
            if len(top) == 2:  # a node whose children are done
                at, row = top
                if at is not None:
                    self.out[at] = (*row[:3], self.post, *row[3:])
                self.post += 1
                continue
            v, key, depth, keys, state = top
            row, children = self._node(v, section, key, depth, keys, state)
            at = None
            if row[1] in ("item", "slice") or self.values:
                at = len(self.out)
                self.out.append(None)
            todo.append((at, row))
            todo += reversed(children)
            self.pre += 1

    def _node(self, v, section: str, key: str, depth: int, keys: tuple[str, ...], state: str) -> tuple[tuple, list[tuple]]:
        """(section, kind, pre, depth, key, value, names), and the children. state: 'out' outside of items, 'in' in an item, 'slices' under an item's slices."""
        kind, names = ("object" if isinstance(v, dict) else "array" if isinstance(v, list) else "value"), (None, None)
        children: list[tuple] = []
        read = parse_any(v) if state == "out" and isinstance(v, str) and section else None
        if isinstance(read, (dict, list)):
            kind, children = "text", [(read, "", depth + 1, keys, state)]
        elif isinstance(v, list):
            children = [(x, "", depth + 1, keys, state) for x in v]
        elif isinstance(v, dict):
            if state == "out" and section and _is_item(v):
                kind, state, names = "item", "in", self._names(v, section, keys)
            if state == "out" and section:
                # keys beside scalars ('items', 'count') name nothing
                named = all(isinstance(x, (dict, list)) or x is None for x in v.values())
                children = [(x, k, depth + 1, (*keys, k) if named and depth else keys, state) for k, x in v.items()]
            else:
                if state == "slices":
                    kind = "slice"
                children = [(x, k, depth + 1, keys, "slices" if k == "slices" else "in" if state == "slices" else state) for k, x in v.items()]
        return (section, kind, self.pre, depth, key, _text(v) if kind == "value" else None, *names), children

    @staticmethod
    def _names(v: dict, section: str, keys: tuple[str, ...]) -> tuple[str, str]:
        want = [n for n in SECTIONS[section] if not isinstance(v.get(n), str)]
        given = dict(zip(want, keys[len(keys) - len(want) :] if len(keys) >= len(want) else keys))
        name = lambda n: v[n] if isinstance(v.get(n), str) else given.get(n, "")
        return name("attribute"), name("feature") if "feature" in SECTIONS[section] else ""


def nodes(df: DataFrame, id_col: str = "report_id", text_col: str = "payload", body: str = "body", values: bool = False) -> DataFrame:
    """The nodes of each report with their intervals; without values only items and slices, numbered as if all were there."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for i, text in zip(p["id"], p["x"]):
                v = parse(text)
                b = v.get(body) if v else None
                if not isinstance(b, dict):
                    continue
                w = _Walk(values)
                for section in SECTIONS:
                    if section in b:
                        w.visit(b[section], section)
                out += [(i, *x) for x in w.out]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    kind = df.schema[id_col].dataType
    got = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("x")).mapInPandas(run, NODE_SCHEMA)
    # a report's nodes come together once, and stay where they are for everything below
    return got.repartition("id").dropDuplicates(["id", "pre"]).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def link(all_nodes: DataFrame, id_col: str = "report_id") -> DataFrame:
    """Items and slices with item_no, slice_no (-1 for items) and the names and interval of the item that contains them."""
    n = all_nodes.where(F.col("kind").isin("item", "slice"))
    w = Window.partitionBy(id_col).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    item = F.when(F.col("kind") == "item", F.struct("pre", "post", "section", "attribute", "feature"))
    n = n.withColumn("item", F.last(item, ignorenulls=True).over(w)).withColumn("items", F.count(item).over(w))
    # the last item begun contains the node if it ends after it
    n = n.where((F.col("item.pre") <= F.col("pre")) & (F.col("item.post") >= F.col("post")))
    first = Window.partitionBy(id_col, "section").orderBy("pre")
    n = n.withColumn("item_no", F.col("items") - F.first("items").over(first))
    n = n.withColumn("slice_no", F.row_number().over(Window.partitionBy(id_col, "item.pre").orderBy("pre")) - 2)
    return n.select(id_col, F.col("item.section").alias("section"), F.col("item_no").cast("int").alias("item_no"), F.col("slice_no").cast("int").alias("slice_no"), F.col("item.attribute").alias("attribute"), F.col("item.feature").alias("feature"), F.col("item.pre").alias("item_pre"), F.col("item.post").alias("item_post"), "pre", "post")


def values_of(all_nodes: DataFrame, kind: str, id_col: str = "report_id") -> DataFrame:
    """(id, owner_pre, owner_post, pre, key, value): the scalar values in nodes of a kind, each with the interval of the innermost one that holds it."""
    n = all_nodes.where(F.col("kind").isin(kind, "value"))
    w = Window.partitionBy(id_col).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("kind") == kind, F.struct("pre", "post")), ignorenulls=True).over(w)
    n = n.withColumn("own", own).where((F.col("kind") == "value") & (F.col("own.post") > F.col("post")))
    return n.select(id_col, F.col("own.pre").alias("owner_pre"), F.col("own.post").alias("owner_post"), "pre", "key", "value")
