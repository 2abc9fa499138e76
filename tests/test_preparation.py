"""The core's dealt operators on edge cases and against brute force."""

import json
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairloom.functions.expressions import column_expressions, induce, whole
from fairloom.functions.flooding import Field, Value, correspondences
from fairloom.operators.drift import SchemaDrift, _totals
from fairloom.operators.hot_keys import hot_keys, key_statistics
from fairloom.operators.nested import link, nodes, values_of
from fairloom.operators.profile import ColumnProfile, Rule, issues

CLASH = ["id", "n", "key__", "x", "w", "file", "path", "v__", "k__", "load__"]


def clashing(df):
    """The table with further columns whose names operators could use inside."""
    return df.withColumns({c: F.lit("q") for c in CLASH if c not in df.columns})


# --- hot keys -----------------------------------------------------------------------------------------------------------------------------------------


def _stats_by_hand(rows, points):
    by = defaultdict(list)
    for k, v, *_ in rows:
        by[k].append(v)
    out = {}
    for k, vs in by.items():
        s = sorted(v for v in vs if v is not None and not math.isnan(v))
        q = tuple(s[max((len(s) * p + 9999) // 10000, 1) - 1] for p in points) if s else (None,) * len(points)
        out[k] = (len(vs), len(s), q)
    return out


def test_key_statistics_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(np.round(rng.random(), 5)), 1) for _ in range(4000)] + [("hot", 0.5, 0)] * 500 + [(f"k{i % 40}", float(rng.normal() * 10.0 ** rng.integers(-5, 6)), 1) for i in range(600)]
    rows += [(None, 1.0, 1), (None, None, None), ("nan", float("nan"), 0), ("nan", None, 1), ("inf", float("inf"), 1), ("inf", float("-inf"), 1), ("inf", 3.0, 0), ("", 2.0, 1), (" ", -0.0, 1), ("K1", 1.0, 1), ("x" * 9000, 1.0, 1)]
    points = [1, 100, 2500, 5000, 9900, 10000]
    df = clashing(spark.createDataFrame(rows, "key string, value double, hit int")).repartition(7)
    got = {r["key"]: r for r in key_statistics(df, "key", "value", ["hit"], points, steps=16).collect()}
    want = _stats_by_hand(rows, points)
    assert set(got) == set(want)
    for k, (n, m, q) in want.items():
        r = got[k]
        assert (r["n_rows"], r["n_values"], tuple(r[f"p{p}"] for p in points)) == (n, m, q), k
    assert got["inf"]["mean"] == 3.0 and got["inf"]["least"] == -math.inf and got["nan"]["mean"] is None and got["nan"]["rate_hit"] == 0.5
    assert [r["key"] for r in hot_keys(key_statistics(df, "key", "value", points=[]), "key").collect()] == ["hot"]


def test_key_statistics_of_nothing(spark):
    df = spark.createDataFrame([], "key string, value double")
    assert key_statistics(df, "key", "value").count() == 0
    assert hot_keys(key_statistics(df, "key", "value"), "key").count() == 0


# --- profile ------------------------------------------------------------------------------------------------------------------------------------------


def test_expressions_follow_the_evidence(spark):
    c = Counter({"A": 800, "B": 150, "C": 60, "A001": 90, "A002": 40, "F017": 60, "a": 2, "A.": 3, "N/A": 2, "Z9": 1, "": 1, "x" * 5000: 1})
    df = spark.createDataFrame(list(c.items()), "v string, n long")
    ex = column_expressions(df, "v", "n")
    assert ex == ["[A-CF]", "[A-CF][0-27]{3}"]  # one alphabet for the column
    ok = {r["v"] for r in df.where(F.col("v").rlike(whole(ex))).collect()}
    assert ok == {"A", "B", "C", "A001", "A002", "F017"}
    long = spark.createDataFrame([(f"https://site.example/item/{i:07d}", 5) for i in range(200)] + [("word " * 40, 300)], "v string, n long")
    (e,) = column_expressions(long, "v", "n")
    assert e.count("+") == 5 and long.where(F.col("v").rlike(whole([e]))).count() == 200
    ten = spark.createDataFrame([(k, n * 10) for k, n in c.items()], "v string, n long")
    assert column_expressions(ten, "v", "n") == ex  # the same share of noise, the same expressions
    assert induce([], 0) == [] and column_expressions(df.limit(0), "v", "n") == []
    bad = spark.createDataFrame([("A\n",), ("A\r",), ("A",)], "v string")
    assert [r["v"] for r in bad.where(F.col("v").rlike(whole(["A"]))).collect()] == ["A"]
    assert bad.where(F.col("v").rlike(whole([]))).count() == 0


RULES = {"score": Rule(low=0.0, high=1.0), "pred": Rule(binary=True), "code": Rule(pattern=r"\A[AB]\z")}


def test_profile_issues(spark):
    rng = np.random.default_rng(0)
    rows = []
    for load in range(8):
        for i in range(200):
            s, p, c = float(rng.random()), int(rng.random() < 0.5), "AB"[rng.integers(2)]
            if load == 1:
                s = s**3
            if load == 2:
                p = 1 if i < 190 else 0
            if load == 3:
                c = "A"
            if load == 4 and i == 0:
                s, p, c = 1.5, 7, "A\n"
            if load == 5 and i < 17:  # 8.5 %
                s, p, c = float("nan"), None, None
            if load == 6 and i < 16:  # 8 % exactly is no issue
                s = None
            rows.append((load, s, p, c))
    rows += [(7, *r[1:]) for r in rows if r[0] == 7]  # all of it twice
    df = clashing(spark.createDataFrame(rows, "load long, score double, pred int, code string"))
    got = {tuple(r) for r in issues(ColumnProfile(df, "load", RULES, list(RULES)).profile(), "load").collect()}
    want = {(1, "score", "shift"), (2, "pred", "shift"), (3, "code", "shift"), (3, "code", "constant"), (4, "score", "range"), (4, "pred", "range"), (4, "code", "pattern")} | {(5, c, "nulls") for c in RULES}
    assert got == want


def test_found_needs_no_rule_for_codes(spark):
    from fairloom.plans.preparation import RULES as rules

    dev = spark.read.parquet("/root/testdata/sf0.01/dev_sample.parquet")
    flags = [{r["load_id"]: r["n_malformed"] for r in ColumnProfile(dev, "load_id", r, ["sensitive"]).profile().collect()} for r in ({}, rules)]
    assert flags[0] == flags[1] and sum(flags[0].values()) > 0
    codes = dev.groupBy("sensitive").count().where("sensitive is not null")
    assert column_expressions(codes, "sensitive", "count") == ["[A-H]", "[A-H][0-9]{3}"]


def test_common_malformed_codes_stay_malformed(spark):
    rows = [(i % 6, "a123" if i % 6 == 2 and i % 5 == 0 else "AB"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "load long, code string")
    assert len(column_expressions(df.groupBy("code").count(), "code", "count")) == 2  # the malformed shape has an expression
    got = {r["load"]: r for r in ColumnProfile(df, "load", {"code": RULES["code"]}, ["code"]).profile().collect()}
    assert {k: (r["pattern"], r["n_malformed"], r["n_odd"]) for k, r in got.items()} == {k: (k == 2, 100 * (k == 2), 100 * (k == 2)) for k in range(6)}  # but not with the rule


def test_profile_of_y_true(spark):
    from fairloom.plans.preparation import p2_profile

    got = p2_profile(spark, "/root/testdata/sf0.001").where("n_missing < n_rows").collect()
    assert len({r["column_name"] for r in got}) == 8 and all(r["shift"] is not None for r in got if r["column_name"] in ("y_true", "rec_id", "scored_at", "loaded_at"))


def test_gap_bounds_hold_the_exact_gap(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 30, float(np.round(rng.beta(2, 2 + (i % 30) / 12), int(rng.integers(1, 6))))) for i in range(6000)] + [(99, 0.5)] * 300 + [(None, 0.1), (None, 1.0)]
    df = spark.createDataFrame(rows, "load long, score double")
    all_ = np.sort([s for _, s in rows])
    got = {r["load"]: r for r in ColumnProfile(df, "load", {"score": RULES["score"]}, ["score"]).profile().collect()}
    for load in {r[0] for r in rows}:
        own = np.sort([s for k, s in rows if k == load])
        x = np.unique(all_)
        gap = np.abs(np.searchsorted(own, x, "right") / len(own) - np.searchsorted(all_, x, "right") / len(all_)).max()
        r = got[load]
        assert r["shift"] - 1e-9 <= gap <= r["shift_most"] + 1e-9
        assert r["shifted"] == (gap > 0.15), load


def test_profile_of_empty_and_missing(spark):
    df = spark.createDataFrame([], "load long, score double, pred int, code string")
    assert ColumnProfile(df, "load", RULES).profile().count() == 0
    df = spark.createDataFrame([(1, None, None, None), (None, float("nan"), None, None)], "load long, score double, pred int, code string")
    got = ColumnProfile(df, "load", RULES).profile().collect()
    assert len(got) == 6 and all(r["nulls"] and r["shift"] is None and not r["constant"] for r in got)


# --- nested -------------------------------------------------------------------------------------------------------------------------------------------


def _item(**k):
    return {"test": "chi2", "pvalue": 0.5, **k}


def _report(rep=None, dis=None, prox=None):
    return json.dumps({"body": {k: v for k, v in (("representation", rep), ("disparities", dis), ("proxies", prox)) if v is not None}})


def test_sections_in_all_shapes(spark):
    sl = lambda *gs: [{"group": g, "n": 1} for g in gs]
    rows = [
        (1, _report([{"attribute": "s", "counts": {"A": 1}, "slices": sl("a", "b")}, None, {"attribute": "t", "flagged": False, "evidence": {"source": {"slices": {"group": "c"}}}}])),
        (2, _report({"s": {"counts": {"A": 2}, "proportions": {}}, "t": None}, {"f": _item(attribute="s", slices=[None, *sl("a")])})),
        (3, _report(None, {"s": [_item(feature="f"), _item(feature="g", slices=[])]}, {"items": [_item(feature="f", attribute="s")], "count": 1})),
        (4, _report([[_item(attribute="s", flagged=True)], []], json.dumps([_item(attribute="s", feature="f")]), {"s": {"f": {"measure": "eta", "strength": None}}})),
        (5, _report("not json", [], 7)),
        (5, _report("not json", [], 7)),
        (6, None), (7, ""), (8, "{\"body\": {\"proxies\": [{\"attr"), (9, "[1]"), (10, '{"body": null}'), (11, '{"body": {"proxies": NaN}}'),
        (12, _report([{"attribute": "long", "counts": {"x" * 50000: 1}}])),
        (1, _report([{"attribute": "s", "counts": {"A": 1}, "slices": sl("a", "b")}, None, {"attribute": "t", "flagged": False, "evidence": {"source": {"slices": {"group": "c"}}}}])),
    ]
    df = clashing(spark.createDataFrame(rows, "report_id long, payload string"))
    got = sorted(tuple(r) for r in link(nodes(df)).select("report_id", "section", "item_no", "slice_no", "attribute", "feature").collect())
    rep, dis, prox = "representation", "disparities", "proxies"
    assert got == sorted([
        (1, rep, 0, -1, "s", ""), (1, rep, 0, 0, "s", ""), (1, rep, 0, 1, "s", ""), (1, rep, 1, -1, "t", ""), (1, rep, 1, 0, "t", ""),
        (2, rep, 0, -1, "s", ""), (2, dis, 0, -1, "s", "f"), (2, dis, 0, 0, "s", "f"),
        (3, dis, 0, -1, "s", "f"), (3, dis, 1, -1, "s", "g"), (3, prox, 0, -1, "s", "f"),
        (4, rep, 0, -1, "s", ""), (4, dis, 0, -1, "s", "f"), (4, prox, 0, -1, "s", "f"),
        (12, rep, 0, -1, "long", ""),
    ])


def test_intervals_nest_and_values_find_their_slice(spark):
    df = spark.createDataFrame([(1, _report([{"attribute": "s", "flagged": True, "slices": [{"group": "a", "n": 1}, {"group": "b", "n": 2}]}]))], "report_id long, payload string")
    n = nodes(df, values=True)
    rows = n.collect()
    assert sorted(r["pre"] for r in rows) == list(range(len(rows))) and sorted(r["post"] for r in rows) == list(range(len(rows)))
    v = [(r["owner_pre"], r["key"], r["value"]) for r in values_of(n, "slice").orderBy("pre").collect()]
    assert [x[1:] for x in v] == [("group", "a"), ("n", "1"), ("group", "b"), ("n", "2")] and v[0][0] == v[1][0] < v[2][0]
    assert link(nodes(df.limit(0))).count() == 0


# --- drift --------------------------------------------------------------------------------------------------------------------------------------------


def _file(feed, file, seq, *payloads):
    return [(feed, file, seq, p if p is None or isinstance(p, str) else json.dumps(p)) for p in payloads]


def test_changes_of_files(spark):
    base = lambda i, **k: {"meta": {"alpha": 0.05 * (i % 3 + 1), "phase": "0"}, "sum": {"rep_flags": i % 3, "notes": ["see log", "by hand", "partial run"][i % 3], **k}}

    def renamed(i):
        d = base(i)
        d["meta"]["significance"] = d["meta"].pop("alpha")
        d["sum"]["repFlags"] = str(d["sum"].pop("rep_flags"))
        d["notes"] = d["sum"].pop("notes")
        return d

    rows = _file(1, 10, 1, *[base(i) for i in range(5)], None, "{broken", "[1]")
    rows += _file(1, 11, 2, *[base(i, started="2024-01-01T00:00:00Z", empty={}) for i in range(5)])
    rows += _file(1, 13, 4, *[renamed(i) for i in range(5)])  # 3 never came
    rows += _file(2, 20, 1, *[base(i) for i in range(5)]) + _file(2, 21, 2, *[{"meta": {"alpha": None, "phase": 0}, "sum": {"rep_flags": float(i), "notes": "x" * 40000}} for i in range(3)])
    rows += rows[:3]
    df = clashing(spark.createDataFrame(rows, "feed_id long, file_id long, file_seq int, payload string"))
    drift = SchemaDrift(df)
    got = {tuple(r) for r in drift.changes().collect()}
    assert got == {
        (11, "added", "", "sum.started"),
        (13, "removed", "sum.started", ""), (13, "renamed", "meta.alpha", "meta.significance"), (13, "renamed", "sum.notes", "notes"), (13, "removed", "sum.rep_flags", ""), (13, "added", "", "sum.repFlags"),
        (21, "retyped", "meta.phase", "meta.phase"), (21, "retyped", "sum.rep_flags", "sum.rep_flags"),
    }
    out = SchemaDrift(df).unified(["file_id"])
    assert out.count() == len(set(rows))
    assert {c for c in out.columns} == {"file_id", "meta.alpha", "meta.phase", "sum.rep_flags", "sum.notes", "sum.started", "sum.repFlags"}
    late = out.where("file_id = 13").collect()
    assert all(r["meta.alpha"] is not None and r["sum.notes"] is not None for r in late)


def test_drift_of_nothing(spark):
    df = spark.createDataFrame([], "feed_id long, file_id long, file_seq int, payload string")
    assert SchemaDrift(df).changes().count() == 0
    one = spark.createDataFrame([(1, 1, 1, None), (1, 2, 2, "{}"), (None, 3, None, '{"a": 1}')], df.schema)
    assert SchemaDrift(one).changes().count() == 0
    assert SchemaDrift(one).unified(["file_id"]).count() == 3


def _notes(name, files, feed, first, seq=1, start=0):
    """Files of three records with one note each and a number."""
    return [r for f in range(files) for r in _file(feed, first + f, seq + f, *[{"a": {name: ["see log", "by hand", "partial run"][i], "n": 7 * i + start}} for i in range(3)])]


def test_a_name_that_comes_back_keeps_both_fields(spark):
    rows = _notes("note", 3, 1, 10) + _notes("note_text", 3, 1, 20, seq=4)
    rows += _file(1, 30, 7, *[{"a": {"note_text": "by hand", "note": 100 + i, "n": i}} for i in range(3)])
    df = spark.createDataFrame(rows, "feed_id long, file_id long, file_seq int, payload string")
    assert {tuple(r) for r in SchemaDrift(df).changes().collect()} == {(20, "renamed", "a.note", "a.note_text"), (30, "added", "", "a.note")}
    out = SchemaDrift(df).unified(["file_id"])
    assert set(out.columns) == {"file_id", "a.note", "a.note (2)", "a.n"}
    got = {(r["file_id"], r["a.note"], r["a.note (2)"]) for r in out.collect()}
    assert {(30, "by hand", 100 + i) for i in range(3)} <= got and (20, "see log", None) in got and (10, "see log", None) in got


def test_feeds_that_begin_with_different_names_share_a_column(spark):
    rows = _notes("note", 3, 1, 10) + _notes("note_text", 3, 1, 20, seq=4) + _notes("note_text", 3, 2, 40)  # known from the other feed's rename
    rows += [(f, i, s, p.replace('"note_text"', '"noteText"')) for f, i, s, p in _notes("note_text", 2, 3, 60)]  # found by flooding
    df = spark.createDataFrame(rows, "feed_id long, file_id long, file_seq int, payload string")
    out = SchemaDrift(df).unified(["file_id"])
    assert set(out.columns) == {"file_id", "a.note", "a.n"} and out.where("`a.note` is null").count() == 0


def test_wide_numbers_deep_texts_and_repeated_rows(spark):
    deep = '{"a": {"n": 1, "deep": ' + "[" * 1200 + "]" * 1200 + "}}"
    rows = _file(1, 1, 1, '{"a": {"n": 99999999999999999999, "w": 1}}', '{"a": {"n": 3, "w": ' + "9" * 50 + "}}", deep)
    df = spark.createDataFrame(rows + rows, "feed_id long, file_id long, file_seq int, payload string")
    out = SchemaDrift(df).unified(["file_id"])
    kinds = dict(out.dtypes)
    assert kinds["a.n"] == "decimal(38,0)" and kinds["a.w"] == "string" and kinds["a.deep"] == "string"
    assert sorted(int(r["a.n"]) for r in out.collect()) == [1, 3, 99999999999999999999]
    deep = '{"body": {"proxies": ' + "[" * 1200 + '{"attribute": "s", "feature": "f", "test": "t"}' + "]" * 1200 + "}}"
    report = spark.createDataFrame([(1, deep), (2, "[" * 100000)], "report_id long, payload string")
    assert [tuple(r) for r in link(nodes(report)).select("report_id", "attribute", "feature").collect()] == [(1, "s", "f")]


def test_sketches_of_spread_files_agree(spark):
    rows = _file(1, 1, 1, *[{"v": f"text number {i} " + "x" * 300 + str(i)} for i in range(3000)])
    df = spark.createDataFrame(rows, "feed_id long, file_id long, file_seq int, payload string")
    a, b = (sorted(SchemaDrift(df.repartition(n)).fields.first()["values"]) for n in (1, 16))
    assert a == b and len(a) == 256


def _many(name, first, feed=1, seq=1):
    """A file of 3,000 records with names ending in name: a code that is long text but for ten records, amounts of which one is by far the greatest, and a number."""
    codes = [f"c{chr(97 + i)}" for i in range(10)]
    text = lambda i: " ".join("abcdefgh"[(i >> (3 * j)) & 7] * 9 for j in range(4)) + " long words" * 20
    low, top = (1, 5e6) if name == "" else (1.001, 9.0)
    return _file(feed, first, seq, *[{"a": {f"code{name}": codes[i] if i < 10 else text(i), f"amount{name}": top if i == 1500 else low + i / 400, "n": i}} for i in range(3000)])


def test_large_files_are_compared_by_all_their_values(spark):
    rows = _many("", 1) + _file(1, 2, 2, *[{"a": {"codeNew": f"c{chr(97 + i % 10)}", "amountNew": 1.001 + i / 40, "n": i}} for i in range(300)])
    rows += _many("", 3, 2) + _many("New", 4, 2, 2) + _file(3, 5, 1, {"b": 1})
    df = spark.createDataFrame(rows, "feed_id long, file_id long, file_seq int, payload string").repartition(6)
    drift = SchemaDrift(df)
    amount = {(f, "removed", "a.amount", "") for f in (2, 4)} | {(f, "added", "", "a.amountNew") for f in (2, 4)}  # 5e6 against less than 10
    assert {tuple(r) for r in drift.changes().collect()} == {(2, "renamed", "a.code", "a.codeNew"), (4, "renamed", "a.code", "a.codeNew")} | amount
    # totals and shared values are those of all values
    keyed = drift.fields.select(F.col("file").alias("key"), F.col("path").alias("field"), "*")
    whole, common = drift._whole(keyed, keyed, spark.createDataFrame([(2, 1), (4, 3), (5, 3)], "key long, before long"))
    of = defaultdict(set)
    for _, f, _, p in rows:
        for k, v in json.loads(p)["a" if f != 5 else "b"].items() if f != 5 else []:
            of[f, f"a.{k}"].add(Value.of(v if isinstance(v, str) else json.dumps(v), None if isinstance(v, str) else v))
    full = {k: Field(k[1], "", tuple(v)) for k, v in of.items()}
    got = {(r["key"], r["field"]): _totals(r["whole"]) for r in whole.collect()}
    assert set(full) <= set(got) and all(tuple(got[k]) == pytest.approx(tuple(f.totals)) for k, f in full.items())
    shared = {(r["key"], c["old"], c["new"]): (c["values"], c["shapes"]) for r in common.collect() for c in r["common"] if r["key"] != 5}
    for f, b in ((2, 1), (4, 3)):
        for (k, x), (m, y) in ((p, q) for p in full for q in full if p[0] == b and q[0] == f and p[1] != q[1]):
            want = len(full[k, x].hashes & full[m, y].hashes), sum(s & 1 for s in full[k, x].shapes & full[m, y].shapes)
            assert shared.get((f, x, y), (0, 0)) == want
    # feeds too are compared by all values
    feeds = spark.createDataFrame(_many("", 1) + _file(2, 2, 1, *[{"a": {"codeNew": f"c{chr(97 + i)}", "n": i}} for i in range(10)]), "feed_id long, file_id long, file_seq int, payload string")
    assert set(SchemaDrift(feeds).unified(["file_id"]).columns) == {"file_id", "a.code", "a.amount", "a.n"}


def test_correspondences_are_one_to_one():
    old = [Field.of("a.alpha", "number", ("0.1", "0.05")), Field.of("a.flags", "integer", ("0", "1", "2")), Field.of("a.text", "string", ("by hand",))]
    new = [Field.of("b.alpha", "number", ("0.1",)), Field.of("b.flags", "integer", ("1", "0")), Field.of("b.rows", "integer", ("91234", "80000")), Field.of("a.when", "string", ("2024-01-01",))]
    assert correspondences(old, new) == [("a.alpha", "b.alpha"), ("a.flags", "b.flags")]
    assert correspondences(old, new, {("a.flags", "b.flags")}) == [("a.alpha", "b.alpha")]
    assert correspondences([], new) == [] and correspondences(old, old) == []


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found"])
def test_found_queries_have_the_wanted_columns(spark, name):
    import __spark_entry__ as entry

    want = {"p1_found": ["file_id", "change", "old_path", "new_path"], "p2_found": ["load_id", "column_name", "issue"], "p3_found": ["report_id", "section", "item_no", "slice_no", "attribute", "feature"], "p5_found": ["table_name", "key_value"]}
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert df.columns == want[name] and rows and len(set(rows)) == len(rows)
