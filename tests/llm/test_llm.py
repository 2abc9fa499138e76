"""The llm operators on edge cases and against brute force."""

import base64
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairloom.llm import bpe, endings, packing, percentiles, sampling, truncation

CLASH = ["id", "n", "k", "x", "w", "n__", "t__", "k__", "ids", "rank", "how", "b__"]


def clashing(df):
    return df.withColumns({c: F.lit("q") for c in CLASH if c not in df.columns})


# --- 4 ------------------------------------------------------------------------------------------------------------------------------------------------


def _groups(rows):
    by = defaultdict(list)
    for g, v in rows:
        if v is not None and not math.isnan(v):
            by[g].append(v)
    return {g: sorted(v) for g, v in by.items()}


@pytest.mark.parametrize("digits", [percentiles.DIGITS, (12, 4, 16, 32), (8,) * 8])
def test_percentiles_by_hand(spark, digits):
    rng = np.random.default_rng(2)
    rows = [("hot", float(np.round(rng.random(), 4))) for _ in range(3000)] + [("hot", 0.5)] * 700 + [(f"g{i % 20}", float(rng.normal() * 10.0 ** rng.integers(-200, 200))) for i in range(300)]
    rows += [(None, 1.0), (None, None), ("nan", float("nan")), ("inf", float("inf")), ("inf", float("-inf")), ("zero", -0.0), ("zero", 0.0), ("one", 5e-324), ("", 2.0)]
    points = [1, 2500, 5000, 9999, 10000]
    df = clashing(spark.createDataFrame(rows, "grp string, score double")).repartition(5)
    got = {(r["grp"], r["p_bp"]): (r["n"], r["value"]) for r in percentiles.radix_percentiles(df, ["grp"], "score", points, digits).collect()}
    want = {(g, p): (len(v), v[max((len(v) * p + 9999) // 10000, 1) - 1]) for g, v in _groups(rows).items() for p in points}
    assert got == want


def test_states_merge_and_bound(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 7), "ab"[i % 2], float(rng.lognormal())) for i in range(2000)] + [(1, None, 3.0), (2, "a", None)]
    df = spark.createDataFrame(rows, "load long, grp string, score double")
    state = percentiles.percentile_state(df, ["load", "grp"], "score", 20)
    merged = percentiles.merge_states(state, ["grp"])
    again = percentiles.merge_states(percentiles.merge_states(state.where("load < 3"), ["grp"]).unionByName(percentiles.merge_states(state.where("load >= 3"), ["grp"])), ["grp"])
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    exact = {(r["grp"], r["p_bp"]): r["value"] for r in percentiles.radix_percentiles(df, ["grp"], "score", [100, 5000, 9900]).collect()}
    for r in percentiles.percentiles_of_state(merged, ["grp"], [100, 5000, 9900]).collect():
        assert r["lower"] <= exact[r["grp"], r["p_bp"]] <= r["upper"] <= r["lower"] * (1 + 2**-8)
    none = df.limit(0)
    assert percentiles.radix_percentiles(none, ["grp"], "score", [5000]).count() == 0
    assert percentiles.radix_percentiles(df, [], "score", [5000]).count() == 1
    with pytest.raises(ValueError):
        percentiles.radix_percentiles(df, ["grp"], "score", [5000], (8, 8))


# --- 6 ------------------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [200_000, 37])
def test_sample_meets_its_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", bucket)
    rows = [(i, 1, "A" if i % 10 else "B", i % 2) for i in range(1000)] + [(5000 + i, 1, "rare", 1) for i in range(4)] + [(7000 + i, 2, "A", None) for i in range(50)]
    rows += [(8000, 1, None, 1), (None, 1, "A", 1), (9000, None, "A", 1)] + [(i, 1, "A", 1) for i in range(1, 100, 2) if i % 10]
    targets = [(1, 1, 100, "A", 1, 0.5, 0), (1, 1, 100, "B", 0, 0.25, 30), (1, 1, 100, "rare", 1, 0.25, 0), (2, 2, 40, "A", None, 1.0, 5), (3, 99, 10, "A", 1, 1.0, 1), (4, None, 10, "A", 1, None, 2), (5, 1, 10, "A", 0, 0.25, None), (1, 1, 100, "A", 1, 0.5, 0), (6, 1, 10, None, 1, 0.1, 1)]
    df = clashing(spark.createDataFrame(rows, "rec_id long, load_id long, sensitive string, y_true int")).repartition(6)
    t = clashing(spark.createDataFrame(targets, "plan_id long, load_id long, sample_size int, sensitive string, y_true int, target_share double, min_rows int"))
    s = sampling.StratifiedSample(df, t, ["sensitive", "y_true"])
    rep = {(r["plan_id"], r["sensitive"], r["y_true"]): (r["wanted"], r["available"], r["drawn"], r["unmet"]) for r in s.report().collect()}
    assert rep == {
        (1, "A", 1): (50, 500, 50, False), (1, "B", 0): (30, 100, 30, False), (1, "rare", 1): (25, 4, 4, True), (2, "A", None): (40, 50, 40, False), (3, "A", 1): (10, 0, 0, True),
        (4, "A", 1): (2, 0, 0, True), (5, "A", 0): (2, 400, rep[5, "A", 0][2], False), (6, None, 1): (1, 1, 1, False),
    }
    assert rep[5, "A", 0][2] in (2, 3)
    drawn = [tuple(r) for r in s.drawn().collect()]
    assert len({(r[0], r[4]) for r in drawn}) == len(drawn)
    assert sorted(drawn, key=str) == sorted((tuple(r) for r in sampling.StratifiedSample(df.repartition(3), t, ["sensitive", "y_true"]).drawn().collect()), key=str)
    assert Counter(r[5] for r in drawn if r[0] == 1 and r[2] == "B")["floor"] in (5, 6)


def test_every_record_has_the_same_chance(spark):
    df = spark.createDataFrame([(i, 1, "A") for i in range(40)], "rec_id long, load_id long, c string")
    t = spark.createDataFrame([(1, 1, 10, "A", 1.0, 0)], "plan_id long, load_id long, sample_size int, c string, target_share double, min_rows int")
    hits = Counter(r["rec_id"] for seed in range(12) for r in sampling.StratifiedSample(df, t, ["c"], seed=seed).drawn().collect())
    assert sum(hits.values()) == 120 and max(hits.values()) <= 9 and len(hits) >= 34


def test_sample_of_nothing(spark):
    df = spark.createDataFrame([], "rec_id long, load_id long, c string")
    t = spark.createDataFrame([], "plan_id long, load_id long, sample_size int, c string, target_share double, min_rows int")
    s = sampling.StratifiedSample(df, t, ["c"])
    assert s.drawn().count() == 0 and s.report().count() == 0


# --- 7 ------------------------------------------------------------------------------------------------------------------------------------------------

TEXTS = ["", "Hello world, it's 12345 o'clock!", "a" * 5000, " " * 700 + "x", "<|endoftext|> as text", "\n\n  \t", "naïve café – Grüße 日本語" * 9, "🙂🚲👩‍🔧", "\x00\x07 ÿ", "日本" * 700, "-" * 3000, "ab​cd", None, "dup", "dup"]


@pytest.fixture(scope="module")
def oracle():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_public_library(spark, oracle):
    df = clashing(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).repartition(3)
    got = sorted((r["doc_id"], r["out"]) for r in bpe.encode_corpus(df, out="out").collect())
    assert got == [(i, oracle.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)]
    assert sorted(map(tuple, bpe.token_counts(df).collect())) == [(i, len(x)) for i, x in got]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_corpus(df, out="doc_id")


def test_query_and_heap_agree_and_forgetting_changes_nothing(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 3)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 40)
    e, rng = bpe.Encoder(bpe.VOCABULARY), np.random.default_rng(0)
    for _ in range(20):
        texts = ["".join(rng.choice(list("abcdeé 1-\n"), 60)) for _ in range(3)]
        ends, flat = e.encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [oracle.encode_ordinary(t) for t in texts]
        for w in (t.encode() for t in texts):
            n, ids = e._by_query([w])
            assert ids.tolist() == e._by_heap(w) and n[0] == len(ids)


# --- 8 ------------------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plans_fill_without_overlap(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.choice([1, 7, 64, 300]))
    h = {int(k): int(rng.integers(1, 30)) for k in rng.integers(1, cap + 1, 20)}
    for first in (True, False):
        segs, made = packing.plan_packs(h, cap, first)
        used, ranks = defaultdict(int), Counter()
        slots = set()
        for length, rank, k, box, off in segs.tolist():
            for i in range(k):
                ranks[length, rank + i] += 1
                used[box + i] += length
                slots |= {(box + i, s) for s in range(off, off + length)}
        assert set(ranks.values()) == {1} and len(ranks) == sum(h.values())
        assert len(slots) == sum(k * v for k, v in h.items()) and max(used.values()) <= cap and set(used) == set(range(made))


@pytest.mark.parametrize("rows", [500_000, 50])
def test_packing_of_documents(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "RANK_ROWS", rows)
    rng = np.random.default_rng(1)
    sizes = [(i, int(x)) for i, x in enumerate(rng.integers(1, 40, 400))] + [(1000, 0), (1001, None), (1002, 64), (1003, 65), (1004, 128), (1005, 1000), (7, 3), (7, 3)] + [(2000 + i, 5) for i in range(170)]
    kinds = [(1, 64), (2, 200), (3, None), (4, 0)]
    p = packing.Packing(clashing(spark.createDataFrame(sizes, "doc_id long, n_tokens long")).repartition(4), clashing(spark.createDataFrame(kinds, "kind_id int, capacity_tokens int")))
    got = p.assignments().collect()
    for kind, cap in kinds[:2]:
        mine = [r for r in got if r["kind_id"] == kind]
        assert sum(r["n_tokens"] for r in mine) == sum(n or 0 for _, n in sizes)
        assert Counter(r["doc_id"] for r in mine if r["piece_no"] == 0) == Counter(i for i, _ in sizes)
        slots = [(r["container_no"], s) for r in mine if r["n_tokens"] for s in range(r["first_slot"], r["first_slot"] + r["n_tokens"])]
        assert len(slots) == len(set(slots)) and max(s for _, s in slots) < cap
        for r in mine:
            n = dict(sizes)[r["doc_id"]] or 0
            assert r["piece_no"] == 0 or n > cap  # only what is longer than the capacity is cut
            assert (r["container_no"] is None) == (r["n_tokens"] == 0)
        s = {r["kind_id"]: r for r in p.summary().collect()}[kind]
        boxes = {r["container_no"] for r in mine if r["n_tokens"]}
        assert boxes == set(range(s["containers"])) and s["least_containers"] <= s["containers"] <= s["least_containers"] * 1.1 + 2


def test_packing_of_nothing(spark):
    sizes, kinds = spark.createDataFrame([], "doc_id long, n_tokens long"), spark.createDataFrame([(1, 10)], "kind_id int, capacity_tokens int")
    assert packing.Packing(sizes, kinds).assignments().count() == 0
    one = spark.createDataFrame([("a", 3)], "doc_id string, n_tokens long")
    assert packing.Packing(one, kinds.limit(0)).assignments().count() == 0
    assert [r["container_no"] for r in packing.Packing(one, kinds).assignments().collect()] == [0]


# --- 9 ------------------------------------------------------------------------------------------------------------------------------------------------

SENTENCE = "The kitchen on floor {} is closed until {}, so please use the one near the stairs and tell {} about it."
HEAD = "From: Ann Bee <ann@x.example>\nTo: cee@y.example\nSubject: floors\n"


def _mail(i: int, n: int = 4) -> str:
    days, names = ["Monday", "Tuesday", "Friday"], ["Anna", "Boris", "Chloe", "Dora"]
    return "Hello,\n\n" + "\n\n".join(SENTENCE.format(i * 7 + j, days[(i + j) % 3], names[(i * j) % 4]) for j in range(n)) + "\n\nBest,\n" + names[i % 4]


CASES = {
    1: (_mail(1), False), 2: (_mail(2)[:-40], True), 3: (_mail(3)[:150], True), 4: ("Received, thanks", False), 5: (None, False), 6: ("", False), 7: (" \n\t ", False), 8: ("ok", False),
    9: (HEAD + "\n" + _mail(4), False), 10: (HEAD[:-10], True), 11: (HEAD + "Content-Type: multipart/mixed; boundary=\"b123456789\"\n\n--b123456789\nContent-Type: text/plain\n\nWe are done.\n", True),
    12: (HEAD + "Content-Type: multipart/mixed; boundary=\"b123456789\"\n\n--b123456789\nContent-Type: text/plain\n\nWe are done\n--b123456789--\n", False), 13: ("<html><p>We are done.</p>", True), 14: ("<html>We are done</html>", False),
    15: ("Points:\n- the kitchen is closed until Monday\n- tell Anna about it", False), 16: ("| a | b |\n| 1 | 2 |\n| 3 | 4 |", False), 17: ("Yes.\n\n> " + _mail(5).replace("\n", "\n> "), False), 18: ("word " * 30000 + "end.", False), 19: (_mail(6)[:200] + "...", True), 20: (_mail(7) + "\n\nThat is all for now...", False),
    21: ("That is all for now...", False), 22: ("So long.\n\nThat is all for now...", False),
}


def test_truncated_texts(spark):
    filler = [(100 + i, _mail(i + 10, 3), "s") for i in range(60)] + [(200 + i, "ok", "s") for i in range(3)] + [(300 + i, "Received, thanks", "t") for i in range(4)]
    rows = [(i, t, "s" if i % 2 else None) for i, (t, _) in CASES.items()] + filler + [(1, CASES[1][0], "s")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string")).repartition(4)
    t = truncation.Truncation(df)
    judged = t.judged().collect()
    got = {r["doc_id"]: r["truncated"] for r in judged}
    assert len(judged) == len(got)
    assert {i: got.get(i, False) for i in CASES} == {i: v for i, (_, v) in CASES.items()}
    assert not any(got[i] for i in got if i >= 100)
    rates = {r["source"]: r for r in t.rates().collect()}
    assert rates[None]["documents"] == len([i for i in CASES if i % 2 == 0]) and rates["t"]["truncated"] == 0


def _judged(spark, rows) -> dict:
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    return {r["doc_id"]: r["how"] for r in truncation.Truncation(df).judged().collect()}


def test_cut_last_lines_do_not_vouch_for_each_other(spark):
    filler = [(100 + i, _mail(i + 10, 3)) for i in range(60)]
    cut = [(i, f"Hello {i},\n\nall is well on floor {i}.\n\nTh") for i in range(4)]  # 180 longer lines begin so
    short = [(20 + i, f"Hello {i},\n\nwe saw floor {i}.\n\nBest,\nAnna") for i in range(4)]
    got = _judged(spark, filler + cut + short)
    assert {got[i] for i, _ in cut} == {"word"} and {got[i] for i, _ in filler + short} == {"whole"}


def _copies(spark, rows) -> dict:
    t = truncation.Truncation(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string"))
    return {r["id"]: r["copy_cut"] for r in t.copies().collect()}


def test_near_copy_shows_the_cut(spark):
    long = _mail(1, 12)
    cut = long[: long.index("Anna") + 4]
    at = long.rindex("stairs") - 5
    c = _copies(spark, [(1, long), (2, long[:at]), (3, "Fwd:\n\n" + long)] + [(10 + i, _mail(i + 20)) for i in range(10)])
    assert c[2] is True and 1 not in {k for k, v in c.items() if v}
    assert truncation.aligned_end(long[:at], long) == "cut" and truncation.aligned_end(cut, long) == "cut" and truncation.aligned_end(_mail(2), long) == ""
    assert truncation.aligned_end(long, long + "\n\n_____\nlist footer") == "end"
    assert truncation.Truncation(spark.createDataFrame([], "doc_id long, text string, source string")).judged().count() == 0


def test_copies_are_found_behind_others_of_a_bucket(spark):
    long = _mail(1, 12)
    at = long.rindex("stairs") + 3
    hubs = [(10 + k, long + " " + " ".join(f"own{k}x{i}" for i in range(110))) for k in range(60)]  # longest in all buckets
    c = _copies(spark, [*hubs, (1, long), (2, long[:at]), (6, "so it goes on and on in this text until the very last wor"), (7, "so it goes on and on in this text until the very last word")])
    assert c[2] is True and c[6] is True and not c.get(7)


def test_all_answers_of_a_bucket_count(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}x" for i in range(200)]

    def edited(n):
        words = list(base)
        for i in rng.choice(160, n, replace=False):
            words[i] = f"e{rng.integers(1 << 30)}"
        return " ".join(words)

    others = [(100 + i, edited(9)) for i in range(60)]  # of one bucket, with the same thirty last words, but below 0.8
    cut = " ".join(base[:190])[:-1]
    assert not any(truncation.aligned_end(cut, t) for _, t in others)
    one = edited(1)
    c = _copies(spark, [*others, (1, cut), (2, one)])
    assert truncation.aligned_end(cut, one) == "cut" and c[1] is True
    # texts of the same words but other lines are different answers, wherever their id is
    lines = " ".join(base[:190]) + "\n" + " ".join(base[190:])
    short = " ".join(base[:190])
    assert truncation.aligned_end(short, lines) == "end"
    for ids in ((1, 2, 3), (3, 2, 1)):
        c = _copies(spark, list(zip(ids, (lines, short, " ".join(base)))))
        assert c == {2: True}


def test_sets_differ_at_least_by_their_parities():
    rng = np.random.default_rng(5)
    texts = [[f"w{i}" for i in rng.integers(0, m, 120)] for m in (3, 20, 1000)] + [["a"] * 120, [f"w{i}" for i in range(120)], [f"w{i}" for i in range(100)] + ["b"] * 20]
    mixed = truncation._mix(np.array([truncation._code(w, {}) for t in texts for w in t], np.uint64))
    _, once, size, *odd = truncation._begun(mixed, truncation._shingles(mixed), np.full(len(texts), 120))
    sets = [[{tuple(t[j : j + 5]) for j in range(k - 4)} for k in range(120)] for t in texts]
    assert size.tolist() == [len(s) for x in sets for s in x] and once[240:360].sum() == 115 and not once[360:480].any()
    bits = lambda i, k, m, j: sum(((int(p[120 * i + k]) ^ int(p[120 * m + j])) & (1 << 64) - 1).bit_count() for p in odd)
    for i, x in enumerate(sets):
        for m, y in enumerate(sets):
            for k, j in ((119, 119), (119, 60), (6, 5), (80, 119)):
                d = len(x[k] ^ y[j])
                assert bits(i, k, m, j) <= d and bits(i, k, m, j) % 2 == d % 2


@pytest.mark.parametrize("lost", [0.05, 0.2, 0.4, 0.6])
def test_planted_copies_are_found_through_judged(spark, lost):
    rng = np.random.default_rng(int(lost * 100))
    pool = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "su", "ta") for b in ("bel", "dor", "fin", "gas", "hul", "jen", "kor")]
    whole = [(i, " ".join(rng.choice(pool, int(rng.integers(150, 300)))) + ".") for i in range(150)]
    planted = []
    for i, t in whole:
        words = t[: int(len(t) * (1 - lost))].split(" ")
        words[int(rng.integers(len(words) // 2))] = "edited"  # a near-copy of similarity above 0.8, no equal beginning
        planted.append((1000 + i, " ".join(words)))
    got = _judged(spark, whole + planted)
    assert sum(got[i] == "copy" for i, _ in planted) >= 0.9 * len(planted) and not any(got[i] == "copy" for i, _ in whole)


def test_one_beginning_of_many_texts_is_no_square(spark):
    same = " ".join(f"w{i}" for i in range(60))
    words = lambda i, n: same + "".join(f" own{i % 1000}x{k}" for k in range(n))
    rows = [(i, words(i, 12)) for i in range(400)] + [(1000 + i, words(i, 6)) for i in range(40)]
    c = _copies(spark, rows)
    assert all(c.get(1000 + i) for i in range(40)) and not any(c.get(i) for i in range(400))


def test_signatures_find_beginnings():
    rng = np.random.default_rng(0)
    pool = [f"w{i}" for i in range(500)]
    a = list(rng.choice(pool, 300))
    texts = [a, a[:200], a, list(rng.choice(pool, 300)), ["one"], [], a[:6]]
    depth, keys, body, tail = truncation.signatures(texts, {})
    assert depth.tolist() == [6, 6, 6, 6, 0, 0, 1] and tail[0] == tail[2] != tail[1]
    size = [min(d, truncation.WHOLE) + max(d - truncation.WHOLE, 0) * truncation.BANDS for d in depth.tolist()]
    at = np.cumsum(size)
    of = lambda i: keys[at[i] - size[i] : at[i]].tolist()
    assert of(0) == of(1) == of(2) and not set(of(0)) & set(of(3)) and of(6) == of(0)[:1]
    assert body[0] == body[2] and len(set(body.tolist())) == 6
    back = truncation.signatures(texts[::-1], {})
    assert back[0].tolist() == depth.tolist()[::-1] and set(back[1].tolist()) == set(keys.tolist())


def test_codes_are_those_of_the_words(monkeypatch):
    texts = ["One, two_2 three.", "", "...", "\n", "Été à Zürich — 東京タワー x", "İstanbul ﬁn 9", "a" * 63 + " " + "b" * 64 + " " + "c" * 65 + " " + "d" * 5000, "ab-c" * 100, "end"]
    for signs in (truncation.SIGNS, 50):  # texts together, and longer ones alone
        monkeypatch.setattr(truncation, "SIGNS", signs)
        codes, n, begin, end = truncation.word_codes(texts, {})
        want = [[(m.group(), m.start(), m.end()) for m in truncation._WORD.finditer(t)] for t in texts]
        assert n.tolist() == [len(x) for x in want] and list(zip(begin.tolist(), end.tolist())) == [x[1:] for w in want for x in w]
        assert codes.tolist() == [zlib.crc32(x[0].encode()) for w in want for x in w]
    assert [len(x) for x in truncation.word_codes([], {})] == [0] * 4


def test_longer_tokens_are_counted_without_interpreted_expressions(spark):
    uses = {w: i + 1 for i, w in enumerate(["a", "ab", "abc", "abcd", "abcde", "abcdef", "b", "bcdx", "\na", "\nab c", "\nab cdefgh", "\nab cdefghi jk\n", "\0xa"])}
    words = ["a", "abc", "abcd", "abcde", "x", "\na", "\nab cdefg", "\nab cdefgh"]
    t = truncation.Truncation.__new__(truncation.Truncation)
    t.uses = spark.createDataFrame(list(uses.items()), "w string, n long")
    w = spark.createDataFrame([(x,) for x in words], "w string")
    p = t._begun(w, w)
    want = {x: sum(n for u, n in uses.items() if u.startswith(x) and u != x) for x in words}
    assert dict(map(tuple, p.collect())) == {x: n for x, n in want.items() if n}
    assert "lambda" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_endings():
    end = lambda t: endings.closing(endings.body_lines(t, endings.header_end(t)))
    assert end("All is well. I will be the") == ("s", "a", "the", "", False) and end("See you.")[:3] == ("h", ".", "you.")
    assert end("one two three four five six seven eight ")[:3] == ("l", "_", "eight") and end("- a point")[0] == "b" and end("so it is, and wha...")[2:] == ("wha", "\nso it is, and wha...", True)
    long = "This line is long enough to be a wrapped one of many"
    assert end(long + "\nand so")[0] == "w" and end(long + "\n   (ref 0123456789abcdef)")[:2] == ("h", ")") and end("お疲れさまです。資料を送りま")[:3] == ("j", "a", "りま")
    left = lambda t: endings.structure(t, endings.header_end(t))[1]
    assert left(HEAD) == "header" and left(HEAD + "\n") == "" and left("<html><p>x") == "html" and left("<html>x</html>") == "closed"
    u = endings.Uses()
    u.add(endings.body_lines("Best,\nAnna\n\nBest,\nAnn", 0), False)
    got = {r[0]: r[1:] for r in u.take()}
    assert got["Best,"] == (2, 0, 2) and got["Anna"] == (1, 0, 1) and got["\nBest,"] == (2, 0, 0) and "Ann" not in got


def test_found_queries(spark):
    import __spark_entry__ as entry

    qs = entry.queries()
    want = {"p6_found": ["plan_id", "sensitive", "y_true"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}
    for name, cols in want.items():
        df = qs[name](spark, "/root/testdata/sf0.001")
        rows = [str(r) for r in df.collect()]
        assert df.columns == cols and rows and len(set(rows)) == len(rows)
