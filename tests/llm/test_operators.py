"""The training-data operators against brute force, and their defined cases."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bin_packing, contributor_cap, crosssplit, grouped_split, junk_pages, mixture, quantile_cut, textforms, tokens
from corpusloom.llm.corpus import records
from corpusloom.llm.oracles import ORACLES
from corpusloom.llm.queries import QUERIES

TARGETS = "speaker_id string, max_records int, keep_pct int"
ROWS = "id string, contributor string, score double, penalty double, extra string"


def test_queries_match_sql(compare, data):
    assert compare(QUERIES, ORACLES, data) == []


def test_queries_without_sql_run(spark, data):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, data).count() > 0, name


# ---- records


def test_records_read_numbers_splits_and_repeats(spark):
    cols = "file_name string, text_normalized string, speaker_id string, dnsmos string, cer string, source_path string, split string, exported_at timestamp"
    base = ("t", "\tSpk_1 ", " 3.5\t", "1.2e-2", "p", " VAL\t")
    rows = [("a", *base, "2024-01-01"), ("a", *base, "2024-01-02"), ("b", None, " ", "3,5", "nan", None, "", "2024-01-01"), ("c", "", None, "3", "1e999.0", None, None, "2024-01-01"), (None, *base, "2024-01-01")]
    df = spark.createDataFrame([(*r[:-1], r[-1]) for r in rows], cols.replace("timestamp", "string")).withColumn("exported_at", F.to_timestamp("exported_at"))
    got = {r.file_name: r for r in records(df, "speaker", "split", "dnsmos", "cer").collect()}
    assert len(got) == 3 and (got["a"].speaker, got["a"].split, got["a"].dnsmos, got["a"].cer) == ("spk_1", "val", 3.5, 0.012)
    assert (got["b"].speaker, got["b"].split, got["b"].dnsmos, got["b"].cer) == (None, "train", None, None)
    assert got["c"].dnsmos is None and got["c"].cer is None


# ---- 1


def brute_cap(rows, caps):
    by = collections.defaultdict(list)
    for i, who, score, penalty, _ in rows:
        if who is not None:
            by[who].append((-score if score is not None else math.inf, penalty if penalty is not None else math.inf, i))
    out = set()
    for who, items in by.items():
        cap = caps.get(who, caps.get("*"))
        if cap is not None:
            out |= {i for _, _, i in sorted(items)[max(cap, 0) :]}
    return out


def test_cap_matches_sorting(spark):
    rnd = random.Random(1)
    rows = [(f"f{i:05d}", rnd.choice(["hot", "hot", "hot", "a", "b", None, "zero"]), rnd.choice([None, 1.0, 2.0, 2.5]), rnd.choice([None, 0.1, 0.2]), "x") for i in range(3000)]
    caps = {"hot": 40, "zero": 0, "b": None, "*": 7}
    df = spark.createDataFrame(rows, ROWS).repartition(9)
    targets = spark.createDataFrame([(k, v, 50) for k, v in caps.items()], TARGETS)
    got = {r.id for r in contributor_cap.cut_records(df, targets).collect()}
    want = brute_cap(rows, {k: v for k, v in caps.items()})
    assert got == want - {i for i, who, *_ in rows if who == "b"}
    assert contributor_cap.kept_records(df, targets).count() == len(rows) - len(got)
    kept = contributor_cap.kept_records(df.withColumn("target", F.lit("x")), targets)
    assert kept.columns == [*df.columns, "target"] and {r.id for r in kept.select("id").collect()} == {r[0] for r in rows} - got
    clash = df.withColumns({"target": F.lit(0), "cap": F.lit(0), "heap": F.lit("x"), "_k": F.lit(1)})
    assert contributor_cap.cut_records(clash, targets).count() == len(got)


def test_heaps_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(contributor_cap, "MERGE_FAN", 2)
    df = spark.createDataFrame([(f"f{i:04d}", "hot", float(i % 97), None, "x") for i in range(1000)], ROWS).repartition(9)
    got = {r.id for r in contributor_cap.best_records(df, spark.createDataFrame([("*", 13, 1)], TARGETS)).collect()}
    assert got == {f"f{i:04d}" for i in sorted(range(1000), key=lambda i: (-(i % 97), f"f{i:04d}"))[:13]}


def test_cap_without_targets_or_rows(spark):
    df = spark.createDataFrame([("a", "s", 1.0, None, "x")], ROWS)
    none = spark.createDataFrame([], TARGETS)
    assert contributor_cap.cut_records(df, none).count() == 0
    assert contributor_cap.cut_records(df.where("false"), spark.createDataFrame([("*", 1, 1)], TARGETS)).count() == 0


# ---- 2


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def near(a, b):
    x, y = crosssplit.words(a), crosssplit.words(b)
    return bool(x and y) and (5 * distance(x, y) <= max(len(x), len(y)) or "".join(x) == "".join(y))


def test_bit_parallel_distance():
    import numpy as np

    rnd = random.Random(2)
    for _ in range(3000):
        a = [rnd.randrange(5) for _ in range(rnd.randrange(12))]
        b = [x if rnd.random() < 0.8 else rnd.randrange(5) for x in a] + [1] * rnd.randrange(2)
        d = distance(a, b)
        for limit in range(6):
            assert crosssplit.edits_within(np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes(), limit) == (d <= limit)


def overlap_pairs(spark, rows):
    df = spark.createDataFrame(rows, "file string, split string, text string")
    coded = crosssplit.coded_texts(df, "file", "split", "text")
    return {(r.train_file, r.eval_file) for r in crosssplit.overlaps(coded, ["val", "test"]).collect()}


def test_overlaps_match_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    train, held = [], []
    for i in range(150):
        n = rnd.choice([3, 5, 6, 8, 11, 15, 20, 26, 30, 40, 60])
        text = [rnd.choice(vocabulary) for _ in range(n)]
        train.append((f"t{i}", "train", " ".join(text)))
        for k in range(2):
            other = list(text)
            for _ in range(int(n * rnd.choice([0, 0.05, 0.1, 0.12, 0.3]))):
                at = rnd.randrange(len(other))
                other[at : at + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [other[at], "new"]])
            held.append((f"e{i}_{k}", rnd.choice(["val", "test"]), " ".join(other).upper() + "!"))
    want = {(a, b) for a, _, x in train for b, _, y in held if near(x, y)}
    assert overlap_pairs(spark, train + held) == want and len(want) > 100


def test_short_texts_lose_no_pair_at_a_fifth(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, want = [], set()
    for i in range(200):
        n = rnd.randrange(5, 31)
        text = [rnd.choice(vocabulary) for _ in range(n)]
        other = list(text)
        for at in rnd.sample(range(n), n // 5):
            other[at] = f"x{at}"
        rows += [(f"t{i}", "train", " ".join(text)), (f"e{i}", "val", " ".join(other))]
        want.add((f"t{i}", f"e{i}"))
    assert overlap_pairs(spark, rows) == want


def test_longer_texts_at_the_limit(spark):
    rnd = random.Random(11)
    rows, want = [], set()
    for i in range(300):
        n = rnd.randrange(31, 110)
        text = [f"w{rnd.randrange(3000)}" for _ in range(n)]
        other = list(text)
        for at in rnd.sample(range(n), n // 5 if i % 2 else int(n * 0.1)):
            other[at] = f"x{at}"
        rows += [(f"t{i}", "train", " ".join(text)), (f"e{i}", "test", " ".join(other))]
        want.add((f"t{i}", f"e{i}"))
    got = overlap_pairs(spark, rows)
    assert got <= want and len(got) >= 0.98 * len(want)
    assert {p for p in want if int(p[0][1:]) % 2 == 0} <= got  # a tenth of edits


def test_no_length_loses_a_pair_at_a_fifth(spark):
    rnd = random.Random(12)
    rows, want = [], set()
    for i, n in enumerate([*range(5, 125), 300, 511, 512, 513, 1300]):
        text, new = [f"w{i}_{j}" for j in range(n)], iter(f"x{i}_{j}" for j in range(n))
        spread, dropped, grown = list(text), list(text), list(text)
        for at in range(4, n, 5):  # every fifth word: no five unchanged words in a row
            spread[at] = next(new)
        del dropped[4::5]
        for at in range(n // 4 * 4, 0, -4):
            grown.insert(at, next(new))
        mixed = list(text)
        for at in rnd.sample(range(n), n // 5):
            mixed[at] = next(new)
        rows.append((f"t{i}", "train", " ".join(text)))
        for k, other in enumerate((spread, dropped, grown, mixed)):
            rows.append((f"e{i}_{k}", "val", " ".join(other)))
            want.add((f"t{i}", f"e{i}_{k}"))
    han = [chr(0x4E00 + j) for j in range(40)]
    rows += [("t_zh", "train", "".join(han)), ("e_zh", "test", "".join("龍" if j % 5 == 4 else c for j, c in enumerate(han)))]
    want.add(("t_zh", "e_zh"))
    assert overlap_pairs(spark, rows) == want


def test_chosen_runs_are_disjoint_and_enough():
    import numpy as np

    rnd = np.random.default_rng(5)
    sizes = np.array([*range(0, 70), 255, 256, 511, 512, 700, 1100])
    toks = [rnd.integers(0, 1 << 31, n, dtype=np.int32).tobytes() for n in sizes]
    found, starts, hashes = crosssplit._runs(toks)
    seen = rnd.integers(1, 50, 1 << crosssplit.SKETCH_BITS[0]).astype(np.int32)
    chosen, text = crosssplit._chosen_runs(found, starts, hashes, seen)
    where = {int(x): (i, k) for k, h in zip(crosssplit.RUNS, hashes) for i, x in enumerate(h)}
    for t, n in enumerate(sizes):
        spans = sorted(where[int(h)] for h in chosen[text == t])
        assert len(spans) == (n // 4 + 1 if n >= 4 else 0)
        assert all(i + k <= j for (i, k), (j, _) in zip(spans, [*spans[1:], (starts[t] + n, 0)]))


def test_overlap_cases(spark):
    long = " ".join(f"từ{i}" for i in range(20_000))
    rows = [
        ("t1", "train", "Xin chào, các bạn!"), ("e1", "val", "xin chào các bạn"), ("e2", "val", "xinchào các bạn"), ("e3", "test", None), ("t2", "train", "  "),
        ("e4", "val", "..."), ("t3", "train", "Cỏ xanh"), ("e5", "val", "ｃỏ​ xаnh"), ("t4", "train", long), ("e6", "test", long + " thêm"), ("t1", "train", "Xin chào, các bạn!"),
    ]
    assert overlap_pairs(spark, rows) == {("t1", "e1"), ("t1", "e2"), ("t3", "e5"), ("t4", "e6")}
    assert overlap_pairs(spark, [("t1", "train", "một hai")]) == set()


def test_hot_blocks_are_salted_without_loss(spark, monkeypatch):
    monkeypatch.setattr(crosssplit, "HOT", 5)
    monkeypatch.setattr(crosssplit, "_SALTS", 3)
    intro = " ".join(f"intro{i}" for i in range(12))
    rows = [(f"t{i}", "train", f"{intro} a{i} b{i} c{i}") for i in range(40)] + [(f"e{i}", "val", f"{intro} a{i} b{i} d{i}") for i in range(40)]
    want = {(a, b) for a, s, x in rows for b, r, y in rows if s == "train" and r == "val" and near(x, y)}
    assert overlap_pairs(spark, rows) == want


def test_hot_runs_are_told_beyond_what_the_sketch_can_count(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(crosssplit, "_MOST", 4)  # as if every slot were full
    monkeypatch.setattr(crosssplit, "HOT", 50)
    coded = crosssplit.coded_texts(spark.createDataFrame([(f"e{i}", "val", f"một hai ba bốn năm s{i} t{i} u{i}") for i in range(100)], "f string, s string, t string"), "f", "s", "t")
    counts, hot = crosssplit.run_counts(coded.select("toks"))
    assert len(hot) == 9 and len(counts) == 1 << 20  # the runs of two to four words within the five
    decoded = crosssplit._decoded_counts(counts)
    assert decoded.max() == 4 and (decoded > 0).sum() > 300
    exact = np.array([0, 1, 2, 3, 100, 4_000, 10**6, 10**12])
    monkeypatch.setattr(crosssplit, "_MOST", 1 << 22)
    back = crosssplit._decoded_counts(crosssplit._coded_counts(exact))
    assert back[:4].tolist() == [0, 1, 2, 3] and abs(back[4] - 100) < 10 and back[-1] == 1 << 22


def test_a_hot_run_in_short_texts(spark, monkeypatch):
    monkeypatch.setattr(crosssplit, "HOT", 5)
    rows = [(f"t{i}", "train", f"xin chào a{i} b{i} c{i}") for i in range(30)] + [(f"e{i}", "test", f"xin chào a{i} b{i} d{i}") for i in range(30)]
    assert overlap_pairs(spark, rows) == {(f"t{i}", f"e{i}") for i in range(30)}


# ---- 3


def test_cutoffs_match_order_statistics(spark):
    rnd = random.Random(5)
    rows = [(f"r{i}", rnd.choice(["hot"] * 6 + ["a", "b", "one", None]), rnd.choice([None, rnd.gauss(3, 1), round(rnd.gauss(3, 1), 1)])) for i in range(4000)]
    rows += [("z1", "tie", 2.0), ("z2", "tie", 2.0), ("z3", "tie", 2.0), ("z4", "none", None)]
    pct = {"hot": 37, "a": 100, "b": 0, "tie": 34, "*": 70}
    df = spark.createDataFrame(rows, "id string, source string, score double")
    cuts = quantile_cut.score_cutoffs(df, spark.createDataFrame([(k, 1, v) for k, v in pct.items()], TARGETS))
    got = {r.source: (r.cutoff, r.kept) for r in cuts.collect()}
    by = collections.defaultdict(list)
    for _, s, v in rows:
        if s is not None and v is not None:
            by[s].append(v)
    want = {}
    for s, v in by.items():
        k = max(1, -(-pct.get(s, 70) * len(v) // 100))
        t = sorted(v, reverse=True)[k - 1]
        want[s] = (t, sum(x >= t for x in v))
    assert got == want
    assert quantile_cut.kept_by_cutoff(df, cuts).count() == sum(k for _, k in want.values())


def test_cutoffs_of_nothing(spark):
    df = spark.createDataFrame([], "id string, source string, score double")
    assert quantile_cut.score_cutoffs(df, spark.createDataFrame([("*", 1, 50)], TARGETS)).count() == 0
    one = spark.createDataFrame([("a", "s", 1.0)], "id string, source string, score double")
    assert quantile_cut.score_cutoffs(one, spark.createDataFrame([("x", 1, 50)], TARGETS)).count() == 0


# ---- 4


def test_components_over_two_keys(spark):
    rows = [("1", "a", "x"), ("2", "a", "y"), ("3", "b", "y"), ("4", "c", None), ("5", None, None), ("6", None, "z"), ("7", "d", "z"), ("8", "a", None)]
    got = {r.id: r.component for r in grouped_split.components(spark.createDataFrame(rows, "id string, speaker string, source string"), ["speaker", "source"]).collect()}
    groups = collections.defaultdict(set)
    for i, c in got.items():
        groups[c].add(i)
    assert sorted(map(sorted, groups.values())) == [["1", "2", "3", "8"], ["4"], ["5"], ["6", "7"]]


def test_components_of_a_long_chain(spark):
    rows = [(str(i), f"k{i}", f"k{i + 1}") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, a string, b string").select("id", "a", F.regexp_replace("b", "^k", "k").alias("b"))
    chained = df.unionByName(df.select(F.concat("id", F.lit("'")).alias("id"), F.col("b").alias("a"), F.col("b")))
    assert grouped_split.components(chained, ["a", "b"]).select("component").distinct().count() == 1


def test_differencing_balances():
    rnd = random.Random(6)
    items = [(rnd.randrange(1, 100), i) for i in range(500)]
    bins = grouped_split.difference(items, 10)
    assert len(bins) == 10 and sorted(i for _, names in bins for i in names) == list(range(500))
    assert max(w for w, _ in bins) - min(w for w, _ in bins) <= 3
    assert grouped_split.difference([], 5) == [] and [w for w, _ in grouped_split.difference([(7, "a")], 5)] == [7]
    assert grouped_split.difference([(4, 1), (5, 2), (6, 3), (7, 4), (8, 5)], 2)[0][0] in (15, 16)


def test_partial_solutions_combine_and_repeat(spark, monkeypatch):
    monkeypatch.setattr(grouped_split, "PART", 30)
    monkeypatch.setattr(grouped_split, "FAN", 2)
    monkeypatch.setattr(grouped_split, "BINS", 20)
    rnd = random.Random(15)
    rows = [(f"r{i}", f"c{rnd.randrange(300)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id string, component string")
    targets = spark.createDataFrame([("train", 70), ("val", 30)], "split string, share_pct int")
    got = {r.id: r.new_split for r in grouped_split.assign_splits(df, targets).collect()}
    assert len(got) == 4000 and abs(sum(s == "val" for s in got.values()) - 1200) <= 60
    by = collections.defaultdict(set)
    for i, c in rows:
        by[c].add(got[i])
    assert all(len(s) == 1 for s in by.values())
    again = {r.id: r.new_split for r in grouped_split.assign_splits(df.repartition(7), targets).collect()}
    assert again == got


def test_splits_keep_groups_whole_and_meet_shares(spark):
    rnd = random.Random(7)
    rows = [(f"r{i}", rnd.choice(["hot"] * 30 + [f"s{k}" for k in range(60)] + [None] * 5), "train") for i in range(5000)]
    df = grouped_split.components(spark.createDataFrame(rows, "id string, speaker string, split string"), ["speaker"])
    targets = spark.createDataFrame([("train", 80), ("val", 10), ("test", 10), (None, 5)], "split string, share_pct int")
    placed = grouped_split.assign_splits(df, targets)
    got = placed.collect()
    assert len(got) == 5000
    by = collections.defaultdict(set)
    for r in got:
        by[r.component].add(r.new_split)
    assert all(len(s) == 1 for s in by.values())
    sizes = collections.Counter(r.new_split for r in got)
    assert abs(sizes["train"] - 4000) < 60 and abs(sizes["val"] - 500) < 60
    assert grouped_split.assign_splits(df, targets.where("false")).count() == 0
    assert grouped_split.assign_splits(df.where("false"), targets).count() == 0


# ---- 5


@pytest.mark.parametrize(
    "a, b, same_form, same_look",
    [
        ("một", "một", True, True), ("ｃafé", "café", True, True), ("a​b", "ab", True, True), ("a b", "a b", True, True), ("ab ", "ab", True, True),
        ("Татьяна", "Tатьянa", True, True), ("сửa", "cửa", True, True), ("Dom", "dom", True, False), ("a b", "ab", False, False), ("a.b", "a,b", False, False), ("má", "ma", False, False),
        ("ﾊﾞｽ", "バス", True, True), ("，", ",", True, True), ("Ðẹp", "Đẹp", True, True), ("СССР", "CCCP", True, True), ("⼈", "人", True, True), ("мама", "mama", False, False),
        ("tӑm", "tăm", True, True), ("Ѐ́", "È́", True, True), ("αnh", "anh", True, True), ("ρhở", "phở", True, True), ("νề", "về", True, True), ("ɡà", "gà", True, True), ("ｅ̂m", "êm", True, True),
        ("Ꭰạ", "Dạ", True, True), ("օng", "ong", True, True), ("ӏà", "là", True, True), ("ά́nh", "á́nh", True, True), ("", "​", True, True),
    ],
)
def test_forms(a, b, same_form, same_look):
    assert (textforms.unified(a) == textforms.unified(b)) is same_form
    assert (textforms.appearance(a) == textforms.appearance(b)) is same_look


def test_forms_are_stable(data):
    import pyarrow.parquet as pq

    for t in pq.read_table(f"{data}/manifest.parquet", columns=["text_normalized"]).column(0).to_pylist():
        if t is not None:
            assert textforms.unified(textforms.unified(t)) == textforms.unified(t)


def test_same_look_pairs(spark):
    left = spark.createDataFrame([("1", "cửa"), ("2", "сửa"), ("2", "сửa"), ("3", None), ("4", ""), ("5", "Cửa"), ("6", "x" * 300_000 + "­")], "id string, text string")
    right = spark.createDataFrame([("a", "cửa", 1), ("b", "cửa", 2), ("c", None, 3), ("d", "​", 4), ("e", "x" * 300_000, 5)], "id string, text string, side int")
    got = {tuple(r) for r in textforms.same_look_pairs(left, "id", "text", right.withColumnRenamed("id", "rid"), "rid", "text").collect()}
    assert got == {("1", "b"), ("2", "a"), ("2", "b"), ("6", "e")}
    same_name = textforms.same_look_pairs(left, "id", "text", right, "id", "text")
    assert same_name.columns == ["id", "id_right"] and same_name.count() == 4
    assert textforms.same_look_pairs(left.where("false"), "id", "text", right.withColumnRenamed("id", "rid"), "rid", "text").count() == 0


# ---- 6


def check_packing(got, capacity, items):
    used = collections.Counter()
    parts = collections.defaultdict(list)
    for r in got:
        used[(r.shard, r.container)] += r.tokens
        parts[r.id].append((r.piece, r.tokens))
    assert max(used.values()) <= capacity
    for i, n in items.items():
        pieces = sorted(parts.get(i, []))
        assert sum(t for _, t in pieces) == (n or 0) and [p for p, _ in pieces] == list(range(len(pieces)))
        assert len(pieces) == (max(1, -(-n // capacity)) if n else 0)
    return len(used)


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(8)
    items = {i: rnd.choice([None, 0, 1, 5, 99, 100, 101, 250, rnd.randrange(1, 130)]) for i in range(800)}
    df = spark.createDataFrame(list(items.items()), "id bigint, tokens bigint")
    specs = spark.createDataFrame([(1, 100), (2, None), (3, 0)], "spec_id int, capacity_tokens int")
    packed = bin_packing.pack(df, specs)
    got = packed.collect()
    assert {r.spec_id for r in got} == {1}
    n = check_packing(got, 100, items)
    assert n <= 1.03 * -(-sum(x or 0 for x in items.values()) // 100)
    assert bin_packing.packing_report(packed, specs).first().containers == n
    assert bin_packing.pack(df.where("false"), specs).count() == 0


def optimum(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_bin_completion_finds_the_optimum_on_small_cases():
    rnd = random.Random(9)
    better = 0
    for _ in range(3000):
        capacity = rnd.choice([20, 30, 50, 100])
        most = max(2, int(capacity * rnd.choice([0.3, 0.5, 0.8, 1])))
        sizes = [rnd.randrange(1, most + 1) for _ in range(rnd.randrange(1, 10))]
        bins = bin_packing.bin_completion(sizes, capacity, 1_000_000)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
        best = optimum(sorted(sizes, reverse=True), capacity)
        assert len(bins) == best >= bin_packing.lower_bound(sizes, capacity)
        better += len(bins) < len(bin_packing.best_fit_decreasing(sorted(sizes, reverse=True), capacity))
    assert better >= 5
    assert len(bin_packing.bin_completion([7, 3, 7, 2, 4, 10, 2, 9, 12, 4], 30)) == 2


def test_fillings_are_all_undominated_ones_fullest_first():
    rnd = random.Random(13)
    for _ in range(300):
        left = collections.Counter(rnd.randrange(1, 12) for _ in range(rnd.randrange(1, 8)))
        room = rnd.randrange(1, 30)
        got = [f for f in bin_packing.fillings(room, left) if f is not None]
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True) and len(set(got)) == len(got)
        every = {()}
        for k in sorted(left, reverse=True):
            every = {f + (k,) * n for f in every for n in range(left[k] + 1)}
        fit = {f for f in every if f and sum(f) <= room} or {()}
        assert set(got) <= fit
        # what is left out can take a filling that is listed instead, without more containers: its items fit in that one's
        for f in fit - set(got):
            assert any(sum(g) >= sum(f) for g in got)


def test_searches_that_run_out_stay_whole():
    rnd = random.Random(14)
    sizes = [rnd.randrange(40, 300) for _ in range(400)]
    for nodes in (0, 50):
        bins = bin_packing.bin_completion(sizes, 512, nodes)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and max(map(sum, bins)) <= 512


# ---- 7


def test_sainte_lague():
    assert mixture.sainte_lague([53, 24, 23], [99] * 3, 7) == [3, 2, 2]
    assert mixture.sainte_lague([1, 1], [1, 99], 10) == [1, 9]
    assert mixture.sainte_lague([0, 1], [5, 5], 3) == [0, 3] and mixture.sainte_lague([], [], 3) == []
    assert sum(mixture.sainte_lague([0.31, 0.29, 0.4], [10**6] * 3, 99_999)) == 99_999


def test_mixture_meets_shares_and_repeats(spark):
    rnd = random.Random(10)
    rows = [(i, rnd.choice(["big"] * 8 + ["mid"] * 3 + ["small", "other", None]), rnd.choice([None, 0, rnd.randrange(20, 400)])) for i in range(6000)]
    df = spark.createDataFrame(rows, "id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 50, 1), ("mid", 30, 2), ("small", 20, 3), ("absent", 10, 2), ("none", 5, None)], "source string, weight_pct int, max_repeats int")
    drawn, report = mixture.mix(df, targets, block=500)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "mid", "small", "absent", "none"} and got["absent"].drawn_tokens == 0
    limit = {"big": 1, "mid": 2, "small": 3}
    seen = drawn.collect()
    assert all(1 <= r.times <= limit[r.source] and r.tokens > 0 for r in seen) and len({r.id for r in seen}) == len(seen)
    total = sum(r.tokens * r.times for r in seen)
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(sum(r.tokens * r.times for r in seen if r.source == s) / total - w) < 0.0005
    again, _ = mixture.mix(df, targets, block=500)
    assert {(r.id, r.times) for r in again.collect()} == {(r.id, r.times) for r in seen}
    long = df.where("source = 'mid'").limit(3).withColumns({"id": F.col("id") + 10_000, "tokens": F.lit(30_000)})
    uneven, _ = mixture.mix(df.unionByName(long), targets, block=500)
    per = {r.source: r.n for r in uneven.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("n")).collect()}
    assert all(abs(per[s] / sum(per.values()) - w) < 0.002 for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))
    nothing, empty = mixture.mix(df.where("false"), targets)
    assert nothing.count() == 0 and empty.count() == 5


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Xin chào", "s"), (2, None, "s"), (3, "", "s"), (4, "<|endoftext|>" * 3, None)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.tokens for r in tokens.count_tokens(df, "doc_id", "text", ["source"]).collect()}
    assert got[1] > 1 and got[2] == 0 and got[3] == 0 and got[4] > 3


# ---- 8

GENUINE = [
    "The old ferryman waited by the canal until the market closed, and then he walked home with a basket of plums under his arm. "
    "Nobody asked him about the letter, because everyone in the village knew that he would not answer before the harvest was over.",
    "Bà hàng nước kể lại chuyện cũ cho cậu học trò khi trời vừa tạnh, và cả hai cùng ngồi dưới mái hiên cho đến lúc gà gáy. "
    "Trong khi đó người giữ rừng đi qua cầu với chiếc đèn của mình, nhưng không ai nhìn thấy ông ấy.",
    "Der Fährmann wartete am Kanal, bis der Markt geschlossen war, und ging dann mit einem Korb voller Pflaumen nach Hause. Niemand fragte ihn nach dem Brief.",
]
JUNK = [
    "cheap phone deal buy cheap phone deal online cheap phone deal near me best cheap phone deal discount cheap phone deal sale cheap phone deal top cheap phone deal " * 3,
    "\n".join(f"www.shop{i}.example/page-{i}?id={i}" for i in range(30)),
    " ".join(f"#tag_{i}word" for i in range(40)),
    " » ".join(f"Nova{i} » Kira{i}" for i in range(30)),
    "tai nghe giá rẻ, tai nghe tốt nhất, tai nghe chính hãng, mua tai nghe, tai nghe online, tai nghe khuyến mãi, " * 4,
]


def test_junk_and_genuine_pages(spark):
    rows = [(f"g{i}", t, 1) for i, t in enumerate(GENUINE * 5)] + [(f"j{i}", t, 1) for i, t in enumerate(JUNK)]
    rows += [("song", (GENUINE[0].split(", ")[0] + ".\n") * 40, 1), ("null", None, 1), ("empty", " \n", 1), ("notes", GENUINE[0] + "\nhttps://a.example/x\nhttps://b.example/y", 1), ("long", GENUINE[0] * 3000, 1), ("marks", " ok", 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang int")
    assert {r.doc_id for r in junk_pages.junk_pages(df).collect()} == {f"j{i}" for i in range(len(JUNK))}
    assert junk_pages.junk_pages(df.where("false")).count() == 0


def test_repeated_keyword_lines_are_junk(spark):
    tags = ["cheap mic sale", "studio lamp outlet", "vintage guitar bargain", "wireless headset coupon", "portable speaker discount"]
    song = ["Trăng lên trên dòng sông của chúng ta", "và em đã hát cho anh nghe", "con thuyền ở lại với bến cũ"]
    rows = [(f"g{i}", t) for i, t in enumerate(GENUINE * 5)] + [("one line", "cheap mic sale\n" * 500), ("five lines", "\n".join(tags * 100)), ("vi", "tai nghe giá rẻ\nloa kéo chính hãng\n" * 60)]
    rows += [("song", "\n".join(song * 30)), ("drill", "She has a book.\nHe was in the garden.\n" * 40), ("it", "Il mare era calmo e la luna saliva.\nUna barca tornava a casa con la notte.\n" * 20)]
    rows += [("zh drill", "第418号没寄出的信集市散去后高兴地路过了溪汀柳街角茶馆。\n" * 4)]
    rows += [("refrain", GENUINE[1] + "\n" + "la la la\n" * 3 + GENUINE[1].upper())]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id for r in junk_pages.junk_pages(df).collect()} == {"one line", "five lines", "vi"}


def test_lists_of_products_and_pages_of_other_languages(spark):
    korean = "할머니는 강가에서 오래된 편지를 읽고 있었다. | 아이들은 시장이 닫힌 뒤에 천천히 집으로 돌아갔다. | 우리는 저녁을 먹은 다음에 다시 그 노래를 들었다. | 비가 그치자 배는 조용히 떠났다."
    thai = "คุณยายอ่านจดหมายเก่าอยู่ริมแม่น้ำ เด็ก ๆ กลับบ้านช้า ๆ หลังจากตลาดปิด เราฟังเพลงนั้นอีกครั้งหลังอาหารเย็น เรือออกไปเงียบ ๆ เมื่อฝนหยุด"
    rows = [(f"g{i}", t, None) for i, t in enumerate(GENUINE * 5)]
    rows += [("korean", korean, "ko"), ("thai", thai, "th"), ("korean, wrong label", korean, "en"), ("domains in a sentence", GENUINE[0] + " See notes.example or shop.de for more of it.", "en")]
    rows += [("vi list", ", ".join(f"loa kéo X{7000 + 13 * i} giá rẻ {300 + 7 * i}k" for i in range(20)), "vi"), ("zh list", "\n".join(f"充值卡优惠 B{9000 + i} 最新 {200 + i}€" for i in range(20)), "zh")]
    rows += [("domains", "\n".join(f"cua-hang{i}.vn" for i in range(30)), "vi"), ("more domains", ", ".join(f"laden{i}.co.at" for i in range(30)), None)]
    scattered = " ".join(f"{a} microphone {b}" for a, b in zip("best new cheap top studio voice small large silver black".split() * 6, [f"model{i}" for i in range(60)]))
    rows += [("scattered", scattered, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    assert {r.doc_id for r in junk_pages.junk_pages(df, hint="lang").collect()} == {"vi list", "zh list", "domains", "more domains", "scattered"}


def test_signals_of_a_window():
    langs, windows, s = junk_pages.measure(["a xb a xb xk xq " * 3, "", "ab"], [None, "en", "vi"], junk_pages._Tokens())
    assert langs[1:] == ["other", "vi"] and windows.tolist() == [1, 0, 1]  # "a" is no content word
    assert s["diversity"][0] == pytest.approx(4 / 18) and s["top"][0] == pytest.approx(6 / 18) and s["grams"][0] == 1 and math.isnan(s["diversity"][1])
