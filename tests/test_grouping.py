"""Group operators against plain restatements on random input."""

import itertools
import math
import random

import pytest

from sortwell.operators import dedup, edges, grouping, split
from sortwell.operators.components import connected_components
from sortwell.operators.grouping import leader_groups, merge_components, merge_single_pass, numbered_groups
from sortwell.operators.index import with_position
from sortwell.operators.split import group_sides, smart_split
from sortwell.queries import rounded
from pyspark.sql import functions as F


def edges_of(r, labels=12, n=16, p=0.15):
    return [(f"l{k}", i, j) for k in range(labels) for i in range(n) for j in range(i + 1, n) if r.random() < p]


def greedy(edges):
    near = {}
    for i, j in edges:
        near.setdefault(i, []).append(j)
    taken, out = set(), set()
    for i in sorted(near):
        if i in taken:
            continue
        js = [j for j in near[i] if j not in taken]
        if js:
            taken |= {i, *js}
            out |= {(i, i), *((i, j) for j in js)}
    return out


def test_leaders(spark):
    e = edges_of(random.Random(1))
    e = [(None if k == "l3" else k, i, j) for k, i, j in e]  # a null label is a label
    got = leader_groups(spark.createDataFrame(e, "label string, i long, j long")).collect()
    for k in {x[0] for x in e}:
        assert {(r.leader, r.idx) for r in got if r.label == k} == greedy([(i, j) for l, i, j in e if l == k])
    assert len(got) == len({(r.label, r.idx) for r in got})


@pytest.mark.parametrize("block", [3, 16])
def test_leaders_by_ranges_of_positions(spark, monkeypatch, block):
    """Rounds over ranges, down to the last edge, give what one scan gives; runs of keys may span batches."""
    monkeypatch.setattr(grouping, "BLOCK", block)
    monkeypatch.setattr(grouping, "AT_ONCE", 0)
    e = [(None if k == "l1" else k, i, j) for k, i, j in edges_of(random.Random(11), labels=5, n=40, p=0.08)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = leader_groups(spark.createDataFrame(e, "label string, i long, j long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in {x[0] for x in e}:
        assert {(r.leader, r.idx) for r in got if r.label == k} == greedy([(i, j) for l, i, j in e if l == k])
    assert len(got) == len({(r.label, r.idx) for r in got})


def test_leaders_along_a_long_chain_take_few_jobs(spark):
    tracker = spark.sparkContext.statusTracker()
    e = spark.range(10_000).select(F.lit("a").alias("label"), F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = leader_groups(e).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("chain")) <= 20
    assert {(r.leader, r.idx) for r in got} == {(i - i % 2, i) for i in range(10_000)} | {(10_000, 10_000)} - {(10_000, 10_000)}


def test_leaders_of_nothing(spark):
    assert leader_groups(spark.createDataFrame([], "label string, i long, j long")).count() == 0


def test_leaders_along_a_chain(spark):
    e = [(None, i, i + 1) for i in range(9)]
    got = {(r.leader, r.idx) for r in leader_groups(spark.createDataFrame(e, "label string, i long, j long")).collect()}
    assert got == greedy([(i, j) for _, i, j in e])


def vectors(r, n=130, kinds=14):
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(kinds)]
    rows = [(r.choice(["a", "a", "a", "b", None]), [x + r.choice([0, 0, 0.3]) * r.gauss(0, 1) for x in r.choice(base)]) for _ in range(n)]
    rows += [("a", [0.0] * 6), ("a", [0.0] * 6), ("a", None), ("a", rows[0][1][:5]), ("b", [2 * x for x in base[0]])]
    at = {}
    return [(k, at.setdefault(k, itertools.count()).__next__(), v) for k, v in rows]


def links_of(rows, t):
    ok = [x for x in rows if x[2] is not None and any(x[2])]
    near = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) > t
    return {(a[0], a[1], b[1]) for a, b in itertools.permutations(ok, 2) if a[0] == b[0] and a[1] < b[1] and len(a[2]) == len(b[2]) and near(a[2], b[2])}


def test_cosine_links_are_those_of_classes(spark, monkeypatch):
    rows = vectors(random.Random(7))
    want = links_of(rows, 0.9)
    df = spark.createDataFrame(rows, "label string, idx long, v array<double>")
    value = {(k, i): v for k, i, v in rows}
    first = {x: min(i for (k, i), v in value.items() if k == x[0] and v == value[x]) for x in value}
    for block, tile, at_once in ((512, 32, 128), (8, 3, 2)):
        monkeypatch.setattr(edges, "BLOCK", block)
        monkeypatch.setattr(edges, "TILE", tile)
        monkeypatch.setattr(edges, "AT_ONCE", at_once)
        got = edges.cosine_edges(df, 0.9).collect()
        assert len(got) == len({(r.label, r.i, r.j) for r in got})
        assert {(r.label, r.i, r.j) for r in got if not r.copy} == {(k, i, j) for k, i, j in want if first[k, i] == i and first[k, j] == j and value[k, i] != value[k, j]}
        assert {(r.label, r.i, r.j) for r in got if r.copy} == {(k, first[k, j], j) for k, _, j in want if first[k, j] != j}
        led = {(r.label, r.leader, r.idx) for r in leader_groups(edges.cosine_edges(df, 0.9)).collect()}
        assert led == {(k, *p) for k in ("a", "b", None) for p in greedy([(i, j) for l, i, j in sorted(want, key=repr) if l == k])}


def sparse(r, n=160, dims=60):
    rows, at = [], {}
    for _ in range(n):
        k, v = r.choice(["a", "a", "b", None]), [0.0] * dims
        common = r.random() < 0.2  # some hold a component that many have
        for c in r.sample(range(4), 3) if common else r.sample(range(4, dims), r.choice([1, 2, 2, 3, 5])):
            v[c] = float(r.choice([1, 1, 2, -1]))
        if not common and r.random() < 0.5:
            v[r.randrange(4)] = 1.0
        rows.append((k, at.setdefault(k, itertools.count()).__next__(), v))
    return rows


@pytest.mark.parametrize("posting", [0, 3, 12, 4096])
@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_prefixes_lose_no_link(spark, monkeypatch, posting, threshold):
    """Postings and tiles together give each link once, whatever counts as rare."""
    monkeypatch.setattr(edges, "POSTING", posting)
    monkeypatch.setattr(edges, "BLOCK", 16)
    rows = sparse(random.Random(12))
    want = links_of(rows, threshold)
    got = [(x.label, x.i, x.j) for x in edges.cosine_edges(spark.createDataFrame(rows, "label string, idx long, v array<double>"), threshold).where("NOT copy").collect()]
    value = {(k, i): v for k, i, v in rows}
    first = {x: min(i for (k, i), v in value.items() if k == x[0] and v == value[x]) for x in value}
    assert len(got) == len(set(got))
    assert set(got) == {(k, i, j) for k, i, j in want if first[k, i] == i and first[k, j] == j and value[k, i] != value[k, j]}


def test_sparse_vectors_are_compared_with_few(spark, monkeypatch):
    """Rows dealt don't grow with the intervals of a label, and few pairs are compared."""
    monkeypatch.setattr(edges, "BLOCK", 8)
    monkeypatch.setattr(edges, "POSTING", 64)
    r = random.Random(13)
    rows = [("a", i, [float(c in s) for c in range(400)]) for i, s in enumerate(set(r.sample(range(400), 4)) for _ in range(600))]
    x = edges.cosine_candidates(spark.createDataFrame(rows, "label string, idx long, v array<double>"), 0.8).first()
    assert x.light == x.vectors == 600
    assert x.sent <= 4 * x.vectors and x.compared < x.vectors * (x.vectors - 1) / 2 / 20
    dense = [("a", i, [r.random() + 0.1 for _ in range(5)]) for i in range(100)]
    x = edges.cosine_candidates(spark.createDataFrame(dense, "label string, idx long, v array<double>"), 0.8).first()
    assert x.light == 0 and x.compared == 100 * 99 // 2


def test_links_of_one_label_come_from_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(edges, "BLOCK", 8)
    rows = [("a", i, [1.0, i / 1000, (i * i % 7) / 100]) for i in range(120)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = edges.cosine_edges(spark.createDataFrame(rows, "label string, idx long, v array<double>"), 0.9)
        assert got.where("NOT copy").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hamming_links(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(160):
        h = r.choice(base)
        for b in r.sample(range(64), r.choice([0, 0, 1, 2, 3, 4, 6])):
            h ^= 1 << b
        rows.append((r.choice(["a", None]), i, f"{h:064b}"))
    rows += [("a", 200, ""), ("a", 201, None), ("a", 202, "1" * 64), ("a", 203, "1" * 64)]
    df = spark.createDataFrame(rows, "label string, idx long, phash string")
    ok = [(k, i, int(h, 2)) for k, i, h in rows if h]
    first = {(k, h): min(i for l, i, g in ok if (l, g) == (k, h)) for k, _, h in ok}
    for bits in (0, 3, 5, 8):
        got = [tuple(x) for x in edges.hamming_edges(df, bits).collect()]
        firsts = [(k, i, h) for (k, h), i in first.items()]
        want = {(a[0], min(a[1], b[1]), max(a[1], b[1]), (a[2] ^ b[2]).bit_count(), False) for a, b in itertools.combinations(firsts, 2) if a[0] == b[0] and (a[2] ^ b[2]).bit_count() <= bits}
        want |= {(k, first[k, h], i, 0, True) for k, i, h in ok if first[k, h] != i}
        assert len(got) == len(set(got)) and set(got) == want


def groups_of(r):
    return [(None if k == 4 else f"l{k}", n, sorted(r.sample(range(30), r.randint(2, 5)))) for k in range(10) for n in range(1, r.randint(2, 9))]


def frame(spark, groups):
    return spark.createDataFrame([(k, no, i) for k, no, m in groups for i in m], "label string, group_no long, idx long")


def sets_of(rows):
    out = {}
    for r in rows:
        out.setdefault((r.label, r.group_no), []).append(r.idx)
    return {k: sorted(v) for k, v in out.items()}


def fold_once(groups):
    left, out = [set(g) for g in groups], []
    while left:
        first, left = left[0], left[1:]
        met = [g for g in left if g & first]
        left = [g for g in left if not g & first]
        out.append(sorted(first.union(*met)))
    return sorted(out)


@pytest.mark.parametrize("at_once", [grouping.AT_ONCE, 0, 60])
def test_single_pass(spark, monkeypatch, at_once):
    monkeypatch.setattr(grouping, "AT_ONCE", at_once)
    g = groups_of(random.Random(2))
    got = sets_of(merge_single_pass(frame(spark, g)).collect())
    for k in {x[0] for x in g}:
        assert sorted(m for (l, _), m in got.items() if l == k) == fold_once([m for l, _, m in g if l == k])
    got = sets_of(merge_single_pass(frame(spark, [("a", 1, [1, 2]), ("a", 2, [3, 4]), ("a", 3, [2, 3])])).collect())
    assert got == {("a", 1): [1, 2, 3], ("a", 2): [3, 4]}
    assert merge_single_pass(frame(spark, [])).count() == 0


def test_components(spark):
    g = groups_of(random.Random(3))
    got = sets_of(merge_components(frame(spark, g)).collect())
    for k in {x[0] for x in g}:
        sets = [set(m) for l, _, m in g if l == k]
        while True:
            nxt = [set(s) for s in fold_once(sets)]
            if len(nxt) == len(sets):
                break
            sets = nxt
        assert sorted(m for (l, _), m in got.items() if l == k) == sorted(sorted(s) for s in sets)


def test_numbers_follow_level_and_lead(spark):
    rows = [("b", "y", 3, 3), ("b", "y", 3, 9), ("b", "x", 7, 7), (None, "y", 1, 1), (None, "x", 2, 2), (None, "x", 2, 5)]
    got = sets_of(numbered_groups(spark.createDataFrame(rows, "label string, level string, lead long, idx long"), ["x", "y"]).collect())
    assert got == {("b", 1): [7], ("b", 2): [3, 9], (None, 1): [2, 5], (None, 2): [1]}


def test_best_and_losers_with_null_labels(spark):
    items = spark.createDataFrame([(None, 0, "h", 0.1), (None, 1, "h", 0.5), (None, 2, "", 0.5), (None, 3, "", 0.5), ("a", 0, "h", 0.3), ("a", 1, "h", 0.3), ("a", 2, None, 0.3)], "label string, idx long, hash string, quality double")
    groups = dedup.key_groups(items, "hash")
    assert sorted((str(r.label), r.n, r.group_no, r.idx) for r in groups.collect()) == [("None", 2, 0, 0), ("None", 2, 0, 1), ("a", 2, 0, 0), ("a", 2, 0, 1)]
    unique = dedup.unique_items(items, groups)
    assert sorted((str(r.label), r.idx) for r in unique.collect()) == [("None", 1), ("None", 2), ("None", 3), ("a", 0), ("a", 2)]
    more = frame(spark, [(None, 1, [0, 1, 2, 3]), ("a", 1, [0, 1])])
    left = dedup.remapped_groups(more, unique.withColumn("uidx", F.col("idx") * 10))
    assert sets_of(left.collect()) == {(None, 1): [10, 20, 30]}


def test_connected_components(spark):
    e = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_positions(spark):
    rows = [("a" if i % 3 else None, i, -i) for i in range(100)]
    got = with_position(spark.createDataFrame(rows, "k string, id long, x long").repartition(7), "k", [F.col("x").asc()]).collect()
    for k in ("a", None):
        want = sorted((r[2], r[1]) for r in rows if r[0] == k)
        assert sorted((r.x, r.id, r.idx) for r in got if r.k == k) == [(x, i, n) for n, (x, i) in enumerate(want)]


def split_plainly(n, quality, groups, ratio):
    nt, side, used, of = int(n * ratio), {}, {"train": 0, "test": 0}, {}
    order = sorted(groups, key=lambda g: (-len(g[1]), g[0]))
    for no, g in order:
        a, b = nt - used["train"], n - nt - used["test"]
        if a + b <= 0:
            continue
        share = a / (a + b) if len(g) <= a else ratio
        s = "train" if (a >= len(g) and share >= 0.5) or b < len(g) else "test"
        for i in g:
            if i not in side:
                side[i] = s
                used[s] += 1
    for i in sorted(range(n), key=lambda i: (-quality[i], i)):
        if i not in side:
            s = "train" if used["train"] < nt else "test"
            side[i] = s
            used[s] += 1
    off = abs(used["train"] / n - ratio)
    if off > 0.05:
        fit = sorted((g for _, g in order if len(g) <= abs(used["train"] - nt)), key=len)
        for g in fit:
            s, size = side[g[0]], len(g)
            to = "test" if s == "train" and used["train"] > nt else "train" if s == "test" and used["train"] < nt else None
            if to and abs((used["train"] + (size if to == "train" else -size)) / n - ratio) < off:
                side |= dict.fromkeys(g, to)
                break
    return side


def dealt_plainly(size, fresh, n, n_train, ratio):
    used, out = {"train": 0, "test": 0}, []
    for s, f in zip(size, fresh, strict=True):
        a, b = n_train - used["train"], n - n_train - used["test"]
        if a + b <= 0:
            out.append(None)
            continue
        share = a / (a + b) if s <= a else ratio
        side = "train" if (a >= s and share >= 0.5) or b < s else "test"
        used[side] += f
        out.append(side)
    return out


def test_runs_of_groups_are_dealt_as_one_by_one():
    r = random.Random(14)
    for _ in range(8000):
        runs, size, fresh = [], [], []
        for s in sorted((r.randint(2, 9) for _ in range(r.randint(0, 4))), reverse=True):
            for _ in range(r.choice([1, 1, 2])):
                f, c = r.choice([s, s, s, s - 1, 0, 1]), r.choice([1, 2, 3, 7, 20])
                runs.append((len(size), c, s, f))
                size += [s] * c
                fresh += [f] * c
        n, ratio = max(1, sum(fresh) + r.choice([0, 0, 3, 10, -2])), r.choice([0.5, 0.75, 0.2, 0.9, 1.0, 0.0, 0.6])
        got, k = [None] * len(size), 0
        for start, first, last, even, odd in split._segments(runs, n, int(n * ratio)):
            k += 1
            for x in range(first, last):
                got[start + x] = odd if (x - first) % 2 else even
        assert got == dealt_plainly(size, fresh, n, int(n * ratio), ratio)
        assert k <= 6 * len(runs)  # however many groups a run has
    assert len(list(split._segments([(0, 10**12, 3, 3)], 3 * 10**12 + 5, 10**12))) <= 6


@pytest.mark.parametrize("stretch", [2, 1 << 16])
def test_many_groups_of_few_sizes(spark, monkeypatch, stretch):
    """Groups of a size that overlap others to different extents are stretches of equal ones."""
    monkeypatch.setattr(split, "STRETCH", stretch)
    r = random.Random(15)
    groups, n = [], 0
    for no in range(1, 301):
        size = r.choice([2, 2, 3])
        groups.append((no, [*range(n, n + size)] if no % 7 else [n - 1, *range(n, n + size - 1)]))
        n = groups[-1][1][-1] + 1
    n += 40
    for ratio in (0.75, 0.3):
        got = {x.group_no: x.split for x in split.group_sides(spark.range(n).select(F.lit("a").alias("label"), F.col("id").alias("idx")), frame(spark, [("a", no, g) for no, g in groups]), ratio).collect()}
        order = sorted(groups, key=lambda g: (-len(g[1]), g[0]))
        seen, fresh = set(), []
        for _, g in order:
            fresh.append(len(set(g) - seen))
            seen |= set(g)
        assert [got[no] for no, _ in order] == dealt_plainly([len(g) for _, g in order], fresh, n, int(n * ratio), ratio)


def test_split(spark):
    r = random.Random(5)
    rows, groups, want = [], [], {}
    for k in range(25):
        n = r.randint(3, 40)
        q = [r.randint(0, 5) / 5 for _ in range(n)]
        free, gs = list(range(n)), []
        r.shuffle(free)
        while len(free) > 2 and r.random() < 0.8:
            size = r.randint(2, max(2, len(free) // 2))
            gs.append((len(gs) + 1, sorted(free[:size])))
            free = free[size:]
        if r.random() < 0.5 and n > 4:
            gs.append((len(gs) + 1, sorted(r.sample(range(n), 3))))  # overlaps
        label = None if k == 7 else f"l{k}"
        rows += [(label, i, q[i]) for i in range(n)]
        groups += [(label, no, g) for no, g in gs]
        want[label] = split_plainly(n, q, gs, 0.75)
    items = spark.createDataFrame(rows, "label string, idx long, quality double")
    got = smart_split(items, frame(spark, groups), 0.75).collect()
    assert len(got) == len(rows)
    for x in got:
        assert want[x.label][x.idx] == x.split, x


@pytest.mark.parametrize(("scanned", "step", "rows", "leaders"), [(1 << 21, 256, 256, 4096), (60, 4, 3, 2), (1, 1, 1, 1)])
def test_leaders_of_vectors_need_no_links(spark, monkeypatch, scanned, step, rows, leaders):
    """Rounds over vectors give the groups of a scan over all links, at every level."""
    for name, value in {"SCANNED": scanned, "STEP": step, "ROWS": rows, "LEADERS": leaders}.items():
        monkeypatch.setattr(grouping, name, value)
    data = vectors(random.Random(17), n=130 if scanned > 1 else 24)
    got = grouping.vector_leaders(spark.createDataFrame(data, "label string, idx long, v array<double>"), {"near": 0.97, "far": 0.7}).collect()
    for level, t in (("near", 0.97), ("far", 0.7)):
        want = {(k, *p) for k in ("a", "b", None) for p in greedy([(i, j) for l, i, j in sorted(links_of(data, t), key=repr) if l == k])}
        assert {(r.label, r.leader, r.idx) for r in got if r.level == level} == want
    assert len(got) == len({(r.label, r.level, r.idx) for r in got})
    assert grouping.vector_leaders(spark.createDataFrame([], "label string, idx long, v array<double>"), {"near": 0.9}).count() == 0


def test_many_alike_vectors_are_no_links(spark):
    """4,000 vectors that are all alike are one group each level, found within a few jobs; their 8 million links are never rows."""
    r = random.Random(18)
    data = [("a", i, [1.0 + r.random() / 50 for _ in range(16)]) for i in range(4000)]
    tracker = spark.sparkContext.statusTracker()
    df = spark.createDataFrame(data, "label string, idx long, v array<double>").cache()
    df.count()
    spark.sparkContext.setJobGroup("alike", "alike")
    try:
        got = grouping.vector_leaders(df, {"near": 0.95, "far": 0.8}).groupBy("level", "leader").count().collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == [("far", 0, 4000), ("near", 0, 4000)]
    assert len(tracker.getJobIdsForGroup("alike")) <= 30


def test_a_cosine_equal_to_the_threshold_is_no_link(spark):
    """Whole numbers whose cosine is the threshold itself link with nothing, as in SQL, whatever rounding a scale would add."""
    pairs, n = [], 0
    for k in range(1, 40):
        a, b = [0.0] * 8, [0.0] * 8
        a[0], a[1], b[0], b[2] = 3.0 * k, 4.0 * k, 3.0 * k, 4.0 * k  # 9 / 25
        pairs += [(str(k), 0, a), (str(k), 1, b)]
    df = spark.createDataFrame(pairs, "label string, idx long, v array<double>")
    wide = [(f"{x}", i, [float(c < 19 or c == 19 + i) for c in range(24)]) for x in range(5) for i in range(2)]  # 19 / 20
    assert edges.cosine_edges(df, 0.36).count() == 0
    assert edges.cosine_edges(spark.createDataFrame(wide, "label string, idx long, v array<double>"), 0.95).count() == 0
    assert grouping.vector_leaders(spark.createDataFrame(wide, "label string, idx long, v array<double>"), {"near": 0.95}).count() == 0


@pytest.mark.parametrize(("posting", "nonzero", "tuples"), [(4096, 16, 64), (4096, 5, 64), (4096, 16, 6), (5, 16, 64)])
@pytest.mark.parametrize("threshold", [0.55, 0.9])
def test_sparse_vectors_meet_by_what_they_share(spark, monkeypatch, posting, nonzero, tuples, threshold):
    """Tuples, and tiles for the heavy vectors of a label, give each link once."""
    for name, value in {"POSTING": posting, "NONZERO": nonzero, "TUPLES": tuples, "OTHERS": 0.6, "BLOCK": 8, "TILE": 2, "PAIRS": 7}.items():
        monkeypatch.setattr(edges, name, value)
    rows = sparse(random.Random(19), n=220, dims=14)
    want = links_of(rows, threshold)
    df = spark.createDataFrame(rows, "label string, idx long, v array<double>")
    got = [(x.label, x.i, x.j) for x in edges.cosine_edges(df, threshold).where("NOT copy").collect()]
    value = {(k, i): v for k, i, v in rows}
    first = {x: min(i for (k, i), v in value.items() if k == x[0] and v == value[x]) for x in value}
    assert len(got) == len(set(got))
    assert set(got) == {(k, i, j) for k, i, j in want if first[k, i] == i and first[k, j] == j and value[k, i] != value[k, j]}


def test_rows_dealt_for_sparse_vectors_grow_with_them(spark):
    """Whatever their number, vectors of few components are sent a few times each, and compared with few."""
    r = random.Random(20)
    sent = []
    for n in (4000, 16000):
        rows = [("a", i, [float(c in s) for c in range(32)]) for i, s in enumerate(set(r.sample(range(32), r.choice([5, 6, 7]))) for _ in range(n))]
        x = edges.cosine_candidates(spark.createDataFrame(rows, "label string, idx long, v array<double>"), 0.9).first()
        assert x.light == x.vectors and x.compared < x.vectors * (x.vectors - 1) / 2 / 50
        sent.append(x.sent / x.vectors)
    assert max(sent) <= 5 and sent[1] < sent[0] * 1.2


def shuffled(spark):
    """Bytes of each shuffle file that the session holds."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
    return {f.getName(): f.length() for f in (files.apply(k) for k in range(files.length())) if f.getName().startswith("shuffle")}


def test_disk_for_dense_vectors_grows_with_them(spark, monkeypatch):
    """A vector is written once to be dealt, and once packed, however many tiles it is in."""
    monkeypatch.setattr(edges, "BLOCK", 8)
    monkeypatch.setattr(edges, "POSTING", 0)
    r = random.Random(21)
    each, sent = [], []
    for n in (300, 2400):
        rows = [("a", i, [r.gauss(0, 1) for _ in range(32)]) for i in range(n)]
        df = spark.createDataFrame(rows, "label string, idx long, v array<double>")
        before = shuffled(spark)
        edges.cosine_edges(df, 0.75).count()
        each.append(sum(size for name, size in shuffled(spark).items() if name not in before) / n)
        x = edges.cosine_candidates(df, 0.75).first()
        assert x.light == 0 and x.compared == n * (n - 1) // 2
        sent.append(x.sent / n)
    assert each[1] < each[0] * 1.3, each
    assert sent == [2, 2]


def test_written_links_take_few_bytes(spark, tmp_path):
    """Links come in order of cosine, so that equal ones of six places lie together in a file; unordered, a cosine alone takes 8 bytes."""
    r, n = random.Random(22), 1500
    rows = [("a", i, [r.random() + 0.1 for _ in range(24)]) for i in range(n)]
    edges.cosine_edges(spark.createDataFrame(rows, "label string, idx long, v array<double>"), 0.3).withColumn("sim", rounded()).write.parquet(f"{tmp_path}/links")
    links = spark.read.parquet(f"{tmp_path}/links")
    assert links.count() == links.select("i", "j").where("i < j").distinct().count() == n * (n - 1) // 2
    assert sum(f.stat().st_size for f in (tmp_path / "links").glob("*.parquet")) < 7 * links.count()
