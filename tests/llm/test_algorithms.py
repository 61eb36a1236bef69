"""Windows, clusters, groups, set join, subsets: brute force, edge cases, properties."""

import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import density, groups, setjoin, subset, windows

FEATURES = "doc_id long, feature string, type string, level string, value double, frequency int"
CLUSTERS = "cluster_id long, features array<string>, documents array<long>, number_documents int, average_features double, affinity_ratio double"
JOBS = "job_id long, file_name string, page_start int, page_end int, total_pages int, split_type string, detect_lang boolean, lang string, submitted_at timestamp"
PAGES = "file_name string, page_number int, page_width double, page_height double, orientation string, angle int, language string, lang_confidence double, content_type string, read_confidence double, encrypted string, number_images int"
PAIRS = "cluster_a long, cluster_b long, score double, scored_at timestamp"


def t(day):
    return datetime(2020, 1, day)


def doc_features(spark, sets):
    return spark.createDataFrame([(i, f, "title", "cluster", None, 1) for i, s in sets.items() for f in s], FEATURES)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def family_sets(rng, families=6, size=7):
    """Families whose members share most features, single documents, exact copies, and common features of all."""
    sets, n = {}, 100
    for k in range(families):
        core = [f"c{k}_{i}" for i in range(9)]
        for _ in range(size):
            own = core[:]
            own[rng.randrange(9)] = f"own{n}"
            sets[n] = {*own, "page", f"lang{k % 2}"}
            n += 1
        sets[n] = set(sets[n - 1])
        n += 1
    for _ in range(20):
        sets[n] = {*(f"s{n}_{i}" for i in range(6)), "page", "lang0"}
        n += 1
    sets[n] = {"page", "lang0"}
    return sets


# ---- problem 1 -------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 900), st.integers(1, 60), st.data())
def test_windows_cover_overlap_and_fit(n, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    strength = data.draw(st.dictionaries(st.integers(1, 900), st.floats(0.1, 9), max_size=12))
    got = windows.merge_segments(n, strength, limit, overlap)
    assert all(1 <= a <= b <= n and b - a + 1 <= limit for a, b in got)
    assert {p for a, b in got for p in range(a, b + 1)} == set(range(1, n + 1))
    ends = [0, *[b for _, b in got]]
    for (a, _), before in zip(got[1:], ends[1:]):
        assert a == max(1, before - overlap + 1)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 400), st.integers(1, 40), st.data())
def test_windows_are_those_of_merging_single_units(n, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    strength = data.draw(st.dictionaries(st.integers(-3, 410), st.sampled_from([0.0, 1.0, 2.0, 2.5]), max_size=30))
    segments = [[i, i] for i in range(1, n + 1)]
    if n > limit:
        for _, i in sorted((strength.get(i, 0.0), i) for i in range(1, n)):
            k = next(k for k, s in enumerate(segments) if s[1] == i)
            a, b = segments[k][0], segments[k + 1][1]
            if b - a + 1 + (overlap if a > 1 else 0) <= limit:
                segments[k : k + 2] = [[a, b]]
        want = [(a - overlap if a > overlap and a > 1 else 1, b) for a, b in segments]
    else:
        want = [(1, n)] if n else []
    assert windows.merge_segments(n, strength, limit, overlap) == want


def test_windows_of_an_implausible_total():
    got = windows.merge_segments(20_000_000, {7_000: 2.0}, 200, 5)
    assert len(got) > 100_000 and got[-1][1] == 20_000_000 and (6_996, 7_195) in got


def test_windows_end_at_the_strongest_change():
    got = windows.merge_segments(300, {140: 5.0, 150: 1.0}, 200, 5)
    assert got[0] == (1, 140) and got[-1][1] == 300
    with pytest.raises(ValueError):
        windows.merge_segments(10, {}, 5, 5)


def test_requests(spark):
    jobs = [
        (1, "f", None, None, 300, "line", True, "en", t(1)),
        (2, "f", 250, 10, 300, "line", True, "en", t(1)),  # exchanged: 240 pages
        (3, "f", 0, 999, 100, "line", True, "en", t(1)),  # past the end
        (4, "g", 0, None, None, "line", True, "en", t(1)),  # end of file from page_info
        (4, "g", 0, 5, None, "line", True, "en", t(2)),  # the later one counts
        (5, "h", 0, None, -1, "line", None, None, None),  # nothing known
        (6, "g", 0, None, 0, None, None, None, t(1)),
        (6, "g", 0, None, 0, None, None, None, t(1)),
        (None, "g", 0, 500, 900, None, None, None, t(1)),
        (7, None, 0, 201, 900, None, None, None, t(1)),
    ]
    pages = [("g", p, 10.0, 20.0, "P" if p < 150 else "L", 0, "fra", 0.9, "R", 0.9, "N", 0) for p in range(1, 221)] * 2
    pages += [(None, 1, None, None, None, None, None, None, None, None, None, None), ("g", None, None, None, None, None, None, None, None, None, None, None)]
    j, p = spark.createDataFrame(jobs, JOBS).withColumn("requested", F.lit("clash")), spark.createDataFrame(pages, PAGES).withColumn("eof", F.lit(1))
    asked = {r["job_id"]: r["requested"] for r in windows.requested_pages(j, p).collect()}
    assert asked == {1: 300, 2: 240, 3: 100, 4: 5, 5: 0, 6: 220, 7: 201}
    assert {r["job_id"] for r in windows.found(j, p).collect()} == {1, 2, 6, 7}
    six = sorted((r["page_from"], r["page_to"]) for r in windows.split_requests(j, p).where("job_id = 6").collect())
    assert six == [(1, 149), (145, 220)]
    assert windows.split_requests(j.where("false"), p).count() == 0
    assert windows.found(j, p.where("false")).count() == 3


# ---- problem 4 -------------------------------------------------------------------------------------------------


def test_latest_score_links(spark):
    nan = float("nan")
    rows = [(2, 1, 0.9, t(1)), (1, 2, 0.1, t(2)), (3, 4, 0.1, t(1)), (4, 3, 0.8, t(2)), (5, 6, nan, t(3)), (5, 6, 0.9, t(1)), (7, 7, 1.0, t(1)), (8, 9, None, t(1)), (None, 9, 1.0, t(1)), (10, 11, 0.9, None), (3, 4, 0.8, t(2))]
    df = spark.createDataFrame(rows, PAIRS).withColumn("a", F.lit(1))
    assert sorted((r["a"], r["b"]) for r in groups.latest_links(df).collect()) == [(3, 4), (10, 11)]
    assert sorted(map(tuple, groups.found(df).collect())) == [(3, 3), (4, 3), (10, 10), (11, 10)]
    assert groups.found(df.where("false")).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "star with chains", "random", "one edge"])
def test_groups_are_components(spark, shape):
    rng = random.Random(2)
    ids = rng.sample(range(1000), 300)
    edges = {
        "chain": list(zip(ids, ids[1:])),
        "star": [(ids[0], x) for x in ids[1:]],
        "star with chains": [(ids[0], x) for x in ids[1:60]] + list(zip(ids[59:], ids[60:200])) + list(zip(ids[200:], ids[201:])),
        "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(200)],
        "one edge": [(5, 3)],
    }[shape]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = sorted((r["v"], r["label"]) for r in groups.group_ids(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == sorted((v, root(v)) for v in linked)


# ---- problem 5 -------------------------------------------------------------------------------------------------


def test_set_join_is_exact_whatever_the_blocks(spark):
    rng = random.Random(4)
    sets = {i: {f"f{int(rng.random() ** 2 * 25)}" for _ in range(rng.randrange(6, 16))} for i in range(120)}
    sets = {i: s for i, s in sets.items() if len(s) > 5}
    by = {}
    for i in sorted(sets):
        by.setdefault(frozenset(sets[i]), i)
    reps = {i: set(s) for s, i in by.items()}
    for num, den in ((3, 4), (1, 2)):
        want = {(a, b) for a in reps for b in reps if a < b and den * len(reps[a] & reps[b]) >= num * len(reps[a] | reps[b])}
        recs, members = setjoin.classes(setjoin.feature_sets(doc_features(spark, sets)))
        got = [(r["a"], r["b"]) for r in setjoin.similar_classes(recs, num, den, block=3).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {r["id"]: r["class_id"] for r in members.collect()} == {i: by[frozenset(s)] for i, s in sets.items()}


def test_pairs_of_documents_and_clusters(spark):
    base = {f"x{i}" for i in range(8)}
    sets = {10_000_001: base, 10_000_002: {*base, "y"}, 10_000_003: base, 10_000_004: {f"z{i}" for i in range(8)}, 10_000_005: {"x0", "x1"}}
    f = doc_features(spark, sets).unionByName(spark.createDataFrame([(10_000_001, " X0\t", "t", "l", None, None), (10_000_001, None, "t", "l", None, None), (None, "x1", None, None, None, None)], FEATURES))
    c = spark.createDataFrame([(3, [*sorted(base), None], [1], 1, 1.0, 1.0), (3, sorted(base), [1], 1, 1.0, 1.0), (4, sorted(base), None, None, None, None), (5, None, [], 0, None, None)], CLUSTERS).withColumn("feats", F.lit(0))
    a, b, d = 10_000_001, 10_000_002, 10_000_003
    want = {(a, b), (a, d), (b, d), *((k, x) for k in (3, 4) for x in (a, b, d))}
    got = [tuple(r) for r in setjoin.found(f.withColumn("id", F.lit(0)), c).collect()]
    assert len(got) == len(want) and set(got) == want
    s = {r["id"]: (r["class_id"], r["copies"], r["similar"]) for r in setjoin.summary(f, c).collect()}
    assert s[a] == (3, 3, 1) and s[b] == (b, 0, 4) and 10_000_005 not in s
    assert setjoin.found(f.where("false"), c.where("false")).count() == 0


def test_large_classes_and_lists_are_divided(spark):
    sets = {i: {f"x{j}" for j in range(8)} for i in range(900)}  # one class of 900 copies
    sets |= {1000 + i: {*(f"x{j}" for j in range(8)), f"y{i}"} for i in range(60)}  # 60 classes that share every rare feature
    recs, members = setjoin.classes(setjoin.feature_sets(doc_features(spark, sets)))
    assert {r["class_id"]: r["lead"] for r in recs.collect()}[1000] == 1
    pairs = setjoin.similar_classes(recs, block=7).select("a", "b").collect()
    assert len(pairs) == len(set(pairs)) == 61 * 60 // 2
    same = spark.createDataFrame([(0, 0), (0, 1000)], "a long, b long")
    got = setjoin.expand(same, members, block=50).select("x", "y").collect()
    assert len(got) == len(set(got)) == 900 * 899 // 2 + 900
    parts = setjoin.parted(members, 50).groupBy("class_id", "part").count().agg(F.max("count")).first()[0]
    assert parts < 100


# ---- problem 3 -------------------------------------------------------------------------------------------------


def test_density_peaks_find_the_families(spark):
    sets = family_sets(random.Random(6))
    big = {i: s for i, s in sets.items() if len(s) > 5}
    parent = {i: i for i in big}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in big:
        for b in big:
            if a < b and jaccard(big[a], big[b]) >= 0.5:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    size = {}
    for i in big:
        size[root(i)] = size.get(root(i), 0) + 1
    want = sorted((i, root(i)) for i in big if size[root(i)] > 1)
    f = doc_features(spark, sets).withColumn("class_id", F.lit(1))
    assert sorted(map(tuple, density.found(f).collect())) == want
    rep = {r["doc_id"]: r for r in density.report(f).collect()}
    assert set(rep) == set(sets) and rep[max(sets)]["group_id"] == 0
    assert all(rep[i]["size"] == size[root(i)] and set(rep[i]["typical"]) <= {j for j in big if root(j) == root(i)} for i in big)
    assert density.found(f.where("false")).count() == 0


def test_density_pointers_are_exact_on_overlapping_chains(spark):
    rng = random.Random(12)
    sets = {}
    for c in range(6):  # chains in which only near links are alike, with copies and side branches
        for i in range(50):
            s = {f"c{c}_{j}" for j in range(i, i + 9)}
            if rng.random() < 0.4:
                s.add(f"b{c}_{i}")
            sets[len(sets)] = s
            if rng.random() < 0.3:
                sets[len(sets)] = set(s)
    recs, _ = setjoin.classes(setjoin.feature_sets(doc_features(spark, sets)))
    copies = {}
    for i in sorted(sets):
        copies.setdefault(frozenset(sets[i]), []).append(i)
    rep = {v[0]: (set(s), len(v)) for s, v in copies.items()}
    near = {a: {b: jaccard(rep[a][0], rep[b][0]) for b in rep if b != a and 2 * len(rep[a][0] & rep[b][0]) >= len(rep[a][0] | rep[b][0])} for a in rep}
    rho = {a: rep[a][1] + sum(rep[b][1] for b in near[a]) for a in rep}
    got = density.densities(recs)
    assert {r["class_id"]: r["rho"] for r in got.collect()} == rho
    want = {}
    for a in rep:
        denser = [b for b in near[a] if (rho[b], -b) > (rho[a], -a)]
        if denser:
            want[a] = max(denser, key=lambda b: (near[a][b], rho[b], -b))
    assert {r["class_id"]: r["p"] for r in density.pointers(got).collect()} == want

    def peak(a):
        return peak(want[a]) if a in want else a

    group = {}
    for a in rep:
        group.setdefault(peak(a), []).append(a)
    label = {i: min(group[peak(v[0])]) for v in copies.values() for i in v}
    assert {r["doc_id"]: r["group_id"] for r in density.report(doc_features(spark, sets)).collect()} == label


def test_density_in_one_huge_family(spark):
    core = [f"c{i}" for i in range(9)]
    sets = {i: {*core, f"o{i % 37}", f"p{i % 11}"} for i in range(400)}
    got = density.found(doc_features(spark, sets)).collect()
    assert len(got) == 400 and {r["group_id"] for r in got} == {0}


# ---- problem 6 -------------------------------------------------------------------------------------------------


def test_greedy_determinant_equals_plain_greedy():
    rng = random.Random(8)
    toks = [np.array(sorted(rng.sample(range(30), rng.randrange(3, 9)))) for _ in range(40)]
    kernel = np.array([[jaccard(set(a), set(b)) for b in toks] for a in toks]) + subset.RIDGE * np.eye(40)
    plain = []
    for _ in range(8):
        left = [i for i in range(40) if i not in plain]
        plain.append(max(left, key=lambda i: round(np.linalg.det(kernel[np.ix_([*plain, i], [*plain, i])]), 12)))
    got = subset.greedy_determinant(toks, 8)
    assert np.linalg.det(kernel[np.ix_(got, got)]) >= np.linalg.det(kernel[np.ix_(plain, plain)]) * (1 - 1e-6)
    assert subset.greedy_determinant(toks, 100) and len(set(subset.greedy_determinant(toks, 100))) == 40
    assert subset.greedy_determinant([], 3) == []


def test_core_sets_reach_the_determinant_of_the_whole(spark):
    rng = random.Random(4)
    sets = family_sets(rng, families=12, size=40)
    whole = {k: v for k, v in sets.items()}
    recs, _ = setjoin.classes(subset.item_sets(doc_features(spark, sets), spark.createDataFrame([], CLUSTERS)))
    rows = sorted(recs.collect(), key=lambda r: r["class_id"])
    at = subset.greedy_determinant([np.asarray(r["toks"], dtype=np.int64) for r in rows], 15, [r["k"] for r in rows])
    once = [rows[i]["class_id"] for i in at]
    parted = [r["doc_id"] for r in subset.varied_subset(subset.item_sets(doc_features(spark, sets), spark.createDataFrame([], CLUSTERS)), 15, part=60).collect()]

    def logdet(ids):
        kernel = np.array([[jaccard(whole[a], whole[b]) for b in ids] for a in ids]) + subset.RIDGE * np.eye(len(ids))
        return np.linalg.slogdet(kernel)[1]

    assert logdet(parted) >= logdet(once) - 0.05 * len(once)
    assert logdet(rng.sample(sorted(whole), 15)) < logdet(parted) - 1


def test_subset_spreads_over_families(spark):
    sets = family_sets(random.Random(9), families=5, size=30)
    f = doc_features(spark, sets)
    c = spark.createDataFrame([(1, ["a"], [100, 101, 101, None], 2, 1.0, 1.0), (0, [], None, None, None, None)], CLUSTERS)
    got = subset.varied_subset(subset.item_sets(f, c), 20, part=40)
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) == 20 and sorted(r["rank"] for r in got.collect()) == list(range(1, 21))
    in_family = sum(any(x.startswith("c") for x in sets[i]) for i in ids)
    assert in_family <= 12  # 155 of 176 documents are in families, the subset doesn't follow that
    assert subset.subset(f.where("false"), c).count() == 0
    with pytest.raises(ValueError):
        subset.varied_subset(subset.item_sets(f, c), 0)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(range(8)))
def test_subset_ignores_row_order(spark, order):
    sets = {i: {f"f{i}", f"g{i % 3}", "h"} for i in range(8)}
    f = doc_features(spark, {i: sets[i] for i in order})
    c = spark.createDataFrame([], CLUSTERS)
    assert [r["doc_id"] for r in subset.varied_subset(subset.item_sets(f, c), 3).orderBy("rank").collect()] == [0, 1, 2]
