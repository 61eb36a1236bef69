"""Micro-fixtures and properties of the core operators."""

import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import content, language, layout, text
from pagewright.operators import cluster, evaluate, features, ingest, labelling, similarity
from pagewright.operators.graph import connected_components
from pagewright.operators.skew import hot_join
from pagewright.session import cut, drop, scratch


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def scalar(spark, e, value):
    return spark.createDataFrame([(value,)], "t string").select(e.alias("v")).first()["v"]


# ---- text ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "f, value, want",
    [
        (text.fold_vowels, "œuvre déjà", "oeuvre deja"),
        (lambda c: text.sign_words(F.col(c)), "a)", "a parenthèse "),
        (text.has_text, "12 %", False),
        (text.has_text, "-", True),
        (text.has_text, "x", True),
        (text.before_colon, "total: 5", "total"),
        (text.strip_numbers, "total actif 123 net", "totalnet"),
        (text.strip_dates, "note au 31 decembre 2015 consolide", "note au  consolide"),
        (text.enumerator_type, "i)", " romain  parenthèse "),
        (text.enumerator_type, "3.", " cardinal  point "),
        (text.enumerator_type, "b)", " lettre  parenthèse "),
        (text.enumerator_type, "v i", " roma romain n   romain "),
        (text.enumerator, "", None),
        (text.enumerator, None, None),
        (text.strip_dates, None, None),
        (text.first_tokens, "a b c", "a b c"),
    ],
)
def test_scalars(spark, f, value, want):
    assert scalar(spark, f("t"), value) == want


def test_note_word_before_enumerator(spark):
    assert scalar(spark, text.enumerator("t", F.lit("fra")), "note 3. immobilisations") is not None
    assert scalar(spark, text.enumerator("t", F.lit("xxx")), "note 3. immobilisations") is None
    assert scalar(spark, text.enumerator("t"), "la societe").strip() in text.NOT_ENUMERATORS


# ---- layout, content, language ---------------------------------------------------------------------------------


def test_layout(spark):
    df = spark.createDataFrame([(600.0, 800.0, 0), (600.0, 800.0, 90), (800.0, 600.0, 0)], "w double, h double, r int")
    assert [r[0] for r in df.select(layout.orientation(F.col("w"), F.col("h"), F.col("r"))).collect()] == ["P", "L", "L"]
    box = spark.range(1).select(*[layout.normalize_box(F.lit(v), F.lit(s)).alias(n) for n, v, s in (("a", 150, 600), ("b", 300, 1200), ("c", 450, 600), ("d", 600, 1200), ("e", 5, 0))]).first()
    assert tuple(box) == (250, 250, 750, 500, None)
    lines = spark.createDataFrame([("f", 1, 0, 10), ("f", 1, 1, 10), ("f", 1, 2, 25)], "file_name string, page_number int, line_number int, y int")
    assert [r[1] for r in rows(layout.renumber_lines(lines), "line_number", "line_index")] == [1, 1, 2]


def test_line_assembly_follows_the_opening_word(spark):
    w = [("A", 10, 10), ("B", 10, 10), ("C", 18, 12), ("D", 25, 10)]
    data = [("f", 1, 1, 0, i, t, 10 * i, top, 8, h, 5, 90) for i, (t, top, h) in enumerate(w)]
    cols = "file_name string, page_number int, block_num int, line_num int, word_num int, text string, left_px int, top_px int, width_px int, height_px int, level int, conf int"
    df = spark.createDataFrame(data + data[:1] + [("f", 1, 1, 0, 9, None, 0, 0, 1, 1, 5, 1), ("f", 1, 1, 0, 9, " ", 0, 0, 1, 1, 5, 1)], cols)
    assert rows(layout.assemble_lines(df), "line_index", "text") == [(0, "A B C"), (1, "D")]
    assert len(rows(layout.assemble_lines(df, "word"), "text")) == 4
    assert layout.assemble_lines(df.where("false")).count() == 0


def test_content_types(spark):
    page = lambda n, o: ("<p>" + " ".join(["w"] * n) + "</p>", ["w"] * o)
    cases = [(page(0, 0), "E", 1.0), (page(3, 0), "E", 0.5), (page(4, 10), "S", 0.6), (page(5, 10), "C", 0.5), (page(7, 10), "B", 0.7), (page(9, 10), "R", 0.9)]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, html string, words array<string>").select("i", content.content_type("html", F.col("words")).alias("c"))
    got = {r["i"]: (r["c"]["content_type"], r["c"]["confidence"]) for r in df.collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(cases)}


def test_page_language(spark):
    stop = spark.createDataFrame([("fra", "le"), ("eng", "the"), ("deu", "der"), ("fra", "und"), ("deu", "und")], "lang string, token string")
    tok = spark.createDataFrame([(1, "le"), (1, "le"), (1, "the"), (1, "x"), (2, "x"), (3, "le"), (3, "the"), (3, "der")], "id long, token string")
    assert rows(language.page_language(tok, stop)) == [(1, "fra", 0.66), (2, "fra", 0.0), (3, "fra", 0.33)]
    vocab = spark.createDataFrame([("deu", "the"), ("deu", "der"), ("fra", "q")], "lang string, token string")
    assert rows(language.page_language_two_stage(tok, stop, vocab))[2] == (3, "deu", 1.0)


# ---- ingest ----------------------------------------------------------------------------------------------------


def test_last_document_keeps_ties(spark):
    d = spark.createDataFrame([("A", 2015), ("A", 2016), ("A", 2016), ("B", 2014), (None, 2020), ("C", None)], "company_id string, document_year int")
    assert rows(ingest.last_document(d)) == [("A", 2016), ("A", 2016), ("B", 2014)]


def test_left_joins_keep_unmatched_and_extra_columns(spark):
    lines = spark.createDataFrame([("f", 1, 0, "t"), ("g", 2, 0, "u")], "file_name string, page_number int, line_number int, text string")
    pages = spark.createDataFrame([("f", 1, "fra"), ("f", 1, "fra")], "file_name string, page_number int, language string")
    assert {(r["file_name"], r["language"]) for r in ingest.lines_with_pages(lines, pages).collect()} == {("f", "fra"), ("g", None)}
    assert rows(ingest.unmatched_keys(lines, pages, ["file_name", "page_number"])) == [("g", 2)]


def test_statement_pages_and_scope(spark):
    data = [("f", p, 0, "x") for p in range(1, 6)] + [("f", 2, 1, ingest.STATEMENT_SENTENCES[0])]
    lines = spark.createDataFrame(data, "file_name string, page_number int, line_number int, text string")
    kept = ingest.skip_statement_pages(lines)
    assert {r["page_number"] for r in kept.collect()} == {1, 3, 4, 5}
    assert {r["page_number"] for r in ingest.layout_scope(kept).collect()} == {1, 3}
    assert ingest.layout_scope(lines.where("false")).count() == 0


def test_hot_join_is_a_join(spark):
    big = spark.createDataFrame([(i % 3 if i % 10 else None, i) for i in range(500)], "k long, v long")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, s string")
    want = rows(big.join(small, "k"), "v", "s")
    assert rows(hot_join(big, small, "k", least=1), "v", "s") == want
    assert hot_join(big, small, "k", "left", least=1).count() == 500


# ---- similarity and clusters -----------------------------------------------------------------------------------


def weighted(spark, sets):
    return spark.createDataFrame([(i, f, w) for i, s in sets.items() for f, w in s.items()], "id long, feature string, weight int")


def test_similarity_matches_brute_force(spark):
    rng = random.Random(3)
    sets = {i: {f"f{rng.randrange(14)}": 0 for _ in range(rng.randrange(1, 9))} for i in range(60)}
    sets = {i: {f: 1 + int(f[1:]) % 3 for f in s} for i, s in sets.items()}
    for num, den in ((83, 100), (1, 2)):
        want = set()
        for a in sets:
            for b in sets:
                s = sum(sets[a][f] for f in sets[a] if f in sets[b])
                if a < b and s and 2 * s * den >= num * (sum(sets[a].values()) + sum(sets[b].values())):
                    want.add((a, b))
        got = {(r["a"], r["b"]) for r in similarity.pair_overlaps(weighted(spark, sets), num, den, block=5).collect()}
        assert got == want


def test_contributions_affinity_prune(spark):
    f = weighted(spark, {1: {"a": 1, "b": 1}, 2: {"a": 1, "c": 1}})
    a = spark.createDataFrame([(1, 7), (2, 7), (2, 7)], "id long, cluster_id long")
    parts = similarity.contributions(f, a)
    assert rows(parts, "feature", "df", "n") == [("a", 2, 2), ("b", 1, 2), ("c", 1, 2)]
    assert round(cluster.affinity(parts).first()["affinity"], 6) == 0.666667
    assert cluster.prune(parts).count() == 3
    p5 = spark.createDataFrame([(1, x, 1, d, 5) for x, d in zip("abcd", (5, 3, 2, 1))], "cluster_id long, feature string, weight int, df long, n long")
    assert [r[0] for r in rows(cluster.prune(p5), "feature")] == ["a", "b"]
    assert rows(cluster.prune(cluster.prune(p5))) == rows(cluster.prune(p5))


def test_survivor_has_a_smaller_neighbour(spark):
    edges = lambda e: spark.createDataFrame(e, "a long, b long")
    assert set(rows(cluster.survivors(edges([(5, 2), (5, 3)])))) == {(2, 5), (3, 5), (5, 5)}
    assert set(rows(cluster.survivors(edges([(3, 2), (5, 3)])))) == {(2, 3), (3, 3), (5, 3)}


def test_merge_adds_up(spark):
    cols = "cluster_id long, feature string, weight int, df long, n long"
    parts = spark.createDataFrame([(1, "a", 1, 2, 2), (1, "b", 1, 1, 2), (2, "a", 1, 1, 1), (2, "c", 1, 1, 1)], cols)
    to = spark.createDataFrame([(1, 2), (2, 2)], "cluster_id long, survivor long")
    assert rows(cluster.merged(parts, to), "feature", "df", "n") == [("a", 3, 3), ("b", 1, 3), ("c", 1, 3)]
    assert rows(cluster.merged_average(parts, to)) == [(2, 3, 2.0)]


def test_leader_against_plain_loop(spark):
    rng = random.Random(5)
    sets = {i: {f"f{rng.randrange(12)}": 1 for _ in range(rng.randrange(4, 12))} for i in range(80)}
    want, groups = {}, []
    for i in sorted(sets):
        d = sets[i]
        if len(d) <= cluster.NOISE:
            want[i] = 0
            continue
        for k, g in enumerate(groups):
            s = sum(sum(f in sets[m] for m in g) / len(g) for f in d if any(f in sets[m] for m in g))
            total = len({f for m in g for f in sets[m]}) + len(d)
            if 2 * s / total >= 0.7 - 1e-12:
                g.append(i)
                want[i] = g[0]
                break
        else:
            groups.append([i])
            want[i] = i
    got = {r["id"]: r["cluster_id"] for r in cluster.leader_clusters(weighted(spark, sets), 70, 100).collect()}
    assert got == want
    blocks = cluster.leader_clusters(weighted(spark, sets), 70, 100, block=10)
    assert blocks.count() == len(sets)


@pytest.mark.parametrize("best", [False, True])
def test_leader_above_a_block_is_one_pass(spark, best):
    rng = random.Random(7)
    n = cluster.BLOCK + 300
    sets = {i: {f"a{k}": 1 for k in range(10)} for i in range(1, n, 2)}  # one family, some with a feature more or less
    for i in range(1, n, 10):
        sets[i] = {f"a{k}": 1 for k in range(9)} | {"x": 1}
    for i in range(0, n, 2):  # looser chains, some features of unequal weight
        at = rng.randrange(150)
        sets[i] = {f"b{at + k}": (4 if k == 3 and rng.random() < 0.5 else 1) for k in range(8)}
    lead, first, want = cluster.Leader(83, 100, best), [], {}
    for i in sorted(sets):
        c, distance = lead.add(sets[i])
        first += [i] if c == len(first) else []
        want[i] = (first[c], distance)
    got = {r["id"]: (r["cluster_id"], r["distance"]) for r in cluster.leader_clusters(weighted(spark, sets), best=best).collect()}
    assert got == want
    assert {got[i][0] for i in range(1, n, 2)} == {1}


@pytest.mark.parametrize("best", [False, True])
def test_leader_with_weights_that_differ(spark, best):
    rnd = random.Random(5)
    docs = {i: {f"f{k}": rnd.choice([4, 4, 4, 1]) if k < 4 else 1 for k in rnd.sample(range(12), rnd.randint(6, 9))} for i in range(1, 121)}
    lead, first, want = cluster.Leader(70, 100, best), [], {}
    for i, d in docs.items():
        c, distance = lead.add(d)
        if c == len(first):
            first.append(i)
        want[i] = (first[c], distance)
    df = spark.createDataFrame([(i, f, w) for i, d in docs.items() for f, w in d.items()], "id long, feature string, weight int")
    got = {r["id"]: (r["cluster_id"], r["distance"]) for r in cluster.leader_clusters(df, 70, 100, best).collect()}
    assert got == want


@pytest.mark.parametrize("best", [False, True])
def test_one_light_weight_does_not_pair_all_documents(spark, monkeypatch, best):
    n, sizes = 400, []

    def counting(df, name="t"):
        out = cut(df, name)
        if name == "candidates":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(similarity, "cut", counting)
    one = lambda i: [("enum", 1 if i == 1 else 4), ("p1", 1), ("p2", 1), *[(f"t{i}_{k}", 1) for k in range(3)]]
    df = spark.createDataFrame([(i, f, w) for i in range(1, n + 1) for f, w in one(i)], "id long, feature string, weight int")
    assert {r["cluster_id"] for r in cluster.leader_clusters(df, best=best).collect()} == set(range(1, n + 1))
    assert max(sizes) < 2 * n


def test_tables_are_dropped_and_codes_are_apart(spark):
    f = spark.createDataFrame([(i, f"x{i % 50}") for i in range(200)], "id long, feature string")
    got = similarity.coded(f)
    assert got.select("feature").distinct().count() == 50
    assert got.count() == 200
    drop(got)
    with pytest.raises(Exception, match="does not exist|not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        got.collect()


def test_merging_keeps_no_contributions(spark):
    import os

    names = lambda: {x for x in os.listdir(scratch(spark).removeprefix("file://")) if x.startswith(("parts-", "coded-"))}
    sets = {i: {f"f{k}" for k in range(12)} | {f"own{i}"} for i in (1, 2, 3)} | {9: {f"g{k}" for k in range(8)}}
    f = spark.createDataFrame([(i, x, 1) for i, d in sets.items() for x in d], "id long, feature string, weight int")
    cut(f.limit(1), "any")
    before = names()
    got = cluster.merge_clusters(f, f.select("id", F.col("id").alias("cluster_id")).distinct())
    assert names() == before
    assert rows(got) == [(1, 2), (2, 2), (3, 2), (9, 9)]


def test_soft_match_counts_against_matches(spark):
    rnd = random.Random(3)
    kinds = ["xPos", "wSize", "w", "pos_wSize"]
    data = {(i, f"{rnd.choice(kinds)}_{v}", float(v)) for i in range(1, 80) for v in [rnd.randint(0, 60) for _ in range(rnd.choice([1, 1, 1, 2, 4]))]}
    data |= {(i, "wSize_7", 7.0) for i in range(100, 130)} | {(200, "alone_900", 900.0), (201, "nan_1", float("nan")), (202, "xPos_3", None)}
    f = spark.createDataFrame(sorted(data, key=str), "id long, feature string, value double")
    want = similarity.soft_matches(f, f).where("a <> b").groupBy("a").agg(F.count_distinct("b").alias("others"), F.count("*").alias("matches"))
    assert rows(similarity.soft_match_counts(f)) == rows(want)


def test_subclusters_soft_values(spark):
    cols = "id long, feature string, level string, value double, weight int"
    f = spark.createDataFrame([(1, "xPos_100", "subcluster", 100.0, 1), (2, "xPos_105", "subcluster", 105.0, 1), (3, "xPos_200", "subcluster", 200.0, 1)], cols)
    a = spark.createDataFrame([(1, 4), (2, 4), (3, 4), (9, 4), (5, 0)], "id long, cluster_id long")
    got = {r["id"]: r["subcluster"] for r in cluster.subclusters(f, a).collect()}
    assert got[1] == got[2] != got[3] and 5 not in got and 9 in got
    m = similarity.soft_matches(f.select("id", "feature", "value"), f.select("id", "feature", "value"))
    assert {(r["a"], r["b"]) for r in m.collect()} == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}


def test_soft_score_counts_near_features_beside_exact_ones():
    lead = cluster.SubLeader(0.7)
    assert lead.add({"xPos_100": (1, 100.0)}) == (0, 1.0)
    assert lead.add({"xPos_100": (1, 100.0), "xPos_103": (1, 103.0)}) == (0, 4 / 3)
    assert {f: x[0] for f, x in lead.clusters[0]["features"].items()} == {"xPos_100": 2, "xPos_103": 1}
    assert lead.add({"xPos_98": (1, 98.0)})[0] == 0  # both features of the sub-cluster are near and gain a document
    assert {f: x[0] for f, x in lead.clusters[0]["features"].items()} == {"xPos_100": 3, "xPos_103": 2, "xPos_98": 1}
    assert lead.add({}) == (1, 1.0) and lead.add({}) == (2, 1.0)


def test_subclusters_against_a_plain_loop(spark):
    rng = random.Random(31)
    docs = {}
    for i in range(120):
        base = rng.choice([100, 180, 260])
        xs = {base + 4 * rng.randrange(6) for _ in range(rng.randrange(1, 5))}
        docs[i] = {**{f"xPos_{x}": float(x) for x in xs}, **{f"wSize_{w}": float(w) for w in {rng.choice([50, 53, 60, 90]) for _ in range(2)}}, **({"text_a": None} if rng.random() < 0.5 else {})}
    member = {i: 1 + i % 2 for i in docs}
    want, subs = {}, {1: [], 2: []}
    for i in sorted(docs):
        best, at, hit = 0, None, None
        for k, (n, df) in enumerate(subs[member[i]]):
            near = {(f, g) for f in df for g in docs[i] if df[f][1] is not None and docs[i][g] is not None and f.split("_")[0] == g.split("_")[0] and abs(df[f][1] - docs[i][g]) <= 5}
            mine = {f for f in df if f in docs[i]} | {f for f, _ in near}
            theirs = {g for _, g in near} - set(df)
            score = Fraction(2, len(df) + len(docs[i])) * (sum(Fraction(df[f][0], n) for f in mine) + len(theirs))
            if score >= Fraction(7, 10) and score > best:
                best, at, hit = score, k, mine
        if at is None:
            subs[member[i]].append([1, {f: [1, v] for f, v in docs[i].items()}])
            best, at = 1, len(subs[member[i]]) - 1
        else:
            entry = subs[member[i]][at]
            entry[0] += 1
            for f in hit:
                entry[1][f][0] += 1
            for f, v in docs[i].items():
                entry[1].setdefault(f, [1, v])
        want[i] = (member[i], at, float(best))
    f = spark.createDataFrame([(i, x, "subcluster", v, 1) for i, d in docs.items() for x, v in d.items()], "id long, feature string, level string, value double, weight int")
    a = spark.createDataFrame(list(member.items()), "id long, cluster_id long")
    got = {r["id"]: (r["cluster_id"], r["subcluster"], r["distance"]) for r in cluster.subclusters(f, a).collect()}
    assert got == want and max(x[1] for x in want.values()) > 3


def test_merging_against_a_plain_loop(spark):
    rng = random.Random(17)
    sets, assigned = {}, {}
    for c in range(1, 25):
        core = [f"k{c // 5}_{j}" for j in range(14)]
        for _ in range(rng.randrange(1, 8)):
            i = len(sets)
            sets[i] = {f: 1 for f in rng.sample(core, 11)} | {f"o{rng.randrange(40)}": 1}
            assigned[i] = c
    def table(docs):
        out = {}
        for i, c in assigned.items():
            out.setdefault(c, [0, {}])
            out[c][0] += 1
            for f in sets[i]:
                out[c][1][f] = out[c][1].get(f, 0) + 1
        return {c: [n, {f: d for f, d in df.items() if n <= 4 or d > 2}] for c, (n, df) in out.items()}

    parts, to = table(sets), {c: c for c in assigned.values()}
    for _ in range(10):
        edges = []
        for b in sorted(parts):
            for a in sorted(parts):
                (nb, fb), (_, fa) = parts[b], parts[a]
                if a > b and fa and fb:
                    score = Fraction(2 * sum(d for f, d in fb.items() if f in fa), nb * (len(fa) + len(fb)))
                    if score >= Fraction(8, 10) * (Fraction(105, 100) if min(len(fa), len(fb)) < 10 else 1):
                        edges.append((a, b))
        if not edges:
            break
        group = {c: c for c in parts}
        for _ in parts:
            for a, b in edges:
                group[a] = group[b] = min(group[a], group[b])
        for g in set(group.values()):
            inside = [c for c in parts if group[c] == g]
            if len(inside) > 1:
                head = min(c for c in inside if any(a == c for a, _ in edges))
                n, df = sum(parts[c][0] for c in inside), {}
                for c in inside:
                    for f, d in parts[c][1].items():
                        df[f] = df.get(f, 0) + d
                    to = {k: head if v == c else v for k, v in to.items()}
                for c in inside:
                    del parts[c]
                parts[head] = [n, df]
    got = cluster.merge_clusters(weighted(spark, sets), spark.createDataFrame(list(assigned.items()), "id long, cluster_id long"))
    assert {r["id"]: r["cluster_id"] for r in got.collect()} == {i: to[c] for i, c in assigned.items()}
    assert len(set(to.values())) < len(to)


def test_subclusters_of_a_cluster_above_a_block(spark):
    ids = spark.range(1, cluster.BLOCK + 2)
    f = ids.select("id", F.explode(F.array(*[F.lit(f"xPos_{v}") for v in (100, 200, 300)])).alias("feature"), F.lit("subcluster").alias("level"))
    f = f.withColumn("value", F.substring_index("feature", "_", -1).cast("double")).withColumn("weight", F.lit(1))
    got = cluster.subclusters(f, ids.withColumn("cluster_id", F.lit(1).cast("long")))
    assert got.count() == cluster.BLOCK + 1 and got.select("cluster_id", "part", "subcluster").distinct().count() == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
def test_components_are_those_of_union_find(spark, edges):
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = rows(connected_components(spark.createDataFrame(edges, "a long, b long")), "v", "label")
    assert got == sorted((v, root(v)) for v in linked)


def test_components_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(1).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = connected_components(chain)
    assert got.count() == 400 and {r["label"] for r in got.collect()} == {0}
    assert connected_components(chain.where("false")).count() == 0


# ---- evaluation and labelling ----------------------------------------------------------------------------------


def test_pair_index(spark):
    part = lambda d: spark.createDataFrame([(i, c) for c, ids in d.items() for i in ids], "id string, cluster long")
    pred, true = part({1: ["a", "b"], 2: ["c"]}), part({1: ["a"], 2: ["b", "c"]})
    assert [round(r[1], 6) for r in rows(evaluate.pair_index(pred, true))] == [0.5, 0.333333, 0.5]
    assert round(evaluate.mean_pair_index(pred, true).first()[0], 6) == 0.444444
    assert evaluate.mean_pair_index(pred, pred).first()[0] == 1.0
    assert evaluate.mean_pair_index(pred, true.where("id = 'a'")).first()[0] == pytest.approx(1 / 6)


def test_company_accuracy(spark):
    d = spark.createDataFrame([("c", k, 0) for k in (1, 1, 2, 0)] + [("n", 0, 0), (None, 1, 1)], "company_id string, cluster_id long, subcluster int")
    got = {r["company_id"]: (r["documents"], r["clusters"], r["per_cluster"]) for r in evaluate.company_accuracy(d).collect()}
    assert got == {"c": (4, 2, 2.0), "n": (1, 0, None)}


def test_metrics_of_nothing(spark):
    m = evaluate.run_metrics(spark.createDataFrame([], "id long, cluster_id long")).first()
    assert m["documents"] == 0 and m["share"] == 0.0


def test_greedy_selection(spark):
    sets = {1: ["f1", "f2", "f3"], 2: ["f3", "f4"], 3: ["f5", "f1"]}
    f = spark.createDataFrame([(i, x, "title") for i, s in sets.items() for x in s], "id long, feature string, type string")
    a = spark.createDataFrame([(i, 1) for i in sets] + [(8, 0)], "id long, cluster_id long")
    got = labelling.candidates(f, a)
    assert rows(got, "id", "pick", "new_features", "left_features") == [(1, 1, 2, 0)]
    c = labelling.coverage(f, a, got).first()
    assert (c["selected"], c["documents"], c["covered"], c["headings"]) == (1, 3, 2, 2)
    assert {r["id"]: r["labelled"] for r in labelling.representation(f, a, got).collect()} == {1: 3, 2: 1, 3: 1}
    assert labelling.candidates(f.where("false"), a).count() == 0


# ---- fingerprint -----------------------------------------------------------------------------------------------


def test_extracts_each_kind(spark):
    cols = "file_name string, page_number int, line_number int, text string, x int, y int, w double, h double, page_width double, language string, orientation string"
    t = [("A) Immobilisations corporelles", 100, 10), ("les immobilisations sont", 100, 10), ("Capital souscrit", 120, 40), (None, 130, 50), ("", 700, 60)]
    lines = spark.createDataFrame([("f", 1, i, s, x, y, 150.0, 12.0, 600.0, "fra", "P") for i, (s, x, y) in enumerate(t)], cols)
    got = {r["feature"] for r in features.extract_features(lines).collect()}
    assert {"language_1_fra", "orientation_1_P", "xPos_100", "wSize_150.0", "hSize_12.0", "subtitle_immobilisations corporelles", "text_les immobilisations sont", "title_capital souscrit"} <= got
    assert features.extract_features(lines.where("false")).count() == 0


def test_cleans_features(spark):
    cols = "doc_id long, feature string, type string, level string, value double, frequency int"
    f = spark.createDataFrame([(1, " Title_A\t", "title", "cluster", None, 1), (1, "title_a", None, "cluster", None, None), (1, None, "x", "cluster", None, 1), (None, "b", "x", "cluster", None, 1)], cols)
    assert rows(features.clean_features(f), "id", "feature", "weight") == [(1, "title_a", 1)]


def test_cut_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") > 5, F.lit("a")))
    assert rows(cut(df), "id") == rows(df, "id")


def shuffles(df):
    """The columns (name, type) that each shuffle of a plan carries."""

    def walk(p):
        if p.nodeName() == "AdaptiveSparkPlan":
            p = p.initialPlan()
        if p.nodeName() == "Exchange":
            yield {(p.output().apply(i).name(), p.output().apply(i).dataType().simpleString()) for i in range(p.output().size())}
        for i in range(p.children().size()):
            yield from walk(p.children().apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("name", ["document_records", "leader_cluster_best"])
def test_no_shuffle_or_table_holds_the_names_of_features(spark, sf, monkeypatch, name):
    from pagewright.operators import graph
    from pagewright.plans import queries

    plans, tables = [], []

    def watching(df, name="t"):
        plans.extend(shuffles(df))
        tables.append(set(df.dtypes))
        return cut(df, name)

    for m in (cluster, graph, queries, similarity):
        monkeypatch.setattr(m, "cut", watching)
    plans += shuffles(queries.queries()[name](spark, sf))
    assert any(("feature", "bigint") in p for p in plans)
    assert not [p for p in plans + tables if ("feature", "string") in p]


def test_coded_features_are_the_clean_features(spark, monkeypatch):
    raw = [(1, " A ", "page", "cluster"), (1, "a", None, "subcluster"), (1, "b", "enumerator", "cluster"), (2, "B\t", "title", None), (2, None, "page", "cluster"), (None, "a", "page", "cluster")]
    raw = spark.createDataFrame([(*r, None, 1) for r in raw], "doc_id long, feature string, type string, level string, value double, frequency int")
    want = features.clean_features(raw)
    hashed = F.xxhash64
    # all names share a number under salt 0
    monkeypatch.setattr(F, "xxhash64", lambda a, b: F.lit(7).cast("long") if a is zero else hashed(a, b))
    zero = F.lit(0)
    lit = F.lit
    monkeypatch.setattr(F, "lit", lambda x: zero if x == 0 and x is not False else lit(x))
    got = features.coded_features(raw)
    monkeypatch.undo()
    key = F.xxhash64(F.lit(1), "feature").alias("feature")
    assert rows(got, "id", "feature", "weight") == rows(want.select("id", key, "weight"))
    assert {(r["id"], r["feature"]): r["level"] for r in got.collect()} == {(r["id"], r["feature"]): r["level"] for r in want.select("id", key, "level").collect()}
