"""Languages, scans, packing, leaks, cuts: held-out accuracy, brute force, edge cases."""

import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import cuts, editor, langid, leaks, packing, queries, scans
from pagewright.sources.tables import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, file_name string, ingested_at timestamp"
LINES = "file_name string, page_number int, line_number int, text string, x int, y int, x2 int, y2 int, w double, h double, avg_h double"
PAGES = "file_name string, page_number int, page_width double, page_height double, orientation string, angle int, language string, lang_confidence double, content_type string, read_confidence double, encrypted string, number_images int"
JOBS = "job_id long, file_name string, page_start int, page_end int, total_pages int, split_type string, detect_lang boolean, lang string, submitted_at timestamp"

EN = ["The company has approved the annual accounts of the year.", "The board of managers still holds the shares in the subsidiary.", "The average headcount was higher than in the previous year."]
FR = ["La société a approuvé les comptes annuels de l'exercice.", "Le conseil de gérance détient toujours les parts de la filiale.", "L'effectif moyen était plus élevé que l'année précédente."]
DE = ["Die Gesellschaft hat den Jahresabschluss des Jahres genehmigt.", "Der Geschäftsführungsrat hält weiterhin die Anteile an der Tochter.", "Die durchschnittliche Belegschaft war höher als im Vorjahr."]


def docs(spark, rows, lang=None, source="s"):
    return spark.createDataFrame([(i, x, lang, source, 0, None, datetime(2020, 1, 1)) for i, x in rows], DOCS)


# ---- problem 2 -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        lang, base = (("en", EN), ("FR", FR), ("ger", DE))[i % 3]
        text = " ".join(rng.choice(base) for _ in range(4))
        rows.append((i, text, "nl" if i == 7 else lang, "s", len(text), f"f{i}", datetime(2020, 1, 1)))
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def model(labelled):
    return langid.model_for(labelled)


def test_labels(spark):
    got = spark.createDataFrame([(x,) for x in (" FR ", "fr-LU", "English", "en_GB", "ger", "und", "", None, "?", "dut", "Spanish")], "l string").select(langid.label("l")).collect()
    assert [r[0] for r in got] == ["fra", "fra", "eng", "eng", "deu", None, None, None, None, "nld", "spa"]


def test_forward_sums_all_segmentations(model):
    word = langid.marked("company")

    def total(s):
        if not s:
            return np.ones(len(langid.LANGS))
        out = np.zeros(len(langid.LANGS))
        for j in range(1, len(s) + 1):
            k = model.pieces.get(s[:j])
            if k is not None:
                out = out + model.p[k] * total(s[j:])
            elif j == 1:
                out = out + model.single * total(s[1:])
        return out

    assert np.allclose(model.forward(word), np.log(total(word)))


def test_reads_documents(spark, labelled, model):
    mixed = "\n".join([*EN[:2], *FR[:2]])
    single = "\n".join([EN[0], EN[1], FR[0], EN[2]])
    rows = [(1, mixed), (2, single), (3, EN[0]), (4, "12 345"), (5, ""), (6, None), (7, DE[0].upper()), (8, mixed)]
    got = {r["doc_id"]: r for r in langid.document_languages(docs(spark, rows).withColumn("label", F.lit("x")), model).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7, 8}
    assert got[1]["langs"] == ["eng", "fra"] and [s["lang"] for s in got[1]["segments"]] == ["eng", "fra"]
    assert mixed[got[1]["segments"][1]["first"] :].startswith(FR[0])
    assert got[2]["langs"] == ["eng"] and got[3]["langs"] == ["eng"] and got[7]["lang"] == "deu"
    assert got[4]["lang"] is None and got[4]["langs"] == [] and got[5]["lang"] is None
    assert 0.2 <= got[3]["confidence"] <= 1


def test_long_words_are_scored_whole(model):
    word = langid.marked("gesellschafterversammlung")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "LONG", 10**9)
        plain = model.forward(word)
    assert len(word) > langid.LONG and np.allclose(model.forward(word), plain)
    assert np.isfinite(model.forward(langid.marked("x" * 5_000))).all()


@pytest.mark.parametrize("text, n", [
    ("As shown in note 12. The board approved it.", 2), ("Beschluss vom 9. April 2011. Der Vorstand prüfte 3. Dezember.", 2), ("12. The board approved it.", 1), ("It rose by 3.5 per cent. So it did.", 2),
    ("Granted to Keltav S.A. The board approved it.", 2), ("Granted to Keltav S.à r.l. for one year.", 1), ("He met J. Smith. Then he left.", 2), ("One\r\nTwo.\n\nThree", 3), ("", 0), (" . ", 1),
])
def test_sentences(text, n):
    assert len(list(langid.sentences(text))) == n


def test_two_sentences_after_a_number_count(spark, model):
    text = " ".join([*EN, FR[0].rstrip(".") + " en 2009.", FR[1].rstrip(".") + " à la note 12.", EN[0]])
    assert next(langid.read_texts([text], langid.Scorer(model)))[2] == ["eng", "fra"]


def test_wrong_labels_fade(spark, model):
    held = {"eng": "The subsidiary has approved the shares of the board.", "fra": "La filiale a approuvé les parts de la société.", "deu": "Die Tochter hat die Anteile der Gesellschaft genehmigt."}
    for lang, x in held.items():
        assert next(langid.read_texts([x], langid.Scorer(model)))[0] == lang


def test_found_documents_and_jobs(spark, labelled):
    line = lambda f, p, i, x: (f, p, i, x, 0, 0, 1, 1, 1.0, 1.0, 1.0)
    lines = spark.createDataFrame([line("a", 1, 0, EN[0]), line("a", 2, 0, FR[0]), line("b", 1, 0, DE[0]), line("b", 1, 0, DE[0]), line(None, 1, 0, DE[0]), line("b", 2, 1, None), line("c", 1, 0, "99")], LINES)
    jobs = [(1, "a", 0, 2, 2, "line", True, "en", datetime(2020, 1, 1)), (2, "b", 0, 1, 1, "line", True, "de", datetime(2020, 1, 1)), (3, "b", 0, 1, 1, None, None, None, None), (3, "b", 0, 1, 1, None, None, "de-LU", datetime(2020, 1, 2)), (4, "c", 0, 1, 1, None, None, None, None), (5, "zz", 0, 1, 1, None, None, None, None)]
    got = {tuple(r) for r in langid.found(labelled, spark.createDataFrame(jobs, JOBS), lines).collect()}
    assert {g for g in got if g[0] == "job"} == {("job", 1, "eng"), ("job", 1, "fra")}
    assert ("doc", 7, "fra") in got and not any(g[1] == 8 for g in got if g[0] == "doc")


# ---- problem 7 -------------------------------------------------------------------------------------------------


WORDS = "company approved annual accounts board managers shares subsidiary average headcount previous revolving credit following decision recorded absorbing entity interest accrued commitments undertaking".split()


def test_editor_repairs_held_out_corruptions():
    lex = editor.Lexicon({w: 10 for w in WORDS}, (), (), editor.train(WORDS))
    rng = random.Random(99)
    tried = hit = 0
    for _ in range(300):
        w = rng.choice(WORDS)
        noisy, _ = editor.corrupted(w, rng)
        if noisy != w:
            tried += 1
            hit += lex.repair(noisy) == w
    assert hit / tried >= 0.85
    assert all(lex.repair(w) is None for w in WORDS)
    assert lex.repair("xylophone") is None


def made_up_words(rng, n):
    """Pronounceable words with shared endings, as a language has them."""
    stems = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(n)]
    return sorted({s + rng.choice(["tion", "ment", "ing", "s", "er", "al"]) for s in stems})


def test_editor_reads_numbers_it_was_not_trained_on():
    ed, rng = editor.train(made_up_words(random.Random(1), 200)), random.Random(123)
    tried = hit = kept = 0
    for _ in range(400):
        n = editor.number(rng)
        kept += ed.readings(n)[0] == n
        noisy, ops = editor.misread_number(n, rng)
        assert "".join(ops) == n
        if noisy != n:
            tried += 1
            hit += next((r for r in ed.readings(noisy) if scans.NUMBER.fullmatch(r)), None) == n
    assert kept == 400 and hit / tried >= 0.85


def test_line_joins_of_words_that_were_held_out():
    rng = random.Random(5)
    words = made_up_words(rng, 900)
    rng.shuffle(words)
    counts = {w: rng.randrange(3, 500) for w in words[:500]} | {f"{a}-{b}": 20 for a, b in zip(words[:60], words[60:120])}
    ed = editor.Editor({}, {}, editor.train_breaks(counts, {}))
    facts = lambda a, b: (counts.get(a + b, 0), counts.get(f"{a}-{b}", 0), counts.get(a, 0), counts.get(b, 0))
    held = [(w[:k], w[k:]) for w in words[500:] for k in (len(w) // 2,)]
    assert sum(ed.joins(a, b, rng.choice("-‐¬"), facts(a, b)) for a, b in held) >= 0.95 * len(held)
    compounds = [k.split("-") for k in counts if "-" in k]
    assert sum(not ed.joins(a, b, "-", facts(a, b)) for a, b in compounds) >= 0.95 * len(compounds)
    suspended = [(a, b) for a, b in zip(words[120:300], words[300:480])]  # two words, the first with its second part left out
    assert sum(not ed.joins(a, b, "-", facts(a, b)) for a, b in suspended) >= 0.9 * len(suspended)


def test_near_texts_are_all_found(spark):
    rng = random.Random(8)
    models = {"".join(rng.choice("ab -<x>") for _ in range(rng.randrange(8, 16))) for _ in range(25)}
    texts = set()
    for m in models:
        for edits in (0, 1, 2, 3, 4):
            t = list(m)
            for _ in range(edits):
                k, i = rng.randrange(3), rng.randrange(len(t))
                t[i : i + (k != 0)] = [] if k == 1 else [rng.choice("abc")]
            texts.add("".join(t))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    df = lambda x: spark.createDataFrame([(t,) for t in sorted(x)], "g string")
    got = {r["g"] for r in scans.near_texts(df(texts), df(models)).collect()}
    assert got == {t for t in texts if any(distance(t, m) <= 2 for m in models)}


def test_rare_words_are_looked_up(spark):
    lines, pages, d = scan_fixture(spark)
    words = scans.vocabulary(d)
    all_known, _, _, least = scans.frequent(words)
    few, _, _, more = scans.frequent(words, most=5)
    assert least == scans.KNOWN and more > least and len(few) <= 5 < len(all_known)
    whole = scans.judged(lines, pages, d)
    # the same editor for both, as it is trained on the frequent words
    fitted = scans.fit
    try:
        trained = fitted(all_known)
        scans.fit = lambda _: trained
        cols = ["file_name", "page_number", "line_number", "kind", "hyphen", "misread", "text"]
        a = sorted(map(str, scans.judged(lines, pages, d).select(*cols).collect()))
        assert a == sorted(map(str, scans.judged(lines, pages, d, most=5).select(*cols).collect()))
    finally:
        scans.fit = fitted
    assert whole.where("misread").count() > 0


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(WORDS), st.integers(0, 10_000))
def test_operations_give_back_the_word(word, seed):
    noisy, ops = editor.corrupted(word, random.Random(seed))
    assert len(noisy) == len(ops) and "".join(ops) == word


def scan_fixture(spark):
    pages = {
        1: ["Tavsto Partners - Annual accounts 2018", "The company has approved the annual acc-", "ounts of the board. The Short-", "term credit of 12,5O0 euros was recorded", "by the absorb ing entity.", "[1]"],
        2: ["TAVSTO PARTNERS", "The board has approved the aver4ge headcount.", "104", "The subsidiary holds shares.", "[2]"],
        3: ["Tavsto Partners - Annual accounts 2018", "The commitments of the managers.", "[3]"],
        4: ["TAVSTO PART1ERS", "The interest accrued.", "[4]"],
    }
    rows = []
    for n, f in enumerate("abcd"):
        for p, ls in pages.items():
            own = [ls[0], " ".join(WORDS[(5 * n + 3 * p + k) % len(WORDS)] for k in range(4)) + ".", ls[-1]]
            for i, x in enumerate(ls if f == "a" else own):
                left = 1180 if x.startswith("[") else 1650 if x == "104" else 230
                rows.append((f, p, i, x, left, 100 + 60 * i, left + (70 if left > 1000 else 1400), 140 + 60 * i, 1.0, 40.0, 40.0))
    rows.append(rows[1])
    text = "The company has approved the annual accounts of the board. The Short-term credit was recorded by the absorbing entity. The average headcount. The subsidiary holds shares. The commitments of the managers. The interest accrued. euros"
    return spark.createDataFrame(rows, LINES).withColumn("kind", F.lit("clash")), spark.createDataFrame([], PAGES), docs(spark, [(i, text) for i in range(30)] + [(99, None), (98, "")])


def test_scan_noise(spark):
    lines, pages, d = scan_fixture(spark)
    got = {tuple(r) for r in scans.found(lines, pages, d).collect() if r["file_name"] == "a"}
    want = {("a", p, 0, "header") for p in range(1, 5)} | {("a", 1, 5, "pageno"), ("a", 2, 4, "pageno"), ("a", 3, 2, "pageno"), ("a", 4, 2, "pageno")}
    want |= {("a", 1, 1, "hyphen"), ("a", 1, 3, "misread"), ("a", 1, 4, "misread"), ("a", 2, 1, "misread")}
    assert got == want
    out = " ".join(r["text"] for r in scans.paragraphs(lines, pages, d).where("file_name = 'a'").orderBy("paragraph").collect())
    assert "annual accounts of the board" in out and "Short-term credit" in out and "absorbing entity" in out and "average headcount" in out
    assert "TAVSTO" not in out and "[1]" not in out
    assert scans.found(lines.where("false"), pages, d).count() == 0
    assert scans.found(lines, pages, d.where("false")).count() > 0


def test_misread_heads_of_a_file_with_many(spark):
    lines, pages, d = scan_fixture(spark)
    heads = [f"{x} chapter of accounts" for x in "Alpha Bravo Delta Foxtrot Hotel India Kilo Lima Oscar Tango Zulu".split()]
    tops = [h for h in heads for _ in range(2)] + [h.replace("chapter of acc", "chapt3r of a3c") for h in heads]
    rows = [("z", p, i, x, 230, 100 + 60 * i, 1630, 140 + 60 * i, 1.0, 40.0, 40.0) for p, h in enumerate(tops, 1) for i, x in enumerate((h, "The board has approved the accounts.", "The interest accrued."))]
    got = scans.found(lines.select(*spark.createDataFrame([], LINES).columns).unionByName(spark.createDataFrame(rows, LINES)), pages, d)
    assert {r["page_number"] for r in got.where("file_name = 'z' and kind = 'header' and line_number = 0").collect()} == set(range(1, len(tops) + 1))


# ---- problem 8 -------------------------------------------------------------------------------------------------


def test_packing_keeps_every_token_and_every_limit(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([3, 20, 100, 500, 900, 2500])) for i in range(3000)] + [(9000, 0), (9001, 1), (1, 7)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    p = packing.packed(df, tokens=1000, documents=12, attention=1000.0**2, part=400).collect()
    assert sum(r["tokens"] for r in p) == sum(n for _, n in sizes)
    per = {}
    for r in p:
        c = per.setdefault(r["container_id"], [0, 0, 0])
        c[0] += r["tokens"]
        c[1] += 1
        c[2] += r["tokens"] ** 2
    assert all(a <= 1000 and b <= 12 and c <= 1000**2 for a, b, c in per.values())
    pieces = {}
    for r in p:
        pieces.setdefault(r["doc_id"], []).append(r["tokens"])
    assert all(len(v) == 1 or max(n for i, n in sizes if i == d) > 1000 or d == 1 for d, v in pieces.items())
    assert sum(a for a, _, _ in per.values()) / len(per) > 950
    assert packing.packed(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, tokens=1000, attention=10.0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_never_overfills(tokens):
    b = packing.best_fit(np.array(tokens, dtype=np.int64), (50.0, 4.0, 2500.0))
    assert all(np.array(tokens)[b == k].sum() <= 50 and (b == k).sum() <= 4 for k in set(b.tolist()))


def test_each_capacity_decides_a_placement():
    cap = (100.0, 3.0, 5000.0)
    # tokens: 60 and 40 fill a container, the 50 opens another
    assert packing.best_fit(np.array([60, 50, 40]), (100.0, 9.0, 1e9)).tolist() == [0, 1, 0]
    # attention: 60 and 40 cost 5200, so 40 goes to the 50 (4100)
    assert packing.best_fit(np.array([60, 50, 40]), (100.0, 9.0, 5000.0)).tolist() == [0, 1, 1]
    # documents: the first container has its three, the next small one must open a new one
    assert packing.best_fit(np.array([10, 10, 10, 10]), cap).tolist() == [0, 0, 0, 1]
    # a weight decides between two that can take the item: 8 leaves less attention in the first, fewer tokens in the second
    tokens = np.array([70, 20, 20, 20, 8])
    by_tokens = packing.best_fit(tokens, (80.0, 9.0, 6000.0), (1.0, 0.0, 0.0)).tolist()
    by_attention = packing.best_fit(tokens, (80.0, 9.0, 6000.0), (0.0, 0.0, 1.0)).tolist()
    by_documents = packing.best_fit(tokens, (80.0, 9.0, 6000.0), (0.0, 1.0, 0.0)).tolist()
    assert by_tokens == [0, 1, 1, 1, 0] and by_attention == [0, 1, 1, 1, 0] and by_documents == [0, 1, 1, 1, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 9), st.integers(2500, 6000))
def test_best_fit_keeps_all_three_limits(tokens, documents, attention):
    t = np.array(tokens, dtype=np.int64)
    b = packing.best_fit(t, (90.0, float(documents), float(attention)))
    assert all(t[b == k].sum() <= 90 and (b == k).sum() <= documents and (t[b == k] ** 2).sum() <= attention for k in set(b.tolist()))


def test_packing_under_a_binding_attention_budget(spark):
    rng = random.Random(21)
    sizes = [(i, rng.choice([5, 30, 120, 400, 700, 999, 3000])) for i in range(2000)]
    p = packing.packed(spark.createDataFrame(sizes, "doc_id long, tokens long"), tokens=1000, documents=40, attention=250_000.0, part=300).collect()
    per, of = {}, {}
    for r in p:
        per.setdefault(r["container_id"], []).append(r["tokens"])
        of.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
    assert all(sum(x) <= 1000 and len(x) <= 40 and sum(n * n for n in x) <= 250_000 for x in per.values())
    assert all(sum(n for _, n in of[i]) == n and (len(of[i]) > 1) == (n > 500) for i, n in sizes)
    cost = sum(n * n for x in per.values() for n in x) / 250_000
    # the scarcer of the two capacities is nearly used up
    assert len(per) <= 1.08 * max(cost, sum(n for _, n in sizes) / 1000)


def test_packing_of_what_cannot_be_combined(spark):
    p = packing.packed(spark.range(900).select(F.col("id").alias("doc_id"), F.lit(60).cast("long").alias("tokens")), tokens=100, documents=5, part=100)
    assert p.count() == 900 and p.select("container_id").distinct().count() == 900


def test_token_counts_of_odd_texts(spark):
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(docs(spark, [(1, "two words"), (2, ""), (3, None), (4, "x " * 50_000)]).withColumn("tokens", F.lit("clash"))).collect()}
    assert set(got) == {1, 2, 4} and got[2] == 0 and got[4] >= 50_000


# ---- problem 9 -------------------------------------------------------------------------------------------------


ITEM = "Read the case and choose one answer. The quarry liquidator of Caldyoro capitalises a bundle of 26 unsigned warrants before the harvest audit of 2009. A beekeeping syndicate of Felgoro restates 32 tonnes of reclaimed slate so that the widow's share stays whole. The tramway contractor swaps an option over winter pasture."
FILL = "The company has approved the annual accounts of the year following the decision taken by the board of managers in exchange for a bank guarantee. "


def brute(doc, item):
    """Longest common subsequence of the words over the best window of at most 1.4 times the item's length."""
    d, i = leaks.plain_words(doc), leaks.plain_words(item)
    best, n = 0, int(1.4 * len(i))
    for a in range(0, max(1, len(d) - n + 1), 3):
        w = d[a : a + n]
        row = [0] * (len(i) + 1)
        for x in w:
            new = [0]
            for k, y in enumerate(i):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        best = max(best, row[-1])
    return best / len(i)


def test_leaks(spark):
    w = ITEM.split()
    rng = random.Random(5)
    slips = " ".join(x[:-2] + x[-1] + x[-2] if len(x) > 5 and rng.random() < 0.25 else x for x in w if rng.random() > 0.05)
    part = " ".join(w[: int(len(w) * 0.75)])
    rows = [
        (1, FILL + ITEM + FILL), (2, FILL + ITEM.upper()), (3, ITEM.lower().replace(".", "").replace("'", "").replace(" ", "\n  ")), (4, FILL * 3 + slips + FILL), (5, FILL + part + ". " + FILL),
        (6, FILL * 4), (7, "Read the case and choose one answer. " + FILL), (8, " ".join(w[:18])), (9, " ".join(w[:20]) + " " + FILL * 8 + " ".join(w[20:40])), (10, ""), (11, None), (1, FILL + ITEM + FILL), (12, " ".join(reversed(w))),
    ]
    items = spark.createDataFrame([(7, ITEM, "en", "test"), (7, ITEM, "en", "test"), (8, "", "en", "test"), (9, None, "en", "test"), (None, ITEM, "en", "test")], "item_id long, text string, lang string, split_name string")
    d = docs(spark, rows).withColumn("item_id", F.lit(0))
    got = {tuple(r) for r in leaks.found(d, items).collect()}
    assert got == {(i, 7) for i in (1, 2, 3, 4, 5)}
    for i in (1, 2, 3, 5, 6, 7, 8, 12):
        assert (brute(dict(rows)[i], ITEM) >= 0.6) == ((i, 7) in got)
    clean = {r["doc_id"]: r["text"] for r in leaks.cleaned(docs(spark, rows[:3]), items).collect()}
    assert "quarry" not in clean[1] and clean[1].count("bank guarantee") == 2
    assert leaks.found(d, items.where("false")).count() == 0 and leaks.found(d.where("false"), items).count() == 0


def test_item_passes_cover_all(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS_PER_PASS", 2)
    items = spark.createDataFrame([(i, ITEM.replace("Caldyoro", f"Place{i}")) for i in range(7)], "item_id long, text string")
    got = leaks.found(docs(spark, [(1, ITEM)]), items)
    assert {r["item_id"] for r in got.collect()} == set(range(7))


def damaged(item, rate, rng):
    """The words with about `rate` of them missing or misspelled."""
    out = []
    for w in item:
        if rng.random() >= rate:
            out.append(w)
        elif rng.random() < 0.5:
            k = rng.randrange(1, len(w) - 2)
            out.append(w[:k] + w[k + 1] + w[k] + w[k + 2 :])
    return out


@pytest.mark.parametrize("rate, least", [(0.1, 1.0), (0.2, 1.0), (0.3, 0.97), (0.4, 0.9)])
def test_recall_of_damaged_passages(rate, least):
    rng = random.Random(int(rate * 100))
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 10))) for _ in range(4000)]
    fill = [rng.choice(vocab) for _ in range(200)]
    tried = hit = 0
    for _ in range(150):
        item = [rng.choice(vocab) for _ in range(rng.randrange(30, 70))]
        doc = fill[:100] + damaged(item, rate, rng) + fill[100:]
        if leaks.align(item, doc)[0] >= leaks.PART * len(item):
            tried += 1
            hit += bool(leaks.Items([(1, " ".join(item))]).scan(" ".join(doc)))
    assert tried > 100 and hit >= least * tried


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=12), st.lists(st.sampled_from("abcde"), max_size=12))
def test_words_in_order_are_the_longest_common_subsequence(item, doc):
    row = [0] * (len(item) + 1)
    for x in doc:
        new = [0]
        for k, y in enumerate(item):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    assert leaks.in_order(leaks.places(item), len(item), doc) == row[-1]


def test_many_items_give_what_few_do(spark):
    rng = random.Random(14)
    texts = [" ".join(rng.choice("quarry liquidator bundle warrants harvest syndicate tonnes slate widow tramway option pasture orchard ferry".split()) for _ in range(n)) for n in (2, 3, 8, 20, 40, 60) * 4]
    items = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(99, ""), (98, None)], "item_id long, text string")
    rows = [(i, FILL + " ".join(damaged(rng.choice(texts).split() * 1, 0.15, rng)) + " " + FILL) for i in range(60)] + [(70, None), (71, ""), (72, texts[3])]
    few = sorted(map(tuple, leaks.leaks(docs(spark, rows), items).collect()))
    for bits in (64, 1 << 12, 1 << 20):
        assert sorted(map(tuple, leaks.leaks(docs(spark, rows), items, most=3, bits=bits).collect())) == few
    assert len(few) > 30 and leaks.leaks(docs(spark, rows), items.where("item_id = 99"), most=0).count() == 0


# ---- problem 10 ------------------------------------------------------------------------------------------------


def cut_fixture():
    s = ["The company has approved the annual accounts of the year.", "The branch office still holds the shares in the subsidiary.", "The board of managers has recorded the interest accrued."]
    rows = [(i, f"Management report\n{s[i % 3]} {s[(i + 1) % 3]}\nThe board of managers") for i in range(30)]
    rows += [(100 + i, f"{s[i % 3]}\nTotal assets 1,{i:03d}\nOn behalf of Zanfel S.A.") for i in range(6)]
    cut = {200: "The company has approved the ann", 201: "The branch office still holds the sha...", 202: f"{s[0]} The board of managers has […]", 203: "Management report\nThe branch office still ho�", 204: "The company has   ", 205: f"{s[1]} The company", 210: "Manag"}
    whole = {300: "Management report", 301: "Cash at bank | 1,200 | 3,400", 302: s[0], 303: f"{s[0]}\r\n", 304: s[0] + " " + s[1]}
    return rows, cut, whole


def test_cut_texts(spark):
    rows, cut, whole = cut_fixture()
    every = [*rows, *cut.items(), *whole.items(), (400, None), (401, ""), (402, "  \n ")]
    d = docs(spark, every).withColumn("h", F.lit("clash")).withColumn("how", F.lit(1))
    assert {r["doc_id"] for r in cuts.found(d).collect()} == set(cut)
    twice = d.unionByName(d.where("doc_id = 200").withColumn("doc_id", F.lit(500).cast("long")))
    assert {r["doc_id"] for r in cuts.found(twice).collect()} == {*cut, 500}
    src = cuts.sources(d).first()
    assert (src["documents"], src["cut"]) == (len(every) - 3, len(cut))
    assert cuts.found(d.where("false")).count() == 0 and cuts.sources(d.where("false")).count() == 0


def test_same_cut_inside_a_word_of_several_texts(spark):
    s = "The company has approved the annual accounts of the year."
    rows = [(i, f"{s}\nThe statutory auditor {i}\nThe statutory auditors have examined item number {i}.\nThe board of managers") for i in range(40)]
    cut = {100 + i: f"{s} Number {i}.\nThe statutory audi" for i in range(3)}
    assert {r["doc_id"] for r in cuts.found(docs(spark, [*rows, *cut.items()])).collect()} == set(cut)


def test_prefixes_over_partition_bounds(spark):
    rng = random.Random(7)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(150)}
    want = {u for u in texts if any(v != u and v.startswith(u) for v in texts)}
    df = spark.createDataFrame([(u, u) for u in texts], "h string, u string").withColumn("keys", cuts.beginnings("u"))
    assert {r["h"] for r in cuts.prefixes_of_longer(df).collect()} == want


def test_long_texts_share_their_beginnings(spark):
    base = "".join(random.Random(3).choice("abc é") for _ in range(700))
    texts = {base[:n] for n in (1, 3, 4, 5, 15, 16, 17, 63, 64, 255, 256, 257, 600, 700)} | {"x" + base, "y" * 300, "z" * 299, "z" * 300}
    df = spark.createDataFrame([(u, u) for u in texts], "h string, u string").withColumn("keys", cuts.beginnings("u"))
    got = {r["h"]: r["following"] for r in cuts.prefixes_of_longer(df).collect()}
    assert set(got) == {u for u in texts if any(v != u and v.startswith(u) for v in texts)}
    assert got["z" * 299] == "z" and got[base[:600]] == base[600:620]


def test_counts_between_bounds(spark):
    rng = random.Random(11)
    values = {}
    for _ in range(400):
        values["".join(rng.choice("ab é") for _ in range(rng.randrange(0, 6)))] = rng.randrange(1, 5)
    asks = [(i, j, p + a, p + z) for i, p in enumerate(["", "a", "ab", "b é", "zz"]) for j, (a, z) in enumerate([(" ", "!"), ("a", "{"), ("\xaa", "\u2000")])]
    want = {(i, j): sum(n for g, n in values.items() if lo.encode() <= g.encode() < hi.encode()) for i, j, lo, hi in asks}
    v = spark.createDataFrame(list(values.items()), "g string, n long").repartition(5)
    got = {(r["id"], r["slot"]): r["n"] for r in cuts.counted_between(v, spark.createDataFrame(asks, "id long, slot int, lo string, hi string")).collect()}
    assert got == want


@pytest.mark.parametrize("tail", ["   ", "...", " […] ", "… \n", "\ufffd", " ... " * 40, ".. .", "\u2003\xa0\n", "(…)", ""])
def test_body_is_the_text_without_marks(spark, tail):
    import regex

    for text in ("The company" + tail, tail, "x" * 100 + tail, "A.\nB" + tail):
        got = spark.createDataFrame([(text,)], "t string").select(cuts.body("t").alias("b")).first()["b"]
        assert got == regex.sub(r"(?:\s|\.\.\.|…|\[\.\.\.\]|\[…\]|\(…\)|\ufffd)+$", "", text)


def test_near_copies_cut_at_one_place(spark):
    s = "The company has approved the annual accounts of the year."
    long = "Zanfel S.A. has granted a subordinated loan to its foreign subsidiary with retroactive eff"
    cut = {100 + i: f"{s} Number {i}.\n{long}" for i in range(4)}
    assert {r["doc_id"] for r in cuts.found(docs(spark, [*((i, s) for i in range(5)), *cut.items()])).collect()} == set(cut)


# ---- all queries -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() >= (name not in ("p1_found", "p9_found", "p9_cleaned"))


def test_language_on_the_tables(spark, sf):
    """Held-out: labelled documents that were not fitted agree with the model nearly always."""
    d = table(spark, sf, "documents")
    model = langid.model_for(d.where("doc_id % 2 = 0"))
    got = langid.document_languages(d.where("doc_id % 2 = 1 and length(text) > 100"), model).where("label is not null").collect()
    assert sum(r["label"] in r["langs"] for r in got) >= 0.8 * len(got)
