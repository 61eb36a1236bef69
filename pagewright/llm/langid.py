"""Problem 2: languages of texts and of their parts, by segmentation-marginalised unigrams."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.norm import strip

#: Public vocabulary whose pieces are scored.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled documents of each language that are used for fitting, chosen by a hash of their id.
FIT_ROWS = 800
#: Rounds of expectation-maximisation.
EM_ROUNDS = 2
#: Added to every piece count; beyond so many characters a word is summed in logarithms, and fitted in parts of this length.
SMOOTH, LONG = 0.05, 24
#: Words remembered by one task.
CACHE = 400_000
#: Lead over the next language from which a sentence is assigned, and the scale that makes a lead a confidence.
LEAD, SCALE = 5.0, 3.0

LANGS = ("eng", "fra", "deu", "spa", "nld")
# The ways labels are written.
CODES = {
    "eng": "en eng english anglais englisch",
    "fra": "fr fra fre french francais français französisch",
    "deu": "de deu ger german allemand deutsch",
    "spa": "es spa spanish espagnol spanisch español",
    "nld": "nl nld dut dutch neerlandais néerlandais niederländisch nederlands",
}

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def label(c: Column | str) -> Column:
    """A language label as one of LANGS, null where it names none of them."""
    key = F.regexp_replace(F.lower(strip(c)), r"[-_].*$", "")
    out = F.lit(None).cast("string")
    for lang, names in CODES.items():
        out = F.when(key.isin(names.split()), lang).otherwise(out)
    return out


class Pieces:
    """Piece probabilities for each language; scores a word by the sum over all its segmentations."""

    def __init__(self, pieces: dict[str, int], logp: np.ndarray, floor: np.ndarray):
        self.pieces, self.logp, self.floor = pieces, logp, floor
        self.p = np.exp(logp)
        self.longest = max(map(len, pieces), default=1)
        self.single = np.exp(floor)

    def parts(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """What the model is made of; plain objects that any worker can read."""
        return self.pieces, self.logp, self.floor

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) of every piece inside the word; -1 for a character outside the vocabulary."""
        n, out, get = len(word), [], self.pieces.get
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                k = get(word[i:j])
                if k is not None:
                    out.append((i, j, k))
                elif j == i + 1:
                    out.append((i, j, -1))
        return out

    def forward(self, word: str) -> np.ndarray:
        """Log probability of the word under each language, all segmentations summed."""
        if len(word) > LONG:
            b = np.full((len(word) + 1, len(LANGS)), -np.inf)
            b[0] = 0.0
            for i, j, k in self.edges(word):
                b[j] = np.logaddexp(b[j], b[i] + (self.logp[k] if k >= 0 else self.floor))
            return b[-1]
        a: list = [0.0] * (len(word) + 1)
        a[0] = np.ones(len(LANGS))
        for i, j, k in self.edges(word):
            a[j] = a[j] + a[i] * (self.p[k] if k >= 0 else self.single)
        return np.log(a[-1])

    def expected(self, word: str) -> Iterator[tuple[int, np.ndarray]]:
        """(piece, expected uses under each language) by forward and backward sums."""
        e = self.edges(word)
        n = len(word)
        a: list = [0.0] * (n + 1)
        b: list = [0.0] * (n + 1)
        a[0] = b[n] = np.ones(len(LANGS))
        for i, j, k in e:
            a[j] = a[j] + a[i] * (self.p[k] if k >= 0 else self.single)
        for i, j, k in reversed(e):
            b[i] = b[i] + b[j] * (self.p[k] if k >= 0 else self.single)
        for i, j, k in e:
            if k >= 0:
                yield k, a[i] * self.p[k] * b[j] / a[n]


def _from_counts(pieces: dict[str, int], counts: np.ndarray) -> Pieces:
    seen = counts.sum(axis=1, keepdims=True)
    total = seen + SMOOTH * counts.shape[1]
    logp = np.log((counts + SMOOTH) / total)
    logp[seen[:, 0] == 0] = -25.0  # a language without a labelled text is never found
    return Pieces(pieces, logp.T.copy(), np.minimum(np.log(SMOOTH / total[:, 0]), logp.max(axis=1)))


def marked(word: str) -> str:
    """The word as the vocabulary sees it: lower case, with the sign of a word's beginning."""
    return "▁" + word.lower()


def fit(rows: Sequence[tuple[str, dict[str, int]]], vocabulary: str = VOCABULARY) -> Pieces:
    """Fit piece probabilities to (language, word counts) of labelled texts.

    Starts from the vocabulary's own segmentation, then expectation-maximisation over all segmentations. First two
    halves are fitted, and each judges the rows of the other; rows whose label the other half does not confirm are
    left out of the final fit, so wrong labels don't shape it.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    vocab = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_byte(i)}
    words = sorted({w for _, c in rows for w in c})
    at = {w: i for i, w in enumerate(words)}
    split = [[vocab[p] for p in sp.encode_as_pieces(w[1:]) if p in vocab] for w in words]
    used = sorted({k for s in split for k in s} | {vocab[p] for w in words for p in set(w) if p in vocab})
    of_word = Pieces(vocab, np.zeros((1, len(LANGS))), np.zeros(len(LANGS)))
    inside = {k for w in words for _, _, k in of_word.edges(w) if k >= 0}
    names = {i: p for p, i in vocab.items()}
    pieces = {names[k]: n for n, k in enumerate(sorted(inside | set(used)))}
    row_of = {k: n for n, k in enumerate(sorted(inside | set(used)))}
    lang = np.array([LANGS.index(x) for x, _ in rows], dtype=np.int64)
    sparse = [(np.array([at[w] for w in c], dtype=np.int64), np.array(list(c.values()), dtype=float)) for _, c in rows]

    def model_of(keep: np.ndarray) -> Pieces:
        weight = np.zeros((len(words), len(LANGS)))
        for r in keep:
            np.add.at(weight[:, lang[r]], sparse[r][0], sparse[r][1])
        counts = np.zeros((len(LANGS), len(pieces)))
        for i, s in enumerate(split):
            for k in s:
                counts[:, row_of[k]] += weight[i]
        model = _from_counts(pieces, counts)
        for _ in range(EM_ROUNDS):
            counts = np.zeros((len(LANGS), len(pieces)))
            for i, w in enumerate(words):
                if weight[i].any():
                    for k, e in model.expected(w):
                        counts[:, k] += e * weight[i]
            model = _from_counts(pieces, counts)
        return model

    def agree(model: Pieces, judged: np.ndarray) -> list[int]:
        asked = sorted({int(i) for r in judged for i in sparse[r][0]})
        score = np.zeros((len(words), len(LANGS)))
        for i in asked:
            score[i] = model.forward(words[i])
        return [int(r) for r in judged if len(sparse[r][0]) and int(np.argmax(sparse[r][1] @ score[sparse[r][0]])) == lang[r]]

    halves = [np.arange(h, len(rows), 2) for h in (0, 1)]
    kept = sorted(agree(model_of(halves[0]), halves[1]) + agree(model_of(halves[1]), halves[0]))
    return model_of(np.array(kept, dtype=np.int64))


def labelled_rows(documents: DataFrame, fit_rows: int = FIT_ROWS) -> list[tuple[str, dict[str, int]]]:
    """Up to fit_rows labelled texts of each language as word counts; the bound is the one thing that is sampled."""
    d = documents.where("doc_id is not null and text is not null").select("doc_id", label("lang").alias("lang"), "text").where("lang is not null")
    # a hash threshold a little above the need, then the exact bound: no sort of the corpus
    n = d.groupBy("lang").agg(F.count("*").alias("n"))
    d = d.join(F.broadcast(n), "lang").withColumn("h", F.xxhash64("doc_id", "text") / F.lit(2.0**63))
    d = d.where((F.col("h") + 1) / 2 * F.col("n") <= 1.3 * fit_rows)
    d = d.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= fit_rows)
    out = []
    for r in d.select("lang", "text", "h").orderBy("lang", "h").toLocalIterator():
        c: dict[str, int] = defaultdict(int)
        for w in WORD.findall(r["text"]):
            for k in range(0, len(w), LONG - 1):
                c[marked(w[k : k + LONG - 1])] += 1
        out.append((r["lang"], dict(c)))
    return out


class Scorer:
    """Sums of word scores with a bounded memory of words; the model itself never changes."""

    def __init__(self, model: Pieces):
        self.model, self.known = model, {}
        self.rows = np.zeros((1024, len(LANGS)))

    def word(self, w: str) -> int:
        k = len(self.known)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        v = self.model.forward(marked(w))
        self.rows[k] = v - v.max()
        self.known[w] = k
        return k

    def scores(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log scores of each text and language, words of each text); each word by its marginal likelihood."""
        if len(self.known) >= CACHE:
            self.known.clear()
        get, ids, n = self.known.get, [], []
        for t in texts:
            ws = WORD.findall(t)
            n.append(len(ws))
            for w in ws:
                k = get(w)
                ids.append(self.word(w) if k is None else k)
        count = np.array(n, dtype=np.int64)
        total = np.concatenate([np.zeros((1, len(LANGS))), np.cumsum(self.rows[ids], axis=0)]) if ids else np.zeros((1, len(LANGS)))
        end = np.cumsum(count)
        return total[end] - total[end - count], count


def confidence(score: np.ndarray) -> float:
    """Share of the best language when the log scores are flattened by SCALE; 0.2 for no evidence."""
    e = np.exp((score - score.max()) / SCALE)
    return float(e.max() / e.sum())


# a sentence ends at its sign before white space, or at the end of its line
STOP = re.compile(r"[.!?][)\]»”\"']*(?=\s)|[\r\n]+")
ENDED = (".", "!", "?", ".)", ".]", ".»", ".”", '."')
# What a full stop may belong to instead: days before German months, and legal forms, which end a sentence
# only before a capital letter.
MONTHS = ("Jan", "Jän", "Feb", "Mär", "Mrz", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez")
FORM = re.compile(r"(?:S\.A|r\.l|N\.V|B\.V|S\.L|S\.p\.A)$")
DAY = re.compile(r"(?<!\d)\d{1,2}$")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each sentence or line."""
    at = 0
    for m in STOP.finditer(text):
        a, b = m.span()
        if text[a] in "\r\n":
            b = a
        elif not text[max(at, a - 2) : a].isalpha() and text[a - 1 : a] not in ")]»”\"%":
            # after a number, a legal form or a single letter
            after = text[b : b + 40].lstrip()
            if not after[:1].isupper():
                continue
            if text[a - 1 : a].isdigit():
                day = DAY.search(text[max(at, a - 3) : a])
                if day and after.startswith(MONTHS) or text[at:a].strip().isdigit():
                    continue
            elif not FORM.search(text[max(at, a - 6) : a]):
                continue
        if text[at:b].strip():
            yield at, b
        at = m.end()
    if text[at:].strip():
        yield at, len(text)


def read_texts(texts: Sequence[str], scorer: Scorer) -> Iterator[tuple[str | None, float, list[str], list[tuple[int, int, str, float]]]]:
    """(language, confidence, languages present, segments) of each text.

    A segment is a stretch of at least two consecutive sentences of one language, or the whole text where there
    is none; sentences without a clear lead belong to what is around them; headings, table rows and signatures
    neither make nor break a stretch.
    """
    spans = [list(sentences(t)) for t in texts]
    parts = [t[a:b].strip() for t, s in zip(texts, spans) for a, b in s]
    score, words = scorer.scores(parts)
    best = score.argmax(axis=1) if len(parts) else np.empty(0, np.int64)
    two = np.partition(score, -2, axis=1)[:, -2:] if len(parts) else np.empty((0, 2))
    clear = (words >= 3) & (two[:, 1] - two[:, 0] >= LEAD) & np.array([p.endswith(ENDED) for p in parts], dtype=bool)
    at = 0
    for t, s in zip(texts, spans):
        z = at + len(s)
        total = score[at:z].sum(axis=0)
        if not words[at:z].any():
            yield None, 0.0, [], []
            at = z
            continue
        kept: list[list] = []  # [language, first, last, score]
        run: list | None = None
        for (a, b), i in zip(s, range(at, z)):
            if not clear[i]:
                continue
            if run is not None and run[0] == best[i]:
                run[2], run[3], run[4] = b, run[3] + score[i], run[4] + 1
                if run[4] == 2:
                    if kept and kept[-1][0] == run[0]:
                        kept[-1][2], kept[-1][3] = run[2], kept[-1][3] + run[3]
                        run = [*kept.pop()[:4], 2]
                    kept.append(run)
            else:
                run = [best[i], a, b, score[i], 1]
        at = z
        main = int(np.argmax(total))
        if kept:
            segments = [(r[1], r[2], LANGS[r[0]], confidence(r[3])) for r in kept]
        else:
            segments = [(0, len(t), LANGS[main], confidence(total))]
        yield LANGS[main], confidence(total), sorted({x[2] for x in segments}), segments


def model_for(documents: DataFrame, fit_rows: int = FIT_ROWS, vocabulary: str = VOCABULARY) -> Pieces:
    return fit(labelled_rows(documents, fit_rows), vocabulary)


def document_languages(documents: DataFrame, model: Pieces | None = None) -> DataFrame:
    """(doc_id, label, lang, confidence, langs, segments) of every document with text.

    segments: array of (first, last, lang, confidence) by character. lang is null where a text has no words.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model or model_for(documents)).parts())
    seg = "array<struct<first:int,last:int,lang:string,confidence:double>>"

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Pieces(*shared.value))
        for pdf in batches:
            rows = list(read_texts(pdf["text"].tolist(), scorer))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "label": pdf["label"], "lang": [r[0] for r in rows], "confidence": [r[1] for r in rows], "langs": [r[2] for r in rows],
                "segments": [[dict(zip(("first", "last", "lang", "confidence"), s)) for s in r[3]] for r in rows],
            })

    d = documents.where("doc_id is not null and text is not null").select("doc_id", label("lang").alias("label"), "text")
    return d.mapInPandas(read, f"doc_id long, label string, lang string, confidence double, langs array<string>, segments {seg}")


def page_languages(lines: DataFrame, model: Pieces) -> DataFrame:
    """(file_name, page_number, lang, confidence): each page by the sum of its lines; pages without words are left out."""
    shared = lines.sparkSession.sparkContext.broadcast(model.parts())
    cols = [f"s{i}" for i in range(len(LANGS))]

    def add(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Pieces(*shared.value))
        for pdf in batches:
            out = pd.DataFrame(scorer.scores(pdf["text"].tolist())[0], columns=cols)
            out.insert(0, "page_number", pdf["page_number"].to_numpy())
            out.insert(0, "file_name", pdf["file_name"].to_numpy())
            yield out.groupby(["file_name", "page_number"], as_index=False, sort=False).sum()

    rows = lines.where("file_name is not null and page_number is not null and text is not null").select("file_name", "page_number", "text")
    sums = rows.mapInPandas(add, "file_name string, page_number int, " + ", ".join(f"{c} double" for c in cols))
    sums = sums.groupBy("file_name", "page_number").agg(*[F.sum(c).alias(c) for c in cols])
    best = F.greatest(*cols)
    lang = F.coalesce(*[F.when(F.col(c) == best, F.lit(x)) for c, x in zip(cols, LANGS)])
    share = 1 / sum((F.exp((F.col(c) - best) / SCALE) for c in cols), F.lit(0.0))
    return sums.where(F.least(*cols) < 0).select("file_name", "page_number", lang.alias("lang"), share.alias("confidence"))


def job_languages(jobs: DataFrame, lines: DataFrame, model: Pieces) -> DataFrame:
    """(job_id, label, lang, confidence, langs): every job whose file has lines; a language is present if a page is in it.

    Of rows under one job_id the latest submitted_at counts. lang is that of most pages, confidence their share
    times their mean confidence.
    """
    latest = jobs.where("job_id is not null").groupBy("job_id").agg(F.max(F.struct("submitted_at", "file_name", "lang")).alias("r"))
    latest = latest.select("job_id", F.col("r.file_name").alias("file_name"), label("r.lang").alias("label"))
    per = page_languages(lines, model).groupBy("file_name", "lang").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    files = per.groupBy("file_name").agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.max(F.struct("n", "c", "lang")).alias("m"), F.sum("n").alias("all"))
    files = files.select("file_name", F.col("m.lang").alias("lang"), (F.col("m.n") / F.col("all") * F.col("m.c")).alias("confidence"), "langs")
    return latest.join(files, "file_name").select("job_id", "label", "lang", "confidence", "langs")


def jobs_report(documents: DataFrame, jobs: DataFrame, lines: DataFrame) -> DataFrame:
    return job_languages(jobs, lines, model_for(documents))


def found(documents: DataFrame, jobs: DataFrame, lines: DataFrame) -> DataFrame:
    """Records whose label is missing, names a language that is not present, or of several languages: one row per language."""
    model = model_for(documents)
    d = document_languages(documents, model).select(F.lit("doc").alias("record_kind"), F.col("doc_id").alias("record_id"), "label", "langs")
    j = job_languages(jobs, lines, model).select(F.lit("job").alias("record_kind"), F.col("job_id").alias("record_id"), "label", "langs")
    both = d.unionByName(j).where("size(langs) > 0")
    case = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return both.where(case).select("record_kind", "record_id", F.explode("langs").alias("lang")).distinct()
