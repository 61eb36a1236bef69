"""Problem 7: noise in text from scanned pages, found and repaired."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.norm import strip
from ..operators.skew import hot_join
from ..session import cut
from .cuts import shape
from .editor import DIGITS, HYPHENS, Editor, Lexicon, pairs_of, train, train_breaks

#: A word is known if the documents hold it at least so often.
KNOWN = 3
#: Known words that every worker holds, the most frequent; others go to the lines that ask for them.
LEXICON = 1_000_000
#: Lines counted from the top and from the bottom of a page among which furniture stands.
EDGE = 2
#: One in so many corpora may hold a shape that is taken for a running line by chance; a shape of so large a share of the
#: edge lines (one in SHARE) is one whatever the chance.
CHANCE, SHARE = 1_000, 300
#: Distance within which a line is a misread form of a running line of other files.
OFF = 2

# Words that stand with page numbers.
PAGE_WORDS = r"(?:page|seite|p[aá]gina|pagina|blz|blatt|bladzijde|pag|p|s)"
#: Characters that may stand for a digit.
FOR_DIGITS = {c for cs in DIGITS.values() for c in cs}

WORD = re.compile(r"[^\W\d_]+")
EDGES = ".,;:!?()[]{}\"'«»„“”‚‘’"


def tidy_lines(lines: DataFrame) -> DataFrame:
    """Each line once, with its place on the page: (file_name, page_number, line_number, text, x, x2, y, y2, top, bottom).

    top counts from 1 down the page, bottom from 1 up. Of differing repeats the greatest text counts. One sort of
    each page serves all of it.
    """
    keys = ["file_name", "page_number", "line_number"]
    one = lines.where("file_name is not null and page_number is not null and line_number is not null and text is not null")
    one = one.select(*keys, "text", "x", "x2", "y", "y2").distinct()
    page = W.partitionBy("file_name", "page_number").orderBy("line_number", F.desc("text"), F.desc("x"), F.desc("x2"), F.desc("y"), F.desc("y2"))
    t = one.withColumn("top", F.dense_rank().over(W.partitionBy("file_name", "page_number").orderBy("line_number"))).withColumn("_before", F.lag("line_number").over(page))
    t = t.withColumn("bottom", F.max("top").over(W.partitionBy("file_name", "page_number")) - F.col("top") + 1)
    return t.where("_before is null or _before <> line_number").drop("_before")


def near_texts(texts: DataFrame, models: DataFrame, off: int = OFF) -> DataFrame:
    """(g): the distinct texts (g) within edit distance `off` of a model (g).

    A model is cut into off + 1 parts; `off` edits leave one of them whole, moved by at most `off` places. So a text that
    is near has a part of the model at such a place: parts are join keys together with the model's length, and only
    pairs that share one are measured.
    """
    part = lambda n, i: f"floor({n} * {i} / {off + 1})"
    of = lambda i: F.struct(F.lit(i).alias("i"), F.expr(f"substr(g, cast({part('length(g)', i)} as int) + 1, cast({part('length(g)', i + 1)} - {part('length(g)', i)} as int))").alias("part"))
    m = models.select(F.col("g").alias("m"), F.length("g").alias("len"), F.explode(F.array(*[of(i) for i in range(off + 1)])).alias("p")).select("m", "len", "p.i", "p.part")
    at = F.expr(
        f"flatten(transform(sequence(greatest(length(g) - {off}, 1), length(g) + {off}), len -> flatten(transform(sequence(0, {off}), i -> transform(filter(sequence(-{off}, {off}), d -> "
        f"cast({part('len', 'i')} as int) + d >= 0), d -> struct(len, i, substr(g, cast({part('len', 'i')} as int) + 1 + d, cast({part('len', '(i + 1)')} - {part('len', 'i')} as int)) as part))))))"
    )
    lengths = models.select(F.length("g").alias("n")).distinct().select(F.explode(F.sequence(F.col("n") - off, F.col("n") + off)).alias("n")).distinct()
    t = texts.join(lengths, F.length("g") == F.col("n"), "left_semi").select("g", F.explode(F.array_distinct(at)).alias("p")).select("g", "p.len", "p.i", "p.part")
    return t.join(m, ["len", "i", "part"]).select("g", "m").distinct().where(F.levenshtein("g", "m") <= off).select("g").distinct()


def furniture(lines: DataFrame, page_info: DataFrame) -> DataFrame:
    """lines with kind: 'header', 'pageno', 'number' (a bare number in the margin) or null for the body.

    By position on the page: only the first and last lines can be furniture. A page number holds nothing but the
    number, perhaps with signs, a page word or the number of pages; a bare one must stand in the middle or keep step
    with the pages of its file. A running line has a shape (names and numbers masked) that stands at page edges all
    over the corpus, or letters that come back on other pages of its file, exactly or nearly (misread).
    """
    width = page_info.where("page_width > 0").groupBy("file_name", "page_number").agg(F.max("page_width").alias("page_width"))
    t = lines.withColumn("edge", (F.col("top") <= EDGE) | (F.col("bottom") <= EDGE)).withColumn("s", strip("text"))
    number = r"[0-9lIOoSBZ]{1,4}"
    look = rf"(?iU)^[^\p{{L}}\p{{N}}]*({PAGE_WORDS}\b\.?)?[^\p{{L}}\p{{N}}]*({number})(?:\s*(?:/|\||of|de|von|sur|van|aus)\s*({number}))?[^\p{{L}}\p{{N}}]*$"
    t = t.withColumn("_num", F.col("edge") & F.col("s").rlike(look) & F.col("s").rlike(r"\d") & ~F.col("s").rlike(r"^\d+\.$"))
    value = F.translate(F.regexp_extract("s", look, 2), "lIOoSBZ", "1100582").cast("int")
    t = t.withColumn("_value", F.when(F.col("_num"), value)).withColumn("_dressed", F.col("_num") & F.col("s").rlike(r"(?U)\p{L}{2,}|[\[\](){}\-–—/|]"))
    t = cut(t, "lines")
    step = t.where("_value is not null").select("file_name", (F.col("_value") - F.col("page_number")).alias("_step"), "page_number").distinct()
    step = step.groupBy("file_name", "_step").agg(F.count("*").alias("_kept"))
    nums = t.where("_num").withColumn("_step", F.col("_value") - F.col("page_number")).join(step, ["file_name", "_step"], "left").join(width, ["file_name", "page_number"], "left")
    middle = F.abs((F.col("x") + F.col("x2")) / 2 - F.coalesce(F.col("page_width"), F.lit(2480.0)) / 2) < 0.12 * F.coalesce(F.col("page_width"), F.lit(2480.0))
    in_step = (F.col("_step") == 0) | (F.col("_kept") >= 2)
    keys = ["file_name", "page_number", "line_number"]
    pageno = nums.where(middle | (F.col("_dressed") & in_step)).select(*keys, F.lit("pageno").alias("kind"))

    # running lines: shapes at the edges of many files
    place = F.when(F.col("top") <= EDGE, F.col("top")).otherwise(-F.col("bottom"))
    edges = t.where("edge and not _num").select(*keys, "s", place.alias("place"), shape(F.col("s")).alias("g"), F.regexp_replace(F.lower("s"), r"(?U)[^\p{L}]+", "").alias("k"))
    edges = cut(edges.where("length(k) >= 4 or g like '%<x>%'"), "edges")
    by_file = edges.groupBy("g", "file_name").agg(F.count("*").alias("e"))
    at_edge = by_file.groupBy("g").agg(F.sum("e").alias("e"), F.count("*").alias("files"))
    # the same shapes inside the pages
    inside = t.where("not edge").select(shape(F.col("s")).alias("g")).groupBy("g").agg(F.count("*").alias("i"))
    by_shape = at_edge.join(inside, "g", "left").withColumn("n", F.col("e") + F.coalesce("i", F.lit(0)))
    by_shape = cut(by_shape, "shapes")
    ended = F.col("g").rlike(r"[.;:,]$") & ~F.col("g").rlike(r"<x>$")
    # by chance all but a fifth of the n lines of a shape stand at page edges, where any line does with probability p, at
    # most C(n, e) p ** e times; among all shapes of the corpus fewer than one in CHANCE such cases are expected
    p, shapes = t.agg(F.avg(F.col("edge").cast("double")).alias("p")), by_shape.agg(F.count("*").alias("c"))
    choose = F.when(F.col("n") > F.col("e"), 0.5004 * F.col("n")).otherwise(0.0)  # ln C(n, n / 5) < 0.5004 n
    rare = -F.col("e") * F.log(F.coalesce(p.scalar(), F.lit(1.0))) - choose >= F.log(F.lit(CHANCE) * F.greatest(shapes.scalar(), F.lit(1)))
    all_edges = t.agg(F.sum(F.col("edge").cast("int")).alias("m"))
    much = F.col("e") * SHARE >= F.coalesce(all_edges.scalar(), F.lit(0))  # or it makes up much of all edges of a small corpus
    running = by_shape.where((F.col("files") >= 3) & (F.col("e") >= 0.8 * F.col("n")) & (rare | much) & F.col("g").rlike(r"[a-z<]") & ~ended & ~F.col("g").rlike(rf"^{PAGE_WORDS}\.? "))
    running = cut(running.select("g"), "running")
    exact = edges.join(running, "g", "left_semi").select(*keys, "k")
    # what comes back at the same place of this page or the next but one
    near_page = F.lead("page_number").over(W.partitionBy("file_name", "k", "place").orderBy("page_number")) - F.col("page_number")
    pages = edges.select("file_name", "k", "place", "page_number").distinct()
    back = pages.withColumn("gap", near_page).where("gap <= 2").select("file_name", "k").distinct()
    inner = by_shape.where(F.col("e") < 0.5 * F.col("n")).select("g")  # headings and phrases of the body
    again = edges.join(back, ["file_name", "k"], "left_semi").join(inner, "g", "left_anti").where(~F.col("s").rlike(r"(?U)\p{Ll}[.;:,]$")).select(*keys, "k")
    sure = cut(exact.unionByName(again).distinct(), "headers")
    # every running line of a file is a model for its misread heads; lengths within the distance allowed are compared
    off = F.greatest(F.lit(2), F.floor(F.length("m") * 0.2).cast("int"))
    models = sure.select("file_name", F.col("k").alias("m")).distinct().withColumn("off", off)
    models = models.withColumn("len", F.explode(F.sequence(F.length("m") - F.col("off"), F.length("m") + F.col("off"))))
    open_ = cut(edges.join(sure.select(*keys), keys, "left_anti"), "open")
    misread = open_.select("file_name", "k", F.length("k").alias("len")).distinct().join(models, ["file_name", "len"])
    misread = misread.where(F.levenshtein("k", "m") <= F.col("off")).select("file_name", "k").distinct()
    # a head that its file shows once and misread: near a running shape of other files, or its part after the name
    letters = F.length(F.regexp_replace("g", r"<x>|[\W\d]", "")) >= 8
    long = running.where(letters)
    near_shape = near_texts(open_.select("g").distinct(), long)
    ends = long.where("g like '<x> - %'").select(F.expr("substr(g, 4)").alias("end")).distinct()
    dash = open_.select("g", F.explode(F.expr("transform(filter(sequence(1, length(g)), i -> substr(g, i, 3) = ' - '), i -> substr(g, i))")).alias("end")).distinct()
    tail = dash.join(ends, "end", "left_semi").select("g")
    near = open_.join(near_shape.unionByName(tail).distinct(), "g", "left_semi").select(*keys).unionByName(open_.join(misread, ["file_name", "k"], "left_semi").select(*keys))
    header = sure.select(*keys).unionByName(near).distinct().withColumn("kind", F.lit("header"))
    bare = t.where((F.col("x") > 1000) & F.col("s").rlike(r"^[\W\d]*\d[\W\d]*$") & ~F.col("s").rlike(r"^\d[\d., ]*\.$")).select(*keys, F.lit("number").alias("kind"))
    kinds = header.unionByName(pageno).unionByName(bare)
    order = {"header": 1, "pageno": 0, "number": 2}
    rank = F.when(F.col("kind") == "pageno", order["pageno"]).when(F.col("kind") == "header", order["header"]).otherwise(order["number"])
    kinds = kinds.groupBy(*keys).agg(F.min_by("kind", rank).alias("kind"))
    return t.select(*keys, "text", "x", "x2", "y", "y2", "s").join(kinds, keys, "left")


def vocabulary(documents: DataFrame) -> DataFrame:
    """(w, n): the words and compounds of all texts and how often they occur, in lower case; words in capitals are kept apart, as they may lack their accents."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*").findall
        for pdf in batches:
            # white space ends every word: tokens are counted first, and each different one is looked into once
            tokens: Counter[str] = Counter()
            for t in pdf["text"]:
                tokens.update(t.split())
            n: Counter[str] = Counter()
            for t, k in tokens.items():
                for w in find(t):
                    n[w] += k
            yield pd.DataFrame({"w": list(n), "n": list(n.values())})

    w = documents.where("text is not null").select("text").mapInPandas(count, "w string, n long")
    capitals = F.col("w") == F.upper("w")
    return cut(w.groupBy(F.when(capitals, F.col("w")).otherwise(F.lower("w")).alias("w")).agg(F.sum("n").alias("n")), "words")


def frequent(words: DataFrame, most: int = LEXICON) -> tuple[dict[str, int], set[str], set[str], int]:
    """(known words with counts, known words in capitals, letter triples, least count): at most about `most` known words.

    The least count is KNOWN where all known words fit. Letter triples are those of all words seen twice, bounded by the
    alphabet. What lies between KNOWN and the least count is left to look-ups.
    """
    sizes = words.where(F.col("n") >= KNOWN).groupBy("n").agg(F.count("*").alias("c"))
    w = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)  # one row for each count that occurs
    sums = sizes.withColumn("upto", F.sum("c").over(w)).agg(F.coalesce(F.max("upto"), F.lit(0)).alias("all"), F.min(F.when(F.col("upto") <= most, F.col("n"))).alias("n")).first()
    least = KNOWN if sums["all"] <= most else sums["n"] if sums["n"] is not None else 1 << 62
    known, upper = {}, set()
    for r in words.where(F.col("n") >= least).toLocalIterator():
        if r["w"] == r["w"].upper():
            upper.add(r["w"])
        else:
            known[r["w"]] = r["n"]
    marked = words.where("n >= 2 and length(w) > 0 and w <> upper(w)").select(F.concat(F.lit("^"), "w", F.lit("$")).alias("w"))
    triples = marked.select(F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substr(w, i, 3))")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return known, upper, {r["t"] for r in triples.where("n >= 2").toLocalIterator()}, least


def fit(words: dict[str, int]) -> Editor:
    """Train the editor on the known words, the most frequent first, and its line join on broken words and compounds."""
    plain = [w for w in sorted(words, key=lambda w: (-words[w], w)) if len(w) >= 3 and "-" not in w]
    editor = train(plain)
    editor.breaks = train_breaks(words, pairs_of((w, n) for w, n in words.items() if "-" in w))
    return editor


def core_of(token: str) -> tuple[str, str, str]:
    """(signs before, the word, signs after)."""
    a, b = 0, len(token)
    while a < b and token[a] in EDGES:
        a += 1
    while b > a and token[b - 1] in EDGES:
        b -= 1
    return token[:a], token[a:b], token[b:]


def parts_of(token: str, lex: Lexicon) -> tuple[str, str, str, str, int]:
    """core_of the token, the word in lower case, and how often the documents have it."""
    got = lex.parts.get(token)
    if got is None:
        if len(lex.parts) > 50_000:
            lex.parts.clear()
        a, core, z = core_of(token)
        low = core.lower()
        got = lex.parts[token] = a, core, z, low, lex.count(low) if core else 0
    return got


NUMBER = re.compile(r"[+-]?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?%?|\d+(?:[.,]\d{1,2})?%?")
CODE = re.compile(r"\d+(?:[-/.]\d+)*|\d+(?:er|re|e|º|ª|th|st|nd|rd|ème)|[^\W\d_]+[-/]\d+")


def like(word: str, model: str) -> str:
    """word in the letter case of model."""
    return word.upper() if model.isupper() and len(model) > 1 else word[:1].upper() + word[1:] if model[:1].isupper() else word


def mend_word(core: str, lex: Lexicon) -> str | None:
    """The repaired word or number, None if there is nothing to repair; the same text if it is surely misread but unclear."""
    if core not in lex.mended:
        if len(lex.mended) > 50_000:
            lex.mended.clear()
        lex.mended[core] = _mend(core, lex)
    return lex.mended[core]


def _mend(core: str, lex: Lexicon) -> str | None:
    low = core.lower()
    if not core or lex.known(low) or lex.capital(core) or NUMBER.fullmatch(core):
        return None
    digits = sum(c.isdigit() for c in core)
    if digits and digits + sum(c in FOR_DIGITS or c in ".,%" for c in core) == len(core) and any(c in FOR_DIGITS for c in core) and not CODE.fullmatch(core):
        got = lex.repair(low) if digits <= len(core) // 2 else None
        if got:
            return like(got, core)
        # a number in which the editor reads letters as digits; the likeliest reading that is one counts
        return next((r for r in lex.editor.readings(core) if NUMBER.fullmatch(r)), core)
    parts = re.split(r"([-'’/.])", core)
    if len(parts) > 1:
        mended = [None if i % 2 else mend_word(p, lex) for i, p in enumerate(parts)]
        if any(m is not None for m in mended):
            return "".join(p if m is None else m for p, m in zip(parts, mended))
        if all(len(p) > 1 for p in parts[::2]) and "." in parts[1::2] and not digits:
            got = lex.repair(low)
            return like(got, core) if got else None
        return None
    if CODE.fullmatch(core):
        return None
    got = lex.repair(low) if len(core) > 1 else None
    if got:
        return like(got, core)
    letters = sum(c.isalpha() for c in core)
    if letters >= 2 and letters < len(core) and not core.endswith(tuple(HYPHENS)):
        return core  # signs or digits inside a word
    return None


def mend_line(text: str, head: str, tail: str, lex: Lexicon, own: tuple[bool, bool] = (False, False)) -> tuple[str, bool]:
    """(repaired line, misread?) of a body line.

    head: the broken word's first part from the line before (without its hyphen), tail: its second part on the line
    after; the parts of a word are only judged together. own: the first token ends, the last begins a known compound.
    """
    tokens = text.split()
    plain = lex.plain
    if not head and not tail and not any(own):
        for t in tokens:
            if t not in plain:
                break
        else:
            return " ".join(tokens), False
    out: list[str] = []
    misread = False
    i = 0
    while i < len(tokens):
        t = tokens[i]
        a, core, z, low, one = parts_of(t, lex)
        if i == 0 and own[0] or i == len(tokens) - 1 and own[1]:
            out.append(t)
            i += 1
            continue
        if i == 0 and head:
            whole = head.lower() + core.lower()
            got = None if lex.known(whole) else lex.repair(whole)
            if got and not got.startswith(head.lower()[:-1]):
                got = None
            if got and got.startswith(head.lower()):
                fixed = got[len(head) :]
                misread = misread or fixed != core.lower()
                t = a + fixed + z
            elif got is None and not lex.known(whole) and any(c.isdigit() or not c.isalnum() for c in core):
                misread = misread or any(c.isdigit() for c in core) and any(c.isalpha() for c in core)
            out.append(t)
            i += 1
            continue
        if i == len(tokens) - 1 and tail:
            core = core.rstrip(HYPHENS)
            whole = core.lower() + tail.lower()
            got = None if lex.known(whole) else lex.repair(whole)
            if got and got.endswith(tail.lower()):
                fixed = got[: len(got) - len(tail)]
                misread = misread or fixed != core.lower()
                t = a + like(fixed, core) + text.rstrip()[-1]
            elif got is None and any(c.isdigit() for c in core) and any(c.isalpha() for c in core):
                misread = True
            out.append(t)
            i += 1
            continue
        # a blank put into a word: the whole is one, the parts are none or rare
        if i + 1 < len(tokens) and not z and not (i + 2 == len(tokens) and tail):
            b, after, y, low_after, two = parts_of(tokens[i + 1], lex)
            if not b and core and after:
                whole = low + low_after
                # parts that texts cut off left among the words are far rarer than the whole
                split = lex.known(whole) and min(one, two) * (200 if one and two else 20) < lex.count(whole)
                if not split and core.isalpha() and after.isalpha() and not one and not two and not lex.capital(after):
                    split = len(core) + len(after) >= 5 and lex.repair(low + " " + low_after) is not None and lex.repair(low) is None and lex.repair(low_after) is None
                    whole = lex.repair(low + " " + low_after) if split else whole
                if split:
                    out.append(a + like(whole, core) + y)
                    misread = True
                    i += 2
                    continue
            # a blank put into a number: what follows isn't a group of three digits
            if core and after and core[-1].isdigit() and after[0].isdigit() and NUMBER.fullmatch(core + after) and re.fullmatch(r"[\d.,]+", core + after):
                group = re.match(r"\d+", after).group()
                grouped = len(group) == 3 and re.fullmatch(r"\d{1,3}", core) is not None
                if not grouped and ("." in core + after or "," in core + after or len(group) != 3) and len(core) + len(after) > 2:
                    out.append(a + core + after + y)
                    misread = True
                    i += 2
                    continue
        got = mend_word(core, lex)
        if one * 5_000 > lex.top and core.isalpha() and len(plain) < 100_000:
            plain.add(t)  # frequent words need no second look, whatever stands beside them
        if got is not None:
            misread = True
            t = a + got + z
        elif core[:1].isupper() and not core.isupper() and core.isalpha() and not one and lex.odd(low) >= 2:
            # a name in letters that no word has, which the editor can read as something plausible
            if any(not lex.odd(r) for r in lex.editor.readings(core.lower())[:3] if r != core.lower()):
                misread = True
        out.append(t)
        i += 1
    return " ".join(out), misread


def broken(word: str, rest: str, sign: str, lex: Lexicon) -> bool:
    """Whether word + rest is one word that was broken at the line's end, not a compound broken at its own hyphen."""
    if not word or not rest or not rest[0].islower() or not word[-1].isalpha():
        return False
    w = word.split("-")[-1].split("'")[-1].split("’")[-1].lower()
    first = WORD.match(rest)
    r = (first.group() if first else rest).lower()
    own = max(lex.count(f"{word.lower()}-{rest.lower()}"), lex.compound(w, r))
    one = lex.count(w + r)
    if not one and not own and lex.repair(w + r) is not None:
        one = 1  # a part is misread
    return lex.editor.joins(w, r, sign, (one, own, lex.count(w), lex.count(r)))


def parts_over_lines(a: str | None, b: str | None, lex: Lexicon) -> tuple[str, str, bool]:
    """(first part without sign, second part) of a word broken between lines a and b, or two empty texts; a known compound?"""
    if not a or not b or a[-1] not in HYPHENS:
        return "", "", False
    head, tail = core_of(a[:-1].rsplit(maxsplit=1)[-1] if a[:-1].strip() and not a[-2].isspace() else "")[1], core_of(b.split(maxsplit=1)[0])[1]
    if broken(head, tail, a[-1], lex):
        return head, tail, False
    return "", "", lex.compound(head.lower(), tail.lower()) > 0


def read_line(s: str, before: str | None, after: str | None, lex: Lexicon) -> tuple[bool, bool, str, bool]:
    """(broken at its end?, misread?, repaired text, goes on with a broken word?) of a body line between two others."""
    head, _, own_a = parts_over_lines(before, s, lex)
    first, tail, own_b = parts_over_lines(s, after, lex)
    h = head.split("-")[-1].split("'")[-1].split("’")[-1]
    text, bad = mend_line(s, h, (WORD.match(tail) or re.match("", "")).group() if tail else "", lex, (own_a, own_b))
    return bool(first), bad, text, bool(head)


def judged(lines: DataFrame, page_info: DataFrame, documents: DataFrame, most: int = LEXICON) -> DataFrame:
    """Every line with kind ('header', 'pageno', 'number' or null), hyphen, misread and its repaired text.

    (file_name, page_number, line_number, kind, hyphen, misread, text, y, y2). Words broken over lines are judged
    with the next body line, on the next page if need be. Lines without text are body without noise. The `most` frequent
    words go to every worker; where the documents have more known words, each line asks for those it needs, by joins.
    """
    lines = cut(furniture(tidy_lines(lines), page_info), "furniture")
    vocab = vocabulary(documents)
    words, capitals, triples, least = frequent(vocab, most)
    editor = fit(words)
    shared = lines.sparkSession.sparkContext.broadcast([words, capitals, triples, editor.weights, editor.offers, editor.breaks])
    w = W.partitionBy("file_name").orderBy("page_number", "line_number")
    body = lines.where("kind is null").withColumn("before", F.lag("s").over(w)).withColumn("after", F.lead("s").over(w))
    body = body.select("file_name", "page_number", "line_number", "s", "before", "after", "y", "y2").withColumn("more", F.lit(None).cast("map<string,long>"))

    def lexicon() -> Lexicon:
        state = shared.value
        if len(state) == 6:  # one lexicon, with what it remembers, for all tasks of a Python worker
            state.append(Lexicon(*state[:3], Editor(*state[3:6])))
        return state[6]

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon()
        for pdf in batches:
            out = []
            for s, before, after, more in zip(pdf["s"], pdf["before"], pdf["after"], pdf["more"]):
                lex.use(dict(more) if more is not None else {})
                out.append(read_line(s, before, after, lex))
            lex.use({})
            yield pdf[["file_name", "page_number", "line_number", "y", "y2"]].assign(
                hyphen=[o[0] for o in out], misread=[o[1] for o in out], text=[o[2] for o in out], joined=[o[3] for o in out]
            )

    def ask(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon()
        for pdf in batches:
            out = []
            for i, s, before, after, more in zip(pdf["line"], pdf["s"], pdf["before"], pdf["after"], pdf["more"]):
                lex.use(dict(more) if more is not None else {}, set())
                read_line(s, before, after, lex)
                out += [(i, x) for x in lex.asked]
            lex.use({})
            yield pd.DataFrame(out, columns=["line", "w"])

    if least > KNOWN:
        rare = cut(vocab.where((F.col("n") >= KNOWN) & (F.col("n") < least)), "rare")
        body = cut(body.withColumn("line", F.monotonically_increasing_id()), "body")
        known = 0
        while True:  # a word known after all may lead to further ones
            asked = body.select("line", "s", "before", "after", "more").mapInPandas(ask, "line long, w string")
            hits = cut(hot_join(cut(asked, "asked"), rare, "w"), "known")
            got = hits.select("line", "w", "n")
            if known:
                got = got.unionByName(body.where("more is not null").select("line", F.explode("more").alias("w", "n")))
            more = got.groupBy("line").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("more"))
            if hits.isEmpty():
                break
            known += 1
            body = cut(body.drop("more").join(more, "line", "left"), "body")
    schema = "file_name string, page_number int, line_number int, y int, y2 int, hyphen boolean, misread boolean, text string, joined boolean"
    done = body.drop("line").mapInPandas(read, schema).withColumn("kind", F.lit(None).cast("string"))
    rest = lines.where("kind is not null").select(
        "file_name", "page_number", "line_number", "y", "y2", F.lit(False).alias("hyphen"), F.lit(False).alias("misread"), F.col("s").alias("text"), F.lit(False).alias("joined"), "kind"
    )
    return done.unionByName(rest)


def found(lines: DataFrame, page_info: DataFrame, documents: DataFrame) -> DataFrame:
    """(file_name, page_number, line_number, kind) of every line with noise."""
    j = judged(lines, page_info, documents)
    kinds = F.array_compact(F.array(
        F.when(F.col("kind").isin("header", "pageno"), F.col("kind")), F.when(F.col("hyphen"), F.lit("hyphen")), F.when(F.col("misread"), F.lit("misread"))
    ))
    return j.select("file_name", "page_number", "line_number", F.explode(kinds).alias("kind"))


def paragraphs(lines: DataFrame, page_info: DataFrame, documents: DataFrame) -> DataFrame:
    """(file_name, paragraph, text): the repaired body of each file as continuous paragraphs.

    Furniture is left out, broken words are joined, misread words put right. A paragraph ends where a line ends a
    sentence and stops well short of the usual line, or stands apart (headings); it runs on over page ends.
    """
    j = cut(judged(lines, page_info, documents).where("kind is null"), "judged")
    w = W.partitionBy("file_name").orderBy("page_number", "line_number")
    usual = j.groupBy("file_name").agg(F.percentile_approx(F.length("text"), 0.8).alias("usual"))
    short = F.length("text") < 0.75 * F.col("usual")
    t = j.join(usual, "file_name").withColumn("_short", short).withColumn("_ends", F.col("text").rlike(r"[.!?)]$"))
    starts = F.lag(F.col("_short") & (F.col("_ends") | ~F.col("text").rlike(r"[,;]$")), 1, True).over(w) & F.col("text").rlike(r"(?U)^[\W\d]*\p{Lu}") & ~F.col("joined")
    t = t.withColumn("paragraph", F.sum(starts.cast("int")).over(w))
    sign = F.regexp_replace("text", rf"[{HYPHENS}]$", "")
    piece = F.when(F.col("hyphen"), sign).when(F.col("text").rlike(rf"(?U)\p{{L}}[{HYPHENS}]$"), F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    got = t.withColumn("piece", piece).groupBy("file_name", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page_number", "line_number", "piece"))).alias("p"))
    return got.select("file_name", "paragraph", F.trim(F.array_join(F.col("p.piece"), "")).alias("text"))
