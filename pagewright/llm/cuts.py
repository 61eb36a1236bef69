"""Problem 10: find texts that were cut off, and how often each source cuts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

# White space, what systems put after a cut, and the legal forms that end a company's name.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = r"(?U)(?:\s|\.\.\.|…|\[\.\.\.\]|\[…\]|\(…\)|\x{FFFD})+$"
VISIBLE_MARKS = r"(?U)(?:\.\.\.|…|\[\.\.\.\]|\[…\]|\(…\)|\x{FFFD})$"
FORMS = r"(?:gmbh|ag|scs|s\. ?a\.|s\.a ?r\.l\.|ltd|holding|invest|partners)"
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Where one sentence of a line ends and the next begins.
NEXT_SENTENCE = r"[ \t\xa0]+(?=\p{Lu})(?<=(?:\p{Ll}{3}|\d{3}|[%)»”])[.!?][ \t\xa0]{1,3})"
#: A line stands alone properly if at least one in so many lines that begin like it does.
ALONE = 100
#: A line of more words that only ever ends texts is running text, however many near copies are cut at the same place.
LONG = 10
#: Lengths of the beginnings whose hashes tell which texts can be beginnings of others.
LENGTHS = (1, 4, 16, 64, 256)


def body(text: Column | str) -> Column:
    """The text without what was put after a cut. Only the end of the text is looked at, unless it is nothing but marks."""
    t = F.rtrim(F.col(text) if isinstance(text, str) else text, F.lit(SPACE + "…\ufffd"))
    end = F.regexp_replace(F.right(t, F.lit(64)), MARKS, "")
    return F.when((end == "") & (F.length(t) > 64), F.regexp_replace(t, MARKS, "")).otherwise(F.concat(F.substring(t, F.lit(1), F.greatest(F.length(t) - 64, F.lit(0))), end))


def ended(line: Column) -> Column:
    """Ends like a sentence: a full stop or the like, perhaps with closing signs after it."""
    return line.rlike(r"""[.!?:;]["'»”’)\]]*$""")


def shape(line: Column) -> Column:
    """The line without case and accents, numbers as 0, dates as <d>, company names as <x>."""
    s = F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(F.lower(line), *ACCENTS))
    s = F.when(s.rlike(r"[0-9]"), F.regexp_replace(s, r"[0-9]+(?:[.,'\x{A0}\x{202F} ][0-9]+)*", "0")).otherwise(s)
    s = F.regexp_replace(s, r"\b0\.? (?:de )?[a-zßœ]++ (?:de )?0\b", "<d>")
    # the name is the word before a legal form: whole words only, so no word is tried twice
    s = F.regexp_replace(s, rf"(?<![\p{{L}}'-])[\p{{L}}'-]++ {FORMS}(?![\p{{L}}\d_])", "<x>")
    return F.regexp_replace(s, r"[ \t\x{A0}]{2,}|[\t\x{A0}]", " ")


def beginnings(text: str) -> Column:
    """Length and hash of each beginning of a text that has one of LENGTHS, the longest last."""
    return F.array_compact(F.array(*[F.when(F.length(text) >= x, F.struct(F.lit(x).alias("x"), F.xxhash64(F.substring(text, 1, x)).alias("key"))) for x in LENGTHS]))


def may_begin_others(texts: DataFrame) -> DataFrame:
    """Of distinct (h, u, keys), those among which every strict prefix of another, and that other, is found.

    keys: beginnings of u. A text that is a prefix of another has the same first characters; each text asks for the
    longest of its beginnings, and what shares no beginning that is asked for is left out. Only hashes are shuffled.
    """
    keys = texts.select("h", F.element_at("keys", -1)["x"].alias("mine"), F.explode("keys").alias("k")).select("h", "k.x", "k.key", (F.col("k.x") == F.col("mine")).alias("asks"))
    keys = cut(keys, "beginnings")
    met = keys.groupBy("x", "key").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).where("n > 1 and asked").select("x", "key")
    ids = cut(keys.join(met, ["x", "key"], "left_semi").select("h").distinct(), "sharing")
    return texts.join(ids, "h", "left_semi")


def prefixes_of_longer(texts: DataFrame) -> DataFrame:
    """(h, following): each body that is a strict prefix of a longer one, and what follows there.

    texts: distinct (h, u, keys), keys being the beginnings of u. In the order of all bodies, the first that begins with u and is longer stands right
    after u. So one range-partitioned sort finds every case, however many texts share a beginning; the only pairs
    that span two partitions are the last body of one and the first of the next, one row for each partition. Empty
    bodies are left out.
    """
    schema = "kind string, part int, h string, u string, following string"

    def neighbours(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str, str] | None = None
        part = -1
        for pdf in batches:
            out = []
            for p, h, u in zip(pdf["part"], pdf["h"], pdf["u"]):
                if last is None:
                    out.append(("first", p, h, u, None))
                elif len(u) > len(last[1]) and u.startswith(last[1]):
                    out.append(("hit", p, last[0], None, u[len(last[1]) : len(last[1]) + 20]))
                last, part = (h, u), p
            yield pd.DataFrame(out, columns=["kind", "part", "h", "u", "following"])
        if last is not None:
            yield pd.DataFrame([("last", part, last[0], last[1], None)], columns=["kind", "part", "h", "u", "following"])

    rows = may_begin_others(texts).select("h", "u").repartitionByRange("u").sortWithinPartitions("u").withColumn("part", F.spark_partition_id())
    rows = cut(rows.mapInPandas(neighbours, schema), "neighbours")
    ends = rows.where("kind <> 'hit'")
    w = W.orderBy("part", F.when(F.col("kind") == "first", 0).otherwise(1))  # two rows for each partition
    ends = ends.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_u", F.lead("u").over(w))
    across = ends.where("kind = 'last' and next_kind = 'first' and length(next_u) > length(u) and startswith(next_u, u)")
    across = across.select("h", F.expr("substr(next_u, length(u) + 1, 20)").alias("following"))
    return rows.where("kind = 'hit'").select("h", "following").unionByName(across)


def counted_between(values: DataFrame, asks: DataFrame) -> DataFrame:
    """(id, slot, n): how much n of values (g, n) lies at lo <= g < hi, for asks (id, slot, lo, hi); sums over equal (id, slot).

    The prefix join of short texts: what begins with p is what lies between p and the next text that doesn't. One
    range-partitioned sort of values and bounds, a running sum in each partition and one total of each partition serve
    all asks: a beginning shared by any number of values costs nothing more, and prefixes of any length are compared.
    """
    none = F.lit(None)
    ends = asks.select("id", "slot", F.explode(F.array(F.struct(F.col("lo").alias("g"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("g"), F.lit(1).alias("sign")))).alias("e"))
    rows = values.select("g", F.lit(1).alias("tie"), "n", none.cast("long").alias("id"), none.cast("int").alias("slot"), F.lit(0).alias("sign")).unionByName(
        ends.select("e.g", F.lit(0).alias("tie"), F.lit(0).cast("long").alias("n"), F.col("id").cast("long").alias("id"), F.col("slot").cast("int").alias("slot"), "e.sign")
    )

    def running(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["part"].iloc[0])
            sums = pdf["n"].to_numpy().cumsum() + total
            total = int(sums[-1])
            hit = (pdf["sign"] != 0).to_numpy()
            yield pdf.loc[hit, ["part", "id", "slot", "sign"]].assign(sum=sums[hit])
        if part is not None:
            yield pd.DataFrame({"part": [part], "id": pd.array([None], dtype="Int64"), "slot": pd.array([None], dtype="Int32"), "sign": [0], "sum": [total]})

    ordered = rows.repartitionByRange("g").sortWithinPartitions("g", "tie").select(F.spark_partition_id().alias("part"), "n", "id", "slot", "sign")
    sums = cut(ordered.mapInPandas(running, "part int, id long, slot int, sign int, sum long"), "sums")
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    before = sums.where("sign = 0").select("part", F.coalesce(F.sum("sum").over(w), F.lit(0)).alias("before"))
    got = sums.where("sign <> 0").join(F.broadcast(before), "part")
    return got.groupBy("id", "slot").agg(F.sum(F.col("sign") * (F.col("sum") + F.col("before"))).alias("n"))


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n, how): every document with text; how is null for complete ones.

    how = 'copy': the text is a strict prefix of a longer one elsewhere, which goes on inside the sentence. 'mark': what
    systems put after a cut follows a text that has not ended. 'sentence': the last sentence has not ended and is, its
    names and numbers masked, a strict prefix of longer ones elsewhere, and isn't a line that stands alone elsewhere
    (heading, signature, total, table row). 'open': it neither ends nor is a prefix of anything known, but follows a
    finished sentence on its line or has more than four words and no closing name, date or number. Copies of one
    text are judged once. Null and blank texts are left out.
    """
    d = documents.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "source", "text")
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(8))
    d = d.withColumn("u", body("text")).withColumn("mark", end.rlike(VISIBLE_MARKS))
    d = cut(d.select("doc_id", "source", "mark", "u", F.length("u").alias("n"), F.sha2("u", 256).alias("h"), beginnings("u").alias("keys"), F.monotonically_increasing_id().alias("row")), "bodies")
    # spaces or lines after the text are no sign of a cut; other marks are
    one = cut(d.groupBy("h").agg(F.min("row").alias("row")), "one")
    texts = d.join(one.select("row"), "row", "left_semi").select("h", "u", "keys")
    lines = F.filter(F.transform(F.split("u", r"[\r\n]+"), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: x != "")
    units = texts.select("h", lines.alias("l")).where(F.size("l") > 0)
    units = units.select("h", F.size(F.split(F.element_at("l", -1), NEXT_SENTENCE)).alias("in_last"), F.flatten(F.transform("l", lambda x: F.split(x, NEXT_SENTENCE))).alias("s"))
    units = units.select("h", "in_last", F.size("s").alias("size"), F.posexplode("s").alias("i", "last"))
    final = F.col("i") == F.col("size") - 1
    units = units.select(shape(F.col("last")).alias("g"), final.alias("final"), *[F.when(final, F.col(c)).alias(c) for c in ("h", "last", "in_last")])
    units = cut(units, "units")
    per = cut(units.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("final").cast("int")).alias("ends")), "shapes")
    table_row = r"(?U)^.*\p{L}.*?(?:\t|\||\.{3,}|\s{2,})\s*[-(]?\d[\d.,'\s]*\)?\s*(?:\t|\||\.{3,}|\s{2,})\s*[-(]?\d[\d.,'\s]*\)?$"
    open_ = units.where("final").select("h", "g", "last", (F.col("in_last") > 1).alias("running"), ended(F.col("last")).alias("ended"))
    tail = cut(open_.where(~F.col("ended") & ~F.col("last").rlike(table_row)), "tails")
    keys = tail.select("g").distinct().withColumn("words", F.split("g", " ")).withColumn("k", F.size("words"))
    keys = cut(keys.withColumn("but_last", F.expr("array_join(slice(words, 1, k - 1), ' ')")).drop("words").withColumn("id", F.monotonically_increasing_id()), "keys")
    to = lambda slot, c, a, z: F.struct(F.lit(slot).alias("slot"), F.concat(c, F.lit(a)).alias("lo"), F.concat(c, F.lit(z)).alias("hi"))
    # go on with another word; go on inside the last word (letters, plain and others); begin like all but the last word
    asks = F.array(to(0, "g", " ", "!"), to(1, "g", "a", "{"), to(1, "g", "\xaa", "\u2000"), F.when(F.col("k") > 1, to(2, "but_last", " ", "!")))
    asked = keys.select("id", F.explode(F.array_compact(asks)).alias("a")).select("id", "a.*")
    n = counted_between(per.select("g", "n"), asked).groupBy("id").agg(*[F.sum(F.when(F.col("slot") == i, F.col("n"))).alias(c) for i, c in enumerate(("more", "within", "near"))])
    keys = keys.join(n, "id", "left").join(per.select("g", F.col("n").alias("alone"), F.col("ends").alias("final")), "g", "left")
    keys = keys.na.fill(0, ["alone", "final", "more", "within", "near"])
    # last lines of other texts may be cut at the same letter: they count only if the line is seen to go on with another
    # word, or never or seldom goes on inside its last one
    whole = (F.col("more") > 0) | (F.col("final") > F.col("within"))
    inside = F.col("alone") > F.col("final")  # seen before the end of a text
    keys = keys.withColumn("inside", inside).withColumn("alone", F.when(whole, F.col("alone")).otherwise(F.col("alone") - F.col("final")))
    known = (F.col("inside") | (F.col("k") <= LONG)) & (F.col("alone") >= 2) & (F.col("alone") * ALONE >= F.col("more") + F.col("within"))
    closing = (F.col("k") <= 6) & F.col("g").rlike(r"(?:^| )(?:<x>|<d>|0)$")
    goes = (F.col("more") > 0) | (F.greatest("near", "within") > F.col("alone"))
    keys = cut(keys.select("g", known.alias("known"), (F.col("more") + F.col("within") > 0).alias("prefix"), (~known & (goes | ((F.col("k") > 4) & ~closing))).alias("cut")), "verdicts")
    by_tail = tail.join(keys, "g").where(F.col("running") | F.col("cut")).select("h", F.when(F.col("prefix"), "sentence").otherwise("open").alias("tail"))
    copy = prefixes_of_longer(texts)
    # inside a line: the copy goes on with something other than a new line
    inside = copy.where(~F.col("following").rlike(r"^\s*[\r\n]")).join(open_.select("h", "ended"), "h")
    small_next = F.col("following").rlike(r"(?U)^\s*[\p{Ll}\d,;)]")
    by_copy = inside.where(~F.col("ended") | small_next).select("h", F.lit(True).alias("copy"))
    facts = open_.where("not ended").select("h", F.lit(True).alias("open")).join(by_tail, "h", "left").join(by_copy, "h", "full")
    how = (
        F.when(F.coalesce("copy", F.lit(False)), "copy")
        .when(F.col("mark") & F.coalesce("open", F.lit(False)), "mark")
        .otherwise(F.col("tail"))
    )
    return d.select("doc_id", "source", "n", "mark", "h").join(cut(facts, "facts"), "h", "left").select("doc_id", "source", "n", how.alias("how"))


def found(documents: DataFrame) -> DataFrame:
    return judged(documents).where("how is not null").select("doc_id").distinct()


def sources(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, share, by_copy, by_mark, by_sentence, by_open, usual_length): how often each source cuts.

    usual_length: the length most of its cut texts have, where at least a fifth of them (and three) share it; it shows a field limit.
    """
    j = cut(judged(documents), "judged")
    per = j.groupBy("source").agg(
        F.count("*").alias("documents"), F.count("how").alias("cut"),
        *[F.count(F.when(F.col("how") == x, 1)).alias(f"by_{x}") for x in ("copy", "mark", "sentence", "open")],
    )
    length = j.where("how is not null").groupBy("source", "n").agg(F.count("*").alias("c"))
    most = length.groupBy("source").agg(F.max(F.struct("c", "n")).alias("m"))
    return per.join(most.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "documents", "cut", F.round(F.col("cut") / F.col("documents"), 4).alias("share"), "by_copy", "by_mark", "by_sentence", "by_open",
        F.when((F.col("m.c") >= 3) & (F.col("m.c") * 5 >= F.col("cut")), F.col("m.n")).alias("usual_length"),
    )
