"""Problem 8: fill containers of fixed capacity with texts of uneven length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Public tokenizer that measures the texts.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens, documents and attention cost (sum of squared piece lengths) a container holds. A text that fills a container
#: costs TOKENS ** 2, and no text may be divided that fits; so with this attention budget only the others decide. A smaller
#: budget binds: a text that alone exceeds it is divided as one that exceeds the tokens.
TOKENS, DOCUMENTS, ATTENTION = 4_096, 128, 4_096**2
#: Least part of the token capacity a piece may have to be cut to by the attention budget.
LEAST_PIECE = 1 / 16
#: Pieces one task packs; containers filled below FULL in every respect are opened again and packed across tasks.
PART, FULL = 8_000, 0.985
#: Packing again ends when it saves less than one in so many of the containers opened, or after so many levels.
GAIN, LEVELS = 1_000, 8


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document with text; texts are measured whole."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        for pdf in batches:
            n = [len(x) for x in sp.encode(pdf["text"].tolist(), num_threads=1)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": np.array(n, dtype=np.int64)})

    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInPandas(count, "doc_id long, tokens long")


def scarcity(demand: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Weight of each capacity: the part of it that all items together ask for, against the scarcest one."""
    asked = demand.sum(axis=0) / capacity
    return asked / asked.max() if len(demand) and asked.max() > 0 else np.ones(len(capacity))


def best_fit(tokens: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] | None = None) -> np.ndarray:
    """The container of each item: vector best-fit of items in decreasing order.

    An item asks for its tokens, one document and its squared length. It goes to the open container that can take it under
    every capacity and whose weighted residual is least in norm afterwards; if none can, a new one is opened. Weights
    are by scarcity unless given, so the capacity that runs out first decides. Ties go to the container opened first.
    """
    cap = np.array(capacity, dtype=float)
    size = tokens.astype(float)
    demand = np.stack([size, np.ones(len(size)), size**2], axis=1) if len(size) else np.empty((0, 3))
    scale = (scarcity(demand, cap) if weights is None else np.array(weights)) / cap
    out = np.empty(len(tokens), dtype=np.int64)
    left = np.empty((64, 3))
    n = 0
    live = np.empty(0, dtype=np.int64)  # containers that can still take the smallest item
    least = demand.min(axis=0) if len(demand) else np.zeros(3)
    for i in np.argsort(-size, kind="stable"):
        item = demand[i]
        after = left[live] - item
        fits = np.flatnonzero((after >= 0).all(axis=1))
        if len(fits):
            rest = after[fits] * scale
            b = live[fits[int(np.argmin((rest * rest).sum(axis=1)))]]
        else:
            if n == len(left):
                left = np.concatenate([left, np.empty_like(left)])
            left[n] = cap
            b = n
            n += 1
            live = np.append(live, b)
        left[b] -= item
        if (left[b] < least).any():
            live = live[live != b]
        out[i] = b
    return out


def pieces_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, first_token, tokens): texts as one piece, those above the capacity as runs of full ones and a rest."""
    return sizes.where("tokens > 0").withColumn("piece", F.explode(F.expr(f"sequence(0L, (tokens - 1) div {capacity})"))).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).alias("tokens")
    )


def packed(sizes: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: float = ATTENTION, part: int = PART) -> DataFrame:
    """(container_id, doc_id, piece, first_token, tokens) for sizes (doc_id, tokens).

    Hash partitions of about `part` pieces are packed each in a task of its own. Containers filled below FULL are opened
    again and their pieces packed with those of other tasks, as long as that saves containers. No piece is dropped; a text is
    divided only if it alone exceeds the tokens or the attention budget; texts without a token are left out; rows
    repeated under one id are packed as often as they come.
    """
    piece = min(tokens, isqrt(int(attention)))
    if piece < tokens * LEAST_PIECE:
        raise ValueError(f"attention must allow a piece of {LEAST_PIECE:.4f} of the tokens")
    if documents < 1:
        raise ValueError("documents must be at least 1")
    capacity = (float(tokens), float(documents), float(attention))
    cols = ["doc_id", "piece", "first_token", "tokens"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        n = pdf["tokens"].to_numpy()
        b = best_fit(n, capacity)
        full = np.maximum.reduce([np.bincount(b, weights=x) / c for x, c in zip((n, np.ones(len(n)), n.astype(float) ** 2), capacity)])
        return pdf[cols].assign(container_id=b + (int(pdf["p"].iloc[0]) << 24), fill=full[b])

    schema = "doc_id long, piece long, first_token long, tokens long, container_id long, fill double"
    rest = cut(pieces_of(sizes, piece), "pieces")
    n, level, opened = rest.count(), 0, None
    done = before = None
    while True:
        parts = max(1, -(-n // part))
        key = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(parts)).cast("long")
        # a stated number of ranges, one for each part: they aren't folded into fewer tasks
        spread = rest.withColumn("p", key).repartitionByRange(parts, "p")
        got = cut(spread.groupBy("p").applyInPandas(pack, schema).withColumn("container_id", F.col("container_id") + F.lit(level << 52)), "packed")
        if before is not None:
            made = got.agg(F.count_distinct("container_id").alias("c")).first()["c"]
            if made * GAIN > opened * (GAIN - 1):  # hardly anything saved: what was packed stays as it is
                return before if made >= opened else done.unionByName(got.select("container_id", *cols))
        low = F.col("fill") < FULL
        full = got.where(~low).select("container_id", *cols)
        done = full if done is None else done.unionByName(full)
        before = done.unionByName(got.where(low).select("container_id", *cols))
        if parts == 1 or level + 1 == LEVELS:
            return before
        rest = got.where(low).select(*cols)
        counted = got.where(low).agg(F.count("*").alias("n"), F.count_distinct("container_id").alias("c")).first()
        n, opened, level = counted["n"], counted["c"], level + 1
        if not n:
            return before


def packing(documents: DataFrame) -> DataFrame:
    return packed(token_counts(documents))


def report(documents: DataFrame) -> DataFrame:
    """One row: containers, texts, divided texts, tokens, mean and least fill, and the least number of containers possible."""
    p = cut(packing(documents), "packing")
    per = p.groupBy("container_id").agg(F.sum("tokens").alias("t"))
    a = per.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.avg("t") / TOKENS, 6).alias("mean_fill"), F.round(F.min("t") / TOKENS, 6).alias("least_fill"))
    b = p.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("documents"), F.count(F.when(F.col("n") > 1, 1)).alias("divided"))
    return a.select("*", b.select("documents").scalar().alias("documents"), b.select("divided").scalar().alias("divided"), F.ceil(F.col("tokens") / TOKENS).alias("least_containers"))


def limits(documents: DataFrame) -> DataFrame:
    """One row: documents packed, containers over a capacity, and documents whose pieces don't follow each other without a gap."""
    p = cut(packing(documents), "packing")
    per = p.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("d"), F.sum(F.col("tokens") * F.col("tokens")).alias("a"))
    over = per.agg(*[F.count(F.when(F.col(c) > most, 1)).alias(f"over_{name}") for c, most, name in (("t", TOKENS, "tokens"), ("d", DOCUMENTS, "documents"), ("a", ATTENTION, "attention"))])
    of = p.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.count_distinct("piece").alias("k"))
    whole = of.agg(F.count("*").alias("documents"), F.count(F.when((F.col("n") != F.col("k")) | (F.col("last") + 1 != F.col("n")) | (F.col("t") != F.col("end")), 1)).alias("broken"))
    return over.select(whole.select("documents").scalar().alias("documents"), "*", whole.select("broken").scalar().alias("broken"))
