"""Page language by words that only one language has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_join
from ..session import cut

#: Words up to which a vocabulary is broadcast.
BROADCAST_ROWS = 200_000
LANGS = ("fra", "eng", "deu")  # fixed order: the first wins ties
# Small word lists; pass larger ones as a table (lang, token).
STOP_WORDS = {
    "fra": "le la les des du un une et est pour par dans sur au aux en de que qui ne pas".split(),
    "eng": "the of and to in is for by on at with as an not has have are was which been".split(),
    "deu": "der die das den dem des und ist für von mit auf zu ein eine einer nicht im wird wurde".split(),
}


def exclusive_words(vocab: DataFrame) -> DataFrame:
    """(lang, token) of the tokens that one language alone has."""
    return vocab.distinct().groupBy("token").agg(F.count("*").alias("n"), F.min("lang").alias("lang")).where("n = 1").select("lang", "token")


def vocab_table(spark, words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, v in words.items() for t in v], "lang string, token string")


def page_language(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, language, confidence) for tokens (id, token).

    The exclusive words go to every task if they are counted to be at most BROADCAST_ROWS, else they meet the tokens in a
    join that takes frequent tokens apart.

    Each language is scored by its share of the tokens; confidence is the best share of all shares, cut to two
    decimals. Nothing found: the first language with 0.
    """
    v = cut(exclusive_words(vocab), "exclusive")
    met = tokens.join(F.broadcast(v), "token", "left") if v.count() <= BROADCAST_ROWS else hot_join(tokens, v, "token", "left")
    hit = met.groupBy("id").agg(*[F.count(F.when(F.col("lang") == x, 1)).alias(x) for x in LANGS])
    best, total = F.greatest(*LANGS), sum((F.col(x) for x in LANGS), F.lit(0))
    lang = F.coalesce(*[F.when(F.col(x) == best, F.lit(x)) for x in LANGS])
    return hit.select("id", F.when(total > 0, lang).otherwise(LANGS[0]).alias("language"), F.when(total > 0, F.floor(best * 100 / total) / 100).otherwise(0.0).alias("confidence"))


def page_language_two_stage(tokens: DataFrame, stop: DataFrame, vocab: DataFrame, least: float = 0.4) -> DataFrame:
    """By stop words; pages below `least` confidence by the larger vocabulary."""
    a, b = page_language(tokens, stop), page_language(tokens, vocab)
    b = b.select("id", F.col("language").alias("l2"), F.col("confidence").alias("c2"))
    weak = F.col("confidence") < least
    return a.join(b, "id").select("id", F.when(weak, F.col("l2")).otherwise(F.col("language")).alias("language"), F.when(weak, F.col("c2")).otherwise(F.col("confidence")).alias("confidence"))
