"""Text scalars of the fingerprint: enumerators, dates, numbers, letter folding. Columns in, columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .norm import let, strip

# Fixed values.
VOWELS = "àâéèêëîïôùûü", "aaeeeeiiouuu"
BULLET = r"[•>✓.\-–—_*\x{FFFD}]"
NOTE_WORDS = {"fra": ["note"], "eng": ["note"], "deu": ["punkt", "erläuterung", "anmerkung"]}
LANG_CODES = {"fr": "fra", "fra": "fra", "en": "eng", "eng": "eng", "de": "deu", "deu": "deu"}
NOT_ENUMERATORS = ["la", "le", "el", "lo", "il"]
SIGN_WORDS = [("-", " petit tiret "), ("–", " tiret "), ("_", " souligner "), (".", " point "), ("✓", " coche "), ("*", " astérisque "), (")", " parenthèse ")]
DATE = r"(\s[0-3]?[0-9][-/.\s]\s*(?:[a-zÀ-Ÿ']*(?:[0-3]?[0-9])?)[-/.\s]\s*%s\s)"
DATE_4, DATE_2 = DATE % "[12][089][0-9]{2}", DATE % "[0-9]{1,2}"
NUMBER_1 = r"(\s[a-z]*[+-]?\s?\d{0,3}[,.\s]*\d{0,3}[,.\s]*[a-z]?\d{2,3}[,.\s]?\d*[€|$]*(?:\beuros\b)*(?:\beur\b)*[.,]?\s)"
NUMBER_2 = r"(\s\d[,.\s]\d\s?\d[€|$]*(?:\beuros\b)*(?:\beur\b)*[.,]?\s)"


def fold_vowels(c: Column | str) -> Column:
    """French accented vowels to plain ones, œ to oe; other letters stay."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.translate(c, *VOWELS), F.lit("œ"), F.lit("oe"))


def note_word(lang: str | None) -> str:
    """Pattern of the optional word before an enumerator in this language; empty for other languages."""
    words = NOTE_WORDS.get(LANG_CODES.get(lang or "", ""), [])
    if not words:
        return ""
    return rf"(?:{words[0]}\s)?" if len(words) == 1 else "(?:" + "|".join([*words, r"\s"]) + ")*"


def enumerator_patterns(word: str = "", line: bool = False) -> list[tuple[str, int]]:
    """(pattern, group) of the four ways a line can be numbered; line=True asks for a closing sign."""
    return [
        (rf"^{BULLET}?{word}[1livx]?[0-9a-j]?[.]?[0-9]{{0,2}}[1livx]*[.]?[0-9]?\s?[).\-–_:—*]{{{1 if line else 0},2}}\s", 0),
        (rf"^{BULLET}?{word}[0-9]{{1,2}}[.]?[0-9]{{0,2}}[.]?[0-9]{{0,2}}[).\-–—_:*\s]{{1,2}}", 0),
        (rf"^{BULLET}\s?{word}", 0),
        (r"^([0-9a-f][.-][0-9a-f]?[.-]?)+", 1),
    ]


def enumerator(c: Column | str, lang: Column | None = None, line: bool = False) -> Column:
    """The first enumerator the text starts with, null if none. lang: column whose language sets the optional note word."""
    c = F.col(c) if isinstance(c, str) else c

    def first(word: str) -> Column:
        def found(low: Column) -> Column:
            return F.coalesce(*[F.nullif(F.regexp_extract(low, p, g), F.lit("")) for p, g in enumerator_patterns(word, line)])

        odd = F.when(F.substring(c, 1, 1).isin("\ufffd", "\uf0b7"), F.substring(c, 1, 1))
        return F.coalesce(let(strip(F.lower(c)), found), odd)

    if lang is None:
        return first("")
    out = first("")
    for codes in (("de", "deu"), ("fr", "fra", "en", "eng")):
        out = F.when(lang.isin(*codes), first(note_word(codes[0]))).otherwise(out)
    return out


def has_text(c: Column | str) -> Column:
    """Holds a letter, an apostrophe or a hyphen."""
    return F.lower(c).rlike(r"[a-z'\-]+")


def sign_words(c: Column) -> Column:
    for sign, word in SIGN_WORDS:
        c = F.replace(c, F.lit(sign), F.lit(word))
    return c


def enumerator_type(c: Column | str) -> Column:
    """The kind of an enumerator: Roman letters, digits and a single letter by their names, signs by words.

    Replacements follow each other on the text as it then is, so letters of names put in before are replaced again.
    """

    def named(pattern: str, name: str) -> Callable[[Column], Column]:
        return lambda t: F.aggregate(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), t, lambda acc, x: F.replace(acc, x, F.lit(name)))

    def letter(t: Column) -> Column:
        return let(F.regexp_extract(t, r"^([a-z]*)", 1), lambda first: F.when(F.length(first) == 1, F.replace(t, first, F.lit(" lettre "))).otherwise(t))

    return sign_words(let(let(let(strip(F.lower(c)), named("([ivxl]+)", " romain ")), named("([0-9]+)", " cardinal ")), letter))


def strip_dates(c: Column | str) -> Column:
    """Every occurrence of the first date with a four-digit year, then of the first with a short year, removed."""
    t = F.col(c) if isinstance(c, str) else c

    def without(p: str) -> Callable[[Column], Column]:
        def cut_out(t: Column) -> Column:
            m = strip(F.regexp_extract(F.concat(F.lit(" "), t, F.lit(" ")), p, 1))
            return let(m, lambda x: F.when(x != "", strip(F.replace(t, x, F.lit("")))).otherwise(t))

        return cut_out

    return let(let(t, without(DATE_4)), without(DATE_2))


def strip_numbers(c: Column | str) -> Column:
    """Number-like tokens removed, with the blanks around and a letters-only word right before them."""
    t = F.col(c) if isinstance(c, str) else c
    for p in (NUMBER_1, NUMBER_2):
        t = F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), p, "")
    return strip(t)


def find_numbers(c: Column | str, start: bool = False, end: bool = False) -> Column:
    """All number-like tokens with the blanks around them."""
    t = F.concat(F.lit(" "), F.col(c) if isinstance(c, str) else c, F.lit(" "))
    a, z = "^" if start else "", "$" if end else ""
    return F.concat(*[F.regexp_extract_all(t, F.lit(a + p + z), F.lit(1)) for p in (NUMBER_1, NUMBER_2)])


def plain_quotes(c: Column | str) -> Column:
    """Curly quotes and long dashes to ASCII."""
    return F.translate(c, "‘’—", "''-")


def first_tokens(c: Column | str, n: int = 10) -> Column:
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def before_colon(c: Column | str) -> Column:
    return F.substring_index(c, ":", 1)
