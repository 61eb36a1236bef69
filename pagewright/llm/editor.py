"""An averaged-perceptron character editor that repairs misread words."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable, Sequence
from operator import itemgetter

#: Words, corruptions of each, and passes of the training; a word's rank by frequency decides whether it is among them.
TRAIN_WORDS, CORRUPTIONS, EPOCHS = 4_000, 4, 2
#: Alternatives kept while a word is decoded, operations offered for a character at most, and the lead over keeping a character that the model must not exceed to offer one.
BEAM, OFFERED, SPREAD = 40, 8, 60.0
#: Numbers and broken words among the training examples, passes over the broken words, and the lead that each should have.
TRAIN_NUMBERS, TRAIN_BREAKS, BREAK_EPOCHS, MARGIN = 600, 6_000, 4, 6.0
#: Corruptions of all words together that a small vocabulary is trained on.
LEAST_EXAMPLES = 2_000
#: Smallest averaged weight that is kept.
LEAST_WEIGHT = 0.3
#: Signs that end a line inside a word.
HYPHENS = "-¬‐‑­–"

# What page readers commonly take characters for (clean -> read).
CONFUSIONS = {
    "i": "1 l ! í".split(), "l": "1 i I |".split(), "o": "0 c".split(), "s": "5 $".split(), "g": "9 q".split(), "e": "c 6 o".split(),
    "é": "6 e c è".split(), "è": "6 e é".split(), "t": "† f 7".split(), "a": "@ o 4".split(), "n": "ri u".split(), "h": "li b".split(),
    "m": "rn nn".split(), "rn": ["m"], "w": "vv".split(), "vv": ["w"], "ü": "ii u".split(), "u": "ii n v".split(), "ä": "ii a".split(), "d": "cl".split(),
    "cl": ["d"], "b": "8 6 h".split(), "z": "2".split(), "q": "9 g".split(), "c": "e (".split(), "f": "t".split(), "ß": "8 B".split(),
    "ö": "o ii 6".split(), "r": "n".split(), "v": "y".split(), "y": "v".split(), "p": "n".split(), "k": "lc".split(), "ll": ["11"], "ri": ["n"], "ii": ["u"],
}
DIGITS = {"0": "O o".split(), "1": "l I i |".split(), "2": "Z z".split(), "5": "S s".split(), "8": ["B"], "9": "g q".split()}


def number(rng: random.Random) -> str:
    """A year, an amount in one of the usual forms, or a small number."""
    kind = rng.random()
    if kind < 0.2:
        return str(rng.randrange(1990, 2030))
    if kind < 0.4:
        return str(rng.randrange(10 ** rng.randrange(1, 5))) + rng.choice(["", ".", "%", f",{rng.randrange(10)}"])
    group, point = rng.choice([(".", ","), (",", "."), ("", ","), ("", ".")])
    whole = f"{rng.randrange(10 ** rng.randrange(3, 9)):,}".replace(",", group)
    return whole + (f"{point}{rng.randrange(100):02d}" if rng.random() < 0.6 else "")


def misread_number(text: str, rng: random.Random) -> tuple[str, list[str]]:
    """(number with one to three digits read as letters, the digit each character stands for)."""
    out = list(text)
    spots = [i for i, c in enumerate(text) if c in DIGITS]
    for i in rng.sample(spots, min(len(spots), rng.choice((1, 1, 1, 2, 3)))):
        out[i] = rng.choice(DIGITS[text[i]])
    return "".join(out), list(text)


def corrupted(word: str, rng: random.Random) -> tuple[str, list[str]]:
    """(noisy word, operation for each of its characters); an operation is the clean text the character stands for.

    Keeping a character is the operation equal to it, deleting it the empty text, replacing it another character,
    inserting a text of two characters; a blank put into a word is an operation '' on the blank, a join.
    """
    spots = [(i, c) for c in CONFUSIONS for i in range(len(word)) if word.startswith(c, i)]
    edits: dict[int, tuple[str, str]] = {}
    for _ in range(1 if rng.random() < 0.8 else 2):
        if spots and rng.random() < 0.8:
            i, c = rng.choice(spots)
            if all(not (a < i + len(c) and i < a + len(x)) for a, (x, _) in edits.items()):
                edits[i] = (c, rng.choice(CONFUSIONS[c]))
        elif len(word) > 2:
            i = rng.randrange(1, len(word))
            edits.setdefault(i, (word[i], " " + word[i]))
    noisy, ops, i = [], [], 0
    while i < len(word):
        clean, read = edits.get(i, (word[i], word[i]))
        if read == " " + clean:
            noisy += [" ", clean]
            ops += ["", clean]
        elif len(read) == 1:
            noisy.append(read)
            ops.append(clean)
        else:
            noisy += list(read)
            ops += [clean] + [""] * (len(read) - 1)
        i += len(clean)
    return "".join(noisy), ops


def features(s: str, i: int) -> list[str]:
    """What the model sees of position i: the character with up to three neighbours on either side."""
    p = "^^^" + s + "$$$"
    j = i + 3
    c = p[j]
    return [
        "0" + c, "1" + p[j - 1] + c, "2" + c + p[j + 1], "3" + p[j - 1 : j + 2], "4" + p[j - 2 : j + 1], "5" + p[j : j + 3], "6" + p[j - 2 : j + 2],
        "7" + p[j - 1 : j + 3], "8" + p[j - 3 : j + 1], "9" + p[j : j + 4], "a" + p[j - 2 : j + 3], "b" + p[j - 3 : j + 4], "c" + p[j - 1] + "_" + p[j + 1],
        "d" + p[j - 2 : j] + "_" + p[j + 1 : j + 3], "e" + p[j - 3 : j] + "_", "f" + "_" + p[j + 1 : j + 4],
    ]


#: So many of them hold the character itself; operations learned with them are always among those offered for it.
WITH_CHARACTER = 12

_cost = itemgetter(0)


def size_of(n: int) -> str:
    """A count as one of few sizes."""
    return str(min(n.bit_length(), 9))


def break_features(head: str, tail: str, sign: str, facts: tuple[int, int, int, int]) -> list[str]:
    """What the model sees of a line's end: the sign, the letters around it, and how often the documents have the whole
    word, the compound, and the two parts (facts, 0 for never)."""
    one, own, first, second = facts
    more = "=" if one == own else ">" if one > own else "<"
    parts = f"{int(first > 0)}{int(second > 0)}"
    return [
        "bias", "s" + sign, "a" + head[-1:], "b" + head[-2:], "c" + head[-3:], "d" + tail[:1], "e" + tail[:2], "f" + tail[:3], "g" + head[-1:] + tail[:1], "h" + head[-2:] + tail[:2],
        "n" + str(min(len(head), 5)), "m" + str(min(len(tail), 5)), "o" + size_of(one), "p" + size_of(own), "q" + more, "r" + more + sign, "t" + parts + more, "u" + parts + sign + more, "v" + size_of(one) + "/" + size_of(own),
    ]


class Editor:
    """weights: feature -> operation -> weight; offers: character -> operations seen for it; breaks: feature -> weight of a line join."""

    def __init__(self, weights: dict[str, dict[str, float]], offers: dict[str, tuple[str, ...]], breaks: dict[str, float] | None = None):
        self.weights, self.offers, self.breaks = weights, offers, breaks or {}
        self.steps: dict[str, list[tuple[float, str]]] = {}

    def scored(self, s: str, i: int) -> list[tuple[float, str]]:
        ops = self.offers.get(s[i], (s[i],))
        total = dict.fromkeys(ops, 0.0)
        get = self.weights.get
        feats = features(s, i)
        for f in feats[:WITH_CHARACTER]:
            w = get(f)
            if w:
                for op, v in w.items():
                    total[op] += v
        for f in feats[WITH_CHARACTER:]:
            w = get(f)
            if w:
                for op, v in w.items():
                    if op in total:
                        total[op] += v
        return sorted(((v, op) for op, v in total.items()), key=lambda x: (-x[0], x[1]))

    def joins(self, head: str, tail: str, sign: str, facts: tuple[int, int, int, int]) -> bool:
        """Whether the operation for the sign at a line's end is the line join (the sign goes), not to keep it."""
        return sum(self.breaks.get(f, 0.0) for f in break_features(head, tail, sign, facts)) > 0

    def readings(self, s: str) -> list[str]:
        """Readings of s, the likeliest first; s itself is among them if the model would keep it."""
        beam = [(0.0, "")]
        padded = "^^^" + s + "$$$"
        for i in range(len(s)):
            window = padded[i : i + 7]  # all that the features of this place depend on
            step = self.steps.get(window)
            if step is None:
                best = self.scored(s, i)[:OFFERED]
                step = [(v, op) for v, op in best if v >= best[0][0] - SPREAD]
                if len(self.steps) > 60_000:
                    self.steps.clear()
                self.steps[window] = step
            if len(step) == 1:
                v, op = step[0]
                beam = [(a + v, t + op) for a, t in beam]
                continue
            grown = [(-a - v, n, t + op) for n, (a, t) in enumerate(beam) for v, op in step]
            grown.sort(key=_cost)
            seen: set[str] = set()
            beam = []
            for cost, _, t in grown:
                if t not in seen:
                    seen.add(t)
                    beam.append((-cost, t))
                    if len(beam) == BEAM:
                        break
        return [t for _, t in beam]


def train_breaks(counts: dict[str, int], pairs: dict[str, int], seed: int = 7) -> dict[str, float]:
    """Averaged-perceptron weights of the line join, from words broken at random places, compounds broken at their own
    sign, and words that stand with a sign before another word.

    In three of ten examples the documents are taken not to have the word itself, so the letters and the parts are
    learned too. Of both kinds the most frequent are used, at most TRAIN_BREAKS examples each.
    """
    rng = random.Random(seed)
    order = sorted(counts, key=lambda w: (-counts[w], w))
    words, compounds = [w for w in order if "-" not in w and len(w) >= 5][:TRAIN_BREAKS], [w for w in order if "-" in w.strip("-")]
    data: list[tuple[list[str], int]] = []

    def add(head: str, tail: str, sign: str, join: int) -> None:
        hide = rng.random() < 0.3
        one, own = counts.get(head + tail, 0), max(counts.get(f"{head}-{tail}", 0), pairs.get(f"{head}-{tail}", 0))
        if hide:
            one, own = (0, own) if join else (one, 0)
        # texts that were cut off leave parts of words among the words
        first = counts.get(head, 0) or (rng.randrange(3, 40) if rng.random() < 0.3 else 0)
        second = counts.get(tail, 0) or (rng.randrange(3, 40) if rng.random() < 0.3 else 0)
        data.append((break_features(head, tail, sign, (one, own, first, second)), 1 if join else -1))

    if not words:
        return {}
    for i in range(TRAIN_BREAKS):
        w = words[i % len(words)]
        at = rng.randrange(2, len(w) - 1)
        add(w[:at], w[at:], rng.choice(HYPHENS), 1)
    for i in range(TRAIN_BREAKS if compounds else 0):
        parts = compounds[i % len(compounds)].split("-")
        at = rng.randrange(1, len(parts))
        if parts[at - 1] and parts[at]:
            add(parts[at - 1], parts[at], "-" if rng.random() < 0.95 else rng.choice(HYPHENS), 0)
    # words whose second part is left out before the next word (a suspended hyphen)
    common = [w for w in order if "-" not in w and len(w) >= 2]
    for _ in range(TRAIN_BREAKS // 2):
        add(rng.choice(words), rng.choice(common[:100] if rng.random() < 0.7 else common), "-", 0)
    weights: dict[str, float] = defaultdict(float)
    sums: dict[str, float] = defaultdict(float)
    step = 0
    for _ in range(BREAK_EPOCHS):
        rng.shuffle(data)
        for feats, gold in data:
            step += 1
            if sum(weights[f] for f in feats) * gold <= MARGIN:
                for f in feats:
                    weights[f] += gold
                    sums[f] += gold * step
    return {f: v - sums[f] / max(step, 1) for f, v in weights.items() if v or sums[f]}


def train(words: Sequence[str], seed: int = 7) -> Editor:
    """Train on the words, each clean and in some corruptions, and on numbers; words come in order of frequency."""
    rng = random.Random(seed)
    data: list[tuple[str, list[str]]] = []
    each = max(CORRUPTIONS, -(-LEAST_EXAMPLES // max(len(words), 1)))
    for w in words[:TRAIN_WORDS]:
        data.append((w, list(w)))
        data += [corrupted(w, rng) for _ in range(each)]
    for _ in range(TRAIN_NUMBERS if words else 0):
        n = number(rng)
        data += [(n, list(n)), misread_number(n, rng), misread_number(n, rng)]
    offers: dict[str, set[str]] = defaultdict(set)
    for s, ops in data:
        for c, op in zip(s, ops):
            offers[c] |= {op, c}
    plain = {c: tuple(sorted(x)) for c, x in offers.items()}
    # features as numbers, worked out once for each place that has a choice
    number_of: dict[str, int] = {}
    weights: list[dict[str, float]] = []

    def seen(f: str) -> int:
        n = number_of.setdefault(f, len(weights))
        if n == len(weights):
            weights.append({})
        return n

    places = []
    for s, ops in data:
        for i, gold in enumerate(ops):
            if len(plain[s[i]]) > 1:
                feats = [seen(f) for f in features(s, i)]
                own = [weights[f] for f in feats]
                places.append((feats, own[:WITH_CHARACTER], own[WITH_CHARACTER:], plain[s[i]], gold))
    sums: list[dict[str, float]] = [{} for _ in weights]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(places)
        for feats, own, others, offered, gold in places:
            step += 1
            total = dict.fromkeys(offered, 0.0)
            for w in own:
                for op, v in w.items():
                    total[op] += v
            for w in others:
                for op, v in w.items():
                    if op in total:
                        total[op] += v
            guess = max(offered, key=total.__getitem__)  # the first of ties, offered is sorted
            if guess != gold:
                for f in feats:
                    w, t = weights[f], sums[f]
                    w[gold] = w.get(gold, 0.0) + 1
                    w[guess] = w.get(guess, 0.0) - 1
                    t[gold] = t.get(gold, 0.0) + step
                    t[guess] = t.get(guess, 0.0) - step
    mean = {}
    for f, n in number_of.items():
        # weights far below what decides anything are left out: they are most of the model's size
        w = {op: m for op, v in weights[n].items() if abs(m := v - sums[n][op] / max(step, 1)) >= LEAST_WEIGHT}
        if w:
            mean[f] = w
    return Editor(mean, plain)


def pairs_of(compounds: Iterable[tuple[str, int]]) -> dict[str, int]:
    """Neighbouring parts of compounds of more than two parts, and how often the documents have them at most."""
    out: dict[str, int] = {}
    for w, n in compounds:
        parts = w.split("-")
        for a, b in zip(parts, parts[1:]):
            k = f"{a}-{b}"
            out[k] = max(out.get(k, 0), n)
    return out


class Lexicon:
    """Known words (capitals: as written) with the editor and the letter triples of all words seen.

    words and capitals may be a part of all known ones. Then words asked for in vain are remembered in `asked`, and those
    of a line that are known after all are given with the line (`more`: word -> count, `more_capitals`).
    """

    def __init__(self, words: dict[str, int], capitals: Iterable[str], triples: Iterable[str], editor: Editor):
        self.base, self.capitals, self.triples, self.editor = words, frozenset(capitals), frozenset(triples), editor
        self.top = max(words.values(), default=0)
        self.pairs = pairs_of((w, n) for w, n in words.items() if "-" in w)
        self.more: dict[str, int] = {}
        self.asked: set[str] | None = None
        self.memory: dict[str, str | None] = {}
        self.mended: dict[str, str | None] = {}
        self.plain: set[str] = set()
        self.parts: dict[str, tuple[str, str, str, str, int]] = {}

    def use(self, more: dict[str, int], asked: set[str] | None = None) -> None:
        """Take these words as known too, and note in asked what isn't; what was remembered may no longer hold."""
        if more or self.more or asked is not None:
            self.memory, self.mended, self.plain, self.parts = {}, {}, set(), {}
        self.more, self.asked = more, asked

    def count(self, w: str) -> int:
        """How often the documents have the word; 0 if it isn't known."""
        n = self.base.get(w) or self.more.get(w, 0)
        if not n and self.asked is not None:
            self.asked.add(w)
        return n

    def known(self, w: str) -> bool:
        return self.count(w) > 0

    def capital(self, w: str) -> bool:
        if w in self.capitals:
            return True
        return w == w.upper() and self.count(w) > 0

    def compound(self, a: str, b: str) -> int:
        """How often the documents have a-b, alone or within a longer compound."""
        return max(self.count(f"{a}-{b}"), self.pairs.get(f"{a}-{b}", 0), self.more.get(f"{a}-{b}", 0))

    def odd(self, w: str) -> int:
        """How many letter triples of the word no word of the corpus has."""
        p = f"^{w}$"
        return sum(p[i : i + 3] not in self.triples for i in range(len(p) - 2))

    def repair(self, s: str) -> str | None:
        """The known word that the editor reads in s (lower case, perhaps with a blank), if s isn't one itself."""
        if s in self.memory:
            return self.memory[s]
        if len(self.memory) > 50_000:
            self.memory.clear()
        out = None
        if not self.known(s):
            out = next((r for r in self.editor.readings(s) if r != s and self.known(r)), None)
        self.memory[s] = out
        return out
