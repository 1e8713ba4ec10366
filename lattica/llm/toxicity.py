"""Toxicity scores by noisy-channel deobfuscation.

A character trigram model counts the letters of all documents, and a second one those of the telling words that labels
mark. A suspicious token (digits or signs among letters, letters repeated, letters set apart by spaces or dots) is a
lattice: each character may stand for letters it resembles, be noise, or repeat the letter before it. Exact Viterbi
decoding under the mixed character model restores the likeliest letters; a long token is decoded in parts. Restored words,
their prefixes, and prefixes that several words of a text have, are then scored by naive Bayes weights learnt from labels.
The other words of a text, clean evidence among them, move its score by at most one unit of log odds, so they rank texts
but don't decide alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import CHUNK_BYTES, hash_sample, lower_ascii, string_buffers
from lattica.plans.lineage import cut

#: Labelled rows that the classifier is fitted on, at most; they are chosen by a hash of their ids.
LABELLED = 60_000
#: A telling word occurs in so many toxic training texts at least, and among as many words as there are to test one that
#: isn't telling would do as well with such a probability ...
LEAST_TEXTS, CHANCE = 3, 0.01
#: ... and such a share of the texts that have it are toxic.
PRECISION = 0.95
#: It stands behind so many different words, as a share of its texts (of 20 of them at most); words of copies don't.
PLACES = 0.5
#: Prefixes that stand for inflected words, in letters, and numbers of words of a text that share one.
PREFIXES, SHARED = (4, 5, 6), (2, 3, 4)
THRESHOLD = 0.7

# The letters that a digit or sign resembles.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "2": "z"}

_OTHER, _LETTERS = 27, 28  # 0 is a word's edge, 1 to 26 are a to z, 27 is any other letter
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = _OTHER
_EDGE = "".join(sorted(set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’…")))
_APART = re.compile(r"(?<![^\s])[^\W_](?:[ .\-_*]{1,2}[^\W_]){2,}(?![^\s.,;:!?])")
_LONG_RUN = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_EDGE_LETTER = re.compile(r"[$@](?![$@])\w|.*\w[$@]$")
#: Signs of a token that are decoded together; a longer one is split at signs, and what has none into overlapping parts.
_TOGETHER = 40
#: Letters that a word has at least to be found inside what a suspicious token was restored to, however long that is.
_INSIDE = 6
_WILD = "*#%"
_SPLIT = re.compile(r"[^\w@$!|+*#%€£¡]+|_+")
_RUN = re.compile(r"(.)\1{2,}")


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else _OTHER if c.isalpha() else 0


def trigram_log_probabilities(counts: np.ndarray) -> np.ndarray:
    """counts[a, b, c] smoothed by bigrams and letters, as log probabilities of c after a and b."""
    one = counts.sum((0, 1)) + 1.0
    two = counts.sum(0) + 2.0 * (one / one.sum())
    two = two / two.sum(1, keepdims=True)
    three = counts + 4.0 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def word_trigrams(words: list[str]) -> np.ndarray:
    counts = np.zeros((_LETTERS,) * 3)
    for w in words:
        a = b = 0
        for c in [*map(letter, w), 0]:
            counts[a, b, c] += 1
            a, b = b, c
    return counts


def options(c: str) -> list[tuple[str, float]]:
    """What a character of a token may stand for: letters, or '' for noise, each with its log cost."""
    if c in LOOKALIKES:
        return [(x, -0.7) for x in LOOKALIKES[c]] + [("", -5.0)]
    if c.isalpha():
        return [(c, 0.0)]
    if c in _WILD:
        return [(x, -3.5) for x in "abcdefghijklmnopqrstuvwxyz"] + [("", -1.5)]
    return [("", -0.5)]


def restore(token: str, model: list, table: np.ndarray | None = None) -> str:
    """The likeliest letters behind a token, by Viterbi decoding of its lattice under the character model; table: the model as an array."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before = ""
    for c in token:
        choice = [(x, letter(x) if x else -1, cost) for x, cost in options(c)]
        if c == before and c.isalnum():
            choice.append(("", -1, -0.4))
        then: dict[tuple[int, int], tuple[float, str]] = {}
        if c in _WILD and len(best) > _LETTERS:
            table = np.array(model) if table is None else table
            best_of = _any_letter(best, table)
            choice = [x for x in choice if x[1] < 0]
            then = {key: (s - 3.5, best[a, key[0]][1] + chr(96 + key[1])) for key, (s, a) in best_of.items()}
        for (a, b), (score, out) in best.items():
            row = model[a][b]
            for x, k, cost in choice:
                key, s = ((a, b), score + cost) if k < 0 else ((b, k), score + cost + row[k])
                if key not in then or s > then[key][0]:
                    then[key] = (s, out + x)
        best, before = then, c
    return max(((s + model[a][b][0], out) for (a, b), (s, out) in best.items()))[1]


def _any_letter(best: dict[tuple[int, int], tuple[float, str]], table: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
    """For each state (b, c) with c a letter from a to z the best score of a step to it, and the state (a, b) it comes from, by a."""
    scores = np.full((_LETTERS, _LETTERS), -np.inf)
    for (a, b), (s, _) in best.items():
        scores[a, b] = s
    steps = scores[:, :, None] + table[:, :, 1:27]
    least, of = steps.max(0), steps.argmax(0)
    return {(int(b), int(c) + 1): (float(least[b, c]), int(of[b, c])) for b, c in np.argwhere(least > -np.inf)}


def parts(token: str) -> list[str]:
    """What of a token is decoded at once: itself, or of a long one, without long repeats, its parts between signs and then overlapping ones."""
    if len(token) <= _TOGETHER:
        return [token]
    short = _RUN.sub(r"\1\1", token)
    out = []
    for part in [short] if len(short) <= _TOGETHER else _SPLIT.split(short):
        out += [part[i : i + _TOGETHER] for i in range(0, max(1, len(part) - _TOGETHER // 2), _TOGETHER // 2)] if len(part) > _TOGETHER else [part]
    return out


def core(token: str) -> str:
    """A token without signs at its edges."""
    return token.strip(_EDGE)


def prefixes(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if len(word) > n]


def features(word: str) -> list[str]:
    return ["=" + word, *prefixes(word)]


@dataclass
class Model:
    """weights: of telling features, with those of prefixes that several words share; stems: the latter's prefixes; others: of
    other words; prior: log odds of a toxic text; characters: log probabilities of letters."""

    weights: dict[str, float]
    prior: float
    characters: list
    others: dict[str, float] = field(default_factory=dict)
    stems: frozenset[str] = frozenset()
    cache: dict[str, tuple[float, str, list[str]]] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        # a feature of a word begins with the word's first letters, so most words need no look at all
        self.heads = {f.lstrip("=")[: PREFIXES[0]] for f in self.weights}
        # decoding may take a doubled letter for noise
        self.within = [(_DOUBLE.sub(r"\1", f[1:]), w) for f, w in self.weights.items() if f[0] == "=" and len(f) > _INSIDE]

    def best(self, word: str) -> float:
        if word[: PREFIXES[0]] not in self.heads:
            return 0.0
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def stems_of(self, word: str) -> list[str]:
        return [x for x in prefixes(word) if x in self.stems] if word[: PREFIXES[0]] in self.heads else []

    def inside(self, letters: str) -> float:
        """The largest weight of a word in the letters that a token was restored to; doubled letters count as one."""
        single = _DOUBLE.sub(r"\1", letters)
        return max((w for word, w in self.within if word in single), default=0.0)

    def weigh(self, token: str) -> tuple[float, str, list[str]]:
        """The weight of a token's telling feature, 0 if it has none, its word, and the word's stems; suspicious tokens are restored first."""
        word = core(token)
        found, stems = self.best(word), self.stems_of(word)
        if _DOUBLE.search(word):
            found = max(found, self.best(_DOUBLE.sub(r"\1", word)))
        if word.isalpha() and len(word) <= _TOGETHER and not _LONG_RUN.search(word) and not ((token[0] in "$@" or token[-1] in "$@") and _EDGE_LETTER.match(token)):
            return found, word, stems
        if self.table is None:
            self.table = np.array(self.characters)
        for form in {word, token.strip(".,;:?\"'()[]")}:
            cut_up = parts(form)
            for part in cut_up if len(cut_up) == 1 else {x for part in cut_up for x in (part, core(part))}:
                if len(cut_up) > 1:
                    found = max(found, self.best(part), self.best(_DOUBLE.sub(r"\1", part)))
                if 2 < len(part) and any(map(str.isalpha, part)) and (not part.isalpha() or _LONG_RUN.search(part) or len(form) > _TOGETHER):
                    letters = restore(part, self.characters, self.table)
                    found = max(found, self.best(letters), self.inside(letters))
                    if some := self.stems_of(letters):
                        word, stems = letters, some
        return found, word, stems

    def tell(self, text: str) -> tuple[dict[str, float], float]:
        """Telling tokens of a text and their weights, and the mean weight of its other known words, from -1 to 1."""
        low = text.lower()
        tokens = set(low.split())
        for m in _APART.finditer(low):
            tokens.add("".join(c for c in m[0] if c.isalnum()))
        found, cache = {}, self.cache
        if len(cache) > 100_000:
            cache.clear()
        known = [self.others[t] for t in tokens if t in self.others]
        words: dict[str, set[str]] = {}
        for t in tokens:
            got = cache.get(t)
            if got is None:
                got = cache[t] = self.weigh(t)
            if got[0] > 0:
                found[t] = got[0]
            for stem in got[2]:
                words.setdefault(stem, set()).add(got[1])
        for stem, some in words.items():
            w = max((self.weights.get(f"{stem}*{n}", 0.0) for n in SHARED if n <= len(some)), default=0.0)
            if w > 0:
                key = stem[: PREFIXES[0]] + "*"  # a stem and a longer one are one piece of evidence
                found[key] = max(found.get(key, 0.0), w)
        return found, max(-1.0, min(1.0, math.fsum(known) / (len(known) + 1)))

    def score(self, text: str | None) -> float:
        """The probability that a text is toxic; a null or empty text has the prior one."""
        found, other = self.tell(text or "")
        return 1 / (1 + math.exp(-min(40.0, self.prior + math.fsum(found.values()) + other)))


def by_chance(toxic: int, clean: int, share: float) -> float:
    """The probability that of toxic + clean texts so many or more are toxic, if each is with probability share; an upper bound."""
    n = toxic + clean
    if not 0 < share < 1:
        return 1.0
    term = lambda k: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (n - k) * math.log(share) + k * math.log(1 - share))
    return sum(term(k) for k in range(clean + 1))


def fold(key, of: int = 3):
    """crc32(key as text) mod `of`; a null key is the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % of


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 1, labelled: int = LABELLED) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, toxic), without the labels whose fold is held_out.

    The characters of all docs are counted. A label that is null is left out, as is one without a row; of several labels
    of an id the highest counts, for all its rows, and each repeated row is a text. Without any label, as with empty tables,
    every text has the score 0.5 or less.
    """
    told_of = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told_of = cut(told_of)
    known = {r[0]: r[1] for r in hash_sample(told_of, F.xxhash64("doc_id"), labelled, told_of.count()).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def told(batch: pa.RecordBatch, kind: int) -> Iterator[dict[str, int]]:
        """The features of each text of a batch whose label is of a kind, with a bit for each word that stood before one."""
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key in shared.value and (shared.value[key] == 1) == (kind == 1):
                found: dict[str, int] = {}
                before = ""
                for t in (batch.column(1)[i].as_py() or "").lower().split():
                    w = core(t)
                    if w.isalpha():
                        bit = 1 << zlib.crc32(before.encode()) % 63
                        for f in features(w):
                            found[f] = found.get(f, 0) | bit
                    before = t
                many: dict[str, int] = {}
                for w in [f[1:] for f in found if f[0] == "="]:
                    for x in prefixes(w):
                        many[x] = many.get(x, 0) + 1
                yield found | {f"{x}*{n}": found[x] for x, k in many.items() for n in SHARED if n <= k}

    def rows(counts: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
        names, values = [*counts], [*counts.values()]
        for at in range(0, len(names), 50_000):
            n, m = ([v[k] for v in values[at : at + 50_000]] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 50_000], pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["f", "n", "m"])

    def gather(seen: dict[str, list[int]], found: dict[str, int]) -> None:
        for f, bits in found.items():
            if (have := seen.get(f)) is None:
                seen[f] = [1, bits]
            else:
                have[0] += 1
                have[1] |= bits

    def toxic_and_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen = np.zeros(_LETTERS**3, np.int64), {}
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
                kinds = np.concatenate(([0, 0], _CLASS[lower_ascii(data[offsets[at] : offsets[to]])], [0]))
                letters += np.bincount((kinds[:-2] * _LETTERS + kinds[1:-1]) * _LETTERS + kinds[2:], minlength=_LETTERS**3)
                at = to
            for found in told(batch, 1):
                gather(seen, found | {"##": 0})
        yield from rows(seen | {f"#{k}": [int(letters[k]), 0] for k in np.flatnonzero(letters)})

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for found in told(batch, 0):
                gather(seen, {f: 0 for f in found.keys() & hopeful.value} | {"##": 0})
        yield from rows(seen)

    def gathered(count) -> DataFrame:
        return docs.select("doc_id", "text").mapInArrow(count, "f string, n long, m long").groupBy("f").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("m")).alias("places"))

    toxic, places = {}, {}
    for r in gathered(toxic_and_letters).where(F.col("f").startswith("#") | (F.col("n") >= LEAST_TEXTS)).collect():
        toxic[r.f], places[r.f] = r.n, r.places
    letters = np.zeros(_LETTERS**3)
    for f in [f for f in toxic if f[0] == "#" and f != "##"]:
        letters[int(f[1:])] = toxic.pop(f)
    hopeful = docs.sparkSession.sparkContext.broadcast(set(toxic))
    clean_counts = {r.f: r.n for r in gathered(clean).collect()}
    total = (clean_counts.pop("##", 0), toxic.pop("##", 0))
    share, many = total[1] / max(1, sum(total)), max(1, len(toxic))
    counted = {f: (clean_counts.get(f, 0), t) for f, t in toxic.items()}
    telling = {f: (c, t) for f, (c, t) in counted.items() if t >= PRECISION * (t + c + 0.2) and places[f] >= PLACES * min(t, 20) and by_chance(t, c, share) * many <= CHANCE}
    weigh = lambda n, t: math.log((t + 0.5) / (total[1] + 1)) - math.log((n + 0.5) / (total[0] + 1))
    weights = {f: weigh(*n) for f, n in telling.items()}
    others = {f[1:]: weigh(*n) for f, n in counted.items() if f[0] == "=" and f not in telling}
    letters = letters.reshape((_LETTERS,) * 3)
    lexicon = [f[1:] for f in weights if f.startswith("=")]
    mixed = np.logaddexp(trigram_log_probabilities(letters), trigram_log_probabilities(50.0 * word_trigrams(lexicon))) - math.log(2)
    return Model(weights, math.log((total[1] + 0.5) / (total[0] + 1)), mixed.tolist(), others, frozenset(f.split("*")[0] for f in weights if "*" in f))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs; only doc_id, which is passed on, and text are read.

    Equal texts, null ones as empty ones, have equal scores; texts of any length are read whole. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([shared.value.score(x.as_py()) for x in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns, whatever their names; see `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(x.as_py()) < threshold for x in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
