"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: compatibility forms, homoglyphs and digit substitutions become the letters they stand for. The lexicon is
learned from labelled texts: words, and word beginnings, that toxic texts have more often than chance allows, weighted by the
log-odds. Exception phrases are words with a neighbour that occur in texts that aren't toxic more often than chance allows for the word; a match inside one counts nothing. A text's score is
the logistic of the matched weight and of that weight by length, calibrated on the same sample.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Stash, fold_of, give_back, read, ship, text_parts

#: The training sample: at most so many labelled texts of either label, all of them whole, with so many characters together (one text at least).
SAMPLE_EACH, SAMPLE_CHARS = 2_000, 8_000_000
#: The chance that any entry, or any exception, comes from nothing, and the least log-odds of an entry; the lengths of beginnings, of whose
#: occurrences no word makes up more than ONE_WORD; words in more clean texts than a share of COMMON are no entries.
CHANCE, LEAST_ODDS, BEGINNINGS, ONE_WORD, COMMON = 0.01, 2.0, (4, 5, 6, 7, 8), 0.8, 0.25
#: Texts are scored in parts of at most so many bytes.
PART = 1_000_000
THRESHOLD = 0.7

# Characters that look like Latin letters (Cyrillic, Greek, others), and digits and signs put for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ℓ": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

WORDS = re.compile(r"[^\W_]+(?:[@$!|](?=[^\W_])[^\W_]*)*|[@$!|][^\W_]+")
SIGN = re.compile(r"[0-9@$!|]")
LETTER = re.compile(r"[a-z]")
ODD = re.compile(r"[^\x00-\x7f\xc0-\xff]")
#: Never visible: soft hyphen, zero-width space and joiners, byte-order mark.
HIDDEN = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_glyphs, _digits = str.maketrans(HOMOGLYPHS), str.maketrans(DIGITS)


def fold(text: str) -> str:
    """Lower case, homoglyphs replaced; digits and signs replaced in words that also have a letter. Letters with accents stay."""
    text = text.lower()
    if ODD.search(text):
        text = unicodedata.normalize("NFKC", text).translate(HIDDEN).translate(_glyphs)
    out, last = [], 0
    for m in SIGN.finditer(text):
        at = m.start()
        if at < last:
            continue
        a, b = at, at + 1
        while a > last and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        word = text[a:b]
        if LETTER.search(word):
            tail = len(word) - len(word.rstrip("!|"))  # at a word's end these are marks
            word = word[: len(word) - tail].translate(_digits) + word[len(word) - tail :]
        out += [text[last:a], word]
        last = b
    return "".join([*out, text[last:]]) if out else text


def words(folded: str) -> list[str]:
    return WORDS.findall(folded)


def word_before(folded: str, at: int) -> str:
    """The last word that ends before that place, however far; empty if there is none."""
    width = 32
    while True:
        start, last = max(0, at - width), None
        for last in WORDS.finditer(folded, start, at):
            pass
        if start == 0 or last is not None and last.start() > start:
            return last[0] if last else ""
        width *= 4


class Lexicon:
    """weights: entry -> weight; an entry that ends in * is a beginning. exceptions: two words with a space."""

    def __init__(self, weights: dict[str, float], exceptions: set[str]):
        self.weights, self.exceptions, self.line, self._machine = weights, exceptions, (-4.0, 1.0, 0.0), None

    def __getstate__(self):
        return (self.weights, self.exceptions, self.line)

    def __setstate__(self, state):
        self.weights, self.exceptions, self.line = state
        self._machine = None

    def machine(self):
        if self._machine is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                made.add_word(entry.rstrip("*"), (len(entry.rstrip("*")), entry.endswith("*"), w))
            if len(made):
                made.make_automaton()
            self._machine = made
        return self._machine

    def matches(self, folded: str) -> list[tuple[str, float]]:
        """(word matched, weight): the heaviest entry for each word, if no exception phrase holds the word."""
        made = self.machine()
        if not len(made):
            return []
        best: dict[int, float] = {}
        for end, (n, beginning, w) in made.iter(folded):
            at = end - n + 1
            if (at and (folded[at - 1].isalnum())) or (not beginning and end + 1 < len(folded) and folded[end + 1].isalnum()):
                continue
            best[at] = max(best.get(at, 0.0), w)
        found = []
        for at, w in best.items():
            to = at
            while to < len(folded) and folded[to].isalnum():
                to += 1
            word = folded[at:to]
            if self.exceptions:
                after = WORDS.search(folded, to)
                if f"{word_before(folded, at)} {word}" in self.exceptions or after and f"{word} {after[0]}" in self.exceptions:
                    continue
            found.append((word, w))
        return found

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        weight = sum(w for _, w in self.matches(folded))
        return math.log1p(weight), math.log1p(100 * weight / (20 + folded.count(" ")))

    def score(self, text: str | None) -> float:
        a, b = self.features(text or "")
        z = self.line[0] + self.line[1] * a + self.line[2] * b
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def unlikely(k: int, n: int, share: float) -> float:
    """Chernoff's bound on the logarithm of the chance that at least k of n cases fall where a share of all cases is; 0 if k is no more than expected."""
    q = k / n if n else 0.0
    if q <= share:
        return 0.0
    return -n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))


def allowed(totals: Iterable[int], share: float) -> tuple[int, float]:
    """The least number of texts at which an entry can be told from chance at all, and the bound on the logarithm of its chance. Entries
    below that number can't pass, so they aren't tried and don't count as tries."""
    sizes = Counter(totals)
    tries = sum(sizes.values())
    for k in range(1, max(sizes, default=0) + 1):
        if tries and k * math.log(share) <= math.log(CHANCE / tries):
            return k, math.log(CHANCE / tries)
        tries -= sizes[k]
    return max(sizes, default=0) + 1, -math.inf


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


def contexts(texts: list[list[str]], entries: set[str]) -> dict[str, int]:
    """For each entry the number of different neighbours it has: copies of a text, or of a passage, give the same ones."""
    found: dict[str, set[int]] = {e: set() for e in entries}
    for own in texts:
        for k, w in enumerate(own):
            for e in (w, *beginnings(w)):
                if e in found:
                    found[e].add(hash((own[k - 1] if k else "", w, own[k + 1] if k + 1 < len(own) else "")))
    return {e: len(x) for e, x in found.items()}


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """rows: (text, 0 or 1)."""
    rows = list(dict.fromkeys(rows))  # copies of a text are one case
    texts = [([*map(sys.intern, words(fold(t)))], y) for t, y in rows]  # one copy of each word
    n1 = sum(y for _, y in texts)
    n0 = len(texts) - n1
    if not n1 or not n0:
        made = Lexicon({}, set())
        made.line = (6.0 if n1 else -6.0, 0.0, 0.0)
        return made
    share, odds = n1 / (n0 + n1), lambda k, c: math.log((k + 0.1) / (n1 + 1)) - math.log((c + 0.1) / (n0 + 1))
    # Clean texts are counted for what toxic ones have often enough to tell, which is little beside all words.
    toxic = Counter(w for own, y in texts if y for w in set(own))
    least, bound = allowed(toxic.values(), share)
    toxic = Counter({w: k for w, k in toxic.items() if k >= least})
    clean = Counter(w for own, y in texts if not y for w in set(own) if w in toxic)
    able = {w for w, k in toxic.items() if k * n0 > clean[w] * n1 and clean[w] <= COMMON * n0}
    exceptions = exceptions_of(texts, able, toxic, clean)
    # Texts that have the word, or a word with the beginning, outside exception phrases.
    kinds = lambda own: {e for k, w in enumerate(own) if not excepted(own, k, exceptions) for e in (w, *beginnings(w))}
    toxic, one_word = Counter(e for own, y in texts if y for e in kinds(own)), Counter()
    for w, k in toxic.items():
        if not w.endswith("*"):
            for b in beginnings(w):
                one_word[b] = max(one_word[b], k)
    least, bound = allowed(toxic.values(), share)
    toxic = Counter({e: k for e, k in toxic.items() if k >= least and one_word[e] <= ONE_WORD * k})
    clean = Counter(e for own, y in texts if not y for e in kinds(own) if e in toxic)
    able = {e for e, k in toxic.items() if odds(k, clean[e]) >= LEAST_ODDS and unlikely(k, k + clean[e], share) <= bound}
    varied = contexts([own for own, y in texts if y], able)
    holds = {e: set() for e in able}
    for i, (own, y) in enumerate(texts):
        for e in kinds(own) & able if y else ():
            holds[e].add(i)
    chance = lambda e, k: unlikely(min(k, varied[e]), min(k, varied[e]) + clean[e], share)
    # The least likely entry first, which takes the texts that it explains away from those that follow; numbers of texts only fall, so an
    # entry whose chance is still the least when it is counted anew is the least of all.
    weights, explained, queue = {}, set(), [(chance(e, len(holds[e])), e) for e in able]
    heapify(queue)
    while queue:
        _, e = heappop(queue)
        now = chance(e, len(holds[e] - explained))
        if now > bound:
            continue
        if queue and (now, e) > queue[0]:
            heappush(queue, (now, e))
            continue
        weights[e] = odds(min(toxic[e], varied[e]), clean[e])
        explained |= holds[e]
    # Words that pass by themselves belong to the lexicon too, though others explain their texts.
    for w in able:
        if not w.endswith("*") and not any(b in weights for b in beginnings(w)) and chance(w, len(holds[w])) <= bound:
            weights[w] = odds(min(toxic[w], varied[w]), clean[w])
    made = Lexicon({e: weights[e] for e in sorted(weights)}, {p for p in exceptions if any(e in weights for w in p.split(" ") for e in (w, *beginnings(w)))})
    x = np.array([made.features(t) for t, _ in rows])
    made.line = logistic(x, np.array([y for _, y in rows]))
    return made


def excepted(own: list[str], k: int, exceptions: set[str]) -> bool:
    return bool(exceptions) and (k > 0 and f"{own[k - 1]} {own[k]}" in exceptions or k + 1 < len(own) and f"{own[k]} {own[k + 1]}" in exceptions)


def exceptions_of(texts: list[tuple[list[str], int]], able: set[str], toxic: Counter, clean: Counter) -> set[str]:
    """Phrases of an able word and a neighbour that clean texts have more often than chance allows, going by the word alone."""
    good, bad = Counter(), Counter()
    for own, y in texts:
        (bad if y else good).update(_phrases(own, able, clean))
    share = {w: clean[w] / (clean[w] + toxic[w]) for w in able}
    tries = len(good)
    return {p for (w, p), k in good.items() if unlikely(k, k + bad[w, p], share[w]) <= math.log(CHANCE / tries)}


def _phrases(own: list[str], able: set[str], clean: Counter) -> set[tuple[str, str]]:
    """(able word, phrase) for each able word that clean texts have, with the word before and the word behind."""
    found = set()
    for k, w in enumerate(own):
        if w in able and clean[w]:
            if k:
                found.add((w, f"{own[k - 1]} {w}"))
            if k + 1 < len(own):
                found.add((w, f"{w} {own[k + 1]}"))
    return found


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-regularised logistic regression by Newton's method, slopes not negative."""
    X, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    live = [True] * len(beta)
    for _ in range(3):
        beta[:] = 0
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
            g = X.T @ (y - p) - 0.05 * beta * [0, *[1] * x.shape[1]]
            H = (X * (p * (1 - p))[:, None]).T @ X + 0.05 * np.eye(len(beta))
            move = np.linalg.solve(H, g)
            move[~np.array(live)] = 0
            beta += np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-8:
                break
        if (beta[1:] >= 0).all():
            break
        live = [True, *(beta[1:] >= 0)]
        X = X * live
    return tuple(float(b) if k else 0.0 for b, k in zip(beta, live, strict=True))


def fit_lexicon(texts: DataFrame, labels: DataFrame) -> Lexicon:
    """texts: doc_id, text; labels: doc_id, toxic, of which null ones aren't learned from.

    The sample is drawn from doc_ids alone, those with the least hashes of either label, so only the sample's texts are moved; where
    these ids repeat, the same bounds hold for their texts."""
    spark, kind = texts.sparkSession, texts.schema["doc_id"].dataType.simpleString()
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast(kind), (F.col("toxic") > 0).cast("int").alias("y")).distinct().join(texts.select("doc_id"), "doc_id", "left_semi")
    stash = Stash(spark)
    known = stash.keep(known, "known")
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    drawn = [r for y in n for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_EACH).collect()]
    stash.drop()
    ids = spark.createDataFrame([(r.doc_id, r.y) for r in drawn], f"doc_id {kind}, y int")
    found = texts.join(F.broadcast(ids), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y").withColumn("_h", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("y").orderBy("_h"))
    sizes = found.groupBy("y", "_h").agg(F.max(F.length("text")).alias("n")).withColumn("place", place).where(F.col("place") <= SAMPLE_EACH).orderBy("y", "place").collect()
    last, taken = {}, Counter()
    for r in sizes:
        if not taken[r.y] or taken[r.y] + r.n <= SAMPLE_CHARS:
            last[r.y] = r["_h"]
        taken[r.y] += r.n
    rows = []
    if last:
        fits = functools.reduce(lambda a, b: a | b, [(F.col("y") == y) & (F.col("_h") <= h) for y, h in last.items()])
        rows = [(r.text, r.y) for r in found.where(fits).select("text", "y").distinct().collect()]
    made = learn(sorted(rows))
    if len(n) == 2 and len(last) == 2:  # the sample has other shares of the labels than the rows it stands for
        sampled = {y: sum(z == y for _, z in rows) for y in n}
        shift = math.log((n[1] / n[0]) / (sampled[1] / sampled[0]))
        made.line = (made.line[0] + shift, *made.line[1:])
    return made


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs and last a score, 0 to 1: toxic_score, with underscores behind if docs has that name. Null texts count as
    empty; texts are scored whole, however long, and scores depend on the text alone, so rows that repeat score alike. labels: doc_id
    of docs, toxic; an id with both labels counts as both. With no labels, or one kind of label only, there is
    no lexicon and all scores are the same. An empty table gives an empty result. Only texts go to Python, and only scores come back."""
    spark = docs.sparkSession
    ship(spark)
    lexicon = spark.sparkContext.broadcast(fit_lexicon(docs.select("doc_id", "text"), labels))
    give_back()
    name = "toxic_score"
    while name in map(str.lower, docs.columns):
        name += "_"

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                batch = pa.RecordBatch.from_arrays([texts], ["text"])
                yield pa.array([lexicon.value.score(t) for _, part in text_parts(batch, 0, PART) for t in part], pa.float64())
        finally:
            give_back()

    return docs.select("*", scored(F.col("text")).alias(name))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = toxicity(docs, labels.where(fold_of(F.col("doc_id"), 3) != 1))
    return found.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
