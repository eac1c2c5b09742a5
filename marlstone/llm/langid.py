"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its subwords: the 2- to 4-grams of letters, word edges included, hashed to a fixed table.
Embeddings and softmax are trained together by stochastic gradient descent in numpy on a bounded sample of whole labelled texts. A step is
a share of the inverse of the loss's curvature at the text, so no step overshoots and training can't diverge; numbers that
aren't finite are an error all the same. A temperature fitted on texts held back from training calibrates the probabilities, and the least
probability that keeps the error of accepted predictions low is the rejection threshold. As averaging and softmax weights are linear, a prediction sums rows of one
buckets-by-languages table over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold_of, read, ship, text_parts, tidied

BUCKET_BITS, DIM = 16, 16
#: The training sample: at most so many labelled texts, all of them whole, with so many characters together (one text at least).
SAMPLE_DOCS, SAMPLE_CHARS = 4_000, 20_000_000
#: Of the texts of a language, one in HELD_PART is held back to calibrate on.
EPOCHS, RATE, HELD_PART, KEPT_ERROR = 4, 0.5, 8, 0.01
UNKNOWN = "und"
#: Texts are scored in parts of at most so many bytes.
CHUNK = 1_000_000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, a zero before and behind each, 0 for what isn't a letter; and each text's number of them,
    the zeros included. Four more zeros end the whole."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    gap = np.zeros(1, np.uint32)
    flat = np.concatenate([*(x for p in parts for x in (gap, p, gap)), np.zeros(4, np.uint32)])
    return np.where(letters()[flat], flat, 0).astype(np.uint32), np.array([len(p) + 2 for p in parts], np.int64)


def buckets(flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 2, 3, 4: the bucket of each n-gram and whether it counts: edges may stand at its ends, letters alone within."""
    mul = np.uint32(2654435761)
    h, within = flat * np.uint32(0x9E3779B1), flat > 0
    inner = np.ones(len(flat), bool)
    for n in (2, 3, 4):
        last = flat[n - 1 :]
        if not len(last):
            return
        h = (h[: len(last)] ^ (h[: len(last)] >> np.uint32(15))) * mul + last * np.uint32(0x85EBCA6B)
        inner = inner[: len(last)] & (within[n - 2 :][: len(last)] if n > 2 else True)
        ok = inner & ((within[: len(last)] & within[1:][: len(last)]) | (within[: len(last)] & (last == 0)) | ((flat[: len(last)] == 0) & (last > 0))) if n == 2 else inner
        yield ((h * mul) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), ok


def sums(table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the sum of the table's rows over its subwords, and their number."""
    flat, sizes = code_points(texts)
    starts = np.cumsum(sizes) - sizes
    total, number = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for b, ok in buckets(flat):
        rows = table[b]
        rows[~ok] = 0
        total += np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
        number += np.add.reduceat(ok.astype(np.int64), starts)
    return total, number


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's subwords and the share of the subwords in each."""
    flat, _ = code_points([text])
    n = sum((np.bincount(b[ok], minlength=1 << BUCKET_BITS) for b, ok in buckets(flat)), np.zeros(1 << BUCKET_BITS, np.int64))
    own = np.flatnonzero(n)
    return own.astype(np.uint16), (n[own] / max(1, n.sum())).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, heat: float, least: float):
        self.langs, self.table, self.bias, self.heat, self.least = langs, table, bias, heat, least

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        total, number = sums(self.table, texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax((total / np.maximum(number, 1)[:, None] + self.bias) * self.heat)
        best, some = p.argmax(axis=1), [any(c.isalpha() for c in t) if not n else True for t, n in zip(texts, number, strict=True)]
        return [self.langs[i] if s else UNKNOWN for i, s in zip(best, some, strict=True)], np.where(some, p.max(axis=1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 1) -> Model:
    """rows: (text, language). Equal rows count once; with no rows the model knows no language."""
    rng = np.random.default_rng(seed)
    rows = sorted(set(rows))
    langs = sorted({y for _, y in rows})
    if not langs:
        return Model([], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    own, held, seen = [], [], dict.fromkeys(langs, 0)
    for t, y in rows:
        grams = grams_of(t)
        if len(grams[0]):
            seen[y] += 1
            (held if seen[y] % HELD_PART == 0 else own).append((*grams, langs.index(y)))
    E = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
    W, c = rng.normal(0, 1, (DIM, len(langs))), np.zeros(len(langs))
    steps, step = max(1, EPOCHS * len(own)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(own)):
            g, share, y = own[i]
            x = share @ E[g]
            d = softmax((x @ W + c)[None])[0]
            d[y] -= 1
            rate = RATE * (1 - step / steps)
            back = W @ d
            # The curvature along the embeddings is at most |share|^2 |W|^2, along the softmax |x|^2 + 1.
            E[g] -= np.outer(share * (rate / (float(share @ share) * max(1.0, float((W * W).sum())))), back)
            pace = rate / (float(x @ x) + 1)
            W -= pace * np.outer(x, d)
            c -= pace * d
            step += 1
    table = (E @ W).astype(np.float32)
    if not (np.isfinite(table).all() and np.isfinite(c).all()):
        raise ArithmeticError("training didn't end in finite numbers")
    heat, least = calibrated(np.array([share @ table[g] + c for g, share, _ in held]).reshape(len(held), len(langs)), np.array([y for *_, y in held], int))
    return Model(langs, table, c, heat, least)


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The factor of the scores that makes held-back texts likeliest, their languages taken as certain to (n + 1) / (n + 2), and the least probability at which at most KEPT_ERROR of those that
    reach it are wrong (1 if there is none). With nothing held back, 1 and 0."""
    if not len(y):
        return 1.0, 0.0
    target = np.full(z.shape, 1 / (len(y) + 2) / max(1, z.shape[1] - 1))
    target[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)
    loss = lambda heat: -(target * np.log(np.maximum(softmax(z * heat), 1e-300))).sum(axis=1).mean()
    heat = min((2.0**h for h in np.arange(-3, 7.1, 0.5)), key=loss)
    p = softmax(z * heat)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    able = [t for t in np.sort(top) if 1 - right[top >= t].mean() <= KEPT_ERROR]
    return float(heat), float(able[0]) if able else 1.0


def drawn(labelled: DataFrame) -> list[tuple[str, str]]:
    """The sample: distinct rows with the least hashes, so reruns take the same and their order has nothing to do with the data. Hashes and
    lengths are gathered first, so no other texts are moved."""
    known = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text", "lang").alias("_h"))
    least = known.groupBy("_h").agg(F.max(F.length("text")).alias("n")).orderBy("_h").limit(SAMPLE_DOCS).collect()
    if not least:
        return []
    fit = int(np.searchsorted(np.cumsum([r.n for r in least]), SAMPLE_CHARS, side="right"))
    last = least[max(1, fit) - 1]["_h"]
    return [(r.text, r.lang) for r in known.where(F.col("_h") <= last).select("text", "lang").distinct().collect()]


def language(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, accepted.

    labelled has text and lang; texts and languages that are null aren't learned from, equal rows count once, and training
    that doesn't end in finite numbers is an error. lang_pred is the likeliest learned language,
    und with score 0 for texts that are null or have no letter, and for all if nothing could be learned; accepted is whether the
    score reaches the calibrated rejection threshold. Texts count whole, however long; of languages that are equally likely the first
    by name is taken. Rows that repeat a doc_id are judged each by its text. Empty tables give empty results; other columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(drawn(labelled)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_parts(batch, 1, CHUNK):
                langs, scores = model.value.predict([t or "" for t in texts])
                kept = (scores >= model.value.least) & np.array([w != UNKNOWN for w in langs], bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(kept)], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, accepted boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 3) == 1
    found = language(docs, docs.where(~held))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
