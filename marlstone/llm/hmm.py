"""Language-model scoring with a hidden Markov model over words.

States emit classes of words (hashes of the word), and a class emits its words by their smoothed frequency: a word's probability in a state is its
smoothed unigram probability times a ratio that depends on state and class alone. So the parameters that Baum-Welch trains have a fixed size, their
expected counts are summed across partitions, and the vocabulary, which grows with the corpus, is counted and joined apart from
them. The score is the exact likelihood by the scaled forward recursion over the whole text: the base score plus the logarithm of
what the states add. Unknown words have ratio 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Stash, fold_of, read, ship, text_parts, tidied
from .wordhash import word_hashes

STATES, CLASS_BITS, PASSES = 8, 13, 6
#: How much the first model stays in a state, so that states become topics and languages; 0 leaves moves to chance.
STAY = 0.9
#: Training and scoring run over whole texts. Training holds forward states of about so many tokens at once; of texts beyond, it keeps
#: the states at the borders of stretches and computes each stretch again on the way back. Texts of like length, which share
#: steps, are sought among POOL tokens.
HOLD, POOL = 1 << 20, 1 << 22
#: Words that make up at least one in FREQUENT tokens are looked up from a broadcast table (so many words at most), others joined.
FREQUENT = 1 << 21
END = -0x61C8864680B583EB  # hash of the end
CLASSES = 1 << CLASS_BITS


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token of the texts, words and an end for each text, and each text's number of tokens."""
    words, n = word_hashes(texts)
    return np.insert(words.view(np.int64), np.cumsum(n), END), n + 1


def class_of(h: np.ndarray) -> np.ndarray:
    return (h & (CLASSES - 1)).astype(np.int64)


class Model:
    """start, move: of states; ratio: of state and class to the class's own frequency."""

    def __init__(self, start: np.ndarray, move: np.ndarray, ratio: np.ndarray):
        self.start, self.move, self.ratio = start, move, ratio

    def gain(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each text, log10 of its likelihood over that of the base; classes -1 are unknown words."""
        out = np.zeros(len(sizes))
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        live_until, ratio = sizes[order], np.vstack([self.ratio.T, np.ones(len(self.start))])
        alive = np.searchsorted(-live_until, -np.arange(1, (live_until[0] if len(sizes) else 0) + 1), side="right")
        state, ones = np.tile(self.start, (len(sizes), 1)), np.ones(len(self.start))
        for t, n in enumerate(alive.tolist()):
            state = state[:n]
            if t:
                state = state @ self.move
            state *= ratio[classes[starts[:n] + t]]
            scale = state @ ones
            state /= scale[:, None]
            out[:n] += np.log(scale)
        back = np.empty(len(sizes))
        back[order] = out / np.log(10)
        return back

    def counts(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts over texts: first states, moves, emissions; and the log-likelihood. seq: (texts, tokens), -1 behind the end."""
        return self.expected(seq[seq >= 0], (seq >= 0).sum(axis=1))

    def expected(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The same over texts one behind the other, of one token at least each."""
        k = len(self.start)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        # The longest texts come first; those that still run at a step are the first alive[step].
        alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(alive) - 1) // HOLD)) + 1).tolist(), len(alive)]
        stretches, ratio, ones = list(zip(cuts[:-1], cuts[1:], strict=True)), np.ascontiguousarray(self.ratio.T), np.ones(k)

        def forward(a: int, b: int, state: np.ndarray) -> tuple[list, list, list]:
            """For each step its classes, the states behind it and their scale; state: that before step a."""
            classes, alpha, scale = [], [], []
            for t in range(a, b):
                n = alive[t]
                classes.append(flat[starts[:n] + t])
                state = (state[:n] @ self.move if t else state) * ratio[classes[-1]]
                scale.append((state @ ones)[:, None])  # faster than a sum along eight numbers
                state /= scale[-1]
                alpha.append(state)
            return classes, alpha, scale

        border, like = [np.tile(self.start, (len(sizes), 1))], 0.0
        for a, b in stretches:
            held = forward(a, b, border[-1])
            border.append(held[1][-1])
            like += sum(float(np.log(x).sum()) for x in held[2])
        moves, emit, carry = np.zeros((k, k)), np.zeros((k, CLASSES)), np.ones((0, k))
        for at in range(len(stretches) - 1, -1, -1):
            a, b = stretches[at]
            classes, alpha, scale = held if at == len(stretches) - 1 else forward(a, b, border[at])
            for t in range(b - 1, a - 1, -1):
                own, n = t - a, alive[t]
                beta = carry if len(carry) == n else np.concatenate([carry, np.ones((n - len(carry), k))])  # texts that end here
                gamma = alpha[own] * beta
                if t:
                    after = ratio[classes[own]] * beta / scale[own]
                    moves += (alpha[own - 1] if own else border[at])[:n].T @ after
                    carry = after @ self.move.T
                gamma /= (gamma @ ones)[:, None]
                alpha[own] = gamma
            seen, weight = np.concatenate(classes), np.ascontiguousarray(np.concatenate(alpha).T)
            emit += np.stack([np.bincount(seen, weights=w, minlength=CLASSES) for w in weight])
        return gamma.sum(axis=0), moves * self.move, emit, like


def first_model(mass: np.ndarray, states: int = STATES, stay: float = STAY, seed: int = 11) -> Model:
    """States that differ at random, by class."""
    rng = np.random.default_rng(seed)
    emit = mass * np.exp(rng.standard_normal((states, CLASSES)))
    move = (1 - stay) * rng.dirichlet(np.ones(states), size=states) + stay * np.eye(states)
    return Model(np.full(states, 1 / states), move, ratios(emit, mass))


def ratios(emit: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Emission over the class's own mass, each state's emissions summing to the mass of known words."""
    share = emit / emit.sum(axis=1, keepdims=True) * mass.sum()
    return np.divide(share, mass, out=np.ones_like(share), where=mass > 0)


def refit(start: np.ndarray, moves: np.ndarray, emit: np.ndarray, mass: np.ndarray) -> Model:
    """New parameters; counts are smoothed towards the class's own frequency, as if each state had seen a few tokens for each class more."""
    start = (start + 1) / (start + 1).sum()
    moves = (moves + 1) / (moves + 1).sum(axis=1, keepdims=True)
    prior = mass / mass.sum() * 0.5 * (mass > 0).sum()
    return Model(start, moves, ratios(emit + prior, mass))


#: Texts are taken in parts of at most so many bytes.
PART = 2_000_000


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of tokens with counts; partial: what a worker holds is bounded."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for _, texts in text_parts(batch, 0, PART):
            held.append(np.unique(tokens_of(texts)[0], return_counts=True))
            if sum(len(h) for h, _ in held) > 2_000_000:
                yield _summed(held)
                held = []
    if held:
        yield _summed(held)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    h, where = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    c = np.bincount(where, weights=np.concatenate([c for _, c in held]), minlength=len(h)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as classes, two bytes each."""
    for batch in batches:
        for _, part in text_parts(batch, 0, PART):
            flat, sizes = tokens_of(part)
            seq = class_of(flat).astype("<u2")
            rows = [seq[e - n : e].tobytes() for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["seq"])


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Texts of about POOL tokens, the longest last."""
    rows, held = [], 0
    for batch in batches:
        for row in batch.column(0):
            rows.append(row.as_py())
            held += len(rows[-1]) // 2
            if held >= POOL:
                yield sorted(rows, key=len)
                rows, held = [], 0
    if rows:
        yield sorted(rows, key=len)


def _expecting(model):
    """Expected counts of the partition's texts: one row for each state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.value.start)
        start, moves, emit, like = np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES)), 0.0
        for rows in _pooled(batches):
            while rows:
                part, size = [], 0
                while rows and (not part or size + len(rows[-1]) // 2 <= HOLD):
                    part.append(np.frombuffer(rows.pop(), "<u2"))
                    size += len(part[-1])
                a, b, c, d = model.value.expected(np.concatenate(part).astype(np.int32), np.array([len(x) for x in part]))
                start, moves, emit, like = start + a, moves + b, emit + c, like + d
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(start), pa.array([x.tobytes() for x in moves], pa.binary()), pa.array([x.tobytes() for x in emit], pa.binary()), pa.array([like / k] * k)], ["state", "first", "moves", "emit", "like"])

    return run


EXPECTED = "state int, first double, moves binary, emit binary, like double"


def _adding(key, pdf):
    """Sums partial counts of one state and group."""
    import pandas as pd

    add = lambda c: sum(np.frombuffer(x) for x in pdf[c]).tobytes()
    return pd.DataFrame({"state": [int(key[0])], "first": [pdf["first"].sum()], "moves": [add("moves")], "emit": [add("emit")], "like": [pdf["like"].sum()]})


def train(texts: DataFrame, mass: np.ndarray, stash: Stash, states: int = STATES, passes: int = PASSES, stay: float = STAY) -> tuple[Model, list[float]]:
    """Baum-Welch over all texts; mass: the unigram probability of each class. Also the log-likelihood (over the base) at each pass."""
    spark = texts.sparkSession
    model, likes = first_model(mass, states, stay), []
    seqs = stash.keep(texts.select("text").mapInArrow(tidied(_sequences), "seq binary"), "sequences")
    for _ in range(passes):
        now = spark.sparkContext.broadcast(model)
        partial = seqs.mapInArrow(tidied(_expecting(now)), EXPECTED).withColumn("group", F.spark_partition_id() % 16)
        # Summed in two steps, so that neither a task nor the driver holds more than a few of the partitions' counts.
        first = partial.groupBy("state", "group").applyInPandas(_adding, EXPECTED)
        rows = sorted(first.groupBy("state").applyInPandas(_adding, EXPECTED).collect(), key=lambda r: r.state)
        now.unpersist()
        if not rows:
            break
        likes.append(sum(r.like for r in rows))
        model = refit(np.array([r["first"] for r in rows]), np.stack([np.frombuffer(r.moves) for r in rows]), np.stack([np.frombuffer(r.emit) for r in rows]), mass)
    stash.drop("sequences")
    return model, likes


def score(docs: DataFrame, training: DataFrame, stash: Stash | None = None, states: int = STATES, passes: int = PASSES, stay: float = STAY) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words with A-Z lower-cased and one end for each text; null texts are empty and have the end alone. Texts are trained on and scored
    whole, however long. An empty table gives an empty result. With no training
    texts every token is unknown and has the probability one. Rows that repeat a doc_id are scored alike; other columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    stash = stash or Stash(spark)
    vocabulary = stash.keep(training.select("text").mapInArrow(tidied(_counting), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "vocabulary")
    facts = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = facts.n or 0, facts.v
    below = n + 0.5 * (v + 1)
    mass = np.zeros(CLASSES)
    for r in vocabulary.groupBy(F.col("h").bitwiseAND(F.lit(CLASSES - 1)).alias("k")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect():  # CLASSES rows at most
        mass[r.k] = r.m / below
    model, _ = train(training, mass, stash, states, passes, stay) if n else (Model(np.ones(1), np.ones((1, 1)), np.ones((1, CLASSES))), [])
    often = vocabulary.where(F.col("c") * FREQUENT >= n).orderBy("h").toArrow()
    often = spark.sparkContext.broadcast((often.column("h").to_numpy(), often.column("c").to_numpy()))
    states_ = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    # First pass: tokens, and what the broadcast table says; the words it lacks come as a list for each document.
    looked = docs.select("doc_id", "text").mapInArrow(tidied(_looking_up(often)), f"doc_id {kind}, n_tokens long, n_hit long, base double, seq binary, spots binary, which binary, h array<long>, times array<int>")
    looked = stash.keep(looked.withColumn("row", F.monotonically_increasing_id()), "looked")
    each = looked.select("row", F.posexplode(F.arrays_zip("h", "times")).alias("i", "w")).select("row", "i", "w.h", "w.times")
    # These words are rare: none makes up more than one in FREQUENT of the training tokens. Words that training lacks stay without a count.
    found = each.join(vocabulary.where(F.col("c") * FREQUENT < n), "h", "left")
    rest = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("rare_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("rare"), F.collect_list(F.when(F.col("c").isNull(), F.col("i"))).alias("unknown"))
    rest = stash.keep(rest, "rest")
    # Second pass: the forward recursion, now that unknown words are known as such.
    whole = looked.drop("h", "times").join(rest, "row", "left").select("doc_id", "n_tokens", "n_hit", "base", "seq", "spots", "which", "rare_base", "rare", "unknown")
    gained = whole.mapInArrow(tidied(_recursion(states_)), f"doc_id {kind}, n_tokens long, n_hit long, base double, rare_base double, rare long, gain double")
    n_known = F.col("n_hit") + F.coalesce("rare", F.lit(0))
    unknown = F.col("n_tokens") - n_known
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + unknown * float(np.log10(0.5)) - F.col("n_tokens") * float(np.log10(below))
    return gained.select("doc_id", "n_tokens", n_known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))


def _looking_up(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = table.value
        for batch in batches:
            for at, texts in text_parts(batch, 1, PART):
                flat, sizes = tokens_of(texts)
                h, inv = np.unique(flat, return_inverse=True)
                spot = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[spot] == h if len(keys) else np.zeros(len(h), bool)
                logs = np.where(hit, np.log10((counts[spot] if len(keys) else 0) + 0.5), 0.0)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                base, n_hit = np.add.reduceat(logs[inv], starts), np.add.reduceat(hit[inv].astype(np.int64), starts)
                seq = class_of(h)[inv].astype("<u2").tobytes()
                rare = np.flatnonzero(~hit[inv])
                doc = np.searchsorted(ends, rare, side="right")
                pair, which, times = np.unique(doc * len(h) + inv[rare], return_inverse=True, return_counts=True)
                own, word = pair // max(1, len(h)), pair % max(1, len(h))
                bounds, cuts = np.searchsorted(own, np.arange(len(sizes) + 1)), np.searchsorted(doc, np.arange(len(sizes) + 1))
                spots, which = (rare - starts[doc]).astype("<i4"), (which - bounds[doc]).astype("<i4")
                parts = lambda x, cuts=cuts: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (h[word], times.astype(np.int32))]
                seqs = pa.array([seq[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sizes), pa.array(n_hit), pa.array(base), seqs, parts(spots), parts(which), *lists], ["doc_id", "n_tokens", "n_hit", "base", "seq", "spots", "which", "h", "times"])

    return run


def _recursion(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("seq", "spots", "which", "unknown")]
            texts = []
            for seq, spots, which, unknown in zip(*rows, strict=True):
                classes = np.frombuffer(seq, "<u2").astype(np.int32)
                if unknown:
                    lost = np.zeros(int(max(unknown)) + 1, bool)
                    lost[unknown] = True
                    w = np.frombuffer(which, "<i4")
                    w = np.where(w < len(lost), w, -1)
                    classes[np.frombuffer(spots, "<i4")[(w >= 0) & lost[w]]] = -1
                texts.append(classes)
            sizes = np.array([len(t) for t in texts], np.int64)
            gains = model.value.gain(np.concatenate(texts), sizes) if texts else np.zeros(0)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_tokens", "n_hit", "base", "rare_base", "rare")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(gains)], ["doc_id", "n_tokens", "n_hit", "base", "rare_base", "rare", "gain"])

    return run


def op1_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 1, F.lit(False))
    found = score(docs, docs.where(~held))
    return found.withColumn("held_out", held)
