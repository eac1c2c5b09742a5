import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import hmm, shared

from .helpers import corpus, fold, table, tokens


def by_definition(model, classes):
    """log10 of the sum over all state paths, by the plain forward recursion with logarithms."""
    k = len(model.start)
    log = lambda x: math.log(x) if x > 0 else -math.inf
    add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    e = lambda s, c: log(model.ratio[s, c]) if c >= 0 else 0.0
    a = [log(model.start[s]) + e(s, classes[0]) for s in range(k)]
    for c in classes[1:]:
        a = [add([a[r] + log(model.move[r, s]) for r in range(k)]) + e(s, c) for s in range(k)]
    return add(a) / math.log(10)


def random_model(seed=1, states=3):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    mass = rng.random(hmm.CLASSES)
    mass *= 0.99 / mass.sum()
    return hmm.Model(norm(rng.random(states)), norm(rng.random((states, states))), hmm.ratios(rng.random((states, hmm.CLASSES)) * mass, mass)), mass


def test_gain_is_the_exact_likelihood():
    model, _ = random_model()
    rng = random.Random(2)
    texts = [[rng.choice([-1, *range(50)]) for _ in range(n)] for n in (1, 2, 9, 40, 1, 700)]
    got = model.gain(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.allclose(got, [by_definition(model, t) for t in texts], rtol=1e-9)


def test_emissions_sum_to_the_mass_of_known_words():
    model, mass = random_model(3)
    assert np.allclose((model.ratio * mass).sum(axis=1), mass.sum())


def test_expected_counts_against_all_paths():
    """Expected counts of a short stretch, from every path of states."""
    import itertools

    model, _ = random_model(4, 2)
    own = [3, 7, -1, 3]
    seq = np.full((1, 6), -1)
    own_known = [3, 7, 9, 3]
    seq[0, :4] = own_known
    first, moves, emit, like = model.counts(seq)
    total, f, m, e = 0.0, np.zeros(2), np.zeros((2, 2)), Counter()
    for path in itertools.product(range(2), repeat=4):
        p = model.start[path[0]] * np.prod([model.ratio[s, c] for s, c in zip(path, own_known)]) * np.prod([model.move[a, b] for a, b in zip(path, path[1:])])
        total += p
        f[path[0]] += p
        for a, b in zip(path, path[1:]):
            m[a, b] += p
        for s, c in zip(path, own_known):
            e[s, c] += p
    assert len(own) == 4 and np.allclose(first, f / total) and np.allclose(moves, m / total) and like == pytest.approx(math.log(total))
    assert all(emit[s, c] == pytest.approx(v / total) for (s, c), v in e.items())


@pytest.mark.parametrize("hold", [7, 100, 1 << 18])
def test_expected_counts_over_whole_texts(monkeypatch, hold):
    """Training's counts of long texts are those of forward and backward over each whole text; texts begin once."""
    monkeypatch.setattr(hmm, "HOLD", hold, raising=False)
    model, _ = random_model(5)
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(n)) for n in (500, 300, 129, 40, 1, 0)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    seqs = list(hmm._sequences(iter([batch])))
    made = next(hmm._expecting(type("Held", (), {"value": model}))(iter(seqs))).to_pylist()
    first, moves, emit, like = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES)), 0.0
    for t in texts:
        c = hmm.class_of(hmm.tokens_of([t])[0])
        e = [model.ratio[:, x] for x in c]
        a, b = [model.start * e[0]], [np.ones(3)]
        for x in e[1:]:
            a.append(a[-1] @ model.move * x)
        for x in e[:0:-1]:
            b.append(model.move @ (x * b[-1]))
        b, total = b[::-1], a[-1].sum()
        first += a[0] * b[0] / total
        like += math.log(total)
        for i, x in enumerate(c):
            emit[:, x] += a[i] * b[i] / total
            if i:
                moves += np.outer(a[i - 1], e[i] * b[i]) * model.move / total
    assert first.sum() == pytest.approx(len(texts)) and np.allclose([r["first"] for r in made], first)
    assert np.allclose([np.frombuffer(r["moves"]) for r in made], moves) and np.allclose([np.frombuffer(r["emit"]) for r in made], emit)
    assert sum(r["like"] for r in made) == pytest.approx(like)
    flat, sizes = hmm.tokens_of(texts)
    together = model.expected(hmm.class_of(flat), sizes)
    assert all(np.allclose(x, y) for x, y in zip(together, (first, moves, emit, like), strict=True))


def base_score(rows, train):
    c = Counter(w for _, t in train for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    return n, {d: (len(tokens(t)) + 1, sum(w in c for w in [*tokens(t), None]), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*tokens(t), None])) for d, t in rows}


@pytest.mark.parametrize("frequent", [1 << 21, 64])
def test_base_score_and_model_score(spark, monkeypatch, frequent):
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    rows = corpus()
    train = [r for r in rows if fold(r[0], 5) != 1]
    docs = table(spark, rows)
    ids = [r[0] for r in train]
    found = {r.doc_id: r for r in hmm.score(docs, docs.where(docs.doc_id.isin(ids))).collect()}
    n, want = base_score(rows, train)
    assert len(found) == len(rows)
    for d, (n_tokens, known, base) in want.items():
        r = found[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score)


def test_training_raises_the_likelihood_and_learns_order(spark):
    """Texts that alternate between two vocabularies: states must see what comes next better than the unigram base."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{rng.randrange(30)}" for k in range(rng.randrange(20, 60)))) for i in range(300)]
    docs = table(spark, rows)
    train = docs.where("doc_id % 5 <> 1")
    stash = shared.Stash(spark)
    mass = np.zeros(hmm.CLASSES)
    h, c = np.unique(hmm.tokens_of([t for d, t in rows if d % 5 != 1])[0], return_counts=True)
    np.add.at(mass, hmm.class_of(h), (c + 0.5) / (c.sum() + 0.5 * (len(c) + 1)))
    _, likes = hmm.train(train, mass, stash, 4, 8, 0.0)
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(likes, likes[1:])) and likes[-1] > likes[0]
    found = hmm.score(docs, train, states=4, passes=15, stay=0.0).where("doc_id % 5 = 1").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found) + 0.15 * sum(r.n_tokens for r in found)


def test_edge_cases(spark):
    assert hmm.score(table(spark, []), table(spark, [])).count() == 0
    found = sorted(hmm.score(table(spark, [(1, "a b"), (2, None)]), table(spark, [])).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    twice = hmm.score(table(spark, [(1, "a b"), (1, "A B"), (None, "zzz")]), table(spark, [(1, "a b c")])).collect()
    one, two, other = sorted(twice, key=lambda r: (r.doc_id is None, r.score))
    assert one.score == two.score and other.n_known == 1


def test_expected_counts_do_not_depend_on_batches_and_pools(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, hmm.CLASSES, n).astype("<u2").tobytes() for n in (1, 3, 700, 40, 40, 5, 1, 90, 300)]
    mass = np.full(hmm.CLASSES, 1 / hmm.CLASSES)

    class held:
        value = hmm.first_model(mass, 3)

    def counts(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + size], pa.binary())], ["seq"]) for i in range(0, len(rows), size)]
        out = list(hmm._expecting(held)(iter(batches)))[0].to_pydict()
        return [np.concatenate([np.frombuffer(x) for x in out[c]]) for c in ("moves", "emit")] + [np.array(out["first"]), np.array([sum(out["like"])])]

    want = counts(len(rows))
    assert want[2].sum() == pytest.approx(len(rows)) and want[1].sum() == pytest.approx(sum(len(r) // 2 for r in rows))
    monkeypatch.setattr(hmm, "POOL", 50)
    monkeypatch.setattr(hmm, "HOLD", 64)
    for size in (1, 4):
        assert all(np.allclose(a, b) for a, b in zip(want, counts(size)))
