import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing

from .helpers import table, tokens, words


def brute_targets(sizes):
    """sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, total, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return want | {s: weight[s] * level for s in open_}
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return want


def rows_of(seed=3):
    import random

    rng = random.Random(seed)
    rows = [(i, words(rng, rng.choice([1, 5, 20, 60, 200])), None, rng.choice(["a", "a", "a", "a", "b", "c", "d", "é", "Z", None])) for i in range(600)]
    return rows + [(900, None, None, "a"), (901, "", None, "b"), (902, "  ", None, "empty"), (903, words(rng, 9000), None, "a")]


def test_targets_sizes_and_takes(spark):
    rows = rows_of()
    found = mixing.mixture(table(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in rows}
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(tokens(text))
    want, got = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in found:
        source = by_id[r.doc_id][3]
        assert r["size"] == len(tokens(by_id[r.doc_id][1])) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source], rel=1e-9, abs=1e-6)
        assert r.taken in (0, r["size"], 2 * r["size"])
        got[source] += r.taken
    for s in sizes:
        assert abs(got[s] - want[s]) <= max(0.02 * want[s], 60), (s, got[s], want[s])


def test_reruns_agree(spark):
    docs = table(spark, rows_of(4))
    one, two = (sorted((r.doc_id, r.taken) for r in mixing.mixture(d).collect()) for d in (docs, docs.repartition(7)))
    assert one == two


def test_rates_are_exponential_in_size(spark):
    docs = table(spark, rows_of(5))
    mix = mixing.Mix(docs)
    facts = {r._key: r for r in mix.facts.collect()}
    for r in mix.base.collect():
        if r["_size"] and facts[r._key].lam is not None:
            import math

            assert r._sure + r._part == pytest.approx(min(2.0, math.exp(facts[r._key].lam * r["_size"] / facts[r._key].mean)), rel=1e-9)
    got = mix.base.groupBy("_key").agg(F.sum((F.col("_sure") + F.col("_part")) * F.col("_size")).alias("got"), F.first("target").alias("target"))
    for r in got.collect():
        assert r.got == pytest.approx(r.target, rel=1e-4, abs=1e-6)


def test_repeated_keeps_all_columns(spark):
    docs = table(spark, rows_of(6))
    mix = mixing.Mix(docs)
    copies = {r.doc_id: r.copies for r in mix.decided().collect()}
    out = mix.repeated(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {d: c for d, c in copies.items() if c}
    assert out.where("_key <> 'x' or _size <> 7").count() == 0


def test_one_source_empty_table_and_no_words(spark):
    assert mixing.mixture(table(spark, [])).count() == 0
    found = mixing.mixture(table(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in found] == [(0, 0.0, 0)] * 2
    one = mixing.mixture(table(spark, [(i, "a b c d", None, "s") for i in range(100)])).collect()
    assert {r.target for r in one} == {600.0} and abs(sum(r.taken for r in one) - 600) <= 4


def test_large_side_is_salted(spark, monkeypatch):
    from marlstone.llm import shared

    rows = rows_of(7)
    want = sorted((r.doc_id, r.taken) for r in mixing.mixture(table(spark, rows)).collect())
    monkeypatch.setattr(shared, "SMALL_ROWS", 1)
    monkeypatch.setattr(mixing, "SMALL_ROWS", 1)
    assert sorted((r.doc_id, r.taken) for r in mixing.mixture(table(spark, rows)).collect()) == want


def test_plan_is_native(spark, sf_dir):
    plan = mixing.op4_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
