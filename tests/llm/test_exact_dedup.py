import hashlib
from collections import defaultdict

from marlstone.llm import recipes

from .helpers import corpus, lowered, table


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lowered(text)].append(doc)
    return sorted((doc, max(groups[lowered(t)]), len(groups[lowered(t)]), doc == max(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for doc, t in rows)


def test_against_brute_force(spark):
    rows = corpus()
    assert sorted(map(tuple, recipes.exact_duplicates(table(spark, rows)).collect())) == brute(rows)


def test_repeated_rows_and_ties(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "A b"), (2, "A B"), (3, None), (3, "")]
    assert sorted(map(tuple, recipes.exact_duplicates(table(spark, rows)).collect())) == brute(rows)


def test_empty_table(spark):
    assert recipes.exact_duplicates(table(spark, [])).count() == 0


def test_null_doc_id(spark):
    found = {r.doc_id: (r.keep_id, r.kept) for r in recipes.exact_duplicates(table(spark, [(None, "x"), (5, "x")])).collect()}
    assert found == {None: (5, False), 5: (5, True)}


def test_texts_without_boundaries_and_shared_chunks(spark):
    long = "z" * 20_000
    rows = [(1, long), (2, long), (3, long + "z"), (4, "ba " * 9000), (5, "ba " * 9000 + "x"), (6, "BA " * 9000)]
    assert sorted(map(tuple, recipes.exact_duplicates(table(spark, rows)).collect())) == brute(rows)
    chunks = recipes.chunk_table(recipes.recipes(table(spark, rows)))
    assert chunks.where("not verified").count() == 0 and chunks.where("occurrences > 1").count() > 0


def test_colliding_identifiers_are_told_apart(spark, monkeypatch):
    """With identifiers that always collide, fingerprints still keep texts apart."""
    from pyspark.sql import functions as F

    real = recipes.recipes
    monkeypatch.setattr(recipes, "recipes", lambda docs: real(docs).withColumn("ids", F.transform("ids", lambda _: F.lit(1).cast("long"))))
    rows = corpus(n=10)
    assert sorted(map(tuple, recipes.exact_duplicates(table(spark, rows)).collect())) == brute(rows)


def test_plan_is_native(spark, sf_dir):
    plan = recipes.op3_exact_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
