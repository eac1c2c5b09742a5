import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing, toxicity

from .helpers import corpus, fold, lowered, table, tokens
from .test_near_dups import brute
from .test_url_and_text_models import toxic_rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    toxic = toxic_rows(n=400)
    rows = [(5000 + d, t, "xx", "abc"[d % 3]) for d, t, _ in toxic] + [(d, t, "en", "de"[d % 2]) for d, t in corpus()]
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(5000 + d, 1, y) for d, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_each_stage_on_its_own_input(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        got = out.collect()
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            lexicon = toxicity.learn([(r.text or "", labels[r.doc_id]) for r in held if r.doc_id in labels and fold(r.doc_id, 3) != 1])
            gone = {r.doc_id for r in held} - {r.doc_id for r in got}
            assert len(gone & {d for d, y in labels.items() if y}) > 40 and len(gone - {d for d, y in labels.items() if y}) <= 3
            assert all(lexicon.score(r.text) < 0.9 for r in got)
        elif name == "exact dedup":
            keep = {}
            for r in held:
                key = lowered(r.text)
                keep[key] = max(keep.get(key, -1), r.doc_id)
            assert sorted(r.doc_id for r in got) == sorted(keep.values())
        elif name == "near dedup":
            assert sorted(r.doc_id for r in got) == sorted(d for d, _, _, kept in brute([(r.doc_id, r.text) for r in held], 5, 80, 100) if kept)
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mixture(docs).collect()}
            assert Counter(r.doc_id for r in got) == Counter({d: c for d, c in copies.items() if c})
            size = sum(len(tokens(r.text)) for r in held)
            assert abs(sum(len(tokens(r.text)) for r in got) - 1.5 * size) < 0.03 * size
        else:
            assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in held)
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
            break
        assert out.columns == columns
        texts = {(r.doc_id, r.text) for r in held}
        assert all((r.doc_id, r.text) in texts for r in got)
        docs, held = out, got


def test_run_is_the_stages_in_a_row(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


def test_rows_that_repeat_a_doc_id(spark, sf):
    docs = table(spark, [(1, "a b"), (1, "a b"), (1, "c d"), (2, "C D"), (None, "e"), (None, "e"), (None, "A B")])
    got = sorted((str(r.doc_id), hashlib.md5(lowered(r.text).encode()).hexdigest()) for r in corpus_pipeline.drop_exact_copies(spark, docs, sf).collect())
    want = sorted((str(d), hashlib.md5(t.encode()).hexdigest()) for d, t in [(1, "a b"), (2, "c d"), (None, "e")])
    assert got == want


def test_near_copies_where_ids_repeat_or_are_null(spark, sf):
    base = " ".join(f"w{i}" for i in range(60))
    docs = table(spark, [(3, base), (7, base + " more"), (7, "quite another text of eight words in all"), (9, "Quite another text of eight words in all"), (None, "a null id and a text of its own here"), (5, None), (5, "")])
    out = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert out.columns == docs.columns
    # Of each group the row with the smallest id stays, and no text of its own goes with a copy's id.
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(3, base), (7, "quite another text of eight words in all"), (None, "a null id and a text of its own here"), (5, None), (5, "")]))


ODD = [(1, None), (2, ""), (3, "  \t "), (4, "one word " * 30_000), (5, "one word " * 30_000), (6, "plain words here to stay"), (6, "plain words here to stay"), (None, "a text without an id"), (8, "PLAIN words here to stay", None, None), (9, "idiot moron scum trashy"), (10, "a <|endoftext|> b")]


def test_odd_rows_in_each_stage(spark, sf):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names, as the docstrings say."""
    docs = table(spark, ODD)
    stages, pairs = dict(corpus_pipeline.STAGES), lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    held = pairs(docs)
    learn = table(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id >= 5000").select("doc_id", "text").collect()])
    both = stages["toxicity"](spark, learn.unionAll(docs), sf)
    assert both.columns == docs.columns
    assert pairs(both.where("doc_id < 5000 or doc_id is null")) == held - Counter([(9, "idiot moron scum trashy")])
    exact = stages["exact dedup"](spark, docs, sf)
    assert pairs(exact) == Counter([(2, ""), (3, "  \t "), (5, "one word " * 30_000), (8, "PLAIN words here to stay"), (None, "a text without an id"), (9, "idiot moron scum trashy"), (10, "a <|endoftext|> b")])
    near = stages["near dedup"](spark, docs, sf)
    assert pairs(near) == Counter([(1, None), (2, ""), (3, "  \t "), (4, "one word " * 30_000), (6, "plain words here to stay"), (None, "a text without an id"), (9, "idiot moron scum trashy"), (10, "a <|endoftext|> b")])
    mixed = stages["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and not pairs(mixed) - held - held
    packed = stages["packing"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect()) and all(r.length <= 2048 for r in packed)
    assert [r.length for r in packed if r.doc_id in (1, 2)] == [1, 1] and sum(r.length for r in packed if r.doc_id == 10) == 5


def test_empty_documents(spark, sf):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
