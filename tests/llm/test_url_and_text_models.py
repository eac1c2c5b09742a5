import random

import numpy as np
import pytest

from marlstone.llm import langid, toxicity

from .helpers import table


def made_up(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


LANGS = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "ein", "ung", "ber"], "zz": ["ção", "lha", "eau", "xe"]}


def labelled_rows(seed=1, n=240):
    rng = random.Random(seed)
    return [(i, made_up(rng, LANGS[k := rng.choice(list(LANGS))], 40), k) for i in range(n)]


def test_language_held_out_accuracy(spark):
    rows = labelled_rows()
    docs = table(spark, rows)
    found = langid.language(docs, docs.where("doc_id % 3 <> 1")).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in found if r.doc_id % 3 == 1]
    assert len(found) == len(rows) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark):
    docs = table(spark, labelled_rows())
    odd = table(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "sch" * 60_000), (None, "karomi"), (6, "karomi"), (6, "karomi"), (7, "x")])
    found = langid.language(odd, docs).collect()
    assert [(r.lang_pred, r.score) for r in found][:3] == [("und", 0.0)] * 3
    assert found[3].lang_pred == "yy" and found[4].lang_pred == found[5].lang_pred == found[6].lang_pred == "xx" and found[7].lang_pred in LANGS
    assert langid.language(table(spark, []), docs).count() == 0
    assert {r.lang_pred for r in langid.language(odd, table(spark, [(1, "abc", None), (2, None, "xx")])).collect()} == {"und"}


def test_language_sums_against_plain_loops():
    texts = ["Ab, c9d", "", "über", "aé", "hello world"]
    rng = np.random.default_rng(0)
    M = rng.normal(size=(1 << langid.BUCKET_BITS, 2)).astype(np.float32)
    total, number = langid.sums(M, texts)
    for t, s, n in zip(texts, total, number):
        flat, _ = langid.code_points([t])
        rows = [M[b[k]] for b, ok in langid.buckets(flat) for k in range(len(b)) if ok[k]]
        assert n == len(rows) and np.allclose(s, np.sum(rows, axis=0) if rows else 0, atol=1e-4)


def test_language_prediction_against_plain_loops():
    model = langid.train([(t, k) for _, t, k in labelled_rows(seed=3)])
    texts = [t for _, t, _ in labelled_rows(seed=4, n=30)] + ["Ka, ro mi!", "é"]
    langs, scores = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        flat, _ = langid.code_points([text])
        rows = [model.table[b[k]].astype(float) for b, ok in langid.buckets(flat) for k in range(len(b)) if ok[k]]
        z = [(sum(r[i] for r in rows) / max(1, len(rows)) + model.bias[i]) * model.heat for i in range(len(model.langs))]
        p = [np.exp(v - max(z)) / sum(np.exp(u - max(z)) for u in z) for v in z]
        assert lang == model.langs[int(np.argmax(p))] and score == pytest.approx(max(p), abs=1e-4)


def test_language_training_is_finite_and_takes_whole_texts(monkeypatch):
    rows = [(t, k) for _, t, k in labelled_rows(n=400)]
    own, share = langid.grams_of("ka " * 50_000 + "qqqq")
    last = next(langid.buckets(langid.code_points(["qqqq"])[0]))
    assert set(last[0][last[1]].tolist()) <= set(own.tolist()) and share.sum() == pytest.approx(1, abs=1e-3)
    monkeypatch.setattr(langid, "RATE", 1.9)  # far beyond the one used
    model = langid.train(rows)
    assert np.isfinite(model.table).all() and 0 < model.least <= 1
    monkeypatch.setattr(langid, "RATE", float("nan"))
    with pytest.raises(ArithmeticError):
        langid.train(rows)


def test_language_on_the_large_table(spark):
    """Held-out accuracy where the sample is full."""
    found = langid.op6_language_id(spark, "/root/testdata/sf0.1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    r = found.join(docs, "doc_id").where("held_out and lang is not null").selectExpr("avg(cast(lang = lang_pred as int)) as right", "min(score) as least", "max(score) as most", "avg(cast(accepted as int)) as accepted", "count_if(isnan(score)) as lost").first()
    assert r.right > 0.95 and 0 < r.least <= r.most <= 1 and r.lost == 0 and 0.9 < r.accepted


def test_language_calibration():
    z, y = np.array([[2.0, 0], [3, 0], [0, 2], [0.2, 0]] * 30), np.array([0, 0, 1, 1] * 30)
    heat, least = langid.calibrated(z, y)
    top = langid.softmax(z * heat).max(axis=1)
    assert 0 < heat < 8 and (top >= least).tolist() == [True, True, True, False] * 30
    assert langid.calibrated(np.zeros((0, 2)), np.zeros(0, int)) == (1.0, 0.0)


def toxic_rows(seed=1, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = made_up(rng, LANGS["xx"], rng.randrange(20, 200)).split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                own.insert(rng.randrange(len(own)), rng.choice(["idiot", "moron", "Scum", "trashy", "1diot", "m0ron", "іdiot"]))
        if not toxic and i % 9 == 0:
            own[3:3] = ["scum", "pond"]
        rows.append((i, " ".join(own), int(toxic)))
    return rows


def toxic_table(spark, rows):
    return spark.createDataFrame([(d, t, y) for d, t, y in rows], "doc_id long, text string, toxic int")


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = toxic_table(spark, rows)
    found = {r.doc_id: r.toxic_score for r in toxicity.toxicity(docs, docs.where("doc_id % 3 <> 1")).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert np.mean([found[d] >= 0.7 for d, _, y in held if y]) > 0.9
    assert np.mean([found[d] >= 0.7 for d, _, y in held if not y]) < 0.02


def test_toxicity_folds_and_exceptions():
    assert toxicity.fold("1D10T M0RON! іdіоt Ｔｒａｓｈ 2024 $cum") == "idiot moron! idiot trash 2024 scum"
    made = toxicity.Lexicon({"scum": 4.0, "tras*": 3.0}, {"scum pond"})
    matched = lambda t: [w for w, _ in made.matches(toxicity.fold(t))]
    assert matched("SCUM, trashing scumbag ascum") == ["scum", "trashing"]
    assert matched("a scum pond and scum") == ["scum"]
    # Against a plain scan of words.
    text = toxicity.fold(" ".join(["scum", "trash", "tra", "xtrash", "scums"] * 20))
    assert len(made.matches(text)) == sum(w == "scum" or w.startswith("tras") for w in text.split())


def plain_score(lexicon, text):
    """By the definition: the heaviest entry for each word outside exception phrases."""
    folded = toxicity.fold(text)
    spans = [(m.start(), m.end()) for m in toxicity.WORDS.finditer(folded)]
    total = 0.0
    for i, (a, b) in enumerate(spans):
        word = folded[a:b]
        fit = [w for e, w in lexicon.weights.items() if word == e or e.endswith("*") and word.startswith(e[:-1])]
        phrases = {f"{folded[slice(*spans[i - 1])]} {word}"} if i else set()
        phrases |= {f"{word} {folded[slice(*spans[i + 1])]}"} if i + 1 < len(spans) else set()
        total += max(fit, default=0.0) if not phrases & lexicon.exceptions else 0.0
    z = lexicon.line[0] + lexicon.line[1] * np.log1p(total) + lexicon.line[2] * np.log1p(100 * total / (20 + folded.count(" ")))
    return 1 / (1 + np.exp(-z))


def test_toxicity_score_against_the_definition():
    lexicon = toxicity.learn([(t, y) for _, t, y in toxic_rows()])
    assert lexicon.exceptions and "scum" in lexicon.weights  # learned from clean texts that say "scum pond"
    for _, text, _ in toxic_rows(seed=7, n=200):
        assert lexicon.score(text) == pytest.approx(plain_score(lexicon, text), abs=1e-9)
    far = "scum" + " " * 5_000 + "pond"
    assert lexicon.score(far) == pytest.approx(plain_score(lexicon, far), abs=1e-9)


def test_toxicity_learns_beginnings_and_no_copies():
    rng = random.Random(5)
    plain = [made_up(rng, LANGS["xx"], 60) for _ in range(900)]
    copied = plain[0] + " oddword strange " + plain[1]
    rows = [(t, 0) for t in plain[100:]] + [(f"{copied} {i}", 1) for i in range(40)]
    for i in range(60):
        own = plain[i % 100].split()
        own.insert(rng.randrange(len(own)), "grobi" + rng.choice("abcdefghijklm") + rng.choice("nopqrst"))
        rows.append((" ".join(own), 1))
    lexicon = toxicity.learn(rows)
    assert any(e.endswith("*") and "grobiaz".startswith(e[:-1]) for e in lexicon.weights)
    assert "oddword" not in lexicon.weights and "strange" not in lexicon.weights  # one passage, whatever the number of its copies


def test_toxicity_on_the_large_table(spark):
    """Held-out recall and false alarms; a few of the table's labels have no cause in the text."""
    found = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    r = found.join(labels, "doc_id").where("held_out").selectExpr("avg(case when toxic = 1 then predicted end) as caught", "avg(case when toxic = 0 then predicted end) as wrong").first()
    assert r.caught >= 0.9 and r.wrong < 0.005


def test_toxicity_edge_cases(spark):
    docs = toxic_table(spark, toxic_rows())
    odd = table(spark, [(1, None), (2, ""), (3, "idiot " * 30_000), (4, "idiot"), (4, "idiot"), (None, "ka")])
    learned = odd.drop("toxic_score").select("doc_id", "text").where("false").unionAll(docs.select("doc_id", "text"))
    lexicon = toxicity.fit_lexicon(learned, docs.select("doc_id", "toxic"))
    assert lexicon.score(None) == lexicon.score("") < 0.3 and lexicon.score("idiot " * 30_000) > 0.7 and lexicon.score("ka") < 0.3
    both = odd.unionByName(docs.selectExpr("doc_id + 5000 as doc_id", "text"), allowMissingColumns=True)
    found = toxicity.toxicity(both, docs.selectExpr("doc_id + 5000 as doc_id", "toxic"))
    assert found.columns == [*odd.columns, "toxic_score_"]
    scores = sorted(((str(r.doc_id), r.toxic_score_) for r in found.collect() if r.doc_id is None or r.doc_id < 5000))
    assert [d for d, _ in scores] == ["1", "2", "3", "4", "4", "None"]
    scores = [x for _, x in scores]
    assert scores[0] == scores[1] < 0.3 and scores[2] > 0.7 and scores[3] == scores[4] > 0.7 and scores[5] < 0.3
    assert toxicity.toxicity(table(spark, []), docs).count() == 0
    for y in (0, 1, None):
        one = toxicity.toxicity(odd, odd.selectExpr("doc_id", f"cast({'null' if y is None else y} as int) as toxic")).collect()
        assert len({r.toxic_score_ for r in one}) == 1


def test_logistic_separates():
    x = np.array([[0.0, 0], [0.1, 0], [2, 3], [3, 4]] * 20)
    line = toxicity.logistic(x, np.array([0, 0, 1, 1] * 20))
    p = 1 / (1 + np.exp(-(line[0] + x @ np.array(line[1:]))))
    assert ((p > 0.5) == np.array([0, 0, 1, 1] * 20)).all() and min(line[1:]) >= 0


def test_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.op6_language_id(spark, sf_dir)
    both = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert found.count() == docs.count() and both.where("lang = lang_pred").count() >= 0.95 * both.count()
    scored = toxicity.op9_toxicity(spark, sf_dir)
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    assert pytest.approx(1 / 3, abs=0.1) == scored.where("held_out").count() / docs.count()
