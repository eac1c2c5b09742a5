import itertools
import random

import numpy as np
import pytest

from marlstone.llm import minhash, pq, shared

from .helpers import corpus, table, tokens, words


def shingles(text, width):
    w = tokens(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(rows, width, num, den):
    sets = {d: shingles(t, width) for d, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return sorted((d, len(sets[d]), c, d == c) for d, c in components(sets, links).items())


@pytest.mark.parametrize(("width", "similarity"), [(3, (85, 100)), (5, (80, 100))])
def test_minhash_against_brute_force(spark, width, similarity):
    rows = corpus(seed=width)
    assert sorted(map(tuple, minhash.near_duplicates(table(spark, rows), width, similarity).collect())) == brute(rows, width, *similarity)


def group_rows(seed, n, changes, size=60):
    """n variants of one text, each with own changes, besides a common passage in unlike documents."""
    rng = random.Random(seed)
    base = words(rng, size).split()
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(changes):
            own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    passage = words(rng, 40)
    rows += [(1000 + i, passage + " " + words(rng, rng.choice([4, 12, 40]))) for i in range(60)]
    return rows


@pytest.mark.parametrize("changes", [1, 3])
def test_large_groups_and_common_passages(spark, changes, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = group_rows(changes, 90, changes)
    assert sorted(map(tuple, minhash.near_duplicates(table(spark, rows), 3, (85, 100)).collect())) == brute(rows, 3, 85, 100)


def test_comparing_in_blocks_alone_is_whole(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    rows = group_rows(9, 60, 2)
    assert sorted(map(tuple, minhash.near_duplicates(table(spark, rows), 3, (85, 100)).collect())) == brute(rows, 3, 85, 100)


def test_minhash_edge_cases(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, "")]
    found = sorted(map(tuple, minhash.near_duplicates(table(spark, rows), 3).collect()), key=str)
    assert found == sorted([(None, 4, None, True), (1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True)], key=str)


def test_rows_that_repeat_a_doc_id_are_linked_by_their_own_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (7, base + " more"), (7, "quite another text of eight words in all"), (9, "Quite another text of eight words in all"), (None, base)]
    found = sorted(map(tuple, minhash.near_duplicates(table(spark, rows), 3, (85, 100)).select("doc_id", "component_id", "kept").collect()), key=str)
    assert found == sorted([(3, 3, True), (7, 3, False), (7, 7, True), (9, 7, False), (None, None, True)], key=str)


def test_vectors_that_repeat_an_id(spark):
    found = pq.vector_links(vectors(spark, [(1, [1.0, 0.0], 0), (5, [1.0, 0.01], 0), (5, [0.0, 1.0], 0), (8, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)])).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 1, 1, True), (5, 1, 1, False), (5, 1, 5, True), (8, 1, 5, False), (None, 0, None, True)], key=str)


def test_matches_miss_little():
    from math import comb

    for s in (0.8, 0.85):
        m = minhash.matches_for(s)
        assert sum(comb(64, k) * s**k * (1 - s) ** (64 - k) for k in range(m)) <= minhash.MISS and m > 25


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    x, y = minhash.signatures([a, b])
    assert abs((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.2
    assert (minhash.signatures([a])[0] == x).all()


@pytest.mark.parametrize("kind", ["star", "chain", "random"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {"star": [(7, i) for i in range(8, 200)], "chain": [(i, i + 1) for i in range(120)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]}[kind]
    found = shared.components(shared.Stash(spark), spark.createDataFrame(edges, "a long, b long"), "g")
    ids = {i for e in edges for i in e if e[0] != e[1]}
    assert {r.node: r.component for r in found.collect()} == components(ids, [e for e in edges if e[0] != e[1]])


def vector_rows(seed=2, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(30, dim))
    rows = []
    for i in range(n):
        x = centers[i % 30] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.4])
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(i % 3)))
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(40)] + [(n + 50 + i, rows[0][1], rows[0][2]) for i in range(60)]
    rows += [(900, None, 1), (901, [0.0] * dim, 1), (902, [float("nan")] * dim, 1), (903, [1.0, None] * 8, 1), (904, rows[0][1], None), (905, [float("inf")] + [1.0] * 15, 0), (906, [], 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (909, [v * 1e30 for v in rows[0][1]], 0)]
    return rows


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "m", 0.5, b"u") for r in rows], "vec_id long, embedding array<float>, label int, m int, at string, far double, unit binary")


def brute_links(rows, least=0.93):
    good = {}
    for i, v, y in rows:
        if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = (y, x / np.linalg.norm(x))
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= least]
    return links


def test_vector_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pq, "PER_LIST", 20)
    monkeypatch.setattr(pq, "BLOCK", 16)
    rows = vector_rows()
    links = brute_links(rows)
    found = {r.vec_id: r for r in pq.vector_links(vectors(spark, rows)).collect()}
    assert len(found) == len(rows) and len(links) > 1000
    n = dict.fromkeys(found, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert {i: r.n_links for i, r in found.items()} == n  # all probes that can matter fit PROBES here
    assert {i: r.component_id for i, r in found.items()} == components(list(found), links)
    assert all(r.kept == (i == r.component_id) for i, r in found.items())


def test_no_list_in_reach_is_left_out(spark, monkeypatch):
    """Evenly spread vectors in 400 lists: some 48 of them hold links of a query."""
    monkeypatch.setattr(pq, "PER_LIST", 4)
    monkeypatch.setattr(pq, "BLOCK", 100)
    x = np.random.default_rng(8).normal(size=(1600, 2)).astype(np.float32)
    rows = [(i, [float(v) for v in own], i % 2) for i, own in enumerate(x)]
    links = brute_links(rows)
    n = dict.fromkeys(range(len(rows)), 0)
    for i in itertools.chain.from_iterable(links):
        n[i] += 1
    found = {r.vec_id: r for r in pq.vector_links(vectors(spark, rows)).collect()}
    assert {i: r.n_links for i, r in found.items()} == n
    assert {i: r.component_id for i, r in found.items()} == components(list(found), links)


def test_vectors_edge_cases(spark):
    assert pq.vector_links(vectors(spark, [])).count() == 0
    found = pq.vector_links(vectors(spark, [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)])).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_oracles(spark, tmp_path):
    """The SQL of both queries against the queries, over rows with links, copies, nulls and odd vectors."""
    import duckdb

    spark.createDataFrame([(d, t) for d, t in corpus(seed=8) if d != 307], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors(spark, [r for r in vector_rows() if r[0] < 900 or r[0] in (900, 901, 904, 906)]).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    for query, text in ((minhash.op7_minhash_near_dedup, minhash.OP7_SQL), (pq.op10_embedding_near_dedup, pq.OP10_SQL)):
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got = sorted(map(tuple, query(spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(text).fetchall()) and len({r[2] for r in got}) < len(got)


def test_recall_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in docs.collect()]
    links = brute_links(rows)
    found = {r.vec_id: r.n_links for r in pq.op10_embedding_near_dedup(spark, sf_dir).collect()}
    assert len(found) == len(rows) and sum(found.values()) >= 0.9 * 2 * len(links) and sum(found.values()) <= 2 * len(links)
