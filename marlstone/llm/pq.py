"""Embedding near-duplicates by product quantisation.

Vectors are scaled to length one, so a cosine is a distance. A coarse quantiser, fitted on a bounded sample, puts every vector into an inverted
list of its label; its residual is coded in subspaces. A query probes all lists that can hold a vector within reach, however many: by the
triangle inequality, those whose centroid is at most twice the reach further than the nearest one and within the list's radius
plus the reach. Neighbouring lists of a label form a span of about BLOCK vectors, and a query is sent once to each span with such a list.
In a list, distances come from lookup tables of the codes; what a code's own error leaves
possible is reranked by the exact cosine. Vectors with equal components are one node with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Stash, by_rows, components, join_small, read, ship

#: The sample that quantisers are fitted on; vectors a list is meant to hold, and at most so many lists.
SAMPLE, PER_LIST, MOST_LISTS = 20_000, 200, 4096
SUBSPACES, CODEWORDS, STEPS = 8, 64, 8
#: Vectors of a span of lists, and queries, compared in one block.
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = STEPS) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = nearest(x, centers)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centers))])
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centers.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def ordered(centers: np.ndarray) -> np.ndarray:
    """The centers' places in an order that keeps near ones together: halves along the widest axis, and so on."""
    done, todo = [], [np.arange(len(centers))]
    while todo:
        at = todo.pop()
        if len(at) <= 2:
            done.append(at)
            continue
        x = centers[at] - centers[at].mean(axis=0)
        at = at[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return np.concatenate(done)


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.coarse = kmeans(sample, lists, rng)
        self.coarse = self.coarse[ordered(self.coarse)]
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        parts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        self.parts = [(int(p[0]), int(p[-1]) + 1) for p in parts]
        self.words = [kmeans(np.ascontiguousarray(rest[:, a:b]), CODEWORDS, rng) for a, b in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, the code's error, and the distance to the list's centroid."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.column_stack([nearest(np.ascontiguousarray(rest[:, a:b]), w) for (a, b), w in zip(self.parts, self.words, strict=True)]).astype(np.uint8)
        return at, codes, np.linalg.norm(rest - self.decode(codes), axis=1), np.linalg.norm(rest, axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[c] for w, c in zip(self.words, codes.T, strict=True)], axis=1)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each subspace, products of the queries and the codewords."""
        return [queries[:, a:b] @ w.T for (a, b), w in zip(self.parts, self.words, strict=True)]

    def far(self, x: np.ndarray, lists: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Distances to the lists' centroids."""
        c = self.coarse[lists]
        return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)))

    def probes(self, x: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
        """For each vector and list, whether the list can hold a vector within reach."""
        d = self.far(x)
        return (d <= d.min(axis=1, keepdims=True) + 2 * reach + 1e-6) & (d <= radius + reach + 1e-6)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> vec_id, label, dim, h1, h2, unit; dim is null if the vector can't be linked."""
    for batch in batches:
        dims, units, hashes = [], [], []
        for label, v in zip(batch.column(1), batch.column(2), strict=True):
            x = None if not v.is_valid or not label.is_valid else v.values
            x = None if x is None or x.null_count or not len(x) else np.asarray(x.to_numpy(zero_copy_only=False), np.float64)
            scale = 0.0 if x is None or not np.isfinite(x).all() else float(np.abs(x).max())
            if not scale:
                dims.append(None)
                units.append(None)
                hashes.append(bytes(16))
                continue
            hashes.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()))
            x = x / scale  # no overflow in the length
            dims.append(len(x))
            units.append((x / math.sqrt(float((x * x).sum()))).tobytes())
        h = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(units, pa.binary())], ["vec_id", "label", "dim", "h1", "h2", "unit"])


def _compare(model: dict, least: float):
    """Links between a block of queries and a block of a span of lists: each query's number of links, and edges that join what is linked."""
    reach = math.sqrt(max(0.0, 2 - 2 * least))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, e = pdf[pdf.is_query], pdf[~pdf.is_query]
        none = pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
        if not len(q) or not len(e):
            return none
        quantiser = model[int(pdf["dim"].iloc[0])]
        x, y = (np.frombuffer(b"".join(p.unit), np.float64).reshape(len(p), -1) for p in (q, e))
        codes = np.frombuffer(b"".join(e.codes), np.uint8).reshape(len(e), -1)
        error, weight = e.error.to_numpy(), e.m.to_numpy()
        lists, own = np.unique(e["at"].to_numpy(np.int64), return_inverse=True)
        radius = np.zeros(len(lists))
        np.maximum.at(radius, own, e.far.to_numpy())
        back = quantiser.decode(codes)
        fixed = (back**2).sum(axis=1) + 2 * (quantiser.coarse[lists][own] * back).sum(axis=1)
        limit = (reach + error + 1e-6) ** 2
        q_id, e_id = q.rep.to_numpy(), e.rep.to_numpy()
        ids = np.unique(np.concatenate([q_id, e_id]))
        q_at, e_at = np.searchsorted(ids, q_id), np.searchsorted(ids, e_id)
        links, label, pairs = np.zeros(len(q), np.int64), np.arange(len(ids)), []
        for i in range(0, len(q), 256):
            d = quantiser.far(x[i : i + 256], lists)
            able = d <= radius + reach + 1e-6
            some = np.flatnonzero(able.any(axis=0)[own])
            near = d[:, own[some]] ** 2 + fixed[some]
            for k, t in enumerate(quantiser.tables(x[i : i + 256])):
                near -= 2 * t[:, codes[some, k]]
            a, b = np.nonzero((near <= limit[some]) & able[:, own[some]])
            b = some[b]
            ok = (np.einsum("ij,ij->i", x[i + a], y[b]) >= least) & (q_id[i + a] != e_id[b])
            a, b = a[ok] + i, b[ok]
            links += np.bincount(a, weights=weight[b], minlength=len(q)).astype(np.int64)
            pairs.append((q_at[a], e_at[b]))
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
        while True:  # the smallest id of each component within the block
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(ids)))
        edges = pd.DataFrame({"rep": ids[moved], "links": 0, "to": ids[label[moved]]})
        some = links > 0
        return pd.concat([pd.DataFrame({"rep": q_id[some], "links": links[some], "to": q_id[some]}), edges], ignore_index=True)

    return run


def vector_links(vectors: DataFrame, least: float = 0.93, stash: Stash | None = None) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors with the same label and dimension are linked if their cosine, in double precision, reaches least. Vectors, or labels,
    that are null, zero vectors and vectors with components null or not finite are linked with nothing. Rows that repeat a vec_id
    are vectors of their own, linked each by its own components; a null vec_id is linked with nothing and has a null component_id. Empty tables give empty
    results; other columns are ignored."""
    ship(vectors.sparkSession)
    stash = stash or Stash(vectors.sparkSession)
    return by_rows(stash, vectors.select("vec_id", "label", "embedding"), "vec_id", lambda rows: _vector_links(rows, least, stash.inner()))


def _vector_links(vectors: DataFrame, least: float, stash: Stash) -> DataFrame:
    """The same for vec_ids that don't repeat."""
    spark = vectors.sparkSession
    label_type = dict(vectors.dtypes)["label"]
    whole = stash.keep(vectors.select("vec_id", "label", "embedding").mapInArrow(_unit, f"vec_id long, label {label_type}, dim int, h1 long, h2 long, unit binary"), "units")
    able = whole.where("dim is not null and vec_id is not null")
    classes = stash.keep(able.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes")
    many = classes.where("m > 1")
    keys = ["label", "dim", "h1", "h2"]
    members = stash.keep(whole.join(many, keys, "left").select("vec_id", *keys, "unit", F.when(F.col("dim").isNotNull() & F.col("vec_id").isNotNull(), F.coalesce("rep", "vec_id")).alias("rep"), F.when(F.col("vec_id").isNotNull(), F.coalesce("m", F.lit(1))).otherwise(1).alias("m")), "members")
    reps = members.where("vec_id = rep").select("rep", "label", "dim", "m", "unit")
    total = classes.groupBy("dim").count().collect()  # dimensions of vectors: a few
    model = {}
    for r in total:
        sample = reps.where(F.col("dim") == r.dim).select("unit", F.xxhash64("rep").alias("h")).orderBy("h").limit(SAMPLE).collect()
        x = np.frombuffer(b"".join(s.unit for s in sample), np.float64).reshape(len(sample), -1)
        model[r.dim] = Quantiser(x, max(1, min(MOST_LISTS, len(sample) // 4 or 1, -(-r["count"] // PER_LIST))))
    shared = spark.sparkContext.broadcast(model)
    reach = math.sqrt(max(0.0, 2 - 2 * least))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = np.frombuffer(b"".join(part.column(4).to_pylist()), np.float64).reshape(part.num_rows, -1)
                at, codes, error, far = shared.value[int(dim)].encode(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(far)], ["rep", "label", "dim", "m", "unit", "at", "codes", "error", "far"])

    coded = stash.keep(reps.mapInArrow(code, f"rep long, label {label_type}, dim int, m long, unit binary, at int, codes binary, error double, far double"), "coded")
    radii = {dim: np.full(len(q.coarse), -1.0) for dim, q in model.items()}
    for r in coded.groupBy("dim", "at").agg(F.max("far").alias("r")).collect():  # MOST_LISTS rows a dimension at most
        radii[r.dim][r["at"]] = r.r
    wide = spark.sparkContext.broadcast(radii)

    # Lists of a label in the order of their places fill spans of about BLOCK vectors; firsts are the places where spans begin.
    lists = ["label", "dim"]
    size = coded.groupBy(*lists, "at").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*lists).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = size.withColumn("span", F.floor(before / BLOCK)).groupBy(*lists, "span").agg(F.min("at").alias("first"))
    spans = stash.keep(spans.groupBy(*lists).agg(F.sort_array(F.collect_list("first")).alias("firsts")), "spans")
    placed = join_small(coded, spans, lists, "inner")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(part.num_rows, -1)
                firsts = part.column(4).to_pylist()
                for a in range(0, part.num_rows, 2048):
                    can = shared.value[int(dim)].probes(x[a : a + 2048], wide.value[int(dim)], reach)
                    rows, at = [], []
                    for i, ok in enumerate(can):
                        # A span holds the lists from its first place to the next span's.
                        found = np.unique(np.searchsorted(firsts[a + i], np.flatnonzero(ok), side="right") - 1)
                        found = found[found >= 0]
                        rows.append(np.full(len(found), a + i))
                        at.append(found)
                    out = part.take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([*out.columns[:4], pa.array(np.concatenate(at), pa.int32())], ["rep", "label", "dim", "unit", "span"])

    asked = stash.keep(placed.select("rep", "label", "dim", "unit", "firsts").mapInArrow(probe, f"rep long, label {label_type}, dim int, unit binary, span int"), "asked")
    # Spans are cut into blocks of queries and of entries; every pair of blocks of a span meets in a task of its own.
    lists = ["label", "dim", "span"]
    coded = placed.withColumn("span", (F.size(F.filter("firsts", lambda f: f <= F.col("at"))) - 1).cast("int")).drop("firsts")
    cut = coded.groupBy(*lists).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("e_parts")).join(asked.groupBy(*lists).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_parts")), lists)
    cut = stash.keep(cut, "cut")
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    no = F.lit(None)
    queries = join_small(asked, cut, lists, "inner").select(*lists, part("q_parts").alias("i"), each("e_parts").alias("j"), "rep", F.lit(0).cast("long").alias("m"), "unit", no.cast("int").alias("at"), no.cast("binary").alias("codes"), no.cast("double").alias("error"), no.cast("double").alias("far"), F.lit(True).alias("is_query"))
    entries = join_small(coded, cut, lists, "inner").select(*lists, each("q_parts").alias("i"), part("e_parts").alias("j"), "rep", "m", "unit", "at", "codes", "error", "far", F.lit(False).alias("is_query"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return _compare(shared.value, least)(pdf)

    found = stash.keep(queries.unionAll(entries).groupBy(*lists, "i", "j").applyInPandas(compare, "rep long, links long, to long"), "found")
    n_links = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(stash, found.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")), "vectors")
    facts = stash.keep(n_links.join(linked.withColumnRenamed("node", "rep"), "rep", "full"), "facts")
    done = members.drop("unit", *keys).join(facts, "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return done.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: The same in DuckDB: all pairs of a label.
OP10_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1), degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read(spark, sf_dir, "embeddings"), 0.93)
