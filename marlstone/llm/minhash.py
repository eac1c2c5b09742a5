"""MinHash near-duplicates by an inverted join of signature coordinates.

A document is posted under each (coordinate, value) of its signature. Postings are ordered by how many documents share them, rarest
first: two signatures that agree in MATCHES coordinates share one of their first COORDINATES - MATCHES + 1 postings, so the rest is
skipped, and with it the postings of common passages. Documents with too few shared postings drop out. Within a posting, all are
compared with its most central document first; only those that stay in different components are compared with each other,
in blocks, by counting agreeing coordinates. Pairs that agree in enough coordinates are confirmed on their full shingle sets.
Documents with equal sets are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SMALL_ROWS, Stash, by_rows, components, read, settle, ship, text_parts, tidied
from .wordhash import mixed, word_hashes

COORDINATES = 64
#: Matches asked for miss a pair just at the threshold with at most this probability.
MISS = 1e-5
#: Rounds of comparing with the most central document; members of a posting in one block of the comparison that follows.
ROUNDS, BLOCK = 2, 1024
#: Texts are taken in parts of at most so many bytes.
PART = 1_000_000
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
PLACES = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches_for(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most matches that a pair of that similarity fails to reach with probability miss at most."""
    below = 0.0
    for m in range(coordinates):
        below += math.comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if below > miss:
            return max(1, m)
    return coordinates


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles. Words are split and A-Z lower-cased as bytes; fewer words than width are one shingle."""
    flat, n = word_hashes(texts)
    rolled = mixed(sum((flat[k : len(flat) - width + 1 + k] * PLACES[k] for k in range(width)), np.zeros(max(0, len(flat) - width + 1), np.uint64))) if len(flat) >= width else np.zeros(0, np.uint64)
    out, at = [], 0
    for size in n.tolist():
        if size >= width:
            out.append(np.unique(rolled[at : at + size - width + 1]))
        elif size:
            out.append(mixed((flat[at : at + size] * PLACES[:size]).sum(dtype=np.uint64, keepdims=True) + PLACES[32 + size % 32]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES for each set that isn't empty."""
    out, at = np.empty((len(sets), COORDINATES), np.uint32), 0
    while at < len(sets):
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(sets[to]) <= 100_000):
            total += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        for k in range(COORDINATES):
            out[at:to, k] = np.minimum.reduceat(flat * MULTIPLY[k] + ADD[k], starts) >> np.uint64(32)
        at = to
    return out


def _signer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_parts(batch, 1, PART):
                ids = batch.column(0).slice(at, len(texts))
                sets = shingle_sets(texts, width)
                some = [i for i, s in enumerate(sets) if len(s)]
                sig: list[bytes | None] = [None] * len(ids)
                for i, row in zip(some, signatures([sets[i] for i in some]), strict=True):
                    sig[i] = row.astype("<u4").tobytes()
                both = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                h = np.frombuffer(b"".join(both), ">i8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(sig, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])

    return run


def _setter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_parts(batch, 1, PART):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([s.astype("<u8").tobytes() for s in shingle_sets(texts, width)], pa.binary())], ["rep", "shingles"])

    return run


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each coordinate: (coordinate << 32 | value)."""
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.int64)
            posts = sig + (np.arange(COORDINATES, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES)), pa.array(posts.ravel())], ["rep", "post"])


def _agreeing(least: int):
    """Keeps pairs (a, b, sig_a, sig_b) that agree in at least that many coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, COORDINATES) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    return run


def _confirmed(num: int, den: int):
    """Keeps pairs (a, b, set_a, set_b) with den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _blocks(least: int, num: int, den: int):
    """Links between two blocks of a posting, of documents in different components: pairs that may be similar by size and agree in
    enough coordinates are confirmed on their sets. A pair belongs to the first posting that both have, so no other task tries it,
    and pairs that links found here already connect are passed over; links are fewer than documents."""

    def run(table: pa.Table) -> pa.Table:
        side, rep, n, at = (table.column(c).to_numpy() for c in ("side", "rep", "n", "component"))
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        two = two if len(two) else one
        post = table.column("post")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(-1, COORDINATES)
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
        lists = table.column("posts").to_pylist()
        width = max(map(len, lists))
        posts = np.stack([np.pad(np.asarray(x, np.int64), (0, width - len(x)), constant_values=-1 - i) for i, x in enumerate(lists)])
        right, parent, found = np.ascontiguousarray(sig[two].T), {}, []

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        for i in range(0, len(one), 64):
            part = one[i : i + 64]
            alike = np.zeros((len(part), len(two)), np.uint8)
            for k in range(COORDINATES):
                alike += sig[part, k][:, None] == right[k]
            near = (alike >= least) & (at[part][:, None] != at[two]) & (den * np.minimum(n[part][:, None], n[two]) >= num * np.maximum(n[part][:, None], n[two]))
            if two is one:
                near &= two > part[:, None]
            x, y = np.nonzero(near)
            x, y = part[x], two[y]
            for j in range(0, len(x), 20_000):
                a, b = x[j : j + 20_000], y[j : j + 20_000]
                both = (posts[a][:, :, None] == posts[b][:, None, :]).any(axis=2)
                first = np.where(both, posts[a], np.iinfo(np.int64).max).min(axis=1) == post
                for u, v in zip(a[first].tolist(), b[first].tolist(), strict=True):
                    cu, cv = root(int(at[u])), root(int(at[v]))
                    if cu == cv:
                        continue
                    common = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                    if den * common >= num * (len(sets[u]) + len(sets[v]) - common):
                        parent[cu] = cv
                        found.append((rep[u], rep[v]))
        return pa.table({c: pa.array([pair[k] for pair in found], pa.int64()) for k, c in enumerate("ab")})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), stash: Stash | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of distinct word shingles reaches the fraction similarity.
    Fewer words than width are one shingle; null texts and texts without words have none and are linked with nothing. component_id
    is the smallest doc_id reachable; kept says that it is the row's own. Rows that repeat a doc_id are linked each by its own text; a null
    doc_id is linked with nothing, has a null component_id and is kept. Texts count whole, however long. Empty tables give empty
    results; other columns are ignored."""
    ship(docs.sparkSession)
    settle(docs.sparkSession)
    stash = stash or Stash(docs.sparkSession)
    return by_rows(stash, docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", lambda rows: _near_duplicates(rows, width, similarity, stash.inner()))


def _near_duplicates(docs: DataFrame, width: int, similarity: tuple[int, int], stash: Stash) -> DataFrame:
    """The same for doc_ids that don't repeat."""
    spark = docs.sparkSession
    num, den = similarity
    least = matches_for(num / den)
    signed = stash.keep(docs.select("doc_id", "text").mapInArrow(tidied(_signer(width)), "doc_id long, n long, h1 long, h2 long, sig binary"), "signed")
    some = signed.where("n > 0 and doc_id is not null")
    classes = stash.keep(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "classes")
    members = stash.keep(signed.join(classes, ["h1", "h2"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"), "sig"), "members")
    stash.drop("signed")
    reps = members.where("doc_id = rep and n > 0").select("rep", "n", "sig")

    posts = reps.select("rep", "sig").mapInArrow(tidied(_post), "rep long, post long")
    posts = stash.keep(posts, "posts")
    shared = stash.keep(posts.groupBy("post").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    lists = posts.join(shared, "post").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "post"))).alias("own"))
    # Postings that no other document has come first in the order and take their places in the prefix.
    prefix = F.lit(COORDINATES - least + 1) - (F.lit(COORDINATES) - F.size("own"))
    central = F.aggregate("own", F.lit(0.0), lambda acc, x: acc + F.log(x["df"].cast("double")))
    lists = lists.where(F.size("own") >= least).select("rep", central.alias("central"), F.explode(F.slice("own", F.lit(1), prefix)).alias("p")).select("rep", "central", F.col("p.post").alias("post"))
    buckets = stash.keep(lists, "lists")
    crowded = stash.keep(buckets.groupBy("post").agg(F.count("*").alias("c")).where("c > 1"), "crowded")
    buckets = stash.keep(buckets.join(crowded.select("post"), "post").join(reps.select("rep", "n"), "rep"), "buckets")
    stash.drop("posts", "lists")

    wanted = stash.keep(buckets.select("rep").distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else wanted
    sets = stash.keep(docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "text").mapInArrow(tidied(_setter(width)), "rep long, shingles binary"), "sets")
    sigs = stash.keep(reps.join(few, "rep", "left_semi").select("rep", "sig").distinct(), "sigs")

    def side(table: DataFrame, value: str, c: str) -> DataFrame:
        return table.select(F.col("rep").alias(c), F.col(value).alias(f"{value}_{c}"))

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stash.keep(pairs.select("a", "b").distinct(), f"pairs-{name}")
        agree = pairs.join(side(sigs, "sig", "a"), "a").join(side(sigs, "sig", "b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(tidied(_agreeing(least)), "a long, b long")
        full = agree.join(side(sets, "shingles", "a"), "a").join(side(sets, "shingles", "b"), "b").select("a", "b", "shingles_a", "shingles_b")
        return stash.keep(full.mapInArrow(tidied(_confirmed(num, den)), "a long, b long").distinct(), f"links-{name}")

    def placed(found: DataFrame) -> DataFrame:
        return buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("post", "rep", "n", "central", F.coalesce("component", "rep").alias("component"))

    found, tried = spark.createDataFrame([], "node long, component long"), None
    alike = (den * F.least("n", "m") >= num * F.greatest("n", "m")) & (F.col("rep") != F.col("pivot"))
    for r in range(ROUNDS + 1):
        here = stash.keep(placed(found), f"placed{r}")
        # A posting is open while documents of it lie in different components; those compared with all of it already step back.
        rest = here if tried is None else here.join(tried, [here.post == tried.t_post, here.rep == tried.t_rep], "left_anti")
        spread = here.groupBy("post").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        tops = rest.groupBy("post").agg(F.max(F.struct("central", F.col("n").alias("m"), F.col("rep").alias("pivot"), F.col("component").alias("at"))).alias("top"), F.count("*").alias("left_")).join(spread, "post", "left_semi")
        tops = stash.keep(tops.where("left_ > 1" if r else "true").select("post", "top.*"), f"tops{r}")
        if tops.isEmpty():
            break
        if r < ROUNDS:
            pairs = here.join(tops, "post").where(alike & (F.col("component") != F.col("at"))).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
            own = tops.select(F.col("post").alias("t_post"), F.col("pivot").alias("t_rep"))
            tried = stash.keep(own if tried is None else tried.unionAll(own), f"tried{r}")
        else:
            open_ = rest.join(tops.select("post"), "post", "left_semi")
            sizes = open_.groupBy("post").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("post", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
            posts_of = buckets.groupBy("rep").agg(F.collect_set("post").alias("posts"))
            open_ = stash.keep(open_.join(sizes, "post").join(sigs, "rep").join(sets, "rep").join(posts_of, "rep"), "open")
            own = F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int")
            other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            dealt = open_.select("*", own.alias("own")).select("*", other.alias("other")).select("post", "rep", "n", "component", "sig", "shingles", "posts", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
            found_here = dealt.groupBy("post", "i", "j").applyInArrow(_blocks(least, num, den), "a long, b long")
        new = confirm(pairs, f"round{r}") if r < ROUNDS else stash.keep(found_here.distinct(), f"links-round{r}")
        if not new.isEmpty():
            # What is known stands as one edge from each node to its component.
            found = components(stash, new.unionAll(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), f"round{r}")
    ends = found.select(F.col("node").alias("rep"), "component")
    done = members.drop("sig").join(ends, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same in DuckDB: sets of shingles, pairs that share one, and what links reach.
OP7_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least ON least.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), 3, (85, 100))
