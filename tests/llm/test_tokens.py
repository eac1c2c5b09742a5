import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marlstone.llm import packing, tokenfile, tokens

from .helpers import corpus, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "\ta b\t", "a b c  d", "I'm he's  don't", "x　y z", " a b", "a\0b c", "a b\x1c c", "<|endoftext|> <|endoftext|>", "hello <|endoftext|> there", "a<|endoftext|>b  <|ENDOFTEXT|>  <|endoftext|>\n", "<|endoftext|>", "naïve 你好 мир 😀 é́", "1234 56 7.8", "a\r\nb", "\n\n\n", "a \n", "ﬁ \x85 b", "!!! ???\n ...", "tab\there"]


@pytest.fixture(scope="module")
def plain():
    made = Tokenizer.from_file(PATH)
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain):
    rng = random.Random(1)
    bits = [*ODD, "the", " of", "\n", "  ", "Ünder", "don't"]
    texts = ODD + ["".join(rng.choice(bits) + rng.choice(["", " ", "\n", "\t"]) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    tool = tokens.Encoder(PATH)
    assert plain("hello <|endoftext|> there") == [31373, 220, 50256, 612]
    for _ in range(2):
        ids, n = tool.encode(texts)
        parts = np.split(ids, np.cumsum(n)[:-1])
        for t, p in zip(texts, parts, strict=True):
            assert p.tolist() == plain(t), repr(t)
    assert [len(x) for x in tool.encode([])] == [0, 0]


def test_new_stretches_are_not_cut_up_one_by_one(plain, monkeypatch):
    """Learning works on whole groups of stretches; a cut for each took about a fifth of the encoder's time."""

    def refused(*_):
        raise AssertionError("cut one by one")

    text = " ".join(f"w{i}x é{i}" for i in range(4000)) + "\n \n end"
    tool = tokens.Encoder(PATH)
    monkeypatch.setattr(tokens.np, "split", refused)
    for _ in range(2):
        ids, n = tool.encode([text, "two words", ""])
        assert ids.tolist() == plain(text) + plain("two words") and n.tolist() == [len(plain(text)), len(plain("two words")), 0]


def test_encoder_forgets_and_goes_on(plain, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_STRETCHES", 3)
    tool = tokens.Encoder(PATH)
    for t in ["a b c d e", "x y", "a b"]:
        assert tool.encode([t])[0].tolist() == plain(t)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 20, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = tokenfile.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (tokenfile.unpack(data, 1001, bits) == ids).all()


@pytest.mark.parametrize("bits", [16, 17])
def test_random_access(bits):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 5, 4096, 1, 10_000, 4095)]
    sink = pa.BufferOutputStream()
    out = tokenfile.Writer(sink, bits)
    for i, d in enumerate(docs):
        out.add(i, d)
    out.finish()
    file, whole = tokenfile.Reader(pa.BufferReader(sink.getvalue())), np.concatenate(docs)
    assert file.n == len(whole) and file.sizes.tolist() == [len(d) for d in docs]
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(whole) + 1, 2))
        assert (file.ids(int(a), int(b - a)) == whole[a:b]).all()


def test_files_against_the_library(spark, plain):
    rows = corpus() + [(400 + i, t) for i, t in enumerate(ODD)] + [(7, "again"), (None, "first")]
    found = tokenfile.token_file_round_trip(table(spark, rows), PATH, 2, docs_per_file=20)
    want, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array([*plain(r[1]), 2], "<u2").tobytes())):
        ids = [*plain(text), 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want
    assert found.rdd.getNumPartitions() > 3


def test_empty_table(spark):
    assert tokenfile.token_file_round_trip(table(spark, []), PATH, 2).count() == 0
    assert packing.pack_documents(table(spark, []), PATH, 0).count() == 0


@pytest.mark.parametrize(("cap", "per_part"), [(2048, 50_000), (64, 40), (7, 25)])
def test_packing(spark, plain, cap, per_part):
    rows = corpus() + [(7, "again"), (7, "again"), (None, "x")]
    found = packing.pack_documents(table(spark, rows), PATH, 0, cap, per_part=per_part).collect()
    want = []
    for doc, text in rows:
        ids = [*plain(text), 0]
        first = len(ids) if len(ids) <= cap else (len(ids) % cap or cap)
        cuts = [0, *range(first, len(ids), cap), len(ids)]
        want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    counts = np.bincount([w[3] for w in want], minlength=cap + 1)
    assert packing.lower_bound(counts) <= len(bins) <= packing.lower_bound(counts) * 1.04 + 2


def fewest(sizes, cap):
    """By trying all ways."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= cap and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bounds_hold_and_best_fit_packs():
    rng = random.Random(5)
    for _ in range(120):
        cap = rng.choice([10, 17, 30])
        sizes = sorted((rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        least = fewest(sizes, cap)
        assert packing.lower_bound(np.bincount(sizes, minlength=cap + 1)) <= least
        bins, fill = packing.best_fit(np.array(sizes), cap)
        assert fill.max() <= cap and len(fill) <= least * 11 / 9 + 1 and np.bincount(bins, weights=sizes).tolist() == fill.tolist()
    assert packing.lower_bound(np.bincount([6] * 5, minlength=11)) == 5
    assert packing.lower_bound(np.zeros(11, int)) == 0


def test_best_fit_is_best_fit():
    """The same bins as a plain search for the fullest bin that has room."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 101, 400)
    fills = []
    for s in sorted(sizes.tolist(), reverse=True):
        able = [f for f in fills if f + s <= 100]
        if able:
            fills.remove(max(able))
        fills.append((max(able) if able else 0) + s)
    assert sorted(packing.best_fit(sizes, 100)[1].tolist()) == sorted(fills)
