"""Fixtures of documents for the operators' tests."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, h long, n int, rep long, part int, label int, _key string, _size long, toxic_score double, sig binary"


def table(spark, rows):
    """documents with extra columns whose names the operators use inside; rows: (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        doc, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r
        full.append((doc, text, lang, source, None if text is None else len(text), 1, "k", 2, 3, 4, 5, 6, "x", 7, 0.5, b"z"))
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text): plain texts, equal ones, near copies, short, empty and null ones, and one very long text."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randrange(30, 120))) for i in range(n)]
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(8)]
    for i in range(12):
        own = rows[i][1].split()
        own[rng.randrange(len(own))] = "changed"
        rows.append((200 + i, " ".join(own)))
    rows += [(300, ""), (301, None), (302, "  \t\n"), (303, "one"), (304, "one two"), (305, "ONE two"), (306, None), (307, words(rng, 20_000)), (308, "naïve café"), (309, "Naïve café"), (310, "É"), (311, "é")]
    return rows


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return (text or "").encode().lower().split()


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds
