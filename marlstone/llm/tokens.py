"""Encoding whole texts with a tokenizers file, fast: distinct stretches are encoded once per worker and looked up after that.

Byte-level BPE of this family never joins what stands before a white space with what follows after a visible character, so a text
may be cut at each change from visible to white space; the ids of the whole are those of the stretches in a row. Texts in which a
token is spelt out that the file adds to the vocabulary (an end mark, say) go to the library whole, which makes one id of it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import text_parts

#: White space of Unicode, as the tokenizer's pattern has it.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
STRETCH = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: Texts with these take the general way; in others, stretches begin at each single space or line feed.
PAIRS, WIDE = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\0", "\x0b", "\x0c"), re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Beyond so many distinct stretches the lookup forgets those seen once, and all but half of its places; this bounds a worker's memory.
MOST_STRETCHES = 800_000
BATCH_BYTES = 2_000_000


def unusual(text: str) -> bool:
    """Whether the text has white space other than single spaces and line feeds. Searching for one thing at a time is three times as fast as a pattern."""
    for p in PAIRS:
        if p in text:
            return True
    return not text.isascii() and WIDE.search(text) is not None


class _Index(dict):
    """Numbers stretches as they come."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(map(re.escape, added))) if added else None
        vocab = self.tokenizer.get_vocab()
        self.vocab_size = max(vocab.values()) + 1
        self.n_bytes = np.zeros(self.vocab_size, np.int64)
        for token, i in vocab.items():  # a byte-level token has one character for each byte
            self.n_bytes[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        self.index, self.flat, self.starts, self.sizes, self.hits = _Index(), array("I"), array("q"), array("q"), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the stretches seen most often."""
        hits = np.pad(self.hits, (0, len(self.index) - len(self.hits)))
        kept = np.flatnonzero(hits > 1)
        if len(kept) > MOST_STRETCHES // 2:
            kept = np.sort(kept[np.argsort(-hits[kept], kind="stable")[: MOST_STRETCHES // 2]])
        keys, starts, sizes, flat = list(self.index), np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int64)[kept], np.frombuffer(self.flat, np.uint32)
        first = np.cumsum(sizes) - sizes
        ids = flat[np.repeat(starts[kept] - first, sizes) + np.arange(int(sizes.sum()))]
        self._reset()
        for i in kept.tolist():
            self.index[keys[i]] = len(self.index)
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.starts.frombytes(first.astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.hits = hits[kept] // 2

    def _learn(self) -> None:
        """Encodes the new stretches. Their ids stand in the order in which the library gives them; starts and sizes say where, so nothing is cut up."""
        new, self.index.new = self.index.new, []
        joined, alone = [], []
        for i, w in enumerate(new):
            (joined if w and w[0] in " \n" and w[-1] > " " and not w[-1].isspace() else alone).append(i)
        starts, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        groups = [joined[at : at + 3000] for at in range(0, len(joined), 3000)]
        texts = [[new[i] for i in g] for g in groups]
        coded = self.tokenizer.encode_batch_fast(["".join(t) for t in texts], add_special_tokens=False)
        for group, own, code in zip(groups, texts, coded, strict=True):
            ids = np.array(code.ids, np.uint32)
            ends = np.cumsum(np.asarray(pc.binary_length(pa.array(own, pa.string())), np.int64))
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, side="left") + 1
            sizes[group] = n = np.diff(cuts, prepend=0)
            starts[group] = len(self.flat) + cuts - n
            self.flat.frombytes(ids.tobytes())
        for i, code in zip(alone, self.tokenizer.encode_batch_fast([new[i] for i in alone], add_special_tokens=False), strict=True):
            starts[i], sizes[i] = len(self.flat), len(code.ids)
            self.flat.extend(code.ids)
        self.starts.frombytes(starts.tobytes())
        self.sizes.frombytes(sizes.tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if len(self.index) > MOST_STRETCHES:
            self._forget()
        look, rows = self.index.__getitem__, []
        marked = {i: self.whole(t) for i, t in enumerate(texts) if self.marks and self.marks.search(t)}
        for i, t in enumerate(texts):
            if i in marked:
                rows.append(np.zeros(0, np.int64))
                continue
            parts = STRETCH.findall(t) if unusual(t) else t.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            rows.append(np.fromiter(map(look, parts), np.int64, len(parts)))
        if self.index.new:
            self._learn()
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        starts, sizes, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int64), np.frombuffer(self.flat, np.uint32)
        n = sizes[at] if len(at) else at
        self.hits = np.bincount(at, minlength=len(self.index)) + np.pad(self.hits, (0, len(self.index) - len(self.hits)))
        before = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[at] - before[:-1], n) + np.arange(before[-1])] if len(at) else np.zeros(0, np.uint32)
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
        sizes = np.diff(before[ends], prepend=0)
        if marked:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, own in marked.items():
                parts[i], sizes[i] = own, len(own)
            ids = np.concatenate(parts)
        return ids, sizes

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """From batches of (doc_id, text): doc_ids, all their ids in a row with end behind each document, and each document's number of ids. Null texts count as empty."""
    tool = encoder(path)
    for batch in batches:
        docs = batch.column(0).to_pylist()
        for at, texts in text_parts(batch, 1, BATCH_BYTES):
            ids, n = tool.encode([t or "" for t in texts])
            yield docs[at : at + len(texts)], np.insert(ids, np.cumsum(n), end), n + 1
