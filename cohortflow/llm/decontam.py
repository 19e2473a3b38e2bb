"""Operator 9: benchmark decontamination by CGK embedding and bit-sampling LSH.

Method: item and window words walk through the CGK embedding (at every step
the current word is written down, and a random bit of (step, word) decides
whether to go on to the next word), which maps small edit distance to small
Hamming distance. Each of several walks is sampled at a few random places per
repetition; windows as long as an item that agree with it in one repetition
are candidates, and an exact word edit distance against the best place near
the window decides. Repetitions are set by the target recall. The random bits
are hashed from walk, step and word, so no table of them is kept.

Windows are embedded only where they can lie within the distance: with at most
``k`` edits an item of ``n`` words leaves a run of ``(n - k) / (k + 1)`` words
unchanged, so a window is taken where a run of that many (three at most)
words of an item stands in the document, at the start which this run implies,
and where as many known runs stand as ``k`` edits must leave. This loses no
window.

Items of fewer than ``min_words`` words allow no edit. With ``short_items``
they are matched exactly, as runs of words; without it they match nothing,
which suits a filter, where a word or two are no evidence of a leak.

Plan: one map over the documents per block of items; a document never leaves
its task whole, and only matches come out. Items are a stated query set, sent
to the tasks in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES``
bytes. Walks are worked out by at most ``CELLS`` steps times windows, and
texts searched by at most ``PART_WORDS`` words with the gaps between them, so
memory does not grow with the longest item times the vocabulary.

Defined results: null items and items without words match nothing; null or
empty documents hold nothing; repeated documents or items each give their
rows; other columns are ignored; empty tables give no rows. An item and a
document give one row, the best place; of a short item the first.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import by_value

by_value(__name__)

MAX_EDITS = 0.2            # of the item's words: similarity 0.8
MIN_WORDS = 5
TARGET_RECALL = 0.99
AGREE = 0.5                # share of a walk that two windows at the limit are taken to agree on; the tests measure the recall it gives
SAMPLES = 3                # places per repetition
WALKS = 8
BLOCK_ITEMS = 10_000
BLOCK_BYTES = 16 << 20
RUN = 3
CELLS = 4_000_000          # steps times windows embedded at once
PART_WORDS = 2_000_000     # words searched at once, gaps included


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def repetitions(recall: float = TARGET_RECALL, agree: float = AGREE, samples: int = SAMPLES) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree ** samples))


def coin(words: np.ndarray, step: int, walk: int) -> np.ndarray:
    """A random bit per word, the same for the same walk, step and word."""
    x = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step + 1) * 0xD1342543DE82EF95 + (walk + 1) * 0xAF251AF3B0F025B5 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(63)).astype(np.int64)


def cgk(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """Embedding, one column per window of ``text``; row t is the word read at step t, zero after the window."""
    steps = 3 * int(lengths.max())
    at, out = np.zeros(len(starts), np.int64), np.zeros((steps, len(starts)), np.int32)
    for t in range(steps):
        pos = starts + at
        inside = (at < lengths) & (pos >= 0) & (pos < len(text))
        out[t] = np.where(inside, text[np.where(inside, pos, 0)], 0)
        at += coin(out[t], t, walk)
    return out


def _by_cells(lengths: np.ndarray):
    """Places of windows in parts of at most ``CELLS`` cells (one window at least), windows of like length together."""
    order = np.argsort(lengths, kind="stable")
    while len(order):
        n = max(1, int(np.searchsorted(3 * lengths[order] * np.arange(1, len(order) + 1), CELLS, "right")))
        yield order[:n]
        order = order[n:]


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any run of words of ``text``, and where that run ends."""
    row, steps = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (text != w), out=new[1:])
        new[0] = i
        row = np.minimum.accumulate(new - steps) + steps     # words of the text left over
    end = int(row.argmin())
    return int(row[end]), end


def _together(near: list[np.ndarray], lengths: np.ndarray):
    """(item, first start, last start) of candidate windows of one item that overlap."""
    if not near:
        return
    c = np.unique(np.concatenate(near), axis=0)
    if not len(c):
        return
    new = np.r_[True, (c[1:, 0] != c[:-1, 0]) | (c[1:, 1] - c[:-1, 1] > lengths[c[1:, 0]])]
    at = np.flatnonzero(new)
    yield from zip(c[at, 0].tolist(), c[at, 1].tolist(), c[np.r_[at[1:], len(c)] - 1, 1].tolist())


class Items:
    """Items of a block, with their runs of words and their keys."""

    def __init__(self, rows, max_edits: float, min_words: int, recall: float, agree: float, short_items: bool = False):
        self.vocab: dict[str, int] = {}
        self.rows = []                  # item id, words, edits allowed, run length
        short: dict[int, list] = {}     # by length: items to be matched exactly
        for item_id, text in rows:
            w = split_words(text)
            if len(w) < min_words and not (short_items and w):
                continue
            ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64)
            if len(w) < min_words:
                short.setdefault(len(w), []).append((item_id, ids))
            else:
                k = int(max_edits * len(w) + 1e-9)
                self.rows.append((item_id, ids, k, max(1, min(RUN, (len(w) - k) // (k + 1)))))
        self.base = np.int64(len(self.vocab) + 1)
        self.short = {}                 # by length: codes in order, their items, the items' words
        for n, found in short.items():
            ids = np.stack([x for _, x in found])
            codes = np.concatenate([self.code(x, n) for x in ids])
            order = np.argsort(codes, kind="stable")
            self.short[n] = codes[order], [found[i][0] for i in order], ids[order]
        if not self.rows:
            return
        self.lengths = np.array([len(ids) for _, ids, _, _ in self.rows])
        self.edits = {len(ids): (k, q) for _, ids, k, q in self.rows}
        self.runs = {}                  # run length: codes, their first row and count in (code, item length, place in item)
        for q in range(1, RUN + 1):
            found = {(int(c), len(ids), s) for _, ids, _, run in self.rows if run == q
                     for s, c in enumerate(self.code(ids, q))}
            if found:
                a = np.array(sorted(found), np.int64)
                self.runs[q] = (*np.unique(a[:, 0], return_index=True, return_counts=True), a)
        rng = np.random.default_rng(9)
        # sampled places of every length, walk and repetition
        self.reps = -(-repetitions(recall, agree) // WALKS)
        share = rng.random((WALKS, self.reps, SAMPLES))
        self.places = lambda lengths, w, r: (share[w, r][:, None] * 3 * lengths).astype(np.int64)
        text, starts = np.concatenate([ids for _, ids, _, _ in self.rows]), np.cumsum(self.lengths) - self.lengths
        keys = {(w, r): np.zeros(len(starts), np.uint64) for w in range(WALKS) for r in range(self.reps)}
        for part in _by_cells(self.lengths):
            for wr, key in self.sampled(text, starts[part], self.lengths[part]):
                keys[wr][part] = key
        self.tables = {wr: self._table(key) for wr, key in keys.items()}

    @staticmethod
    def _table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def code(self, ids: np.ndarray, q: int) -> np.ndarray:
        """One number per run of q words."""
        n = max(0, len(ids) - q + 1)
        c = np.zeros(n, np.int64)
        for j in range(q):
            c = c * self.base + ids[j:j + n]
        return c

    def sampled(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Per walk and repetition a key for every window: its length and the sampled words."""
        cols = np.arange(len(starts))
        for w in range(WALKS):
            e = cgk(text, starts, lengths, w)
            for r in range(self.reps):
                key = lengths.astype(np.uint64)
                for place in self.places(lengths, w, r):
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + e[place, cols].astype(np.uint64)
                yield (w, r), key

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """(start, length) of the windows that can be close to an item of that length."""
        out = []
        for q, (codes, first, count, a) in self.runs.items():
            c = self.code(ids, q)
            known = ids > 0
            at = np.flatnonzero(np.logical_and.reduce([known[j:len(c) + j] for j in range(q)])) if len(c) else c
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(codes, c[at]), len(codes) - 1)
            hit = codes[k] == c[at]
            at, k = at[hit], k[hit]
            if not len(at):
                continue
            n = count[k]
            rows = np.repeat(first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair = np.unique(np.stack([np.repeat(at, n) - a[rows, 2], a[rows, 1]], 1), axis=0)
            # k edits leave n - q + 1 - kq of the item's runs, so the window holds that many known runs
            held = np.zeros(len(ids) + 1, np.int64)
            held[at + 1] = 1
            held = np.cumsum(held)
            edits = np.array([self.edits.get(x, (0, 0))[0] for x in range(int(pair[:, 1].max()) + 1)])[pair[:, 1]]
            lo = np.clip(pair[:, 0] - edits, 0, len(ids))
            hi = np.clip(pair[:, 0] + pair[:, 1] + edits, 0, len(ids))
            out.append(pair[held[hi] - held[lo] >= np.maximum(1, pair[:, 1] - q + 1 - edits * q)])
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def search_short(self, texts: list[np.ndarray]) -> list[tuple]:
        """As ``search``, for the items that are matched exactly: the first place of each in every text."""
        out = []
        for n, (codes, items, words) in self.short.items():
            for t, ids in enumerate(texts):
                c = self.code(ids, n)
                a = np.searchsorted(codes, c, "left")
                at = np.flatnonzero(codes[np.minimum(a, len(codes) - 1)] == c)
                new = np.sort(at[np.unique(c[at], return_index=True)[1]])        # a code's first place (codes may wrap: see below)
                for p in new.tolist() if self.exact(n) else at.tolist():
                    for m in range(int(a[p]), int(np.searchsorted(codes, c[p], "right"))):
                        if (words[m] == ids[p:p + n]).all():
                            out.append((t, m, n, p))
        first = {}
        for t, m, n, p in sorted(out, key=lambda x: x[3]):
            first.setdefault((t, n, m), (t, self.short[n][1][m], 0, n, p, p + n))
        return [first[x] for x in sorted(first)]

    def exact(self, n: int) -> bool:
        """Whether runs of n words have codes of their own; beyond that codes may meet, and every place is looked at."""
        return int(self.base) ** n < 1 << 63

    def search(self, texts: list[np.ndarray]) -> list[tuple]:
        """(text, item id, edits, words, first word, word after the last) of every item within its distance, best place."""
        out = self.search_short(texts) if self.short else []
        if not self.rows:
            return out
        at, size, gap = 0, 0, 2 * int(self.lengths.max())
        for n, t in enumerate(texts):
            if size and size + gap + len(t) > PART_WORDS:
                out += [(at + f[0], *f[1:]) for f in self.search_close(texts[at:n])]
                at, size = n, 0
            size += gap + len(t)
        return out + [(at + f[0], *f[1:]) for f in self.search_close(texts[at:])]

    def search_close(self, texts: list[np.ndarray]) -> list[tuple]:
        """As ``search``, for the items that allow edits."""
        if not texts:
            return []
        gap = np.zeros(2 * int(self.lengths.max()), np.int64)       # no window reaches the next text
        ids = np.concatenate([x for t in texts for x in (gap, t)])
        ends = np.cumsum([len(gap) + len(t) for t in texts])
        near: list[np.ndarray] = []
        pairs = self.windows(ids)
        for places in _by_cells(pairs[:, 1]):
            part = pairs[places]
            for wr, key in self.sampled(ids, part[:, 0], part[:, 1]):
                keys, order = self.tables[wr]
                a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = b - a
                rows = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                near.append(np.stack([order[rows], np.repeat(part[:, 0], n)], 1))
        best: dict[tuple[int, int], tuple] = {}
        for m, first, last in _together(near, self.lengths):
            item_id, item, k, _ = self.rows[m]
            n = int(np.searchsorted(ends, first + len(item) // 2, "right"))     # the text of the window's middle
            if n == len(texts):
                continue
            begin = int(ends[n]) - len(texts[n])
            lo, hi = max(begin, first - k), min(int(ends[n]), last + len(item) + k)
            d, end = best_place(item, ids[lo:hi])
            if d <= k and ((n, m) not in best or d < best[n, m][2]):
                _, back = best_place(item[::-1], ids[max(lo, lo + end - len(item) - k):lo + end][::-1])
                best[n, m] = (n, item_id, d, len(item), lo + end - back - begin, lo + end - begin)
        return [best[x] for x in sorted(best)]


def _parts(batch, most: int = 8 << 20):
    """Rows (id, text) of a batch by parts of about ``most`` bytes; null texts left out."""
    part, size = [], 0
    for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        if t.is_valid:
            part.append((d, t.as_py()))
            size += len(part[-1][1])
            if size >= most:
                yield part
                part, size = [], 0
    if part:
        yield part


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS,
          min_words: int = MIN_WORDS, recall: float = TARGET_RECALL, agree: float = AGREE, short_items: bool = False,
          block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, item_words, first_word, end_word (best place)."""
    q = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    n, size = q.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    id_kind, item_kind = (x.dataType.simpleString() for x in (src.schema["doc_id"], q.schema["item_id"]))
    schema = f"doc_id {id_kind}, item_id {item_kind}, edits int, item_words int, first_word bigint, end_word bigint"
    fields = to_arrow_schema(_parse_datatype_string(schema))
    out = None
    for b in range(blocks):
        # one block of the stated query set, bounded by its parameters
        rows = [tuple(r) for r in q.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {b}")).collect()]
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            import pyarrow as pa

            block = Items(sent.value, max_edits, min_words, recall, agree, short_items)
            get = block.vocab.get
            for batch in batches:
                for part in _parts(batch):
                    found = block.search([np.array([get(w, 0) for w in split_words(t)], np.int64) for _, t in part])
                    cols = list(zip(*[(part[f[0]][0], *f[1:]) for f in found])) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], fields.names)

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
