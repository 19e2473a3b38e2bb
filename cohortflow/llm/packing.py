"""Operator 6: best-fit packing after Martello-Toth dominance reduction.

Method: documents are cut into pieces of at most ``capacity`` tokens. Pieces
of one length are alike, so the instance is the number of pieces per length
(at most ``capacity`` numbers). Dominance reduction fixes sets that no better
packing needs to break: a piece with the largest that fits beside it, when
that one fills the sequence exactly, or when no two pieces fit beside it, or
when it is as long as any two that do. What remains is packed best-fit in
order of falling length, many equal pieces at a time. The result is a list of
runs: ranks of one length, and the sequences and offsets they go to. Every
piece carries its token ids: a sequence is the ids of its pieces by offset.

Plan: one map turns texts into pieces (text never leaves it), which are written
down with a key of their own. Keys get their rank within their length from
windows over (length, salt) and the counts of the salts, so a length that a
third of all pieces share is split; token ids are moved once, two bytes a token
while the vocabulary allows, when the places are joined to them by key. Only the
counts per length, at most ``capacity`` numbers, meet in one task.

Defined results: a null or empty text is one piece of the end token; repeated
rows each are packed; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import unicodedata
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, stage

by_value(__name__)

CAPACITY = 4096
END_ID = 1
SALTS = 32
#: Distinct words whose ids a worker keeps: half of them as the older ones, of which those that come up again stay.
CACHE_WORDS = 700_000


class WordIds:
    """Ids of texts by a tokenizer that drops white space: word by word, remembered.

    White space always ends a word of this tokenizer, and so does the place
    between letters and closing marks, so the ids of a text are those of its
    words, and the ids of a word are those of its letters and of its marks.
    """

    MARKS = b".,;:!?*#$%&|"

    def __init__(self, path: str):
        import os

        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks use the cores
        # Spark reuses a worker process for many tasks: what one has learned helps the next
        kept = vars(tokenizers).setdefault("_known_words", {})
        if path not in kept:
            kept[path] = (tokenizers.Tokenizer.from_file(path), {}, {})
        self.tokenizer, self.known, self.older = kept[path]
        # the letter that stands for a byte in the vocabulary: printable ones themselves, the others from 256 on
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.letter = {b: 256 + n for n, b in enumerate(odd)}
        # two bytes a token while they hold all ids
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def _one_by_one(self, words: list[bytes]) -> dict[bytes, bytes]:
        got = self.tokenizer.encode_batch_fast([x.decode() for x in words], add_special_tokens=False)
        return {x: np.array(e.ids, self.kind).tobytes() for x, e in zip(words, got)}

    def learn(self, words: set[bytes]) -> None:
        """Add the ids of all words that are not known yet.

        Small letters below U+0100 pass the tokenizer's other steps as they are: its model alone is asked for them, by
        the letters that stand for their bytes.
        """
        known, older, marks, letter = self.known, self.older, self.MARKS, self.letter
        if len(known) > CACHE_WORDS // 2:
            older.clear()
            older.update(known)
            known.clear()
        ask, kind, get, old = self.tokenizer.model.tokenize, "H" if self.kind == "<u2" else "I", known.get, older.get
        other = []                               # (word, what the tokenizer is asked for, marks behind it)
        for w in words.difference(known):
            if (ids := old(w)) is not None:
                known[w] = ids
                continue
            core = w.rstrip(marks)
            if core.isalpha():                   # of bytes: ASCII letters
                small = core.lower()
                text = small.decode()
            else:
                text = "" if core.isascii() else unicodedata.normalize("NFC", core.decode()).lower()
                if not text.isalpha():           # one piece: marks may join what stands before them
                    other.append((w, w, b""))
                    continue
                if max(text) >= "\u0100":
                    other.append((w, core, w[len(core):]))
                    continue
                small = text.encode()
                text = small.decode("latin-1").translate(letter)
            if (ids := get(small)) is None:
                if (ids := old(small)) is None:
                    ids = array(kind, [t.id for t in ask(text)]).tobytes()
                known[small] = ids
            if len(core) < len(w):
                tail = w[len(core):]
                if (more := get(tail)) is None:
                    more = known[tail] = self._one_by_one([tail])[tail]
                ids += more
            known[w] = ids
        asked = list({x for _, c, t in other for x in (c, t)})
        for at in range(0, len(asked), 50_000):
            known.update(self._one_by_one(asked[at:at + 50_000]))
        known.update([(w, known[c] + known[t]) for w, c, t in other if w is not c])

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.split() for t in texts]       # ASCII white space
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), self.kind) for w in split]


def _parts(column, most: int = 4 << 20):
    """(first row, texts) of a column by parts of about ``most`` bytes; null texts are empty."""
    part, size, first = [], 0, 0
    for n, t in enumerate(column):
        part.append(t.as_py() or b"")
        size += len(part[-1])
        if size >= most:
            yield first, part
            part, size, first = [], 0, n + 1
    if part:
        yield first, part


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids of every piece of every document (ids: two bytes a token, lowest first, or four
    where the vocabulary needs them)."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ids = WordIds(tokenizer_path)
        for b in batches:
            for first, texts in _parts(b.column(1)):      # one batch a part: ids may be larger than their text
                rows, cols = [], [[], [], [], []]
                for n, x in enumerate(ids(texts), first):
                    kind = ids.kind if end_id < 1 << 16 else "<u4"
                    x = np.append(x.astype(kind), np.array(end_id, kind))
                    for p, at in enumerate(range(0, len(x), capacity)):
                        part = x[at:at + capacity]
                        rows.append(n)
                        for c, v in zip(cols, (p, at, len(part), part.tobytes())):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())),
                     *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary())))],
                    ["doc_id", "piece", "start", "length", "ids"])

    return src.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


class Packer:
    """Packs counts of lengths; ``runs`` gets (length, first rank, last rank, first sequence, per sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.counts, self.runs = capacity, dict(counts), []
        self.used = dict.fromkeys(counts, 0)
        self.lengths = sorted(counts)
        self.sequences = 0

    def take(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        """The next ``n`` pieces of a length go to sequences from ``sequence`` on, ``each`` to every one."""
        a = self.used[length]
        self.runs.append((length, a, a + n, sequence, each, offset))
        self.used[length] += n
        self.counts[length] -= n
        if not self.counts[length]:
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def fits(self, room: int) -> int | None:
        """The largest length left that is at most ``room``."""
        i = bisect.bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i else None

    def two_least(self) -> int:
        """The sum of the two shortest pieces left."""
        a = self.lengths[0]
        return 2 * a if self.counts[a] > 1 else a + self.lengths[1] if len(self.lengths) > 1 else 1 << 60

    def pair_at_most(self, room: int, least: int) -> bool:
        """Whether two pieces fit into ``room`` whose sum is over ``least``."""
        i, j = 0, bisect.bisect_right(self.lengths, room) - 1
        while i <= j:
            s = self.lengths[i] + self.lengths[j]
            if s > room:
                j -= 1
            elif s > least and (i < j or self.counts[self.lengths[i]] > 1):
                return True
            else:
                i += 1
        return False

    def reduce(self) -> None:
        """Fix dominating sets, longest pieces first."""
        cap = self.capacity
        for a in sorted(self.lengths, reverse=True):
            while (n := self.counts.get(a, 0)):
                room = cap - a
                if not room or not self.lengths or room < self.lengths[0]:
                    self.take(a, n, self.sequences, 1, 0)       # nothing fits beside it
                    self.sequences += n
                    continue
                b = self.fits(room)
                if b == a and n < 2:
                    i = bisect.bisect_left(self.lengths, a)
                    b = self.lengths[i - 1] if i else None
                if b is None:
                    break
                alone = self.two_least() > room
                if not (b == room or alone or (3 * self.lengths[0] > room and not self.pair_at_most(room, b))):
                    break
                if a == b:
                    m = n // 2
                    self.take(a, 2 * m, self.sequences, 2, 0)
                else:
                    # with an exact fit all go at once; else shorter partners may come up, so by the smaller count too
                    m = min(n, self.counts[b])
                    self.take(a, m, self.sequences, 1, 0)
                    self.take(b, m, self.sequences, 1, a)
                self.sequences += m

    def best_fit(self) -> None:
        """Pack what is left, longest first, into the fullest sequence that has room."""
        cap = self.capacity
        open_: dict[int, list[tuple[int, int]]] = {}     # by room: first sequence and number of them
        rooms: list[int] = []            # sorted rooms of open sequences

        def put(room: int, sequence: int, n: int) -> None:
            if room and n:
                if room not in open_:
                    bisect.insort(rooms, room)
                open_.setdefault(room, []).append((sequence, n))

        for a in sorted(self.lengths, reverse=True):
            while (n := self.counts.get(a, 0)):
                i = bisect.bisect_left(rooms, a)
                if i < len(rooms):
                    room = rooms[i]
                    sequence, m = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[i]
                else:
                    room, sequence = cap, self.sequences
                    m = -(-n // (cap // a))
                    self.sequences += m
                each = room // a
                whole = min(m, n // each)
                if whole:
                    self.take(a, whole * each, sequence, each, cap - room)
                    put(room - each * a, sequence, whole)
                rest = n - whole * each
                if rest and whole < m:
                    rest = min(rest, each)
                    self.take(a, rest, sequence + whole, rest, cap - room)
                    put(room - rest * a, sequence + whole, 1)
                    whole += 1
                put(room, sequence + whole, m - whole)


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Runs (see ``Packer``) for counts per length, and the number of sequences."""
    p = Packer(counts, capacity)
    p.reduce()
    p.best_fit()
    return p.runs, p.sequences


def _widened(batches):
    """Task function: token ids as four bytes each, and their checksum."""
    import zlib

    for b in batches:
        for at in range(0, b.num_rows, 1024):
            t = b.slice(at, 1024)
            ids = [np.frombuffer(v, f"<u{len(v) // n}").astype("<u4").tobytes()
                   for v, n in zip(t.column("ids").to_pylist(), t.column("length").to_pylist())]
            cols = {n: t.column(n) for n in ("doc_id", "piece", "start", "length")}
            cols |= {"ids": pa.array(ids, pa.binary()), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}
            cols |= {n: t.column(n) for n in ("sequence_id", "offset")}
            yield pa.RecordBatch.from_pydict(cols)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (four bytes a token, lowest first), ids_crc32, sequence_id, offset of every piece."""
    # copies of one document agree in all else: every piece is known by its place in the written table
    found = stage(pieces(docs, tokenizer_path, capacity, id_col, text_col, end_id)
                  .withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    dealt = found.select("_piece", "length", F.expr(f"CAST(pmod(xxhash64(_piece, 7), {SALTS}) AS INT)").alias("salt"))
    key = ["length", "salt"]
    salts = stage(dealt.groupBy(*key).agg(F.count("*").alias("n")), "pieces-counts")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        runs, _ = solve(dict(zip(frame["length"].tolist(), frame["n"].tolist())), capacity)
        return pd.DataFrame(runs, columns=["length", "a", "b", "sequence", "each", "place"])

    # one row per length, at most ``capacity``, whatever the number of pieces
    counts = salts.groupBy("length").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))
    runs = stage(counts.groupBy("all").applyInPandas(
        run, "length bigint, a bigint, b bigint, sequence bigint, each bigint, place bigint"), "packing-runs")
    by_length = runs.groupBy("length").agg(F.collect_list(F.struct("a", "b", "sequence", "each", "place")).alias("runs"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sides = (salts.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
             .join(by_length, "length"))
    inside = Window.partitionBy(*key).orderBy("_piece")
    ranked = dealt.withColumn("r", F.row_number().over(inside)).join(sides, key)
    ranked = ranked.withColumn("rank", F.col("n0") + F.col("r") - 1)
    ranked = ranked.withColumn("run", F.expr("filter(runs, x -> rank >= x.a AND rank < x.b)[0]"))
    placed = ranked.select(
        "_piece", F.expr("run.sequence + (rank - run.a) div run.each").alias("sequence_id"),
        F.expr("run.place + ((rank - run.a) % run.each) * length").alias("offset"))
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.join(placed, "_piece").select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset").mapInArrow(
        _widened, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, sequence_id bigint, offset bigint")
