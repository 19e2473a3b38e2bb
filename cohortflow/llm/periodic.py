"""Operator 13: periodic runs of words, by a dictionary of basic factors.

Method: every stretch of 2^k words gets a name (equal stretches, equal names),
level by level, each from two names of the level below. Where a stretch comes
again at most twice its length later, the distance to that successor is a
proposed period; neighbouring places with one distance are one progression.
A proposal is extended both ways by jumps over the dictionary, and proposals
that grow into one run are one.

A run of period q and at least 4q words holds, at the level whose stretches are
q to 2q words long, a stretch with its successor q words later (the root of a
run is primitive, so nothing nearer), so every run is proposed. A proposed
distance of at most the stretch is the smallest period of what it spans; of
longer ones only those that the next level proposes too are runs of the wanted
length, so each level keeps the distances up to its own length.

Plan: one map over the rows, no shuffle. A document is worked on as a whole;
levels end as soon as no stretch comes twice, which in prose is after a few.
Memory follows the longest document.

Defined results: a null or empty text has no words and no runs; runs that
overlap are all returned, ordered by start, then period; a null id and repeated
rows keep their rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, words

by_value(__name__)

MIN_LENGTH = 6
MIN_EXPONENT = 4
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def names(symbols: list) -> np.ndarray:
    """Level 0: one number per distinct symbol."""
    known: dict = {}
    return np.fromiter((known.setdefault(s, len(known)) for s in symbols), np.int64, len(symbols))


def dictionary(level0: np.ndarray) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, ... words, up to the first level without a repeated one."""
    out = [level0]
    size = 1
    while True:
        low = out[-1]
        if len(low) <= size or int(low.max()) + 1 == len(low):
            return out
        pair = low[:-size] * (int(low.max()) + 1) + low[size:]
        out.append(np.unique(pair, return_inverse=True)[1])
        size *= 2


def successors(level: np.ndarray) -> np.ndarray:
    """Distance from every place to the next one of its name (0: none)."""
    order = np.argsort(level, kind="stable")
    same = level[order[1:]] == level[order[:-1]]
    gap = np.zeros(len(level), np.int64)
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _common(levels: list[np.ndarray], i: int, j: int, n: int) -> int:
    """Words that agree from i and from j (i < j) on."""
    got = 0
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        while j + got + size <= n and levels[k][i + got] == levels[k][j + got]:
            got += size
    return got


def _common_before(levels: list[np.ndarray], i: int, j: int) -> int:
    """Words that agree before i and before j (i < j)."""
    got = 0
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        while i - got - size >= 0 and levels[k][i - got - size] == levels[k][j - got - size]:
            got += size
    return got


def runs_of(symbols: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period.

    ``min_exponent`` is 4 or more: shorter repetitions need other levels.
    """
    if min_exponent < 4:
        raise ValueError("min_exponent must be at least 4")
    n = len(symbols)
    if n < min_length:
        return []
    levels, found = dictionary(names(symbols)), set()
    for k, level in enumerate(levels):
        size = 1 << k
        if size > n // 2 or int(level.max()) + 1 == len(level):
            break
        gap = successors(level)
        gap[gap > 2 * size] = 0
        # progressions: neighbouring places with one distance
        edge = np.flatnonzero(np.diff(gap)) + 1
        first, last = np.r_[0, edge], np.r_[edge, len(gap)]
        period = gap[first]
        # a longer distance is decided at the next level, a much shorter one was at the level before
        ok = (period <= size) & (2 * period > size)
        # what a progression spans already: a run needs min_exponent periods, and extension adds to it
        for a, p in zip(first[ok].tolist(), period[ok].tolist()):
            if p == 0:
                continue
            start = a - _common_before(levels, a, a + p)
            length = p + _common(levels, start, start + p, n)
            if length >= max(min_length, min_exponent * p):
                found.add((start, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(symbols: list, runs: list[tuple[int, int, int]]) -> list:
    """``symbols`` without those that a run repeats: of every run its first period stays."""
    if not runs:
        return symbols
    change = np.zeros(len(symbols) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [s for s, k in zip(symbols, keep.tolist()) if k]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; words from 0) and collapsed (the words that stay, joined by a space)."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    kind = src.schema["doc_id"].dataType.simpleString()
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, b.num_rows, 512):       # results of few documents at a time: texts can be long
                n_words, runs, rest = [], [], []
                for t in texts.slice(at, 512):
                    w = (t.as_py() or b"").split()     # of bytes: ASCII white space only
                    r = runs_of(w, min_length, min_exponent)
                    n_words.append(len(w))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in r])
                    rest.append(b" ".join(collapsed(w, r)).decode())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 512), pa.array(n_words, pa.int64()), pa.array(runs, runs_type), pa.array(rest, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return src.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id and text) where one document in ten, by the CRC of its id, ends in a repeated stretch of its own words."""
    x = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t")).withColumn(
        "h", F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")))
    x = x.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("t")))).withColumn("g", F.expr("h DIV 10"))
    x = x.withColumn("n", F.expr("coalesce(size(w), 0)")).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    x = x.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    changed = "array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[CAST(a + (i - a) % p AS INT)] END), ' ')"
    return x.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {changed} ELSE t END").alias("text"))
