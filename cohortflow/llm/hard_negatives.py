"""Operator 12: hard negatives by Strassen products of anchor and candidate tiles.

Method: vectors become int64; the scores of a tile of anchors against a tile of
candidates are one matrix product, computed by Strassen's recursion (odd sides
padded with zeros, all additions in int64, so every score is exact). Each task
keeps heaps per anchor over the tiles it sees: first the best rows of the
anchor's own label (positives), then, with the positives known, per positive
the best rows of other labels whose score lies in the positive's window. Heaps
of tasks are merged per anchor.

Plan: the anchors are the stated query set. They go out in blocks of at most
``BLOCK_BYTES``; a block meets all candidates in one pass of a map over the
candidate table, so neither a join nor a group by label occurs and a hot label
is a column value like any other. A pass costs 64 multiplications an anchor and
row, thousands of times what reading the row costs, so the number of passes
does not decide the time. Candidates are dealt to as many tasks as the cluster
has cores, whatever their number: heaps sent are tasks x anchors x their size.

Leaf products run in float64 where the largest possible sum stays below 2^53
(then they are exact), else in int64. Scores are exact while they fit a long;
beyond that they count modulo 2^64.

Defined results: rows without an id or label, without a vector, or with a null
or non-finite component take no part; a vector shorter than others counts as
padded with zeros; repeated ids are rows of their own, ordered by id, then by
score only; other columns are ignored; no anchors or no candidates: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, stage

by_value(__name__)

#: Rows or columns below which Strassen's recursion hands over to the plain product.
LEAF = 32
#: Bytes of one block of anchors as int64.
BLOCK_BYTES = 8 << 20
#: Anchors and candidates of one tile.
TILE = 1024
NO_ID = np.iinfo(np.int64).max
NO_SCORE = np.iinfo(np.int64).min


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in int64 (modulo 2^64); by float64 where that is exact."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for int64 matrices by Strassen's seven products."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return product(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * i, 2 * l), np.int64)
    c[:i, :l] = p1 + p4 - p5 + p7
    c[:i, l:] = p3 + p5
    c[i:, :l] = p2 + p4
    c[i:, l:] = p1 - p2 + p3 + p6
    return c[:m, :n]


def padded(rows: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as an int64 matrix, short rows padded with zeros, cut or widened to ``width``."""
    size = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(rows), max(int(size.max(initial=0)), width or 0)), np.int64)
    out[np.repeat(np.arange(len(rows)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out if width is None else out[:, :width]


class Heaps:
    """For every slot the ``size`` best (score, id), best first: higher scores, then smaller ids."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.score = np.full((slots, size), NO_SCORE, np.int64)
        self.id = np.full((slots, size), NO_ID, np.int64)

    def least(self) -> np.ndarray:
        """The score that a row must at least have to enter a slot."""
        return self.score[:, -1]

    def merge(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offers rows to their slots."""
        if not len(slot):
            return
        touched = np.unique(slot)
        own = np.repeat(touched, self.size)
        slot = np.r_[own, slot]
        score = np.r_[self.score[touched].ravel(), score]
        ids = np.r_[self.id[touched].ravel(), ids]
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, touched)
        at = first[:, None] + np.arange(self.size)
        self.score[touched], self.id[touched] = score[at], ids[at]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero((self.id != NO_ID) | (self.score != NO_SCORE))
        return slot, self.score[slot, place], self.id[slot, place]


def _tiles(batches, width: int):
    """(row keys, ids, labels, vectors as columns) of tiles of candidates."""
    for b in batches:
        for at in range(0, b.num_rows, TILE):
            t = b.slice(at, TILE)
            yield (*(t.column(i).to_numpy(zero_copy_only=False) for i in range(3)),
                   np.ascontiguousarray(padded(t.column(3), width).T))


def _positives(block: dict, size: int):
    """Task function: the best rows of each anchor's own label, but the anchor itself."""
    key, label, v = block["key"], block["label"], block["v"]

    def run(batches):
        heaps = Heaps(len(key), size)
        for r, ids, labels, x in _tiles(batches, v.shape[1]):
            for a in range(0, len(key), TILE):
                z = slice(a, a + TILE)
                s = strassen(v[z], x)
                ok = (labels == label[z, None]) & (s >= heaps.least()[z, None]) & (r != key[z, None])
                slot, at = np.nonzero(ok)
                heaps.merge(a + slot, s[slot, at], ids[at])
        slot, score, ids = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(key[slot]), pa.array(score), pa.array(ids)], ["r", "score", "id"])

    return run


def _windows(block: dict, size: int, low: int, high: int):
    """Task function: per positive the best rows of other labels with low% to high% of its score."""
    key, label, v, slots, p = block["key"], block["label"], block["v"], block["slots"], block["positive"]
    # low * p <= 100 * score <= high * p, as bounds on the score; slots: the anchor of every positive, ascending
    lo, hi = -((-low * p) // 100), (high * p) // 100

    def run(batches):
        heaps = Heaps(len(slots), size)
        first = np.searchsorted(slots, np.arange(len(key) + 1))
        for _, ids, labels, x in _tiles(batches, v.shape[1]):
            for a in range(0, len(key), TILE):
                s = strassen(v[a:a + TILE], x)
                other = labels != label[a:a + TILE, None]
                begin, end = first[a:a + TILE + 1][:len(s)], first[a + 1:a + TILE + 1]
                for j in range(int((end - begin).max(initial=0))):     # the j-th positive of every anchor that has one
                    has = np.flatnonzero(begin + j < end)
                    q, part = begin[has] + j, s[has]
                    ok = other[has] & (part <= hi[q, None]) & (part >= np.maximum(lo[q], heaps.least()[q])[:, None])
                    row, at = np.nonzero(ok)
                    heaps.merge(q[row], part[row, at], ids[at])
        slot, score, ids = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(key[slots[slot]]), pa.array(block["nth"][slot]), pa.array(score), pa.array(ids)],
                                         ["r", "nth", "score", "id"])

    return run


def _best(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """Merges the heaps of the tasks: at most tasks x size rows meet per group."""
    return rows.groupBy(*by).agg(F.expr(
        f"slice(array_sort(collect_list(struct(score, id)), (x, y) -> CASE WHEN x.score > y.score THEN -1 "
        f"WHEN x.score < y.score THEN 1 WHEN x.id < y.id THEN -1 WHEN x.id > y.id THEN 1 ELSE 0 END), 1, {size})").alias("best"))


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and the vector's components (v) of the rows that take part."""
    finite = "forall(v, c -> c IS NOT NULL AND NOT isnan(CAST(c AS DOUBLE)) AND abs(CAST(c AS DOUBLE)) < CAST('Infinity' AS DOUBLE))"
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                       F.col(f"`{vector_col}`").alias("v")).where(
        f"id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND coalesce({finite}, false)")


def hard_negatives(rows: DataFrame, is_anchor, id_col: str = "id", vector_col: str = "v", label_col: str = "label",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` hold integer vectors (array<bigint>) without nulls; ``is_anchor`` is a condition on the id.
    """
    spark = rows.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    src = stage(rows.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                            F.col(vector_col).alias("v")), "negatives-rows")
    width = src.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    anchors = src.where(is_anchor)
    # blocks by equal numbers of rows: positions from counts per partition would need a sort; a hash of the row deals evenly
    n = anchors.count()
    per = max(1, block_bytes // (8 * max(1, width)))
    blocks = -(-n // per)
    anchors = stage(anchors.withColumn("block", F.expr(f"CAST(pmod(xxhash64(r), {max(1, blocks)}) AS INT)")), "negatives-anchors")
    candidates = src.select("r", "id", "label", "v").coalesce(tasks)
    pos_parts, neg_parts = [], []
    for k in range(blocks):
        got = anchors.where(F.col("block") == k).select("r", "id", "label", "v").toArrow().combine_chunks()
        block = {"key": got["r"].to_numpy(), "label": got["label"].to_numpy(), "v": padded(got["v"].combine_chunks(), width)}
        if not len(block["key"]):
            continue
        found = candidates.mapInArrow(_positives(block, positives), "r bigint, score bigint, id bigint")
        best = stage(_best(found, ["r"], positives).select("r", F.posexplode("best").alias("nth", "p"))
                     .select("r", "nth", F.col("p.score").alias("positive_score"), F.col("p.id").alias("positive_id")), "positives")
        pos_parts.append(best)
        p = best.select("r", "nth", "positive_score").toArrow().combine_chunks()     # at most `positives` rows an anchor of the block
        place = np.argsort(block["key"], kind="stable")
        block = {k2: x[place] for k2, x in block.items()}
        slot = np.searchsorted(block["key"], p["r"].to_numpy())
        order = np.lexsort((p["nth"].to_numpy(), slot))
        block |= {"slots": slot[order], "nth": p["nth"].to_numpy()[order], "positive": p["positive_score"].to_numpy()[order]}
        found = candidates.mapInArrow(_windows(block, negatives, low, high), "r bigint, nth int, score bigint, id bigint")
        neg_parts.append(stage(_best(found, ["r", "nth"], negatives).select("r", "nth", F.posexplode("best").alias("at", "q"))
                               .select("r", "nth", (F.col("at") + 1).cast("int").alias("rank"), F.col("q.id").alias("negative_id"),
                                       F.col("q.score").alias("negative_score")), "negatives"))
    if not neg_parts:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    pos, neg = pos_parts[0], neg_parts[0]
    for p in pos_parts[1:]:
        pos = pos.unionByName(p)
    for q in neg_parts[1:]:
        neg = neg.unionByName(q)
    return (neg.join(pos, ["r", "nth"]).join(anchors.select("r", F.col("id").alias("anchor_id")), "r")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label and v = floor(256 x) of every usable row; where 7 divides the id, the label moves on by one (of ten)."""
    x = usable(rows, id_col, vector_col, label_col)
    return x.select("id", F.expr("CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"),
                    F.expr("transform(v, c -> floor(256 * CAST(c AS DOUBLE)))").alias("v"))
