"""Operator 11: embedding near-duplicates by E8 lattice hashing.

Method: every table projects the unit vectors at random to eight dimensions,
scales them and moves each to its nearest point of the E8 lattice: its home
cell. It also probes the lattice neighbours nearest to it. Two vectors meet in
a table when one is at home in a cell where the other is at home or probes.
Those that meet are compared by 64 random signs first (the limit is 5 sigma
beyond what a pair at the wanted cosine has), then by exact cosine.

Plan: equal vectors are one row from the first shuffle on. Cells travel as
(cell, row, signs), without vectors. Only rows with a partner of close signs in
their cell fetch their vectors, by a join on the row, and meet once more. A cell
beyond ``MAX_BUCKET`` rows is known from a count before anything is dealt by
cell; its rows are dealt into blocks, and every pair of blocks is compared, so
no task holds more than two blocks. Tasks send counts of links per row and a
spanning forest of the links, never pairs. A pair that meets in several cells
counts in the first only: cells are worked out again from the vectors
(projections of rounded vectors by rounded matrices, sums of whole numbers
below 2^53, so they are the same in every batch).

Recall: two vectors at cosine ``min_cosine`` meet in one table with probability
0.50 (0.73 for half the angle's square less), whatever their dimension, as the
lattice is scaled to the distance of such a pair; six tables find 0.98 of them.
Unrelated vectors meet in 2 of 10,000 cases a table: the pairs of signs compared
per row (one instruction each) grow with the table; vectors are fetched only for
the 1 in 700 of them whose signs are close.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; equal
vectors always link; a null id keeps its row and counts for a component only if
all ids in it are null; repeated rows each keep their row and link; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, stage
from .components import components

by_value(__name__)

MIN_COSINE = 0.95
TABLES = 6
PROBES = 4
MAX_BUCKET = 4096
#: Rows of a cell that are compared by shifting the whole batch; larger cells by matrices.
SMALL = 8
SEED = 11
GRID = 2.0 ** 20


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, by their rule: two entries +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [[x / 2 for x in s] for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum."""
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    e = y[odd] - r[odd]
    worst = np.abs(e).argmax(axis=1)
    r[odd, worst] += np.where(e[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return r


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of every row: the better one of the even points and the even points moved by 1/2."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


class Lattice:
    """The hash tables for vectors of one length."""

    def __init__(self, dim: int, min_cosine: float, tables: int, probes: int):
        g = np.random.default_rng([SEED, dim])
        self.tables, self.probes = tables, probes
        # a pair at the wanted cosine lies sqrt(0.1) apart in every scaled coordinate
        self.scale = np.sqrt(0.05 / max(1e-9, 1 - min_cosine)) / (GRID * 2.0 ** 10)
        self.turn = np.rint(g.standard_normal((dim, 8 * tables)) * 2.0 ** 10)
        self.move = g.uniform(0, 4, 8 * tables)
        self.plane = np.rint(g.standard_normal((dim, 64)) * 2.0 ** 10)
        self.mix = g.integers(1, 2 ** 63, (tables, 8), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.neighbours = _neighbours()

    @staticmethod
    def whole(unit: np.ndarray) -> np.ndarray:
        """Unit vectors on a grid of whole numbers: their projections are exact, so the same in every batch."""
        return np.rint(unit * GRID)

    def signs(self, whole: np.ndarray) -> np.ndarray:
        return np.packbits(whole @ self.plane > 0, axis=1, bitorder="little").view(np.uint64).ravel()

    def cells(self, whole: np.ndarray, table: int) -> np.ndarray:
        """(rows, 1 + probes) cell numbers: home first, then the probed neighbours, nearest first."""
        at = slice(8 * table, 8 * table + 8)
        y = np.rint(((whole @ self.turn[:, at]) * self.scale + self.move[at]) * GRID) / GRID
        home = nearest(y)
        # the neighbours whose points are nearest to y are those most in the direction of what rounding left
        near = np.argpartition(-((y - home) @ self.neighbours.T), self.probes, axis=1)[:, :self.probes]
        points = np.concatenate([home[:, None, :], home[:, None, :] + self.neighbours[near]], axis=1)
        z = ((2 * points).astype(np.int64).astype(np.uint64) * self.mix[table]).sum(axis=2, dtype=np.uint64)
        z ^= z >> np.uint64(31)
        return (z * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length, column by column, so that a row's result does not hang on its batch."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        total += x[:, c] * x[:, c]
    return x / np.sqrt(total)[:, None]


def _matrices(vectors: pa.Array, kind: str):
    """(row numbers, matrix) for every length of vector among binary rows."""
    size = pc.binary_length(vectors).to_numpy(zero_copy_only=False)
    values = vectors.to_pylist()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(values[i] for i in at), kind).reshape(len(at), -1)


def _whole_cells(batches, key: int = 0):
    """Batches of rows sorted by a key, cut so that all rows of one key are together."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.concat_batches([held, b])
        k = b.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1]))
        if last:
            yield b.slice(0, last)
        held = b.slice(last)
    if held is not None and held.num_rows:
        yield held


def _pairs(key: np.ndarray, close):
    """Arrays of row pairs (i, j) with equal key for which close(i, j) holds, a bounded number at a time; rows are sorted by key."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for s in range(1, SMALL):
        i, j = small[:-s], small[s:]
        i, j = i[same := key[i] == key[j]], j[same]
        if len(i):
            ok = close(i, j)
            yield i[ok], j[ok]
    for a, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        for x in range(0, n, 512):
            i0 = np.arange(a + x, a + min(n, x + 512))
            for y in range(x, n, 512):
                j0 = np.arange(a + y, a + min(n, y + 512))
                i, j = (m.ravel() for m in np.broadcast_arrays(i0[:, None], j0[None, :]))
                if x == y:
                    i, j = i[keep := i < j], j[keep]
                ok = close(i, j)
                yield i[ok], j[ok]


def _distinct_rows(kind: str):
    """Task function: (id, vector, digest) of every row; vector and digest are null where it links with nothing."""

    def run(batches):
        for b in batches:
            out, digest = [], []
            for v in b.column(1):
                x = v.as_py()
                ok = bool(x) and None not in x
                a = np.array(x, kind) + 0.0 if ok else None      # + 0.0: no negative zeros
                ok = ok and bool(np.isfinite(a).all()) and bool(a.any())
                out.append(a.astype(kind).tobytes() if ok else None)
                digest.append(hashlib.blake2b(out[-1], digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(digest, pa.binary())], ["id", "v", "digest"])

    return run


def _cell_rows(kind: str, make):
    """Task function: (cell, home, k, signs) of every vector, its home and its probes in every table."""

    def run(batches):
        made: dict = {}
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            for at, x in _matrices(b.column(1), kind):
                h = made.get(x.shape[1]) or made.setdefault(x.shape[1], make(x.shape[1]))
                w = h.whole(unit(x))
                signs = h.signs(w).view(np.int64)
                for t in range(h.tables):
                    c = h.cells(w, t)
                    n = c.shape[1]
                    home = np.zeros(c.shape, bool)
                    home[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.ravel()), pa.array(home.ravel()), pa.array(np.repeat(k[at], n)), pa.array(np.repeat(signs, n))],
                        ["cell", "home", "k", "signs"])

    return run


def _close_signs(most: int):
    """Task function over rows sorted by cell: those with a partner of close signs that is at home, or any if they are."""

    def run(batches):
        for b in _whole_cells(batches):
            cell, home = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            s = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            keep = np.zeros(len(cell), bool)
            for i, j in _pairs(cell, lambda i, j: (home[i] | home[j]) & (np.bitwise_count(s[i] ^ s[j]) <= most)):
                keep[i] = keep[j] = True
            at = pa.array(np.flatnonzero(keep))
            yield b.take(at).select(["cell", "home", "k"]) if len(at) else b.slice(0, 0).select(["cell", "home", "k"])

    return run


def _verify(kind: str, make, min_cosine: float):
    """Task function over rows (key, cell, home, k, v, n, block, split) sorted by key: link counts and forest links.

    Yields (k, other, n): n rows linked to k, or, with ``other``, a link of the forest.
    """

    def run(batches):
        made: dict = {}
        for b in _whole_cells(batches):
            key = b.column(0).to_numpy(zero_copy_only=False)
            cell, k = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
            home = b.column(2).to_numpy(zero_copy_only=False)
            copies, block, split = (b.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7))
            for rows, x in _matrices(b.column(4), kind):
                h = made.get(x.shape[1]) or made.setdefault(x.shape[1], make(x.shape[1]))
                u = unit(x)
                kk, cc, hh, bb, sp, nn, ke = k[rows], cell[rows], home[rows], block[rows], split[rows], copies[rows], key[rows]

                def close(i, j):
                    ok = (hh[i] | hh[j]) & (kk[i] != kk[j]) & (~sp[i] | (bb[i] != bb[j]))
                    at = np.flatnonzero(ok)
                    for a in range(0, len(at), 65_536):      # bounded memory: pairs times dimensions
                        z = at[a:a + 65_536]
                        ok[z] = np.einsum("ij,ij->i", u[i[z]], u[j[z]]) >= min_cosine
                    return ok

                count, root = np.zeros(len(kk), np.int64), np.arange(len(kk))
                cells = None
                for i, j in _pairs(ke, close):
                    if not len(i):
                        continue
                    if cells is None:
                        w = h.whole(u)
                        cells = [h.cells(w, t) for t in range(h.tables)]
                    first = _first_meeting(cells, cc, i, j)
                    np.add.at(count, i[first], nn[j[first]])
                    np.add.at(count, j[first], nn[i[first]])
                    _join(root, i, j)
                got = np.flatnonzero(count)
                tree = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[kk[got], kk[tree]]), pa.array(np.r_[np.zeros(len(got), np.int64), kk[root[tree]]], mask=np.r_[np.ones(len(got), bool), np.zeros(len(tree), bool)]),
                     pa.array(np.r_[count[got], np.zeros(len(tree), np.int64)])], ["k", "other", "n"])

    return run


def _first_meeting(cells: list[np.ndarray], here: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a pair of rows, met in the cell ``here``, has met in no cell before: tables in order, homes before probes, smaller cells first."""
    out, open_ = np.zeros(len(i), bool), np.ones(len(i), bool)
    for c in cells:
        a, b = c[i, 0], c[j, 0]
        one = (c[j, 1:] == a[:, None]).any(axis=1)        # j probes the home of i
        two = (c[i, 1:] == b[:, None]).any(axis=1)
        met = np.where(a == b, a, np.where(one & two, np.minimum(a, b), np.where(one, a, b)))
        meets = open_ & ((a == b) | one | two)
        out |= meets & (met == here[i])
        open_ &= ~meets
    return out


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of rows i and j; every row points to the smallest row of its tree."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root[:] = root[root]


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE,
                 tables: int = TABLES, probes: int = PROBES, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """id, n_links (other rows linked directly) and component_id (smallest id that can be reached) of every row."""
    src = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    id_kind = src.schema["id"].dataType.simpleString()
    kind = "<f4" if src.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    make = lambda dim: Lattice(dim, min_cosine, tables, probes)
    # expected share of different signs at the wanted cosine, and five times its deviation
    share = float(np.arccos(min(1.0, max(-1.0, min_cosine))) / np.pi)
    most = int(np.ceil(64 * share + 5 * np.sqrt(64 * share * (1 - share)) + 1))

    read = stage(src.mapInArrow(_distinct_rows(kind), f"id {id_kind}, v binary, digest binary"), "lattice-rows")
    groups = stage(read.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"))
                   .withColumn("k", F.monotonically_increasing_id()), "lattice-vectors")
    cells = stage(groups.select("k", "v").mapInArrow(_cell_rows(kind, make), "cell bigint, home boolean, k bigint, signs bigint"), "lattice-cells")
    heavy = stage(cells.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > max_bucket)
                  .select("cell", F.expr(f"CAST(ceil(rows / {max_bucket}) AS INT)").alias("blocks")), "lattice-heavy")
    light = (cells.join(heavy, "cell", "left_anti").repartition("cell").sortWithinPartitions("cell")
             .mapInArrow(_close_signs(most), "cell bigint, home boolean, k bigint")
             .selectExpr("cell", "home", "k", "1 AS blocks"))
    full = cells.join(heavy, "cell").select("cell", "home", "k", "blocks")
    # vectors are fetched before rows of heavy cells are copied for their pairs of blocks
    met = stage(light.unionByName(full), "lattice-met").join(groups.select("k", "v", "n"), "k")
    met = (met.withColumn("block", F.expr("CAST(pmod(xxhash64(k), blocks) AS INT)"))
           .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
           .select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "cell", "home", "k", "v", "n", "block",
                   (F.col("block") != F.col("other")).alias("split"))
           .repartition("key").sortWithinPartitions("key"))
    found = stage(met.mapInArrow(_verify(kind, make, min_cosine), "k bigint, other bigint, n bigint"), "lattice-links")

    counts = found.where("other IS NULL").groupBy("k").agg(F.sum("n").alias("links"))
    tree = components(found.where("other IS NOT NULL").select(F.col("k").alias("u"), F.col("other").alias("v")))
    member = tree.select("node", "root").union(tree.select(F.col("root").alias("node"), "root").distinct())
    roots = stage(member.join(groups.select("k", "low"), F.col("node") == F.col("k")).select("k", "root", "low"), "lattice-roots")
    lows = stage(roots.groupBy("root").agg(F.min("low").alias("least")), "lattice-least")     # read again: a hot component's join can be split
    ids = (groups.select("digest", "k", "low", "n").join(counts, "k", "left").join(roots.select("k", "root").join(lows, "root"), "k", "left")
           .select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "low").alias("least"), F.lit(True).alias("known")))
    return (read.select("id", "digest").join(stage(ids, "lattice-ids"), "digest", "left")
            .select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("known"), F.col("least")).otherwise(F.col("id")).alias("component_id")))
