"""Operator 10: SimHash near-duplicates by pigeonhole blocks.

Method: 64 bits are cut into ``distance + 2`` blocks; two fingerprints at most
``distance`` bits apart agree in at least two of them, so every pair of blocks
is a join key (10 keys for 3 bits). Fingerprints that share a key are compared
by Hamming distance, and links become components.

Plan: texts are read once, by a map that turns them into (id, fingerprint).
Equal fingerprints are one row from there on, so copies cost nothing. Keys are
shuffled once; inside a task the sorted keys are compared in numpy, and a
bucket yields at most a spanning forest of its links once it is larger than
``SMALL``. A bucket beyond ``MAX_BUCKET`` fingerprints is not compared there:
its rows come out again, are dealt into blocks, and every pair of blocks is
compared as a bucket of its own, so no task holds more than two blocks and no
link is lost.

Defined results: a null or empty text has fingerprint zero, linked like any
other; a null id keeps its row and counts for a component only if all ids in it
are null; repeated rows each keep their row; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, stage
from .components import components

by_value(__name__)

SMALL = 12
MAX_BUCKET = 16_384
#: Rows (key, fingerprint) that a task compares on average.
ROWS_A_TASK = 100_000
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats included."""
    import xxhash

    w = (text or b"").lower().split()      # of bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    n, counts = max(1, len(w) - shingle + 1), np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):         # long texts by parts
        part = w[at:at + 65_536 + shingle - 1]
        rows = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
        a = np.fromiter((h(r, SEED) for r in rows), np.uint64)
        counts += np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row."""
    kind = docs.select(F.col(f"`{id_col}`").alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return src.mapInArrow(run, f"doc_id {kind}, fp bigint")


def block_keys(distance: int) -> list[str]:
    """SQL of the keys: every pair of the blocks, all bits of both."""
    n = distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [f"(shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L)" for a, b in zip(cuts, cuts[1:])]
    size = [b - a for a, b in zip(cuts, cuts[1:])]
    return [f"(shiftleft({block[i]}, {size[j]}) | {block[j]})" for i, j in combinations(range(n), 2)]


def _forest(fp: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the fingerprints of a bucket into its components."""
    rest, out = fp, []
    while len(rest):
        root, rest, front = rest[0], rest[1:], [rest[0]]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                got = rest[near]
                out.append((np.full(len(got), root), got))
                front.extend(got)
                rest = rest[~near]
    return out


def _links_in(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key; rows stand in the order of the key."""
    u, v = [], []
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for a, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        for x, y in _forest(np.unique(fp[a:a + n]), distance):
            u.append(x), v.append(y)
    small = np.repeat(sizes <= SMALL, sizes)
    key, fp = key[small], fp[small]
    for s in range(1, SMALL):
        hit = np.flatnonzero((key[s:] == key[:-s]) & (np.bitwise_count(fp[s:] ^ fp[:-s]) <= distance))
        if len(hit):
            u.append(fp[hit]), v.append(fp[hit + s])
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(u), np.concatenate(v)) if u else (empty, empty)


def _compare(distance: int, most: int | None):
    """Task function over rows (key, fp) sorted by key: links, or the rows of too large buckets."""

    def frame(kind: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))],
                                          ["kind", "u", "v"])

    def run(batches):
        key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if over is not None:           # the rest of a bucket that is too large already
                n = int(np.searchsorted(key != over, True))
                yield frame(1, key[:n].view(np.uint64), fp[:n])
                key, fp, over = key[n:], fp[n:], None if n < len(key) else over
            if not len(key):
                continue
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if last:                       # all buckets but the last are whole
                big = np.zeros(last, bool)
                if most is not None:
                    _, at, n = np.unique(key[:last], return_inverse=True, return_counts=True)
                    big = n[at] > most
                yield frame(1, key[:last][big].view(np.uint64), fp[:last][big])
                yield frame(0, *_links_in(key[:last][~big], fp[:last][~big], distance))
                key, fp = key[last:], fp[last:]
            if most is not None and len(key) > most:
                over = key[0]
                yield frame(1, key.view(np.uint64), fp)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield frame(0, *_links_in(key, fp, distance))

    return run


def near_links(fps: DataFrame, distance: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(u, v): links that join all distinct fingerprints at most ``distance`` bits apart, directly or by others."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.expr(k).alias("k")) for i, k in enumerate(block_keys(distance))])
    # a key is a hash of (table, blocks): two keys that meet by chance only share a comparison
    # a stated number of partitions: small rows would be merged into few tasks of very many
    most = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(most, -(-fps.count() * len(block_keys(distance)) // ROWS_A_TASK))
    dealt = (fps.select("fp", F.explode(keys).alias("x"))
             .select(F.xxhash64("x.t", "x.k").alias("key"), "fp")
             .repartition(n, "key").sortWithinPartitions("key"))
    found = stage(dealt.mapInArrow(_compare(distance, max_bucket), "kind int, u bigint, v bigint"), "simhash-links")
    links = found.where("kind = 0").select("u", "v")
    over = found.where("kind = 1").select(F.col("u").alias("key"), F.col("v").alias("fp"))
    sizes = over.groupBy("key").agg(F.expr(f"CAST(ceil(count(*) / {max_bucket}) AS INT)").alias("n"))
    blocks = (over.join(sizes, "key").withColumn("b", F.expr("CAST(pmod(xxhash64(fp), n) AS INT)"))
              .select("key", "fp", "b", F.explode(F.expr("sequence(0, n - 1)")).alias("c"))
              .select(F.xxhash64("key", F.least("b", "c"), F.greatest("b", "c")).alias("key"), "fp")
              .repartition("key").sortWithinPartitions("key"))
    more = blocks.mapInArrow(_compare(distance, None), "kind int, u bigint, v bigint").select("u", "v")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    distance: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id that can be reached) of every row."""
    rows = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    groups = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-groups")
    found = components(near_links(groups.select("fp"), distance, max_bucket))
    # every linked fingerprint with its root, the root itself included
    member = found.select("node", "root").union(found.select(F.col("root").alias("node"), "root").distinct())
    roots = member.join(groups, F.col("node") == F.col("fp")).select("fp", "root", "rep")
    low = roots.groupBy("root").agg(F.min("rep").alias("low"))
    linked = roots.join(low, "root").select("fp", "low")
    ids = stage(groups.join(linked, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id")), "simhash-ids")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
