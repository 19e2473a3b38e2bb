"""Operators 11 to 13 against plain Python: embedding near-duplicates, hard negatives, periodic runs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm.hard_negatives import Heaps, hard_negatives, integer_vectors, strassen
from cohortflow.llm.lattice import Lattice, near_vectors, nearest, unit
from cohortflow.llm.periodic import collapsed, dictionary, names, periodic_runs, planted, runs_of
from cohortflow.llm.queries import build_queries

NAN, INF = float("nan"), float("inf")
CLASHES = "key bigint, cell bigint, k bigint, v string, digest string, n bigint, block int, other int, split boolean, `a.b` int, r bigint, id string"


def near(rng, v, cosine):
    """A vector at the given cosine to ``v``."""
    w = rng.standard_normal(len(v))
    w -= w @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine ** 2) * w / np.linalg.norm(w)


# ---- 11 ------------------------------------------------------------------------


def brute_links(rows, min_cosine=0.95):
    """(id, n_links, component) of rows (id, vector), by comparing all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= min_cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], links[i], min(ids) if ids else None))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(5)
    rows, base = [], rng.standard_normal((12, 24))
    for i, v in enumerate(base):
        rows.append((100 + i, v))
        rows += [(200 + 10 * i + j, near(rng, v, c)) for j, c in enumerate((0.96, 0.97, 0.985, 0.999, 0.9)[:i % 6])]
    rows += [(500, base[0]), (501, 3 * base[0]), (100, base[0]), (None, base[1]), (None, -base[2]), (502, base[3][:7]), (503, base[3][:7] * 2)]
    hot = rng.standard_normal(24)                       # a hot group of near copies
    rows += [(600 + i, hot + 0.02 * rng.standard_normal(24)) for i in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    return rows + [(700, None), (701, []), (702, [0.0] * 24), (703, [NAN] + [1.0] * 23), (704, [INF] * 24), (705, [None] + [1.0] * 23),
                   (706, [-0.0] * 23 + [1.0]), (707, [0.0] * 23 + [1.0]), (708, [1e30] + [0.0] * 23), (709, [1e-30] + [0.0] * 23), (701, [])]


def vectors_df(spark, rows, kind="float"):
    extra = (1, 2, 3, "v", "d", 4, 5, 6, True, 7, 8, "id")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"vec_id bigint, embedding array<{kind}>, {CLASHES}").repartition(3)


@pytest.mark.parametrize("max_bucket", [4096, 8])
def test_links_equal_brute_force(spark, vector_rows, max_bucket):
    """With 8 rows a bucket the hot group is dealt into blocks: the result stays."""
    got = near_vectors(vectors_df(spark, vector_rows), max_bucket=max_bucket).collect()
    assert order(map(tuple, got)) == order(brute_links(vector_rows))


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).collect() == []
    got = near_vectors(spark.createDataFrame([(1, None), (None, None)], "vec_id bigint, embedding array<double>")).collect()
    assert order(map(tuple, got)) == [(1, 0, 1), (None, 0, None)]


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    y = rng.uniform(-3, 3, (300, 8))
    got = nearest(y)
    assert (np.abs(2 * got - np.rint(2 * got)) < 1e-12).all() and (got.sum(axis=1) % 2 == 0).all()
    near_by = np.concatenate([np.zeros((1, 8)), Lattice(3, 0.95, 1, 1).neighbours])
    d = ((y[:, None, :] - got[:, None, :] - near_by[None]) ** 2).sum(axis=2)
    assert (d.argmin(axis=1) == 0).all()        # no neighbour is nearer (enough: the Voronoi cell's walls lie towards them)


def test_recall_at_the_limit():
    """Pairs at cosine 0.95 exactly meet in one of the tables in 0.95 of the cases or more; the same cells in every batch."""
    rng = np.random.default_rng(2)
    a = unit(rng.standard_normal((3000, 64)))
    b = np.array([near(rng, v, 0.95) for v in a])
    h = Lattice(64, 0.95, 6, 4)
    wa, wb = h.whole(unit(a)), h.whole(unit(b))
    met = np.zeros(len(a), bool)
    for t in range(6):
        ca, cb = h.cells(wa, t), h.cells(wb, t)
        met |= (ca == cb[:, :1]).any(axis=1) | (cb == ca[:, :1]).any(axis=1)
        assert (h.cells(wa[17:18], t) == ca[17:18]).all()
    assert met.mean() >= 0.95


# ---- 12 ------------------------------------------------------------------------


def test_strassen_is_exact():
    rng = np.random.default_rng(3)
    for m, k, n in ((1, 1, 1), (3, 64, 5), (67, 33, 129), (40, 0, 40), (0, 5, 7), (65, 65, 65)):
        a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
        assert (strassen(a, b, leaf=4) == a @ b).all()
        big = rng.integers(-2 ** 40, 2 ** 40, (m, k))
        assert (strassen(big, b, leaf=4) == big @ b).all()


def test_heaps_merge_like_one_sort():
    rng = np.random.default_rng(4)
    slot, score, ids = rng.integers(0, 5, 400), rng.integers(-6, 6, 400), rng.permutation(400)
    heaps = Heaps(5, 7)
    for at in range(0, 400, 50):
        heaps.merge(slot[at:at + 50], score[at:at + 50], ids[at:at + 50])
    want = [(s, *x) for s in range(5) for x in sorted((-score[i], ids[i]) for i in np.flatnonzero(slot == s))[:7]]
    assert [(s, -x, i) for s, x, i in zip(*heaps.rows())] == want


def brute_negatives(rows):
    part = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            part.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for at, (a, la, va) in enumerate(part):
        if a % 100:
            continue
        dot = [sum(x * y for x, y in zip(va, v)) for _, _, v in part]
        pos = sorted((-dot[j], part[j][0]) for j in range(len(part)) if j != at and part[j][1] == la)[:5]
        for s, p in pos:
            neg = sorted((-dot[j], part[j][0]) for j in range(len(part)) if part[j][1] != la and 30 * -s <= 100 * dot[j] <= 90 * -s)[:10]
            out += [(a, p, r + 1, n, -s, -x) for r, (x, n) in enumerate(neg)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(9)], int(rng.integers(0, 3))) for i in range(-120, 480)]
    rows += [(i, rows[4][1], 1) for i in range(500, 560)]                       # ties
    rows += [(300, [1.0] * 9, 1), (300, [0.5] * 9, 2), (601, [1.0, 2.0], 0), (602, [], 0), (700, [0.0] * 9, 0)]
    rows += [(603, None, 1), (604, [NAN] * 9, 1), (605, [None] * 9, 1), (606, [1.0] * 9, None), (None, [1.0] * 9, 1), (607, [INF] * 9, 2)]
    df = spark.createDataFrame([(*r, 1, "v", "s", 2, 3, 4) for r in rows],
                               "vec_id bigint, embedding array<double>, label int, r int, v string, id string, score int, nth int, `a.b` int").repartition(4)
    vectors = integer_vectors(df)
    for size in (8 << 20, 8 * 9 * 2):           # one block, and blocks of two anchors
        got = hard_negatives(vectors, F.col("id") % 100 == 0, block_bytes=size).collect()
        assert sorted(map(tuple, got)) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives(integer_vectors(none), F.col("id") % 100 == 0).collect() == []
    only = spark.createDataFrame([(100, [1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives(integer_vectors(only), F.col("id") % 100 == 0).collect() == []


# ---- 13 ------------------------------------------------------------------------


def brute_runs(w):
    """Every maximal stretch of every period, with its smallest period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        j = 0
        while j < len(w) - q:
            if w[j] != w[j + q]:
                j += 1
                continue
            e = j
            while e < len(w) - q and w[e] == w[e + q]:
                e += 1
            s, n = j, e - j + q
            least = not any(all(w[x] == w[x + p] for x in range(s, s + n - p)) for p in range(1, q))
            if n >= max(6, 4 * q) and least:
                out.append((s, n, q))
            j = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(1500):
        n, k = rnd.randint(0, 90), rnd.choice([1, 2, 3, 5, 30])
        w = [rnd.randrange(k) for _ in range(n)]
        if n > 4 and rnd.random() < 0.7:
            a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if rnd.random() < 0.5:
                w[rnd.randrange(n)] = 99
        assert runs_of(w) == brute_runs(w), w
    with pytest.raises(ValueError):
        runs_of([1] * 9, min_exponent=3)


def test_dictionary_names_equal_stretches():
    w = [1, 2, 1, 2, 1, 2, 3, 1, 2, 1, 2]
    for k, level in enumerate(dictionary(names(w))):
        size = 1 << k
        for i in range(len(level)):
            for j in range(len(level)):
                assert (level[i] == level[j]) == (w[i:i + size] == w[j:j + size])


def test_long_texts():
    w = [i % 777 for i in range(200_000)] + [5] * 100_000
    assert runs_of(w)[0] == (0, 200_000, 777) and (200_000, 100_000, 1) in runs_of(w)


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w) if len(w) > 400 else brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *top, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_rows(spark, sf, docs, empty, tmp_path):
    query = build_queries()["op13_periodic_runs"]
    small = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text").unionByName(small)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_row(*r) for r in rows.collect()), key=str)
    assert any(r[1] for r in got)
    assert periodic_runs(empty).collect() == [] and planted(empty).collect() == []


def test_collapsed_keeps_first_periods():
    w = "a b a b a b a b x x x x x x y".split()
    assert collapsed(w, runs_of(w)) == "a b x y".split()
