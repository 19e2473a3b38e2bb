"""SimHash groups, decontamination, packing, toxicity and main texts against plain Python."""

import random
import timeit
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from cohortflow.llm import components, decontam, html_text, packing, simhash, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# ---- SimHash ------------------------------------------------------------------

def test_fingerprints_and_groups(spark, docs, empty):
    rows = [(d, brute.simhash(t)) for d, t in pairs(docs.where("doc_id IS NOT NULL"))]
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect())
    assert got == Counter((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute.components(rows)))
    assert simhash.near_duplicates(empty).count() == 0
    null = simhash.near_duplicates(docs).where("doc_id IS NULL").collect()
    assert len(null) == 1                                      # a null id keeps its row


@pytest.mark.parametrize("max_bucket", [16_384, 24])
def test_links_lose_no_pair(spark, max_bucket):
    """Dense and sparse fingerprints; with a small bucket limit every large bucket goes through the blocks."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in list(fps)[:4]:                                   # clusters around four centres
        for _ in range(70):
            f = c
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 5])):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps | {0, 1, 3, (1 << 64) - 1})
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp bigint"), 3, max_bucket)
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = brute.components([(i, f) for i, f in enumerate(fps)])
    by_root, by_brute = defaultdict(set), defaultdict(set)
    for (f,), c in zip(signed, want):
        by_root[found.get(f, f)].add(f)
        by_brute[c].add(f)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_brute.values()))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 500)] + [(3, 2)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 400)}}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# ---- decontamination ------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def planted(seed, share, n_items=60):
    """Items, and documents that hold one of them after a share of its words was edited."""
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(400)] + ["the", "of", "and", "to"] * 40
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randint(8, 60)))) for i in range(n_items)]
    docs = []
    for d in range(200):
        i, text = rng.choice(items)
        w = text.split()
        for _ in range(int(share * len(w))):
            at, kind = rng.randrange(len(w)), rng.random()
            w[at:at + (kind < 2 / 3)] = [] if kind < 1 / 3 else [rng.choice(voc)]
        docs.append((d, i, " ".join(rng.choices(voc, k=rng.randint(0, 90)) + w + rng.choices(voc, k=rng.randint(0, 90)))))
    return items, docs


@pytest.mark.parametrize("share,least", [(0.0, 1.0), (0.1, 0.98), (0.2, 0.95)])
def test_leaks_are_found(spark, share, least):
    items, rows = planted(5, share)
    found = decontam.leaks(spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id int, text string").repartition(3),
                           spark.createDataFrame(items, "item_id int, text string")).collect()
    have = {(r["doc_id"], r["item_id"]): r for r in found}
    assert sum((d, i) in have for d, i, _ in rows) >= least * len(rows)
    texts, words = {d: t.split() for d, _, t in rows}, {i: t.split() for i, t in items}
    for (d, i), r in list(have.items())[:60]:                  # the place that is named has that distance
        assert r["edits"] == edits(words[i], texts[d][r["first_word"]:r["end_word"]]) <= int(0.2 * len(words[i]) + 1e-9)


def test_leaks_none_where_nothing_is_planted(spark, docs, empty):
    items, _ = planted(6, 0)
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "a"), (902, "one two three")], "item_id int, text string")
    assert decontam.leaks(docs, bench).count() == 0
    assert decontam.leaks(empty, bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_in_blocks_are_the_same(spark):
    items, rows = planted(7, 0.1, 30)
    docs = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    one = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    assert one == sorted(map(tuple, decontam.leaks(docs, bench, block_items=7).collect())) and one


def test_short_items_match_exactly(spark):
    """Items of one to four words against every run of words of every document; repeated items and documents each give rows."""
    rng = random.Random(13)
    voc = ["a", "b", "c", "The", "é", "日本"]
    items = [(i, " ".join(rng.choices(voc, k=rng.randint(1, 4)))) for i in range(40)] + [(0, "a b"), (50, ""), (51, None), (52, "absent word")]
    rows = [(d, " ".join(rng.choices([*voc, "x"], k=rng.randint(0, 9)))) for d in range(80)] + [(3, "a b c"), (90, None), (91, "the THE a b a b")]
    want = Counter()
    for d, t in rows:
        w = (t or "").lower().split()
        for i, text in items:
            v = (text or "").lower().split()
            at = next((p for p in range(len(w) - len(v) + 1) if w[p:p + len(v)] == v), None) if v else None
            if at is not None:
                want[d, i, 0, len(v), at, at + len(v)] += 1
    docs, bench = spark.createDataFrame(rows, "doc_id int, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string")
    assert Counter(map(tuple, decontam.leaks(docs, bench, short_items=True).collect())) == want and want
    assert decontam.leaks(docs, bench).count() == 0


def test_short_items_whose_codes_meet():
    """A vocabulary so large that codes of four words wrap: still exact."""
    rows = [(i, " ".join(f"v{j}" for j in range(i, i + 4))) for i in range(10, 69_990, 4)] + [("four", "v1 v2 v3 v4"), ("last", "v69996 v69997 v69998 v69999")]
    block = decontam.Items(rows, 0.2, 5, 0.99, 0.5, True)
    assert not block.exact(4) and block.exact(3)
    ids = lambda t: np.array([block.vocab.get(w, 0) for w in t.split()], np.int64)
    found = block.search_short([ids("x v1 v2 v3 v4 v1 v2 v3 v4"), ids(""), ids("v69996 v69997 v69998 x v69996 v69997 v69998 v69999")])
    assert found == [(0, "four", 0, 4, 1, 5), (2, "last", 0, 4, 4, 8)]


def test_very_long_items_in_bounded_memory():
    """An item of 5,000 words in a block of 50,000 words: found after edits, and tables and walks stay small."""
    rng = random.Random(17)
    long = [f"l{rng.randint(0, 20_000)}" for _ in range(5000)]
    rows = [("long", " ".join(long))] + [(i, " ".join(f"s{rng.randint(0, 50_000)}" for _ in range(40))) for i in range(900)]
    tracemalloc.start()
    block = decontam.Items(rows, 0.2, 5, 0.99, 0.5)
    edited = [w if rng.random() > 0.05 else "other" for w in long]
    texts = [["before"] * 30 + edited + ["after"] * 9, rows[7][1].split()] + [["x"] * 20] * 300
    found = block.search([np.array([block.vocab.get(w, 0) for w in t], np.int64) for t in texts])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(t, i) for t, i, *_ in found] == [(0, "long"), (1, 6)] and found[0][4:] == (30, 5030)
    assert peak < 1 << 30


def test_parts_change_nothing(monkeypatch):
    items, rows = planted(8, 0.1, 40)
    search = lambda: (lambda b: sorted(b.search([np.array([b.vocab.get(w, 0) for w in t.split()], np.int64) for _, _, t in rows])))(
        decontam.Items(items, 0.2, 5, 0.99, 0.5))
    whole = search()
    monkeypatch.setattr(decontam, "CELLS", 500)
    monkeypatch.setattr(decontam, "PART_WORDS", 700)
    assert search() == whole and whole


# ---- packing ----------------------------------------------------------------------

def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_whole_and_placed(spark, docs, empty):
    rows = packing.pack(docs, TOKENIZER, 512).collect()
    n = check_packing(rows, 512)
    assert n >= -(-sum(r["length"] for r in rows) // 512)
    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for d, t in pairs(docs):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p, at in enumerate(range(0, len(ids), 512)):
            part = ids[at:at + 512]
            want[d, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_sequences_hold_the_tokens(spark, docs):
    tok = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(docs, TOKENIZER, 512).collect()
    whole, sequences = Counter(), {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], np.frombuffer(r["ids"], "<u4").tolist()))
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        whole[r["doc_id"], r["start"], bytes(r["ids"])] += 1
    want = Counter()
    for d, t in pairs(docs):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.update((d, at, ids[at:at + 512].tobytes()) for at in range(0, len(ids), 512))
    assert whole == want
    for places in sequences.values():
        tokens = []
        for at, ids in sorted(places):
            assert at == len(tokens)
            tokens += ids
        assert len(tokens) <= 512


@pytest.mark.parametrize("kept", [packing.CACHE_WORDS, 40])
def test_word_ids_are_the_tokenizers(monkeypatch, kept):
    """Any letters, marks behind them, a dotted capital I, letters that are taken apart; words forgotten and met again."""
    monkeypatch.setattr(packing, "CACHE_WORDS", kept)
    tok, ids = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER)
    texts = [f"{chr(c)}a A{chr(c)}, {chr(c)}! {chr(c).upper()}.;" for c in [*range(33, 0x250), *range(0x904, 0x960), 0x1E9E, 0x212A]]
    texts += ["", " \t\n", "Straße, STRASSE. Œuvre; œuvre! naïve É. é! ½ a½ 日本語 привет, ΣΑΣ. it's I'LL x_y", "e\u0301t\u0301. \u00a0x\u0085y"]
    for part in (texts, texts[::-1]):
        for at in range(0, len(part), 25):
            some = part[at:at + 25]
            want = [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]
            assert [x.tolist() for x in ids([t.encode() for t in some])] == want


def test_packing_is_that_of_the_counts(spark, docs):
    """As many sequences as the solver needs for all pieces at once, however the rows are dealt."""
    rows = packing.pack(docs, TOKENIZER, 512).collect()
    n = packing.solve(Counter(r["length"] for r in rows), 512)[1]
    assert check_packing(rows, 512) == n
    assert check_packing(packing.pack(docs.repartition(7), TOKENIZER, 512).collect(), 512) == n


def fewest(sizes, capacity):
    """Least number of sequences, by trying all ways (few pieces)."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                left = list(rooms)
                left.remove(r)
                go(i + 1, left + [r - sizes[i]])
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_is_optimal_where_it_decides_all():
    rng, tight = random.Random(2), 0
    for _ in range(300):
        cap = rng.choice([10, 20, 37])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        p = packing.Packer(Counter(sizes), cap)
        p.reduce()
        fixed = p.sequences
        rest = list(Counter(p.counts).elements())
        # dominance: the fixed sets cost nothing against the best packing of all
        assert fixed + (fewest(rest, cap) if rest else 0) == fewest(sizes, cap), sizes
        runs, n = packing.solve(Counter(sizes), cap)
        assert sum(b - a for _, a, b, *_ in runs) == len(sizes)
        tight += n == fewest(sizes, cap)
    assert tight > 285


# ---- toxicity ---------------------------------------------------------------------

def slow_segments(s):
    """Maximal scoring segments by their recursive definition."""
    best = None
    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            v = sum(s[a:b])
            if v > 0 and (best is None or v > best[0]):
                best = (v, a, b)
    if best is None:
        return []
    _, a, b = best
    return slow_segments(s[:a]) + [best] + [(v, x + b, y + b) for v, x, y in slow_segments(s[b:])]


def test_segments_match_their_definition():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-4, -3, -2, -1, 1, 2, 3, 5]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        got = [(a, b) for _, a, b in toxicity.segments(np.array(s))]
        assert got == [(a, b) for _, a, b in slow_segments(s)], s


def test_segments_in_linear_time():
    """A text whose sum keeps falling: twice the words take about twice the time, and the segments are those of its parts."""
    took = {}
    for n in (100_000, 200_000):
        s = np.tile([-1.0, 0.5], n // 2)
        took[n] = min(timeit.repeat(lambda: toxicity.segments(s), number=1, repeat=3))
        assert toxicity.segments(s) == [(0.5, i, i + 1) for i in range(1, n, 2)]
    assert took[200_000] < 3 * took[100_000] + 0.05
    rng = random.Random(12)
    for _ in range(40):                                        # deep chains of links, merged and not
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 100 for _ in range(60)]
        assert [(a, b) for _, a, b in toxicity.segments(np.array(s))] == [(a, b) for a, b in sorted((a, b) for _, a, b in slow_segments(s))]


def test_one_row_per_id_in_the_sample(spark):
    """An id with many texts and both labels gives the sample one row; the model is that of its least text and greater label."""
    docs, labels = toxic_corpus(spark, 400)
    hot = next(r["doc_id"] for r in docs.orderBy("doc_id").collect() if r["doc_id"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2)
    more = spark.range(300).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("~ "), F.col("id").cast("string"), F.lit(" scum vile")).alias("text"))
    both = spark.createDataFrame([(hot, 1, 0)] * 5, labels.schema)
    least = docs.where(F.col("doc_id") == hot).first()["text"]
    assert least < "~"
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs.union(more), labels.union(both) if labels.where((F.col("doc_id") == hot) & (F.col("toxic") == 1)).count() else labels)
    assert a == b
    assert toxicity.fit(docs, labels, max_labels=40).weights.keys() <= {f for w in ["scum", "vile", "rotten"] for f in toxicity.features(w)}


def toxic_corpus(spark, n=900):
    rng = random.Random(4)
    voc = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for d in range(n):
        w = rng.choices(voc, k=rng.randint(5, 120))
        bad = d % 6 == 0
        for _ in range(rng.randint(2, 4) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["scum", "vile", "rotten"]))
        rows.append((d, " ".join(w)))
        labels.append((d, 1, int(bad)))
    return (spark.createDataFrame(rows, "doc_id bigint, text string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_held_out_documents_are_told_apart(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    assert right > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_are_never_read(spark):
    docs, labels = toxic_corpus(spark, 400)
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted(map(tuple, toxicity.toxicity(docs, labels).collect()))
    assert a == sorted(map(tuple, toxicity.toxicity(docs, other).collect()))


def test_toxicity_of_odd_texts(spark, docs, empty):
    _, labels = toxic_corpus(spark, 50)
    assert toxicity.toxicity(docs, labels).where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    kept = toxicity.keep_below(docs, toxicity.Model(), 0.3)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_passages_are_returned(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    scores, toxic = toxicity.Scores(model.weights, model.drift), 0
    for d, t in pairs(docs):
        words, r = t.split(), rows[d]
        chance = np.log(max(model.k * len(words), 1e-9))
        want = [(a, b) for v, a, b in slow_segments([scores[w] for w in words]) if model.scale * v > chance]
        assert [(x["first"], x["end"]) for x in r["segments"]] == want
        assert r["best"] == max((x["excess"] for x in r["segments"]), default=0.0)
        toxic += any({"scum", "vile", "rotten"} & set(words[a:b]) for a, b in want)
    assert toxic > 100


# ---- main texts -------------------------------------------------------------------

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("cells", [html_text.LCS_CELLS, 20])
def test_common_lines(monkeypatch, cells):
    monkeypatch.setattr(html_text, "LCS_CELLS", cells)
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randint(0, rng.choice([2, 5, 20])) for _ in range(rng.randint(0, 25))] for _ in range(2))
        got = html_text.common_lines(a, b)
        rest = iter(b)
        assert len(got) == lcs(a, b) and all(any(y == a[i] for y in rest) for i in got)


def page(*blocks):
    return "<html><head><title>T</title></head><body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body></html>"


def test_differencing_finds_the_template(spark, empty):
    rows = [(i, f"http://h.org/news/{i}", page("Home | News | Contact", f"Story {i} tells of things {i}.", "Share this", "All rights reserved"))
            for i in range(9)]
    rows += [(50, "http://h.org/shop/x", page("Home | News | Contact", "A shop.", "All rights reserved")), (51, "http://one.org/a", page("Alone", "text")),
             (52, None, None), (53, None, ""), (None, "http://h.org/zzz/30", page("Other")), (60, rows[4][1], rows[4][2]), (55, "x", "plain &lt;text&gt; a&nbsp;b &amp"),
             (56, "http://q.org/1", '<nav>Menu</nav><article><h1>T</h1><p>Same<b>ly</b> text.<p>Two &amp; three<br>four</p></article><div class="ad">Buy'),
             (57, "http://q.org/2", '<article><h1>T</h1><p>Same<b>ly</b> text.</article><div id="comments"><p>I think</p></div><form>Name</form>'),
             (58, "http://z.org/1", "<p>cut <b>in a ta"), (59, "http://z.org/9", "<script>if (a<b) { '</p>' }</script><style>p{}</style><p>seen")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id int, url string, html string, text string, row string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
    for i in range(9):
        assert got[i] == f"Story {i} tells of things {i}."
    assert got[60] == got[4]                                   # a copy does not delete what it copies
    assert got[50] == "A shop." and got[51] == "Alone text" and got[52] == got[53] == ""
    assert got[55] == "plain <text> a b &"
    assert got[56] == "T Samely text. Two & three four" and got[57] == "T Samely text."
    assert got[58] == "cut in a ta" or got[58] == "cut in a"
    assert got[59] == "seen"
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_neighbours_do_not_depend_on_partitions(spark):
    rows = [(i, f"h{i % 3}", f"/a/{i // 7}/{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "row bigint, host string, path string")
    one = sorted(map(tuple, html_text.neighbours(df.coalesce(1)).collect()))
    assert one == sorted(map(tuple, html_text.neighbours(df.repartition(13)).collect()))
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    at = {r[0]: i for i, r in enumerate(order)}
    for row, other in one:
        assert abs(at[row] - at[other]) == 1 and row % 3 == other % 3


def slow_neighbour(pages, host, path, digest):
    """The digest of the page that a page is aligned with, by its definition (pages: host, path, digest)."""
    versions = {}
    for h, p, d in pages:
        if h == host:
            versions.setdefault(p, set()).add(d)
    low, order = {p: min(v) for p, v in versions.items()}, sorted(versions)
    at, found = order.index(path), []
    for back, rest in ((True, order[:at][::-1]), (False, order[at + 1:])):
        other = next((p for p in rest if low[p] != low[path]), None)
        if other is not None and low[other] != digest:
            a, b = path.split("/"), other.split("/")
            found.append((next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))), back, low[other]))
    own = versions[path] - {digest}
    return max(found)[2] if found else min(own) if low[path] != digest else max(own) if own else None


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_neighbours_match_their_definition(spark, parts):
    """Copies under many paths, versions of one path, hosts of one page, a run of copies over many partitions."""
    rng = random.Random(parts)
    rows = {("only", "/", 5), ("twins", "/a", 1), ("twins", "/b", 1), ("twins", "/c", 1), ("dynamic", "/index", 1), ("dynamic", "/index", 2), ("dynamic", "/index", 3)}
    rows |= {("hot", f"/{i:04}", 9) for i in range(300)} | {("hot", "/0150/x", 4), ("hot", "/9999", 3)}
    rows |= {(f"h{rng.randint(0, 3)}", "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 3))), rng.randint(0, 4)) for _ in range(150)}
    rows = sorted(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row int, host string, path string, digest bigint").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["row"]: r["other"] for r in html_text.neighbours(df, "digest").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, r in enumerate(rows):
        assert got.get(i) == slow_neighbour(rows, *r), r


def test_main_texts_match_brute_force(spark):
    """Whole operator without containers: copies under two URLs, query variants, versions of a path, shared paragraphs."""
    rng = random.Random(21)
    top, end = "Home | News | Contact", "All rights reserved"
    rows = [("http://two.org/a/1", page(top, "First.", end)), ("http://two.org/a/2", page(top, "First.", end)),
            ("http://var.org/p?x=1", page(top, "Variant.", end)), ("http://var.org/p?x=2", page(top, "Variant.", end)), ("http://var.org/q", page(top, "Q.", end)),
            ("http://ver.org/p?v=1", page(top, "Old text.", "Same paragraph.", end)), ("http://ver.org/p?v=2", page(top, "New text.", "Same paragraph.", end)),
            ("http://ver.org/q", page(top, "Another.", end)), ("http://no.org/p?v=1", page("Wholly", "one")), ("http://no.org/p?v=2", page("other", "words"))]
    for h in range(6):
        for _ in range(12):
            body = [rng.choice(["Alpha.", "Beta.", "Gamma.", f"Own {rng.randint(0, 99)}."]) for _ in range(rng.randint(0, 4))]
            rows.append((f"http://h{h}.org/{rng.choice('xyz')}/{rng.randint(0, 5)}{rng.choice(['', '?q=1'])}", page(*([top] * (h % 2)), *body, end)))
    rows += rows[::5]
    at = [(u.split("/")[2], "/" + u.split("?")[0].split("/", 3)[3], html_text.lines_of(h)[0]) for u, h in rows]
    digest = lambda x: xxhash.xxh3_128(b"".join(xxhash.xxh3_128_digest(y) for y in x)).digest()
    known = sorted({(h, p, digest(x)) for h, p, x in at})
    lines = {digest(x): x for _, _, x in at}
    want = []
    for h, p, x in at:
        other = slow_neighbour(known, h, p, digest(x))
        gone = set(html_text.common_lines(x, lines[other])) if other else set()
        assert len(gone) == (lcs(x, lines[other]) if other else 0) and other != digest(x)
        want.append(" ".join(t for i, t in enumerate(x) if i not in gone))
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert got[0] == got[1] == f"{top} First. {end}"           # nothing on the host differs: all open lines stay
    assert got[2] == got[3] == "Variant."                      # query variants of one path are not each other's neighbours
    assert got[5] == "Old text. Same paragraph." and got[6] == "New text. Same paragraph."
    assert got[8] == "Wholly one" and got[9] == "other words"
