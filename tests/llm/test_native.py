"""Sharding, quality rules, URL rules, licence scan and personal data against plain Python."""

import zlib
from collections import Counter

import brute
from cohortflow.llm import licenses, pii, quality, sharding, url_rules
from conftest import TEXTS


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_shards(docs, empty):
    rows = [tuple(r) for r in sharding.shard_by_bytes(docs, 8).collect()]
    assert Counter(rows) == Counter(brute.shards(pairs(docs), 8))
    for s in {r[3] for r in rows}:
        assert sorted(r[4] for r in rows if r[3] == s) == list(range(sum(r[3] == s for r in rows)))
    assert sharding.shard_by_bytes(empty, 8).count() == 0


def test_shards_are_balanced_and_contiguous(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('é', CAST(id % 97 AS INT)) AS text").repartition(7)
    rows = sorted(tuple(r) for r in sharding.shard_by_bytes(docs, 8).collect())
    assert [r[3] for r in rows] == sorted(r[3] for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += r[1]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r[1] for r in rows)


def test_shards_hold_the_whole_rows(spark, docs, empty):
    out, path = sharding.write_shards(docs, 8)
    rows = out.collect()
    assert Counter(tuple(r["row"]) for r in rows) == Counter(map(tuple, docs.collect()))
    assert rows[0]["row"].__fields__ == docs.columns
    for r in rows:
        text = r["row"]["text"] or ""
        assert r["doc_id"] == r["row"]["doc_id"] and r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
    for s in {r["shard"] for r in rows}:
        assert spark.read.parquet(f"{path}/shard={s}").count() == sum(r["shard"] == s for r in rows)
    assert sharding.write_shards(empty, 8)[0].count() == 0


def test_quality_base(docs, empty):
    got = Counter(tuple(r)[:7] for r in quality.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == Counter((d, *brute.quality_base(t)) for d, t in pairs(docs))
    assert quality.quality(empty).count() == 0


def test_quality_rejects_another_distribution(spark):
    clean = " ".join(["the river ran down and the stones of it were cold but not", "far from her house, where a road went on"] * 9)
    rows = [(i, clean + f" it{i} was so{i}.", "en") for i in range(40)]
    rows += [(100, " ".join(f"{w}$$$" for w in clean.split()[:90]) + " " + " ".join(f"q{i}&&&" for i in range(90)), "en"),
             (101, " ".join(f"zxq{i}vw" for i in range(200)), "en"), (102, None, None), (103, clean.upper(), None)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert not got[100]["kept"] and got[100]["class_distance"] > quality.MAX_CLASS_DISTANCE
    assert not got[101]["kept"] and got[101]["word_distance"] > quality.MAX_WORD_DISTANCE
    assert not got[102]["kept"] and got[102]["n_words"] == 0
    assert got[103]["class_distance"] > quality.MAX_CLASS_DISTANCE      # held against all documents
    # a repeated text fails the base rule; texts like the reference stay close to it
    assert max(got[i]["class_distance"] for i in range(40)) < quality.MAX_CLASS_DISTANCE


def test_quality_keeps_rare_languages(spark):
    english = " ".join(["the river ran down and the stones of it were cold but not", "far from her house, where a road went on"] * 9)
    # of either rare language: texts alike in their common words, and one that is not; all under 1 % of the words
    russian = lambda k: " ".join(f"и вода{chr(1072 + i % 30)}{chr(1072 + i // 30)}{chr(1072 + k)} не" for i in range(45))
    japanese = " ".join(f"日本{chr(0x4e00 + i)}語 です" for i in range(60))
    junk = " ".join(f"жук{chr(1072 + i % 30)}{chr(1072 + i // 30)}" for i in range(150))
    rows = [(i, english + f" it{i} was.", "en") for i in range(800)]
    rows += [(1000 + i, russian(i), "ru") for i in range(8)] + [(2000, japanese, "ja"), (2001, junk, "ru"), (2002, russian(3), None)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i in [*range(1000, 1008), 2000]:
        assert not got[i]["base_failed"] and got[i]["kept"], got[i]
    assert got[1000]["word_distance"] is not None and got[1000]["word_distance"] < 0.2
    assert not got[2001]["kept"] and got[2001]["word_distance"] > quality.MAX_WORD_DISTANCE
    assert not got[2002]["kept"]          # no language: held against all documents


URLS = [None, "", "no scheme", "http://", "HTTP://Org/", "http://org", "http://org/", "https://A.B.org/x", "http://xorg/", "http://example.org/es/1",
        "http://m.example.org/es", "http://example.org/en/1", "http://example.org/en/17?x", "http://example.org/en/2#1", "http://q.com/fr/",
        "http://q.com/de/x", "http://q.com/de", "http://q.com:80/fr/", "http://example.org?x/es/", "http://example.org/es/", "http://example.org/es/",
        "ftp://free-bets.net/a", "http://m.casino-win.example.net/fr/", "http://x.com/free-bets", "http://K.org/", "http://free.bets.com/fr/1",
        "a://b://c.org/", "http://ex\nample.org/es/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i if i != 4 else None, u, "h", "tok") for i, u in enumerate(URLS)], "page_id int, url string, host string, _row string")
    got = Counter(tuple(r) for r in url_rules.url_verdicts(pages).select("page_id", "host", "path", "rule").collect())
    assert got == Counter((i if i != 4 else None, *brute.url_rule(u)) for i, u in enumerate(URLS))
    by = {r["page_id"]: r for r in url_rules.url_verdicts(pages).collect()}
    assert by[21]["verdict"] == "block" and by[21]["rule"] is None and by[21]["matched"] == "free-bets"
    assert by[22]["matched"] == "casino-win" and by[23]["verdict"] == "allow" and by[25]["rule"] == "com/fr/"
    for r in by.values():
        if r["rule"]:
            assert r["verdict"] == brute.RULES[r["rule"]]
    assert url_rules.url_verdicts(pages.limit(0)).count() == 0
    # the same result where the rules are too many to broadcast
    plain = Counter(map(tuple, url_rules.url_verdicts(pages, broadcast_rules=0).collect()))
    assert plain == Counter(map(tuple, url_rules.url_verdicts(pages).collect()))


def test_licence_base(docs, empty):
    got = Counter(tuple(r) for r in licenses.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    assert got == Counter((d, *brute.license_base(t)) for d, t in pairs(docs))
    assert licenses.license_scan(empty).count() == 0


def test_licence_templates(spark):
    rows = [(1, "x. Licensed under CC BY-NC 4.0. y"), (2, "x Permission is hereby granted, free of charge, to any person obtaining a copy of this "
             "softwares and associated documentation files"), (3, "redistribution and use in source or binary"), (4, "license " * 300),
            (5, "permission is hereby refused free of charge to any person obtaining a copy of this software and associated documentation files")]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1]["labels"] == "cc-by-nc" and got[1]["base_labels"] == "" and got[1]["score"] == 1.0
    assert got[2]["labels"] == "mit" and 0.9 < got[2]["score"] < 1      # one word of the template differs
    assert [got[i]["labels"] for i in (3, 4, 5)] == ["", "", ""]       # too few words; none; a key phrase lacks


def test_personal_data_base(docs, empty):
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.pii(docs).collect())
    want = Counter()
    for d, t in pairs(docs):
        s = brute.pii_base(t)
        n = Counter(k for k, _, _ in s)
        want[d, n["email"], n["ip"], n["card"], n["phone"], brute.pii_sha(s)] += 1
    assert got == want
    assert pii.pii(empty).count() == 0


def test_personal_data_of_the_method(spark):
    good, bad = "DE89370400440532013000", "DE89370400440532013001"
    hexa = "0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d"
    rows = [(1, f"IBAN {good} and {bad}"), (2, f"token = \"{hexa}\""), (3, f"sum {hexa}"), (4, "DE89 3704 0044 0532 0130 00."),
            (5, " ".join(f"u{i}@x.org" for i in range(700)))]
    got = {r["doc_id"]: r["spans"] for r in pii.pii(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == f"iban:5:{5 + len(good)}"
    assert got[2] == f"secret:9:{9 + len(hexa)}" and got[3] == ""
    assert got[4].split(",")[-1].startswith("iban:0:27") or "iban:0:27" in got[4]
    assert got[5] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii_base(rows[4][1]))


def test_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1", "host 0.0.0.0, 127.0.0.1", "001.2.3.4", "000.00.0.000", "192.168.0.1 256.0.0.1 1.2.3.0256 0255.1.1.0", "0" * 4_000 + ".0.0.999"]
    got = pii.pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in got:
        want = brute.pii_base(texts[r["doc_id"]])
        assert (r["n_ip"], r["base_sha256"]) == (sum(k == "ip" for k, _, _ in want), brute.pii_sha(want)), texts[r["doc_id"]][:40]
    assert sorted(r["n_ip"] for r in got) == [0, 1, 1, 1, 2, 2]
    clean = pii.redact(spark.createDataFrame([(1, "at 10.0.0.1 now")], "doc_id int, text string")).collect()
    assert clean[0]["text"] == "at <IP> now"


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_iban_ends_at_its_length(spark):
    good = ["DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947", "MT84MALT011000012345MTLCAST001S", "BE68539007547034"]
    printed = [" ".join(x[i:i + 4] for i in range(0, len(x), 4)) for x in good]
    assert all(map(mod97, good))
    rows, want = [], []
    for x in good + printed:
        for before, after in (("", " Bitte"), ("", " AND MORE"), ("to ", " 2024"), ("é ", " A1B2 C3"), ("AB12 ", " x"), ("", ""), ("(", ").")):
            rows.append((len(rows), before + x + after))
            want.append((len(before), len(before) + len(x)))
    rows += [(len(rows), good[0] + "7"), (len(rows) + 1, "x" + good[0]), (len(rows) + 2, good[0] + "a")]      # not on their own
    got = {r["doc_id"]: r["spans"] for r in pii.pii(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for (i, text), (a, b) in zip(rows, want):
        assert f"iban:{a}:{b}" in got[i].split(","), text
    assert not any("iban" in got[i] for i in range(len(want), len(rows)))
    # a code of no country is held to its checksum alone
    other = next(f"QQ{n:02d}ABCDEFGHIJK12" for n in range(100) if mod97(f"QQ{n:02d}ABCDEFGHIJK12"))
    assert pii.pii(spark.createDataFrame([(1, other + ".")], "doc_id int, text string")).collect()[0]["spans"] == f"iban:0:{len(other)}"


def test_redaction(spark, docs):
    rows = [(1, "é mail a.b@c.de, ip 1.2.3.4."), (2, "none"), (3, None), (4, "")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: "é mail <EMAIL>, ip <IP>.", 2: "none", 3: None, 4: ""}
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert all(not brute.pii_base(r["text"]) for r in out.collect())      # nothing is left


def test_working_names_may_be_columns(spark):
    """Columns called like the operator's own, and dotted ones, come through redaction unchanged."""
    from pyspark.sql import functions as F
    row = {"doc_id": 1, "text": "mail a.b@c.de now", "_spans": "s", "_m": "m", "_merged": "x", "_Spans_": 1, "a.b": 2, "in_0": 3, "k_0": 4, "t": 5, "_stage_row": 6}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    got = pii.redact(df)
    assert got.columns == list(row)
    assert got.first().asDict() == row | {"text": "mail <EMAIL> now"}
    from corpus_pipeline import _keyed, _without
    keyed, key = _keyed(df, "names")
    assert key not in row and _without(keyed, keyed.where("false").select(F.col(key)), key).first().asDict() == row
