"""The stages of the pipeline against plain Python, one after the other."""

import random

import corpus_pipeline as P
import numpy as np
import pytest
from tokenizers import Tokenizer

import brute
from cohortflow.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, where every stage has something to do."""
    rng = random.Random(12)
    voc = [f"w{i}" for i in range(600)]
    items = [(i, " ".join(rng.choices(voc, k=30))) for i in range(20)]
    docs, labels = [], []
    for d in range(600):
        w = rng.choices(voc, k=rng.randint(20, 150))
        if d % 7 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "vile", "rotten"]))
        if d % 31 == 1:
            w += items[d % 20][1].split()
        if d % 17 == 2:
            w += ["mail", f"x{d}@y.org"]
        docs.append((d, " ".join(w)))
        labels.append((d, 1, int(d % 7 == 0)))
    docs += [(600 + i, docs[8 + i % 3][1]) for i in range(30)]            # copies
    docs += [(700, None), (701, ""), (None, "no id"), (None, "no id"), (9, docs[9][1])]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    columns = docs.columns

    model = toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    clean = P.drop_toxic(spark, docs, corpus)
    assert clean.columns == columns
    scores = toxicity.Scores(model.weights, model.drift)
    want = []
    for d, t in rows(docs):
        best, every, _ = model.evidence(t, scores)
        if model.probability(np.array([best]), np.array([every]))[0] < P.TOXIC_AT:
            want.append((d, t))
    got = rows(clean)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert not {d for d, _ in got} & set(range(0, 600, 7)) and len(got) > 500

    once = P.drop_near_duplicates(spark, clean, corpus)
    assert once.columns == columns
    named = [(d, brute.simhash(t)) for d, t in got if d is not None]
    keep = {c for c in brute.components(named)}
    left = rows(once)
    assert sorted(d for d, _ in left if d is not None) == sorted(keep)
    assert sum(d is None for d, _ in left) == 2

    apart = P.drop_contaminated(spark, once, corpus)
    assert apart.columns == columns
    gone = {d for d, _ in left if d is not None} - {d for d, _ in rows(apart)}
    assert gone == {d for d, _ in left if d is not None and d < 600 and d % 31 == 1}

    safe = P.redact_personal_data(spark, apart, corpus)
    assert safe.columns == columns and safe.count() == apart.count()
    for d, t in rows(safe):
        assert not brute.pii_base(t)
    assert all(r["n_chars"] == len(r["text"]) for r in safe.collect() if r["text"] is not None)

    packed = P.pack_sequences(spark, safe, corpus).collect()
    tok = Tokenizer.from_file(P.public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in packed) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows(safe))


def test_run_and_empty_input(spark, corpus, tmp_path):
    assert P.run(spark, corpus).count() > 300
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), corpus).columns == docs.columns


def test_rows_are_judged_by_their_own_text(spark, tmp_path):
    """Repeated and missing ids: no clean row goes for another's text, no near copy or benchmark passage stays."""
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(400)]
    text = lambda n=60: " ".join(rng.choices(voc, k=n))
    hot = [(5, text()) for _ in range(40)]                       # one id, forty texts
    a, b, c = text(), text(), text()
    rows = hot + [(1, a), (5, a), (2, b), (2, b), (3, c), (None, c)]
    schema = "doc_id bigint, text string"
    got = sorted((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(4), "").collect())
    assert got == sorted([*hot, (1, a), (2, b), (3, c)])

    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(7, text()), (7, text() + " " + item), (None, text() + " " + item), (None, "clean"), (8, text())]
    left = P.drop_contaminated(spark, spark.createDataFrame(rows, schema).repartition(3), str(tmp_path))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=key) == sorted([rows[0], rows[3], rows[4]], key=key)
