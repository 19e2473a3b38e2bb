"""Operator 2: quality rules by distribution divergence.

Method: every language gets two reference histograms, counted over all
documents of that language: shares of character classes and shares of its
common words (words that make up at least ``common_share`` of the language's
words, so at most ``1 / common_share`` of them). A document is kept when the
Jensen-Shannon distance of its character classes, and, if it is long enough
for a word histogram, that of its common words, stay within limits. Rules on
counts (length, repeated windows) come before.

Plan: pass one counts words per language (they combine map-side before one
shuffle; what is joined by language is dealt by language and a salt, so a hot
language is spread over its words). Pass two is a map over the documents, joined
by language to the common words, one row of at most ``1 / common_share`` words a
language: a broadcast while that table is small. It writes all that is known of
a document as numbers; the class references are sums over those rows, and the
verdicts a last pass over them. Words repeated in a document are found inside
the row, by sorting hashes.

Defined results: a null or empty text has no words, so it fails the length
rule; every language has its own reference, however rare; a document whose
language is null is held against the reference of all documents; repeated rows
each keep their result; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stage

MIN_WORDS = 50
MIN_WORDS_FOR_HISTOGRAM = 100
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.30
COMMON_SHARE = 0.005
#: Languages whose common words are looked up in one set; it decides on speed alone.
MIN_LANGUAGE_SHARE = 0.01
ALL = "*"

#: Character classes by what is not in them; small letters (and control characters) are the rest.
CLASSES = {"upper": r"[^A-Z]+", "digit": r"[^0-9]+", "space": r"[^ \t-\r]+",
           "stop": r"[^.,;:!?'\"()-]+", "symbol": r"[^#*$%&|<>@/\\+=~^_{}\[\]`]+", "wide": r"[\x00-\x7F]+"}


def class_counts(text) -> list[F.Column]:
    """Characters of every class, as columns named c_<class>."""
    return [F.length(F.regexp_replace(text, rx, "")).alias(f"c_{name}") for name, rx in CLASSES.items()]


#: What stands between the words of the histograms: they are lower-case and made of letters only.
NOT_LETTERS = r"[^\p{L}]+"
WHITE = " \t\n\v\f\r"


def _with_all(df: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """One row per language, and the sum over all rows as ``*``."""
    every = df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("ref", F.lit(ALL)).select(*df.columns)
    return df.where(F.col("ref") != ALL).unionByName(every)


def word_references(src: DataFrame, common_share: float = COMMON_SHARE, min_language_share: float = MIN_LANGUAGE_SHARE) -> tuple[DataFrame, list[str]]:
    """Per language (and ``*`` for all) of rows (ref, t): ref, ref_words (common words with their shares) and ref_rare
    (those of them that are not in the list).

    The list holds the common words of the languages of at least ``min_language_share`` of all words, so at most
    ``1 / min_language_share`` times ``1 / common_share``.
    """
    word_n = stage(src.select("ref", F.explode(F.split(F.lower("t"), NOT_LETTERS)).alias("w")).where("w <> ''")
                   .groupBy("ref", "w").agg(F.count("*").alias("n")), "quality-words")
    totals = stage(_with_all(word_n.groupBy("ref").agg(F.sum("n").alias("ref_n")), [], ["ref_n"]), "quality-totals")
    all_n = totals.where(F.col("ref") == ALL).select(F.col("ref_n").alias("all_n"))    # one row
    big = totals.join(F.broadcast(all_n), F.col("ref_n") >= F.col("all_n") * min_language_share).select("ref")
    # totals are copied to every salt and words dealt by language and salt: no language's vocabulary meets in one task
    n = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    counted = stage(_with_all(word_n, ["w"], ["n"]), "quality-counts").withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(n)).cast("int"))
    common = stage(counted.join(salted, ["ref", "salt"]).where(F.col("n") >= F.col("ref_n") * common_share)
                   .select("ref", "w", (F.col("n") / F.col("ref_n")).alias("q")), "quality-common")
    often = sorted(r["w"] for r in common.join(F.broadcast(big), "ref").select("w").distinct().collect())     # bounded, see above
    by_ref = common.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("w", "q"))).alias("ref_words"),
                                       F.collect_list(F.when(~F.col("w").isin(often or [""]), F.col("w"))).alias("ref_rare"))
    return stage(by_ref, "quality-references"), often


def class_references(per_doc: DataFrame) -> DataFrame:
    """Per language (and ``*``): ref, ref_chars (shares of the character classes) from the counts per document."""
    names = [f"c_{n}" for n in CLASSES] + ["c_rest"]
    sums = per_doc.groupBy(F.col("lang_ref").alias("ref")).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    return _with_all(sums, [], ["n", *names]).select("ref", F.array(*[F.col(c) / F.greatest("n", F.lit(1)) for c in names]).alias("ref_chars"))


def _entropy_term(p: str, q: str) -> str:
    """One bucket's part of the Jensen-Shannon divergence, base 2."""
    m = f"(({p} + {q}) / 2)"
    side = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) / 2 ELSE 0D END"
    return f"({side(p)} + {side(q)})"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            min_words: int = MIN_WORDS, min_histogram: int = MIN_WORDS_FOR_HISTOGRAM,
            max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the two distances."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    x = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{lang_col}`"), F.lit(ALL)).alias("lang_ref"),
                    text.alias("t"))
    ref, often = word_references(x.select(F.col("lang_ref").alias("ref"), "t"))
    # trimmed first, so that no empty word comes out
    x = x.withColumn("w", F.when(F.btrim("t", F.lit(WHITE)) != "", F.split(F.btrim("t", F.lit(WHITE)), SPACE))
                     .otherwise(F.array().cast("array<string>"))).withColumn("n_words", F.size("w").cast("long"))
    x = x.withColumn("wh", F.transform("w", lambda w: F.xxhash64(w)))
    windows = F.expr("""CASE WHEN n_words >= 3 THEN transform(sequence(0, size(wh) - 3),
                        i -> xxhash64(wh[i], wh[i + 1], wh[i + 2])) ELSE cast(array() as array<bigint>) END""")
    lines = F.filter(F.split("t", "\n"), lambda s: F.regexp_like(s, F.lit(r"[^ \t-\r]")))
    x = x.select("doc_id", "lang_ref", "t", "n_words", windows.alias("win"), lines.alias("lines"),
                 F.length("t").alias("n"), F.length(F.regexp_replace("t", r"[#*$%&|<>]+", "")).alias("n_plain"),
                 *class_counts(F.col("t")))
    # only documents that repeat a window sort them, to find which ones
    x = x.withColumn("sorted", F.expr("""CASE WHEN size(array_distinct(win)) < size(win)
        THEN sort_array(transform(win, (h, i) -> struct(h AS h, i AS i))) ELSE cast(array() as array<struct<h:bigint,i:int>>) END"""))
    again = F.expr("""filter(sorted, (x, j) -> (j > 0 AND sorted[j - 1].h = x.h)
                                            OR (j < size(sorted) - 1 AND sorted[j + 1].h = x.h)).i""")
    x = x.withColumn("rep", again)
    names = [f"c_{c}" for c in CLASSES]
    x = x.select(
        "doc_id", "lang_ref", "t", "n_words", "n", *names, F.expr(f"n - {' - '.join(names)}").alias("c_rest"), (F.col("n") - F.col("c_space")).cast("long").alias("word_chars"),
        (F.col("n") - F.col("n_plain")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CAST(size(array_distinct(flatten(transform(rep, i -> array(i, i + 1, i + 2))))) AS LONG)").alias("n_repeat_words"))
    x = x.withColumn("base_failed", F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words"))

    every = ref.where(F.col("ref") == ALL).select(F.col("ref_words").alias("all_words"), F.col("ref_rare").alias("all_rare"))     # one row
    x = (x.join(ref, F.col("lang_ref") == F.col("ref"), "left").join(F.broadcast(every), F.lit(True), "left")
         .withColumn("q_words", F.coalesce("ref_words", "all_words", F.expr("cast(array() as array<struct<w:string,q:double>>)")))
         .withColumn("q_rare", F.coalesce("ref_rare", "all_rare", F.expr("cast(array() as array<string>)")))
         .drop("ref", "ref_words", "ref_rare", "all_words", "all_rare"))
    # only failing documents skip the word histogram; the rest sort their common words
    x = x.withColumn("hw", F.when(~F.col("base_failed"), F.split(F.lower("t"), NOT_LETTERS)).otherwise(F.array().cast("array<string>")))
    # only the first and the last can be empty
    x = x.withColumn("n_hw", F.expr("size(hw) - CASE WHEN size(hw) > 0 AND hw[0] = '' THEN 1 ELSE 0 END"
                                    " - CASE WHEN size(hw) > 1 AND element_at(hw, -1) = '' THEN 1 ELSE 0 END"))
    often = often or [""]
    x = x.withColumn("common", F.sort_array(
        F.when(F.size("q_rare") == 0, F.filter("hw", lambda w: w.isin(often)))
        .otherwise(F.filter("hw", lambda w: w.isin(often) | F.array_contains("q_rare", w)))))
    x = x.withColumn("q_map", F.map_from_entries("q_words"))
    starts = "filter(sequence(0, size(common)), (j, i) -> j = 0 OR j = size(common) OR common[j] <> common[j - 1])"
    x = x.withColumn("starts", F.expr(f"CASE WHEN size(common) > 0 THEN {starts} ELSE array(0) END"))
    # one bucket for every common word of the reference, one for all other words
    found = """filter(transform(sequence(1, size(starts) - 1), k -> struct(
                 CAST(starts[k] - starts[k - 1] AS DOUBLE) / n_hw AS p,
                 q_map[common[starts[k - 1]]] AS q)), b -> b.q IS NOT NULL)"""
    x = x.withColumn("found", F.expr(f"CASE WHEN size(starts) > 1 THEN {found} ELSE cast(array() as array<struct<p:double,q:double>>) END"))
    sum_of = lambda a: f"aggregate({a}, 0D, (s, v) -> s + v)"
    x = x.withColumn("p_rest", F.expr(f"1 - {sum_of('found.p')}")).withColumn("q_rest", F.expr(f"1 - {sum_of('q_words.q')}"))
    word_js = F.expr(f"""sqrt(greatest(0D, ({sum_of('q_words.q')} - {sum_of('found.q')}) / 2
                    + {sum_of("transform(found, b -> " + _entropy_term("b.p", "b.q") + ")")}
                    + {_entropy_term("greatest(0D, p_rest)", "greatest(0D, q_rest)")}))""")
    # everything about one document, as numbers; the classes' references are sums over these rows
    per_doc = stage(x.select("doc_id", "lang_ref", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n", *names,
                             "c_rest", F.when((F.col("n_hw") >= min_histogram) & (F.size("q_words") > 0), word_js).alias("word_distance")), "quality-documents")
    classes = stage(class_references(per_doc), "quality-classes")
    every = classes.where(F.col("ref") == ALL).select(F.col("ref_chars").alias("all_chars"))     # one row
    x = (per_doc.join(classes, F.col("lang_ref") == F.col("ref"), "left").join(F.broadcast(every), F.lit(True), "left")
         .withColumn("q_chars", F.coalesce("ref_chars", "all_chars"))
         .withColumn("p_chars", F.expr(f"transform(array({', '.join(names)}, c_rest), c -> CAST(c AS DOUBLE) / greatest(n, 1))")))
    class_js = F.expr("sqrt(greatest(0D, aggregate(zip_with(p_chars, q_chars, (p, q) -> " + _entropy_term("p", "q")
                      + "), 0D, (a, v) -> a + coalesce(v, 0D))))")
    x = x.withColumn("class_distance", class_js)
    kept = (~F.col("base_failed") & (F.coalesce("class_distance", F.lit(0.0)) <= max_class)
            & (F.coalesce("word_distance", F.lit(0.0)) <= max_word))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", kept.alias("kept"), "class_distance", "word_distance")
