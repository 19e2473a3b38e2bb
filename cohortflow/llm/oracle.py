"""DuckDB SQL of the text operators that SQL can express.

Operators 3, 5, 6, 9 and 10 have none (markup, a learned model, a tokenizer,
edit distances, XXH64): ``tests/llm`` holds them against plain Python.
"""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES
from .quality import CLASSES, COMMON_SHARE, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_WORDS_FOR_HISTOGRAM
from .url_rules import HOST_RULES, WORD_RULES

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: CRC-32 of a text: a table by its rule (reflected polynomial), then one step per byte.
CRC32 = """crc_table AS (
  SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
  FROM range(256) r(n)),
bytes AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
         xor(4294967295, list_reduce([4294967295] || list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)),
             lambda c, b: xor(c // 256, t[1 + (xor(c, b) & 255)]))) AS text_crc32
  FROM bytes, crc_table)"""


def sharding_sql(n: int = 8) -> str:
    return f"""WITH {CRC32},
line AS (
  SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total FROM sized
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, CAST(least({n - 1}, ((2 * upto - size) * {n}) // (2 * total)) AS INTEGER) AS shard FROM line)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM cut"""


def quality_sql() -> str:
    counts = ", ".join(f"length(regexp_replace(t, {_q(rx)}, '', 'g')) AS c_{n}" for n, rx in CLASSES.items())
    names = [f"c_{n}" for n in CLASSES]
    js = lambda p, q: (f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) / 2 ELSE 0 END"  # noqa: E731
                       f" + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) / 2 ELSE 0 END)")
    shares = ", ".join(f"{c} / greatest(n, 1) AS p_{c}" for c in [*names, "c_rest"])
    return f"""WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '*') AS ref, coalesce(text, '') AS t FROM documents),
word AS (
  SELECT *, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split_regex(lower(t), '[^\\p{{L}}]+'), lambda x: x <> '') AS hw,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM doc),
windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS times
  FROM (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(w[:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c FROM word WHERE len(w) >= 3)),
repeated AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY rid),
classed AS (SELECT rid, ref, length(t) AS n, {counts} FROM doc),
base AS (
  SELECT word.rid, word.doc_id, word.ref, word.hw, CAST(len(w) AS BIGINT) AS n_words,
         CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM word LEFT JOIN repeated r USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
counted AS (SELECT ref, x AS w, count(*) AS n FROM (SELECT ref, unnest(hw) AS x FROM word) GROUP BY ALL),
counted_all AS (SELECT * FROM counted WHERE ref <> '*' UNION ALL SELECT '*', w, sum(n) FROM counted GROUP BY w),
big AS (
  SELECT ref, sum(n) AS total FROM counted_all GROUP BY ref),
common AS (SELECT ref, w, n / total AS q FROM counted_all JOIN big USING (ref) WHERE n >= total * {COMMON_SHARE}),
chars AS (SELECT *, n - {' - '.join(names)} AS c_rest FROM classed),
chars_ref AS (
  SELECT ref, {', '.join(f'sum({c}) / greatest(sum(n), 1) AS q_{c}' for c in [*names, 'c_rest'])}
  FROM (SELECT * FROM chars WHERE ref <> '*' UNION ALL SELECT * REPLACE ('*' AS ref) FROM chars) GROUP BY ref),
placed AS (SELECT f.*, coalesce(b.ref, '*') AS known FROM failed f LEFT JOIN big b USING (ref)),
class_js AS (
  SELECT p.rid, sqrt(greatest(0, {' + '.join(js(f'p_{c}', f'q_{c}') for c in [*names, 'c_rest'])})) AS d
  FROM placed p JOIN (SELECT rid, {shares} FROM chars) USING (rid) LEFT JOIN chars_ref r ON r.ref = p.known),
held AS (
  SELECT rid, known, x AS w, count(*) / any_value(size) AS p
  FROM (SELECT rid, known, len(hw) AS size, unnest(hw) AS x FROM placed WHERE NOT base_failed) GROUP BY rid, known, x),
found AS (SELECT rid, sum(p) AS p_all, sum(q) AS q_all, sum({js('p', 'q')}) AS js FROM held JOIN common ON common.ref = held.known AND common.w = held.w GROUP BY rid),
word_js AS (
  SELECT p.rid, sqrt(greatest(0, (c.q_sum - coalesce(q_all, 0)) / 2 + coalesce(js, 0)
         + {js('greatest(0, 1 - coalesce(p_all, 0))', 'greatest(0, 1 - c.q_sum)')})) AS d
  FROM placed p JOIN (SELECT ref, sum(q) AS q_sum FROM common GROUP BY ref) c ON c.ref = p.known LEFT JOIN found USING (rid)
  WHERE NOT base_failed AND len(hw) >= {MIN_WORDS_FOR_HISTOGRAM})
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_js.d, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(word_js.d, 0) <= {MAX_WORD_DISTANCE} AS kept
FROM placed LEFT JOIN class_js USING (rid) LEFT JOIN word_js USING (rid)"""


def url_sql() -> str:
    rules = ", ".join(f"({_q(r.name)}, {_q(r.verdict)}, {_q(r.name.split('/', 1)[0])}, {_q('/' + r.name.split('/', 1)[1])})" for r in HOST_RULES)
    words = " OR ".join(f"regexp_matches(host || path, {_q(r.pattern)})" for r in WORD_RULES)
    return f"""WITH cut AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT rid, page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
urls AS (
  SELECT rid, page_id, translate(h, '{UPPER}', '{SMALL}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts),
rules(rule, verdict, rh, rp) AS (VALUES {rules}),
fit AS (
  SELECT rid, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host <> '' AND ({words}) THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN fit USING (rid)"""


def license_sql(rare_words: int = 4) -> str:
    templates = ", ".join(
        f"({k}, {_q(t.label)}, string_split({_q(t.text)}, ' '), [{', '.join(map(_q, t.phrases))}], {t.min_share})" for k, t in enumerate(TEMPLATES))
    starts = []
    for phrase, label in PHRASES:
        same = " AND ".join(f"w[i + {j + 1}] = {_q(v)}" for j, v in enumerate(phrase.split()))
        starts.append(f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'i': i, 'label': {_q(label)}}})")
    return f"""WITH template(k, label, tw, phrases, min_share) AS (VALUES {templates}),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
place AS (SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS v FROM doc),
vocabulary AS (SELECT DISTINCT unnest(tw) AS v FROM template),
df AS (SELECT v, count(DISTINCT rid) AS n FROM place SEMI JOIN vocabulary USING (v) GROUP BY v),
ranked AS (
  SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY coalesce(n, 0), v) AS r
  FROM (SELECT DISTINCT k, unnest(tw) AS v FROM template) LEFT JOIN df USING (v)),
rare AS (SELECT k, v, count(*) OVER (PARTITION BY k) AS size FROM ranked WHERE r <= {rare_words}),
posting AS (SELECT k, v, p, ceil(size / 2) AS need FROM (SELECT k, unnest(range(len(tw))) AS p, unnest(tw) AS v FROM template) JOIN rare USING (k, v)),
vote AS (SELECT rid, k, i - p AS spot, count(DISTINCT v) AS votes, any_value(need) AS need FROM place JOIN posting USING (v) GROUP BY ALL),
scored AS (
  SELECT rid, label, len(list_filter(range(1, len(tw) + 1), lambda j: w[spot + j] IS NOT DISTINCT FROM tw[j])) / len(tw) AS share
  FROM vote JOIN template USING (k) JOIN doc USING (rid)
  WHERE spot >= 0 AND votes >= need AND len(list_filter(phrases, lambda p: NOT contains(array_to_string(w[spot + 1:spot + len(tw)], ' '), p))) = 0
    AND len(list_filter(range(1, len(tw) + 1), lambda j: w[spot + j] IS NOT DISTINCT FROM tw[j])) / len(tw) >= min_share),
found AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share FROM scored GROUP BY rid),
base AS (SELECT *, {' || '.join(starts)} AS s FROM doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(s) AS BIGINT) AS n_base, list_min(list_transform(s, lambda x: x.i)) AS first_word,
       list_max(list_transform(s, lambda x: x.i)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(s, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(s, lambda x: x.label) || coalesce(labels, []))), ',') AS labels,
       CAST(greatest(coalesce(share, 0), CASE WHEN len(s) > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS score
FROM base LEFT JOIN found USING (rid)"""


def pii_sql() -> str:
    """IBANs, of which the given tables hold none, are left to the tests: RE2 has no look-behind."""
    luhn = ("list_sum(list_transform(range(length(g)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse(g), i + 1, 1) AS INTEGER) "
            "ELSE list_sum(list_transform(string_split(CAST(2 * CAST(substr(reverse(g), i + 1, 1) AS INTEGER) AS VARCHAR), ''), "
            "lambda c: CAST(c AS INTEGER))) END)) % 10 = 0")
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS DOUBLE))) <= 255"),
        ("card", r"[0-9](?:[ -]?[0-9])+", f"length(g) BETWEEN 14 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(g) BETWEEN 10 AND 15"),
        ("secret", r"[A-Za-z0-9]{32,}", "regexp_full_match(m, '[0-9a-f]+') AND regexp_matches(substr(t, greatest(1, spot - 39), least(spot, 40)), "
                                        "'(?i)token|secret|key|password|passwd')"),
    ]
    parts = "\nUNION ALL\n".join(
        f"""SELECT rid, {rank} AS rank, '{name}' AS kind, spot, spot + length(m) AS stop FROM (
  SELECT rid, t, ms[j] AS m, regexp_replace(ms[j], '[^0-9]+', '', 'g') AS g,
         CAST(list_sum(list_transform(ps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS spot
  FROM (SELECT rid, t, ms, ps, unnest(range(1, len(ms) + 1)) AS j
        FROM (SELECT rid, t, regexp_extract_all(t, {_q(rx)}) AS ms, string_split_regex(t, {_q(rx)}) AS ps FROM doc)))
WHERE {ok}""" for rank, (name, rx, ok) in enumerate(kinds))
    n = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))
    return f"""WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
span AS ({parts}),
joined AS (
  SELECT rid, {n}, string_agg(kind || ':' || spot || ':' || stop, ',' ORDER BY spot, rank) AS spans,
         string_agg(kind || ':' || spot || ':' || stop, ',' ORDER BY spot, rank) FILTER (WHERE kind <> 'secret') AS base
  FROM span GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN joined USING (rid)"""


def hard_negatives_sql() -> str:
    return """WITH x AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


def build_oracle() -> dict[str, str]:
    return {"op1_sharding": sharding_sql(), "op2_quality": quality_sql(), "op4_url_rules": url_sql(),
            "op7_licenses": license_sql(), "op8_pii": pii_sql(), "op12_hard_negatives": hard_negatives_sql()}
