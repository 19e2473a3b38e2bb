"""Operator 8: personal data by proposals, validators and context.

Method: regular expressions propose spans, checksum and range validators (Luhn
for cards, mod-97 for IBANs, byte ranges for addresses, digit counts for
phones) confirm or drop them, and context words before a span raise its score.
The base kinds (email, ip, card, phone) stay whenever their validator holds;
the added kinds need a score of ``ACCEPT``: an IBAN gets it from its checksum,
a secret (long hexadecimal run) only from a context word.

Positions: a text is split by the same expression that proposes the spans, so
piece and match lengths alternate; their running sums are the positions. The
sums are taken in blocks, so a text with very many spans stays cheap. The
expressions start runs at their first character and repeat without bound only
what cannot match in two ways, so they are linear in the text.

An IBAN has the length of its country, whatever stands behind it. Only its
first four characters are a match, the rest is looked ahead at: a code that is
no IBAN never hides one that begins inside of it. A code of no country of the
registry is taken as far as capitals and digits go.

Plan: one map over the documents, no shuffle, no Python.

Defined results: a null or empty text has no spans; repeated rows each keep
their result; other columns are ignored (``redact`` keeps all columns).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

ACCEPT = 0.5
CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: str            # SQL condition on ``m``, the match
    gate: str             # SQL condition on ``t``, true for every text with a match
    score: float          # once valid
    context: str = ""     # expression for the words before a span
    bonus: float = 0.0
    base: bool = False
    whole: str = ""       # expression for the span from the place of a match on, where the match only begins it


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]+', '')"


#: Luhn: from the right, every second digit is doubled, nines are cast out.
LUHN = """aggregate(transform(reverse(split({d}, '')), (c, i) -> CASE WHEN i % 2 = 0 THEN CAST(c AS INT)
          WHEN CAST(c AS INT) < 5 THEN 2 * CAST(c AS INT) ELSE 2 * CAST(c AS INT) - 9 END), 0, (a, v) -> a + v) % 10 = 0"""

#: mod-97: the first four characters go to the end, letters count from ten.
MOD97 = """aggregate(split(concat(substring({x}, 5), substring({x}, 1, 4)), ''), 0,
           (a, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (a * 10 + CAST(c AS INT)) % 97
                          ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"""


def _let(value: str, body: str) -> str:
    """``body`` over ``v``, with ``value`` worked out once."""
    return f"transform(array({value}), v -> {body})[0]"


#: Lengths of IBANs by country (registry of ISO 13616, and the countries that use the form without an entry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE GG IE IM JE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BL CF CG DJ FR GA GF GP GQ GR IT KM MC MF MG MQ MR NC PF PM RE SM TD TF WF YT BI",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """An IBAN up to its last character."""
    by_length = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
    known = "|".join(c.replace(" ", "|") for c in IBAN_LENGTHS.values())
    other = f"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}+"
    return f"(?:{by_length}|{other})(?![A-Za-z0-9])"


IBAN = _iban()

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
         "true", "contains(t, '@')", 0.9, r"(?i)mail|contact", 0.1, True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
         r"forall(split(m, '[.]'), p -> regexp_like(p, '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$'))",
         "regexp_like(t, '[0-9][.][0-9]')", 0.7, r"(?i)\bip\b|address|host", 0.2, True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++",
         _let(_digits("m"), "CASE WHEN length(v) BETWEEN 14 AND 19 THEN " + LUHN.format(d="v") + " ELSE false END"),
         "regexp_like(t, '[0-9]([ -]?[0-9]){13}')", 0.8, r"(?i)card|visa|credit", 0.2, True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]",
         f"length({_digits('m')}) BETWEEN 10 AND 15", "contains(t, '+')", 0.7, r"(?i)phone|tel|call", 0.2, True),
    Kind("iban", f"(?<![A-Za-z0-9])(?={IBAN})[A-Z]{{2}}[0-9]{{2}}",
         _let("replace(m, ' ', '')", "CASE WHEN length(v) BETWEEN 15 AND 34 THEN " + MOD97.format(x="v") + " ELSE false END"),
         "regexp_like(t, '[A-Z]{2}[0-9]{2}')", 0.6, r"(?i)iban|account|konto", 0.3, whole=IBAN),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])", "true",
         "regexp_like(t, '[0-9a-f]{32}')", 0.3, r"(?i)token|secret|key|password|passwd", 0.5),
)


def _running_sums(a: str, block: int = 256) -> str:
    """Sums of all elements before each one, in two levels."""
    total = f"transform(sequence(0, (size(b) - 1) div {block}), k -> aggregate(slice(b, k * {block} + 1, {block}), 0L, (s, v) -> s + v))"
    outer = "transform(sequence(0, size(c) - 1), k -> aggregate(slice(c, 1, k), 0L, (s, v) -> s + v))"
    inner = f"transform(b, (v, i) -> o[i div {block}] + aggregate(slice(b, (i div {block}) * {block} + 1, i % {block}), 0L, (s, w) -> s + w))"
    return f"transform(array({a}), b -> transform(array({total}), c -> transform(array({outer}), o -> {inner})[0])[0])[0]"


def _sql(text: str) -> str:
    """A SQL string literal for an expression (raw, so backslashes stay)."""
    return 'r"' + text + '"' if '"' not in text else "r'" + text + "'"


SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint,score:double>"


def _spans(rank: int, k: Kind) -> str:
    """Accepted spans of one kind in ``t``, as an array of ``SPAN``."""
    rx = _sql(k.pattern)
    # lengths of piece, match, piece, match ...: a match starts at every second sum
    lengths = "flatten(zip_with(slice(p, 1, size(f)), f, (a, m) -> array(CAST(length(a) AS LONG), CAST(length(m) AS LONG))))"
    context = (f"CASE WHEN regexp_like(substring(t, CAST(greatest(1, s - {CONTEXT_CHARS} + 1) AS INT), "
               f"CAST(least(s, {CONTEXT_CHARS}) AS INT)), {_sql(k.context)}) THEN {k.bonus}D ELSE 0D END")
    valid = f"transform(array(m), m -> {k.valid})[0]"
    # what a match only begins is read on from its place: no IBAN is longer than 34 characters and as many blanks
    spans = f"transform(f, (m, i) -> regexp_extract(substring(t, CAST(at[2 * i + 1] + 1 AS INT), 69), {_sql(k.whole)}, 0))" if k.whole else "f"
    rows = (f"transform({spans}, (m, i) -> struct(at[2 * i + 1] AS start, {rank} AS rank, '{k.name}' AS kind, "
            f"at[2 * i + 1] + length(m) AS stop, CASE WHEN {valid} THEN {k.score}D ELSE 0D END AS score))")
    scored = (f"transform({rows}, x -> CASE WHEN x.score > 0 THEN transform(array(x.start), s -> struct(x.start AS start, x.rank AS rank, "
              f"x.kind AS kind, x.stop AS stop, x.score + {context} AS score))[0] ELSE x END)")
    accepted = f"filter({scored}, x -> x.score >= {ACCEPT})"
    found = (f"transform(array(regexp_extract_all(t, {rx}, 0)), f -> CASE WHEN size(f) = 0 THEN cast(array() as array<{SPAN}>) ELSE "
             f"transform(array(split(t, {rx}, -1)), p -> transform(array({_running_sums(lengths)}), at -> "
             f"CAST({accepted} AS array<{SPAN}>))[0])[0] END)[0]")
    return f"CASE WHEN {k.gate} THEN {found} ELSE cast(array() as array<{SPAN}>) END"


def with_spans(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, name: str = "_spans") -> DataFrame:
    """``docs`` with ``name``: accepted spans by start, then kind; code points, end exclusive."""
    keep = docs.columns
    x = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(keep)],
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    x = x.select("*", *[F.expr(_spans(i, k)).alias(f"k_{i}") for i, k in enumerate(kinds)])
    return x.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)],
                    F.sort_array(F.concat(*[f"k_{i}" for i in range(len(kinds))])).alias(name))


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts per base kind, base_sha256 and spans of every document."""
    x = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = [k.name for k in KINDS if k.base]
    digest = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"
    only = "filter(_spans, x -> x.kind IN ({}))".format(", ".join(f"'{k}'" for k in base))
    return x.select("doc_id", *[F.expr(f"CAST(size(filter(_spans, x -> x.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in base],
                    F.sha2(F.expr(digest.format(only)), 256).alias("base_sha256"),
                    F.expr(digest.format("_spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every accepted span replaced by ``<KIND>``; a null text stays null.

    Spans that overlap become one, named after the first.
    """
    # working names that no column of the caller has
    spans = free_name(docs, "_spans")
    x = with_spans(docs, text_col, name=spans)
    m = free_name(x, "_merged")
    # spans in order; one that begins inside an earlier one only lengthens it
    merged = f"""aggregate(`{spans}`, cast(array() as array<{SPAN}>), (a, x) -> CASE
        WHEN size(a) > 0 AND x.start < element_at(a, -1).stop THEN concat(slice(a, 1, size(a) - 1), array(
            named_struct('start', element_at(a, -1).start, 'rank', element_at(a, -1).rank, 'kind', element_at(a, -1).kind,
                         'stop', greatest(element_at(a, -1).stop, x.stop), 'score', element_at(a, -1).score)))
        ELSE concat(a, array(x)) END)"""
    x = x.withColumn(m, F.expr(merged))
    parts = f"""concat(transform(`{m}`, (x, i) -> concat(
        substring(`{text_col}`, CAST(CASE WHEN i = 0 THEN 0 ELSE `{m}`[i - 1].stop END + 1 AS INT),
                  CAST(x.start - CASE WHEN i = 0 THEN 0 ELSE `{m}`[i - 1].stop END AS INT)), '<', upper(x.kind), '>')),
        array(substring(`{text_col}`, CAST(element_at(`{m}`, -1).stop + 1 AS INT))))"""
    text = F.expr(f"CASE WHEN size(`{m}`) > 0 THEN array_join({parts}, '') ELSE `{text_col}` END")
    return x.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
