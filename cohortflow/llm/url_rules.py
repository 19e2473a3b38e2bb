"""Operator 4: URL verdicts from pattern rules found by their rarest literal token.

Method: every rule is a regular expression over ``host + path`` with literal
tokens (runs of ``[a-z0-9]``). A rule is indexed under that one of its tokens
which fewest URLs hold, counted over all URLs. The tokens of a URL fetch their
rules from the index, and only those run their expression. Among the rules
that match, the one of highest priority and then the longest decides.

Plan: one pass counts the rules' own tokens (bounded by the rules), one pass
explodes the URL tokens, joins them with the index and reduces per row; the
reduction is combined map-side, since the tokens of a row stay together. The
index is broadcast only up to ``broadcast_rules`` rules and joined by token
beyond that. Texts and html are never read.

Defined results: a null URL, or one without ``://``, has empty host and path,
so no host rule fits it, and it is allowed. A rule without any literal token
is held by every URL (it is indexed under the empty token). Repeated rows each
get their own result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UrlRule:
    verdict: str          # allow or block
    name: str             # what is reported
    pattern: str          # expression over host + path (lower-case host)
    literals: tuple[str, ...]   # tokens that every matching URL must hold
    priority: int = 0


def host_rule(verdict: str, rule: str) -> UrlRule:
    """A rule ``host/path``: the host with all its subdomains, paths that start with the path."""
    host, _, path = rule.partition("/")
    # the last token of the path may go on in the URL, so it is no whole token
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"[A-Za-z0-9]+(?![A-Za-z0-9]|$)", path)
    # one literal text; a pattern in the form of Java's expressions
    pattern = r"^([^/]*\.)?" + _quote(host) + "/" + _quote(path)
    return UrlRule(verdict, rule, pattern, tuple(t.lower() for t in whole), 1)


def word_rule(verdict: str, name: str, *tokens: str) -> UrlRule:
    """A rule on whole tokens of the host that stand side by side."""
    between = r"[^a-z0-9/]"
    return UrlRule(verdict, name, rf"^([^/]*{between})?" + between.join(tokens) + rf"({between}[^/]*)?(/|$)", tokens)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


#: The rules of the query's contract (fixed values).
HOST_RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)

#: Host words of gambling, adult, advertising and spam sites.
WORD_RULES = (
    word_rule("block", "casino", "casino"),
    word_rule("block", "casino-win", "casino", "win"),
    word_rule("block", "free-bets", "free", "bets"),
    word_rule("block", "adult", "adult"),
    word_rule("block", "xxx", "xxx"),
    word_rule("block", "cheap-pills", "cheap", "pills"),
    word_rule("block", "spam-farm", "spam", "farm"),
    word_rule("block", "ads-track", "ads", "track"),
    word_rule("block", "doubleclick", "doubleclick"),
)


#: So many rules are written into the plan itself; more are a table of their own.
LITERAL_RULES = 500


def host_and_path(url) -> tuple[F.Column, F.Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_verdicts(pages: DataFrame, rules: tuple[UrlRule, ...] = HOST_RULES + WORD_RULES,
                 id_col: str = "page_id", url_col: str = "url",
                 broadcast_rules: int = 20_000) -> DataFrame:
    """page_id, host, path, rule (host rules only), verdict, matched (the deciding rule)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # the empty token is in every URL: it fetches rules that have no literal
    tokens = F.array_distinct(F.concat(
        F.filter(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"), lambda t: t != ""), F.array(F.lit(""))))
    urls = urls.withColumn("_tokens", tokens)

    small = len(rules) <= broadcast_rules
    row = lambda i, r: (i, r.verdict, r.name, r.pattern, r.priority, len(r.name), list(r.literals) or [""])
    names = ["rule_id", "r_verdict", "r_name", "r_pattern", "r_priority", "r_length", "r_literals"]
    if 0 < len(rules) <= LITERAL_RULES:      # part of the plan: no Python worker reads them
        structs = [F.struct(*[F.array(*map(F.lit, v)).alias(c) if isinstance(v, list) else F.lit(v).alias(c) for c, v in zip(names, row(i, r))])
                   for i, r in enumerate(rules)]
        rule_rows = spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    else:
        rule_rows = spark.createDataFrame([row(i, r) for i, r in enumerate(rules)],
                                          "rule_id int, r_verdict string, r_name string, r_pattern string, r_priority int, r_length int, "
                                          "r_literals array<string>")
    rule_tokens = rule_rows.select("rule_id", F.explode("r_literals").alias("token"))
    near = F.broadcast if small else (lambda df: df)
    wanted = rule_tokens.select("token").distinct()
    counts = (urls.select(F.explode("_tokens").alias("token")).join(near(wanted), "token", "left_semi")
              .groupBy("token").agg(F.count("*").alias("n")))
    # per rule the token of fewest URLs; a token that no URL holds is the rarest
    index = (rule_tokens.join(counts, "token", "left")
             .groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("_token"))
             .join(rule_rows.drop("r_literals"), "rule_id"))

    rows = (urls.withColumn("_row", F.monotonically_increasing_id())
            .select("_row", "page_id", "host", "path", F.explode("_tokens").alias("_token"))
            .join(near(index), "_token", "left"))
    hit = F.expr("host <> '' AND regexp_like(concat(host, path), r_pattern)")
    best = F.max(F.when(hit, F.struct("r_priority", "r_length", "r_name", "r_verdict")))
    return (rows.groupBy("_row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"),
                                     F.first("path").alias("path"), best.alias("_best"))
            .select("page_id", "host", "path",
                    F.when(F.col("_best.r_priority") > 0, F.col("_best.r_name")).alias("rule"),
                    F.coalesce("_best.r_verdict", F.lit("allow")).alias("verdict"),
                    F.col("_best.r_name").alias("matched")))
