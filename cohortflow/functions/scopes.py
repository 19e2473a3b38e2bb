"""Vertical ("scope") predicates over partner attributes.

A scope decides which orders belong to a vertical. Scopes overlap (QC contains
Local Stores, which contains Market/Pharmacy/Drinks/Kiosks), so an order can be
in up to three of them; ``partner_scopes`` attaches to each partner the array
of scopes it belongs to, and the report explodes that array -- one pass for
all verticals instead of one query per vertical.

Two predicate sets exist because the Market report segments users on
non-dark Market partners but reports orders of every Market partner.
NULL semantics follow SQL: a predicate that is NULL keeps the order out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import VERTICALS

# Fixed values of the original predicates.
EXCLUDED_TYPES = ("Restaurant", "Coffee")
MARKET = "Market"
SUPERMARKET_LABEL = "Supermercados"
SPECIALTY_LABEL = "Comercios Especializados"
SUPERMARKET_PREFIXES = ("SUPERMERCADO", "MINIMERCADO")
SUPERMARKET_EXACT = "EXPRESS"
NO_CATEGORY = "Without Category"


# The predicates are written once, as SQL expression text over the flat
# partner columns (is_darkstore, business_type_name, category_name): the scope
# arrays are built from them in one projection (one parse in the JVM instead
# of hundreds of Column objects over py4j), and the Column forms below wrap
# the same text.

def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


SQL_NOT_DARK = "NOT coalesce(is_darkstore, false)"
SQL_NOT_EXCLUDED = (f"(business_type_name IS NOT NULL AND business_type_name NOT IN "
                    f"({', '.join(_q(t) for t in EXCLUDED_TYPES)}))")


def segment_predicate_sql(vertical: str) -> str:
    if vertical == "DMarts":
        return "coalesce(is_darkstore, false)"
    if vertical == "QC":
        return SQL_NOT_EXCLUDED
    if vertical == "Local Stores":
        return f"({SQL_NOT_DARK} AND {SQL_NOT_EXCLUDED})"
    return f"({SQL_NOT_DARK} AND coalesce(business_type_name = {_q(vertical)}, false))"


def final_predicate_sql(vertical: str) -> str:
    if vertical == MARKET:
        return f"coalesce(business_type_name = {_q(MARKET)}, false)"
    return segment_predicate_sql(vertical)


SQL_IS_SUPERMARKET = (
    f"(upper(coalesce(category_name, {_q(NO_CATEGORY)})) LIKE '{SUPERMARKET_PREFIXES[0]}%' OR "
    f"upper(coalesce(category_name, {_q(NO_CATEGORY)})) LIKE '{SUPERMARKET_PREFIXES[1]}%' OR "
    f"upper(coalesce(category_name, {_q(NO_CATEGORY)})) = '{SUPERMARKET_EXACT}')")
SQL_MARKET_SUBLABEL = (
    f"CASE WHEN {SQL_IS_SUPERMARKET} THEN {_q(SUPERMARKET_LABEL)} "
    f"WHEN upper(business_type_name) = {_q(MARKET.upper())} AND NOT is_darkstore "
    f"AND NOT {SQL_IS_SUPERMARKET} THEN {_q(SPECIALTY_LABEL)} END")


def segment_predicate(vertical: str) -> Column:
    """Scope of the segment definitions (New / Acquisition / Reactivated)."""
    return F.expr(segment_predicate_sql(vertical))


def market_sublabel() -> Column:
    """Market report label; NULL drops the order (``HAVING vertical IS NOT NULL``).

    Dark partners can only be labelled by category: the second branch needs
    ``NOT is_darkstore`` to be TRUE, so a NULL flag leaves the label NULL.
    """
    return F.expr(SQL_MARKET_SUBLABEL)


def flat_partner(dim_partner: DataFrame, *more: str) -> DataFrame:
    return dim_partner.select(
        "partner_id", "is_darkstore",
        F.col("business_type.business_type_name").alias("business_type_name"),
        F.col("businessCategory.name").alias("category_name"), *more,
    )


# A row of orders carries the cells (scope, vertical) it counts in as fields of one
# BIGINT, CELL_BITS bits each: flags of a row times the partner's bits put the flags
# into every cell of the partner, and bit_or merges rows.
CELL_BITS = 6


def final_cells(verticals=VERTICALS) -> list[tuple[str, str]]:
    """The (scope, reported vertical) pairs of the report; at most 8, so their fields fit a BIGINT."""
    return [(v, label) for v in verticals
            for label in ((SUPERMARKET_LABEL, SPECIALTY_LABEL) if v == MARKET else (v,))]


def partner_scopes(dim_partner: DataFrame, verticals=VERTICALS) -> DataFrame:
    """partner_id, seg_scopes array<string>, final_bits (lowest bit of the field of every final cell).

    Partners in no scope are dropped: every report predicate rejects them, so
    the later fact join can be inner.
    """
    p = flat_partner(dim_partner)
    seg_items = ", ".join(f"CASE WHEN {segment_predicate_sql(v)} THEN {_q(v)} END" for v in verticals)
    bits = []
    for i, (v, label) in enumerate(final_cells(verticals)):
        named = f" AND ({SQL_MARKET_SUBLABEL}) = {_q(label)}" if v == MARKET else ""
        bits.append(f"CASE WHEN {final_predicate_sql(v)}{named} THEN {1 << (CELL_BITS * i)}L ELSE 0L END")
    out = p.selectExpr(
        "partner_id",
        f"filter(array({seg_items}), x -> x IS NOT NULL) AS seg_scopes",
        f"{' | '.join(bits)} AS final_bits")
    return out.where("size(seg_scopes) > 0 OR final_bits <> 0")
