"""Weighted candidate scoring, verdicts, ranking and reports.

A candidate carries its scores as a map, so scoring is a projection over the fixed factor catalog: no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import js_round
from ledgerloom.operators.ordering import global_rank

# Factor weights in catalog order.
FACTORS = {
    "customerProblem": 3,
    "demandEvidence": 3,
    "grossMarginPotential": 3,
    "differentiation": 2,
    "competitiveDensity": 2,
    "demonstrability": 2,
    "creativePotential": 2,
    "shippingSimplicity": 2,
    "returnRisk": 2,
    "breakageRisk": 1,
    "qualityRisk": 2,
    "supplierReliability": 2,
    "repeatPurchase": 1,
    "bundlePotential": 1,
    "seasonalityStability": 1,
    "regulatoryRisk": 3,
}
# Knockout names.
KNOCKOUTS = ("regulatedCategory", "ipRisk", "marginBelowFloor", "unsafeToShip", "platformProhibited")
# Stand-in for an unknown score, top score, verdict order and thresholds in percent.
UNKNOWN_SCORE = 2
TOP_SCORE = 5
VERDICT_ORDER = ("SHORTLIST", "HOLD", "NEEDS_RESEARCH", "REJECT")
CONFIDENCE_FLOOR, SHORTLIST_PCT, HOLD_PCT = 60, 70, 55
GROSS_MARGIN_FLOOR, CONTRIBUTION_FLOOR = 0.60, 0.40
DEMAND_CAP = 3
RELIABILITY = {"H": 10, "M": 6, "L": 3}  # tenths; our own weights

ALL_WEIGHT = sum(FACTORS.values())
MAX_TOTAL = TOP_SCORE * ALL_WEIGHT

CANDIDATE_SCHEMA = "id string, name string, scores map<string,int>, knockouts map<string,boolean>"


def _over_factors(term: str, glue: str = " + ") -> str:
    """SQL over the whole catalog; {s} is the factor's score, {f} its name, {w} its weight."""
    return glue.join(
        term.format(s=f"try_element_at(scores, '{f}')", f=f, w=w) for f, w in FACTORS.items()
    )


def invalid_reasons() -> Column:
    """Everything wrong with a candidate, as a list of messages."""
    out_of_range = F.map_filter("scores", lambda k, v: k.isin(*FACTORS) & ~v.between(1, TOP_SCORE))
    bad_scores = F.transform(
        F.map_entries(out_of_range), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    unknown = F.transform(
        F.map_keys(F.map_filter("knockouts", lambda k, v: v & ~k.isin(*KNOCKOUTS))),
        lambda k: F.concat(F.lit("unknown knockout "), k),
    )
    return F.concat(F.coalesce(bad_scores, F.array()), F.coalesce(unknown, F.array()))


def split_valid(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid candidates, and the rejected ones with their reasons."""
    checked = cands.withColumn("reasons", invalid_reasons())
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def require_valid(cands: DataFrame) -> DataFrame:
    """The candidates as they are; running it fails on the first one with a bad score or an unknown knockout."""
    reasons = invalid_reasons()
    failed = F.raise_error(F.concat(F.lit("candidate "), F.col("id"), F.lit(": "), F.array_join(reasons, "; ")))
    return cands.where(F.when(F.size(reasons) == 0, F.lit(True)).otherwise(failed.cast("boolean")))


def score(cands: DataFrame) -> DataFrame:
    """Totals, confidence, unknown factors, active knockouts and the verdict."""
    total = F.expr(_over_factors(f"coalesce({{s}}, {UNKNOWN_SCORE}) * {{w}}")).cast("bigint")
    known_weight = F.expr(_over_factors("if({s} IS NULL, 0, {w})"))
    missing = F.expr(f"array_compact(array({_over_factors("if({s} IS NULL, '{f}', NULL)", ', ')}))")
    out_by = F.map_keys(F.map_filter("knockouts", lambda k, v: F.coalesce(v, F.lit(False))))
    scored = (
        cands.withColumn("total", total)
        .withColumn("max_total", F.lit(MAX_TOTAL))
        .withColumn("known_weight", known_weight)
        .withColumn("unknowns", missing)
        .withColumn("known", F.lit(len(FACTORS)) - F.size("unknowns"))
        .withColumn("knocked_out_by", F.coalesce(out_by, F.array()))
        .withColumn("pct", F.col("total") / MAX_TOTAL)
        .withColumn("confidence", F.col("known_weight") / ALL_WEIGHT)
    )
    return scored.withColumn("verdict", verdict())


def verdict() -> Column:
    """Whole-number thresholds, so 70% exactly is in."""
    return (
        F.when(F.size("knocked_out_by") > 0, "REJECT")
        .when(F.col("known_weight") * 100 < CONFIDENCE_FLOOR * ALL_WEIGHT, "NEEDS_RESEARCH")
        .when(F.col("total") * 100 >= SHORTLIST_PCT * MAX_TOTAL, "SHORTLIST")
        .when(F.col("total") * 100 >= HOLD_PCT * MAX_TOTAL, "HOLD")
        .otherwise("REJECT")
    )


def rank_order() -> list[Column]:
    place = F.array_position(F.array(*[F.lit(v) for v in VERDICT_ORDER]), F.col("verdict"))
    return [place, F.desc("total"), F.asc("ord")]


def rank(scored: DataFrame) -> DataFrame:
    """Verdict order, then score, then input order."""
    return global_rank(scored, rank_order())


def shortlist(scored: DataFrame, size: int = 3) -> DataFrame:
    """Best candidates that may proceed, with a flag telling whether enough qualified."""
    fit = scored.where(
        F.col("verdict").isin("SHORTLIST", "HOLD") & (F.col("known_weight") * 100 >= CONFIDENCE_FLOOR * ALL_WEIGHT)
    )
    head = fit.orderBy(*rank_order()).limit(size)
    every = Window.partitionBy()  # over the few rows kept
    return head.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())).cast("bigint")).withColumn(
        "enough", F.count(F.lit(1)).over(every) == size
    )


def verify_queue(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("total") * 100 >= HOLD_PCT * MAX_TOTAL)


def _percent(c: Column) -> Column:
    return F.concat(js_round(c * 100).cast("string"), F.lit("%"))


def report_line() -> Column:
    """Table line of a ranked candidate."""
    dash = lambda c: F.when(F.size(c) == 0, "—").otherwise(F.array_join(c, ", "))
    cells = [
        F.col("rank").cast("string"),
        F.col("id"),
        F.col("name"),
        _percent(F.col("pct")),
        _percent(F.col("confidence")),
        F.concat(F.lit("**"), F.col("verdict"), F.lit("**")),
        dash("unknowns"),
        dash("knocked_out_by"),
    ]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def apply_consistency_rules(cands: DataFrame) -> DataFrame:
    """Cap demand evidence without a quantitative source; blank reliability while suppliers are unverified."""

    def rule(k: Column, v: Column) -> Column:
        capped = F.when((k == "demandEvidence") & ~F.col("quantitative"), F.least(v, F.lit(DEMAND_CAP)))
        blanked = (k == "supplierReliability") & ~F.col("verified")
        return F.when(blanked, F.lit(None).cast("int")).otherwise(F.coalesce(capped, v))

    return cands.withColumn("scores", F.transform_values("scores", rule))


def evidence_confidence(cands: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of factor weight backed by evidence, each known factor scaled by its most reliable source."""
    weight = F.create_map(*[F.lit(x) for kv in RELIABILITY.items() for x in kv])
    best = evidence.groupBy("id", "factor").agg(F.max(weight[F.col("reliability")]).alias("tenths"))
    catalog = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])
    known = cands.select("id", F.explode("scores").alias("factor", "score")).where("score IS NOT NULL")
    backed = (
        known.join(best, ["id", "factor"], "left")
        .withColumn("w", catalog[F.col("factor")])
        .groupBy("id")
        .agg(F.sum(F.col("w") * F.coalesce("tenths", F.lit(0))).alias("got"))
    )
    return backed.select("id", (F.col("got") / (10 * ALL_WEIGHT)).alias("evidence_confidence"))


def margin_floor(df: DataFrame) -> DataFrame:
    """Both floors on the mid case; exactly on a floor passes."""
    price = F.col("price")
    gross = (price - F.col("landed")) / price
    contribution = (price - F.col("landed") - F.col("ship") - F.col("fees")) / price
    below = (gross < GROSS_MARGIN_FLOOR) | (contribution < CONTRIBUTION_FLOOR)
    return df.withColumn("gross_margin", gross).withColumn("contribution_margin", contribution).withColumn(
        "below_floor", below
    )
