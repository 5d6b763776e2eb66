"""Candidate scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import scoring
from ledgerloom.plans.registry import query
from ledgerloom.plans.sql import cte, sql
from ledgerloom.sources import research

_NAMES = list(scoring.FACTORS)
_W = list(scoring.FACTORS.values())
_raw = lambda o: f"(s_suppkey * {o + 2} + {o}) % 6"
_value = lambda o: (
    f"CASE WHEN s_suppkey % 17 = 3 THEN 7 ELSE nullif({_raw(o)}, 0) END" if o == 5 else f"nullif({_raw(o)}, 0)"
)

cte(
    "cands",
    "SELECT s_suppkey AS ord, 'C-' || s_suppkey AS id, s_name AS name, s_suppkey % 3 = 0 AS quantitative, s_suppkey % 4 = 0 AS verified, "
    + ", ".join(f"{_value(o)} AS f{o}" for o in range(16))
    + ", list_filter(["
    + ", ".join(f"CASE WHEN (s_suppkey + {o}) % 13 = 0 THEN '{k}' END" for o, k in enumerate(scoring.KNOCKOUTS))
    + ", CASE WHEN s_suppkey % 19 = 4 THEN 'tooTrendy' END], lambda x: x IS NOT NULL) AS outs FROM supplier",
)
_BAD = "list_contains(outs, 'tooTrendy') OR coalesce(f5 > 5, false)"


def _scored_cte(name: str, base: str, where: str) -> None:
    cte(
        name,
        f"""SELECT *, CASE WHEN len(outs) > 0 THEN 'REJECT' WHEN known_weight * 100 < 60 * 32 THEN 'NEEDS_RESEARCH'
          WHEN total * 100 >= 70 * 160 THEN 'SHORTLIST' WHEN total * 100 >= 55 * 160 THEN 'HOLD' ELSE 'REJECT' END AS verdict,
          total / 160 AS pct, known_weight / 32 AS confidence FROM (
        SELECT *, {' + '.join(f'coalesce(f{o}, 2) * {w}' for o, w in enumerate(_W))} AS total,
          {' + '.join(f'CASE WHEN f{o} IS NOT NULL THEN {w} ELSE 0 END' for o, w in enumerate(_W))} AS known_weight,
          {' + '.join(f'CASE WHEN f{o} IS NOT NULL THEN 1 ELSE 0 END' for o in range(16))} AS known,
          list_filter([{', '.join(f"CASE WHEN f{o} IS NULL THEN '{n}' END" for o, n in enumerate(_NAMES))}], lambda x: x IS NOT NULL) AS unknowns
        FROM {base} {where})""",
        "cands" if base == "cands" else base,
    )


_scored_cte("cand_scored", "cands", f"WHERE NOT ({_BAD})")
cte(
    "cands_adjusted",
    "SELECT * REPLACE (CASE WHEN quantitative THEN f1 ELSE least(f1, CASE WHEN f1 IS NULL THEN NULL ELSE 3 END) END AS f1, "
    "CASE WHEN verified THEN f11 END AS f11) FROM cands",
    "cands",
)
_scored_cte("cand_scored_adjusted", "cands_adjusted", f"WHERE NOT ({_BAD})")

_RANK = (
    "row_number() OVER (ORDER BY list_position(['SHORTLIST', 'HOLD', 'NEEDS_RESEARCH', 'REJECT'], verdict), total DESC, ord)"
)


def valid(spark, sf_dir):
    return scoring.split_valid(research.candidates(spark, sf_dir))[0]


def scored(spark, sf_dir):
    return scoring.score(valid(spark, sf_dir))


@query(
    "cand_source",
    sql(
        f"""SELECT ord, id, name, {' + '.join(f'CASE WHEN f{o} IS NOT NULL THEN 1 ELSE 0 END' for o in range(16))} AS known,
            len(outs) AS active_knockouts FROM cands""",
        "cands",
    ),
)
def _cand_source(spark, sf_dir):
    """Candidates read back out of JSON documents."""
    rows = research.parse_documents(research.candidate_documents(spark, sf_dir))
    return rows.select(
        "ord",
        "id",
        "name",
        F.size(F.map_filter("scores", lambda k, v: v.isNotNull())).alias("known"),
        F.size(F.map_filter("knockouts", lambda k, v: F.coalesce(v, F.lit(False)))).cast("bigint").alias("active_knockouts"),
    )


@query("cand_score", sql("SELECT id, total, 160 AS max_total, pct, confidence, known FROM cand_scored", "cand_scored"))
def _cand_score(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "total", "max_total", "pct", "confidence", "known")


@query("cand_unknowns", sql("SELECT id, array_to_string(unknowns, ', ') AS unknowns FROM cand_scored", "cand_scored"))
def _cand_unknowns(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.array_join("unknowns", ", ").alias("unknowns"))


@query("cand_knockouts", sql("SELECT id, array_to_string(outs, ', ') AS knocked_out_by FROM cand_scored", "cand_scored"))
def _cand_knockouts(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.array_join("knocked_out_by", ", ").alias("knocked_out_by"))


@query(
    "cand_invalid",
    sql(
        f"""SELECT id, array_to_string(list_filter([CASE WHEN f5 > 5 THEN 'demonstrability=' || f5 END,
              CASE WHEN list_contains(outs, 'tooTrendy') THEN 'unknown knockout tooTrendy' END], lambda x: x IS NOT NULL), '; ') AS reasons
            FROM cands WHERE {_BAD}""",
        "cands",
    ),
)
def _cand_invalid(spark, sf_dir):
    _, rejected = scoring.split_valid(research.candidates(spark, sf_dir))
    return rejected.select("id", F.array_join("reasons", "; ").alias("reasons"))


@query("cand_verdict", sql("SELECT id, verdict FROM cand_scored", "cand_scored"))
def _cand_verdict(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "verdict")


@query("cand_rank", sql(f"SELECT {_RANK} AS rank, id, verdict, pct FROM cand_scored", "cand_scored"))
def _cand_rank(spark, sf_dir):
    return scoring.rank(scored(spark, sf_dir)).select("rank", "id", "verdict", "pct")


@query(
    "cand_shortlist",
    sql(
        f"""SELECT rank, id, n >= 3 AS enough FROM (SELECT id, {_RANK} AS rank, count(*) OVER () AS n FROM cand_scored
            WHERE verdict IN ('SHORTLIST', 'HOLD') AND known_weight * 100 >= 60 * 32) WHERE rank <= 3""",
        "cand_scored",
    ),
)
def _cand_shortlist(spark, sf_dir):
    return scoring.shortlist(scored(spark, sf_dir)).select("rank", "id", "enough")


@query(
    "cand_report",
    sql(
        f"""SELECT rank, '| ' || rank || ' | ' || id || ' | ' || name || ' | ' || CAST(floor(pct * 100 + 0.5) AS BIGINT) || '% | '
              || CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '% | **' || verdict || '** | '
              || CASE WHEN len(unknowns) = 0 THEN '—' ELSE array_to_string(unknowns, ', ') END || ' | '
              || CASE WHEN len(outs) = 0 THEN '—' ELSE array_to_string(outs, ', ') END || ' |' AS line
            FROM (SELECT *, {_RANK} AS rank FROM cand_scored)""",
        "cand_scored",
    ),
)
def _cand_report(spark, sf_dir):
    return scoring.rank(scored(spark, sf_dir)).select("rank", scoring.report_line().alias("line"))


@query("cand_verify_queue", sql("SELECT id, total FROM cand_scored WHERE total * 100 >= 55 * 160", "cand_scored"))
def _cand_verify_queue(spark, sf_dir):
    return scoring.verify_queue(scored(spark, sf_dir)).select("id", "total")


@query(
    "cand_adjust",
    sql("SELECT id, total, confidence, verdict FROM cand_scored_adjusted", "cand_scored_adjusted"),
)
def _cand_adjust(spark, sf_dir):
    return scoring.score(scoring.apply_consistency_rules(valid(spark, sf_dir))).select("id", "total", "confidence", "verdict")


@query(
    "cand_evidence_conf",
    sql(
        "SELECT c.id, sum(w * coalesce(tenths, 0)) / 320 AS evidence_confidence FROM ("
        + " UNION ALL ".join(
            f"SELECT id, {o} AS o, {w} AS w FROM cand_scored WHERE f{o} IS NOT NULL" for o, w in enumerate(_W)
        )
        + """) c LEFT JOIN (SELECT 'C-' || l_suppkey AS id, l_partkey % 16 AS o,
              max(CASE l_returnflag WHEN 'N' THEN 10 WHEN 'R' THEN 6 ELSE 3 END) AS tenths FROM lineitem GROUP BY 1, 2) e
             ON e.id = c.id AND e.o = c.o GROUP BY 1""",
        "cand_scored",
    ),
)
def _cand_evidence_conf(spark, sf_dir):
    return scoring.evidence_confidence(valid(spark, sf_dir), research.evidence(spark, sf_dir))


@query(
    "margin_floor",
    """SELECT sym, gross_margin, contribution_margin, gross_margin < 0.60::DOUBLE OR contribution_margin < 0.40::DOUBLE AS below_floor FROM (
         SELECT sym, (price - landed) / price AS gross_margin, (price - landed - ship - fees) / price AS contribution_margin FROM (
           SELECT 'P' || p_partkey AS sym, p_retailprice AS price, p_retailprice * 0.25 * (1 + (p_partkey % 20) / 20) AS landed,
             p_retailprice * 0.05 + p_size * 2 AS ship, p_retailprice * 0.029 + 0.30 AS fees FROM part))""",
)
def _margin_floor(spark, sf_dir):
    return scoring.margin_floor(research.price_cases(spark, sf_dir)).select(
        "sym", "gross_margin", "contribution_margin", "below_floor"
    )
