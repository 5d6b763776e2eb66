"""Shared pieces of the checking SQL: the derived relations as common table expressions."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """Prefix ``body`` with the named relations and whatever they depend on."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in CTES[n][0]:
            visit(dep)
        ordered.append(n)

    for n in needs:
        visit(n)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body


def fixed(x: str, d: int) -> str:
    """C printf rounds the exact binary value half-even; nudge the exact ties away from zero."""
    p = 2 ** (d + 1)
    nudge = 10.0 ** -(d + 1)
    return (
        f"CASE WHEN {x} = 0 THEN printf('%.{d}f', 0.0::DOUBLE) WHEN abs({x})*{p} = floor(abs({x})*{p}) AND CAST(floor(abs({x})*{p}) AS HUGEINT) % 2 = 1 "
        f"THEN printf('%.{d}f', ({x}) + sign({x})*{nudge:.{d + 1}f}::DOUBLE) ELSE printf('%.{d}f', {x}) END"
    )


def grouped(x: str, d: int) -> str:
    return f"format('{{:,.{d}f}}', round({x}, {d}))"


cte(
    "prices",
    """SELECT l_partkey AS pk, 'P' || l_partkey AS sym, CAST(l_shipdate AS DATE) AS dt,
       CAST((200 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) + sum(CAST(l_quantity AS BIGINT)))
            // (2 * sum(CAST(l_quantity AS BIGINT))) AS BIGINT) / 10000.0::DOUBLE AS price,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
       CAST(sum(CAST(round(l_tax * 100) AS BIGINT) - CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS lean,
       CAST(sum(CAST(round(l_tax * 100) AS BIGINT) - CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100)::DOUBLE AS drift
    FROM lineitem GROUP BY 1, 2, 3""",
)
cte(
    "series",
    """SELECT pk, sym, dt, price, lean, row_number() OVER (PARTITION BY pk ORDER BY dt) - 1 AS i,
       count(*) OVER (PARTITION BY pk) AS n FROM prices""",
    "prices",
)
cte(
    "instruments",
    """SELECT p_partkey AS ord, 'P' || p_partkey AS sym, p_name AS name, p_type AS sector, p_retailprice AS base,
       p_retailprice * v.volume AS mcap_num,
       CASE WHEN p_size % 7 = 0 THEN '—' ELSE CAST(p_size AS VARCHAR) END AS pe, p_brand = 'Brand#1' AS curated
    FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
                         FROM lineitem GROUP BY 1) v ON v.l_partkey = p_partkey""",
)
cte(
    "last_two",
    """SELECT pk, max(price) FILTER (rn = 1) AS last_px, max(drift) FILTER (rn = 1) AS drift,
       max(dt) FILTER (rn = 1) AS last_dt, max(price) FILTER (rn = 2) AS prior_px
    FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY dt DESC) AS rn FROM prices) GROUP BY pk""",
    "prices",
)
cte(
    "quotes",
    """SELECT *, price - prev_close AS chg, (price - prev_close) / prev_close * 100 AS chg_pct FROM (
         SELECT i.*, coalesce(prior_px, last_px, base) AS prev_close,
           coalesce(prior_px, last_px, base) * (1 + coalesce(last_px / coalesce(prior_px, last_px) - 1, 0)
             + CASE WHEN drift IS NULL THEN 0 ELSE greatest(-0.06::DOUBLE, least(0.06::DOUBLE, drift)) END) AS price
         FROM instruments i LEFT JOIN last_two t ON t.pk = i.ord)""",
    "instruments",
    "last_two",
)
cte(
    "screen",
    """SELECT *, CASE WHEN mcap_num > 0 THEN abs(chg_pct) * log10(mcap_num) END AS heat FROM quotes""",
    "quotes",
)
cte(
    "holdings",
    """SELECT o_custkey AS account, l_partkey AS ord, 'P' || l_partkey AS sym,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS shares,
       CAST((200 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) + sum(CAST(l_quantity AS BIGINT)))
            // (2 * sum(CAST(l_quantity AS BIGINT))) AS BIGINT) / 10000.0::DOUBLE AS cost
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
)
cte(
    "watch",
    """SELECT DISTINCT o_custkey AS account, l_partkey AS pk, 'P' || l_partkey AS sym FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
cte(
    "positions",
    """SELECT h.account, h.ord, h.sym, h.shares, h.cost, q.price, q.price * h.shares AS mv, h.cost * h.shares AS cost_basis,
       (q.price - q.prev_close) * h.shares AS day_pl
    FROM holdings h LEFT JOIN quotes q ON q.sym = h.sym""",
    "holdings",
    "quotes",
)
cte(
    "ranged",
    """SELECT s.pk, s.sym, s.dt, s.price, r.range_id, r.range_ord
    FROM series s JOIN last_two t ON t.pk = s.pk
    JOIN (VALUES ('1D', 0, 1), ('1W', 1, 7), ('1M', 2, 30), ('3M', 3, 91), ('1Y', 4, 365)) r(range_id, range_ord, days)
      ON date_diff('day', s.dt, t.last_dt) <= r.days""",
    "series",
    "last_two",
)
cte(
    "perf",
    """SELECT q.sym, f.range_id, f.range_ord, q.price - f.base_px AS chg, (q.price - f.base_px) / f.base_px * 100 AS chg_pct FROM (
         SELECT g.*, CASE WHEN range_id = '1D' THEN qq.prev_close WHEN points = 1 THEN qq.price ELSE first_px END AS base_px FROM (
           SELECT pk, range_id, range_ord, arg_min(price, dt) AS first_px, count(*) AS points FROM ranged GROUP BY 1, 2, 3) g
         JOIN quotes qq ON qq.ord = g.pk) f
       JOIN quotes q ON q.ord = f.pk""",
    "ranged",
    "quotes",
)
