"""Quote derivation and display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import fmt_adaptive, fmt_cap, fmt_scaled, fmt_sign, leading_number

DEFAULT_PE = 25.0
OPEN_HOUR, CLOSE_HOUR = 9, 16

# What a listing says of its sector; any other table does as well.
SECTOR_BLURBS = {
    "Technology": "software, cloud and data",
    "Biotech": "drug discovery",
    "Healthcare": "clinics, devices and care",
    "Energy": "oil, gas and renewables",
    "Industrials": "machines, transport and building",
    "Financials": "banks, insurers and exchanges",
    "Materials": "metals, chemicals and paper",
    "Consumer": "shops, brands and household goods",
    "Communications": "telecoms and media",
    "Utilities": "electricity, water and heat",
    "Semiconductors": "chips and the tools that make them",
}
DEFAULT_BLURB = "no sector description"


def derive_quote(df: DataFrame) -> DataFrame:
    """price, chg and chg_pct from (prev_close, day_move, offset)."""
    return (
        df.withColumn("price", F.col("prev_close") * (1 + F.col("day_move") + F.col("offset")))
        .withColumn("chg", F.col("price") - F.col("prev_close"))
        .withColumn("chg_pct", F.col("chg") / F.col("prev_close") * 100)
        .drop("day_move", "offset")
    )


def heat(chg_pct: Column, mcap: Column) -> Column:
    """Size-weighted move; NULL without a positive market cap."""
    return F.when(mcap > 0, F.abs(chg_pct) * F.log10(mcap))


def direction(chg_pct: Column) -> Column:
    """Standing direction: flat counts as up."""
    return F.when(chg_pct >= 0, "up").otherwise("down")


def market_open(ts: Column) -> Column:
    return F.hour(ts).between(OPEN_HOUR, CLOSE_HOUR - 1)


def eps(price: Column, pe: Column) -> Column:
    """Earnings per share; a missing or zero P/E falls back to the default multiple."""
    return price / F.coalesce(F.nullif(leading_number(pe), F.lit(0.0)), F.lit(DEFAULT_PE))


def lookup(key: Column, entries: dict[str, str], default: str) -> Column:
    """Constant table lookup with a default, as a literal map so no join is needed."""
    pairs = F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def tape_columns(df: DataFrame) -> DataFrame:
    """Display columns of the ticker tape."""
    return df.select(
        "ord",
        "kind",
        "sym",
        "sector",
        fmt_adaptive(F.col("price"), 5000, 1).alias("price_text"),
        fmt_sign(F.col("chg_pct")).alias("chg_text"),
        fmt_cap(F.col("mcap_num")).alias("cap_text"),
        fmt_scaled(F.abs("chg_pct"), 2).alias("move_text"),
        direction(F.col("chg_pct")).alias("dir"),
    )
