"""Address and link columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Campaign convention <EXP-###>_<angle>.
CAMPAIGN = r"^(EXP-[0-9]{3,})_(.+)$"


def query_param(url: str, name: str) -> Column:
    """Query parameter of an address, NULL when absent or empty."""
    return F.nullif(F.regexp_extract(url, f"[?&]{name}=([^&#]*)", 1), F.lit(""))


def utm_fields(url: str) -> list[Column]:
    """source, medium, campaign, experiment, angle and content of a tagged address."""
    campaign = query_param(url, "utm_campaign")
    return [
        query_param(url, "utm_source").alias("source"),
        query_param(url, "utm_medium").alias("medium"),
        campaign.alias("campaign"),
        F.nullif(F.regexp_extract(campaign, CAMPAIGN, 1), F.lit("")).alias("experiment"),
        F.nullif(F.regexp_extract(campaign, CAMPAIGN, 2), F.lit("")).alias("angle"),
        query_param(url, "utm_content").alias("content"),
    ]


# Link syntaxes, fenced blocks, targets that are not files, and fragment mark.
MARKDOWN_LINK = r"\]\(([^)\s]+)\)"
HTML_LINK = r'href="([^"\s]+)"'
FENCE = r"(?s)```.*?```"
NOT_A_FILE = r"^(https?:|mailto:|#)"


def link_targets(text: Column) -> Column:
    """Local link targets outside fenced blocks."""
    body = F.regexp_replace(text, FENCE, "")
    found = F.concat(F.regexp_extract_all(body, F.lit(MARKDOWN_LINK), 1), F.regexp_extract_all(body, F.lit(HTML_LINK), 1))
    return F.filter(found, lambda t: ~t.rlike(NOT_A_FILE))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/]+([^?#]*)", 1)


def resolve_path(base: Column, target: Column) -> Column:
    """Absolute path of a target: from the root when it starts with a slash, else from the base's folder."""
    path = F.split_part(target, F.lit("#"), F.lit(1))
    folder = F.regexp_replace(base, "/[^/]*$", "")
    full = F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))
    no_step = F.array().cast("array<string>")

    def walk(done: Column, step: Column) -> Column:
        parent = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(step == "..", parent).when(step.isin("", "."), done).otherwise(F.array_append(done, step))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(full, "/"), no_step, walk), "/"))
