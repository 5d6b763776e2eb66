"""Query registry, filled by importing the query modules."""

from ledgerloom.plans import commerce, market, operations, research, series, textual  # noqa: F401
