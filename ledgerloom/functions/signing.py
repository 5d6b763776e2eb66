"""Keyed signatures and header lookups as built-in expressions (no Python in the row path)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header names of a signed delivery.
SIGNATURE_HEADER = "X-Shopify-Hmac-Sha256"
EVENT_ID_HEADER = "X-Shopify-Event-Id"
DELIVERY_ID_HEADER = "X-Shopify-Webhook-Id"
TOPIC_HEADER = "X-Shopify-Topic"

_BLOCK = 64


def _pads(secret: str) -> tuple[bytes, bytes]:
    if not secret:
        raise ValueError("signing secret is not configured")
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(body: Column, secret: str) -> Column:
    """Base64 HMAC-SHA256 of the raw bytes; the key pads are worked out once on the driver."""
    inner_pad, outer_pad = (F.lit(bytearray(p)) for p in _pads(secret))
    inner = F.unhex(F.sha2(F.concat(inner_pad, body), 256))
    return F.base64(F.unhex(F.sha2(F.concat(outer_pad, inner), 256)))


def signature_ok(body: Column, received: Column, secret: str) -> Column:
    """True only for the exact signature; a missing header is simply false."""
    return F.coalesce(received == hmac_sha256(body, secret), F.lit(False))


def header(headers: Column, name: str) -> Column:
    """First value of a header whatever its case, NULL when absent."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(F.get(hits, 0)["value"], 0)


def event_id(headers: Column) -> Column:
    """Event id, or the delivery id only when the event id header is absent; an empty one is no id."""
    return F.nullif(F.coalesce(header(headers, EVENT_ID_HEADER), header(headers, DELIVERY_ID_HEADER)), F.lit(""))
