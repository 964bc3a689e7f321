"""Webhook signatures with built-in hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE_PREFIX = "sha256="
_BLOCK = 64


def key_pads(secret: str) -> tuple[str, str]:
    """Inner and outer HMAC-SHA256 pads of a secret, in hex."""
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def sign_body(body: Column, secret: str) -> Column:
    """The signature header a sender with this secret puts on a body."""
    inner_pad, outer_pad = (F.unhex(F.lit(pad)) for pad in key_pads(secret))
    inner = F.sha2(F.concat(inner_pad, F.encode(body, "UTF-8")), 256)
    return F.concat(F.lit(SIGNATURE_PREFIX), F.sha2(F.concat(outer_pad, F.unhex(inner)), 256))


def signature_is_valid(body: Column, signature: Column, secret: str) -> Column:
    """True for an exact match; a missing or empty header is false."""
    return F.coalesce((signature != "") & (signature == sign_body(body, secret)), F.lit(False))
