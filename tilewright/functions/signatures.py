"""Webhook signatures: HMAC-SHA256 with a known key is two nested sha2 calls."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: seconds by which a signed time may differ from now.
REPLAY_WINDOW = 300
_BLOCK = 64


def _mac(key: bytes, message: Column) -> Column:
    """Hex; null of a null message."""
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def hmac_hex(secret: str, message: Column) -> Column:
    return _mac(secret.encode(), message)


def hmac_base64(secret: str, message: Column) -> Column:
    """The secret is base64 itself."""
    return F.base64(F.unhex(_mac(base64.b64decode(secret), message)))


def in_window(now: Column, stamp: Column, window: int = REPLAY_WINDOW) -> Column:
    return F.coalesce(F.abs(now - stamp.try_cast("long")) <= window, F.lit(False))


def timed_hex(secret: str, header: Column, body: Column, now: Column) -> Column:
    """header `t=<seconds>,v1=<hex>`: signed over `<seconds>.<body>`, within the window."""
    stamp, given = F.regexp_extract(header, r"(?:^|,)t=([^,]*)", 1), F.regexp_extract(header, r"(?:^|,)v1=([^,]*)", 1)
    return in_window(now, stamp) & (hmac_hex(secret, F.concat(stamp, F.lit("."), body)) == given)


def listed_base64(secret: str, message_id: Column, stamp: Column, header: Column, body: Column, now: Column) -> Column:
    """header `v1,<base64> v1,<base64> ...`: any entry may match what is signed over `<id>.<seconds>.<body>`, within the window."""
    want = F.concat(F.lit("v1,"), hmac_base64(secret, F.concat_ws(".", message_id, stamp, body)))
    return in_window(now, stamp) & F.coalesce(F.array_contains(F.split(header, " "), want), F.lit(False))


def plain_hex(secret: str, header: Column, body: Column) -> Column:
    """header: hex over the body; there is no time in it."""
    return F.coalesce(hmac_hex(secret, body) == header, F.lit(False))
