"""Meters, pools and orders as functions of SQL: `register(spark)` makes seven names callable.

Scalar functions are SQL expressions. The others are table functions over a whole table, dealt and
ordered by the caller (TABLE(...) PARTITION BY ... ORDER BY ...), so that Spark moves the rows and a
function sees one meter, or one edition, in order. A meter's state is one row; a claim holds the free
keys of an edition, so for large pools use the DataFrame form, `ledger.claim_keys`.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from tilewright.operators.ledger import INSTALL_LIMIT, MAX_SPEND, NETWORK_LIMIT, NETWORK_PREFIX

#: Fixed value: what a meter id looks like.
METER = re.compile(r"[a-z0-9]{8,64}\Z")
SCALARS = {
    "free_monthly_limit": f"free_monthly_limit() RETURNS INT RETURN {INSTALL_LIMIT}",
    "free_ip_monthly_limit": f"free_ip_monthly_limit() RETURNS INT RETURN {NETWORK_LIMIT}",
    "limit_for_meter": f"limit_for_meter(meter STRING) RETURNS INT RETURN CASE WHEN startswith(meter, '{NETWORK_PREFIX}') THEN {NETWORK_LIMIT} ELSE {INSTALL_LIMIT} END",
    "merge_order_metadata": """merge_order_metadata(old MAP<STRING, STRING>, patch MAP<STRING, STRING>) RETURNS MAP<STRING, STRING>
        RETURN map_concat(map_filter(coalesce(old, map()), (k, v) -> NOT map_contains_key(coalesce(patch, map()), k)), coalesce(patch, map()))""",
}


def _limit(meter: str) -> int:
    return NETWORK_LIMIT if meter.startswith(NETWORK_PREFIX) else INSTALL_LIMIT


@udtf(returnType="order_id bigint, edition string, key string")
class ClaimLicenseKey:
    """Rows (edition, key, order_id) of one edition, keys first, each side in its order: every order gets the oldest key that is left, or null."""

    def __init__(self) -> None:
        self._free: deque[str] = deque()

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["key"] is not None:
            self._free.append(row["key"])
        elif row["order_id"] is not None:
            yield row["order_id"], row["edition"], self._free.popleft() if self._free else None


@udtf(returnType="meter string, period string, used bigint, remaining bigint, monthly_limit bigint, error string")
class SpendCredits:
    """Rows (meter, period, n) of one meter by time: its balance after each; a spend outside 1 to the largest is refused and changes nothing."""

    def __init__(self) -> None:
        self._period, self._used = None, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        meter, period, n = row["meter"], row["period"], row["n"]
        limit = _limit(meter or "")
        error = "invalid meter id" if meter is None or not METER.match(meter) else "invalid credit count" if n is None or not 1 <= n <= MAX_SPEND else None
        if error is None:
            self._used = n + (self._used if period == self._period else 0)
            self._period = period
        used = self._used if period == self._period else 0
        yield meter, period, used, max(limit - used, 0), limit, error


@udtf(returnType="meter string, period string, used bigint, remaining bigint, monthly_limit bigint")
class PeekCredits:
    """Rows (meter, period, used, asked) of one meter's balances: the balance of the month asked for, the whole allowance where there is none."""

    def __init__(self) -> None:
        self._meter, self._asked, self._used = None, None, 0

    def eval(self, row: Row) -> None:
        self._meter, self._asked = row["meter"], row["asked"]
        if row["period"] == row["asked"]:
            self._used = row["used"]

    def terminate(self) -> Iterator[tuple]:
        if self._meter is not None:
            limit = _limit(self._meter)
            yield self._meter, self._asked, self._used, max(limit - self._used, 0), limit


TABLES = {"claim_license_key": ClaimLicenseKey, "spend_credits": SpendCredits, "peek_credits": PeekCredits}


def register(spark: SparkSession) -> list[str]:
    """Make all functions callable in this session's SQL; their names."""
    for text in SCALARS.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
    return [*SCALARS, *TABLES]
