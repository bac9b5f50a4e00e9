"""Licence keys: shape, signature and statement of each, against the public keys of a table."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import ed25519
from tilewright.operators.policy import ISSUE_SKEW

#: The longest statement, the version that is understood.
MAX_PAYLOAD, VERSION = 4096, 1
#: A build carries a few public keys; more than this is no table of those.
MAX_PUBLIC_KEYS = 64
STATEMENT = "v bigint, product string, edition string, id string, holder string, issued bigint, expires bigint, machine string"
#: Fixed value: white space of every script.
_SPACE = re.compile("[\t\n\v\f\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PART = re.compile(r"[A-Za-z0-9_-]+\Z")


def _bytes_of(part: str) -> bytes | None:
    """Base64 for URLs without padding, in its one spelling."""
    if not _PART.match(part):
        return None
    try:
        data = base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
    except binascii.Error:
        return None
    return data if base64.urlsafe_b64encode(data).rstrip(b"=").decode() == part else None


def segments(key: str, prefix: str) -> tuple[bytes, bytes] | None:
    """Statement and signature of <prefix><statement>.<signature>; white space anywhere is taken out."""
    bare = _SPACE.sub("", key)
    parts = bare.removeprefix(prefix).split(".")
    if not bare.startswith(prefix) or len(parts) != 2:
        return None
    found = tuple(map(_bytes_of, parts))
    if None in found or len(found[0]) > MAX_PAYLOAD or len(found[1]) != 64:
        return None
    try:
        found[0].decode()
    except UnicodeDecodeError:
        return None
    return found


def key_of(seed: bytes, statement: str, prefix: str) -> str:
    """A key over exactly the bytes of a statement."""
    plain = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    return f"{prefix}{plain(statement.encode())}.{plain(ed25519.sign(seed, statement.encode()))}"


def sign_keys(seeds: list[bytes], prefix: str):
    """A column function: statement (JSON text) and the number of a seed -> key."""
    return F.udf(lambda s, n: None if s is None else key_of(seeds[n], s, prefix), "string")


def verified(keys: DataFrame, public_keys: DataFrame, prefix: str) -> DataFrame:
    """keys (key, ...) with statement, the JSON text that one of the public keys vouches for, else null.

    public_keys (hex): rows that are no key, by length, digits or curve, are skipped, and so are keys
    under which anything verifies. A null key, or one of another shape, has no statement. The public
    keys go to every task, so a table of more than MAX_PUBLIC_KEYS is refused.
    """
    known = [r["hex"] for r in public_keys.filter("hex is not null").select("hex").distinct().limit(MAX_PUBLIC_KEYS + 1).collect()]
    if len(known) > MAX_PUBLIC_KEYS:
        raise ValueError(f"more than {MAX_PUBLIC_KEYS} public keys")
    usable = sorted(bytes.fromhex(h) for h in known if re.fullmatch(r"[0-9A-Fa-f]{64}", h))

    def vouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                parts = None if key is None else segments(key, prefix)
                good = parts is not None and ed25519.verifier(usable, *parts) is not None
                out.append(parts[0].decode() if good else None)
            rest = [batch.column(c) for c in batch.schema.names if c != "statement"]
            yield pa.record_batch([*rest, pa.array(out, pa.string())], names=[*[c for c in batch.schema.names if c != "statement"], "statement"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields if f.name != "statement")
    return keys.mapInArrow(vouched, f"{schema}, statement string")


def rejection(statement: Column, product: str, own_machine: Column, now: Column) -> Column:
    """Why a key is no licence, or null; the order of the branches is the rule. Nothing is parsed that is not vouched for."""
    said = F.from_json(statement, STATEMENT)
    whole = said["v"].isNotNull() & said["product"].isNotNull() & said["edition"].isin("pro", "studio") & said["id"].isNotNull() & said["holder"].isNotNull() & said["issued"].isNotNull()
    return (
        F.when(statement.isNull() | ~F.coalesce(whole, F.lit(False)), "malformed").when(said["v"] != VERSION, "unsupported_version").when(said["product"] != product, "wrong_product")
        .when(said["machine"].isNotNull() & ~said["machine"].eqNullSafe(own_machine), "wrong_machine").when(said["issued"] > now + ISSUE_SKEW, "clock_suspect").when(said["expires"].isNotNull() & (now >= said["expires"]), "expired")
    )


def with_revocation(licences: DataFrame, notices: DataFrame) -> DataFrame:
    """licences (id, ...) with revocation: unknown where no notice names the id, else accepted or revoked.

    notices (id, revoked, at): of several the latest counts, and of one time the one that revokes.
    """
    last = notices.filter("id is not null").groupBy("id").agg(F.max(F.struct("at", F.coalesce("revoked", F.lit(False)).alias("revoked"))).alias("_n"))
    found = licences.join(last, "id", "left")
    return found.withColumn("revocation", F.when(F.col("_n").isNull(), "unknown").when(F.col("_n.revoked"), "revoked").otherwise("accepted")).drop("_n")
