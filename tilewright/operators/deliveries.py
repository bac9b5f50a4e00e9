"""Signed event deliveries: bytes are authenticated first, then read as VARIANT, then mapped to what they ask for.

Three schemes, by the way a provider signs: `timed` (hex in a header with its time), `listed` (one of
several base64 entries beside an id and a time) and `plain` (hex over the body alone).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import signatures
from tilewright.functions.scalars import to_cents

SCHEMES = ("timed", "listed", "plain")


def authentic(scheme: Column, headers: Column, body: Column, now: Column, secrets: dict[str, str]) -> Column:
    """Whether the body's bytes are signed as its scheme asks; headers: a map by lower-case name."""
    head = lambda k: F.try_element_at(headers, F.lit(k))
    good = {
        "timed": lambda s: signatures.timed_hex(s, head("signature"), body, now),
        "listed": lambda s: signatures.listed_base64(s.removeprefix("whsec_"), head("webhook-id"), head("webhook-timestamp"), head("webhook-signature"), body, now),
        "plain": lambda s: signatures.plain_hex(s, F.lower(head("x-signature")), body),
    }
    out = F.lit(False)
    for name, test in good.items():
        if secrets.get(name):
            out = F.when(scheme == name, F.coalesce(test(secrets[name]), F.lit(False))).otherwise(out)
    return out


def _text(event: Column, path: str) -> Column:
    """A string at a path; null for what is there as something else."""
    at = F.try_variant_get(event, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(event, path, "string"))


def _number(event: Column, path: str) -> Column:
    at = F.try_variant_get(event, path, "variant")
    return F.when(F.schema_of_variant(at).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(event, path, "double"))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def read_deliveries(deliveries: DataFrame, secrets: dict[str, str], products: dict[str, dict[str, str]], business: str | None = None, brand: str | None = None) -> DataFrame:
    """deliveries (delivery, scheme, headers, body, received_s) as one row each: delivery, scheme, status, error, ignored, type,
    action, external_id, payment_id, tier, amount_cents.

    status 400 with `invalid signature` comes before anything is read, and 503 where a scheme has no
    secret; then `invalid payload` for bytes that are no JSON, and 500 with `processing failed` for a bare null. products: by scheme, the product or variant
    of each tier. A paid event asks to `fulfill`, if it names an order and a tier, one that failed or
    ended to `cancel`, a refund to `refund`; unknown types are acknowledged and ask for nothing, and so
    are events of another business or brand, whose `ignored` says so, and those of a test.
    """
    text = F.when(F.is_valid_utf8(F.col("body").cast("string")), F.col("body").cast("string"))
    known = F.lit(False)
    for s in SCHEMES:
        if secrets.get(s):
            known = known | (F.col("scheme") == s)
    checked = deliveries.select("delivery", "scheme", known.alias("known"), authentic(F.col("scheme"), F.col("headers"), F.col("body"), F.col("received_s"), secrets).alias("signed"), F.try_parse_json(text).alias("parsed"))
    e = F.when(F.col("signed") & (F.schema_of_variant("parsed") != "VOID"), F.col("parsed"))
    event = checked.select("delivery", "scheme", "known", "signed", F.col("parsed").isNotNull().alias("json"), e.alias("e"))
    v = F.col("e")
    is_ = lambda s: F.col("scheme") == s
    by = lambda **of: F.coalesce(*[F.when(is_(s), c) for s, c in of.items()])
    kind = by(timed=_text(v, "$.type"), listed=_text(v, "$.type"), plain=_text(v, "$.meta.event_name"))
    paid_brand = F.coalesce(_text(v, "$.brand_id"), _text(v, "$.data.brand_id"))
    ignored = F.lit(None).cast("string")
    if brand:
        ignored = F.when(is_("listed") & (F.coalesce(paid_brand, F.lit("")) != "") & (paid_brand != brand), "other brand").otherwise(ignored)
    if business:
        ignored = F.when(is_("listed") & ~_text(v, "$.business_id").eqNullSafe(F.lit(business)), "other business").otherwise(ignored)
    external = by(timed=_some(_text(v, "$.data.object.id")), listed=_some(_text(v, "$.data.metadata.ref")), plain=F.coalesce(_some(_text(v, "$.meta.custom_data.ref")), _text(v, "$.data.attributes.identifier")))
    payment = by(timed=_text(v, "$.data.object.payment_intent"), listed=_some(_text(v, "$.data.payment_id")))

    def tier_of(scheme: str, product: Column) -> Column:
        out = F.lit(None).cast("string")
        for tier, own in products.get(scheme, {}).items():
            out = F.when(product == own, tier).otherwise(out)
        return out

    declared = lambda path: F.when(_text(v, path).isin("pro", "studio"), _text(v, path))
    cart = F.try_variant_get(v, "$.data.product_cart", "array<variant>")
    tiers = F.transform(cart, lambda x: tier_of("listed", _text(x, "$.product_id")))
    bought = F.try_element_at(F.filter(tiers, lambda t: t.isNotNull()), F.lit(1))
    foreign = F.coalesce(F.exists(tiers, lambda t: t.isNull()), F.lit(False))
    variant = F.coalesce(F.try_variant_get(v, "$.data.attributes.first_order_item.variant_id", "string"), F.lit(""))
    session_tier = F.when(F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.data.object.metadata.tier", "variant")), F.lit("VOID")) == "VOID", declared("$.data.object.client_reference_id")).otherwise(declared("$.data.object.metadata.tier"))
    tier = by(
        timed=session_tier, listed=F.coalesce(bought, F.when(~foreign, declared("$.data.metadata.tier"))), plain=F.coalesce(declared("$.meta.custom_data.tier"), tier_of("plain", variant))
    )
    amount = by(timed=F.floor(_number(v, "$.data.object.amount_total")).cast("long"), listed=F.floor(_number(v, "$.data.total_amount")).cast("long"), plain=to_cents(_number(v, "$.data.attributes.total")))
    paid = by(
        timed=(kind == "checkout.session.completed") & _text(v, "$.data.object.payment_status").isin("paid", "no_payment_required"), listed=(kind == "payment.succeeded") & (_text(v, "$.data.status") == "succeeded"),
        plain=(kind == "order_created") & (_text(v, "$.data.attributes.status") == "paid") & ~F.coalesce(F.try_variant_get(v, "$.data.attributes.test_mode", "boolean"), F.lit(False)),
    )
    cancels = by(timed=kind == "checkout.session.expired", listed=kind.isin("payment.failed", "payment.cancelled")) & external.isNotNull()
    refunds = by(timed=(kind == "charge.refunded") & payment.isNotNull(), listed=(kind == "refund.succeeded") & payment.isNotNull(), plain=(kind == "order_refunded") & external.isNotNull())
    yes = lambda c: F.coalesce(c, F.lit(False))
    action = F.when(ignored.isNotNull(), None).when(yes(paid) & external.isNotNull() & tier.isNotNull(), "fulfill").when(yes(cancels), "cancel").when(yes(refunds), "refund")
    error = F.when(~F.col("known"), "webhook not configured").when(~F.col("signed"), "invalid signature").when(~F.col("json"), "invalid payload").when(v.isNull(), "processing failed")
    read = lambda c: F.when(error.isNull(), c)
    return event.select(
        "delivery", "scheme", F.when(~F.col("known"), 503).when(error == "processing failed", 500).when(error.isNotNull(), 400).otherwise(200).alias("status"), error.alias("error"), read(ignored).alias("ignored"), read(kind).alias("type"), read(action).alias("action"),
        read(external).alias("external_id"), read(payment).alias("payment_id"), read(tier).alias("tier"), read(amount).alias("amount_cents"),
    )
