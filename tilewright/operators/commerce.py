"""Checkout, webhooks, downloads and lookups of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.scalars import lookup
from tilewright.functions.text import without_space
from tilewright.operators.ledger import ORDER_STATES
from tilewright.operators.ordered import written

#: Tiers and editions, what each payment provider needs to be set, plans with a build. The needed keys stand for
#: settings of the same meaning: the key and the webhook secret of the provider's interface, the product or the hosted
#: checkout link of each paid tier, and the business whose payments count.
TIER_EDITION = {"pro": "pro", "studio": "studio"}
TIERS = ("pro", "studio", "evaluate")
NEEDED_KEYS = {"dodo": ("api_key", "product_pro", "product_studio", "webhook_secret", "business_id"), "stripe": ("secret_key",), "lemonsqueezy": ("fastlink_pro", "fastlink_studio", "webhook_secret"), "manual": ()}
PLANS = ("free", "pro", "studio")


def edition_of(tier: Column) -> Column:
    return lookup(TIER_EDITION, tier)


def tier_of_product(product: Column, products: dict[str, str]) -> Column:
    """products: product or variant id by tier; an empty or unknown id gives null."""
    return F.when(F.coalesce(product, F.lit("")) != "", lookup({v: k for k, v in products.items()}, product))


def checkout_error(tier: Column) -> Column:
    return F.when(~F.coalesce(tier.isin(*TIERS), F.lit(False)), "unknown tier")


def provider(name: Column) -> Column:
    """The provider a setting names; without one, or with an unknown one, the manual path."""
    clean = F.lower(F.trim(F.coalesce(name, F.lit("manual"))))
    return F.when(clean.isin(*NEEDED_KEYS), clean).otherwise("manual")


def configured(name: Column, keys: Column) -> Column:
    """keys: map of what is set. An unknown provider is not configured, and blank counts as not set."""
    clean = F.lower(F.trim(F.coalesce(name, F.lit("manual"))))
    out = F.when(clean == "manual", True)
    for p, needed in NEEDED_KEYS.items():
        if needed:
            have = [F.trim(F.coalesce(F.try_element_at(keys, F.lit(k)), F.lit(""))) != "" for k in needed]
            every = have[0]
            for h in have[1:]:
                every = every & h
            out = out.when(clean == p, every)
    return out.otherwise(False)


#: Where providers take requests, by mode where there are two.
SESSION_URL = "https://api.stripe.com/v1/checkout/sessions"
CHECKOUT_BASE = {"test": "https://test.dodopayments.com", "live": "https://live.dodopayments.com"}


def _form(pairs: list[tuple[str, Column]]) -> Column:
    """Pairs as a form's text; a pair with a null value is left out."""
    return F.array_join(F.array(*[F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(v)) for k, v in pairs]), "&")


def checkout_request(name: Column, tier: Column, origin: Column, ref: Column, keys: Column, titles: dict[str, str]) -> dict[str, Column]:
    """What a checkout of a tier sends: provider, error, kind (post or redirect), url, body.

    keys: a map of what is set (api_mode, secret_key, price_<tier>, amount_<tier>_usd, product_<tier>,
    fastlink_<tier>); titles: the line that a price made on the spot is sold under. The error names the key that is
    missing, `free tier` for a tier that is not sold, and then nothing is sent. The manual path sends
    nobody anywhere but on.
    """
    who = provider(name)
    of = lambda k: F.nullif(F.trim(F.try_element_at(keys, k if isinstance(k, Column) else F.lit(k))), F.lit(""))
    per = lambda before, after="": of(F.concat(F.lit(before), tier, F.lit(after)))
    price, usd = per("price_"), per("amount_", "_usd").try_cast("double")
    usd = F.when((usd > 0) & (usd < float("inf")), usd)
    missing = lambda c, k: F.when(c.isNull(), F.concat(F.lit("not set: "), k))
    back = lambda source: F.concat(origin, F.lit("/download?tier="), tier, F.lit(f"&source={source}"))
    title = lookup(titles, tier)
    made = price.isNull()
    session = _form(
        [
            ("mode", F.lit("payment")), ("success_url", F.concat(back("stripe"), F.lit("&session_id={CHECKOUT_SESSION_ID}"))), ("cancel_url", F.concat(origin, F.lit("/#pricing"))), ("client_reference_id", tier), ("metadata[tier]", tier),
            ("allow_promotion_codes", F.lit("true")), ("line_items[0][quantity]", F.lit("1")), ("line_items[0][price]", price), ("line_items[0][price_data][currency]", F.when(made, "usd")),
            ("line_items[0][price_data][unit_amount]", F.when(made, F.floor(usd * 100 + 0.5).cast("string"))), ("line_items[0][price_data][product_data][name]", F.when(made, title)),
        ]
    )
    record = F.to_json(
        F.struct(
            F.array(F.struct(per("product_").alias("product_id"), F.lit(1).alias("quantity"))).alias("product_cart"), F.concat(back("dodo"), F.lit("&ref="), ref).alias("return_url"), F.concat(origin, F.lit("/#pricing")).alias("cancel_url"),
            F.struct(ref.alias("ref"), tier.alias("tier")).alias("metadata"),
        )
    )
    link = per("fastlink_")
    ride = _form([("checkout[custom][ref]", ref), ("checkout[custom][tier]", tier), ("redirect_url", F.concat(back("lemonsqueezy"), F.lit("&ref="), ref))])
    linked = F.concat(link, F.when(link.contains("?"), "&").otherwise("?"), ride)
    sold = F.coalesce(tier.isin(*TIER_EDITION), F.lit(False))
    base = F.coalesce(lookup(CHECKOUT_BASE, of("api_mode")), F.lit(CHECKOUT_BASE["live"]))
    error = (
        F.when(checkout_error(tier).isNotNull(), checkout_error(tier)).when(who == "manual", None).when(~sold, "free tier")
        .when(who == "stripe", F.coalesce(missing(of("secret_key"), F.lit("secret_key")), F.when(made & usd.isNull(), F.concat(F.lit("not set: price_"), tier, F.lit(" or amount_"), tier, F.lit("_usd")))))
        .when(who == "dodo", F.coalesce(missing(per("product_"), F.concat(F.lit("product_"), tier)), missing(of("api_key"), F.lit("api_key")))).when(who == "lemonsqueezy", missing(link, F.concat(F.lit("fastlink_"), tier)))
    )
    send = lambda c: F.when(error.isNull(), c)
    return {
        "provider": who, "error": error, "kind": send(F.when(who.isin("stripe", "dodo"), "post").otherwise("redirect")),
        "url": send(F.when(who == "stripe", SESSION_URL).when(who == "dodo", F.concat(base, F.lit("/checkouts"))).when(who == "lemonsqueezy", linked).otherwise(F.concat(F.lit("/download?tier="), tier, F.lit("&source=checkout")))),
        "body": send(F.when(who == "stripe", session).when(who == "dodo", record)),
    }


def constraint_faults(orders: DataFrame) -> DataFrame:
    """orders (tier, edition, amount_cents, status, used) with the rules each row breaks."""
    rules = {
        "tier": ~F.col("tier").isin("pro", "studio"), "edition": ~F.col("edition").isin("pro", "studio"), "amount_cents": F.col("amount_cents") < 0,
        "status": ~F.col("status").isin(*ORDER_STATES), "used": F.col("used") < 0,
    }
    return orders.withColumn("faults", F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])))


def first_deliveries(events: DataFrame, fulfilled: DataFrame) -> DataFrame:
    """events (external_id, seq, ...) that may claim a key: the first of each order, unless it is fulfilled already.

    All providers are treated alike here: a delivery that comes again never claims again.
    """
    cols = events.columns
    first = events.groupBy("external_id").agg(F.min_by(F.struct(*cols), "seq").alias("_e")).select("_e.*")
    return first.join(fulfilled.select("external_id"), "external_id", "left_anti")


def ours(events: DataFrame, business: str, brand: str | None) -> DataFrame:
    """Events of our business and, where one is named, our brand."""
    own = F.col("business_id") == business
    return events.filter(own if brand is None else own & F.coalesce(F.col("brand_id") == brand, F.lit(True)))


def by_metadata(orders: DataFrame, field: str, wanted: DataFrame) -> DataFrame:
    """orders (metadata: JSON) joined with wanted (value) on one of its fields."""
    return orders.withColumn("value", F.get_json_object("metadata", f"$.{field}")).join(wanted.select("value").distinct(), "value", "left_semi")


def order_of(orders: DataFrame, external_id: str) -> DataFrame:
    return orders.filter(F.col("external_id") == external_id).limit(1)


def orders_of_visits(visits: DataFrame, orders: DataFrame) -> DataFrame:
    """visits (visit, session_id, ref, order_id): the order that the first of the three names, or null."""
    asked = visits.withColumn("external_id", F.coalesce("session_id", "ref", "order_id"))
    return asked.join(orders, "external_id", "left")


def claimed_keys(pool: DataFrame, orders: DataFrame) -> DataFrame:
    """pool (key, order_id) with the status of the order that holds each key."""
    return pool.join(orders.select(F.col("id").alias("order_id"), "status"), "order_id")


def activations(pasted: DataFrame) -> DataFrame:
    """pasted (machine, seq, key, at): a key that is active already keeps its first time and is reported as such.

    seq is unique in a machine. Rows are dealt by ranges of machine and seq, so a machine may have any
    number; each range looks back inside itself, and a row for each range and machine carries the last
    key, and when it was first pasted, on to the next.
    """
    dealt = pasted.withColumn("key", without_space(F.col("key"))).repartitionByRange("machine", "seq").withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "pasted")
    inside = Window.partitionBy("machine", "_part").orderBy("seq")
    on = lambda a, b: a.join(b, F.col("machine").eqNullSafe(F.col("_m")) & (F.col("_part") == F.col("_p"))).drop("_m", "_p")
    per_part = lambda rows, value, name: rows.groupBy(F.col("machine").alias("_m"), F.col("_part").alias("_p")).agg(value.alias(name))

    ends = per_part(dealt, F.max_by("key", "seq"), "_end").withColumn("_before", F.lag("_end").over(Window.partitionBy("_m").orderBy("_p"))).drop("_end")
    looked = on(dealt.withColumn("_was", F.lag("key").over(inside)).withColumn("_first", F.row_number().over(inside) == 1), ends)
    same = F.coalesce(F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_was")) == F.col("key"), F.lit(False))
    told = looked.withColumn("already_active", same).withColumn("_since", F.when(~same, F.struct("at")))
    starts = per_part(told, F.max_by("_since", F.when(F.col("_since").isNotNull(), F.col("seq"))), "_start")
    carried = starts.withColumn("_carried", F.last("_start", ignorenulls=True).over(Window.partitionBy("_m").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_start")
    here = F.last("_since", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return on(told.withColumn("_here", here), carried).select("machine", "seq", "already_active", F.coalesce("_here", "_carried")["at"].alias("activated_at"))


def builds(settings: DataFrame) -> DataFrame:
    """settings (site, name, value) of download addresses, as one row for each site and plan.

    Names: exe, msi, size for the free build, exe_pro and so on for others; blank counts as not set.
    """
    value = F.nullif(F.trim("value"), F.lit(""))
    plans = F.explode(F.array(*[F.lit(p) for p in PLANS]))
    every = settings.select("site").distinct().select("site", plans.alias("plan"))
    plan = F.when(F.col("name").endswith("_pro"), "pro").when(F.col("name").endswith("_studio"), "studio").otherwise("free")
    what = F.get(F.split("name", "_"), F.lit(0))
    one = lambda k: F.max(F.when(what == k, value)).alias(k)
    found = settings.withColumn("plan", plan).groupBy("site", "plan").agg(one("exe"), one("msi"), one("size"))
    return every.join(found, ["site", "plan"], "left").select("site", "plan", "exe", "msi", "size", F.col("exe").isNotNull().alias("published"))


def any_published(built: DataFrame) -> DataFrame:
    return built.groupBy("site").agg(F.bool_or("published").alias("published"))
