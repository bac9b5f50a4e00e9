"""Signatures of keys, signed events, recorded replies and SQL functions."""

import base64
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import ed25519, guards, sql_functions
from tilewright.operators import deliveries, ledger, licences
from tilewright.sources import meter_log

#: RFC 8032, section 7.1: secret, public key, message, signature.
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


@pytest.mark.parametrize(("secret", "public", "message", "signature"), VECTORS)
def test_published_vectors(secret, public, message, signature):
    seed, key, text, sig = map(bytes.fromhex, (secret, public, message, signature))
    assert ed25519.public_key(seed) == key and ed25519.sign(seed, text) == sig
    assert ed25519.verifies(key, text, sig)
    assert not ed25519.verifies(key, text + b"x", sig)
    assert not any(ed25519.verifies(key, text, sig[:k] + bytes([sig[k] ^ 1]) + sig[k + 1 :]) for k in (0, 31, 32, 63))


def test_odd_keys_and_signatures():
    seed = bytes(range(32))
    key, sig = ed25519.public_key(seed), ed25519.sign(seed, b"m")
    s = int.from_bytes(sig[32:], "little") + ed25519.ORDER
    assert not ed25519.verifies(key, b"m", sig[:32] + s.to_bytes(32, "little"))  # another spelling
    small = [ed25519.packed(ed25519.ZERO), (ed25519.P - 1).to_bytes(32, "little"), bytes(32)]
    assert all(ed25519.usable_key(k) is None for k in [*small, b"", key[:31], b"\xff" * 32, (2).to_bytes(32, "little")])
    assert not any(ed25519.verifies(k, b"m", small[0] + bytes(32)) for k in small)
    rng = random.Random(1)
    a, b = rng.randrange(ed25519.ORDER), rng.randrange(ed25519.ORDER)
    p, q = ed25519.times(a, ed25519.BASE), ed25519.times(b, ed25519.BASE)
    assert ed25519.packed(ed25519.times(5, p, 7, q)) == ed25519.packed(ed25519.times((5 * a + 7 * b) % ed25519.ORDER, ed25519.BASE))
    assert ed25519.unpacked(ed25519.packed(p)) is not None and ed25519.is_zero(ed25519.times(ed25519.ORDER, p))


def test_keys_against_public_keys(spark):
    mine, other = bytes([7]) * 32, bytes([8]) * 32
    good = licences.key_of(mine, '{"v":1}', "K1.")
    payload, sig = good.removeprefix("K1.").split(".")
    cases = {
        good: True, f" {good[:9]}\n{good[9:]}\t": True, licences.key_of(other, '{"v":1}', "K1."): False, good[:-2]: False, good + ".x": False, f"K1.{payload}.": False, f"K1.{payload}=.{sig}": False, f"K2.{payload}.{sig}": False,
        "": False, f"K1.{payload}.{sig[:-1]}" + ("B" if sig[-1] != "B" else "C"): False, licences.key_of(mine, "x" * 4097, "K1."): False, licences.key_of(mine, "x" * 4096, "K1."): True,
    }
    keys = spark.createDataFrame([(k, "mine", n) for n, k in enumerate([*cases, None])], "key string, statement string, n int").repartition(3)
    public = spark.createDataFrame([(h,) for h in ("zz", "00" * 31, ed25519.public_key(mine).hex(), None, "ff" * 32)], "hex string")
    got = {r["key"]: r["statement"] for r in licences.verified(keys, public, "K1.").collect()}
    assert {k: s is not None for k, s in got.items()} == {**cases, None: False} and got[good] == '{"v":1}'
    assert all(r["statement"] is None for r in licences.verified(keys, public.limit(0), "K1.").collect())
    with pytest.raises(ValueError, match="public keys"):
        licences.verified(keys, spark.range(65).select(F.sha2(F.col("id").cast("string"), 256).alias("hex")), "K1.")


def test_revocation_notices(spark):
    owned = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    notices = spark.createDataFrame([("a", True, 1), ("a", False, 2), ("b", False, 1), ("b", True, 2), ("c", True, 3), ("c", False, 3), (None, True, 1), ("x", True, 1)], "id string, revoked boolean, at long")
    assert {r["id"]: r["revocation"] for r in licences.with_revocation(owned, notices).collect()} == {"a": "accepted", "b": "revoked", "c": "revoked", "d": "unknown"}


def test_deliveries_are_authenticated_as_bytes(spark):
    secrets = {"timed": "t", "listed": "whsec_" + base64.b64encode(b"l").decode(), "plain": "p"}
    now = 10_000

    def row(scheme, body, key=None, at=now, **more):
        body = body if isinstance(body, bytes) else json.dumps(body, ensure_ascii=False).encode()
        mac = lambda k, m: hmac.new(k, m, hashlib.sha256)
        if scheme == "timed":
            heads = {"signature": f"t={at},v1={mac(key or b't', f'{at}.'.encode() + body).hexdigest()}"}
        elif scheme == "listed":
            heads = {"webhook-id": "i", "webhook-timestamp": str(at), "webhook-signature": "v0,zz v1," + base64.b64encode(mac(key or b"l", f"i.{at}.".encode() + body).digest()).decode()}
        else:
            heads = {"x-signature": mac(key or b"p", body).hexdigest().upper()}
        return scheme, {**heads, **more}, body, now

    paid = {"type": "checkout.session.completed", "data": {"object": {"id": "s1", "payment_status": "paid", "amount_total": 199, "metadata": {"tier": "pro"}, "note": "héé"}}}
    cases = [
        (row("timed", paid), (200, None, "fulfill", "s1", "pro")), (row("timed", paid, key=b"no"), (400, "invalid signature", None, None, None)), (row("timed", paid, at=now - 301), (400, "invalid signature", None, None, None)),
        (row("timed", {"type": "checkout.session.completed", "data": {"object": {"id": "s2", "payment_status": "paid", "client_reference_id": "studio"}}}), (200, None, "fulfill", "s2", "studio")),
        (row("timed", {"type": "checkout.session.completed", "data": {"object": {"id": 5, "payment_status": "paid", "metadata": {"tier": "pro"}}}}), (200, None, None, None, "pro")),
        (row("timed", b"\xff{"), (400, "invalid payload", None, None, None)), (row("timed", b""), (400, "invalid payload", None, None, None)), (row("timed", b"null"), (500, "processing failed", None, None, None)), (row("timed", b"[1]"), (200, None, None, None, None)), (row("timed", b"7"), (200, None, None, None, None)),
        (row("listed", {"type": "payment.succeeded", "data": {"status": "succeeded", "metadata": {"ref": "r", "tier": "pro"}, "product_cart": [{"product_id": "x"}]}}), (200, None, None, "r", None)),
        (row("listed", {"type": "payment.succeeded", "data": {"status": "succeeded", "metadata": {"ref": "r"}, "product_cart": [{"product_id": "x"}, {"product_id": "ps"}]}}), (200, None, "fulfill", "r", "studio")),
        (row("listed", {"type": "payment.cancelled", "data": {"metadata": {"ref": "r"}}}), (200, None, "cancel", "r", None)), (row("listed", {"type": "payment.cancelled", "data": {"metadata": {"ref": ""}}}), (200, None, None, None, None)),
        (row("plain", {"meta": {"event_name": "order_refunded"}, "data": {"attributes": {"identifier": "u"}}}), (200, None, "refund", "u", None)),
        (row("plain", {"meta": {"event_name": "order_created", "custom_data": {"ref": "q"}}, "data": {"attributes": {"status": "paid", "first_order_item": {"variant_id": 9}}}}), (200, None, "fulfill", "q", "pro")),
        (row("plain", {"meta": {"event_name": "order_created", "custom_data": {"ref": "q", "tier": "pro"}}, "data": {"attributes": {"status": "paid", "test_mode": True}}}), (200, None, None, "q", "pro")),
        (("plain", {}, b"{}", now), (400, "invalid signature", None, None, None)), (("plain", None, b"{}", now), (400, "invalid signature", None, None, None)), (("plain", {"x-signature": "0"}, None, now), (400, "invalid signature", None, None, None)), (("sealed", {}, b"{}", now), (503, "webhook not configured", None, None, None)),
    ]
    df = spark.createDataFrame([(k, s, h, None if b is None else bytearray(b), t) for k, ((s, h, b, t), _) in enumerate(cases)], "delivery long, scheme string, headers map<string,string>, body binary, received_s long")
    got = {r["delivery"]: (r["status"], r["error"], r["action"], r["external_id"], r["tier"]) for r in deliveries.read_deliveries(df, secrets, {"listed": {"studio": "ps"}, "plain": {"pro": "9"}}).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    unset = deliveries.read_deliveries(df.limit(1), {}, {}).collect()
    assert [(r["status"], r["error"]) for r in unset] == [(503, "webhook not configured")]


def test_recorded_replies(spark, tmp_path):
    meter_log.register(spark)
    good = {"period": "2024-03", "limit": 10, "used": 12, "remaining": 0, "server_time": 5}
    first = [{"meter": "a", "at": 1, "status": 200, "body": json.dumps(good)}, {"meter": "b", "at": 2, "status": 500, "body": json.dumps(good)}, {"meter": 3, "at": "x", "status": True, "body": None}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "0001.json").write_text("\n".join([*map(json.dumps, first), "", "{cut", "[]"]))
    (tmp_path / "log" / "_SUCCESS").write_text("not a reply")
    read = lambda: sorted((tuple(r) for r in meter_log.replies(spark.read.format("meter_replies").load(str(tmp_path / "log"))).collect()), key=repr)
    want = [("a", 1, None, "2024-03", 10, 10, False, 5), ("b", 2, "meter_unreachable", *[None] * 5), *[(None, None, "meter_unreachable", *[None] * 5)] * 3]
    assert read() == sorted(want, key=repr)

    def drain():
        q = meter_log.replies(spark.readStream.format("meter_replies").load(str(tmp_path / "log"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert drain() == 5
    (tmp_path / "log" / "0002.json").write_text(json.dumps(first[0]))
    assert drain() == 6 and drain() == 6  # new files only, once each
    (tmp_path / "none").mkdir()
    assert spark.read.format("meter_replies").load(str(tmp_path / "none")).count() == 0


def test_functions_of_sql(spark):
    assert sorted(sql_functions.register(spark)) == ["claim_license_key", "free_ip_monthly_limit", "free_monthly_limit", "limit_for_meter", "merge_order_metadata", "peek_credits", "spend_credits"]
    rows = [("dev00001", "2024-01", 4), ("dev00001", "2024-01", 9), ("dev00001", "2024-02", 1), ("iph00001", "2024-01", 31), ("short", "2024-01", 1), ("dev00002", "2024-01", 0), ("dev00002", "2024-01", 1001), ("dev00002", "2024-01", None)]
    spark.createDataFrame([(m, p, n, k) for k, (m, p, n) in enumerate(rows)], "meter string, period string, n long, seq int").createOrReplaceTempView("spends")
    got = spark.sql("SELECT * FROM spend_credits(TABLE(spends) PARTITION BY meter ORDER BY seq)").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [
            ("dev00001", "2024-01", 4, 6, 10, None), ("dev00001", "2024-01", 13, 0, 10, None), ("dev00001", "2024-02", 1, 9, 10, None), ("iph00001", "2024-01", 31, 0, 30, None), ("short", "2024-01", 0, 10, 10, "invalid meter id"),
            *[("dev00002", "2024-01", 0, 10, 10, "invalid credit count")] * 3,
        ],
        key=repr,
    )
    assert spark.sql("SELECT free_monthly_limit(), free_ip_monthly_limit(), limit_for_meter('iphx'), limit_for_meter('x')").collect()[0] == (10, 30, 30, 10)
    assert spark.sql("SELECT merge_order_metadata(map('a', '1', 'b', '2'), map('b', '3')) AS m, merge_order_metadata(NULL, NULL) AS n").collect()[0] == ({"a": "1", "b": "3"}, {})
    spark.sql("SELECT * FROM VALUES ('dev00001', '2024-01', 7L, '2024-01'), ('dev00003', '2023-12', 7L, '2024-01') AS t(meter, period, used, asked)").createOrReplaceTempView("balances")
    assert sorted(map(tuple, spark.sql("SELECT * FROM peek_credits(TABLE(balances) PARTITION BY meter)").collect())) == [("dev00001", "2024-01", 7, 3, 10), ("dev00003", "2024-01", 0, 10, 10)]


def test_claims_of_sql_equal_the_table_form(spark):
    sql_functions.register(spark)
    rng = random.Random(2)
    orders = [(k, rng.choice(["pro", "studio"]), rng.randrange(10**6)) for k in range(40)]
    pool = [(f"k{k}", rng.choice(["pro", "studio"]), rng.randrange(10**6)) for k in range(25)]
    o = spark.createDataFrame(orders, "order_id long, edition string, paid_at long")
    p = spark.createDataFrame(pool, "key string, edition string, issued_at long")
    want = ledger.claim_keys(o, p).select("order_id", "edition", "key")
    both = o.selectExpr("edition", "cast(null as string) as key", "order_id", "1 as side", "paid_at as at").unionByName(p.selectExpr("edition", "key", "cast(null as long) as order_id", "0 as side", "issued_at as at"))
    both.createOrReplaceTempView("both_sides")
    got = spark.sql("SELECT * FROM claim_license_key(TABLE(both_sides) PARTITION BY edition ORDER BY (side, at, order_id, key))")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_guards_of_payloads(spark):
    """Missing fields, null, other kinds, numbers as text, arrays with one bad element, bare values."""
    good = {n: "x" if k == "text" else 1 for n, k in guards.RESULT.items() if n != "dataUrl"} | {"dataUrl": None}
    engine = {"device": "d", "models": [{"id": "a", "state": "s"}], "ready": False, "scales": [2, 2.5, 10**20], "modes": [], "filters": [], "modelsDirDisplay": ""}
    cases = [
        (guards.is_result, good, True), (guards.is_result, good | {"dataUrl": "u"}, True), (guards.is_result, good | {"dataUrl": 1}, False), (guards.is_result, {k: v for k, v in good.items() if k != "dataUrl"}, False), (guards.is_result, good | {"width": "1"}, False), (guards.is_result, good | {"label": None}, False),
        (guards.is_result, good | {"width": 1.5, "more": []}, True), (guards.is_result, [], False), (guards.is_result, None, False), (guards.is_result, "x", False),
        (guards.is_engine_status, engine, True), (guards.is_engine_status, engine | {"scales": [2, None]}, False), (guards.is_engine_status, engine | {"models": [{"id": "a"}]}, False), (guards.is_engine_status, engine | {"models": [1]}, False), (guards.is_engine_status, engine | {"ready": 1}, False), (guards.is_engine_status, engine | {"filters": {}}, False),
        (guards.is_engine_status, engine | {"scales": []}, True), (guards.is_job_event, {"phase": "completed"}, True), (guards.is_job_event, {"phase": "device", "device": "d"}, False), (guards.is_job_event, {"phase": "device", "device": "d", "tile": 4}, True), (guards.is_job_event, {"phase": 3}, False), (guards.is_job_event, {}, False),
    ]
    for guard, payload, want in cases:
        row = spark.createDataFrame([(json.dumps(payload),)], "j string").select(guard(F.parse_json("j")).alias("ok")).collect()[0]
        assert row["ok"] is want, (guard.__name__, payload)
    assert spark.createDataFrame([("{",)], "j string").select(guards.is_result(F.try_parse_json("j")).alias("ok")).collect()[0]["ok"] is False


def test_payloads_are_parsed_once(spark):
    from tilewright.plans import service_queries

    plan = service_queries.payload_guards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 3
    v = F.parse_json(F.lit('{"a":[{"b":1}],"b":null}'))
    asked = [({"a": [{"b": "number"}], "b": {"text", "none"}}, True), ({"a": [{"b": "text"}]}, False), ({"a": [{"c": {"none"}}]}, False), ({"a": {"b": "number"}}, False), ({"b": [{"b": "text"}]}, False), ([{"b": "number"}], False), ({}, True), ("text", False)]
    assert spark.range(1).select(*[guards.fits(v, shape).alias(f"c{k}") for k, (shape, _) in enumerate(asked)]).collect()[0][:] == tuple(want for _, want in asked)


def test_one_signature_against_several_keys(monkeypatch):
    seeds = [bytes([n]) * 32 for n in (1, 2, 3)]
    keys = [ed25519.public_key(s) for s in seeds]
    sig = ed25519.sign(seeds[1], b"m")
    assert ed25519.verifier([bytes(32), *keys], b"m", sig) == keys[1] and ed25519.verifier([keys[0], keys[2]], b"m", sig) is None and ed25519.verifier([], b"m", sig) is None
    rng = random.Random(2)
    for _ in range(20):
        n, m = rng.randrange(2**256), rng.choice([0, 1, 255, 256, 2**255, 2**256 - 1])
        assert all(ed25519.packed(ed25519.times_known(k, ed25519.BASE, ed25519.times(3, ed25519.BASE))) == ed25519.packed(ed25519.times(k + 3, ed25519.BASE)) for k in (n, m))
    # a point of small order beside R: the equation holds only when multiplied by 8
    torsion = ed25519.ZERO
    while ed25519.is_zero(torsion):
        torsion = ed25519.times(ed25519.ORDER, ed25519.unpacked(rng.randrange(ed25519.P).to_bytes(32, "little")) or ed25519.ZERO)
    first = ed25519.packed(ed25519.add(ed25519.times(77, ed25519.BASE), torsion))
    s = (77 + ed25519._number(first, keys[1], b"m") * ed25519._secret(seeds[1])[0]) % ed25519.ORDER
    odd = first + s.to_bytes(32, "little")
    assert ed25519.verifier(keys, b"m", odd) == keys[1] and not ed25519.verifies(keys[0], b"m", odd)
    made = []
    monkeypatch.setattr(ed25519, "times_known", lambda n, a, to=ed25519.ZERO, known=ed25519.times_known: made.append(a) or known(n, a, to))
    assert ed25519.verifier(keys, b"m", sig) == keys[1] and made.count(ed25519.BASE) == 1 and len(made) == 3
