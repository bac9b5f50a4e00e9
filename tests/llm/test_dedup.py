"""Exact, near and suffix dedup, sharding and URL filters against brute force, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import components, exact_dedup, minhash, passages, sharding, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, kept string, size string, _rid long, tkey string, node string"


def frame(spark, rows):
    """Rows (doc_id, text) beside columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "x", "y", 7, "z", "n") for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choices("abcde", k=3)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = words(rng, 120)
    long = words(rng, 9000)
    near = [" ".join(w if rng.random() > 0.02 else "zz" for w in base.split()) for _ in range(12)]
    return [
        (1, base), (2, base.upper()), (3, base.replace(" ", "\n")), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "One"), (9, "one two"), (10, long), (11, long + " x"),
        (12, "é" * 900), (13, "é" * 900), (14, words(rng, 80) + " " + base), (15, base), (15, base), (None, "no id"), (None, base), *((20 + k, t) for k, t in enumerate(near)), *((60 + k, words(rng, 70)) for k in range(8)),
    ]


def test_exact_dedup(spark, rows):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0))
    weak = lambda b, seed: [F.xxhash64(b) % (3 if seed < 2 else 1 << 40), F.lit(0)]
    for size, prints in ((64, exact_dedup._fingerprint), (4096, exact_dedup._fingerprint), (4096, weak)):
        got = exact_dedup.exact_dedup(frame(spark, rows), size, prints).collect()
        assert len(got) == len(rows)
        by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        for r in got:
            g = by_hash[r["text_sha256"]]
            best = min(g)
            assert (r["group_size"], r["keep_id"]) == (len(g), None if best[1] else best[2])
        assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact_copies(frame(spark, rows)).collect()
    assert Counter(bare(r["text"]) for r in kept) == Counter(groups.keys())
    assert all((r["kept"], r["size"], r["tkey"]) == ("x", "y", "z") for r in kept)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def _links(rows, width, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}))
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[top(a)] = top(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(top(k), []).append(i)
    least = lambda v: min((x for x in v if x is not None), default=None)
    return sorted(((i, len(s), least(ids[top(k)])) for k, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("width", "small"), [(4, 6), (5, 1)])
def test_near_duplicates(spark, rows, width, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    got = minhash.near_duplicates(frame(spark, rows), width=width).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == _links(rows, width, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_copies_that_only_chain(spark):
    """A cloud of copies where many pairs are below the threshold, and outliers are not linked."""
    rng = random.Random(1)
    base = words(rng, 150).split()
    rows = [(k, " ".join(w if rng.random() > (0.004 * (k % 25)) else words(rng, 1) for w in base)) for k in range(1, 90)]
    got = minhash.near_duplicates(frame(spark, rows), width=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == _links(rows, 4, 80)


def test_repeated_row_links_a_large_bucket(spark, monkeypatch):
    """One bucket holds all; its leader links 2 to 5; document 6, a repeated row, is near 5 alone, also repeated."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 1)
    rng = random.Random(3)
    base = ["first", *words(rng, 140).split()]
    swap = lambda w, at: " ".join(f"new{k}" if k in at else x for k, x in enumerate(w))
    five = swap(base, {20, 60}).split()
    six = swap(five, {100, 110, 120})
    rows = [(1, " ".join(base)), *((k, swap(base, {120 + k})) for k in (2, 3, 4)), *[(5, " ".join(five))] * 3, *[(6, six)] * 30]
    real = minhash._signatures

    def one_bucket(bands, rows, width):
        def run(batches):
            for batch in real(bands, rows, width)(batches):
                out = batch.column("bands").to_pylist()
                yield minhash.pa.RecordBatch.from_arrays([*batch.columns[:4], minhash.pa.array([[1]] * len(out), minhash.pa.list_(minhash.pa.int64()))], names=batch.schema.names)

        return run

    monkeypatch.setattr(minhash, "_signatures", one_bucket)
    got = minhash.near_duplicates(frame(spark, rows), width=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == _links(rows, 4, 80)


def test_near_empty(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert minhash.drop_near_copies(frame(spark, [(1, None), (2, "")])).count() == 2


def test_near_copies_without_ids_of_their_own(spark):
    """One row of each component stays, whether doc_ids are missing, shared by different texts, or repeated."""
    rng = random.Random(8)
    a, b, c, d, e, f = (words(rng, 60) for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (None, c), (5, d), (5, e), (5, e), (6, d + " x"), (7, f), (8, f), (8, a + " y"), (9, ""), (9, " "), (9, f + " z"), (None, None), (None, "")]
    got = Counter((r["doc_id"], r["text"]) for r in minhash.drop_near_copies(frame(spark, rows)).collect())
    (nine,) = [k for k in got if k[0] == 9]
    assert not (nine[1] or "").strip()
    del got[nine]
    # a's component keeps the row with an id; of those of f and d the smallest id stays
    assert got == Counter([(None, b), (None, c), (5, d), (5, e), (7, f), (8, a + " y"), (None, None), (None, "")])


def test_circulant_signatures_estimate_similarity():
    made = minhash.Circulant(256)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    a, b = made.signature(ids[:3000]), made.signature(ids[1000:])
    assert abs((a == b).mean() - 0.5) < 0.12
    assert (made.windows[5][1:] == made.windows[6][:-1]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for k in {n for e in edges if e[0] != e[1] for n in e}}


@pytest.mark.parametrize("hot", [4000, 2])
def test_suffix_dedup(spark, rows, hot):
    texts = [(i, (t or "").encode()) for i, t in rows]
    n = 60
    times = Counter(t[k : k + n] for _, t in texts for k in range(len(t) - n + 1))
    expected = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if times[t[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        expected.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=n, hot_group=hot).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert suffix_dedup.remove_repeats(frame(spark, []), length=n).count() == 0


@pytest.mark.parametrize("words_in_passage", [60, 75, 95])
def test_suffix_dedup_of_a_passage_in_all_texts(spark, words_in_passage):
    """A passage below, near and above the length, in texts that differ around it: groups are dealt anew until they are small."""
    rng = random.Random(2)
    passage, n = words(rng, words_in_passage), 300
    other = passage[: n * 2 // 3] + words(rng, 30)
    rows = [(k, words(rng, rng.randint(20, 120)) + " " + (passage if k % 5 else other) + " " + (words(rng, rng.randint(20, 120)) if k % 7 else "one end of all these " * 12)) for k in range(60)]
    times = Counter(t[k : k + n] for _, t in rows for k in range(len(t) - n + 1))
    gone = {i: sum(any(times[t[k : k + n]] > 1 for k in range(max(0, at - n + 1), min(at, len(t) - n) + 1)) for at in range(len(t))) for i, t in rows}
    for hot in (4000, 10, 2):
        got = suffix_dedup.remove_repeats(frame(spark, rows), length=n, hot_group=hot).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got} == gone, hot


def test_long_text_goes_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SLICE", 500)
    rng = random.Random(6)
    base = words(rng, 200)
    rows = [(1, base + " " + words(rng, 900) + " " + base), (2, words(rng, 2000))]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got[1][0] >= 2 * len(base) and got[1][1] == 2 and got[2] == (0, 0)


def test_block_names_do_not_depend_on_partitions(spark, rows):
    named = [sorted((r["name"], r["level"], r["text_sha256"]) for r in exact_dedup.block_names(frame(spark, rows).repartition(k), block_bytes=64).collect()) for k in (1, 9)]
    assert named[0] == named[1]
    top = {}
    for name, level, sha in named[0]:
        top.setdefault(level, {}).setdefault(name, set()).add(sha)
    assert all(len(x) == 1 for level in top.values() for x in level.values())


def test_two_stage_order():
    rng = random.Random(4)
    for trial in range(40):
        texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 5))]
        _, order, begins = suffix_dedup.suffix_array(texts, 1000)
        suffix = {int(begins[k]) + i: t[i:] for k, t in enumerate(texts) for i in range(len(t) + 1)}
        found = [suffix[p] for p in order.tolist()]
        assert found == sorted(suffix.values())


def test_shards(spark, rows):
    got = sharding.shard(frame(spark, rows * 3), n_shards=5, rows_per_salt=10).collect()
    assert len(got) == 3 * len(rows)
    loads, slots, homes = Counter(), {}, {}
    for r in got:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows * 3)
    assert Counter((r["size"], r["text_crc32"]) for r in got) == texts
    total = sum(loads.values())
    for key, shards in homes.items():
        assert len(shards) == 1 or key[0] * texts[key] > total // 20
    assert sharding.shard(frame(spark, []), 5).count() == 0


def test_groups_below_a_shard_stay_whole(spark):
    """Copies of a third of a shard, and of nearly one, have one home; a group of two shards is split into pieces of a shard."""
    rows = [*[(k, "a" * 92) for k in range(17)], *[(k, "b" * 92) for k in range(30)], *[(k, "c" * 92) for k in range(60)], *((k, f"{k:092d}") for k in range(43))]
    got = sharding.shard(frame(spark, rows), n_shards=5, rows_per_salt=10).collect()  # 150 rows of 100 bytes: 30 a shard
    homes = {c: Counter(r["shard"] for r in got if r["text_crc32"] == zlib.crc32(c.encode() * 92)) for c in "abc"}
    assert {c: sorted(h.values()) for c, h in homes.items()} == {"a": [17], "b": [30], "c": [30, 30]}
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(5)}
    assert all(v == list(range(30)) for v in slots.values())


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        cap = rng.randint(60, 150)
        room, plain = [cap] * 40, []
        for s in sorted(sizes, reverse=True):
            b = min((r, k) for k, r in enumerate(room) if r >= s)[1]
            room[b] -= s
            plain.append((s, b))
        runs = sharding.best_fit_decreasing(list(Counter(sizes).items()), 40, cap)
        by_run = Counter({})
        for s, first, last, b in runs:
            by_run[s, b] += last - first + 1
        load, own = Counter(), Counter()
        for (s, b), n in by_run.items():
            load[b] += s * n
        for s, b in plain:
            own[b] += s
        assert sorted(load.values()) == sorted(v for v in own.values() if v)


def test_url_filter(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [("spam", "domain", "b.com", "add", 2), ("spam", "domain", "b.com", "remove", 5), ("spam", "domain", "b.com", "add", 9), ("spam", "domain", "b.com", "add", 10), ("adult", "prefix", "a.org/x/y", "add", 3), ("z", "host", "a.org", "add", 4), ("z", "host", "a.org", "remove", 4), ("q", "url", None, "add", 1)]
    e = spark.createDataFrame([(*x[:4], at(x[4])) for x in entries], "list string, kind string, pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
    caps = [("http://www.b.com/", 1), ("http://www.b.com/", 2), ("https://B.com:80/p", 4), ("http://b.com", 5), ("http://b.com", 9), ("http://xb.com", 9), ("http://a.org/x/y/z?q", 3), ("http://a.org/x", 20), (None, 3), ("nonsense", 3), ("http://b.com", None), ("http://b.com", 9)]
    c = spark.createDataFrame([(k, u, d and at(d), "old", 1) for k, (u, d) in enumerate(caps)], "id int, url string, d string, host string, _k int").withColumn("fetched_at", F.to_timestamp("d"))
    for limit in (50_000, 0):
        got = {r["id"]: (r["blocked"], r["n_active"], r["lists"]) for r in url_filter.filter_urls(c, e, limit).collect()}
        on = {1, 2, 4, 6, 11}
        assert got == {k: (k in on, int(k in on), "" if k not in on else "adult" if k == 6 else "spam") for k in range(len(caps))}
    assert url_filter.filter_urls(c.limit(0), e).count() == 0
    assert not any(r["blocked"] for r in url_filter.filter_urls(c, e.limit(0)).collect())


def test_urls_of_odd_hosts_and_columns(spark):
    """Final dots, addresses in brackets, users, parent domains of numbers, single labels, and columns named like ours."""
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [("l", "domain", "evil.com", "add", 2), ("l", "host", "[2001:db8::1]", "add", 2), ("m", "domain", "com", "add", 6), ("n", "domain", "3.4", "add", 1), ("o", "url", "http://evil.com./x", "add", 4), ("o", "domain", "local", "add", 1)]
    cases = {
        "http://evil.com./x": (3, "evil.com", "l"), "http://EVIL.com.:8080/": (7, "evil.com", "l,m"), "http://[2001:db8::1]/x": (3, "[2001:db8::1]", "l"), "http://u:p@w@[2001:DB8::1]:80": (3, "[2001:db8::1]", "l"),
        "http://1.2.3.4/": (9, "1.2.3.4", ""), "http://a.b.com": (7, "a.b.com", "m"), "http://evil.com./x#": (5, "evil.com", "l"), "http://local/": (2, "local", "o"), "http:///x": (3, "", ""), "http://evil.com..": (3, "evil.com.", ""),
    }
    cols = ["_rid", "_t", "_k", "_lists", "_own_0", "changes", "kind", "pattern", "n_active"]
    for tops in (True, False):
        chosen = [e for e in entries if tops or e[2] not in ("com", "local")]
        e = spark.createDataFrame([(*x[:4], at(x[4])) for x in chosen], "list string, kind string, pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
        c = spark.createDataFrame([(u, at(d), *range(len(cols))) for u, (d, _, _) in cases.items()], "url string, d string, " + ", ".join(f"{x} int" for x in cols)).withColumn("fetched_at", F.to_timestamp("d"))
        for limit in (50_000, 0):
            got = {r["url"]: r for r in url_filter.filter_urls(c, e, limit).collect()}
            lists = lambda x: ",".join(y for y in x.split(",") if tops or y not in ("m", "o"))
            assert {u: (r["host"], r["lists"]) for u, r in got.items()} == {u: (h, lists(x)) for u, (_, h, x) in cases.items()}
            assert all(r[x] == k for r in got.values() for k, x in enumerate(cols) if x != "n_active")


def test_timelines_equal_a_walk(spark):
    """Random dated entries against a plain walk through each pattern's history."""
    rng = random.Random(8)
    entries = [(rng.choice("abc"), "host", rng.choice(("x.org", "y.org")), rng.choice(("add", "remove")), rng.randrange(20)) for _ in range(120)]
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, at long").withColumn("at", F.timestamp_seconds("at"))
    c = spark.createDataFrame([(f"http://{h}/{t}", t) for h in ("x.org", "y.org") for t in range(-1, 22)], "url string, t long").withColumn("fetched_at", F.timestamp_seconds("t"))
    for r in url_filter.filter_urls(c, e).collect():
        live = set()
        for name in "abc":
            state = False
            for t in range(r["t"] + 1):
                acts = {a for x, _, h, a, w in entries if x == name and h == r["host"] and w == t}
                state = state if not acts else "remove" not in acts
            live |= {name} if state else set()
        assert (r["lists"], r["n_active"]) == (",".join(sorted(live)), len(live))


def test_runs_of_a_content_meet_before_its_rows(spark):
    runs = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 20, 22), (1, 1, 6, 9), (1, 1, 3, 7), (2, 2, 4, 4), (3, 3, 0, 1)], "c1 long, c2 long, lo long, hi long").repartition(3)
    times = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 1)], "c1 long, c2 long, times long")
    light = spark.createDataFrame([(7, 1, 1), (8, 2, 2), (9, 3, 3), (10, 4, 4)], "did long, c1 long, c2 long")
    got = suffix_dedup._of_single(light, runs, times).select("did", "r.lo", "r.hi").collect()
    assert sorted(map(tuple, got)) == [(7, 0, 9), (7, 20, 22), (9, 0, 1)]


def test_a_line_repeated_in_a_document_is_one_segment(spark):
    """A row for each content of a document, not for each of its places; the places meet in runs that are removed whole."""
    import pyarrow as pa

    line, other = "all work and no play, ", "".join(chr(97 + (k * k + 7 * k) % 26) for k in range(500))
    text = (other + line * 200 + other[::-1]).encode()
    h = suffix_dedup.anchors(text)[0]
    batch = pa.record_batch({"did": pa.array([5]), "copies": pa.array([1]), "hs": pa.array([sorted(set(h.tolist()))]), "text": pa.array([text.decode()])})
    rows = pa.Table.from_batches(suffix_dedup._segments(400)(iter([batch]))).to_pylist()
    assert len(rows) == len({(r["c1"], r["c2"]) for r in rows}) < len(h) - 100
    assert sorted(i for r in rows for lo, hi in zip(r["lo"], r["hi"], strict=True) for i in range(lo, hi + 1)) == list(range(len(text) - 399))
    assert max(r["k"] for r in rows) > 100 and sum(r["k"] for r in rows) == len(h)
    docs = spark.createDataFrame([(k, chr(65 + k) * k + line * (60 + k)) for k in range(6)] + [(9, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {**{k: (len(line) * (60 + k), 1) for k in range(6)}, 9: (0, 0)}


@pytest.mark.parametrize(("width", "common", "cut"), [(50, 4000, 1 << 20), (12, 4000, 700), (12, 2, 1 << 20), (5, 3, 90)])
def test_passages_of_words_that_documents_share(spark, monkeypatch, width, common, cut):
    """Shared runs of words are found whatever their bytes; what one document alone repeats is not; nothing more is removed."""
    monkeypatch.setattr(passages, "COMMON", common)
    monkeypatch.setattr(passages, "_SLICE", cut)
    rng = random.Random(width + common)
    some = lambda n: [rng.choice(["a", "\u00e9", "to", "the", "x" * 30, "", "\t", "\u00a0"]) + str(rng.randint(0, 99)) for _ in range(n)]
    passage, line, own = some(width + 3), some(7), some(width * 2)
    assert len(" ".join(["to"] * width)) < suffix_dedup.LENGTH  # too short for a string that is removed
    rows = [(k, [*some(k * 9), *passage[k % 5 :], *some(30)]) for k in range(9)]  # the last ones share one word less than a window
    rows += [(20 + k, [*some(11), *line * (3 + 9 * k), *some(3)]) for k in range(3)] + [(30, ["the"] * width * 2), (31, ["the"] * (width + 1))]
    rows += [(40, own * 3), (41, some(width * 3)), (42, some(2)), (43, []), (44, [*passage, *passage, *line, *passage])]
    rows = [(k, "  ".join(w)) for k, w in rows] + [(41, "  ".join(some(width))), (50, None), (None, " ".join(passage))]
    rows += [(60, " ".join(some(width)))] * 2  # a row given twice
    split = [re.findall(r"[^ \t-\r]+", t or "") for _, t in rows]
    where = {}
    for n, w in enumerate(split):
        for k in range(len(w) - width + 1):
            where.setdefault(tuple(w[k : k + width]), set()).add(n)
    expected = Counter()
    for (i, t), w in zip(rows, split, strict=True):
        hit = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if len(where[tuple(w[k : k + width])]) > 1:
                hit[k : k + width] = True
        expected[i, len((t or "").encode()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), int(hit.sum())] += 1
    docs = frame(spark, rows).repartition(3)
    out = suffix_dedup.remove_repeats(docs, passage_words=width)
    plain = suffix_dedup.remove_repeats(docs)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_passages"], r["n_passage_words"]) for r in out.collect()) == expected
    assert sum(k[3] > 0 for k in expected) > 9 and any(k[3] == 0 for k in expected if k[1] > 400)
    assert Counter(map(tuple, out.select(plain.columns).collect())) == Counter(map(tuple, plain.collect()))
    assert suffix_dedup.remove_repeats(frame(spark, []), passage_words=width).columns == [*plain.columns, "n_passages", "n_passage_words"]


def test_a_shared_passage_below_400_bytes_is_told(spark):
    rng = random.Random(8)
    passage = " ".join(f"{rng.randint(0, 999):03}" for _ in range(60))
    rows = [(k, words(rng, 300) + " " + (passage if k < 2 else "") + " " + words(rng, 300)) for k in range(4)]
    got = {r["doc_id"]: (r["n_removed"], r["n_passages"], r["n_passage_words"]) for r in suffix_dedup.remove_repeats(frame(spark, rows), passage_words=passages.WORDS).collect()}
    assert len(passage) < 400 and got == {0: (0, 1, 60), 1: (0, 1, 60), 2: (0, 0, 0), 3: (0, 0, 0)}
