"""Rules, classifier, language model, packing, mixing and the pipeline."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import lm, mixing, packing, quality_classifier, quality_rules, queries
from tilewright.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n_words string, tokens string, p string, rate string, held_out string"
DATA = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * 7) for i, t in rows], SCHEMA)


def sentence(rng, n, junk=False):
    vocabulary = ["the", "of", "and", "sun", "river", "stone", "light", "walks", "blue", "green", "tree", "small", "house", "water", "old", "year"]
    return " ".join(rng.choice(vocabulary) + ("$$$" if junk else "") + ("\n" if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    good = [(k, sentence(rng, rng.randint(40, 160))) for k in range(1, 41)]
    bad = [(k, sentence(rng, rng.randint(40, 160), True)) for k in range(41, 61)]
    return [*good, *bad, (70, None), (71, ""), (72, " \n\t"), (73, "a b"), (74, "x y z " * 40), (75, "line one\n" * 30), (76, good[0][1]), (76, good[0][1]), (None, good[1][1]), (77, "w" * 30000 + " end"), (78, "naïve  café　x\x1cy")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([*((k, 1, int(k % 13 == 0)) for k in range(1, 31)), *((k, 0, 0) for k in range(41, 56)), (None, 1, 0), (70, None, None)], "doc_id long, quality int, toxic int")


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def spark_hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_quality_rules(spark, rows, labels):
    buckets = 256
    got = quality_rules.quality_rules(frame(spark, rows), labels, n_buckets=buckets).collect()
    assert len(got) == len(rows)
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target = Counter(), Counter()
    grams = {}
    for i, t in rows:
        w = tokens(t)
        g = [spark_hash(*x) % buckets for x in [*((a,) for a in w), *zip(w, w[1:])]]
        grams[i] = g
        raw.update(g)
        target.update(g if i in trusted and i is not None else [])
    share = sum(target.values()) / sum(raw.values())
    weight = [math.log((target[k] / share + 10) / (raw[k] + 10)) for k in range(buckets)]
    for r in got:
        t = dict(rows)[r["doc_id"]] or ""
        w = tokens(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = {x for x, n in Counter(windows).items() if n > 1}
        covered = {k + d for k, x in enumerate(windows) if x in often for d in range(3)}
        lines = [x for x in t.split("\n") if tokens(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        score = sum(weight[k] for k in grams[r["doc_id"]]) / len(grams[r["doc_id"]]) if w else 0.0
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)
    assert all(r["kept"] for r in got if r["doc_id"] in range(1, 41) and not r["base_failed"])
    assert not any(r["kept"] for r in got if r["doc_id"] in range(41, 61))
    assert quality_rules.quality_rules(frame(spark, []), labels).count() == 0
    assert {r["score"] for r in quality_rules.quality_rules(frame(spark, rows), labels.limit(0)).collect()} == {0.0}


def test_classifier(spark, rows, labels):
    got = quality_classifier.classify(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        part = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == part and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    known = [(r, r["doc_id"] <= 40) for r in got if r["doc_id"] in {*range(1, 61)}]
    assert sum((r["score"] > 0.5) == good for r, good in known if r["held_out"]) >= 0.9 * sum(r["held_out"] for r, _ in known)
    assert {r["score"] for r in quality_classifier.classify(frame(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(frame(spark, []), labels).count() == 0


def test_flat_trees_equal_walking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality_classifier.fit_forest(x, y, rounds=20, depth=3)
    scores = forest.scores(x)
    assert ((scores > 0.5) == y).mean() > 0.95
    for row, s in zip(x[:50], scores, strict=False):
        total = forest.start
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert s == pytest.approx(1 / (1 + math.exp(-total)))


def cut(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def test_language_model(spark, rows):
    """Against counts in plain dictionaries; probabilities differ by what a byte's rounding moves them."""
    got = lm.score_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    c1, c2, c3 = Counter(), Counter(), Counter()
    for w in (cut(t) for i, t in rows if not held(i)):
        c1.update(w)
        c2.update(zip([b"\n", *w], w, strict=False))
        c3.update(zip([b"\n", *w], w, w[1:], strict=False))
    n, v, d = sum(c1.values()), len(c1), lm.DISCOUNT
    after1, after2 = Counter(u for u, _ in c2), Counter(k[:2] for k in c3)

    def p1(w):
        return (c1[w] - d if w in c1 else d * v) / n

    def p2(u, w):
        return (max(c2[u, w] - d, 0) + d * after1[u] * p1(w)) / c1[u] if u in c1 else p1(w)

    def p3(t, u, w):
        m = c2[t, u]
        went_on = sum(k for x, k in c3.items() if x[:2] == (t, u)) if u == b"\n" else m
        return (max(c3[t, u, w] - d, 0) + (m - went_on + d * after2[t, u]) * p2(u, w)) / m if m else p2(u, w)

    for r in got:
        w = cut(dict(rows)[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(x in c1 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        score = math.log10(p2(b"\n", w[0])) + sum(math.log10(p3(*x)) for x in zip([b"\n", *w], w, w[1:], strict=False))
        assert abs(r["score"] - score) <= 0.02 * len(w)
    assert lm.score_texts(frame(spark, [])).count() == 0
    assert lm.score_texts(frame(spark, rows).filter("doc_id = -1")).count() == 0


def test_probabilities_add_up(spark, rows, tmp_path):
    """Over all known words and the unknown one, after any two words, up to the rounding of the codes; frequent first words are cut over parts."""
    docs = frame(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("learn"))
    info, _ = lm.train(docs, str(tmp_path / "model"), docs.count())
    trie = lm.Trie(info)
    assert len(info["cut"]) > 5 and (trie.figures(np.array(info["cut"]))[2] > 1).all()
    vocabulary = sorted({w for _, t in rows for w in cut(t)})

    def ids(words):
        return np.array([trie.ids(lm._word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1] if w.strip() else np.array([lm.END]))[0] for w in words])

    for context in ([b"the", b"of"], [b"x", b"y"], [b"never", b"seen"], [b"the", b"never"]):
        before, total = ids(context), 0.0
        for w in [*vocabulary, b"unseen-word"]:
            _, p = lm.token_probabilities(trie, np.array([3]), np.append(before, ids([w])))
            total += p[2]
        assert total == pytest.approx(1, abs=0.03)


def test_words_of_bytes(monkeypatch):
    """Words and their identity as split() has them, over breaks between documents and in small slices."""
    rng = random.Random(5)
    texts = ["".join(rng.choices(" \n\tabABéz\x1c\x0b", k=rng.randint(0, 60))).encode() for _ in range(300)] + [b"x" * 500, b"", b" "]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    words = [w for t in texts for w in t.lower().split()]
    for size in (1 << 20, 64):
        monkeypatch.setattr(lm, "_SLICE", size)
        lm._powers_to.cache_clear()
        starts, found = lm._word_hashes(data, ends)
        assert np.diff(np.searchsorted(starts, ends)).tolist() == [len(t.split()) for t in texts]
        of = dict(zip(words, found.tolist(), strict=True))
        assert [of[w] for w in words] == found.tolist() and len(set(of.values())) == len(of)
    lm._powers_to.cache_clear()


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 5), (1, 1), (1, 1 << 58), (1000, 10), (1000, 1 << 40), (777, 1 << 58), (5000, 6000)):
        v = np.sort(rng.integers(0, u, n))
        coded = lm.Coded(lm.ef_encode("x", v, u), "x")
        assert (coded.get(np.arange(n)) == v).all()
        wanted = np.concatenate([v, rng.integers(0, u, 500)])
        at = coded.find(wanted)
        assert ((at >= 0) == np.isin(wanted, v)).all() and (v[at[at >= 0]] == wanted[at >= 0]).all()
        lo, hi = np.sort(rng.integers(0, n + 1, (2, len(wanted))), axis=0)
        inside = coded.find(wanted, lo, hi)
        assert (inside == [next((k for k in range(a, b) if v[k] == w), -1) for w, a, b in zip(wanted, lo, hi, strict=True)]).all() if n <= 1000 else True
        size = sum(x.nbytes for x in lm.ef_encode("x", v, u).values())
        assert size <= n * (max(0, math.log2(u / max(n, 1))) + 1.5 * 3) / 8 + 100  # low bits, at most 3 high bits an entry, half as much for the directory
    p = rng.normal(size=5000)
    q = lm.quantise("p", p)
    assert np.abs(lm.dequantise(q, "p", np.arange(5000)) - p).mean() < 0.02


@pytest.mark.parametrize(("window", "space", "merge"), [(1024, 64, 8192), (64, 3, 2)])
def test_packing(spark, rows, window, space, merge):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(frame(spark, rows).repartition(5), tokenizer_path(), window, space, merge_items=merge).collect()
    per_doc, per_sequence = {}, {}
    for r in got:
        per_doc.setdefault(r["doc_id"], []).append(r)
        per_sequence.setdefault(r["sequence_id"], []).append(r)
    times = Counter(i for i, _ in rows)
    for i, t in dict(rows).items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(per_doc[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == times[i] * len(ids) and {r["doc_tokens"] for r in pieces} == {len(ids)}
        for r in pieces:
            assert bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes()
    for pieces in per_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    assert len(per_sequence) <= 1 + 1.35 * sum(r["length"] for r in got) / window
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_units_equal_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["a  b", "\n\n x", "a \n b'sx 12's  ", "  ", "<|endoftext|> hi", "a <|endoftext|> b", "x  <|endoftext|>y.", "q\n\n<|endoftext|><|endoftext|>\n c", "x y   z", "a\x1cb \x1c c", "é́ \t\tq'll!!'re", "", "\r\n \r\nA", "end.\nNo, no.'s a.,b.", "x  y ½x ²"]
    assert packing.UnitTokenizer(tokenizer_path()).encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    rng = np.random.default_rng(5)
    letters = list("etaonxyZQ" + "àÿßÉ" + "ªµ×÷ő") + [" "] * 6 + [".", ",", "$", "7"]
    texts = ["".join(rng.choice(letters, 60)) for _ in range(300)]
    whole = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    small = packing.UnitTokenizer(tokenizer_path(), remembered=50)
    assert small.encode(texts) == whole and small.encode(texts) == whole and len(small) <= 50 and len(small.late) <= 50 and small.filled >= packing.FILLINGS


def test_mixing(spark, rows, labels):
    got = mixing.mix(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    assert all(abs(r["p_good"] + r["p_toxic"] + r["p_poor"] - 1) < 1e-9 and 0 <= r["rate"] <= 1 and r["copies"] in (0, 1) for r in got)
    good, poor = ([r["rate"] for r in got if r["doc_id"] in range(a, b)] for a, b in ((1, 41), (41, 61)))
    assert np.mean(good) > 0.95 > np.mean(poor)
    assert mixing.mix(frame(spark, []), labels).count() == 0
    assert len(mixing.mix(frame(spark, rows), labels.limit(0)).collect()) == len(rows)


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.5] * 3, 300)
    rows = [(k, int(rng.integers(1, 400)), p[k].tolist()) for k in range(300)]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    rated, report = mixing.fit_rates(members, targets=[9000.0, 3000.0, 20000.0], max_rate=None)
    r = rated.collect()
    totals = sum(x["rate"] * x["tokens"] * np.array(x["p"]) for x in r)
    assert np.allclose(totals, [9000, 3000, 20000], rtol=0.01) and all(x["rate"] >= 0 for x in r)
    assert np.allclose(totals, report["reached"])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_mixing_query_meets_goals(spark):
    """The totals of the query's own rates: the good tokens stay, the others have their weights beside them."""
    got = queries.op8_soft_membership_mixing(spark, DATA).collect()
    mass = np.array([[r["tokens"] * r[f"p_{d}"] for d in mixing.WEIGHTS] for r in got])
    weights = np.array(list(mixing.WEIGHTS.values()))
    goal = weights * mass[:, 0].sum() / weights[0]
    assert (np.abs(np.array([r["rate"] for r in got]) @ mass - goal) <= mixing.TOLERANCE * goal * 1.001).all()  # each domain by its own goal
    _copies_meet_rates(got, list(mixing.WEIGHTS))


def _copies_meet_rates(got, domains):
    """Whole copies beside rates: in each likeliest domain their tokens differ by no more than the longest document."""
    likeliest = [max(range(len(domains)), key=lambda k: (r[f"p_{domains[k]}"], -k)) for r in got]
    for k in range(len(domains)):
        own = [r for r, d in zip(got, likeliest, strict=True) if d == k]
        if own:
            assert abs(sum((r["copies"] - r["rate"]) * r["tokens"] for r in own)) <= max(r["tokens"] for r in own) + 0.01 * len(own)
            assert abs(sum(r["copies"] - r["rate"] for r in own)) <= 1 + 1e-5 * len(own)
    assert all(r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in got)


def test_rows_without_ids_are_drawn_each(spark):
    """A source without ids is mixed like any other, and repeated rows share their copies."""
    text = lambda k: f"plain words number {k % 50} " + ("vile junk" if k % 2 else "fine prose")
    labelled = [(k, text(k)) for k in range(40)]
    docs = frame(spark, labelled + [(None, text(k)) for k in range(400)] + [(7, "twice vile junk")] * 6)
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels, max_rate=None).collect()
    assert len(got) == 446 and {r["copies"] for r in got if r["doc_id"] is None} >= {0, 1}
    _copies_meet_rates(got, list(mixing.WEIGHTS))
    assert mixing.drawn(docs, labels, max_rate=None).count() == sum(r["copies"] for r in got)


def test_fit_says_how_it_ended(spark):
    members = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 10, [0.0, 1.0])], "doc_id long, tokens long, p array<double>")
    assert mixing.fit_rates(members, targets=[30.0, 5.0], max_rate=None)[1]["ended"] == "goal"
    assert mixing.fit_rates(members, targets=[30.0, 5.0], max_rate=1.0)[1]["ended"] == "stuck"
    assert mixing.fit_rates(members, targets=[30.0, 5.0], max_rate=None, max_steps=0)[1]["ended"] == "steps"


def test_rates_written_between_steps(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(1, 400)), x.tolist()) for k, x in enumerate(rng.dirichlet([0.3] * 3, 300))]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    fit = lambda: mixing.fit_rates(members, targets=[1000.0, 20000.0, 200.0], max_rate=None)
    plain, report = fit()
    monkeypatch.setattr(mixing, "STEPS_A_PLAN", 1)
    written, again = fit()
    assert report["steps"] == again["steps"] > 1 and np.allclose(report["reached"], again["reached"])
    of = lambda d: [r["rate"] for r in d.orderBy("doc_id").collect()]
    assert np.allclose(of(plain), of(written))


def test_statistics_by_hand():
    text = b"Ab ab, ab!\nx9 #\n\nAb ab, ab!\nx9 #\n"
    found = dict(zip(quality_classifier.FEATURES, quality_classifier.statistics([text])[0], strict=True))
    w, n = text.decode().split(), len(text)
    pairs, triples, lines = list(zip(w, w[1:], strict=False)), list(zip(w, w[1:], w[2:], strict=False)), [x for x in text.decode().split("\n") if x]
    share = lambda chars: sum(text.decode().count(c) for c in chars) / n
    sizes = [len(x) for x in w]
    mean = sum(sizes) / len(w)
    expected = {
        "log_words": math.log(10), "log_bytes": math.log(n), "mean_word": mean, "std_word": math.sqrt(sum((x - mean) ** 2 for x in sizes) / 10), "max_word": 3, "unique_words": len(set(w)) / 10,
        "repeat_pairs": 1 - len(set(pairs)) / 9, "repeat_triples": 1 - len(set(triples)) / 8, "upper": share("A"), "lower": share("abx"), "digit": share("9"), "space": share(" "), "newline": share("\n"),
        "symbol": share("#"), "exclaim": share("!"), "comma": share(","), "stop": 0, "other_ascii": 0, "high": 0, "entropy": -sum(text.count(bytes([c])) / n * math.log(text.count(bytes([c])) / n) for c in set(text)),
        "log_lines": math.log(4), "repeat_lines": 0.5, "mean_line": n / 4, "short_words": 1.0, "lines_end": 0.5, "top_word": 2 / 10,
    }
    assert found == pytest.approx(expected)
    assert not quality_classifier.statistics([b"", b" \n"]).any()


def test_posteriors_by_hand(spark, rows, labels):
    """Naive Bayes in plain dictionaries; an id with several labels has the worst of them."""
    extra = labels.union(spark.createDataFrame([(2, 0, 0), (3, 1, 1), (41, 1, 0)], labels.schema))
    worst = {}
    for i, q, t in extra.collect():
        if i is not None and q is not None:
            a = worst.get(i, (1, 0))
            worst[i] = (min(a[0], q), max(a[1], t))
    of = {i: 1 if t else 0 if q else 2 for i, (q, t) in worst.items()}
    n_buckets = mixing.N_BUCKETS
    bag = lambda t: [xxhash.xxh3_64_intdigest(w) % n_buckets for w in (t or "").encode().lower().split()]
    counts, seen = [Counter(), Counter(), Counter()], [1, 1, 1]
    for i, t in rows:
        if i in of:
            counts[of[i]].update(bag(t))
            seen[of[i]] += 1
    for r in mixing.mix(frame(spark, rows), extra).collect():
        b = bag(dict(rows)[r["doc_id"]])
        log = [math.log(seen[k] / sum(seen)) + (sum(math.log((counts[k][x] + 1) / (sum(counts[k].values()) + n_buckets)) for x in b) * min(1, mixing.EVIDENCE_WORDS / len(b)) if b else 0) for k in range(3)]
        p = np.exp(np.array(log) - max(log))
        assert np.allclose([r["p_good"], r["p_toxic"], r["p_poor"]], p / p.sum()) and r["tokens"] == len(b) + 1
    assert of[2] == 2 and of[3] == 1 and of[41] == 2


def test_conflicting_labels_do_not_depend_on_order(spark, rows, labels):
    both = labels.union(labels.filter("doc_id < 20").withColumn("quality", 1 - F.col("quality")))
    one, two = (quality_classifier.classify(frame(spark, rows), x).orderBy("doc_id").collect() for x in (both, both.repartition(7).orderBy(F.desc("doc_id"), "quality")))
    assert one == two


def test_stages_keep_clashing_columns(spark, rows, labels, tmp_path):
    """Columns named like those the operators make come through every stage as they are; empty tables stay empty."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = ["_t", "_made", "score", "_sha", "_tkey", "tkey", "kept", "copies", "n_words", "d", "_copy", "text_sha256", "times", "_own_0"]
    docs = frame(spark, rows).select("doc_id", "text", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in kept for c in names), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(rows)


def _scores(rows, trusted, buckets):
    """The rules' verdicts in plain Python."""
    grams = [[spark_hash(*x) % buckets for x in [*((a,) for a in w), *zip(w, w[1:], strict=False)]] for w in (tokens(t) for _, t in rows)]
    raw, target = Counter(), Counter()
    for (i, _), g in zip(rows, grams, strict=True):
        raw.update(g)
        target.update(g if i in trusted else [])
    share = sum(target.values()) / sum(raw.values())
    for (_, t), g in zip(rows, grams, strict=True):
        w = tokens(t)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        often = {x for x, n in Counter(windows).items() if n > 1}
        covered = {k + d for k, x in enumerate(windows) if x in often for d in range(3)}
        score = sum(math.log((target[k] / share + 10) / (raw[k] + 10)) for k in g) / len(g) if g else 0
        yield len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and score >= quality_rules.THRESHOLD


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    """Every stage's decisions against plain Python on its own input; all but the last keep the columns."""
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    docs, cols = source, source.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA).cache()
        assert docs.columns == cols
        out[name] = [[(r["doc_id"], r["text"]) for r in x.collect()] for x in (before, docs)]
        assert docs.join(before, cols, "left_anti").count() == 0
    rows, kept = out["quality_rules"]
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1} - {r["doc_id"] for r in labels if r["quality"] == 0}
    assert Counter(kept) == Counter(r for r, k in zip(rows, _scores(rows, trusted, quality_rules.N_BUCKETS), strict=True) if k)
    rows, kept = out["exact_dedup"]
    best = {}
    for i, t in rows:
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    assert sorted(i for i, _ in kept) == sorted(min(v)[1] for v in best.values())
    rows, kept = out["near_dedup"]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.encode().lower().split()) for i, t in rows)}
    top = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top[a], top[b]))
                top = {i: x if c == y else c for i, c in top.items()}
    assert sorted(i for i, _ in kept) == sorted(set(top.values()))
    rows, kept = out["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{DATA}/labels.parquet"), max_rate=None).collect()}
    assert Counter(i for i, _ in kept) == Counter({i: n for i, n in copies.items() if n})
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{DATA}/labels.parquet"), max_rate=None).collect()
    _copies_meet_rates(mixed, list(mixing.WEIGHTS))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in kept}
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    assert sum(r["length"] for r in pieces) == sum(len(ids[i]) for i, _ in kept)
    in_order = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) and b[1] + b[2] <= 1024 for a, b in zip([(None, 0, 0), *in_order], in_order, strict=False))
    root = spark.conf.get("spark.checkpoint.dir")
    there = set(os.listdir(root))
    again = corpus_pipeline.run(spark, DATA)
    assert again.count() == len(pieces)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - there}
    assert "mixing" in left and not left & {"quality_rules", "exact_dedup", "near_dedup", "members", "weights", "rates"}  # what only stages before needed is gone
