"""Classifiers, language, decontamination, mixing, LM scoring, WARC and the pipeline."""

import base64
import collections
import gzip
import hashlib
import itertools
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import catalogue, decontaminate, language, lattice, mixing, quality, textclf, toxicity, warc
from palimpsest.llm.common import remainder_of_crc
from tests.compare import assert_same, database
from tests.llm.data import ROWS, documents, empty


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert_same(catalogue.QUERIES[name](spark, sf_dir), database(sf_dir), catalogue.ORACLES[name])


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (10, 0, 1), (11, None, None), (99, 1, 1), (9, 5, 7)], "doc_id long, quality int, toxic int")


def held(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % modulus == remainder


def check_scores(rows, threshold):
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == held(r.doc_id, 4, 2)


def test_toxicity_cases(spark):
    check_scores(toxicity.score(documents(spark), labels(spark)).select("row.doc_id", "held_out", "score", "predicted").collect(), 0.3)
    assert toxicity.score(empty(spark), labels(spark)).count() == 0
    assert toxicity.score(documents(spark), labels(spark).limit(0)).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.drop_toxic(documents(spark), labels(spark)).columns == documents(spark).columns


def test_quality_cases(spark):
    check_scores(quality.score(documents(spark), labels(spark)).collect(), 0.7)
    assert quality.score(empty(spark), labels(spark)).count() == 0
    assert quality.score(documents(spark), labels(spark).limit(0)).count() == len(ROWS)
    assert quality.score(documents(spark).drop("n_chars"), labels(spark)).count() == len(ROWS)


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.1"


def accuracy(scored, truth, column):
    j = scored.where("held_out").join(truth.select("doc_id", F.col(column).alias("y")).where("y is not null"), "doc_id")
    return j.agg(F.avg((F.col("predicted") == F.col("y")).cast("int"))).first()[0]


def test_held_out_accuracy(spark, larger):
    docs, truth = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    assert accuracy(quality.score(docs, truth), truth, "quality") > 0.97
    assert accuracy(toxicity.score(docs, truth).select("row.doc_id", "held_out", "score", "predicted"), truth, "toxic") > 0.95
    got = language.identify(docs.select("doc_id", "text", "lang")).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_sample_is_refilled_and_labels_agree(spark):
    docs = spark.createDataFrame([(1, None), (2, "x" * 50_000), (3, "c"), (4, "d"), (5, "e")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 1), (4, 1), (4, 1), (5, 0), (77, 1)], "doc_id long, toxic int")
    got = textclf.training_sample(docs, marks, "toxic", 3, F.lit(False)).collect()
    assert sorted((r.label, len(r.text)) for r in got) == [(0, 1), (1, 1), (1, 40_000)]
    led = textclf.training_sample(docs, marks, "toxic", 3, F.lit(False), lead=F.lit("12")).collect()
    assert {r.text[:3] for r in led} == {"12\x00"} and max(len(r.text) for r in led) == 40_003
    quality_rows = docs.withColumn("n_chars", F.length("text"))
    assert quality.score(quality_rows, marks.withColumnRenamed("toxic", "quality")).count() == 5


def test_ftrl_against_scalars(monkeypatch):
    """Training coordinate by coordinate, with plain dictionaries."""
    monkeypatch.setattr(toxicity, "LEAST_DOCS", 1)
    monkeypatch.setattr(toxicity, "L1", 0.2)
    rows = [(1, "you are a bad bad person"), (0, "what a nice day it is"), (1, "bad day"), (0, None), (0, "a nice person")] * 3
    codes, z, n = textclf.TokenCodes(), collections.Counter(), collections.Counter()

    def inputs(text):
        one, two, skip, mask = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 2**64 - 1
        u = [codes[w] for w in (text or "").lower().split()]
        out = [(x * one & mask) >> 64 - toxicity.BITS for x in u]
        for gap, salt in ((1, two), (2, skip)):
            out += [((a * salt + b * one) * two & mask) >> 64 - toxicity.BITS for a, b in zip(u, u[gap:])]
        return [*dict.fromkeys(out), -1]

    def weight(i):
        l1 = 0.0 if i == -1 else 0.2
        return 0.0 if abs(z[i]) <= l1 and i != -1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA)

    rng = np.random.default_rng(3)
    for _ in range(toxicity.EPOCHS):
        for k in rng.permutation(len(rows)):
            own = inputs(rows[k][1])
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - rows[k][0]
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    at, values, bias = toxicity.train(rows)
    want = {i: weight(i) for i in z if i != -1 and weight(i)}
    assert set(at.tolist()) == set(want) and np.allclose(values, [want[i] for i in at.tolist()], atol=1e-5) and abs(bias - weight(-1)) < 1e-9
    texts = ["bad person", "", "a nice bad day it is bad"]
    assert np.allclose(toxicity.score_batch(texts, np.bincount(at, values, 1 << toxicity.BITS).astype(np.float32), bias, textclf.TokenCodes()), [1 / (1 + math.exp(-sum(weight(i) for i in inputs(t)))) for t in texts], atol=1e-5)


def test_training_holds_neither_texts_nor_all_slots():
    rows = [(k % 2, f"{'vile' if k % 2 else 'kind'} words number {k % 7} here") for k in range(400)]
    tracemalloc.start()
    at, values, bias = toxicity.train(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and len(at)
    blocks = [len(block) for block in toxicity._in_blocks((0, t) for t in ["x" * 200_000] * 7 + [None] * 600)]
    assert sum(blocks) == 607 and blocks[0] == 3 and max(blocks) <= 256
    again = toxicity.train(iter(rows))
    assert np.array_equal(at, again[0]) and np.array_equal(values, again[1]) and bias == again[2]
    assert not len(toxicity.train([(0, ""), (1, None)])[0])


def test_language_votes_against_scalars():
    rng = np.random.default_rng(5)
    letters = {"en": "etaoin", "de": "enisra", "fr": "esaitn", "es": "eaosrn", "xx": "zqxjk"}
    say = lambda lang, n: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(n))
    model = language.train([(lang, say(lang, 30)) for lang in letters for _ in range(20)])
    texts = [say(lang, 12) + " 3! É" for lang in letters] + ["a", None, "123"]
    for text, got, score in zip(texts, *language.predict(texts, model)):
        if text is None or not any(c.isalpha() for c in text):
            assert (got, score) == ("und", 0.0)
            continue
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in b"  " + text.lower().encode() + b"  ")
        grams = [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 32 - language.BITS for i in range(len(raw) - 2)]
        margin = [sum(float(model["w"][g, c]) for g in grams) / len(grams) + model["b"][c] for c in range(model["w"].shape[1])]
        f = len(model["families"])
        family = max(range(f), key=lambda c: margin[c])
        squash = lambda x: 1 / (1 + math.exp(-2 * x))
        votes, sums = collections.Counter(), collections.Counter()
        for (p, q), m in zip(model["pairs"], margin[f:]):
            votes[p if m > 0 else q] += 1
            sums[p] += squash(m)
            sums[q] += 1 - squash(m)
        members = model["members"][family]
        best = max(members, key=lambda k: (votes[k], sums[k], -k))
        sure = squash(margin[family]) / sum(squash(m) for m in margin[:f])
        assert got == model["langs"][best] and abs(score - sure * (sums[best] / (len(members) - 1) if len(members) > 1 else 1.0)) < 1e-4


def test_quality_features_against_scalars():
    texts, sizes = ["The cat! the CAT 12\nthe cat\nthe cat", "", None, "a a a a | {x}"], [10, None, -4, 3]
    d, s, x = quality.features(texts, sizes, textclf.TokenCodes())
    for k, text in enumerate(texts):
        t = text or ""
        raw, words, lines = t.encode(), t.lower().split(), t.split("\n") if t else []
        codes = textclf.TokenCodes()
        slots = {(codes[w] * 0x9E3779B97F4A7C15 & 2**64 - 1) >> 64 - quality.WORD_BITS for w in words}
        count = lambda chars: sum(chr(b) in chars for b in raw)
        shares = [count(c) / max(1, len(raw)) for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "#$%&*+=@^_~", "|<>{}[]/\\", "\n", " \t\r\x0b\x0c")]
        own = [codes[w] for w in words]
        shares += [sum(a == b for a, b in zip(own[g:], own)) / max(1, len(own)) for g in (1, 2)]
        shares += [1 - len(slots) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines))]
        bins = [sum(e <= v for e in quality.EDGES) for v in shares]
        bins += [int(math.log2(len(raw) + 1)), min(quality.BINS - 1, int(2 * len(raw) / max(1, len(words)))), quality.BINS - 1 if sizes[k] is None else max(0, sizes[k]).bit_length()]
        want = {slot: 1 / math.sqrt(len(slots)) for slot in slots} | {(1 << quality.WORD_BITS) + j * quality.BINS + b: 0.5 for j, b in enumerate(bins)}
        got = dict(zip(s[d == k].tolist(), x[d == k].tolist()))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    model = (0.3, rng.standard_normal(50), rng.standard_normal((50, 4)).astype(np.float32))
    slot, value = np.array([3, 7, 9, 20]), np.array([0.5, 1.0, 2.0, 0.1])
    z, _, _ = quality.predict(model, np.zeros(4, dtype=np.int64), slot, value, 1)
    want = 0.3 + sum(model[1][s] * x for s, x in zip(slot, value)) + sum(model[2][a] @ model[2][b] * x * y for (a, x), (b, y) in itertools.combinations(zip(slot, value), 2))
    assert abs(z[0] - want) < 1e-4


def test_language_cases(spark):
    rows = language.identify(documents(spark)).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == held(r.doc_id, 5, 0)
        assert (r.lang_pred == "und") == (r.doc_id in (4, 5, 6)) and r.lang_pred in ("und", "en", "de", "fr", "es")
    assert language.identify(empty(spark)).count() == 0
    unknown = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unknown).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    rng, rows = np.random.default_rng(4), []
    for k in range(70):
        words = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(12)]
        for j in range(8):
            rows.append((10 * k + j, " ".join(rng.choice(words, 5000 if k == 69 else 60)), f"x{k:02}"))  # the last one has long texts only
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {r[0]: r[2] for r in rows}
    got = language.identify(docs).collect()
    right = [r.doc_id for r in got if r.lang_pred == truth[r.doc_id]]
    assert len({r.lang_pred for r in got}) == 70 and len(right) > 0.9 * len(rows) and sum(i >= 690 for i in right) == 8


def index_of(*items):
    return decontaminate.Index(list(enumerate(items)))


def found(index, text):
    return [(m[0], m[4]) for m in index.matches(text, decontaminate.Tokens())]


def test_templates():
    index = index_of("Yesterday Anna bought 3 kg of fresh apples for 12 dollars and then gave Anna 3 more pieces", "Too short", None, "")
    assert found(index, "so. Yesterday Peter bought 8 kg of fresh apples for 40 dollars and then gave Peter 8 more pieces okay") == [(0, False)]
    assert found(index, "so. Yesterday Peter bought 8 kg of fresh apples for 40 dollars and then gave Maria 9 more pieces okay") == []
    assert found(index, "YESTERDAY ANNA bought 3 kg of fresh apples for 12 dollars and then gave anna 3 more pieces") == [(0, True)]
    assert found(index, "Yesterday Anna bought something else") == [] and found(index, None) == [] and found(index, "too short!") == [(1, True)]


def test_runs_of_names_and_number_words():
    index = index_of("Last week at the market Anna bought three baskets of fresh red apples and Anna gave them to the old teacher", "学校 の 庭 に 三本の木 があります何本ですか")
    say = "Last week at the market {0} bought {1} baskets of fresh red apples and {2} gave them to the old teacher".format
    assert found(index, say("Mary Jane", "twenty five", "Mary Jane")) == [(0, False)] and found(index, say("Mary Jane", "nine", "Peter")) == []
    assert found(index, say("Anna", "three", "Anna")) == [(0, True)]
    assert found(index, "さて学校の庭に三本の木があります何本ですか。") == [(1, True)]


def test_windows_that_recur_in_an_item():
    listed = lambda numbers: "what comes next in the list " + " ".join(map(str, numbers))
    index = index_of(listed(range(100, 140)), "word " * 30)
    assert found(index, listed(range(500, 540))) == [(0, False)]
    assert found(index, "so. " + listed(range(100, 140))) == [(0, True)]
    assert found(index, "start " + "word " * 30) == [(1, True)]
    assert found(index, listed([5] * 6)) == [] and found(index, "word " * 4) == []


def test_item_beside_other_instances_of_its_template():
    say = "tom has {} apples and buys {} pears at the old market today. ".format
    index = index_of(say(3, 3))
    assert found(index, say(4, 5)) == []
    assert found(index, say(4, 5) + say(3, 3)) == [(0, True)] == found(index, say(3, 3) + say(4, 5))
    assert found(index, "".join(say(k, k + 1) for k in range(10, 40)) + say(7, 7)) == [(0, False)]
    assert found(index, say(7, 7) + say(3, 3)) == [(0, True)]
    assert found(index, "".join(say(k, k + 1) for k in range(10, 40))) == []


def brute_coverage(item, text):
    """Share of the item's windows of five plain tokens that the text has."""
    words = lambda t: re.findall(r"\d+(?:[.,]\d+)*|[^\W\d]+", (t or "").lower())
    a, b = words(item), words(text)
    windows = [tuple(a[i:i + 5]) for i in range(len(a) - 4)]
    have = {tuple(b[i:i + 5]) for i in range(len(b) - 4)}
    return sum(w in have for w in windows) / len(windows) if windows else 0.0


def test_decontamination_finds_what_brute_force_finds(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if brute_coverage(b.text, d.text) >= 0.8}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).select("row.doc_id", "item_id").collect()}
    assert want <= got and len(got - want) <= 1 and want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_decontamination_in_blocks_and_cases(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ROWS[0][1]), (2, None), (3, ""), (4, "x")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 4)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(documents(spark), bench).select("row.doc_id", "item_id").collect())
    assert got == [(1, 1), (2, 1), (3, 1), (7, 4), (7, 4)]
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(documents(spark), bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(documents(spark), bench).count() == len(ROWS) - 5


def water(sizes):
    """Targets of named sizes by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        out = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mixing(spark):
    rows = mixing.mixed(documents(spark)).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in ROWS)
    sizes = collections.defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want, taken = water(sizes), collections.defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert taken["b"] == round(want["b"]) or abs(taken["b"] - want["b"]) < max(r.size for r in rows if r.source == "b")
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(documents(spark)).collect()))
    assert mixing.mixed(empty(spark)).count() == 0


def test_mixing_of_many(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5))).alias("source"))
    per = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.max("source_size").alias("z")).collect()
    assert all(abs(r.k - r.t) <= 1 for r in per)
    assert abs(sum(r.t for r in per) - sum(r.z for r in per)) < 1e-6


@pytest.mark.parametrize("low, high", [(20, 1500), (30_000, 110_000), (1, 30)])
def test_budgets_are_met_or_nearest(low, high):
    rng = np.random.default_rng(low)
    for _ in range(300):
        lengths, counts = rng.choice(np.arange(low, high), 6, replace=False), rng.integers(1, 4, 6)
        sums = {0}
        for x, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + x * k for s in sums for k in range(n + 1)}
        budget = int(rng.choice(list(sums))) if rng.random() < 0.5 else int(rng.integers(0, max(sums) + 1))
        got = mixing.choose(lengths, counts, budget)
        assert (got >= 0).all() and (got <= counts).all()
        assert abs(int((lengths * got).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_budgets_of_many_lengths():
    rng = np.random.default_rng(3)
    for m, low, high, most in ((20_000, 1, 20_001, 1000), (500, 30_000, 110_000, 100_000)):
        lengths, counts = rng.choice(np.arange(low, high), m, replace=False), rng.integers(1, most + 1, m)
        budget = int((lengths * counts).sum()) // 3 + 7
        assert int((lengths * mixing.choose(lengths, counts, budget)).sum()) == budget
    lengths = np.append(np.arange(100, 1_000_000, 100), 51)  # only the one of 51 words changes the last digits
    counts = np.append(np.full(len(lengths) - 1, 5), 1)
    budget = int((lengths * counts).sum()) // 200 * 100 + 33
    assert abs(int((lengths * mixing.choose(lengths, counts, budget)).sum()) - budget) == 18
    assert mixing.choose(np.array([0, 0]), np.array([3, 1]), 5).tolist() == [0, 0] and not len(mixing.choose(np.array([]), np.array([]), 0))


def test_mixing_of_null_ids(spark):
    docs = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "repeat('w ', 3) AS text", "IF(id < 1000, 'a', NULL) AS source")
    rows = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.source: r.n for r in rows} == {"a": 1000, None: 2000} and all(abs(r.k - r.t) <= 2 for r in rows)


@pytest.fixture(scope="module")
def model():
    names, prior = lattice.vocabulary()
    return lattice.Lattice(names, prior), names, prior


def brute_word(names, p, word):
    """Log of the sum over all segmentations, by plain recursion."""
    of, w, total = dict(zip(names, p)), b" " + word, [1.0]
    for j in range(1, len(w) + 1):
        total.append(sum(total[i] * of[w[i:j]] for i in range(j) if w[i:j] in of))
    return math.log(total[-1])


def test_lattice_sums_all_segmentations(model, monkeypatch):
    lat, names, prior = model
    words = [b"hello", b"the", b"x" * 30, "é".encode(), b"\xff\xfe", b"tionerthe" * 8]
    want = [brute_word(names, prior, w) for w in words]
    assert np.allclose(lat.log_probabilities(words), want)
    lengths = np.array([len(n) for n in names])
    pair = [b"hello", b"y" * 60], np.array([2.0, 1.0])
    counts = lat.expected_counts(*pair)
    assert abs((counts * lengths).sum() - (2 * 6 + 61)) < 1e-6  # every byte is in one piece of each segmentation
    monkeypatch.setattr(lattice, "LONG_WORD", 3)  # all words the way of long ones, in stretches
    monkeypatch.setattr(lattice, "STRETCH", 7)
    assert np.allclose(lat.log_probabilities(words), want) and np.allclose(lat.expected_counts(*pair), counts)


def test_expected_counts_against_segmentations():
    names, p = [b" ", b"a", b"b", b" a", b"ab", b"aba"], np.array([0.3, 0.2, 0.1, 0.2, 0.1, 0.1])
    word, want, total = b" abab", collections.Counter(), 0.0
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(x in names for x in parts):
            chance = math.prod(p[names.index(x)] for x in parts)
            total += chance
            for x in parts:
                want[x] += chance
    lat = lattice.Lattice(names, p)
    assert np.allclose(lat.expected_counts([word[1:]], np.ones(1)), [want[x] / total for x in names])
    assert abs(lat.log_probabilities([word[1:]])[0] - math.log(total)) < 1e-9


def test_long_text_without_white_space(spark):
    docs = spark.createDataFrame([(1, "abcdefg" * 150_000), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lattice.score(docs, F.lit(False)).collect()}
    assert rows[1].n_tokens == 2 and math.isfinite(rows[1].score) and rows[2].n_tokens == 1


@pytest.mark.parametrize("top", [200_000, 2])
def test_lm_scoring(spark, top):
    docs = documents(spark)
    rows = lattice.score(docs, remainder_of_crc(F.col("doc_id"), 7) == 2, top_words=top).collect()
    words = [((r[1] or "").encode().lower().split(), held(r[0], 7, 2)) for r in ROWS]
    counts = collections.Counter(w for ws, h in words if not h for w in ws)
    docs_in = sum(not h for _, h in words)
    n, v = sum(counts.values()) + docs_in, len(counts) + 1
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    want = collections.Counter((r[0], h, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, round(sum(log(counts[w]) for w in ws) + log(docs_in), 5)) for r, (ws, h) in zip(ROWS, words))
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert lattice.score(empty(spark), F.lit(False)).count() == 0
    # The score against paths summed one by one, with the pieces' weights of the fit.
    names, prior = lattice.vocabulary()
    table = spark.createDataFrame([(bytearray(w), 1, c) for w, c in counts.items()], "word binary, n long, n_train long")
    p = lattice.fit(table, names, prior)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    d = lattice.discount(once, twice)
    chance = {w: (max(0, counts[w] - d) + d * v * math.exp(brute_word(names, p, w))) / n for ws, _ in words for w in ws}
    score = collections.Counter((r[0], round(sum(math.log10(chance[w]) for w in ws) + math.log10((docs_in - d) / n), 4)) for r, (ws, _) in zip(ROWS, words))
    assert collections.Counter((r.doc_id, round(r.score, 4)) for r in rows) == score


def test_fit_raises_the_likelihood_of_new_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = lattice.word_table(docs.select((remainder_of_crc(F.col("doc_id"), 7) == 2).alias("held_out"), "text")).cache()
    new = [bytes(r.word) for r in table.where("n_train = 0").collect()]
    names, prior = lattice.vocabulary()
    mean = [float(lattice.Lattice(names, lattice.fit(table, names, prior, lattice.ROUNDS[:k])).log_probabilities(new).mean()) for k in range(len(lattice.ROUNDS) + 1)]
    assert all(a < b for a, b in zip(mean, mean[1:])), mean


def test_documents_that_occur_twice_score_higher(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:30])), "doc_id long, text string")
    score = {r.doc_id: r.score for r in lattice.score(docs, F.lit(False)).collect()}
    assert min(score[k] for k in range(30)) > max(score[k] for k in range(30, 60)) and all(score[k] == score[60 + k] for k in range(30))


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(3, "u", "aa"), (1, "u2", "aa"), (2, None, None), (5, "x", ""), (None, "y", "aa"), (9, "z\r\n", "é\r\n\r\nWARC/1.1\r\n" * 3), (9, "q", "é\r\n\r\nWARC/1.1\r\n" * 3)], "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    back = warc.round_trip(pages, str(tmp_path / "a"))
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in back.collect())
    d = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    z = ("é\r\n\r\nWARC/1.1\r\n" * 3).encode()
    assert got == collections.Counter([(1, "response", None, 2, d(b"aa"), b"aa"), (3, "revisit", 1, 2, d(b"aa"), None), (None, "revisit", 1, 2, d(b"aa"), None), (2, "response", None, 0, d(b""), b""), (5, "revisit", 2, 0, d(b""), None)] + [(9, "response", None, len(z), d(z), z)] * 2)
    assert back.where("record_type = 'response' AND page_id = 1").count() == 1
    assert "Filter isnotnull" in back.where("record_type = 'response'")._jdf.queryExecution().executedPlan().toString()
    assert spark.read.format("warc").option("payload", "false").load(str(tmp_path / "a")).where("payload IS NOT NULL").count() == 0
    none = warc.round_trip(pages.limit(0), str(tmp_path / "b"))
    assert none.count() == 0
    least = warc.with_revisits(pages, 3)
    assert least.where("record_type = 'revisit'").count() == 0


def record(k, payload, kind="response"):
    return warc.record_bytes(k, f"http://h/{k}", kind, f"r{k}", None, "X", len(payload), payload)


@pytest.mark.parametrize("pack, name", [(lambda b: b, "f.warc"), (warc.member, "f.warc.gz"), (gzip.compress, "g.warc.gz")])
def test_warc_reads_files(tmp_path, pack, name):
    (tmp_path / name).write_bytes(b"".join(pack(record(k, bytes([k]) * 3000)) for k in range(5)))
    for payload in (True, False):
        with (tmp_path / name).open("rb") as f:
            got = list(warc.records(f, name.endswith(".gz"), lambda r: r["page_id"] in (1, 4), payload))
        assert [(r["page_id"], r["payload_bytes"], r["payload"]) for r in got] == [(k, 3000, bytes([k]) * 3000 if payload else None) for k in (1, 4)]
    if name.endswith(".gz"):
        assert len(gzip.decompress((tmp_path / name).read_bytes())) == sum(len(record(k, bytes(3000))) for k in range(5))
        (tmp_path / name).write_bytes(gzip.compress(b"".join(record(k, bytes([k]) * 3000) for k in range(5))))  # all records in one member
        with (tmp_path / name).open("rb") as f:
            assert [r["page_id"] for r in warc.records(f, True, lambda r: r["page_id"] != 2)] == [0, 1, 3, 4]


def test_warc_inflates_wanted_payloads_only(tmp_path):
    rng = np.random.default_rng(1)
    path = tmp_path / "f.warc.gz"
    path.write_bytes(b"".join(warc.member(record(k, rng.integers(0, 256, 200_000).astype(np.uint8).tobytes(), "revisit" if k % 2 else "response")) for k in range(20)))
    whole, some, none = {}, {}, {}
    for tally, wanted, payload in ((whole, lambda r: True, True), (some, lambda r: r["page_id"] == 8, True), (none, lambda r: True, False)):
        with path.open("rb") as f:
            list(warc.records(f, True, wanted, payload, tally))
    assert whole["inflated"] > 10 * 200_000 and some["inflated"] < 200_000 + 20 * 5000 and none["inflated"] < 20 * 5000


@pytest.mark.parametrize("groups", [200_000, 0])
def test_warc_record_ids(spark, tmp_path, monkeypatch, groups):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)
    pages = spark.createDataFrame([(9, "a", "x"), (9, "b", "x"), (9, "c", "y"), (10, "d", "x"), (None, "e", "x"), (None, "f", "z"), (None, "g", "z")], "page_id long, url string, html string")
    rows = warc.round_trip(pages, str(tmp_path / "a")).collect()
    ids = [r.record_id for r in rows]
    assert len(rows) == 7 and len(set(ids)) == 7
    assert collections.Counter((r.page_id, r.record_type, r.refers_to) for r in rows) == collections.Counter([(9, "response", None)] * 3 + [(10, "revisit", 9), (None, "revisit", 9)] + [(None, "response", None)] * 2)
    assert all(warc.record_name(r.refers_to, r.payload_digest) in ids for r in rows if r.record_type == "revisit")


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    assert 0 < docs.count() < before
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == docs.count() and out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
