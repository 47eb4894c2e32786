"""Suffix, exact and near dedup against brute force."""

import collections
import hashlib
import pathlib
import re
import tempfile

import numpy as np
import pytest
import xxhash
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import exact_dedup, shingles, simhash, suffix_dedup, suffix_sort
from palimpsest.llm.common import few_files
from palimpsest.llm.components import components
from palimpsest.llm.suffix_sort import SuffixSorter
from tests.llm.data import ROWS, documents, empty


def brute_shared(segments, depth):
    seen = collections.Counter(s[i:i + depth] for s in segments for i in range(len(s) - depth + 1))
    return np.array([f for s in segments for f in [i + depth <= len(s) and seen[s[i:i + depth]] > 1 for i in range(len(s))] + [False]])


@pytest.mark.parametrize("memory, chunk", [(100, 1 << 16), (100, 16), (3000, 64), (1 << 20, 1 << 16)])
def test_suffix_sorter(monkeypatch, memory, chunk):
    monkeypatch.setattr(suffix_sort, "CHUNK", chunk)
    rng = np.random.default_rng(memory)
    for _ in range(60):
        depth, letters = int(rng.choice([1, 3, 8, 9, 17, 20])), int(rng.choice([1, 2, 3, 26]))
        base = [bytes(rng.integers(97, 97 + letters, rng.integers(1, 60)).astype(np.uint8)) for _ in range(5)]
        segments = [base[rng.integers(5)] + base[rng.integers(5)] for _ in range(rng.integers(1, 10))]
        text = np.concatenate([np.concatenate((254 - np.frombuffer(s, np.uint8), [0])) for s in segments]).astype(np.uint8)
        with tempfile.TemporaryDirectory() as scratch:
            assert np.array_equal(SuffixSorter(text, scratch, depth, memory).run(), brute_shared(segments, depth))


def test_suffix_sorter_beyond_its_memory(tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(97, 123, 120_000).astype(np.uint8).tobytes()
    segments = [base[k:k + int(rng.integers(200, 400))] for k in rng.integers(0, len(base) - 400, 1200)]
    text = np.concatenate([np.concatenate((254 - np.frombuffer(s, np.uint8), [0])) for s in segments]).astype(np.uint8)
    sorter = SuffixSorter(text, str(tmp_path), 200, 5 * len(text) // 20)  # a twentieth of the tuples
    assert np.array_equal(sorter.run(), brute_shared(segments, 200)) and sorter.spills > 5 and not list(tmp_path.iterdir())


def brute_removed(texts, n=200):
    seen = collections.Counter(b[i:i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed(df):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())


def test_suffix_dedup(spark):
    assert removed(documents(spark)) == collections.Counter((r[0], *w) for r, w in zip(ROWS, brute_removed([(r[1] or "").encode() for r in ROWS])))
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_writes_few_files(spark, monkeypatch):
    """Many small partitions do not make as many files, and so processes that set their rights."""
    counts, parquet = {}, DataFrameWriter.parquet

    def counted(self, path, *args, **more):
        parquet(self, path, *args, **more)
        counts[path.rsplit("/", 1)[1].rsplit("-", 1)[0]] = len(list(pathlib.Path(path.removeprefix("file:")).glob("part-*")))

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    texts = spark.range(0, 400, 1, 100).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.md5((F.col("id") % 200).cast("string")), F.lit(" ")), 12).alias("text"))
    want = collections.Counter((k, *w) for k, w in enumerate(brute_removed([r.text.encode() for r in texts.orderBy("doc_id").collect()])))
    assert removed(texts) == want
    assert {"anchors", "segments", "groups", "marks"} <= set(counts) and max(counts.values()) <= few_files(spark) < 100


def test_suffix_dedup_of_a_hot_anchor(spark, monkeypatch):
    """A phrase in many contexts, some of them shared; and long texts, looked at in stretches."""
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 12)
    monkeypatch.setattr(suffix_dedup, "BUFFER_BYTES", 300)
    rng = np.random.default_rng(6)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    phrase, sides = noise(150), [noise(120) for _ in range(4)]
    texts = [noise(100) + sides[k % 4] * (k % 3 == 0) + phrase + sides[k % 5 % 4] * (k % 2) + noise(100) for k in range(60)]
    got = removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == collections.Counter((k, *w) for k, w in enumerate(brute_removed([t.encode() for t in texts])))


def test_segments_do_not_depend_on_stretches(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in (0, 150, 5000, 3, 900, 200, 2000)]
    whole = suffix_dedup.segments_of(texts, suffix_dedup.Rolling())
    for stretch in (1, 37, 500):
        monkeypatch.setattr(suffix_dedup, "BUFFER_BYTES", stretch)
        assert all(np.array_equal(a, b) for a, b in zip(whole, suffix_dedup.segments_of(texts, suffix_dedup.Rolling())))
    assert whole[2].sum() == sum(max(0, len(t) - 199) for t in texts)


def test_suffix_dedup_of_spooled_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 200)
    assert removed(documents(spark)) == collections.Counter((r[0], *w) for r, w in zip(ROWS, brute_removed([(r[1] or "").encode() for r in ROWS])))


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("parts", [1000, 2])
def test_exact_dedup(spark, monkeypatch, parts):
    monkeypatch.setattr(exact_dedup, "HOT_PARTS", parts)
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[norm(r[1])].append(r[0])
    want = collections.Counter()
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            want[i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    rows = exact_dedup.mark_duplicates(documents(spark)).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want
    kept = exact_dedup.drop_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() == len(groups)
    assert exact_dedup.mark_duplicates(empty(spark)).count() == 0


def test_exact_dedup_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = exact_dedup.mark_duplicates(docs).where("group_size > 1")
    assert rows.count() == 1000 and rows.select("keep_id").distinct().collect()[0][0] == 0 and rows.where("kept").count() == 1


def fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    docs = documents(spark)
    fps = simhash.fingerprints(docs)
    assert collections.Counter((r.doc_id, r.fp & (2**64 - 1)) for r in fps.collect()) == collections.Counter((r[0], fingerprint(r[1])) for r in ROWS)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(fps).collect()}
    ids = {r[0]: fingerprint(r[1]) for r in ROWS}
    for a in ids:
        for b in ids:
            if (ids[a] ^ ids[b]).bit_count() <= 2:
                assert got[a] == got[b]
    assert got[2] == 1 and got[5] == 4 and got[6] == 4 and got[None] is None
    assert simhash.near_groups(simhash.fingerprints(empty(spark))).count() == 0


def test_simhash_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 300)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 2500).astype(np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    fps = np.concatenate((base, flip(base[:700]), flip(flip(base[:400]))))
    head = brute_groups(fps, 2)
    rows = spark.createDataFrame([(k, int(f)) for k, f in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    assert {r.doc_id: r.component_id for r in simhash.near_groups(rows).collect()} == dict(enumerate(head.tolist()))


def brute_groups(fps, r):
    parent = np.arange(len(fps))
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= r)
    simhash._unite(parent, x, y)
    return simhash._find(parent, np.arange(len(fps)))


def test_vantage_point_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    fps = np.unique(np.concatenate((base, flip(base[:900]), flip(flip(np.repeat(base[:1], 800))))))
    whole = brute_groups(fps, 2)
    assert np.array_equal(simhash.local_groups(fps, np.empty(0, np.uint64), leaf=64), whole)
    nodes = simhash.build_tree(rng.choice(fps, 2000, replace=False), 16)
    rows, shard, guest = simhash.route(nodes, fps)
    assert len(np.unique(shard)) > 4 and sorted(rows[~guest]) == list(range(len(fps)))
    parent = np.arange(len(fps))
    for k in np.unique(shard):
        m, g = rows[(shard == k) & ~guest], rows[(shard == k) & guest]
        both = np.concatenate((m, g))
        simhash._unite(parent, both, both[simhash.local_groups(fps[m], fps[g], leaf=64)])
    assert np.array_equal(simhash._find(parent, np.arange(len(fps))), whole)


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(2, 41)) and all(got[k] == 100 for k in range(101, 160))


def word_sets(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_heads(rows):
    sets, head = [word_sets(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and head[i] != head[j]:
                a, b = sorted((head[i], head[j]))
                head = [a if h == b else h for h in head]
    return {rows[h][0] for h in head}


def test_pipeline_drops_near_copies_of_five_word_similarity(spark):
    rng, rows = np.random.default_rng(8), []
    for k in range(12):
        words = [f"w{n}" for n in rng.integers(0, 5000, 120)]
        rows.append((100 * k, " ".join(words)))
        for j in range(1, 8):
            words = list(words)
            words[int(rng.integers(5, 110))] = f"new{j}"
            if j > 4:
                words[int(rng.integers(5, 110))] = f"other{j}"
            rows.append((100 * k + j, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_heads(rows)
    assert 12 <= len(want) < 40
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, None).collect()) == sorted(want)
    kept = stage(spark, documents(spark), None)
    assert kept.columns == documents(spark).columns
    assert kept.count() == len(brute_heads([(k, r[1]) for k, r in enumerate(ROWS)])) and stage(spark, empty(spark), None).count() == 0


def test_near_copies_of_a_hot_key(spark, monkeypatch):
    """Texts of several groups that share keys: heads of rounds find what all pairs find."""
    monkeypatch.setattr(shingles, "HEADS", 8)
    rng, rows = np.random.default_rng(9), []
    base = [f"w{n}" for n in range(60)]
    for k in range(36):
        words = list(base)
        for at in rng.choice(np.arange(4, 56, 5), int(rng.integers(0, 4)), replace=False):
            words[at] = f"x{rng.integers(3)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == sorted(brute_heads(rows))


def changed_copies(rng, count, words=100, changes=8):
    """Copies of one text, each with so many changed, lost or doubled words that most are alike to few others."""
    base, rows = [f"w{n}" for n in range(words)], []
    for k in range(count):
        copy = list(base)
        for at in rng.choice(words, int(rng.integers(0, changes)), replace=False):
            copy[at] = ["", f"w{at} w{at}", f"x{rng.integers(4)}", f"new{k}", f"new{k}"][int(rng.integers(5))]
        rows.append((k, " ".join(copy)))
    return rows


def test_near_copies_of_a_hot_key_cost_few_comparisons(spark, monkeypatch):
    """Pairs compared grow with the texts of a key, not with their square."""
    compared, alike = [], shingles.alike

    def counted(texts, pairs, *more):
        compared.append(pairs.count())
        return alike(texts, pairs, *more)

    monkeypatch.setattr(shingles, "alike", counted)
    rows = changed_copies(np.random.default_rng(10), 500, changes=10)
    want = brute_heads(rows)
    assert 100 < len(want) < 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == sorted(want)
    assert sum(compared) < 12 * len(rows)  # of 124,750 pairs


@pytest.mark.parametrize("small, deals", [(2, 1), (3, 3), (12, 2)])
def test_finer_keys_lose_no_alike_pair(spark, monkeypatch, small, deals):
    """Every pair of 0.8 is met, in one group, or in a key together; texts of several kinds share one key."""
    monkeypatch.setattr(shingles, "SMALL", small)
    monkeypatch.setattr(shingles, "DEALS", deals)
    rng = np.random.default_rng(11 + small)
    rows = changed_copies(rng, 60, 60, 6) + [(100 + k, t + " tail of other words " * 3) for k, t in changed_copies(rng, 40, 45, 6)]
    rows += [(200 + k, " ".join(f"w{n}" for n in range(60) if not k % 7 <= n - 3 * k % 40 <= 9)) for k in range(40)] + [(300, ""), (301, None), (302, "w1 w2")]
    texts = spark.createDataFrame(rows, "at long, text string")
    keyed = texts.selectExpr("1L AS key", "at").union(texts.where("at < 150").selectExpr("at % 3 + 2 AS key", "at"))
    finer, found, roots = shingles.finer_keys(texts, keyed, 5, 0.8)
    assert found is not None
    root, keys = {r.node: r.root for r in roots.collect()}, collections.defaultdict(set)
    for r in finer.collect():
        keys[r.at].add(r.key)
        assert r.root == root.get(r.at, r.at)
    sets = {k: word_sets(t) for k, t in rows}
    like = lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    assert all(like(r.a, r.b) for r in found.collect())
    pairs = [(i, j) for i in sets for j in sets if i < j and like(i, j)]
    assert len(pairs) > 100 and all(root.get(i, i) == root.get(j, j) or keys[i] & keys[j] for i, j in pairs)


def test_pipeline_against_brute_force(spark, sf_dir):
    """The rows of run(): toxic documents by the operator's scores, everything after by plain code."""
    from palimpsest.llm import decontaminate, toxicity
    from tests.llm.test_text import brute_coverage, water

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = {r.row.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0").collect()}
    text = {r.doc_id: r for r in docs.select("doc_id", "text", "source").collect() if r.doc_id in clean}
    first = {}
    for i in sorted(text):
        first.setdefault(norm(text[i].text), i)
    near = brute_heads([(i, text[i].text) for i in sorted(first.values())])
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    index = decontaminate.Index([(b.item_id, b.text) for b in bench])
    held = {i for i in near if index.matches(text[i].text, decontaminate.Tokens())}
    assert {i for i in near if any(brute_coverage(b.text, text[i].text) >= 0.8 for b in bench)} <= held
    left = near - held
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(left)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i].text or "")) for i in left}
    sources, taken = collections.Counter(), collections.Counter()
    for i in left:
        sources[text[i].source] += size[i]
    want = water(dict(sources))
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == sources[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in want:  # the nearest sum that a choice of documents has
        epochs = int(want[s] // sources[s]) if sources[s] else 0
        budget, sums = round(want[s] - epochs * sources[s]), {0}
        for i in left:
            if text[i].source == s:
                sums |= {x + size[i] for x in sums}
        assert epochs >= 3 or abs(taken[s] - epochs * sources[s] - budget) == min(abs(x - budget) for x in sums)
