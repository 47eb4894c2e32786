"""SimHash near-dedup with vantage-point trees.

Fingerprints: bits set in more than half of the XXH64 hashes of the 3-word
shingles.  Distinct fingerprints are dealt to shards by a vantage-point tree
built from a bounded sample: a node sends fingerprints within its radius left
and the others right, and a fingerprint closer to the boundary than the link
distance goes to the other side too, as a guest, so that no pair is lost
(triangle bound).  Inside a shard the same splitting goes on, in memory, down to
leaves in which all pairs are compared.  A shard returns one link per
fingerprint to its local group, never the pairs, and the links' connected
components give the groups.

Only the sample (``SAMPLE`` fingerprints) reaches the driver; the tree has at
most ``MAX_SHARDS`` leaves, so what is broadcast is bounded.

Defined cases: a null or empty text has no words, and fingerprint zero, which
is linked like any other; fewer words than a shingle: one shingle of all words;
rows with equal texts share a fingerprint; a null id is returned with its
group, and never is a group's id unless the whole group has none; an empty table
gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import released, written
from palimpsest.llm.components import components
from palimpsest.llm.shingles import BANDS, Words, min_keys, shingle_set, similar_links

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: What near copies are where rows are dropped: words of a shingle, and Jaccard similarity of the shingle sets.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints sampled for the shard tree, and the most shards it may have.
SAMPLE = 65536
MAX_SHARDS = 4096
#: Fingerprints a shard is meant to hold, and a leaf in which all pairs are compared.
SHARD_ROWS = 20_000
LEAF = 512


def fingerprint_of(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> int:
    """Of the words of one text."""
    n = len(words)
    if not n:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n < size:
        return h(joined, seed)
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1:].tolist())), dtype=np.uint64, count=n - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded for very long texts
        ones += np.unpackbits(hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) per row."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint_of(t.lower().split()) if t else 0 for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    from pyspark.sql import types as T

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())]))


def _distance(fps: np.ndarray, one) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(one)).astype(np.int64)


def _vantage(fps: np.ndarray, r: int, rng, tries: int = 6):
    """The vantage point and radius, of a few tried, with the fewest rows near the boundary for an even split."""
    best = None
    for one in rng.choice(fps, size=min(tries, len(fps)), replace=False):
        d = _distance(fps[:4096], one)
        for cut in np.unique(np.percentile(d, (35, 50, 65)).astype(np.int64)):
            left, near = np.mean(d <= cut), np.mean((d > cut - r) & (d <= cut))
            score = max(left, 1 - left) + near  # rows of the larger side, guests counted
            if 0 < left < 1 and (best is None or score < best[0]):
                best = (score, one, int(cut))
    return best


def build_tree(sample: np.ndarray, shards: int, r: int = DISTANCE) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, left, right); a leaf has radius -1 and its shard's number in left."""
    rng, nodes, count = np.random.default_rng(7), [], [0]
    target = max(8, len(sample) // max(1, shards))

    def grow(fps, room):
        at = len(nodes)
        nodes.append(None)
        best = _vantage(fps, r, rng) if len(fps) > target and room > 1 else None
        if best is None or best[0] > 0.97:
            nodes[at] = (0, -1, count[0], 0)
            count[0] += 1
            return at
        _, one, cut = best
        inside = _distance(fps, one) <= cut
        left = grow(fps[inside], room // 2)
        right = grow(fps[~inside], room - room // 2)
        nodes[at] = (int(one), cut, left, right)
        return at

    grow(sample, shards)
    return nodes


def route(nodes, fps: np.ndarray, r: int = DISTANCE):
    """Arrays (index, shard, guest): each fingerprint's own shard, and those it visits as a guest."""
    found, todo = [], [(0, np.arange(len(fps)), np.zeros(len(fps), dtype=bool))]
    while todo:
        at, rows, guest = todo.pop()
        if not len(rows):
            continue
        one, cut, left, right = nodes[at]
        if cut < 0:
            found.append((rows, np.full(len(rows), left), guest))
            continue
        d = _distance(fps[rows], one)
        go_left = (d <= cut) | (guest & (d - r <= cut))
        go_right = d > cut - r
        todo.append((left, rows[go_left], guest[go_left]))
        todo.append((right, rows[go_right], (guest | (d <= cut))[go_right]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2 + (np.empty(0, bool),)


def _find(parent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    while True:
        up = parent[rows]
        if np.array_equal(up, rows):
            return rows
        rows = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[k] and b[k], for all k at once."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        open_ = a != b
        a, b = a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)


def local_groups(members: np.ndarray, guests: np.ndarray, r: int = DISTANCE, leaf: int = LEAF) -> np.ndarray:
    """For members, then guests: the row of its group's head, by pairs of a member with a member or guest within r."""
    fps = np.concatenate((members, guests))
    parent, rng = np.arange(len(fps)), np.random.default_rng(11)
    own = np.arange(len(members))
    todo = [(own, np.arange(len(members), len(fps)))]
    while todo:
        mine, theirs = todo.pop()
        if not len(mine):
            continue
        best = _vantage(fps[mine], r, rng) if len(mine) > leaf else None
        if best is not None and best[0] < 0.97:
            _, one, cut = best
            d, g = _distance(fps[mine], one), _distance(fps[theirs], one)
            inside, near = d <= cut, (d <= cut) & (d > cut - r)
            todo.append((mine[inside], theirs[g - r <= cut]))
            todo.append((mine[~inside], np.concatenate((theirs[g + r > cut], mine[near]))))
            continue
        against = np.concatenate((mine, theirs))
        for k in range(0, len(mine), 256):  # bounded blocks; links, not pairs, are kept
            rows = mine[k:k + 256]
            for j in range(0, len(against), 8192):
                x, y = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[against[j:j + 8192]][None, :]) <= r)
                a, b = rows[x], against[j:j + 8192][y]
                fresh = parent[a] != parent[b]
                _unite(parent, a[fresh], b[fresh])
    return _find(parent, np.arange(len(fps)))


def links(distinct: DataFrame, r: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span each group within r."""
    spark = distinct.sparkSession
    n = distinct.count()
    # No more rows a shard than SHARD_ROWS, and work for all tasks where there are rows enough; MAX_SHARDS bounds the tree.
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(MAX_SHARDS, max(1, -(-n // SHARD_ROWS), min(n // 2000, tasks)))
    share = min(1.0, SAMPLE / max(1, n))
    kept = distinct.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = np.array([x.fp for x in kept.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    nodes = build_tree(sample, shards, r)

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows, shard, guest = route(nodes, fps, r)
            for k in range(0, len(rows), 1 << 20):
                cut = slice(k, k + (1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(guest[cut]), pa.array(fps[rows[cut]].view(np.int64))], names=["shard", "guest", "fp"])

    def group(table: pa.Table) -> pa.Table:
        fps, guest = table.column("fp").to_numpy().view(np.uint64), table.column("guest").to_numpy(zero_copy_only=False)
        order = np.concatenate((fps[~guest], fps[guest]))
        head = local_groups(fps[~guest], fps[guest], r)
        linked = head != np.arange(len(order))
        return pa.table({"a": order[linked].view(np.int64), "b": order[head[linked]].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, guest boolean, fp long")
    return dealt.groupBy("shard").applyInArrow(group, "a long, b long")


def near_groups(fps: DataFrame, r: int = DISTANCE) -> DataFrame:
    """``fps`` (doc_id, fp) with component_id: the smallest doc_id among all fingerprints reachable."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(links(distinct, r))
    groups = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = groups.where("root IS NOT NULL").join(named, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = written(fingerprints(docs), "doc-fingerprints")
    return near_groups(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY, r: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that head their group: one row of each group stays, that with the smallest id.

    Texts are linked if the sets of their shingles of ``shingle`` words have at
    least the Jaccard similarity ``similarity``; every link is checked on whole
    texts.  Candidates are the groups of the trees' links (fingerprints of such
    shingles within ``r`` bits) and, as texts of that similarity differ in about
    10 bits, where triangle bounds prune nothing, texts that share one of their
    keys of least shingle hashes (a pair of similarity 0.8 shares none with
    probability 3e-6, and is left out by its signatures with one in a million).

    A null or empty text has one shingle, the empty one.  Of rows that share the
    group's smallest id one stays; a null id comes last.  Columns are carried,
    whatever their names.
    """
    rows = written(docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")), "near-input")
    the_id, texts = F.col("row").getField(id_col), rows.select("at", F.col("row").getField(text_col).alias("text"))

    def run(batches):
        cache = Words()
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            sets = [shingle_set(t, shingle, cache) for t in raw]
            fps = np.fromiter((fingerprint_of(t.lower().split(), shingle) if t else 0 for t in raw), dtype=np.uint64, count=len(raw))
            least = [min_keys(s) for s in sets]
            keys = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([k for k, _ in least]) if sets else np.empty(0, np.int64)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps.view(np.int64)), keys, pa.array([g for _, g in least], pa.binary())], names=["at", "n", "fp", "keys", "sig"])

    sketch = written(texts.mapInArrow(released(run), "at long, n long, fp long, keys array<long>, sig binary"), "sketches")
    distinct = sketch.select("fp").distinct()
    near = components(links(written(distinct, "fingerprints"), r))
    by_tree = sketch.join(near, F.col("fp") == F.col("node"), "left").select(F.xxhash64(F.lit("tree"), F.coalesce("root", "fp")).alias("key"), "at")
    keyed = by_tree.union(sketch.select(F.explode("keys").alias("key"), "at"))
    roots = written(similar_links(texts, sketch.select("at", "n", "sig"), keyed, shingle, similarity), "near-groups")
    ids = rows.select("at", F.struct(the_id.isNull().alias("none"), the_id.alias("id"), "at").alias("order"))
    member = roots.withColumnsRenamed({"node": "at"}).union(roots.select(F.col("root").alias("at"), "root").distinct()).join(ids, "at")
    first = member.groupBy("root").agg(F.min("order").alias("first"))
    gone = written(member.join(first, "root").where("order != first").select("at"), "near-copies")
    return rows.join(gone, "at", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
