"""Word shingles of whole texts, keys that bring similar texts together, and the exact check of pairs.

Part of the near-dedup operator (``simhash``).  Texts that share a key are
candidates.  A key of more than ``SMALL`` texts is first dealt into finer keys
(``finer_keys``).  Its texts are compared with one of them, its pivot, and what a
text has that the pivot has not becomes its new keys, rarest first and only as
many as a pair needs to meet: of sets A and B with rA and rB hashes of the pivot
missing, aA and aB added and o of those in both, at least
|rA - rB| + aA + aB - 2 o differ, and of an alike pair at most
q (|A| + |B|), q = (1 - similarity) / (1 + similarity).  So a text far from the
pivot meets those alone that share its changes; texts that may be alike without
a shared addition keep a key together.  No pair of the wanted similarity is lost.

Of each key then one text, its head, is compared with the others; texts
that are then in one group need nothing more.  Where a key still holds several
groups, further heads are drawn from all but its largest group and compared with
the texts of other groups, until every pair of a key has been compared or is in
one group.  A round draws about ``HEADS`` texts a key, or more while its pairs
are at most ``PAIRS`` times the rows of the table of keys.  Heads are picked and
compared by joins: no key's texts are gathered, and a key of near copies costs a comparison a
text, not all pairs.  A comparison begins with signatures, of which pairs of the
wanted similarity hold all but about one in a million; whole texts decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, released, written
from palimpsest.llm.components import components

BANDS, BAND_ROWS = 24, 4
HEADS, PAIRS = 64, 16
#: Texts of a key that is not dealt into finer ones, and how often keys are dealt at most; larger keys that remain take more rounds of heads.
SMALL, DEALS = 32, 4
#: Chance that a pair of just the wanted similarity fails by its signatures.
SIGNATURE_MISS = 1e-6
_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 2**63, BANDS * BAND_ROWS).astype(np.uint64)[:, None]
_ODD = (_RNG.integers(0, 2**63, BANDS * BAND_ROWS).astype(np.uint64) | np.uint64(1))[:, None]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


class Words(dict):
    """Word to its hash; bounded."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word, 21)
        return code


def shingle_set(text: bytes | None, size: int, cache: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text; fewer words than a shingle are one shingle."""
    words = text.lower().split() if text else []
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 22)], dtype=np.uint64)
    codes = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(codes) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += codes[j:j + n] * _MIX[j % len(_MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out * _MIX[0])


def min_keys(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key of each band of least values, and the signature: a byte of each.

    Two sets of similarity s share one band's key with probability s ** BAND_ROWS.
    """
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(hashes), 4096):  # bounded for very long texts
        least = np.minimum(least, ((hashes[None, k:k + 4096] ^ _XOR) * _ODD).min(1))
    out = np.arange(BANDS, dtype=np.uint64) * _MIX[4]
    for j in range(BAND_ROWS):
        out = (out ^ least[j::BAND_ROWS]) * _MIX[j]
        out ^= out >> np.uint64(31)
    return out.view(np.int64), ((least * _MIX[1]) >> np.uint64(56)).astype(np.uint8).tobytes()


def least_equal(similarity: float, miss: float = SIGNATURE_MISS) -> int:
    """Most bytes of a signature that all but ``miss`` of the pairs of this similarity have equal, by the binomial law."""
    n, total = BANDS * BAND_ROWS, 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if total > miss:
            return k
    return n


def _by_signature(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows (a, b, sig, h_sig) whose signatures agree enough."""
    enough, size = least_equal(similarity), BANDS * BAND_ROWS

    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, size) for k in (2, 3))
            yield batch.select([0, 1]).take(pa.array(np.flatnonzero((one == two).sum(1) >= enough)))

    return pairs.select("a", "b", "sig", "h_sig").mapInArrow(run, "a long, b long")


def alike(texts: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b) of rows ``at`` of ``texts`` (at, text), those whose shingle sets have this Jaccard similarity."""

    def run(batches):
        cache, head, mine = Words(), None, None
        for batch in batches:
            keep = []
            for k, (a, one, two) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                if a != head:  # rows come sorted by a
                    head, mine = a, shingle_set(one.as_py(), size, cache)
                theirs = shingle_set(two.as_py(), size, cache)
                shared = len(np.intersect1d(mine, theirs, assume_unique=True))
                if shared >= similarity * (len(mine) + len(theirs) - shared) - 1e-9:
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    text = F.col("text").cast("binary")
    second = pairs.join(texts.select(F.col("at").alias("b"), text.alias("text_b")), "b")
    both = second.join(texts.select(F.col("at").alias("a"), text.alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(released(run), "a long, b long")


def _against_pivots(texts: DataFrame, met: DataFrame, size: int, similarity: float) -> DataFrame:
    """For rows (h, at) of ``met``: hashes of text ``at`` that pivot ``h`` has not, how many of the pivot's are missing, both sizes, and whether the two are alike."""

    def table(keys, rows):
        lost, whole, like, added = zip(*rows)
        arrays = [pa.array(lost, pa.int64()), pa.array(whole, pa.int64()), pa.array(like, pa.bool_()), pa.array(added, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*keys.columns, *arrays], names=["h", "at", "lost", "whole", "like", "added"])

    def run(batches):
        cache, pivot, its = Words(), None, None
        for batch in batches:
            keys, rows, first, held = batch.select([0, 1]), [], 0, 0
            for k, (h, one, two) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                if h != pivot:  # rows come sorted by h
                    pivot, its = h, shingle_set(one.as_py(), size, cache)
                mine = shingle_set(two.as_py(), size, cache)
                added = np.setdiff1d(mine, its, assume_unique=True)
                shared = len(mine) - len(added)
                rows.append((len(its) - shared, len(its), shared >= similarity * (len(its) + len(added)) - 1e-9, added.view(np.int64)))
                held += len(added)
                if held > 1 << 20 or k == len(batch) - 1:  # bounded for very long texts
                    yield table(keys.slice(first, len(rows)), rows)
                    rows, first, held = [], k + 1, 0

    text = F.col("text").cast("binary")
    second = met.join(texts.select("at", text.alias("text_at")), "at")
    both = second.join(texts.select(F.col("at").alias("h"), text.alias("text_h")), "h")
    return both.select("h", "at", "text_h", "text_at").mapInArrow(released(run), "h long, at long, lost long, whole long, like boolean, added array<long>")


def _open_keys(keyed: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows (key, at, root) of the keys whose texts are in several groups, with the number of the key's rows."""
    if roots is None:
        rows = keyed.select("key", "at", F.col("at").alias("root"))
    else:
        rows = keyed.join(roots.withColumnsRenamed({"node": "at"}), "at", "left").select("key", "at", F.coalesce("root", "at").alias("root"))
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return rows.join(several.select("key", "rows"), "key")


def finer_keys(texts: DataFrame, keyed: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows (key, at, root) of keys that bring the same alike pairs together, the alike pairs met on the way, and their groups' roots.

    Pairs that are in one group already need no key.
    """
    q, found, roots = (1 - similarity) / (1 + similarity), None, None
    rows = written(_open_keys(keyed, None), "keys")
    small = rows.where(F.col("rows") <= SMALL).select("key", "at")
    for _ in range(DEALS):
        large = rows.where(F.col("rows") > SMALL)
        if not large.limit(1).count():
            break
        # The text with most company is the pivot: of copies with changes the one with fewest.
        company = large.groupBy("at").agg(F.sum("rows").alias("company"))
        pivots = large.join(company, "at").groupBy("key").agg(F.max_by("at", F.struct("company", -F.col("at"))).alias("h"))
        met = written(large.join(pivots, "key").where("at != h").select("h", "at").distinct(), "met")
        against = written(_against_pivots(texts, met, size, similarity), "against")
        discard(met)
        fresh = against.where("like").select(F.col("h").alias("a"), F.col("at").alias("b"))
        found = written(fresh if found is None else found.union(fresh), "alike")
        roots = components(found)
        of_text = _open_keys(against.select(F.col("h").alias("key"), "at"), roots).select(F.col("key").alias("h"), "at")
        cost = (1 - q) * F.size("added") + q * (F.col("lost") - F.col("whole"))
        open_ = written(against.join(of_text, ["h", "at"]).select("h", "at", "lost", F.size("added").alias("more"), cost.alias("cost"), "added"), "against")
        # Least |lost - lost'| + cost' of any text of the pivot, by running minima over the few values of lost.
        up = Window.partitionBy("h").orderBy("lost").rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy("h").orderBy(F.desc("lost")).rowsBetween(Window.unboundedPreceding, 0)
        least = F.least(F.min(F.col("cost") - F.col("lost")).over(up) + F.col("lost"), F.min(F.col("cost") + F.col("lost")).over(down) - F.col("lost"))
        levels = open_.groupBy("h", "lost").agg(F.min("cost").alias("cost")).select("h", "lost", least.alias("least"))
        needs = open_.join(levels, ["h", "lost"]).withColumn("need", F.ceil((F.col("cost") + F.col("least")) / 2 - 1e-6))
        together = needs.where("need <= 0").select(F.xxhash64(F.lit("together"), "h").alias("key"), "at")
        additions = needs.where("need <= more").select("h", "at", (F.col("more") - F.greatest("need", F.lit(1)) + 1).alias("room"), F.explode("added").alias("x"))
        counted = additions.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("h", "x")))
        ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("h", "at").orderBy("texts", "x")))
        shared = ranked.where("texts > 1 AND rank <= room").select(F.xxhash64(F.lit("added"), "h", "x").alias("key"), "at")
        again, rest = written(_open_keys(shared, roots), "keys"), written(together, "together")
        small = small.union(rest).union(again.where(F.col("rows") <= SMALL).select("key", "at"))
        rows = again
        discard(against, open_)
    else:
        small = small.union(rows.where(F.col("rows") > SMALL).select("key", "at"))
    return _open_keys(small, roots).select("key", "at", "root"), found, roots


def similar_links(texts: DataFrame, sizes: DataFrame, keyed: DataFrame, size: int, similarity: float) -> DataFrame:
    """Roots (node, root) of the groups that the alike pairs among texts of one key make.

    ``keyed`` (key, at) has a row for each key of a text; ``sizes`` (at, n, sig) its number of shingles and signature.
    """
    keyed, found, roots = finer_keys(texts, keyed, size, similarity)
    firsts = keyed.groupBy("key").agg(F.min("at").alias("first"))
    member = written(keyed.join(firsts, "key").join(sizes, "at").select("key", "at", "n", "sig", "root", (F.col("at") == F.col("first")).alias("head")), "members")
    room, turn = PAIRS * member.count(), 0
    while True:
        heads = member.where("head").select("key", *[F.col(c).alias(f"h_{c}") for c in member.columns if c not in ("key", "head")])
        near = (F.least("n", "h_n") >= F.greatest("n", "h_n") * similarity - 1e-9) & (F.col("root") != F.col("h_root"))
        met = member.join(heads, "key").where(near).select(F.least("h_at", "at").alias("a"), F.greatest("h_at", "at").alias("b"), "sig", "h_sig")
        pairs = written(_by_signature(met, similarity).distinct(), "pairs")
        fresh = written(alike(texts, pairs, size, similarity), "alike")
        discard(pairs)
        found = fresh if found is None else written(found.union(fresh), "alike")
        roots = components(found)
        # Heads have met all others of their key; what remains of a key is open while it is in several groups.
        rest = member.where("NOT head").select("key", "at", "n", "sig").join(roots.withColumnsRenamed({"node": "at"}), "at", "left").withColumn("root", F.coalesce("root", "at"))
        groups = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
        of_key = groups.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("all"), F.max("rows").alias("most"), F.max_by("root", F.struct("rows", "root")).alias("largest")).where("groups > 1")
        after = written(rest.join(of_key, "key").select("key", "at", "n", "sig", "root", (F.col("root") != F.col("largest")).alias("small"), "all", (F.col("all") - F.col("most")).alias("others")), "open")
        open_pairs = after.where("small").agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
        share, turn = min(1.0, room / max(1, open_pairs)), turn + 1
        drawn = F.pmod(F.xxhash64("at", "key", F.lit(turn)), F.lit(1 << 20)) < F.greatest(F.lit(share), F.lit(HEADS) / F.col("others")) * (1 << 20)
        new = written(after.select("key", "at", "n", "sig", "root", (F.col("small") & drawn).alias("head")), "members")
        discard(after)
        discard(member)
        member = new
        if not member.limit(1).count():
            return roots
