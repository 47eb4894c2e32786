"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Shards.  Every window of LENGTH bytes has one anchor, the leftmost least hash of
its ``GRAM``-byte strings, so equal windows have equal anchors at equal offsets.
Windows in a row with one anchor make a segment.  Only anchors that recur
anywhere are kept (a Bloom filter of fixed size thins them early; a join
decides).  Segments that are equal as a whole (128-bit BLAKE2 of their bytes) are
counted before anything is gathered: all their windows are repeated, and one of
them stands for the others.  Where an anchor has unlike segments, one of each
goes to the anchor's shard.

Sorting.  A shard's segments are sorted by external induced sorting with
common-prefix values (``suffix_sort``); suffixes that share LENGTH bytes with a
neighbour are repeated windows.  A task cuts what it gets into shards of about
``SHARD_BYTES`` by anchor, through files of its scratch folder if it is much
more; the sorter's queues hold a fifth of a shard's tuples and are on disk beyond.

An anchor with more than ``HOT_SEGMENTS`` unlike segments would make one large
shard; its windows are counted by 128-bit BLAKE2 digests instead, in a shuffle that
combines equal windows before it.

Defined cases: a null text is empty: 0 bytes, nothing removed; texts shorter than
LENGTH lose nothing; rows repeated in ``docs`` count as further occurrences; a
null id is an id like another; an empty table gives an empty result.  Of a very
long text, stretches of BUFFER_BYTES windows are looked at in turn.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import discard, released, written
from palimpsest.llm.suffix_sort import SEPARATOR, SuffixSorter

LENGTH = 200
GRAM = 40
BUFFER_BYTES = 1 << 18
BLOOM_BITS = 26
SHARD_BYTES = 2 << 20
HOT_SEGMENTS = 4096
#: A segment with more than this part of all occurrences has its marks joined by broadcast: at most HOT_PARTS of them.
HOT_PARTS = 1000

# Odd base of the rolling hash, and a finishing multiplier.
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_TABLE = np.random.default_rng(101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any stretch of a buffer, from prefix sums of a polynomial."""

    def __init__(self):
        self.size = 0

    def _grow(self, n: int) -> None:
        if n >= self.size:
            self.size = max(n + 1, BUFFER_BYTES + 1024)
            self.powers, self.inverse = (np.full(self.size, b, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            for x in (self.powers, self.inverse):
                x[0] = 1
                np.cumprod(x, out=x)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * self.powers[:len(data)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start, stop) -> np.ndarray:
        return (prefix[stop] - prefix[start]) * self.inverse[start]


def _leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value of each window of ``width``."""
    at, step = np.arange(len(x)), 1
    while 2 * step <= width:
        a, b = at[:-step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        step *= 2
    if step < width:
        a, b = at[:len(at) - (width - step)], at[width - step:]
        at = np.where(x[b] < x[a], b, a)
    return at


def segments_of(texts: list[bytes], rolling: Rolling, length: int = LENGTH, gram: int = GRAM):
    """(text, first window, windows, anchor hash) of all segments of some texts."""
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    data, found = np.frombuffer(b"".join(texts), dtype=np.uint8), []
    for a in range(0, len(data) - length + 1, BUFFER_BYTES):
        b = min(len(data) - length + 1, a + BUFFER_BYTES)  # windows a to b - 1
        piece = data[a:b + length - 1]
        prefix = rolling.prefix(piece)
        grams = _mix(rolling.span(prefix, slice(0, len(piece) - gram + 1), slice(gram, None)))
        anchor = _leftmost_least(grams, length - gram + 1)
        for end in ends[np.searchsorted(ends, a, "right"):np.searchsorted(ends, b + length, "right")].tolist():
            anchor[max(0, end - length + 1 - a):max(0, end - a)] = -1  # windows over a text's end
        turn = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first = np.concatenate(([0], turn))
        count = np.diff(np.append(first, len(anchor)))
        real = anchor[first] >= 0
        first, count = first[real], count[real]
        found.append((first + a, count, anchor[first] + a, grams[anchor[first]]))
    if not found:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    first, count, anchor, h = (np.concatenate(x) for x in zip(*found))
    # A segment that goes over a stretch's end is one.
    goes_on = np.zeros(len(first), dtype=bool)
    goes_on[1:] = (anchor[1:] == anchor[:-1]) & (first[1:] == first[:-1] + count[:-1])
    heads = np.flatnonzero(~goes_on)
    count = np.add.reduceat(count, heads) if len(heads) else count
    first, h = first[heads], h[heads]
    owner = np.searchsorted(ends, first, "right")
    return owner, first - np.concatenate(([0], ends[:-1]))[owner], count, h


def _buffers(texts: list[bytes]):
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= BUFFER_BYTES or k + 1 == len(texts):
            yield start, texts[start:k + 1]
            start, held = k + 1, 0


def _bloom_words(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BLOOM_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(BLOOM_BITS)) & mask).astype(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k2, text binary): k2 tells rows with one id and unlike texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.hash("doc_id", text).alias("k2"), text.cast("binary").alias("text"))


def _digests(texts: list[bytes], doc: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """128-bit digests of segments, as two numbers each."""
    digest = hashlib.blake2b
    joined = b"".join(digest(texts[d][a:a + n - 1 + length], digest_size=16).digest() for d, a, n in zip(doc.tolist(), start.tolist(), windows.tolist()))
    return np.frombuffer(joined, dtype=np.int64).reshape(-1, 2)


def _packed(keyed: DataFrame) -> DataFrame:
    """The texts compressed, for the shuffle."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t) for t in b.column(2).to_pylist()], pa.binary())], names=["doc_id", "k2", "packed"])

    return keyed.mapInArrow(released(run), T.StructType([keyed.schema["doc_id"], keyed.schema["k2"], T.StructField("packed", T.BinaryType())]))


def _unpacker():
    import zstandard

    z = zstandard.ZstdDecompressor()
    return lambda blob: z.decompress(blob, max_output_size=1 << 31) if blob else b""


def _recurring(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches):
        rolling = Rolling()
        for b in batches:
            for _, texts in _buffers(b.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(segments_of(texts, rolling, length)[3].view(np.int64))], names=["h"])

    return keyed.select("text").mapInArrow(released(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def _bloom(recurring: DataFrame) -> np.ndarray:
    """Bits of a filter of 2**BLOOM_BITS bits; its size is fixed, a fuller one only lets more through."""
    mask = F.lit((1 << BLOOM_BITS) - 1)
    bit = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", BLOOM_BITS).bitwiseAND(mask))).alias("bit")
    words = recurring.select(bit).groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 31 AS INT))")).alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 5), dtype=np.uint32)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _anchors(keyed: DataFrame, recurring: DataFrame, length: int) -> DataFrame:
    bits = keyed.sparkSession.sparkContext.broadcast(_bloom(recurring))

    def run(batches):
        rolling, known = Rolling(), bits.value
        for b in batches:
            for start, texts in _buffers(b.column(2).to_pylist()):
                doc, first, count, h = segments_of(texts, rolling, length)
                one, two = _bloom_words(h)
                keep = (known[one >> 3] >> (one & 7)) & (known[two >> 3] >> (two & 7)) & 1 > 0
                doc, first, count = doc[keep], first[keep], count[keep]
                at, seg = pa.array(doc + start), _digests(texts, doc, first, count, length)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(at), b.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)),
                    pa.array(h[keep].view(np.int64)), pa.array(seg[:, 0]), pa.array(seg[:, 1])], names=["doc_id", "k2", "start", "windows", "h", "seg", "seg2"])

    return keyed.mapInArrow(released(run), T.StructType([keyed.schema["doc_id"], keyed.schema["k2"], *[T.StructField(n, T.IntegerType()) for n in ("start", "windows")], *[T.StructField(n, T.LongType()) for n in ("h", "seg", "seg2")]]))


def _flagged_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2] - edges[::2]


def sort_shard(segments: list[bytes], scratch: str, length: int = LENGTH):
    """(segment, first window, windows) of the runs of windows that recur among the segments."""
    table = ((254 - np.arange(256)) % 256).astype(np.uint8)  # fixed value: bytes 0xF8 to 0xFF are in no UTF-8 text, so 0 is free
    text = table[np.frombuffer(b"\xfe".join(segments) + b"\xfe", dtype=np.uint8)]
    shared = SuffixSorter(text, scratch, length, max(1 << 10, len(text))).run()  # a fifth of its tuples
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments)) + 1
    begin = np.cumsum(sizes) - sizes
    start, count = _flagged_runs(shared)
    owner = np.searchsorted(begin, start, "right") - 1
    return owner, start - begin[owner], count


assert SEPARATOR == (254 - 0xFE)


def _sort(segments: DataFrame, length: int, shards: int) -> DataFrame:
    schema = T.StructType([segments.schema["doc_id"], segments.schema["k2"], T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType())])

    def solve(table: pa.Table, scratch: str):
        owner, start, count = sort_shard(table.column("text").to_pylist(), scratch, length)
        single = table.column("single").to_numpy(zero_copy_only=False)[owner]
        owner, start, count = owner[single], start[single], count[single]
        at = pa.array(owner)
        base = table.column("start").to_numpy()[owner]
        for b in pa.table([table.column("doc_id").take(at), table.column("k2").take(at), pa.array((base + start).astype(np.int32)), pa.array(count.astype(np.int32))], names=schema.names).to_batches():
            yield b

    def run(batches):
        with tempfile.TemporaryDirectory() as scratch:  # the task's own, gone with it
            held, size, files = [], 0, None

            def spool():
                nonlocal held, size
                for b in held:
                    part = (b.column("h").to_numpy().view(np.uint64) >> np.uint64(40)) % np.uint64(len(files))
                    for k in np.unique(part).tolist():
                        files[k].write_batch(b.take(pa.array(np.flatnonzero(part == k))))
                held, size = [], 0

            for b in batches:
                held.append(b)
                size += b.nbytes
                if size > 8 * SHARD_BYTES:
                    if files is None:
                        files = [pa.ipc.new_file(os.path.join(scratch, f"s{k}"), b.schema) for k in range(64)]
                    spool()
            if files is None:
                if held:
                    yield from solve(pa.Table.from_batches(held), scratch)
                return
            spool()
            for k, f in enumerate(files):
                f.close()
                with pa.OSFile(os.path.join(scratch, f"s{k}")) as source:
                    table = pa.ipc.open_file(source).read_all()
                if table.num_rows:
                    yield from solve(table, scratch)

    return segments.repartition(shards, "h").mapInArrow(released(run), schema)


def _hot_windows(segments: DataFrame, length: int) -> DataFrame:
    """Marks of the windows of hot anchors, by counting digests of whole windows."""
    schema = T.StructType([segments.schema["doc_id"], segments.schema["k2"], T.StructField("start", T.IntegerType()), T.StructField("single", T.BooleanType()), T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType())])

    def run(batches):
        for b in batches:
            for begin in range(0, b.num_rows, 1000):
                part = b.slice(begin, 1000)
                windows = part.column("windows").to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.repeat(np.arange(part.num_rows), windows)
                step = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
                digest = _digests(part.column("text").to_pylist(), at, step, np.ones(len(at), dtype=np.int64), length)
                rows = pa.array(at)
                start = part.column("start").to_numpy(zero_copy_only=False)[at] + step
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("k2").take(rows), pa.array(start.astype(np.int32)), part.column("single").take(rows), pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=schema.names)

    windows = segments.mapInArrow(released(run), schema)
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    return windows.where("single").join(again, ["w1", "w2"], "left_semi").select("doc_id", "k2", "start", F.lit(1).cast("int").alias("windows"))


def _segment_texts(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments (doc_id, k2, start, windows, h, single, hot)."""
    by_doc = wanted.groupBy(F.col("doc_id").alias("d"), F.col("k2").alias("k")).agg(F.collect_list(F.struct("start", "windows", "h", "single", "hot")).alias("wanted"))
    joined = _packed(keyed).join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k2") == F.col("k"))).select("doc_id", "k2", "packed", "wanted")
    schema = T.StructType([keyed.schema["doc_id"], keyed.schema["k2"], T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("single", T.BooleanType()), T.StructField("hot", T.BooleanType()), T.StructField("text", T.BinaryType())])

    def run(batches):
        unpack = _unpacker()
        for b in batches:
            packed, lists = b.column(2), b.column(3)
            for k in range(b.num_rows):
                text, found = unpack(packed[k].as_py()), lists.slice(k, 1).flatten()
                start, windows = found.field("start").to_pylist(), found.field("windows").to_pylist()
                at = pa.array(np.full(len(start), k))
                pieces = pa.array([text[a:a + n - 1 + length] for a, n in zip(start, windows)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), found.field("start"), found.field("windows"), found.field("h"), found.field("single"), found.field("hot"), pieces], names=schema.names)

    return joined.mapInArrow(released(run), schema)


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, k2, start, windows): runs of windows of ``length`` bytes that also start elsewhere."""
    keyed = _keyed(docs)
    recurring = written(_recurring(keyed, length), "anchors", few=True)
    anchors = written(_anchors(keyed, recurring, length), "segments", few=True)
    discard(recurring)
    # Per unlike segment: how often it occurs, and one occurrence of it.
    each = anchors.groupBy("h", "seg", "seg2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "k2", "start", "windows")).alias("one"))
    per_anchor = each.groupBy(F.col("h").alias("a")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unlike")).where("total > 1")
    groups = written(each.join(per_anchor, F.col("h") == F.col("a")).select("h", "seg", "seg2", "n", "unlike", "one"), "groups", few=True)
    # Occurrences of segments that recur as a whole; the most frequent ones, at most HOT_PARTS, without a shuffle.
    key, often = ["h", "seg", "seg2"], F.col("n") * HOT_PARTS > anchors.count()
    common = F.broadcast(groups.where((F.col("n") > 1) & often).select(*key))
    whole = anchors.join(common, key, "left_semi").unionByName(anchors.join(common, key, "left_anti").join(groups.where((F.col("n") > 1) & ~often).select(*key), key, "left_semi")).select("doc_id", "k2", "start", "windows")
    wanted = groups.where("unlike > 1").select("one.*", "h", (F.col("n") == 1).alias("single"), (F.col("unlike") > HOT_SEGMENTS).alias("hot"))
    facts = wanted.agg(F.coalesce(F.sum(F.col("windows") + length), F.lit(0)).alias("bytes"), F.count_if("hot").alias("hot")).first()
    if not facts.bytes:
        return whole
    texts = written(_segment_texts(keyed, wanted, length), "segment-texts", few=True)
    marks = whole.unionByName(_sort(texts.where("NOT hot"), length, max(1, -(-facts.bytes // SHARD_BYTES), keyed.sparkSession.sparkContext.defaultParallelism)))
    return marks.unionByName(_hot_windows(texts.where("hot"), length)) if facts.hot else marks


def cut(text: bytes, starts: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[bytes, int, int]:
    """(what remains, bytes removed, maximal removed runs)."""
    if not len(starts):
        return text, 0, 0
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate((starts + windows - 1 + length)[order])
    first = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))  # runs that touch are one
    begin, end = begin[first], np.append(end[first[1:] - 1], end[-1])
    kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)]))
    return kept, int((end - begin).sum()), len(begin)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text, n_bytes, n_removed, n_spans, kept_sha256): text holds the remaining bytes."""
    keyed = _keyed(docs)
    marks = written(repeated_windows(docs, length), "marks", few=True)
    by_doc = marks.groupBy(F.col("doc_id").alias("d"), F.col("k2").alias("k")).agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    joined = _packed(keyed).join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k2") == F.col("k")), "left").select("doc_id", "packed", "marks")
    schema = T.StructType([keyed.schema["doc_id"], T.StructField("text", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        unpack = _unpacker()
        for b in batches:
            for begin in range(0, b.num_rows, 256):
                part, rows = b.slice(begin, 256), []
                for k in range(part.num_rows):
                    text, found = unpack(part.column(1)[k].as_py()), part.column(2).slice(k, 1).flatten()
                    kept, removed, spans = cut(text, found.field("start").to_numpy(zero_copy_only=False).astype(np.int64), found.field("windows").to_numpy(zero_copy_only=False).astype(np.int64), length)
                    rows.append((kept, len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array(cols[4], pa.string())], names=schema.names)

    return joined.mapInArrow(released(run), schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
