"""Quality classifier: a factorisation machine.

Inputs of a whole text: its distinct words, hashed; structure statistics (shares
of byte classes, repetition, line and word shape), cut into bins; and the
metadata n_chars, where the table has it.  A score takes linear time: the
pairwise term is half the sum over factors of (sum of v x) squared less the sum
of (v x) squared.  The model is trained by AdaGrad on a sample of at most
``TRAIN_ROWS`` labelled rows; it has ``SLOTS`` rows of ``FACTORS`` + 1 numbers,
whatever the input, so its broadcast is bounded.

Defined cases: a null or empty text has no words, and the bins of an empty text;
a very long text is scored whole, and learnt from by a stretch; null n_chars, or
one that is no number, has a bin of its own; repeated rows are scored each;
labels are taken as in ``textclf.training_sample``; without labels of both kinds
the score is the labels' mean (0 without labels); an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import remainder_of_crc
from palimpsest.llm.textclf import TokenCodes, in_pieces, sigmoid, token_batch, trained, training_sample

WORD_BITS = 17
FACTORS = 8
TRAIN_ROWS = 10_000
EPOCHS = 6
RATE, DECAY = 0.1, 1e-5
THRESHOLD = 0.7
BINS = 24
#: Edges of the bins of shares.
EDGES = np.array([0.0, 0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99])
N_STATS = 14
SLOTS = (1 << WORD_BITS) + (N_STATS + 1) * BINS

_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#$%&*+=@^_~", b"|<>{}[]/\\", b"\n", b" \t\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _k


def _share(a, b):
    return a / np.maximum(b, 1)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def features(texts: list, n_chars: list, codes: TokenCodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, value) of the inputs of each text."""
    n = len(texts)
    flat, counts = token_batch(texts, codes)
    doc = np.repeat(np.arange(n), counts)
    slot = ((flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key = np.unique((doc << WORD_BITS) | slot)
    wdoc, wslot = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(wdoc, minlength=n)

    raw = [(t or "").encode() for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=n)
    kinds = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    at = np.repeat(np.arange(n), sizes)
    table = np.bincount(at * 9 + kinds, minlength=9 * n).reshape(n, 9)
    same = np.zeros(len(flat), dtype=np.int64)
    if len(flat) > 1:
        same[1:] = (flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])
    pairs = np.zeros(len(flat), dtype=np.int64)
    if len(flat) > 2:
        pairs[2:] = (flat[2:] == flat[:-2]) & (doc[2:] == doc[:-2])
    lines = [t.split("\n") if t else () for t in texts]
    n_lines = np.array([len(x) for x in lines])
    own_lines = np.array([len(set(x)) for x in lines])
    shares = [
        _share(table[:, 1], sizes), _share(table[:, 2], sizes), _share(table[:, 3], sizes), _share(table[:, 4], sizes), _share(table[:, 5], sizes),
        _share(table[:, 6], sizes), _share(table[:, 7], sizes), _share(table[:, 8], sizes), _share(_sums(same, counts), counts), _share(_sums(pairs, counts), counts),
        1 - _share(distinct, counts), 1 - _share(own_lines, n_lines),
    ]
    bins = [np.searchsorted(EDGES, s, "right") for s in shares]
    bins.append(np.minimum(np.log2(sizes + 1).astype(np.int64), BINS - 1))
    bins.append(np.minimum((2 * _share(sizes, counts)).astype(np.int64), BINS - 1))
    bins.append(np.array([BINS - 1 if c is None else min(BINS - 2, int(max(0, c)).bit_length()) for c in n_chars], dtype=np.int64))
    m = len(bins)
    sslot = np.concatenate([(1 << WORD_BITS) + k * BINS + b for k, b in enumerate(bins)])
    sdoc = np.tile(np.arange(n), m)
    value = np.concatenate((1 / np.sqrt(distinct[wdoc]), np.full(m * n, 0.5)))
    d, s = np.concatenate((wdoc, sdoc)), np.concatenate((wslot, sslot))
    order = np.argsort(d, kind="stable")
    return d[order], s[order], value[order]


def predict(model, doc, slot, value, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, sums over v x per document, v x per input); every document has inputs, in order."""
    bias, w, v = model
    starts = np.searchsorted(doc, np.arange(n))
    vx = v[slot] * value[:, None].astype(np.float32)
    sums = np.add.reduceat(vx, starts)
    squares = np.add.reduceat(vx * vx, starts)
    linear = np.add.reduceat(w[slot] * value, starts)
    return bias + linear + 0.5 * (sums * sums - squares).sum(1), sums, vx


def train(rows: list) -> tuple[float, np.ndarray, np.ndarray]:
    """Model from rows (label, text, n_chars)."""
    y = np.array([r[0] for r in rows], dtype=np.float64)
    rng = np.random.default_rng(5)
    w, v = np.zeros(SLOTS), (rng.standard_normal((SLOTS, FACTORS)) * 0.05).astype(np.float32)
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.0
        return float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9))), w.astype(np.float32), np.zeros_like(v)
    codes, docs = TokenCodes(), []
    for k in range(0, len(rows), 256):
        part = rows[k:k + 256]
        d, s, x = features([r[1] for r in part], [r[2] for r in part], codes)
        cuts = np.searchsorted(d, np.arange(1, len(part)))
        docs += list(zip(np.split(s, cuts), np.split(x, cuts)))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv = np.full(SLOTS, 1e-3), np.full((SLOTS, FACTORS), 1e-3, dtype=np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), 32):
            pick = order[k:k + 32]
            slot = np.concatenate([docs[i][0] for i in pick])
            value = np.concatenate([docs[i][1] for i in pick])
            doc = np.repeat(np.arange(len(pick)), [len(docs[i][0]) for i in pick])
            z, sums, vx = predict((bias, w, v), doc, slot, value, len(pick))
            g = (sigmoid(z) - y[pick])[doc] * value
            own, back = np.unique(slot, return_inverse=True)
            dw = np.bincount(back, weights=g) + DECAY * w[own]
            dv = np.zeros((len(own), FACTORS))
            each = g[:, None] * (sums[doc] - vx)
            for f in range(FACTORS):
                dv[:, f] = np.bincount(back, weights=each[:, f])
            dv += DECAY * v[own]
            gw[own] += dw * dw
            gv[own] += dv * dv
            w[own] -= RATE * dw / np.sqrt(gw[own])
            v[own] -= (RATE * dv / np.sqrt(gv[own])).astype(np.float32)
            bias -= 0.02 * float((sigmoid(z) - y[pick]).mean())
    return bias, w.astype(np.float32), v


def score_batch(texts: list, n_chars: list, model, codes: TokenCodes) -> np.ndarray:
    if not texts:
        return np.empty(0)
    return sigmoid(predict(model, *features(texts, n_chars, codes), len(texts))[0].astype(np.float64))


def score(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs (doc_id, text and, if there, n_chars)."""
    chars = F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    rows = docs.select("doc_id", chars.alias("n_chars"), "text")
    held = remainder_of_crc(F.col("doc_id"), 4) == 2
    sample = training_sample(rows, labels, "quality", limit, held, lead=F.coalesce(F.col("n_chars").cast("string"), F.lit("")))
    model = docs.sparkSession.sparkContext.broadcast(trained(sample, lambda rows: train([(y, t, int(c) if c else None) for y, x in rows for c, _, t in [x.partition("\x00")]])))

    def run(batches):
        codes = TokenCodes()
        for part, texts in in_pieces(batches):
            s = score_batch(texts, part.column(1).to_pylist(), model.value, codes)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", (remainder_of_crc(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
