"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a whole text: its distinct words, pairs of neighbours, and pairs
with one word between, hashed to 2**BITS slots.  Training follows the
per-coordinate FTRL-proximal rule, document by document, on a sample of at most
``TRAIN_ROWS`` labelled rows; L1 leaves few weights other than zero, at most
2**BITS, and those are sent to the executors.

Defined cases: a null or empty text has the score of the intercept; a very long
text is scored whole, and learnt from by a stretch; rows repeated in ``docs`` are
scored each; labels other than 0 and 1, labels of unknown documents and ids with
both labels are ignored; without labels of both kinds every score is 0; an empty
table gives an empty result; further columns are ignored or carried, whatever
their names.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import released, remainder_of_crc
from palimpsest.llm.textclf import TokenCodes, in_pieces, sigmoid, token_batch, trained, training_sample

BITS = 23
#: A slot is learnt if at least so many documents of the sample have it.
LEAST_DOCS = 4
TRAIN_ROWS = 10_000
EPOCHS = 3
THRESHOLD = 0.3
#: FTRL-proximal's alpha, beta, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.5, 0.0


def slots(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of each word, neighbour pair and skip pair, repeats included."""
    doc = np.repeat(np.arange(len(counts)), counts)
    u = flat.astype(np.uint64)
    shift = np.uint64(64 - BITS)
    # Odd multipliers of the hashes.
    one, two, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    parts = [(doc, (u * one) >> shift)]
    for gap, salt in ((1, two), (2, skip)):
        if len(u) > gap:
            same = doc[:-gap] == doc[gap:]
            parts.append((doc[:-gap][same], ((u[:-gap] * salt + u[gap:] * one) * two)[same] >> shift))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)


def distinct(doc: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc.astype(np.int64) << BITS) | slot)
    return key >> BITS, key & ((1 << BITS) - 1)


def _in_blocks(rows, most: int = 256, most_chars: int = 500_000):
    """Lists of at most ``most`` rows, cut after about so many characters."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += len(row[1] or "")
        if len(block) >= most or held >= most_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def train(rows) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots with a weight, their weights, intercept) from rows (label, text), which are taken block by block.

    The documents' slots wait in a file; in memory are a byte a slot, then what is learnt of the slots of LEAST_DOCS documents.
    """
    with tempfile.TemporaryFile() as store:
        y, sizes, codes, seen = [], [], TokenCodes(), np.zeros(1 << BITS, dtype=np.uint8)
        for block in _in_blocks(rows):
            doc, slot = distinct(*slots(*token_batch([r[1] for r in block], codes)))
            store.write(slot.astype(np.int32).tobytes())
            for i in np.split(slot, np.searchsorted(doc, np.arange(1, len(block)))):
                seen[i] = np.minimum(seen[i] + 1, LEAST_DOCS)
                sizes.append(len(i))
            y += [r[0] for r in block]
        del codes
        store.flush()
        y, ends = np.array(y, dtype=np.float64), np.cumsum(sizes, dtype=np.int64)
        if not len(y) or y.min() == y.max():
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32), -35.0
        learnt = np.flatnonzero(seen >= LEAST_DOCS).astype(np.int32)
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[learnt] = np.arange(len(learnt))
        del seen
        # Each document's learnt slots, by their place, at the begin of its own stretch.
        flat = np.memmap(store, dtype=np.int32, mode="r+") if ends[-1] else np.empty(0, dtype=np.int32)
        begins = ends - sizes
        for k, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
            i = place[flat[a:b]]
            i = i[i >= 0]
            flat[a:a + len(i)] = i
            ends[k] = a + len(i)
        del place
        docs = [np.asarray(flat[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
        last = len(learnt)  # the intercept, without L1
        z, n = np.zeros(last + 1), np.zeros(last + 1)
        rng = np.random.default_rng(3)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(docs)):
                i = docs[k]
                zi, ni = z[i], n[i]
                w = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
                b = -z[last] / ((BETA + np.sqrt(n[last])) / ALPHA + L2)
                g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y[k]
                for at, now in ((i, w), (last, b)):
                    s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                    z[at] += g - s * now
                    n[at] += g * g
        w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
        b = -z[last] / ((BETA + np.sqrt(n[last])) / ALPHA + L2)
        at = np.flatnonzero(w[:last])
        return learnt[at], w[at].astype(np.float32), float(b)


def score_batch(texts: list, weights: np.ndarray, bias: float, codes: TokenCodes) -> np.ndarray:
    doc, slot = slots(*token_batch(texts, codes))
    hit = weights[slot] != 0
    doc, slot = distinct(doc[hit], slot[hit])
    return sigmoid(bias + np.bincount(doc, weights=weights[slot].astype(np.float64), minlength=len(texts)))


def score(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, limit: int = TRAIN_ROWS) -> DataFrame:
    """The columns ``carry`` (by default doc_id) in a struct ``row``, with held_out, score and predicted."""
    sample = training_sample(docs, labels, "toxic", limit, remainder_of_crc(F.col("doc_id"), 4) == 2)
    model = docs.sparkSession.sparkContext.broadcast(trained(sample, train))

    def run(batches):
        at, values, bias = model.value
        weights, codes = np.zeros(1 << BITS, dtype=np.float32), TokenCodes()
        weights[at] = values
        for part, texts in in_pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_batch(texts, weights, bias, codes))], names=["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry or ["doc_id"]]).alias("row"), "text")
    fields = [rows.schema["row"], T.StructField("score", T.DoubleType())]
    scored = rows.mapInArrow(released(run), T.StructType(fields))
    held = (remainder_of_crc(F.col("row.doc_id"), 4) == 2) if "doc_id" in (carry or ["doc_id"]) else F.lit(None).cast("boolean")
    return scored.select("row", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns of ``docs``."""
    kept = score(docs, labels, docs.columns).where("predicted = 0")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("row.doc_id", "held_out", "score", "predicted")
