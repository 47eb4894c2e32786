"""What the classifiers share: bounded training samples, hashed tokens of whole batches."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import released

#: Fixed value: characters cut from both ends of a token.
EDGES = ".,;:!?\"'()[]{}<>|*#$%&+-=_/\\~`^@"


class TokenCodes(dict):
    """Raw lower-case token to a 63-bit code of the token without edge punctuation; bounded."""

    limit = 400_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[token] = xxhash.xxh64_intdigest((token.strip(EDGES) or token).encode(), 17) >> 1
        return code


def token_batch(texts: list, codes: TokenCodes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens of all texts, one after the other, and the tokens per text; null counts as empty."""
    lists = [t.lower().split() if t else () for t in texts]
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    get = codes.__getitem__
    flat = np.fromiter((get(w) for words in lists for w in words), dtype=np.int64, count=int(counts.sum()))
    return flat, counts


def in_pieces(batches, rows: int = 512, most_chars: int = 8_000_000):
    """(batch slice, texts of its last column), cut so that few texts and characters are held at once."""
    for batch in batches:
        texts, start, held = batch.column(batch.num_columns - 1).to_pylist(), 0, 0
        for k, t in enumerate(texts):
            held += len(t) if t else 0
            if k + 1 - start >= rows or held >= most_chars or k + 1 == len(texts):
                yield batch.slice(start, k + 1 - start), texts[start:k + 1]
                start, held = k + 1, 0


def stretch(text: Column, key: Column, most_chars: int) -> Column:
    """The text; of more than ``most_chars`` characters, a stretch of so many that the key's hash picks."""
    size = F.length(text)
    start = F.when(size > most_chars, F.pmod(F.xxhash64(F.lit(10), key), size - most_chars + 1)).otherwise(0).cast("int") + 1
    return text.substr(start, F.lit(most_chars))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, held_out, seed: int = 5, most_chars: int = 40_000, lead: Column | None = None) -> DataFrame:
    """At most ``limit`` rows (label, text) of the labelled rows that may be learnt from, in seeded order.

    Ids with both labels are left out, and so are labels without a text.  Of a text
    of more than ``most_chars`` characters a stretch is learnt from, so that the
    sample is bounded in bytes too.  ``lead`` is put before it, with a zero character.
    """
    known = labels.select("doc_id", F.col(label).try_cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out)
    sure = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", "label")
    there = docs.where(F.col("text").isNotNull())
    # Ids are drawn first, from narrow rows: at most ``limit`` of them, so they can be broadcast, and no other text moves.
    drawn = sure.join(there.select("doc_id"), "doc_id", "left_semi").withColumn("o", F.xxhash64(F.lit(seed), "doc_id")).orderBy("o", "doc_id").limit(limit)
    piece = stretch(F.col("text"), F.col("doc_id"), most_chars)
    rows = there.select("doc_id", (piece if lead is None else F.concat(lead, F.lit("\x00"), piece)).alias("text"))
    return rows.join(F.broadcast(drawn), "doc_id").orderBy("o", "doc_id", "text").limit(limit).select("label", "text")


def trained(sample: DataFrame, train):
    """``train`` of an iterator of a bounded sample's rows, run in one task so that the driver holds the model alone."""

    def run(batches):
        rows = (r for b in batches for k in range(0, b.num_rows, 256) for r in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], names=["model"])

    found = sample.coalesce(1).mapInArrow(released(run), "model binary").first()
    return pickle.loads(found.model) if found else train([])  # an empty table may have no task at all


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
