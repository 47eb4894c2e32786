"""LM scoring by subword lattice likelihood.

The pieces and their scores come from an existing tokenizer's vocabulary file
(never trained here); its scores give a prior over pieces.  Expected piece
counts over all segmentations of the training documents' distinct words, by
forward and backward recursion in log space, turn the prior into the unigram
model, in rounds over growing parts of the words, the last one over all.

The lattice of a word has the pieces as edges and, if training has the word, one
edge for it as a whole, of its count less a discount; the discounts of all words
weight the paths of pieces.  A word's probability is the sum over all paths
(forward recursion), and a document's is the product over its words and one end.
Pieces never cross white space, so each distinct word is worked out once.

Words are counted over all documents and kept as a table in the shared folder.
Only its most frequent words, at most ``TOP_WORDS``, are broadcast; the other
words of a document are joined with the table.  The frequent ones being out, no
join key has more than about 1/``TOP_WORDS`` of all words.

Defined cases: a null or empty text has the end only; rows repeated in ``docs``
are scored each; a byte of no piece is a piece of its own, so every text has a
probability above zero; a long text without white space is one word, worked out
in stretches; without training documents N is 0 and the prior alone is the
model; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import remainder_of_crc, written

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
TOP_WORDS = 200_000
#: Shares of the distinct words that the rounds of fitting see; the last sees all.
ROUNDS = (1 / 16, 1 / 8, 1 / 4, 1.0)
#: Pseudo-tokens that the vocabulary's own scores are worth.
PRIOR = 1000.0
LONG_WORD = 48
#: Starts of a longer word whose edges are held at once.
STRETCH = 1 << 15
FLUSH_WORDS = 200_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.float64(-np.inf)


def vocabulary(path: str = TOKENIZER) -> tuple[list[bytes], np.ndarray]:
    """(pieces as bytes, prior probabilities): a word starts with a space; all 256 bytes are there."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for k in range(sp.get_piece_size()):
        if sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k):
            continue
        piece = sp.id_to_piece(k).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            pieces[piece] = max(pieces.get(piece, -np.inf), sp.get_score(k))
    least = min(pieces.values(), default=0.0) - 1
    for b in range(256):
        pieces.setdefault(bytes([b]), least)
    names = list(pieces)
    scores = np.array([pieces[p] for p in names])
    if len(scores) and scores.min() < -1000:  # ranks of merges, not log probabilities: Zipf's law on the rank
        prior = 1.0 / (scores.max() - scores + 2.7)
    else:
        prior = np.exp(scores - scores.max())
    return names, prior / prior.sum()


def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (h + byte.astype(np.uint64) + np.uint64(1)) * _MUL ^ (h >> np.uint64(31))


class Lattice:
    """Forward and backward recursion over the segmentations of words, many words of one length at a time.

    Pieces and their prefixes are in a table of open addresses, at most a quarter
    full, so that a start is given up as soon as no piece goes on.
    """

    def __init__(self, pieces: list[bytes], p: np.ndarray):
        self.logp = np.log(np.maximum(p, 1e-300))
        self.most = max(map(len, pieces))
        of = {piece: k for k, piece in enumerate(pieces)}
        known = of | {piece[:n]: -2 for piece in pieces for n in range(1, len(piece)) if piece[:n] not in of}
        self.bits = max(10, (4 * len(known)).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32)
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
        names, ids = list(known), np.fromiter(known.values(), dtype=np.int32, count=len(known))
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            m = np.frombuffer(b"".join(names[k] for k in at.tolist()), dtype=np.uint8).reshape(-1, size)
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(size):
                h = _step(h, m[:, j])
            for key, value in zip(h.tolist(), ids[at].tolist()):
                slot = key >> 64 - self.bits
                while self.ids[slot] != -1:
                    slot = (slot + 1) % len(self.ids)
                self.keys[slot], self.ids[slot] = key, value

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece, -2 for what only begins pieces, -1 for what begins none."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.ids[at]
        open_ = np.flatnonzero((out != -1) & (self.keys[at] != h))
        while len(open_):  # the slot has another key: the next one
            at[open_] = (at[open_] + 1) % len(self.ids)
            out[open_] = self.ids[at[open_]]
            open_ = open_[(out[open_] != -1) & (self.keys[at[open_]] != h[open_])]
        return out

    def _edges(self, columns: np.ndarray):
        """(start, end, words, pieces) of all edges of words of one length; ``columns`` has a row for each byte."""
        size, n = columns.shape
        for i in range(size):
            rows, h = None, np.zeros(n, dtype=np.uint64)
            for j in range(i, min(size, i + self.most)):
                h = _step(h, columns[j] if rows is None else columns[j][rows])
                ids = self.lookup(h)
                alive = np.flatnonzero(ids != -1)
                if len(alive) < len(ids):
                    rows, h, ids = (alive if rows is None else rows[alive]), h[alive], ids[alive]
                if not len(ids):
                    break
                hit = np.flatnonzero(ids >= 0)
                if len(hit) == n:
                    yield i, j + 1, slice(None), ids
                elif len(hit):
                    yield i, j + 1, (hit if rows is None else rows[hit]), ids[hit]

    def _forward(self, columns: np.ndarray, edges) -> np.ndarray:
        alpha = np.full((columns.shape[0] + 1, columns.shape[1]), _NONE)
        alpha[0] = 0.0
        for i, j, rows, ids in edges:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logp[ids])
        return alpha

    # A long word by itself: edges of a stretch of starts at a time, so that few are held.
    def _starts(self, word: np.ndarray, a: int, b: int):
        rows, h, found = np.arange(a, b), np.zeros(b - a, dtype=np.uint64), []
        for step in range(self.most):
            inside = rows + step < len(word)
            rows, h = rows[inside], h[inside]
            h = _step(h, word[rows + step])
            ids = self.lookup(h)
            hit, alive = ids >= 0, ids != -1
            found.append((rows[hit], np.full(int(hit.sum()), step + 1), ids[hit]))
            rows, h = rows[alive], h[alive]
            if not len(rows):
                break
        i, size, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(i, kind="stable")
        return i[order], (i + size)[order], ids[order]

    def _push(self, alpha: array, edges) -> None:
        for i, j, lp in edges:
            high, low = alpha[j], alpha[i] + lp
            if low > high:
                high, low = low, high
            alpha[j] = high if low == -math.inf else high + math.log1p(math.exp(low - high))

    def _long(self, word: bytes) -> array:
        """Log of the sum over all segmentations of the first j bytes, for each j."""
        m, alpha = np.frombuffer(word, dtype=np.uint8), array("d", [0.0]) + array("d", [-math.inf]) * len(word)
        for a in range(0, len(m), STRETCH):
            i, j, ids = self._starts(m, a, min(len(m), a + STRETCH))
            self._push(alpha, zip(i.tolist(), j.tolist(), self.logp[ids].tolist()))
        return alpha

    def _long_counts(self, word: bytes, times: float, counts: np.ndarray) -> None:
        m, alpha = np.frombuffer(word, dtype=np.uint8), np.frombuffer(self._long(word))
        beta = array("d", [-math.inf]) * len(m) + array("d", [0.0])
        for a in reversed(range(0, len(m), STRETCH)):
            i, j, ids = self._starts(m, a, min(len(m), a + STRETCH))
            lp = self.logp[ids]
            self._push(beta, zip(j[::-1].tolist(), i[::-1].tolist(), lp[::-1].tolist()))
            share = np.exp(alpha[i] + lp + np.array([beta[x] for x in j.tolist()]) - alpha[-1])
            counts += np.bincount(ids, weights=share * times, minlength=len(counts))

    @staticmethod
    def _by_length(words: list[bytes]):
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            for k in range(0, len(at), 8192):
                yield size, at[k:k + 8192]

    @staticmethod
    def _columns(words: list[bytes], at: np.ndarray, size: int) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(b"".join(words[k] for k in at.tolist()), dtype=np.uint8).reshape(-1, size).T)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the sum over all segmentations, of each word with its leading space."""
        words, out = [b" " + w for w in words], np.zeros(len(words))
        for size, at in self._by_length(words):
            if size > LONG_WORD:
                out[at] = [self._long(words[k])[-1] for k in at.tolist()]
                continue
            m = self._columns(words, at, size)
            out[at] = self._forward(m, self._edges(m))[size]
        return out

    def expected_counts(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, the words occurring ``times`` times."""
        words, counts = [b" " + w for w in words], np.zeros(len(self.logp))
        for size, at in self._by_length(words):
            if size > LONG_WORD:
                for k in at.tolist():
                    self._long_counts(words[k], float(times[k]), counts)
                continue
            m = self._columns(words, at, size)
            edges = list(self._edges(m))
            alpha = self._forward(m, edges)
            beta = np.full_like(alpha, _NONE)
            beta[size] = 0.0
            weight = times[at]
            for i, j, rows, ids in reversed(edges):
                onward = self.logp[ids] + beta[j, rows]
                counts += np.bincount(ids, weights=np.exp(alpha[i, rows] + onward - alpha[size, rows]) * weight[rows], minlength=len(counts))
                beta[i, rows] = np.logaddexp(beta[i, rows], onward)
        return counts


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_table(rows: DataFrame) -> DataFrame:
    """(word binary, n, n_train) of rows (held_out, text): counts over all documents."""

    def run(batches):
        seen: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def flush():
            words = list({*seen[False], *seen[True]})
            train = [seen[False][w] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([a + seen[True][w] for a, w in zip(train, words)], pa.int64()), pa.array(train, pa.int64())], names=["word", "n", "n_train"])
            seen[False].clear()
            seen[True].clear()

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                seen[bool(held)].update(_words(text))
                if len(seen[False]) + len(seen[True]) > FLUSH_WORDS:
                    yield from flush()
        yield from flush()

    partial = rows.select("held_out", "text").mapInArrow(run, "word binary, n long, n_train long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def _least_count(words: DataFrame, most: int) -> int:
    """The count from which on there are at most ``most`` words; from counts of log-spaced buckets, a few hundred rows."""
    edge = F.ceil(F.pow(F.lit(2.0), F.floor(F.log2("n") * 16) / 16)).cast("long")  # least count of the bucket, or one close to it
    sizes = sorted(((r.least, r.k) for r in words.groupBy(edge.alias("e")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).select("least", "k").collect()), reverse=True)
    total, least = 0, (sizes[0][0] + 1 if sizes else 1)
    for at, k in sizes:
        total += k
        if total > most:
            break
        least = at
    return least


def fit(words: DataFrame, pieces: list[bytes], prior: np.ndarray, rounds=ROUNDS) -> np.ndarray:
    """Piece probabilities after rounds of expectation and maximisation over the words of training.

    Every distinct word counts once: the pieces are there for words that are not known.
    """
    spark, p, slot = words.sparkSession, prior, F.pmod(F.xxhash64("word", F.lit(3)), F.lit(1 << 20))
    for share in rounds:
        model = spark.sparkContext.broadcast(Lattice(pieces, p))

        def run(batches, model=model):
            total = None
            for b in batches:
                got = model.value.expected_counts(b.column(0).to_pylist(), np.ones(b.num_rows))
                total = got if total is None else total + got
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        seen = words.where("n_train > 0").where(slot < int(share * (1 << 20))).select("word")
        sums = seen.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(pieces))
        for r in sums.collect():  # at most one row a piece
            counts[r.piece] = r.n
        p = (counts + PRIOR * prior) / (counts.sum() + PRIOR)
    return p


def discount(once: int, twice: int) -> float:
    """What is taken off the count of each word of training, from how many words occur once and twice."""
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5


def score(docs: DataFrame, held_out, tokenizer: str = TOKENIZER, top_words: int = TOP_WORDS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    table = written(word_table(rows), "words")
    n_docs = rows.where("NOT held_out").count()
    whole = table.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), *[F.count_if(c).alias(k) for k, c in (("v", F.col("n_train") > 0), ("once", F.col("n_train") == 1), ("twice", F.col("n_train") == 2))]).first()
    n_train, v = int(whole.n) + n_docs, int(whole.v) + (1 if n_docs else 0)
    pieces, prior = vocabulary(tokenizer)
    model = spark.sparkContext.broadcast(Lattice(pieces, fit(table, pieces, prior)))
    less = discount(int(whole.once), int(whole.twice))
    end = (n_docs - less) / n_train if n_docs else 1.0 / (PRIOR + 1.0)
    paths = math.log(less * v / n_train if n_train else 1.0 - end)  # weight of the paths of pieces

    def weigh(batches):
        for b in batches:
            counts = b.column(2).to_numpy()
            word = np.log(np.where(counts > 0, counts - less, 1.0) / max(1, n_train))
            log_p = paths + model.value.log_probabilities(b.column(0).to_pylist())
            log_p = np.where(counts > 0, np.logaddexp(log_p, word), log_p)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(log_p / np.log(10))], names=["word", "n", "c", "lattice"])

    weighed = written(table.select("word", "n", "n_train").mapInArrow(weigh, "word binary, n long, c long, lattice double"), "word-scores")
    top = weighed.where(F.col("n") >= _least_count(weighed, top_words)).select("word", "c", "lattice").toArrow()  # at most top_words
    counts = top.column("c").to_numpy()
    shared = spark.sparkContext.broadcast((top.column("word").combine_chunks(), np.log10(counts + 1.0), counts > 0, top.column("lattice").to_numpy()))
    floor = float(np.log10(n_train + (v + 1.0)))
    end_base, end_known, end_score = float(np.log10(n_docs + 1.0)), int(n_docs > 0), float(np.log10(end))

    def run(batches):
        words, base, known, lattice = shared.value
        ids = {w: k for k, w in enumerate(words.to_pylist())}
        get = ids.get
        for batch in batches:
            row_ids = batch.column(0).to_pylist()
            doc_rows, rare = [], ([], [], [])
            for row, text in zip(row_ids, batch.column(1).cast(pa.binary()).to_pylist()):
                tokens = _words(text)
                at = np.fromiter(map(get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
                hit = at[at >= 0]
                doc_rows.append((len(tokens) + 1, int(known[hit].sum()) + end_known, float(base[hit].sum()) + end_base, float(lattice[hit].sum()) + end_score))
                if len(hit) < len(tokens):
                    few = Counter(w for w, k in zip(tokens, at.tolist()) if k < 0)
                    rare[0].extend(repeat(row, len(few)))
                    rare[1].extend(few.keys())
                    rare[2].extend(few.values())
            n = len(rare[0])
            cols = list(zip(*doc_rows)) if doc_rows else [(), (), (), ()]
            # A document's own row has a word that no text holds, spread over many join keys.
            yield pa.RecordBatch.from_arrays([
                pa.array(row_ids + rare[0], pa.int64()), pa.array([b" %d" % (r % 65536) for r in row_ids] + rare[1], pa.binary()), pa.array([0] * len(row_ids) + rare[2], pa.int64()),
                pa.array(list(cols[0]) + [0] * n, pa.int64()), pa.array(list(cols[1]) + [0] * n, pa.int64()), pa.array(list(cols[2]) + [0.0] * n, pa.float64()), pa.array(list(cols[3]) + [0.0] * n, pa.float64()),
            ], names=["row", "word", "times", "n_tokens", "n_known", "base", "score"])

    numbered = written(docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _ids_first(run, docs.schema["doc_id"].dataType), _out_schema(docs.schema["doc_id"].dataType)), "token-sums")
    joined = numbered.join(weighed.select(F.col("word").alias("w"), "c", "lattice"), F.col("word") == F.col("w"), "left")
    times = F.col("times")
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(times * F.log10(F.col("c") + 1.0), F.lit(0.0))).alias("base"),
        F.sum(F.col("score") + F.coalesce(times * F.col("lattice"), F.lit(0.0))).alias("score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score")


def _out_schema(id_type) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("row", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("times", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _ids_first(run, id_type):
    """``run`` over (row, text), its document rows with doc_id and held_out put before; other rows have null there."""

    def wrapped(batches):
        for batch in batches:
            size = max(1, min(batch.num_rows, 1000))
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                for out in run([pa.RecordBatch.from_arrays([part.column(3), part.column(2)], names=["row", "text"])]):
                    at = pa.array([*range(part.num_rows)] + [None] * (out.num_rows - part.num_rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *out.columns], names=["doc_id", "held_out", *out.schema.names])

    return wrapped


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, remainder_of_crc(F.col("doc_id"), 7) == 2)
