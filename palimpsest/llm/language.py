"""Language identification by hierarchical discrimination.

Inputs of a whole text: the shares of its hashed byte trigrams, lower-cased and
with all that is no letter as space.  First, linear scores, one a family, pick
the family; within it, one linear support vector machine for each pair of its
languages votes.  Scores are sums over trigrams, so a text is read once, in any
length.  Training takes about ``TRAIN_ROWS`` rows of every language, fewer where
those of all were more than ``ALL_ROWS``, and a stretch of a long text; the model
has 2**BITS rows and a column for each family and each pair inside one.  A family
of more than ``FAMILY_SIZE`` languages is cut into even ones, so that the columns
grow in proportion to the languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with null lang are not learnt from; a language of no listed family is one
of family "other"; without anything to learn from all is ``und``; an empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import remainder_of_crc
from palimpsest.llm.textclf import in_pieces, sigmoid, stretch, trained

BITS = 12
TRAIN_ROWS = 1200
ROUNDS = 150
#: Rows of all languages together, as long as LEAST_ROWS a language fit in; languages of one family.
ALL_ROWS = 64 * TRAIN_ROWS
LEAST_ROWS = 100
FAMILY_SIZE = 64

#: Families of languages.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi bn mr ne ur pa gu".split(),
    "sinitic": "zh yue".split(),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
LETTER = re.compile(r"[^\W\d_]")

_TO_SPACE = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalpha():
        _TO_SPACE[_b] = 32


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all trigrams, trigrams per text); a text is set in spaces."""
    raw = [b"  " + t.lower().encode() + b"  " if t else b"    " for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    b = _TO_SPACE[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    # The two windows that reach into the next text hold only spaces and its first letter: left out.
    inside = np.ones(len(b), dtype=bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    return slot[inside[:-2]].astype(np.int64), sizes - 2


def shares(texts: list) -> np.ndarray:
    slot, counts = trigrams(texts)
    at = np.repeat(np.arange(len(texts)), counts)
    table = np.bincount((at << BITS) | slot, minlength=len(texts) << BITS).reshape(len(texts), 1 << BITS)
    return (table / counts[:, None]).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear support vector machine: squared hinge loss by accelerated gradient steps; y is -1 or 1."""
    w, b, share = np.zeros(x.shape[1], dtype=np.float32), 0.0, np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 0.5 / (float((share * (x * x).sum(1)).sum()) + 1.0)
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(ROUNDS):
        short = np.maximum(0, 1 - y * (x @ (w + 0.9 * vw) + b + 0.9 * vb)) * share * y
        vw = 0.9 * vw + step * (2 * (x.T @ short) - 1e-4 * w)
        vb = 0.9 * vb + step * 2 * float(short.sum())
        w, b = w + vw, b + vb
    return w, b


def train(rows: list) -> dict:
    """Model from rows (lang, text)."""
    langs = sorted({r[0] for r in rows})
    family_of = {lang: _FAMILY.get(lang, "other") for lang in langs}
    for family in sorted(set(family_of.values())):
        members = [lang for lang in langs if family_of[lang] == family]
        parts = -(-len(members) // FAMILY_SIZE)
        if parts > 1:
            family_of |= {lang: f"{family} {k * parts // len(members)}" for k, lang in enumerate(members)}
    families = sorted(set(family_of.values()))
    columns, biases, pairs = [], [], []
    if langs:
        x = np.concatenate([shares([r[1] for r in rows[k:k + 256]]) for k in range(0, len(rows), 256)])
        scale = 1.0 / (x.std(0) + 1e-4) / np.sqrt(x.shape[1]) * 8
        x *= scale
        of = np.array([langs.index(r[0]) for r in rows])
        fam = np.array([families.index(family_of[r[0]]) for r in rows])
        if len(families) > 1:
            for k in range(len(families)):
                w, b = svm(x, np.where(fam == k, 1.0, -1.0).astype(np.float32))
                columns.append(w * scale)
                biases.append(b)
        for family in families:
            for p, q in combinations([k for k, lang in enumerate(langs) if family_of[lang] == family], 2):
                mine = (of == p) | (of == q)
                w, b = svm(x[mine], np.where(of[mine] == p, 1.0, -1.0).astype(np.float32))
                columns.append(w * scale)
                biases.append(b)
                pairs.append((p, q))
    w = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((1 << BITS, 0), dtype=np.float32)
    return {"langs": langs, "families": families, "members": [[k for k, lang in enumerate(langs) if family_of[lang] == f] for f in families], "pairs": pairs, "w": w, "b": np.array(biases)}


def predict(texts: list, model: dict) -> tuple[list, np.ndarray]:
    n, langs, families = len(texts), model["langs"], model["families"]
    if not langs:
        return ["und"] * n, np.zeros(n)
    slot, counts = trigrams(texts)
    starts = np.cumsum(counts) - counts
    margins = np.stack([np.add.reduceat(model["w"][:, c][slot], starts, dtype=np.float64) for c in range(model["w"].shape[1])], axis=1) / counts[:, None] + model["b"] if model["w"].shape[1] else np.zeros((n, 0))
    if len(families) > 1:
        f = margins[:, :len(families)]
        family, sure = f.argmax(1), sigmoid(2 * f)
        sure = sure.max(1) / sure.sum(1)
        rest = margins[:, len(families):]
    else:
        family, sure, rest = np.zeros(n, dtype=np.int64), np.ones(n), margins
    votes, weight = np.zeros((n, len(langs))), np.zeros((n, len(langs)))
    for c, (p, q) in enumerate(model["pairs"]):
        s = sigmoid(2 * rest[:, c])
        votes[:, p] += rest[:, c] > 0
        votes[:, q] += rest[:, c] <= 0
        weight[:, p] += s
        weight[:, q] += 1 - s
    allowed = np.zeros((len(families), len(langs)), dtype=bool)
    for k, members in enumerate(model["members"]):
        allowed[k, members] = True
    # Most votes of the family's pairs; ties go to the larger sum of scores, then to the first language.
    best = np.where(allowed[family], votes * 1e3 + weight, -1.0).argmax(1)
    rivals = np.array([len(m) - 1 for m in model["members"]])[family]
    score = sure * np.where(rivals > 0, weight[np.arange(n), best] / np.maximum(rivals, 1), 1.0)
    known = np.fromiter((t is not None and LETTER.search(t) is not None for t in texts), dtype=bool, count=n)
    return [langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())], np.where(known, np.clip(score, 0, 1), 0.0)


def training_rows(docs: DataFrame, held_out, limit: int = TRAIN_ROWS, most_chars: int = 20_000) -> DataFrame:
    """About ``limit`` rows (lang, text) of each language, fewer beyond ALL_ROWS, in seeded order.

    A hash threshold a language draws its rows; the bound on all rows is exact.
    Of a text of more than ``most_chars`` characters a stretch drawn by hash is taken.
    """
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", stretch(F.col("text"), F.col("doc_id"), most_chars).alias("text"), F.xxhash64(F.lit(9), "doc_id", "text").alias("o"))
    sizes = [(r.lang, r["count"]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    limit = min(limit, max(LEAST_ROWS, ALL_ROWS // max(1, len(sizes))))
    if not sizes:
        return rows.select("lang", "text").limit(0)
    share = F.create_map(*[x for lang, n in sizes for x in (F.lit(lang), F.lit(min(1.0, limit / n)))])
    drawn = rows.where(F.pmod("o", F.lit(1 << 30)) < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 30))
    return drawn.orderBy("o", "lang", "text").limit(int(limit * 1.1 * len(sizes)) + 1).select("lang", "text")


def identify(docs: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs (doc_id, text, lang)."""
    held = remainder_of_crc(F.col("doc_id"), 5) == 0
    model = docs.sparkSession.sparkContext.broadcast(trained(training_rows(docs, held, limit), lambda rows: train(list(rows))))
    rows = docs.select("doc_id", "text")

    def run(batches):
        for part, texts in in_pieces(batches, most_chars=2_000_000):
            langs, scores = predict(texts, model.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    scored = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", (remainder_of_crc(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
