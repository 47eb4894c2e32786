"""Benchmark decontamination by template canonicalisation.

Texts become tokens (words and numbers, lower-cased).  In the template of a
text, numbers, units that follow a number, and names (capitalised words inside a
sentence) are typed placeholders.  Windows of ``WINDOW`` template tokens, and of
the plain tokens (so that a change of case or of a sentence's start loses
nothing), are looked up in a hash table of the benchmark's windows.  Where at
least ``COVERAGE`` of an item's windows occur in a document, the slots are
compared: along an alignment, each value of the item must stand for one value
of the document, and windows that break this do not count.  Alignments are tried
from the one with the most windows until one is consistent, so an item is also
found beside other instances of its template.  So questions with other numbers
or names, used consistently, are caught.  Where a document has some of the
items' windows, runs of names and of number words ("Mary Jane", "twenty five")
are taken as one slot in a second comparison.

The benchmark is the stated query set: its windows are broadcast in blocks of
items with at most ``BLOCK_WINDOWS`` windows each, one pass over the documents
per block.  Everything about one document is decided in its own row: nothing is
shuffled.

Defined cases: null or empty texts and items match nothing; an item of fewer
tokens than a window (in Chinese, Japanese and Thai every character is a token)
matches only a document whose whole token sequence equals it, as a few words
alone are in many clean texts; several copies of an item in a document are one
match, at the first consistent place; repeated rows of ``docs`` and repeated items give a row each; columns beyond the
id and text are ignored or carried, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import released
from palimpsest.llm.textclf import in_pieces

WINDOW = 5
COVERAGE = 0.8
BLOCK_WINDOWS = 500_000

#: Units that may follow a number, and numbers as words.
UNITS = frozenset("mm cm m km in inch inches ft feet foot yard yards mile miles g kg mg gram grams lb lbs pound pounds oz ounce ounces l ml liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur mph kmh hz khz mhz ghz kb mb gb tb w kw v volt volts degree degrees".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())

#: Fixed value: characters of scripts without spaces between words (Thai, kana, Han).
UNSPACED = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d]+|[.!?\n]")
TOKEN_UNSPACED = re.compile(rf"\d+(?:[.,]\d+)*|[^\W\d{UNSPACED}]+|[{UNSPACED}]|[.!?\n]")
ANY_UNSPACED = re.compile(f"[{UNSPACED}]")
NUMBER, UNIT, NAME, BREAK, SPELT = 1, 2, 4, 8, 16
_SLOT = {NUMBER: 0x1234567, UNIT: 0x2345678, NAME: 0x3456789}
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


class Tokens(dict):
    """Token to hash << 5 | what it may be; bounded."""

    limit = 400_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        low = token.lower()
        if token in ".!?\n":
            flags = BREAK
        elif token[0].isdigit() or low in NUMBERS:
            flags = NUMBER | (0 if token[0].isdigit() else SPELT)
        else:
            flags = (UNIT if low in UNITS else 0) | (NAME if len(token) > 1 and token[0].isupper() and token[1:].islower() else 0)
        code = self[token] = (xxhash.xxh64_intdigest(low.encode(), 3) >> 6 << 5) | flags
        return code


def canonical(text: str | None, cache: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(plain codes, template codes, slot kind or 0, run) of the tokens of one text.

    ``run`` is NAME or SPELT where a token is a name or a number word, else 0.
    """
    get = cache.__getitem__
    pattern = TOKEN if not text or text.isascii() or not ANY_UNSPACED.search(text) else TOKEN_UNSPACED
    found = pattern.findall(text) if text else []
    codes = np.fromiter(map(get, found), dtype=np.int64, count=len(found))
    flags = codes & 31
    is_break = flags == BREAK
    opens = np.ones(len(codes), dtype=bool)
    opens[1:] = is_break[:-1]
    words = ~is_break
    codes, flags, opens = codes[words] >> 5, flags[words], opens[words]
    number = flags & NUMBER > 0
    unit = np.zeros(len(codes), dtype=bool)
    unit[1:] = (flags[1:] & UNIT > 0) & number[:-1]
    name = (flags & NAME > 0) & ~opens & ~unit
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, 0)))
    template = codes.copy()
    for k, code in _SLOT.items():
        template[kind == k] = code
    return codes, template, kind, np.where(name, NAME, flags & SPELT)


def merged(codes, template, kind, run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plain codes, template codes, slot kind) with each run of names, or of number words, as one token."""
    first = np.ones(len(codes), dtype=bool)
    first[1:] = (run[1:] == 0) | (run[1:] != run[:-1])
    if first.all():
        return codes, template, kind
    at = np.flatnonzero(first)
    place = np.arange(len(codes)) - np.repeat(at, np.diff(np.append(at, len(codes))))
    # A run's code depends on all its tokens, in order; one token keeps its own.
    mixed = (codes.astype(np.uint64) * _POWERS[place % len(_POWERS)] >> np.uint64(6)).astype(np.int64)
    joined = np.add.reduceat(np.where(place > 0, mixed, codes), at) & ((1 << 58) - 1)
    return joined, template[at], kind[at]


def window_hashes(codes: np.ndarray, size: int = WINDOW) -> np.ndarray:
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    u, out = codes.astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += (u[j:j + n] + np.uint64(1)) * _POWERS[j]
    return (out ^ (out >> np.uint64(29))) * _POWERS[0]


class Index:
    """Windows of some items: sorted hashes, with item and place of each; ``runs`` merges runs in them."""

    def __init__(self, items: list[tuple], runs: bool = False):
        cache, hashes, owner, place = Tokens(), [], [], []
        self.items, self.short, self.of_runs, self.changed = [], {}, None if runs else Index(items, True), False
        for item_id, text in items:
            found = canonical(text, cache)
            codes, template, kind = merged(*found) if runs else found[:3]
            self.changed |= len(codes) < len(found[0])
            if len(codes) < WINDOW:
                if len(codes):
                    self.short.setdefault(codes.tobytes(), []).append(item_id)
                continue
            for h in (window_hashes(template), window_hashes(codes)):
                hashes.append(h)
                owner.append(np.full(len(h), len(self.items)))
                place.append(np.arange(len(h)))
            self.items.append((item_id, codes, kind))
        self.windows = np.array([len(c) - WINDOW + 1 for _, c, _ in self.items], dtype=np.int64)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, np.int64))[order]
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, row of the index) of every match of the hashes at ``at``."""
        at = np.flatnonzero(self.sieve[(h >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(self.hashes, h[at], "left")
        count = np.searchsorted(self.hashes, h[at], "right") - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(at) else low
        return np.repeat(at, count), rows

    def matches(self, text: str | None, cache: Tokens) -> list[tuple]:
        """(item id, windows, windows matched, windows consistent, exact, start) of the items found in a text."""
        codes, template, kind, run = canonical(text, cache)
        if len(codes) < WINDOW:
            return [(i, 1, 1, 1, True, 0) for i in self.short.get(codes.tobytes(), ())] if len(codes) else []
        found = self._search(codes, template)
        if found is None:  # no window of any item
            return []
        have, one = {m[0] for m in found}, merged(codes, template, kind, run)
        if len(one[0]) == len(codes) and not self.of_runs.changed:  # no run on either side
            return found
        return found + [m for m in self.of_runs._search(*one[:2]) or () if m[0] not in have]

    def _search(self, codes: np.ndarray, template: np.ndarray) -> list[tuple] | None:
        if not len(self.hashes) or len(codes) < WINDOW:
            return None
        both = [window_hashes(template), window_hashes(codes)]
        # Distinct hashes first: repeats in a document must not multiply items.
        hits = [np.flatnonzero(self.sieve[(h >> np.uint64(42)).astype(np.int64)]) for h in both]
        if not any(len(a) for a in hits):
            return None
        distinct = np.unique(np.concatenate([h[a] for h, a in zip(both, hits)]))
        _, rows = self.lookup(distinct)
        if not len(rows):
            return None
        width = int(self.windows.max())
        seen = np.unique(self.owner[rows] * width + self.place[rows])
        owner, matched = np.unique(seen // width, return_counts=True)
        good = matched >= COVERAGE * self.windows[owner]
        return [m for k, n in zip(owner[good].tolist(), matched[good].tolist()) if (m := self._aligned(k, n, codes, both))]

    def _aligned(self, k, matched, codes, both):
        item_id, item_codes, _ = self.items[k]
        n, runs = int(self.windows[k]), []
        votes = np.zeros(n + len(both[0]), dtype=np.int64)  # at shift + n; a shift is a document's position less the item's place
        for h, mine in zip(both, (self._template(k), window_hashes(item_codes))):
            at = np.flatnonzero(np.isin(h, mine))
            at = at[np.argsort(h[at], kind="stable")]
            low, high = (np.searchsorted(h[at], mine, side).tolist() for side in ("left", "right"))
            runs.append((at, low, high))
            for place in range(n):
                votes[at[low[place]:high[place]] + (n - place)] += 1
        # Most votes first, a plain window having two; ties go to the earliest.  Most items are settled by the first shift.
        voted = np.flatnonzero(votes)
        voted = voted[np.argsort(-votes[voted], kind="stable")] - n
        start, size = 0, 1
        while start < len(voted):
            shifts = voted[start:start + size]
            consistent, exact = self._consistent(k, codes, both[1], runs, shifts)
            enough = np.flatnonzero(consistent >= COVERAGE * n)
            if len(enough):
                j = enough[0]
                return item_id, n, int(matched), int(consistent[j]), bool(exact[j]), max(0, int(shifts[j]))
            start, size = start + size, min(2 * size, max(1, BLOCK_WINDOWS // (WINDOW * n)))
        return None

    def _consistent(self, k, codes, plain, runs, shifts):
        """(windows consistent, whether all slots keep their values) of item k at each of the shifts.

        A place stands at the position of its window that is nearest to the
        shift; where two are as near, at the plain window's, then the first.  A
        position with other values stands for one place, the nearest.
        """
        _, item_codes, item_kind = self.items[k]
        places, at = [], []
        for place in range(int(self.windows[k])):
            aim, best = shifts + place, None
            for where, low, high in reversed(runs):  # plain windows first
                if high[place] > low[place]:
                    run = where[low[place]:high[place]]
                    j = np.searchsorted(run, aim)
                    before, after = run[np.maximum(j - 1, 0)], run[np.minimum(j, len(run) - 1)]
                    p = np.where(abs(aim - before) <= abs(aim - after), before, after)
                    best = p if best is None else np.where(abs(aim - p) < abs(aim - best), p, best)
            if best is not None:
                places.append(place)
                at.append(best)
        places, at = np.array(places), np.stack(at, axis=1)
        window, step = np.nonzero(item_kind[places[:, None] + np.arange(WINDOW)])
        verbatim = plain[at] == window_hashes(item_codes)[places]
        line = (at + np.arange(len(shifts))[:, None] * (len(plain) + 1)).ravel()
        order = np.lexsort((abs(at - places - shifts[:, None]).ravel(), ~verbatim.ravel(), line))
        counts = verbatim.ravel()
        counts[order[np.concatenate(([True], line[order][1:] != line[order][:-1]))]] = True
        counts = counts.reshape(at.shape)
        if not len(window):
            return counts.sum(1), np.ones(len(shifts), dtype=bool)
        token = places[window] + step
        keys, key = np.unique(np.stack((item_kind[token], item_codes[token])), axis=1, return_inverse=True)
        value = codes[at[:, window] + step]
        # Per shift and value of the item: the most frequent value of the document, the same value first, then the smallest.
        group = (np.arange(len(shifts))[:, None] * keys.shape[1] + key.reshape(-1)).ravel()
        order = np.lexsort((value.ravel(), group))
        g, v = group[order], value.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1]))))
        count, g, v = np.add.reduceat(counts[:, window].ravel()[order].astype(np.int64), first), g[first], v[first]
        same = v == keys[1][g % keys.shape[1]]
        order = np.lexsort((v, ~same, -count, g))
        heads = order[np.concatenate(([True], g[order][1:] != g[order][:-1]))]
        chosen, same = v[heads].reshape(len(shifts), -1), same[heads].reshape(len(shifts), -1)
        s, e = np.nonzero(value != chosen[:, key.reshape(-1)])
        counts[s, window[e]] = False
        return counts.sum(1), same.all(1)

    def _template(self, k):
        _, codes, kind = self.items[k]
        template = codes.copy()
        for s, code in _SLOT.items():
            template[kind == s] = code
        return window_hashes(template)


def _blocks(benchmark: DataFrame):
    block, held = [], 0
    for row in benchmark.select(F.col("item_id"), F.col("text")).toLocalIterator():
        block.append((row.item_id, row.text))
        held += 2 * max(1, len(row.text or "") // 3)
        if held >= BLOCK_WINDOWS:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(row, item_id, n_windows, matched, consistent, exact, start) for each document and item found in it.

    ``row`` is a struct of the columns ``carry`` of docs (by default doc_id).
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry or ["doc_id"]]).alias("row"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("n_windows", T.LongType()), T.StructField("matched", T.LongType()), T.StructField("consistent", T.LongType()), T.StructField("exact", T.BooleanType()), T.StructField("start", T.LongType())])
    names = schema.names[1:]
    out = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(block))

        def run(batches, shared=shared):
            index, cache = shared.value, Tokens()
            for part, texts in in_pieces(batches):
                at, found = [], []
                for k, text in enumerate(texts):
                    for m in index.matches(text, cache):
                        at.append(k)
                        found.append(m)
                if at:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at))] + [pa.array(c) for c in columns], names=["row", *names])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with the columns of ``docs``."""
    out = docs
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))
        rows = out.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), F.col("text").alias("text"))

        def run(batches, shared=shared):
            index, cache = shared.value, Tokens()
            for part, texts in in_pieces(batches):
                at = [k for k, text in enumerate(texts) if not index.matches(text, cache)]
                if at:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at))], names=["row"])

        kept = rows.mapInArrow(released(run), T.StructType([rows.schema["row"]]))
        out = kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return out


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("row.doc_id", "item_id", "n_windows", "matched", "consistent", (F.col("consistent") / F.col("n_windows")).alias("coverage"), "exact", "start")
