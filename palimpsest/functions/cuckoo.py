"""Cuckoo filter: approximate membership with deletes. The exact way is a semi join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.hashing import np_mix64

SLOTS, MAX_KICKS, FILL = 4, 500, 85


class Cuckoo:
    def __init__(self, entries: int):
        self.n = 16
        while self.n < entries // SLOTS * 100 // FILL + 1:
            self.n *= 2
        self.slots = np.zeros((self.n, SLOTS), dtype=np.uint8)
        self.count, self.rng = 0, np.random.default_rng(1)

    @property
    def capacity(self) -> int:
        return self.n * SLOTS

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        fp = (np_mix64(keys ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(255)).astype(np.uint8)
        fp[fp == 0] = 1
        one = (np_mix64(keys) & np.uint64(self.n - 1)).astype(np.int64)
        return fp, one, self._other(one, fp)

    def _other(self, at, fp):
        return ((np.asarray(at).astype(np.uint64) ^ np_mix64(np.asarray(fp))) & np.uint64(self.n - 1)).astype(np.int64)

    def _set(self, at: int, fp: int) -> bool:
        free = np.flatnonzero(self.slots[at] == 0)
        if not len(free):
            return False
        self.slots[at, free[0]] = fp
        self.count += 1
        return True

    def insert(self, key: int) -> bool:
        fp, one, two = (int(x[0]) for x in self._places(np.array([key], dtype=np.uint64)))
        if self._set(one, fp) or self._set(two, fp):
            return True
        at = one
        undo = []
        for _ in range(MAX_KICKS):
            k = int(self.rng.integers(SLOTS))
            undo.append((at, k, int(self.slots[at, k])))
            fp, self.slots[at, k] = int(self.slots[at, k]), fp
            at = int(self._other(np.array([at]), np.array([fp]))[0])
            if self._set(at, fp):
                return True
        for at, k, fp in reversed(undo):  # full: as before
            self.slots[at, k] = fp
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(np.asarray(keys))
        return (self.slots[one] == fp[:, None]).any(1) | (self.slots[two] == fp[:, None]).any(1)

    def delete(self, key: int) -> bool:
        fp, one, two = (int(x[0]) for x in self._places(np.array([key], dtype=np.uint64)))
        for at in (one, two):
            hit = np.flatnonzero(self.slots[at] == fp)
            if len(hit):
                self.slots[at, hit[0]] = 0
                self.count -= 1
                return True
        return False


#: Keys that a filter is meant to hold, and tasks that share a filter's probes.
FILTER_KEYS, SALTS = 50_000, 4


def maybe_in(probes: DataFrame, key: Column, keys: DataFrame, column: str) -> DataFrame:
    """Probes that may be among ``keys``: no false negatives, few false positives; null keys match nothing.

    Keys and probes are dealt by hash, about FILTER_KEYS distinct keys a filter.  A
    task reads a filter's keys, which come first, and streams its probes past it,
    so it holds one filter and one batch.  A filter's probes are dealt to SALTS tasks.
    """
    held = keys.select(F.col(column).cast("long").alias("__k")).where("__k IS NOT NULL").distinct()
    filters = max(1, -(-held.count() // FILTER_KEYS))
    deal = F.pmod(F.xxhash64("__k"), F.lit(filters)).alias("__f")
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in probes.columns])
    asked = probes.select(key.cast("long").alias("__k"), row.alias("row")).where("__k IS NOT NULL")
    asked = asked.select(deal, F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("__s"), F.lit(1).alias("__o"), "__k", "row")
    told = held.select(deal, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"), F.lit(0).alias("__o"), "__k", F.lit(None).cast(asked.schema["row"].dataType).alias("row"))

    def run(batches):
        at, pending, filt = None, [], None
        for batch in batches:
            deals = batch.column(0).to_numpy() * SALTS + batch.column(1).to_numpy()
            kinds, values = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (deals[1:] != deals[:-1]) | (kinds[1:] != kinds[:-1]))))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(deals)]):
                if deals[a] != at:
                    at, pending, filt = deals[a], [], None
                if kinds[a] == 0:
                    pending.append(values[a:b])
                elif pending or filt is not None:
                    if filt is None:
                        known = np.concatenate(pending)
                        filt, pending = Cuckoo(2 * len(known)), []
                        for value in known.tolist():
                            filt.insert(value & ((1 << 64) - 1))
                    hit = np.flatnonzero(filt.contains(values[a:b].view(np.uint64)))
                    yield pa.RecordBatch.from_arrays([batch.column(4).slice(a, b - a).take(pa.array(hit))], names=["row"])

    sorted_ = told.unionByName(asked).repartition("__f", "__s").sortWithinPartitions("__f", "__s", "__o")
    found = sorted_.mapInArrow(run, T.StructType([asked.schema["row"]]))
    return found.select(*[F.col("row").getField(c).alias(c) for c in probes.columns])
