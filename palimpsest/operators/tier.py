"""Second-level read cache: versioned entries in shards, evicted by SIEVE.

A shard's accesses are a sequence: a task takes a shard's rows in their order,
as Arrow batches.  Shards are many, and hashed, so hot prefixes spread.  The
simulation keeps what the shard holds, which its budget bounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import unsigned_mod, with_mix64

#: An entry's head, a record's, and the size classes.
ENTRY_HEAD, RECORD_HEAD = 56, 12
SIZE_CLASSES = (4 << 10, 16 << 10, 64 << 10, 256 << 10, 1 << 20, 8 << 20)
N_SHARDS, LEAST_SHARD = 64, 1 << 20
ENTRY_MAX = 8 << 20
GUARD = 4096


def entry_cost(n_records: Column, length: Column) -> Column:
    return F.lit(ENTRY_HEAD) + RECORD_HEAD * n_records + length


def size_class(cost: Column) -> Column:
    """Index of the smallest class that holds the entry; -1 is outside the arena."""
    out = F.lit(-1)
    for k, size in reversed(list(enumerate(SIZE_CLASSES))):
        out = F.when(cost <= size, k).otherwise(out)
    return out


def shards_for(budget: int, n: int = N_SHARDS) -> int:
    """Halved while a shard would have less than a MiB."""
    while n > 1 and budget // n < LEAST_SHARD:
        n >>= 1
    return n


def shards_of(budget: Column, n: int = N_SHARDS) -> Column:
    """``shards_for`` of a column."""
    out = F.lit(1)
    while n > 1:
        out = F.when((out == 1) & (F.floor(budget / n) >= LEAST_SHARD), n).otherwise(out)
        n >>= 1
    return out.cast("int")


@dataclass
class _Entry:
    key: tuple
    ver: int
    expire: int
    size: int
    visited: bool = False
    before: "_Entry | None" = None
    after: "_Entry | None" = None


@dataclass
class Sieve:
    """One shard."""

    budget: int
    entry_max: int = ENTRY_MAX
    bytes: int = 0
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    rejected: int = 0
    table: dict = field(default_factory=dict)
    head: _Entry | None = None
    tail: _Entry | None = None
    hand: _Entry | None = None

    def _unlink(self, e: _Entry) -> None:
        if self.hand is e:
            self.hand = e.after
        for a, b, end in ((e.before, e.after, "head"), (e.after, e.before, "tail")):
            if a is None:
                setattr(self, end, b)
            elif end == "head":
                a.after = b
            else:
                a.before = b
        self.bytes -= e.size
        del self.table[e.key]

    def get(self, key: tuple, ver: int, now: int) -> bool:
        """A hit needs the exact version, not expired."""
        e = self.table.get(key)
        if e is None or e.ver != ver or (e.expire and e.expire < now):
            self.misses += 1
            return False
        e.visited = True
        self.hits += 1
        return True

    def put(self, key: tuple, ver: int, expire: int, size: int) -> bool:
        if size <= ENTRY_HEAD or size > self.entry_max or size > self.budget:
            self.rejected += 1
            return False
        old = self.table.get(key)
        if old is not None:
            if old.ver >= ver:
                return True
            self._unlink(old)
        e = self.table[key] = _Entry(key, ver, expire, size, before=self.tail)
        if self.tail is not None:
            self.tail.after = e
        self.tail = e
        self.head = self.head or e
        self.bytes += size
        self._evict(e)
        return True

    def drop(self, key: tuple) -> None:
        if key in self.table:
            self._unlink(self.table[key])

    def _evict(self, fresh: _Entry) -> None:
        for _ in range(GUARD):
            if self.bytes <= self.budget or self.head is None:
                break
            e = self.hand or self.head
            if e is fresh:
                self.hand = e.after
            elif e.visited:
                e.visited = False
                self.hand = e.after
            else:
                after = e.after
                self._unlink(e)
                self.hand = after
                self.evictions += 1


def with_shard(accesses: DataFrame, n_shards: int) -> DataFrame:
    mixed = with_mix64(accesses, F.col("prefix_id").bitwiseXOR(F.shiftleft(F.col("group_idx").cast("long"), 32)), "__m")
    return mixed.withColumn("shard", unsigned_mod(F.col("__m"), n_shards)).drop("__m")


def accesses_of(outcomes: DataFrame) -> DataFrame:
    """From point-in-time outcomes: a hit reads through the tier, a PUT or EVICT invalidates its entry."""
    kind = F.when(F.col("outcome") == "HIT", "read").when(F.col("op").isin("PUT", "EVICT"), "invalidate")
    return outcomes.select("seq", "now_s", "prefix_id", "group_idx", kind.alias("kind"), F.col("seen.seq").alias("ver"), F.col("seen.expire_ts").alias("expire_ts"), entry_cost(F.lit(1), F.col("seen.payload_len")).alias("cost")).where("kind IS NOT NULL")


def simulate(accesses: DataFrame, budget: int, entry_max: int = ENTRY_MAX) -> DataFrame:
    """Per shard: hits, misses, evictions, entries, bytes. A read that misses is put in (read-through)."""
    n = shards_for(budget)
    share, most = budget // n, min(entry_max, budget)

    def run(batches):
        at, shard = None, None
        for batch in batches:
            for number, seq, now, prefix, group, kind, ver, expire, cost in zip(*(c.to_pylist() for c in batch.columns)):
                if number != at:
                    if shard is not None:
                        yield _stats(at, shard)
                    at, shard = number, Sieve(share, most)
                key = (prefix, group)
                if kind == "invalidate":
                    shard.drop(key)
                elif not shard.get(key, ver, now):
                    shard.put(key, ver, expire, cost)
        if shard is not None:
            yield _stats(at, shard)

    dealt = with_shard(accesses, n).select(F.col("shard").cast("int").alias("shard"), "seq", "now_s", "prefix_id", "group_idx", "kind", "ver", "expire_ts", "cost")
    return dealt.repartition(n, "shard").sortWithinPartitions("shard", "seq").mapInArrow(run, "shard int, hits long, misses long, evictions long, rejected long, entries long, bytes long")


def _stats(number: int, shard: Sieve) -> pa.RecordBatch:
    row = {"hits": shard.hits, "misses": shard.misses, "evictions": shard.evictions, "rejected": shard.rejected, "entries": len(shard.table), "bytes": shard.bytes}
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32())] + [pa.array([v], pa.int64()) for v in row.values()], names=["shard", *row])
