"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources, by code point with null last, have weights 5, 2, 1, repeating.
They share all sizes by weight; a target stops at ``MAX_EPOCHS`` times its
source's size and the excess is reshared by weight, which settles at
min(cap, level * weight) for the one level at which the targets add up.

Take: a source's documents are all taken as often as its target holds its whole
size; the remaining budget is fitted by a choice of documents.  Documents are
counted by exact length.  A seeded base share of each length's count is a first
choice; a bounded-knapsack dynamic programme over the counts then gives
documents back or takes more, so that the sum comes nearest to the budget.  It
may move one copy of each length at first, then twice as many, until the budget
is met or all copies may move, when the result is the nearest that any choice
has.  Lengths are divided by their common divisor.  Only if the programme's bit
sets would hold more than ``WORK_BITS`` bits does it stop at the nearest sum
found so far.  Which documents of a length are taken follows from their seeded hash.

A (source, length) with very many rows is cut by hash into buckets of about
``BUCKET_ROWS`` rows before rows are ranked.

Defined cases: a null or empty text has size 0 and is taken 0 times; sources
of size 0 have target 0; rows with equal or null ids are told apart by their row
number, so reruns over the same files agree; an empty table gives
an empty result.  Other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, written
from palimpsest.operators.running import running_sum

#: Fixed value: the weights, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240101
#: Bits of all reachable-sum sets of one round of the programme (256 MB).
WORK_BITS = 1 << 31
BUCKET_ROWS = 100_000


def size_of(text: Column) -> Column:
    """Words of the text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _placed(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``, its row's number in this order from 0: ranges are counted, no task sees all rows."""
    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("m", 33)
    # One row a partition of the range.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = local.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return local.join(F.broadcast(parts), part == F.col("part")).select(*df.columns, (F.col("ahead") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of a table with columns source, size."""
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    weighed = _placed(per, F.col("source").asc_nulls_last()).withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_EPOCHS).drop("place")
    # In order of cap / weight the capped sources come first: level k is what the rest would get if all before k were capped.
    ranked = _placed(weighed, F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = running_sum(running_sum(ranked, [], F.col("cap"), "caps", False, "place"), [], F.col("weight"), "weights", False, "place")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole.size or 0) - F.col("caps")) / (F.lit(whole.weight or 0) - F.col("weights"))
    # The first source in that order that the level leaves under its cap has the level that holds.
    found = ranked.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct((F.col("cap") / F.col("weight")).alias("order"), "level")).alias("found")).first().found
    held = F.lit(found.level if found else None).cast("double")
    return ranked.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.coalesce(held * F.col("weight"), F.col("cap").cast("double")))).alias("target"))


def _moves(gap: int, lengths: list[int], back: list[int], more: list[int]) -> tuple[int, list[int], bool]:
    """(distance to ``gap``, copies by which each length's count changes, whether all lengths were tried).

    Bounded knapsack on bit sets.  A length may change by -back to +more copies;
    ``lengths`` ascend, so that sums stay short.  Lengths beyond ``WORK_BITS`` are not tried.
    """
    reach, offset, held, whole, steps = 1, 0, 0, True, []  # bit s of reach: the sum s - offset can be had
    for k, length in enumerate(lengths):
        left, part = back[k] + more[k], 1
        offset += back[k] * length
        while left > 0:  # binary parts of the count
            part = min(part, left)
            steps.append((k, part, length * part, reach))
            held += reach.bit_length()
            reach |= reach << (length * part)
            left -= part
            part *= 2
        whole = held <= WORK_BITS
        if not whole or (gap + offset >= 0 and reach >> (gap + offset) & 1):
            lengths = lengths[:k + 1]
            break
    at = max(0, gap + offset)
    low, high = (reach & ((1 << (at + 1)) - 1)).bit_length() - 1, reach >> at
    best = low if not high or (low >= 0 and gap + offset - low <= at + (high & -high).bit_length() - 1 - (gap + offset)) else at + (high & -high).bit_length() - 1
    distance, change = abs(best - gap - offset), [0] * len(lengths)
    for k, part, weight, had in reversed(steps):
        if not had >> best & 1:
            change[k] += part
            best -= weight
    return distance, [c - b for c, b in zip(change, back)], whole


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come nearest to ``budget``."""
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(x * n for x, n in zip(lengths, counts))
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return np.array(counts, dtype=np.int64)
    unit = math.gcd(*(x for x, n in zip(lengths, counts) if n))
    goal = (2 * budget + unit) // (2 * unit)  # sums are multiples of unit: the nearest one is aimed at
    order = sorted((k for k, x in enumerate(lengths) if x > 0 and counts[k] > 0), key=lambda k: lengths[k])
    size = [lengths[k] // unit for k in order]
    count = [counts[k] for k in order]
    taken = [n * budget // total for n in count]
    gap = goal - sum(x * n for x, n in zip(size, taken))
    for j in reversed(range(len(size))):  # largest first, as long as they fit
        n = max(0, min(count[j] - taken[j], gap // size[j]))
        taken[j] += n
        gap -= n * size[j]
    room = 1
    while gap:
        back, more = [min(n, room) for n in taken], [min(c - n, room) for c, n in zip(count, taken)]
        distance, change, whole = _moves(gap, size, back, more)
        if distance < abs(gap) or not distance:
            for j, c in enumerate(change):
                taken[j] += c
                gap -= c * size[j]
        if not distance or not whole or all(b == n and m == c - n for b, m, n, c in zip(back, more, taken, count)):
            break
        if room >= max(count):
            break
        room *= 2
    out = np.zeros(len(lengths), dtype=np.int64)
    out[order] = taken
    return out


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    epochs = min(MAX_EPOCHS, int(target // size)) if size else 0
    budget = int(round(target - epochs * size)) if epochs < MAX_EPOCHS else 0
    pdf = pdf.sort_values("size")
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "source_size": size, "target": target, "epochs": epochs, "extra": choose(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget)})


def mix(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, at, and what else is to be carried) with source_size, target and taken.

    ``at`` numbers the rows: by it null ids, which are no order, are dealt and ranked.
    """
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    wanted = targets(counts.select("source", (F.col("size") * F.col("n")).alias("size")))
    wanted = wanted.withColumnRenamed("source", "s")
    full = counts.join(wanted, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target")
    plan = full.groupBy("source").applyInPandas(_plan, "source string, size long, source_size long, target double, epochs int, extra long")
    plan = written(plan, "mix-plan").withColumnsRenamed({"source": "plan_source", "size": "plan_size"})

    n = rows.count()
    buckets = max(64, n // BUCKET_ROWS)
    seeded = rows.withColumn("__h", F.xxhash64(F.lit(SEED), "doc_id", F.when(F.col("doc_id").isNull(), F.col("at")))).withColumn("__bucket", F.pmod(F.col("__h"), F.lit(buckets)))
    cells = seeded.groupBy("source", "size", "__bucket").agg(F.count(F.lit(1)).alias("in_cell"))
    before = Window.partitionBy("source", "size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("in_cell").over(before), F.lit(0))).withColumnsRenamed({"source": "s", "size": "z", "__bucket": "b"})
    cell_plan = cells.join(plan, F.col("s").eqNullSafe(F.col("plan_source")) & (F.col("z") == F.col("plan_size"))).select("s", "z", "b", "ahead", "source_size", "target", "epochs", "extra")
    ranked = seeded.withColumn("__rank", F.row_number().over(Window.partitionBy("source", "size", "__bucket").orderBy("__h", "doc_id", "at")))
    joined = ranked.join(cell_plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("__bucket") == F.col("b")))
    times = F.col("epochs") + F.when(F.col("ahead") + F.col("__rank") <= F.col("extra"), 1).otherwise(0)
    return joined.select(*rows.columns, "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken and source."""
    rows = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("at")), "mix-sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
