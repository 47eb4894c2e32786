"""Per-device allocator: group commit batches, sequential pages, region rotation.

Requests of a device are a sequence: a task takes a device's rows in their
order, as Arrow batches, and holds the open batch of at most ``MAX_REQUESTS``
requests only.  Only lengths are in the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

PAGE = 4096
MAX_REQUESTS = 512
WATERMARK_PAGES = 16
SCHEMA = "dev int, seq long, part int, part_pages long, batch int, region int, epoch long, page long"


def closed(pages: Iterable[int], batch_min: int, batch_room: int, queue: int = MAX_REQUESTS) -> Iterator[list[int]]:
    """Pages of each batch: it closes at the most requests, at ``batch_min`` bytes, or where the next does not fit its room."""
    members, used = [], 0
    for n in pages:
        if len(members) >= queue or used >= batch_min or (members and used + n * PAGE > batch_room):
            yield members
            members, used = [], 0
        members.append(n)
        used += n * PAGE
    if members:
        yield members


def batches(pages: list[int], batch_min: int, batch_room: int, queue: int = MAX_REQUESTS) -> list[list[int]]:
    """Indexes of each batch."""
    out, at = [], 0
    for members in closed(pages, batch_min, batch_room, queue):
        out.append(list(range(at, at + len(members))))
        at += len(members)
    return out


def allocate(parts: DataFrame, region_pages: int, region_cnt: int, batch_min: int = 256 << 10, batch_room: int = 4 << 20) -> DataFrame:
    """Rows (dev, seq, part, part_pages) with batch, region, epoch, page in region; pages of page 0 of a region are its head."""

    def of_device(rows):
        """Rows of one device, in order, with their places."""
        waiting = []

        def pages():
            for row in rows:
                waiting.append(row)
                yield row[3]

        region, epoch, cursor, done = 0, 1, 1, 0
        for number, members in enumerate(closed(pages(), batch_min, batch_room)):
            if cursor + sum(members) > region_pages:  # the whole batch must fit
                region, epoch, cursor = (region + 1) % region_cnt, epoch + 1, 1
            for n in members:
                yield (*waiting[done], number, region, epoch, cursor)
                cursor += n
                done += 1
            del waiting[:done]
            done = 0

    def run(found):
        rows = (row for b in found for row in zip(*(c.to_pylist() for c in b.columns)))
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        out = []
        for _, own in groupby(rows, lambda r: r[0]):
            for placed in of_device(own):
                out.append(placed)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = parts.selectExpr("CAST(dev AS INT) AS dev", "seq", "CAST(part AS INT) AS part", "CAST(part_pages AS LONG) AS part_pages")
    return rows.repartition("dev").sortWithinPartitions("dev", "seq", "part").mapInArrow(run, SCHEMA)
