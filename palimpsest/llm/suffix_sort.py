"""External induced sorting of a shard's suffixes, with common-prefix values.

The text is many segments, each ended by a separator that is smaller than every
byte and unlike every other separator.  Local minima (S* suffixes) are sorted
first: their substrings are named, and the reduced string of names is ranked by
doubling, as deep as ``depth`` bytes need.  They then induce all suffixes that
descend to a local minimum (L), in ascending order, and those induce the rest
(S), in descending order.  Both passes run on a priority queue whose keys are
first bytes: a batch leaves the queue in order, and the suffixes one byte longer
join the queue of their byte, each with the common-prefix value to the one
before it there, which is one more than the least value passed in between.

Queues hold (position, common prefix) tuples; once they hold ``memory`` bytes,
all of them go to one file of the task's scratch folder, and come back at most
``CHUNK`` tuples at a time.  The L suffixes wait for the second pass in another
such queue.  The text and what belongs to each of its positions are mapped
files.  In memory are the local minima (about a third of the positions) while
they are ranked.  Values are capped at ``depth``: only whether a prefix is shared
that far matters.
"""

from __future__ import annotations

import os
import uuid
from collections import deque

import numpy as np

SEPARATOR = 0


#: Tuples that leave a queue at once.
CHUNK = 1 << 16


class BucketQueue:
    """FIFO queues of (position, common prefix) for each first byte; beyond ``memory`` bytes they go to a file."""

    def __init__(self, scratch: str, memory: int):
        self.path, self.memory, self.held, self.spills = os.path.join(scratch, f"q{uuid.uuid4().hex}"), memory, 0, 0
        self.file, self.end = None, 0
        self.parts: list[deque] = [deque() for _ in range(256)]  # arrays, or (offset, tuples) of the file

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        for k in range(0, len(pos), CHUNK):
            self.parts[c].append((pos[k:k + CHUNK].astype(np.int32), lcp[k:k + CHUNK].astype(np.uint8)))
        self.held += 5 * len(pos)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = open(self.path, "w+b")
        self.file.seek(self.end)
        for parts in self.parts:
            for k, (first, second) in enumerate(parts):
                if isinstance(first, np.ndarray):
                    self.file.write(first.tobytes())
                    self.file.write(second.tobytes())
                    parts[k] = (self.end, len(first))
                    self.end += 5 * len(first)
        self.held, self.spills = 0, self.spills + 1

    def _load(self, first, second) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(first, np.ndarray):
            self.held -= 5 * len(first)
            return first.astype(np.int64), second
        self.file.seek(first)
        data = self.file.read(5 * second)
        return np.frombuffer(data, dtype=np.int32, count=second).astype(np.int64), np.frombuffer(data, dtype=np.uint8, offset=4 * second).copy()

    def pop(self, c: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The first tuples of a queue, at most about CHUNK (one part more); with ``last``, the part at its end."""
        parts, got, n = self.parts[c], [], 0
        while parts and (not n or (not last and n < CHUNK)):
            got.append(self._load(*(parts.pop() if last else parts.popleft())))
            n += len(got[-1][0])
        return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.remove(self.path)


class _Minimum:
    """Range minimum over a batch of small values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over [low, high], with low <= high."""
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=self.rows[0].dtype)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            row = self.rows[level]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << level) + 1])
        return out


class SuffixSorter:
    """Sorts the suffixes of ``text`` (uint8, segments ended by SEPARATOR, no other zero)."""

    def __init__(self, text: np.ndarray, scratch: str, depth: int = 200, memory: int = 1 << 20):
        n = len(text)
        self.depth, self.queue_args, self.scratch, self.spills = depth, (scratch, memory), scratch, 0
        padded = self._mapped("text", n + depth + 16, np.uint8)
        padded[:n] = text
        self.t = padded[:n]
        self.words = np.ndarray(shape=(n + depth + 8,), dtype="<u8", buffer=padded, strides=(1,))
        self.ends = ends = np.flatnonzero(self.t == SEPARATOR)
        self.left = self._mapped("left", n, np.int32)  # bytes before the separator
        self.s_type, self.shared = self._mapped("type", n, np.bool_), self._mapped("shared", n, np.bool_)
        # Segment by segment, from whole segments of about CHUNK bytes.
        cuts, begin = np.concatenate(([0], ends + 1)), 0
        while begin < len(ends):
            stop = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + CHUNK, "right")) - 1)
            a, b = int(cuts[begin]), int(cuts[stop])
            own, size = ends[begin:stop] - a, b - a
            t = np.asarray(self.t[a:b])
            self.left[a:b] = np.repeat(own, np.diff(own, prepend=-1)) - np.arange(size)
            step = np.zeros(size, dtype=np.int8)
            step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
            step[own] = 1
            at = np.where(step != 0, np.arange(size, dtype=np.int32), np.int32(size))
            at = np.minimum.accumulate(at[::-1])[::-1]
            self.s_type[a:b] = step[np.minimum(at, size - 1)] > 0
            begin = stop

    def _mapped(self, name: str, n: int, kind) -> np.ndarray:
        """A file of the scratch folder as an array of zeros; the file is gone with the array."""
        path = os.path.join(self.scratch, f"{name}{uuid.uuid4().hex}")
        out = np.memmap(path, dtype=kind, mode="w+", shape=(max(1, n),))
        os.unlink(path)
        return np.asarray(out)[:n]  # a plain view: cheaper to index

    # Common prefixes by comparison: for local minima and for the seams of batches.
    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), self.depth, dtype=np.int64)
        open_ = np.arange(len(a))
        for d in range(0, self.depth, 8):
            x = self.words[a[open_] + d] ^ self.words[b[open_] + d]
            differ = x != 0
            if differ.any():
                y = x[differ]
                low = y & (~y + np.uint64(1))
                out[open_[differ]] = d + np.frexp(low.astype(np.float64))[1].astype(np.int64) // 8 - (np.frexp(low.astype(np.float64))[1] % 8 == 0)
                open_ = open_[~differ]
            if not len(open_):
                break
        return np.minimum(np.minimum(out, self.depth), np.minimum(self.left[a], self.left[b]))

    def _one(self, a: int, b: int) -> int:
        return int(self.common(np.array([a]), np.array([b]))[0])

    @staticmethod
    def _refine(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> None:
        """Splits the groups of ``rows`` (whole groups; a rank is its group's first place) by ``key``."""
        order = np.argsort((rank[rows].astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64), kind="stable")
        rows, key = rows[order], key[order]
        old = rank[rows]
        first = np.ones(len(rows), dtype=bool)
        first[1:] = old[1:] != old[:-1]
        group = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        new = first.copy()
        new[1:] |= key[1:] != key[:-1]
        part = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        rank[rows] = old + (part - group)

    def _minima(self) -> np.ndarray:
        """Positions of the local minima and separators, sorted as suffixes to ``depth`` bytes."""
        s = self.s_type
        star = np.zeros(len(s), dtype=bool)
        star[1:] = s[1:] & ~s[:-1]
        star[self.ends] = True
        pos = np.flatnonzero(star)
        m = len(pos)
        is_end = self.t[pos] == SEPARATOR
        size = np.zeros(m, dtype=np.int64)
        size[:-1] = pos[1:] - pos[:-1] + 1
        size[is_end] = 1
        rank = np.zeros(m, dtype=np.int64)
        n_ends = int(is_end.sum())
        rank[is_end] = np.arange(n_ends)
        rank[~is_end] = n_ends
        rows, d = np.flatnonzero(~is_end), 0
        # Names: substrings up to the next minimum, compared 8 bytes at a time; a longer one sorts before its prefix.
        while len(rows):
            word = self.words[pos[rows] + d].byteswap()
            inside = np.clip(size[rows] - d, 0, 8)
            mask = np.where(inside >= 8, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.minimum(inside, 7)).astype(np.uint64))
            key = word | mask
            _, dense = np.unique(key, return_inverse=True)
            self._refine(rank, rows, dense.ravel())
            d += 8
            count = np.bincount(rank[rows], minlength=m)
            tied = count[rank[rows]] > 1
            more = np.zeros(m, dtype=bool)
            more[rank[rows][tied & (size[rows] > d)]] = True
            rows = rows[tied & more[rank[rows]]]
        # The reduced string of names, ranked by doubling.
        step, rows = 1, np.flatnonzero(~is_end)
        while True:
            count = np.bincount(rank[rows], minlength=m)
            rows = rows[count[rank[rows]] > 1]
            rows = rows[pos[np.minimum(rows + step, m - 1)] - pos[rows] < self.depth]
            if not len(rows):
                break
            # Whole groups only: a group's members reach equally far.
            key = rank[np.minimum(rows + step, m - 1)].copy()
            self._refine(rank, rows, key)
            step *= 2
        return pos[np.argsort(rank, kind="stable")]

    def _induce(self, seeds, wanted_type: bool, order, keep: bool) -> BucketQueue:
        """Runs one pass; ``seeds`` maps a byte to batches (positions, common prefixes) emitted after the byte's queue.

        With ``keep`` the queue of what was emitted from queues is returned, else an empty one.
        """
        queue, out = BucketQueue(*self.queue_args), BucketQueue(*self.queue_args)
        since = np.zeros(256, dtype=np.int64)  # least value since the queue's last tuple
        cap = self.depth

        def emit(pos, lcp, last):
            """Marks shared prefixes, and queues the suffixes one byte longer."""
            lcp[0] = self._one(last, int(pos[0])) if last >= 0 else 0
            hit = lcp >= cap
            if hit.any():
                self.shared[pos[hit]] = True
                self.shared[pos[np.flatnonzero(hit[1:])]] = True
                if hit[0]:
                    self.shared[last] = True
            before = pos - 1
            ok = np.flatnonzero(before >= 0)
            ok = ok[(self.t[before[ok]] != SEPARATOR) & (self.s_type[before[ok]] == wanted_type)]
            whole = int(lcp.min())
            if not len(ok):
                np.minimum(since, whole, out=since)
                return
            c = self.t[before[ok]]
            by = np.argsort(c, kind="stable")
            at, c = ok[by], c[by]
            starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            ends = np.append(starts[1:], len(c))
            rmq = _Minimum(lcp)
            low = np.empty(len(at), dtype=np.int64)
            low[1:] = at[:-1] + 1
            low[starts] = 0
            value = rmq(low, at).astype(np.int64)
            chars = c[starts].astype(np.int64)
            value[starts] = np.minimum(value[starts], since[chars])
            value = np.minimum(value + 1, cap).astype(np.uint8)
            last_at = at[ends - 1]
            rest = np.full(len(chars), cap, dtype=np.int64)
            inner = last_at < len(lcp) - 1
            if inner.any():
                rest[inner] = rmq(last_at[inner] + 1, np.full(int(inner.sum()), len(lcp) - 1))
            np.minimum(since, whole, out=since)
            since[chars] = rest
            for ch, a, b in zip(chars.tolist(), starts.tolist(), ends.tolist()):
                queue.push(ch, pos[at[a:b]] - 1, value[a:b])

        for c in order:
            last = -1
            while (batch := queue.pop(c)) is not None:
                pos, lcp = batch
                if keep:
                    out.push(c, pos, lcp)
                emit(pos, lcp, last)
                last = int(pos[-1])
            for pos, lcp in seeds(c):
                emit(pos, lcp, last)
                last = int(pos[-1])
            # Between bytes nothing is common.
            since[:] = 0
        self.spills += queue.spills + out.spills
        queue.close()
        return out

    def run(self) -> np.ndarray:
        """Whether each suffix shares its first ``depth`` bytes with another one."""
        if not len(self.t):
            return self.shared
        star = self._minima()
        lcp = np.zeros(len(star), dtype=np.uint8)
        for k in range(1, len(star), CHUNK):
            stop = min(len(star), k + CHUNK)
            lcp[k:stop] = self.common(star[k - 1:stop - 1], star[k:stop])
        first = self.t[star]
        cuts = np.searchsorted(first, np.arange(257))

        def minima(c):
            for a in range(cuts[c], cuts[c + 1], CHUNK):
                b = min(cuts[c + 1], a + CHUNK)
                yield star[a:b].astype(np.int64), lcp[a:b].copy()

        descending = self._induce(minima, False, range(256), True)

        def reverse(c):
            while (batch := descending.pop(c, last=True)) is not None:
                pos, v = batch
                back = np.zeros(len(v), dtype=np.uint8)  # the first one of a batch is compared anew
                back[1:] = v[:0:-1]
                yield pos[::-1], back

        self._induce(reverse, True, range(255, -1, -1), False)
        descending.close()
        return np.asarray(self.shared)
