"""Induced suffix sorting with disk-backed queues that carry suffixes and common-prefix lengths.

Suffixes are put in order by induction: the order of the suffixes that start at a
local minimum (LMS) induces that of all others in two sweeps over the alphabet.
The suffix in front of each one swept goes into a priority queue under its first
character, with the length of the prefix it shares with its predecessor there.
Keys only grow (or only fall) during a sweep, so the queue is an append-only run
per character; beyond a memory limit the runs move to disk. LMS suffixes are
named by a first induction over their substrings, and the string of names is
sorted in turn: by the same induction while its alphabet is small, otherwise by
prefix doubling, in which every round is one sort.

Each sweep takes a whole run of a character at a time, so the work per suffix is
a handful of array operations.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Bytes that a queue holds in memory before it moves to disk: less than the queues of a shard of 8 MB need.
MEMORY = 4 << 20
#: Alphabets up to this size are swept character by character.
SMALL_ALPHABET = 1024


class DiskQueue:
    """Runs of (position, shared prefix) per character; in order of insertion within a character."""

    #: How often any queue of this process has moved to disk.
    total_spills = 0

    def __init__(self, keys: int, kind: type, memory: int = MEMORY):
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(keys)]
        self.kind, self.memory, self.held, self.folder = kind, memory, 0, None
        self.spills = 0

    def push(self, key: int, at: np.ndarray, lcp: np.ndarray) -> None:
        if len(at):
            self.parts[key].append((at, lcp))
            self.held += at.nbytes + lcp.nbytes
            if self.held > self.memory:
                self._spill()

    def _spill(self) -> None:
        self.folder = self.folder or Path(tempfile.mkdtemp(prefix="suffixes-"))
        self.spills += 1
        DiskQueue.total_spills += 1
        for key, parts in enumerate(self.parts):
            for k, name in enumerate(("at", "lcp")):
                if parts:
                    with open(self.folder / f"{key}.{name}", "ab") as f:
                        for p in parts:
                            p[k].tofile(f)
            parts.clear()
        self.held = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """All of a character's entries; they leave the queue."""
        parts, self.parts[key] = self.parts[key], []
        self.held -= sum(a.nbytes + b.nbytes for a, b in parts)
        files = [self.folder / f"{key}.{x}" for x in ("at", "lcp")] if self.folder else []
        if files and files[0].exists():
            parts = [(np.fromfile(files[0], self.kind), np.fromfile(files[1], np.uint8)), *parts]
            for f in files:
                f.unlink()
        if not parts:
            return np.zeros(0, self.kind), np.zeros(0, np.uint8)
        return tuple(np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts, strict=True))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is below the one that follows it (type S); the last is not."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    step = np.flatnonzero(text[1:] != text[:-1])
    up = text[step] < text[step + 1]
    # within a run of one character all are as its last; the run at the end falls
    edges = np.concatenate([[0], step + 1])
    out[: edges[-1]] = np.repeat(up, np.diff(edges))
    return out


class _Sweep:
    """One direction of the induction."""

    def __init__(self, text: np.ndarray, up: np.ndarray, want: bool, keys: int, cap: int, memory: int, kind: type):
        self.text, self.up, self.want, self.cap = text, up, want, cap
        self.queue = DiskQueue(keys, kind, memory)
        self.least = np.zeros(keys, np.uint8)  # of what was swept since the last push of a key
        self.last = None

    def seam(self, at: int) -> int:
        """What the next suffix to be swept shares with the last one."""
        return 0 if self.last is None or self.cap == 0 else common_prefix(self.text, self.last, at, self.cap)

    def run(self, at: np.ndarray, lcp: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Sweep suffixes in order; push those in front of them and return those that begin with ``own`` again."""
        self.last = int(at[-1])
        source = np.flatnonzero(at > 0)
        front = at[source] - 1
        fits = self.up[front] == self.want
        source, front = source[fits], front[fits]
        same = np.zeros(0, at.dtype), np.zeros(0, np.uint8)
        first = self.text[front]
        order = np.argsort(first, kind="stable")
        ranked = first[order]
        start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        keys, bounds = ranked[start], np.append(start, len(order))
        if self.cap == 0:
            for k, key in enumerate(keys.tolist()):
                at = front[order[bounds[k] : bounds[k + 1]]]
                if key == own:
                    same = at, np.zeros(len(at), np.uint8)
                else:
                    self.queue.push(key, at, np.zeros(len(at), np.uint8))
            return same
        before = self.least.copy()
        np.minimum(self.least, lcp.min(), out=self.least)
        for k, key in enumerate(keys.tolist()):
            mine = order[bounds[k] : bounds[k + 1]]
            rank = source[mine]
            edge = np.concatenate([[0], rank[:-1] + 1])
            shared = np.minimum.reduceat(lcp[: rank[-1] + 1], edge)
            shared[0] = min(shared[0], before[key])
            tail = lcp[rank[-1] + 1 :]
            self.least[key] = tail.min() if len(tail) else 255
            shared = np.minimum(shared.astype(np.int16) + 1, self.cap).astype(np.uint8)
            if key == own:
                same = front[mine], shared
            else:
                self.queue.push(key, front[mine], shared)
        return same


def common_prefix(text: np.ndarray, a: int, b: int, cap: int) -> int:
    n = min(cap, len(text) - max(a, b))
    differ = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(differ[0]) if len(differ) else n


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    out = np.zeros(len(a), np.uint8)
    live, n = np.arange(len(a)), len(text)
    for k in range(cap):
        x, y = a[live] + k, b[live] + k
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        live = live[ok]
        if not len(live):
            break
        out[live] += 1
    return out


def _induce(text: np.ndarray, up: np.ndarray, lms: np.ndarray, lms_lcp: np.ndarray, keys: int, cap: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, shared prefixes) of all suffixes, bucket by bucket from the last character to the first."""
    kind = lms.dtype.type
    lms_cut = np.searchsorted(text[lms], np.arange(keys + 1)) if len(lms) else np.zeros(keys + 1, np.int64)
    forward = _Sweep(text, up, False, keys, cap, memory, kind)
    falling = DiskQueue(keys, kind, memory)
    forward.queue.push(int(text[-1]), np.array([len(text) - 1], kind), np.zeros(1, np.uint8))
    backward = _Sweep(text, up, True, keys, cap, memory, kind)
    try:
        for key in range(keys):
            at, lcp = forward.queue.pop(key)
            while len(at):
                lcp[0] = min(forward.seam(int(at[0])), cap)
                falling.push(key, at, lcp)
                at, lcp = forward.run(at, lcp, key)
            a, b = lms_cut[key], lms_cut[key + 1]
            if b > a:
                lcp = lms_lcp[a:b].copy()
                lcp[0] = forward.seam(int(lms[a]))
                forward.run(lms[a:b], lcp, key)
        for key in range(keys - 1, -1, -1):
            rounds = []
            at, lcp = backward.queue.pop(key)
            while len(at):
                lcp[0] = backward.seam(int(at[0]))
                rounds.append((at, lcp))
                at, lcp = backward.run(at, lcp, key)
            low, low_lcp = falling.pop(key)
            seam = 0
            if len(low):
                # swept downwards, each shares with the one above it what that one shares with it
                down = np.empty_like(low_lcp)
                down[0] = seam = backward.seam(int(low[-1]))
                down[1:] = low_lcp[:0:-1]
                backward.run(low[::-1], down, key)
            if not rounds and not len(low):
                continue
            if rounds:
                high, high_lcp = (np.concatenate(x)[::-1] for x in zip(*rounds, strict=True))
                shared = np.empty_like(high_lcp)
                shared[1:] = high_lcp[:-1]
                shared[0] = seam if len(low) else 0
                low_lcp = low_lcp.copy()
                if len(low_lcp):
                    low_lcp[0] = 0
                yield np.concatenate([low, high]), np.concatenate([low_lcp, shared])
            else:
                low_lcp = low_lcp.copy()
                low_lcp[0] = 0
                yield low, low_lcp
    finally:
        for q in (forward.queue, falling, backward.queue):
            q.close()


def _names(text: np.ndarray, up: np.ndarray, lms: np.ndarray, keys: int, memory: int) -> tuple[np.ndarray, int]:
    """Ranks of the LMS substrings, by position, and how many there are."""
    by_first = lms[np.argsort(text[lms], kind="stable")]
    is_lms = np.zeros(len(text) + 1, bool)
    is_lms[lms] = True
    parts = [at[is_lms[at]] for at, _ in _induce(text, up, by_first, np.zeros(len(lms), np.uint8), keys, 0, memory)]
    order = np.concatenate(parts[::-1])
    size = np.empty(len(text), lms.dtype)
    size[lms] = np.diff(np.append(lms, len(text))) + 1
    a, b = order[:-1], order[1:]
    same = (size[a] == size[b]) & (np.maximum(a, b) + size[a] <= len(text))
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        ok = text[a[live] + k] == text[b[live] + k]
        same[live[~ok]] = False
        k += 1
        live = live[ok]
        live = live[size[a[live]] > k]
    rank = np.concatenate([[0], np.cumsum(~same)])
    out = np.empty(len(text), lms.dtype)
    out[order] = rank
    return out[lms], int(rank[-1]) + 1


def _double(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names``, right to ``depth`` items, by prefix doubling."""
    n, reach = len(names), 1
    rank = names.astype(np.int64) + 1
    order = np.argsort(rank)
    while reach < depth:
        after = np.zeros(n, np.int64)
        after[: max(n - reach, 0)] = rank[reach:]
        key = rank * (n + 2) + after
        order = np.argsort(key)
        ranked = key[order]
        rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]]))
        reach *= 2
        if rank[order[-1]] == n:
            break
    return order


def suffix_buckets(text: np.ndarray, keys: int = 256, cap: int = 255, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffix array of ``text`` with common-prefix lengths, bucket by bucket from the last character to the first.

    Within a bucket suffixes ascend, right to their first ``cap`` items; lengths are those shared with the
    suffix before, at most ``cap`` (at most 255), and 0 for the first of a bucket.
    """
    n = len(text)
    if not n:
        return
    kind = np.int32 if n < 2**31 - 2 else np.int64
    up = rising(text)
    lms = (np.flatnonzero(up[1:] & ~up[:-1]) + 1).astype(kind)
    lcp = np.zeros(len(lms), np.uint8)
    if len(lms) > 1:
        names, count = _names(text, up, lms, keys, memory)
        if count == len(lms):
            order = np.argsort(names)
        elif count <= SMALL_ALPHABET and cap // 2 + 2 <= 255:
            order = np.concatenate([at for at, _ in suffix_buckets(names, count, cap // 2 + 2, memory)][::-1])
        else:
            order = _double(names, cap // 2 + 2)
        lms = lms[order]
        lcp[1:] = common_prefixes(text, lms[:-1], lms[1:], cap)
    yield from _induce(text, up, lms, lcp, keys, cap, memory)


def suffix_array(text: np.ndarray, keys: int = 256, cap: int = 255, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of ``suffix_buckets`` in ascending order."""
    found = list(suffix_buckets(text, keys, cap, memory))[::-1]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


__all__ = ["DiskQueue", "common_prefix", "suffix_array", "suffix_buckets"]
