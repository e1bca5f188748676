"""Front-coded sorted runs of strings and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

import numpy as np


def sorted_order(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix as strings, by eight bytes at a time."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    columns = padded.view(">u8").astype(np.uint64)
    return np.lexsort(columns.T[::-1])


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before; none for the first."""
    out = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        first = differs.argmax(1)
        out[1:] = np.where(differs.any(1), first, rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Common prefixes of a sorted run, and what follows them in each row."""
    shared = common_prefixes(rows)
    return shared.tobytes(), rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]].tobytes()


def decode(shared: bytes, rest: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a run and their common prefixes."""
    lengths = np.frombuffer(shared, np.uint8)
    rows = np.zeros((len(lengths), width), np.uint8)
    own = np.arange(width)[None, :] >= lengths[:, None]
    rows[own] = np.frombuffer(rest, np.uint8)
    # A byte that is not a row's own is that of the last row before it that has one.
    at = np.where(own, np.arange(len(rows))[:, None], 0)
    np.maximum.accumulate(at, axis=0, out=at)
    return np.take_along_axis(rows, at, axis=0), lengths


def _difference(a: bytes, b: bytes, start: int, width: int) -> int:
    """First place from start on where two strings differ."""
    while start < width and a[start] == b[start]:
        start += 1
    return start


def merge(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, place in the run and common prefix with the string before, for all strings in order.

    A run is its strings, sorted, and each one's common prefix with the one before. In
    the tree each loser keeps how much it shares with the string that beat it. Of two strings, the
    one that shares more with the last string out is the smaller; only where both share as much are
    bytes compared, and those from there on.
    """
    count = len(runs)
    total = sum(len(r[0]) for r in runs)
    out_run, out_place, out_shared = np.zeros(total, np.int32), np.zeros(total, np.int64), np.zeros(total, np.uint8)
    if not total:
        return out_run, out_place, out_shared
    size = 1 << max(0, count - 1).bit_length()
    ended = -1
    texts = [r[0] for r in runs] + [[]] * (size - count)
    lcps = [r[1] for r in runs] + [[]] * (size - count)
    lengths = [len(t) for t in texts]
    place = [0] * size
    head = [t[0] if t else None for t in texts]
    # Shared with the last string out; a run that has ended loses to all.
    shared = [0 if t else ended for t in texts]

    def wins(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's, both measured against the same string; the loser's share is updated."""
        ha, hb = shared[a], shared[b]
        if ha != hb:
            return ha > hb
        if ha == ended:
            return a < b
        at = _difference(head[a], head[b], ha, width)
        if at == width:
            first = a < b
        else:
            first = head[a][at] < head[b][at]
        shared[b if first else a] = at
        return first

    losers = [0] * size
    level = list(range(size))
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            a_first = wins(a, b)
            losers[(len(level) + i) // 2] = b if a_first else a
            above.append(a if a_first else b)
        level = above
    winner = level[0]
    for n in range(total):
        out_run[n], out_place[n], out_shared[n] = winner, place[winner], shared[winner]
        at = place[winner] = place[winner] + 1
        if at < lengths[winner]:
            head[winner], shared[winner] = texts[winner][at], lcps[winner][at]
        else:
            shared[winner] = ended
        node = (size + winner) >> 1
        now = winner
        h = shared[now]
        while node:
            other = losers[node]
            ho = shared[other]
            if h < ho:
                losers[node], now, h = now, other, ho
            elif h == ho and not wins(now, other):
                losers[node], now = now, other
                h = shared[now]
            node >>= 1
        winner = now
    return out_run, out_place, out_shared
