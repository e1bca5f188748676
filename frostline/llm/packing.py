"""Packing: documents as token ids, cut into sequences with little padding.

Method: order-preserving dynamic programming. Cuts may stand after documents and
sentences, and anywhere in a stretch without such ends; the cuts chosen have the least padding
plus truncation penalties. A sequence shorter than the window is padded to it, so the best
cut before a place is a sliding-window minimum, kept in a monotone queue; sequences whose
length is a power of two need no padding and are transitions of their own.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Cost, in tokens of padding, of a cut after a sentence and of one inside a sentence.
SENTENCE_PENALTY, TRUNCATION_PENALTY = 4, 64
#: Tokens that are cut at once; what the last cut leaves over goes on with the next.
BLOCK = 1 << 19


def choose_cuts(places: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indices into places, in order, that cost least; the first place is the start, the last is always cut.

    Places are token positions where a cut may stand, with neighbours no more
    than ``window`` apart. Cost of a sequence is its padding and its end's penalty.
    """
    n = len(places)
    before = {}
    size = 1
    while size < window:  # powers of two: no padding
        at = np.searchsorted(places, places - size)
        hit = np.flatnonzero((at < n) & (places[np.minimum(at, n - 1)] == places - size))
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            before.setdefault(j, []).append(i)
        size *= 2
    place, penalty = places.tolist(), penalties.tolist()
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(place[0], place[0], 0)])  # (cost + place, place, index), costs rising
    for j in range(1, n):
        here = place[j]
        while queue[0][1] < here - window:
            queue.popleft()
        least, _, by = queue[0]
        best = least + window - here
        for i in before.get(j, ()):
            if cost[i] < best:
                best, by = cost[i], i
        best += penalty[j]
        cost[j], back[j] = best, by
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def cut_places(ends: np.ndarray, penalties: np.ndarray, total: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The start, the given ends, and places between ends that are far apart, so that no gap passes the window."""
    step = window // 4
    places = np.concatenate([[0], ends, [total]] if not len(ends) or ends[-1] != total else [[0], ends])
    costs = np.concatenate([[0], penalties, [TRUNCATION_PENALTY]] if not len(ends) or ends[-1] != total else [[0], penalties])
    gaps = np.flatnonzero(np.diff(places) > step)
    more = [np.arange(places[g] + step, places[g + 1], step) for g in gaps]
    if more:
        extra = np.concatenate(more)
        places, costs = np.concatenate([places, extra]), np.concatenate([costs, np.full(len(extra), TRUNCATION_PENALTY)])
        order = np.argsort(places, kind="stable")
        places, costs = places[order], costs[order]
    return places, costs


class Packer:
    """Takes documents' ids in order and gives pieces of sequences, in order."""

    def __init__(self, sentence_ends: np.ndarray, window: int):
        self.sentence_ends, self.window = sentence_ends, window
        self.documents: list[tuple[int, int, np.ndarray]] = []  # (row, ids before, ids) not yet packed
        self.held, self.sequence = 0, 0

    def add(self, row: int, ids: np.ndarray) -> None:
        self.documents.append((row, 0, ids))
        self.held += len(ids)

    def pack(self, last: bool) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, start, length, crc32, sequence, offset) of all that is held, but for some at the end if more comes."""
        if not self.held:
            return
        ids = np.concatenate([d[2] for d in self.documents])
        ends = self.sentence_ends[ids]
        edges = np.cumsum([len(d[2]) for d in self.documents])
        ends[edges[:-1] - 1] = True
        if last:
            ends[-1] = True
        at = np.flatnonzero(ends) + 1
        penalties = np.full(len(at), SENTENCE_PENALTY)
        penalties[np.isin(at, edges)] = 0
        places, costs = cut_places(at, penalties, len(ids), self.window)
        cuts = places[choose_cuts(places, costs, self.window)]
        # The end is no end of the text yet: the sequences before it are chosen again with what comes.
        cuts = cuts if last else cuts[: max(1, len(cuts) - 8)]
        bounds = np.union1d(np.concatenate([[0], cuts]), edges[edges < cuts[-1]])
        owner = np.searchsorted(edges, bounds[:-1], side="right")
        sequence = np.searchsorted(cuts, bounds[:-1], side="right")
        begins = np.concatenate([[0], cuts])
        firsts = np.concatenate([[0], edges])
        for a, b, d, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), owner.tolist(), sequence.tolist(), strict=True):
            row, before, _ = self.documents[d]
            yield row, before + a - int(firsts[d]), b - a, zlib.crc32(ids[a:b]), self.sequence + s, a - int(begins[s])
        self.sequence += len(cuts)
        done = int(cuts[-1])
        left = int(np.searchsorted(edges, done, side="right"))
        rest = self.documents[left:]
        if rest:
            row, before, own = rest[0]
            skip = done - int(firsts[left])
            rest[0] = row, before + skip, own[skip:]
        self.documents, self.held = rest, len(ids) - done


def packed(
    documents: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", end_id: int = 2, window: int = 4096,
) -> DataFrame:
    """Pieces of sequences: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; each id lies in one piece. Documents keep the order of the
    input's partitions, each of which is packed by itself, without a shuffle: sequences are at most
    ``window`` long, and shorter ones a power of two or padded to it. A null or empty text is ``end_id`` alone.
    Repeated rows are packed as often as they come; null keys stay null; other columns are ignored; an empty table gives an
    empty result. A task that is run again reads the same rows and gives the same sequences.
    """
    kind = documents.schema[key].dataType.simpleString()
    names = ["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokens.load(tokenizer_path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        packer = Packer(made.sentence_end, window)
        base = TaskContext.get().partitionId() << 40
        keys: dict[int, object] = {}
        sizes: dict[int, int] = {}

        def pieces(last: bool) -> Iterator[pa.RecordBatch]:
            rows = list(packer.pack(last))
            if not rows:
                return
            row, start, length, crc, sequence, offset = zip(*rows, strict=True)
            columns = (
                pa.array([keys[r] for r in row], key_type), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                pa.array([sizes[r] for r in row], pa.int64()), pa.array([base + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()),
            )
            kept = {d[0] for d in packer.documents}
            for r in [r for r in keys if r not in kept]:
                del keys[r], sizes[r]
            yield pa.RecordBatch.from_arrays(list(columns), names=names)

        row = 0
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, document in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(made.ids(document.as_py() or "") + end, "<u4")
                keys[row], sizes[row] = k, len(ids)
                packer.add(row, ids)
                row += 1
                if packer.held >= BLOCK:
                    yield from pieces(False)
        yield from pieces(True)

    shape = f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, shape).withColumnRenamed("_key", key)
