"""Repeated strings: bytes that a string of fixed length shares with an earlier document.

Method: common-prefix-aware distributed merge sort. Suffixes are front-coded in sorted runs, exchanged by sampled
splitters and merged with loser trees that never compare a known prefix again; neighbours with long common
prefixes are the repeats.

A string of ``length`` bytes is found through its anchor, the k-gram with the smallest hash in it: equal strings have equal
anchors. So only suffixes that start at anchors are sorted, and only where the anchor's k-gram
stands in several different documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.session import materialise, partitions

from . import arrays, buckets, merging

#: Bytes of an anchor's k-gram, out of the 50 of a string.
ANCHOR = 30
#: Sampled strings for each splitter.
OVERSAMPLE = 32


@dataclass(frozen=True)
class Anchors:
    """Anchors of all strings of a chunk of texts: hash, place, and the first and last string that each stands for."""

    key: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    owner: np.ndarray


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, size: int = ANCHOR) -> Anchors:
    """For each string within a text the leftmost of its k-grams with the smallest hash; strings in a row that share one are together."""
    strings = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if strings <= 0:
        return Anchors(none.astype(np.uint64), none, none, none, none)
    prefix = arrays.prefix_hash(data)
    grams = len(data) - size + 1
    key = arrays.mix((prefix[size:] - prefix[:-size]) * arrays.powers(len(prefix))[1][:grams])
    # The hash's upper bits, then the place: the least is the leftmost smallest.
    bits = np.uint64(max(1, int(grams).bit_length()))
    least = ((key >> bits) << bits) | np.arange(grams, dtype=np.uint64)
    span, width = 1, length - size + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    inside = np.zeros(len(data) + 1, np.int32)
    # Strings that start in the last length - 1 bytes of a text reach over its end.
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, np.maximum(offsets[1:] - length + 1, offsets[:-1]), -1)
    valid = np.flatnonzero(np.cumsum(inside[:strings]) > 0)
    if not len(valid):
        return Anchors(none.astype(np.uint64), none, none, none, none)
    at = (least[valid] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    ends = np.concatenate([starts[1:], [len(valid)]]) - 1
    place = at[starts]
    return Anchors(key[place], place, valid[starts], valid[ends], np.searchsorted(offsets, valid[starts], side="right") - 1)


def _digest(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each whole text."""
    return arrays.span_hash(arrays.prefix_hash(data), offsets[:-1], offsets[1:])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Packed anchors of each chunk by bucket: a k-gram once, with the document that has it or the first of several.

    K-grams that several different texts of the chunk have go with all of them under a bucket below zero, nothing to be compared.
    """
    for batch in batches:
        for a, b, data, offsets in arrays.chunks(batch.column(1)):
            found = anchors(data, offsets, length)
            if not len(found.key):
                continue
            ids = batch.column(0).slice(a, b - a).to_numpy()
            digest = _digest(data, offsets)
            # Of equal texts only the first is compared with others.
            order = np.lexsort((ids, digest))
            leads = np.zeros(len(ids), bool)
            leads[order[buckets.runs(digest[order])]] = True
            own = leads[found.owner]
            key, owner = found.key[own], found.owner[own]
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            key, owner = key[fresh], owner[fresh]
            start = buckets.runs(key)
            sizes = np.diff(np.concatenate([start, [len(key)]]))
            several = np.repeat(sizes > 1, sizes)
            rows = []
            if several.any():
                docs, place = np.unique(owner[several], return_inverse=True)
                code = buckets.whole(0, buckets.within(key[several], bits), bits) | (key[several] >> np.uint64(64 - bits) << np.uint64(32))
                spread = int(arrays.mix(ids[:1].astype(np.uint64))[0] >> np.uint64(64 - bits))
                rows.append((-1 - spread, True, buckets.packed(ids[docs]), None, buckets.packed(code), buckets.packed(place.astype("<u4" if len(docs) > 65535 else "<u2"))))
            known, k, o = several[start], key[start], owner[start]
            for flag in (False, True):
                for bucket, run in buckets.split(k[known == flag], bits):
                    docs, place = np.unique(o[known == flag][run], return_inverse=True)
                    low = buckets.within(k[known == flag][run], bits)
                    rows.append((
                        bucket, flag, buckets.packed(ids[docs]), buckets.packed(digest[docs]),
                        buckets.packed(low), buckets.packed(place.astype("<u4" if len(docs) > 65535 else "<u2")),
                    ))
            columns = zip(*rows, strict=True)
            types = pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "known", "ids", "digests", "keys", "owners"]
            )


def shared_anchors(documents: DataFrame, length: int) -> DataFrame:
    """(id, keys) of documents whose anchors' k-grams stand in a different document too; several rows for a document.

    A k-gram is sent to its bucket once per chunk, however many documents of the chunk have it; what several of them have is known to be
    shared there. Of a chunk's copies of a text the smallest id stands for all.
    """
    bits = buckets.bucket_bits(documents)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _anchor_rows(batches, length, bits)

    def known_shared(table: pa.Table) -> pa.Table:
        out = ([], [])
        for i, k, o in zip(*(table.column(c).to_pylist() for c in ("ids", "keys", "owners")), strict=True):
            i, k = np.frombuffer(i, np.int64), np.frombuffer(k, np.uint64)
            o = np.frombuffer(o, "<u4" if len(i) > 65535 else "<u2")
            order = np.argsort(o, kind="stable")
            out[0].extend(i.tolist())
            out[1].extend(buckets.packed(np.unique(x)) for x in np.split(k[order], buckets.runs(o[order])[1:]))
        return pa.table({"id": pa.array(out[0], pa.int64()), "keys": pa.array(out[1], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return known_shared(table)
        columns = {c: table.column(c).to_pylist() for c in ("known", "ids", "digests", "keys", "owners")}
        ids, digests, keys, known = [], [], [], []
        for k, i, d, low, o in zip(*columns.values(), strict=True):
            i, d, low = np.frombuffer(i, np.int64), np.frombuffer(d, np.uint64), np.frombuffer(low, "<u4")
            o = np.frombuffer(o, "<u4" if len(i) > 65535 else "<u2")
            ids.append(i[o])
            digests.append(d[o])
            keys.append(low)
            known.append(np.full(len(low), k))
        ids, digests, keys, known = (np.concatenate(x) for x in (ids, digests, keys, known))
        order = np.lexsort((digests, keys))
        ids, digests, keys, known = ids[order], digests[order], keys[order], known[order]
        start = buckets.runs(keys)
        lasts = np.concatenate([start[1:], [len(keys)]]) - 1
        shared = np.repeat((digests[start] != digests[lasts]) | np.logical_or.reduceat(known, start), lasts - start + 1)
        ids, keys = ids[shared], buckets.whole(bucket, keys[shared], bits)
        order = np.argsort(ids, kind="stable")
        ids, keys = ids[order], keys[order]
        start = buckets.runs(ids)
        parts = np.split(keys, start[1:]) if len(start) else []
        return pa.table({"id": pa.array(ids[start], pa.int64()), "keys": pa.array([buckets.packed(np.unique(p)) for p in parts], pa.binary())})

    cut_ = documents.mapInArrow(cut, "bucket int, known boolean, ids binary, digests binary, keys binary, owners binary")
    return cut_.groupBy("bucket").applyInArrow(compare, "id long, keys binary")


def _entries(batch: pa.RecordBatch, length: int, bits: int) -> Iterator[tuple]:
    """Of each chunk the suffixes at shared anchors: owner's id, right and left bytes with their lengths, and the strings' places."""
    left = length - ANCHOR
    for a, b, data, offsets in arrays.chunks(batch.column("text")):
        found = anchors(data, offsets, length)
        if not len(found.key):
            continue
        wanted = [np.frombuffer(x, np.uint64) for row in batch.column("keys").slice(a, b - a).to_pylist() for x in [b"".join(row)]]
        tag = np.repeat(np.arange(b - a, dtype=np.uint64), [len(w) for w in wanted])
        mark = arrays.mix(np.concatenate(wanted) * np.uint64(0x9E3779B97F4A7C15) + tag) if len(tag) else np.zeros(0, np.uint64)
        code = ((found.key >> np.uint64(64 - bits)) << np.uint64(32)) | buckets.within(found.key, bits).astype(np.uint64)
        own = np.isin(arrays.mix(code * np.uint64(0x9E3779B97F4A7C15) + found.owner.astype(np.uint64)), mark)
        place, owner = found.place[own], found.owner[own]
        padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(length, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, left + length)[place].copy()
        ahead = np.minimum(offsets[owner + 1] - place, length)
        behind = np.minimum(place - offsets[owner], left)
        spot = np.arange(left + length)[None, :]
        rows[(spot < (left - behind)[:, None]) | (spot >= (left + ahead)[:, None])] = 0
        ids = batch.column("id").slice(a, b - a).to_numpy()
        yield ids[owner], rows, ahead, behind, place - found.last[own], place - found.first[own], place - offsets[owner]


def _intervals(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching intervals of an id united."""
    order = np.lexsort((end, start, ids))
    ids, start, end = ids[order], start[order], end[order]
    if not len(ids):
        return ids, start, end
    # The furthest end so far within the id: ids become steps that no end can reach over.
    step = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]])) * (int(end.max()) + 1)
    furthest = np.maximum.accumulate(end + step) - step
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (start[1:] > furthest[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(ids)]]) - 1
    return ids[first], start[first], furthest[last]


def _covered(ids: np.ndarray, rows: np.ndarray, ahead: np.ndarray, behind: np.ndarray, low: np.ndarray, high: np.ndarray,
             place: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that strings of suffixes in a group share with a smaller id of the group."""
    left = length - ANCHOR
    if not len(ids):
        return ids, place, place
    first = buckets.runs(group)
    sizes = np.diff(np.concatenate([first, [len(group)]]))
    head = np.repeat(first, sizes)
    alike = (rows == rows[head]).all(1) & (ahead == ahead[head]) & (behind == behind[head])
    plain = np.repeat(np.logical_and.reduceat(alike, first), sizes)
    least = np.repeat(np.minimum.reduceat(ids, first), sizes)
    # All strings of equal suffixes are equal.
    hit = plain & (ids > least)
    out = [(ids[hit], place[hit] - high[hit], place[hit] - low[hit] + length)]
    mixed = np.flatnonzero(~plain & (np.repeat(np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first), sizes)))
    # In mixed groups each string is compared by itself; a group is never cut in two.
    at = 0
    while at < len(mixed):
        end = min(len(mixed), at + 10_000)
        while end < len(mixed) and group[mixed[end]] == group[mixed[end - 1]]:
            end += 1
        some = mixed[at:end]
        at = end
        counts = high[some] - low[some] + 1
        entry = np.repeat(some, counts)
        back = low[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(counts) - counts, counts)
        strings = np.lib.stride_tricks.sliding_window_view(rows, length, axis=1)[entry, left - back]
        words = np.zeros((len(entry), -(-length // 8) * 8), np.uint8)
        words[:, :length] = strings
        code = group[entry].astype(np.uint64)
        for column in words.view(np.uint64).T:
            code = arrays.mix(code * np.uint64(0x9E3779B97F4A7C15) + column)
        order = np.lexsort((ids[entry], code))
        starts = buckets.runs(code[order])
        ordered = words.view(np.uint64)[order]
        if not (ordered == ordered[np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))]).all():
            # Different strings with one hash: sorted by their bytes instead.
            order = np.lexsort((ids[entry], *words.view(np.uint64).T))
            ordered = words.view(np.uint64)[order]
            starts = np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)]))
        smallest = np.repeat(ids[entry][order][starts], np.diff(np.concatenate([starts, [len(order)]])))
        hit = order[ids[entry][order] > smallest]
        out.append(_intervals(ids[entry[hit]], place[entry[hit]] - back[hit], place[entry[hit]] - back[hit] + length))
    return _intervals(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _interval_rows(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list, list]:
    """Intervals packed by id."""
    first = buckets.runs(ids)
    both = np.stack([start, end], 1).astype("<i8")
    return ids[first].tolist(), [buckets.packed(x) for x in np.split(both, first[1:])] if len(first) else []


def _splitters(documents: DataFrame, shared: DataFrame, length: int, bits: int, parts: int) -> np.ndarray:
    """Strings that cut the suffixes into parts, from those of at most 16 documents a part."""
    left = length - ANCHOR

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, *_ in _entries(batch, length, bits):
                some = rows[:: max(1, len(rows) // 64), left : left + ANCHOR]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in some], pa.binary())], names=["string"])

    few = shared.orderBy(F.xxhash64("id"), "id").limit(16 * parts).select("id", "keys")
    strings = documents.join(F.broadcast(few), "id").mapInArrow(sample, "string binary")
    taken = sorted(r.string for r in strings.orderBy(F.xxhash64("string")).limit(OVERSAMPLE * parts).collect())
    return np.array(sorted({taken[i * len(taken) // parts] for i in range(1, parts)}) if taken else [], f"S{ANCHOR}")


def repeated_spans(candidates: DataFrame, length: int, bits: int, parts: int, splitters: np.ndarray) -> DataFrame:
    """(id, spans): covered intervals from rows (id, text, keys), several rows for a document; united later."""
    left, width = length - ANCHOR, 2 * length - ANCHOR

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.int32(), pa.binary(), *[pa.binary()] * 8
        names = ["part", "shared", "rest", "lefts", "ids", "ahead", "behind", "low", "high", "place"]
        for batch in batches:
            for ids, rows, ahead, behind, low, high, place in _entries(batch, length, bits):
                if not len(ids):
                    continue
                own = np.concatenate([rows[:, left:], rows[:, :left], ahead[:, None].astype(np.uint8), behind[:, None].astype(np.uint8)], 1)
                order = merging.sorted_order(np.concatenate([own, ids.astype(">i8").view(np.uint8).reshape(-1, 8) ^ np.array([128] + [0] * 7, np.uint8)], 1))
                own = own[order]
                ids, low, high, place = ids[order], low[order], high[order], place[order]
                same = np.concatenate([[False], (own[1:] == own[:-1]).all(1)])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(own))))
                # Equal suffixes go out with the smallest id alone; the others' strings are covered already.
                known = same & (ids > ids[head])
                done = _intervals(ids[known], place[known] - high[known], place[known] - low[known] + length)
                rows_ = [(-1 - int(i) % parts, None, None, s, buckets.packed(np.array([i])), None, None, None, None, None) for i, s in zip(*_interval_rows(*done), strict=True)]
                kept = ~known
                own, ids, low, high, place = own[kept], ids[kept], low[kept], high[kept], place[kept]
                target = np.searchsorted(splitters, np.ascontiguousarray(own[:, :ANCHOR]).view(f"S{ANCHOR}")[:, 0], side="right") if len(splitters) else np.zeros(len(own), int)
                bounds = buckets.runs(target)
                for x, y in zip(bounds, np.concatenate([bounds[1:], [len(own)]]), strict=True):
                    shared, rest = merging.front_code(own[x:y, :length])
                    rows_.append((
                        int(target[x]), shared, rest, buckets.packed(own[x:y, length:width]), buckets.packed(ids[x:y]),
                        *(buckets.packed(own[x:y, k]) for k in (width, width + 1)),
                        *(buckets.packed(v[x:y].astype(np.uint8)) for v in (low, high)), buckets.packed(place[x:y].astype("<i8")),
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_, strict=True), types, strict=True)], names=names)

    def join(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
            return pa.table({"id": pa.array(ids, pa.int64()), "spans": table.column("lefts").combine_chunks()})
        decoded, runs = [], []
        for shared, rest in zip(table.column("shared").to_pylist(), table.column("rest").to_pylist(), strict=True):
            matrix, lcps = merging.decode(shared, rest, length)
            flat = matrix.tobytes()
            decoded.append(matrix)
            runs.append(([flat[i : i + length] for i in range(0, len(flat), length)], lcps.tolist()))
        run, at, shared = merging.merge(runs, length)
        starts = np.cumsum([0, *[len(d) for d in decoded]])[:-1]
        order = starts[run] + at
        del runs
        right = np.concatenate(decoded)[order]
        lefts = np.frombuffer(b"".join(table.column("lefts").to_pylist()), np.uint8).reshape(-1, left)[order]
        ids, ahead, behind, low, high, place = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), k)[order]
            for c, k in (("ids", np.int64), ("ahead", np.uint8), ("behind", np.uint8), ("low", np.uint8), ("high", np.uint8), ("place", "<i8"))
        )
        # Neighbours that share less than an anchor have different ones.
        group = np.cumsum(shared < ANCHOR)
        found = _covered(
            ids, np.concatenate([lefts, right], 1), ahead, behind, low.astype(np.int64), high.astype(np.int64), place, group, length
        )
        names, spans = _interval_rows(*found)
        return pa.table({"id": pa.array(names, pa.int64()), "spans": pa.array(spans, pa.binary())})

    shape = "part int, shared binary, rest binary, lefts binary, ids binary, ahead binary, behind binary, low binary, high binary, place binary"
    return candidates.mapInArrow(cut, shape).groupBy("part").applyInArrow(join, "id long, spans binary")


def _removed(rows: DataFrame) -> DataFrame:
    """(id, sha, n_removed, n_spans, kept_sha256) from (id, sha, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                pairs = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
                _, start, end = _intervals(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                kept, at = hashlib.sha256(), 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                for column, value in zip(out, (int((end - start).sum()), len(start), kept.hexdigest()), strict=True):
                    column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sha"), *columns], names=["id", "sha", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("id", "sha", "text", "spans").mapInArrow(run, "id long, sha string, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(documents: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50, parts: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every document.

    Each byte that lies in a string of ``length`` UTF-8 bytes that also starts in a document with a smaller key
    is removed; strings overlap, do not cross documents and are judged on the input. n_spans counts maximal removed runs; kept_sha256
    is of the bytes that stay.

    Null and empty texts, and those shorter than ``length``, lose nothing. Rows of one key and text are one document and keep a
    row each; of rows with one key and differing texts one is compared with other documents, the others lose nothing
    (but whole copies of an earlier one). Rows with a null key are neither compared nor changed. Other columns are ignored.

    A copy of a whole earlier document is removed whole; only the first of equal texts is compared with others.
    """
    parts = parts or partitions(documents.sparkSession)
    rows = documents.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = materialise(rows.select("id", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha")), "texts")
    firsts = base.where("id is not null").groupBy("sha").agg(F.min("id").alias("first"))
    keyed = rows.where("id is not null")
    first = base.join(firsts, "sha").where("id = first").groupBy("id").agg(F.min("sha").alias("sha"))
    shared = shared_anchors(keyed, length).groupBy("id").agg(F.collect_list("keys").alias("keys")).join(first, "id")
    shared = materialise(shared, "anchors")
    bits = buckets.bucket_bits(keyed)
    splitters = _splitters(keyed, shared, length, bits, parts)
    # Both joins deal the texts out by key in the same way, so Spark shuffles them once.
    texts = keyed.withColumn("sha", F.sha2("text", 256))
    candidates = texts.join(shared, ["id", "sha"])
    spans = repeated_spans(candidates, length, bits, parts, splitters).groupBy("id").agg(F.collect_list("spans").alias("spans"))
    spans = spans.join(first, "id")
    cleaned = _removed(texts.join(spans, ["id", "sha"])).dropDuplicates(["id"])
    empty = hashlib.sha256(b"").hexdigest()
    copy = (F.col("first") < F.col("id")) & (F.col("n") >= length)
    whole = base.join(firsts, "sha", "left").join(cleaned, ["id", "sha"], "left")
    return whole.select(
        F.col("id").alias(key), F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
