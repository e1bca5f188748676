"""Near duplicates: b-bit MinHash, verified on full shingle sets.

Method: the minima of many hash functions over a document's shingles are kept to their
low bits and packed into one signature. Bands of full minima give candidates; counting equal
low bits estimates the similarity, corrected for chance collisions; pairs that can
reach the threshold are compared on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.session import materialise

from . import arrays
from .components import connected_components

#: Bands of ROWS minima: at a similarity of 0.85, one pair in 10^6 shares no band.
BANDS, ROWS, LOW_BITS = 24, 5, 4
MINIMA = BANDS * ROWS
#: Standard deviations that an estimate may fall short of the threshold.
SLACK = 5.0
#: Members of a band that are compared with each other at once.
BLOCK = 1_024

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
# Minima of the four-bit fields that are zero in a byte: both, one or none.
_EQUAL = np.array([(b < 16) + (b % 16 == 0) for b in range(256)], np.uint8)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each set, a row for each; empty sets get zeros."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), MINIMA), np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    values = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    for j in range(MINIMA):
        hashed = ((values * _FACTORS[j] + _ADDENDS[j]) >> np.uint64(32)).astype(np.uint32)
        out[full, j] = np.minimum.reduceat(hashed, starts)
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """Low bits of minima, two to a byte."""
    low = (least & np.uint32(15)).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << np.uint8(4))


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    rows = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(least), 0)
    for r in range(ROWS):
        keys = arrays.mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return keys.view(np.int64)


def equal_minima_needed(percent: int) -> int:
    """Fewest equal low-bit fields of a pair at the threshold, chance collisions included."""
    share = percent / 100 + (1 - percent / 100) / (1 << LOW_BITS)
    return int(np.floor(MINIMA * share - SLACK * np.sqrt(MINIMA * share * (1 - share))))


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal fields, corrected for chance collisions."""
    chance = 1 / (1 << LOW_BITS)
    return (equal / MINIMA - chance) / (1 - chance)


def _table(documents: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(key, n, digest, signature, bands) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(1)):
                sets = arrays.shingle_sets(data, offsets, size)
                least = minima(sets)
                packed = signatures(least)
                keys = band_keys(least)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([p.tobytes() for p in packed], pa.binary()),
                    pa.array(list(keys), pa.list_(pa.int64())),
                ], names=["_key", "n", "digest", "signature", "bands"])

    return documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, "_key long, n long, digest binary, signature binary, bands array<long>"
    )


def _sets(documents: DataFrame, text: str, key: str, size: int, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the wanted documents, the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(1)):
                rows = [s.tobytes() for s in arrays.shingle_sets(data, offsets, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.binary())], names=["id", "shingles"])

    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("_text"))
    return rows.join(wanted, "id", "left_semi").mapInArrow(run, "id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    kept.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")  # two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                kept.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _star_pairs(members: DataFrame, needed: int) -> DataFrame:
    """Each band's members with its smallest one, where the estimate allows a link."""
    heads = members.groupBy("band").agg(F.min(F.struct("id", "signature")).alias("head"), F.count(F.lit(1)).alias("m"))
    pairs = (
        members.join(heads.where("m > 1"), "band").where("id != head.id")
        .select(F.col("id").alias("b"), F.col("head.id").alias("a"), F.col("signature").alias("y"), F.col("head.signature").alias("x"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
                near = _EQUAL[x ^ y].sum(1, dtype=np.int32) >= needed
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near))

    return pairs.mapInArrow(run, "a long, b long").distinct()


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Shingles that a set has in common with each of some others."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def _other_links(members: DataFrame, components: DataFrame, facts: DataFrame, needed: int, percent: int) -> DataFrame:
    """Links between members of a band that are in different components.

    Members are dealt to blocks by hash; a band's blocks meet two at a time, each meeting one group, so no task
    holds a band. A pair that shares several bands is compared in the first. Full sets are compared in the group, and of the links
    between parts that are already linked there one is given: no more links come out than members go in.
    """
    labelled_ = members.join(components, members["id"] == components["node"], "left").select(
        "band", "place", "id", F.coalesce("component", "id").alias("c")
    )
    mixed = labelled_.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m")).where("low != high")
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        labelled_.join(mixed.select("band", blocks.alias("blocks")), "band").withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("band", "place", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "c")
        .join(facts, "id")
    )

    def run(table: pa.Table) -> pa.Table:
        i, j, place = (table.column(k)[0].as_py() for k in ("i", "j", "place"))
        ids, label, own_ = (table.column(k).to_numpy().copy() for k in ("id", "c", "own"))
        packed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
        earlier = np.array(table.column("bands").to_pylist(), np.int64)[:, :place]
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        inside = np.flatnonzero(own_ == j)
        links: list[tuple[int, int]] = []
        for x in np.flatnonzero(own_ == i).tolist():
            right = inside[(label[inside] != label[x]) & ((ids[inside] > ids[x]) if i == j else True)]
            right = right[_EQUAL[packed[right] ^ packed[x]].sum(1, dtype=np.int32) >= needed]
            right = right[~(earlier[right] == earlier[x]).any(1)]
            right = right[100 * np.minimum(sizes[right], sizes[x]) >= percent * np.maximum(sizes[right], sizes[x])]
            if not len(right):
                continue
            common = _common(sets[x], [sets[y] for y in right.tolist()])
            near = right[100 * common >= percent * (sizes[right] + sizes[x] - common)]
            _, one = np.unique(label[near], return_index=True)
            for y in near[one].tolist():
                links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                label[label == label[y]] = label[x]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every document.

    Words are what stands between ASCII white space, A-Z lower-cased; a document's set is its distinct runs of ``size`` words,
    the whole text if it has fewer words. Documents link where 100 * common >= percent * united shingles;
    component_id is the smallest key reachable, kept says whether it is the document's own.

    A null, empty or blank text has no shingles and links with nothing. Rows with one key are one
    document (its sets link if any row's does) and keep a row each; rows with a null key stay alone, with a null component, kept.
    Other columns are ignored. Shingles are 64-bit hashes.

    Equal sets are one class from the start. A band's members are first compared with its smallest one;
    only members that are in different components after that are compared with each other.
    """
    numbered = F.col(key).cast("long")
    rows = documents.select(numbered.alias(key), text)
    table = materialise(_table(rows, text, key, size), "minima")
    classes = table.where("_key is not null and n > 0").groupBy("digest").agg(
        F.min("_key").alias("id"), F.min_by("signature", "_key").alias("signature"), F.min_by("bands", "_key").alias("bands")
    )
    classes = materialise(classes, "classes")
    every = classes.select("id", "signature", F.posexplode("bands").alias("place", "band"))
    shared = every.groupBy("band").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("band")
    members = materialise(every.join(shared, "band", "left_semi"), "bands")
    sets = materialise(_sets(rows, text, key, size, members.select("id").distinct()), "sets")
    sets = sets.dropDuplicates(["id", "shingles"])
    needed = equal_minima_needed(percent)
    links = materialise(verified(_star_pairs(members, needed), sets, percent), "near")
    facts = sets.join(classes.select("id", "signature", "bands"), "id")
    links = links.union(materialise(_other_links(members, connected_components(links), facts, needed, percent), "near"))
    # Copies join their class, and with it everything that it links to.
    copies = table.where("n > 0").join(classes.select("digest", "id"), "digest").where("_key != id").select(F.col("id").alias("a"), F.col("_key").alias("b"))
    reached = connected_components(links.union(copies))
    out = table.join(reached, table["_key"] == reached["node"], "left")
    component = F.coalesce("component", "_key")
    return out.select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"),
    )


def without_near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 85) -> DataFrame:
    """The documents that are the smallest of their component; all columns, rows with a null key stay."""
    gone = near_duplicates(documents, text, key, size, percent).where(~F.col("kept")).select(F.col(key).alias("_gone")).distinct()
    return documents.join(gone, F.col(key) == F.col("_gone"), "left_anti")
