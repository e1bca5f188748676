"""Spelling variants: words one edit apart, and the frequent form of each.

Method: sorted-list dynamic programming. The vocabulary is dealt and sorted so that words with a common beginning are
neighbours. A word is searched by scanning such a sorted list with a banded matrix of edits: words that share a prefix (their
adjacent longest common prefixes say how long) share the matrix rows of it, so a row is computed once for a whole range,
and a range whose shared prefix already needs more than one edit is skipped with all its words. Two words
one edit apart share either their first half or their second, so each word stands in lists by its beginning and, reversed, by
its end, and no list grows with the whole vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.session import materialise, partitions

#: Letters of a run, A-Z already lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Code points and occurrences that a word needs at least.
SHORTEST, FEWEST = 5, 3
#: Different words that a task counts before it sends them.
COUNTED = 200_000
#: Words of a list above which it is dealt to lists by one more letter.
CROWDED = 16_000
#: Words whose lists are scanned at once, in whole lists.
AT_ONCE = 8_000

#: Returns the word to count for a run of a document, given its hash state of the document.
Altered = Callable[[str, int], str]


def one_in_97(run: str, state: int) -> str:
    """The run, or where 97 divides the crc32 of ``<doc_id>:<run>`` the run without the code point that this picks."""
    h = zlib.crc32(run.encode(), state)
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def unaltered(run: str, state: int) -> str:
    return run


def vocabulary(documents: DataFrame, text: str = "text", key: str = "doc_id", altered: Altered = unaltered, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): the words of all texts and how often they occur; each task sends a word once for many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not value:
                    continue
                state = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # bytes.lower() changes A-Z alone.
                for word, n in Counter(m[0] for m in RUN.finditer(value.encode().lower().decode())).items():
                    word = altered(word, state)
                    if len(word) >= shortest:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield out()
                    total.clear()
        if total:
            yield out()

    counted = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def listed(words: DataFrame, shortest: int = 1) -> DataFrame:
    """(side, short, skip, start, list, word, n): the sorted lists that each word stands in.

    ``short`` is the length of the shorter word of the pairs that a list is for, its words have that length or one more. A word of the
    list ``side`` 0 has its first half in common with the others, of 1, reversed, the second half; ``start`` is how many code points that is.
    """
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short")
    rows = words.select("word", "n", lengths).where(F.col("short") >= max(1, shortest)).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.floor(F.col("short") / 2).cast("int")
    rows = rows.withColumns({
        "word": F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")),
        "start": F.when(F.col("side") == 0, half).otherwise(F.col("short") - half),
        "skip": F.lit(False),
    })
    return rows.select("side", "short", "skip", "start", F.expr("left(word, start)").alias("list"), "word", "n")


def _crowded(rows: DataFrame, most: int) -> DataFrame:
    keys = ["side", "short", "start", "list"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select(*keys, F.lit(True).alias("crowded"))


def uncrowded(rows: DataFrame, most: int = CROWDED) -> DataFrame:
    """The lists with those of more than ``most`` words dealt out, however many words begin alike.

    Pairs of a crowded list differ in the code point after its common beginning, or share that too. For the first, words that are equal
    but for this code point (or without it) meet in small lists with ``skip``; for the second, the words go to lists by one code point
    more, until none is crowded.
    """
    done: list[DataFrame] = []
    keys = ["side", "short", "start", "list"]
    crowded = materialise(_crowded(rows, most), "crowded")
    while not crowded.isEmpty():
        joined = rows.join(crowded, keys, "left")
        done.append(joined.where("crowded is null").drop("crowded"))
        over = joined.where("crowded").drop("crowded")
        rest = lambda cut: F.concat("list", F.lit("\x00"), F.expr(f"substring(word, start + 1 + {cut})"))
        either = over.select(
            "side", "short", F.lit(True).alias("skip"), "start",
            F.explode(F.array(F.when(F.length("word") > F.col("start"), rest(1)), F.when(F.length("word") == F.col("short"), rest(0)))).alias("list"), "word", "n",
        ).where("list is not null")
        done.append(either)
        deeper = over.where("length(word) > start").withColumn("start", F.col("start") + 1).withColumn("list", F.expr("left(word, start)"))
        rows = materialise(deeper.select("side", "short", "skip", "start", "list", "word", "n"), "lists")
        crowded = materialise(_crowded(rows, most), "crowded")
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after another, and the range of each."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - low, size), owner


def scan(flat: np.ndarray, offset: np.ndarray, group: np.ndarray, start: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, target) of words one edit apart in sorted lists: rows of a list stand together, in order.

    ``flat`` has the words' code points, ``offset`` where each begins, and its end; words of ``group`` share the first ``start`` code points.
    Queries are a list's words of ``short`` code points, targets all its words of that length or one more.

    Of a query's matrix only two cells of a row can stay at one edit, as no query is longer than its target: the
    diagonal ``same`` and the cell ``behind`` it (one more code point of the target than of the query). A range of words
    is entered once by each query for which its prefix is within one edit.
    """
    length = np.diff(offset)
    query = np.flatnonzero(length == short)
    first = np.searchsorted(group, group[query], side="left")
    last = np.searchsorted(group, group[query], side="right")
    depth = start[query].astype(np.int64)
    same, behind = np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
    found = [np.zeros((2, 0), np.int64)]
    padded = np.concatenate([flat, np.zeros(1, flat.dtype)])
    while True:
        # A range that holds nothing but the query has no pair.
        live = (last - first > 1) | (first != query)
        query, first, last, depth, same, behind = (x[live] for x in (query, first, last, depth, same, behind))
        if not len(query):
            break
        # Each range once: its words by their next code point, words that end first.
        _, one, node = np.unique(first, return_index=True, return_inverse=True)
        rows, owner = _ranges(first[one], last[one])
        at = depth[one][owner]
        ended = length[rows] == at
        code = np.where(ended, -1, padded[offset[rows] + np.where(ended, 0, at)].astype(np.int64))
        new = np.ones(len(rows), bool)
        new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        low = rows[begin]
        high = rows[np.concatenate([begin[1:], [len(rows)]]) - 1] + 1
        letter, parent = code[begin], owner[begin]
        # Every query of a range goes on to each of the ranges in it.
        child, entry = _ranges(np.searchsorted(parent, node, side="left"), np.searchsorted(parent, node, side="right"))
        q, d, s, b, c = query[entry], depth[entry], same[entry], behind[entry], letter[child]
        end = c < 0
        if end.any():
            target = low[child[end]]
            edits = np.where(length[target] == length[q[end]], s[end], b[end])
            hit = (edits == 1) & (target != q[end])
            found.append(np.stack([q[end][hit], target[hit]]))
        q, d, s, b, c, child = (x[~end] for x in (q, d, s, b, c, child))
        within = d < length[q]
        here = padded[offset[q] + np.where(within, d, 0)]
        before = padded[offset[q] + np.maximum(d - 1, 0)]
        below = np.where(d > 0, b + (before != c), 2)
        next_behind = np.minimum(np.minimum(below, s + 1), 2).astype(np.int8)
        next_same = np.where(within, np.minimum(s + (here != c), 2), 2).astype(np.int8)
        near = (next_same <= 1) | (next_behind <= 1)
        query, depth, same, behind = q[near], d[near] + 1, next_same[near], next_behind[near]
        first, last = low[child[near]], high[child[near]]
    return tuple(np.concatenate(found, axis=1))


def _found(table: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of the words with near ones in the given lists, each pair from one list alone."""
    words = table.column("word").to_pylist()
    side, short, start, skip, n = (table.column(c).to_numpy() for c in ("side", "short", "start", "skip", "n"))
    # All code points of words are below 256, where one byte is one code point.
    encoded = [w.encode("latin-1") for w in words]
    flat = np.frombuffer(b"".join(encoded), np.uint8)
    offset = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
    group = np.cumsum(_group_starts(table)) - 1
    a, b = scan(flat, offset, group, start, short)
    # A pair with both halves alike is taken from the list by its first half.
    backward = side[a] == 1
    kept = np.ones(len(a), bool)
    half = (short // 2).astype(np.int64)
    if backward.any():
        at = np.flatnonzero(backward)
        ends = [words[x][len(words[x]) - half[x] :] != words[y][len(words[y]) - half[x] :] for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)]
        kept[at] = np.array(ends, bool)
    # Pairs that share the code point at the skipped place too are found in a longer list.
    for i in np.flatnonzero(skip[a]).tolist():
        x, y = int(a[i]), int(b[i])
        kept[i] &= words[x][: start[x] + 1] != words[y][: start[x] + 1]
    a, b = a[kept], b[kept]
    # A pair of equal lengths is found from either of its words, one of different lengths from the shorter.
    longer = np.diff(offset)[b] > np.diff(offset)[a]
    word, other = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
    forward = [w if s == 0 else w[::-1] for w, s in zip(words, side.tolist(), strict=True)]
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=forward.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[other], -n[other], word))
    word, other = word[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    return pa.table({
        "word": pa.array([forward[i] for i in word[first].tolist()], pa.string()),
        "n_near": pa.array(np.diff(np.concatenate([first, [len(word)]])), pa.int64()),
        "best_n": pa.array(n[other[first]], pa.int64()),
        "best": pa.array([forward[i] for i in other[first].tolist()], pa.string()),
    })


_LIST = ["side", "short", "skip", "start", "list"]


def _group_starts(table: pa.Table) -> np.ndarray:
    """Whether a row begins a list, of rows sorted by list."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in ("side", "short", "skip", "start"):
        column = table.column(name).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    names = np.array(table.column("list").to_pylist(), object)
    new[1:] |= names[1:] != names[:-1]
    return new


def near_words(words: DataFrame, shortest: int = 1, most: int = CROWDED) -> DataFrame:
    """(word, n_near, best): of each word with words one edit away their number and the most frequent, as a struct of -n and word."""
    rows = uncrowded(listed(words, shortest), most)
    parts = partitions(words.sparkSession)
    dealt = rows.repartition(parts, *_LIST).sortWithinPartitions(*_LIST, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size < AT_ONCE:
                continue
            table = pa.concat_tables(held).combine_chunks()
            last = int(np.flatnonzero(_group_starts(table))[-1])
            if last:
                yield from _found(table.slice(0, last).combine_chunks()).to_batches()
            held, size = [table.slice(last)], table.num_rows - last
        if size:
            yield from _found(pa.concat_tables(held).combine_chunks()).to_batches()

    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): the last form, reached by steps that double.

    A form is at least twice as frequent as its word, so chains end, after fewer steps than a count has bits.
    """
    now = forms.select("word", F.col("form").alias("root"), F.lit(False).alias("final"))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("final").alias("ends"))
        moving = now.where("not final").join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.coalesce("ends", F.lit(True)).alias("final")
        )
        now = materialise(now.where("final").unionByName(moving), "roots")
        if now.where("not final").isEmpty():
            return now.select("word", "root")


def spelling_variants(
    documents: DataFrame, text: str = "text", key: str = "doc_id", altered: Altered = unaltered,
    shortest: int = SHORTEST, fewest: int = FEWEST, times: int = 2, most: int = CROWDED,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with its more frequent near word.

    Words are the runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least ``shortest`` code points
    and at least ``fewest`` occurrences in all texts. Two words are near if one insertion, deletion or replacement of a code point
    turns one into the other. ``form`` is a word's most frequent near word (of equals the smallest) if that is at least ``times`` as
    frequent, else null; ``root`` is reached by following forms, and the word itself where it has none. ``altered`` changes runs before they are counted.

    Null and empty texts have no words; repeated rows count each; a null key stands for an empty one where ``altered`` uses it; other
    columns are ignored; an empty table gives an empty result.
    """
    words = materialise(vocabulary(documents, text, key, altered, shortest, fewest), "words")
    near = near_words(words, shortest, most)
    form_n = -F.col("best.minus")
    has = F.coalesce(form_n >= times * F.col("n"), F.lit(False))
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.word")).alias("form"), F.when(has, form_n).alias("form_n"),
    )
    formed = materialise(formed, "forms")
    roots = rooted(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
