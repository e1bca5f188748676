"""Personal data: e-mail and IP addresses, payment card and telephone numbers.

Method: a semi-Markov conditional random field. Fixed patterns find what is written the usual way; the field adds what they miss:
addresses spelled with "at" and "dot", numbers with other separators, and numbers side by side that a pattern takes for one. Candidate
segments have features of the whole span (digits, groups, separators, check digit, what stands next to it), and a dynamic programme over
segments of bounded length chooses boundaries and kinds together. Its weights are trained here, on
a bounded sample of the documents: the patterns' own finds, the same rewritten in other ways, and look-alikes.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Documents of the sample that the field is trained on, and the most stretches of text taken from it.
SAMPLE, STRETCHES = 30_000, 600
#: Stretches with finds that are rewritten at least, some of them several times if there are fewer.
REWRITTEN = 600
#: Code points of a document taken around a stretch.
AROUND = 24
#: Most digits and groups of digits of a number, and labels of an address on either side: what bounds a segment.
MOST_DIGITS, MOST_GROUPS, MOST_LABELS = 19, 7, 8
#: Passes over the training stretches, step size and weight decay.
ROUNDS, STEP, DECAY = 6, 0.5, 1e-4

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Classes next to each other exclude one another or are possessive, so no pattern goes back over what it has read.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each ``@`` is tried with all that can stand before it, so long runs of letters are read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers with dots between them, from the left; a chain of eight is two."""
    for chain in _DOTTED.finditer(text):
        parts = chain[0].split(".")
        if len(parts) < 4:
            continue
        at = chain.start()
        for i in range(0, len(parts) // 4 * 4, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def patterns(text: str) -> list[Span]:
    """What the fixed patterns find, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(1, a, b) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


class Segment(NamedTuple):
    start: int
    end: int
    kind: int
    features: tuple[str, ...]


_DOT = r"(?:\.| ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot )"
_AT = r"(?:@| ?[\[({<] ?(?:at|@) ?[\])}>] ?| at )"
_LABEL = r"[A-Za-z0-9_%+-]{1,64}"
_RIGHT = re.compile(rf"({_AT})([A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,{MOST_LABELS}}})", re.IGNORECASE)
_LEFT = re.compile(rf"({_LABEL}(?:{_DOT}{_LABEL}){{0,{MOST_LABELS - 1}}})$", re.IGNORECASE)
_DOTS = re.compile(_DOT, re.IGNORECASE)
_SOME_AT = re.compile(r"@|(?:dot|\.) ?[\])}]| dot ", re.IGNORECASE)
_BETWEEN = re.compile(r"[ ().\-/\[\]{}]{1,3}+| ?[\[({]?dot[\])}]? ?", re.IGNORECASE)


def _near(text: str, at: int) -> str:
    """What stands at a place, as a class."""
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    return "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c if c in "\"'=#$.,:;-/()_+@" else "other"


def _around(text: str, start: int, end: int) -> tuple[str, ...]:
    left, right = _near(text, start - 1), _near(text, end)
    return f"left {left}", f"right {right}"


def _email_segments(text: str) -> Iterator[Segment]:
    if not _SOME_AT.search(text):
        return
    for m in _RIGHT.finditer(text):
        before = text[max(0, m.start() - 80) : m.start()]
        left = _LEFT.search(before)
        if not left:
            continue
        ends = [m.start(2) + d.start() for d in _DOTS.finditer(m[2])][1:] + [m.end()]
        base = m.start() - len(before) + left.start()
        starts = [base, *(base + d.end() for d in _DOTS.finditer(left[0]))]
        at = re.sub("[^@a-z]", "", m[1].lower()) + ("" if m[1][0] not in " [({<" else "()" if any(c in "[({<" for c in m[1]) else " ")
        for a in starts:
            for b in ends:
                labels = _DOTS.split(text[m.start(2) : b])
                dots = {re.sub(r"[\[({\])}]", "|", d.lower()) for d in _DOTS.findall(text[m.start(2) : b])}
                last = labels[-1]
                form = "word" if last.isalpha() and 2 <= len(last) <= 6 else "longer" if last.isalpha() else "number"
                yield Segment(a, b, 0, (
                    "email", f"email at {at}", f"email dots {len(dots)}", f"email dot {min(dots)}", f"email last {form}", f"email labels {min(len(labels), 4)}",
                    f"email whole left {a == starts[0]}", f"email whole right {b == ends[-1]}", *(f"email {x}" for x in _around(text, a, b)),
                ))


def _number_segments(text: str) -> Iterator[Segment]:
    groups = [m.span() for m in re.finditer("[0-9]++", text)]
    for i, (first, stop) in enumerate(groups):
        digits, shape, between = 0, [], []
        for j in range(i, min(len(groups), i + MOST_GROUPS)):
            a, b = groups[j]
            if j > i:
                gap = text[stop:a]
                if len(gap) > 7 or not _BETWEEN.fullmatch(gap):
                    break
                between.append(gap.lower())
            stop = b
            digits += b - a
            if digits > MOST_DIGITS:
                break
            shape.append(b - a)
            if digits < 7 and len(shape) != 4:
                continue
            yield from _numbers(text, first, stop, shape, between, groups[i - 1][1] if i else -9, groups[j + 1][0] if j + 1 < len(groups) else len(text) + 9)


def _numbers(text: str, first: int, stop: int, shape: list[int], between: list[str], before: int, after: int) -> Iterator[Segment]:
    """The kinds that a run of groups of digits can be."""
    start = first
    if text[start - 1 : start] == "(":
        start -= 1
    plus = text[start - 1 : start] == "+" and start > 0
    start -= plus
    body = text[start:stop]
    digits = _digits(body)
    kinds = sorted(set(between))
    touches = f"touches {int(0 < start - before <= 2)}{int(0 < after - stop <= 2)}"
    common = (touches, f"gaps {len(kinds)}", f"gap {kinds[0] if kinds else ''}", *_around(text, start, stop))
    form = "-".join(map(str, shape[:6]))
    if len(shape) == 4 and max(shape) <= 3 and not plus and "(" not in body[:1]:
        values = [int(x) for x in re.findall("[0-9]+", body)]
        dotted = all("." in g or "dot" in g for g in between)
        yield Segment(first, stop, 1, ("ip", f"ip in range {max(values) <= 255}", f"ip dotted {dotted}", *(f"ip {x}" for x in common)))
    if 12 <= len(digits) <= MOST_DIGITS and not plus and not any(c in "()[]{}" for c in body):
        check = luhn(digits)
        yield Segment(first, stop, 2, ("card", f"card check {check}", f"card n {len(digits)}", f"card check {check} groups {form}", f"card check {check} {touches}", *(f"card {x}" for x in common)))
    if 7 <= len(digits) <= 15 and body.count("(") == body.count(")") and not any(c in "[]{}" for c in body):
        paren = "(" in body
        yield Segment(start, stop, 3, (
            "phone", f"phone n {len(digits)}", f"phone plus {plus}", f"phone plus {plus} paren {paren}", f"phone plus {plus} groups {form}", f"phone plus {plus} {touches}",
            *(f"phone {x}" for x in common),
        ))


def segments(text: str) -> list[Segment]:
    """All candidate segments, by start: whole numbers side by side and whole labels of an address, never parts of them."""
    some = list(_email_segments(text))
    if _DIGIT.search(text):
        some += _number_segments(text)
    return sorted(some)


def stretches(found: list[Segment]) -> Iterator[list[Segment]]:
    """Segments that overlap or nearly touch, together; what is chosen in one stretch does not matter to another."""
    held: list[Segment] = []
    end = 0
    for s in found:
        if held and s.start > end + 1:
            yield held
            held = []
        end = max(end, s.end) if held else s.end
        held.append(s)
    if held:
        yield held


class Model(NamedTuple):
    """Weights of features, and of a segment's kind after the one that ended right before it (0 is none)."""

    weights: dict[str, float]
    after: list[list[float]]

    def score(self, s: Segment) -> float:
        return sum(self.weights.get(f, 0.0) for f in s.features)


def _arcs(found: list[Segment]) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Places where segments begin or end, and for each the segments (number, place of its start) that end there."""
    places = sorted({p for s in found for p in (s.start, s.end)})
    number = {p: i for i, p in enumerate(places)}
    ending: list[list[tuple[int, int]]] = [[] for _ in places]
    for i, s in enumerate(found):
        ending[number[s.end]].append((i, number[s.start]))
    return places, ending


def decode(model: Model, found: list[Segment]) -> tuple[float, list[int]]:
    """The best choice of segments that do not overlap, by score: (score, numbers).

    A place has a best score for each kind that ended last; text between segments scores nothing, and more than one code point of it
    ends their neighbourhood.
    """
    places, ending = _arcs(found)
    best: list[dict[int, tuple[float, tuple]]] = [{0: (0.0, ())}]
    for b in range(1, len(places)):
        here: dict[int, tuple[float, tuple]] = {}
        close = places[b] - places[b - 1] <= 1
        for state, (value, path) in best[b - 1].items():
            to = state if close else 0
            if to not in here or value > here[to][0]:
                here[to] = (value, path)
        for i, a in ending[b]:
            kind, own = found[i].kind + 1, model.score(found[i])
            for state, (value, path) in best[a].items():
                value += own + model.after[state][kind]
                if kind not in here or value > here[kind][0]:
                    here[kind] = (value, (path, i))
        best.append(here)
    score, path = max(best[-1].values(), key=lambda x: x[0])
    chosen = []
    while path:
        path, i = path
        chosen.append(i)
    return score, chosen[::-1]


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def expected(model: Model, found: list[Segment]) -> tuple[float, list[float], dict[tuple[int, int], float]]:
    """(log of the sum over all choices, share of each segment, share of each kind after another): forward and backward."""
    places, ending = _arcs(found)
    own = [model.score(s) for s in found]
    forward: list[dict[int, float]] = [{0: 0.0}]
    for b in range(1, len(places)):
        into: dict[int, list[float]] = defaultdict(list)
        close = places[b] - places[b - 1] <= 1
        for state, value in forward[b - 1].items():
            into[state if close else 0].append(value)
        for i, a in ending[b]:
            kind = found[i].kind + 1
            into[kind] += [v + own[i] + model.after[s][kind] for s, v in forward[a].items()]
        forward.append({s: _log_add(v) for s, v in into.items()})
    total = _log_add(list(forward[-1].values()))
    out: list[dict[int, list[float]]] = [defaultdict(list) for _ in places]
    for state in forward[-1]:
        out[-1][state].append(0.0)
    shares, pairs = [0.0] * len(found), defaultdict(float)
    for b in range(len(places) - 1, 0, -1):
        back = {s: _log_add(v) for s, v in out[b].items()}
        close = places[b] - places[b - 1] <= 1
        for state in forward[b - 1]:
            to = state if close else 0
            out[b - 1][state].append(back[to])
        for i, a in ending[b]:
            kind = found[i].kind + 1
            for state, value in forward[a].items():
                rest = own[i] + model.after[state][kind] + back[kind]
                out[a][state].append(rest)
                share = math.exp(value + rest - total)
                shares[i] += share
                pairs[state, kind] += share
    return total, shares, pairs


def _gold(found: list[Segment], wanted: set[Span]) -> tuple[list[int], list[tuple[int, int]]] | None:
    """The wanted segments' numbers and their neighbours' kinds, or None where one of them is no candidate."""
    numbers = [i for i, s in enumerate(found) if (s.kind, s.start, s.end) in wanted]
    if len(numbers) != len(wanted):
        return None
    pairs, last, end = [], 0, -9
    for i in sorted(numbers, key=lambda i: found[i].start):
        s = found[i]
        if s.start < end:
            return None
        places = {p for x in found for p in (x.start, x.end) if end <= p <= s.start}
        steps = sorted({end, s.start} | places)
        close = end >= 0 and all(b - a <= 1 for a, b in zip(steps, steps[1:], strict=False))
        pairs.append((last if close else 0, s.kind + 1))
        last, end = s.kind + 1, s.end
    return numbers, pairs


def _rewritten(kind: int, value: str, rng: random.Random) -> str:
    """The same kind of thing with new digits, in a way that the fixed patterns may not know."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        at = rng.choice(["@", " at ", " (at) ", "(at)", "[at]", " [at] "])
        dot = rng.choice([".", " dot ", "(dot)", "[dot]", " [dot] "]) if at != "@" else "."
        if at == " at ":
            dot = " dot "
        return at.join(p.replace(".", dot) for p in value.split("@"))
    if kind == 1:
        return rng.choice([".", "[.]", "(.)", " dot ", "[dot]"]).join(str(rng.randrange(1, 256)) for _ in range(4))
    if kind == 2:
        size = rng.choice([13, 14, 15, 16, 16, 16, 16, 19])
        body = digit(size - 1)
        body += next(c for c in "0123456789" if luhn(body + c))
        gap = rng.choice(["", "", " ", "-", ".", "/"])
        return gap.join(body[i : i + 4] for i in range(0, size, 4))
    lead = rng.choice(["", "", "+", "+"])
    gap = rng.choice(["-", ".", " "])
    area, rest = digit(3), f"{digit(3)}{gap}{digit(4)}"
    number = rng.choice([f"({area}) {rest}", f"({area}) {rest}", f"{area}{gap}{rest}"])
    return f"{lead}{rng.choice('123456789')}{rng.choice([' ', '-'])}{number}" if lead or rng.random() < 0.3 else number


def _alike(rng: random.Random) -> str:
    """Numbers and words that look like personal data and are none."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    year = rng.choice(["19", "20"]) + digit(2)
    day = lambda: f"{rng.randrange(1, 29):02d}"
    gap = rng.choice("-./ ")
    return rng.choice([
        lambda: gap.join([year, day(), day()]), lambda: gap.join([day(), day(), year]), lambda: f"{year}-{day()}-{day()} {day()}:{day()}",
        lambda: f"{year}-{rng.choice(['19', '20'])}{digit(2)}", lambda: " ".join([digit(rng.randrange(1, 4)), digit(3), digit(3)]),
        lambda: digit(rng.randrange(7, 13)), lambda: digit(rng.randrange(12, 20)), lambda: digit(rng.randrange(20, 40)),
        lambda: ".".join(digit(rng.randrange(1, 4)) for _ in range(rng.choice([2, 3, 5]))), lambda: f"{digit(2)}.{digit(1)}.{digit(4)}.{digit(2)}",
        lambda: ".".join([str(rng.randrange(256, 999)), digit(2), digit(3), digit(1)]), lambda: " ".join(digit(4) for _ in range(4)),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: f"978-{digit(1)}-{digit(2)}-{digit(6)}-{digit(1)}",
        lambda: " ".join(digit(rng.randrange(1, 3)) for _ in range(12)), lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", lambda: f"{digit(5)}-{digit(4)}",
        lambda: f"{digit(rng.randrange(1, 4))}.{digit(rng.randrange(4, 13))}", lambda: f"{digit(3)} {digit(rng.randrange(5, 9))}",
        lambda: "meet at noon. dot the line", lambda: f"at {digit(2)}.{digit(2)} dot {digit(1)}", lambda: "look at this dot and that",
        lambda: f"{digit(1)} {digit(1)} {digit(1)} {digit(1)}", lambda: f"{digit(2)}-{digit(2)}-{digit(2)}-{digit(2)}", lambda: f"{digit(3)} {digit(3)} {digit(2)} {digit(1)}",
    ])()


def training_texts(sample: list[tuple[str, list[Span]]], seed: int = 17, least: int = REWRITTEN) -> list[tuple[str, set[Span]]]:
    """(text, spans) to train on: each stretch of the sample as it is, and its spans rewritten, doubled and replaced by look-alikes.

    A small sample is rewritten several times, ``least`` times over all stretches with spans.
    """
    times = max(1, -(-least // max(1, sum(bool(spans) for _, spans in sample))))
    rng = random.Random(seed)
    out: list[tuple[str, set[Span]]] = []
    for text, spans in sorted(sample):
        out.append((text, set(spans)))
    for text, spans in sorted(sample) * times:
        if not spans:
            a = rng.randrange(len(text) + 1)
            other = f" {_alike(rng)} "
            text = text[:a] + other + text[a:]
            out.append((text, set(patterns(text))))
            continue
        kind, a, b = rng.choice(spans)
        before, after = text[:a], text[b:]
        # What follows need not be a clean context: only the text's own finds before it stay wanted.
        rest = {s for s in spans if s[2] <= a}
        for _ in range(2):
            new = _rewritten(kind, text[a:b], rng)
            out.append((before + new + after, rest | {(kind, a, a + len(new))} | {(k, x - b + a + len(new), y - b + a + len(new)) for k, x, y in spans if x >= b}))
        for other in rng.sample([1, 2, 3], 2):
            one, two = _rewritten(kind, text[a:b], rng), _rewritten(other, "", rng)
            second = a + len(one) + 1
            out.append((f"{before}{one} {two}", rest | {(kind, a, a + len(one)), (other, second, second + len(two))}))
        for _ in range(2):
            text_ = before + _alike(rng) + after
            out.append((text_, set(patterns(text_))))
    return out


def unclear(text: str, wanted: set[Span], found: list[Segment]) -> bool:
    """Whether a segment not wanted would be a find of the patterns if it stood alone: they missed it only for what stands next to it."""
    return any((s.kind, s.start, s.end) not in wanted and (s.kind, 0, s.end - s.start) in patterns(text[s.start : s.end]) and not any(
        a < s.end and s.start < b for _, a, b in wanted) for s in found)


def trained(sample: list[tuple[str, list[Span]]], rounds: int = ROUNDS) -> Model | None:
    """The field, fitted by gradient ascent of the likelihood; None where the sample has no spans to learn from."""
    if not any(spans for _, spans in sample):
        return None
    examples = []
    for text, wanted in training_texts(sample):
        for found in stretches(segments(text)):
            low, high = found[0].start, max(s.end for s in found)
            gold = _gold(found, {w for w in wanted if low <= w[1] and w[2] <= high})
            if gold and not unclear(text, wanted, found):
                examples.append((found, *gold))
    rng = random.Random(5)
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-2)
    after = [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)]
    squares_after = [[1e-2] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)]
    model = Model(weights, after)
    for _ in range(rounds):
        rng.shuffle(examples)
        for found, numbers, pairs in examples:
            _, shares, pair_shares = expected(model, found)
            gradient: dict[str, float] = defaultdict(float)
            for i, s in enumerate(found):
                change = (i in numbers) - shares[i]
                if abs(change) > 1e-4:
                    for f in s.features:
                        gradient[f] += change
            for f, g in gradient.items():
                g -= DECAY * weights[f]
                squares[f] += g * g
                weights[f] += STEP * g / math.sqrt(squares[f])
            change_after: dict[tuple[int, int], float] = defaultdict(float)
            for p in pairs:
                change_after[p] += 1
            for p, share in pair_shares.items():
                change_after[p] -= share
            for (s, k), g in change_after.items():
                squares_after[s][k] += g * g
                after[s][k] += STEP * g / math.sqrt(squares_after[s][k])
    return Model(dict(weights), after)


def spans(text: str, model: Model | None) -> tuple[list[Span], list[Span]]:
    """(what the patterns find, what the field adds): added spans overlap no other."""
    base = patterns(text)
    if model is None:
        return base, []
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    free = []
    for s in segments(text):
        i = bisect_right(ends, s.start)
        if i == len(taken) or taken[i][0] >= s.end:
            free.append(s)
    added = []
    for found in stretches(free):
        added += [(found[i].kind, found[i].start, found[i].end) for i in decode(model, found)[1]]
    return base, added


def sampled(documents: DataFrame, text: str, key: str, sample: int = SAMPLE, most: int = STRETCHES) -> list[tuple[str, list[Span]]]:
    """Stretches of a sample of about ``sample`` documents, even by hash: at most ``most`` with finds of the patterns and as many without."""
    rate = min(1.0, sample / max(1, documents.count()))
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    rows = rows.where(F.pmod(F.xxhash64("k", F.length("t")), F.lit(1 << 20)) < int(rate * (1 << 20))) if rate < 1 else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, list[int]]] = []
            for value in batch.column(1).to_pylist():
                found = segments(value)
                base = patterns(value) if found else []
                for one in stretches(found):
                    a, b = one[0].start, max(s.end for s in one)
                    if b - a > 200:
                        continue
                    low, high = max(0, a - AROUND), min(len(value), b + AROUND)
                    inside = [s for s in base if low <= s[1] and s[2] <= high]
                    # Context that cuts a find would give it a new shape.
                    if all(s[2] <= low or s[1] >= high or s in inside for s in base):
                        out.append((value[low:high], [x for k, p, q in inside for x in (k, p - low, q - low)]))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([s for _, s in out], pa.list_(pa.int32()))], names=["stretch", "spans"])

    found = materialise(rows.mapInArrow(run, "stretch string, spans array<int>").distinct(), "stretches")
    order = F.xxhash64("stretch")
    taken = []
    for some in (F.size("spans") > 0, F.size("spans") == 0):
        for r in found.where(some).orderBy(order, "stretch").limit(most).collect():
            taken.append((r["stretch"], [tuple(r["spans"][i : i + 3]) for i in range(0, len(r["spans"]), 3)]))
    return taken


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))


def personal_data(documents: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, most: int = STRETCHES) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, added): personal data in every whole text.

    ``n_`` columns count what the patterns find, ``base_sha256`` is the digest of their list, ``spans`` lists all spans as
    kind:start:end (code points, end exclusive) by kind and start, ``added`` those of the field alone. Added spans overlap no other span.

    Null and empty texts have none; every row gives one, repeated ones and those without a key too; other columns are ignored; an empty
    table gives an empty result. A table without any finds of the patterns has nothing to learn from, and nothing is added.
    The field is trained on at most ``most`` stretches with finds and as many without, of about ``sample`` documents.
    """
    model = trained(sampled(documents, text, key, sample, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, lists, more = [], [], []
            for value in batch.column(1):
                base, added = spans(value.as_py() or "", model)
                for k, column in enumerate(counts):
                    column.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                lists.append(joined(base + added))
                more.append(joined(added))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string()), pa.array(more, pa.string())],
                names=["_key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "added"],
            )

    columns = "_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added string"
    rows = documents.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, columns).withColumnRenamed("_key", key)


def redacted(documents: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, most: int = STRETCHES) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; all columns. Overlapping spans are one, of the kind that begins first."""
    model = trained(sampled(documents, text, key, sample, most))
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(place).to_pylist():
                out, at = [], 0
                for a, b, k in sorted((a, b, k) for part in spans(value or "", model) for k, a, b in part):
                    if a >= at:
                        out += [value[at:a], f"<{KINDS[k]}>"]
                    at = max(at, b)
                texts.append(None if value is None else "".join(out) + value[at:])
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return documents.mapInArrow(run, documents.schema)
