import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from frostline.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


def test_ids_word_by_word_are_the_tokenizers():
    ids, mine = reference(), tokens.load(PATH)
    odd = ["", " ", "a\x1cb\x1d c", "İstanbul ΣΑΣ ς", "it's don't 'tis l'été", "x́y e\u0301 \u0301a", "a\xa0b\u2003c\u200bd", "<|endoftext|>x <|startoftext|>",
           "ß ẞ 12345 a1b2 ½", "…—“q” !!?..; (a) \"b\" --c--", "日本語 テスト。", "ŉ ň Ň ĸ ı Ĳ ſ K Å", "\x00 \x7f \U0001f600", "a.b,c;d e-f's"]
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x20, 0x250)]
    odd += ["".join(rng.choice(letters) for _ in range(30)) for _ in range(300)]
    for text in odd:
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == ids(text), repr(text)


def cost(places, penalties, window, cuts):
    total, before = 0, 0
    for j in cuts:
        size = places[j] - places[before]
        if size > window:
            return float("inf")
        total += (0 if size & (size - 1) == 0 else window - size) + penalties[j]
        before = j
    return total


def test_cuts_cost_least():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 17, n))])
        penalties = rng.integers(0, 9, n + 1)
        best = min(cost(places, penalties, 16, [*c, n]) for k in range(n) for c in itertools.combinations(range(1, n), k))
        assert cost(places, penalties, 16, packing.choose_cuts(places, penalties, 16)) == best


def test_pieces_hold_every_id_once(documents, corpus, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40_000)
    ids = reference()
    want = sorted((zlib.crc32(np.array([*ids(t or ""), 2], "<u4").tobytes()), len(ids(t or "")) + 1, str(i)) for i, t in corpus)
    rows = packing.packed(documents, PATH).collect()
    sequences, padding, total = {}, 0, 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    for size in sequences.values():
        assert 0 < size <= 4096
        padding += 0 if size & (size - 1) == 0 else 4096 - size
        total += size
    assert total == sum(n for _, n, _ in want) and padding < 0.02 * total
    # Whole pieces by their checksum; cut ones by their lengths.
    whole = sorted((r.ids_crc32, r.length, str(r.doc_id)) for r in rows if r.length == r.doc_tokens)
    assert all(w in want for w in whole) and len(whole) > 60
    for key in (500, 501, 502):
        parts = sorted((r.start, r.length) for r in rows if r.doc_id == key)
        own = [*ids(dict(corpus)[key]), 2]
        assert [s for s, _ in parts] == list(itertools.accumulate([0, *(n for _, n in parts)]))[:-1] and sum(n for _, n in parts) == len(own)
        for r in rows:
            if r.doc_id == key:
                assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())


def test_nothing(nothing):
    assert packing.packed(nothing, PATH).collect() == []
