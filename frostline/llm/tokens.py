"""Token ids of texts, word by word.

White space separates the tokenizer's words, so a text's ids are its words' ids one after
the other. Words are looked up; a new one that is letters and then plain punctuation goes to the
tokenizer's merge model directly, any other through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Words remembered per process; beyond that the memory starts anew.
MOST_WORDS = 400_000

# Letters that no normal form and no other letter next to them changes; one lower-case letter each.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ň"
_SIMPLE = re.compile(rf"([{_LETTERS}]+)([.,;:!?*$%&#|()\"\-]*)")
_SPACED = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_NO_SPACE = "\x1c\x1d\x1e\x1f"  # white space to str.split, not to the tokenizer


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible ones stand for themselves."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a lower-casing byte-level tokenizer whose words end at white space, as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        with open(path) as f:
            kinds = [x.get("type") for x in (json.load(f).get("normalizer") or {}).get("normalizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"]
        vocabulary = self.whole.get_vocab()
        self.sentence_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.sentence_end[i] = token.removesuffix("</w>").endswith((".", "!", "?"))

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = self.parts[part] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def _new(self, word: str) -> bytes:
        simple = _SIMPLE.fullmatch(word)
        if simple is None:
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        letters, marks = simple.groups()
        return self._part(letters.lower()) + self._part(marks) if marks else self._part(letters.lower())

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        split = _SPACED.findall(text) if any(c in text for c in _NO_SPACE) else text.split()
        words = self.words
        try:
            return b"".join([words[w] for w in split])
        except KeyError:
            pass
        if len(words) > MOST_WORDS:
            words.clear()
            self.parts.clear()
        for w in split:
            if w not in words:
                words[w] = self._new(w)
        return b"".join([words[w] for w in split])


_loaded: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
