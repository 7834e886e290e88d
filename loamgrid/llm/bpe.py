"""The pieces of a public BPE vocabulary file (tokenizers library, .json) that the token operators share.

The text is cut into pieces as the file's normalizer and pre-tokenizer do; a piece is a word of letters, a digit, a
run of symbols or a contraction, written in the byte alphabet of the vocabulary.
"""

from __future__ import annotations

import functools
import json
import re

#: Most pieces that a worker remembers; beyond it the memory is emptied.
MOST_WORDS = 1_500_000

# Letters and numbers among the code points under U+0250, and white space there; Latin texts need no more.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\\t-\\r \u0085 "
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Code points beyond the Latin ones.
BEYOND = re.compile("[^\\x00-ɏ]")


@functools.cache
def byte_letters() -> dict[int, str]:
    """Byte to letter: printable bytes stand for themselves, the others for letters from U+0100 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.cache
def letter_bytes() -> dict[str, int]:
    return {letter: b for b, letter in byte_letters().items()}


def spelled(piece: str) -> str:
    return piece if piece.isascii() and piece.isprintable() and " " not in piece else piece.encode().decode("latin-1").translate(byte_letters())


class Memory(dict):
    """What make() gives for each piece, remembered."""

    def __init__(self, make, most: int = MOST_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str):
        if len(self) >= self.most:
            self.clear()
        found = self[piece] = self.make(piece)
        return found


class Vocabulary:
    """The parts of the file, and the library's own normalizer and pre-tokenizer for texts beyond Latin letters."""

    def __init__(self, path: str):
        self.path = path
        parts = self.parts()
        model = parts["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = {v: k for k, v in self.ids.items()} | {v: k for k, v in self.special.items()}

    def parts(self) -> dict:
        """The file's content, read anew: workers live on, and need not hold it."""
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    @functools.cached_property
    def merges(self) -> list[tuple[str, str]]:
        return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in self.parts()["model"]["merges"]]

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def bare(self, suffix: str | None):
        """The library's BPE alone, for strings in the byte alphabet; suffix marks the end of a word (None: the string goes on)."""
        from tokenizers import Tokenizer

        parts = self.parts() | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None}
        return Tokenizer.from_str(json.dumps(parts | {"model": parts["model"] | {"end_of_word_suffix": suffix}}))

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text that has no special token; by the library's rules unless its lower case is all Latin, where both agree."""
        low = text.lower()
        if low.isascii() or not BEYOND.search(low):
            return LATIN.findall(low)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(letter_bytes().__getitem__, p)).decode() for p, _ in cut]

    def segments(self, text: str) -> list[tuple[int | None, list[str]]]:
        """(id, []) for each special token that stands in the text, (None, pieces) for what is between."""
        if "<|" not in text:
            return [(None, self.pieces(text))]
        return [(self.special.get(part), [] if part in self.special else self.pieces(part)) for part in self.cut_special.split(text)]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
