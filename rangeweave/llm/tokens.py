"""Byte-level BPE token ids of whole texts, with a bounded cache of words.

A byte-level BPE never merges across the blanks that its splitting pattern cuts at.  A single blank between
two characters that are not white space always starts a new pre-token, so a text may be cut before every such
blank, the pieces encoded apart, and the ids joined: the result equals that of encoding the whole text.
Words repeat, so the ids of a piece are kept (as little-endian 32-bit bytes) in a cache of bounded size.
"""

from __future__ import annotations

import os
import re
from struct import pack

DOUBLE = re.compile(r"\s\s")
SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
CACHE_WORDS = 800_000


#: Latin letters, with a blank before them or without: one pre-token.  And letters with ASCII signs behind them: the signs are another.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
PLAIN = re.compile(f" ?{LETTERS}")
SIGNED = re.compile(f"({LETTERS})([!-/:-@\\[-`{{-~]+)")


class Library:
    """The tokenizer, and how its vocabulary writes bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {}  # asked of the library for one character of every lead and trail byte
        for code in [*range(0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x110000, 0x1000)]:
            self.shown.update(zip(chr(code).encode(), map(ord, level.pre_tokenize_str(chr(code))[0][0])))
        self.bare, self.blanked = WordCache(self, ""), WordCache(self, " ")

    def ids(self, piece: str) -> bytes:
        if PLAIN.fullmatch(piece):
            found = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]
        else:
            found = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return pack(f"<{len(found)}I", *found)


class WordCache(dict):
    """piece -> bytes of the ids of `before` + piece.  Full, it keeps what it has until as many pieces again were not in it, then starts anew."""

    def __init__(self, library: Library, before: str):
        super().__init__()
        self.library, self.before, self.missed = library, before, 0

    def __missing__(self, piece: str) -> bytes:
        m = SIGNED.fullmatch(piece)
        ids = self[m[1]] + self.library.bare[m[2]] if m else self.library.ids(self.before + piece)
        if len(self) < CACHE_WORDS:
            self[piece] = ids
        else:
            self.missed += 1
            if self.missed > CACHE_WORDS:
                self.clear()
                self.missed = 0
        return ids


_libraries: dict[str, Library] = {}


def library_of(path: str) -> Library:
    if path not in _libraries:
        _libraries[path] = Library(path)
    return _libraries[path]


def forget(path: str) -> None:
    """Empties the caches of words: for the end of a task, as the process lives on and may turn to other work."""
    library = library_of(path)
    library.bare.clear()
    library.blanked.clear()


def encode_texts(texts: list, path: str, end: int) -> list[bytes]:
    """Little-endian 32-bit ids of every text (None: empty), each closed by the id `end`.

    Texts are cut before every safe blank and, where all white space stands alone, around every line end.
    """
    library, tail, out = library_of(path), end.to_bytes(4, "little"), []
    bare, blanked = library.bare.__getitem__, library.blanked.__getitem__
    for text in texts:
        ids: list[bytes] = []
        if not text:
            pass
        elif DOUBLE.search(text) or text[0].isspace() or text[-1].isspace():
            first, *rest = SAFE_BLANK.split(text)
            ids.append(bare(first))
            ids += map(blanked, rest)
        else:
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                ids.append(bare(first))
                ids += map(blanked, rest)
                ids.append(bare("\n"))
            ids.pop()
        ids.append(tail)
        out.append(b"".join(ids))
    return out


def tokenizer_path() -> str:
    """Where the public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
