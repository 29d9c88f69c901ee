"""Token ids of whole texts with public tokenizers, for use inside tasks.

Splitting into words comes first in these tokenizers and no merge crosses a word, so
the ids of a text are the ids of its words in a row.  Words repeat: each is encoded once
per worker and kept in a bounded dictionary.  Where the split is not plain, the whole
stretch of text goes to the library.  So does a whole text that holds a special token, unless
the encoder takes these for plain text.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np

from keyfathom.llm.common import per_worker

#: Words of one generation that a worker keeps.
CACHED_WORDS = 400_000
#: Characters handled at once; longer texts are cut where words meet.
STRETCH = 1 << 19

_CUT = re.compile(r"(?<=\S) (?=\S)")
# The split of these tokenizers, for texts of Latin characters.  White space and numbers are written out:
# to the tokenizers \x1c to \x1f are signs and ²³¹¼½¾ are numbers.
_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_NUMBERS}{_LETTERS}]+"
                     rf"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
_BEYOND = re.compile("[^\x00-\u024f]")
_OTHER = re.compile("[^\x00-\u024f]|[\x1c-\x1f²³¹¼½¾]")
#: The same for tokenizers that drop white space and take each digit alone.
_SPACELESS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9]|[^\s0-9A-Za-zªµºÀ-ÖØ-öø-ɏ]+")

_SHOWN = [c for c in range(256) if chr(c).isprintable() and chr(c) != " "]
#: Byte-level models write a byte that cannot be shown as a character from 256 on, in the order of bytes.
_BYTES = {c: 256 + k for k, c in enumerate(c for c in range(256) if c not in _SHOWN)}
_ALPHABET = "".join(chr(_BYTES.get(c, c)) for c in range(256))


def _as_bytes(piece: str) -> str:
    """The piece as byte-level models have it: one character a byte."""
    return codecs.charmap_decode(piece.encode(), "strict", _ALPHABET)[0]


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts, each but the first beginning with a single space before a word."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


class WordCache(dict):
    """Ids of words as little-endian 32-bit strings; a word is encoded when it is first met.

    Two generations: a full dictionary becomes the old one, and what is still met moves to the new,
    so that frequent words stay and memory is bounded.
    """

    def __init__(self, encode: Callable[[Any], bytes | list[int]], limit: int = CACHED_WORDS):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if (found := self.old.get(word)) is None:
            found = self.encode(word)
            if not isinstance(found, bytes):
                found = _packed(found)
        self[word] = found
        return found

    def ids(self, words: list) -> bytes:
        return b"".join(map(self.__getitem__, words))


def _library(path: str, plain_specials: bool = True):
    """The tokenizer of the file; with plain_specials, special tokens in a text are text like any other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain_specials
    return made


class _Specials:
    """Ids of the texts that hold a special token, as the library gives them by default."""

    def __init__(self, path: str, tokenizer):
        self.path, self.tokenizer = path, None
        added = [t for t in tokenizer.get_added_tokens_decoder().values() if t.special]
        # Some are looked for after the normaliser, which may fold case: too many texts do no harm.
        self.exact = [t.content for t in added if not t.normalized]
        self.folded = [t.content.lower() for t in added if t.normalized]

    def ids(self, text: str) -> bytes | None:
        if not any(t in text for t in self.exact) and not (self.folded and any(map(text.lower().__contains__, self.folded))):
            return None
        if self.tokenizer is None:  # a second tokenizer, which few tables need
            self.tokenizer = _library(self.path, False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: By the number of ids, for the numbers that words have.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


def _steps(tokenizer) -> Callable[[str], bytes]:
    """The library's own normaliser, splitter and model one after the other, without its offsets.

    Words of Latin letters are lower-cased and split here where that gives the same pieces.  Pieces of words repeat
    more often than words, so the model's part is kept.
    """
    if any(not t.special for t in tokenizer.get_added_tokens_decoder().values()):
        return lambda word: _packed(tokenizer.encode(word, add_special_tokens=False).ids)
    normalizer, splitter, model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
    known: dict[str | tuple, bytes] = {}

    def split(word: str) -> list[str]:
        return [p for p, _ in splitter.pre_tokenize_str(normalizer.normalize_str(word) if normalizer else word)]

    text = "a 'll bc's12 D'S_#e\nf  g \n\n h\t " + "".join(f"a{c}1{c}, {c}{c} .{c} {c}\n" for c in _signs() if _plain(c))
    alike = split(text) == list(map(_as_bytes, _SPACELESS.findall(text.lower())))

    def model_ids(pieces: list[str], plain: bool) -> Iterator[bytes]:
        for piece in pieces:
            key = piece if plain else (piece,)
            if (found := known.get(key)) is None:
                if len(known) > CACHED_WORDS // 2:
                    known.clear()
                found = known[key] = _packed([t.id for t in model.tokenize(_as_bytes(piece) if plain else piece)])
            yield found

    def encode(word: str) -> bytes:
        low = _plain(word) if alike else None
        return b"".join(model_ids(split(word), False) if low is None else model_ids(_SPACELESS.findall(low), True))

    return encode


def _signs() -> list[str]:
    """The characters that _SPACELESS splits."""
    return [c for c in map(chr, range(0x250)) if not _OTHER.match(c)]


def _plain(word: str) -> str | None:
    """The word in lower case if it is of Latin characters without _OTHER, before and after."""
    low = word.lower()
    return None if _other(word) or low is not word and _other(low) else low


def _other(text: str) -> bool:
    """Whether the text has characters of _OTHER."""
    if text.isascii():
        return any(map(text.__contains__, "\x1c\x1d\x1e\x1f"))
    return _OTHER.search(text) is not None


def _beyond(text: str) -> bool:
    """Whether the text has characters that are not Latin; most texts are told by how Python holds them."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _BEYOND.search(text) is not None
    return False


class SpacelessWords:
    """Tokenizers that drop white space: words are what stands between it."""

    def __init__(self, path: str):
        tokenizer = _library(path)
        encode = _steps(tokenizer)
        self.cache = WordCache(lambda word: encode(word.decode()))
        self.specials = _Specials(path, tokenizer)

    def encode(self, text: str) -> bytes:
        if (found := self.specials.ids(text)) is not None:
            return found
        return b"".join(self.cache.ids(part.encode().split()) for part in stretches(text))


class SpacedWords:
    """Byte-level tokenizers that put one space before a word into its token.

    Texts of Latin letters are split as the tokenizer's pattern splits them, and only the model is
    asked for the pieces; all others are split by the library.  Special tokens in a text are plain text
    here, as a reader that looks for separators needs it; see MarkedWords.
    """

    def __init__(self, path: str):
        self.tokenizer = _library(path)
        self.model = self.tokenizer.model
        self.plain = (self.tokenizer.normalizer is None and self._splits_alike()
                      and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.cache = WordCache(self._piece)

    def _splits_alike(self) -> bool:
        """Whether the library makes the same pieces, tried with each Latin character in several places."""
        text = "a 'll bc's12 d_#e\nf  g \n\n h\t " + "".join(
            f"a{c}1{c}, {c}{c} .{c} {c}\n" for c in map(chr, range(0x250)))
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] == list(
            map(_as_bytes, _PIECES.findall(text)))

    def _piece(self, piece: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(_as_bytes(piece))])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._part, stretches(text)))

    def _part(self, text: str) -> bytes:
        if not self.plain or _beyond(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.cache.ids(_PIECES.findall(text))


class MarkedWords(SpacedWords):
    """The same with special tokens in a text taken as such, as the library does by default."""

    def __init__(self, path: str):
        super().__init__(path)
        self.specials = _Specials(path, self.tokenizer)

    def encode(self, text: str) -> bytes:
        found = self.specials.ids(text)
        return super().encode(text) if found is None else found


def shared(kind: type, path: str):
    """One encoder per worker process and file."""
    return per_worker((kind, path), lambda: kind(path))
