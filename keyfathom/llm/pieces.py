"""SentencePiece BPE without the library's merge loop: a table of last tokens over prefixes.

Every prefix of a word has one encoding, and that has one last token.  A token is the last
one of a prefix if it ends there and if merging would keep it apart from the last token of
the prefix before it, so one pass over the word finds them all and a walk from the end
recovers the ids.  Tokens that end at a place come from an automaton over all pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

from keyfathom.llm.tokens import WordCache, stretches

SPACE = "▁"
_NEVER = 1 << 60


class Pieces:
    """Vocabulary of a BPE model with byte fallback and plain normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.unknown = model.unk_id()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [self.unknown] * 256
        self.text: dict[int, str] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.byte_set = frozenset(i for i in self.byte_ids if i != self.unknown)
        self.unk_text = model.decode([self.unknown]).encode()
        self.prefix = model.encode("a", out_type=str)[0].startswith(SPACE)
        # Merging order: the highest score first; one character needs no merge.
        order = sorted((i for i in self.text if len(self.text[i]) > 1), key=lambda i: (-model.get_score(i), i))
        self.rank = dict.fromkeys(self.text, -1) | {i: k for k, i in enumerate(order)}
        self.id_of = {t: i for i, t in self.text.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        made = {i for i in self.text if len(self.text[i]) == 1}
        for i in order:
            if pair := self._last_merge(i, made):
                self.halves[i] = pair
                made.add(i)
        self.apart.clear()
        self.chars = {self.text[i] for i in made if len(self.text[i]) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in made:
            self.automaton.add_word(self.text[i], (i, len(self.text[i])))
        self.automaton.make_automaton()
        hard = "" if any("\n" in t for t in self.text.values() if len(t) > 1) else "\n"
        glued = any(SPACE in t.lstrip(SPACE) for t in self.text.values())
        self.words = re.compile(".+" if glued else f"{SPACE}*[^{SPACE}{hard}]+|{SPACE}+|\n", re.S)
        self.whole = glued
        self.cache = WordCache(self.word_ids)

    def _last_merge(self, piece: int, made: set[int]) -> tuple[int, int] | None:
        """The two tokens whose merge ends in this piece; none if merging its own text never gives it."""
        text = self.text[piece]
        for cut in range(1, len(text)):
            left, right = self.id_of.get(text[:cut]), self.id_of.get(text[cut:])
            if left in made and right in made and self._kept_apart(left, right, self.rank[piece]):
                return left, right
        return None

    def _kept_apart(self, left: int, right: int, until: int = _NEVER) -> bool:
        """Whether merging leaves the border between two neighbouring tokens alone (before rank `until`).

        Goes back in time from both whole tokens to the characters at the border.  At each
        moment the pair there would merge if its rank comes before the merges that used up
        its two members; of equal ranks the merge further left goes first.
        """
        left_end = right_end = until
        while True:
            both = self.id_of.get(self.text[left] + self.text[right])
            if both is not None:
                rank = self.rank[both]
                if rank < left_end and (rank < right_end or rank == right_end != until):
                    return False
            before, after = self.rank[left], self.rank[right]
            if before < 0 and after < 0:
                return True
            if before > after:
                left_end, left = before, self.halves[left][1]
            else:
                right_end, right = after, self.halves[right][0]

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word; characters without a piece become their bytes."""
        n = len(word)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for at, found in self.automaton.iter(word):
            ending[at].append(found)
        last = [-1] * (n + 1)
        length = [1] * (n + 1)
        apart = self.apart
        if len(apart) > 1_000_000:
            apart.clear()
        for end in range(n):
            for token, size in sorted(ending[end], key=lambda f: -f[1]):
                before = last[end + 1 - size]
                if before >= 0:
                    pair = (before, token)
                    fits = apart.get(pair)
                    if fits is None:
                        fits = apart[pair] = self._kept_apart(before, token)
                    if not fits:
                        continue
                last[end + 1], length[end + 1] = token, size
                break
        ids: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                ids.append(last[at])
            else:
                ids.extend(self._fallback(word[at - 1])[::-1])
            at -= length[at]
        return ids[::-1]

    def _fallback(self, char: str) -> list[int]:
        raw = [self.byte_ids[b] for b in char.encode()]
        return raw if self.unknown not in raw else [self.unknown]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; an empty one has none."""
        parts = []
        for k, part in enumerate([text] if self.whole else stretches(text)):
            part = part.replace(" ", SPACE)
            if not k and part and self.prefix:
                part = SPACE + part
            parts.append(self.cache.ids(self.words.findall(part)))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids: the space put before the text goes, bytes that are no UTF-8 become U+FFFD one by one."""
        ids = list(ids)
        pieces = [self.bytes_of[i] if i != self.unknown else self.unk_text for i in ids]
        raw = b"".join(pieces)
        if self.prefix and ids and ids[0] not in self.byte_set and raw.startswith(b" "):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", raw.decode(errors="surrogateescape"))
