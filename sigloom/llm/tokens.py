"""Token ids of whole texts as little-endian integers."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

# The bytes that a byte-level vocabulary writes as themselves; the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _PLAIN]
BYTE_LETTERS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(_OTHER)}
# A lone space before which a new word starts.
_WORD_START = re.compile(r"(?<=\S) (?=\S)")
# A lone line feed between characters that aren't white space.
_LINE_FEED = re.compile(r"(?<=\S)\n(?=\S)")
_LETTERS_THEN_SIGNS = re.compile(r"([^\W\d_]+)([^\w\s]+)")


class _Uneven(Exception):
    """White space beside a space: the text must be cut with care."""


def _piece_ids(path: str, tokenizer) -> Callable[[str], list[int]]:
    """Ids of one piece of text, without cutting it up first.

    Where the ids of merged tokens rise with their merges, an id is its merge's rank and a rank-based encoder gives the same
    ids at half the cost; else the model itself is asked.
    """
    with open(path, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    vocab = tokenizer.get_vocab(False)
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return lambda piece: [t.id for t in tokenizer.model.tokenize("".join(map(BYTE_LETTERS.__getitem__, piece.encode())))]
    import tiktoken

    byte = {letter: b for b, letter in BYTE_LETTERS.items()}
    ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocab.items()}
    return tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Words(dict):
    """Ids of ``lead`` and a word, by word. Letters are one piece and go straight to BPE, anything else through the whole tokenizer.

    Signs after letters, and a line feed between two words, are pieces of their own, so such words are put together from their
    parts. ``most`` words are kept, and those kept before them, so that frequent words stay when room is made.
    """

    def __init__(self, tokenizer, piece: Callable[[str], list[int]], ids: list[bytes], most: int, lead: str):
        self.tokenizer, self.piece, self.ids, self.most, self.lead, self.older = tokenizer, piece, ids, most, lead, {}
        self.signs: dict[str, bytes] = {}
        self.ends = {c: self.whole(c) for c in ".,!?;:"}
        self.bare = _Words(tokenizer, piece, ids, most, "") if lead else self
        self.line_feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return b"".join([self.ids[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def __missing__(self, word: str) -> bytes:
        if (ids := self.older.get(word)) is None:
            if word.isalpha():
                ids = b"".join([self.ids[i] for i in self.piece(self.lead + word)])
            elif (end := self.ends.get(word[-1:])) is not None and (stem := word[:-1]).isalpha():
                return (self.get(stem) or self[stem]) + end
            elif not word or word[0].isspace() or word[-1].isspace():
                raise _Uneven
            elif (parts := _LETTERS_THEN_SIGNS.fullmatch(word)) and parts[1].isalpha():
                return (self.get(parts[1]) or self[parts[1]]) + self._signs(parts[2])
            elif "\n" in word and len(lines := _LINE_FEED.split(word)) > 1:
                return self[lines[0]] + b"".join([self.line_feed + self.bare[x] for x in lines[1:]])
            else:
                ids = self.whole(f"{self.lead}{word}")
        if len(word) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _signs(self, signs: str) -> bytes:
        if signs not in self.signs:
            if len(self.signs) >= 10_000:
                self.signs.clear()
            self.signs[signs] = self.whole(signs)
        return self.signs[signs]


class Encoder:
    """Ids of a byte-level BPE tokenizer without added special tokens, ``width`` bytes each.

    A lone space between two characters that aren't white space always begins a new piece in
    such a tokenizer, so a text is cut there and the ids of frequent words are kept. ``encode``
    equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` for every text; memory
    depends on the longest word, not on the text's length.
    """

    def __init__(self, path: str, kept_words: int = 120_000, width: int = 4):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"ids of this vocabulary do not fit in {width} bytes")
        ids = [i.to_bytes(width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = _Words(self.tokenizer, _piece_ids(path, self.tokenizer), ids, kept_words, " ")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        try:
            return self.words.bare[words[0]] + b"".join(map(self.words.__getitem__, words[1:]))
        except _Uneven:
            words = _WORD_START.split(text)
            later = [self.words.whole(f" {w}") if w[-1].isspace() else self.words[w] for w in words[1:]]
            return self.words.whole(words[0]) + b"".join(later)


@lru_cache(maxsize=2)
def encoder(path: str, kept_words: int = 120_000, width: int = 4) -> Encoder:
    """The process's encoder: a Python worker keeps it, and the ids of frequent words, from task to task."""
    return Encoder(path, kept_words, width)


def drop_encoders() -> None:
    """Free what ``encoder`` keeps: a worker that goes on with another operator's tasks needs the room."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its words refer to each other
