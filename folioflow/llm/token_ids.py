"""Token ids of whole texts, by the tokenizers library with bounded caches of words."""

from __future__ import annotations

import json
import sys
from array import array
from functools import lru_cache

import regex
from tokenizers import Tokenizer

from folioflow.llm.token_counts import _Cache, byte_symbols, lowered

# Fixed value: the word rule of byte-level vocabularies.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Marks that are a word of their own after letters under either word rule.
MARKS = frozenset(".,;:!?")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, equal to those of the library.

    A text is cut into chunks where the vocabulary's word rule cuts anyway: where white space
    is dropped at every space and line end, in byte-level vocabularies before single spaces
    and line ends, since a word takes the space before it along. Ids of chunks and of their
    words come from caches, those of new words from the library's model. Texts with special
    strings, or with white space next to white space, are encoded whole by the library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # The word rule drops white space if a space by itself has no ids.
        self.drops_space = len(self.encode_whole(" ")) == 0
        rule = BYTE_LEVEL_WORDS
        if self.drops_space:
            steps = spec["pre_tokenizer"]["pretokenizers"]
            rule = next(s for s in steps if s["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(rule, regex.V0).findall
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.symbols = dict(enumerate(byte_symbols()))
        self.word_ids = _Cache(self._word)
        self.chunk_ids = _Cache(self._dropping if self.drops_space else self._spaced)

    def encode_whole(self, text: str) -> bytes:
        return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self.encode_whole(text)
        if self.drops_space:
            ids = b"".join(map(self.chunk_ids.__getitem__, text.replace("\n", " ").split(" ")))
        else:
            first, *rest = text.replace("\n", " \n").split(" ")
            try:
                if first[-1:].isspace():
                    raise _Irregular
                ids = self._joined(first) + b"".join(map(self.chunk_ids.__getitem__, rest))
            except _Irregular:
                return self.encode_whole(text)
        self.word_ids.trim()
        self.chunk_ids.trim()
        return ids

    def forget(self) -> None:
        """Empties the caches, for workers that live on after a task."""
        for cache in (self.word_ids, self.chunk_ids):
            cache.clear()
            cache.older.clear()

    def _joined(self, text: str) -> bytes:
        return b"".join(map(self.word_ids.__getitem__, self.words(text)))

    def _dropping(self, chunk: str) -> bytes:
        body = lowered(chunk)
        plain = self._plain(body)
        return self._joined(body) if plain is None else plain

    def _plain(self, chunk: str) -> bytes | None:
        """Ids of most new chunks, which need no word rule: letters and perhaps a mark at the end."""
        if chunk.isalpha():
            return self.word_ids[chunk]
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return self.word_ids[chunk[:-1]] + self.word_ids[chunk[-1]]
        return None

    def _spaced(self, chunk: str) -> bytes:
        """A chunk after a space, or one that begins with its line end."""
        if chunk.isalpha():
            return self._word(" " + chunk)
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return self.chunk_ids[chunk[:-1]] + self.word_ids[chunk[-1]]
        body = chunk.removeprefix("\n")
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Irregular
        return self._joined(chunk if chunk[0] == "\n" else " " + chunk)

    def _word(self, word: str) -> bytes:
        symbols = word if word.isascii() and word.isalnum() else self._symbols(word)
        return _little([t.id for t in self.model.tokenize(symbols)])

    def _symbols(self, word: str) -> str:
        if word[0] == " " and word.isascii() and word[1:].isalnum():
            return self.symbols[32] + word[1:]
        return word.encode("utf-8").decode("latin-1").translate(self.symbols)


def _little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Irregular(Exception):
    """A chunk whose ids depend on its neighbours."""


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, which serves many tasks."""
    return Encoder(path)
