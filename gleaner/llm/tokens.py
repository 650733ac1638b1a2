"""Texts to token ids inside tasks: words are encoded once by the tokenizers library and remembered.

The vocabulary's tokenizer drops white space and never joins characters across it, so the ids of a
text are the ids of its words between ASCII white space, one after the other. Words not met before are
cut into pieces by the tokenizer's own pattern, all of a chunk at once, and each new piece goes through the
library's model; a word with unusual characters goes through the whole tokenizer. Tests hold all of this against the
library's ids of whole texts.
"""

from __future__ import annotations

import json
import re
import string
import sys
import types
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from tokenizers import Tokenizer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words and pieces a worker remembers; beyond it the memory is cleared, which costs time only.
REMEMBERED_WORDS = 450_000
REMEMBERED_PIECES = 700_000
#: Characters of texts that are split into words at a time.
CHUNK_CHARS = 2_000_000
#: Characters whose normal form, case or class the short way does not vouch for, and special tokens; no word holds a line's end.
_UNUSUAL = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u0250-\U0010ffff]|<\\|")


def byte_letters() -> dict[int, int]:
    """Letters that stand for bytes in byte-level vocabularies: visible ones for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(own)))}


def piece_pattern(path: str) -> str | None:
    """The pattern that cuts words, if the file's tokenizer lowers, cuts and maps bytes as the short way does."""
    with open(path, encoding="utf-8") as file:
        plan = json.load(file)
    steps = [n["type"] for n in (plan.get("normalizer") or {}).get("normalizers", [])]
    cuts = (plan.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    fits = cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    return cuts[0]["pattern"].get("Regex") if fits else None


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _lowered(text: str) -> bytes:
    """The text in UTF-8, A-Z lowered, as the tokenizer would do later; a special token is known by its own case alone."""
    raw = text.encode("utf-8")
    return raw if b"<|" in raw else raw.lower()


class _Numbers(dict):
    """Keys by number; those not met before are listed for ``_Known.keep``."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, key: bytes | str) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class _Known:
    """Ids of many short strings: a number a string, its ids in one array."""

    def __init__(self):
        self.index = _Numbers()
        self.starts, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)

    def fresh(self) -> list:
        """The strings numbered since the last call; ``keep`` must follow."""
        found, self.index.fresh = self.index.fresh, []
        return found

    def keep(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the strings that ``fresh`` gave, one after the other."""
        end, n = len(self.index), len(self.index) - len(lengths)
        while end + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        ends = self.starts[n] + np.cumsum(lengths)
        while len(lengths) and ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.starts[n]: self.starts[n] + len(ids)] = ids
        self.starts[n + 1: end + 1] = ends

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids, one after the other, of the strings with these numbers."""
        first = self.starts[at]
        lengths = self.starts[at + 1] - first
        before = np.cumsum(lengths) - lengths
        return lengths, self.ids[np.repeat(first - before, lengths) + np.arange(int(lengths.sum()))]


class WordIds:
    """Ids of words, with a memory of the words and pieces seen by this worker. Ids are kept as 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        pattern = piece_pattern(path)
        #: Cuts words that stand in lines of their own; a line's end is a piece.
        self.cut = regex.compile(f"{pattern}|\\n").findall if pattern else None
        self.letters = byte_letters()
        self.tokenize = self.tokenizer.model.tokenize
        #: Whether the pattern keeps ASCII letters together, and the characters that it cuts from the letters before them.
        letters = string.ascii_lowercase * 2
        self.plain = bool(self.cut) and self.cut(letters) == [letters]
        self.marks = frozenset(ord(c) for c in string.punctuation if self.plain and self.cut(letters + c) == [letters, c])
        self.clear()

    @property
    def index(self) -> _Numbers:
        """The words remembered, by number."""
        return self.words.index

    def clear(self) -> None:
        """Forget all words and pieces."""
        self.words, self.pieces = _Known(), _Known()

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of pieces; a line's end has none."""
        if len(self.pieces.index) > REMEMBERED_PIECES:
            self.pieces = _Known()
        at = np.fromiter(map(self.pieces.index.__getitem__, pieces), np.int64, len(pieces))
        sizes, found = [], array("i")
        for piece in self.pieces.fresh():
            letters = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = [token.id for token in self.tokenize(letters)] if piece != "\n" else []
            sizes.append(len(ids))
            found.extend(ids)
        self.pieces.keep(np.array(sizes, np.int64), np.frombuffer(found, np.int32))
        return self.pieces.of(at)

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of ASCII letters: each is one piece."""
        return self._of_pieces(b"\n".join(words).decode("ascii").lower().split("\n"))

    def _marked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of ASCII letters before one mark: two pieces each."""
        both: list[str] = []
        for word in b"\n".join(words).decode("ascii").lower().split("\n"):
            both += word[:-1], word[-1]
        lengths, ids = self._of_pieces(both)
        return lengths[::2] + lengths[1::2], ids

    def _cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of words that the pattern cuts."""
        pieces = self.cut(b"\n".join(words).decode("utf-8").lower())
        lengths, ids = self._of_pieces(pieces)
        ends = np.flatnonzero(np.fromiter((p == "\n" for p in pieces), bool, len(pieces)))
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        return np.diff(before[np.concatenate([[0], ends, [len(pieces)]])]), ids

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of any words, each through the whole tokenizer."""
        found = [self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids for word in words]
        return np.array([len(x) for x in found], np.int64), np.fromiter(chain.from_iterable(found), np.int32)

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words, one after the other: words of a kind go together."""
        kind = np.zeros(len(words), np.int8)
        if self.plain:
            kind[:] = [not word.isalpha() for word in words]
            for i in np.flatnonzero(kind).tolist():
                word = words[i]
                if word[-1] not in self.marks or not word[:-1].isalpha():
                    kind[i] = 2
        else:
            kind[:] = 2
        rest = np.flatnonzero(kind == 2)
        if self.cut is None:
            kind[rest] = 3
        elif len(rest) and _UNUSUAL.search(b"\n".join([words[i] for i in rest.tolist()]).decode("utf-8")):
            kind[rest] = [3 if _UNUSUAL.search(words[i].decode("utf-8")) else 2 for i in rest.tolist()]
        lengths, found = np.zeros(len(words), np.int64), {}
        for k, encode in enumerate((self._letters, self._marked, self._cut, self._whole)):
            some = np.flatnonzero(kind == k)
            if len(some):
                lengths[some], found[k] = encode([words[i] for i in some.tolist()])
        out, kinds = np.empty(int(lengths.sum()), np.int32), np.repeat(kind, lengths)
        for k, ids in found.items():
            out[kinds == k] = ids
        return lengths, out

    def _encode(self, word: bytes) -> bytes:
        """The ids of one word."""
        return self._ids_of([word])[1].tobytes()

    def _chunk(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        split = [_lowered(t).split() if t else [] for t in texts]
        if len(self.words.index) > REMEMBERED_WORDS:
            self.words = _Known()
        counts = [len(s) for s in split]
        number = self.words.index.__getitem__
        at = np.fromiter(chain.from_iterable(map(number, s) for s in split), np.int64, sum(counts))
        if fresh := self.words.fresh():
            self.words.keep(*self._ids_of(fresh))
        lengths, ids = self.words.of(at)
        words_before = np.cumsum([0, *counts], dtype=np.int64)
        ids_before = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        limits = ids_before[words_before] + np.arange(len(texts) + 1)
        out = np.full(limits[-1], end_id, np.int32)
        # a text's ids stand as far to the right as end ids stand before it
        out[np.repeat(np.arange(len(texts)), np.diff(ids_before[words_before])) + np.arange(len(ids))] = ids
        return out, np.diff(limits)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text followed by ``end_id``, and the n + 1 limits of the texts."""
        parts, sizes, at = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHUNK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            ids, own = self._chunk(texts[at:end], end_id)
            parts.append(ids)
            sizes.append(own)
            at = end
        return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


@contextmanager
def word_ids(path: str) -> Iterator[WordIds]:
    """The worker's encoder for a file, for one task.

    The tokenizer is kept in the interpreter, as tasks bring their own copy of this module. Words and pieces go with the
    task: workers that wait, or do other work next, hold none.
    """
    home = sys.modules.setdefault("_word_ids_of_this_worker", types.ModuleType("_word_ids_of_this_worker"))
    kept = home.__dict__.setdefault("kept", {})
    if path not in kept:
        kept[path] = WordIds(path)
    try:
        yield kept[path]
    finally:
        kept[path].clear()
        pa.default_memory_pool().release_unused()
