"""Token ids of whole texts by the tokenizers library, with a memo of the pieces between white space.

A byte-level tokenizer without normaliser splits a text at every step from a non-space to a
space or newline before it merges anything, so the ids of a text are those of its pieces
(white space and the word after it) in order. Pieces are encoded once and remembered. A column
of texts is split by Arrow, each of its different pieces is looked up once, and the ids are put together by
Arrow again. Texts with other white space than single spaces and newlines go one by one; texts
for which the rule does not hold (special tokens in the text, other white space than spaces and
newlines) are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memos import LONG, turn

PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space by any library's definition, other than space and newline.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: The same for Arrow, with the ends of a text and runs of white space: texts that hold none are plainly spaced.
UNEVEN = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$|^$"
#: Letters from here on may be newer than the tokenizer's Unicode tables.
LATER = "\u0530"
#: ASCII marks other than the apostrophe; after letters they are a piece of their own.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: What stands for a space in byte-level vocabularies.
SPACE = "\u0120"
#: Pieces remembered in a worker; the older half goes when there are more.
MEMO = 240_000


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Pieces to ids; what is missing comes from `old`, or is made."""

    def __init__(self, old: dict, make):
        self.old, self.make = old, make

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        if len(piece) <= LONG:
            self[piece] = got
        return got


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.uneven = "|".join([UNEVEN, *map(re.escape, self.special)])
        self.map = _byte_chars()
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.newline = self._whole("\n")
        self.memo = _Memo({}, self._made)
        self.after_space = _Memo({}, self._spaced)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, word: str) -> bytes:
        """Ids of letters, one piece for the merges whatever is around it."""
        ids = self.ids
        plain = word.isascii()  # ASCII letters stand for themselves
        return b"".join([ids[t.id] for t in self.tokenize(word.replace(" ", SPACE) if plain else word.encode().decode("latin-1").translate(self.map))])

    def _spaced(self, word: str) -> bytes:
        """Ids of a word after a space."""
        core = word.rstrip(MARKS)
        if core.isalpha() and (word.isascii() or max(word) < LATER):
            return self._merged(" " + core) if len(core) == len(word) else self.after_space[core] + self.memo[word[len(core) :]]
        return self._whole(" " + word)

    def _made(self, piece: str) -> bytes:
        if piece[0] == "\n" and piece[1:2].strip():  # a newline before a word stands alone
            return self.newline + self.memo[piece[1:]]
        if piece[0] == " " and piece[1:2].strip():
            return self.after_space[piece[1:]]
        core = piece.rstrip(MARKS)
        if core.isalpha() and max(piece) < LATER:
            return self._merged(core) if len(core) == len(piece) else self.memo[core] + self.memo[piece[len(core) :]]
        return self._whole(piece)

    def _bounded(self) -> None:
        """Of more than MEMO pieces the older half goes."""
        if len(self.memo) + len(self.after_space) > MEMO // 2:
            self.memo.old = self.after_space.old = {}
            self.memo = _Memo(dict(self.memo), self._made)
            self.after_space = _Memo(dict(self.after_space), self._spaced)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        self._bounded()
        return b"".join(map(self.memo.__getitem__, PIECES.findall(text)))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a string column; of none for null and empty ones."""
        column = column.cast(pa.string()).fill_null("")
        uneven = pc.match_substring_regex(column, self.uneven)
        out = [b""] * len(column)
        for i in np.flatnonzero(uneven.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encode(column[i].as_py())
        even = np.flatnonzero(~uneven.to_numpy(zero_copy_only=False))
        if not len(even):
            return out
        self._bounded()
        # Each text begins as if after a newline, whose id is cut off again.
        lines = pc.binary_join_element_wise(pa.scalar("\n"), pc.replace_substring(column.filter(pc.invert(uneven)), "\n", " \n"), pa.scalar(""))
        words = pc.split_pattern(lines, " ")
        coded = words.flatten().dictionary_encode()
        bare, spaced = self.memo, self.after_space
        known = [self.newline + bare[w[1:]] if w[0] == "\n" else spaced[w] for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        ids = pa.array(known, pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[words.offsets.to_numpy()].tolist()
        data, skip = ids.buffers()[2].to_pybytes(), len(self.newline)
        for i, start, end in zip(even.tolist(), ends, ends[1:]):
            out[i] = data[start + skip : end]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between tasks of operators that tokenize."""
    turn(__name__, _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
