"""Token ids by a public tokenizer's file: Arrow tells a batch's distinct words, the library sees each of them once."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and bytes of words, that a worker remembers; beyond either it forgets those that the last texts didn't have.
MEMO_WORDS, MEMO_BYTES = 450_000, 16 << 20
#: Bytes of text that are encoded together; a longer text is encoded alone.
BATCH_BYTES = 5 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[33:127] = ~_LETTER[33:127]
_MARK[48:58] = False
#: White space beyond ASCII: the library's rules look across it, so a text that has some is encoded whole.
_WIDE_BLANK = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: A blank and letters that stay single letters when normalised: one piece.
_PLAIN = "^ [A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"


def _cuts(text: np.ndarray) -> np.ndarray:
    """Where pieces surely end: before white space, after a line feed or tab alone, and between a letter and an ASCII mark."""
    blank, mark = _BLANK[text], _MARK[text]
    letter = _LETTER[text]
    wide = np.flatnonzero(text[:-1] == 0xC3)  # the Latin letters of this lead byte; 0x97 and 0xB7 are signs
    second = text[wide + 1]
    letter[wide + 1] = (second != 0x97) & (second != 0xB7)
    cut = np.empty(len(text), bool)
    cut[0] = True
    cut[1:] = (blank[1:] & ~blank[:-1]) | (letter[:-1] & mark[1:])
    feeds = np.flatnonzero(blank[:-1] & (text[:-1] != 32))  # alone: two in a row may be one piece
    cut[feeds + 1] |= ~blank[feeds + 1] & ~blank[np.maximum(feeds - 1, 0)] | (feeds == 0) & ~blank[feeds + 1]
    return cut


class WordTokenizer:
    """Encodes whole texts as the library does, each distinct word of a batch once.

    A text is cut before each run of white space, after a line feed or tab alone, and between a letter and a mark. The
    library's splitting rules (of byte-level and of word-end BPE files alike) always end a piece there, whatever follows, so
    the ids of the units, each with the white space in front of it, are the ids of the text. A text with white space beyond
    ASCII, or with a string that the tokenizer's file lists as a special token, is one unit.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids end a word, or, where no token marks an end, begin one with its blank.
        self.last, self.first = np.zeros(max(vocabulary.values(), default=0) + 1, bool), np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.first[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.whole = re.compile("|".join([*map(re.escape, special), *map(chr, _WIDE_BLANK)]).encode())
        self.forget()

    def forget(self) -> None:
        """Start the memo anew."""
        self.index: dict[bytes, int] = {}
        self.flat, self.ends, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _add(self, units: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.index)
        used = int(self.ends[n])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(units) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(units)] = used + np.cumsum(lens)
        self.size += sum(map(len, units))
        self.index.update(zip(units, range(n, n + len(units)), strict=True))

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each unit's ids) of the units at places of the memo, one after the other."""
        first = self.ends[place]
        n = self.ends[place + 1] - first
        ends = np.cumsum(n)
        kind = np.int32 if len(self.flat) < 1 << 31 and len(ends) and ends[-1] < 1 << 31 else np.int64
        at = np.repeat((first - ends + n).astype(kind), n)
        at += np.arange(len(at), dtype=kind)
        return self.flat[at], n

    def _places(self, units: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(units, their places in the memo or -1, which ones it lacks) of distinct units."""
        words = units.to_pylist()
        place = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        return words, place, np.flatnonzero(place < 0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The library's ids of some texts, as little-endian unsigned 32-bit bytes."""
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes] | None:
        """The library's ids of blanks with a word of letters each, 2000 in one call; None if they can't be told apart."""
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            data = ids.tobytes()
            ends = np.flatnonzero(self.last[ids[:-1]] if self.last.any() else self.first[ids[1:]]) + 1
            if len(ends) + 1 != len(some):
                return None
            cuts = [0, *(4 * ends).tolist(), len(data)]
            out += [data[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, units: pa.Array) -> None:
        """Encode distinct units that the memo lacks."""
        text = units.cast(pa.large_string())
        plain = pc.match_substring_regex(text, _PLAIN).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(units)
        for at, how in ((np.flatnonzero(plain), self._joined), (np.flatnonzero(~plain), self.encode)):
            some = text.take(at).to_pylist()
            for i, ids in zip(at.tolist(), (how(some) or self.encode(some)) if some else [], strict=True):
                out[i] = ids
        self._add(units.to_pylist(), np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4)

    def _some(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each text's ids) of the texts at data[at[i] : at[i + 1]]."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        text = _LOWER[data] if self.lowers else data
        cut = _cuts(text)
        raw, end = memoryview(text), 0
        while m := self.whole.search(raw, end):
            k = int(np.searchsorted(at, m.start(), "right"))  # the text ends at at[k], and begins at the last place before
            cut[at[k - 1] : at[k]], end = False, int(at[k])
        cut[at[:-1][at[:-1] < len(text)]] = True
        starts = np.flatnonzero(cut)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(text))), pa.py_buffer(text)]).dictionary_encode()
        words, place, lost = self._places(units.dictionary)
        if len(lost):
            self._learn(units.dictionary.take(lost))
            place[lost] = [self.index[words[i]] for i in lost.tolist()]
        ids, n = self._gather(place[units.indices.to_numpy()])
        if len(self.index) > MEMO_WORDS or self.size > MEMO_BYTES:
            last = self._gather(place)
            self.forget()
            if len(words) < MEMO_WORDS // 2 and len(text) < MEMO_BYTES // 2:
                self._add(words, *last)
        return ids, np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, at[1:])]

    def columns(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, end of each row's ids) of a column of texts (null: empty), some rows at a time; end_id closes each."""
        column = texts.fill_null("").cast(pa.large_binary())
        n = len(column)
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH_BYTES, "right")) - 1)
            ids, ends = self._some(data[at[i] : at[j]], at[i : j + 1] - at[i])
            if end_id is not None:
                ids, ends = np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)
            yield i, ids, ends
            i = j

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit bytes."""
        out = []
        for _, ids, ends in self.columns(pa.array(texts, pa.string())):
            out += [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])]
        return out


LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, kept between tasks."""
    if path not in LOADED:
        LOADED[path] = WordTokenizer(path)
    return LOADED[path]


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file of this name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
