"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 is the vocabulary: words in the order of their 64-bit hashes, with exact counts. Level k holds the n-grams of k
words, grouped by their first k - 1 (the context's place in level k - 1): a monotone pointer for each context, and its successors. A successor is
told relative to a shorter context: the place of the n-gram without its first word, counted from the first one of its own context. Such numbers
are small; they are made monotone by adding what the contexts before end with. Both sequences are Elias-Fano coded, and a
successor is found by a search within its context's own range. Each n-gram has a smoothed probability (interpolated
absolute discounting) and each context a backoff weight, as quantised base-10 logarithms. All n-grams are kept, those that occur once too,
unless `least_count` says otherwise.

Levels are cut into shards by ranges of contexts, whose number grows with the corpus. Tasks write each shard as one file
in the shared folder and map the files into memory, so nothing of the model passes through the driver but a few numbers for each shard.

Cases: a null or empty text is its end token alone; without training texts every token has the probability of an unseen
one; repeated rows count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.llm.common import SharedFiles, bounded_batches, crc32_mod, materialise, shared_path

END = b""
ORDER = 3
DISCOUNT = 0.6
#: N-grams of fewer occurrences are left out; 1 keeps all.
LEAST_COUNT = 1
#: Tokens of the corpus for each shard of a level, about.
SHARD_TOKENS = 6_000_000
#: Bytes of text that are taken together; a longer text is taken alone.
BATCH_BYTES = 4 << 20
#: Tokens that are looked up together, and n-grams that a task counts together.
LOOKUP_TOKENS, COUNT_TOKENS = 800_000, 6_000_000
#: Bytes of shards that a worker holds where the shared folder can't be mapped.
HELD_BYTES = 256 << 20
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEPS = 4096  # quantisation steps for a factor of ten
_U = np.uint64


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


_PLACES = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).ravel()
_EVERY, _TOP = _U(0x0101010101010101), _U(0x8080808080808080)


def _select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th (from 0) one of each 64-bit word: first its byte, by running sums of all bytes at once."""
    k = k.astype(np.uint64)
    s = x - ((x >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EVERY
    byte = np.bitwise_count(((k * _EVERY | _TOP) - s) & _TOP).astype(np.uint64) * _U(8)
    k = k - (((s << _U(8)) >> byte) & _U(255))
    return (byte + _PLACES[(((x >> byte) & _U(255)) << _U(3)) + k]).astype(np.int64)


class EliasFano:
    """A monotone sequence in about 2 + log2(largest / length) bits a value, with vectorised access and search."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays
        self.n, self.bits = (int(v) for v in arrays["meta"])
        self.low, self.high, self.before = arrays["low"], arrays["high"], arrays["before"]

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            part = v & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * _U(bits)
            word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(low, word, part << off)
            over = off + _U(bits) > _U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - off[over]))
        ones = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, ones >> 6, _U(1) << (ones & 63).astype(np.uint64))
        before = np.concatenate(([0], np.cumsum(_ones(high))[:-1]))
        return cls({"meta": np.array([n, bits], np.int64), "low": low, "high": high, "before": before.astype(np.uint32 if n < 1 << 32 else np.uint64)})

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.uint64) * _U(self.bits)
        word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
        x = self.low[word] >> off
        over = np.flatnonzero(off + _U(self.bits) > _U(64))
        x[over] |= self.low[word[over] + 1] << (_U(64) - off[over])
        return (x & _U((1 << self.bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.before, i, "right") - 1
        one = word * 64 + _select_in_word(self.high[word], i - self.before[word].astype(np.int64))
        return ((one - i) << self.bits) | self._low(i)

    def all(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return ((ones - i) << self.bits) | self._low(i)

    def _first_at_or_after(self, h: np.ndarray) -> np.ndarray:
        """The number of values whose high part is below h: h zeros come before those that are not."""
        word_zeros = self.zeros
        k = h - 1
        word = np.clip(np.searchsorted(word_zeros, np.maximum(k, 0), "right") - 1, 0, len(self.high) - 1)
        zero = word * 64 + _select_in_word(~self.high[word], k - word_zeros[word])
        return np.where(h <= 0, 0, np.minimum(zero - k, self.n))

    @property
    def zeros(self) -> np.ndarray:
        if "zeros" not in self.arrays:
            kind = np.int32 if 64 * len(self.high) < 1 << 31 else np.int64
            self.arrays["zeros"] = np.arange(0, 64 * len(self.high), 64, kind) - np.asarray(self.before).astype(kind)
        return self.arrays["zeros"]

    def find(self, target: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of target values within [low, high), -1 where there is none: high parts tell the bucket, low parts the place in it."""
        h = target >> self.bits
        want = target & ((1 << self.bits) - 1)
        limit = len(self.zeros) * 64 - self.n - 1
        a = np.maximum(self._first_at_or_after(np.minimum(h, limit)), low)
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for _ in range(6):  # buckets hold one or two values on average
            i = a[left]
            at = i + h[left]
            word = np.minimum(at >> 6, len(self.high) - 1)
            # a value is in bucket h if its one stands before the bucket's zero
            here = (i < high[left]) & ((self.high[word] >> (at & 63).astype(np.uint64)) & _U(1)).astype(bool) & (at >> 6 == word)
            left, i = left[here], i[here]
            got, sought = self._low(i), want[left]
            same = got == sought
            out[left[same]] = i[same]
            left = left[got < sought]
            a[left] += 1
            if not len(left):
                return out
        z = np.minimum(self._first_at_or_after(np.minimum(h[left] + 1, limit)), high[left])
        i, sought = a[left], want[left]
        end = z.copy()
        while len(open_ := np.flatnonzero(i < z)):
            mid = (i[open_] + z[open_]) // 2
            less = self._low(mid) < sought[open_]
            i[open_] = np.where(less, mid + 1, i[open_])
            z[open_] = np.where(less, z[open_], mid)
        ok = i < end
        ok[ok] = self._low(i[ok]) == sought[ok]
        out[left[ok]] = i[ok]
        return out


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one block of bytes that can be mapped."""
    head, at, parts = {}, 0, []
    for k, v in arrays.items():
        data = np.ascontiguousarray(v).tobytes()
        head[k] = [v.dtype.str, len(v), at]
        data += bytes(-len(data) % 8)
        parts.append(data)
        at += len(data)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def view_arrays(block: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of pack_arrays(), without a copy."""
    n = int.from_bytes(bytes(block[:8]), "little")
    base = 8 + n
    return {k: block[base + at : base + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, size, at) in json.loads(bytes(block[8:base])).items()}


def _sub(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k[len(prefix) :]: v for k, v in arrays.items() if k.startswith(prefix)}


def _quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs * _STEPS), 0, 65535).astype(np.uint16)


class Model:
    """The mapped files of a model; `shape` has the few numbers that place its shards."""

    def __init__(self, root: str, shape: dict) -> None:
        self.files, self.shape = SharedFiles(root), shape
        self.total, self.distinct = shape["tokens"], shape["words"]
        self._open: dict[str, dict[str, np.ndarray]] = {}
        self._held: dict[str, int] = {}
        self.unseen = -float(np.log10(self.total + self.distinct + 1))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        """A shard's arrays; what is not mapped is let go, the oldest first, beyond HELD_BYTES."""
        if name not in self._open:
            block = self.files.map(name)
            if not isinstance(block, np.memmap):
                while self._held and sum(self._held.values()) + len(block) > HELD_BYTES:
                    gone = next(iter(self._held))
                    del self._held[gone], self._open[gone]
                self._held[name] = len(block)
            self._open[name] = view_arrays(block.view(np.ndarray))
        return self._open[name]

    # -- level 1

    def by_hash(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that are not in the training texts."""
        out, starts, order = np.full(len(h), -1, np.int64), self.shape["starts"][0], np.argsort(h)
        h, width = h[order], 64 - self.shape["hash_bits"]
        bounds = [0, *np.searchsorted(h, np.array([s << width for s in range(1, len(starts) - 1)], np.uint64)).tolist(), len(h)]
        for s, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if a < z and starts[s + 1] > starts[s]:
                keys = self.arrays(f"1.{s}")["hash"]
                i = np.minimum(np.searchsorted(keys, h[a:z]), len(keys) - 1)
                out[order[a:z]] = np.where(keys[i] == h[a:z], i + starts[s], -1)
        return out

    def counts(self, words: np.ndarray) -> np.ndarray:
        """How often words occur, by number."""
        return self._gather(1, "count", words)

    # -- levels from 2 on

    def _gather(self, level: int, field: str, places: np.ndarray) -> np.ndarray:
        """A field of the n-grams at places of a level."""
        starts = np.array(self.shape["starts"][level - 1])
        if not len(places):
            return np.zeros(0, np.int64)
        if len(starts) == 2:
            return self.arrays(f"{level}.0")[field][places]
        shard = np.searchsorted(starts, places, "right") - 1
        out = np.zeros(len(places), np.int64)
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            out[at] = self.arrays(f"{level}.{s}")[field][places[at] - starts[s]]
        return out

    def _sequences(self, level: int, s: int) -> tuple[EliasFano, EliasFano]:
        a = self.arrays(f"{level}.{s}")
        if "_ptr" not in a:
            a["_ptr"], a["_succ"] = EliasFano(_sub(a, "ptr.")), EliasFano(_sub(a, "succ."))
        return a["_ptr"], a["_succ"]

    def find(self, level: int, contexts: np.ndarray, successors: np.ndarray, logs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, first place of the context, logarithm of the probability or nan, that of the backoff weight) of pairs in order of contexts.

        A negative successor has no place; without `logs` the logarithms are not read.
        """
        n, size = len(contexts), self.shape["range"][level - 1]
        place, first, prob, backoff = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, np.nan), np.zeros(n)
        bounds = np.searchsorted(contexts, np.arange(len(self.shape["starts"][level - 1])) * size)
        for s, (i, j) in enumerate(zip(bounds.tolist(), [*bounds[1:].tolist(), n], strict=True)):
            if i == j:
                continue
            start = self.shape["starts"][level - 1][s]
            c = contexts[i:j] - s * size
            new = np.concatenate(([True], c[1:] != c[:-1]))
            of, c = np.cumsum(new) - 1, c[new]
            ptr, succ = self._sequences(level, s)
            a = self.arrays(f"{level}.{s}")
            low, high = ptr.access(c), ptr.access(c + 1)
            first[i:j] = (low + start)[of]
            if logs:
                backoff[i:j] = (a["backoff"][c] / -_STEPS)[of]
            if not succ.n:
                continue
            base = np.where(low > 0, succ.access(np.maximum(low - 1, 0)), 0)
            use = np.flatnonzero((high > low)[of] & (successors[i:j] >= 0))
            of = of[use]
            got = succ.find(base[of] + successors[i:j][use] + 1, low[of], high[of])
            use, got = use[got >= 0], got[got >= 0]
            place[i + use] = got + start
            if logs:
                prob[i + use] = a["prob"][got] / -_STEPS
        return place, first, prob, backoff

    def _range(self, level: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(context, successor) of the n-grams at places low to high of a level from 2 on."""
        contexts, successors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        starts = self.shape["starts"][level - 1]
        for s, (a, z) in enumerate(zip(starts, starts[1:], strict=False)):
            if max(a, low) < min(z, high):
                ptr, succ = self._sequences(level, s)
                ends, values = ptr.all(), succ.all()
                c = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                base = np.where(ends[:-1] > 0, values[np.maximum(ends[:-1] - 1, 0)], 0)
                i, j = max(low - a, 0), min(high, z) - a
                contexts.append(c[i:j] + s * self.shape["range"][level - 1])
                successors.append((values - base[c] - 1)[i:j])
        return np.concatenate(contexts), np.concatenate(successors)

    def firsts(self, level: int, contexts: np.ndarray) -> np.ndarray:
        """The first places of contexts of a level, in any order."""
        c, back = np.unique(contexts, return_inverse=True)
        return self.find(level, c, np.full(len(c), -1))[1][back]

    def shorter(self, level: int, low: int, high: int) -> np.ndarray:
        """For the n-grams at places low to high of a level from 2 on, the place of each without its first word."""
        contexts, successors = self._range(level, low, high)
        if level == 2 or not len(contexts):
            return successors
        a = int(contexts[0])
        return self.firsts(level - 1, self.shorter(level - 1, a, int(contexts[-1]) + 1)[contexts - a]) + successors

    def probs(self, level: int, places: np.ndarray) -> np.ndarray:
        """Base-10 logarithms of the probabilities at places of a level."""
        if level == 1:
            return np.log10(self.counts(places) + 1) + self.unseen
        return self._gather(level, "prob", places) / -_STEPS

    def walk(self, ids: np.ndarray, doc: np.ndarray, upto: int, score: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, first place of its context) of the n-gram of `upto` words that ends at each token, -1 where there is none.

        `score`, if given, becomes the logarithm of each token's probability.
        """
        place, first = ids, np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        for level in range(2, upto + 1):
            at = inner[place[inner - 1] >= 0]
            if score is None:
                at = at[place[at] >= 0]
            context, successor = place[at - 1], np.where(place[at] >= 0, place[at] - first[at], -1)
            (c, x), back = _unique_pairs(context, successor + 1)
            got = self.find(level, c, x - 1, score is not None)
            if score is not None:
                prob = got[2][back]
                score[at] = np.where(np.isnan(prob), score[at] + got[3][back], prob)
                if level == upto:
                    break
            place, first = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
            place[at], first[at] = got[0][back], got[1][back]
        return place, first

    def logs(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, model, known) of each token: base-10 logarithms and whether its count is above zero."""
        known = ids >= 0
        base = np.full(len(ids), self.unseen)
        base[known] += np.log10(self.counts(ids[known]) + 1)
        score = base.copy()
        self.walk(ids, doc, self.shape["order"], score)
        return base, score, known


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct pairs, sorted, and for each given pair the place of its like."""
    if not len(a):
        return (a, b), np.zeros(0, np.int64)
    if int(a.max()) < 1 << 31 and int(b.max()) < 1 << 32:
        code = a.astype(np.uint64) << _U(32) | b.astype(np.uint64)
        order = np.argsort(code)
        code = code[order]
        new = np.concatenate(([True], code[1:] != code[:-1]))
        code = code[new]
        pairs = (code >> _U(32)).astype(np.int64), (code & _U(0xFFFFFFFF)).astype(np.int64)
    else:
        order = np.lexsort((b, a))
        new = np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
        pairs = a[order][new], b[order][new]
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return pairs, back


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, with the sums of their counts (1 each if none are given)."""
    if n is None and len(a) and int(a.max()) < 1 << 31 and int(b.max()) < 1 << 32:
        code = np.sort(a.astype(np.uint64) << _U(32) | b.astype(np.uint64))
        new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        code = code[new]
        return (code >> _U(32)).astype(np.int64), (code & _U(0xFFFFFFFF)).astype(np.int64), np.diff(np.append(new, len(a)))
    (a2, b2), back = _unique_pairs(a, b)
    return a2, b2, np.bincount(back, n, len(a2)).astype(np.int64)


def _words(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(first row, distinct words, code of each token, end of each row's tokens) of a column of texts, BATCH_BYTES at a time.

    A-Z is lower-cased, words are told apart by ASCII white space, and each row ends with END, which has the code -1.
    """
    column = texts.fill_null("").cast(pa.large_binary())
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH_BYTES, "right")) - 1)
        text, bounds = data[at[i] : at[j]], at[i : j + 1] - at[i]
        inside = _INSIDE[text]
        first = inside.copy()
        np.greater(inside[1:], inside[:-1], out=first[1:])
        begun = bounds[:-1][bounds[:-1] < bounds[1:]]
        first[begun] = inside[begun]
        last = inside.copy()  # the last byte of a word: before white space or the next row
        np.greater(inside[:-1], inside[1:], out=last[:-1])
        over = bounds[1:][bounds[1:] > 0] - 1
        last[over] = inside[over]
        starts = np.flatnonzero(first)
        sizes = np.flatnonzero(last) + 1 - starts
        packed = pa.py_buffer(_LOWER[text[inside]])  # without the white space
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes)))), packed]).dictionary_encode()
        ends = np.searchsorted(starts, bounds[1:])
        codes = np.insert(words.indices.to_numpy(), ends, -1)
        yield i, words.dictionary, codes, ends + np.arange(1, len(ends) + 1)
        i = j


def _hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist(), repeat(42)), np.uint64, len(words))


def _deal(shards: int, df: DataFrame) -> DataFrame:
    return df.repartition(max(1, shards), "shard").sortWithinPartitions("shard")


def _count_words(texts: DataFrame) -> DataFrame:
    """(h, n): how often each word occurs, by its hash; words of one 64-bit hash count as one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0

        def out():
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return h[new], np.add.reduceat(n, new)

        for b in it:
            for _, words, codes, ends in _words(b.column(0)):
                held.append((_hashes(words), np.bincount(codes[codes >= 0], minlength=len(words))))
                size, rows = size + len(words), rows + len(ends)
                if size > 1_000_000:
                    held = [out()]
                    if len(held[0][0]) > 600_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["h", "n"])
                        held = []
                    size = sum(len(h) for h, _ in held)
        if rows:
            held.append((_hashes(pa.array([END], pa.binary())), np.array([rows])))
            h, n = out()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _write_words(root: str, df: DataFrame) -> DataFrame:
    """Write the shards of level 1 from rows (shard, h, n) sorted by shard and hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, now, parts, done = SharedFiles(root), None, [], []

        def close() -> None:
            h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            files.write(f"1.{now}", pack_arrays({"hash": h[order], "count": n[order].astype(np.uint64 if n.max() >= 1 << 32 else np.uint32)}))
            done.append((now, len(h)))

        for b in it:
            shard, h, n = (b.column(k).to_numpy() for k in range(3))
            for s in np.unique(shard).tolist():
                if s != now and parts:
                    close()
                    parts.clear()
                now = s
                at = shard == s
                parts.append((h[at].view(np.uint64), n[at]))
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([n for _, n in done], pa.int64())], ["shard", "n"])

    return df.mapInArrow(run, "shard int, n long")


def number_bytes(shape: dict) -> int:
    """Bytes of a word number."""
    return 4 if shape["words"] < 1 << 31 else 8


def number(docs: DataFrame, root: str, shape: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """(keep, numbers binary) of every row: its tokens' word numbers as integers of number_bytes(), -1 for unseen words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(root, shape)
        end = int(model.by_hash(_hashes(pa.array([END], pa.binary())))[0])
        for b in it:
            for at, words, codes, ends in _words(b.column(len(keep))):
                ids = np.append(model.by_hash(_hashes(words)), end)[codes].astype(f"<i{width}")  # the last one is that of END
                cuts = np.concatenate(([0], ends * width))
                data = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(ends)) for k in range(len(keep))), data.cast(pa.binary())], [*keep, "numbers"])

    width = number_bytes(shape)
    part = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    return part.mapInArrow(run, part.select(*keep).schema.add("numbers", "binary"))


def _number_batches(it: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch, list[int]]]:
    """(numbers, row of each, rows, lengths), about LOOKUP_TOKENS numbers at a time."""
    for b in it:
        data = b.column(column).to_pylist()
        sizes, at = [len(x) // width for x in data], 0
        while at < len(data):
            end, total = at, 0
            while end < len(data) and (total == 0 or total + sizes[end] <= LOOKUP_TOKENS):
                total += sizes[end]
                end += 1
            ids = np.frombuffer(b"".join(data[at:end]), f"<i{width}").astype(np.int64)
            yield ids, np.repeat(np.arange(end - at), sizes[at:end]), b.slice(at, end - at), sizes[at:end]
            at = end


def _packed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs and their counts, compressed: steps of a, then b and n, in as many bytes as they need."""
    parts = [np.diff(a, prepend=0), b, n]
    kinds = ["<u1" if not len(x) or x.max() < 1 << 8 else "<u2" if x.max() < 1 << 16 else "<u4" if x.max() < 1 << 32 else "<u8" for x in parts]
    head = len(a).to_bytes(8, "little") + "".join(kinds).encode()
    # bytes of one weight together: they are alike
    planes = [np.ascontiguousarray(x.astype(k).view(np.uint8).reshape(len(x), -1).T).tobytes() for x, k in zip(parts, kinds, strict=True)]
    return zlib.compress(head + b"".join(planes), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 17, []
    for k in range(3):
        kind = np.dtype(raw[8 + 3 * k : 11 + 3 * k].decode())
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n).astype(np.int64))
        at += n * kind.itemsize
    return np.cumsum(out[0]), out[1], out[2]


def _count_level(numbered: DataFrame, root: str, shape: dict, level: int, size: int) -> DataFrame:
    """Packed counts (shard, data) of the n-grams of a level, summed in each task and sorted by context and successor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, held_size = Model(root, shape), [], 0

        def out():
            a, b, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            names, first = np.unique(a // size, return_index=True)
            bounds = [*first.tolist(), len(a)]
            data = [_packed(a[i:j] - s * size, b[i:j], n[i:j]) for s, i, j in zip(names.tolist(), bounds, bounds[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])

        for ids, doc, _, _ in _number_batches(it, 0, number_bytes(shape)):
            place, first = model.walk(ids, doc, level - 1)
            at = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0) & (doc[1:] == doc[:-1])) + 1
            held.append((place[at - 1], place[at] - first[at]))
            held_size += len(at)
            if held_size > COUNT_TOKENS:
                yield out()
                held, held_size = [], 0
        if held:
            yield out()

    return numbered.select("numbers").mapInArrow(run, "shard int, data binary")


def _write_level(df: DataFrame, root: str, shape: dict, level: int, size: int, contexts: int) -> DataFrame:
    """Merge each shard's counts, and write its pointers, successors, probabilities and backoff weights."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, parts, done = Model(root, shape), None, [], []

        def merged():
            return _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        def close() -> None:
            a, b, n = merged()
            mine = min(size, contexts - now * size)
            total = np.bincount(a, n, mine)
            keep = n >= shape["least_count"]
            a, b, n = a[keep], b[keep], n[keep]
            left = np.clip(1 - np.bincount(a, n - DISCOUNT, mine) / np.maximum(total, 1), 1e-9, 1.0)
            # the shorter n-gram is at least as frequent, so it was kept
            shorter = b if level == 2 else b + model.firsts(level - 1, model.shorter(level - 1, now * size, now * size + mine)[a])
            p = (n - DISCOUNT) / total[a] + left[a] * 10.0 ** model.probs(level - 1, shorter)
            ptr = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=mine))))
            # monotone: each context's successors, plus one, are added to what the context before ended with
            some = np.diff(ptr) > 0
            last = np.zeros(mine, np.int64)
            last[some] = b[ptr[1:][some] - 1] + 1
            base = np.cumsum(last) - last
            fields = {"prob": _quantise(np.log10(p)), "backoff": _quantise(np.log10(left))}
            for name, values in (("ptr", ptr), ("succ", base[a] + b + 1)):
                fields |= {f"{name}.{k}": v for k, v in EliasFano.build(values).arrays.items()}
            model.files.write(f"{level}.{now}", pack_arrays(fields))
            done.append((now, len(b)))

        for batch in it:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != now and parts:
                    close()
                    parts.clear()
                now = s
                parts.append(_unpacked(data) if data is not None else (np.zeros(0, np.int64),) * 3)
                if sum(len(x[0]) for x in parts) > 8_000_000 and len(parts) > 8:
                    parts[:] = [merged()]
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([n for _, n in done], pa.int64())], ["shard", "n"])

    return df.mapInArrow(run, "shard int, n long")


def _starts(rows: list, shards: int) -> list[int]:
    sizes = np.zeros(shards, np.int64)
    for s, n in rows:
        sizes[s] = n
    return [0, *np.cumsum(sizes).tolist()]


def learn_words(spark: SparkSession, docs: DataFrame, text_col: str = "text", order: int = ORDER, least_count: int = LEAST_COUNT) -> tuple[str, dict]:
    """Level 1 from every row; returns the model's folder and its shape (a few numbers for each shard)."""
    root = shared_path(spark, "lm")
    words = materialise(spark, _count_words(docs.select(F.col(text_col).cast("string").alias("text"))), "words")
    distinct, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-total // SHARD_TOKENS))
    bits = (shards - 1).bit_length()
    shape = {"order": order if distinct else 1, "least_count": least_count, "tokens": int(total), "words": int(distinct), "hash_bits": bits, "shards": shards, "starts": [], "range": [0]}
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = _deal(1 << bits, words.select(shard.alias("shard"), "h", "n"))
    shape["starts"].append(_starts(_write_words(root, dealt).collect(), 1 << bits))
    return root, shape


def learn_levels(spark: SparkSession, numbered: DataFrame, root: str, shape: dict) -> dict:
    """The levels from 2 on, from rows of word numbers; returns the shape with them."""
    shape = {**shape, "starts": list(shape["starts"]), "range": list(shape["range"])}
    for level in range(2, shape["order"] + 1):
        contexts = shape["starts"][-1][-1]
        size = max(1, -(-contexts // shape["shards"]))
        n_shards = max(1, -(-contexts // size)) if contexts else 1
        counted = _count_level(numbered, root, shape, level, size)
        every = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("data"))
        rows = _write_level(_deal(n_shards, counted.unionByName(every)), root, shape, level, size, contexts).collect()
        shape["starts"].append(_starts(rows, n_shards))
        shape["range"].append(size)
    return shape


def score(numbered: DataFrame, root: str, shape: dict, keep: list[str]) -> DataFrame:
    """(keep, n_tokens, n_known, base_score, score) of every row of word numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(root, shape)
        for ids, doc, b, sizes in _number_batches(it, len(keep), number_bytes(shape)):
            base, logs, known = model.logs(ids, doc)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(np.bincount(doc, known, n).astype(np.int64)), pa.array(np.bincount(doc, base, n)), pa.array(np.bincount(doc, logs, n))], [*keep, "n_tokens", "n_known", "base_score", "score"])

    part = numbered.select(*keep, "numbers")
    return part.mapInArrow(run, part.select(*keep).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those whose crc32 modulo 7 is not 2."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (crc32_mod("doc_id", 7) == 2).alias("held_out"))
    root, shape = learn_words(spark, docs.where(~F.col("held_out")))
    numbered = materialise(spark, number(docs, root, shape, ["doc_id", "held_out"]), "numbers")
    shape = learn_levels(spark, numbered.where(~F.col("held_out")), root, shape)
    out = score(numbered, root, shape, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(shape["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
