"""Benchmark decontamination: rare n-gram seeds find candidate pairs, Smith-Waterman alignment scores them.

Words are lower-cased runs without white space or punctuation. A seed is three of an item's words in order, with up to two words left out
among them (PATTERNS); it meets the same three words of a document whatever either side leaves out, so words that were put in, left out or replaced do not
hide it. An alignment of the least score has a certain number of seeds, each begun at another word of the item (fewest_seeds()). Half of
these may be spared: the words of an item whose own n-grams are the commonest, counted over all documents, begin no seed, and a
passage is aligned if it has seeds from as many of the rarer words as must be left. So every alignment with an item of seven words or more
that reaches LEAST_SCORE is found. A passage is a run of a document's words around seeds of one item; it is aligned with the item
locally, by words, so that edited, shortened and reworded copies score nearly as well as exact ones.

Cases: null and empty texts and items match nothing; an item shorter than a seed is one seed, found wherever its words run; one of three to six
words needs one seed; a null id of a document or an item is an id like any other; very long texts are read whole, and a passage grows no longer than the seeds that lie near each other; repeated rows
and items give a row each; an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.llm.common import bounded_batches, lighten

#: Places of a seed's words: up to two are left out.
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
_REACH = 4
SEED_WORDS = 3
#: Words of the longest passage whose alignment is remembered, and how many passages and bytes of them are.
MEMO_WORDS, MEMO_PASSAGES, MEMO_BYTES = 4096, 20_000, 8 << 20
#: Characters of the texts that are looked through at a time, whatever a batch holds; a longer text goes alone.
SLICE_CHARS = 1 << 18
#: An alignment's score divided by the item's own; from here on a document counts as contaminated.
LEAST_SCORE = 0.5
#: Items of at most this many bytes in all go to every task; larger sets are dealt into parts of this size.
PART_BYTES = 8 << 20
_MATCH, _MISMATCH, _GAP = 2, -1, -1
#: Entries of the table that tells most runs of words apart from seeds.
_SIEVE = 1 << 22
_SPLIT = re.compile(r"[^\w]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a whole text, without punctuation."""
    return [w for w in _SPLIT.split((text or "").lower()) if w]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """(score / own score of the item, first, end) of the best local alignment of two runs of word numbers.

    Two rows are kept, each cell as its score and, below it, how far from the passage's end its alignment began: of equal scores the earliest begun wins.
    """
    m, n = len(item), len(passage)
    if not m or not n:
        return 0.0, 0, 0
    scale = n + 2
    drop = np.arange(n + 1) * (-_GAP * scale)
    fresh = n + 1 - np.arange(n + 1)  # score 0, begun here
    row, best, end = fresh.copy(), fresh[0], 0
    for i in range(m):
        step = np.where(passage == item[i], _MATCH, _MISMATCH) * scale
        h = np.maximum(row + _GAP * scale, fresh)
        h[1:] = np.maximum(h[1:], row[:-1] + step)
        row = np.maximum(np.maximum.accumulate(h + drop) - drop, fresh)  # gaps along the passage
        j = int(np.argmax(row // scale))
        if row[j] // scale > best // scale:
            best, end = row[j], j
    score, begun = divmod(int(best), scale)
    return score / (_MATCH * m), n + 1 - begun, end


def fewest_seeds(size: int, least: float) -> int:
    """Words of an item of `size` words that begin a seed in any alignment of score `least` or more.

    With m matches the score leaves room for 2 * m - least * 2 * size edits. They lie between matches that follow each other, and three such matches
    are a seed unless three edits or more lie among them; each edit lies among at most two such threes.
    """
    score = math.ceil(_MATCH * least * size - 1e-9)
    return min((m - 2 - 2 * (_MATCH * m - score) // 3 for m in range(-(-score // _MATCH), size + 1)), default=0)


class Items:
    """Test items as word numbers, and their seeds as sorted codes."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: float = LEAST_SCORE) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words, self.least = [], [], least
        for item_id, text in items:
            got = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if got:
                self.ids.append(item_id)
                self.words.append(np.array(got, np.int64))
        self.base = len(self.vocabulary) + 2
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        fewest = np.array([fewest_seeds(int(n), least) for n in self.sizes], np.int64)
        self.spared = np.maximum(fewest // 2, 0)  # words that begin no seed
        self.need = np.maximum(fewest - self.spared, 1)
        self.keep([np.ones(len(w), bool) for w in self.words])

    def keep(self, begins: list[np.ndarray]) -> None:
        """Make seeds begin at these words only."""
        code, owner, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, w in enumerate(self.words):
            i, c = self.runs(w)
            i, c = i[begins[k][i]], c[begins[k][i]]
            code.append(c)
            at.append(i)
            owner.append(np.full(len(c), k, np.int64))
        code, self.owners, self.places = np.concatenate(code), np.concatenate(owner), np.concatenate(at)
        order = np.lexsort((self.places, self.owners, code))
        code, self.owners, self.places = code[order], self.owners[order], self.places[order]
        self.sorted, first = np.unique(code, return_index=True)
        self.first = np.append(first, len(code))
        self.sieve = np.zeros(_SIEVE, bool)
        self.sieve[self.sorted % _SIEVE] = True

    def grams(self) -> np.ndarray:
        """Sorted codes of all items' runs of three words that follow each other."""
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(self.codes(w, PATTERNS[0])[1] for w in self.words)]))

    def keep_rare(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Spare each item's words whose n-grams, given with how often documents have them, are the commonest."""
        begins = []
        for k, w in enumerate(self.words):
            i, c = self.codes(w, PATTERNS[0])
            mine = np.ones(len(w), bool)
            if len(i) and self.spared[k]:
                common = np.lexsort((i, -counts[np.searchsorted(grams, c)]))
                mine[i[common[: self.spared[k]]]] = False
            begins.append(mine)
        self.keep(begins)

    def codes(self, words: np.ndarray, pattern: tuple[int, ...], near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, codes) where all words of a pattern are known; `near` are the places of known words."""
        i = np.flatnonzero(words) if near is None else near
        i = i[i < len(words) - pattern[-1]]
        b, c = words[i + pattern[1]], words[i + pattern[2]]
        known = (b > 0) & (c > 0)
        i = i[known]
        return i, (words[i] * self.base + b[known]) * self.base + c[known]

    def runs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, codes) of the runs of known words, for each pattern."""
        near = np.flatnonzero(words)
        got = [self.codes(words, p, near) for p in PATTERNS]
        return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's words as numbers; 0 for words of no item."""
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, places in `sorted`) where a run of words is a seed of an item."""
        near, got = np.flatnonzero(numbers), []
        for p in PATTERNS:  # most runs are told apart before those of the next pattern are made
            i, c = self.codes(numbers, p, near)
            maybe = np.flatnonzero(self.sieve[c % _SIEVE])
            got.append((i[maybe], c[maybe]))
        at, code = (np.concatenate(x) for x in zip(*got, strict=True))
        if not len(self.sorted):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.sorted, code), len(self.sorted) - 1)
        found = self.sorted[place] == code
        return at[found], place[found]

    def short(self) -> list[int]:
        """Items with fewer words than a seed."""
        return [k for k, w in enumerate(self.words) if len(w) < SEED_WORDS]


class Finder:
    """Finds the passages of texts that align with items."""

    def __init__(self, items: Items, least: float | None = None) -> None:
        self.items, self.least = items, items.least if least is None else max(least, items.least)  # seeds answer for the items' own score
        self.short: dict[int, list[int]] = defaultdict(list)  # by first word
        for k in items.short():
            self.short[int(items.words[k][0])].append(k)
        self.firsts = np.array(sorted(self.short), np.int64)
        self.memo: dict[tuple[int, bytes], tuple[float, int, int]] = {}
        self.memo_bytes = 0

    def passages(self, numbers: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first, end) of the ranges of words to align in texts that end at `ends`: where an item's seeds are close together."""
        at, seed = self.items.hits(numbers)
        count = self.items.first[seed + 1] - self.items.first[seed]
        mine = np.repeat(self.items.first[seed] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        item, place = self.items.owners[mine], self.items.places[mine]
        at = np.repeat(at, count)
        if not len(at):
            return
        text = np.searchsorted(ends, at, "right")
        order = np.lexsort((at, text, item))
        at, place, item, text = at[order], place[order], item[order], text[order]
        # an alignment has at most as many edits as matches, so it is at most twice as long as its item
        reach = 2 * self.items.sizes + _REACH
        new = np.concatenate(([True], (np.diff(item) != 0) | (np.diff(text) != 0) | (np.diff(at) > reach[item[1:]])))
        run, first = np.cumsum(new) - 1, np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        longest = int(self.items.sizes.max()) + 1
        begins = np.bincount(np.unique(run * longest + place) // longest, minlength=len(first))
        begun = np.concatenate(([0], ends))
        for k in np.flatnonzero(begins >= self.items.need[item[first]]).tolist():
            i, t = int(item[first[k]]), int(text[first[k]])
            yield t, i, max(int(begun[t]), int(at[first[k]] - reach[i])), min(int(ends[t]) - _REACH, int(at[last[k]] + reach[i]))

    def find_all(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """For each text, (item_id, score, first word, end word) of the best passage for each item, from `least` on."""
        out: list[list[tuple[int, float, int, int]]] = []
        first = chars = 0
        for k, t in enumerate(texts):
            if first < k and chars + len(t or "") > SLICE_CHARS:
                out += self._find_some(texts[first:k])
                first, chars = k, 0
            chars += len(t or "")
        return out + self._find_some(texts[first:])

    def _find_some(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """find_all() of texts whose words are held at once."""
        apart = np.zeros(_REACH, np.int64)  # no seed reaches from one text into the next
        each = [np.concatenate((self.items.numbers(t), apart)) for t in texts]
        ends = np.cumsum([len(x) for x in each], dtype=np.int64)
        numbers = np.concatenate([apart[:0], *each])
        begun = np.concatenate(([0], ends))
        out: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        for p in np.flatnonzero(np.isin(numbers, self.firsts)).tolist() if self.short else ():
            t = int(np.searchsorted(ends, p, "right"))
            for k in self.short[int(numbers[p])]:
                w = self.items.words[k]
                if k not in out[t] and p + len(w) <= ends[t] and np.array_equal(numbers[p : p + len(w)], w):
                    out[t][k] = (1.0, p - int(begun[t]), p - int(begun[t]) + len(w))
        for t, k, a, z in self.passages(numbers, ends):
            window, words = numbers[a:z], self.items.words[k]
            # each match takes a word of the item that the passage has, and one of the passage that the item has
            if min(np.isin(words, window).sum(), np.isin(window, words).sum()) < self.least * len(words):
                continue
            key = (k, window.tobytes()) if len(window) <= MEMO_WORDS else None
            if key not in self.memo:
                if len(self.memo) > MEMO_PASSAGES or self.memo_bytes > MEMO_BYTES:
                    self.memo.clear()
                    self.memo_bytes = 0
                got = align(words, window)
                if key:
                    self.memo[key] = got
                    self.memo_bytes += len(key[1])
            else:
                got = self.memo[key]
            s, i, j = got
            if s >= self.least and s > out[t].get(k, (0.0,))[0]:
                out[t][k] = (s, a + i - int(begun[t]), a + j - int(begun[t]))
        return [[(self.items.ids[k], *x) for k, x in sorted(found.items())] for found in out]

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """find_all() of one text."""
        return self.find_all([text])[0]


def find_links(docs: DataFrame, finder: Finder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of each row's best passage for each item."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            out = [(d, *x) for d, found in zip(b.column(0).to_pylist(), finder.find_all(b.column(1).to_pylist()), strict=True) for x in found]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], ["doc_id", "item_id", "score", "first_word", "end_word"])

    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return part.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")


def gram_counts(docs: DataFrame, items: Items, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes, counts): how often all documents have the items' n-grams. Tasks send sums, one row per n-gram of the items."""
    grams = items.grams()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        sums = np.zeros(len(grams), np.int64)
        for b in it:
            for t in b.column(0).to_pylist():
                code = items.codes(items.numbers(t), PATTERNS[0])[1]
                place = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
                sums += np.bincount(place[grams[place] == code], minlength=len(grams))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["gram", "n"])

    counts = np.zeros(len(grams), np.int64)
    if len(grams):
        got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
        counts[got["gram"]] = got["n"]
    return grams, counts


def finders(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Iterator[Finder]:
    """A finder for each part of the benchmark, with seeds that are rare in the documents.

    Items go to the tasks in parts of at most PART_BYTES, measured first; each part is two scans of its own (n-grams are counted, then seeds found), so no task
    holds more than one part however large the benchmark is, and no row of the documents is shuffled.
    """
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-int(size) // PART_BYTES) or 1
    for k in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        items = Items(sorted(((r[0], r[1] or "") for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), least)
        if items.spared.any():
            items.keep_rare(*gram_counts(docs, items, text_col))
        yield Finder(items)


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All links between documents and test items, from a score of `least` on."""
    out = None
    for f in finders(docs, benchmark, least, text_col, item_col, item_text_col):
        links = find_links(docs, f, id_col, text_col)
        out = links if out is None else out.unionByName(links)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that have no link to a test item; no shuffle."""
    out = docs
    for f in finders(docs, benchmark, least, text_col, item_col, item_text_col):

        def run(it: Iterator[pa.RecordBatch], f: Finder = f) -> Iterator[pa.RecordBatch]:
            lighten()
            for b in it:
                yield b.filter(pa.array([not x for x in f.find_all(b.column(b.schema.get_field_index(text_col)).to_pylist())], pa.bool_()))

        out = out.mapInArrow(lambda it, run=run: run(it), docs.schema)
    return out


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that copies a benchmark item, exactly or edited, with its score and place."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
