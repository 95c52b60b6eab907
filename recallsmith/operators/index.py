"""An inverted index in storage that grows by segments and skips what can't be among the best.

A segment holds a batch of rows: `docs` (id, dl, terms, tfs) with the words of each row, counted within the row; `postings` (term, block, most, least, n, ids, tfs, dls), a row
for each word of a block with its rows' ids, counts and lengths, the greatest count, the least length and their number; and `prefixes` with the number of rows that have a word
beginning with each prefix. Both are made from runs of `docs` within tasks, without a shuffle of postings, and each run is sorted by word, so that the statistics of a file's pages
leave a term a few of them. A query's terms stand for all words that begin with them and have three characters at least.

Blocks are some BLOCK rows of one run with nearly the same number of words, and nearly the same count of their commonest word. A term's score grows with tf and falls with dl; so the sum over a term's words of the
greatest tf, with the least dl, bounds what any row of a block can get from it, whatever the corpus has become since the block was written. A search reads
the bounds, scores the blocks with the greatest ones, and takes the kth score as a threshold; then it reads the postings of the blocks whose bound reaches
it. Nothing below can be among the best k, so the rows are those of a full scan.

Deletes are tombstones (segment, id) with the words they take away. All statistics are sums over segments minus sums over tombstones, so any order of appends,
deletes and merges gives what a rebuild would. A merge rewrites small segments from `docs`, without texts. See sources/manifest.py for how changes become
visible.

Cases: rows without words count in n and, unless their text is null, in the mean length, and nowhere else; rows without an id are not indexed; a row that is appended again replaces the earlier one, and of
equal ids in one append the one with the greatest text stays; unknown ids may be deleted; a query without terms, and an empty index, give no row; ties are in
the order of ids.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.functions import text
from recallsmith.sources.manifest import Manifest, spread

#: Characters of the shortest word and prefix.
HEAD = 3
#: Rows of a block, and the longest prefix that is counted ahead; longer terms are counted in their postings.
BLOCK, LONGEST = 128, 32
#: Rows of the blocks that are scored first for a threshold, for each wanted row, and blocks that are looked up by their numbers.
FIRST, LOOKUP = 4, 1000
#: Up to so many tombstones or blocks are broadcast.
BROADCAST_ROWS = 50_000
_DOCS = "id string, dl long, terms array<string>, tfs array<int>"
_POSTINGS = "term string, block long, most int, least long, n long, ids array<string>, tfs array<int>, dls array<long>"
_PREFIXES = "prefix string, df long"
#: Postings that a task sorts at a time, and rows of an Arrow batch that it hands over.
RUN, ROWS = 1 << 20, 1 << 15


def counted(memories: DataFrame) -> DataFrame:
    """(id, dl, terms, tfs): the number of words of each row, and its words with their counts; no shuffle."""
    word = re.compile(text.TOKEN)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            dl, terms, tfs, ends = [], [], [], [0]
            for t in b.column(1).to_pylist():
                found = word.findall(t or "")
                own = Counter(found)
                dl.append(None if t is None else len(found))
                terms.extend(own)
                tfs.extend(own.values())
                ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.string()), (tfs, pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dl, pa.int64()), *lists], ["id", "dl", "terms", "tfs"])

    return memories.select(F.col("id").cast("string").alias("id"), F.lower("text").alias("text")).mapInArrow(run, _DOCS)


def postings(memories: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of every word of every row; dl counts the words of a row."""
    return counted(memories).select("id", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).select("term", "id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("int").alias("dl"))


class _Run:
    """The words of some rows of `docs`: `words`, the different ones of HEAD characters at least in order, and for each posting its row, the place of its word, and its count."""

    def __init__(self, rows: pa.Table) -> None:
        self.size = len(rows)
        self.ids, self.dl = rows["id"].combine_chunks(), rows["dl"].combine_chunks()
        lists = rows["terms"].combine_chunks()
        term, tf = lists.flatten().dictionary_encode(), rows["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(self.size), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        order = pc.sort_indices(term.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words = term.dictionary.take(pa.array(order))
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        number = np.cumsum(lengths >= HEAD) - 1
        word = place[term.indices.to_numpy(zero_copy_only=False)]
        kept = lengths[word] >= HEAD
        self.words = words.filter(pa.array(lengths >= HEAD))
        self.lengths = lengths[lengths >= HEAD]
        self.row, self.word, self.tf = row[kept], number[word[kept]], tf[kept]

    def classes(self) -> np.ndarray:
        """Rows of one class differ by less than a fifth in their numbers of words, and by less than a half in the count of their commonest word."""
        most = np.ones(self.size, np.int64)
        np.maximum.at(most, self.row, self.tf)
        steps = lambda c, k: np.floor(k * np.log2(np.maximum(c, 1).astype(float))).astype(np.int64)
        return steps(pc.fill_null(self.dl, 1).to_numpy(zero_copy_only=False), 4) * 256 + steps(most, 2)

    def postings(self, block: int, first: int) -> tuple[pa.RecordBatch, int]:
        """The rows of `postings`, in order of words and blocks of `block` rows, whose numbers begin at `first`; and the number of blocks."""
        own = self.classes()
        order = np.argsort(own, kind="stable")
        new = np.concatenate(([True], np.diff(own[order]) != 0)) if self.size else np.zeros(0, bool)
        begun = np.flatnonzero(new)[np.cumsum(new) - 1]  # where a row's class begins
        cuts = new | ((np.arange(self.size) - begun) % block == 0)
        number, at = np.empty(self.size, np.int64), np.empty(self.size, np.int64)
        number[order], at[order] = np.cumsum(cuts) - 1, np.arange(self.size)
        sort = np.argsort(self.word * max(self.size, 1) + at[self.row], kind="stable")
        row, word, tf = self.row[sort], self.word[sort], self.tf[sort]
        of, dl = number[row], pc.fill_null(self.dl, 0).to_numpy(zero_copy_only=False)[row]
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(word) != 0) | (np.diff(of) != 0)))) if len(row) else np.zeros(0, np.int64)
        ends = pa.array(np.append(starts, len(row)).astype(np.int32))
        fold = lambda f, x: f.reduceat(x, starts) if len(starts) else x[:0]
        lists = (pa.ListArray.from_arrays(ends, x) for x in (self.ids.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl, pa.int64())))
        cols = [self.words.take(pa.array(word[starts])), pa.array(of[starts] + first), pa.array(fold(np.maximum, tf), pa.int32()), pa.array(fold(np.minimum, dl), pa.int64()), pa.array(np.diff(np.append(starts, len(row))), pa.int64()), *lists]
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _POSTINGS.split(", ")]), int(cuts.sum())

    def prefixes(self) -> Iterator[pa.RecordBatch]:
        """(prefix, df): in how many rows a word begins with each prefix. In the order of words those of one prefix are neighbours, so a row's words are counted by where it changes."""
        sort = np.argsort(self.row * max(len(self.words), 1) + self.word, kind="stable")
        row, word = self.row[sort], self.word[sort]
        for size in range(HEAD, LONGEST + 1):
            kept = self.lengths[word] >= size
            row, word = row[kept], word[kept]
            if not len(row):
                return
            heads = pc.utf8_slice_codeunits(self.words, 0, size).dictionary_encode()
            head = heads.indices.to_numpy(zero_copy_only=False)[word]
            new = np.concatenate(([True], (np.diff(row) != 0) | (np.diff(head) != 0)))
            n = np.bincount(head[new], minlength=len(heads.dictionary))
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([heads.dictionary.take(pa.array(has)), pa.array(n[has], pa.int64())], ["prefix", "df"])


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    """Runs of about RUN postings each."""
    held, n = [], 0
    for b in it:
        for at in range(0, len(b), 64):  # a batch of long texts may be several runs
            part = b.slice(at, 64)
            k = len(part["terms"].flatten())
            if held and n + k > RUN:
                yield _Run(pa.Table.from_batches(held))
                held, n = [], 0
            held.append(part)
            n += k
    if held:
        yield _Run(pa.Table.from_batches(held))


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(b), ROWS):
        yield b.slice(at, ROWS)


def _grouped(docs: DataFrame) -> DataFrame:
    """The postings of `docs`; a task numbers its blocks above its own number."""
    block = BLOCK

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for r in _runs(it):
            rows, n = r.postings(block, first)
            first += n
            yield from _slices(rows)

    return docs.select("id", "dl", "terms", "tfs").mapInArrow(run, _POSTINGS)


def _prefixes(docs: DataFrame) -> DataFrame:
    """(prefix, df) of all beginnings of words, of HEAD to LONGEST characters; runs are counted in tasks, and their sums are shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(it):
            for b in r.prefixes():
                yield from _slices(b)

    return docs.select("id", "dl", "terms", "tfs").mapInArrow(run, _PREFIXES).groupBy("prefix").agg(F.sum("df").alias("df"))


class TextIndex:
    """The index below a path in shared storage."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.manifest = Manifest(spark, path)

    # --- changes ---

    def append(self, memories: DataFrame) -> TextIndex:
        """Index rows (id, text) as a segment; live rows with the same ids are replaced."""
        rows = memories.where("id IS NOT NULL").select("id", "text")
        if not rows.groupBy("id").count().where("count > 1").isEmpty():  # ids alone are compared; texts are shuffled only where some repeat
            rows = rows.groupBy("id").agg(F.max("text").alias("text"))
        number, at = self.manifest.fresh()
        counted(spread(rows)).write.option("compression", "zstd").parquet(f"{at}/docs")
        docs = self.manifest.read([number], "docs", _DOCS)
        old = self._tombstones(docs.select("id"))
        self.manifest.commit(add=[self._write(number, at, docs), *old])
        return self

    def _write(self, number: int, at: str, docs: DataFrame) -> dict:
        """The tables of a segment whose `docs` are written; returns its row for the manifest."""
        rows, texts, words = docs.agg(F.count("*"), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        # small pages have statistics of their own
        _grouped(docs).write.option("compression", "zstd").option("parquet.page.size", 64 << 10).parquet(f"{at}/postings")
        _prefixes(docs).sortWithinPartitions("prefix").write.parquet(f"{at}/prefixes")
        return {"kind": "segment", "number": number, "segment": number, "rows": rows, "words": words, "texts": texts}

    def delete(self, ids: DataFrame) -> TextIndex:
        """Take rows (id) out."""
        if old := self._tombstones(ids):
            self.manifest.commit(add=old)
        return self

    def _tombstones(self, ids: DataFrame) -> list[dict]:
        """Write tombstones of the live rows among ids, with the prefixes they take away; returns the rows for the manifest, one for each segment."""
        live = self._live("docs", _DOCS)
        if live is None:
            return []
        number, at = self.manifest.fresh()
        live.join(ids.select(F.col("id").cast("string")).distinct(), "id", "left_semi").write.parquet(f"{at}/dead")
        dead = self.spark.read.schema(_DOCS + ", segment long").parquet(f"{at}/dead")
        found = dead.groupBy("segment").agg(F.count("*").alias("rows"), F.count("dl").alias("texts"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).collect()
        if found:
            of = [_prefixes(dead.where(F.col("segment") == r["segment"])).withColumn("segment", F.lit(r["segment"])) for r in found]
            reduce(DataFrame.unionByName, of).sortWithinPartitions("prefix").write.parquet(f"{at}/minus")
        return [{"kind": "gone", "number": number, "segment": r["segment"], "rows": r["rows"], "words": r["words"], "texts": r["texts"]} for r in found]

    def merge(self, below: int | None = None) -> TextIndex:
        """Rewrite the segments of fewer than `below` live rows, all by default, as one without their tombstones."""
        rows = self.manifest.rows()
        live = {r["number"]: r["rows"] - sum(g["rows"] for g in rows if g["kind"] == "gone" and g["segment"] == r["number"]) for r in rows if r["kind"] == "segment"}
        small = [n for n, k in live.items() if below is None or k < below]
        if not small:
            return self
        docs = self._live("docs", _DOCS).where(F.col("segment").isin(small)).drop("segment")
        number, at = self.manifest.fresh()
        docs.write.option("compression", "zstd").parquet(f"{at}/docs")
        new = self._write(number, at, self.manifest.read([number], "docs", _DOCS))
        # tombstones of segments that stay are kept, row by row
        kept = [r for r in rows if r["kind"] == "gone" and r["segment"] not in small]
        self.manifest.commit(add=[new, *({k: r[k] for k in ("kind", "number", "segment", "rows", "words", "texts")} for r in kept)], drop=[*small, *(r["number"] for r in rows if r["kind"] == "gone")])
        return self

    # --- reading ---

    def _parts(self) -> tuple[list[int], list[dict]]:
        """The live segments, and the tombstones' rows of the manifest."""
        rows = self.manifest.rows()
        return [r["number"] for r in rows if r["kind"] == "segment"], [r for r in rows if r["kind"] == "gone"]

    def _rows(self, name: str, schema: str) -> DataFrame | None:
        """The rows of a table of all segments, with their segment; None without segments."""
        segments = self._parts()[0]
        return self.manifest.read(segments, name, schema) if segments else None

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, id, ...) without dead ids."""
        gone = self._parts()[1]
        if not gone:
            return rows
        dead = self.manifest.read(sorted({r["number"] for r in gone}), "dead", _DOCS + ", segment long").select("segment", "id")
        return rows.join(F.broadcast(dead) if sum(r["rows"] for r in gone) <= BROADCAST_ROWS else dead, ["segment", "id"], "left_anti")

    def _live(self, name: str, schema: str) -> DataFrame | None:
        """The rows of a table of all segments, with their segment, without dead ids; None without segments."""
        rows = self._rows(name, schema)
        return None if rows is None else self._alive(rows)

    def _each(self, grouped: DataFrame) -> DataFrame:
        """(segment, term, block, id, tf, dl, ...) of the live rows of grouped postings."""
        more = [c for c in grouped.columns if c not in ("most", "least", "n", "ids", "tfs", "dls")]
        return self._alive(grouped.select(*more, F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl")))))

    def numbers(self) -> tuple[int, float]:
        """The number of live rows, and the mean number of words of those with a text."""
        rows = self.manifest.rows()
        n, words, texts = (sum(r[k] if r["kind"] == "segment" else -r[k] for r in rows) for k in ("rows", "words", "texts"))
        return n, words / texts if texts else 0.0

    @property
    def stats(self) -> DataFrame:
        """One row (n, avgdl)."""
        return self.spark.createDataFrame([self.numbers()], "n long, avgdl double")

    def postings(self) -> DataFrame:
        """(term, id, tf, dl, ...) of the live rows."""
        rows = self._rows("postings", _POSTINGS)
        return self.spark.createDataFrame([], "segment long, term string, block long, id string, tf int, dl long") if rows is None else self._each(rows)

    def of_words(self, words: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings (term, id, ...) of whole words (term), and (term, df), with how many live rows have them; counts come from the blocks' own where nothing is deleted."""
        rows = self._rows("postings", _POSTINGS)
        if rows is None:
            none = self.postings().select("term", "id")
            return none, none.groupBy("term").agg(F.count("*").alias("df"))
        mine = rows.join(words.select("term").distinct(), "term", "left_semi")
        each = self._each(mine)
        return each, each.groupBy("term").agg(F.count("*").alias("df")) if self._parts()[1] else mine.groupBy("term").agg(F.sum("n").alias("df"))

    def counts(self, terms: list[str]) -> dict[str, int]:
        """The number of live rows with a word that begins with each term."""
        segments, gone = self._parts()
        out = dict.fromkeys(terms, 0)
        short = [t for t in terms if len(t) <= LONGEST]
        at = F.col("prefix").isin(short)
        if segments and short:
            told = self.manifest.read(segments, "prefixes", _PREFIXES).where(at).select("prefix", "df")
            if gone:
                less = self.manifest.read(sorted({r["number"] for r in gone}), "minus", _PREFIXES + ", segment long").where(at & F.col("segment").isin(segments))
                told = told.unionByName(less.select("prefix", (-F.col("df")).alias("df")))
            out.update(told.groupBy("prefix").agg(F.sum("df")).collect())
        for t in terms:
            if len(t) > LONGEST:
                out[t] = self.postings().where(F.col("term").startswith(t)).agg(F.countDistinct("id")).first()[0]
        return out

    def _of_terms(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of words that begin with a term, with i, the term's number; a word may begin with several."""
        found = [rows.where(F.col("term").startswith(t)).withColumn("i", F.lit(i)) for i, t in enumerate(terms)]
        return reduce(DataFrame.unionByName, found)

    def _weights(self, terms: list[str]) -> tuple[list[float], float]:
        """Each term's weight, and the mean length."""
        n, mean = self.numbers()
        df = self.counts(terms)
        row = self.spark.range(1).select(*(F.greatest(F.log((F.lit(n) - F.lit(df[t]) + 0.5) / (F.lit(df[t]) + 0.5)), F.lit(1e-6)) for t in terms)).first()
        return list(row), mean

    @staticmethod
    def _score(weights: list[float], mean: float, tf: list[Column], dl: list[Column], k1: float, b: float) -> Column:
        parts = [w * t * (k1 + 1) / (t + k1 * (1 - b + b * d / F.lit(mean))) for w, t, d in zip(weights, tf, dl, strict=True)]
        return reduce(lambda x, y: x + y, (F.when(t > 0, p).otherwise(0.0) for t, p in zip(tf, parts, strict=True)))

    def _scored(self, found: DataFrame, terms: list[str], weights: list[float], mean: float, k1: float, b: float) -> DataFrame:
        """(id, score) of postings of the query's terms."""
        at = range(len(terms))
        tf = found.groupBy("id").agg(F.first("dl").alias("dl"), *(F.sum(F.when(F.col("i") == i, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i in at))
        return tf.select("id", F.round(self._score(weights, mean, [F.col(f"tf{i}") for i in at], [F.col("dl")] * len(terms), k1, b), 9).alias("score"))

    def bm25(self, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) of all rows with a word of the query; higher is better. Frequencies count all words that begin with a term."""
        terms = text.query_terms(query)
        if not terms or not self._parts()[0]:
            return self.spark.createDataFrame([], "id string, score double")
        return self._scored(self._each(self._of_terms(self._rows("postings", _POSTINGS), terms)), terms, *self._weights(terms), k1, b)

    def bounds(self, terms: list[str], weights: list[float], mean: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(segment, block, bound, n): what a row of a block can get at most, and the postings of the terms in it."""
        every = self._of_terms(self._rows("postings", _POSTINGS), terms)
        at = range(len(terms))
        own = lambda i, c: F.when(F.col("i") == i, F.col(c))
        tops = every.groupBy("segment", "block").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(own(i, "most")), F.lit(0)).alias(f"tf{i}") for i in at), *(F.coalesce(F.min(own(i, "least")), F.lit(1)).alias(f"dl{i}") for i in at))
        # bounds are rounded up a little, scores to nine places
        return tops.select("segment", "block", (self._score(weights, mean, [F.col(f"tf{i}") for i in at], [F.col(f"dl{i}") for i in at], k1, b) + 1e-8).alias("bound"), "n")

    def best(self, query: str, limit: int, scope: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) of the best `limit` rows; `scope` (id) restricts them, not the statistics."""
        return self.search(query, limit, scope, k1, b)[0]

    def search(self, query: str, limit: int, scope: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, dict[str, int]]:
        """best(), and what it took: the postings of the terms, and those in the blocks that are read."""
        terms = text.query_terms(query)
        if not terms or not self._parts()[0]:
            return self.spark.createDataFrame([], "id string, score double"), {"postings": 0, "read": 0}
        weights, mean = self._weights(terms)
        tops = self.bounds(terms, weights, mean, k1, b)
        found = self._of_terms(self._rows("postings", _POSTINGS), terms)

        def ranked(blocks: DataFrame | None, few: list | None) -> DataFrame:
            rows = found
            if few is not None:  # block numbers reach the scan
                rows = rows.where(F.col("block").isin(sorted({r["block"] for r in few})))
            if blocks is not None:
                rows = rows.join(blocks, ["segment", "block"], "left_semi")
            scored = self._scored(self._each(rows), terms, weights, mean, k1, b)
            scored = scored if scope is None else scored.join(scope.select(F.col("id").cast("string")), "id", "left_semi")
            return scored.orderBy(F.desc("score"), "id").limit(limit)

        first, n = [], 0  # blocks with enough postings, of which some have few
        for r in tops.orderBy(F.desc("bound"), "segment", "block").limit(max(1, FIRST * limit)).select("block", "n").collect():
            if n >= FIRST * limit:
                break
            first.append(r)
            n += r["n"]
        kth = ranked(None, first).agg(F.when(F.count("*") == limit, F.min("score"))).first()[0] if first else None
        total = tops.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if kth is None:
            return ranked(None, None), {"postings": total[1], "read": total[1]}
        open_ = tops.where(F.col("bound") >= kth)
        n, read = open_.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        took = {"postings": total[1], "read": read}
        if n <= LOOKUP:
            return ranked(None, open_.select("block").collect()), took
        return ranked(F.broadcast(open_) if n <= BROADCAST_ROWS else open_, None), took


def build(memories: DataFrame, path: str) -> TextIndex:
    """Write the index of memories (id, text) to a path in shared storage."""
    return TextIndex(memories.sparkSession, path).append(memories)
