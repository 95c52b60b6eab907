"""Ranked lexical search by Fagin's threshold algorithm, over a forward index in storage.

Building: one pass splits whole texts into terms and writes, for each document, its length, its distinct terms and their counts; and, from that table, the
number of documents and of terms. Searching: the weights of the query's terms come from their document counts. Then each task takes its documents in
blocks. In a block every query term has a list of documents sorted by impact, and a sorted key array answers what impact a document has for a term. For each
item the lists are read in rounds, one position of every list after another; documents met for the first time are looked up for their whole score; the
threshold is the sum of the impacts at the last positions read, and reading stops when it falls strictly below the kth score, so ties are all met. The
kth score of earlier blocks of a task holds for later ones. The best k of each task are merged by a window that ranks within tasks first.

The lists of a block are as many rounds long as its most frequent term; rounds are read in runs that double, which reads further than single rounds would, never less.

Terms of items lie in files of bounded parts in the shared folder, which tasks load one at a time: neither the driver nor a task holds all queries, and the
documents' index is read once, however many queries there are.

Cases: null and empty texts, and those without a term, match nothing and don't count; rows that repeat are each a document, and items that repeat (one id and one text) are one item,
while two texts under one id are ranked apart; rows and items without an id take part, ids that are null come last among equal scores; equal scores are in
ascending order of ids; no text is cut, however long; without documents, or items, there is no row; other columns pass by unread.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallsmith.llm.common import FEWEST, SharedFiles, bounded_batches, few_files, lighten, materialise, shared_path

TOP = 10
#: Postings of a block, terms of a part of the queries, and rounds that are read first.
BLOCK_POSTINGS, PART_TERMS, FIRST_ROUNDS = 1 << 20, 1 << 17, 8
#: Up to so many query terms are broadcast to be counted.
BROADCAST_TERMS = 100_000
_KEPT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a whole text in UTF-8: runs of letters and digits of ASCII, the letters in lower case, and of everything beyond ASCII."""
    return text.translate(_KEPT).split()


def _counts(rows: DataFrame, schema: str) -> DataFrame:
    """(id, n, terms, counts) of rows (id, text) that have a term."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            n, flat, tf, ends, keep = [], [], [], [0], []
            for i, t in enumerate(b.column(1).cast(pa.binary())):
                found = terms_of(t.as_py() or b"")
                if found:
                    own = Counter(found)
                    flat += own.keys()
                    tf += own.values()
                    n.append(len(found))
                    ends.append(len(flat))
                    keep.append(i)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((flat, pa.binary()), (tf, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    return rows.mapInArrow(run, schema)


class LexicalIndex:
    """A forward index: (id, n, terms, counts) of all documents that have a term, their number, and that of all terms."""

    def __init__(self, rows: DataFrame, documents: int, length: int) -> None:
        self.rows, self.documents, self.length = rows, documents, length

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
        """Write the index below the shared folder."""
        bounded_batches(spark)
        part = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        rows = materialise(spark, few_files(spark, _counts(part, "id long, n long, terms array<binary>, counts array<int>"), scanned=docs), "forward")
        documents, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        return cls(rows, documents, length)

    def document_counts(self, wanted: DataFrame) -> DataFrame:
        """(term, df) of the wanted terms that some document has."""
        each = self.rows.select(F.explode("terms").alias("term"))
        if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
            each = each.join(F.broadcast(wanted), "term")  # its size was checked
            return each.groupBy("term").agg(F.count("*").alias("df"))
        return each.groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term")


def weighted_terms(spark: SparkSession, index: LexicalIndex, items: DataFrame) -> DataFrame:
    """(item, term, times, w) of the items' terms that occur in documents; items (item, text)."""
    rows = _counts(items.select(F.col("item").alias("id"), "text"), "id long, n long, terms array<binary>, counts array<int>")
    terms = materialise(spark, rows.select(F.col("id").alias("item"), F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("times")))), "query").select("item", "term", "times")
    df = materialise(spark, index.document_counts(terms.select("term").distinct()).coalesce(FEWEST), "weights")
    w = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    return terms.join(df, "term").select("item", "term", "times", w.alias("w"))


def _write_parts(spark: SparkSession, terms: DataFrame, root: str) -> list[str]:
    """Write weighted terms as files of about PART_TERMS terms, whole items each, and return the files' names."""
    parts = max(1, -(-terms.count() // PART_TERMS))
    dealt = terms.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")).repartition(min(parts, 200), "part").sortWithinPartitions("part", "item", "term")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, part = SharedFiles(root), [], None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0].schema) as out:
                    for x in held:
                        out.write_batch(x)
                files.write(f"part-{part}", sink.getvalue().to_pybytes())
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([f"part-{part}"])], ["name"])

        for b in it:
            at = b.column(4).to_numpy()
            for x in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else ():
                if at[x[0]] != part:
                    yield from close()
                    part = int(at[x[0]])
                held.append(b.slice(int(x[0]), len(x)))
        yield from close()

    # one name for each part, which counts the queries' terms, not documents
    return sorted(r[0] for r in dealt.select("item", "term", "times", "w", "part").mapInArrow(run, "name string").collect())


class Queries:
    """A part of the queries: its vocabulary, and the terms of each item as places in it."""

    def __init__(self, data: np.ndarray) -> None:
        t = pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()
        order = np.argsort(t["item"].to_numpy(), kind="stable")
        items = t["item"].to_numpy()[order]
        coded = t["term"].combine_chunks().dictionary_encode()
        self.vocabulary = coded.dictionary
        terms = coded.indices.to_numpy()[order].astype(np.int64)
        self.weight = np.zeros(len(self.vocabulary), np.int64)
        self.weight[terms] = t["w"].to_numpy()[order]
        times = t["times"].to_numpy()[order].astype(np.int64)
        cuts = np.flatnonzero(np.diff(items)) + 1
        self.items = [(int(i[0]), x, y) for i, x, y in zip(np.split(items, cuts), np.split(terms, cuts), np.split(times, cuts), strict=True)]


class Block:
    """Documents of a part of the collection: impact-sorted lists and a forward index of a part of the queries."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, terms: pa.Array, tf: np.ndarray, documents: int, length: int, q: Queries) -> None:
        code = pc.index_in(terms, value_set=q.vocabulary)
        keep = code.is_valid().to_numpy(zero_copy_only=False)
        term = code.drop_null().to_numpy().astype(np.int64)
        # documents are numbered in the order of their ids, so that ties are in the order of numbers
        by_id = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[by_id] = np.arange(len(ids))
        self.ids, self.size = ids[by_id], len(q.vocabulary)
        doc, tf, own = number[doc[keep]], tf[keep].astype(np.int64), n[doc[keep]]
        m = 100 - 75 + (75 * own * documents) // length
        impact = q.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(self.size + 1))
        key = doc * self.size + term
        order = np.argsort(key, kind="stable")
        self.key, self.value = key[order], impact[order]

    def lookup(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The whole scores of some documents, by random access to the forward index."""
        wanted = docs[:, None] * self.size + terms[None, :]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return ((self.key[at] == wanted) * self.value[at] * times[None, :]).sum(1)

    def best(self, terms: np.ndarray, times: np.ndarray, top: int, floor: int) -> tuple[list[tuple[int, int]], int]:
        """([(score, id)] of the best `top` documents here with a score of `floor` at least, and above 0, in order; rounds that were read)."""
        start, stop = self.start[terms], self.start[terms + 1]
        terms, times, start, stop = (x[stop > start] for x in (terms, times, start, stop))
        seen = np.zeros(len(self.ids), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, run, longest = 0, FIRST_ROUNDS, int((stop - start).max(initial=0))
        while depth < longest:
            after = depth + run
            met = np.unique(np.concatenate([self.doc[s + depth : min(s + after, e)] for s, e in zip(start.tolist(), stop.tolist(), strict=True) if s + depth < e]))
            met = met[~seen[met]]
            seen[met] = True
            found = self.lookup(met, terms, times)
            good = found >= max(floor, 1)
            docs, scores = np.concatenate([docs, met[good]]), np.concatenate([scores, found[good]])
            order = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[order], scores[order]
            kth = max(int(scores[-1]) if len(scores) == top else 0, floor)
            depth, run = after, 2 * run
            # a document that no list has shown yet has no more than the last impacts read; lists that have ended give it nothing
            open_ = start + depth < stop
            if int((self.impact[start[open_] + depth - 1] * times[open_]).sum()) < kth:
                break
        return list(zip(scores.tolist(), self.ids[docs].tolist(), strict=True)), min(depth, longest)


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
    return sorted(a + b, key=lambda x: (-x[0], x[1]))[:top]


def _blocks(it: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """(ids, n, document of each posting, terms, counts) of blocks of about `most` postings, or of one document with more."""
    held: list[pa.RecordBatch] = []

    def closed() -> tuple:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        terms, counts = t["terms"].combine_chunks(), t["counts"].combine_chunks()
        sizes = pc.list_value_length(terms).to_numpy()
        return pc.fill_null(t["id"], _NO_ID).to_numpy(), t["n"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), terms.flatten(), counts.flatten().to_numpy()

    size = 0
    for b in it:
        if b.num_rows:
            held.append(b)
            size += pc.sum(pc.list_value_length(b.column(2))).as_py()
            if size >= most:
                yield closed()
                size = 0
    if held:
        yield closed()


def search(spark: SparkSession, index: LexicalIndex, items: DataFrame, top: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` best documents of each item."""
    asked = materialise(spark, items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct().coalesce(FEWEST).withColumn("item", F.monotonically_increasing_id()), "items")
    root, documents, length, most = shared_path(spark, "queries"), index.documents, index.length, BLOCK_POSTINGS
    parts = _write_parts(spark, weighted_terms(spark, index, asked), root)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        files = SharedFiles(root)
        kept: dict[int, list[tuple[int, int]]] = {}
        queries = Queries(files.map(parts[0])) if len(parts) == 1 else None

        def rows() -> pa.RecordBatch:
            flat = [(i, d, s) for i, best in kept.items() for s, d in best]
            kept.clear()
            item, doc, score = zip(*flat, strict=True) if flat else ((), (), ())
            doc = pa.array(doc, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pc.if_else(pc.equal(doc, _NO_ID), None, doc), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

        for b in _blocks(it, most) if parts else ():
            for name in parts:
                q = queries or Queries(files.map(name))
                block = Block(*b, documents, length, q)
                for item, terms, times in q.items:
                    before = kept.get(item, [])
                    floor = before[-1][0] if len(before) == top else 0
                    found = block.best(terms, times, top, floor)[0]
                    if found:
                        kept[item] = _merged(before, found, top)
                if queries is None:
                    yield rows()  # of many queries, what each block finds goes on at once
        yield rows()

    found = index.rows.mapInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    index = LexicalIndex.build(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return search(spark, index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP11_SQL = f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL),
  n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1), s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
  sc AS (SELECT item_id, tf.doc_id, CAST(sum(qtf * CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l)))) AS BIGINT) AS score
    FROM q JOIN df USING (term) JOIN tf USING (term) JOIN n ON n.doc_id = tf.doc_id, s GROUP BY ALL)
  SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0) WHERE rank <= 10"""
