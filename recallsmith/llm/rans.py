"""Token-id files by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids and scaled to 2^20, is shared by all blocks. A block holds the ids of some
consecutive documents, is encoded by up to 512 interleaved lanes of 64-bit state with 32-bit renormalisation, and stands
alone: it stores its lanes' states, its documents' ids and lengths, and the number of ids before it. Every 2^16 ids it has a checkpoint: the
lanes' states there, the place in the words, and the crc32 of the ids from there to the next. So any block, and any span between checkpoints, can be
decoded and checked by itself, in any order, on any machine.

The file format is a folder of Parquet files (Spark's committer makes them appear whole or not at all): `freq` holds the
table, `blocks` one row per block with its payload, in one folder per range of document ids, in ascending order.

Cases: a null text counts as empty and gives the end id only; ties of doc_id are ordered by a hash of the text; null ids come first and stay null; very long texts are
encoded whole, in a block of their own size; an empty table gives no blocks; a frequency that rounds to nothing is kept at one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.llm.common import bounded_batches, input_bytes, materialise, shared_path
from recallsmith.llm.tokens import tokenizer, tokenizer_path

SCALE_BITS = 20
LANES = 512
BLOCK_IDS = 1 << 18
#: Ids between checkpoints; a multiple of LANES.
CHECKPOINT_IDS = 1 << 16
#: Stored bytes of documents in a range, about.
RANGE_BYTES = 64 << 20
_LOW = np.uint64(1 << 31)


class CorruptBlock(ValueError):
    """A block whose ids don't have the checksum that was stored with them."""


def scale_counts(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2^bits; every id with a count gets one at least."""
    total, counts = 1 << bits, counts.astype(np.int64)
    seen = counts > 0
    if seen.sum() > total:
        raise ValueError("more distinct ids than the scale holds")
    if not seen.any():
        return np.zeros(len(counts), np.int64)
    freq = np.where(seen, np.maximum(1, (counts * (total / counts.sum())).astype(np.int64)), 0)
    off = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    while off:
        for i in order if off < 0 else order[:1]:
            step = off if off > 0 else -min(-off, int(freq[i]) - 1 if freq[i] < 64 else int(freq[i]) // 2)
            freq[i] += step
            off -= step
            if not off:
                break
    return freq


class Coder:
    """Encodes and decodes blocks of ids with one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS) -> None:
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The id that each of the 2^bits slots belongs to."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_IDS) -> tuple[bytes, bytes]:
        """(states, words): the lanes' states at each checkpoint, in order, each after the place of its first word; and the renormalisation words."""
        n = len(ids)
        lanes = max(1, min(lanes, n // 64))
        every = max(1, every // lanes) * lanes
        state, out, marks, made = np.full(lanes, _LOW, np.uint64), [], [], 0
        f_all, s_all, top = self.freq[ids], self.start[ids], np.uint64(63 - self.bits)
        bits, low32, w32 = np.uint64(self.bits), np.uint64(0xFFFFFFFF), np.uint64(32)
        for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
            f, s = f_all[at : at + lanes], s_all[at : at + lanes]
            x = state[: len(f)]
            full = x >= (f << top)
            if full.any():
                out.append((x[full] & low32).astype("<u4"))
                made += len(out[-1])
                x = np.where(full, x >> w32, x)
            q = x // f
            state[: len(f)] = (q << bits) + (x - q * f) + s
            if at % every == 0:
                marks.append((made, state.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
        return b"".join(np.array([made - k], "<u8").tobytes() + x.astype("<u8").tobytes() for k, x in marks[::-1]), words.tobytes()

    def spans(self, n: int, states: bytes, every: int = CHECKPOINT_IDS) -> list[tuple[int, int]]:
        """The ranges of ids between a block's checkpoints."""
        lanes = max(1, min(LANES, n // 64)) if len(states) else 1
        every = max(1, every // lanes) * lanes
        return [(a, min(a + every, n)) for a in range(0, n, every)]

    def decode_span(self, n: int, states: bytes, payload: bytes, span: int = 0, every: int = CHECKPOINT_IDS) -> np.ndarray:
        """The ids of a block of n ids from one checkpoint to the next, without those before."""
        if not n:
            return np.zeros(0, np.uint32)
        if len(payload) % 4:
            raise CorruptBlock("the payload ends early")
        spans = self.spans(n, states, every)
        held = np.frombuffer(states, "<u8").reshape(len(spans), -1)
        at, state, words = int(held[span, 0]), held[span, 1:].astype(np.uint64), np.frombuffer(payload, "<u4")
        lanes, out = len(state), np.empty(spans[span][1] - spans[span][0], np.uint32)
        mask, bits, w32, slots = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.uint64(32), self.slots
        for i in range(0, len(out), lanes):
            x = state[: min(lanes, len(out) - i)]
            slot = x & mask
            ids = slots[slot]
            out[i : i + len(x)] = ids
            x = self.freq[ids] * (x >> bits) + slot - self.start[ids]
            empty = x < _LOW
            if k := int(np.count_nonzero(empty)):
                if at + k > len(words):
                    raise CorruptBlock("the payload ends early")
                x[empty] = (x[empty] << w32) | words[at : at + k]
                at += k
            state[: len(x)] = x
        return out

    def checksums(self, ids: np.ndarray, states: bytes) -> list[int]:
        """The crc32 of the ids of each span."""
        data = memoryview(ids.astype("<u4", copy=False)).cast("B")
        return [zlib.crc32(data[4 * a : 4 * z]) for a, z in self.spans(len(ids), states)]

    def decode(self, n: int, states: bytes, payload: bytes, checksums: list[int] | None = None) -> np.ndarray:
        """The n ids of a block; spans that don't have their checksum raise CorruptBlock."""
        out = [self.decode_span(n, states, payload, k) for k in range(len(self.spans(n, states)))]
        for k, ids in enumerate(out):
            if checksums is not None and zlib.crc32(ids.astype("<u4", copy=False)) != checksums[k]:
                raise CorruptBlock(f"span {k}")
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


_SEGMENT = "part int, at long, docs array<long>, lens array<long>, ids binary, n long, counts array<struct<id:int,n:long>>"
_BLOCK = "file_no int, start long, n_ids long, doc_ids array<long>, doc_lens array<long>, states binary, crc32 array<long>, payload binary"


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the token files to `path`, in ascending order of id.

    Texts are dealt by ranges of id and tokenised once; packed ids go to shared storage with each task's counts. The
    driver gets one row per id of the vocabulary (the table) and one per range (its number of ids), nothing per document.
    """

    def segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, counts = TaskContext.get().partitionId(), 0, np.zeros(1 << 16, np.int64)
        tok = tokenizer(tokenizer_file)
        docs_, lens, parts, size = [], [], [], 0  # docs_: Arrow arrays, so null ids stay null
        schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("docs", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("ids", pa.binary()), ("n", pa.int64()), ("counts", pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())])))])

        def row(tail=None):
            nonlocal at, counts
            ids = np.concatenate([np.zeros(0, np.uint32), *parts])
            got = np.bincount(ids)
            if len(got) > len(counts):
                counts = np.concatenate((counts, np.zeros(len(got) - len(counts), np.int64)))
            counts[: len(got)] += got
            small = ids.astype("<u2") if len(ids) == 0 or ids.max() < 1 << 16 else ids.astype("<u4")
            at += len(ids)
            tail = [{"id": int(i), "n": int(counts[i])} for i in np.flatnonzero(counts)] if tail else None
            made = [part, at - len(ids), None, np.concatenate([np.zeros(0, np.int64), *lens]), bytes([small.itemsize]) + small.tobytes(), len(ids), tail]
            cols = [pa.array([v], f.type) for v, f in zip(made, schema, strict=True)]
            flat = pa.concat_arrays([pa.array([], pa.int64()), *docs_])
            cols[2] = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for b in it:
            names = b.column(0)
            for first, ids, ends in tok.columns(b.column(1), end_id):
                i = 0
                while i < len(ends):  # a block closes with the document that fills it
                    begun = int(ends[i - 1]) if i else 0
                    j = min(len(ends), int(np.searchsorted(ends, begun + BLOCK_IDS - size)) + 1)
                    docs_.append(names.slice(first + i, j - i))
                    lens.append(np.diff(ends[i:j], prepend=begun))
                    parts.append(ids[begun : int(ends[j - 1])])
                    size += len(parts[-1])
                    i = j
                    if size >= BLOCK_IDS:
                        yield row()
                        docs_, lens, parts, size = [], [], [], 0
        yield row(tail=True)

    bounded_batches(spark)
    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = input_bytes(docs)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES) if size < 1 << 60 else 0)  # beyond: not known
    tie = F.xxhash64("text")  # rows of one id are dealt out too, without texts in the bounds of the ranges
    dealt = part.repartitionByRange(ranges, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    held = materialise(spark, dealt.mapInArrow(segments, _SEGMENT), "ids")
    table = held.select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n")).toPandas()
    counts = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.int64)
    counts[table["id"]] = table["n"]
    freq = scale_counts(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq long").coalesce(1).write.parquet(f"{path}/freq")
    starts, before = {}, 0
    for p, n in held.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row per range
        starts[p], before = before, before + n

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        schema = pa.schema([("file_no", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("states", pa.binary()), ("crc32", pa.list_(pa.int64())), ("payload", pa.binary())])
        for b in it:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                if not r["n"][0].as_py():
                    continue
                data = r["ids"][0].as_py()
                ids = np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")
                states, words = coder.encode(ids)
                made = [r["part"], pa.array([starts[r["part"][0].as_py()] + r["at"][0].as_py()]), r["n"], r["docs"], r["lens"], pa.array([states], pa.binary()), pa.array([coder.checksums(ids, states)], pa.list_(pa.int64())), pa.array([words], pa.binary())]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, schema, strict=True)], schema=schema)

    held.drop("counts").mapInArrow(encode, _BLOCK).write.option("compression", "none").partitionBy("file_no").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in the files; each block is decoded and checked alone."""
    rows = spark.read.parquet(f"{path}/freq").toPandas()  # one row per id of the vocabulary
    freq = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    freq[rows["id"]] = rows["freq"]

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for b in it:
            for i in range(b.num_rows):
                start, n, docs_, lens, states, crcs, payload = (b.column(k)[i] for k in range(7))
                ids = coder.decode(n.as_py(), states.as_py(), payload.as_py(), crcs.as_py()).astype("<u4", copy=False)
                lens = lens.values.to_numpy()
                ends = np.cumsum(lens)
                cuts = pa.py_buffer(np.concatenate(([0], 4 * ends)).astype(np.int32 if 4 * len(ids) < 1 << 31 else np.int64))
                data = pa.Array.from_buffers(pa.binary() if 4 * len(ids) < 1 << 31 else pa.large_binary(), len(lens), [None, cuts, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([docs_.values, pa.array(start.as_py() + ends - lens), pa.array(lens), data], ["doc_id", "start", "n_tokens", "ids"])

    schema = "start long, n_ids long, doc_ids array<long>, doc_lens array<long>, states binary, crc32 array<long>, payload binary, file_no int"
    return spark.read.schema(schema).parquet(f"{path}/blocks").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    """Every document's place, length and crc32 in the token files written from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_path(spark, "tokens")
    write_token_files(spark, docs, path, tokenizer_file or tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
