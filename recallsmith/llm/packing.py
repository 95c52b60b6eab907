"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

A text is tokenised and ends with an end id; texts longer than a sequence are cut into whole sequences, the first piece
being the shorter rest. The pieces are to fill as few sequences as possible.

Whole pieces are sequences by themselves. The others are dealt by a hash of their row numbers into problems of bounded size, which grow in
number with the input. Each problem is solved on several islands, each with a population of packings. A packing is a list of bins; a bin
is a multiset of lengths, since pieces of one length can stand for each other. Crossover injects the fullest bins of one
parent into the other, removes the bins whose pieces would then occur twice, and places the displaced pieces: first where they can
replace smaller pieces of a bin, then best-fit. Mutation empties the worst bins and some others, and packs them anew by a bounded exact search. An
island stops at a lower bound that proves its packing best. Between epochs each island's elite migrates to the next island of its problem.

Problems leave a badly filled bin or two each. The pieces of those meet in fewer, merged problems, which are solved in the same way, until one
problem is left.

Cases: a null or empty text is the end id alone; ties are broken by id, piece, checksum and row number; repeated rows are packed each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallsmith.llm.common import bounded_batches, drop_table, few_files, materialise
from recallsmith.llm.tokens import tokenizer, tokenizer_path

CAPACITY = 2048
#: Pieces in a problem, on average; bounds a task's memory and its share of sequences that stay open.
PROBLEM_PIECES = 6000
ISLANDS = 2
EPOCHS = 2
POPULATION = 12
#: Generations of an epoch, if the bins allow so many bin visits; and those without a better packing that end it.
GENERATIONS, VISITS, PATIENCE = 150, 60_000, 40
#: Problems whose badly filled bins meet in one merged problem, and the share of the capacity below which a bin is such.
MERGE, OPEN_BELOW = 64, 0.97

def best_fit(lengths: list[int], capacity: int = CAPACITY, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Place lengths, longest first, each into the fullest bin that has room; opens bins as needed."""
    bins = [list(b) for b in bins or []]
    by_room: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        by_room.setdefault(capacity - sum(b), []).append(i)
    rooms = sorted(by_room)
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        if at < len(rooms):
            room = rooms[at]
            i = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            bins[i].append(x)
        else:
            i, room = len(bins), capacity
            bins.append([x])
        if left := room - x:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(i)
    return bins


def _fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones (mean squared fill), which leaves more room in the rest."""
    fill = np.fromiter(map(sum, bins), np.float64, len(bins)) / capacity
    return -len(bins), float((fill * fill).sum() / max(1, len(bins)))


def crossover(a: list[list[int]], b: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject whole well-filled bins of b into a, remove duplicates, and best-fit what that displaces."""
    fill = np.fromiter(map(sum, b), np.int64, len(b))
    order = np.argsort(-fill, kind="stable")
    full = order[: max(1, len(b) // 2)]
    start = int(rng.integers(0, len(full)))
    chosen = [b[i] for i in full[start : start + max(1, len(full) // 3)]]
    extra = Counter(x for c in chosen for x in c)  # occurrences that a's own bins must give up
    kept, displaced = list(chosen), []
    for bin_ in sorted(a, key=sum):
        if any(extra[x] for x in bin_):
            for x in bin_:
                if extra[x] > 0:
                    extra[x] -= 1
                else:
                    displaced.append(x)
        else:
            kept.append(bin_)
    return replace(displaced, kept, capacity, rng)


def lower_bound(lengths: list[int], capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: pieces over half a bin can't share one, and others only use the room that is left.

    For each limit k up to half the capacity: pieces over capacity - k are alone, those over a half take a bin each, and what
    pieces from k to a half don't find room for in the latter needs more.
    """
    if not lengths:
        return 0
    x = np.sort(np.asarray(lengths, np.int64))
    total, best = np.concatenate(([0], np.cumsum(x))), -(-int(x.sum()) // capacity)
    half = int(np.searchsorted(x, capacity // 2, "right"))
    for k in np.unique(x[x <= capacity // 2]).tolist() or [0]:
        alone, low = int(np.searchsorted(x, capacity - k, "right")), int(np.searchsorted(x, k))
        big = len(x) - half
        room = (alone - half) * capacity - int(total[alone] - total[half]) if alone > half else 0
        best = max(best, big + max(0, -(-(int(total[half] - total[min(low, half)]) - room) // capacity)))
    return best


def replace(displaced: list[int], bins: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Let displaced pieces, one or two at a time, take the place of up to two smaller ones wherever a bin is fuller for it; best-fit the rest."""
    out, loose = [list(b) for b in bins], sorted(displaced)
    for i in rng.permutation(len(out)).tolist():
        if not loose:
            break
        room = capacity - sum(out[i])
        if not room or loose[0] > capacity - room:
            continue
        some = loose if len(loose) <= 24 else [loose[k] for k in sorted(rng.choice(len(loose), 24, replace=False).tolist())]
        offers = sorted([(x, (x,)) for x in some] + [(x + y, (x, y)) for k, x in enumerate(some) for y in some[k + 1 :] if x + y <= capacity])
        sums, best = [o[0] for o in offers], (0, (), ())
        mine = sorted(out[i])
        for gone in [(x,) for x in dict.fromkeys(mine)] + [(x, y) for k, x in enumerate(mine) for y in mine[k + 1 :]]:
            size = sum(gone)
            at = bisect.bisect_right(sums, size + room) - 1
            if at >= 0 and sums[at] - size > best[0]:
                best = (sums[at] - size, gone, offers[at][1])
                if best[0] == room:
                    break
        if best[0]:
            for x in best[1]:
                out[i].remove(x)
                bisect.insort(loose, x)
            for x in best[2]:
                out[i].append(x)
                loose.remove(x)
    return best_fit(loose, capacity, out)


def fullest(lengths: list[int], capacity: int = CAPACITY, steps: int = 400) -> list[list[int]]:
    """Fill one bin after the other: the longest piece left, with those others that fill the bin best, by a search of `steps` nodes."""
    left, bins = Counter(lengths), []
    sizes = sorted(left, reverse=True)
    while sizes:
        first = sizes[0]
        best: list = [capacity - first, (first,)]
        seen = 0
        stack = [(0, capacity - first, (first,))]
        while stack and seen < steps and best[0]:
            k, room, chosen = stack.pop()
            seen += 1
            if room < best[0]:
                best = [room, chosen]
            k = max(k, bisect.bisect_left(sizes, -room, key=lambda v: -v))
            if k < len(sizes):
                x = sizes[k]
                stack.append((k + 1, room, chosen))  # without any more of x
                if chosen.count(x) < left[x]:
                    stack.append((k, room - x, (*chosen, x)))
        bins.append(list(best[1]))
        for x in best[1]:
            left[x] -= 1
            if not left[x]:
                del left[x]
                sizes.remove(x)
    return bins


def mutate(bins: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Empty the least filled bins and a few others; let their pieces fill other bins better, or fill bins of their own as well as a search can."""
    fill = np.fromiter(map(sum, bins), np.int64, len(bins))
    few = max(2, min(12, len(bins) // 20))
    worst = set(np.argsort(fill, kind="stable")[:few].tolist()) | set(rng.integers(0, len(bins), few).tolist())
    loose, kept = [x for i in sorted(worst) for x in bins[i]], [b for i, b in enumerate(bins) if i not in worst]
    return replace(loose, kept, capacity, rng) if rng.random() < 0.6 else kept + fullest(loose, capacity)


def evolve(lengths: list[int], seeds: list[list[list[int]]], rng: np.random.Generator, capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing that an island finds; seeds are packings that came from other islands."""
    bound = lower_bound(lengths, capacity)

    def fitness(p: list[list[int]]) -> tuple[int, float]:
        return _fitness(p, capacity)

    best = max([s for s in seeds if s] or [best_fit(lengths, capacity)], key=fitness)
    if len(best) <= bound or len(lengths) < 3:
        return best
    pool = [(fitness(p), p) for p in [*(s for s in seeds if s), best_fit(lengths, capacity), fullest(lengths, capacity)]]
    while len(pool) < population:
        p = mutate(pool[int(rng.integers(0, len(pool)))][1], capacity, rng)
        pool.append((fitness(p), p))

    def parent() -> list[list[int]]:
        return max((pool[k] for k in rng.integers(0, len(pool), 3).tolist()), key=lambda x: x[0])[1]

    best, since = max(pool, key=lambda x: x[0]), 0
    for _ in range(max(8, min(generations, VISITS // len(best[1])))):
        if len(best[1]) <= bound or since > PATIENCE:
            break
        child = crossover(parent(), parent(), capacity, rng)
        for p in (child, mutate(child, capacity, rng)):
            f = fitness(p)
            # the worst of four makes room, but never the best
            gone = min((k for k in rng.permutation(len(pool)).tolist()[:4] if pool[k][1] is not best[1]), key=lambda k: pool[k][0])
            if f > pool[gone][0] and all(f != x[0] for x in pool):
                pool[gone] = (f, p)
            if f > best[0]:
                best, since = (f, p), -1
        since += 1
    return best[1]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row[, ids]) of every piece of every row; row is a number of its own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, made = tokenizer(tokenizer_file), TaskContext.get().partitionId() << 40
        for b in it:
            for at, ids, ends in tok.columns(b.column(1), end_id):
                n = np.diff(ends, prepend=0)
                count = -(-n // capacity)
                piece = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                rest = np.repeat((n - 1) % capacity + 1, count)  # the first piece's length
                start = np.where(piece > 0, rest + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, rest)
                first = np.repeat(ends - n, count) + start
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                parts = [data[4 * a : 4 * z] for a, z in zip(first.tolist(), (first + length).tolist(), strict=True)]
                crc = np.fromiter(map(zlib.crc32, parts), np.int64, len(parts))
                columns = [b.column(0).slice(at, len(ends)).take(np.repeat(np.arange(len(ends)), count)), piece.astype(np.int32), start, length, crc, made + np.arange(len(parts))]
                made += len(parts)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
                if keep_ids:
                    columns, names = [*columns, pa.array([bytes(x) for x in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)

    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return part.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids binary" * keep_ids)


def _pack(bins: list[list[int]]) -> bytes:
    """Bins as 16-bit numbers: each bin's size, then its lengths."""
    return np.array([x for b in bins for x in (len(b), *b)], "<u4").tobytes()


def _unpack(data: bytes | None) -> list[list[int]]:
    flat, out, at = np.frombuffer(data or b"", "<u4").tolist(), [], 0
    while at < len(flat):
        out.append(flat[at + 1 : at + 1 + flat[at]])
        at += 1 + flat[at]
    return out


def solve(spark: SparkSession, counted: DataFrame, capacity: int, turn: int) -> DataFrame:
    """(problem, elite) of rows (problem, length, n): the best packing that the islands of each problem find."""
    spread = counted.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))))
    state = None
    for epoch in range(EPOCHS):

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            problem, island = (int(k) for k in key)
            rng = np.random.default_rng([problem, island, turn, int(pdf["epoch"].iloc[0])])
            counts = pdf[pdf["length"].notna()]
            lengths = [int(x) for x, k in sorted(zip(counts["length"], counts["n"], strict=True)) for _ in range(int(k))]
            seeds = [_unpack(x) for x in sorted(pdf["elite"].dropna())] if "elite" in pdf else []
            best = evolve(lengths, seeds, rng, capacity)
            return pd.DataFrame({"problem": [problem], "island": [island], "elite": [_pack(best)], "bins": [len(best)], "proved": [len(best) <= lower_bound(lengths, capacity)]})

        given = spread
        if state is not None:  # each island keeps its own elite and gets that of its neighbour
            moved = state.unionByName(state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).select("problem", "island", "elite")
            given = spread.withColumn("elite", F.lit(None).cast("binary")).unionByName(moved, allowMissingColumns=True)
        solved = given.withColumn("epoch", F.lit(epoch)).groupBy("problem", "island").applyInPandas(run, "problem long, island int, elite binary, bins int, proved boolean")
        before, state = state, materialise(spark, solved, "islands")
        if before is not None:
            drop_table(spark, before)
        if state.where(~F.col("proved")).isEmpty():  # no packing can be better
            break
    best = state.groupBy("problem").agg(F.min(F.struct("bins", "island")).alias("b")).select("problem", F.col("b.island").alias("island"))
    return state.join(best, ["problem", "island"]).select("problem", "elite")


def pack(spark: SparkSession, docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of every row with sequence_id and offset: as few sequences as the islands find, each without gaps."""
    bounded_batches(spark)
    rows = materialise(spark, few_files(spark, pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col, keep_ids), scanned=docs), "pieces")
    n = rows.count()
    problems = max(1, -(-n // PROBLEM_PIECES))
    rows = rows.withColumn("problem", F.pmod(F.xxhash64("row"), F.lit(problems)))
    part = rows.where(F.col("length") < capacity)

    def slots(last: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for problem, elite in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    seen: Counter[int] = Counter()
                    out = []
                    for k, lengths in enumerate(_unpack(elite)):
                        offset, open_ = 0, not last and sum(lengths) < OPEN_BELOW * capacity
                        for x in lengths:
                            seen[x] += 1
                            out.append((problem, x, seen[x], None if open_ else k, offset))
                            offset += x
                    cols = list(zip(*out, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["problem", "length", "rank", "k", "offset"])

        return run

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "sequence_id", "offset"]
    order, done, turn = Window.partitionBy("problem", "length").orderBy("doc_id", "piece", "ids_crc32", "row"), [], 0
    while True:
        # a problem is told by how often each length occurs: at most `capacity` numbers, summed before the shuffle
        chosen = solve(spark, part.groupBy("problem", "length").agg(F.count("*").alias("n")), capacity, turn)
        last = problems == 1
        places = chosen.mapInArrow(slots(last), "problem long, length long, rank int, k long, offset long")
        placed = part.withColumn("rank", F.row_number().over(order)).join(places, ["problem", "length", "rank"]).drop("rank")
        # turns have numbers apart: no problem has 2^26 bins
        placed = placed.withColumn("sequence_id", (F.col("problem") * 16 + turn) * (1 << 26) + F.col("k"))
        if last:
            done.append(placed.select(*columns))
            break
        placed = materialise(spark, few_files(spark, placed, rows=n, row_limit=1 << (13 if keep_ids else 18)), "placed")
        done.append(placed.where("k is not null").select(*columns))
        problems, turn = -(-problems // MERGE), turn + 1
        part = placed.where("k is null").drop("k", "offset", "sequence_id").withColumn("problem", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(problems)))
    # a whole piece is a sequence by itself; its number comes from its row, below all others
    done.append(rows.where(F.col("length") == capacity).withColumn("sequence_id", -F.col("row") - 1).withColumn("offset", F.lit(0).cast("long")).select(*columns))
    out = reduce(DataFrame.unionByName, done)
    return few_files(spark, out, rows=n, row_limit=1 << (13 if keep_ids else 18))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(spark, docs, tokenizer_file or tokenizer_path("byte_bpe_50k.json"))
