"""SimHash near-duplicate detection with pigeonhole blocks, and groups of near copies at a stated similarity, which begin with it.

A fingerprint of `bits` bits takes the majority, bit by bit, of the XXH64 hashes of a text's word shingles. Split into
more blocks than a pair may have differing bits, two close fingerprints share at least one whole block; rows are joined
on (block number, block value) and the Hamming distance of each joined pair is then checked.

Cases: a null text counts as an empty one; a text without words has the fingerprint zero and links like any other; fewer
words than a shingle has give one shingle of all of them; repeated rows keep their rows and share a class; an empty
table gives an empty result; other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallsmith.llm.common import bounded_batches, connected_components, drop_table, few_files, fresh_name, lighten, materialise, no_small_broadcasts

#: Up to this many members, a block's rows are compared pair by pair; larger blocks go through hub keys, or first meet heads.
SMALL_BLOCK = 48
#: In each of so many rounds, the members of a larger block that all others meet before what is left is compared across groups.
HEADS, ROUNDS = 4, 2
#: Words of 64 bits of a parity sketch, at least and at most; it has about two bits for each shingle.
LEAST_PARITY, MOST_PARITY = 8, 1 << 10
#: The longest list of common shingles.
COMMON = 1 << 20
#: Up to this many rows, of ids of texts that share a block, may be broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of sketches that may be broadcast.
BROADCAST_BYTES = 2 << 20
_CHUNK = 1 << 15


def _hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    import xxhash

    h, n = xxhash.xxh64_intdigest, len(words)
    if n <= shingle:
        return np.array([h(b" ".join(words), seed)] if n else [], np.uint64)
    if shingle == 1:
        return np.fromiter((h(w, seed) for w in words), np.uint64, n)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((h(text[a:b], seed) for a, b in spans), np.uint64, n - shingle + 1)


def _majority(hashes: np.ndarray, rounds: int = 1) -> np.ndarray:
    """The majority bits of the hashes as `rounds` words of 64 bits; words after the first take remixed hashes."""
    out = np.zeros(rounds, np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rounds):
            ones = np.zeros(64, np.int64)
            for i in range(0, len(hashes), _CHUNK):
                x = hashes[i : i + _CHUNK]
                if r:
                    x = (x ^ np.uint64(0x9E3779B97F4A7C15 * r & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    x ^= x >> np.uint64(32)
                ones += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
            out[r] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one UTF-8 text, as an unsigned integer."""
    return int(_majority(_hashes((text or b"").lower().split(), shingle, seed))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) of every row; fp holds the 64 bits as a signed number."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            fps = [simhash(t, shingle, seed) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return part.mapInArrow(run, part.select("id").schema.add("fp", "long"))


def link_fingerprints(spark: SparkSession, fps: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (fp long) at 2 or fewer differing bits to their neighbours.

    64 bits are dealt into blocks, of which a close pair shares all but two; keys are made of the blocks that are left
    out of each choice of two. More distinct fingerprints get more and finer blocks, so a block's expected company stays
    small: three blocks (keys of 21 bits) below 2^18 fingerprints, four (32 bits) below 2^28, else six (42 bits), unless `parts`
    says how many. The links are the same for any number.

    A block with more than SMALL_BLOCK members (a large group of near copies) is not compared pair by pair. Its members
    differ in at most two of the other bits, and two values differ in at most two bits exactly if some value lies within
    one bit of both. So each member is dealt to the values within one bit of its own (at most 65 keys), and the members
    under one key, which are all within two bits of each other, are linked to the least of them: linear, and exact.
    """
    distinct = materialise(spark, fps.select("fp").distinct(), "fps")
    n = distinct.count()
    if parts is None:
        parts = 3 if n < 1 << 18 else 4 if n < 1 << 28 else 6
    cuts = [64 * i // parts for i in range(parts + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(parts)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [sum(blocks) - x - y for i, x in enumerate(blocks) for y in blocks[i + 1 :]]  # what is compared when two blocks may differ
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks))).alias("k", "v"))
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(spark, keyed.join(sizes, ["k", "v"]), "blocks")
    left, right = shared.where(F.col("n") <= SMALL_BLOCK), shared.where(F.col("n") <= SMALL_BLOCK).select("k", "v", F.col("fp").alias("b"))
    near = left.join(right, ["k", "v"]).where((F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= 2)).select(F.col("fp").alias("a"), "b")
    hot = shared.where(F.col("n") > SMALL_BLOCK).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(64)))
    dealt = hot.select("fp", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("hub"))
    heads = dealt.groupBy("hub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    hubs = dealt.join(heads.select("hub", "b"), "hub").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(hubs)


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the least id whose fingerprint can be reached over links."""
    fps = materialise(spark, fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    roots = connected_components(spark, link_fingerprints(spark, fps))
    firsts = fps.groupBy("fp").agg(F.min("id").alias("first"))
    known = firsts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    known = materialise(spark, known, "roots")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = known.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("id", "fp", "component_id")


# --- near copies at a stated shingle similarity ---------------------------------------------------------------------


def _named(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """The sorted distinct ones of shingle hashes, and a signed hash of them all, which names the class of their text."""
    import xxhash

    h = np.unique(hashes)
    return h, int(np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64).view(np.int64)[0])


def _set(text: bytes | None, shingle: int) -> tuple[np.ndarray, int]:
    """The sorted distinct shingle hashes of a text, and the name of its class."""
    return _named(_hashes((text or b"").lower().split(), shingle, 2))


def _parities(h: np.ndarray) -> np.ndarray:
    """A sketch of a set of hashes: bit i is set if an odd number of them is i modulo the bits, whose number is a power of two."""
    bits = 64 * min(MOST_PARITY, max(LEAST_PARITY, 1 << max(0, (2 * len(h) - 1).bit_length() - 6)))
    odd = np.bincount((h >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _apart(x: Column, y: Column) -> Column:
    """In how many bits two sketches differ; the larger one is folded to half its size, which is as if it had been made so."""
    nx, ny = F.size(x), F.size(y)
    fold = lambda v, n: F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, n + 1, n), lambda a, b: a.bitwiseXOR(b))
    half = lambda v, n, m: F.when(n > m, fold(v, m)).otherwise(v)
    return F.aggregate(F.zip_with(half(x, nx, ny), half(y, ny, nx), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def _hinted(rows: DataFrame, lists: str) -> DataFrame:
    """Rows with a list of numbers, broadcast if all of them are few bytes: the driver holds what is broadcast, as rows, as a table and as blocks, for each join anew."""
    n, numbers = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(rows) if 8 * numbers + 32 * n <= BROADCAST_BYTES else rows


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array([], np.uint64), *arrays]).view(np.int64)))


def common_shingles(part: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that recur in a sample of a 32nd of the rows, 8192 at least.

    They only set the order in which prefixes are taken, so which ones are known changes the cost and not the result.
    """
    rate = max(1, min(32, n // 8192))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            for t in b.column(1).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_set(t, shingle)[0].view(np.int64))], ["k"])

    some = part.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0).mapInArrow(run, "k long")
    # two columns of numbers: up to COMMON of them as rows would be objects each in the driver's Python
    found = some.groupBy("k").agg(F.count("*").alias("n")).where("n >= 4").orderBy(F.desc("n"), "k").limit(COMMON).toArrow()
    keys, counts = found["k"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def distinct_blocks(keyed: DataFrame) -> DataFrame:
    """(k, c, n int, i int, m) of the blocks of two members or more of rows (k, c, p), whose p holds a size n and, below it, a place i; one block for all those of the same members.

    Near copies share shingles by the dozen, and each would give the same pairs again. A member keeps its first place, which excludes no pair that any of the
    blocks would allow. k is a hash of the members: should those of two blocks have the same, the blocks are one, which adds pairs and loses none.
    """
    of_key = Window.partitionBy("k")
    counted = keyed.withColumn("m", F.count("*").over(of_key)).withColumn("s", F.bit_xor(F.xxhash64("c")).over(of_key)).where("m > 1")
    once = counted.groupBy(F.col("s").alias("k"), "c").agg(F.min("p").alias("p"), F.max("m").alias("m"))
    return once.select("k", "c", F.shiftright("p", 32).cast("int").alias("n"), F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("i"), "m")


def similarity_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, key, group_id, group_key) of every row: groups of rows linked by a Jaccard similarity of their word shingles of `similarity` or more.

    key is a hash of the text, since an id may stand for several; a group is named by its least (id, key). Texts with equal shingles are one class.

    SimHash comes first: each class has a fingerprint of its shingles, and link_fingerprints() joins those at 2 or fewer differing bits over pigeonhole blocks.
    Classes of one fingerprint meet the least of them, and the least ones of two linked fingerprints meet; a pair is a link if its whole sets of 64-bit
    shingle hashes have the similarity.

    Fingerprints of texts of that similarity may differ in more bits, so an exact prefix-filter join finds what they leave. All texts order their shingles alike, common ones last; two texts of that similarity share
    one of the first n - ceil(similarity * n) + 1 of either's n shingles, whatever the number of rows and the length of the
    texts. Classes that share such a shingle are a block, shingles that the same classes share are one, and pairs are verified on their whole sets too.

    Groups need only links that join them, so pairs already in one group are not compared. After the fingerprints each block's members meet
    its least one, and those of larger blocks then HEADS others that differ by block; near copies mostly fall into one group then. What is left is exact:
    in each block, all pairs across groups meet whose sizes and places in the order allow the similarity. A block with many members
    that are no near copies of each other costs the square of that number; common shingles come last, so such a block's members
    share nearly all they have with others.

    A pair is first held against its classes' parity sketches, which can rule it out but never wrongly; whole sets are only made of those that are left.
    """
    n = docs.count()
    part = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    common, counts = common_shingles(part, n, shingle)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            names, sizes, firsts, parities, prints = [], [], [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                every = _hashes((t or b"").lower().split(), shingle, 2)
                h, c = _named(every)
                prints.append(_majority(every)[0])
                level = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    level = np.where(common[at] == h, counts[at], 0)
                most = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
                parities.append(_parities(h))
                names.append(c)
                sizes.append(len(h))
                firsts.append(h[np.argsort(level, kind="stable")[:most]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), _lists(firsts), _lists(parities), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "key", "h", "n", "keys", "odd", "fp"])

    found = part.mapInArrow(run, "id long, key long, h long, n int, keys array<long>, odd array<long>, fp long").withColumn("r", F.monotonically_increasing_id())
    rows = materialise(spark, few_files(spark, found, scanned=docs), "prefixes")

    def written(df: DataFrame, tag: str, each: int = 1) -> DataFrame:
        return materialise(spark, few_files(spark, df, rows=each * n), tag)

    # equal sets first: one class each, named by the row of its least id
    firsts = rows.groupBy("h").agg(F.min(F.struct("id", "key", "r")).alias("first"))
    ids = written(rows.select("id", "key", "h", "r").join(firsts, "h").select("id", "key", "r", F.col("first.r").alias("c")), "ids")
    copies = ids.where("r <> c").select("r")
    heads_only = rows.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "r", "left_anti")
    heads = written(heads_only.select(F.col("r").alias("c"), "id", "key", "h", "n", "odd", "fp"), "classes")
    # one shuffle, of what a member of a block must tell: its class, and its size and place in one number
    place = F.shiftleft(F.col("n").cast("long"), 32) + F.col("i")
    keyed = heads_only.select(F.col("r").alias("c"), "n", F.posexplode("keys").alias("i", "k")).select("k", "c", place.alias("p"))
    shared = written(distinct_blocks(keyed), "blocks", 8)
    drop_table(spark, rows)

    info = _hinted(heads.select("c", "n", "odd"), "odd")
    no_sets = spark.createDataFrame([], "c long, set array<long>")
    sets = [no_sets]

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            got = [(c, h, *_set(t, shingle)) for c, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True)]
            got = [(c, x) for c, h, x, mine in got if h == mine]  # an id may stand for several texts
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.int64()), _lists([x for _, x in got])], ["c", "set"])

    def learn(pairs: DataFrame) -> DataFrame:
        """The whole sets of all classes of some pairs, those made before among them."""
        have = reduce(DataFrame.unionByName, sets)
        need = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(have.select("c"), "c", "left_anti")
        wanted = written(need.join(heads.select("c", "id", "h"), "c"), "wanted")
        if (k := wanted.count()) == 0:
            return have
        by_id = part.join(F.broadcast(wanted) if k <= BROADCAST_ROWS else wanted, "id").select("c", "h", "text")
        sets.append(written(by_id.mapInArrow(whole, "c long, set array<long>").dropDuplicates(["c"]), "sets", 8))
        return reduce(DataFrame.unionByName, sets)

    least, member = F.lit(similarity - 1e-9), ("c", "n", "i")

    def may(x: str, y: str) -> Column:
        """Whether sizes, and what can follow the first shared shingle, allow the similarity."""
        nx, ny, ix, iy = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.i"), F.col(f"{y}.i")
        return (F.least(nx, ny) >= least * F.greatest(nx, ny)) & (F.least(nx - ix, ny - iy) * (1 + similarity) >= least * (nx + ny))

    def alike(x: str, y: str) -> Column:
        """Whether sizes and sketches allow it: a shingle that one text has alone flips one bit, so as many differ at least as bits do.

        Texts of sizes that allow it have sketches of one size, or of twice it.
        """
        nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
        sized = F.least(nx, ny) >= least * F.greatest(nx, ny)
        return F.when(sized, _apart(F.col(f"{x}.odd"), F.col(f"{y}.odd")) * (1 + similarity) <= (1 - least) * (nx + ny)).otherwise(False)

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        met = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        told = met.join(info.select(F.col("c").alias("a"), F.struct("n", "odd").alias("x")), "a").join(info.select(F.col("c").alias("b"), F.struct("n", "odd").alias("y")), "b")
        left = written(told.where(alike("x", "y")).select("a", "b"), "pairs", 8)
        every = learn(left)
        both = left.join(every.select(F.col("c").alias("a"), F.col("set").alias("set_a")), "a").join(every.select(F.col("c").alias("b"), F.col("set").alias("set_b")), "b")
        inter = F.size(F.array_intersect("set_a", "set_b"))
        return written(both.where(inter >= least * (F.size("set_a") + F.size("set_b") - inter)).select("a", "b"), tag, 8)

    def by_fingerprint() -> DataFrame:
        """Pairs of classes whose fingerprints are equal, or are linked; of those of one fingerprint the least stands for all."""
        firsts = heads.groupBy("fp").agg(F.min("c").alias("first"))
        equal = heads.join(firsts, "fp").where("c <> first").select(F.col("c").alias("a"), F.col("first").alias("b"))
        linked = link_fingerprints(spark, heads)
        for x in ("a", "b"):
            linked = linked.join(firsts.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first")), x)
        return equal.unionByName(linked.select(F.col("a_first").alias("a"), F.col("b_first").alias("b")))

    def to_heads(blocks: DataFrame, *orders: Column) -> DataFrame:
        """Pairs of each member with the heads of its block; where groups are known already, with those of other groups."""
        told = [*member, *(["root"] if "root" in blocks.columns else [])]
        heads = blocks.groupBy("k").agg(F.array(*(F.min(F.struct(x.alias("by"), *told)) for x in orders)).alias("y"))
        met = blocks.select("k", F.struct(*told).alias("x")).join(heads, "k").select("x", F.explode("y").alias("y")).where("x.root <> y.root" if "root" in told else "x.c <> y.c")
        return met.where(may("x", "y")).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))

    def still_open(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The blocks whose members are in several groups, with their groups; and the groups."""
        roots = connected_components(spark, links)
        named = shared.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        several = named.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k")
        return written(named.join(several, "k"), "open", 8), roots

    rest, roots = still_open(verified(by_fingerprint(), "links"))
    for turn in range(-1, ROUNDS):
        large = rest if turn < 0 else rest.where(F.col("m") > SMALL_BLOCK)
        if large.isEmpty():
            break
        met = to_heads(large, *([F.col("c")] if turn < 0 else [F.xxhash64("c", "k", F.lit(turn * HEADS + j)) for j in range(HEADS)]))
        new = verified(met, "links")
        if new.isEmpty():
            if turn < 0:
                continue
            break
        before = rest
        rest, roots = still_open(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new))
        drop_table(spark, before)

    # sketches are held against each other where members meet: a family of near copies shares dozens of blocks, and would give each pair as often
    x, y = (rest.join(heads.select("c", "odd"), "c").select("k", F.struct(*member, "root", "odd").alias(z)) for z in ("x", "y"))
    left = x.join(y, "k").where("x.c < y.c AND x.root <> y.root").where(may("x", "y") & alike("x", "y")).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(left, "links"))
    roots = connected_components(spark, links)
    named = heads.select("c", "id", "key").join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("c", F.struct("id", "key").alias("first"), F.coalesce("root", "c").alias("root"))
    named = written(named, "named")
    groups = named.groupBy("root").agg(F.min("first").alias("head"))
    return ids.drop("r").join(named.join(groups, "root").select("c", "head"), "c").select("id", "key", F.col("head.id").alias("group_id"), F.col("head.key").alias("group_key"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows, with all their columns, of the least id of each group of near copies; of rows with that id and the same text, one.

    Rows without an id stay. A null text counts as an empty one. Two texts under one id are told apart.
    """
    bounded_batches(spark)
    lighten()  # of what an earlier stage left in the driver's Python
    known = docs.where(F.col(id_col).isNotNull())
    with no_small_broadcasts(spark):
        groups = materialise(spark, similarity_groups(spark, known, id_col, text_col, shingle, similarity), "groups")
    id_, key, other = (fresh_name(docs, x) for x in ("id", "key", "key"))
    named = known.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))

    def rows(of: DataFrame, how: str) -> DataFrame:
        pairs = of.select(F.col("id").alias(id_), F.col("key").alias(other)).distinct()
        pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
        return named.join(pairs, (F.col(id_col).cast("long") == F.col(id_)) & (F.col(key) == F.col(other)), how)

    # the rows that go are listed, which are few as a rule; of what stays only repeated rows are shuffled
    gone = groups.where("id <> group_id OR key <> group_key")
    repeated = groups.where("id = group_id AND key = group_key").groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1")
    once = rows(gone.select("id", "key").unionByName(repeated.select("id", "key")), "left_anti").drop(key)
    if not repeated.isEmpty():
        once = once.unionByName(rows(repeated, "left_semi").withColumn(id_, F.col(id_col).cast("long")).dropDuplicates([id_, key]).drop(id_, key))
    return once.unionByName(docs.where(F.col(id_col).isNull()))


def op8_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, links at 2 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(spark, docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
