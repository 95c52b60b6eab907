"""Hyperdimensional vectors as arrays of 64-bit words, 65,536 bits unless stated otherwise.

Concepts come from hashes; binding, rotation and similarity are column expressions. Texts are encoded and vectors bundled in Arrow-batched
functions, where a majority vote adds up whole words by bit-sliced counters. Both sides make the same vector of a name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallsmith.functions import text
from recallsmith.sources.manifest import small_batches

WORDS, SEED = 1024, "0"
#: Terms of a text and relations of a memory that a vector holds at most; rows of an index that are added at a time.
MOST_TERMS, MOST_RELATIONS, BACKFILL = 64, 32, 1000
#: Rows whose vectors a task holds at once, and words of them that it makes at a time: what it works on stays in a core's cache.
CHUNK, SLICE = 128, 64
#: Concepts that may be compared with every row.
MOST_CONCEPTS = 20_000
_U, _ENTITY = np.uint64, re.compile(text.ENTITY)
# The primes of XXH64.
_P1, _P2, _P3, _P5 = _U(0x9E3779B185EBCA87), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5)


def normal(name: Column) -> Column:
    """A name in lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def concept(name: Column, words: int = WORDS, seed: str = SEED) -> Column:
    """The vector of a name: one hash for each word."""
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.xxhash64(F.lit(seed), normal(name), i))


def _start(name: str, seed: str = SEED) -> int:
    """The hash of a name, from which those of its words go on."""
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(name.lower().split()).encode(), xxhash.xxh64_intdigest(seed.encode(), 42))


def _concepts(starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Some words of the vectors of names: a row for each start, a column for each word's place."""
    with np.errstate(over="ignore"):
        h = (starts + (_P5 + _U(4)))[:, None] ^ (places.astype(np.uint64) * _P1)
        low = h >> _U(41)
        h <<= _U(23)
        h |= low
        h *= _P2
        h += _P3
        for shift, prime in ((_U(33), _P2), (_U(29), _P3)):
            h ^= np.right_shift(h, shift, out=low)
            h *= prime
        h ^= np.right_shift(h, _U(32), out=low)
    return h


def concept_vector(name: str, words: int = WORDS, seed: str = SEED) -> np.ndarray:
    """concept() of one name as unsigned words."""
    return _concepts(np.array([_start(name, seed)], np.uint64), np.arange(words))[0]


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def similarity(a: Column, b: Column) -> Column:
    """1 - Hamming distance / bits."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / (64 * F.size(a))


def permute(v: Column, steps: int = 1) -> Column:
    """Rotate left by bits, the first word being the lowest; a permutation that keeps distances."""
    whole, bits = divmod(steps, 64)
    turned = F.concat(F.slice(v, F.size(v) - F.lit(whole) + 1, F.lit(whole)), F.slice(v, F.lit(1), F.size(v) - F.lit(whole))) if whole else v
    if not bits:
        return turned
    below = F.concat(F.slice(turned, F.size(turned), F.lit(1)), F.slice(turned, F.lit(1), F.size(turned) - 1))
    return F.zip_with(turned, below, lambda x, y: F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(y, 64 - bits)))


def rotated(v: np.ndarray, steps: int) -> np.ndarray:
    """permute() of one vector."""
    whole, bits = divmod(steps, 64)
    v = np.roll(v, whole)
    return (v << _U(bits)) | (np.roll(v, 1) >> _U(64 - bits)) if bits else v


_ODD = _U(0xAAAAAAAAAAAAAAAA)


def majority_of(vectors: list[np.ndarray]) -> np.ndarray:
    """Bit-wise majority of unsigned words; a tie sets the bit where its number plus the count of vectors is odd.

    The votes for each bit are counted in planes: plane k holds bit k of all counts, so 64 counts are added at once, three words to two.
    """
    n, open_ = len(vectors), [list(vectors)]
    if n == 2:
        a, b = vectors
        return (a & b) | ((a ^ b) & _ODD)
    for k, level in enumerate(open_):  # it grows by the carries
        if len(level) > 1 and k + 1 == len(open_):
            open_.append([])
        while len(level) > 1:
            a, b = level.pop(), level.pop()
            odd, both = a ^ b, a & b
            if level:
                c = level.pop()
                odd, both = odd ^ c, both | (odd & c)
            level.append(odd)
            open_[k + 1].append(both)
    planes = [level[0] for level in open_]
    above, equal, half = np.zeros_like(vectors[0]), ~np.zeros_like(vectors[0]), n // 2
    for k in range(max(len(planes), half.bit_length()) - 1, -1, -1):  # compare with half of the votes, from the highest bit
        plane = planes[k] if k < len(planes) else np.zeros_like(above)
        if half >> k & 1:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above if n % 2 else above | (equal & _ODD)  # with an even count, an odd place


def majority(vectors: list[list[int]]) -> list[int]:
    """majority_of() of signed words."""
    return majority_of([np.array(v, np.int64).view(np.uint64) for v in vectors]).view(np.int64).tolist()


def bundle(rows: DataFrame) -> DataFrame:
    """(id, hv) of rows (id, parts array<array<long>>), a few dozen parts each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [majority(p) if p else [] for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "hv"])

    part = rows.select("id", "parts")
    return part.mapInArrow(run, f"id {part.schema['id'].dataType.simpleString()}, hv array<bigint>")


def encode_relation(subject: Column, predicate: Column, object_: Column, words: int = WORDS) -> Column:
    """The parts of a relation's bundle."""
    s, p, o = (concept(x, words) for x in (subject, predicate, object_))
    return F.array(bind(s, p), bind(p, o))


def entities_of(said: str | None, most: int = text.MOST_ENTITIES) -> list[str]:
    """text.extract_entities() of one text, which is searched until it has given enough."""
    found: dict[str, None] = {}
    for m in _ENTITY.finditer((said or "").lower()):
        if len(e := m[0].strip(text.ENTITY_MARKS)) >= 3:
            found[e] = None
            if len(found) == most:
                break
    return list(found)


class Encoder:
    """Vectors of texts and memories; the vectors of names that were met are kept, up to a bound."""

    def __init__(self, words: int = WORDS, most: int = 4096) -> None:
        self.words, self.most = words, most
        self.names: dict[str, np.ndarray] = {}
        place = concept_vector("__position__", words)
        self.places = [rotated(place, i) for i in range(MOST_TERMS)]

    def concept(self, name: str) -> np.ndarray:
        if name not in self.names:
            if len(self.names) >= self.most:
                self.names.clear()
            self.names[name] = concept_vector(name, self.words)
        return self.names[name]

    @staticmethod
    def terms(said: str, entities: list[str]) -> list[str]:
        """What stands for a text: the entities, or else the words of three characters or more, or else the text itself."""
        if entities:
            return entities[:MOST_TERMS]
        plain = " ".join((said or "").lower().split())
        return [t for t in plain.split() if len(t) >= 3][:MOST_TERMS] or [plain or "__empty__"]

    def text(self, said: str, entities: list[str]) -> np.ndarray:
        """Each of the first terms bound to its place."""
        return majority_of([p ^ self.concept(t) for p, t in zip(self.places, self.terms(said, entities), strict=False)])

    def relation(self, subject: str, predicate: str, object_: str) -> np.ndarray:
        s, p, o = (self.concept(x) for x in (subject, predicate, object_))
        return majority_of([s ^ p, p ^ o])

    @staticmethod
    def relations(entities: list[str], metadata: dict[str, str | None]) -> list[tuple[str, str, str]]:
        """The relations of a memory: the type, the places it belongs to, and each entity with the next."""
        near = [(a, "near", b) for a, b in zip(entities, entities[1:], strict=False)]
        kind = (metadata.get("tier") or metadata.get("type") or "").strip()
        told = [("__memory__", "has_type", kind)] if kind else []
        told += [(k, "equals", metadata[k]) for k in ("workspace_name", "module", "room") if metadata.get(k)]
        return (told + near)[:MOST_RELATIONS]

    def memory(self, said: str, entities: list[str], metadata: dict[str, str | None]) -> np.ndarray:
        """A text's vector bundled with its relations."""
        vectors = [self.relation(*r) for r in self.relations(entities, metadata)]
        own = self.text(said, entities)
        return majority_of([own, *vectors]) if vectors else own

    def memories(self, texts: list[str], entities: list[list[str]], metadata: list[dict[str, str | None]]) -> np.ndarray:
        """memory() of some rows at once, a row of words each: rows of as many terms and relations together, some of their words at a time."""
        out, shapes = np.empty((len(texts), self.words), np.uint64), {}
        for i, (said, own, given) in enumerate(zip(texts, entities, metadata, strict=True)):
            terms, told = self.terms(said, own), self.relations(own, given)
            near = sum(p == "near" for _, p, _ in told)  # those of the first entities, which are the first terms
            shapes.setdefault((len(terms), len(told), near), []).append((i, terms, told[: len(told) - near]))
        for (n, _, near), rows in shapes.items():
            numbers: dict[str, int] = {"near": 0}
            number = lambda name, of=numbers: of.setdefault(name, len(of))
            at = np.array([i for i, _, _ in rows])
            held = np.array([[number(t) for t in terms] for _, terms, _ in rows])
            told = np.array([[[number(x) for x in r] for r in rel] for *_, rel in rows]).reshape(len(rows), -1, 3)
            starts, step = np.array([_start(name) for name in numbers], np.uint64), SLICE * max(1, CHUNK // len(rows))
            for begin in range(0, self.words, step):
                cut = slice(begin, min(begin + step, self.words))
                names = _concepts(starts, np.arange(cut.start, cut.stop))
                parts = [names[held[:, i]] for i in range(n)]
                vectors = [majority_of([x ^ place[cut] for x, place in zip(parts, self.places, strict=False)])]
                for i in range(told.shape[1]):
                    s, p, o = (names[told[:, i, j]] for j in range(3))
                    vectors.append(majority_of([s ^ p, p ^ o]))
                close = [x ^ names[0] for x in parts[: near + 1]] if near else []
                vectors += [majority_of([x, y]) for x, y in zip(close, close[1:], strict=False)]
                out[at, cut] = majority_of(vectors) if len(vectors) > 1 else vectors[0]
        return out


_METADATA = ("tier", "type", "workspace_name", "module", "room")


def index(memories: DataFrame, words: int = WORDS, packed: bool = False) -> DataFrame:
    """(id, entities, hv) of memories (id, text, and any of tier, type, workspace_name, module, room); hv is an array of words or, packed, their bytes.

    A task holds the vectors of CHUNK rows at a time.
    """
    small_batches(memories.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(words)
        for b in (b.slice(start, CHUNK) for b in it for start in range(0, b.num_rows, CHUNK)):
            texts, *rest = (b.column(i).to_pylist() for i in range(1, 2 + len(given)))
            found = [entities_of(t) for t in texts]
            out = encoder.memories(texts, found, [dict(zip(given, m, strict=True)) for m in zip(*rest, strict=True)] if given else [{}] * len(texts))
            if packed:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, names), pa.array([v.tobytes() for v in out.astype("<u8", copy=False)], pa.binary())], ["id", "entities", "hv"])
                continue
            hv = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * words), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, names), hv], ["id", "entities", "hv"])

    given, names = [c for c in _METADATA if c in memories.columns], pa.list_(pa.string())
    part = memories.select("id", "text", *(F.col(c).cast("string").alias(c) for c in given))
    return part.mapInArrow(run, f"id {part.schema['id'].dataType.simpleString()}, entities array<string>, hv {'binary' if packed else 'array<bigint>'}")


def query_vector(said: str, words: int = WORDS) -> list[int]:
    """The vector of a query's text, by its entities."""
    return Encoder(words).text(said, entities_of(said)).view(np.int64).tolist()


def query(vectors: DataFrame, said: str, words: int = WORDS) -> DataFrame:
    """(id, score) of indexed rows: similarity of the vectors, with a share of that of the entities."""
    wanted = text.extract_entities(F.lit(said))
    sim = similarity(F.col("hv"), F.lit(query_vector(said, words)))
    return vectors.select("id", F.round(score(sim, F.col("entities"), wanted), 9).alias("score"))


def score(sim: Column, entities: Column, wanted: Column) -> Column:
    """.7 similarity + .3 Jaccard; plain similarity where either has no entities."""
    j = F.size(F.array_intersect(entities, wanted)) / F.size(F.array_union(entities, wanted))
    return F.when((F.size(entities) == 0) | (F.size(wanted) == 0), sim).otherwise(0.7 * sim + 0.3 * j)


def load(entities: DataFrame, vectors: DataFrame, memories: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, entities, hv) of stored entities (id, entities) with their stored vectors (id, hv); what has no vector is encoded anew."""
    have = vectors.where("hv IS NOT NULL")
    kept = entities.join(have, "id")
    # ids alone tell what is lost: no vector is read for it, or shuffled twice
    lost = memories.join(entities.select("id").join(have.select("id"), "id", "left_anti"), "id", "left_semi")
    return kept.select("id", "entities", "hv").unionByName(index(lost, words))


def unindex(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """Indexed rows without some ids."""
    return vectors.join(gone.select("id"), "id", "left_anti")


def backfill(vectors: DataFrame, memories: DataFrame, most: int = BACKFILL, words: int = WORDS) -> DataFrame:
    """Indexed rows with up to `most` memories that the index lacks, newest first."""
    new = memories.join(vectors.select("id"), "id", "left_anti").orderBy(F.desc("created_at"), "id").limit(most)
    return vectors.unionByName(index(new, words))


def stats(vectors: DataFrame) -> DataFrame:
    """One row: indexed memories, entities in all, distinct entities, stored vectors."""
    sizes = vectors.agg(F.count("*").alias("indexed_memories"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("total_entities"), F.count("hv").alias("stored_vectors"))
    names = vectors.select(F.explode("entities").alias("e")).agg(F.countDistinct("e").alias("unique_concepts"))
    return sizes.crossJoin(names)  # one row each


def near_pairs(entities: Column) -> Column:
    """(subject, object) of each entity and the next."""
    return F.zip_with(F.slice(entities, F.lit(1), F.greatest(F.size(entities) - 1, F.lit(0))), F.slice(entities, F.lit(2), F.greatest(F.size(entities) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("subject"), b.alias("object")))


def decode(hv: DataFrame, concepts: DataFrame, top: int = 5) -> DataFrame:
    """(id, name, sim, r): the nearest of up to MOST_CONCEPTS concepts (name, cv) to each of some vectors."""
    from pyspark.sql import Window

    if (n := concepts.count()) > MOST_CONCEPTS:
        raise ValueError(f"{n} concepts: decode against fewer")
    pairs = hv.crossJoin(F.broadcast(concepts)).select("id", "name", F.round(similarity(F.col("hv"), F.col("cv")), 6).alias("sim"))
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "name"))).where(F.col("r") <= top).drop("r")


def expand(results: DataFrame, concepts: DataFrame, least: float = 0.7, factor: float = 0.8) -> DataFrame:
    """(id, text, score, origin) of concepts (name, cv) like one of the first three words, of four letters at least, of some results (id, text)."""
    firsts = F.slice(text.words(F.col("text")), 1, 3)
    words = results.select(F.explode(F.filter(firsts, lambda w: F.length(w) >= 4)).alias("id")).distinct()
    size = F.size(F.col("cv"))
    width = concepts.select(F.max(size)).first()[0] or WORDS
    near = decode(words.select("id", concept(F.col("id"), width).alias("hv")), concepts).where((F.col("sim") > least) & (F.col("name") != F.col("id")))
    best = near.groupBy("name").agg(F.max("sim").alias("sim"))
    return best.select(F.concat(F.lit("hdc-"), "name").alias("id"), F.concat(F.lit("related: "), "name").alias("text"), (F.col("sim") * factor).alias("score"), F.lit("expanded").alias("origin"))
