"""Secret scans: patterns find the plain cases, and a character convolutional network judges every other candidate in its context.

One pass over whole texts finds base spans and candidates: the values of base spans, and every other run of at least RUN characters that secrets are
written in. A candidate has its value and the characters around it. Findings with a label train the network: values of an assignment, of an access key,
and hexadecimal runs with a letter are secrets; runs outside of base spans are not; hexadecimal runs of digits alone may be card or phone numbers and have no
label. The network slides filters over characters (a table lookup for each of their places), takes each filter's maximum over the value and over the
context, and joins them in a small hidden layer. Half of what it learns from has its context blanked, so that the value's own form counts.

Logits are calibrated on documents that it did not learn from (Platt's scaling), and the threshold is one that keeps LEAST_RECALL of the secrets there,
context blanked, with the fewest false findings; candidates beyond it are added as kind `secret`. Base spans always stay.

Learning, calibration and threshold take all labelled findings, each different one once and of whatever length: parts of them are learned from in tasks, whose networks are
averaged after each epoch, and logits are counted. Maxima are taken block by block, and long values go through the network in small groups.

Cases: a null text is empty and has no spans; repeated rows are treated alike, and one finding counts once however often it is copied; rows without an id are
kept; equal starts keep the order assign, access, hex, secret; very long texts and values are read whole. Without LEAST_LABELS findings of both labels nothing is
added. An empty table gives an empty result; other columns pass by unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.llm.common import bounded_batches, lighten, materialise

KINDS = ("assign", "access", "hex", "secret")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{16,}")
#: The shortest run of secret characters that is a candidate.
RUN = 16
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{RUN},}}")
#: Characters of context before and after a value.
BEFORE, AFTER = 24, 12
LEAST_LABELS, LEAST_RECALL = 20, 0.98
#: Findings of a part that one task learns from, epochs, and steps of a logit.
PART_ROWS, EPOCHS, STEPS = 20_000, 12, 500
WIDTH, FILTERS, HIDDEN = 5, 32, 16
#: Codes of characters: 0 is blank, 1 to 95 are ASCII from the blank to the tilde, then all others, then the edge of a value.
_OTHER, _EDGE, CODES = 96, 97, 98
_BLOCK = 256


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start of the value, its end) of the base findings, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int | None, bool]]:
    """(start, end, label, base) of the values of base findings, each once, and of the other runs, which touch no base finding."""
    seen: dict[tuple[int, int], int | None] = {}
    for start, kind, end, a, b in base:
        sure = kind < 2 or any(c > "9" for c in text[start:end])
        seen[a, b] = 1 if sure or seen.get((a, b)) else None
    out = [(a, b, label, True) for (a, b), label in sorted(seen.items())]
    k, reach = 0, 0
    for m in _RUN.finditer(text):
        while k < len(base) and base[k][0] < m.end():  # the furthest end of the findings that start before this run ends
            reach, k = max(reach, base[k][2]), k + 1
        if reach <= m.start():
            out.append((m.start(), m.end(), 0, False))
    return out


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,label:int,base:boolean,value:string,before:string,after:string>>"


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, found): base spans and candidates of every row, written to shared storage. The texts are read once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("base", pa.bool_()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())]))
        for b in it:
            spans, found = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _, _ in base])
                found.append([{"start": s, "end": e, "label": y, "base": own, "value": t[s:e], "before": t[max(0, s - BEFORE) : s], "after": t[e : e + AFTER]} for s, e, y, own in candidates(t, base)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, spans_type), pa.array(found, found_type)], ["id", "spans", "found"])

    bounded_batches(spark)
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialise(spark, part.mapInArrow(run, f"id {part.schema['id'].dataType.simpleString()}, spans {_SPANS}, found {_FOUND}"), "findings")


def codes(s: str) -> np.ndarray:
    """The codes of a text's characters."""
    x = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((x >= 32) & (x < 127), x - 31, _OTHER).astype(np.uint8)


def encoded(value: str, before: str = "", after: str = "") -> tuple[np.ndarray, np.ndarray]:
    """A value between its edges, and its context with the value as a gap."""
    edge = np.array([_EDGE], np.uint8)
    pad = lambda x, n, left: np.concatenate([np.zeros(n - len(x), np.uint8), x] if left else [x, np.zeros(n - len(x), np.uint8)])
    context = np.concatenate([pad(codes(before), BEFORE, True), edge, pad(codes(after), AFTER, False)])
    return np.concatenate([edge, codes(value), edge]), context


def padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(WIDTH, max(map(len, rows), default=0))), np.uint8)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _like_lengths(lengths: list[int], most: int = 256) -> list[np.ndarray]:
    """Places of a batch's rows: all of up to `most` characters together, longer ones in groups of as many characters as those may have in all, or alone."""
    order = np.argsort(lengths, kind="stable")
    short = int(np.searchsorted(np.array(lengths)[order], most, "right"))
    out, start = [order[:short]] if short else [], short
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * lengths[order[stop]] <= most * len(lengths):
            stop += 1
        out.append(order[start:stop])
        start = stop
    return out


class Network:
    """Filters over characters, maxima, a hidden layer, one logit."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        ins = 2 * FILTERS + 1
        self.p = {"value": normal(WIDTH, CODES, FILTERS, scale=0.3), "context": normal(WIDTH, CODES, FILTERS, scale=0.3), "w": normal(ins, HIDDEN, scale=ins**-0.5), "b": np.zeros(HIDDEN, np.float32), "u": normal(HIDDEN, scale=HIDDEN**-0.5), "c": np.zeros(1, np.float32)}
        for t in ("value", "context"):
            self.p[t][:, 0] = 0  # a blank says nothing
        self.scale, self.shift = 1.0, 0.0

    def _pool(self, table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maximum over places, its place) of each filter, block by block, so memory doesn't grow with the length."""
        n, places = len(x), x.shape[1] - WIDTH + 1
        best, at = np.full((n, FILTERS), -np.inf, np.float32), np.zeros((n, FILTERS), np.int64)
        for start in range(0, places, _BLOCK):
            stop = min(start + _BLOCK, places)
            out = table[0][x[:, start:stop]]
            for k in range(1, WIDTH):
                out = out + table[k][x[:, start + k : stop + k]]
            where = out.argmax(1)
            top = np.take_along_axis(out, where[:, None], 1)[:, 0]
            at, best = np.where(top > best, where + start, at), np.maximum(best, top)
        return np.maximum(best, 0), at

    def forward(self, values: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, tuple]:
        v, at_v = self._pool(self.p["value"], values)
        c, at_c = self._pool(self.p["context"], contexts)
        size = np.log1p((values > 0).sum(1, keepdims=True)).astype(np.float32) / 4
        x = np.concatenate([v, c, size], 1)
        h = np.maximum(x @ self.p["w"] + self.p["b"], 0)
        return h @ self.p["u"] + self.p["c"][0], (v, at_v, c, at_c, x, h)

    def gradients(self, values: np.ndarray, contexts: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean logistic loss and its gradients."""
        z, (v, at_v, c, at_c, x, h) = self.forward(values, contexts)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = float(-np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)))
        dz = ((p - labels) / len(labels)).astype(np.float32)
        dh = np.outer(dz, self.p["u"]) * (h > 0)
        dx = dh @ self.p["w"].T
        g = {"u": h.T @ dz, "c": np.array([dz.sum()], np.float32), "w": x.T @ dh, "b": dh.sum(0)}
        filters = np.broadcast_to(np.arange(FILTERS), v.shape)
        for name, chars, top, at, d in (("value", values, v, at_v, dx[:, :FILTERS]), ("context", contexts, c, at_c, dx[:, FILTERS : 2 * FILTERS])):
            g[name] = np.zeros_like(self.p[name])
            d = d * (top > 0)
            for k in range(WIDTH):
                np.add.at(g[name][k], (np.take_along_axis(chars, at + k, 1), filters), d)
            g[name][:, 0] = 0
        return loss, g

    def fit(self, rows: list[tuple[str, str, str, int]], epochs: int = 12, batch: int = 128, rate: float = 3e-3, seed: int = 0) -> None:
        """Adam over rows (value, before, after, label), each with its context and, in another step, without; labels weigh alike."""
        rng = np.random.default_rng(seed)
        pairs = [encoded(*r[:3]) for r in rows]
        y = np.array([r[3] for r in rows], np.float32)
        slow, fast, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        sides = [s for k in (0, 1) if len(s := np.flatnonzero(y == k))]
        for _ in range(epochs):
            # the rarer label is drawn again until both are as many
            most = max(map(len, sides))
            order = rng.permutation(np.concatenate([np.resize(rng.permutation(s), most) for s in sides]))
            for start in range(0, len(order), batch):
                pick = order[start : start + batch]
                contexts = padded([pairs[i][1] for i in pick])
                contexts[rng.random(len(pick)) < 0.5] = 0
                g = {k: np.zeros_like(a) for k, a in self.p.items()}
                for group in _like_lengths([len(pairs[i][0]) for i in pick]):
                    _, part = self.gradients(padded([pairs[pick[i]][0] for i in group]), contexts[group], y[pick[group]])
                    for k, d in part.items():
                        g[k] += d * (len(group) / len(pick))
                t += 1
                for k, d in g.items():
                    slow[k] = 0.9 * slow[k] + 0.1 * d
                    fast[k] = 0.999 * fast[k] + 0.001 * d * d
                    self.p[k] -= (rate * (slow[k] / (1 - 0.9**t)) / (np.sqrt(fast[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def logits(self, rows: list[tuple[str, str, str]], blank: bool = False, batch: int = 512) -> np.ndarray:
        """Uncalibrated logits of rows (value, before, after), grouped by length so that padding stays small."""
        out = np.zeros(len(rows))
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][0]))
        start = 0
        while start < len(order):
            longest = len(rows[order[min(start + batch, len(order)) - 1]][0])
            # a batch of long values has fewer rows
            stop = min(len(order), start + max(1, min(batch, (1 << 20) // (longest + 1))))
            pairs = [encoded(*rows[i]) for i in order[start:stop]]
            contexts = padded([c for _, c in pairs])
            out[order[start:stop]] = self.forward(padded([v for v, _ in pairs]), contexts * (not blank))[0]
            start = stop
        return out

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, rounds: int = 50) -> None:
        """Platt's scaling by Newton steps, with smoothed labels; n tells how many findings each stands for."""
        n = np.ones(len(y)) if n is None else n
        pos, neg = float((n * y).sum()), float((n * (1 - y)).sum())
        target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, r = n * np.maximum(p * (1 - p), 1e-6), n * (p - target)
            h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, np.array([(r * z).sum(), r.sum()]))
            a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
            if np.abs(step).max() < 1e-6:
                break
        # what is told apart without an error has no finite scale; the order of logits must stay in any case
        self.scale, self.shift = max(a, 1e-3), b

    def probability(self, rows: list[tuple[str, str, str]], blank: bool = False) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(rows, blank) + self.shift, -30, 30)))


def recall_threshold(p: np.ndarray, y: np.ndarray, least: float = LEAST_RECALL, n: np.ndarray | None = None) -> float:
    """A threshold at or above which at least the share `least` of the positives lie; n tells how many findings each stands for.

    Of those that also let the fewest negatives through, from the greatest that keeps the recall down to the next negative, it is the middle in log odds.
    """
    n = np.ones(len(y)) if n is None else n
    order = np.argsort(-p[y > 0], kind="stable")
    good, upto = p[y > 0][order], np.cumsum(n[y > 0][order])
    if not len(good):
        return np.inf
    top = float(good[np.searchsorted(upto, np.ceil(least * upto[-1] - 1e-9))])
    below = p[(y == 0) & (p < top)].max(initial=1e-9)
    odds = (np.log(top / (1 - top)) + np.log(below / (1 - below))) / 2
    return float(1 / (1 + np.exp(-odds)))


class SecretModel:
    """A network and its threshold; without enough labels there is no network, and nothing is added."""

    def __init__(self, network: Network | None = None, threshold: float = np.inf) -> None:
        self.network, self.threshold = network, threshold

    def scores(self, rows: list[tuple[str, str, str]]) -> list[float]:
        return self.network.probability(rows).tolist() if self.network is not None and rows else [0.0] * len(rows)


def train(found: DataFrame, fold, part_rows: int = PART_ROWS, least_recall: float = LEAST_RECALL) -> SecretModel:
    """Learn from all labelled findings of find(), each different one once.

    fold is a column of ids: in rows where it is 0 the network learns, where it is 1 it is calibrated, others are left alone.
    The findings to learn from are dealt into parts of about part_rows. In each epoch every part takes the network's steps over all of its rows, and the
    networks of the parts are averaged by their rows. Calibration and threshold come from the counts of all findings by logit, in steps of 1 / STEPS.
    """
    spark = found.sparkSession
    each = found.select(fold.alias("fold"), F.explode("found").alias("f")).where("fold IN (0, 1) AND f.label IS NOT NULL")
    rows = materialise(spark, each.select("fold", "f.label", "f.value", "f.before", "f.after").distinct(), "labelled")
    counts = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    if min(counts.get((part, y), 0) for part in (0, 1) for y in (0, 1)) < LEAST_LABELS:
        return SecretModel()
    parts = -(-sum(counts[0, y] for y in (0, 1)) // part_rows)
    deal = F.pmod(F.xxhash64("value", "before", "after"), F.lit(parts)).cast("int")
    learn = materialise(spark, rows.where("fold = 0").select(deal.alias("part"), "label", "value", "before", "after").repartition(parts, "part").sortWithinPartitions("part", "label", "value", "before", "after"), "learn")
    network = Network()
    for epoch in range(EPOCHS):
        network.p = _averaged(learn, parts, network, epoch)
    told = _logit_counts(rows.where("fold = 1"), network)
    z, y, n = (np.array(c, np.float64) for c in zip(*told, strict=True))
    network.calibrate(z, y, n)
    return SecretModel(network, recall_threshold(1 / (1 + np.exp(-np.clip(network.scale * z + network.shift, -30, 30))), y, least_recall, n))


def _averaged(learn: DataFrame, parts: int, network: Network, epoch: int) -> dict[str, np.ndarray]:
    """The parameters after one epoch over each part of learn (part, label, value, before, after), averaged by the parts' rows."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        lighten()
        own = Network()
        own.p = {k: a.copy() for k, a in network.p.items()}
        y, *texts = (part.column(c).to_pylist() for c in ("label", "value", "before", "after"))
        own.fit([(v, b, a, t) for t, v, b, a in zip(y, *texts, strict=True)], 1, seed=epoch)
        flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)]).astype("<f4").tobytes()
        return pa.table({"n": pa.array([part.num_rows], pa.int64()), "part": pa.array([key[0].as_py()], pa.int32()), "p": pa.array([flat], pa.binary())})

    # a single part needs no shuffle, and several are dealt to as many tasks
    dealt = learn.coalesce(1) if parts == 1 else learn.repartition(parts, "part")
    got = dealt.groupBy("part").applyInArrow(run, "n long, part int, p binary")
    total, mean = 0, np.zeros(sum(a.size for a in network.p.values()))
    for r in got.orderBy("part").toLocalIterator():  # a few hundred KB for each part, one after the other
        total += r["n"]
        mean += (np.frombuffer(bytes(r["p"]), "<f4") - mean) * (r["n"] / total)
    out, at = {}, 0
    for k in sorted(network.p):
        a = network.p[k]
        out[k], at = mean[at : at + a.size].astype(np.float32).reshape(a.shape), at + a.size
    return out


def _logit_counts(rows: DataFrame, network: Network) -> list[tuple[float, int, int]]:
    """(logit without context, label, findings) of all rows (label, value, before, after); logits are rounded down to steps of 1 / STEPS and held within 30."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            z = network.logits(list(zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)), blank=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(z, -30, 30) * STEPS).astype(np.int64)), b.column(0)], ["z", "label"])

    told = rows.select("label", "value", "before", "after").mapInArrow(run, "z long, label int").groupBy("z", "label").count()
    return sorted((r["z"] / STEPS, r["label"], r["count"]) for r in told.collect())  # at most 60 * STEPS steps of either label


def judge(found: DataFrame, model: SecretModel) -> DataFrame:
    """(id, spans, all_spans, p_secret): base spans, those with what the network adds, and the greatest probability of a candidate."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            lists = b.column(2).to_pylist()
            scores = iter(model.scores([(c["value"], c["before"], c["after"]) for x in lists for c in x or ()]))
            every, greatest = [], []
            for spans, x in zip(b.column(1).to_pylist(), lists, strict=True):
                p = [next(scores) for _ in x or ()]
                added = [{"start": c["start"], "kind": 3, "end": c["end"]} for c, s in zip(x or (), p, strict=True) if s >= model.threshold and not c["base"]]
                every.append(sorted([*spans, *added], key=lambda s: (s["start"], s["kind"])))
                greatest.append(max(p, default=0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(every, b.column(1).type), pa.array(greatest, pa.float64())], ["id", "spans", "all_spans", "p_secret"])

    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, spans {_SPANS}, all_spans {_SPANS}, p_secret double")


def span_list(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def default_fold(id_col: str = "id"):
    """Learn from half of the documents, calibrate on a quarter, leave the rest: by crc32 of the id modulo 4."""
    part = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return F.when(part == 1, 1).when(part == 2, 2).otherwise(0)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets of every document."""
    found = find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = judge(found, train(found, default_fold()))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select(F.col("id").alias("doc_id"), *(count(k) for k in range(3)), F.sha2(span_list("spans"), 256).alias("base_sha256"), span_list("all_spans").alias("spans"), "p_secret")
