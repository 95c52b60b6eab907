"""Verdicts, samples, clashing names, both arms of size checks, and the pipeline stage by stage against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recallsmith.llm import common, decontam, lang_id, near_dup, packing, pii, quality, queries, tokens, toxicity

SF = "/root/testdata/sf0.01"
CLASH = ["key", "row", "terms", "__id", "__key", "text_", "group_id", "n", "c", "host", "spans", "problem", "rank"]


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "a b c d"), (5, "a b c d"), (6, "a  b\tc \n"), (7, "mail a@b.co or +1 (978) 555-6437, 4111 1111 1111 1111"), (7, "a b c d"), (7, "a b c d"), (8, "word " * 30_000), (9, "!!! ??? 123"), (None, "no id here"), (None, None)]
    return clashing(spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))


# --- samples ------------------------------------------------------------------------------------------------------


def test_sample_limits_at_any_size():
    assert common.sample_limit(300, 300) == common.SAMPLE_RANGE
    for rows in (10**3, 10**6, 10**9, 10**13, 10**17):
        assert common.sample_limit(300, rows) / common.SAMPLE_RANGE * rows == pytest.approx(330, rel=0.01)


def test_sample_is_about_as_large_as_wanted(spark):
    df = spark.range(60_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    got = {r.g: r.n for r in common.sampled(df, "g", {"a": 20_000, "b": 40_000, "absent": 5}, 1000, "id").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert 950 < got["a"] < 1250 and 950 < got["b"] < 1250
    # as if the table had a thousand million rows of each: a few of the rows that there are still pass
    few = common.sampled(df, "g", {"a": 10**9, "b": 10**9}, 10**7, "id").count()
    assert 500 < few < 850 and common.sampled(df, "g", {}, 10, "id").count() == 0


# --- language identification --------------------------------------------------------------------------------------


def naive_grams(text):
    data, out, m = list(b" " + text.lower().encode() + b" "), Counter(), (1 << 32) - 1
    for i in range(len(data)):
        h = data[i] * 0x9E3779B1 & m
        for k in (1, 2, 3):
            if i + k >= len(data):
                break
            h = ((h ^ h >> 15) * 0x85EBCA6B + data[i + k] * 0xC2B2AE35) & m
            out[(h ^ h >> 13) & lang_id.DIMENSIONS - 1] += 1
    return out


def test_grams_and_decisions(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = lang_id.train(docs.where(common.crc32_mod("doc_id", 4) != 2))
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.QUERIES["op1_language_id"](spark, SF).collect()}
    monkeypatch.setattr(lang_id, "_CHUNK", 64)

    def decide(machine, x):
        if len(machine.labels) == 1:
            return machine.labels[0], 1.0
        votes, least = defaultdict(float), defaultdict(lambda: math.inf)
        for (i, j), w in zip(machine.pairs, machine.weights, strict=True):
            m = sum(float(w[k]) * v for k, v in x.items())
            for k, s in ((i, m), (j, -m)):
                votes[k] += (s > 0) + 1e-3 * math.tanh(s)
                least[k] = min(least[k], s)
        best = max(votes, key=votes.get)
        return machine.labels[best], 1 / (1 + math.exp(-4 * least[best]))

    for r in docs.limit(60).collect():
        grams = naive_grams(r.text)
        assert {k: int(n) for k, n in enumerate(lang_id.gram_counts(r.text)) if n} == dict(grams)
        if not re.search(r"[^\W\d_]", r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        norm = math.sqrt(sum(grams.values()))
        x = {k: math.sqrt(n) / norm for k, n in grams.items()}
        family, sure = decide(model.top, x)
        lang, surer = decide(model.within[family], x)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(sure * surer, abs=1e-3)


def test_many_and_odd_language_values(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 7) * 3} {chr(97 + i % 7) * 4} words", f"x{i % 7}" if i % 7 < 6 else "") for i in range(210)] + [(999, "rare", "once")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = lang_id.train(df)
    assert len(model.within["other"].labels) == 8 and list(model.within) == ["other"]
    assert model.predict("aaa aaaa words")[0] == "x0"
    monkeypatch.setattr(lang_id, "FAMILY_SIZE", 3)  # all values are learned, in families of three
    model = lang_id.train(df)
    assert sorted(x for m in model.within.values() for x in m.labels) == ["", "once", *(f"x{i}" for i in range(6))]
    assert len(model.within) == 3 and all(model.predict(f"{c * 3} {c * 4} words")[0] == f"x{i}" for i, c in enumerate("abcdef"))


def test_samples_of_repeated_rows_are_the_same_whatever_the_partitions(spark):
    rows = [(7, "the same words again", "en")] * 3000 + [(i, f"andere worte {i}", "de") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (lang_id.train(df.repartition(n), per_language=100) for n in (3, 7))
    assert (a.top.weights == b.top.weights).all() and a.predict("worte")[0] == "de"


# --- toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_query_against_plain_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    graded = labels.select("doc_id", toxicity.grade_column().alias("grade")).where(common.crc32_mod("doc_id", 4) != 2)
    model = toxicity.train(docs, graded)
    got = {r.doc_id: r for r in queries.QUERIES["op9_toxicity_severity"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", t.lower())}
        words |= {w[:4] + "-" for w in words if len(w) > 4}
        eta = sum(w for x, w in model.weights.items() if x in words)
        above = [1 / (1 + math.exp(-(eta - th))) for th in model.thresholds]
        assert got[d].expected_severity == pytest.approx(sum(above)) and got[d].p_toxic == pytest.approx(above[0]) and above == sorted(above, reverse=True)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_toxicity_severity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    rows = [(r.label, r.expected_severity) for r in got.select("label", "expected_severity").collect()]
    bad, good = np.array([s for t, s in rows if t]), np.array([s for t, s in rows if not t])
    order = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    assert len(bad) > 100 and order > 0.85


def test_four_ordered_grades():
    words = ["mild", "harsh", "vile"]
    texts = [toxicity.features_of(f"plain text {' '.join(words[: i % 4])} filler{i % 50}") for i in range(800)]
    model = toxicity.SeverityModel.fit(texts, np.array([i % 4 for i in range(800)]))
    expected = [sum(model.above(f"plain text {' '.join(words[:k])}")) for k in range(4)]
    assert len(model.thresholds) == 3 and expected == sorted(expected) and expected[0] < 0.5 and expected[3] > 2.5


def test_toxicity_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (3, 1, 0), (4, None, None), (None, 1, 1), (77, 1, 0)], "doc_id long, toxic int, quality int").select("doc_id", toxicity.grade_column().alias("grade"))
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(odd.limit(0), model).count() == 0


# --- host rules ---------------------------------------------------------------------------------------------------


def host_table(spark):
    good, bad = "one two three four five six seven eight nine ten eleven " * 1, "# $ %"
    rows = [(i, bad if i % 20 else good, "spam") for i in range(200)] + [(1000 + i, bad if i % 10 == 0 else good, f"h{i % 5}") for i in range(200)] + [(5000, good, None), (5001, None, "tiny"), (5002, good, "tiny")]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("id", F.lit("x")))


@pytest.mark.parametrize("most", [50_000, 0])
def test_host_verdicts(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", most)
    df = host_table(spark)
    got = quality.host_rules(spark, df).collect()
    rows = [(r.doc_id, *quality.measure(r.text), r.source) for r in df.select("doc_id", "text", "source").collect()]
    failed = {d: n < 10 or 100 * rep > 20 * n or 10 * sym > chars or 10 * dup > 3 * n for d, n, chars, sym, dup, rep, _ in rows}
    hosts = defaultdict(list)
    for d, *_, h in rows:
        if h is not None:
            hosts[h].append(failed[d])
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean = min(max(sum(rates) / len(rates), 1e-4), 1 - 1e-4)
    between = max(np.var(rates, ddof=1) - mean * (1 - mean) * np.mean([1 / len(x) for x in hosts.values()]), 1e-6)
    strength = max(mean * (1 - mean) / between - 1, 2.0)
    a, b = mean * strength, (1 - mean) * strength
    want = {}
    for h, x in hosts.items():
        p = (sum(x) + a) / (len(x) + a + b)
        want[h] = (p, p - 2 * math.sqrt(p * (1 - p) / (len(x) + a + b + 1)) > 0.6)
    assert [h for h in want if want[h][1]] == ["spam"] and len(got) == len(rows)
    of = {d: h for d, *_, h in rows}
    for r in got:
        rate, out = want.get(of[r.id], (None, False))
        assert (r.host_rate is None) == (rate is None) and (rate is None or r.host_rate == pytest.approx(rate))
        assert r.kept == (not r.base_failed and not out)


# --- near copies --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [3, 4, 6])
def test_links_for_any_number_of_blocks(spark, parts):
    rng = np.random.default_rng(parts)
    base = rng.integers(0, 1 << 62, 40)
    fps = {int(b) for b in base} | {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (6, 2))}
    fps |= {(1 << 40) - 1 ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i, 12)}
    edges = near_dup.link_fingerprints(spark, spark.createDataFrame([(x,) for x in fps], "fp long"), parts)
    roots = {r.node: r.root for r in near_dup.connected_components(spark, edges).collect()}
    group = {x: roots.get(x, x) for x in fps}
    label = {x: x for x in fps}
    changed = True
    while changed:
        new = {x: min(label[y] for y in fps if (x ^ y).bit_count() <= 2) for x in fps}
        changed, label = new != label, new
    assert len({(group[x], label[x]) for x in fps}) == len(set(group.values())) == len(set(label.values()))


@pytest.mark.parametrize("most", [100_000, 0])
def test_one_of_each_group_stays(spark, odd, monkeypatch, most):
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", most)
    long_ = [f"w{i}" for i in range(60)]
    more = odd.unionByName(clashing(spark.createDataFrame([(20, " ".join(long_)), (21, " ".join([*long_[:59], "other"])), (22, "quite another text with seven words"), (7, "under one id a text of its own")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})))
    kept = near_dup.keep_one(spark, more)
    got = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:12]) for r in kept.collect())
    # null and empty are one group, so are all copies of a b c d; the two rows without an id stay
    assert kept.columns == more.columns
    assert got == [(-1, ""), (-1, "no id here"), (1, ""), (3, "one"), (4, "a b c d"), (6, "a  b\tc \n"), (7, "mail a@b.co "), (7, "under one id"), (8, "word word wo"), (9, "!!! ??? 123"), (20, "w0 w1 w2 w3 "), (22, "quite anothe")]
    assert near_dup.keep_one(spark, more.limit(0)).count() == 0


# --- sanitisation -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [20_000, 0])
def test_disclosure_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", most)
    rng = np.random.default_rng(8)
    vocabulary = [f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = []
    for i in range(160):
        words = [vocabulary[k] for k in rng.integers(0, 300, 25)]
        if i % 3 == 0:
            words.insert(0, "spy@x.org")
            words.append(["zanzibar", "harbour"][i % 2] + (" " + "filler " * 80 + "faraway" if i % 4 == 0 else ""))
        if i % 5 == 0:
            words.append("10.1.2.3 and +1 978 555 64 37")
        rows += [(i, " ".join(words))] * (4 if i % 9 == 0 else 1)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = pii.find_base(spark, df)
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosure(spark, found, df).collect()}
    terms = lambda t: {w for w in re.split(r"[^a-z]+", t.lower()) if len(w) >= 4}
    held = {r.key: None for r in found.collect()}
    assert len(held) < len(rows)
    docs = [(t, terms(t), {f"{s.kind}:{s.value.lower()}" for s in r.spans}) for (_, t), r in zip(sorted(rows), sorted(found.collect(), key=lambda r: (r.id, r.row)), strict=True)]
    n_e, n_t, n_te, texts = Counter(), Counter(), Counter(), defaultdict(set)
    for t, ts, es in docs:
        n_e.update(es)
        n_t.update(ts)
        n_te.update((e, x) for e in es for x in ts)
        for e in es:
            for x in ts:
                texts[e, x].add(t)
    want = {}
    for (e, x), n in n_te.items():
        k = len(texts[e, x])
        d = k / (k + 1) * (1 + math.log2(n / n_t[x]) / math.log2(len(docs) / n_e[e]))
        if d >= pii.GENERALISE:
            want[e, x] = d
    assert got == {k: pytest.approx(v) for k, v in want.items()} and {"zanzibar", "harbour", "faraway"} <= {x for _, x in got}
    out = pii.sanitise(spark, df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert not any(w in r.text for r in out.collect() for w in ("zanzibar", "faraway", "spy@x.org", "10.1.2.3"))


# --- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, now = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        now = common.materialise(spark, stage(spark, now, sf), name)
        stages.append(now)
        assert now.columns == docs.columns or name == "best_fit_packing"
    texts = [{r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in stages[:-1]]
    model = lang_id.train(docs)
    assert set(texts[1]) == {d for d, t in texts[0].items() if model.predict(t)[0] != "und" and model.predict(t)[1] >= 0.05}
    assert all(r.lang is not None for r in docs.where(~F.col("doc_id").isin(list(texts[1]))).collect()) or len(texts[1]) > 0.9 * len(texts[0])

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in texts[1].items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                r, s = sorted((find(a), find(b)))
                root[s] = r
    assert set(texts[2]) == {d for d in ids if find(d) == d}

    items = decontam.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    found = set()
    for d, t in texts[2].items():
        n = items.numbers(t)
        have = Counter(n.tolist())
        for w in items.words:
            shared = sum(min(c, have[k]) for k, c in Counter(w.tolist()).items())
            if shared >= 0.5 * len(w) and decontam.align(w, n)[0] >= decontam.LEAST_SCORE:
                found.add(d)
                break
    gone = set(texts[2]) - set(texts[3])
    assert gone <= found and len(gone) >= 0.99 * len(found)

    for d, t in texts[4].items():
        before = texts[3][d]
        if not re.search(r"@|[0-9]", before):
            assert t == before
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", t)
    assert set(texts[4]) == set(texts[3])

    t = tokens.WordTokenizer(tokens.tokenizer_path("byte_bpe_50k.json"))
    sizes = defaultdict(int)
    for r in stages[5].collect():
        sizes[r.doc_id] += r.length
    assert dict(sizes) == {d: len(t.tokenizer.encode(x, add_special_tokens=False).ids) + 1 for d, x in texts[4].items()}
    # the registered run gives the same pieces
    run = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, stages[5].select(key).collect()))


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf, odd):
    some = odd.unionByName(clashing(spark.read.parquet(f"{sf}/documents.parquet").limit(40).select(odd.columns[:5])))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (some, odd, odd.limit(0)):
            out = common.materialise(spark, stage(spark, df, sf), "odd")
            assert out.columns == df.columns and out.count() <= df.count()
    for df in (some, odd.limit(0)):
        pieces = corpus_pipeline.best_fit_packing(spark, df, sf)
        assert pieces.where("piece = 0").count() == df.count()


def test_whole_pieces_and_repeated_rows(spark):
    df = clashing(spark.createDataFrame([(1, "a" * 50_000)] * 5 + [(2, "x")] * 5, "doc_id long, text string"))
    q = packing.pack(spark, df, tokens.tokenizer_path("byte_bpe_50k.json")).toPandas()
    assert q.groupby("sequence_id").length.sum().max() <= 2048 and not q.duplicated(["sequence_id", "offset"]).any()
