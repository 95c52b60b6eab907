"""The text operators against brute force, round trips and held-out labels, with odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from recallsmith.llm import chat, decontam, lang_id, near_dup, ngram_lm, packing, pii, quality, queries, rans, tokens, toxicity

ODD = [(1, None), (2, ""), (3, "one"), (4, "a b c d"), (5, "a b c d"), (6, "a  b\tc \n"), (7, "über 10.0.0.1 a@b.co +1 (978) 555-6437, 4111 1111 1111 1111"), (7, "a b c d"), (8, "word " * 30_000), (9, "!!! ??? 123")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "en", "src") for i, t in ODD], "doc_id long, text string, id string, lang string, source string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_near_dup(spark, sf, docs, odd, empty):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op8_simhash_near_dup"](spark, sf).collect()}
    f = {d: near_dup.simhash(t.encode()) for d, t in docs.items()}
    root = {d: d for d in docs}
    for _ in docs:
        new = {d: min(root[e] for e in docs if (f[d] ^ f[e]).bit_count() <= 2) for d in docs}
        if new == root:
            break
        root = new
    assert got == {d: (f"{f[d]:016x}", root[d]) for d in docs}
    rows = near_dup.near_duplicates(spark, odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.id in (4, 5)} == {4}
    assert near_dup.near_duplicates(spark, empty).count() == 0
    kept = near_dup.keep_one(spark, odd)
    assert kept.columns == odd.columns and 5 not in {r.doc_id for r in kept.collect()}


def test_large_block_of_near_copies(spark):
    base = (1 << 40) - 1
    fps = [base ^ (1 << i) ^ (1 << j) for i in range(0, 20) for j in range(i + 1, 20)]
    edges = near_dup.link_fingerprints(spark, spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {frozenset((r.a, r.b)) for r in edges.collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, got))
    roots = near_dup.connected_components(spark, edges)
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(fps) - 1


def same_groups(spark, texts, least=0.8):
    """Whether similarity_groups() gives the groups of all pairs' five-word-shingle Jaccard similarities."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    groups = near_dup.similarity_groups(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r.id: r.group_id for r in groups.collect()} == dict(enumerate(root))


def edited(words, *at):
    return " ".join("edit%d" % i if i in at else w for i, w in enumerate(words))


def test_near_copies_in_large_blocks(spark):
    rng = np.random.default_rng(1)
    stock = [f"stockword{i}" for i in range(90)]
    texts = [edited(stock, *rng.choice(90, rng.integers(1, 6), replace=False).tolist()) for _ in range(150)]
    texts += [" ".join([*stock[:60], *(f"own{g}{i}" for i in range(40)), *["tail"] * k]) for g in range(60) for k in (0, 1)]
    assert same_groups(spark, texts)


def test_near_copies_close_to_the_threshold(spark):
    texts = []
    for k in range(60):
        words = [f"word{k}number{i}" for i in range(94)]
        texts += [" ".join(words), edited(words, 20, 60)]  # 80 of 100 shingles: 0.8
    assert same_groups(spark, texts)


def test_short_near_copies(spark):
    texts = []
    for k in range(40):
        words = [f"w{k}n{i}" for i in range(50)] + [f"longword{k}n{i}" for i in range(8)]
        texts += [" ".join(words), edited(words, 57)]  # eight long words and seven
    assert same_groups(spark, texts)


def test_token_files(spark, sf, docs, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("word_bpe_49k.json")
    t, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op3_token_files"](spark, sf).collect()}
    for d in sorted(docs):
        ids = np.array(t.encode(docs[d], add_special_tokens=False).ids + [2], "<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for name, df in (("odd", odd), ("none", empty)):
        rans.write_token_files(spark, df, f"file://{tmp_path}/{name}", path)
        assert rans.read_token_files(spark, f"file://{tmp_path}/{name}").count() == df.count()


def test_token_files_with_null_and_large_ids(spark, tmp_path):
    path, big = tokens.tokenizer_path("word_bpe_49k.json"), (1 << 53) + 1
    df = spark.createDataFrame([(None, "one two"), (big, "three"), (None, None), (-5, "four five six")], "doc_id long, text string")
    rans.write_token_files(spark, df, f"file://{tmp_path}/nulls", path)
    rows = sorted(rans.read_token_files(spark, f"file://{tmp_path}/nulls").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, -5, big]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(4)] and all(len(r.ids) == 4 * r.n_tokens for r in rows)


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 5000, 70_000, 200_001):
        ids = (rng.zipf(1.3, n) % 4000).astype(np.int64)
        c = rans.Coder(rans.scale_counts(np.bincount(ids, minlength=4000) if n else np.zeros(4000, np.int64)))
        states, words = c.encode(ids)
        sums = c.checksums(ids, states)
        assert (c.decode(n, states, words, sums) == ids).all()
        for k, (a, z) in enumerate(c.spans(n, states)):  # each span by itself, without those before
            assert (c.decode_span(n, states, words, k) == ids[a:z]).all()
    with pytest.raises(rans.CorruptBlock):
        c.decode(n, states, words[: len(words) // 8 * 4], sums)
    with pytest.raises(rans.CorruptBlock):
        c.decode(n, states, words[:400] + b"\x01\x02\x03\x04" + words[404:], sums)


def test_tokenizer_memo_equals_library(monkeypatch):
    import random

    rng = random.Random(5)
    marks = [*"aB'sé .,!\n\t1 9$#<|>ÉİΣσ\u00a0\u3000\u0301 ' ßñ\x1c\x85中", "<|endoftext|>", "'ll", " the", "\r\n"]
    for name, memo in (("word_bpe_49k.json", 50), ("byte_bpe_50k.json", 50), ("byte_bpe_50k.json", 10**6)):
        monkeypatch.setattr(tokens, "MEMO_WORDS", memo)
        monkeypatch.setattr(tokens, "BATCH_BYTES", 300)
        t = tokens.WordTokenizer(tokens.tokenizer_path(name))
        texts = ["a  b", " x", "x ", "\n", "", None, 'don\'t stop. "Hi!"; <|endoftext|> ok.', "É. ñ, 12, 3.", "İ Σας. ΣΑΣ", "e \u0301x", "a\tb", "x.,!?;: y", "1,000. 2", "a b c"]
        texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(3000)]
        assert t.ids(texts) == [np.array(t.tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        rows = [(at, ids, ends) for at, ids, ends in t.columns(__import__("pyarrow").array([None, "a b", ""]), 7)]
        assert [x for _, ids, _ in rows for x in ids.tolist()].count(7) == 3


def test_packing(spark, sf, docs, odd, empty):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for df, texts in ((spark.read.parquet(f"{sf}/documents.parquet"), list(docs.items())), (odd.unionByName(odd), ODD * 2), (empty, [])):
        rows = packing.pack(spark, df, path).toPandas()
        want = []
        for d, text in texts:
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
            cuts = sorted({0, *range(len(ids), 0, -2048)} | {len(ids)})
            want += [(d, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
        if texts:
            q = rows.sort_values(["sequence_id", "offset"])
            assert (q.groupby("sequence_id").offset.shift(-1).dropna() == (q.offset + q.length)[q.groupby("sequence_id").offset.shift(-1).notna()]).all()
            assert (q.offset + q.length).max() <= 2048 and (q.groupby("sequence_id").offset.min() == 0).all()
            assert q.sequence_id.nunique() == -(-q.length.sum() // 2048)


def test_packing_of_many_problems(spark, monkeypatch):
    monkeypatch.setattr(packing, "PROBLEM_PIECES", 60)
    monkeypatch.setattr(packing, "MERGE", 4)
    df = spark.createDataFrame([(i, "word " * (7 * i % 900)) for i in range(1500)] + [(7, "same text")] * 400, "doc_id long, text string")
    q = packing.pack(spark, df, tokens.tokenizer_path("byte_bpe_50k.json"), keep_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    assert len(q) == 1900 and (q.ids.map(len) == 4 * q.length).all() and (q.groupby("sequence_id").length.sum() <= 2048).all()
    assert (q.offset == q.groupby("sequence_id").length.cumsum() - q.length).all()
    assert q.sequence_id.nunique() <= -(-q.length.sum() // 2048) + 2


def test_genetic_operators_keep_pieces():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 300).tolist()
    a, b = packing.best_fit(lengths), packing.best_fit(lengths[::-1])
    for p in (packing.crossover(a, b, 2048, rng), packing.mutate(a, 2048, rng), packing.fullest(lengths), packing.replace(lengths[:50], packing.best_fit(lengths[50:]), 2048, rng), packing.evolve(lengths, [], rng)):
        assert sorted(x for c in p for x in c) == sorted(lengths) and max(map(sum, p)) <= 2048


def test_genetic_algorithm_beats_best_fit():
    rng, lengths = np.random.default_rng(3), []
    for _ in range(300):  # three pieces each that fill a bin exactly
        a = int(rng.integers(778, 1003))
        b = int(rng.integers(512, (2048 - a) // 2 + 1))
        lengths += [a, b, 2048 - a - b]
    best, seeds = packing.best_fit(lengths), []
    for epoch in range(2):
        seeds = [packing.evolve(lengths, seeds, np.random.default_rng([i, epoch])) for i in range(2)]
    assert len(best) > 330 and min(map(len, seeds)) <= 303 and packing.lower_bound(lengths) == 300


def test_lower_bound_of_small_problems():
    import itertools

    def exact(x):
        full = (1 << len(x)) - 1
        fits = [m for m in range(1, full + 1) if sum(v for i, v in enumerate(x) if m >> i & 1) <= 10]
        need = {0: 0}
        for m in range(1, full + 1):
            need[m] = min(need[m & ~f] + 1 for f in fits if f & m == f and f & (m & -m))
        return need[full]

    for x in itertools.combinations_with_replacement([1, 3, 4, 5, 6, 7, 10], 5):
        assert packing.lower_bound(list(x), 10) <= exact(x) <= len(packing.evolve(list(x), [], np.random.default_rng(0), 10))


def test_chat(spark, sf, odd):
    got = {r.conv_id: r for r in queries.QUERIES["op2_chat_formatting"](spark, sf).collect()}
    c = spark.read.parquet(f"{sf}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    for k, g in c.groupby("conv_id"):
        said = "".join(g.text[g.role == "assistant"])
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text)).encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(g), len(said), hashlib.sha256(said.encode()).hexdigest())
    for t in ("<|", "<\\|", "<|im_end|>\n", "<", "\\|", "<\\\\|x"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], chat._TURNS))).count() == 0
    rows = [(None, 0, "user", "x"), (None, None, None, None), (5, 1, "assistant", "a" * 3_000_000), (5, 0, "a%0A\nb", ""), (5, 1, "assistant", "<|im_end|>")]
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, chat._TURNS))).collect()}
    said = "<|im_end|>" + "a" * 3_000_000
    assert (back[None].n_turns, back[5].n_turns, back[5].loss_chars, back[5].loss_sha256) == (2, 3, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_layouts(spark):
    turns = [(1, "user", "p"), (1, "assistant", "c")]
    records = [
        ('{"prompt":"p","completion":"c"}', turns),
        ('{"prompt":"p","completion":"c","id":7,"meta":{"tags":["x"]}}', turns),
        ('{"messages":[{"role":"user","content":"p"},{"role":"assistant","content":"c","n":1}]}', turns),
        ('{"messages":[{"role":"human","content":[{"type":"text","text":"p"}]},{"role":"gpt","content":[{"type":"text","text":"c"},{"type":"image"}]}]}', turns),
        ('{"conversations":[{"from":"human","value":"p"},{"from":"gpt","value":"c"}]}', turns),
        ('{"system":"","instruction":"p","input":"","output":"c"}', turns),
        ('{"system":"s","instruction":"p","input":"q","output":null}', [(1, "system", "s"), (1, "user", "p\n\nq"), (1, "assistant", "")]),
        ('{"x":1}', []), ("bad", []), (None, []), ("[1]", []), ("{}", []),
    ]
    j = spark.createDataFrame([(k, x, "clash") for k, (x, _) in enumerate(records)], "id long, j string, conv_id string")
    got = {}
    for r in chat.json_turns(j, "id", "j").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((1, r.role, r.text))
    assert got == {k: want for k, (_, want) in enumerate(records) if want}
    assert {r.id for r in chat.unmapped(j, "id", "j").collect()} == {7, 8, 9, 10, 11}
    for kind, values in (
        ("conv_id long, messages array<struct<role:string,content:string>>, extra string", (1, [("human", "p"), ("gpt", "c")], "x")),
        ("conv_id long, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>", (1, [("user", [("t", "p")]), ("assistant", [("t", "c"), ("i", None)])])),
        ("id int, instruction string, input string, output string", (1, "p", None, "c")),
    ):
        t = chat.table_turns(spark.createDataFrame([values], kind)).orderBy("turn").collect()
        assert [(r.conv_id, r.role, r.text) for r in t] == turns
    t = chat.table_turns(spark.createDataFrame([(1, 0, "human", "p"), (1, 1, "gpt", "c")], "conv_id long, turn int, role string, text string"))
    assert sorted((r.turn, r.role) for r in t.collect()) == [(0, "user"), (1, "assistant")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.table_turns(spark.createDataFrame([(1,)], "x int"))


def test_quality(spark, sf, docs, odd, empty):
    got = {r.doc_id: r for r in queries.QUERIES["op5_host_quality_rules"](spark, sf).collect()}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(set(grams)) < len(grams) else set()
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert got[d].base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
    assert quality.host_rules(spark, odd).count() == len(ODD) and quality.host_rules(spark, empty).count() == 0


def test_language(spark, sf, odd, empty):
    rows = queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas())
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and rows.score.between(0, 1).all()
    got = lang_id.identify(odd, lang_id.train(odd)).collect()
    assert {r.id: r.lang_pred for r in got if r.id in (1, 2, 9)} == {1: "und", 2: "und", 9: "und"}
    assert lang_id.identify(odd, lang_id.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, odd, empty):
    bad, good = "you are a stupid loser", "the weather is nice today"
    texts = [toxicity.features_of(f"{bad if i % 3 == 0 else good} number{i}") for i in range(300)]
    model = toxicity.SeverityModel.fit(texts, np.array([int(i % 3 == 0) + int(i % 6 == 0) for i in range(300)]))
    assert model.above(bad)[0] > 0.9 and model.above(good)[0] < 0.1 and model.thresholds == sorted(model.thresholds)
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.train(empty, spark.createDataFrame([], "doc_id long, grade int")).above("x") == []


def test_decontamination(spark, odd, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    w = item.split()
    edited = " ".join("CHANGED" if i in (4, 11) else x for i, x in enumerate(w))
    rows = [(1, "pre " * 50 + item.upper() + ", post"), (2, "x " + edited), (3, "alpha beta and nothing else here"), (4, None), (5, " ".join(reversed(w)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contamination(d, b).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == 1.0 and got[2, 7] > 0.7
    assert {r.doc_id for r in decontam.drop_contaminated(d, b).collect()} == {3, 4, 5}
    assert decontam.contamination(empty, b).count() == 0 and decontam.contamination(d, b.limit(0)).count() == 0


def test_decontamination_of_passages_in_many_documents(spark):
    w = [f"w{i}" for i in range(60)]
    edited = " ".join("CHANGED" if i % 5 == 4 else x for i, x in enumerate(w))
    d = spark.createDataFrame([(i, f"before {i} {edited} after") for i in range(40)] + [(99, "one tiny remark")], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(w)), (2, "tiny remark"), (3, "remark tiny")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.end_word) for r in decontam.contamination(d, b).collect()}
    assert set(got) == {*((i, 1) for i in range(40)), (99, 2)} and got[99, 2] == (1, 3)


def test_alignment_of_long_runs():
    def plain(x, y):
        rows = np.zeros((len(x) + 1, len(y) + 1), np.int64)
        for i in range(len(x)):
            for j in range(len(y)):
                rows[i + 1, j + 1] = max(0, rows[i, j] + (2 if x[i] == y[j] else -1), rows[i, j + 1] - 1, rows[i + 1, j] - 1)
        return rows.max() / 2 / len(x)

    rng = np.random.default_rng(4)
    for _ in range(150):
        x, y = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(1, 5, rng.integers(1, 30))
        score, first, end = decontam.align(x, y)
        assert score == plain(x, y)
        if score:
            assert decontam.align(x, y[first:end])[0] == score
    assert decontam.align(np.arange(1, 2001), np.concatenate((np.zeros(200_000, np.int64), np.arange(1, 2001))))[0] == 1.0


def test_decontamination_equals_all_alignments(spark):
    rng = np.random.default_rng(6)
    stock = [f"word{i}" for i in rng.integers(0, 2000, 4000)]
    items = [(k, " ".join(stock[50 * k : 50 * k + int(rng.integers(9, 50))])) for k in range(40)] + [(40, items0 := "twin phrase"), (41, items0)]
    docs = []
    for i in range(150):
        words = [f"word{x}" for x in rng.integers(0, 2000, rng.integers(0, 200))]
        if i % 4:
            w = items[int(rng.integers(0, 40))][1].split()
            for at in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 4))).tolist():
                w[at : at + 1] = [["other"], [], [*w[at : at + 1], "extra"]][int(rng.integers(0, 3))]
            words[len(words) // 2 : 0] = w
        docs.append((i, " ".join(words)))
    docs += [(900, "foo twin phrase bar"), (901, " ".join("CHANGED" if i % 3 == 2 else w for i, w in enumerate(f"x{k}" for k in range(60))))]
    items += [(42, " ".join(f"x{k}" for k in range(60)))]
    f = decontam.Finder(decontam.Items(items), 0.5)
    want = set()
    for d, t in docs:
        n = f.items.numbers(t)
        want |= {(d, i) for i, w in zip(f.items.ids, f.items.words) if decontam.align(w, n)[0] >= 0.5 and len(w) >= 3}
    want |= {(900, 40), (900, 41)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and {(900, 40), (900, 41), (901, 42)} <= got


def test_decontamination_of_words_put_in_left_out_and_replaced(spark):
    rng = np.random.default_rng(11)
    items = [(k, " ".join(f"w{k}x{x}" if k % 3 else f"w{x % 40}" for x in range(n))) for k, n in enumerate([7, 8, 9, 10, 12, 15, 20, 24, 31, 60] * 3)]
    docs, made = [(-1, None), (-2, "")], 0
    for k, t in items:
        w = t.split()
        for step in (2, 3, 4, 5):
            made += 1
            docs.append((made, "a b c " + " ".join(x + (" foreign" if i % step == step - 1 else "") for i, x in enumerate(w)) + " d e"))
            made += 1
            docs.append((made, " ".join(x for i, x in enumerate(w) if i % step != step - 1)))
            made += 1
            docs.append((made, " ".join("foreign" if i % step == step - 1 else x for i, x in enumerate(w))))
        for rate in (0.1, 0.2, 0.3, 0.4, 0.5):
            out = []
            for x in w:
                r, kind = rng.random(), rng.integers(0, 3)
                out += [x] if r >= rate else [[], ["other"], [x, "more"]][kind]
            made += 1
            docs.append((made, "x y " * int(rng.integers(0, 9)) + " ".join(out)))
    f = decontam.Finder(decontam.Items(items))
    want = {(d, k) for d, t in docs for k, w in zip(f.items.ids, f.items.words) if decontam.align(w, f.items.numbers(t))[0] >= 0.5}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 300
    odd = spark.createDataFrame([(None, items[9][1])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contamination(odd, spark.createDataFrame([(None, items[9][1])], "item_id long, text string")).collect()] == [(None, None)]


def test_fewest_seeds_is_a_lower_bound():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        m, least = int(rng.integers(3, 40)), float(rng.choice([0.5, 0.6, 0.8]))
        keep = np.sort(rng.choice(m, int(rng.integers(2, m + 1)), replace=False))
        gaps = [max(int(b - a) - 1, int(rng.integers(0, 4))) for a, b in zip(keep[:-1], keep[1:])]
        if 2 * len(keep) - sum(gaps) >= 2 * least * m:
            assert sum(a + b <= 2 for a, b in zip(gaps[:-1], gaps[1:])) >= decontam.fewest_seeds(m, least)


def brute_spans(t):
    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    rx = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for k, (n, p) in enumerate(rx):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if n == "email" or (n == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (n == "card" and 14 <= len(d) <= 19 and luhn(d)) or (n == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), n))
    return sorted(out)


def test_pii(spark, sf, docs, odd, empty):
    got = {r.doc_id: r.base_sha256 for r in queries.QUERIES["op6_pii_spans"](spark, sf).collect()}
    for d, t in docs.items():
        assert got[d] == hashlib.sha256(",".join(f"{n}:{a}:{z}" for a, _, z, n in brute_spans(t)).encode()).hexdigest()
    out = pii.sanitise(spark, odd)
    assert out.columns == odd.columns and out.count() == len(ODD) and pii.sanitise(spark, empty).count() == 0
    hidden = next(r.text for r in out.collect() if r.doc_id == 7 and "ber" in (r.text or ""))
    assert "<EMAIL>" in hidden and "<IP>" in hidden and "<PHONE>" in hidden and "4111" not in hidden
    rows = [(i, f"contact zanzibar{'' if i < 4 else i} agent{i} via spy@x.org or call {'filler ' * i}") for i in range(6)]
    rows += [(i, "plain words of no use") for i in range(6, 200)]
    terms = {r.spans for r in pii.analyse(spark, spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("array_join(transform(all_spans, s -> s.value), ' ') AS spans").collect()}
    assert any("zanzibar" in t for t in terms)


def brute_scores(words, train, order, least=1):
    """Interpolated absolute discounting over plain dictionaries."""
    import math
    from collections import Counter

    counts = [None, *(Counter(tuple(x[i : i + k]) for x in train for i in range(len(x) - k + 1)) for k in range(1, order + 1))]
    total, distinct = sum(counts[1].values()), len(counts[1])
    after = [None] + [{} for _ in range(order)]
    for k in range(2, order + 1):
        for g, n in counts[k].items():
            if k > 2 and (counts[k - 1][g[1:]] < least or counts[k - 1][g[:-1]] < least):
                continue  # a part of it is left out
            t = after[k].setdefault(g[:-1], [0, 0.0])
            t[0] += n
            if n >= least:
                t[1] += n - ngram_lm.DISCOUNT
    left = lambda k, c: 1 - after[k][c][1] / after[k][c][0]

    def prob(g):
        if len(g) == 1:
            return (counts[1][g] + 1) / (total + distinct + 1)
        return (counts[len(g)][g] - ngram_lm.DISCOUNT) / after[len(g)][g[:-1]][0] + left(len(g), g[:-1]) * prob(g[1:])

    out = []
    for x in words:
        logs = 0.0
        for i in range(len(x)):
            s = math.log10(prob((x[i],)))
            for k in range(2, min(order, i + 1) + 1):
                g = tuple(x[i - k + 1 : i + 1])
                if counts[k][g] >= least:
                    s = math.log10(prob(g))
                elif g[:-1] in after[k] and (k == 2 or counts[k - 1][g[:-1]] >= least):
                    s += math.log10(max(left(k, g[:-1]), 1e-9))
            logs += s
        out.append(logs)
    return out


def test_language_model(spark, sf, docs):
    import math
    from collections import Counter

    got = {r.doc_id: r for r in queries.QUERIES["op10_lm_scores"](spark, sf).collect()}
    w = {d: re.sub(rb"[A-Z]+", lambda m: m[0].lower(), t.encode()).split() + [b""] for d, t in docs.items()}
    train = [x for d, x in w.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(t for x in train for t in x)
    n, v = sum(c.values()), len(c)
    for (d, x), score in zip(w.items(), brute_scores(w.values(), train, 3), strict=True):
        assert got[d].base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in x))
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(x), sum(c[t] > 0 for t in x), n)
        assert got[d].score == pytest.approx(score, abs=3e-4 * len(x))  # quantised logarithms
    held = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize(("order", "least"), [(1, 1), (2, 1), (4, 1), (5, 1), (3, 2)])
def test_language_models_of_other_orders(spark, monkeypatch, order, least):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 400)
    rng = np.random.default_rng(order)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(0, 40)) % 30) for _ in range(120)] + ["w1 W2\tw3", None, "", "  ", "new words w1 w2 w3 w4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", __import__("pyspark").sql.functions.col("doc_id") >= 100)
    root, shape = ngram_lm.learn_words(spark, df.where("not held_out"), order=order, least_count=least)
    numbered = ngram_lm.number(df, root, shape, ["doc_id", "held_out"])
    shape = ngram_lm.learn_levels(spark, numbered.where("not held_out"), root, shape)
    got = {r.doc_id: r.score for r in ngram_lm.score(numbered, root, shape, ["doc_id"]).collect()}
    w = [(t or "").lower().encode().split() + [b""] for t in texts]
    want = brute_scores(w, w[:100], order, least)
    assert [got[i] for i in range(len(texts))] == [pytest.approx(s, abs=1e-3 * len(x)) for s, x in zip(want, w)]


def test_language_model_of_nothing(spark, odd, empty):
    for df, n in ((odd, len(ODD)), (empty, 0)):
        for learn in (df, empty):
            root, shape = ngram_lm.learn_words(spark, learn)
            numbered = ngram_lm.number(df, root, shape, ["doc_id"])
            shape = ngram_lm.learn_levels(spark, numbered.limit(0) if learn is empty else numbered, root, shape)
            assert ngram_lm.score(numbered, root, shape, ["doc_id"]).count() == n


def test_words_of_a_column():
    texts = ["A b\tb\n", None, "", " x", "é É\x0bz", "y", "\x1c q", "ab" * 9]
    rows = []
    for k in (1, 10**6):
        ngram_lm.BATCH_BYTES, old = k, ngram_lm.BATCH_BYTES
        for _, words, codes, ends in ngram_lm._words(__import__("pyarrow").array(["?", *texts]).slice(1)):
            w = [*words.to_pylist(), b""]
            rows += [[w[c] for c in x] for x in np.split(codes, ends[:-1])]
        ngram_lm.BATCH_BYTES = old
    assert rows == 2 * [re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split() + [b""] for t in texts]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for top, n in ((10, 5), (1 << 40, 3000), (100_000, 60_000)):
        v = np.unique(rng.integers(0, top, n))
        e = ngram_lm.EliasFano.build(v)
        assert (e.access(np.arange(len(v))) == v).all()
        t = rng.integers(0, top, 4000)
        place = {int(x): i for i, x in enumerate(v)}
        assert e.find(t.copy(), np.zeros(len(t), np.int64), np.full(len(t), len(v))).tolist() == [place.get(int(x), -1) for x in t]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.select("doc_id").distinct().count() < docs.count() and out.where("length > 2048").count() == 0
