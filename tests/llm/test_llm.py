import hashlib
import random
import re
import time
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumeworks.llm import lines, packing, pii, quality, simhash, tokens, topk, toxicity, urls, wordbpe
from plumeworks.llm.queries import BYTE_BPE, URL_RULES, WORD_BPE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
LONG = "ab" * 40_000 + " end"
ROWS = [(1, None), (2, ""), (3, "  \n\t "), (4, "Hello world, it's <|endoftext|> 12 fine.\n\nYes é日本"), (4, "Hello world, it's <|endoftext|> 12 fine.\n\nYes é日本"), (None, "a b c d e f"), (7, LONG), (8, "a  b c \x1cd ΣΑΣ İ é")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None, 1.0, "x") for i, t in ROWS], DOCS)


def empty(docs):
    return docs.limit(0)


def test_packing(spark, docs):
    hf = Tokenizer.from_file(BYTE_BPE)
    rows = packing.pack(docs, BYTE_BPE).orderBy("sequence_id").collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length & (r.length - 1) == 0 and r.length <= 1024 and 1 << r.bucket == r.length and r.offset == 0 for r in rows)
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
    want = [hf.encode(t or "", add_special_tokens=False).ids + [0] for _, t in ROWS]
    assert [x for i in ids for x in i] == [x for w in want for x in w]
    assert sum(r.start == 0 for r in rows) == len(ROWS) and packing.pack(empty(docs), BYTE_BPE).count() == 0
    assert packing.lengths(2053, 1024) == [1024, 1024, 4, 1]


def test_token_counts(spark, docs):
    hf = Tokenizer.from_file(BYTE_BPE)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, BYTE_BPE).collect())
    want = [(i or 0, len((t or "").encode()), n := len(hf.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in ROWS]
    assert got == sorted(want) and tokens.count_tokens(empty(docs), BYTE_BPE).count() == 0


def test_word_bpe(spark, docs):
    hf = Tokenizer.from_file(WORD_BPE)
    rnd = random.Random(1)
    odd = ["".join(rnd.choice("ab cd\n\t 'slrevm.,12é日🎉́ <|endoftext|>") for _ in range(rnd.randint(1, 50))) for _ in range(500)]
    tok = wordbpe.WordBPE(open(WORD_BPE, encoding="utf-8").read())
    for t in odd:
        ids = hf.encode(t, add_special_tokens=False).ids
        assert tok.encode(t) == ids and tok.decode(ids) == hf.decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in ROWS:
        ids = hf.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), sha(" ".join(map(str, ids))), sha(hf.decode(ids, skip_special_tokens=False))))
    assert sorted((r.doc_id or 0, *r[1:]) for r in wordbpe.digest_documents(docs, WORD_BPE).collect()) == sorted(want)


def brute_fingerprint(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, docs):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(300)) for _ in range(6)]
    texts = [b.replace(" a ", " zz ", k) for b in base for k in range(8)] + [t for _, t in ROWS] + base[:2]
    df = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id").collect()}
    fps = {100 - i: brute_fingerprint(t) for i, t in enumerate(texts)}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: (f"{f:016x}", find(i)) for i, f in fps.items()}
    kept = simhash.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in fps})
    assert simhash.near_duplicates(empty(docs)).count() == 0 and simhash.drop_near_duplicates(docs).columns == docs.columns


def test_reached_links_chains():
    chain = np.array([0, 0b1111, 0b11111111, 0xFFFF << 40], np.uint64)
    child, root = simhash.reached(np.sort(chain), 4)
    assert sorted(zip(child.tolist(), root.tolist())) == [(15, 0), (255, 0)]
    assert simhash.shared_bytes(np.array([0, 1, 0x0100_0000_0000_0080, (1 << 64) - 1], np.uint64)).tolist() == [8, 7, 6, 0]


def roots(n, edges):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        at[y] = x
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("most", [4096, 60, 8])
def test_simhash_split_lists_lose_no_link(spark, most):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 120, dtype=np.int64).astype(np.uint64).tolist()
    fps += [f ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for f in fps[:80] for d in (1, 4, 5)]
    fps += (rng.integers(0, 1 << 16, 150).astype(np.uint64) | np.uint64(0x1122334400000000)).tolist()  # half their bytes and more are shared
    fps = np.unique(np.array(fps, np.uint64))
    place = {int(f): k for k, f in enumerate(fps.view(np.int64))}
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    nodes = spark.createDataFrame([(f,) for f in place], "fp long")
    got = [(place[r.u], place[r.v]) for r in simhash.links(nodes, 4, most).collect()]
    assert roots(len(fps), got) == roots(len(fps), zip(i.tolist(), j.tolist()))


def test_simhash_list_of_200000_members():
    rng = np.random.default_rng(2)
    f = np.unique(rng.choice(1 << 32, 200_000, replace=False).astype(np.uint64)) | np.uint64(0x5566778800000000)
    near = {(min(a, b), max(a, b)) for a, b in ((int(x), int(y)) for x in f[:300] for y in f[np.bitwise_count(f ^ x) <= 4]) if a != b}
    edges = set()
    for a, b in simhash.long_list(f, [0, 1, 2, 3], 4):
        edges.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    assert near <= edges and all((a ^ b).bit_count() <= 4 for a, b in list(edges)[:1000])


def test_near_duplicates_keep_columns_that_look_like_our_own(spark):
    rows = [(1, "a b c d e f", "h", 5, 9), (1, "a b c d e f", "g", 6, 9), (2, "a b c d e f", "h", 7, 9), (None, None, "x", 8, 9), (None, "", "y", 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __hash string, __id int, __fp int")
    kept = simhash.drop_near_duplicates(df)
    got = sorted(kept.collect(), key=str)
    assert kept.columns == df.columns and len(got) == 2 and {r.doc_id for r in got} == {1, None}
    assert got == sorted(simhash.drop_near_duplicates(df.orderBy(F.desc("__id"))).collect(), key=str)


def test_urls(spark):
    given = [("http://www.Example.com/en/a?x", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "example.com/en/", "block"), ("http://example.com/english", "com/", "allow"), ("http://x.net/es/1", "net/es/", "block"), ("http://x.net/es", None, "allow"), (None, None, "allow"), ("no scheme", None, "allow"), ("http://com", None, "allow"), ("http://notexample.com/en/", "com/", "allow")]
    df = spark.createDataFrame([(i, u, "x") for i, (u, _, _) in enumerate(given)], "page_id long, url string, host string")
    assert [(r.rule, r.verdict) for r in urls.filter_urls(df, URL_RULES).orderBy("page_id").collect()] == [(r, v) for _, r, v in given]
    assert urls.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_quality(spark, docs):
    rows = {r.doc_id: r for r in quality.apply_policy(quality.ledger(docs), "v1").collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and rows[3].n_lines == 0
    assert quality.measure("a b c a b c x\nq\nq") == (9, 9, 0, 1, 6, 3)
    of = quality.ledger(docs)
    by = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(of, "v1").collect()}
    assert by["few_words"][0] == len(ROWS) and quality.ledger(empty(docs)).count() == 0


def test_top_k_against_all(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(60)] + [(900, None), (920, [float("nan")] * 8), (None, [1.0] * 8), (940, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, block=7, shard=64, group=128).collect())
    assert got == sorted(tuple(r) for r in topk.top_k(df).collect())
    assert got == sorted(tuple(r) for r in topk.top_k(df, block=7, shard=64, group=128, partitions=2).collect())
    v = {i: np.pad(np.floor(64 * np.array(e)), (0, 8 - len(e))) for i, e in rows if i is not None and e is not None and np.isfinite(e).all()}
    want = []
    for q in v:
        if q % 20 == 0:
            best = sorted(((-int(v[q] @ x), i) for i, x in v.items() if i != q))[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and topk.top_k(df.limit(0)).count() == 0


def test_lines(spark, monkeypatch):
    rows = [(i, "s", f"same line\nown {i}\n\n", i, "x") for i in range(20)] + [(50, "s", None, 0, "x"), (51, None, "same line", 0, "x"), (52, "t", "same line\nx", 0, "x"), (53, "s", "", 0, "x")]
    rows += [(60 + i, None, "a\nb", i, "x") for i in range(2)] + [(70 + i, "small", f"menu\n{i}", i, "x") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, lines_before int, __host string")
    for most in (lines.BROADCAST, 0):
        monkeypatch.setattr(lines, "BROADCAST", most)
        of = lines.drop_lines(df, counts=("before", "after"))
        got = {r.doc_id: (r.text, r.before, r.after, r.lines_before) for r in of.collect()}
        assert got[0] == ("own 0\n\n", 4, 3, 0) and got[50] == (None, 0, 0, 0) and got[51] == ("same line", 1, 1, 0) and got[52][2] == 2 and got[53] == ("", 1, 1, 0)
        assert got[70] == ("0", 2, 1, 0) and got[61] == ("a\nb", 2, 2, 1) and len(got) == len(rows)
        assert lines.drop_lines(df).columns == df.columns and sum(r.lines_before for r in lines.drop_lines(df).collect()) == sum(r[3] for r in rows)
    copies = spark.createDataFrame([(i, "s", "a\nb") for i in range(30)], "doc_id long, source string, text string")
    assert lines.drop_lines(copies, counts=("lines_before", "lines_after")).where("lines_after = 2").count() == 30 and lines.drop_lines(df.limit(0)).count() == 0


def brute_base(t):
    out = []
    for k, x in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(x, t):
            n = re.sub("[^0-9]", "", m.group())
            if not (k == 1 and any(int(p) > 255 for p in m.group().split(".")) or k == 2 and not (13 <= len(n) <= 19 and pii.luhn(n)) or k == 3 and not 9 <= len(n) <= 15):
                out.append((k, *m.span()))
    return sorted(out)


def test_pii(spark, docs):
    rnd = random.Random(3)
    for _ in range(5000):
        t = "".join(rnd.choice("a.@b-+1 2.3(4)5%5\n_") for _ in range(rnd.randint(0, 40)))
        assert sorted(pii.base(t)[0]) == brute_base(t)
    cards = [d + str(k) for d in ("453201511283036", "601111111111111", "222300004841001") for k in range(10) if pii.luhn(d + str(k))]
    texts = [f"call +1 (377) 555-0{rnd.randint(100, 999)} or mail a{i}@b.com , card {cards[i % 3]} at 10.0.0.{i % 250} and 12 of 2024" for i in range(300)]
    w = pii.learn(texts)
    (b, every), = pii.find([f"pay {cards[0]} {cards[1]} now"], w)
    assert b == [] and [s[0] for s in every] == [2, 2]
    assert pii.redact("mail a@b.com now", [(0, 5, 12)]) == "mail [EMAIL] now"
    rows = {r.doc_id: r for r in pii.find_in_documents(docs, w).collect()}
    assert rows[1].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.train(empty(docs)).node.shape == (pii.FEATURES, len(pii.LABELS)) and pii.redact_documents(docs, w).columns == docs.columns


def test_toxicity_held_out(spark, docs, monkeypatch):
    rnd = random.Random(9)
    plain = ["tha", "ion", "ere", "ing", "st", "an", "wh", "le"]
    word = lambda: "".join(rnd.choice(plain) for _ in range(rnd.randint(1, 3)))
    bad = ["vequa", "vequo", "lowix"]

    def text(label):
        w = [word() for _ in range(60)]
        if label:
            for _ in range(4):
                w[rnd.randrange(60)] = rnd.choice(bad) + rnd.choice(plain)
        return " ".join(w)

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(docs, model).collect())
    monkeypatch.setattr(toxicity, "MOST", 0)
    joined = toxicity.train(df, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    assert isinstance(joined, toxicity.Joined) and np.allclose(joined.curve.weights, model.weights, atol=1e-3)
    for of in (df, docs):
        a, b = ({(r.doc_id or 0): r.score for r in toxicity.score_documents(of, m).collect()} for m in (model, joined))
        assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-3 for i in a)
    for share in (0.01, 1.0):  # some words are joined as hot ones, then none
        monkeypatch.setattr(toxicity, "HOT", share)
        c = {(r.doc_id or 0): r.score for r in toxicity.score_documents(df, joined).collect()}
        assert c.keys() == {i for i, _, _ in rows} and all(abs(c[i] - got[i].score) < 1e-3 for i in c)
    assert toxicity.drop_toxic(docs, joined).columns == docs.columns and toxicity.drop_toxic(docs, joined).count() == toxicity.drop_toxic(docs, model).count()
    none = toxicity.train(empty(df), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.drop_toxic(docs, none).count() == len(ROWS)


def brute_ratios(counts, word):
    """log P(word | toxic) - log P(word | ordinary) by the definition, from {word: (toxic, ordinary)}."""
    size, d = toxicity.CONTEXT, toxicity.DISCOUNT
    grams = lambda w: [f"^{w}$"[max(0, i - size) : i + 1] for i in range(1, len(w) + 2)]
    n = [{}, {}]
    for w, by in counts.items():
        for g in grams(w):
            for c in (0, 1):
                if by[c]:
                    n[c][g] = n[c].get(g, 0) + by[c]
    every = {g for c in n for g in c}
    inner = {g[k:] for g in every for k in range(len(g))} - {g for g in every if len(g) > size} - {"^"}
    both = inner | every
    level = {g: sum(b[1:] == g and len(b) == len(g) + 1 for b in both) + (g[0] == "^") for g in inner}

    def shared(g):
        of = {x: c for x, c in level.items() if x[:-1] == g[:-1]}
        low = shared(g[1:]) if len(g) > 1 else 1 / len({x for x in level if len(x) == 1})
        return (max(level.get(g, 0) - d, 0) + d * len(of) * low) / sum(of.values()) if of else low

    def p(c, g):
        of = {x: k for x, k in n[c].items() if x[:-1] == g[:-1]}
        low = shared(g[1:] if len(g) > size else g)
        return (max(n[c].get(g, 0) - d, 0) + d * len(of) * low) / sum(of.values()) if of else low

    return sum(np.log(p(0, g) / p(1, g)) for g in grams(word))


def test_toxicity_ratios_against_definition(spark):
    counts = {"abracadabras": (3, 1), "abra": (0, 2), "cadabra": (4, 0), "bra": (1, 1), "zebra": (0, 5)}
    words = spark.createDataFrame([(w, *by, 0, 0) for w, by in counts.items()], "word string, n0 long, n1 long, n2 long, n3 long")
    half, none, every = toxicity.models(toxicity.ratios(toxicity.gram_counts(words)))
    for m in (half, every):
        assert np.allclose(m.words([*counts, "abrazeb", "bracad"]), [brute_ratios(counts, w) for w in [*counts, "abrazeb", "bracad"]], atol=1e-5)
    assert not none.words([*counts]).any()  # the other half has no rows


def test_toxicity_ratios_stay_out_of_the_drivers_memory(spark):
    table = spark.range(1_000_000).selectExpr("id % 3 = 0 AS context", "xxhash64(id) AS hash", "cast(id AS float) AS r0", "cast(-id AS float) AS r1", "cast(id / 7 AS float) AS r")
    got = table.toArrow()
    context, hashes, r = (got.column(c).to_numpy() for c in ("context", "hash", "r"))
    toxicity.models(table.limit(9), ("r",))  # what is imported at the first call does not count
    tracemalloc.start()
    try:
        model, = toxicity.models(table, ("r",))
        assert tracemalloc.get_traced_memory()[1] < 6_000_000  # of 12 million bytes; a batch of rows takes some
    finally:
        tracemalloc.stop()
    for c, (keys, values) in zip((False, True), (model.grams, model.contexts)):
        order = np.argsort(hashes[context == c].view(np.uint64))
        assert np.array_equal(keys.view(np.int64), hashes[context == c][order]) and np.array_equal(values, r[context == c][order])


def test_toxicity_halves_hold_what_the_curve_looks_up(spark):
    words = spark.createDataFrame([("abracadabra", 3, 1, 2, 2), ("zebra", 0, 5, 1, 0), ("quite", 1, 1, 0, 3), ("other", 2, 0, 0, 4)], "word string, n0 long, n1 long, n2 long, n3 long")
    table = toxicity.ratios(toxicity.gram_counts(words))
    rows = spark.createDataFrame([("Zebra, abrazeb\n12 " + "z" * 90,), (None,), ("zebra",)], "text string")
    some = toxicity.looked_up_by(table, rows)
    assert 0 < some.count() < table.count() / 2 and some.columns == table.columns
    for a, b in zip(toxicity.models(table), toxicity.models(some)):
        assert np.array_equal(*[m.features(["Zebra, abrazeb\n12 " + "z" * 90, "", "zebra"], {}) for m in (a, b)])


def test_toxicity_counts_long_words_in_parts(spark):
    long = "a" * 40 + "b" * 40 + "cd"
    df, labels = spark.createDataFrame([(1, f"x {long}")], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.word for r in toxicity.word_counts(df, labels).collect()} == {"", "x", "a" * 40, "b" * 40, "cd"}


def test_toxicity_counts_all_labelled_texts(spark, monkeypatch):
    rows = [(i, f"common words here w{'abcdefghij'[i % 10]}x" + (" vequalow" if i % 2 else " plainly")) for i in range(400)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    train = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 4 == 2]
    for most in (toxicity.BROADCAST, 0):
        monkeypatch.setattr(toxicity, "BROADCAST", most)
        by = {r.word: sum(r[1:]) for r in toxicity.word_counts(df, labels).collect()}
        assert by[""] == by["common"] == len(train) and by["vequalow"] == sum(i % 2 for i in train)
    few, many = (toxicity.train(df, labels, {1: n, 0: n}) for n in (4, 100))
    assert np.array_equal(few.grams[1], many.grams[1]) and toxicity.curve_rows(df, labels, {1: 4, 0: 4}).count() == 8


def test_pipeline_keeps_columns(spark, docs, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(3, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        now = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < 4:
            assert now.columns == docs.columns, name
    assert now.count() > 0


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(4)
    part = ["tha", "ion", "ere", "ing", "st", "an", "wh", "le", "ou", "mer"]
    word = lambda: "".join(rnd.choice(part) for _ in range(rnd.randint(1, 3)))
    docs = []
    for i in range(90):
        w = [word() for _ in range(rnd.randint(40, 90))]
        if i % 3 == 0:
            for _ in range(5):
                w[rnd.randrange(len(w))] = rnd.choice(["vequalow", "vequabix", "vequatro"])
        if i % 5 == 1:
            w[5:5] = ["mail", f"a{i}@b.com", "at", f"10.0.0.{i}", "call", f"+1 (377) 555-0{100 + i}"]
        lines_ = [" ".join(w[: len(w) // 2]), "read more of this site", " ".join(w[len(w) // 2 :])]
        docs.append((i, "\n".join(lines_), f"s{i % 2}"))
    docs += [(200 + i, t + " ", s) for i, t, s in docs[:30]] + [(300, None, "s0"), (301, "", "s1"), (302, docs[1][1], "s0")]
    labels = [(i, int(i % 3 == 0)) for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in P.run(spark, str(tmp_path)).collect())

    read = lambda n: spark.read.parquet(str(tmp_path / f"{n}.parquet"))
    model = toxicity.train(read("documents"), read("labels"))
    now = [d for d, s in zip(docs, model.scores([t or "" for _, t, _ in docs], {})) if s < toxicity.THRESHOLD]
    assert 0 < sum(i % 3 == 0 for i, *_ in now if i < 90) + 20 < 50 and sum(i % 3 != 0 for i, *_ in now if i < 90) > 50
    pages, on = {}, {}
    for t, s in {(t, s) for _, t, s in now if t is not None}:
        pages[s] = pages.get(s, 0) + 1
        for x in {x for x in t.split("\n") if x.strip(" \t\v\f\r")}:
            on[s, x] = on.get((s, x), 0) + 1
    bad = {k for k, n in on.items() if n >= lines.PAGES and n > lines.RATIO * pages[k[0]]}
    now = [(i, t if t is None else "\n".join([x for x in t.split("\n") if (s, x) not in bad])) for i, t, s in now]
    assert ("s0", "read more of this site") in bad
    f = [brute_fingerprint(t, 5) for _, t in now]
    near = roots(len(now), [(a, b) for a, b in combinations(range(len(now)), 2) if (f[a] ^ f[b]).bit_count() <= 4])
    least = {r: min(now[k][0] for k in range(len(now)) if near[k] == r) for r in near}
    kept = sorted(x for k, x in enumerate(now) if least[near[k]] == x[0])
    assert len(kept) < len(now)
    weights = pii.learn([t for _, t in kept if t and re.search("[0-9@]", t)])
    clean = [(i, pii.redact(t or "", spans)) for (i, t), (_, spans) in zip(kept, pii.find([t or "" for _, t in kept], weights))]
    assert any("[EMAIL]" in t and "[IP]" in t for _, t in clean)
    hf, want = Tokenizer.from_file(BYTE_BPE), []
    for i, t in clean:
        ids, at = np.array(hf.encode(t, add_special_tokens=False).ids + [0], "<u4"), 0
        for n in packing.lengths(len(ids), 1024):
            want.append((i, at, n, ids[at : at + n].tobytes()))
            at += n
    assert got == sorted(want)


def test_pii_long_text_in_linear_time():
    text = " ".join(f"user{i}@mail{i % 50}.org +1 377 555 {i % 9000 + 1000}" for i in range(30_000))
    w = pii.learn([f"mail a{i}@b.com or 10.0.0.{i}" for i in range(50)])
    began = time.time()
    (b, every), = pii.find([text], w)
    assert len(b) >= 30_000 and set(b) <= set(every) and time.time() - began < 60


def test_beliefs_against_enumeration():
    rng = np.random.default_rng(0)
    w = pii.Weights(rng.normal(size=(pii.FEATURES, 7)), rng.normal(size=(7, 7)), np.abs(rng.normal(size=7)))
    x = rng.normal(size=(4, pii.FEATURES))
    g = pii.Graph(np.zeros((4, 3), np.int64), x, np.array([[0, 1], [1, 2]]), np.array([[0, 3]]))  # a tree
    node, p = x @ w.node, np.zeros((4, 7))
    for y in np.ndindex(7, 7, 7, 7):
        z = np.exp(sum(node[k, y[k]] for k in range(4)) + w.chain[y[0], y[1]] + w.chain[y[1], y[2]] + (w.skip[y[0]] if y[0] == y[3] else 0))
        for k in range(4):
            p[k, y[k]] += z
    assert np.allclose(pii.beliefs(g, w, 60), p / p.sum(1, keepdims=True), atol=1e-6)


def test_public_path():
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE
    assert F is not None
