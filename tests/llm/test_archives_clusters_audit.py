import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from plumeworks.llm import audit, clusters, packing, quality, warc, wordbpe
from plumeworks.llm.queries import BYTE_BPE, WORD_BPE

PAGES = "page_id long, url string, html string, id string, digest string, payload int, first int"
LONG = "<p>é日\r\n\r\n" * 40_000
HTML = [(5, "http://a/x y\n", LONG), (2, None, None), (3, "", ""), (4, "u", "short"), (1, "u", "short"), (9, "v", "x" * 100), (7, "v", "x" * 100), (None, "v", "x" * 100), (7, "v", "x" * 100), (8, "w", "x" * 99), (6, "w", LONG), (11, "w", "null " * 30), (None, "w", "only " * 30), (None, "w", "only " * 30), (12, "x", "WARC/1.1\r\n" * 20)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x", "y", 0, 1) for r in HTML], PAGES).repartition(3)


def expected():
    out = []
    for i, _, html in HTML:
        body = (html or "").encode()
        same = [j for j, _, h in HTML if (h or "").encode() == body and j is not None]
        first = min(same) if len(body) >= 100 and same else i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def test_archives_give_back_every_page(pages, tmp_path):
    index = warc.write(pages, f"file://{tmp_path}/a", frame=1000, bundle=300, date="2026-01-01T00:00:00Z")
    rows = warc.read(index).collect()
    as_id = lambda x: None if x is None else int(x)
    assert sorted(((as_id(r.id), r.payload_bytes, r.payload_digest, r.record_type, as_id(r.refers_to_id)) for r in rows), key=str) == expected()
    bodies = {r.record_id: r.payload for r in rows if r.record_type == "response"}
    assert all(bodies[r.refers_to] and hashlib.sha256(bodies[r.refers_to]).hexdigest() == r.payload_digest for r in rows if r.record_type == "revisit")
    assert {r.url for r in rows} == {"http://a/x%20y%0A", None, "", "u", "v", "w", "x"}
    assert index.select("bundle").distinct().count() > 3
    assert {r.payload for r in warc.read(index, payloads=False).collect()} == {None}


def test_bundles_are_plain_zstandard_and_frames_stand_alone(pages, tmp_path):
    index = warc.write(pages, str(tmp_path / "a"), frame=1000, bundle=1 << 20)
    seen = 0
    for path in (tmp_path / "a/bundles").iterdir():
        with path.open("rb") as f:
            data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        of = list(warc.parse(data))
        assert of[0][0]["warc-type"] == "warcinfo" and all(x["warc-type"] in ("response", "revisit") for x, _ in of[1:])
        seen += len(of) - 1
        bundle = warc.Bundle(str(path))
        assert b"".join(bundle.frame(k) for k in range(len(bundle.frames))) == data and len(bundle.frames) > 1
        raw = path.read_bytes()
        start, packed, full, _ = bundle.frames[-1]
        assert zstandard.ZstdDecompressor().decompress(raw[start : start + packed], max_output_size=full) == bundle.frame(len(bundle.frames) - 1)
        bad = path.with_suffix(".bad")
        bad.write_bytes(raw[: start + packed - 1] + bytes([raw[start + packed - 1] ^ 1]) + raw[start + packed :])
        with pytest.raises((ValueError, zstandard.ZstdError)):
            warc.Bundle(str(bad)).frame(len(bundle.frames) - 1)
        with pytest.raises(ValueError):
            bad.write_bytes(raw[:-1])
            warc.Bundle(str(bad))
    assert seen == len(HTML) == index.count()


def test_records_are_found_by_id(spark, pages, tmp_path):
    index = warc.write(pages, str(tmp_path / "a"), frame=1000)
    name = warc.record_id("5", hashlib.sha256(LONG.encode()).hexdigest())
    ids = spark.createDataFrame([(name, 1), (name, 2), ("none", 3), (None, 4)], "record_id string, wanted int")
    (row,) = warc.read(warc.find(index, ids)).collect()
    assert row.id == "5" and row.payload == LONG.encode()
    assert warc.read(warc.find(index, ids.limit(0))).count() == 0
    assert warc.read(warc.write(pages.limit(0), str(tmp_path / "none"))).count() == 0


VECTORS = "vec_id long, embedding array<float>, id int, vec int, at int"


def lloyd(rows, k, rounds, dim, scale):
    """Plain Lloyd rounds over Python's whole numbers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w))
    for n in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
        if n < rounds:
            for j in range(len(c)):
                own = [v for (_, v), a in zip(kept, at) if a == j]
                c[j] = [sum(x) // len(own) for x in zip(*own)] if own else c[j]
    d = [far(v, c[a]) for (_, v), a in zip(kept, at)]
    of = [sum(x for x, a in zip(d, at) if a == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i, a, x, of[a], sum(d), sha[a]) for (i, _), a, x in zip(kept, at, d)), key=str)


@pytest.mark.parametrize(("k", "rounds", "spread"), [(16, 3, 1.0), (16, 6, 0.05), (40, 5, 1.0), (5, 3, 0.0), (1, 2, 1.0), (2, 3, 1.0), (100, 3, 1.0)])
def test_clusters_are_those_of_plain_rounds(spark, tmp_path, k, rounds, spread):
    rnd = random.Random(k * rounds)
    centres = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(9)]
    rows = [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(centres)]) for i in range(90)]
    rows += [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0]), (93, [1.0, float("nan"), 2.0, 3.0]), (94, [float("-inf")] * 4), (95, [1.0] * 5), (None, [0.0] * 4), (7, rows[7][1]), (7, rows[8][1])]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(3)
    got = clusters.cluster(df, k=k, rounds=rounds, dim=4, folder=str(tmp_path / "c"))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == lloyd(rows, k, rounds, 4, 64)
    assert clusters.cluster(df.limit(0), dim=4).count() == 0 and clusters.cluster(df.limit(0), dim=4).columns == got.columns


def test_bounds_spare_distances_and_stay_below(spark, tmp_path):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 3, (16, 8))
    rows = [(i, (centres[i % 16] + rnd.normal(0, 0.1, 8)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clusters.cluster(df, rounds=4, dim=8, folder=str(tmp_path / "c")).collect()
    measured = [spark.read.parquet(str(tmp_path / f"c/{n}")).agg(F.avg("measured")).first()[0] for n in range(5)]
    assert measured[0] == 16 and measured[3] < 2 and measured[4] < 3
    # large whole numbers, where floating point is not exact
    x, c = np.array([[(1 << 26) - 1, 3]]), np.array([[-(1 << 26), 1], [(1 << 26) - 1, 3]])
    assert clusters.all_squares(x, c).tolist() == [[((1 << 27) - 1) ** 2 + 4, 0]]
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"), dim=4).collect()


def random_state(rnd, n, k, b):
    x = rnd.integers(-6, 7, (n, 3))
    c = rnd.integers(-6, 7, (k, 3))
    return x, c, clusters.scan(x, c, b)


@pytest.mark.parametrize("seed", range(20))
def test_a_step_keeps_nearest_and_bounds(seed):
    rnd = np.random.default_rng(seed)
    k = int(rnd.integers(1, 12))
    b = int(rnd.integers(1, max(2, k)))
    x, c, s = random_state(rnd, 200, k, b)
    for _ in range(5):
        new = c + rnd.integers(-1, 2, c.shape) * (rnd.random((k, 1)) < 0.4)
        drift = np.sqrt(((new - c) ** 2).sum(1)) * (1 + clusters.SAFE)
        c, b = new, max(1, b - int(rnd.integers(0, 2)))
        s = clusters.step(x, s, c, drift, b, bool(rnd.integers(0, 2)))
        d2 = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (s["at"] == d2.argmin(1)).all()
        root, r = np.sqrt(d2), np.arange(len(x))
        assert (s["upper"] >= root[r, s["at"]]).all() and (s["bounds"] <= np.take_along_axis(root, s["order"], 1) + 1e-15).all()
        others = root.copy()
        others[r, s["at"]] = np.inf
        np.put_along_axis(others, s["order"], np.inf, 1)
        assert (s["rest"] <= others.min(1) + 1e-15).all()


DOCS = "doc_id long, text string, source string, part int, mask int, fingerprint int, good int"


def documents():
    rnd = random.Random(4)
    words = lambda n, of: " ".join(rnd.choice(of) for _ in range(n))
    many, few = [f"w{i}" for i in range(400)], ["a", "b"]
    texts = [words(250, many), words(250, few), words(250, many).upper(), words(250, many) + " $", words(10, many), "", None, "\x1c \t\v", "A" * 5, "é" * 300, words(199, many), words(200, many)]
    rows = [(i, rnd.choice(texts), rnd.choice(["x", "y", "", None])) for i in range(300)] + [(None, texts[0], "x"), (None, texts[0], "x"), (3, texts[0], "z"), (3, texts[0], "z"), (3, texts[1], "z")]
    labels = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(0, 300, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1)]
    return rows, labels


def fails(rows):
    out = []
    for i, text, source in rows:
        t = text or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        mask = (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * sum("A" <= x <= "Z" for x in t) > 2 * len(t)) + 8 * any(x in "#$%&*|" for x in t)
        mask += 16 * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))
        out.append((i, source or "", mask))
    return out


@pytest.mark.parametrize("most", [1, 3000, 1 << 20])
def test_masks_of_all_rows(spark, most):
    rows, _ = documents()
    df = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], DOCS).repartition(5)
    got = audit.failed(df, most=most).collect()
    assert sorted(map(tuple, got), key=str) == sorted(fails(rows), key=str)
    assert audit.failed(df.limit(0)).count() == 0


def test_texts_of_one_fingerprint_are_told_apart():
    rows = [(5, "p", 0, 1, "a"), (4, "p", 0, 1, "b"), (3, "p", 0, 1, "b"), (9, "p", 0, 1, "a"), (2, "p", 0, 2, "b")]
    out = sorted(audit._routed(iter(sorted(audit._own_minima(iter(rows), 100)))))
    assert out == [(2, "p", 0), (3, "p", 0), (4, "p", 16), (5, "p", 0), (9, "p", 16)]


def test_report_of_all_orders(spark):
    rows, labels = documents()
    df = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], DOCS)
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flags = {i: (any(q == 1 for j, q, _ in labels if j == i), any(t == 1 for j, _, t in labels if j == i)) for i, *_ in rows if i is not None}
    want = []
    for part in {p for _, p, _ in fails(rows)}:
        own = [(m, *flags.get(i, (False, False))) for i, p, m in fails(rows) if p == part]
        steps, total = [], {}
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                gone, left = [x for x in left if x[0] & bit], [x for x in left if not x[0] & bit]
                total[f] = total.get(f, 0) + len(gone)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), sum(x[0] & bit > 0 for x in own) - len(gone), sum(x[0] == bit for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        want += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    assert sorted(map(tuple, audit.audit(df, of).collect())) == sorted(want)
    assert audit.audit(df.limit(0), of).count() == 0 and audit.audit(df, of.limit(0)).where("good_lost > 0").count() == 0


TEXTS = [(1, None), (2, ""), (3, "a few words, repeated a few words, repeated a few words"), (3, "a few words, repeated a few words, repeated a few words"), (None, "x " * 5000)]


def test_ids_pieces_by_length_and_ablations(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 1) for r in TEXTS], "doc_id long, text string, ids int")
    tok = wordbpe.WordBPE(open(WORD_BPE, encoding="utf-8").read())
    got = sorted(((r.doc_id, r.ids) for r in wordbpe.encode_documents(docs, WORD_BPE).collect()), key=str)
    assert got == sorted(((i, tok.encode(t or "")) for i, t in TEXTS), key=str) and wordbpe.encode_documents(docs.limit(0), WORD_BPE).count() == 0
    pieces = packing.pack(docs, BYTE_BPE)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("length <> shiftleft(1, bucket)").count() == 0 and back.count() == pieces.count()
    packing.write_buckets(pieces.limit(0), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("bucket=*"))
    ledger = quality.ledger(docs)
    rows, names = quality.apply_policy(ledger, "v1").collect(), quality.POLICIES["v1"]
    bits = {r: 1 << k for k, r in enumerate(quality.RULES)}
    policy = sum(bits[r] for r in names)
    found = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(ledger, "v1").collect()}
    assert found == {n: (sum(r.failed_bits & bits[n] > 0 for r in rows), sum(r.failed_bits & policy == bits[n] for r in rows)) for n in names}
    assert {(r.n_failed, r.n_only) for r in quality.ablations(ledger.limit(0), "v1").collect()} == {(0, 0)}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        quality.ledger(spark.createDataFrame([("no number", "x")], "doc_id string, text string")).collect()
