"""Source divergence, exact top-k search and whitening against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chronofleet.llm import source_audit, topk_search, whitening

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _audit(rows):
    """The whole audit in plain Python, from (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall(text.translate(UPPER))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, n in held[lang].items() if n >= 10)
        v = len(kept)
        sources = sorted({r[1] for r in rows if r[0] == lang})
        own = {s: [counts[lang, s][t] for t in kept] for s in sources}
        every = [sum(own[s][k] for s in sources) for k in range(v)]
        p = lambda n: [1 + 10**9 * (c + 2) // (sum(n) + 2 * v) for c in n]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(map(f, p(own[s]), p(own[t]))), t.encode(), t) for t in sources if t != s)
            out += [(lang, s, "pair", t, -value, k + 1) for k, (value, _, t) in enumerate(pairs)]
            terms = sorted((-f(a, b), t.encode(), t) for a, b, t, n in zip(p(own[s]), p(every), kept, own[s]) if n and a > b)
            out += [(lang, s, "term", t, -value, k + 1) for k, (value, _, t) in enumerate(terms[:10])]
    return sorted(out)


def _drawn(rng, n, sources, langs=("en", "de")):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)] + ["Über", "ÉTÉ", "naïve", "日本", "😀"]
    out = []
    for _ in range(n):
        lang, source = rng.choice(langs), f"s{int(rng.zipf(1.6)) % sources}"
        text = " ".join(rng.choice(words, int(rng.integers(0, 30)), p=np.arange(45, 0, -1) / (45 * 46 / 2)))
        out.append((str(lang), source, text.upper() if rng.random() < 0.1 else text))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    if small:  # several vocabulary shards and blocks of sources
        monkeypatch.setattr(source_audit, "SHARD_TERMS", 7)
        monkeypatch.setattr(source_audit, "BLOCK_SOURCES", 3)
    rows = _drawn(np.random.default_rng(5), 300, 9)
    rows += [("en", "empty", ""), ("en", None, None), (None, None, "12 -- 34"), ("fr", "one", "rare words only"), ("xx", "a", None), ("xx", "b", "")]
    rows += [("en", "copies", "same text again")] * 40 + [("en", "long", "waa " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(5)
    assert sorted(map(tuple, source_audit.audited(df).collect())) == _audit(rows)


def test_audit_of_an_empty_table(spark, documents, odd_rows):
    assert source_audit.audited(documents(odd_rows).filter("false")).count() == 0
    rows = [((r[2] if len(r) > 2 else "en"), (r[3] if len(r) > 3 else "s"), r[1]) for r in odd_rows]
    assert sorted(map(tuple, source_audit.audited(documents(odd_rows)).collect())) == _audit(rows)


def test_audit_slices_of_a_long_text(monkeypatch):
    text = ("aB,été " * 300 + "z" * 70 + " 日本語 x1y ") * 3
    whole = Counter(TERM.findall(text.translate(UPPER)))
    monkeypatch.setattr(source_audit, "SLICE_BYTES", 64)
    t = source_audit._long_counts(np.frombuffer(text.encode(), np.uint8))
    assert dict(zip(t["term"].to_pylist(), t["n"].to_pylist())) == dict(whole)
    assert set(t["docs"].to_pylist()) == {1}
    batch = pa.RecordBatch.from_pydict({"lang": ["a"], "source": ["s"], "text": [text]})
    assert sum(source_audit._counted(batch)["n"].to_pylist()) == sum(whole.values())


def test_audit_shares_of_large_counts():
    n, total = np.array([0, 1 << 40, 10**12]), 3 * 10**12 + 17
    assert source_audit.shares(n, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in n]


def _neighbours(rows, k=10, every=3):
    fine = list({(i, tuple(np.floor(1024 * np.array(v, float)))): None for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()})
    out = []
    for i, x in fine:
        if i % every == 0:
            s = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), j) for j, y in fine if j != i and len(x) == len(y))
            out += [(i, r + 1, j, -v) for r, (v, j) in enumerate(s[:k])]
    return sorted(out)


def _mixed(rng, n=700, dim=12):
    """Lengths over three decades, dense groups, copies, ties and odd rows."""
    out = []
    for i in range(n):
        base = rng.standard_normal(dim) * 10 ** rng.uniform(-1.5, 1.5)
        out.append((i, (np.round(base, 1) if i % 3 else base).astype(np.float32).tolist()))
    hot = (rng.standard_normal(dim) * 5).astype(np.float32)
    out += [(n + i, hot.tolist()) for i in range(n // 2)]
    out += [(2 * n + i, (hot + rng.standard_normal(dim) * 0.05).astype(np.float32).tolist()) for i in range(90)]
    return out


ODD = [(9001, None), (9003, [None] * 12), (9006, [float("nan")] * 12), (9009, [float("inf")] + [0.0] * 11), (9012, [0.0] * 12), (9015, [1.0, 2.0]), (9018, [3.0, 4.0]), (9021, []), (None, [1.0] * 12), (9024, [-1.0] * 12), (9024, [-1.0] * 12), (9027, [0.5] * 12), (9027, [0.25] * 12)]


@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, rows in (("BUCKET_ROWS", 40), ("QUERY_ROWS", 16), ("GROUP_ROWS", 100)):
            monkeypatch.setattr(topk_search, name, rows)
    rows = _mixed(np.random.default_rng(3)) + ODD
    df = spark.createDataFrame([(i, v, "x", 0, 0.0) for i, v in rows], "vec_id long, embedding array<float>, dim string, part int, score double").repartition(4)
    assert sorted(map(tuple, topk_search.top_k(df, "vec_id % 3 = 0").collect())) == _neighbours(rows)
    assert topk_search.top_k(df.filter("false"), "vec_id % 3 = 0").count() == 0


def test_top_k_with_few_candidates_and_large_components(spark):
    rows = [(0, [3e6, -1.0]), (3, [1e5, 2.0]), (6, [-1e5, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.top_k(df, "vec_id % 3 = 0").collect())) == _neighbours(rows)


def test_both_ways_of_pruning_are_taken_and_lose_nothing():
    rng = np.random.default_rng(8)
    v = np.floor(1024 * rng.standard_normal((3000, 16)) * 10 ** rng.uniform(-1, 1, (3000, 1)))
    bucket = topk_search.Bucket(np.arange(3000), v)
    q = np.concatenate([v[:40] + np.floor(rng.standard_normal((40, 16)) * 20), np.floor(1024 * rng.standard_normal((40, 16)))])
    for row in q:
        unit, c = row / np.linalg.norm(row), bucket.v / bucket.length[:, None]
        for cosine in (0.3, 0.8, 0.99):
            found, _ = bucket.by_coordinate(unit, cosine)
            assert set(np.flatnonzero(c @ unit >= cosine)) <= set(found)
    best = topk_search.Best(np.arange(10_000, 10_080), q, np.full(80, -np.inf), 10)
    taken = set()
    for a in range(0, 3000, 300):
        part = topk_search.Bucket(bucket.ids[a : a + 300], bucket.v[a : a + 300])
        looked = part.by_coordinate
        part.by_coordinate = lambda u, c, f=looked: taken.add("coordinate") or f(u, c)
        best.search(part)
        taken.add("plain" if part.switch == 2.0 else "tuned")
    assert {"coordinate", "tuned"} <= taken
    score = (q.astype(np.int64) @ bucket.v.astype(np.int64).T)
    for k in range(80):
        want = sorted(zip((-score[k]).tolist(), bucket.ids.tolist()))[:10]
        assert list(zip((-best.score[best.query == k]).tolist(), best.found[best.query == k].tolist())) == want


def _white(rows, k=16):
    """x, n, S and the eigenpairs of the fit list, by numpy."""
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 10**6 for i, v in rows}
    fit = np.array(sorted({tuple(r) for r in x.values()}))
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    w, u = np.linalg.eigh(c.T @ c / n)
    return x, n, s, w[::-1][:k], u[:, ::-1][:, :k], w.sum()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    scale = np.linspace(3, 1, 40)
    rows = [(i, (rng.standard_normal(40) * scale).astype(np.float32).tolist()) for i in range(900)]
    rows += [(900 + i, rows[7][1]) for i in range(400)]  # copies count once in the fit
    odd = [(5000, None), (5001, [None] * 40), (5002, [float("nan")] * 40), (5003, [float("-inf")] * 40), (5004, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, x string, n int").repartition(4)
    got = whitening.whitened(df).collect()
    x, n, s, w, u, trace = _white(rows)
    assert len(got) == 16 * len(rows)
    own = {(r["vec_id"], r["component"]): r for r in got}
    flip = np.ones(17)
    for c in range(1, 17):
        z = {i: (n * x[i] - s) / n @ u[:, c - 1] / np.sqrt(w[c - 1]) for i, _ in rows}
        flip[c] = np.sign(own[0, c]["whitened"] * z[0])
        assert max(abs(own[i, c]["whitened"] * flip[c] - z[i]) for i in z) < 1e-9
    for (i, c), r in own.items():
        assert (r["n"], r["deviation"]) == (n, int(((n * x[i] - s) ** 2).sum()))
        assert abs(r["explained"] - w[c - 1] / trace) < 1e-12
        assert r["identity_error"] == got[0]["identity_error"] < 1e-10


def test_whitening_of_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whitened(frame([])).count() == 0
    assert whitening.whitened(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # nothing varies
    got = whitening.whitened(frame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (None, [1.0, 1.0, 0.0]), (3, [4.0]), (4, [8.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"], round(abs(r["whitened"]), 9)) for r in got) == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0)]
    assert max(abs(r["explained"] - 1) for r in got) < 1e-12
    with pytest.raises(Exception, match="64-bit"):
        whitening.whitened(frame([(1, [1e300]), (2, [0.0])])).collect()


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[1 << 60, 5], [3, 7]], np.int64)
    n, sums = 1 << 40, np.array([(1 << 70) + 3, (6 << 40) + 1], object)
    assert whitening.deviations(x, n, sums).tolist() == [[int(a) * n - int(s) for a, s in zip(r, sums)] for r in x]


@pytest.mark.parametrize("dim", [1, 5, 30, 300])
def test_solver_finds_the_leading_pairs(dim):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    w = np.sort(rng.random(dim))[::-1] + 1
    w[: min(dim, 6)] = [5, 5, 4.9999, 4.9998, 3, 3][: min(dim, 6)]  # equal and close ones
    a = (q * w) @ q.T
    a = (a + a.T) / 2
    jobs = []
    k = min(16, dim)
    values, vectors = whitening.jacobi_davidson(lambda u: jobs.append(u.shape[1]) or a @ u, dim, k)
    assert np.abs(values - w[:k]).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert max(jobs) <= 40 and len(jobs) < dim + 40
