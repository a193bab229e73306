"""The operators on documents against brute force, on made-up rows and the smallest tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from chronofleet.llm import batches, bpe, common, exact_dedup, graph, mixing, ngram_join, quality, suffix_dedup, surrogates, toxicity

DATA = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]+"


def _table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def _words(text):
    return [w for w in re.split(SPACE, text or "") if w]


class Sets:
    """Union-find by smallest member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _shingles(text):
    w = _words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _near(rows):
    sets = [(i, _shingles(t)) for i, t in rows if i is not None]
    uf = Sets()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                uf.join(i, j)
    return sorted([(i, len(s), uf.find(i)) for i, s in sets] + [(-1, len(_shingles(t)), -1) for i, t in rows if i is None])


def _near_copies():
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([6, 30, 80, 200]))]
        for _ in range(rng.randrange(1, 9)):
            own = [w if rng.random() > 0.03 else f"v{rng.randrange(999)}" for w in base]
            rows.append((n := n + 1, " ".join(own)))
    return rows


def test_ngram_join(spark, documents, odd_rows):
    rows = [r[:2] for r in odd_rows] + [(i + 100, t) for i, t in _near_copies()]
    got = ngram_join.ngram_components(documents(odd_rows + [(i + 100, t) for i, t in _near_copies()])).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == _near(rows)


def test_ngram_join_on_table_and_empty(spark, documents):
    docs = _table(spark, "documents")
    want = _near([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, ngram_join.query(spark, DATA).collect())) == want
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0


def test_count_tree_loses_no_link():
    rng = np.random.default_rng(1)
    base = rng.poisson(3, (40, ngram_join.GROUPS))
    point = np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0) for _ in range(6)]).astype(np.int32)
    comp = np.arange(len(point))
    got = {tuple(sorted((int(q), int(m)))) for hit, m in ngram_join.CountTree(point).search(np.arange(len(point)), comp) for q in hit}
    size = point.sum(axis=1)
    for i in range(len(point)):
        for j in range(i + 1, len(point)):
            if 180 * np.minimum(point[i], point[j]).sum() >= 80 * (size[i] + size[j]):
                assert (i, j) in got


def test_a_hot_family_gives_joining_links_only():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 62, 300, dtype=np.uint64))
    sets = [np.sort(np.concatenate([base[rng.random(len(base)) > 0.02 * (k % 8)], rng.integers(0, 1 << 62, 3 * (k % 8), dtype=np.uint64)])) for k in range(400)]
    rows = np.repeat(np.arange(400), [len(x) for x in sets])
    point = ngram_join.points(np.concatenate(sets), rows, 400)
    family = ngram_join.Family(np.arange(1000, 1400), np.arange(400), np.zeros(400, int), point, sets)
    family.search(np.arange(400))
    assert len(family.links) == 400 - len(np.unique(family.comp)) < 400
    alike = [[180 * len(np.intersect1d(x, y)) >= 80 * (len(x) + len(y)) for y in sets[:60]] for x in sets[:60]]
    assert all(family.comp[i] == family.comp[j] for i in range(60) for j in range(60) if alike[i][j])


def test_large_bucket_is_split(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_ROWS", 3)
    rows = _near_copies()
    assert sorted(map(tuple, ngram_join.ngram_components(documents(rows)).collect())) == _near(rows)


def _exact(rows):
    norm = lambda t: re.sub(SPACE, "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: x[:3])[3]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(map(str, out))


def test_exact_dedup(documents, odd_rows, monkeypatch):
    rows = [r[:2] for r in odd_rows]
    docs = documents(odd_rows).repartition(23)
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_duplicates(docs).collect()) == _exact(rows)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    monkeypatch.setattr(exact_dedup, "ROUNDS_AT_ONCE", 1)
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_duplicates(docs).collect()) == _exact(rows)


def test_merge_compares_whole_digests():
    e = np.zeros(4, exact_dedup._ENTRY)
    e["d"] = [[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 4], [1, 2, 3, 4]]
    e["id"], e["short"], e["rows"] = [9, 8, 7, 6], [-1, -1, -5, -1], 1
    out = exact_dedup._merged(e)
    assert [(int(d[3]), int(i), int(n)) for d, i, n in zip(out["d"], out["id"], out["rows"])] == [(4, 7, 3), (5, 8, 1)]


def test_stage_keeps_one_row_of_each_text(documents, odd_rows):
    kept = exact_dedup.deduplicated(documents(odd_rows))
    assert len({re.sub(SPACE, "", r.text or "") for r in kept.collect()}) == len({re.sub(SPACE, "", r[1] or "") for r in odd_rows})


@pytest.fixture(scope="module")
def tiktoken_own():
    import base64

    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}), public.PATTERN


def test_bpe_digests(spark, documents, odd_rows, tiktoken_own):
    _, tok, _ = tiktoken_own
    docs = documents(odd_rows)
    want = []
    for i, t in (r[:2] for r in odd_rows):
        ids = tok.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    tokenizer = bpe.default_tokenizer(spark)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in tokenizer.digests(docs).collect())
    decoded = tokenizer.decode(tokenizer.encode(docs)).collect()
    assert sorted((str(i), (t or "").encode()) for i, t in (r[:2] for r in odd_rows)) == sorted((str(r.doc_id), bytes(r.data)) for r in decoded)
    assert tokenizer.digests(docs.limit(0)).count() == 0


def test_bpe_table_appends_and_edits(tiktoken_own):
    ranks, tok, pattern = tiktoken_own
    e = bpe.Encoder(ranks, bpe.split_table(ranks), pattern)
    rng = random.Random(4)
    for _ in range(200):
        data = bytes(rng.choice(b"abetion er\n0\xc3\xa9") for _ in range(rng.randrange(300)))
        last = e.extend([], data)
        more = bytes(rng.choice(b"thing ") for _ in range(9))
        assert e.extend(list(last), data + more) == e.extend([], data + more)
        a = rng.randrange(len(data) + 1)
        b = min(len(data), a + rng.randrange(6))
        table, edited = e.edit(last, data, a, b, more[: rng.randrange(9)])
        assert table == e.extend([], edited)
        assert b"".join(e.tokens[i] for i in e.ids(table)) == edited
    for _ in range(3000):
        text = "".join(rng.choice("abetion THE'sé😀0 \n\t.") for _ in range(rng.randrange(30)))
        assert [int(i) for i in e.text(text).split(b",") if i] == tok.encode_ordinary(text)


def _goal(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        out = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[o] for o in open_) for s in names}
        over = {s for s in open_ if out[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return out
        full |= over


def test_mixing(spark, documents, odd_rows):
    rng = random.Random(7)
    rows = odd_rows + [(100 + k, "w " * rng.randrange(1, 400), "en", rng.choice(["a", "b", "é", None, "c", "c", "c"])) for k in range(400)]
    docs = documents(rows)
    got = mixing.mixed(docs).toPandas()
    sizes = defaultdict(int)
    for r in rows:
        src = r[3] if len(r) == 4 else "s"
        sizes[src] += len(_words(r[1]))
    want = _goal(dict(sizes))
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    for src in sizes:
        part = got[got["source"].isna()] if src is None else got[got["source"] == src]
        assert set(part["source_size"]) == {sizes[src]}, src
        assert part["target"].iloc[0] == pytest.approx(want[src])
        assert abs(part["taken"].sum() - want[src]) <= max(0.02 * want[src], 400)
    again = mixing.mixed(docs.repartition(5)).toPandas()
    key = ["source", "size", "taken"]
    assert sorted(map(str, got[key].itertuples(index=False))) == sorted(map(str, again[key].itertuples(index=False)))
    assert mixing.mixed(docs.limit(0)).count() == 0
    once = got.drop_duplicates("doc_id", keep=False)  # rows that repeat an id get as many as the most of them
    assert mixing.repeated(docs).join(spark.createDataFrame(once[["doc_id"]]), "doc_id").count() == once["copies"].sum()


def test_mixing_ranks_hot_sizes_in_bins(documents, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 10)
    rows = [(k, "w " * 7, "en", "ab"[k % 2]) for k in range(500)]
    got = mixing.mixed(documents(rows)).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 7


def _repeats(rows):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, int)
        for x in range(len(b) - 99):
            w = b[x : x + 100]
            if w in seen:
                m[x] += 1
                m[x + 100] -= 1
            else:
                seen.add(w)
        cover = np.cumsum(m)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((i, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def test_suffix_dedup(documents, odd_rows):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(150):
        t = ""
        for _ in range(rng.randrange(4)):
            x = rng.randrange(350)
            t += rng.choice(base)[x : x + rng.randrange(20, 300)] + "é" * rng.choice([0, 0, 150]) + "ab" * rng.choice([0, 0, 120])
        rows.append((i * 3 if i % 5 else -i - 20, t or None))
    got = suffix_dedup.repeated_passages(documents(rows), digest=True).collect()
    assert sorted(str(tuple(r)) for r in got) == _repeats(sorted(rows))
    odd = suffix_dedup.repeated_passages(documents(odd_rows)).collect()
    assert len(odd) == len(odd_rows)
    for r in odd:
        assert len(r.kept) == r.n_bytes - sum(e - s for s, e in zip(r.starts, r.ends))
    assert suffix_dedup.repeated_passages(documents(rows).limit(0), digest=True).count() == 0


def test_suffix_dedup_spreads_its_buckets():
    buf = np.random.default_rng(9).integers(97, 123, 200_000).astype(np.uint8)
    keys = np.unique(suffix_dedup.anchors(buf, np.array([0, len(buf)]))["bucket"] >> np.uint64(64 - batches.KEY_BITS))
    sizes = np.diff(batches.cuts(keys, 16))
    assert len(keys) > 4_000 and sizes.max() < 1.3 * len(keys) / 16


def test_suffix_dedup_on_table(spark):
    docs = _table(spark, "documents")
    assert sorted(str(tuple(r)) for r in suffix_dedup.query(spark, DATA).collect()) == _repeats(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_keys_survive_the_way():
    rng = np.random.default_rng(1)
    for n, top in ((0, 48), (1, 48), (50, 48), (5000, 48), (100000, 48), (300, 20)):
        keys = np.sort(rng.integers(0, 1 << top, n, dtype=np.uint64))
        assert (batches.decoded(batches.encoded(keys), n) == keys).all()


def test_packing_keeps_every_row(spark, documents, odd_rows, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 1000)
    got = [(int(i), bytes(b[o[k] : o[k + 1]])) for r in batches.packed(documents(odd_rows)).collect() for i_, b, o in [batches.unpacked(r)] for k, i in enumerate(i_)]
    assert sorted(got) == sorted((r[0], (r[1] or "").encode()) for r in odd_rows if r[0] is not None)


def test_scores_equal_sums_over_whole_texts(documents, odd_rows, monkeypatch):
    """Every row's score against the plain sum of its coordinates' weights; long, empty, null and repeated rows."""
    rng = np.random.default_rng(6)
    at = np.sort(rng.choice(toxicity.BIAS, 200_000, replace=False))
    model = at, rng.standard_normal(len(at)).astype(np.float32) / 50, -0.3
    full = np.zeros(toxicity.BIAS)
    full[at] = model[1]

    def plain(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        counts = Counter(toxicity.coordinates(data, np.array([0, len(data)]))[1].tolist())
        total = sum(full[toxicity._leveled(np.array([c]), level)[0]] for c, n in counts.items() for level in toxicity.LEVELS if n >= level)
        return 1 / (1 + np.exp(-np.clip(total + model[2], -35, 35)))

    docs = documents(odd_rows)
    got = toxicity.scored(docs, model, keep=docs.columns, score="_p").select("doc_id", "text", "_p").collect()
    assert len(got) == len(odd_rows) and sorted(map(str, [r[:2] for r in got])) == sorted(map(str, [tuple(r[:2]) for r in odd_rows]))
    assert all(abs(r["_p"] - plain(r["text"])) < 1e-6 for r in got)
    again = toxicity.scored(docs, model).collect()
    assert sorted(round(r["score"], 12) for r in again) == sorted(round(r["_p"], 12) for r in got)


def test_toxicity_learns_words_and_ignores_labels_it_must_not_see(spark, documents):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["bad", "awful"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = documents(rows + [(None, "bad w1"), (1000, None), (1001, "")])
    table = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, table).toPandas()
    assert len(got) == 603 and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    import zlib

    mine = got.dropna(subset="doc_id")
    assert all(h == (zlib.crc32(str(int(i)).encode()) % 3 == 1) for i, h in zip(mine["doc_id"], mine["held_out"]))
    held = mine[mine["held_out"] & (mine["doc_id"] < 600)]
    assert ((held["doc_id"] % 4 == 0) == (held["predicted"] == 1)).mean() > 0.97
    flipped = table.withColumn("toxic", (1 - table["toxic"]).cast("int"))
    mixed = table.join(held_ids(spark, held), "doc_id", "left_anti").union(flipped.join(held_ids(spark, held), "doc_id", "left_semi"))
    assert np.allclose(sorted(toxicity.toxicity(docs, mixed).toPandas()["score"]), sorted(got["score"]))
    none = toxicity.toxicity(docs, table.limit(0)).toPandas()
    assert (none["score"] == 0.5).all()
    assert toxicity.toxicity(docs.limit(0), table).count() == 0


def held_ids(spark, held):
    return spark.createDataFrame([(int(i),) for i in held["doc_id"]], "doc_id long")


def _kneser_ney(texts):
    """Interpolated modified Kneser-Ney by dictionaries: a function (context, byte) to probability."""
    n = quality.ORDER
    counts = {n: defaultdict(int)}
    for t in texts:
        b = bytes(n - 1) + t.encode()
        for k in range(n - 1, len(b)):
            counts[n][b[k - n + 1 : k + 1]] += 1
    for k in range(n - 1, 0, -1):
        counts[k] = defaultdict(int)
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    disc = {}
    for k, c in counts.items():
        many = [sum(v == x for v in c.values()) for x in range(5)]
        if not many[1] or not many[2] or not many[3]:
            disc[k] = (0.5, 1.0, 1.5)
            continue
        y = many[1] / (many[1] + 2 * many[2])
        disc[k] = tuple(min(max(x - (x + 1) * y * many[x + 1] / many[x], 0.05), x) for x in (1, 2, 3))
    of = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            of[k][g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        own = of[k].get(g[:-1])
        if not own:
            return p(g[1:])
        d = disc[k]
        less = lambda v: d[min(v, 3) - 1]
        c = counts[k].get(g, 0)
        return ((c - less(c)) / sum(own) if c else 0) + sum(map(less, own)) / sum(own) * p(g[1:])

    return p


def test_quality_model_equals_brute_force(spark, documents, odd_rows):
    rng = random.Random(1)
    good = [(100 + k, "".join(rng.choice(["the ", "cat ", "sat ", "on ", "mats. "]) for _ in range(rng.randrange(3, 40)))) for k in range(80)]
    docs = documents(good + odd_rows + [(500, "#### %%% ZZZ" * 20)])
    trusted = spark.createDataFrame([(i,) for i, _ in good] + [(None,)], "doc_id long")
    each = quality.scores(docs, trusted).toPandas()
    held = set(each[each["held"]]["doc_id"])
    assert 0 < len(held) < 40
    p = _kneser_ney([t for i, t in good if i not in held])
    text = defaultdict(list)
    for r in good + odd_rows:
        text[r[0]].append(r[1] or "")
    for i, bits in zip(each["doc_id"], each["total_bits"]):
        if i in text and i != 6 and i != 7 and i != 9:
            b = bytes(quality.ORDER - 1) + text[i][0].encode()
            want = -sum(math.log2(p(b[k - quality.ORDER + 1 : k + 1])) for k in range(quality.ORDER - 1, len(b)))
            assert bits == pytest.approx(want, abs=0.001 * len(b) + 0.01)
    out = quality.classified(docs, trusted).toPandas()
    kept = dict(zip(out["doc_id"], out["kept"]))
    assert len(out) == len(good) + len(odd_rows) + 1 and not kept[500] and kept[1] and kept[2]
    assert sum(kept[i] for i, _ in good) >= 78
    assert quality.classified(docs, trusted.limit(0)).filter("NOT kept").count() == 0
    assert quality.classified(docs.limit(0), trusted).count() == 0


def test_surrogates(spark, documents, odd_rows):
    rows = [
        (1, "call +1 (017) 555-7713 or und.34@mail7.example.com, UND.34@MAIL7.EXAMPLE.COM: 4845168114407329 9807915762804490"),
        (2, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" at 97.51.17.173. And 4845-1681-1440-7329; 123-45-6789 DE89 3704 0044 0532 0130 00 v. 1.2.3.4.5'),
        (3, "Mr. John Smith met Frau Anna Weber. госпожа Анна Иванова +10175557713"), (4, "Mr. John Smith!"), (4, "Mr. John Smith!"),
    ]
    docs = documents(rows + odd_rows)
    got = surrogates.anonymized(docs, "key").collect()
    assert len(got) == len(rows) + len(odd_rows)
    by = {r.doc_id: r for r in got if r.doc_id in (1, 2, 3) and r.n_entities}
    for secret in ("7713", "und.34", "UND.34", "mail7", "4845168114407329", "04dbebab", "97.51.17.173", "123-45", "3704 0044", "Smith", "Weber", "Иванова"):
        assert not any(secret in (r.text or "") for r in by.values())
    one, two, three = (by[i].text for i in (1, 2, 3))
    phone = re.search(r"\+1 (\(\d{3}\) \d{3}-\d{4})", one)[1]
    assert re.sub(r"\D", "", phone) in three
    mail = re.search(r"or (\S+@\S+),", one)[1]
    assert mail.upper() in one and mail == mail.lower()
    card = re.search(r"(\d{16}) 9807915762804490", one)[1]
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10
    assert luhn(card) == 0 and card[0] == "4" and "-".join(card[k : k + 4] for k in (0, 4, 8, 12)) in two
    iban = re.search(r"DE[\d ]+", two)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:].strip() + iban[:4])) % 97 == 1
    assert "v. 1.2.3.4.5" in two
    name = re.search(r"Mr\. (\S+ \S+) met Frau (\S+)", three)
    assert [r.text for r in got if r.doc_id == 4 and r.n_entities] == [f"Mr. {name[1]}!"] * 2
    assert name[1].split()[0].endswith("n") and name[2].endswith("a")
    plain = sorted(str((r.doc_id, r.text)) for r in got if not r.n_entities)
    assert plain == sorted(str(r[:2]) for r in odd_rows)
    assert surrogates.anonymized(docs.limit(0), "key").count() == 0


def test_surrogates_draw_again_on_collisions(spark, monkeypatch):
    from pyspark.sql import functions as F

    def few(key, kind, canon, attempt):
        return F.concat(F.lit("10.0.0."), F.pmod(F.xxhash64(F.lit(key), canon, attempt), F.lit(60)).cast("string"))

    monkeypatch.setattr(surrogates, "surrogate", few)
    real = [("ip", f"10.0.0.{k}") for k in range(20)]
    made = surrogates.drawn(spark.createDataFrame(real, "kind string, canon string"), "k").toPandas()
    assert made["made"].is_unique and not set(made["made"]) & set(made["canon"]) and len(made) == 20


def test_surrogates_follow_a_person_through_a_text(documents):
    said = [
        "Mr. John Smith came. Mr. Smith said John Smith's mail is here. JOHN SMITH left, Smith too, SMITH as well. Blacksmith and smith stay.",
        "Mr. Smith alone", "Ms. Anna Smith and Mr. John Smith: Ms. Smith, Mr. Smith", "mr.\tSmith", "Dr. Weber and Dr. Eva Weber", "John Smith without a title",
    ]
    got = {r.doc_id: r.text for r in surrogates.anonymized(documents(list(enumerate(said))), "key").collect()}
    given, family = re.match(r"Mr\. (\S+) (\S+) came", got[0]).groups()
    assert got[0] == f"Mr. {given} {family} came. Mr. {family} said {given} {family}'s mail is here. {given.upper()} {family.upper()} left, {family} too, {family.upper()} as well. Blacksmith and smith stay."
    assert got[1] != f"Mr. {family} alone" and "Smith" not in got[1]  # nobody's short name here
    pair = re.match(r"Ms\. (\S+) (\S+) and Mr\. (\S+) (\S+): Ms\. (\S+), Mr\. (\S+)$", got[2]).groups()
    assert pair[1] == pair[4] and pair[3] == pair[5] and (pair[2], pair[3]) == (given, family) and pair[1] != pair[3]
    assert got[3].startswith("mr.\t") and "Smith" not in got[3]
    short, full = re.match(r"Dr\. (\S+) and Dr\. \S+ (\S+)$", got[4]).groups()
    assert short == full and "Weber" not in got[4] and got[5] == said[5]


def test_phones_keep_their_country(documents):
    said = ["+33 6 12 34 56 78", "+1 (017) 555-7713", "+358 40 123 4567", "+49 30 12345678", "+7 495 123-45-67", "017 555 7713"]
    got = {r.doc_id: r.text for r in surrogates.anonymized(documents(list(enumerate(said))), "key").collect()}
    for i, (text, code) in enumerate(zip(said, ("+33 ", "+1 (", "+358 ", "+49 ", "+7 ", ""))):
        assert got[i].startswith(code) and got[i] != text and re.sub(r"\d", "0", got[i]) == re.sub(r"\d", "0", text)


def test_long_secrets_go_whole(documents):
    said = ["sk-" + "a1b2" * 30, "f0" * 200]
    got = {r.doc_id: r.text for r in surrogates.anonymized(documents(list(enumerate(said))), "key").collect()}
    assert all(got[i] != said[i] and len(got[i]) == len(said[i]) and said[i][-12:] not in got[i] for i in (0, 1))


def test_surrogates_of_wider_patterns(documents):
    said = ["GB29 NWBK 6016 1331 9268 19 was paid", "to NL91ABNA0417164300", "IT60X0542811101000000123456", "AT61 1904 3002 3457 3201 from", "555-123-4567", "tel:555-123-4567", "+33 6 12 34 56 78", "+49 30 12345678"]
    said += ["Mr. John Paul Jones left", "Mr. McDonald", "Ms. Anne-Marie Smith", "Frau Dr. Weber", "Mr. O'Brien's car", "Herr Weber Frau Braun"]
    gone = ["9268", "0417164300", "05428", "1904", "4567", "4567", "12 34", "12345678", "Jones", "Donald", "Marie", "Weber", "Brien", "Braun"]
    got = {r.doc_id: r for r in surrogates.anonymized(documents(list(enumerate(said))), "key").collect()}
    for i, (text, part) in enumerate(zip(said, gone)):
        assert got[i].n_entities == 1 + (i == 13) and part not in got[i].text, (text, got[i].text)
    assert got[0].text.endswith(" was paid") and got[3].text.endswith(" from") and got[8].text.endswith(" left")
    assert got[11].text.startswith("Frau Dr. ") and got[12].text.endswith("'s car")
    for i in range(4):
        iban = got[i].text.removesuffix(" was paid").removesuffix(" from").removeprefix("to ").replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_short_surrogates_grow(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(surrogates, "NAME_PARTS", {k: ("ba be", ends) for k, (_, ends) in surrogates.NAME_PARTS.items()})
    real = [("name", f"m smith{k}") for k in range(40)] + [("email", f"{chr(97 + k % 26)}{'' if k < 26 else k % 10}@x.org") for k in range(36)]
    rows = spark.createDataFrame(real, "kind string, canon string").coalesce(1)
    tries = rows.withColumn("made", surrogates.surrogate("k", F.col("kind"), F.col("canon"), F.lit(8)))
    assert tries.filter("kind = 'name'").select("made").distinct().count() > 8  # else drawn() has no end
    made = surrogates.drawn(rows, "k").toPandas()
    assert len(made) == len(real) and not made.duplicated(["kind", "made"]).any()


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    uf = Sets()
    for a, b in links:
        uf.join(a, b)
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, uf.find(x)) for x in {y for a, b in links if a != b for y in (a, b)})
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_follow_the_definition():
    import pyarrow as pa

    texts = ["", "a", " a\tb\n", None, "é x y", "\x0b\x0c", "end", "go"]
    buf, offs = common.strings(pa.array(texts))
    start, end, row = common.words(buf, offs)
    assert [(int(r), buf[s:e].tobytes().decode()) for s, e, r in zip(start, end, row)] == [(k, w) for k, t in enumerate(texts) for w in _words(t)]


def test_thresholds_are_exact(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"lang": rng.choice(["a", "b"], 500), "score": rng.random(500).round(3)})
    got = {r["lang"]: r["limit"] for r in quality.thresholds(spark.createDataFrame(pdf), 0.9).collect()}
    for lang, part in pdf.groupby("lang"):
        want = sorted(part["score"])[math.ceil(0.9 * len(part)) - 1]
        assert got[lang] == pytest.approx(want, abs=0.0011)
