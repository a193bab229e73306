"""Vectors, archives, the pipeline and what each query returns."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from chronofleet.llm import common, hnsw_dedup, mixing, queries, warc

DATA = "/root/testdata/sf0.001"


def _vectors(rng, groups, dim=16):
    out = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 9))):
            out.append(base + rng.standard_normal(dim) * 0.25 * rng.random())
    return out


def _brute(rows):
    fine = [(i, np.array(v, float)) for i, v in {(i, None if v is None else tuple(v)): None for i, v in rows} if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, up = {i: set() for i, _ in rows}, {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for k, (i, x) in enumerate(fine):
        for j, y in fine[:k]:
            if i != j and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                links[i].add(j)
                links[j].add(i)
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {(i, len(links[i]), None if i is None else find(i)) for i, _ in rows}


@pytest.mark.parametrize("walked", [False, True])
def test_a_dense_shard_answers_with_few_rows(monkeypatch, walked):
    """A third of the rows near one another, small groups apart; counts against brute force."""
    monkeypatch.setattr(hnsw_dedup, "WALK", 0.1 if walked else 100)
    rng = np.random.default_rng(9)
    dim, dense = 32, 1000
    small = np.repeat(rng.standard_normal((200, dim)), 5, axis=0) + rng.standard_normal((1000, dim)) * 0.1
    v = np.concatenate([rng.standard_normal(dim) + rng.standard_normal((dense, dim)) * 0.2, small, rng.standard_normal((1000, dim))])[rng.permutation(3000)].astype(np.float32).astype(float)
    ids, sizes = np.arange(3000) * 3, rng.integers(1, 4, 3000)
    shard = hnsw_dedup.Shard(ids, sizes, v)
    out = [r for a in range(0, 3000, 700) for r in shard.answer(ids[a : a + 700], v[a : a + 700]).to_pylist()]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    want = {int(ids[k]): int(sizes[linked[k]].sum()) for k in range(3000) if linked[k].any()}
    got = {r["a"]: r["others"] for r in out if r["others"] is not None}
    assert sum(got.values()) >= (0.99 if walked else 1) * sum(want.values()) and all(n <= want[i] for i, n in got.items())
    assert walked or got == want
    links = [(r["a"], r["b"]) for r in out if r["others"] is None]
    assert len(links) <= 2 * 3000 < linked.sum() / 20 and all(linked[a // 3, b // 3] for a, b in links)
    up = list(range(3000))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a // 3), find(b // 3)
        up[max(a, b)] = min(a, b)
    assert walked or all(find(a) == find(b) for a, b in zip(*np.nonzero(linked)))


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 7 % 1009, [float(np.float32(x)) for x in v]) for i, v in enumerate(_vectors(rng, 90))]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 15 + [None]), (2003, [1.0] * 15 + [float("inf")]), (2004, []), (2005, rows[0][1]), (2006, rows[0][1][:8]), (2007, [x * 1e30 for x in rows[0][1]]), (None, rows[0][1])]
    rows += [(3000, rows[0][1]), (3000, rows[0][1])]  # a repeated row counts once
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, v int").repartition(4)
    got = hnsw_dedup.near_duplicates(df).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == _brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert hnsw_dedup.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall_on_cliques_and_noise():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1500, 32))
    clique = rng.standard_normal(32) + rng.standard_normal((400, 32)) * 0.1
    x = hnsw_dedup._unit(np.concatenate([base, clique])[rng.permutation(1900)])
    g = hnsw_dedup.Graph(x, hnsw_dedup._levels(np.arange(len(x))))
    beam, recall = g.audited(hnsw_dedup.BEAM)
    assert recall >= hnsw_dedup.RECALL
    q, n = (np.concatenate(v) for v in zip(*g.near(x, beam, 0.9)))
    want = set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.9))))
    assert len(want & set(zip(q.tolist(), n.tolist()))) >= 0.99 * len(want)


def test_audit_sees_lost_small_groups(monkeypatch):
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(32) + rng.standard_normal((1000, 32)) * 0.05
    x = hnsw_dedup._unit(np.concatenate([hot, rng.standard_normal((2000, 32))])[(order := rng.permutation(3000))])
    g = hnsw_dedup.Graph(x, hnsw_dedup._levels(np.arange(len(x))))
    is_hot, near = order < 1000, hnsw_dedup.Graph.near

    def lossy(self, q, beam, least):
        for got_q, got_n in near(self, q, beam, least):
            on = is_hot[got_n] | (beam >= 256)
            yield got_q[on], got_n[on]

    monkeypatch.setattr(hnsw_dedup.Graph, "near", lossy)
    beam, recall = g.audited(hnsw_dedup.BEAM)
    assert beam >= 256 and recall >= hnsw_dedup.RECALL


def test_warc_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 7 == 0 else f"http://x/{i} ü\n", "".join(rng.choice("\r\n aé😀") for _ in range(rng.choice([0, 5, 99, 100, 5000])))) for i in range(40)]
    rows += [(200, "long", "".join(rng.choice("abc é") for _ in range(300_000)))]  # many times what a read takes
    rows += [(100, "u", rows[4][2]), (101, None, None), (1, "a", "x" * 200), (1, "a", "x" * 200), (2, "b", "x" * 200), (None, "c", "x" * 200), (50, "t", "WARC/1.1\r\n\r\n" * 90), (51, "h", "é" * 49), (52, "h", "é" * 49), (53, "h", "é" * 50), (54, "h", "é" * 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = common.scratch(spark)
    warc.write_warc(df, path, chunk_chars=700)
    chunks = warc.read_warc(spark, path).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in warc.record_table(spark.createDataFrame(chunks, warc.CHUNKS)).collect())
    assert got == sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    ident = lambda x: x and (int(x[10:-1]) if x[10:-1] else None)
    text = {}
    for c in sorted((c for c in chunks if c.record_type == "response" and ident(c.record_id) not in (1, 2, None)), key=lambda c: c.chunk_no):
        text[ident(c.record_id)] = text.get(ident(c.record_id), b"") + c.chunk
        assert len(c.chunk) <= 700 * 4
    assert all(text[i] == (h or "").encode() for i, _, h in rows if i in text)
    kinds = {(ident(c.record_id), c.record_type, ident(c.refers_to)) for c in chunks if c.last_chunk}
    assert {(2, "revisit", 1), (None, "revisit", 1), (54, "revisit", 53), (52, "response", None)} <= kinds
    empty = common.scratch(spark)
    warc.write_warc(df.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_archives_are_plain_warc(spark):
    path = common.scratch(spark)
    warc.write_warc(spark.createDataFrame([(1, "http://x/", "hello\r\nworld"), (2, None, "")], "page_id long, url string, html string").coalesce(1), path)
    import gzip
    from pathlib import Path

    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(path).glob("*.gz")))
    at = records = 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        at += len(head) + 4 + length
        assert head.startswith(b"WARC/1.1\r\n") and data[at : at + 4] == b"\r\n\r\n"
        at, records = at + 4, records + 1
    assert records == 2


def _foreign(payload: bytes) -> dict[str, bytes]:
    """Records as other writers make them, by name."""
    import base64

    def record(kind, block, *fields):
        head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:uuid:" + kind.encode() + b">", b"Content-Length: %d" % len(block), *[f.encode() for f in fields]]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype="
    sha1 = "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    chunked = b"".join(b"%X;x=1\r\n" % len(payload[i : i + 999]) + payload[i : i + 999] + b"\r\n" for i in range(0, len(payload), 999)) + b"0\r\nTrailer: 1\r\n\r\n"
    return {
        "warcinfo": record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        "request": record("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", http + "request"),
        "response": record("response", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload, http + "response", sha1, "WARC-Target-URI: http://x/\r\n  folded"),
        "chunked": record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked, http + "response", "WARC-Payload-Digest: sha256:" + hashlib.sha256(payload).hexdigest()),
        "metadata": record("metadata", b"a: b\r\n\r\nnot: a header", "Content-Type: application/warc-fields"),
        "resource": record("resource", payload, "Content-Type: application/octet-stream", sha1),
        "revisit": record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", http + "response", sha1, "WARC-Refers-To: <urn:uuid:response>"),
    }


@pytest.mark.parametrize("packed", ["", "members", "one"])
def test_archives_of_others_are_read(spark, tmp_path, packed):
    import gzip

    payload = bytes(range(256)) * 700 + b"\r\nWARC/1.0\r\n"
    records = _foreign(payload)
    if packed == "members":
        data = b"".join(map(gzip.compress, records.values()))
    else:
        data = b"".join(records.values())
        data = gzip.compress(data) if packed else data
    file = tmp_path / ("a.warc.gz" if packed else "a.warc")
    file.write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    whole = [c for c in rows if c.last_chunk]
    assert [c.record_type for c in whole] == ["warcinfo", "request", "response", "response", "metadata", "resource", "revisit"]
    digest = hashlib.sha256(payload).hexdigest()
    assert [c.running_digest == digest and c.running_bytes == len(payload) for c in whole] == [False, False, True, True, False, True, False]
    assert max(len(c.chunk) for c in rows) <= warc.CHUNK_BYTES and [c.url for c in whole][2] == "http://x/ folded"
    body, part = [], b""
    for c in rows:
        part = part + c.chunk
        if c.last_chunk:
            body, part = [*body, part], b""
    assert body == [b"software: x\r\n", b"", payload, payload, b"a: b\r\n\r\nnot: a header", payload, b""]
    file.write_bytes(data[:-300])
    with pytest.raises(Exception, match="cut|ends inside"):
        warc.read_warc(spark, str(tmp_path)).collect()
    if not packed:
        file.write_bytes(data.replace(payload, payload[:-1] + b"x", 1))
        with pytest.raises(Exception, match="does not have its digest"):
            warc.read_warc(spark, str(tmp_path)).collect()


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, DATA)
        cols = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*cols).collect()), name


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "source_mixing", "byte_bpe"]
    shape = lambda t: re.sub(r"[\x20\x09-\x0d]+", "", t or "")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.saved(stage(spark, docs, DATA))
        after = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        if name == "exact_dedup":
            assert len({shape(r.text) for r in after}) == len(after) == len({shape(r.text) for r in before})
        if name == "source_mixing":
            # Every row as often as the mix takes it.
            mixed = {r.doc_id: r.copies for r in mixing.mixed(spark.createDataFrame(before, docs.schema)).collect()}
            count = {}
            for r in after:
                count[r.doc_id] = count.get(r.doc_id, 0) + 1
            assert count == {i: n for i, n in mixed.items() if n}
        if name == "byte_bpe":
            text = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in before}
            assert len(after) == len(before) and all(r.decoded_sha256 == text[r.doc_id] for r in after)


def test_scratch_goes_and_results_stay(spark):
    other = common.saved(spark.range(5))
    mark = common.scratch_mark()
    gone, kept = common.saved(spark.range(7)), common.saved(spark.range(9))
    common.drop_scratch(keep=kept, since=mark)
    assert (other.count(), kept.count()) == (5, 9)
    with pytest.raises(Exception, match="(?i)not exist|no such file"):
        gone.collect()


def test_pipeline_takes_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() >= 0, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:3]])
def test_clean_documents_stay(spark, documents, stage):
    rows = [(k, " ".join(f"word{k}x{j}" for j in range(30))) for k in range(20)]
    assert stage(spark, documents(rows), DATA).count() == 20
