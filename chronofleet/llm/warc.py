"""WARC archives as a table of chunk records.

A payload travels as rows (record_id, chunk_no, bytes). The writer has a page whole, as it is one
row of its input, and makes a chunk row of it at a time; Spark's text source writes these as
WARC/1.1 files, hence to any store. The HTTP message of a response uses chunked transfer encoding.
The reader takes bytes, framed by Content-Length, with bounded reads: it holds one chunk of a
payload and carries the digest from chunk to chunk, whatever the length of the record. It takes
archives of other writers as well.

A record whose payload equals that of an earlier identifier is a ``revisit`` without payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofleet.llm.common import scratch, table
from chronofleet.sources.files import list_files, located, task_count

#: Payloads below this many bytes are always stored.
LEAST_REVISIT_BYTES = 100
CHUNK_CHARS = 1 << 14
_EOL = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_OUT_ROWS = 256
#: Bytes of a payload that the reader holds and hands on at a time, and of a header line.
CHUNK_BYTES = LINE_BYTES = 1 << 16
_OUT_BYTES = 4 << 20


def roles(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, html with the payload's digest, bytes and the page it revisits."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(body, 256), "bytes": F.octet_length(body).cast("long")})
    first = rows.filter(F.col("bytes") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"))
    seen = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    seen = F.when(F.col("page_id").isNull(), F.col("first")).otherwise(seen)
    return rows.join(first, "digest", "left").withColumn("refers_to", seen).drop("first")


def _uri(url: str | None) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _slices(text: str, chars: int):
    for at in range(0, len(text), chars):
        yield text[at : at + chars]


def _chunk_rows(batches, chars: int):
    """Rows of WARC text: one for the headers of a record, one per chunk, one to end it."""
    for b in batches:
        out = []
        for i in range(b.num_rows):
            page, url, digest, size, refers = (b.column(c)[i].as_py() for c in ("page_id", "url", "digest", "bytes", "refers_to"))
            text = b.column("html")[i].as_py() or ""
            http = f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}"
            if refers is None:
                http += f"Transfer-Encoding: chunked{_EOL}{_EOL}"
                sizes = [len(c.encode()) for c in _slices(text, chars)]
                length = len(http) + sum(s + len(f"{s:x}") + 4 for s in sizes) + 5
            else:
                http += f"Content-Length: {size}{_EOL}{_EOL}"
                sizes, length = [], len(http)
            head = [
                "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}",
                *([f"WARC-Target-URI: {_uri(url)}"] if url else []), "WARC-Date: 2024-01-01T00:00:00Z",
                f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
                *([] if refers is None else [f"WARC-Refers-To: {_name(refers)}", f"WARC-Profile: {_PROFILE}"]), f"Content-Length: {length}",
            ]
            # The text source ends every row with CRLF, so a row leaves out its last one.
            out.append((_EOL.join(head) + _EOL + _EOL + http)[: -len(_EOL)])
            for s, chunk in zip(sizes, _slices(text, chars)):
                out.append(f"{s:x}{_EOL}{chunk}")
                if len(out) >= _OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out = []
            out.append((f"0{_EOL}{_EOL}" if refers is None else "") + _EOL)
            if len(out) >= _OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", chunk_chars: int = CHUNK_CHARS) -> None:
    """Write one record per row below ``path``.

    Null html is an empty payload, a null url leaves the target out, clashing column names do
    not matter as only the three columns are read. Of equal payloads of at least
    LEAST_REVISIT_BYTES the smallest page_id is the response; rows that repeat this page_id are
    responses each, rows without one are revisits unless none has one.
    """
    lines = roles(pages, page_id, url, html).mapInArrow(partial(_chunk_rows, chars=chunk_chars), "value string")
    lines.write.option("lineSep", _EOL).option("compression", "gzip").text(path)


class _Block:
    """The block of a record: bounded reads up to its Content-Length, an error where the file ends before."""

    def __init__(self, stream, length: int, name: str):
        self.stream, self.left, self.name = stream, length, name

    def _taken(self, data: bytes) -> bytes:
        if not data and self.left:
            raise ValueError(f"the archive ends inside the record {self.name}")
        self.left -= len(data)
        return data

    def read(self, most: int) -> bytes:
        return self._taken(self.stream.read(min(most, self.left))) if self.left else b""

    def line(self) -> bytes:
        return self._taken(self.stream.readline(min(LINE_BYTES, self.left))) if self.left else b""

    def pieces(self, length: int | None = None):
        """The next ``length`` bytes, or all that is left, at most CHUNK_BYTES at a time."""
        left = self.left if length is None else length
        while left:
            data = self.read(min(CHUNK_BYTES, left))
            if not data:
                raise ValueError(f"the block of {self.name} is shorter than its parts")
            left -= len(data)
            yield data


def _fields(line) -> dict[str, str]:
    """Header fields up to an empty line; a folded line belongs to the field before."""
    out, last = {}, None
    while (text := line()) not in (b"\r\n", b"\n", b""):
        if text[:1] in b" \t" and last:
            out[last] += " " + text.decode("utf-8", "replace").strip()
            continue
        k, _, v = text.decode("utf-8", "replace").partition(":")
        last = k.strip().lower()
        out[last] = v.strip()
    return out


def _records(stream):
    """(fields, block) of every record of an archive."""
    while text := stream.readline(LINE_BYTES):
        if not text.strip():
            continue
        if not text.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {text[:40]!r}")
        head = _fields(lambda: stream.readline(LINE_BYTES))
        name = head.get("warc-record-id", "")
        if not head.get("content-length", "").isdigit():
            raise ValueError(f"the record {name} has no length: the archive is cut or damaged")
        block = _Block(stream, int(head["content-length"]), name)
        yield head, block
        for _ in block.pieces():
            pass


def _dechunked(block: _Block, raw):
    """The payload of a message in chunked transfer encoding; ``raw`` sees every byte of it as sent."""
    while True:
        line = block.line()
        raw(line)
        size = int(line.split(b";")[0], 16)
        if size == 0:
            break
        for data in block.pieces(size):
            raw(data)
            yield data
        raw(block.line())
    while (line := block.line()) not in (b"\r\n", b"\n", b""):
        raw(line)


def _known(digest: str, *hashes) -> bool:
    """Whether a digest field names one of the hashes, in hex or base 32; other algorithms can't be checked."""
    kind, _, value = digest.partition(":")
    same = [h for h in hashes if h.name == kind.replace("-", "").lower()]
    return not same or any(value.lower() == h.hexdigest() or value.upper() == base64.b32encode(h.digest()).decode() for h in same)


def _payload(head: dict, block: _Block):
    """(chunk, running size, running digest, last) of a record's payload; the last one has no bytes."""
    kind, http = head.get("warc-type", ""), {}
    named = head.get("warc-payload-digest", "")
    if head.get("content-type", "").startswith("application/http"):
        block.line()
        http = _fields(block.line)
    if kind == "revisit":  # the payload is that of another record
        size = http.get("content-length", "")
        yield b"", int(size) if size.isdigit() else None, named.partition(":")[2].lower(), True
        return
    sums, size = [hashlib.sha256(), hashlib.sha1()], 0
    sent = [hashlib.sha256(), hashlib.sha1()]  # of the message as it was sent, which some writers digest
    if http.get("transfer-encoding", "").lower() == "chunked":
        data = _dechunked(block, lambda b: [h.update(b) for h in sent])
    else:
        data = block.pieces()
    for chunk in data:
        for h in sums:
            h.update(chunk)
        size += len(chunk)
        yield chunk, size, sums[0].hexdigest(), False
    if not _known(named, *sums) and not (http.get("transfer-encoding") and _known(named, *sent)):
        raise ValueError(f"payload of {block.name} does not have its digest")
    yield b"", size, sums[0].hexdigest(), True


#: running_bytes and running_digest cover the payload up to and with this chunk; the row with
#: last_chunk holds no bytes but those of the whole.
CHUNKS = "record_id string, url string, record_type string, refers_to string, content_type string, chunk_no long, chunk binary, running_bytes long, running_digest string, last_chunk boolean"
_CHUNKS = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]]) for c in CHUNKS.split(", ")])


def _read_files(batches):
    rows, held = [], 0

    def out():
        nonlocal rows, held
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)
        rows, held = [], 0
        return batch

    for b in batches:
        for path in b.column("path").to_pylist():
            fs, inner = located(path)
            with fs.open_input_stream(inner, compression=None) as raw:
                file = gzip.GzipFile(fileobj=raw) if path.lower().endswith(".gz") else raw
                try:
                    for head, block in _records(io.BufferedReader(file, CHUNK_BYTES)):
                        own = [head.get(c) for c in ("warc-record-id", "warc-target-uri", "warc-type", "warc-refers-to", "content-type")]
                        for no, (chunk, size, digest, last) in enumerate(_payload(head, block)):
                            rows.append((*own, no, chunk, size, digest, last))
                            held += len(chunk)
                            if len(rows) >= _OUT_ROWS or held >= _OUT_BYTES:
                                yield out()
                except EOFError as e:
                    raise ValueError(f"the archive {path} is cut") from e
    if rows:
        yield out()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives below ``path``, of this writer or any other.

    Records of all types come, plain or gzipped (.gz, one member or many). The payload of an HTTP
    message is what follows its header, with chunked transfer encoding undone; of other records it is
    the block. SHA-256 and SHA-1 payload digests are checked. An archive that ends inside a record,
    or whose payload does not have its digest, is an error.
    """
    files = list_files(spark, path).filter(r"lower(name) RLIKE '[.](warc|warc[.]gz|gz|txt)$'")
    return files.select("path").repartition(task_count(spark), "path").mapInArrow(_read_files, CHUNKS)


def record_table(chunks: DataFrame) -> DataFrame:
    """One row per response or revisit of a page from the last chunk row of each."""
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    rows = chunks.filter("last_chunk AND record_type IN ('response', 'revisit')")
    return rows.select(page("record_id").alias("page_id"), F.col("running_bytes").alias("payload_bytes"), F.col("running_digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def query(spark, sf_dir):
    path = scratch(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    return record_table(read_warc(spark, path))


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
