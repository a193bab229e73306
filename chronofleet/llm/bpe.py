"""Byte-level BPE by prefix dynamic programming.

Of the encodings of a byte string exactly one is what merging by rank gives, and each of its
prefixes is the encoding of a shorter string. So it is enough to store, for every prefix, the
last token of its encoding: the one token that ends there and fits behind the last token of
the prefix before it. Two tokens fit if merging their bytes by rank leaves the border between
them alone. The table makes appends exact without looking back, and after an edit only the
prefixes up to where old and new table agree are done again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofleet.llm.common import reachable, table

#: Distinct pieces a task remembers, and the longest of them; longer ones are done each time.
MEMO_PIECES = 1 << 18
MEMO_BYTES = 64
_OUT_ROWS = 64


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file: lines of base64 token and rank. A local path is read on the driver."""
    if "://" in path:
        lines = [r.value.encode() for r in spark.read.text(path).toLocalIterator()]
    else:
        with open(path, "rb") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x)}


def split_table(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token of several bytes, the two tokens whose merge makes it.

    Merging the token's bytes by lower ranks must end in two parts; a token where it does not is
    never made by merging and gets no entry.
    """
    splits = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, at = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            splits[rank] = (ranks[parts[0]], ranks[parts[1]])
    return splits


class Encoder:
    """Encodes byte strings; ``pattern`` splits a text into pieces that are encoded apart."""

    def __init__(self, ranks: dict[bytes, int], splits: dict[int, tuple[int, int]], pattern: str):
        self.ranks, self.splits = ranks, splits
        self.tokens = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.made = {pair: rank for rank, pair in splits.items()}
        self.reachable = {t: r for t, r in ranks.items() if len(t) == 1 or r in splits}
        self.longest = max(map(len, self.reachable), default=1)
        self.suffixes = ahocorasick.Automaton()
        for t, r in self.reachable.items():
            self.suffixes.add_word(t.decode("latin-1"), (r, len(t)))
        self.suffixes.make_automaton()
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[bytes, tuple[int, ...]]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge joins the two tokens at any time while their bytes are merged."""
        key = (left, right)
        known = self.fits_memo.get(key)
        if known is None:
            if len(self.fits_memo) > 1 << 20:
                self.fits_memo.clear()
            known = self.fits_memo[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo the merges of both tokens from the last to the first. Whenever the parts at the
        # border could merge, that merge must come after the one that took a part away.
        made, splits, until = self.made, self.splits, 1 << 62
        while True:
            if made.get((left, right), until) < until:
                return False
            undo_left = left > right
            whole = left if undo_left else right
            if whole not in splits:
                undo_left = not undo_left
                whole = left if undo_left else right
                if whole not in splits:
                    return True
            if undo_left:
                # Of equal ranks the left merge comes first: a merge at the border of the same
                # rank as the one in the left token comes later, in the right token earlier.
                until, left = left, splits[left][1]
            else:
                until, right = right + 1, splits[right][0]

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Fill ``last`` (last token of each prefix of ``data``) from where it ends."""
        base = max(0, len(last) - self.longest)
        fits, at = self.fits_memo, len(last)
        # The automaton names the tokens that end at a byte from the longest down.
        for end, (token, size) in self.suffixes.iter(data[base:].decode("latin-1")):
            end += base
            if end < at:
                continue
            start = end + 1 - size
            if start == 0 or (start > 0 and (fits.get((last[start - 1], token)) or self.fits(last[start - 1], token))):
                last.append(token)
                at += 1
        if at < len(data):
            raise ValueError("the vocabulary lacks single bytes")
        return last

    def edit(self, last: list[int], old: bytes, start: int, end: int, new: bytes) -> tuple[list[int], bytes]:
        """The table after ``old[start:end]`` became ``new``.

        Past the edit a prefix's entry depends on ``longest`` entries and bytes before it; once
        as many agree with the old table, the rest of the old table holds.
        """
        data = old[:start] + new + old[end:]
        table_, shift = last[:start], len(new) - (end - start)
        same = 0
        while len(table_) < len(data):
            self.extend(table_, data[: len(table_) + 1])
            at = len(table_) - 1
            same = same + 1 if at >= start + len(new) and last[at - shift] == table_[-1] else 0
            if same >= 2 * self.longest:
                table_ += last[len(table_) - shift :]
        return table_, data

    def ids(self, last: list[int]) -> list[int]:
        """The encoding, read from the end of the table."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.ids(self.extend([], data))

    def joined(self, piece: str) -> bytes:
        """The ids of a piece as decimals, each followed by a comma."""
        known = self.memo.get(piece)
        if known is None:
            data = piece.encode()
            known = b"".join(b"%d," % i for i in self.piece(data))
            if len(data) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[piece] = known
        return known

    def text(self, text: str) -> bytes:
        """The ids of a text as decimals joined by commas."""
        known, joined = self.memo.get, self.joined
        return b"".join([known(p) or joined(p) for p in self.pattern.findall(text)])[:-1]


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, sent) -> Encoder:
    if key not in _encoders:  # a worker keeps it, with its memo, for all its tasks
        _encoders.clear()
        _encoders[key] = Encoder(*sent.value)
    return _encoders[key]


class Tokenizer:
    """A vocabulary for encoding and decoding columns; the file's size bounds what is broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        reachable(spark)
        ranks = read_ranks(spark, path)
        self.key = uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast((ranks, split_table(ranks), pattern))

    def encode(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, ids) per row, over the whole text; null text gives no ids."""
        key, sent = self.key, self.sent

        def task(batches):
            e = _encoder(key, sent)
            for b in batches:
                for at in range(0, b.num_rows, _OUT_ROWS):
                    part = b.slice(at, _OUT_ROWS)
                    ids = [[int(i) for i in e.text(t or "").split(b",") if i] for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, "doc_id long, ids array<int>")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(doc_id, data) with the bytes of the ids."""
        key, sent = self.key, self.sent

        def task(batches):
            tokens = _encoder(key, sent).tokens
            for b in batches:
                for at in range(0, b.num_rows, _OUT_ROWS):
                    part = b.slice(at, _OUT_ROWS)
                    data = [b"".join([tokens[i] for i in ids or ()]) for ids in part.column("ids").to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

        return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, data binary")

    def digests(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, n_tokens, ids_sha256, decoded_sha256 per row: encode, then decode the ids.

        Null and empty texts have no tokens and the digests of nothing; rows that repeat or lack
        an id are rows of their own.
        """
        key, sent = self.key, self.sent

        def task(batches):
            e = _encoder(key, sent)
            tokens = {b"%d" % r: t for r, t in e.tokens.items()}
            for b in batches:
                for at in range(0, b.num_rows, _OUT_ROWS):
                    part = b.slice(at, _OUT_ROWS)
                    n, ids_sha, text_sha = [], [], []
                    for t in part.column(1).to_pylist():
                        joined = e.text(t or "")
                        ids = joined.split(b",") if joined else []
                        n.append(len(ids))
                        ids_sha.append(hashlib.sha256(joined).hexdigest())
                        text_sha.append(hashlib.sha256(b"".join([tokens[i] for i in ids])).hexdigest())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        return rows.mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_tokenizer(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> Tokenizer:
    """The vocabulary of a rank file, by default the public one for many languages."""
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return Tokenizer(spark, path, pattern)


def query(spark, sf_dir):
    return default_tokenizer(spark).digests(table(spark, sf_dir, "documents"))


SQL = None
