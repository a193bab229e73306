"""N-gram Jaccard join with count-vector R-trees.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
THRESHOLD percent. A set's shingles are hashed into GROUPS groups; the counts per group are a
point. Of two sets no more shingles can be common than the coordinate minima sum to, and for a
box of points than the minima with its upper corner. An R-tree over points is searched with
this bound, and pairs that survive are verified on the sets.

One tree over a corpus can't be searched without visiting most of it, so there is a tree for
each shingle that could make two documents meet: in a common order of all shingles, rare
ones first, two linked sets share one of their first ``n - ceil(0.8 n) + 1``. Trees search only
between documents that are not connected yet: a first step hooks each document to the first
one that has its rarest shared shingle, and a tree whose documents are all in one component
isn't built. What a tree finds is verified at once, on sets that lie next to the points; a verified pair
joins two components and ends the search between them, so a task emits fewer links than it has
documents. No link between different components goes unchecked, so components are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofleet.llm import batches as bt
from chronofleet.llm.common import PIECE_BYTES, Rolling, lowered, mixed, ready, saved, shuffle_partitions, table, word_bounds, words
from chronofleet.llm.graph import components

SHINGLE = 5
THRESHOLD = 80
GROUPS = 64
LEAF = 32
#: Of its first shingles so many hook a document to others at once.
HOOKS = 5
#: Keys of one bucket of the frequency count.
BUCKET_KEYS = 1 << 20
#: Documents and shingles of one block of a family, on average.
TREE_ROWS = 1 << 12
TREE_SHINGLES = 1 << 21
_COEFF = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one after another, and where rows end."""
    hashes, ends = [], [0]
    at, last = 0, len(offs) - 1
    while at < last:
        to = min(max(int(np.searchsorted(offs, offs[at] + PIECE_BYTES, "right")) - 1, at + 1), last)
        part, cut = lowered(buf[offs[at] : offs[to]]), offs[at : to + 1] - offs[at]
        start, end, row = words(part, cut)
        h = Rolling(part).of(start, end)
        bounds = word_bounds(row, to - at)
        if len(h) >= SHINGLE:
            full = mixed(sum(h[i : len(h) - SHINGLE + 1 + i] * _COEFF[i] for i in range(SHINGLE)))
            whole = row[: len(full)] == row[SHINGLE - 1 :]
            r, x = row[: len(full)][whole], full[whole]
        else:
            r, x = row[:0], h[:0]
        size = np.diff(bounds)
        short = np.flatnonzero((size < SHINGLE) & (size > 0))
        if len(short):
            one = size[short].astype(np.uint64)
            for k in range(SHINGLE - 1):
                on = size[short] > k
                one[on] = mixed(one[on] * _COEFF[0] + h[bounds[short[on]] + k])
            r, x = np.concatenate([r, short]), np.concatenate([x, one])
        order = np.lexsort((x, r))
        r, x = r[order], x[order]
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
        r, x = r[keep], x[keep]
        hashes.append(x)
        ends += (np.searchsorted(r, np.arange(1, to - at + 1)) + ends[-1]).tolist()
        at = to
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(ends)


_ONE, _OTHER = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x3C6EF372FE94F82B)


def _set_digests(buf: np.ndarray, offs: np.ndarray) -> dict[str, bytes]:
    """Size and 128-bit digest of each row's set."""
    h, ends = shingle_sets(buf, offs)
    n = np.diff(ends)
    sums = []
    for salt in (_ONE, _OTHER):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ salt), dtype=np.uint64)])
        sums.append((total[ends[1:]] - total[ends[:-1]]).astype(np.uint64))
    return {"sizes": n.astype(np.int64).tobytes(), "first": sums[0].tobytes(), "second": sums[1].tobytes()}


def _set_rows(batches):
    for row in bt.rows_of(batches):
        cols = [pa.array(np.frombuffer(row[c], np.int64)) for c in ("ids", "sizes", "first", "second")]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "first", "second"])


def first_shingles(n: np.ndarray) -> np.ndarray:
    """How many of a set's first shingles must hold one that a linked set has among its own."""
    return np.where(n > 0, n - -(-n * THRESHOLD // 100) + 1, 0)


class _Sets:
    """The distinct sets of a batch and the keys they ask about."""

    def __init__(self, row):
        self.ids, buf, offs = bt.unpacked(row)
        h, ends = shingle_sets(buf, offs)
        digest = np.stack([np.frombuffer(row[c], np.int64) for c in ("sizes", "first", "second")], 1)
        order = np.lexsort((self.ids, digest[:, 2], digest[:, 1], digest[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (digest[order][1:] != digest[order][:-1]).any(axis=1)
        on = np.zeros(len(order), bool)
        on[order[new]] = True  # of equal sets the smallest id asks for all
        on &= digest[:, 0] > 0
        rows = np.repeat(np.arange(len(self.ids)), np.diff(ends))
        self.h, self.row = h[on[rows]], rows[on[rows]]
        self.n = np.diff(ends)
        keys = self.h >> np.uint64(64 - bt.KEY_BITS)
        # Half of the key space comes first in the order of shingles; a set asks about the other
        # half only where the first does not hold enough of its shingles.
        self.late = keys >> np.uint64(bt.KEY_BITS - 1)
        early = np.bincount(self.row, self.late == 0, len(self.ids))
        enough = early >= first_shingles(self.n)
        ask = (self.late == 0) | ~enough[self.row]
        self.h, self.row, self.late = self.h[ask], self.row[ask], self.late[ask]
        self.keys, self.back, self.counts = np.unique(keys[ask], return_inverse=True, return_counts=True)


def _ask(buckets: int):
    def task(batches):
        for row in bt.rows_of(batches):
            s = _Sets(row)
            if len(s.keys):
                yield bt.asked(row["batch"], s.keys, s.counts, buckets)

    return task


def points(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Counts per group of the hashes of each of ``n`` rows."""
    group = (h & np.uint64(GROUPS - 1)).astype(np.int64)
    return np.bincount(rows * GROUPS + group, minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)


ENTRY = "doc_id long, n int, tokens array<long>, point binary, hashes binary"


def _entries(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sets with a first shingle that other documents have too; these shingles, rare ones first."""
    out = []
    for _, row in left.iterrows():
        s = _Sets(row)
        kind = bt.in_order(right)[s.back]
        order = np.lexsort((s.h, kind, s.late, s.row))
        r = s.row[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        take = order[(place < first_shingles(s.n)[r]) & (kind[order] > 0)]
        r = s.row[take]
        docs, at = np.unique(r, return_index=True)
        if not len(docs):
            continue
        tokens = np.split((s.h[take] >> np.uint64(64 - bt.KEY_BITS)).astype(np.int64), at[1:])
        _, buf, offs = bt.unpacked(row)
        h, ends = shingle_sets(buf, offs)
        all_rows = np.repeat(np.arange(len(s.ids)), np.diff(ends))
        point = points(h, all_rows, len(s.ids))
        for d, t in zip(docs, tokens):
            out.append((s.ids[d], int(s.n[d]), t.tolist(), point[d].tobytes(), h[ends[d] : ends[d + 1]].tobytes()))
    return pd.DataFrame(out, columns=["doc_id", "n", "tokens", "point", "hashes"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _may_link(n, m, common):
    """100 * common >= THRESHOLD * union, with union = n + m - common."""
    return (100 + THRESHOLD) * common >= THRESHOLD * (n + m)


class CountTree:
    """A bulk-loaded R-tree over count vectors; each node has the upper corner of its points."""

    def __init__(self, point: np.ndarray):
        self.point, self.size = point, point.sum(axis=1)
        self.order = np.arange(len(point))
        self.nodes = []
        self._build(0, len(point))

    def _build(self, a: int, b: int) -> int:
        own = self.order[a:b]
        p = self.point[own]
        me = len(self.nodes)
        self.nodes.append([p.max(axis=0), int(self.size[own].min()), int(self.size[own].max()), a, b, -1, -1])
        if b - a > LEAF:
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if self.size[own].max() <= 1.25 * self.size[own].min() else None
            key = self.size[own] if axis is None else p[:, axis]
            mid = (b - a) // 2
            self.order[a:b] = own[np.argpartition(key, mid)]
            self.nodes[me][5] = self._build(a, a + mid)
            self.nodes[me][6] = self._build(a + mid, b)
        return me

    def search(self, ask: np.ndarray, comp: np.ndarray):
        """Yields (candidates, found): asking points of other components that may link with one found.

        ``comp`` may change between two steps: points that have come together are not given.
        """
        todo = [(0, ask)]
        while todo:
            node, q = todo.pop()
            top, low, high, a, b, one, two = self.nodes[node]
            n = self.size[q]
            q = q[100 * np.minimum(n, high) >= THRESHOLD * np.maximum(n, low)]
            if len(q):
                own = comp[self.order[a:b]]
                if (own == own[0]).all():
                    q = q[comp[q] != own[0]]
            if len(q):
                q = q[_may_link(self.size[q], low, np.minimum(self.point[q], top).sum(axis=1))]
            if not len(q):
                continue
            if one >= 0:
                todo += [(one, q), (two, q)]
                continue
            for m in self.order[a:b]:
                hit = q[comp[q] != comp[m]]
                hit = hit[_may_link(self.size[hit], self.size[m], np.minimum(self.point[hit], self.point[m]).sum(axis=1))]
                if len(hit):
                    yield hit, m


class Family:
    """Documents of one pair of blocks, joined by verified links as trees over them are searched."""

    def __init__(self, ids, comp, block, point, sets):
        self.ids, self.block, self.point, self.sets = ids, block, point, sets
        self.comp = np.unique(comp, return_inverse=True)[1]
        self.tried = np.zeros((len(ids), -(-len(ids) // 8)), np.uint8)  # a bit per pair
        self.links = []

    def _link(self, m: int, hit: np.ndarray) -> None:
        """Verifies ``m`` against candidates until none is left in another component."""
        while len(hit):
            hit = hit[(self.comp[hit] != self.comp[m]) & ((self.tried[m, hit >> 3] >> (hit & 7)) & 1 == 0)]
            if not len(hit):
                return
            k, hit = int(hit[0]), hit[1:]
            self.tried[m, k >> 3] |= 1 << (k & 7)
            self.tried[k, m >> 3] |= 1 << (m & 7)
            x, y = self.sets[m], self.sets[k]
            if _may_link(len(x), len(y), _common(x, y)):
                self.links.append((self.ids[m], self.ids[k]))
                old, new = self.comp[k], self.comp[m]
                self.comp[self.comp == old] = new

    def search(self, rows: np.ndarray) -> None:
        """Links between all documents of ``rows``, which share a token; of two blocks, across them."""
        comp = self.comp[rows]
        if (comp == comp[0]).all():
            return
        tree = CountTree(self.point[rows])
        if (self.block == self.block[0]).all():
            ask, found = np.arange(len(rows)), None
        else:  # the smaller block asks
            first = self.block[rows] == self.block[0]
            ask = np.flatnonzero(first if 2 * first.sum() <= len(rows) else ~first)
            found = self.block[rows[ask[0]]] if len(ask) else None
        live = _Live(self.comp, rows)
        for hit, m in tree.search(ask, live):
            if found is None:
                hit = hit[hit < m]  # each pair once
            elif self.block[rows[m]] == found:
                continue
            self._link(int(rows[m]), rows[hit])


class _Live:
    """Components of some rows as they are now."""

    def __init__(self, comp: np.ndarray, rows: np.ndarray):
        self.comp, self.rows = comp, rows

    def __getitem__(self, at):
        return self.comp[self.rows[at]]


ROW = "low long, one int, two int, block int, doc_id long, component long, tokens array<long>, point binary, hashes binary"


def _search_families(batches):
    """Links that join components, for each family and pair of blocks in sorted rows."""

    def found(rows):
        t = pa.Table.from_batches(rows).combine_chunks()
        comp = t["component"].to_numpy()
        if (comp == comp[0]).all():
            return None
        ids, block = t["doc_id"].to_numpy(), t["block"].to_numpy()
        if (block == block[0]).all() and t["one"][0].as_py() != t["two"][0].as_py():
            return None
        point = np.frombuffer(b"".join(t["point"].to_pylist()), np.int32).reshape(-1, GROUPS)
        family = Family(ids, comp, block, point, [np.frombuffer(h.as_buffer(), np.uint64) for c in t["hashes"].chunks for h in c])
        tokens = t["tokens"].combine_chunks()
        values, row = tokens.flatten().to_numpy(), np.repeat(np.arange(len(ids)), tokens.value_lengths().to_numpy())
        order = np.lexsort((row, values))
        values, row = values[order], row[order]
        for own in np.split(row, np.flatnonzero(values[1:] != values[:-1]) + 1):
            if len(own) > 1:
                family.search(own)
        if not family.links:
            return None
        a, b = np.array(family.links, np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in ("low", "one", "two")], 1)
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for x, y in zip(np.append(0, change), np.append(change, len(k))):
            if held and tuple(k[x]) != key:
                if (out := found(held)) is not None:
                    yield out
                held = []
            key = tuple(k[x])
            held.append(b.slice(x, y - x))
    if held and (out := found(held)) is not None:
        yield out


def _verified(batches):
    for b in batches:
        keep = np.zeros(b.num_rows, bool)
        for i in range(b.num_rows):
            x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in ("hashes", "other"))
            keep[i] = _may_link(len(x), len(y), _common(x, y))
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


def _links(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """The pairs (a, b) that link by their sets."""
    left = entries.select(F.col("doc_id").alias("a"), "hashes")
    right = entries.select(F.col("doc_id").alias("b"), F.col("hashes").alias("other"))
    return saved(pairs.join(left, "a").join(right, "b").select("a", "b", "hashes", "other").mapInArrow(_verified, "a long, b long"))


def _bound(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int32).reshape(-1, GROUPS) for c in ("point", "other"))
        keep = pa.array(_may_link(x.sum(axis=1), y.sum(axis=1), np.minimum(x, y).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


def _hooked(entries: DataFrame) -> DataFrame:
    """Links of documents to the smallest one that shares one of HOOKS of their first shingles."""
    at = F.array_distinct(F.array(*[F.element_at("tokens", (F.floor((F.size("tokens") - 1) * k / (HOOKS - 1)) + 1).cast("int")) for k in range(HOOKS)]))
    mine = entries.select("doc_id", "point", F.explode(at).alias("token"))
    centre = mine.groupBy("token").agg(F.min("doc_id").alias("b"))
    pairs = mine.select("token", F.col("doc_id").alias("a"), "point").join(centre, "token").filter("a <> b").select("a", "b", "point").dropDuplicates(["a", "b"])
    other = entries.select(F.col("doc_id").alias("b"), F.col("point").alias("other"))
    return _links(pairs.join(other, "b").select("a", "b", "point", "other").mapInArrow(_bound, "a long, b long"), entries)


def _families(entries: DataFrame, joined: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents by family, (low, doc_id, component, n, tokens), and (token, low) of tokens in several components.

    Tokens with the same smallest component are one family: their documents mostly are the same.
    """
    comp = joined.select(F.col("node").alias("doc_id"), "component")
    rows = entries.select("doc_id", "n", "tokens").join(comp, "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"), "tokens")
    each = rows.select("doc_id", "n", "component", F.explode("tokens").alias("token"))
    if only is not None:
        each = each.join(only, "token", "left_semi")
    each = saved(each)
    spread = each.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token", "low")
    spread = saved(spread)
    family = each.join(spread, "token").groupBy("low", "doc_id", "component", "n").agg(F.collect_list("token").alias("tokens"))
    return saved(family), spread


def _block(blocks: str, first: str = "0") -> Column:
    return (F.expr(first) + F.pmod(F.xxhash64("doc_id"), F.col(blocks))).cast("int")


def _many(docs: str, shingles: str) -> Column:
    return F.ceil(F.greatest(F.col(docs) / TREE_ROWS, F.col(shingles) / TREE_SHINGLES)).cast("int")


def _searched(rows: DataFrame, entries: DataFrame) -> DataFrame:
    rows = rows.join(entries.select("doc_id", "point", "hashes"), "doc_id").select(*[c.split()[0] for c in ROW.split(", ")])
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "low", "one", "two").sortWithinPartitions("low", "one", "two", "doc_id")
    return saved(rows.mapInArrow(_search_families, "a long, b long"))


def _across(entries: DataFrame, joined: DataFrame) -> DataFrame:
    """Links between documents of different components, from a tree per shared first shingle.

    A first round searches blocks of a family, each of bounded size, on their own. Families of
    one block are done then. In the others most documents belong to one component by now; a
    second round deals that component's documents to blocks of one kind, all others to blocks
    of another, and searches every pair of blocks but those of two blocks of the first kind.
    """
    family, spread = _families(entries, joined)
    sizes = saved(family.groupBy("low").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).withColumn("blocks", _many("docs", "shingles")))
    own = family.join(sizes.select("low", "blocks"), "low").withColumn("one", _block("blocks"))
    first = _searched(own.withColumns({"two": F.col("one"), "block": F.col("one")}), entries)
    large = sizes.filter("blocks > 1")
    if large.isEmpty():
        return first
    joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(first))
    family, _ = _families(entries, joined, spread.join(large, "low", "left_semi"))
    sizes = family.groupBy("low", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    main = sizes.groupBy("low").agg(F.max(F.struct("docs", "component")).alias("top")).select("low", F.col("top.component").alias("main"))
    kind = F.col("component") == F.col("main")
    sizes = sizes.join(main, "low").groupBy("low", "main").agg(*[F.sum(F.when(k, F.col(c)).otherwise(0)).alias(f"{c}_{name}") for c in ("docs", "shingles") for name, k in (("main", kind), ("rest", ~kind))])
    sizes = saved(sizes.select("low", "main", _many("docs_rest", "shingles_rest").alias("rest"), _many("docs_main", "shingles_main").alias("most")))
    rows = family.join(sizes, "low").withColumn("block", F.when(kind, _block("most", "rest")).otherwise(_block("rest")))
    with_ = F.when(kind, F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("most") - 1))
    rows = rows.withColumn("with", F.explode(with_)).withColumns({"one": F.least("block", "with"), "two": F.greatest("block", "with")})
    return first.union(_searched(rows, entries))


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row.

    A text without words, or null, has no shingles and is linked with nothing; one with fewer words
    than a shingle has its whole sequence as one. Rows that repeat an id are one document with
    the links of all its texts; a row without an id gets its size and no component. Texts of
    any length count whole, similarity of exactly THRESHOLD links, other columns are ignored
    whatever their names, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packs = bt.packed(rows, _set_digests, "sizes binary, first binary, second binary")
    sets = saved(packs.select("ids", "sizes", "first", "second").mapInArrow(_set_rows, "doc_id long, n_shingles long, first long, second long"))
    classes = saved(sets.filter("n_shingles > 0").groupBy("n_shingles", "first", "second").agg(F.min("doc_id").alias("rep")))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = ready(shuffle_partitions(spark), total, BUCKET_KEYS)
    asked = packs.mapInArrow(_ask(buckets), bt.ASKED)
    answers = asked.groupBy("bucket").applyInPandas(bt.frequency_classes, bt.ANSWERED)
    entries = packs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_entries, ENTRY)
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    entries = saved(entries.join(reps, "doc_id", "left_semi"))
    hooked = _hooked(entries)
    joined = components(hooked)
    across = _across(entries, joined)
    same = sets.join(classes, ["n_shingles", "first", "second"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    found = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(across.select("a", "b")).union(same)
    final = components(found)
    out = sets.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    lost = rows.filter("doc_id IS NULL").mapInArrow(_sizes_only, "doc_id long, n_shingles long")
    return out.union(lost.withColumn("component_id", F.lit(None).cast("long")))


def _sizes_only(batches):
    from chronofleet.llm.common import strings

    for b in batches:
        _, ends = shingle_sets(*strings(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends))], ["doc_id", "n_shingles"])


def query(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))


SQL = None
