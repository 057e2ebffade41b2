"""Near duplicates by SimHash, searched in BK-trees.

A document's signature has BITS bits: the signs of the sum of +-1 vectors of its distinct words and pairs of
neighbouring words. Two documents are near duplicates if their signatures differ in at most RADIUS bits; groups are
the connected components of that relation. Documents with equal words are exact copies and are searched as one.

Search. Signatures are sharded by TABLES bands of BAND_BITS bits drawn at random; a shard holds the signatures that
agree in one band. Each shard is a BK-tree (children keyed by the Hamming distance to their parent), and every
signature is a query to its own shards' trees, where only edges within RADIUS of its distance to the node are followed.

The trees are broadcast where all signatures together are counted to be below BROADCAST_BYTES: each task then takes
some of the bands, grows their shards' trees, and asks them for every signature, without a shuffle. Above that size
shards are formed by a shuffle; one above SHARD_ROWS is split into several trees and its queries go to each of them,
so that no task grows with a hot shard. Both ways look at the same trees and find the same pairs.

Whether a pair is found depends on its own two signatures only, at any size of the corpus: a pair that differs in d
bits shares a band with probability found(d), which is 0.9 at RADIUS (0.977 at 46 bits, 0.998 at 40, where nearly all
near copies lie). All trees at once, without bands, would ask every signature for every other: at a fifth of the bits
BK-trees leave out next to nothing. BAND_BITS and TABLES are parameters: wider bands make smaller shards and need
more of them (tables_for).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernstone.llm import common, textscan
from quernstone.llm.common import arrow_map, batch, combined, row_key, small, unused
from quernstone.llm.components import components
from quernstone.session import cut

BITS = 256
RADIUS = 52
#: Bits of a band, and bands; see tables_for.
BAND_BITS = 16
TABLES = 98
#: Signatures of one tree where shards are formed by a shuffle.
SHARD_ROWS = 10_000
LANES = BITS // 64
SEEDS = np.array([0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xB5297A4D1B56C4E9, 0x68E31DA493C7A1F3], np.uint64)


def features(words: textscan.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes (44 bits) of words and of pairs of words by document, with the documents' ranges."""
    at = textscan.starts(words.ptr, 2)
    docs = words.docs.astype(np.uint64) << np.uint64(44)
    key = np.concatenate([words.hash >> np.uint64(20) | docs, textscan.windows(words.hash, 2)[at] >> np.uint64(20) | docs[at]])
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return key & np.uint64((1 << 44) - 1), np.searchsorted(key, np.arange(len(words.ptr), dtype=np.uint64) << np.uint64(44))


def signatures(words: textscan.Words) -> np.ndarray:
    """(documents x LANES) uint64; all zero for documents without words.

    Ones are counted for eight bits at a time, in the bytes of a word, over runs of at most 255 features.
    """
    value, ptr = features(words)
    size = np.diff(ptr)
    out = np.zeros((len(size), LANES), np.uint64)
    filled = np.flatnonzero(size > 0)
    if not len(filled):
        return out
    runs = -(-size[filled] // 255)
    first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    begin = np.repeat(ptr[filled] - 255 * first, runs) + 255 * np.arange(runs.sum())
    for lane in range(LANES):
        h = textscan.mix(value ^ SEEDS[lane])
        ones = np.empty((len(filled), 8, 8), np.int64)
        for k in range(8):
            counts = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), begin)
            ones[:, :, k] = np.add.reduceat(counts.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        bits = (2 * ones > size[filled][:, None, None]).reshape(-1, 64)
        out[filled, lane] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("copy", pa.int64()), ("copy2", pa.int64()), *((f"s{i}", pa.int64()) for i in range(LANES))])


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row that has words: its id and key, 128 bits that identify its sequence of words, its signature."""
    for got in batches:
        column, ids, keys = textscan.strings(got["text"]), combined(got["doc_id"]), combined(got["row"])
        for a, b in textscan.pieces(column):
            words = textscan.scan(column.slice(a, b - a))
            own = np.flatnonzero(np.diff(words.ptr) > 0)
            if not len(own):
                continue
            place = np.arange(len(words.hash)) - np.repeat(words.ptr[:-1], np.diff(words.ptr))
            whole = []
            for base in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
                total = np.zeros(len(words.hash) + 1, np.uint64)
                np.cumsum(words.hash * textscan.powers(base, int(place.max()))[place], out=total[1:])
                whole.append((total[words.ptr[1:]] - total[words.ptr[:-1]])[own].view(np.int64))
            s, at = signatures(words)[own], pa.array(own)
            yield batch(SIGNED, ids.slice(a, b - a).take(at), keys.slice(a, b - a).take(at), *whole, *(np.ascontiguousarray(s[:, i]).view(np.int64) for i in range(LANES)))


def found(bits: int, away: int, tables: int = TABLES) -> float:
    """Probability that a pair which differs in `away` bits shares one of `tables` bands."""
    agree = math.prod(max(0, BITS - away - i) / (BITS - i) for i in range(bits))  # a band's positions are distinct
    return 1 - (1 - agree) ** tables


def tables_for(bits: int, radius: int = RADIUS, recall: float = 0.9) -> int:
    """Bands of that many bits needed to find a pair at the radius with probability recall."""
    agree = found(bits, radius, 1)
    return math.ceil(math.log(1 - recall) / math.log1p(-agree)) if 0 < agree < 1 else 1


def band_positions(bits: int, count: int) -> np.ndarray:
    return np.stack([np.random.default_rng(1000 + t).choice(BITS, bits, replace=False) for t in range(count)])


def band_keys(s: np.ndarray, bands: np.ndarray, first: int = 0) -> np.ndarray:
    """Shard of each signature (columns) in each band (rows); first is the number of the first of the bands."""
    raw = np.ascontiguousarray(s).view(np.uint8).reshape(len(s), 8 * LANES)
    keys = np.empty((len(bands), len(s)), np.uint64)
    for t, where in enumerate(bands):
        packed = np.packbits(raw[:, where >> 3] >> (where & 7).astype(np.uint8) & 1, axis=1, bitorder="little")
        wide = np.zeros((len(s), 8), np.uint8)
        wide[:, : packed.shape[1]] = packed
        keys[t] = textscan.mix(wide.view(np.uint64)[:, 0] + np.uint64((first + t) << 48))
    return keys.view(np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def forest(s: np.ndarray, tree: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """BK-trees of the signatures s[held], one for each value of tree (sorted), built level by level.

    Returns parents, edges (distances to the parent) and the roots by tree. Signatures within a tree must be distinct.
    """
    n = len(s)
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    rest = np.flatnonzero(held)
    values, first = np.unique(tree[rest], return_index=True)
    root = dict(zip(values.tolist(), rest[first].tolist()))
    at = np.full(n, -1, np.int64)
    at[rest] = np.repeat(rest[first], np.diff(np.append(first, len(rest))))
    rest = np.delete(rest, first)
    while len(rest):
        d = distance(s[rest], s[at[rest]])
        key = at[rest] * (BITS + 1) + d
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        child = rest[first]
        parent[child], edge[child] = at[child], d[first]
        at[rest] = child[inverse]
        rest = np.delete(rest, first)
    return parent, edge, root


def search(s: np.ndarray, tree: np.ndarray, held: np.ndarray, radius: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) index pairs within radius: every row queries the tree of its shard. Rows with held are nodes."""
    parent, edge, root = forest(s, tree, held)
    nodes = np.flatnonzero(parent >= 0)
    nodes = nodes[np.argsort(parent[nodes], kind="stable")]
    size = np.bincount(parent[nodes], minlength=len(s))
    base = np.cumsum(size) - size
    child_edge = edge[nodes]
    start = np.full(len(s), -1, np.int64)
    values, which = np.unique(tree, return_inverse=True)
    start = np.array([root.get(t, -1) for t in values.tolist()], np.int64)[which]
    ask = np.arange(len(s))
    stack = [(ask[i : i + most], start[i : i + most]) for i in range(0, len(s), most)]
    while stack:
        q, node = stack.pop()
        if (node < 0).any():
            q, node = q[node >= 0], node[node >= 0]
        if not len(q):
            continue
        d = distance(s[q], s[node])
        hit = d <= radius
        yield q[hit], node[hit]
        count = size[node]
        inner = count > 0
        q, node, d, count = q[inner], node[inner], d[inner], count[inner]
        total = np.cumsum(count)
        at = 0
        while at < len(q):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            c = count[at:to]
            child = np.repeat(base[node[at:to]] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
            near = np.abs(child_edge[child] - np.repeat(d[at:to], c)) <= radius
            stack.append((np.repeat(q[at:to], c)[near], nodes[child[near]]))
            at = to


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def settle(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index connected to each of n rows by links."""
    low = np.arange(n)
    found = [x for x in links if len(x[0])]
    while found:
        before = low.copy()
        for q, node in found:
            m = np.minimum(low[q], low[node])
            np.minimum.at(low, q, m)
            np.minimum.at(low, node, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def link(shard: np.ndarray, ids: np.ndarray, s: np.ndarray, held: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole shards: from each row to the least row of its component in the shard."""
    order = np.lexsort((ids, *s.T, shard))
    s, ids, shard, held = s[order], ids[order], shard[order], held[order]
    # equal signatures are linked here; a tree holds one of them
    same = np.zeros(len(ids), np.bool_)
    same[1:] = (shard[1:] == shard[:-1]) & (s[1:] == s[:-1]).all(1)
    group = np.cumsum(~same) - 1
    head = np.flatnonzero(~same)
    any_held = np.maximum.reduceat(held.astype(np.int8), head) > 0
    low = settle(len(head), search(s[head], shard[head], any_held, radius))
    moved = np.flatnonzero(low != np.arange(len(head)))
    return np.concatenate([ids[same], ids[head[moved]]]), np.concatenate([ids[head[group[same]]], ids[head[low[moved]]]])


def link_shards(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the shards of a partition sorted by shard."""

    def links(t: pa.Table) -> pa.RecordBatch:
        s = np.stack([t[f"s{i}"].to_numpy() for i in range(LANES)], 1).view(np.uint64)
        return batch(LINK, *link(t["shard"].to_numpy(), t["id"].to_numpy(), s, t["held"].to_numpy(), radius))

    waiting: list[pa.RecordBatch] = []
    rows = 0
    for got in batches:
        if not got.num_rows:
            continue
        waiting.append(got)
        rows += got.num_rows
        if rows < 40_000:
            continue
        t = pa.Table.from_batches(waiting)
        shard = t["shard"].to_numpy()
        to = int(np.searchsorted(shard, shard[-1], "left"))
        if to:
            yield links(t.slice(0, to))
            t = t.slice(to)
        waiting, rows = t.to_batches(), 0 if t.num_rows < 40_000 else t.num_rows - 40_000
    if waiting and (t := pa.Table.from_batches(waiting)).num_rows:
        yield links(t)


SUMS = [f"s{i}" for i in range(LANES)]
#: Rows of shards whose trees are grown at a time.
GROVE = 60_000


def broadcast_links(copies: DataFrame, bands: np.ndarray, radius: int) -> DataFrame:
    """(a, b): links within the shards, the signatures of all trees being broadcast; a task takes some of the bands."""
    spark = copies.sparkSession
    t = copies.select("id", *SUMS).toArrow()
    data = (t["id"].to_numpy(), np.stack([t[c].to_numpy() for c in SUMS], 1).view(np.uint64))
    sent = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, s = sent.value
        for got in batches:
            for band in got["band"].to_pylist():
                shard = band_keys(s, bands[band : band + 1], band)[0]
                order = np.argsort(shard, kind="stable")
                ranked = shard[order]
                edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
                size = np.diff(np.append(edge, len(ranked)))
                keep = np.repeat(size > 1, size)  # a shard of one has no pair
                order, ranked = order[keep], ranked[keep]
                at = 0
                while at < len(order):
                    to = min(at + GROVE, len(order))
                    to = len(order) if to == len(order) else max(int(np.searchsorted(ranked, ranked[to], "left")), 0)
                    to = to if to > at else int(np.searchsorted(ranked, ranked[at], "right"))
                    rows = order[at:to]
                    yield batch(LINK, *link(ranked[at:to], ids[rows], s[rows], np.ones(len(rows), np.bool_), radius))
                    at = to

    tasks = max(1, min(len(bands), 2 * spark.sparkContext.defaultParallelism))
    return arrow_map(spark.range(0, len(bands), 1, tasks).select(F.col("id").cast("int").alias("band")), run, "a long, b long")


def shuffled_links(copies: DataFrame, bands: np.ndarray, radius: int, shard_rows: int) -> DataFrame:
    """(a, b): links within the shards, which are formed by a shuffle."""
    full = pa.schema([("id", pa.int64()), ("shard", pa.int64()), *((c, pa.int64()) for c in SUMS)])
    keyed = pa.schema([("shard", pa.int64())])

    def lanes(got: pa.RecordBatch) -> np.ndarray:
        return np.stack([got[c].to_numpy() for c in SUMS], 1).view(np.uint64)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            yield batch(keyed, band_keys(lanes(got), bands).ravel())

    def shard_rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            take = pa.array(np.tile(np.arange(got.num_rows), len(bands)))
            yield batch(full, got["id"].take(take), band_keys(lanes(got), bands).ravel(), *(got[c].take(take) for c in SUMS))

    count = arrow_map(copies.select(*SUMS), shards, "shard long").groupBy("shard").agg(F.count("*").alias("__n"))
    hot = cut(count.filter(F.col("__n") > shard_rows).select(F.col("shard").alias("__hot"), F.ceil(F.col("__n") / shard_rows).cast("int").alias("__parts")))
    split = arrow_map(copies.select("id", *SUMS), shard_rows_of, "id long, shard long, " + ", ".join(f"{c} long" for c in SUMS)).join(small(hot, 16), F.col("shard") == F.col("__hot"), "left")
    split = split.withColumn("__own", F.pmod(F.xxhash64("id"), F.coalesce("__parts", F.lit(1)))).withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    split = split.select("id", F.when(F.col("__parts").isNull(), F.col("shard")).otherwise(F.xxhash64("shard", "__part")).alias("shard"), (F.col("__own") == F.col("__part")).alias("held"), *SUMS)
    return arrow_map(split.repartition("shard").sortWithinPartitions("shard"), lambda b: link_shards(radius, b), "a long, b long")


def members(docs: DataFrame, radius: int, band_bits: int, tables: int, shard_rows: int, broadcast_bytes: int | None) -> DataFrame:
    """(doc_id, row, kept_doc_id, kept_row): the rows of all groups of more than one row, and the row that stays: the least (doc_id, row)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(docs).alias("row")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = cut(arrow_map(own, sign, "doc_id long, row long, copy long, copy2 long, " + ", ".join(f"{c} long" for c in SUMS)))
    me = F.struct("doc_id", "row")
    copies = cut(signed.groupBy("copy", "copy2").agg(F.min(me).alias("first"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in SUMS)).withColumn("id", F.col("copy")))
    bands = band_positions(band_bits, tables)
    if copies.count() * 8 * (LANES + 1) <= (common.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        links = broadcast_links(copies, bands, radius)
    else:
        links = shuffled_links(copies, bands, radius, shard_rows)
    near = components(links.distinct())
    # copies that are alone with one row are no group; a group of copies is never gathered in one row
    rooted = copies.join(near.select("id", "root"), "id", "left").filter("root IS NOT NULL OR n > 1").select("copy", "copy2", "first", F.coalesce("root", "id").alias("root"))
    rooted = cut(rooted)
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    rooted = cut(rooted.join(kept, "root").select("copy", "copy2", "kept"))
    return signed.select("copy", "copy2", "doc_id", "row").join(small(rooted, 56), ["copy", "copy2"]).select("doc_id", "row", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.row").alias("kept_row"))


def groups(docs: DataFrame, radius: int = RADIUS, band_bits: int = BAND_BITS, tables: int = TABLES, shard_rows: int = SHARD_ROWS, broadcast_bytes: int | None = None) -> DataFrame:
    """(doc_id, kept_doc_id): every document that has a near or exact duplicate with a lesser doc_id in its group, with the least doc_id of the group.

    Rows whose text is null, empty or without words, and rows whose doc_id is null, are no duplicates of anything.
    Rows that agree in doc_id and text are one document; rows of one doc_id with different texts are documents of
    their own, so that such a doc_id may come with several kept_doc_ids. Ties go to the least doc_id. Texts are used
    whole. An empty table gives an empty result. Columns other than doc_id and text are not looked at.
    """
    found = members(docs, radius, band_bits, tables, shard_rows, broadcast_bytes)
    return found.filter("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id").distinct()


def keep_one(docs: DataFrame, radius: int = RADIUS, band_bits: int = BAND_BITS, tables: int = TABLES, shard_rows: int = SHARD_ROWS, broadcast_bytes: int | None = None) -> DataFrame:
    """docs without the near duplicates: of each group, one row of the least doc_id stays. All columns unchanged, whatever their names.

    Rows go by doc_id and text, so a row that shares its doc_id with a duplicate but not the text stays. Of rows that
    agree in doc_id and text one stays, any where they differ in other columns. Null, empty and wordless texts and
    null doc_ids stay.
    """
    doc, row, whole = unused(docs, "__doc", "__row", "__whole")
    found = cut(members(docs, radius, band_bits, tables, shard_rows, broadcast_bytes))
    is_kept = (F.col("doc_id") == F.col("kept_doc_id")) & (F.col("row") == F.col("kept_row"))

    def keys(df: DataFrame) -> DataFrame:
        return small(cut(df.select(F.col("doc_id").alias(doc), F.col("row").alias(row))), 24)

    def on(side: DataFrame):
        return (docs["doc_id"].cast("long") == side[doc]) & (row_key(docs) == side[row])

    gone = keys(found.filter(~is_kept).distinct())
    again = keys(found.filter(is_kept).groupBy("doc_id", "row").agg(F.count("*").alias("n")).filter("n > 1"))
    left = docs.join(gone, on(gone), "left_anti")
    if again.isEmpty():
        return left
    once = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias(whole), docs["doc_id"].cast("long").alias(doc), row_key(docs).alias(row)).join(again, [doc, row], "left_semi")
    once = once.groupBy(doc, row).agg(F.first(whole).alias(whole)).select(*(F.col(whole)[c].alias(c) for c in docs.columns))
    return left.join(again, on(again), "left_anti").unionByName(once)
