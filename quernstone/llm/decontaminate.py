"""Benchmark decontamination by a broadcast set of word n-grams.

Grams of the normalised benchmark items (GRAM words, or a whole item if it is shorter) are hashed into a sorted
array that goes to every task. Each window of a document is looked up by a bitmap and then by binary search. A hit
is verified and widened to the longest run of words that the document and the item share around it, word hash by
word hash; runs of at least GRAM words (or a whole shorter item) are kept as spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quernstone.llm import textscan
from quernstone.llm.common import arrow_map, batch, combined, row_key
from quernstone.llm.suffixdedup import remove_ranges
from quernstone.session import cut

GRAM = 8
#: Items of fewer words are found only where they are all of a document: a word or two are in every text.
SHORTEST = 3
#: A document of which at least this share of words is benchmark text goes as a whole.
DOCUMENT_SHARE = 0.5
#: Benchmark words in one broadcast set; a larger benchmark is scanned for in several passes, each with a part of it.
SET_WORDS = 4_000_000
BITMAP_BITS = 22


@dataclass
class Grams:
    """keys (sorted) with the item and word of each; items' words (CSR); sizes are the gram sizes that occur."""

    ids: np.ndarray
    words: np.ndarray
    ptr: np.ndarray
    sizes: list[int]
    keys: list[np.ndarray]
    item: list[np.ndarray]
    word: list[np.ndarray]
    bitmaps: list[np.ndarray]


def build(rows: list[tuple[int, str]], gram: int = GRAM) -> Grams:
    """Gram set of (item_id, text) rows. Items without words are left out; equal items are kept each."""
    words = textscan.scan(textscan.strings(pa.array([t for _, t in rows], pa.large_string())))
    size = np.minimum(np.diff(words.ptr), gram)
    grams = Grams(np.array([i for i, _ in rows], np.int64), words.hash, words.ptr, [], [], [], [], [])
    for s in sorted(set(size[size > 0].tolist())):
        at = textscan.starts(words.ptr, s)
        item = np.searchsorted(words.ptr, at, "right") - 1
        mine = size[item] == s
        at, item = at[mine], item[mine]
        key = textscan.windows(words.hash, s)[at]
        order = np.argsort(key, kind="stable")
        bitmap = np.zeros(1 << BITMAP_BITS, np.bool_)
        bitmap[key >> np.uint64(64 - BITMAP_BITS)] = True
        for held, value in ((grams.sizes, s), (grams.keys, key[order]), (grams.item, item[order]), (grams.word, (at - words.ptr[item])[order]), (grams.bitmaps, np.packbits(bitmap))):
            held.append(value)
    return grams


def run_of(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the first words are equal."""
    equal = x == y
    return len(equal) if equal.all() else int(equal.argmin())


def hits(words: textscan.Words, grams: Grams, bitmaps: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(document, item, start, stop) of the longest common runs around gram hits, word numbers within the document."""
    found = []
    for size, keys, items, places, bitmap in zip(grams.sizes, grams.keys, grams.item, grams.word, bitmaps):
        window = textscan.windows(words.hash, size)
        at = np.flatnonzero(bitmap[window >> np.uint64(64 - BITMAP_BITS)])
        low = np.searchsorted(keys, window[at], "left")
        count = np.searchsorted(keys, window[at], "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        at = np.repeat(at, count)
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else low
        doc = np.searchsorted(words.ptr, at, "right") - 1
        item = items[entry]
        offset = at - (grams.ptr[item] + places[entry])  # document word minus item word
        within = at + size <= words.ptr[doc + 1]
        if size < SHORTEST:
            within &= np.diff(words.ptr)[doc] == size
        doc, item, offset, at = doc[within], item[within], offset[within], at[within]
        # hits on one diagonal are one run or several: those already covered by the run before are skipped
        order = np.lexsort((at, offset, item, doc))
        last = (-1, -1, 0, 0)
        for i in order.tolist():
            d, m, o, a = int(doc[i]), int(item[i]), int(offset[i]), int(at[i])
            if last[:3] == (d, m, o) and a < last[3]:
                continue
            if (words.hash[a : a + size] != grams.words[a - o : a - o + size]).any():
                continue
            back = min(a - int(words.ptr[d]), a - o - int(grams.ptr[m]))
            b = a - run_of(words.hash[a - back : a][::-1], grams.words[a - o - back : a - o][::-1])
            ahead = min(int(words.ptr[d + 1]) - a, int(grams.ptr[m + 1]) - (a - o))
            e = a + run_of(words.hash[a : a + ahead], grams.words[a - o : a - o + ahead])
            last = (d, m, o, e)
            found.append((d, m, b - int(words.ptr[d]), e - int(words.ptr[d])))
    found = np.array(sorted(set(found)), np.int64).reshape(-1, 4)
    return found[:, 0], grams.ids[found[:, 1]], found[:, 2], found[:, 3]


HIT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("doc_words", pa.int32())])


def spans(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, set_words: int = SET_WORDS) -> DataFrame:
    """(doc_id, row, item_id, start, stop, doc_words): runs of at least gram words that a document shares with a benchmark item.

    start and stop are word numbers. row is the key of the row's doc_id and text: rows of one doc_id with different
    texts are documents of their own. Items of less than gram words count when the whole item occurs,
    those of less than SHORTEST when they are the whole document. Null, empty or wordless texts and items never match; rows with a null doc_id are left out; a repeated row gives its spans once.
    Without items, or on an empty table, the result is empty. The benchmark's grams are broadcast in parts of at most
    set_words words, so that a benchmark of any size is scanned for in as many passes as it needs. Columns other than
    doc_id, text, item_id are not looked at.
    """
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(docs).alias("row")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    total = wanted.agg(F.sum(F.length("text") / 2).alias("n")).first().n or 0
    parts = max(1, -(-int(total) // set_words))
    out = None
    for part in range(parts):
        grams = build(sorted((r.item_id, r.text) for r in wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()), gram)

        def run(batches: Iterator[pa.RecordBatch], grams: Grams = grams) -> Iterator[pa.RecordBatch]:
            bitmaps = [np.unpackbits(b).view(np.bool_) for b in grams.bitmaps]
            for got in batches:
                column, ids, keys = textscan.strings(got["text"]), combined(got["doc_id"]).to_numpy(), combined(got["row"]).to_numpy()
                for a, b in textscan.pieces(column):
                    words = textscan.scan(column.slice(a, b - a))
                    doc, item, start, stop = hits(words, grams, bitmaps)
                    if len(doc):
                        yield batch(HIT, ids[a:b][doc], keys[a:b][doc], item, start.astype(np.int32), stop.astype(np.int32), np.diff(words.ptr)[doc].astype(np.int32))

        found = arrow_map(own, run, "doc_id long, row long, item_id long, start int, stop int, doc_words int")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def keyed_verdicts(found: DataFrame, share: float = DOCUMENT_SHARE) -> DataFrame:
    """spans() with covered_share (of the document's words, overlaps counted once) and action: 'document' if that reaches share, else 'span'."""
    document = Window.partitionBy("doc_id", "row")
    reach = F.max("stop").over(document.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("reach", F.lit(0))))
    ratio = F.sum("new").over(document) / F.col("doc_words")
    out = found.withColumn("reach", reach).withColumn("new", new).withColumn("ratio", ratio)
    out = out.withColumn("covered_share", F.round("ratio", 6)).withColumn("action", F.when(F.col("covered_share") >= share, "document").otherwise("span"))
    return out.drop("reach", "new", "ratio")


def verdicts(found: DataFrame, share: float = DOCUMENT_SHARE) -> DataFrame:
    """keyed_verdicts() without the row's key."""
    return keyed_verdicts(found, share).drop("row")


def remove(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, share: float = DOCUMENT_SHARE) -> DataFrame:
    """docs without benchmark text: its spans are cut out, and documents mostly made of it go.

    All other rows are unchanged, those with a null doc_id too. Rows that share a doc_id and differ in text are judged and cut each by its own text.
    """
    found = cut(keyed_verdicts(spans(docs, benchmark, gram), share))
    whole = found.filter("action = 'document'").select("doc_id", "row", F.lit(0).alias("start"), F.col("doc_words").alias("stop"))
    return remove_ranges(docs, found.filter("action = 'span'").select("doc_id", "row", "start", "stop").unionByName(whole))


def verdicts_sql(gram: int = GRAM, share: float = DOCUMENT_SHARE) -> str:
    """verdicts(spans()) over documents and benchmark in DuckDB's SQL: common runs as islands of equal words on a diagonal."""
    words = f"regexp_extract_all(lower(text), '{textscan.word_class(chr(92) + 'x{{{}}}')}')"
    return f"""
        WITH d AS (SELECT DISTINCT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        b AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        bs AS (SELECT item_id, w, least(len(w), {gram}) AS g FROM b WHERE len(w) > 0),
        bg AS (SELECT item_id, g, i - 1 AS bp, list_aggregate(w[i:i + g - 1], 'string_agg', ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - g + 2)) AS i FROM bs)),
        sizes AS (SELECT DISTINCT g FROM bs),
        dg AS (SELECT doc_id, g, i - 1 AS dp, len(w) AS n, list_aggregate(w[i:i + g - 1], 'string_agg', ' ') AS s
               FROM (SELECT doc_id, w, g, unnest(range(1, len(w) - g + 2)) AS i FROM d, sizes WHERE len(w) >= g)),
        h AS (SELECT doc_id, item_id, n, dp, dp - bp AS diagonal, dg.g FROM dg JOIN bg USING (s, g) WHERE dg.g >= {SHORTEST} OR n = dg.g),
        m AS (SELECT *, dp - lag(dp) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY dp) AS step FROM h),
        r AS (SELECT *, sum(CASE WHEN step = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY dp) AS run FROM m),
        f AS (SELECT DISTINCT doc_id, item_id, start, stop, n FROM (SELECT doc_id, item_id, min(dp) AS start, max(dp) + max(g) AS stop, max(n) AS n FROM r GROUP BY doc_id, item_id, diagonal, run)),
        c AS (SELECT doc_id, count(DISTINCT p) / max(n) AS share FROM (SELECT doc_id, n, unnest(range(start, stop)) AS p FROM f) GROUP BY doc_id)
        SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(n AS INTEGER) AS doc_words, round(share, 6) AS covered_share,
               CASE WHEN share >= {share} THEN 'document' ELSE 'span' END AS action
        FROM f JOIN c USING (doc_id)"""
