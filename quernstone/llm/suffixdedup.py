"""Exact removal of repeated passages by a distributed sort of suffixes.

Words are what stands between white space; case and punctuation are passed over. A window of LENGTH words that occurs
in two documents is a repeat; passages are unions of such windows, and the document with the least doc_id keeps it, as
often as it has it: repetition within a document is left to other filters.

1. Sampling. In every window the GRAM-word gram with the least hash is its anchor (the rightmost of ties). Equal
   windows have equal anchors, so a repeat is found at its anchors, of which there is about one in 13 words, and no
   other suffix has to be sorted. Anchors whose gram occurs once cannot lie in a repeat and are dropped by a count.
2. Runs. Each task sorts the suffixes that begin at its remaining anchors, the gram counting as the first letter and
   the words after it as the others, and cuts the sorted run at fixed ranges of that first letter. Suffixes are cut
   off where no window through the anchor reaches. Of suffixes of a run with equal words on both sides only the first
   goes on, with the places at which its document has it again; those of other documents are repeats of it, so that a
   passage that many documents share is exchanged once a run.
3. Exchange. Pieces of runs are front-coded: a suffix carries the length of the prefix it shares with its predecessor
   and only the words after it. The words before the anchor go along as payload.
4. Merge. A range's pieces are merged by a loser tree whose nodes hold common prefix lengths with the last winner:
   unequal lengths decide without looking at words, equal ones compare from that length on.
5. Windows. In the merged suffix array, runs of suffixes with a common first letter hold all occurrences of a gram;
   their windows are compared by the hashes of the words before and after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from quernstone.llm import textscan
from quernstone.llm.common import BROADCAST_BYTES, arrow_map, batch, combined, row_key, unused
from quernstone.session import cut, ship

LENGTH = 50
GRAM = 25
SPAN = LENGTH - GRAM + 1  # gram positions in a window; also the most words after an anchor, plus one
CONTEXT = LENGTH - GRAM
#: Suffixes whose windows are compared at a time (more where one gram has more).
BLOCK = 10_000
#: Suffixes of a run, and of a range of the first letter on average.
RUN_ROWS = 1 << 16
RANGE_ROWS = 1 << 12


def anchors(words: textscan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes by word, starts of the windows that lie in a document, and the anchors of these windows (not decreasing)."""
    gram = textscan.windows(words.hash, GRAM)
    begin = textscan.starts(words.ptr, LENGTH)
    if not len(begin):
        return gram, begin, begin
    value, place, width = gram, np.arange(len(gram), dtype=np.int32), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        right = value[step:] <= value[: len(value) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        value = np.minimum(value[step:], value[: len(value) - step])
        width += step
    return gram, begin, place[begin].astype(np.int64)


SPAN_ROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("first_doc_id", pa.int64())])
SPAN_DDL = "doc_id long, row long, start int, stop int, first_doc_id long"
ANCHOR = pa.schema([("gram", pa.int64()), ("row", pa.int64()), ("word", pa.int32())])


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        column, keys = textscan.strings(got["text"]), combined(got["row"]).to_numpy()
        for a, b in textscan.pieces(column):
            words = textscan.scan(column.slice(a, b - a), spaced=True)
            gram, _, place = anchors(words)
            if not len(place):
                continue
            place = place[np.append(True, place[1:] != place[:-1])]
            doc = np.searchsorted(words.ptr, place, "right") - 1
            yield batch(ANCHOR, gram[place].view(np.int64), keys[a:b][doc], (place - words.ptr[doc]).astype(np.int32))


def ragged(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin[i] : begin[i] + size[i]], one after the other."""
    total = int(size.sum())
    if not total:
        return values[:0]
    return values[np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)]


def grid(flat: np.ndarray, size: np.ndarray, skip: np.ndarray | int = 0) -> np.ndarray:
    """Rows of CONTEXT words from their concatenation, each placed from column skip on, else 0."""
    out = np.zeros((len(size), CONTEXT), np.uint32)
    column = np.arange(CONTEXT)[None, :]
    first = np.broadcast_to(np.asarray(skip), size.shape)[:, None]
    out[(column >= first) & (column < first + size[:, None])] = flat
    return out


def encode(gram, right, right_size, left_flat, left_size, ids, keys, times, place) -> bytes:
    """A sorted piece of a run, front-coded. right is a grid; place has, one after the other, the places of each suffix, times their numbers; all else by suffix."""
    same = np.zeros(len(gram), np.int64)
    if len(gram) > 1:
        equal = (right[1:] == right[:-1]) & (right[1:] != 0)
        same[1:] = np.where(gram[1:] == gram[:-1], 1 + np.where(equal.all(1), CONTEXT, equal.argmin(1)), 0)
    drop = np.maximum(same - 1, 0)
    keep = np.arange(CONTEXT)[None, :]
    flat = right[(keep >= drop[:, None]) & (keep < right_size[:, None])]
    parts = [np.array([len(gram)], np.int64), gram[same == 0], ids, keys, times.astype(np.int32), place.astype(np.int32), same.astype(np.uint8), right_size.astype(np.uint8), left_size.astype(np.uint8), flat, left_flat]
    return b"".join(p.tobytes() for p in parts)


def decode(data: bytes) -> tuple[np.ndarray, ...]:
    """(gram, right grid, right sizes, left grid, left sizes, ids, row keys, numbers of places, shared prefix lengths, places) of a piece."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at = 8

    def take(kind, count):
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    heads = int.from_bytes(data[-8:], "little")  # suffixes with a first letter of their own
    gram_heads, ids, keys, times = take(np.uint64, heads), take(np.int64, n), take(np.int64, n), take(np.int32, n).astype(np.int64)
    place = take(np.int32, int(times.sum()))
    same, right_size, left_size = take(np.uint8, n).astype(np.int64), take(np.uint8, n).astype(np.int64), take(np.uint8, n).astype(np.int64)
    gram = gram_heads[np.cumsum(same == 0) - 1]
    drop = np.maximum(same - 1, 0)
    right = grid(take(np.uint32, int((right_size - drop).sum())), right_size - drop, drop)
    row = np.arange(n)
    for c in range(int(drop.max(initial=0))):
        right[:, c] = right[np.maximum.accumulate(np.where(drop <= c, row, 0)), c]
    left = grid(take(np.uint32, int(left_size.sum())), left_size)
    return gram, right, right_size, left, left_size, ids, keys, times, same, place


PIECE = pa.schema([("range", pa.int32()), ("piece", pa.binary())])
#: The range that stands for spans already found within a run.
LOCAL = -1


def pack_spans(*columns: np.ndarray) -> bytes:
    return np.stack(columns).astype(np.int64).tobytes()


def local_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the spans that pack_spans put away."""
    for got in batches:
        for piece in got["piece"]:
            ids, keys, start, stop, first = np.frombuffer(piece.as_py(), np.int64).reshape(5, -1)
            yield batch(SPAN_ROW, ids, keys, start.astype(np.int32), stop.astype(np.int32), first)


def make_runs(ranges: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Front-coded pieces of sorted runs of at most about `most` suffixes, by range of the first letter."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        gram, right, right_size, left, left_size, ids, keys, place = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(gram, kind="stable")
        ranked = gram[order]
        tied = np.zeros(len(order), np.bool_)
        tied[1:] = ranked[1:] == ranked[:-1]
        tied[:-1] |= tied[1:].copy()
        at = np.flatnonzero(tied)
        if len(at):
            mine = order[at]
            order[at] = mine[np.lexsort((place[mine], keys[mine], ids[mine], *left[mine].T[::-1], *right[mine].T[::-1], gram[mine]))]
        gram, right, right_size, left, left_size, ids, keys, place = (x[order] for x in (gram, right, right_size, left, left_size, ids, keys, place))
        # of suffixes whose whole context is the same, the first stands for all: those of other documents are repeats of it already
        same = np.zeros(len(gram), np.bool_)
        near = np.flatnonzero(gram[1:] == gram[:-1]) + 1
        same[near] = (right_size[near] == right_size[near - 1]) & (left_size[near] == left_size[near - 1]) & (right[near] == right[near - 1]).all(1) & (left[near] == left[near - 1]).all(1)
        head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        other = same & ((ids != ids[head]) | (keys != keys[head]))
        gone = np.flatnonzero(other)
        local = pack_spans(ids[gone], keys[gone], place[gone] - left_size[gone], place[gone] + GRAM + right_size[gone], ids[head[gone]]) if len(gone) else None
        # the first's document comes first among its equals, so what is left of them are its places in order
        stays = np.flatnonzero(~other)
        stays = stays[np.append(True, (head[stays][1:] != head[stays][:-1]) | (place[stays][1:] != place[stays][:-1]))] if len(stays) else stays
        ends = np.append(np.flatnonzero(~same[stays])[1:], len(stays))
        times, places = np.diff(np.append(0, ends)), place[stays]
        gram, right, right_size, left, left_size, ids, keys = (x[~same] for x in (gram, right, right_size, left, left_size, ids, keys))
        upto = np.append(0, ends)
        part = (gram >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
        names, blobs = ([], []) if local is None else ([LOCAL], [local])
        column = np.arange(CONTEXT)[None, :]
        for r in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[r], cuts[r + 1])
            body = encode(gram[s], right[s], right_size[s], left[s][column < left_size[s][:, None]], left_size[s], ids[s], keys[s], times[s], places[upto[cuts[r]] : upto[cuts[r + 1]]])
            heads = int((np.append(True, gram[s][1:] != gram[s][:-1])).sum())
            names.append(r)
            blobs.append(body + heads.to_bytes(8, "little"))
        return batch(PIECE, np.array(names, np.int32), pa.array(blobs, pa.binary()))

    rows = 0
    for got in batches:
        column, ids, keys, lists = textscan.strings(got["text"]), combined(got["doc_id"]).to_numpy(), combined(got["row"]).to_numpy(), combined(got["words"])
        for a, b in textscan.pieces(column):
            words = textscan.scan(column.slice(a, b - a), spaced=True)
            gram, begin, place = anchors(words)
            if not len(place):
                continue
            new = np.append(True, place[1:] != place[:-1])
            where = place[new]
            first = begin[new]
            last = begin[np.append(np.flatnonzero(new)[1:], len(place)) - 1]
            doc = np.searchsorted(words.ptr, where, "right") - 1
            wanted = lists.slice(a, b - a)
            size = np.diff(wanted.offsets.to_numpy())
            lived = (np.repeat(np.arange(b - a), size).astype(np.int64) << 32) + wanted.flatten().to_numpy().astype(np.int64)
            mine = np.isin((doc.astype(np.int64) << 32) + where - words.ptr[doc], lived)
            where, first, last, doc = where[mine], first[mine], last[mine], doc[mine]
            if not len(where):
                continue
            word = np.maximum((words.hash >> np.uint64(32)).astype(np.uint32), 1)
            right_size, left_size = last + LENGTH - where - GRAM, where - first
            right = grid(ragged(word, where + GRAM, right_size), right_size)
            left = grid(ragged(word[::-1], len(word) - where, left_size), left_size)  # nearest word first
            held.append((gram[where], right, right_size, left, left_size, ids[a:b][doc], keys[a:b][doc], where - words.ptr[doc]))
            rows += len(where)
            if rows >= most:
                rows = 0
                yield flush()
    if held:
        yield flush()


def merge(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loser-tree merge of sorted runs of (first letter, grid of words, lengths shared with the predecessor).

    Returns run and position of each suffix in order, and the length it shares with its predecessor in that order.
    """
    count = len(runs)
    letters = [r[0].tolist() for r in runs]
    shared = [r[2].tolist() for r in runs]
    grids = [r[1] for r in runs]
    sizes = [len(x) for x in letters]
    cache: list[tuple[int, list[int]]] = [(-1, [])] * count
    at = [0] * count

    def words(r: int) -> list[int]:
        have = cache[r]
        if have[0] != at[r]:
            have = cache[r] = (at[r], grids[r][at[r]].tolist())
        return have[1]

    def less(a: int, b: int, known: int) -> tuple[bool, int]:
        """Whether run a's head is the lesser, and the common prefix, both known to share known letters."""
        if known == 0:
            x, y = letters[a][at[a]], letters[b][at[b]]
            if x != y:
                return x < y, 0
            known = 1
        x, y = words(a), words(b)
        for i in range(known - 1, CONTEXT):
            if x[i] != y[i]:
                return x[i] < y[i], i + 1
            if not x[i]:
                return a < b, i + 1
        return a < b, CONTEXT + 1

    width = 1 << max(0, (count - 1).bit_length())
    loser = [-1] * width
    common = [0] * width
    # first round, played bottom up; a run that has ended loses to any other
    winner = [r if r < count and sizes[r] else -1 for r in range(width)]
    level = width
    while level > 1:
        level //= 2
        following = []
        for i in range(level):
            a, b = winner[2 * i], winner[2 * i + 1]
            if a < 0 or b < 0:
                following.append(max(a, b))
                continue
            first, known = less(a, b, 0)
            loser[level + i], common[level + i] = (b, known) if first else (a, known)
            following.append(a if first else b)
        winner = following
    best, prefix = winner[0], 0
    order_run, order_at, order_shared = [], [], []
    while best >= 0:
        order_run.append(best)
        order_at.append(at[best])
        order_shared.append(prefix)
        node = (width + best) // 2
        at[best] += 1
        now, prefix = (best, shared[best][at[best]]) if at[best] < sizes[best] else (-1, 0)
        while node:
            other = loser[node]
            if other >= 0:
                if now < 0:
                    now, other, prefix, common[node] = other, -1, common[node], 0
                    loser[node] = other
                elif common[node] > prefix:
                    loser[node] = now
                    now = other
                    prefix, common[node] = common[node], prefix
                elif common[node] == prefix:
                    first, known = less(now, other, prefix)
                    if first:
                        common[node] = known
                    else:
                        loser[node] = now
                        now = other
                        common[node] = known
            node //= 2
        best = now
    return np.array(order_run, np.int64), np.array(order_at, np.int64), np.array(order_shared, np.int64)


def repeats(gram_new: np.ndarray, right, right_size, left, left_size, ids, keys, times, first_place, place) -> pa.RecordBatch:
    """Windows of a merged suffix array that occur in an earlier document; gram_new marks where the first letter changes. A suffix has times places in place, from first_place on."""
    rank = np.lexsort((keys, ids))
    group = np.cumsum(gram_new)[rank].astype(np.uint64)
    right, right_size, left, left_size, ids, keys, times, first_place = (x[rank] for x in (right, right_size, left, left_size, ids, keys, times, first_place))
    n = len(ids)
    factor = np.uint64(textscan.BASE)
    before, after = np.zeros((n, SPAN), np.uint64), np.zeros((n, SPAN), np.uint64)
    for c in range(CONTEXT):
        before[:, c + 1] = textscan.mix(before[:, c] * factor + left[:, c])
        after[:, c + 1] = textscan.mix(after[:, c] * factor + right[:, c])
    back = np.arange(SPAN)  # words of the window before the anchor
    key = textscan.mix(before + textscan.mix(after[:, ::-1] + (group * np.uint64(64))[:, None] + back.astype(np.uint64)[None, :]))
    # a window with `back` words before has CONTEXT - back after; only those of which the anchor is the anchor are there
    there = (back[None, :] <= left_size[:, None]) & (CONTEXT - back[None, :] <= right_size[:, None])
    row, column = np.nonzero(there)
    k = key[row, column]
    order = np.argsort(k, kind="stable")
    k, row, column = k[order], row[order], column[order]
    head = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, np.bool_)
    of = row[np.flatnonzero(head)][np.cumsum(head) - 1] if len(k) else row
    repeat = ~head & ((ids[row] != ids[of]) | (keys[row] != keys[of]))
    row, column, of = row[repeat], column[repeat], of[repeat]
    if not len(row):
        return batch(SPAN_ROW, *(np.zeros(0, np.int64) for _ in range(5)))
    # a suffix's windows at each of its places
    each = times[row]
    where = ragged(place, first_place[row], each).astype(np.int64)
    row, column, of = np.repeat(row, each), np.repeat(column, each), np.repeat(of, each)
    order = np.lexsort((-column, where, row))
    row, column, where, first = row[order], column[order], where[order], ids[of[order]]
    start = where - column
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (first[1:] != first[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return batch(SPAN_ROW, ids[row[new]], keys[row[new]], start[new].astype(np.int32), (start[last] + LENGTH).astype(np.int32), first[new])


def merge_range(table: pa.Table) -> pa.Table:
    """Repeats of one range of first letters."""
    runs = [decode(x.as_py()) for x in combined(table["piece"])]
    run, at, shared = merge([(r[0], r[1], r[8]) for r in runs])
    base = np.concatenate(([0], np.cumsum([len(r[0]) for r in runs])[:-1]))
    order = base[run] + at
    columns = [np.concatenate([r[i] for r in runs]) for i in (1, 2, 3, 4, 5, 6, 7)]
    columns.append(np.cumsum(columns[-1]) - columns[-1])
    place = np.concatenate([r[9] for r in runs])
    del runs
    new = shared == 0
    # blocks of whole grams, so that the windows of only some suffixes are spread out at a time
    heads = np.append(np.flatnonzero(new), len(order))
    found, at = [], 0
    while at < len(order):
        to = int(heads[max(np.searchsorted(heads, at + BLOCK, "right") - 1, np.searchsorted(heads, at, "right"))])
        found.append(repeats(new[at:to], *(c[order[at:to]] for c in columns), place))
        at = to
    return pa.Table.from_batches(found, schema=SPAN_ROW)


def keyed_spans(docs: DataFrame, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """spans() with row, the key of the row's doc_id and text."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(docs).alias("row")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = arrow_map(own.select("text", "row"), find_anchors, "gram long, row long, word int")
    # a gram is there twice if its neighbour in the order of grams is the same: no group is held, however large
    w = Window.partitionBy("gram").orderBy("gram")
    twice = found.withColumn("n", F.coalesce(F.lag("gram").over(w), F.lead("gram").over(w))).filter("n IS NOT NULL").drop("n")
    lived = cut(twice.groupBy("row").agg(F.collect_set("word").alias("words")))
    sums = lived.agg(F.sum(F.size("words") * 4 + 48).alias("b"), F.sum(F.size("words")).alias("n")).first()
    side = F.broadcast(lived) if (sums.b or 0) <= BROADCAST_BYTES else lived.hint("shuffle_hash")
    ranges = max(1, -(-(sums.n or 0) // range_rows))
    pieces = cut(arrow_map(own.join(side, "row"), lambda b: make_runs(ranges, run_rows, b), "range int, piece binary"))
    rows = pieces.filter(F.col("range") != LOCAL).groupBy("range").applyInArrow(merge_range, SPAN_DDL)
    rows = rows.unionByName(arrow_map(pieces.filter(F.col("range") == LOCAL), local_spans, SPAN_DDL))
    w = Window.partitionBy("doc_id", "row").orderBy("start", "stop")
    island = rows.withColumn("reach", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    island = island.withColumn("island", F.sum(F.when(F.col("start") > F.coalesce("reach", F.lit(-1)), 1).otherwise(0)).over(w))
    out = island.groupBy("doc_id", "row", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"))
    return out.select("doc_id", "row", "start", "stop", (F.col("stop") - F.col("start")).alias("words"), "first_doc_ids")


def spans(docs: DataFrame, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, start, stop, words, first_doc_ids): passages, as ranges of word numbers, that repeat an earlier one.

    Every window of LENGTH words whose first occurrence, by doc_id, is in another document is covered; first_doc_ids
    lists documents that hold an earlier occurrence (the first of the run or of all). What a document repeats of itself
    alone does not count. Words stand between white space and are compared without case and punctuation. Null or empty texts and texts of less
    than LENGTH words have none; rows with a null doc_id are left out; rows that agree in doc_id and text count once;
    rows of one doc_id with different texts are documents of their own, told apart by a hash, each with its own
    passages. An empty table gives an empty result. Texts are used whole. Columns other than doc_id and text are not
    looked at.
    """
    return keyed_spans(docs, run_rows, range_rows).drop("row")


def strip(column: pa.Array, lists: pa.Array, spaced: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Texts without the ranges of words (of scan()'s kind) listed (structs of start and stop, in order; they may overlap or nest), and whether any word is left."""
    out, left = column.to_pylist(), np.ones(len(column), np.bool_)
    touched = [i for i, x in enumerate(lists.to_pylist()) if x]
    for i in touched:
        words = textscan.scan(column.slice(i, 1), hashes=False, spaced=spaced)
        data, at, parts = words.data.tobytes(), 0, []
        n = len(words.start)
        for x in lists[i].as_py():
            a, b = min(x["start"], n), min(x["stop"], n)
            if a < b:
                parts.append(data[at : words.start[a]])
                at = max(at, int(words.end[b - 1]))
        parts.append(data[at:])
        out[i] = b"".join(parts).decode("utf-8", "replace")
        left[i] = len(textscan.scan(pa.array([out[i]], pa.large_string()), hashes=False).start) > 0
    return pa.array(out, pa.large_string()), left


def remove_ranges(docs: DataFrame, ranges: DataFrame, spaced: bool = False) -> DataFrame:
    """docs without the word ranges (doc_id, row, start, stop) of ranges; n_chars, where there is one, follows the text.

    Words are those of textscan.scan(spaced=spaced). row is row_key() of the row that a range belongs to, so that rows which share a doc_id lose only their own ranges.
    A document of which no word is left goes; all others stay. Rows with a null doc_id stay as they are. Columns of
    docs may have any names.
    """
    doc, row, held = unused(docs, "__doc", "__row", "__ranges")
    listed = cut(ranges.groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(held)))
    size = listed.agg(F.sum(F.size(held) * 16 + 56).alias("b")).first().b or 0
    side = F.broadcast(listed) if size <= BROADCAST_BYTES else listed
    names = docs.columns
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            lists = combined(got[len(names)])
            columns = [got[i] for i in range(len(names))]
            touched = lists.is_valid().to_numpy(zero_copy_only=False)
            left = np.ones(got.num_rows, np.bool_)
            if touched.any():
                i = names.index("text")
                mask = pa.array(touched)
                text, some = strip(textscan.strings(columns[i].filter(mask), lower=False), lists.filter(mask), spaced)
                left[touched] = some
                columns[i] = pc.replace_with_mask(columns[i], mask, text.cast(columns[i].type))
                if "n_chars" in names:
                    j = names.index("n_chars")
                    columns[j] = pc.replace_with_mask(columns[j], mask, pc.utf8_length(text).cast(columns[j].type))
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(left))

    joined = docs.join(side, (docs["doc_id"].cast("long") == side[doc]) & (row_key(docs) == side[row]), "left").drop(doc, row)
    return arrow_map(joined, run, kinds)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without the passages that spans() finds: the first occurrence of each stays. See spans and remove_ranges for the special cases."""
    return remove_ranges(docs, keyed_spans(docs), spaced=True)
