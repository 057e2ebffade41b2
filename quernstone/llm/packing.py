"""Packing of tokenised documents into training sequences by large-item matching.

Lengths are token counts of a public byte-level BPE vocabulary. A document longer than the capacity is cut into full
sequences and a rest. In each shard, pieces above a third of the capacity are matched: taken from the longest on,
each gets the longest other such piece that still fits beside it, so that no sequence holds more than two of them.
The smaller pieces, longest first, then go to the sequence with the least gap that holds them, or to a new one.

A shard is a random part of the corpus of SHARD_TOKENS tokens on average; only lengths are shuffled to it. Each
shard wastes at most a few sequences more than packing all at once would.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quernstone.llm import textscan
from quernstone.llm.common import arrow_map, batch
from quernstone.session import cut, ship

CAPACITY = 2048
SHARD_TOKENS = 64_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that, next to a single space, the pre-tokeniser may join to it.
BLANK = r"[\s\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text whose distinct pieces are encoded at a time.
CHUNK = 4 << 20


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary's encoder, once per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each token."""
    own = encoder(path)
    return np.array([len(own.decode_single_token_bytes(i)) for i in range(own.max_token_value + 1)], np.int64)


def piece_counts(words: pa.Array, path: str) -> np.ndarray:
    """Token counts of " " + word for each of a large_string array: one call encodes all words that neither begin nor end with white space."""
    own = encoder(path)
    edged = pc.match_substring_regex(words, f"^{BLANK}|{BLANK}$|^$").to_numpy(zero_copy_only=False)
    out = np.zeros(len(words), np.int64)
    for i in np.flatnonzero(edged).tolist():
        out[i] = len(own.encode_ordinary(" " + words[i].as_py()))
    plain = words.filter(pa.array(~edged))
    if len(plain):
        data, offsets = textscan.raw(plain)
        size = np.diff(offsets)
        ends = np.cumsum(size + 1)
        joined = np.full(int(ends[-1]), 32, np.uint8)
        joined[np.arange(len(data)) + np.repeat(np.arange(1, len(size) + 1), size)] = data
        tokens = own.encode_to_numpy(joined.tobytes().decode(), disallowed_special=())
        upto = np.searchsorted(np.cumsum(token_bytes(path)[tokens]), ends, "left") + 1  # tokens up to each word's end
        out[~edged] = np.diff(np.append(0, upto))
    return out


def token_counts(column: pa.Array, path: str = VOCABULARY) -> np.ndarray:
    """Exact token counts of a large_string array.

    The pre-tokeniser never joins a single space to what stands before it unless there is white space on both of its
    sides, so any other text is the sum of its space-separated pieces, which are counted once for each distinct piece.
    Texts with such spaces are encoded whole.
    """
    encode = encoder(path).encode_ordinary
    joined = pc.match_substring_regex(column, f"  |{BLANK} {BLANK}").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(column, " ")
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy()
    size = piece_counts(words, path)
    total = np.zeros(len(coded) + 1, np.int64)
    np.cumsum(size[at], out=total[1:])
    out = total[offsets[1:]] - total[offsets[:-1]]
    first, which = np.unique(at[offsets[:-1]], return_inverse=True)  # the first piece has no space before it
    out += (np.array([len(encode(words[i].as_py())) for i in first.tolist()], np.int64) - size[first])[which]
    for i in np.flatnonzero(joined).tolist():
        out[i] = len(encode(column[i].as_py()))
    return out


COUNTED = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])


def lengths(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) for every row. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            column = textscan.strings(got["text"], lower=False)
            for a, b in textscan.pieces(column, CHUNK):
                yield batch(COUNTED, got["doc_id"].slice(a, b - a), token_counts(column.slice(a, b - a), path))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, tokens long")


def pack(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece (1 .. capacity long), ties in the order given."""
    order = np.argsort(-size, kind="stable")
    number, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]  # large pieces, by length
    mask = 0  # lengths of which there are any
    ranked = size[order].tolist()
    order = order.tolist()
    large = 0
    while large < len(ranked) and 3 * ranked[large] > capacity:
        large += 1
    for i in range(large - 1, -1, -1):
        held[ranked[i]].append(order[i])
        mask |= 1 << ranked[i]
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    used = 0

    def leave(gap: int, which: int) -> None:
        nonlocal open_
        if gap:
            gaps[gap].append(which)
            open_ |= 1 << gap

    while mask:
        most = mask.bit_length() - 1
        i = held[most].pop()
        if not held[most]:
            mask &= ~(1 << most)
        number[i], gap = used, capacity - most
        fits = mask & ((1 << (gap + 1)) - 1)
        if fits:
            other = fits.bit_length() - 1
            j = held[other].pop()
            if not held[other]:
                mask &= ~(1 << other)
            number[j], offset[j], gap = used, most, gap - other
        leave(gap, used)
        used += 1
    for i, s in zip(order[large:], ranked[large:]):
        fits = open_ >> s
        if fits:
            gap = s + (fits & -fits).bit_length() - 1
            which = gaps[gap].pop()
            if not gaps[gap]:
                open_ &= ~(1 << gap)
        else:
            gap, which = capacity, used
            used += 1
        number[i], offset[i] = which, capacity - gap
        leave(gap - s, which)
    return number, offset


PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64()), ("tokens", pa.int64())])


def pack_shard(capacity: int, table: pa.Table) -> pa.Table:
    """Pieces of one shard with their sequences; the shard's number is the high part of the sequence's."""
    table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending")])
    ids, tokens = table["doc_id"].to_numpy(), table["tokens"].to_numpy()
    count = -(-tokens // capacity)
    row = np.repeat(np.arange(len(ids)), count)
    piece = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count) if len(row) else row
    size = np.minimum(capacity, tokens[row] - piece * capacity)
    number, offset = pack(size, capacity)
    shard = int(table["shard"][0].as_py())
    return pa.Table.from_batches([batch(PACKED, ids[row], piece, number + (shard << 32), offset, size)])


def assign(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, sequence, offset, tokens): the place of every piece of every document.

    Pieces of a document are numbered from 0 and are capacity tokens long but for the last; a sequence's pieces do
    not overlap and end within capacity. Rows without tokens (null or empty text) and rows with a null doc_id have no
    piece. Repeated rows are packed each. Ties go to the least doc_id. An empty table gives an empty result. Texts of
    any length are used whole. Columns other than doc_id and text are not looked at.
    """
    ship(docs.sparkSession)
    counted = cut(lengths(docs.filter("doc_id IS NOT NULL"), path).filter("tokens > 0"))
    total = counted.agg(F.sum("tokens").alias("n")).first().n or 0
    shards = max(1, -(-total // shard_tokens))
    sharded = counted.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(lambda t: pack_shard(capacity, t), "doc_id long, piece long, sequence long, offset long, tokens long")


def available(path: str = VOCABULARY) -> bool:
    """Whether the vocabulary file and its library are there."""
    return Path(path).exists() and importlib.util.find_spec("tiktoken") is not None
