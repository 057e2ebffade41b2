"""Language identification by a string kernel.

The kernel is the blended-spectrum presence kernel: k(x, y) = |S(x) & S(y)| / sqrt(|S(x)| |S(y)|), S being the set
of n-grams, n = 1 .. 3, of the bytes of the lower-cased UTF-8 text in which digits are one sign and all ASCII characters
but letters and digits another. It is exact: no gram is hashed or left out. Classifiers are one-versus-rest kernel
ridge regressions on Nystroem features of landmark documents. Grams of no landmark count in |S(x)| and nowhere else, so
a batch is scored by two matrix products: presence of the landmarks' grams by landmarks, and that by weights.

A text that is in none of the languages has low scores for all, but so have short texts in one of them. The best score
must therefore reach a floor that depends on the number of distinct grams of the text. Floors are set on labelled rows
that the scoring model has not seen (each half of the sample is scored by a model of the other half), taken whole and
cut to their first words, so that at most LOST of the rows that are rightly recognised fall below, and go no higher
than HIGHEST, which random strings and unseen languages seldom reach, so that little else is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quernstone.llm import textscan
from quernstone.llm.common import arrow_map, batch, row_key

#: Rows of one presence matrix.
BLOCK = 192
#: Share of the held-out rows, at each size, that floors may reject, the highest floor, and the fewest held-out texts that set one.
LOST = 0.005
HIGHEST = 0.05
FLOOR_ROWS = 50
#: Distinct grams at which the floor changes, and the beginnings (words) of the held-out rows that set floors of small sizes.
SIZES = np.array([48, 64, 96, 128, 192, 256, 384, 512, 768, 1024])
BEGINNINGS = (5, 10, 20, 40)

#: Signs: 0 other ASCII, 1-26 letters, 27 digits, 28-155 bytes of other characters, END after a text.
CLASS = np.zeros(256, np.uint32)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
    CLASS[_c] = _i + 1
    CLASS[_c - 32] = _i + 1
for _c in b"0123456789":
    CLASS[_c] = 27
CLASS[128:] = 28 + np.arange(128)
END = 156
M = END + 1
#: Codes of grams: 3-grams, then 2-grams, then single signs.
CODES = M**3 + M**2 + M


@dataclass
class Model:
    """languages in order; codes of the landmarks' grams (sorted); landmarks (codes x landmarks) scaled by their norms; weights (landmarks x languages); floors of the best score, by range of SIZES."""

    languages: list[str]
    codes: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    floors: np.ndarray

    @cached_property
    def column(self) -> np.ndarray:
        """The row of landmarks of each code, or -1."""
        out = np.full(CODES, -1, np.int32)
        out[self.codes] = np.arange(len(self.codes))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "column"}


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct grams of each text of a large_string array of at most 1,024 rows.

    3-grams are sorted by row and signs, the last of a text being filled up by END; equal beginnings of neighbours give
    the distinct 2-grams and single signs.
    """
    data, offsets = textscan.raw(column)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint32), np.diff(offsets))
    place = np.arange(len(data)) + 2 * row.astype(np.int64)
    c = np.full(len(data) + 2 * (len(offsets) - 1), END, np.uint32)
    c[place] = CLASS[data]
    key = ((row * np.uint32(M) + c[place]) * np.uint32(M) + c[place + 1]) * np.uint32(M) + c[place + 2]
    key.sort()

    def distinct(x: np.ndarray) -> np.ndarray:
        return x[np.append(True, x[1:] != x[:-1])] if len(x) else x

    three = distinct(key)
    two = distinct(three // np.uint32(M))
    one = distinct(two // np.uint32(M))
    three, two = three[three % np.uint32(M) != END], two[two % np.uint32(M) != END]
    row = np.concatenate([three // np.uint32(M**3), two // np.uint32(M**2), one // np.uint32(M)]).astype(np.int64)
    return row, np.concatenate([three % np.uint32(M**3), M**3 + two % np.uint32(M**2), M**3 + M**2 + one % np.uint32(M)]).astype(np.int64)


def kernel(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Kernel of each text against the landmarks, and its number of distinct grams."""
    row, code = grams(column)
    size = np.bincount(row, minlength=len(column)).astype(np.float32)
    at = model.column[code]
    there = np.zeros((len(column), len(model.codes)), np.float32)
    there[row[at >= 0], at[at >= 0]] = 1
    return (there @ model.landmarks) / np.sqrt(np.maximum(size, 1))[:, None], size


def fit(texts: list[str], languages: list[str], landmarks: int = 128, ridge: float = 0.05) -> Model:
    """Fit on labelled texts; every k-th text of each language is a landmark. Floors are those of calibrate()."""
    model = fit_weights(texts, languages, landmarks, ridge)
    model.floors = calibrate(texts, languages, landmarks, ridge)
    return model


def calibrate(texts: list[str], languages: list[str], landmarks: int, ridge: float) -> np.ndarray:
    """Floors by range of SIZES, not decreasing; without enough held-out texts of a range or a smaller one, minus infinity."""
    order = sorted(range(len(texts)), key=lambda i: (languages[i], i))
    best, size = [np.zeros(0)], [np.zeros(0)]
    for one, two in ((order[::2], order[1::2]), (order[1::2], order[::2])):
        if not one or not two:
            continue
        model = fit_weights([texts[i] for i in one], [languages[i] for i in one], landmarks, ridge)
        own = np.array([languages[i] for i in two])
        for words in (None, *BEGINNINGS):
            cut = [texts[i] if words is None else " ".join(texts[i].split(None, words)[:words]) for i in two]
            scores, grams = score(textscan.strings(pa.array(cut, pa.large_string())), model)
            right = np.array(model.languages)[scores.argmax(1)] == own
            best.append(scores.max(1)[right])
            size.append(grams[right])
    best, at = np.concatenate(best), np.searchsorted(SIZES, np.concatenate(size), "right")
    floors = [np.quantile(best[at == k], LOST, method="lower") if (at == k).sum() >= FLOOR_ROWS else -np.inf for k in range(len(SIZES) + 1)]
    return np.minimum(np.maximum.accumulate(np.array(floors, np.float64)), HIGHEST)


def fit_weights(texts: list[str], languages: list[str], landmarks: int, ridge: float) -> Model:
    """Model without floors."""
    names = sorted(set(languages))
    none = np.full(len(SIZES) + 1, -np.inf)
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), none)
    order = sorted(range(len(texts)), key=lambda i: (languages[i], i))
    chosen = order[:: max(1, -(-len(order) // landmarks))]
    column = textscan.strings(pa.array(texts, pa.large_string()))
    own = [grams(column.slice(i, 1))[1] for i in chosen]
    codes = np.unique(np.concatenate(own))
    base = np.zeros((len(codes), len(chosen)), np.float32)
    for j, code in enumerate(own):
        base[np.searchsorted(codes, code), j] = 1 / np.sqrt(max(len(code), 1))
    model = Model(names, codes, base, np.zeros((len(chosen), len(names)), np.float32), none)
    rows = np.concatenate([kernel(column.slice(i, min(BLOCK, len(texts) - i)), model)[0] for i in range(0, len(texts), BLOCK)]).astype(np.float64)
    values, vectors = np.linalg.eigh((base.T @ base).astype(np.float64))
    root = vectors * np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0) @ vectors.T
    features = rows @ root
    truth = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ truth)
    model.weights = (root @ solved).astype(np.float32)
    return model


def score(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest scores (rows x languages), and the number of distinct grams of each row."""
    found, sizes = [np.zeros((0, len(model.languages)), np.float32)], [np.zeros(0, np.float32)]
    for i in range(0, len(column), BLOCK):
        block = column.slice(i, min(BLOCK, len(column) - i))
        for a, b in textscan.pieces(block):
            near, size = kernel(block.slice(a, b - a), model)
            found.append(near @ model.weights)
            sizes.append(size)
    return np.concatenate(found), np.concatenate(sizes)


def decide(column: pa.Array, model: Model, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language (index), margin to the second, and whether the text is accepted."""
    scores, size = score(column, model)
    data, offsets = textscan.raw(column)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(textscan.WORD[data] & ((data < 48) | (data > 57)), out=letters[1:])
    lettered = letters[offsets[1:]] > letters[offsets[:-1]]
    ranked = np.sort(scores, 1)
    margin = ranked[:, -1] - ranked[:, -2] if scores.shape[1] > 1 else ranked[:, -1]
    known = ranked[:, -1] >= model.floors[np.searchsorted(SIZES, size, "right")]
    return scores.argmax(1), margin, lettered & known & (margin >= least)


def shares(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows of each language in a sample of at most `rows`: a quarter of the sample in equal parts, so that a rare language is learnt too, the rest in proportion."""
    total = sum(counts.values())
    if total <= rows:
        return dict(counts)
    least = max(1, rows // (4 * len(counts)))
    out = {k: min(n, least) for k, n in counts.items()}
    left = rows - sum(out.values())
    part = {k: left * (counts[k] - out[k]) / max(1, total - sum(out.values())) for k in counts}
    over = left - sum(int(x) for x in part.values())
    first = sorted(part, key=lambda k: (int(part[k]) - part[k], k))[:over]
    return {k: out[k] + int(part[k]) + (k in first) for k in counts}


def labelled(docs: DataFrame, rows: int) -> tuple[list[str], ...]:
    """Texts and languages of at most rows labelled documents of the whole table.

    Each language has its share (where there are more languages than rows, the most frequent have); of a language those documents are taken whose doc_id and text have the least hash.
    """
    spark = docs.sparkSession
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    found = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    count = {r.lang: r.n for r in found}
    want = shares(count, rows)
    part = {k: min(1.0, (2 * w + 32) / count[k]) for k, w in want.items()}
    out: dict[str, list[str]] = {}
    while want:
        # only rows with hashes below a bound that some twice the wanted rows reach are ranked
        side = spark.createDataFrame([(k, float(part[k]), w) for k, w in want.items()], "__lang string, __part double, __want long")
        low = known.select("lang", "text", row_key(known).alias("__h")).join(F.broadcast(side), F.col("lang") == F.col("__lang"))
        low = low.filter(F.shiftrightunsigned("__h", 1) / float(1 << 63) < F.col("__part")).dropDuplicates(["lang", "__h"])
        ranked = low.withColumn("__i", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("__h", 1), "__h"))).filter("__i <= __want")
        got: dict[str, list[str]] = {}
        for r in sorted(ranked.select("lang", "__i", "text").collect()):
            got.setdefault(r.lang, []).append(r.text)
        done = {k for k, w in want.items() if len(got.get(k, [])) >= w or part[k] >= 1}
        out |= {k: got.get(k, []) for k in done}
        want = {k: w for k, w in want.items() if k not in done}
        part = {k: min(1.0, 8 * p) for k, p in part.items()}
    return [t for k in sorted(out) for t in out[k]], [k for k in sorted(out) for _ in out[k]]


def train(docs: DataFrame, sample_rows: int = 1024, landmarks: int = 128) -> Model:
    """Model of the table's own lang labels; sample_rows bounds the labelled rows that are used."""
    return fit(*labelled(docs, sample_rows), landmarks=landmarks)


RESULT = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("margin", pa.float64()), ("keep", pa.bool_())])


def identify(docs: DataFrame, model: Model | None = None, least: float = 0.02, sample_rows: int = 1024) -> DataFrame:
    """(doc_id, lang, margin, keep) for every row of docs.

    keep is false if the text has no letter, the best score leads the second by less than least, or it is below the
    floor for texts of that size (the text is in none of the languages). Floors need some 50 labelled rows; with less,
    and for texts of a few words, unseen languages cannot be told apart and may be kept. Null text counts
    as empty; empty text has lang null and is not kept. A null doc_id is passed through. Repeated rows get one row
    each. Without any labelled row nothing can be told apart: lang is null and every row is kept. Texts of any
    length are used whole. Columns other than doc_id, text and lang are not looked at.
    """
    model = train(docs, sample_rows) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            column = textscan.strings(got["text"])
            n = len(column)
            if not model.languages:
                yield batch(RESULT, got["doc_id"], pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), np.ones(n, np.bool_))
                continue
            best, margin, keep = decide(column, model, least)
            filled = np.diff(textscan.raw(column)[1]) > 0
            names = pa.array(np.array(model.languages, object)[best], pa.string(), mask=~filled)
            yield batch(RESULT, got["doc_id"], names, np.round(margin.astype(np.float64), 5), keep)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang string, margin double, keep boolean")


def keep_identified(docs: DataFrame, model: Model | None = None, least: float = 0.02, sample_rows: int = 1024) -> DataFrame:
    """Rows of docs that identify() keeps, all columns unchanged, in one pass without a shuffle."""
    model = train(docs, sample_rows) if model is None else model
    if not model.languages:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            yield got.filter(pa.array(decide(textscan.strings(got["text"]), model, least)[2]))

    return arrow_map(docs, run, docs.schema)
