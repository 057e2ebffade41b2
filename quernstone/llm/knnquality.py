"""Quality classification by nearest-neighbour voting in a latent semantic space.

Terms are hashed stems (first STEM bytes) of lower-case words, punctuation characters, and three signs of form: capitals, words that repeat
the one before, and lines. A bounded sample of labelled documents (SAMPLE_ROWS) gives document
frequencies and, by a truncated singular value decomposition of its tf-idf matrix, a projection of terms to RANK
dimensions; the sample's own vectors are the labelled neighbours. Each label has a space of its own, in which
terms weigh by their correlation with it. All is broadcast and of a fixed size. Every
document is projected, multiplied with all labelled vectors (exact cosines, block by block), and its NEIGHBOURS
nearest vote with their similarities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernstone.llm import textscan
from quernstone.llm.common import arrow_map, batch

WORD_BITS = 18
#: Words count by their first bytes, so that forms of a stem are one term.
STEM = 7
SIGNS = 40
#: Documents of the sample that must have a stem for it to be a term: one alone makes nothing alike.
LEAST = 2
#: Stems whose part of the sample's matrix is spread out at a time.
STEMS = 8192
RANK = 64
SAMPLE_ROWS = 1024
NEIGHBOURS = 9
BLOCK = 512
#: Weight of a term that tells nothing of the labels, and how sharply weights rise with correlation.
FLOOR, POWER = 0.02, 2.0

MARK = np.zeros(256, np.int64)
for _i, _c in enumerate(c for c in range(33, 127) if not chr(c).isalnum()):
    MARK[_c] = _i + 1
UPPER, AGAIN, LINE = SIGNS - 3, SIGNS - 2, SIGNS - 1


@dataclass
class Model:
    """A label's space: column (of each hashed stem, -1 if not used), project (SIGNS and stems x RANK, weights included), vectors (labelled x RANK, unit length), labels (0 or 1)."""

    column: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def damp(count: np.ndarray) -> np.ndarray:
    return np.log1p(count.astype(np.float32))


def signs(words: textscan.Words, plain: pa.Array) -> np.ndarray:
    """(documents x SIGNS) counts; plain is the text before lower-casing."""
    data, offsets = textscan.raw(plain)
    rows = len(offsets) - 1
    out = np.zeros((rows, SIGNS), np.float32)
    mark = MARK[data]
    at = np.flatnonzero(mark)
    doc = np.searchsorted(offsets, at, "right") - 1
    np.add.at(out, (doc, mark[at] % (SIGNS - 3)), 1)
    lines = np.flatnonzero(data == 10)
    np.add.at(out[:, LINE], np.searchsorted(offsets, lines, "right") - 1, 1)
    capital = (data >= 65) & (data <= 90)
    pair = capital[1:] & capital[:-1]
    ends = offsets[1:-1]
    pair[ends[(ends > 0) & (ends < len(data))] - 1] = False  # of two texts
    upper = np.flatnonzero(pair)
    np.add.at(out[:, UPPER], np.searchsorted(offsets, upper, "right") - 1, 1)
    if len(words.hash) > 1:
        same = words.hash[1:] == words.hash[:-1]
        first = words.ptr[1:-1]
        same[first[(first > 0) & (first < len(words.hash))] - 1] = False
        again = np.flatnonzero(same) + 1
        np.add.at(out[:, AGAIN], np.searchsorted(words.ptr, again, "right") - 1, 1)
    # these two tell something only where they are a good part of the text
    size = np.diff(words.ptr)
    out[:, AGAIN] *= out[:, AGAIN] > 0.1 * size
    out[:, UPPER] *= out[:, UPPER] > 0.5 * size
    return out


def counts(words: textscan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words by document: (document, term, count)."""
    key = (words.docs << WORD_BITS) | (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(key)))
    return key[new] >> WORD_BITS, key[new] & ((1 << WORD_BITS) - 1), size


@dataclass
class Terms:
    """Terms of a chunk of texts: (document, hashed stem, count) and the signs of each document."""

    doc: np.ndarray
    stem: np.ndarray
    size: np.ndarray
    marks: np.ndarray


def terms(plain: pa.Array) -> Terms:
    words = textscan.scan(textscan.strings(plain), stem=STEM)
    return Terms(*counts(words), signs(words, plain))


def project(found: Terms, model: Model) -> np.ndarray:
    """Unit vectors of a chunk in the model's space (zero for a text without terms)."""
    at = model.column[found.stem]
    doc, at, size = found.doc[at >= 0], at[at >= 0], found.size[at >= 0]
    out = damp(found.marks) @ model.project[:SIGNS]
    if len(doc):
        head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        out[doc[head]] += np.add.reduceat(model.project[at] * damp(size)[:, None], head, axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 0, out / np.maximum(norm, 1e-9), 0).astype(np.float32)


def tell(there: np.ndarray, both: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weight of terms by their correlation (phi) with the label, so that the leading dimensions are those that it depends on. there counts the documents of each term, both those with the label."""
    n, own = len(label), label.sum()
    spread = np.sqrt(np.maximum(there * (n - there) * own * (n - own), 1e-9))
    return ((FLOOR + np.abs(n * both - there * own) / spread) ** POWER).astype(np.float32)


def fit(texts: list[str], label: np.ndarray, rank: int = RANK) -> Model:
    """Model of labelled texts for one label of 0 and 1."""
    plain = textscan.strings(pa.array(texts, pa.large_string()), lower=False)
    n, space = len(texts), 1 << WORD_BITS
    chunks = [(a, terms(plain.slice(a, b - a))) for a, b in textscan.pieces(plain)]
    every = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    doc, stem, size = every(a + c.doc for a, c in chunks), every(c.stem for _, c in chunks), every(c.size for _, c in chunks)
    marks = np.concatenate([np.zeros((0, SIGNS), np.float32), *(c.marks for _, c in chunks)])
    there = np.concatenate([(marks > 0).sum(0), np.bincount(stem, minlength=space)]).astype(np.float64)
    weight = np.log((1 + n) / (1 + there)).astype(np.float32) + np.float32(0.1)
    weight *= tell(there, np.concatenate([label @ (marks > 0), np.bincount(stem, label[doc], minlength=space)]), label) if n else 1
    chosen = np.flatnonzero(there[SIGNS:] >= LEAST)
    column = np.full(space, -1, np.int32)
    column[chosen] = SIGNS + np.arange(len(chosen))
    weight = np.concatenate([weight[:SIGNS], weight[SIGNS + chosen]])
    doc, stem, size = (x[column[stem] >= 0] for x in (doc, stem, size))
    # cells of the sample's matrix by column; it is spread out some columns at a time
    cell = np.concatenate([damp(marks).ravel(), damp(size)]) * np.concatenate([np.tile(weight[:SIGNS], n), weight[column[stem]]])
    where = np.concatenate([np.tile(np.arange(SIGNS), n), column[stem]])
    which = np.concatenate([np.repeat(np.arange(n), SIGNS), doc])
    cell = (cell / np.maximum(np.sqrt(np.bincount(which, cell.astype(np.float64) ** 2, minlength=n)), 1e-9)[which]).astype(np.float32)
    order = np.argsort(where, kind="stable")
    cell, where, which = cell[order], where[order], which[order]

    def blocks() -> Iterator[np.ndarray]:
        for at in range(0, len(weight), STEMS):
            a, b = np.searchsorted(where, [at, at + STEMS])
            rows = np.zeros((n, min(STEMS, len(weight) - at)), np.float32)
            rows[which[a:b], where[a:b] - at] = cell[a:b]
            yield rows

    values, vectors = np.linalg.eigh(sum((rows @ rows.T for rows in blocks()), np.zeros((n, n))).astype(np.float64))
    top = np.argsort(-values)[:rank]
    top = top[values[top] > 1e-9]
    matrix = (weight[:, None] * (np.concatenate([rows.T @ vectors[:, top] for rows in blocks()]) / np.sqrt(values[top]))).astype(np.float32)
    model = Model(column, matrix, np.zeros((0, len(top)), np.float32), label.astype(np.float32))
    model.vectors = np.concatenate([model.vectors, *(project(c, model) for _, c in chunks)])
    return model


def vote(vectors: np.ndarray, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of the label among the nearest; its mean where nothing is similar."""
    out = np.empty(len(vectors))
    k = min(neighbours, len(model.vectors))
    for i in range(0, len(vectors), BLOCK):
        similar = vectors[i : i + BLOCK] @ model.vectors.T
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, near, 1), 0).astype(np.float64)
        total = weight.sum(1)
        out[i : i + BLOCK] = np.where(total > 0, (weight * model.labels[near]).sum(1) / np.maximum(total, 1e-9), model.labels.mean())
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rank: int = RANK) -> tuple[Model, Model]:
    """Models of quality and toxic from the labelled documents with the least hashes, at most sample_rows of them; of the rows of one doc_id the text with the least hash counts."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__q"), F.col("toxic").cast("int").alias("__t"))
    picked = known.orderBy(F.xxhash64("__id"), "__id", "__q", "__t").limit(sample_rows)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("__id", "__q", "__t").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("__id", "text", "__q", "__t").collect()
    rows = sorted(tuple(r) for r in rows)
    texts = [r[1] for r in rows]
    return tuple(fit(texts, np.array([r[i] for r in rows], np.float32), rank) for i in (2, 3))


RESULT = pa.schema([("doc_id", pa.int64()), ("quality", pa.float64()), ("toxic", pa.float64()), ("keep", pa.bool_())])


def classify(docs: DataFrame, labels: DataFrame | None = None, models: tuple[Model, Model] | None = None, least_quality: float = 0.5, most_toxic: float = 0.6) -> DataFrame:
    """(doc_id, quality, toxic, keep) for every row: voted probabilities, and whether the document passes both limits.

    Null text counts as empty; a text without terms gets the mean labels. Without labelled documents both scores are
    null and every row is kept. Repeated rows get a row each; ties among neighbours at the last place are cut by
    position in the sample. Texts are used whole. Columns other than doc_id, text and the labels are not looked at.
    """
    models = train(docs, labels) if models is None else models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            plain = textscan.strings(got["text"], lower=False)
            for a, b in textscan.pieces(plain):
                ids = got["doc_id"].slice(a, b - a)
                if not len(models[0].vectors):
                    yield batch(RESULT, ids, pa.nulls(b - a, pa.float64()), pa.nulls(b - a, pa.float64()), np.ones(b - a, np.bool_))
                    continue
                found = terms(plain.slice(a, b - a))
                quality, toxic = (vote(project(found, m), m) for m in models)
                yield batch(RESULT, ids, np.round(quality, 5), np.round(toxic, 5), (quality >= least_quality) & (toxic <= most_toxic))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, quality double, toxic double, keep boolean")
