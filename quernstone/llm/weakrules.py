"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The votes' joint counts over all documents feed an
expectation-maximisation of a two-class model with independent rules: class shares, and for each rule the chance of a
good vote given the class, where it votes. An abstention says nothing of the class. The posterior probability of good
replaces the demand that all rules pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernstone.llm import textscan
from quernstone.llm.common import arrow_map, batch, segment_sum
from quernstone.session import cut

STOPWORDS = "the of and to in is was that for with on as are be this by from at der die das und ein eine nicht mit von den le la les des et en une dans qui que pour el los las una por con para del".split()
RULES = ("symbols", "capitals", "echoes", "word_length", "stopwords", "line_ends", "variety", "letters", "length", "same_lines")
ROUNDS = 200
#: Pseudo-counts per vote, so that no chance becomes 0.
SMOOTH = 1.0

_PUNCT = np.zeros(256, np.bool_)
for _c in range(33, 127):
    _PUNCT[_c] = not chr(_c).isalnum()
_PLAIN = _PUNCT.copy()
for _c in b".,;:!?'\"()-":
    _PLAIN[_c] = False


def _stop_hashes() -> np.ndarray:
    return np.sort(textscan.scan(textscan.strings(pa.array([" ".join(STOPWORDS)], pa.large_string()))).hash)


def judged(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def votes(plain: pa.Array, stop: np.ndarray) -> np.ndarray:
    """(documents x rules) of a large_string array. A document without words abstains everywhere but on length."""
    words = textscan.scan(textscan.strings(plain))
    data, offsets = textscan.raw(plain)
    rows = len(offsets) - 1
    n = np.diff(words.ptr)
    filled = n > 0
    least = np.maximum(n, 1)
    visible = segment_sum(data > 32, offsets)
    upper = segment_sum((data >= 65) & (data <= 90), offsets)
    lower = segment_sum((data >= 97) & (data <= 122), offsets)
    odd = segment_sum(_PLAIN[data], offsets)
    marks = segment_sum(_PUNCT[data], offsets)
    size = segment_sum(words.end - words.start, words.ptr)
    echo = np.zeros(len(words.hash), np.bool_)
    echo[1:] = words.hash[1:] == words.hash[:-1]
    echo[words.ptr[:-1][filled]] = False
    echoes = segment_sum(echo, words.ptr) / least
    found = stop[np.minimum(np.searchsorted(stop, words.hash), len(stop) - 1)] == words.hash
    stops = segment_sum(found, words.ptr) / least
    key = (words.docs.astype(np.uint64) << np.uint64(44)) | (words.hash >> np.uint64(20))
    key.sort()
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, np.bool_)
    variety = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=rows) / least
    # lines: ends before a line break and at the end of the text
    breaks = np.flatnonzero(data == 10)
    edge = np.sort(np.concatenate([breaks, offsets[1:][np.diff(offsets) > 0]]))
    doc = np.minimum(np.searchsorted(offsets, edge - 1, "right") - 1, rows - 1)
    begin = np.empty(len(edge), np.int64)
    if len(edge):
        begin[0] = 0
        begin[1:] = edge[:-1] + (data[np.minimum(edge[:-1], len(data) - 1)] == 10)
        begin = np.maximum(begin, offsets[doc])
    full = edge > begin
    edge, begin, doc = edge[full], begin[full], doc[full]
    lines = np.bincount(doc, minlength=rows)
    closed = np.bincount(doc, np.isin(data[edge - 1], np.frombuffer(b".!?:\"')", np.uint8)) if len(edge) else None, minlength=rows)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * textscan.powers(textscan.BASE, len(data))[: len(data)], out=total[1:])
    line = textscan.mix((total[edge] - total[begin]) * textscan.powers(textscan.INVERSE, len(data) + 1)[begin])
    mark = (doc.astype(np.uint64) << np.uint64(44)) | (line >> np.uint64(20))
    mark.sort()
    kinds = np.bincount((mark[np.append(True, mark[1:] != mark[:-1])] >> np.uint64(44)).astype(np.int64), minlength=rows) if len(mark) else np.zeros(rows, np.int64)
    same = 1 - kinds / np.maximum(lines, 1)
    capital = upper / np.maximum(upper + lower, 1)
    mean = size / least
    alpha = 1 - marks / np.maximum(visible, 1)
    ends = closed / np.maximum(lines, 1)
    few, many = n < 20, n >= 50
    ruled = [
        judged(odd, odd <= 0.05 * n, odd > 0.3 * n),
        judged(capital, capital < 0.2, capital > 0.5),
        judged(echoes, echoes < 0.05, echoes > 0.2),
        judged(mean, (mean > 2.5) & (mean < 9), (mean < 2) | (mean > 12)),
        judged(stops, stops > 0.1, (stops < 0.02) & ~few),
        judged(ends, ends > 0.5, (ends < 0.1) & (lines > 2)),
        judged(variety, (variety > 0.3) | few, (variety < 0.15) & many),
        judged(alpha, alpha > 0.9, alpha < 0.75),
        judged(n, n >= 20, n < 3),
        judged(same, (same == 0) & (lines > 1), same > 0.3),
    ]
    out = np.stack(ruled, 1)
    out[~filled] = 0
    out[~filled, RULES.index("length")] = -1
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, and each rule's accuracy where it votes.

    Starts from the share of good among the votes cast. A tie between classes in naming is settled by that start.
    """
    cast = np.abs(patterns).sum(1)
    good = np.where(cast > 0, (patterns > 0).sum(1) / np.maximum(cast, 1), 0.5)
    good = np.clip(good, 0.05, 0.95)
    hot = np.stack([patterns == v for v in (-1, 1)], 2).astype(np.float64)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good], 1)
        share = (weight.sum(0) + SMOOTH) / (weight.sum() + 2 * SMOOTH)
        chance = np.einsum("pc,prv->rvc", weight, hot) + SMOOTH
        chance /= chance.sum(1, keepdims=True)
        log = np.einsum("prv,rvc->pc", hot, np.log(chance)) + np.log(share)
        following = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        moved = np.abs(following - good).max(initial=0)
        good = following
        if moved < 1e-9:
            break
    right = np.einsum("pr,p->r", patterns > 0, counts * good) + np.einsum("pr,p->r", patterns < 0, counts * (1 - good))
    made = (np.abs(patterns) * counts[:, None]).sum(0)
    return good, np.where(made > 0, right / np.maximum(made, 1), np.nan)


RESULT = pa.schema([("doc_id", pa.int64()), ("code", pa.int32())])
POWERS = 3 ** np.arange(len(RULES))


def vote_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, code) for every row: the votes as digits 0, 1, 2 of a number to base 3."""
    stop = _stop_hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            plain = textscan.strings(got["text"], lower=False)
            for a, b in textscan.pieces(plain):
                yield batch(RESULT, got["doc_id"].slice(a, b - a), ((votes(plain.slice(a, b - a), stop) + 1) @ POWERS).astype(np.int32))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, code int")


def patterns_of(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // POWERS[None, :] % 3 - 1


def fitted(coded: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, posterior of good of each, accuracy of each rule) from vote_codes()."""
    table = sorted((r.code, r.n) for r in coded.groupBy("code").agg(F.count("*").alias("n")).collect())
    codes = np.array([c for c, _ in table], np.int64)
    return codes, *estimate(patterns_of(codes), np.array([n for _, n in table], np.float64))


def accuracies(docs: DataFrame) -> DataFrame:
    """(rule, accuracy): how often each rule is right where it votes, by the fitted model; null for a rule that never votes."""
    _, _, found = fitted(vote_codes(docs))
    return docs.sparkSession.createDataFrame([(n, None if np.isnan(x) else round(float(x), 6)) for n, x in zip(RULES, found)], "rule string, accuracy double")


def score(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, good_votes, bad_votes, posterior, keep) for every row; keep where the posterior reaches least. accuracies() gives the rules' own.

    Null text counts as empty; a text without words votes bad on length and abstains otherwise. Repeated rows count
    and are returned each. An empty table gives an empty result. Only the counts of vote patterns (at most
    3 ** len(RULES), whatever the size of the table) come to the driver. Texts are used whole. Columns other than
    doc_id and text are not looked at.
    """
    coded = cut(vote_codes(docs))
    codes, posterior, _ = fitted(coded)
    patterns = patterns_of(codes)
    rows = [(int(c), int((p > 0).sum()), int((p < 0).sum()), round(float(g), 6), bool(g >= least)) for c, p, g in zip(codes, patterns, posterior)]
    side = docs.sparkSession.createDataFrame(rows, "code int, good_votes int, bad_votes int, posterior double, keep boolean")
    return coded.join(F.broadcast(side), "code").select("doc_id", "good_votes", "bad_votes", "posterior", "keep")
