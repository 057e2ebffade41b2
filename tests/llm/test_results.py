"""Results against brute force, exact round trips and held-out accuracy, and the queries themselves."""

import base64
import fnmatch
import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import arc2warc, components, decontaminate, kdshard, knnquality, langkernel, packing, queries, simhash, suffixdedup, textscan, urlglob, weakrules
from quernstone.session import table
from tests.llm import brute
from tests.oracle import connect, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
Q = queries.queries()


@pytest.fixture(scope="module")
def rows():
    t = pq.read_table(f"{FOLDER}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="module")
def items():
    t = pq.read_table(f"{FOLDER}/benchmark.parquet")
    return list(zip(t["item_id"].to_pylist(), t["text"].to_pylist()))


def run(spark, name):
    return Q[name](spark, FOLDER)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAbB1 .\n\u00e9\u4e2d\u212a\u00a0\u201c\u3001\u3042\u00aa\uff0c\u2070\U0001f600", max_size=30), max_size=6))
def test_words_and_windows(texts):
    column = textscan.strings(pa.array(texts, pa.large_string()))
    got = textscan.scan(column)
    flat = [w for t in texts for w in brute.words(t)]
    assert [bytes(got.data[a:b]).decode() for a, b in zip(got.start, got.end)] == flat
    assert np.diff(got.ptr).tolist() == [len(brute.words(t)) for t in texts]
    assert len(set(zip(flat, got.hash.tolist()))) == len(set(flat)) == len(set(got.hash.tolist()))
    apart, plain = textscan.scan(column, spaced=True), [w for t in texts for w in brute.spaced_words(t.lower())]
    assert np.diff(apart.ptr).tolist() == [len(brute.spaced_words(t)) for t in texts]
    assert len(set(zip(plain, apart.hash.tolist()))) == len(set(plain)) == len(set(apart.hash.tolist()))
    begin = textscan.starts(got.ptr, 3)
    pairs = {(tuple(flat[i : i + 3]), int(textscan.windows(got.hash, 3)[i])) for i in begin.tolist()}
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    names, expected = duck_rows(connect(FOLDER), queries.oracle_sql()[name])
    df = run(spark, name)
    assert sorted(df.columns) == names and spark_rows(df) == expected


def test_decontamination(spark, rows, items):
    got = {(r.doc_id, r.item_id, r.start, r.stop) for r in run(spark, "op1_decontaminate").collect()}
    few = {d for d, *_ in got} | {d for d, _ in rows[:40]}
    assert {x for x in got if x[0] in few} == brute.leaks([r for r in rows if r[0] in few], items)
    docs, bench = table(spark, FOLDER, "documents"), table(spark, FOLDER, "benchmark")
    parts = {(r.doc_id, r.item_id, r.start, r.stop) for r in decontaminate.spans(docs, bench, set_words=500).collect()}
    assert parts == got  # a benchmark above the limit of one set gives the same
    left = {r.doc_id: r.text for r in decontaminate.remove(docs, bench).collect()}
    assert not any(brute.leaks([(d, left[d])], items) for d in few if d in left)
    assert {d for d, t in rows if d not in {x[0] for x in got}} <= set(left)


def test_kd_sharding(spark, rows):
    docs, target = table(spark, FOLDER, "documents"), 40_000
    local = {r.doc_id: r.leaf for r in kdshard.assign(docs, target, local_rows=1 << 40, least_shards=1).collect()}
    spread = {r.doc_id: r.leaf for r in kdshard.assign(docs, target, local_rows=10, least_shards=1).collect()}
    t = docs.toPandas().sort_values("doc_id")
    rank = lambda c: t[c].map({v: i + 1 for i, v in enumerate(sorted(t[c].unique()))}).to_numpy()
    points = np.stack([t["n_chars"].to_numpy(), t["doc_id"].to_numpy(), rank("source"), rank("lang")], 1)
    weight = t["text"].map(lambda x: len(x.encode())).to_numpy()
    scale = np.maximum(1, points.max(0) - points.min(0))
    ids, want = t["doc_id"].to_numpy(), {}

    def split(path, at):
        wide = (points[at].max(0) - points[at].min(0)) / scale
        if weight[at].sum() <= target or not wide.any():
            want.update({int(ids[i]): path for i in at})
            return
        v = points[at, wide.argmax()]
        values = sorted(set(v.tolist()))
        middle = next(x for x in values if 2 * weight[at][v <= x].sum() >= weight[at].sum())
        middle = middle if middle < values[-1] else values[-2]
        split(path + "0", at[v <= middle])
        split(path + "1", at[v > middle])

    split("", np.arange(len(ids)))
    assert local == want and spread == want and len(set(want.values())) > 5
    target = -(-weight.sum() // kdshard.LEAST_SHARDS)  # what the query takes for a small table
    want.clear()
    split("", np.arange(len(ids)))
    got = run(spark, "op2_kd_sharding").collect()
    assert {r.doc_id: r.leaf for r in got} == want and len(set(want.values())) >= kdshard.LEAST_SHARDS
    number = {leaf: i for i, leaf in enumerate(sorted(set(want.values())))}
    assert all(r.shard == number[r.leaf] for r in got)


def test_knn_quality_holds_out(spark):
    big = "/root/testdata/sf0.1"
    t, lab = pq.read_table(f"{big}/documents.parquet").to_pandas(), pq.read_table(f"{big}/labels.parquet").to_pandas()
    both = t.merge(lab, on="doc_id").sample(frac=1, random_state=3)
    one, two = both[:1024], both[1024:2400]
    plain = textscan.strings(pa.array(two.text.tolist(), pa.large_string()), lower=False)
    got = []
    for label in ("quality", "toxic"):
        model = knnquality.fit(one.text.tolist(), one[label].to_numpy(np.float32))
        vectors = np.concatenate([knnquality.project(knnquality.terms(plain.slice(a, b - a)), model) for a, b in textscan.pieces(plain)])
        got.append(knnquality.vote(vectors, model))
        for i in range(20):  # exact cosines, one by one
            near = sorted(((float(vectors[i] @ v), -j) for j, v in enumerate(model.vectors)), reverse=True)[: knnquality.NEIGHBOURS]
            w = np.array([max(0, s) for s, _ in near])
            assert got[-1][i] == pytest.approx((w * model.labels[[-j for _, j in near]]).sum() / w.sum(), abs=0.13)
    q, x = two.quality.to_numpy(), two.toxic.to_numpy()
    assert (got[0][q == 1] >= 0.5).mean() > 0.99 and (got[0][q == 0] < 0.5).mean() > 0.85
    assert (got[1][x == 0] <= 0.6).mean() > 0.98 and (got[1][x == 1] > 0.6).mean() > 0.9
    found = run(spark, "op3_knn_quality")
    assert found.count() == table(spark, FOLDER, "documents").count()


def test_knn_quality_is_exact(spark, rows):
    """Spaces and votes against plain counts, a singular value decomposition by another routine, and cosines one by one."""
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pandas()
    label = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    known = [i for i, d in enumerate(t.doc_id) if d in label]
    truth = np.array([label[t.doc_id[i]] for i in known], float)

    @lru_cache(None)
    def bucket(stem):
        """Stems are told apart by 18 bits of their hash."""
        one = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(stem)], np.int64)), pa.py_buffer(stem)])
        return int(textscan.scan(one).hash[0] >> np.uint64(64 - knnquality.WORD_BITS))

    def counted(text):
        w = [x.encode()[: knnquality.STEM] for x in brute.words(text)]
        c = Counter(bucket(x) for x in w)
        c.update("mark" + x for x in text if x.isascii() and x.isprintable() and not x.isalnum() and x != " ")
        again, upper = sum(a == b for a, b in zip(w, w[1:])), sum(a.isascii() and b.isascii() and a.isupper() and b.isupper() for a, b in zip(text, text[1:]))
        c.update({"again": again * (again > 0.1 * len(w)), "upper": upper * (upper > 0.5 * len(w)), "line": text.count("\n")})
        return {k: v for k, v in c.items() if v}

    every = [counted(x) for x in t.text]
    sample = [every[i] for i in known]
    often = Counter(k for c in sample for k in c)
    names = sorted((k for k, n in often.items() if n >= knnquality.LEAST or isinstance(k, str)), key=str)
    there = np.array([sum(k in c for c in sample) for k in names], float)
    both = np.array([sum(y for c, y in zip(sample, truth) if k in c) for k in names])
    n, own = len(sample), truth.sum()
    phi = np.abs(n * both - there * own) / np.sqrt(np.maximum(there * (n - there) * own * (n - own), 1e-9))
    weight = (np.log((1 + n) / (1 + there)) + 0.1) * (knnquality.FLOOR + phi) ** knnquality.POWER
    at = {k: i for i, k in enumerate(names)}

    def row(c):
        out = np.zeros(len(names))
        for k, v in c.items():
            if k in at:
                out[at[k]] = weight[at[k]] * np.log1p(v)
        return out

    x = np.array([row(c) for c in sample])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    cosines = unit(np.array([row(c) for c in every]) @ v[: knnquality.RANK].T) @ unit(x @ v[: knnquality.RANK].T).T
    model = knnquality.fit([t.text[i] for i in known], truth.astype(np.float32))
    plain = textscan.strings(pa.array(t.text.tolist(), pa.large_string()), lower=False)
    vectors = knnquality.project(knnquality.terms(plain), model)
    got = knnquality.vote(vectors, model)
    assert np.abs(vectors @ model.vectors.T - cosines).max() < 2e-3
    exact = 0
    for i, c in enumerate((vectors.astype(np.float64) @ model.vectors.T.astype(np.float64))):
        near = sorted(c, reverse=True)
        if near[knnquality.NEIGHBOURS - 1] - near[knnquality.NEIGHBOURS] < 1e-5:
            continue  # a tie at the last place
        pick = np.argsort(-c)[: knnquality.NEIGHBOURS]
        w = np.maximum(c[pick], 0)
        assert got[i] == pytest.approx((w * truth[pick]).sum() / w.sum(), abs=1e-4)
        exact += 1
    assert exact > 0.6 * len(every)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab*?.é", max_size=6), min_size=1, max_size=30), st.lists(st.text("ab.é\U0001f600", max_size=8), min_size=1, max_size=6))
def test_globs(globs, urls):
    got = urlglob.match(pa.array(urls, pa.large_string()), urlglob.compile_globs(globs))
    want = [[re.match(fnmatch.translate(g), u) is not None for g in globs] for u in urls]
    assert got.tolist() == want


def spectrum(text):
    """n-grams (1 to 3) of the normalised bytes of a text."""
    t = re.sub(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]", b" ", re.sub(rb"[0-9]", b"0", text.lower().encode()))
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def likeness(x, y):
    return len(x & y) / max(1, len(x) * len(y)) ** 0.5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abz É9.ß\u0153\u4e2d", max_size=12), min_size=1, max_size=5), st.lists(st.text("abz É9.ß\u0153\u4e2d", min_size=1, max_size=12), min_size=2, max_size=4))
def test_kernel(texts, learnt):
    model = langkernel.fit_weights(learnt, [f"l{i}" for i in range(len(learnt))], len(learnt), 0.05)
    near, size = langkernel.kernel(textscan.strings(pa.array(texts, pa.large_string())), model)
    assert size.tolist() == [len(spectrum(t)) for t in texts]
    assert near == pytest.approx(np.array([[likeness(spectrum(t), spectrum(x)) for x in learnt] for t in texts]), abs=1e-5)


def test_language_scores(rows):
    """Scores against the same regression on kernels of plain sets."""
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pandas()
    texts, langs = t.text[:80].tolist(), t.lang[:80].tolist()
    model = langkernel.fit_weights(texts, langs, 20, 0.05)
    order = sorted(range(80), key=lambda i: (langs[i], i))[::4]
    sets = [spectrum(x) for x in t.text]
    marks = [sets[i] for i in order]
    c = np.array([[likeness(x, y) for y in marks] for x in sets])
    values, vectors = np.linalg.eigh(c[order])
    some = values > 1e-6  # landmarks may be copies of one another
    features = c @ (vectors[:, some] / np.sqrt(values[some])) @ vectors[:, some].T
    truth = np.array([[1.0 if x == k else -1.0 for k in model.languages] for x in langs])
    weights = np.linalg.inv(features[:80].T @ features[:80] + 0.05 * np.eye(20)) @ features[:80].T @ truth
    got, _ = langkernel.score(textscan.strings(pa.array(t.text.tolist(), pa.large_string())), model)
    assert got == pytest.approx(features @ weights, abs=2e-3)
    want = np.array(model.languages)[(features @ weights).argmax(1)]
    assert (np.array(model.languages)[got.argmax(1)] == want).mean() > 0.99


def test_language_sample(spark):
    """The least hashes of each language, as many as its share, over the whole table."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("lang", F.when(F.col("doc_id") % 200 == 7, "rare").otherwise(F.col("lang")))
    every = docs.select("lang", "text", F.xxhash64(F.col("doc_id"), "text").alias("h")).collect()
    for n in (40, 300, 5000):
        texts, langs = langkernel.labelled(docs, n)
        want = langkernel.shares({k: sum(r.lang == k for r in every) for k in {r.lang for r in every}}, n)
        assert len(texts) == min(n, len(every)) and want["rare"] >= min(5, n // 20) and sum(want.values()) == len(texts)
        for k, w in want.items():
            first = sorted((r.h % (1 << 64) >> 1, r.text) for r in every if r.lang == k)[:w]
            assert sorted(x for x, y in zip(texts, langs) if y == k) == sorted(x for _, x in first)


def test_language_holds_out(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas().sample(frac=1, random_state=1)
    model = langkernel.fit(t.text[:400].tolist(), t.lang[:400].tolist())
    best, _, keep = langkernel.decide(textscan.strings(pa.array(t.text[400:].tolist(), pa.large_string())), model, 0.02)
    right = np.array(model.languages)[best] == t.lang[400:].to_numpy()
    assert right.mean() > 0.98 and keep.mean() > 0.99
    got = run(spark, "op5_language_id").collect()
    assert len(got) == 200


def test_language_of_none():
    """Random strings and languages that no labelled row has are rejected, texts of the labelled languages are not."""
    t = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pandas().sample(frac=1, random_state=1)
    model = langkernel.fit(t.text[:1024].tolist(), t.lang[:1024].tolist())
    kept = lambda texts: langkernel.decide(textscan.strings(pa.array(texts, pa.large_string())), model, 0.02)[2]
    rng = random.Random(2)
    for n in (60, 300, 2000):
        assert kept(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for _ in range(100)]).mean() <= 0.05
        assert kept([base64.b64encode(rng.randbytes(n * 3 // 4)).decode() for _ in range(100)]).mean() <= 0.05
    unseen = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek egymással szemben testvéri szellemben kell hogy viseltessenek.",
    ]
    assert not kept(unseen).any()
    rest = t.text[1024:3024].tolist()
    assert kept(["All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience."]).all() and kept(rest).mean() > 0.99
    assert all(kept([" ".join(x.split()[:n]) for x in rest]).mean() > 0.98 for n in (5, 10, 40))


def test_arc_round_trip(spark):
    pages = {r.page_id: (r.url, r.html) for r in table(spark, FOLDER, "pages").collect()}
    got = run(spark, "op6_arc_to_warc").collect()
    assert len(got) == 2 * len(pages) and not any(r.error for r in got)
    for r in got:
        head, _, rest = bytes(r.warc).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n" and head.startswith(b"WARC/1.0\r\n")
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.warc_date)
        if r.warc_type == "response":
            url, html = pages[r.page_id]
            assert r.warc_target_uri == url and r.http_status == 200 and block.partition(b"\r\n\r\n")[2].decode() == html
            assert r.warc_payload_digest == arc2warc.digest(html.encode())
        else:
            assert r.warc_type == "warcinfo" and b"arc-version: " + (b"1", b"2")[r.page_id % 2 : r.page_id % 2 + 1][0] in block
    assert len({r.warc_record_id for r in got}) == len(got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.lists(st.integers(1, 2), max_size=4)), max_size=8), min_size=1, max_size=6))
def test_merge_and_front_coding(parts):
    runs, plain = [], []
    for number, part in enumerate(parts):
        part = sorted(part)
        gram = np.array([g for g, _ in part], np.uint64)
        size = np.array([len(x) for _, x in part], np.int64)
        right = suffixdedup.grid(np.array([v for _, x in part for v in x], np.uint32), size)
        if not part:
            continue
        zero = np.zeros(len(part), np.int64)
        heads = len(set(gram.tolist()))
        data = suffixdedup.encode(gram, right, size, np.zeros(0, np.uint32), zero, np.arange(len(part)), zero, zero + 2, np.arange(2 * len(part))) + heads.to_bytes(8, "little")
        got = suffixdedup.decode(data)
        assert (got[0] == gram).all() and (got[1] == right).all() and (got[2] == size).all() and got[9].tolist() == list(range(2 * len(part)))
        runs.append((got[0], got[1], got[8]))
        plain += [(g, tuple(x), number) for g, x in part]
    if not runs:
        return
    run_, at, shared = suffixdedup.merge(runs)
    found = [(int(runs[r][0][i]), tuple(v for v in runs[r][1][i].tolist() if v)) for r, i in zip(run_, at)]
    assert found == sorted((g, x) for g, x, _ in plain)
    for k in range(1, len(found)):
        (g, x), (h, y) = found[k - 1], found[k]
        common = 0 if g != h else 1 + next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert shared[k] == common or (x == y and g == h and shared[k] >= common)


def test_suffix_dedup(spark, rows):
    for f in (run(spark, "op7_suffix_dedup"), suffixdedup.spans(table(spark, FOLDER, "documents").repartition(5), run_rows=50)):
        got = {}
        for r in f.collect():
            got.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
            assert r.words == r.stop - r.start and r.first_doc_ids
        assert got == brute.spans_of_repeats(rows)
    rng = random.Random(5)
    word = [f"w{i}" for i in range(40)]
    passage = [rng.choice(word) for _ in range(200)]
    made = []
    for i in range(60):  # passages of different length and place, runs of one word, chains of overlaps
        a, n = rng.randrange(140), rng.randrange(30, 60)
        made.append((i, " ".join([rng.choice(word) for _ in range(rng.randrange(80))] + passage[a : a + n] + (["same"] * rng.randrange(0, 120) if i % 5 == 0 else []) + [rng.choice(word) for _ in range(20)])))
    line = " ".join(f"Row{i} | c{i}" for i in range(20))  # 60 words of which 40 have letters
    made += [(100, line), (101, "x " + line.upper().replace("|", "--") + " y"), (102, f"{line}. {line}, {line}"), (103, "again " * 300), (104, "more of it " + "again " * 80), (105, "one. " * 200)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    got = {}
    for r in suffixdedup.spans(df, run_rows=20).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    assert got == brute.spans_of_repeats(made)
    assert len(got[102]) == 3 * 60 and 103 not in got and len(got[104]) == 80 and 105 not in got and 101 in got


def test_packing(spark, rows):
    odd = ["a  b", " a", "a ", "\n", " \n x", "a \n b", "", "a\n \nb", "a\n b", "\t \n", "a\u00a0 \u2003b", " ", "\n \n \n"]
    column = textscan.strings(pa.array([t for _, t in rows] + odd, pa.large_string()), lower=False)
    encoder = packing.encoder(packing.VOCABULARY)
    want = [len(encoder.encode_ordinary(x)) for x in column.to_pylist()]
    assert packing.token_counts(column).tolist() == want
    got = run(spark, "op8_best_fit_packing").collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
    assert total == {d: n for (d, _), n in zip(rows, want) if n}
    assert len({r.sequence for r in got}) <= 1.05 * sum(want) / packing.CAPACITY + 2


def plain_pack(sizes, capacity):
    """The same rules by looking through everything each time."""
    number, offset, bins = [0] * len(sizes), [0] * len(sizes), []
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left, step = [i for i in order if 3 * sizes[i] > capacity], 0
    while left:
        i = left.pop(0)
        used = sizes[i]
        number[i] = len(bins)
        j = next((j for j in left if sizes[j] <= capacity - used), None)
        if j is not None:
            left.remove(j)
            number[j], offset[j] = len(bins), used
            used += sizes[j]
        bins.append((capacity - used, step))
        step += 1
    for i in (i for i in order if 3 * sizes[i] <= capacity):
        fits = [(gap, -when, k) for k, (gap, when) in enumerate(bins) if gap >= sizes[i]]
        if not fits:
            bins.append((capacity, step))
            fits = [(capacity, 0, len(bins) - 1)]
        gap, _, k = min(fits)
        number[i], offset[i] = k, capacity - gap
        bins[k] = (gap - sizes[i], step)
        step += 1
    return number, offset


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_pack_rules(sizes):
    size = np.array(sizes, np.int64)
    number, offset = packing.pack(size, 60)
    for k in set(number.tolist()):
        at = np.flatnonzero(number == k)
        at = at[np.argsort(offset[at])]
        assert offset[at[0]] == 0 and (offset[at[1:]] == offset[at[:-1]] + size[at[:-1]]).all() and offset[at[-1]] + size[at[-1]] <= 60
        assert (3 * size[at] > 60).sum() <= 2
    gaps = [60 - size[number == k].sum() for k in set(number.tolist())]
    assert (number.tolist(), offset.tolist()) == plain_pack(sizes, 60)
    small = size[3 * size <= 60]
    assert sum(g >= (small.min() if len(small) else 61) for g in gaps) <= 1 + (3 * size > 60).sum()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_bk_search_is_exact():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, (12, simhash.LANES), dtype=np.uint64)
    s = base[rng.integers(0, 12, 400)]
    for _ in range(40):
        s[np.arange(400), rng.integers(0, 4, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    shard = np.sort(rng.integers(0, 5, 400))
    held = rng.random(400) < 0.7
    keep = np.unique(np.column_stack([shard.astype(np.uint64), s]), axis=0, return_index=True)[1]
    keep.sort()
    s, shard, held = s[keep], shard[keep], held[keep]
    for radius in (0, 20, 52, 256):
        got = {(int(a), int(b)) for q, n in simhash.search(s, shard, held, radius, most=64) for a, b in zip(q, n)}
        want = {(i, j) for i in range(len(s)) for j in range(len(s)) if held[j] and shard[i] == shard[j] and simhash.distance(s[i], s[j]) <= radius}
        assert got == want


def test_simhash_recall(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    want = brute.near_groups(rows)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    for got in (simhash.groups(docs), simhash.groups(docs, shard_rows=20, broadcast_bytes=0)):
        found = {(r.doc_id, r.kept_doc_id) for r in got.collect()}
        assert len(found & want) >= 0.95 * len(want) and len({d for d, _ in found} - {d for d, _ in want}) == 0


@pytest.mark.parametrize("bits", [10, simhash.BAND_BITS, 22])
def test_simhash_bands_reach_the_radius(bits):
    """Pairs at the radius share a band with probability 0.9, and nearer ones as found() says, at any band width."""
    count = simhash.tables_for(bits)
    assert count == simhash.TABLES or bits != simhash.BAND_BITS
    bands = simhash.band_positions(bits, count)
    rng = np.random.default_rng(4)
    one = rng.integers(0, 2, (4000, simhash.BITS), dtype=np.uint8)
    for away in (26, 39, simhash.RADIUS):
        two = one.copy()
        for row in two:
            row[rng.choice(simhash.BITS, away, replace=False)] ^= 1
        a, b = (np.packbits(x, axis=1, bitorder="little").view(np.uint64) for x in (one, two))
        assert (simhash.distance(a, b) == away).all()
        share = (simhash.band_keys(a, bands) == simhash.band_keys(b, bands)).any(0).mean()
        assert share >= 0.88 and abs(share - simhash.found(bits, away, count)) < 0.02


def test_simhash_pairs_do_not_depend_on_the_corpus(spark):
    """Unrelated documents beside them, or the other way of delivering trees, change no pair."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    more = docs.select((docs.doc_id + 1_000_000).alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{i}"))) for i in range(60))).alias("text"))
    want = {tuple(r) for r in simhash.groups(docs).collect()}
    assert {tuple(r) for r in simhash.groups(docs.select("doc_id", "text").unionByName(more)).collect()} == want
    assert {tuple(r) for r in simhash.groups(docs, broadcast_bytes=0).collect()} == want


def test_weak_supervision(spark):
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.7
    accuracy = np.array([0.9, 0.8, 0.7, 0.85, 0.6])
    votes = np.where(rng.random((4000, 5)) < accuracy, 1, -1) * np.where(y, 1, -1)[:, None]
    votes[rng.random((4000, 5)) < 0.3] = 0
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, found = weakrules.estimate(patterns, counts.astype(float))
    assert np.abs(found - accuracy).max() < 0.05
    assert ((good[inverse] >= 0.5) == y).mean() > 0.88
    t, lab = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas(), pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas()
    got = {r.doc_id: r.keep for r in weakrules.score(table(spark, "/root/testdata/sf0.01", "documents")).collect()}
    keep = np.array([got[d] for d in lab.doc_id])
    assert keep[lab.quality == 1].mean() > 0.95 and (~keep[lab.quality == 0]).mean() > 0.95
    assert len(got) == len(t)


def test_estimate_is_plain_em(spark, rows):
    """Posteriors and accuracies against the same model fitted document by document."""
    votes = weakrules.votes(textscan.strings(pa.array([t for _, t in rows], pa.large_string()), lower=False), weakrules._stop_hashes()).tolist()
    good = [min(0.95, max(0.05, sum(x > 0 for x in v) / sum(map(abs, v)))) if any(v) else 0.5 for v in votes]
    for _ in range(weakrules.ROUNDS):
        share = [(sum(1 - g for g in good) + 1) / (len(good) + 2), (sum(good) + 1) / (len(good) + 2)]
        chance = []
        for r in range(len(weakrules.RULES)):
            cell = [[sum((g if c else 1 - g) for g, v in zip(good, votes) if v[r] == x) + 1 for x in (-1, 1)] for c in (0, 1)]
            chance.append([[y / sum(x) for y in x] for x in cell])
        before, good = good, []
        for v in votes:
            p = [share[c] * math.prod(chance[r][c][x > 0] for r, x in enumerate(v) if x) for c in (0, 1)]
            good.append(p[1] / sum(p))
        if max(abs(a - b) for a, b in zip(before, good)) < 1e-9:
            break
    got = {r.doc_id: r.posterior for r in run(spark, "op10_weak_supervision").collect()}
    assert [got[d] for d, _ in rows] == pytest.approx(good, abs=2e-6)
    right = {r.rule: r.accuracy for r in weakrules.accuracies(table(spark, FOLDER, "documents")).collect()}
    for r, name in enumerate(weakrules.RULES):
        made = [(v[r], g) for v, g in zip(votes, good) if v[r]]
        assert right[name] == (pytest.approx(sum(g if x > 0 else 1 - g for x, g in made) / len(made), abs=2e-6) if made else None)


def test_votes_do_not_depend_on_neighbours():
    texts = ["a b c.", "", "THE END OF IT\nTHE END OF IT", "x x x x x x x x", None, "the cat and the dog\n\nsat | on | it"]
    stop = weakrules._stop_hashes()
    column = textscan.strings(pa.array(texts, pa.large_string()), lower=False)
    whole = weakrules.votes(column, stop)
    assert all((whole[i] == weakrules.votes(column.slice(i, 1), stop)[0]).all() for i in range(len(texts)))


def test_pipeline(spark, rows, items):
    """run() against the stages' plain versions one after the other."""
    docs = table(spark, FOLDER, "documents")
    model = langkernel.train(docs)
    _, _, keep = langkernel.decide(textscan.strings(pa.array([t for _, t in rows], pa.large_string())), model, 0.02)
    left = {d: t for (d, t), k in zip(rows, keep) if k}
    for d, _ in brute.near_groups(left.items()):
        left.pop(d)
    for d, gone in brute.spans_of_repeats(left.items()).items():
        left[d] = brute.without_words(left[d], gone, brute.SPACED)
    left = {d: t for d, t in left.items() if brute.words(t)}
    found = brute.leaks(left.items(), items)
    for d in {x[0] for x in found}:
        gone = {i for x in found if x[0] == d for i in range(x[2], x[3])}
        n = len(brute.words(left[d]))
        left[d] = "" if len(gone) >= decontaminate.DOCUMENT_SHARE * n else brute.without_words(left[d], gone)
    encoder = packing.encoder(packing.VOCABULARY)
    want = {d: len(encoder.encode_ordinary(t)) for d, t in left.items() if brute.words(t)}
    got = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.tokens
    assert got == want


def test_sides_above_the_broadcast_limit(spark, monkeypatch, rows):
    """Shuffled instead of broadcast sides give the same rows."""
    from quernstone.llm import common

    docs = table(spark, FOLDER, "documents")
    key = lambda df: sorted(map(repr, df.collect()))
    asked = {
        "spans": lambda: suffixdedup.spans(docs).drop("first_doc_ids"), "strip": lambda: suffixdedup.remove_repeats(docs), "groups": lambda: simhash.groups(docs, shard_rows=20), "one": lambda: simhash.keep_one(docs),
        "leaves": lambda: kdshard.assign(docs, 40_000, local_rows=50),
    }
    before = {k: key(f()) for k, f in asked.items()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(suffixdedup, "BROADCAST_BYTES", 0)
    assert {k: key(f()) for k, f in asked.items()} == before
    left = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in brute.near_groups(rows)}
