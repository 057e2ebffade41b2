"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import arc2warc, decontaminate, kdshard, knnquality, langkernel, packing, simhash, suffixdedup, urlglob, weakrules

EN = "the cat and the dog went to the house of the old man and sat down by the fire for a long time with all of their friends "
DE = "der hund und die katze gingen in das haus von dem alten mann und sassen lange zeit an dem feuer mit allen ihren freunden "
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
DDL = "doc_id long, text string, lang string, source string, n_chars long, keep string, gram string, shard string, node string, words string, tokens string, start string, id string, n string, code string, quality string"
ROWS = [
    (1, EN, "en", "a"), (2, DE, "de", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \n\t", "en", "b"), (6, LONG, "en", "c"), (7, EN, "en", "c"), (7, EN, "en", "c"), (None, EN, "en", "a"), (None, None, None, None),
    (8, "Straße ÉCOLE \u212a 中文 \U0001f600", "de", "a"), (9, EN + EN + DE, "en", "a"), (10, "!!! ??? ...", "en", "b"), (11, "word", "en", "b"), (12, "benchmark item one two three four five six seven eight nine", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), *["x"] * 11) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Benchmark item: one two three four five six seven eight nine"), (1, "Benchmark item: one two three four five six seven eight nine"), (2, None), (None, "x y z"), (3, ""), (4, "the old man")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (10, 0, 0), (11, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


def test_decontamination(docs, none, benchmark):
    got = {(r.doc_id, r.item_id, r.start, r.stop) for r in decontaminate.spans(docs, benchmark).collect()}
    assert (12, 1, 0, 11) in got and (1, 4, 10, 13) in got  # a short item counts as a whole
    assert not any(d in (3, 4, 5, 8, 10) for d, *_ in got)
    assert decontaminate.spans(none, benchmark).count() == 0
    assert decontaminate.spans(docs, benchmark.limit(0)).count() == 0
    kept = decontaminate.remove(docs, benchmark.filter("item_id = 1"))
    assert kept.schema.names == docs.schema.names
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted((r[0] or -1) for r in ROWS if r[0] != 12)


def test_decontamination_across_scripts(spark):
    """Typographic marks and no-break spaces part words as plain ones do; ideographs are words."""
    plain = 'she said "the cat sat on the mat - and the dog did not" to all of them'
    fine = "she said \u201cthe\u00a0cat sat on the mat \u2014 and the dog did not\u201d to all of them"
    chinese = "人人生而自由，在尊严和权利上一律平等。"
    items = spark.createDataFrame([(1, plain), (2, chinese)], "item_id long, text string")
    own = " ".join(f"own{i}" for i in range(60))
    made = spark.createDataFrame([(1, f"{own} {fine} {own}"), (2, f"{own}“{chinese}”{own}")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.start, r.stop) for r in decontaminate.spans(made, items).collect()} == {(1, 1, 60, 77), (2, 2, 60, 77)}
    assert {r.text for r in decontaminate.remove(made, items).collect()} == {f"{own}  {own}", f"{own}“。”{own}"}


def test_decontamination_by_short_items(spark):
    """Items of one or two words are found where they are the whole document, and nowhere else."""
    items = spark.createDataFrame([(1, "Yes."), (2, "New York"), (3, "the old man")], "item_id long, text string")
    made = spark.createDataFrame([(1, "Yes, the old man said yes to all."), (2, "yes!"), (3, "new york"), (4, "New York is big"), (5, "yes yes")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.start, r.stop) for r in decontaminate.spans(made, items).collect()} == {(1, 3, 1, 4), (2, 1, 0, 1), (3, 2, 0, 2)}
    assert {r.doc_id: r.text for r in decontaminate.remove(made, items).collect()} == {1: "Yes,  said yes to all.", 4: "New York is big", 5: "yes yes"}


def test_decontamination_of_nested_spans(spark):
    """Items that share a run, and an item that repeats one, give spans within spans; no word of them stays."""
    stock = "which of the following statements about it is true "
    one = " ".join(f"a{i}" for i in range(30)) + " " + stock + " ".join(f"b{i}" for i in range(21))
    two = "c1 c2 " + stock + "c3 c4 " + stock + "c5"
    own = " ".join(f"own{i}" for i in range(200))
    items = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    made = spark.createDataFrame([(1, f"{own}. {one}. {own}", 0), (2, f"{own}. {two}. {own}", 0), (3, own, len(own))], "doc_id long, text string, n_chars long")
    found = decontaminate.spans(made, items).collect()
    assert any(x.start < y.start and y.stop < x.stop for x in found for y in found if x.doc_id == y.doc_id)
    left = {r.doc_id: r for r in decontaminate.remove(made, items).collect()}
    assert [left[i].text for i in (1, 2, 3)] == [f"{own}. . {own}"] * 2 + [own]
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_kd_sharding(docs, none):
    got = kdshard.assign(docs, target_bytes=500).collect()
    assert len(got) == len(ROWS)
    assert len({(r.leaf, r.shard) for r in got if r.doc_id == 7}) == 1  # rows that agree fall together
    assert kdshard.assign(none, target_bytes=500).count() == 0
    assert {r.shard for r in kdshard.assign(docs, target_bytes=1 << 40, least_shards=1).collect()} == {0}


def test_knn_quality(docs, none, labels):
    got = knnquality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.quality <= 1 for r in got)
    assert knnquality.classify(none, labels).count() == 0
    unlabelled = knnquality.classify(docs, labels.limit(0)).collect()
    assert len(unlabelled) == len(ROWS) and all(r.keep and r.quality is None for r in unlabelled)


def test_url_filter(spark):
    long = "http://a.example/" + "b" * 50_000
    rows = [(1, "http://casino.example/", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (4, long, "x"), (None, "HTTP://WWW.A.example:80/?utm_source=1#f", "x"), (5, "http://\U0001f600.example/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rules string")
    got = {(r.page_id, r.canonical_url, r.keep) for r in urlglob.judge(pages).collect()}
    assert (1, "http://casino.example", False) in got and (2, None, True) in got and (3, "", True) in got and (4, long, True) in got and (None, "http://a.example", True) in got
    assert urlglob.judge(pages).count() == len(rows)
    assert urlglob.judge(pages.limit(0)).count() == 0
    assert all(r.keep and not r.rules for r in urlglob.judge(pages, [], []).collect())


def test_url_filter_of_roots_and_directories(spark):
    """Globs that ask for a slash hold for a host's root page and a directory's URL, though the canonical URL has none at its end."""
    want = {
        "http://foo.xxx/": (["*://*.xxx/*"], False), "http://foo.xxx": (["*://*.xxx/*"], False), "http://foo.xxx?q=1": (["*://*.xxx/*"], False), "http://foo.xxx/?utm_source=a": (["*://*.xxx/*"], False), "http://foo.xxx/a": (["*://*.xxx/*"], False),
        "http://x.com/ads/": (["*/ads/*"], False), "http://x.com/ads/a": (["*/ads/*"], False), "http://viagra.gov/": (["*://*viagra*"], True), "http://a.gov/": ([], True), "http://x.com/": ([], False),
        "http://x.com/a?to=/ads": ([], False), "http://x.com/uploads/": ([], False), "http://x.com/login/": (["*/login", "*/login/*"], False), "http://x.com/a.zip/": (["*.zip"], False), "": ([], False),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = {r.url: r for r in urlglob.judge(pages).collect()}
    assert {u: (r.rules, r.allowed) for u, r in got.items()} == want
    assert all(r.keep == (r.allowed or not r.rules) for r in got.values())
    assert not got["http://x.com/"].canonical_url.endswith("com/")


def test_language_id(docs, none):
    got = langkernel.identify(docs).collect()
    assert len(got) == len(ROWS)
    assert all(not r.keep and r.lang is None for r in got if r.doc_id in (3, 4))
    assert all(not r.keep for r in got if r.doc_id in (5, 10))
    assert langkernel.identify(none, langkernel.train(docs)).count() == 0
    assert langkernel.identify(none).count() == 0
    bare = langkernel.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.keep and r.lang is None for r in bare)


def test_arc_conversion(spark):
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" + b"z" * 300_000
    good = b"http://a.example/ 1.2.3.4 20010203040506 text/html %d\n" % len(body) + body + b"\n"
    rows = [(1, good, 1), (1, good, 1), (2, None, 1), (3, b"", 1), (None, good, 1), (4, b"no header here\n", 1), (5, good[:200], 1), (6, b"dns:a 0.0.0.0 99 text/dns 3\nabc\n", 1)]
    df = spark.createDataFrame([(a, bytearray(b) if b is not None else None, c) for a, b, c in rows], "page_id long, arc binary, position int")
    got = arc2warc.warc_records(df).collect()
    assert sorted((r.page_id or 0, r.error) for r in got if r.error) == [(4, "malformed_header"), (5, "truncated"), (6, "bad_date")]
    assert sum(r.page_id == 1 for r in got) == 2 and sum(r.page_id is None for r in got) == 1
    assert arc2warc.warc_records(df.limit(0)).count() == 0
    assert arc2warc.convert_pages(spark.createDataFrame([(1, None, "x"), (None, "u", "x"), (2, "u", None)], "page_id long, url string, html string")).count() == 0


def test_arc_bytes():
    """Literal archives, the WARC records that they must become, and what is saved from damaged ones."""
    v1 = b"filedesc://one.arc 0.0.0.0 20010203040506 text/plain 68\n1 0 crawler\nURL IP-address Archive-date Content-type Archive-length\n\n\n"
    page = b"http://a.example/x y 1.2.3.4 20010203040507 text/html 45\nHTTP/1.0 404 Not Found\r\nServer: s\r\n\r\n<p>gone\n\n"
    dns = b"dns:a.example 9.9.9.9 20010203040508 text/dns 5\n1.2.3\n"
    got = list(arc2warc.convert(v1 + page + dns))
    assert [(r[1], r[3], r[4], r[5], r[6], r[7], r[8], r[11]) for r in got] == [
        ("warcinfo", "2001-02-03T04:05:06Z", "filedesc://one.arc", None, "application/warc-fields", len(got[0][12].partition(b"\r\n\r\n")[2]) - 4, None, None),
        ("response", "2001-02-03T04:05:07Z", "http://a.example/x y", "1.2.3.4", "application/http; msgtype=response", 45, 404, None),
        ("resource", "2001-02-03T04:05:08Z", "dns:a.example", "9.9.9.9", "text/dns", 5, None, None),
    ]
    assert got[1][12] == (
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: " + got[1][2].encode() + b"\r\nWARC-Date: 2001-02-03T04:05:07Z\r\nWARC-Target-URI: http://a.example/x y\r\nWARC-IP-Address: 1.2.3.4\r\n"
        b"WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"HTTP/1.0 404 Not Found\r\nServer: s\r\n\r\n<p>gone\n").digest()) + b"\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"<p>gone\n").digest())
        + b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 45\r\n\r\nHTTP/1.0 404 Not Found\r\nServer: s\r\n\r\n<p>gone\n\r\n\r\n"
    )
    v2 = b"filedesc://two.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 two.arc 14\n2 0 crawler\nX\n\nhttp://b.example/ 1.2.3.4 20010203040507 text/plain 200 abc - 14 two.arc 3\nxyz\n"
    assert [(r[1], r[4], r[7], r[11]) for r in arc2warc.convert(v2)][1] == ("resource", "http://b.example/", 3, None)
    zipped = b"".join(gzip.compress(x) for x in (v1, page, dns))
    assert list(arc2warc.convert(zipped)) == got
    assert [r[11] for r in arc2warc.convert(zipped[:-9])] == [None, None, None, "bad_gzip"]
    # junk between records costs no record, and neither does content longer than declared
    damaged = dns + b"not a header\nnor this 20010203040507 one\n" + page + dns.replace(b"dns 5", b"dns 3") + dns
    assert [(r[4], r[11]) for r in arc2warc.convert(damaged)] == [
        ("dns:a.example", None), ("not a header", "malformed_header"), ("http://a.example/x y", None), ("dns:a.example", None), (".3", "malformed_header"), ("dns:a.example", None),
    ]
    cut = list(arc2warc.convert(dns + page[:-9]))
    assert cut[1][11] == "truncated" and b"\r\nWARC-Truncated: unspecified\r\n" in cut[1][12]
    undated = list(arc2warc.convert(dns + dns.replace(b"20010203040508", b"2001")))
    assert undated[1][11] == "bad_date" and undated[1][3] is None and b"WARC-Date: 2001-02-03T04:05:08Z" in undated[1][12]


def test_suffix_dedup(docs, none):
    got = {(r.doc_id, r.start, r.stop) for r in suffixdedup.spans(docs).collect()}
    assert not any(d in (None, 1, 2, 3, 4, 5, 8) for d, *_ in got)
    assert suffixdedup.spans(none).count() == 0
    kept = suffixdedup.remove_repeats(docs)
    assert kept.schema.names == docs.schema.names
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in ROWS}
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept.collect())


def test_packing(docs, none):
    got = packing.assign(docs, capacity=128).collect()
    assert {r.doc_id for r in got} == {1, 2, 5, 6, 7, 8, 9, 10, 11, 12}
    assert packing.assign(none).count() == 0
    used = {}
    for r in got:
        used.setdefault(r.sequence, []).append((r.offset, r.offset + r.tokens))
    for parts in used.values():
        parts.sort()
        assert parts[-1][1] <= 128 and all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    twice = [r for r in got if r.doc_id == 7]
    assert len(twice) == 2  # a repeated row is packed each time


def test_simhash(docs, none):
    got = {(r.doc_id, r.kept_doc_id) for r in simhash.groups(docs).collect()}
    assert (7, 1) in got and not any(d in (1, 3, 4, 5, 10) for d, _ in got)
    assert simhash.groups(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.schema.names == docs.schema.names
    left = [r.doc_id for r in kept.collect()]
    assert 7 not in left and left.count(None) == 2 and {1, 2, 3, 4, 5, 6, 10, 11, 12} <= set(left)


UNIQUE = " ".join(f"only{i}x" for i in range(120))
OTHER = " ".join(f"else{i}y" for i in range(120))


def test_rows_that_share_a_doc_id(spark, benchmark):
    """A row loses its own spans, and goes for its own text, never for that of another row with its doc_id."""
    passage = " ".join(f"pass{i}" for i in range(60))
    item = "one two three four five six seven eight nine"
    made = spark.createDataFrame([(1, f"{passage} {OTHER}"), (2, f"start {passage} end"), (2, UNIQUE), (2, UNIQUE)], "doc_id long, text string")
    left = sorted((r.doc_id, r.text) for r in suffixdedup.remove_repeats(made).collect())
    assert left == sorted([(1, f"{passage} {OTHER}"), (2, "start  end"), (2, UNIQUE), (2, UNIQUE)])
    twice = spark.createDataFrame([(2, f"{passage} {OTHER}"), (2, f"start {passage} end")], "doc_id long, text string")
    assert len(suffixdedup.spans(twice).collect()) == 1  # the two texts of one doc_id are two documents
    made = spark.createDataFrame([(2, f"start benchmark item {item} end " + OTHER), (2, UNIQUE)], "doc_id long, text string")
    left = {r.text for r in decontaminate.remove(made, benchmark.filter("item_id = 1")).collect()}
    assert left == {"start  end " + OTHER, UNIQUE}
    made = spark.createDataFrame([(1, EN, "a"), (5, EN, "b"), (5, UNIQUE, "c"), (6, OTHER, "d"), (6, OTHER, "e"), (7, UNIQUE + " more", "f")], "doc_id long, text string, source string")
    for limit in (None, 0):
        got = sorted((r.doc_id, r.text) for r in simhash.keep_one(made, broadcast_bytes=limit).collect())
        assert got == sorted([(1, EN), (5, UNIQUE), (6, OTHER)])
    assert {(r.doc_id, r.kept_doc_id) for r in simhash.groups(made).collect()} == {(5, 1), (7, 5)}  # 1 and 7 are not linked by doc_id 5


def test_reserved_names(spark, benchmark, tmp_path):
    """Columns of any name pass through the filtering stages."""
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["__ranges", "__doc", "__row", "__whole", "__removed_key", "row", "reach", "range", "piece", "copy", "n"]
    made = spark.createDataFrame([(i, EN, "en", "a", len(EN), *names) for i in (1, 1, 2)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, made, str(tmp_path))
        assert got.schema.names == made.schema.names
        assert all(tuple(r)[5:] == tuple(names) for r in got.collect())


def test_weak_supervision(docs, none):
    got = weakrules.score(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.posterior <= 1 for r in got)
    assert all(r.good_votes == 0 and r.bad_votes == 1 for r in got if r.doc_id in (3, 4, 5, 10))
    assert weakrules.score(none).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, none, benchmark, tmp_path, k):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    for df in (docs, none):
        got = stage(spark, df, str(tmp_path))
        rows = got.collect()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert got.schema.names == df.schema.names
        assert bool(rows) == (df is docs)
