"""Mixing, packing, URL filter, nearest neighbours and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import WORD, messy_docs, no_docs, prose, rows_of, SCHEMA
from tidemark.llm import mixing, neighbours, packing, queries, url_filter

SMALL = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(got, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target, taken, largest = plain_targets(sizes), Counter(), Counter()
    for r in got:
        source = r.row.source
        assert r.size == len(WORD.findall(r.row.text or "")) and r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source], rel=1e-9) and 0 <= r.copies <= 2
        taken[source] += r.size * r.copies
        largest[source] = max(largest[source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(1, largest[s])
    assert len(got) == len(rows)


def test_mix_of_messy_rows(spark):
    docs, rows = messy_docs(spark)
    check_mix(mixing.balanced_copies(docs).collect(), rows)
    assert mixing.mixed(no_docs(spark)).count() == 0
    assert mixing.mixed(docs).schema == docs.schema


def test_mix_of_sources_and_reruns(spark):
    rows = []
    for k, source in enumerate(["b", "a", "é", "", None, "zz", "c"]):
        rows += rows_of([prose(k * 100 + i, 1 + (i * 37) % 200) for i in range(60)], first=1000 * k, source=source)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.balanced_copies(docs).collect()
    check_mix(got, rows)
    again = mixing.balanced_copies(docs.repartition(7)).collect()
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs, rows = messy_docs(spark)
    extra = rows_of(["don't stop 'tis it's", "ΑΣ ΟΔΥΣΣΕΥΣ İstanbul ﬁ", "<|startoftext|> x", "é́ a!b?? c-d #1 10%", "w" * 300], first=3000)
    docs = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    plain = Tokenizer.from_file(queries.WORD_VOCABULARY)
    expected = Counter()
    for r in [*rows, *extra]:
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]
        expected[r[0], np.array(ids, "<u4").tobytes()] += 1
    pieces = packing.binary_pieces(docs, queries.WORD_VOCABULARY, longest=64).collect()
    assert all(p.length & (p.length - 1) == 0 and p.length <= 64 and p.offset == 0 for p in pieces)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in pieces)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    got, text = Counter(), b""
    for p in sorted(pieces, key=lambda p: p.sequence_id):  # in an input partition documents follow each other
        assert len(text) == 4 * p.start
        text += p.ids
        if len(text) == 4 * p.doc_tokens:
            got[p.doc_id, text] += 1
            text = b""
    assert got == expected
    assert packing.binary_pieces(no_docs(spark), queries.WORD_VOCABULARY).count() == 0


def test_urls(spark):
    urls = [
        "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "http://example.org/en/2", "http://fr.com/fr/1",
        "http://x.fr.com/de/", "http://com/fr/", "http://dotcom/fr/", "http://example.org", None, "no scheme", "://", "http://h:80/a/?b=1&utm_x=2#z",
        "http://www.h/a?b=1", "ftp://example.org?x/es/", "http://example.org/es/", "http://ÄB.org/",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("block", F.lit(1))
    listed = spark.createDataFrame([("https://h/a?b=1",), (None,), ("http://other/",), ("http://example.org/es/",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed, queries.URL_RULES).collect()}
    assert got == {
        0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"),
        2: ("example.org", "/en/2", "org/", "allow"), 3: ("fr.com", "/fr/1", "com/fr/", "allow"), 4: ("x.fr.com", "/de/", "com/de/", "block"),
        5: ("com", "/fr/", "com/fr/", "allow"), 6: ("dotcom", "/fr/", None, "allow"), 7: ("example.org", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("h:80", "/a/", None, "block"),
        12: ("www.h", "/a", None, "block"), 13: ("example.org", "", None, "allow"), 14: ("example.org", "/es/", "example.org/es/", "block"),
        15: ("Äb.org", "/", "org/", "allow"),
    }
    assert url_filter.judge_urls(pages.limit(0), listed, queries.URL_RULES).count() == 0


def test_bloom_filter_is_exact_when_it_is_full(spark):
    rows = spark.createDataFrame([(f"k{i}",) for i in range(500)] + [(None,)], "k string")
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 900, 3)], "k string")
    got = url_filter.listed_flags(rows, listed, "k", most_blocks=1).collect()
    assert {(r.k, r.listed) for r in got} == {(r.k, r.k is not None and int(r.k[1:]) % 3 == 0) for r in rows.collect()}


def test_nearest(spark):
    random = np.random.default_rng(3)
    x = random.standard_normal((600, 8)).astype(np.float32)
    x[100:140] = x[100]  # equal vectors: ties to smaller ids
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(601, None), (620, [0.0] * 8), (640, [float("nan")] * 8), (660, [None, *[1.0] * 7]), (680, [float("inf"), *[1.0] * 7]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(table).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    products = x.astype(float) @ x.astype(float).T
    hits = 0
    for q, found in got.items():
        found.sort()
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-products[q, i], i))[:20]
        assert [r for r, *_ in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(order))
    assert hits / (20 * len(got)) > 0.95
    few = neighbours.nearest(table.filter("vec_id < 5")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, k) for k in range(1, 5)]
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SMALL)
        assert rows.columns == docs.columns and rows.count() > 0, name
    pieces = corpus_pipeline.run(spark, SMALL)
    per_doc = pieces.filter("start = 0").groupBy("doc_id").count()
    copies = rows.groupBy("doc_id").count()
    assert per_doc.exceptAll(copies).count() == 0 == copies.exceptAll(per_doc).count()


def test_stages_on_messy_rows(spark):
    docs, rows = messy_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() >= 0 and (name == "packing" or out.schema.names == docs.schema.names)
        assert stage(spark, no_docs(spark), SMALL).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()}
    assert {0, None} <= kept and not {1, 2, 12} & kept
