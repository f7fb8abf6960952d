"""Cases in which an operator once did less than the whole job."""

import base64
import bz2
import gzip
import io
import lzma
import tarfile
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import language_id, neighbours, packing, quality, queries, secret_scan
from tidemark.llm.shared import prepared


def test_all_members_of_a_centre_meet(spark):
    random = np.random.default_rng(5)
    x = random.standard_normal((300, 16))
    x[150:] = x[:150] + 0.01 * random.standard_normal((150, 16))  # best partners lie 150 ids apart
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([np.ones(16), *x])], "v long, x array<double>")
    star = spark.range(1, 301).select(F.lit(0).cast("long").alias("v"), F.col("id").alias("u"), F.lit(0.0).cast("float").alias("s"))
    nodes = neighbours._codes(rows)
    got = neighbours._joined_neighbours(star.withColumn("fresh", F.lit(True)), nodes, 2).collect()
    met = {(r.v, r.u) for r in got}
    assert all((i, i + 150) in met and (i + 150, i) in met for i in range(1, 151))


def test_a_round_offers_no_edge_that_a_node_has(spark):
    random = np.random.default_rng(8)
    x = np.ones(16) + 0.01 * random.standard_normal((200, 16))  # near copies, as a hub of their own
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, x array<double>")
    nodes = neighbours._codes(rows)
    s = neighbours._matrix([r.code for r in nodes.orderBy("v").collect()])
    s = s @ s.T
    np.fill_diagonal(s, -np.inf)
    edges = [(i, int(u), float(s[i, u]), True) for i in range(200) for u in np.argsort(-s[i])[: neighbours.DEGREE]]
    graph = spark.createDataFrame(edges, "v long, u long, s float, fresh boolean")
    assert neighbours._joined_neighbours(graph, nodes, 4).count() < 20  # each has its best; products may differ in the last bit
    centre = graph.filter("u <> 0").unionByName(spark.createDataFrame([(v, 0, -1.0, True) for v in range(1, 200)], graph.schema))
    got = neighbours._joined_neighbours(centre, nodes, 4).groupBy("u").count().collect()
    assert got  # what was taken away is offered again


def test_first_edges_are_as_good_in_many_partitions(spark, monkeypatch):
    random = np.random.default_rng(9)
    x = random.standard_normal((900, 16))
    x[:400] = np.ones(16) + 0.01 * random.standard_normal((400, 16))  # near copies: more than a chunk in one leaf
    nodes = neighbours._codes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, x array<double>"))
    monkeypatch.setattr(neighbours, "CHUNK", 128)
    few = {(r.v, r.u) for r in neighbours._first_edges(nodes, 900, 4).collect()}
    for name in ("repartition", "repartitionByRange"):
        deal = getattr(type(nodes), name)
        monkeypatch.setattr(type(nodes), name, lambda self, n, *columns, deal=deal: deal(self, max(60, n), *columns))
    assert {(r.v, r.u) for r in neighbours._first_edges(nodes, 900, 60).collect()} == few
    assert len(few) == 900 * neighbours.DEGREE
    sizes = [r["count"] for r in neighbours._chunks(nodes, 900).groupBy("chunk").count().collect()]
    assert len(sizes) == neighbours.ORDERS * 7 and sum(sizes) == neighbours.ORDERS * 900 and max(sizes) < 2 * 128


def test_first_edges_within_a_chunk_are_the_best(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal((450, 16))
    nodes = neighbours._codes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, x array<double>"))
    monkeypatch.setattr(neighbours, "ROWS", 100)  # the last rows of a chunk are fewer
    s = neighbours._matrix([r.code for r in nodes.orderBy("v").collect()])
    s = s @ s.T
    np.fill_diagonal(s, -np.inf)
    got = {}
    for r in neighbours._first_edges(nodes, 450, 3).collect():
        got.setdefault(r.v, set()).add(r.u)
    assert got == {i: set(np.argsort(-s[i])[: neighbours.DEGREE].tolist()) for i in range(450)}


def test_a_walk_that_finds_too_little_is_widened(spark):
    x = np.random.default_rng(6).standard_normal((150, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, x array<double>")
    nodes = neighbours._codes(rows)
    graph = spark.createDataFrame([(0, 1, 1.0)], "v long, u long, s float")  # leads nowhere
    queries = nodes.filter("v < 5").withColumnRenamed("v", "q")
    truth = neighbours.true_nearest([(i, x[i].tolist()) for i in range(5)], rows, 21)
    assert {(r.q, r.v) for r in truth.collect()} == {(q, v) for q in range(5) for v in np.argsort(-(x @ x[q]))[:21]}
    found = neighbours.searched(queries, graph, nodes, 150, truth)
    assert truth.join(found, ["q", "v"], "left_anti").count() == 0


def test_each_query_walks_once_at_the_width_that_is_found(spark, monkeypatch):
    x = np.random.default_rng(7).standard_normal((400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    walked, walk = [], neighbours.search

    def search(queries, starts, ways, kept=neighbours.KEPT):
        walked.append((kept, sorted(r.q for r in queries.collect())))
        assert {r.q for r in starts.collect()} == set(walked[-1][1])
        return walk(queries, starts, ways, kept)

    monkeypatch.setattr(neighbours, "search", search)
    monkeypatch.setattr(neighbours, "MEASURED", 5)
    near = neighbours.nearest(table)
    assert len({kept for kept, _ in walked}) * 5 == sum(len(q) for _, q in walked[:-1])
    assert sorted(walked[-2][1] + walked[-1][1]) == list(range(0, 400, 20)) and walked[-2][0] == walked[-1][0]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit [q#") == 2  # of a query's nodes only the nearest meet their members
    got = {}
    for r in near.collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q, found in got.items():
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-float(x[i] @ x[q]), i))[:20]
        assert len(set(order) & set(found.values())) >= 18 and list(found) and len(found) == 20


def test_a_step_of_a_walk_is_counted_as_it_is_written(spark, monkeypatch):
    x = np.random.default_rng(6).standard_normal((40, 8))
    nodes = neighbours._codes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, x array<double>"))
    table, n = neighbours._counted(nodes, F.col("v") % 4 == 0)
    assert n == 10 and table.count() == 40
    table, n = neighbours._counted(nodes.filter("v < 0"), F.col("v") % 4 == 0)
    assert n == 0 and table.count() == 0
    ways = nodes.select(F.col("v"), F.array("v").alias("to"), F.array("code").alias("codes"))
    queries = nodes.withColumnRenamed("v", "q")
    starts = neighbours._starts(queries, spark.createDataFrame([], "v long, u long, s float"))
    with monkeypatch.context() as patched:
        patched.setattr(type(nodes), "count", None)  # a job of its own in each step
        found = neighbours.search(queries, starts, ways)
    assert sorted((r.q, r.v) for r in found.collect()) == [(i, i) for i in range(40)]


def test_few_labels_beside_many_documents_are_all_used(spark):
    good, bad = F.lit("A calm and well written sentence about rivers. "), F.lit("BUY!!! $$$ 1234 ||| CLICK @@@ ")
    docs = prepared(spark).range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, good).otherwise(bad).alias("text"))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 12, 2)], "doc_id long, quality long")
    model = quality.train(docs, labels, sample=200)  # one share for both sides leaves 0.2 of the 6 labels
    scores = {r.doc_id % 2: r.score for r in quality.score(docs.filter("doc_id >= 5990"), model).collect()}
    assert scores[0] > 0.5 > scores[1]
    zeros = labels.unionByName(spark.createDataFrame([(i, 0) for i in range(1, 37, 2)], "doc_id long, quality long"))
    assert quality.train(docs, zeros, sample=200).prior == 0.25


KEY = "AKIA" + "Q7" * 9


def b64(data):
    return base64.b64encode(data).decode()


def found_in(text, most=1 << 22):
    return {text[s.start : s.end] for s in secret_scan.find_secrets(text, most)[1]}


def tarred(data):
    box = io.BytesIO()
    with tarfile.open(fileobj=box, mode="w") as tar:
        head = tarfile.TarInfo("x")
        head.size = len(data)
        tar.addfile(head, io.BytesIO(data))
    return box.getvalue()


@pytest.mark.parametrize("data", [
    f"clé {KEY} été".encode("latin-1"), b"log line \xff " + KEY.encode() + b" end", gzip.compress(tarred(KEY.encode())),
    bytes(range(256)) + KEY.encode() + bytes(200), f"$k = '{KEY}'".encode("utf-16-le"), f" $k = '{KEY}'".encode("utf-16-be"),
    gzip.compress(b"first ") + gzip.compress(KEY.encode()), bz2.compress(b"first") + bz2.compress(KEY.encode()),
    lzma.compress(b"first") + lzma.compress(KEY.encode()), gzip.compress(b"first") + b"\xfe" + KEY.encode(),
])
def test_bytes_that_are_not_plain_text_are_scanned(data):
    assert found_in(f"see {b64(data)} there")
    assert KEY not in secret_scan.masked(f"see {b64(data)} there", 1 << 22) and "[secret]" in secret_scan.masked(f"see {b64(data)} there", 1 << 22)


def test_each_stream_has_a_budget_of_its_own():
    most, bomb, last = 1_000_000, b64(gzip.compress(bytes(1_000_000))), b64(KEY.encode())
    streams = f"{b64(gzip.compress(bytes(600_000) + KEY.encode()))} {bomb} {last}"  # over half of it, all of it, a short line
    _, spans, _, refused = secret_scan.find_secrets(streams, most)
    assert not refused and {s.start for s in spans} == {0, streams.rindex(" ") + 1}
    plain = b64(b"word " * 300_000 + KEY.encode())
    assert secret_scan.find_secrets(plain, most)[1] and not secret_scan.find_secrets(plain, most)[3]


def test_what_is_beyond_the_budget_is_masked():
    bomb = b64(gzip.compress(bytes(3_000_000) + KEY.encode()))
    assert secret_scan.find_secrets(f"a {bomb} b", 1_000_000)[3] == 1
    assert secret_scan.masked(f"a {bomb} b", 1_000_000).replace("=", "") == "a [secret] b"
    early = b64(gzip.compress(KEY.encode() + bytes(3_000_000)))
    assert secret_scan.find_secrets(early, 1_000_000)[1]


def wrapped(data, width):
    text = b64(data)
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("word", ["after", "the", "then", "Please", "and", "x"])
@pytest.mark.parametrize("width", [76, 24, 16, 8])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, lambda d: base64.b64encode(d)])
def test_a_wrapped_block_beside_prose(word, width, pack):
    for pad in range(3):
        block = wrapped(pack(b"pad " * 11 + b"p" * pad + b" " + KEY.encode() + b" tail" * 11), width)
        text = f"see\n{block}\n{word} more"
        assert any(text[s.start : s.end] for s in secret_scan.find_secrets(text, 1 << 22)[1]), (text, pad)
        assert secret_scan.find_secrets(f"{word} {block}\nmore", 1 << 22)[1]


def test_a_short_last_line_is_read():
    block = wrapped(b"x" * 44 + KEY.encode(), 76)
    text = f"{block}\nafter"
    assert len(block.split("\n")[-1]) < 20
    assert {secret_scan.KINDS[s.kind] for s in secret_scan.find_secrets(text, 1 << 22)[1]} == {"access"}


@pytest.mark.parametrize("before", ["https://host.com/cb/", "id_", "x/", "a-", "ab+", "see ", "q", "abc", "abcd"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_base64_behind_letters_of_its_alphabet(before, pack):
    if pack is zlib.compress and before in ("q", "abc", "abcd"):
        return  # two bytes of a magic number are no sign in the middle of letters
    data = pack(f"say {KEY} now".encode())
    for block in (b64(data), base64.urlsafe_b64encode(data).decode()):
        text = f"go {before}{block} on"
        found = [text[s.start : s.end] for s in secret_scan.find_secrets(text, 1 << 22)[1]]
        assert found and all(f in text for f in found)
        assert KEY not in secret_scan.masked(text, 1 << 22)


@pytest.mark.parametrize("joint", ["\n    ", "\n> ", "\r\n\t", '" +\n    "', "' \\\n'", '",\n"', '"\n"'])
def test_lines_of_a_block_may_be_indented_or_quoted(joint):
    block = wrapped(b"pad " * 11 + KEY.encode() + b" tail" * 11, 24).replace("\n", joint)
    assert secret_scan.find_secrets(f'x = "{block}"\nok', 1 << 22)[1]


@pytest.mark.parametrize("text", [
    "%" + "25" * 100_000 + f"41{KEY[1:]}", "%" * 60_000 + "25" * 60_000 + f"41{KEY[1:]}", "\\u005c" + "u005c" * 40_000 + f"u0041{KEY[1:]}",
    "%5Cu0025" + "5Cu0025" * 20_000 + f"41{KEY[1:]}",
])
def test_nested_escapes_take_time_in_proportion(text):
    begin = time.process_time()
    _, spans, layers, _ = secret_scan.find_secrets(text, 1 << 22)
    assert time.process_time() - begin < 4 and layers < 10
    assert any(s.kind == 1 and s.end == len(text) for s in spans)


def test_all_escapes_at_once_are_those_one_after_the_other():
    random = np.random.default_rng(8)
    parts = ["%", "25", "41", "4", "1", "\\u", "0041", "005c", "u", "\\x41", "&#65;", "&#x25;", "\\u{41}", "c3%a9", "%C3%A9", "\\ud83d\\ude00", "z"]
    for _ in range(300):
        text = "".join(random.choice(parts, 12))
        layer, seen = secret_scan.Layer.whole(text), []
        scanner = secret_scan.Scanner("", 1 << 20)
        scanner._queue = lambda found, new=False: seen.append(found)
        scanner._unescaped(layer)
        assert not secret_scan._PERCENT.search(seen[-1].text) and len(seen[-1].starts) == len(seen[-1].text)
        assert (seen[-1].starts < seen[-1].ends).all() and (np.diff(seen[-1].starts) >= 0).all()
    assert secret_scan.find_secrets("tok%2565n=abcdefghijklmnop", 1 << 20)[1][0].start == 0


def test_very_long_texts_are_scanned_whole():
    far = "word " * 200_000 + b64(f"x {KEY}".encode()) + " word" * 200_000 + " token=abcdefghijklmnop"
    assert len(secret_scan.find_secrets(far, 1 << 22)[1]) == 2


def test_ids_are_the_tokenizers():
    plain = Tokenizer.from_file(queries.WORD_VOCABULARY)
    random = np.random.default_rng(11)
    marks = list(".,;:!?|\"#$%&*()")
    letters = list("abzAZÉéßÖİıſΣςσЖж漢かกñ") + ["é", "́", "̇", "क़", "ﬁ", "½", "Ⅷ", "7", "'s", "²", "K", "क़"]
    texts = []
    for _ in range(20_000):
        words = ["".join(random.choice(letters, random.integers(1, 7))) + "".join(random.choice(marks, random.integers(0, 3))) for _ in range(3)]
        texts.append(random.choice([" ", "\n", "  "]).join(words))
    texts.append("GÜVENLİ, YENİ. SERİ;")
    got = packing.WordTokenizer(queries.WORD_VOCABULARY).ids(texts)
    expected = plain.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, g, e in zip(texts, got, expected) if g != np.array(e.ids, "<u4").tobytes()]
    assert not wrong, (len(wrong), wrong[:5])


def test_very_long_words_and_texts_are_packed_whole():
    plain = Tokenizer.from_file(queries.WORD_VOCABULARY)
    for text in ("é" * 30_000, "x" * 50_000, "Ab, " * 100_000):
        assert packing.WordTokenizer(queries.WORD_VOCABULARY).ids([text]) == [np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_the_step_follows_the_gradient_of_the_non_negative_risk():
    random = np.random.default_rng(9)
    seen = set()
    for _ in range(60):
        p, u = random.standard_normal((9, 4)) + 1, random.standard_normal((13, 4))
        w, prior = 2 * random.standard_normal(5), random.uniform(0.1, 0.95)

        def plain(w):
            g = [sum(a * b for a, b in zip(row, w)) + w[-1] for row in p]
            h = [sum(a * b for a, b in zip(row, w)) + w[-1] for row in u]
            good = prior * np.mean([np.log(1 + np.exp(-x)) for x in g])
            bad = np.mean([np.log(1 + np.exp(x)) for x in h]) - prior * np.mean([np.log(1 + np.exp(x)) for x in g])
            return good, bad

        good, bad, gradient = quality.risk_step(w, p, u, prior)
        assert np.allclose((good, bad), plain(w))
        follow = (lambda w: sum(plain(w))) if bad >= 0 else (lambda w: -plain(w)[1])
        steps = np.eye(5) * 1e-6
        assert np.allclose(gradient, [(follow(w + d) - follow(w - d)) / 2e-6 for d in steps], atol=1e-6)
        seen.add(bad >= 0)
    assert seen == {True, False}


def test_rows_of_one_id_are_one_training_row(spark):
    good, bad = "A calm and well written sentence about rivers. ", "BUY!!! $$$ 1234 ||| CLICK @@@ "
    rows = [(i, good if i % 2 == 0 else bad) for i in range(200)] + [(0, good * (1 + i % 7)) for i in range(3000)] + [(1, bad)] * 3000
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)] + [(0, None), (2, 0), (None, 1)], "doc_id long, quality long")
    taken = []
    real = quality.fit
    quality.fit = lambda p, u, *a, **k: taken.append((len(p), len(u))) or real(p, u, *a, **k)
    try:
        model = quality.train(docs, labels)
    finally:
        quality.fit = real
    assert set(taken) == {(20, 180)}
    scores = {r.doc_id: r.score for r in quality.score(docs.filter("doc_id in (100, 101)"), model).collect()}
    assert scores[100] > scores[101]


def test_long_words_are_scored_over_all_their_segmentations():
    pieces = language_id.pieces_of(queries.PIECE_VOCABULARY)
    random = np.random.default_rng(10)
    p = random.dirichlet(np.full(len(pieces.names), 0.3), 3).T
    known = {name: i for i, name in enumerate(pieces.names)}
    words = ["▁" + "".join(random.choice(list("abcdeinrstß漢"), n)) for n in (3, 39, 40, 41, 80, 81, 200, 79)]
    got = language_id.word_scores(pieces, words, p)
    for word, row in zip(words, got):
        for k in range(3):
            alpha = [0.0] + [float("-inf")] * len(word)  # logs, so nothing underflows
            for end in range(1, len(word) + 1):
                ways = [alpha[end - 1] + np.log(language_id._STRANGE_P)]
                for start in range(max(0, end - pieces.longest), end):
                    i = known.get(word[start:end])
                    if i is not None and p[i, k] > 0:
                        ways.append(alpha[start] + np.log(p[i, k]))
                alpha[end] = float(np.logaddexp.reduce(ways))
            assert row[k] == pytest.approx(alpha[-1], rel=1e-9)


def test_copies_of_one_text_do_not_decide_whether_a_language_is_learned(spark):
    rows = [(i, "en", "the river runs along the old town") for i in range(300)] + [(1000 + i, "de", f"der fluss {i} geht durch die alte stadt") for i in range(300)]
    docs = prepared(spark).createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(docs, queries.PIECE_VOCABULARY, rounds=2, per_language=30)
    found = {r.doc_id: r.lang_pred for r in language_id.identify(docs.filter("doc_id in (0, 1000)"), model).collect()}
    assert found == {0: "en", 1000: "de"}


def test_training_rows_are_held_once_on_the_driver(spark):
    n = 6000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', id, id % 7, id % 11) AS text")
    labels = spark.range(0, n, 2).selectExpr("id AS doc_id", "cast(id % 4 = 0 AS int) AS quality")
    quality.train(docs.limit(50), labels.limit(50))  # imports
    rows = n * 3 // 4 * (len(quality.NAMED) + quality.PAIRS) * 4
    tracemalloc.start()
    try:
        quality.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5 * rows  # once as read, once standardised, and parts in double precision
