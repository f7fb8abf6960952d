"""Jaccard join, repeated passages, suffix order and fingerprints against plain versions."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from tests.llm.data import messy_docs, no_docs, prose, rows_of, SCHEMA, shingle_set
from tidemark.llm import fingerprints, jaccard_join, repeats, shared, shingles
from tidemark.llm.components import connected_components
from tidemark.llm.suffix_sort import neighbour_prefixes, window_order


def plain_components(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = [(r[0], shingle_set(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {(r[0], len(shingle_set(r[1])), find(r[0]) if r[0] is not None else None) for r in rows}


def chains(seed):
    """Groups of near copies in which each text is like the next one only, and texts that share much but not enough."""
    random_ = random.Random(seed)
    out = []
    for group in range(6):
        words = prose(seed * 100 + group, 150).split(" ")
        for _ in range(8):
            at = random_.randrange(len(words) - 20)
            words = [*words[:at], *prose(random_.random(), 10).split(" "), *words[at + 10 :]]
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chains(spark, seed):
    rows = rows_of(chains(seed))
    random.Random(seed).shuffle(rows)
    got = jaccard_join.similar_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == plain_components(rows)


def test_components_with_common_shingles_last(spark, monkeypatch):
    rows = rows_of([f"{prose(5, 40)} {t}" for t in chains(3)])
    monkeypatch.setattr(jaccard_join.common_shingles, "__defaults__", (1, 3, 200_000))
    got = jaccard_join.similar_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == plain_components(rows)


def test_shingles_of_many_texts_take_little_memory(spark):
    texts = [prose(i, 150).encode() for i in range(3000)]
    tracemalloc.start()
    for _ in shingles.shingle_sets(texts):
        pass
    for _ in shingles.shingle_sets([b" ".join(texts[:900])]):
        pass
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 96 << 20 and held < 12 << 20
    shared.prepared(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_components_of_messy_rows(spark):
    docs, rows = messy_docs(spark)
    got = jaccard_join.similar_components(docs)
    assert got.count() == len(rows)
    assert {tuple(r) for r in got.collect()} == plain_components(rows)
    assert jaccard_join.similar_components(no_docs(spark)).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (200, 200), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 200: 200}


def plain_repeats(rows):
    seen, out = {}, {}
    places = sorted({(r[0] if r[0] is not None else repeats.NO_ID, (r[1] or "").encode()) for r in rows})
    for key, text in places:
        for i in range(len(text) - 99):
            seen[text[i : i + 100]] = min(seen.get(text[i : i + 100], (key, i)), (key, i))
    for key, text in places:
        gone = bytearray(len(text))
        for i in range(len(text) - 99):
            if seen[text[i : i + 100]] < (key, i):
                gone[i : i + 100] = b"\x01" * 100
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key, text] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((r[0] is None, r[0] or 0, *out[r[0] if r[0] is not None else repeats.NO_ID, (r[1] or "").encode()]) for r in rows)


@pytest.mark.parametrize("bucket", [20_000, 2])
def test_repeats_of_messy_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    docs, rows = messy_docs(spark)
    shared = prose(11, 60)
    rows = rows + rows_of([f"{prose(20 + i, 15)} {shared} {prose(40 + i, 15)}" for i in range(12)], first=1000)
    rows += rows_of(["-" * 500, "-" * 150 + "a" * 150, "a" * 150 + "-" * 150, shared[:99], shared[5:105]], first=2000)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [(r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(got) == plain_repeats(rows)
    assert repeats.remove_repeats(no_docs(spark)).count() == 0


@pytest.mark.parametrize("letters,depth", [("ab", 6), ("abcdef", 4), ("a", 5), ("zyx", 8)])
def test_window_order(letters, depth):
    random_ = random.Random(letters)
    parts = ["".join(random_.choices(letters, k=random_.randint(depth, 40))) for _ in range(30)]
    text = np.frombuffer("\0".join([*parts, ""]).encode(), np.uint8)
    flat = text.tobytes()
    starts = np.array([i for i in range(len(text) - depth + 1) if b"\0" not in flat[i : i + depth]])
    order = window_order(text, starts, depth)
    assert sorted(order) == list(starts)
    windows = [flat[i : i + depth] for i in order]
    assert windows == sorted(windows)
    prefixes = neighbour_prefixes(text, order, depth)
    same = lambda a, b: next((k for k in range(depth) if a[k] != b[k]), depth)
    assert list(prefixes[1:]) == [same(a, b) for a, b in zip(windows, windows[1:])]


def test_only_shared_windows_are_sorted_by_place(monkeypatch):
    data = [prose(i, 60).encode() for i in range(40)]
    data += [data[3][20:180], data[5][:140] + data[7][:130]]
    keys, lows = np.arange(len(data)), np.zeros(len(data), np.int64)
    lengths, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda by: lengths.append(len(by[0])) or lexsort(by))
    got = [tuple(map(int, r)) for r in zip(*repeats._later_windows(keys, lows, data, [None] * len(data)))]
    assert got == [(40, 0, 160), (41, 0, 140), (41, 140, 270)]
    assert max(lengths) == 2 * (61 + 41 + 31)
    assert not len(repeats._later_windows(keys[:9], lows[:9], data[:9], [None] * 9)[0])


def test_fingerprints(spark):
    docs, rows = messy_docs(spark)
    got = fingerprints.fingerprint_documents(docs).toPandas()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    expected = []
    for i, r in enumerate(ordered):
        text, following = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        expected.append((r[0] is None, r[0] or 0, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    nulls = got["doc_id"].isna()
    ours = zip(nulls, got["doc_id"].fillna(0).astype(int), got["n_chars"], got["edited_sha256"])
    assert sorted(ours) == sorted(expected)
    of = {}
    for doc_id, print_ in zip(got["doc_id"].fillna(-1), got["fingerprint"]):
        of.setdefault(int(doc_id), set()).add(print_)
    assert of[0] == of[1] == of[12] and all(len(v) == 1 for v in of.values())
    assert of[4] == {""} and got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()
    assert fingerprints.fingerprint_documents(no_docs(spark)).count() == 0


def test_likeness_estimates_jaccard(spark):
    words = prose(1, 600).split(" ")
    texts = [" ".join(words), *(" ".join([*words[: 600 - k], *prose(k, k).split(" ")]) for k in (60, 150, 300)), " ".join(words[:90])]
    rows = spark.createDataFrame(rows_of(texts), SCHEMA).select("doc_id", fingerprints.fingerprint(fingerprints.F.col("text")).alias("p"))
    first = rows.filter("doc_id = 0").select(fingerprints.F.col("p").alias("p0"))
    got = dict(map(tuple, rows.join(first).select("doc_id", fingerprints.likeness(fingerprints.F.col("p"), fingerprints.F.col("p0"))).collect()))
    a = shingle_set(texts[0])
    for i, text in enumerate(texts):
        b = shingle_set(text)
        assert abs(got[i] - len(a & b) / len(a | b)) < 0.12


def test_few_bins_are_filled_alike(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "a b d"), (4, "")], "doc_id long, text string")
    got = {r[0]: r[1] for r in rows.select("doc_id", fingerprints.fingerprint(fingerprints.F.col("text"))).collect()}
    assert got[1] == got[2] != got[3] and len(got[1]) == fingerprints.WORDS and got[4] is None
