"""Conversation repair, repeated windows of words and centroid clustering against plain versions."""

import hashlib
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.data import SCHEMA, WORD, messy_docs, no_docs, prose, rows_of
from tidemark.llm import centroids, conversation_repair, word_windows

TALK = "conv_id long, turn long, role string, text string, part int, audit string, fault string, reversed string, lost int"


def plain_repair(rows, damage=True):
    """rows of one conversation (conv_id, turn, role, text) to counts, cost, audit and hash, by trying every edit."""
    now = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = zlib.crc32(name.encode()) % 20 if damage else 19
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        now += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    now.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in now:
        full = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    turns = [r[0] for r in now if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(now, now[1:]))

    def fits(initials):
        return re.fullmatch("(s?(ua)*u?|s)", initials) is not None  # can still become legal

    @lru_cache(None)
    def best(i, tail, inserted):
        """(cost, audit, repaired) from row i on; tail is what matters of the initials so far."""
        found = []
        if i == len(now) and re.fullmatch("(s?(ua)+)?", tail):
            found.append((0, "", ()))

        def then(cost, letter, row, i, inserted):
            nonlocal found
            start = tail if row is None else tail + row[0][:1]
            if row is not None and (not row[0] or not fits(start)):
                return
            start = start if len(start) < 5 else start[:-2]
            rest = best(i, start, inserted)
            if rest:
                found.append((cost + rest[0], letter + rest[1], ((row,) if row else ()) + rest[2]))

        if inserted < 3:
            for role in ("user", "assistant"):
                then(2, "I", (role, ""), i, inserted + 1)
        if i < len(now):
            _, role, text = now[i]
            then(3, "D", None, i + 1, 0)
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                then(extra, "K", (role, text), i + 1, 0)
                for other in ("user", "assistant"):
                    then(2 + extra, "R", (other, text), i + 1, 0)
        return min(found) if found else None

    cost, audit, repaired = best(0, "", 0)
    text = "\n".join(f"{role}:{text}" for role, text in repaired)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def check_repairs(spark, rows, damage=True, partitions=None):
    table = spark.createDataFrame([(*r, 1, "x", "y", "z", 2) for r in rows], TALK).repartition(3)
    got = conversation_repair.repair_conversations(table, damage, partitions).collect()
    expected = {c: plain_repair([r for r in rows if r[0] == c], damage) for c in {r[0] for r in rows}}
    assert len(got) == len(expected)
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected


ROLES = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "sys", "u", "über"]
TEXTS = ["Yes.", "No!", "Why?\n", "cut off", None, "", " \t", "Yes.", "é.", "a\nb", ". x", " ", "ends. "]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repairs_of_messy_conversations(spark, seed):
    random_ = random.Random(seed)
    rows = []
    for conv in range(150):
        for turn in range(random_.randint(1, 9)):
            turn = random_.choice([turn, turn, turn, turn, None, 2 * turn, 3, -1])
            rows.append((conv if conv else None, turn, random_.choice(ROLES), random_.choice(TEXTS)))
    rows += rows[:20]
    check_repairs(spark, rows)
    check_repairs(spark, rows, damage=False, partitions=3)


def test_repairs_of_long_and_of_lost_conversations(spark):
    sys.setrecursionlimit(20_000)
    random_ = random.Random(4)
    long = [(7, t, random_.choice(["user", "assistant"]), prose(t % 40, 3) + random_.choice([".", "", "!"])) for t in range(300)]
    lost = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:5".encode()) % 20 == 0)
    check_repairs(spark, [*long, (lost, 5, "user", "All of it goes.")])
    found = conversation_repair.repair_conversations(spark.createDataFrame([(lost, 5, "user", "x", 1, "x", "y", "z", 2)], TALK)).first()
    assert tuple(found) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    assert conversation_repair.repair_conversations(spark.createDataFrame([], TALK)).count() == 0


def test_very_long_texts_in_one_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], prose(t, 60_000) + ".") for t in range(4)]
    check_repairs(spark, rows)


def test_nodes_are_shared_and_few():
    automaton = conversation_repair.Automaton()
    random_ = random.Random(5)
    for _ in range(2000):
        node = 0
        for letter in random_.choices("dsuaoSUAO", k=12):
            node = automaton.before(letter, node)[0]
    assert len(automaton.costs) < 60 and len(automaton.arcs) <= 9 * len(automaton.costs)
    assert conversation_repair._common("abcd", "abxd") == 2 and conversation_repair._common("", "a") == 0


def plain_windows(rows, length):
    texts = [WORD.findall(r[1] or "") for r in rows]
    counts = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for row, words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - length + 1):
            if counts[tuple(words[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((row[0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def window_rows():
    shared = prose(11, 60)
    rows = rows_of([f"{prose(20 + i, 15)} {shared} {prose(40 + i, 15)}" for i in range(12)], first=1000)
    words = shared.split(" ")
    rows += rows_of([" ".join(words[:34]), " ".join(words[5:40]), "la " * 34, "la " * 36, "la  la\n" * 40, prose(9, 9000)], first=2000)
    return rows + rows_of([f"{prose(9, 9000)} {prose(8, 20)}", " ".join(words), f"{shared.upper()} x"], first=3000)


@pytest.mark.parametrize("length,least,most", [(35, 16, 1 << 24), (35, 16, 0), (35, 4, 0), (5, 16, 1 << 24), (40, 5, 3)])
def test_windows_of_messy_rows(spark, monkeypatch, length, least, most):
    monkeypatch.setattr(word_windows, "MOST_IN_FILTER", most)
    monkeypatch.setattr(word_windows, "TOGETHER", 3000)
    docs, rows = messy_docs(spark)
    rows = rows + window_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = word_windows.remove_repeated_windows(docs, length, least)
    assert Counter(tuple(r) for r in got.collect()) == plain_windows(rows, length)


def test_windows_of_no_or_different_texts(spark):
    assert word_windows.remove_repeated_windows(no_docs(spark)).count() == 0
    rows = rows_of([prose(i, 80) for i in range(5)])
    got = word_windows.remove_repeated_windows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.n_removed for r in got} == {0} and Counter(map(tuple, got)) == plain_windows(rows, 35)


def test_words_of_runs_of_many_sizes_take_little_memory():
    texts = [prose(i, 150).encode() for i in range(3000)]
    tracemalloc.start()
    for some in (3000, 1500, 700, 300, 100):
        batch = pa.RecordBatch.from_pydict({"key": texts[:some], "text": texts[:some], "known": [None] * some})
        for _, run, known in word_windows._together(batch):
            words_ = word_windows.Words(run)
            word_windows.Level(35).places(words_, known, 18)
            del words_
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 2_000_000 and most < 48 << 20


def test_level_lengths_double():
    assert word_windows.level_lengths(35) == [18, 35] and word_windows.level_lengths(100, 10) == [13, 25, 50, 100]
    assert word_windows.level_lengths(5) == [5] and word_windows.level_lengths(1) == [1]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 18])
def test_least_places(width):
    values = np.random.default_rng(width).integers(0, 9, 60).astype(np.uint64)
    got = word_windows._least_places(values, width)
    assert [int(g) for g in got[: 61 - width]] == [i + int(np.argmin(values[i : i + width])) for i in range(61 - width)]


def plain_clusters(rows, k=16, rounds=3, dimensions=64):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist())
    centres = [r[1] for r in sorted(kept, key=name)[:k]]

    def nearest(x):
        return min((int(((x - c) ** 2).sum()), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, group in groups.items():
            centres[j] = np.array([int(s) // len(group) for s in sum(group)])
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in found)


def vectors(n, dimensions, seed=1):
    random_ = np.random.default_rng(seed)
    rows = [(int(i), (random_.standard_normal(dimensions) + 3 * (i % 5)).astype(np.float32).tolist()) for i in range(n)]
    zero = [0.0] * dimensions
    return [*rows, *rows[:5], (3, rows[7][1] if n > 7 else zero), (None, rows[2][1] if n > 7 else zero), (900, None), (901, []), (902, zero), (903, zero), (904, zero[1:]),
            (905, [float("nan"), *zero[1:]]), (906, [float("-inf"), *zero[1:]]), (907, [None, *zero[1:]]), (908, [*zero, 0.0])]


@pytest.mark.parametrize("n,dimensions,pivots", [(300, 64, 16), (40, 8, 3), (5, 4, 0), (0, 64, 16)])
def test_clusters(spark, n, dimensions, pivots):
    rows = vectors(n, dimensions)
    schema = "vec_id long, embedding array<float>, x int, d string, cluster int, n int"
    table = spark.createDataFrame([(*r, 1, "d", 2, 3) for r in rows], schema).repartition(3)
    got = centroids.cluster_vectors(table, dimensions=dimensions, n_pivots=pivots)
    assert Counter(map(tuple, got.collect())) == plain_clusters(rows, dimensions=dimensions)


def test_no_vectors_and_too_large_ones(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.cluster_vectors(none).count() == 0 and centroids.cluster_vectors(none.limit(0)).count() == 0
    large = spark.createDataFrame([(1, [3e6] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(large, dimensions=4).count()


def test_pivots_rule_out_most_centroids():
    random_ = np.random.default_rng(3)
    centres = random_.integers(-4000, 4000, (16, 8))
    x = centres[random_.integers(0, 16, 2000)] + random_.integers(-60, 60, (2000, 8))
    pivots = centroids._far_apart(x[:200], 16)
    to_pivots = [np.sqrt(centroids._squares(m, pivots).astype(float)) for m in (x, centres)]
    number, distance, compared = centroids.nearest_centroid(x, to_pivots[0], centres, to_pivots[1])
    exact = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert compared < 2 * len(x)  # of 16 each
