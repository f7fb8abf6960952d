"""Removal of repeated windows of words by level-wise doubling.

A window can only be repeated if every shorter window inside it is. So lengths double from level to level: windows that are
repeated at one length alone are extended to twice that length (one word less where that is one too many), until the wanted length
is reached or no candidates survive.

Below the wanted length not every window need be counted. Of the windows inside a wanted one, that with the least hash is its
guard: it depends on nothing but the words, so equal wanted windows have equal guards at equal places, and neighbours mostly share
theirs. A wanted window stays a candidate while its guard at each level is repeated. At the last level every candidate is counted,
by a 96-bit hash, and placed by an exact join.

A count is an aggregation that begins in the tasks which read the texts, so a passage that a third of all documents share is one
row a task. Repeated guards are looked up in a bit map of checked size; beyond it they are joined, exactly. Texts are not shuffled
until the repeated windows are known, and then only those that may lose words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import hash_filter, in_filter, stored, text_or_empty
from tidemark.llm.shingles import mix

#: Windows of fewer words are no level of their own: too many are repeated by chance.
LEAST_WORDS = 16
#: Texts are hashed together until they have so many bytes. Numbers of 64 bits beside each take many times that memory.
TOGETHER = 1 << 18
#: Repeated guards go to a broadcast bit map up to so many, and to a join beyond.
MOST_IN_FILTER = 1 << 24

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_random = np.random.default_rng(12)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PER_BYTE, _PER_WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def level_lengths(length: int, least: int = LEAST_WORDS) -> list[int]:
    """Window lengths, rising, each half of the next (rounded up), from the first of `least` words or more to `length`."""
    out = [length]
    while (half := (out[0] + 1) // 2) >= least and half < out[0]:
        out.insert(0, half)
    return out


def _table(base: int, size: int) -> np.ndarray:
    out = np.full(size, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_kept_table = lru_cache(maxsize=4)(_table)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64. Only one table of each is kept, none of a very long text."""
    usual = 2 * TOGETHER
    table, size = (_kept_table, usual) if n <= usual else (_table, n)
    return table(base, size)[:n], table(pow(base, -1, 1 << 64), size)[:n]


class Words:
    """The words of some texts (UTF-8), one after the other: where they lie and hashes of windows of them."""

    def __init__(self, texts: list[bytes]) -> None:
        self.flat = b" ".join([*texts, b""])
        data = np.frombuffer(self.flat, np.uint8)
        blank = _BLANK[data]
        before = np.concatenate([[True], blank[:-1]])
        self.start, self.end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        #: Number of the first word of each text, and of all words.
        self.first = np.searchsorted(self.start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        up, down = _powers(_PER_BYTE, len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up)])
        self.hashes = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def whole(self, length: int) -> np.ndarray:
        """Words at which a window of this length starts that lies in one text."""
        return np.flatnonzero(np.arange(len(self.text)) + length <= self.first[1:][self.text])

    def windows(self, length: int, salt: int = 0) -> np.ndarray:
        """Hash of the window that starts at each word. One that leaves its text means nothing."""
        n = len(self.hashes)
        up, down = _powers(_PER_WORD, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes, salt) * up)])
        return mix((sums[np.minimum(np.arange(n) + length, n)] - sums[:-1]) * down, salt)

    def guards(self, length: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the window of `length` words at each word, the place of its guard of `part` words; and the hash of each such guard,
        spread evenly, since guards are least hashes."""
        hashes = self.windows(part, part)
        return _least_places(hashes, length - part + 1), mix(hashes, 1)


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each place that of the least of `width` values from there on, the first of equal ones."""
    place, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        other = np.concatenate([place[step:], np.repeat(place[-1:], step)])[: len(place)]
        place = np.where(values[other] < values[place], other, place)
        reach += step
    return place


class Level:
    """How candidates are told at a level: filters of repeated guards of the levels before it, and, if a level before had too many
    for a filter, the places of its repeated guards in a column beside each text."""

    def __init__(self, length: int, filters: tuple[tuple[int, Broadcast], ...] = (), placed: int | None = None) -> None:
        self.length, self.filters, self.placed = length, filters, placed

    def candidates(self, words: Words, known: list[list[int] | None]) -> np.ndarray:
        """Words at which a window starts whose guards so far are all repeated."""
        window = words.whole(self.length)
        if self.placed and len(window):
            at = [words.first[i] + np.array(k) for i, k in enumerate(known) if k]
            seen = np.zeros(len(words.text) + 1, bool)
            seen[np.concatenate(at).astype(np.int64) if at else []] = True
            window = window[seen[words.guards(self.length, self.placed)[0][window]]]
        for part, repeated in self.filters:
            if len(window):
                place, hashes = words.guards(self.length, part)
                window = window[in_filter(repeated.value, hashes[place[window]])]
        return window

    def places(self, words: Words, known: list[list[int] | None], part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, h, g) of the candidates' different guards of `part` words; if that is the whole length, of the candidates."""
        window = self.candidates(words, known)
        if part < self.length:
            place, hashes = words.guards(self.length, part)
            window = np.unique(place[window])
            return window, hashes[window], np.zeros(len(window), np.uint32)
        second = words.windows(part, 1) >> np.uint64(32)
        return window, words.windows(part)[window], second[window].astype(np.uint32)


def _together(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes], list[list[int] | None]]]:
    """Runs of about TOGETHER bytes of the rows (key, text, known)."""
    keys, texts, known = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
    at, size = 0, 0
    for i, text in enumerate(texts, 1):
        size += len(text)
        if size >= TOGETHER or i == len(texts):
            yield keys[at:i], texts[at:i], known[at:i]
            at, size = i, 0


def _counted(texts: DataFrame, level: Level, part: int) -> DataFrame:
    """(h, g) that occur more than once. Equal ones of a run of texts are one row already, then those of a task, then all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some, known in _together(batch):
                _, h, g = level.places(Words(some), known, part)
                order = np.lexsort((g, h))
                h, g = h[order], g[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))[: len(h)]
                n = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(g[new].view(np.int32)), pa.array(n)], names=["h", "g", "n"])

    found = texts.mapInArrow(run, "h long, g int, n long")
    return found.groupBy("h", "g").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "g")


def _placed(texts: DataFrame, level: Level, part: int, repeated: DataFrame, seen: Broadcast | None) -> DataFrame:
    """(key, place) of the level's guards or windows that are repeated: those that pass the filter, if any, joined exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, some, known in _together(batch):
                words = Words(some)
                place, h, g = level.places(words, known, part)
                may = in_filter(seen.value, h) if seen else np.ones(len(h), bool)
                place, text = place[may], words.text[place[may]]
                columns = [
                    pa.array(h[may].view(np.int64)), pa.array(g[may].view(np.int32)),
                    pa.array(keys, pa.binary()).take(pa.array(text)), pa.array((place - words.first[text]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "g", "key", "place"])

    found = texts.mapInArrow(run, "h long, g int, key binary, place int")
    return found.join(repeated, ["h", "g"]).groupBy("key").agg(F.collect_set("place").alias("places"))


def repeated_windows(texts: DataFrame, length: int, least: int = LEAST_WORDS) -> DataFrame:
    """(key, places): in which texts, and at which words (from 0), a window of `length` words starts that also starts elsewhere.

    texts has key (binary, equal for equal texts) and text. Each row is a text of its own. A key's places are at most the words of
    its text."""
    spark = texts.sparkSession
    texts, level = texts.select("key", "text", F.lit(None).cast("array<int>").alias("known")), Level(length)
    for part in level_lengths(length, least):
        repeated = stored(_counted(texts, level, part))
        n = repeated.count()
        small = 0 < n <= MOST_IN_FILTER
        seen = spark.sparkContext.broadcast(hash_filter(repeated)) if small or part == length else None
        if part == length or not n:
            return _placed(texts, level, part, repeated, seen)
        if small:
            level = Level(length, (*level.filters, (part, seen)), level.placed)
        else:
            places = _placed(texts, level, part, repeated, None)
            texts = texts.drop("known").join(places.withColumnRenamed("places", "known"), "key")
            texts, level = stored(texts), Level(length, (), part)


def remove_repeated_windows(docs: DataFrame, length: int = 35, least: int = LEAST_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed (long), kept_sha256 (lowercase hex, kept words joined by a space).

    docs needs doc_id and text; other columns are ignored. Words are maximal runs of characters other than space and \\x09-\\x0D,
    unchanged. A word goes if a window of `length` words covers it that also starts anywhere else in the table, in the same text
    or another. Windows are judged on the input, so all copies of a passage go. Each row is a document of its own, whatever its
    id: repeated rows are copies of each other. A null text has no words; a text of fewer words than a window keeps all. An empty
    table gives no rows.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    places = stored(repeated_windows(rows, length, least))
    losing = hash_filter(places.select(F.xxhash64("key").alias("h")))
    sent = docs.sparkSession.sparkContext.broadcast(losing)  # bounded; only spares texts a shuffle
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            may = in_filter(sent.value, batch.column(3).to_numpy().view(np.uint64))
            kept = [(0, None) if m else _cut(t, None, length)[::2] for t, m in zip(texts, may)]
            n, sha = zip(*kept)
            left = [t if m else None for t, m in zip(texts, may)]
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_words", "kept_sha256", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, sha, text, at in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                out.append((n, 0, sha) if text is None else _cut(text, at, length))
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    counts = rows.select("doc_id", "key", "text", F.xxhash64("key").alias("h")).mapInArrow(
        counted, f"doc_id {id_type}, key binary, n_words long, kept_sha256 string, text binary"
    )
    joined = counts.join(places, "key", "left").select("doc_id", "n_words", "kept_sha256", "text", "places")
    return joined.mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")


def _cut(text: bytes, places: list[int] | None, length: int) -> tuple[int, int, str]:
    """Number of words, of words that go, and the hash of those that stay."""
    words = text.translate(_ONE_BLANK).split(b" ")
    words = [w for w in words if w]
    if places:
        edges = np.zeros(len(words) + 1, np.int64)
        places = np.array(places)
        np.add.at(edges, places, 1)
        np.add.at(edges, places + length, -1)
        stays = np.cumsum(edges[:-1]) == 0
        kept = [w for w, s in zip(words, stays) if s]
    else:
        kept = words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


_ONE_BLANK = bytes(32 if _BLANK[b] else b for b in range(256))
