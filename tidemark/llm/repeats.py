"""Removal of repeated passages: two-stage suffix sorting of those segments of the corpus that can hold a repeat.

A suffix array of every byte with 100 bytes of context would be 100 times the corpus. Instead, each 100-byte window names the
smallest hash among its 32-byte grams, so equal windows name the same one. A segment is a run of windows with one such hash:

1. Hashes that two places name, in any documents, are found by one shuffle of the hashes alone.
2. Segments with such hashes are told apart by (hash, content). Of equal segments the first place stays; all windows of the
   others start earlier in it, so their bytes go. Hot passages meet in partial aggregations, not in lists.
3. The first places of all different segments are sorted by suffixes, by hash, and windows whose neighbours have a common prefix
   of 100 bytes are equal; all but the first of them go.
4. The bytes that go are cut from their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import hash_filter, in_filter, stored
from tidemark.llm.shingles import mix
from tidemark.llm.suffix_sort import neighbour_prefixes, window_order

WINDOW, GRAM = 100, 32
#: Bytes of documents hashed together, bytes of segments sorted together, and segments that one bucket may hold.
TOGETHER, SORTED, BUCKET = 1 << 18, 2 << 20, 20_000
NO_ID = (1 << 63) - 1

_random = np.random.default_rng(7)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _random.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of `width` values."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


def _powers(n: int, known: list[np.ndarray] = []) -> list[np.ndarray]:  # noqa: B006  kept between calls
    if not known or len(known[0]) < n:
        known.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(max(n, TOGETHER * 5 // 4), np.uint64(base))
            row[0] = 1
            known.append(np.multiply.accumulate(row))
    return known


class Block:
    """Some documents' bytes in a row, with the least gram hash of every window that lies in one document."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.cumsum([0, *map(len, texts)])
        n = len(self.data)
        self.any = n >= WINDOW
        if not self.any:
            return
        h, size, k = _BYTE[self.data], 1, 0
        while size < GRAM:
            h = h[:-size] * _STEP[k] + h[size:]
            size, k = size * 2, k + 1
        self.grams = mix(h)
        self.grams |= np.uint64(1)  # 0 marks what is no window
        least = _sliding(self.grams, WINDOW - GRAM + 1, np.minimum)
        inside = np.zeros(len(least), bool)
        for a, b in zip(self.bounds[:-1], self.bounds[1:]):
            if b - a >= WINDOW:
                inside[a : b - WINDOW + 1] = True
        self.least = np.where(inside, least, np.uint64(0))

    def named(self) -> np.ndarray:
        """The hashes of all places that some window names, each place once."""
        edge = np.zeros(WINDOW - GRAM, np.uint64)
        most = _sliding(np.concatenate([edge, self.least, edge]), WINDOW - GRAM + 1, np.maximum)
        return self._spread(self.grams[self.grams == most])

    @staticmethod
    def _spread(least: np.ndarray) -> np.ndarray:
        """Least hashes are small numbers; scrambled, they fill a filter evenly."""
        return mix(least, 3)

    def segments(self) -> tuple[np.ndarray, ...]:
        """(hash, content hash, document, first and last window start in it) of all segments."""
        new = np.concatenate([[True], self.least[1:] != self.least[:-1]])
        new[self.bounds[1:-1][self.bounds[1:-1] < len(new)]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(self.least)) - 1
        real = self.least[first] != 0
        first, last = first[real], last[real]
        up, down = _powers(len(self.data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * up[: len(self.data)])])
        content = mix((sums[last + WINDOW] - sums[first]) * down[first] + mix((last - first).astype(np.uint64)))
        document = np.searchsorted(self.bounds, first, side="right") - 1
        return self._spread(self.least[first]), content, document, first - self.bounds[document], last - self.bounds[document]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], Block]]:
    """Documents (key, text as bytes) together."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            text = text.as_py() or b""
            if len(text) >= WINDOW:
                ids.append(key)
                texts.append(text)
                size += len(text)
            if size >= TOGETHER:
                yield ids, Block(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield ids, Block(texts)


def _repeated_hashes(docs: DataFrame, partitions: int) -> DataFrame:
    """(h) hashes that two places or more name."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0

        def combined():
            h, n = np.unique(np.concatenate(got), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], names=["h", "many"])

        for _, block in _blocks(batches):
            got.append(block.named())
            size += len(got[-1])
            if size > 1_000_000:  # a task's share of a hot hash is one row
                yield combined()
                got, size = [], 0
        if got:
            yield combined()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            h = np.concatenate([b.column(0).to_numpy() for b in got])
            many = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in got])
            kinds, place, n = np.unique(h, return_inverse=True, return_counts=True)
            n = n + np.bincount(place, many, len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[n > 1])], names=["h"])

    named = docs.mapInArrow(name, "h long, many boolean")
    return named.repartition(partitions, "h").mapInArrow(again, "h long")


def _segments(docs: DataFrame, seen: np.ndarray) -> DataFrame:
    """(h, c, key, low, high) of segments whose hash passes the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(seen)  # bounded, see hash_filter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches):
            h, c, document, low, high = block.segments()
            keep = in_filter(sent.value, h)
            h, c, document, low, high = (x[keep] for x in (h, c, document, low, high))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(np.array(ids)[document]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                names=["h", "c", "key", "low", "high"],
            )

    return docs.mapInArrow(run, "h long, c long, key long, low int, high int")


def _zipped(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, z) of the documents whose keys a filter of `keys` lets pass: texts made small before they are shuffled.
    And (key, doc_id, text) of the others, which are not among the keys."""
    sent = docs.sparkSession.sparkContext.broadcast(hash_filter(keys.select(F.xxhash64("key").alias("h"))))  # bounded
    rows = docs.select("key", "doc_id", "text", F.xxhash64("key").alias("h"))

    def wanted(batch: pa.RecordBatch) -> np.ndarray:
        return in_filter(sent.value, batch.column(3).to_numpy().view(np.uint64))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~wanted(batch))).drop_columns(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(pa.array(wanted(batch)))
            z = [press.compress(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=["key", "doc_id", "z"])

    return rows.mapInArrow(run, "key long, doc_id long, z binary"), rows.mapInArrow(others, "key long, doc_id long, text string")


def _contents(first: DataFrame, zipped: DataFrame) -> DataFrame:
    """(h, sub, key, low, data, mine): the bytes of first segments. A hash of very many different segments is dealt to several
    buckets by the content of each window; `mine` marks the windows that are a bucket's own (null: all)."""
    parts = first.groupBy("key").agg(F.collect_list(F.struct("h", "low", "high", "subs")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for key, parts, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = unpress.decompress(z.as_py())
                for p in parts:
                    data = text[p["low"] : p["high"] + WINDOW]
                    if p["subs"] == 1:
                        rows.append((p["h"], 0, key, p["low"], data, None))
                        continue
                    owner = np.array([
                        int.from_bytes(hashlib.blake2b(data[i : i + WINDOW], digest_size=8).digest()) % p["subs"]
                        for i in range(len(data) - WINDOW + 1)
                    ])
                    for sub in np.unique(owner).tolist():
                        rows.append((p["h"], sub, key, p["low"], data, (owner == sub).astype(np.uint8).tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "sub", "key", "low", "data", "mine"]
            )

    rows = parts.join(zipped.select("key", "z"), "key").select("key", "parts", "z")
    return rows.mapInArrow(run, "h long, sub int, key long, low int, data binary, mine binary")


def _later_windows(keys: np.ndarray, lows: np.ndarray, data: list[bytes], mine: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """(key, start, end): runs of bytes of windows that another of the segments holds at an earlier place."""
    lengths = np.array([len(d) for d in data])
    text = np.frombuffer(b"\xff".join([*data, b""]), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: a 0 ends each segment
    bounds = np.cumsum(np.append(0, lengths + 1))[:-1]
    counts = lengths - WINDOW + 1
    segment = np.repeat(np.arange(len(data)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if any(mine):
        own = np.concatenate([np.frombuffer(m, np.uint8) if m else np.ones(n, np.uint8) for m, n in zip(mine, counts)]) == 1
        segment, inside = segment[own], inside[own]
    starts = bounds[segment] + inside
    order = window_order(text, starts, WINDOW)
    same = neighbour_prefixes(text, order, WINDOW) == WINDOW
    shared = same | np.append(same[1:], False)  # by another window; no other can have an earlier place
    group = np.cumsum(~same)[shared]
    number = np.zeros(len(text), np.int64)
    number[starts] = np.arange(len(starts))
    back = number[order[shared]]
    key, at = keys[segment[back]], lows[segment[back]] + inside[back]
    by_place = np.lexsort((at, key, group))
    g, k, a = group[by_place], key[by_place], at[by_place]
    new = np.append(True, g[1:] != g[:-1])[: len(g)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    later = (k != k[head]) | (a != a[head])
    k, a = k[later], a[later]
    by_place = np.lexsort((a, k))
    k, a = k[by_place], a[by_place]
    if not len(k):
        return k, a, a
    new = np.append(True, (k[1:] != k[:-1]) | (a[1:] > a[:-1] + 1))
    last = np.append(np.flatnonzero(new)[1:], len(k)) - 1
    return k[new], a[new], a[last] + WINDOW


def _sorted_repeats(contents: DataFrame, partitions: int) -> DataFrame:
    """(key, start, end) of bytes that go, from the first places of all different segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows):
            key, low, data, mine = zip(*rows)
            out = _later_windows(np.array(key, np.int64), np.array(low, np.int64), list(data), list(mine))
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["key", "start", "end"])

        rows, size, bucket = [], 0, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for h, sub, key, low, data, mine in zip(*columns):
                if size > SORTED and (h, sub) != bucket:
                    yield found(rows)
                    rows, size = [], 0
                bucket = (h, sub)
                rows.append((key, low, data, mine))
                size += len(data)
        if rows:
            yield found(rows)

    dealt = contents.repartition(partitions, "h", "sub").sortWithinPartitions("h", "sub")
    return dealt.mapInArrow(run, "key long, start long, end long")


def remove_repeats(docs: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    docs needs doc_id and text; other columns are ignored. A byte goes if a 100-byte string that covers it also starts earlier: in
    a document with a smaller id, or earlier in the same one. A null text is empty; texts under 100 bytes lose nothing. A null id
    comes after all others. Rows that share an id count as one document whose texts overlie: of places that are equal in id and
    start, none is earlier. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    texts = docs.select("key", "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    repeated = stored(_repeated_hashes(texts, max(least, ceil(n_bytes / 40_000_000))))
    segments = stored(_segments(texts, hash_filter(repeated)))
    first = stored(segments.groupBy("h", "c").agg(F.min(F.struct("key", "low", "high")).alias("first")))
    # equal segments: all but the first place
    of_class = first.select("h", "c", F.col("first.key").alias("k1"), F.col("first.low").alias("l1"))
    copies = segments.join(of_class, ["h", "c"]).filter("key <> k1 or low <> l1")
    copies = copies.select("key", F.col("low").cast("long").alias("start"), (F.col("high") + WINDOW).cast("long").alias("end"))
    # different segments
    crowd = first.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
    crowd = crowd.select("h", F.ceil(F.col("n") / BUCKET).cast("int").alias("subs"))
    different = first.select("h", "first.*").join(crowd, "h", "left").withColumn("subs", F.coalesce("subs", F.lit(1)))
    zipped, _ = _zipped(docs, first.select("first.key"))
    size = first.agg(F.sum(F.col("first.high") - F.col("first.low") + WINDOW)).first()[0] or 0
    later = _sorted_repeats(_contents(different, zipped), max(least, ceil(size / SORTED)))
    gone = stored(copies.unionByName(later)).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, z, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = unpress.decompress(z.as_py())
                removed = spans = 0  # the filter also lets through what loses nothing
                kept = text
                if gone:
                    change = np.zeros(len(text) + 1, np.int32)
                    np.add.at(change, [g["start"] for g in gone], 1)
                    np.add.at(change, [g["end"] for g in gone], -1)
                    away = np.cumsum(change[:-1]) > 0
                    removed = int(away.sum())
                    spans = int((away & ~np.append(False, away[:-1])).sum())
                    kept = np.frombuffer(text, np.uint8)[~away].tobytes()
                rows.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
            kinds = (*[pa.int64()] * 4, pa.string())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    zipped, whole = _zipped(docs, gone)
    rows = zipped.join(gone, "key", "left").select("doc_id", "z", "gone")
    rows = rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    text, nothing = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    return rows.unionByName(whole.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    ))
