"""Exact Jaccard similarity join of documents on word shingles, as a metric-space join.

Jaccard distance is a metric. Regions are made in two ways, one inside the other:

* Outer regions have single shingles as pivots. To such a pivot a document that holds it has distance 1 - 1/n, any other 1, so
  its nearest pivots are its own shingles, and ties go to the first in one fixed order, rare ones first. A document within
  distance 0.25 shares at least one of the first n - ceil(0.75 n) + 1 shingles: the document is replicated to the regions of
  just these, the window of all pivots that may be nearest to a partner.
* Inside a region a document is the pivot. Distances to it are computed exactly. What is near the pivot is linked through it;
  of the rest a new pivot is taken, and so on. Two documents x, y of different components are compared only if their distances
  to each pivot p of the region differ by no more than the radius, |d(x,p) - d(y,p)| <= 0.25: the triangle inequality rules out
  the others. What remains is compared exactly, so no link between different components is lost.

Documents with equal sets are one class from the start, so copies meet in counts, not in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import dropped, hash_filter, in_filter, stored
from tidemark.llm.shingles import mix, shingle_sets

#: Pivots that a region takes one after the other before the rest is compared through their windows.
LEVELS = 3
#: Rows that one task looks through for regions.
REGION_ROWS = 250_000
#: Rows that a worker spreads out at a time: prefixes and counts take many times their stored bytes then.
AT_ONCE = 512
#: Shingles are counted in so many groups of hashes; bytes of a hash that name a region.
GROUPS, NAME_BYTES = 128, 5
#: Groups in which the sets of pairs that are left are counted once more, before whole sets meet.
FINE_GROUPS = 4096


def _utf8(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)
    pa.default_memory_pool().release_unused()


def common_shingles(docs: DataFrame, one_in: int = 16, least: int = 8, most: int = 200_000) -> np.ndarray:
    """Hashes of shingles that are common, rising: those in `least` or more of one in `one_in` documents, the `most` commonest.

    They only go to the end of the order of pivots. Any order gives the same links; this one keeps regions small.
    """
    rows = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in shingle_sets(_utf8(batch, 0)):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["s"])

    counted = rows.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    top = counted.orderBy(F.desc("n"), "s").limit(most).select("s").toArrow()["s"]
    return np.sort(top.to_numpy().astype(np.int64).view(np.uint64))


def shingle_prefixes(docs: DataFrame, percent: int, common: np.ndarray) -> DataFrame:
    """(doc_id, n, k1, k2, cold, prefix, counts) per document: set size, a 128-bit key of the set, its first shingles in the order
    of pivots (the low bytes of their hashes), of which the first `cold` are not common, and its number of shingles in each of
    GROUPS groups, up to 255. Where two hashes share their low bytes, two regions become one; that loses nothing."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), shingle_sets(_utf8(batch, 1))):
                n = len(found)
                length = n - ceil(percent * n / 100) + 1 if n else 0
                cold = length
                counts = _counts(found, GROUPS)
                k1, k2 = mix(found, 1).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(found, 2)) if n else 0
                if n and len(hot):
                    at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                    is_hot = hot[at] == found
                    if is_hot.any():
                        cold = min(length, n - int(is_hot.sum()))
                        found = np.concatenate([found[~is_hot], found[is_hot]])
                rows.append((doc_id, n, int(np.int64(np.uint64(k1).view(np.int64))), int(np.uint64(k2).view(np.int64)), cold, _names(found[:length]), counts))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n", "k1", "k2", "cold", "prefix", "counts"]
            )

    schema = "doc_id long, n long, k1 long, k2 long, cold int, prefix binary, counts binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _counts(hashes: np.ndarray, groups: int) -> bytes:
    """Number of hashes in each group, up to 255."""
    return np.minimum(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % groups, minlength=groups), 255).astype(np.uint8).tobytes()


def _names(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]).tobytes()


def _from_names(data: bytes) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, NAME_BYTES)
    return np.pad(short, ((0, 0), (0, 8 - NAME_BYTES))).view("<i8").ravel()


def _region_rows(classes: DataFrame, cold: bool) -> DataFrame:
    """(s, rep, n, pos): a class in each region of its window, of common (not cold) or other pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            n_cold = batch.column(2).to_numpy()
            flat = [_from_names(p) for p in batch.column(3).to_pylist()]
            flat = [f[:c] if cold else f[c:] for f, c in zip(flat, n_cold)]
            lengths = np.array([len(f) for f in flat], np.int64)
            if not lengths.sum():
                continue
            first = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            pos = first if cold else first + np.repeat(n_cold, lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(flat)), pa.array(np.repeat(batch.column(0).to_numpy(), lengths)),
                    pa.array(np.repeat(batch.column(1).to_numpy(), lengths).astype(np.int32)), pa.array(pos.astype(np.int32)),
                ],
                names=["s", "rep", "n", "pos"],
            )

    return classes.select("rep", "n", "cold", "prefix").mapInArrow(run, "s long, rep long, n int, pos int")


def _shared_regions(rows: DataFrame, partitions: int) -> DataFrame:
    """The rows of regions with two classes or more, with the region's pivot: its smallest rep. For pivots that are not common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        s, rep, n, pos = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(4))
        order = np.lexsort((rep, s))
        s = s[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(s)))
        keep = np.repeat(size > 1, size)
        pivot = np.repeat(rep[order][start], size)[keep]
        some = order[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(s[keep]), pa.array(rep[some]), pa.array(n[some]), pa.array(pos[some]), pa.array(pivot)],
            names=["s", "rep", "n", "pos", "pivot"],
        )

    dealt = rows.repartition(partitions, "s")
    return dealt.mapInArrow(run, "s long, rep long, n int, pos int, pivot long")


def _may_link(n1: Column, pos1: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough if a shingle at these places is the first one they share."""
    shared = 1 + F.least(n1 - pos1, n2 - pos2) - 1
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (shared * (100 + percent) >= (n1 + n2) * percent)


def _near_by_counts(pairs: DataFrame, classes: DataFrame, percent: int, groups: int) -> DataFrame:
    """The pairs (a, b) that counts by group allow: sets differ in as many shingles, at least, as their counts differ by.

    Unlike sets of n shingles differ in fewer counts than shingles once n is many times the groups, so long texts pass few groups."""
    first = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    second = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            ca, cb = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, groups).astype(np.int16) for i in (4, 5)
            )
            unlike = np.abs(ca - cb).sum(axis=1)
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = pa.array(unlike * (100 + percent) <= both * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    rows = pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "ca", "cb")
    return rows.mapInArrow(run, "a long, b long")


def _measured(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, both, either) for those pairs (a, b) that can be near: sizes of the intersection and the union of their sets."""
    allowed = stored(_near_by_counts(pairs, classes, percent, GROUPS))
    members = allowed.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = stored(_sets_of(docs, members))
    pairs = stored(_near_by_counts(allowed, sets, percent, FINE_GROUPS))
    first = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                k = int((large[at] == small).sum())
                both.append(k)
                either.append(len(x) + len(y) - k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())],
                names=["a", "b", "both", "either"],
            )

    rows = pairs.join(second, "b").join(first, "a").select("a", "b", "ha", "hb")
    measured = stored(rows.mapInArrow(run, "a long, b long, both long, either long"))
    dropped(allowed, pairs, sets)
    return measured


def similar_components(docs: DataFrame, percent: int = 75, n_partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    docs needs doc_id and text; other columns are ignored. Two documents link if 100 * intersection >= percent * union of their
    sets of five-word shingles. A text that is null or has no words has the empty set and links with nothing. Rows with the same
    id are one document. A null id links with nothing and has a null component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = stored(shingle_prefixes(docs, percent, common_shingles(docs)))
    key = ["k1", "k2", "n"]
    # all of a class have the same prefix: its bytes follow the smallest id without being compared
    classes = stored(
        known.filter("n > 0 and doc_id is not null").groupBy(*key).agg(
            F.min("doc_id").alias("rep"), F.first("cold").alias("cold"), F.first("prefix").alias("prefix"),
            F.first("counts").alias("counts"),
        )
    )
    rows_in_all = classes.agg(F.sum(F.length("prefix") / NAME_BYTES)).first()[0] or 0
    partitions = max(n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows_in_all / REGION_ROWS))
    cold = _shared_regions(_region_rows(classes, True), partitions)
    common = stored(_region_rows(classes, False))
    centres = common.groupBy("s").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other")).filter("pivot < other")
    hot = common.join(centres.drop("other"), "s").select(*cold.columns)
    regions = stored(cold.unionByName(hot))
    dropped(common)

    links, levels = None, []
    active, found = regions, None
    for level in range(LEVELS):
        if level:
            alone = active.filter("component <> pivot_component").drop("pivot", "component", "pivot_component")
            centre = alone.groupBy("s").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other")).filter("pivot < other")
            active = stored(alone.join(centre.drop("other"), "s"))
        place = active.filter("rep = pivot").select("s", F.col("n").alias("pivot_n"), F.col("pos").alias("pivot_pos"))
        fits = _may_link(F.col("n"), F.col("pos"), F.col("pivot_n"), F.col("pivot_pos"), percent)
        pairs = active.filter("rep <> pivot").join(place, "s").filter(fits)
        pairs = pairs.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
        measured = _measured(pairs, docs, classes, percent)
        levels.append((active.select("s", "rep", "pivot"), measured))
        near = measured.filter(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")
        links = near if links is None else links.unionByName(near)
        found = stored(connected_components(links))
        active = _labelled(active, found)

    rest = _rest_pairs(_labelled(regions, found), levels, percent)
    measured = _measured(rest, docs, classes, percent)
    near = measured.filter(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")
    found = connected_components(links.unionByName(near))

    of_class = classes.select(*key, "rep").join(found, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select(*key, F.coalesce("component", "rep").alias("component_id"))
    rows = known.select("doc_id", *key)
    linked = rows.filter("n > 0 and doc_id is not null").join(of_class, key)
    others = rows.filter("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return linked.select(*names).unionByName(others.select(*names))


def _sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, n, counts, hashes) for the members: the sets, their sizes and counts in FINE_GROUPS groups. A filter of them picks the texts where they lie, so texts are not shuffled."""
    seen = hash_filter(members.select(F.xxhash64("rep").alias("h")))
    sent = docs.sparkSession.sparkContext.broadcast(seen)  # bounded, see hash_filter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(sent.value, batch.column(2).to_numpy().view(np.uint64))))
            sets = list(shingle_sets(_utf8(batch, 1)))
            columns = [
                batch.column(0), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([_counts(x, FINE_GROUPS) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "counts", "hashes"])

    some = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    return some.mapInArrow(run, "rep long, n long, counts binary, hashes binary").join(members, "rep", "left_semi")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the components of rep and pivot."""
    own = found.select(F.col("node").alias("rep"), F.col("component").alias("own_c"))
    centre = found.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_c"))
    return rows.join(own, "rep", "left").join(centre, "pivot", "left").select(
        *rows.columns, F.coalesce("own_c", "rep").alias("component"), F.coalesce("pivot_c", "pivot").alias("pivot_component")
    )


def _rest_pairs(regions: DataFrame, levels: list[tuple[DataFrame, DataFrame]], percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a region and that sizes, places and the windows of pivots allow."""
    regions = stored(regions)
    apart = regions.filter("component <> pivot_component")
    mixed = regions.join(apart.select("s").distinct(), "s", "left_semi")
    for k, (placed, measured) in enumerate(levels):
        distance = measured.select(
            F.col("a").alias(f"p{k}"), F.col("b").alias("rep"), (1 - F.col("both") / F.col("either")).alias(f"d{k}")
        )
        centre = placed.select("s", "rep", F.col("pivot").alias(f"p{k}"))
        mixed = mixed.join(centre, ["s", "rep"], "left").join(distance, [f"p{k}", "rep"], "left")
        mixed = mixed.withColumn(f"d{k}", F.when(F.col("rep") == F.col(f"p{k}"), 0.0).otherwise(F.col(f"d{k}"))).drop(f"p{k}")
    mixed = stored(mixed)
    x, y = mixed.alias("x"), mixed.filter("component <> pivot_component").alias("y")
    allowed = (F.col("x.component") != F.col("y.component")) & _may_link(
        F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent
    )
    radius = 1 - percent / 100 + 1e-9
    for k in range(len(levels)):
        gap = F.abs(F.col(f"x.d{k}") - F.col(f"y.d{k}"))
        allowed = allowed & (gap.isNull() | (gap <= radius))
    pairs = x.join(y, F.col("x.s") == F.col("y.s")).filter(allowed)
    return pairs.select(
        F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")
    ).distinct()
