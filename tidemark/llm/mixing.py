"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document's rate is the number of times the mix takes it, from 0 to `most`. Of all rates that give every source its target
number of words, those with the smallest bounded entropy relative to equal rates are an exponential tilt by size,

    rate = most / (1 + exp(-m * size / mean size of the source)),

with one multiplier m per source: the zero of a convex dual's gradient, found by damped Newton steps. A step is one aggregation
of a table of (source, size, number of documents).

A rate becomes copies by comparing it with a fixed number u of the document (from a hash of its id): floor(rate + u). The
multiplier at which a document gains its k-th copy is then known in closed form. Near the solved multiplier these points are put
in order, and the one at which the whole copies come nearest to the target is the source's cut. It depends only on whole
numbers and on the points themselves, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import small_side, stored, text_or_empty, word_count

#: Newton stops when every source is within this share of its target; the cut does the rest.
TOLERANCE = 1e-4
MOST_STEPS = 60
_NO_ID = -(1 << 63)


def _source_key() -> Column:
    """Null and the empty source are different keys, and equal to themselves in a join."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(key, n_docs, source_size, target) from rows (key, source, source_size, n_docs), one for each source.

    The weights go to sources by code point, null last, over and over; together the targets are `share` times all words. No
    target exceeds most * source_size; what is over goes to the others by weight. That leaves min(most * size, level * weight)
    for one level, which is found from running sums over the sources in the order in which they fill up.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    everything = Window.partitionBy()
    rows = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    rows = rows.withColumns(
        {"room": F.col("source_size") * float(most), "wanted": F.sum("source_size").over(everything) * F.lit(share)}
    )
    filling = Window.orderBy(F.col("room") / F.col("weight"), "key")
    before = F.sum("room").over(filling.rowsBetween(Window.unboundedPreceding, -1))
    onward = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("wanted") - F.coalesce(before, F.lit(0.0))) / onward)
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("level"))
    rows = rows.withColumn("level", F.first(open_level, ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ))
    target = F.least(F.col("room"), F.coalesce(F.col("level") * F.col("weight"), F.col("room")))
    return rows.select("key", "n_docs", "source_size", target.alias("target"))


def _rate(m: Column, x: Column, most: int) -> Column:
    return F.lit(float(most)) / (1 + F.exp(-F.least(F.lit(700.0), F.greatest(F.lit(-700.0), m * x))))


def solved_multipliers(sizes: DataFrame, targets: DataFrame, n_sources: int, most: int) -> DataFrame:
    """(key, n_docs, source_size, target, mean, m, slope, spread, largest) for each source.

    slope: words that the mix gains by a unit of m. spread: standard deviation of the words in whole copies at m. Sources that
    are full, or wanted not at all, have no finite multiplier; they keep m = 0 and are not solved.
    """
    positive = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(most))
    state = targets.withColumns(
        {
            "mean": F.col("source_size") / F.col("n_docs"), "open": positive, "m": F.lit(0.0),
            "low": F.lit(-1e15), "high": F.lit(1e15),
        }
    )
    words, x = F.col("size").cast("double") * F.col("number"), F.col("size") / F.col("mean")
    rate = _rate(F.col("m"), x, most)
    part = rate - F.floor(rate)
    sums = {
        "got": words * rate,
        "slope": words * x * rate * (1 - rate / most),
        "spread": words * F.col("size") * part * (1 - part),
    }
    for _ in range(MOST_STEPS):
        fixed = ["key", "n_docs", "source_size", "target", "mean", "open", "m", "low", "high"]
        tilted = sizes.filter("size > 0").join(small_side(state, n_sources), "key")
        # the sums of a source meet in one row, whatever its share of all documents
        gained = tilted.groupBy(*fixed).agg(*(F.sum(v).alias(n) for n, v in sums.items()), F.max("size").alias("largest"))
        gained = stored(gained)
        off = F.abs(F.col("got") - F.col("target")) > TOLERANCE * F.col("target") + 0.5
        if not gained.filter(F.col("open") & off).limit(1).count():
            break
        newton = F.col("m") + F.greatest(
            -F.greatest(F.lit(1.0), F.abs("m")),
            F.least(F.greatest(F.lit(1.0), F.abs("m")), (F.col("target") - F.col("got")) / F.greatest("slope", F.lit(1e-300))),
        )
        short = F.col("got") < F.col("target")
        low, high = F.when(short, F.col("m")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("m"))
        inside = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        state = gained.select(
            *fixed[:6], F.when(F.col("open") & off, inside).otherwise(F.col("m")).alias("m"),
            F.when(F.col("open"), low).otherwise(F.col("low")).alias("low"),
            F.when(F.col("open"), high).otherwise(F.col("high")).alias("high"),
        )
    return gained.withColumn("spread", F.sqrt("spread"))


def _copy_point(k: int, doc_id: Column, x: Column, most: int) -> Column:
    """The multiplier from which on the document is taken k times."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    share = (k - u) / most
    return F.log(share / (1 - share)) / x


def source_cuts(rows: DataFrame, solved: DataFrame, n_sources: int, most: int) -> DataFrame:
    """(key, source_size, target, mean, full, cut, cut_id): the last copy that a source's mix takes, by point and then id.

    rows: (key, doc_id, size). Only points within some standard deviations of the solved multiplier are put in order; the band
    is widened until it holds the cut of every source.
    """
    rows = rows.filter("size > 0").join(small_side(solved.filter("open"), n_sources), "key")
    width = 6.0
    while True:
        half = (width * F.col("spread") + 2 * F.col("largest")) / F.greatest("slope", F.lit(1e-300))
        points = [_copy_point(k, F.coalesce("doc_id", F.lit(_NO_ID)), F.col("size") / F.col("mean"), most) for k in range(1, most + 1)]
        near = rows.select(
            "key", "target", "size", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"),
            (F.col("m") - half).alias("low"), (F.col("m") + half).alias("high"), F.explode(F.array(*points)).alias("point"),
        )
        below = near.filter("point < low").groupBy("key").agg(F.sum("size").alias("below"))
        inside = near.filter("point between low and high").groupBy("key", "point", "doc_id").agg(F.sum("size").alias("size"))
        line = Window.partitionBy("key").orderBy("point", "doc_id")
        inside = inside.withColumn("up_to", F.sum("size").over(line)).select("key", "point", "doc_id", "up_to")
        nothing = solved.filter("open").select(
            "key", F.lit(-math.inf).alias("point"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("up_to")
        )
        ends = inside.unionByName(nothing).join(
            solved.filter("open").select("key", "target").join(below, "key", "left"), "key"
        ).withColumn("taken", F.coalesce("below", F.lit(0)) + F.col("up_to"))
        best = F.min_by(
            F.struct("point", "doc_id", "taken"), F.struct(F.abs(F.col("taken") - F.col("target")), "point", "doc_id")
        )
        cuts = stored(ends.groupBy("key").agg(
            best.alias("best"), F.min("taken").alias("least"), F.max("taken").alias("greatest"), F.first("target").alias("target")
        ))
        reached = (F.col("least") <= F.col("target")) & (F.col("greatest") >= F.col("target"))
        if width > 1e12 or not cuts.filter(~reached).limit(1).count():
            break
        width *= 16
    # below the band's lower end all is taken: a cut of none in the band stands at that end
    low = F.col("m") - (width * F.col("spread") + 2 * F.col("largest")) / F.greatest("slope", F.lit(1e-300))
    cut = F.when(F.col("best.point") == F.lit(-math.inf), low).otherwise(F.col("best.point"))
    cut_id = F.when(F.col("best.point") == F.lit(-math.inf), F.lit(_NO_ID)).otherwise(F.col("best.doc_id"))
    return solved.join(cuts.select("key", "best"), "key", "left").select(
        "key", "source_size", "target", "mean", cut.alias("cut"), cut_id.alias("cut_id"),
        (F.col("target") >= F.col("source_size") * float(most)).alias("full"),
    )


def balanced_copies(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """docs, all columns as they are in a struct `row`, with size, source_size, target and copies (0 to most).

    docs needs doc_id, text and source. size is the number of words of the text (null: 0). A null source is a source; a null id
    counts as the smallest. Documents without words are taken 0 times. Repeated rows with one id share their fate. Sources
    without words have target 0. An empty table gives no rows.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", _source_key().alias("key"),
        word_count(text_or_empty()).alias("size"),
    )
    light = stored(rows.select("key", "source", "doc_id", "size"))
    sizes = stored(light.groupBy("key", "source", "size").agg(F.count("*").alias("number")))
    per_source = stored(sizes.groupBy("key", "source").agg(
        F.sum(F.col("size") * F.col("number")).alias("source_size"), F.sum("number").alias("n_docs")
    ))
    n_sources = per_source.count()
    targets = stored(source_targets(per_source, weights, share, most))
    solved = solved_multipliers(sizes, targets, n_sources, most)
    cuts = source_cuts(light, solved, n_sources, most).select("key", "mean", "cut", "cut_id", "full")
    cuts = stored(targets.drop("n_docs").join(cuts, "key", "left"))  # sources without words have no cut

    x, doc_id = F.col("size") / F.col("mean"), F.coalesce("doc_id", F.lit(_NO_ID))
    taken = F.lit(0)
    for k in range(1, most + 1):
        point = _copy_point(k, doc_id, x, most)
        first = (point < F.col("cut")) | ((point == F.col("cut")) & (doc_id <= F.col("cut_id")))
        taken = taken + F.when(first, 1).otherwise(0)
    copies = F.when((F.col("size") == 0) | F.coalesce(F.col("target") <= 0, F.lit(True)), 0).when(F.col("full"), most).otherwise(taken)
    return rows.join(small_side(cuts, n_sources), "key").select(
        "row", "doc_id", "size", "source_size", "target", copies.cast("int").alias("copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as balanced_copies takes it, with the columns of docs."""
    rows = balanced_copies(docs, **options).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
