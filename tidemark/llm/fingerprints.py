"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits, in Spark expressions only.

Every shingle is hashed once; the high bits name its bin, and a bin keeps its smallest hash. An empty bin takes the value of
the first filled bin on its own fixed walk over all bins, which depends on the bin alone, so that two documents with the same
filled bins borrow alike. Of every bin the lowest bits are packed into 64-bit words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACE, let, text_or_empty

BIN_BITS, LOW_BITS, SHINGLE = 8, 4, 5
BINS = 1 << BIN_BITS
PER_WORD = 64 // LOW_BITS
WORDS = BINS // PER_WORD
#: Steps of a walk that are tried by position before all filled bins are compared.
STEPS = 6

_SHIFT = 63 - BIN_BITS
#: The walk of bin j: place t holds bin (START[j] + STRIDE[j] * t) mod BINS; odd strides meet every bin once.
_STRIDE = [(2 * ((j * 77 + 29) % 128) + 1) for j in range(BINS)]
_START = [(j * 151 + 43) % BINS for j in range(BINS)]
_BACK = [pow(s, -1, BINS) for s in _STRIDE]


def _mask(value: Column) -> Column:
    return value.bitwiseAND(BINS - 1)


def shingle_hashes(text: Column) -> Column:
    """63-bit hashes of all shingles of five lower-cased words; fewer words make one shingle, none make none."""
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    def shingles(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(a) - SHINGLE, F.lit(0)))
        hashed = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(a, i + k) for k in range(SHINGLE))), 1))
        return F.when(F.size(a) > 0, hashed).otherwise(F.array().cast("array<long>"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of each of the bins, in their order; null where a bin is empty."""
    last = F.array(*(F.lit(((j + 1) << _SHIFT) - 1) for j in range(BINS)))  # one at the end of each bin
    firsts = let(
        F.sort_array(F.concat(hashes, last)),
        lambda a: F.filter(
            a, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(a, i - 1), _SHIFT))
        ),
    )
    return F.transform(firsts, lambda x: F.when(x.bitwiseAND((1 << _SHIFT) - 1) != (1 << _SHIFT) - 1, x))


def densified(minima: Column) -> Column:
    """Empty bins filled from the first filled bin of their walk; all null if no bin is filled."""
    start, stride, back = (F.array(*map(F.lit, x)) for x in (_START, _STRIDE, _BACK))

    def fill(walks: Column) -> Column:
        m, filled, s, d, b = (walks[x] for x in ("m", "filled", "s", "d", "b"))

        def borrowed(j: Column) -> Column:
            tried = [F.get(m, _mask(F.get(s, j) + F.get(d, j) * t)) for t in range(STEPS)]
            nearest = F.array_min(
                F.transform(filled, lambda f: F.struct(_mask((f["bin"] - F.get(s, j)) * F.get(b, j)).alias("t"), f["v"].alias("v")))
            )
            return F.coalesce(*tried, nearest["v"])

        return F.transform(m, lambda v, j: F.when(v.isNotNull(), v).otherwise(borrowed(j)))

    def with_filled(m: Column) -> Column:
        filled = F.filter(
            F.transform(m, lambda v, j: F.struct(j.alias("bin"), v.alias("v"))), lambda f: f["v"].isNotNull()
        )
        return F.struct(m.alias("m"), filled.alias("filled"), start.alias("s"), stride.alias("d"), back.alias("b"))

    return let(let(minima, with_filled), fill)


def fingerprint(text: Column) -> Column:
    """Packed low bits of all bins as an array of 64-bit words; null for a text without words."""
    def packed(dense: Column) -> Column:
        def word(w: Column) -> Column:
            low = F.transform(
                F.slice(dense, w * PER_WORD + 1, PER_WORD),
                lambda v, i: F.call_function("shiftleft", v.bitwiseAND((1 << LOW_BITS) - 1), i * LOW_BITS),
            )
            return F.aggregate(low, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
        return F.when(
            F.get(dense, F.lit(0)).isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word)
        )
    return let(densified(bin_minima(shingle_hashes(text))), packed)


def fingerprint_text(words: Column) -> Column:
    """Lowercase hex of the words; the empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 64 // 4, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of equal bins, less what equal low bits of unlike bins add by chance.

    Two texts without words are alike (1), one such text and another are not (0).
    """
    ones = int("1" * PER_WORD, 16)
    def equal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
        return F.lit(PER_WORD) - F.bit_count(z.bitwiseAND(ones))
    same = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda x, y: x + y)
    chance = 1.0 / (1 << LOW_BITS)
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(corrected)


def _range_buckets(docs: DataFrame, per_bucket: int, cuts: int = 256, most: int = 20_000) -> tuple[Column, DataFrame]:
    """A bucket number that rises with doc_id, and (bucket, its largest doc_id, the bucket whose rows come before it).

    Quantiles of doc_id (at most `cuts`, kept as literals so that every run deals alike) are divided evenly: at most `most`
    buckets, so the second frame can be broadcast. The order goes from the largest id down and wraps around at the end.
    """
    n = docs.count()
    coarse = min(cuts, -(-n // per_bucket)) or 1
    at = docs.agg(F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 10_000)).first()[0] or [0, 0]
    fine = max(1, min(most // coarse, -(-n // (per_bucket * coarse))))
    bounds = F.array(*(F.lit(x) for x in at))
    doc_id = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    step = F.least(F.lit(coarse), F.greatest(F.lit(1), F.size(F.filter(bounds, lambda b: b < doc_id))))
    low, high = F.get(bounds, step - 1), F.get(bounds, step)
    share = (doc_id.cast("double") - low) / F.greatest(F.lit(1.0), high.cast("double") - low)
    inside = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * fine)
    bucket = step.cast("long") * fine + F.least(inside, F.lit(fine - 1))
    tops = docs.groupBy(bucket.alias("bucket")).agg(F.max(doc_id).alias("top"))
    up = Window.orderBy("bucket")
    before = F.coalesce(F.lead("bucket").over(up), F.first("bucket").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return bucket, tops.select("top", before.alias("before"))


def with_next(docs: DataFrame, carried: list[str], per_bucket: int = 5_000) -> DataFrame:
    """docs with, for each carried column, next_<name>: its value in the next row by descending doc_id, the first row's after the last.

    docs has doc_id (null comes last) and the carried columns; the first of them breaks ties between repeated ids. Rows are
    dealt once, by ranges of ids; the first row of a range also goes to the range before it.
    """
    bucket, tops = _range_buckets(docs.select("doc_id"), per_bucket)
    order_id = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.withColumns({"bucket": bucket, "order_id": order_id})
    rows = rows.join(F.broadcast(tops), rows["order_id"] == tops["top"], "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("border"))
    again = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("border"))
    places = F.when(F.col("before").isNotNull(), F.array(own, again)).otherwise(F.array(own))
    rows = rows.select("doc_id", "order_id", *carried, F.inline(places))
    line = Window.partitionBy("bucket").orderBy("border", F.desc("order_id"), carried[0])
    rows = rows.select("doc_id", *carried, "border", *(F.lead(c).over(line).alias(f"next_{c}") for c in carried))
    return rows.filter("not border").drop("border")


def edited_text(text: Column, following: Column) -> Column:
    """text whose last third of code points (rounded down) is replaced by as many first ones of the following text, or all."""
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.char_length(text) - cut), F.substr(following, F.lit(1), cut))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs needs doc_id and text; other columns are ignored. A null text is empty, a text without words has the empty
    fingerprint. The last document's next is the first; a single document is its own next. Repeated ids follow each other in
    the order of their texts. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = with_next(rows.withColumn("print", fingerprint(F.col("text"))), ["text", "print"])
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    # each fingerprint is computed once: as a generator's output it is not merged into its readers
    edited = F.inline(F.array(F.struct(fingerprint(F.col("edited")).alias("edited_print"))))
    rows = rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "print", "next_print",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), edited,
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("print")).alias("fingerprint"),
        fingerprint_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
