"""URL filter: longest host and path rules, and a blocked Bloom filter before an exact join with a list of URLs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

_WORDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def url_host(url: Column) -> Column:
    """Lower-cased text between :// and the next / ? # or the end; empty without ://."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """host/path without scheme, www., default port, trailing slashes and fragment, with the query's parts sorted and those
    of campaigns (utm_*, ref) left out; null without ://."""
    host = F.regexp_replace(url_host(url), r"^www\.|:(80|443)$", "")
    query = F.regexp_extract(_after_scheme(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[^=]*|ref)(?:=|$)"))
    )
    tail = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.when(
        F.locate("://", url) > 0, F.concat(host, F.regexp_replace(url_path(url), r"/+$", ""), tail)
    )


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; both null if none does. Of equally long ones the first."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        for _, h, p in ranked
    ]
    named = F.coalesce(F.lit(None).cast("string"), *(F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ranked)))
    verdict = F.coalesce(F.lit(None).cast("string"), *(F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ranked)))
    return named, verdict


def _bits(key: Column) -> list[Column]:
    """One bit in each of the words of a block."""
    h = F.xxhash64(F.lit("bits"), key)
    places = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(31).cast("int") for i in range(_WORDS)]
    return [F.call_function("shiftleft", F.lit(1), place) for place in places]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """A filter of `blocks` blocks of 256 bits: one row per block that is not empty."""
    words = {f"w{i}": b for i, b in enumerate(_bits(F.col(key)))}
    rows = listed.select(_block(F.col(key), blocks).alias("block"), *(b.alias(n) for n, b in words.items()))
    return rows.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in words))


def listed_flags(
    rows: DataFrame, listed: DataFrame, key: str, bits_per_key: int = 16, most_blocks: int = 1 << 18
) -> DataFrame:
    """rows with a boolean column `listed`: whether the string column `key` is among that of `listed`. Exact.

    The filter has bits_per_key bits per listed key, and at most most_blocks blocks (32 bytes each, so it can be broadcast);
    a longer list makes it denser and the exact join larger, never wrong. Null keys are not listed. Repeated rows stay.
    Only possible hits are shuffled. rows must not have columns named block, listed, maybe or w0 to w7.
    """
    names = listed.select(F.col(key).alias("_key")).filter("_key is not null").distinct()
    blocks = min(most_blocks, max(1, math.ceil(names.count() * bits_per_key / (32 * _WORDS))))
    probe = rows.withColumn("block", _block(F.col(key), blocks))
    probe = probe.join(F.broadcast(bloom_blocks(names, "_key", blocks)), "block", "left")
    inside = reduce(
        Column.__and__,
        (F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(F.col(key)))),
    )
    probe = probe.select(*rows.columns, F.coalesce(inside & F.col(key).isNotNull(), F.lit(False)).alias("maybe"))
    hits = probe.filter("maybe").join(names, F.col(key) == F.col("_key"), "left")
    return (
        hits.select(*rows.columns, F.col("_key").isNotNull().alias("listed"))
        .unionByName(probe.filter("not maybe").select(*rows.columns, F.lit(False).alias("listed")))
    )


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], listed_verdict: str = "block") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, url_key (canonical URL), on_list.

    pages needs page_id and url, listed a string column url; other columns are ignored. The longest rule that fits decides;
    without one, a page on the list gets listed_verdict and any other the opposite. A null url, or one without ://, has an
    empty host and path, a null url_key, fits no rule and is not listed. Repeated pages are judged once each.
    """
    other = "allow" if listed_verdict == "block" else "block"
    url = F.col("url")
    rows = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("url_key"))
    keys = listed.select(canonical_url(url).alias("url_key"))
    named, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), listed_verdict).otherwise(other)
    return listed_flags(rows, keys, "url_key").select(
        "page_id", "host", "path", named.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        "url_key", F.col("listed").alias("on_list"),
    )
