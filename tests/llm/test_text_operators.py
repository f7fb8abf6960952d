"""Secret scan, language identification and quality against plain versions and held-out rows."""

import base64
import bz2
import gzip
import hashlib
import re
import urllib.parse
import zlib

import numpy as np
import pytest

from tests.llm.data import messy_docs, no_docs
from tidemark.llm import language_id, quality, queries, secret_scan
from tidemark.llm.shared import prepared

SMALL = "/root/testdata/sf0.001"
MOST = 1 << 22


def base_spans(text):
    """The contract's patterns as they are written."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


TRICKY = [
    "token=secret=abcdefghijkl", "token=secret:abcdefghijklmn", "API_KEY : 'abcdefghijkl' apikey=short",
    "AKIAAKIA" + "Z" * 12 + " AKIA1 xAKIA" + "9" * 20, "deadbeefdeadbeef0 DEADBEEF deadbeefdeadbee",
    "ſecret = abcdefghijklmno", "toKen = abcdefghijklmno", "pässword=x password\"=\"0123456789abcdef0",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert [str(s) for s in secret_scan.scan(text)] == base_spans(text)


SECRET = 'password = "hunter2hunter2"'


@pytest.mark.parametrize("wrap", [
    lambda s: urllib.parse.quote(s, safe=""),
    lambda s: urllib.parse.quote(urllib.parse.quote(s, safe=""), safe=""),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(bz2.compress(zlib.compress(s.encode()))).decode(),
    lambda s: urllib.parse.quote(base64.b64encode(base64.b64encode(s.encode())).decode(), safe=""),
    lambda s: base64.encodebytes((s + " filler" * 20).encode()).decode(),
])
def test_layers_are_mapped_back(wrap):
    inner = wrap(SECRET)
    text = f"é before {inner} after"
    base, spans, layers, refused = secret_scan.find_secrets(text, MOST)
    deep = [s for s in spans if s.kind == 0]
    assert deep and layers and not refused
    assert all(9 <= s.start < s.end <= 9 + len(inner) for s in deep)
    assert {*base} <= {*spans}


def test_exact_positions_in_an_escaped_layer():
    text = "say \\u0070assword=abcdefghijkl now"
    assert [str(s) for s in secret_scan.find_secrets(text, MOST)[1]] == ["assign:4:30"]
    assert secret_scan.masked(text, MOST) == f"say {secret_scan.MASK} now"


def test_cycles_end_and_bombs_are_refused():
    assert secret_scan.find_secrets("%25" * 50, MOST)[2] <= 50
    bomb = base64.b64encode(gzip.compress(b"a" * 10_000_000)).decode()
    assert secret_scan.find_secrets(bomb, 1_000_000)[3] >= 1


def test_scan_documents(spark):
    docs, rows = messy_docs(spark)
    got = {(r.doc_id, r.base_sha256) for r in secret_scan.scan_documents(docs).collect()}
    assert got == {(r[0], hashlib.sha256(",".join(base_spans(r[1] or "")).encode()).hexdigest()) for r in rows}
    assert secret_scan.scan_documents(docs).count() == len(rows)
    assert secret_scan.scan_documents(no_docs(spark)).count() == 0
    assert secret_scan.mask_documents(docs).schema == docs.schema
    assert secret_scan.mask_documents(docs).exceptAll(docs).count() == 0


def test_forward_sums_all_segmentations():
    class Tiny(language_id.Pieces):
        def __init__(self, names):
            self.names, self.longest = names, max(map(len, names))
            h = self.hashes_of(names)
            self.ids = np.argsort(h)
            self.sorted = h[self.ids]

    names = ["a", "b", "ab", "ba", "aba"]
    p = np.array([[0.1, 0.3], [0.2, 0.3], [0.3, 0.1], [0.25, 0.2], [0.15, 0.1]])

    def brute(word, column):
        if not word:
            return 1.0
        total = language_id._STRANGE_P * brute(word[1:], column)
        return total + sum(p[i, column] * brute(word[len(n) :], column) for i, n in enumerate(names) if word.startswith(n))

    words = ["a", "ab", "abab", "bababa", "xab", "abx"]
    got = np.exp(language_id.word_scores(Tiny(names), words, p))
    assert np.allclose(got, [[brute(w, 0), brute(w, 1)] for w in words], rtol=1e-9)
    counts = language_id.expected_counts(Tiny(names), ["ab"], np.array([2.0]), p[:, 0])
    whole, parts = 0.3, 0.1 * 0.2
    total = brute("ab", 0)
    assert np.allclose(counts, [2 * parts / total, 2 * parts / total, 2 * whole / total, 0, 0], atol=1e-5)


def test_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.languages(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == docs.count() and len(held) and (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()
    messy, rows = messy_docs(prepared(spark))
    model = language_id.train(docs, queries.PIECE_VOCABULARY, rounds=1)
    out = language_id.identify(messy, model).collect()
    assert len(out) == len(rows)
    no_letters = {i for i, r in enumerate(rows) if not any(c.isalpha() for c in r[1] or "")}
    assert sum(r.lang_pred == "und" for r in out) == len(no_letters)
    nothing = language_id.train(no_docs(spark), queries.PIECE_VOCABULARY)
    assert {r.lang_pred for r in language_id.identify(messy, nothing).collect()} == {"und"}


def test_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.quality_scores(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    assert got["score"].between(0, 1).all()
    messy, rows = messy_docs(spark)
    model = quality.train(no_docs(spark), labels.limit(0))
    assert quality.score(messy, model).count() == len(rows)
    assert quality.score(messy, model).select("row.*").schema == messy.schema
    assert {r.score for r in quality.score(messy, model).collect()} == {0.5}


def test_prior_from_scores():
    random = np.random.default_rng(1)
    good, bad = random.normal(2, 1, 20_000), random.normal(-3, 1, 20_000)
    assert abs(quality.prior_from_scores(good[:10_000], np.append(good[10_000:], bad)) - 1 / 3) < 0.03
