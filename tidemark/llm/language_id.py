"""Language identification by unigram pieces: a forward algorithm sums the probability of every segmentation of a word.

The pieces are a fixed public vocabulary. A language gives each piece a probability; a word has the summed probability of all
its segmentations into pieces, and a text that of its words. The probabilities are trained by expectation maximisation:
expected piece counts over all segmentations of the training words (forward and backward sums), added up per language by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

UNKNOWN = "und"
#: A character without a piece of its own, and the start of a word in SentencePiece vocabularies.
_STRANGE_P, _START = 1e-7, "▁"
#: Sums of segmentations are carried on, and rescaled, after so many characters, so a long run cannot underflow or fill memory.
#: In training, words are counted in chunks of this length.
_CHUNK = 40
_MEMORY = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes + np.uint64(1)) * _MIX
    return x ^ (x >> np.uint64(29))


class Pieces:
    """The vocabulary as sorted hashes, to look up all substrings of many words at a time."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.names = sorted({n for n in (name.lower() for name in names) if re.fullmatch(rf"{_START}?[^\W\d_]+|{_START}", n)})
        self.longest = max(map(len, self.names))
        hashes = self.hashes_of(self.names)
        order = np.argsort(hashes)
        self.sorted, self.ids = hashes[order], order
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")

    @staticmethod
    def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words])
        codes = np.zeros((len(words), int(lengths.max(initial=0))), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
        return codes, lengths

    @classmethod
    def hashes_of(cls, words: list[str]) -> np.ndarray:
        codes, lengths = cls._matrix(words)
        h, mixed = np.zeros(len(words), np.uint64), _mixed(codes)
        for k in range(codes.shape[1]):
            h = np.where(k < lengths, h * _BASE + mixed[:, k], h)
        return h

    def found(self, words: list[str]) -> tuple[np.ndarray, Iterator[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Lengths of the words and, for each start and length in turn, (start, length, rows, piece ids) of substrings that are pieces."""
        codes, lengths = self._matrix(words)
        mixed = _mixed(codes)

        def walk():
            for start in range(codes.shape[1]):
                rows = np.flatnonzero(lengths > start)
                h = np.zeros(len(rows), np.uint64)
                for k in range(min(self.longest, codes.shape[1] - start)):
                    keep = lengths[rows] > start + k
                    rows, h = rows[keep], h[keep]
                    if not len(rows):
                        break
                    h = h * _BASE + mixed[rows, start + k]
                    at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
                    hit = self.sorted[at] == h
                    if hit.any():
                        yield start, k + 1, rows[hit], self.ids[at[hit]]

        return lengths, walk()


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _forward(pieces: Pieces, words: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(lengths, alpha[word, end, language], the found pieces in order): alpha sums all segmentations of each beginning."""
    lengths, walk = pieces.found(words)
    width = int(lengths.max(initial=0))
    alpha = np.zeros((len(words), width + 1, p.shape[1]))
    alpha[:, 0] = 1
    found, at = [], 0
    for start, length, rows, ids in walk:
        while at < start:  # all that ends at `at` + 1 is summed: a strange character also gets there
            alpha[:, at + 1] += alpha[:, at] * _STRANGE_P
            at += 1
        alpha[rows, start + length] += alpha[rows, start] * p[ids]
        found.append((start, length, rows, ids))
    while at < width:
        alpha[:, at + 1] += alpha[:, at] * _STRANGE_P
        at += 1
    return lengths, alpha, found


def word_scores(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word (start marker included), however long, in each language, over all of its segmentations."""
    long = np.array([len(w) > _CHUNK for w in words], bool)
    out = np.empty((len(words), p.shape[1]))
    short = [w for w, cut in zip(words, long) if not cut]
    if short:
        lengths, alpha, _ = _forward(pieces, short, p)
        out[~long] = np.log(alpha[np.arange(len(short)), lengths] + 1e-300)
    if long.any():
        out[long] = _long_scores(pieces, [w for w, cut in zip(words, long) if cut], p)
    return out


def _long_scores(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probabilities of long words, all of them _CHUNK characters at a time. What segmentations reach beyond the chunk, by
    the length of a piece at most, is carried into the next one."""
    reach, live = pieces.longest, np.arange(len(words))  # words that are not at their end
    lengths = np.array([len(w) for w in words])
    carry, logs = np.zeros((len(words), reach, p.shape[1])), np.zeros((len(words), p.shape[1]))
    carry[:, 0] = 1
    out = np.empty((len(words), p.shape[1]))
    begin = 0
    while len(live):
        alpha = np.zeros((len(live), _CHUNK + reach, p.shape[1]))
        alpha[:, :reach] = carry
        at = 0
        for start, length, rows, ids in pieces.found([words[i][begin : begin + _CHUNK + reach - 1] for i in live])[1]:
            if start >= _CHUNK:
                break
            while at < start:
                alpha[:, at + 1] += alpha[:, at] * _STRANGE_P
                at += 1
            alpha[rows, start + length] += alpha[rows, start] * p[ids]
        while at < _CHUNK:
            alpha[:, at + 1] += alpha[:, at] * _STRANGE_P
            at += 1
        left = lengths[live] - begin
        ends, goes_on = np.flatnonzero(left <= _CHUNK), left > _CHUNK
        out[live[ends]] = logs[ends] + np.log(alpha[ends, left[ends]] + 1e-300)
        carry = alpha[goes_on, _CHUNK:]
        scale = carry.max(axis=1) + 1e-300
        carry, logs, live = carry / scale[:, None], logs[goes_on] + np.log(scale), live[goes_on]
        begin += _CHUNK
    return out


def expected_counts(pieces: Pieces, words: list[str], number: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of the words, each counted `number` times, in one language."""
    lengths, alpha, found = _forward(pieces, words, p[:, None])
    alpha = alpha[:, :, 0]
    beta = np.zeros_like(alpha)
    beta[np.arange(len(words)), lengths] = 1
    at = alpha.shape[1] - 1
    for start, length, rows, ids in reversed(found):
        while at > start:  # all that starts at `at` is summed
            beta[:, at - 1] += beta[:, at] * _STRANGE_P
            at -= 1
        beta[rows, start] += beta[rows, start + length] * p[ids]
    total = alpha[np.arange(len(words)), lengths] + 1e-300
    out = np.zeros(len(p))
    for start, length, rows, ids in found:
        share = alpha[rows, start] * p[ids] * beta[rows, start + length] / total[rows] * number[rows]
        np.add.at(out, ids, share)
    return out


def letter_words(text: str) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower())


def marked_chunks(word: str) -> list[str]:
    word = _START + word
    return [word[i : i + _CHUNK] for i in range(0, len(word), _CHUNK)]


class Model:
    """Languages, and the probability of every piece in each of them. Size: languages times pieces, whatever the corpus."""

    def __init__(self, languages: list[str], p: np.ndarray, path: str):
        self.languages, self.p, self.path = languages, p, path
        self._forget()

    def __reduce__(self):
        return Model, (self.languages, self.p, self.path)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def _learn(self, words: list[str]) -> None:
        pieces = pieces_of(self.path)
        marked = [_START + w for w in words]
        rows = [word_scores(pieces, marked[i : i + 4096], self.p) for i in range(0, len(marked), 4096)]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.scores = np.concatenate([self.scores, *rows])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, its posterior probability) of each text; of equally likely languages the first."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        words = [letter_words(t) for t in texts]
        flat = [w for ws in words for w in ws]
        if len(self.known) > _MEMORY:
            self._forget()
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            self._learn(new)
        rows = self.scores[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))]
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(rows, axis=0)])
        ends = np.cumsum([0, *map(len, words)])
        logs = sums[ends[1:]] - sums[ends[:-1]]
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        best = odds.argmax(axis=1)
        share = odds.max(axis=1) / odds.sum(axis=1)
        lettered = [any(c.isalpha() for w in ws for c in w) for ws in words]
        return [(self.languages[b], float(s)) if ok else (UNKNOWN, 0.0) for b, s, ok in zip(best, share, lettered)]


def train(
    docs: DataFrame, vocabulary: str, rounds: int = 3, per_language: int = 4_000, smoothing: float = 0.1
) -> Model:
    """A model from rows with text and non-null lang.

    per_language bounds the training sample: of a language with more rows, those whose id and text hash into the needed share are
    taken (about per_language of them, also where many rows have the same text). rounds: steps of expectation maximisation. Null texts teach nothing.
    """
    rows = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    pieces = pieces_of(vocabulary)
    if not languages:
        return Model([], np.zeros((len(pieces.names), 0)), vocabulary)
    share = F.element_at(F.create_map(*(x for l in languages for x in (F.lit(l), F.lit(min(1.0, per_language / counts[l]))))), F.col("lang"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found = pd.Series([c for t in texts for w in letter_words(t) for c in marked_chunks(w)], dtype=object)
                n = found.value_counts()
                yield pd.DataFrame({"lang": lang, "word": n.index.astype(object), "n": n.to_numpy()})

    words = rows.filter(place < share).mapInPandas(split, "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    p = np.full((len(pieces.names), len(languages)), 1.0 / len(pieces.names))
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(p)  # pieces times languages

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocab, now = pieces_of(vocabulary), sent.value
            sums = np.zeros_like(now)
            for batch in batches:
                for lang, part in batch.groupby("lang"):
                    column = languages.index(lang)
                    for begin in range(0, len(part), 4096):
                        some = part.iloc[begin : begin + 4096]
                        sums[:, column] += expected_counts(vocab, list(some["word"]), some["n"].to_numpy(float), now[:, column])
            at, column = np.nonzero(sums)
            yield pd.DataFrame({"piece": at, "language": column, "n": sums[at, column]})

        counted = words.mapInPandas(expect, "piece long, language long, n double")
        counted = counted.groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        got = np.zeros_like(p)
        got[counted["piece"].to_numpy(), counted["language"].to_numpy()] = counted["n"].to_numpy()
        p = (got + smoothing) / (got + smoothing).sum(axis=0)
    return Model(languages, p, vocabulary)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    docs needs doc_id and text; other columns are ignored. A text that is null or has no letter is `und` with score 0; so is any
    text if the model knows no language. Repeated rows are judged alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out = sent.value.predict([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
