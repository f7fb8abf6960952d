"""Packing by powers of two: every document is cut into pieces of binary lengths, and equal lengths share a bucket.

A piece is a sequence of its own, so no sequence crosses documents and none needs padding. A batch of one bucket is
rectangular: `2048 / length` pieces of a bucket make up as many tokens as one longest sequence.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a worker remembers; beyond it the memory is emptied, the ids stay the same.
MEMORY = 1_000_000
#: Longer words are not remembered.
_LONG_WORD = 64
#: Plain words: letters, then marks that no tokenizer rule joins to letters.
_PLAIN = re.compile(r"([^\W\d_]+)([.,;:!?|\"#$%&*()]*)")


def _letters(core: str) -> bool:
    """Whether a word stays letters only in the tokenizer's normal form: some letters become one with a mark, which joins the next."""
    return core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha()


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary"
)


class WordTokenizer:
    """Ids of texts from a tokenizer whose tokens never hold white space and mark a word's end, with repeated words looked up."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.memory, self.known = Tokenizer.from_file(path), memory, {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _cores(self, cores: list[str]) -> dict[str, bytes]:
        """Ids of words of letters only. Plain ASCII ones are spelled as the vocabulary spells them; of others many are
        encoded at a time, and each ends with the first id that marks an end."""
        model = self.tokenizer.model.tokenize
        out = {w: np.array([t.id for t in model(w)], "<u4").tobytes() for w in cores if w.isascii()}
        cores = [w for w in cores if w not in out]
        for begin in range(0, len(cores), 1000):
            part = cores[begin : begin + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) if len(ids) else ids
            if len(last) == len(part) and last[-1] == len(ids) - 1:
                data, bounds = ids.tobytes(), [0, *((last + 1) * 4).tolist()]
                out.update((w, data[bounds[i] : bounds[i + 1]]) for i, w in enumerate(part))
            else:  # a word that the tokenizer's rules split
                out.update((w, self._alone(w)) for w in part)
        return out

    def _learn(self, words: set[str]) -> None:
        known, plain = self.known, []
        for word in words:
            if len(word) <= _LONG_WORD:
                if (m := _PLAIN.fullmatch(word)) and _letters(m[1]):
                    core = m[1].lower() if m[1].isascii() else m[1]
                    plain.append((word, core, m[2]))
                else:
                    known[word] = self._alone(word)
        cores = self._cores(list({core for _, core, _ in plain if core not in known}))
        for tail in {tail for *_, tail in plain if tail not in known}:
            known[tail] = self._alone(tail)
        for word, core, tail in plain:
            known[word] = (cores.get(core) or known[core]) + known[tail]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers. Only blanks and line ends split: both are white space to any tokenizer."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.known) > self.memory:
                self.known = {"": b""}
                new = set().union(*split) - {""}
            self._learn(new)
        long = {w for w in new if len(w) > _LONG_WORD}
        look = self.known.__getitem__
        if not long:
            return [b"".join(map(look, words)) for words in split]
        return [b"".join(self._alone(w) if w in long else look(w) for w in words) for words in split]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def binary_lengths(tokens: int, longest: int) -> list[int]:
    """Lengths of the pieces, longest first: as many longest ones as fit, then the binary digits of the rest."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def binary_pieces(
    docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int | None = 1, keep_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of the length), ids, sequence_id, offset.

    docs needs doc_id and text; other columns are ignored. A null text is empty. The ids of a text are followed by end_id,
    so with an end_id every document has a piece; without one an empty text has none. A null doc_id stays null. Repeated
    rows are packed once each. longest must be a power of two. A piece fills its sequence: offset is 0, sequence_id unique.
    The rows of a sequence id are those of an input partition, so a lost task makes the same ids again.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                coded = words.ids([text or "" for text in part.column(1).to_pylist()])
                for doc_id, ids in zip(part.column(0).to_pylist(), coded):
                    ids += tail
                    n, start = len(ids) // 4, 0
                    for length in binary_lengths(n, longest):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(piece), n, length.bit_length() - 1, piece if keep_ids else None))
                        start += length
                if rows:
                    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                    names = [x.split()[0] for x in PIECES.split(", ")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names
                    )

    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
