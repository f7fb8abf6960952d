"""Secret scan: a worklist that unwraps URL, Unicode, base64 and compressed layers of a text until nothing new comes out.

Every layer is scanned. A layer knows for each of its characters which part of the whole text it came from, so what is found
in it is reported as a span of the whole text. A layer that was seen before at the same place is not unwrapped again.

Escapes inside escapes (%2525..., \\u005cu005c...) are taken off once, which is scanned, and then all at once: a layer for each of
them would take time and memory with the square of their number. Base64 is read from all four places at which it can begin, since
what stands before it in one run of letters (a path, an id and its _) need not be a multiple of four.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order.
KINDS = ("assign", "access", "hex")


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run that is too short holds no long one
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST_VALUE = 12

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
#: One of the above at the end of a text: no escape is longer than _LONGEST characters.
_ENDS_ESCAPE, _LONGEST = re.compile(rf"(?:%([0-9A-Fa-f]{{2}})|{_ESCAPE.pattern})\Z"), 10
#: Shorter runs cannot hold a finding. Lines of one encoded block, of any length, are also read together up to a padding: also
#: indented or quoted ones, and string literals that are added up.
_LEAST_RUN = 20
_JOINT = r"(?:[\"']?[ \t]*+(?:[+\\,][ \t]*+)?\r?\n[ \t>\"']*+)"
_BASE64 = re.compile(
    rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{20,}}+(?:{_JOINT}[A-Za-z0-9+/_-]++)*+|[A-Za-z0-9+/_-]++(?:{_JOINT}[A-Za-z0-9+/_-]++)++)={{0,2}}"
)
_TO_STANDARD = str.maketrans("-_", "+/")
_WRAPPED = re.compile(_JOINT)
#: Enough readable bytes for a finding; and how gzip, bzip2 and xz streams begin in base64, wherever in a run they do.
_READABLE, _BOXED = re.compile(rb"[\t\n\r\x20-\x7e]{12}|(?:[\x20-\x7e]\x00){12}"), re.compile(r"(?=H4sI|Qlpo|[/_]Td6WFo|(?<=[-+/_])e)")
#: Bytes taken at a time from a compressed stream.
_PIECE = 1 << 20
#: Fewer characters cannot hold a finding.
_WIDE = re.compile(rb"(?:[\x01-\xff]\x00){12}")


class Span(NamedTuple):
    start: int
    end: int
    kind: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def scan(text: str) -> list[Span]:
    """What the three patterns find in a text, in code points, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [Span(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= _LEAST_VALUE]
    if "AKIA" in text:
        found += [Span(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [Span(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, s.kind, s.end))


class Layer:
    """A decoded text; character i came from starts[i] to ends[i] of the whole text.

    left: for what came out of a compressed stream, a list of the one number of bytes that may still come out of that stream.
    once: one level of escapes was taken off here, and another layer has them all off.
    """

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, left: list[int] | None = None, once: bool = False):
        self.text, self.starts, self.ends, self.left, self.once = text, starts, ends, left, once

    @staticmethod
    def whole(text: str) -> Layer:
        at = np.arange(len(text), dtype=np.int64)
        return Layer(text, at, at + 1)

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


def _at(places: np.ndarray, index: np.ndarray) -> np.ndarray:
    """places[index], without memory where all places are one."""
    return np.broadcast_to(places[0], len(index)) if len(places) and not places.strides[0] else places[index]


def _bytes_layers(data: bytes, starts: np.ndarray, ends: np.ndarray, left: list[int] | None = None) -> list[Layer]:
    """Bytes as text, mapped by code point.

    As UTF-8 if they are; else each byte as a character (Latin-1), so that what is ASCII in them is seen wherever it stands.
    Where every second byte of a stretch is null, also as UTF-16 of both byte orders and both places to begin.
    """
    if not data:
        return []
    raw = np.frombuffer(data, np.uint8)
    try:
        text, first = data.decode("utf-8"), np.flatnonzero((raw & 0xC0) != 0x80)
    except UnicodeDecodeError:
        text, first = data.decode("latin-1"), np.arange(len(raw))
    out = [Layer(text, _at(starts, first), _at(ends, np.append(first[1:], len(raw)) - 1), left)]
    if _WIDE.search(data):
        for at in (0, 1):
            n = (len(raw) - at) // 2
            for high in (1, 0):  # little and big endian
                codes = raw[at + high : at + 2 * n : 2].astype(np.int64) * 256 + raw[at + 1 - high : at + 2 * n : 2]
                text = "".join(map(chr, codes))  # a surrogate stays one: positions are those of the bytes
                if n:
                    span = slice(at, at + 2 * n, 2), slice(at + 1, at + 2 * n, 2)
                    out.append(Layer(text, starts[span[0]], ends[span[1]], left))
    return out


def _box(data: bytes):
    """What decompresses data, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflate(data: bytes, most: int) -> tuple[bytes, bool] | None:
    """One compression layer less, all members of it, and whether it goes on beyond `most` bytes; None if there is none.

    What follows the last member, or is damaged, is kept as it is.
    """
    out, size = [], 0
    while (box := _box(data)) is not None:
        rest = data
        try:
            while not box.eof:
                piece = box.decompress(rest, min(_PIECE, most - size + 1))
                rest = getattr(box, "unconsumed_tail", b"")
                size += len(piece)
                out.append(piece)
                if size > most:
                    return b"".join(out)[:most], True
                if not piece and not rest and getattr(box, "needs_input", True):  # cut off
                    return b"".join(out), False
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            break
        data = box.unused_data
    return (b"".join([*out, data]), False) if out else None


def _opens(text: str, start: int, end: int) -> bool:
    """Whether a compressed stream begins with this character of a base64 block."""
    head = _WRAPPED.sub("", text[start : min(end, start + 160)]).rstrip("=").translate(_TO_STANDARD)[:88]
    data = base64.b64decode(head[: len(head) // 4 * 4])
    if (box := _box(data)) is None:
        return False
    try:
        box.decompress(data)
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return False
    return True


_BEGINS, _ENDS = frozenset(map(ord, "%\\&")), frozenset(map(ord, "0123456789abcdefABCDEF};"))
_PAIR = re.compile("[\ud800-\udbff][\udc00-\udfff]")


def _long(block: str) -> bool:
    """Whether the lines of a block hold enough characters together."""
    return len(block) >= _LEAST_RUN and len(_WRAPPED.sub("", block).rstrip("=")) >= _LEAST_RUN


class Scanner:
    """The worklist for one text. `most` bounds the bytes that come out of each compressed stream of the text, with all streams
    inside it (against decompression bombs). What is beyond is counted in `refused`, and `hidden` has where it came from.
    """

    def __init__(self, text: str, most: int):
        self.most, self.refused = most, 0
        self.hidden: set[tuple[int, int]] = set()
        self.found: set[Span] = set()
        self.seen: set[tuple] = set()
        self.work: list[Layer] = []
        self.layers = 0
        self._queue(Layer.whole(text) if self._wrapped(text) else None)
        while self.work:
            layer = self.work.pop()
            if not layer.once and self._unicode(layer) | self._percent(layer):
                self._unescaped(layer)
            self._base64(layer)

    @staticmethod
    def _wrapped(text: str) -> bool:
        return bool(any(_long(m[0]) for m in _BASE64.finditer(text)) or ("%" in text and _PERCENT.search(text)) or _ESCAPE.search(text))

    def _queue(self, layer: Layer | None, new: bool = False) -> None:
        if layer is None:
            return
        digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        key = (digest, int(layer.starts[0]), int(layer.ends[-1]))
        if key in self.seen:  # a cycle, or two ways to one layer
            return
        self.seen.add(key)
        if new:
            self.layers += 1
            self.found.update(Span(*layer.origin(s.start, s.end), s.kind) for s in scan(layer.text))
        self.work.append(layer)

    def _bytes(self, data: bytes, starts: np.ndarray, ends: np.ndarray, left: list[int] | None) -> None:
        """Bytes as they are, or after as many decompressions as they take. Only what comes out of a stream is charged, once."""
        known = set()
        while data:
            if _box(data) is None:
                break
            bound = [self.most] if left is None else left
            inner, beyond = _inflate(data, bound[0]) or (None, False)
            start, end = int(starts.min()), int(ends.max())
            if beyond:
                self.refused += 1
                self.hidden.add((start, end))
            if not inner or (mark := hashlib.blake2b(inner).digest()) in known:
                break
            known.add(mark)
            bound[0] -= len(inner)
            left = bound
            starts, ends, data = np.broadcast_to(start, len(inner)), np.broadcast_to(end, len(inner)), inner
        for layer in _bytes_layers(data, starts, ends, left):
            self._queue(layer, new=True)

    def _replaced(self, layer: Layer, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> None:
        """The layer with some of its ranges replaced by decoded text."""
        texts, starts, ends, at = [], [], [], 0
        for a, b, text, s, e in parts:
            texts += [layer.text[at:a], text]
            starts += [layer.starts[at:a], s]
            ends += [layer.ends[at:a], e]
            at = b
        texts.append(layer.text[at:])
        starts.append(layer.starts[at:])
        ends.append(layer.ends[at:])
        whole = "".join(texts)
        if whole:
            self._queue(Layer(whole, np.concatenate(starts), np.concatenate(ends), layer.left, once=True), new=True)

    def _unescaped(self, layer: Layer) -> None:
        """The layer with all escapes taken off, also those that come out of others, in one pass: a decoded character may end
        an escape that began before it, or begin one that ends later."""
        codes: list[int] = []
        first, last, raw = [], [], []
        begun = -_LONGEST  # where the last character that can begin an escape stands
        for i, char in enumerate(layer.text):
            code, start, from_byte = ord(char), i, False
            while True:
                codes.append(code), first.append(start), last.append(i), raw.append(from_byte)
                if code in _BEGINS:
                    begun = len(codes) - 1
                if code not in _ENDS or len(codes) - begun > _LONGEST:
                    break
                m = _ENDS_ESCAPE.search("".join(map(chr, codes[-_LONGEST:])))
                if not m:
                    break
                code = int(m[7]) if m[7] else int(next(g for g in m.groups()[:6] if g), 16)
                if code > 0x10FFFF:
                    break
                at = len(codes) - (m.end() - m.start())
                start, from_byte = first[at], m[1] is not None
                for held in (codes, first, last, raw):
                    del held[at:]
                begun = next((k for k in range(len(codes) - 1, max(-1, len(codes) - _LONGEST), -1) if codes[k] in _BEGINS), -_LONGEST)
        self._put_together(layer, codes, layer.starts[first], layer.ends[last], raw)

    def _put_together(self, layer: Layer, codes: list[int], starts: np.ndarray, ends: np.ndarray, raw: list[bool]) -> None:
        """Queues the layer of these characters, where runs of decoded bytes are UTF-8 or Latin-1, or packed."""
        texts, keep, at = [], [], 0
        edges = np.flatnonzero(np.diff(np.array([False, *raw, False], np.int8)))
        for a, b in [*zip(edges[::2].tolist(), edges[1::2].tolist()), (len(codes), len(codes))]:
            texts.append("".join(map(chr, codes[at:a])))
            keep.append((starts[at:a], ends[at:a]))
            data = bytes(codes[a:b])
            if data:
                layers = _bytes_layers(data, starts[a:b], ends[a:b])
                texts.append(layers[0].text)
                keep.append((layers[0].starts, layers[0].ends))
                if len(layers) > 1 or _box(data):
                    self._bytes(data, starts[a:b], ends[a:b], layer.left)
            at = b
        text, starts, ends = "".join(texts), *map(np.concatenate, zip(*keep))
        pairs = [m.start() for m in _PAIR.finditer(text)]
        if pairs:  # two escapes of one character
            text = _PAIR.sub(lambda m: chr(0x10000 + ((ord(m[0][0]) - 0xD800) << 10) + (ord(m[0][1]) - 0xDC00)), text)
            ends[pairs] = ends[np.array(pairs) + 1]
            starts, ends = np.delete(starts, np.array(pairs) + 1), np.delete(ends, np.array(pairs) + 1)
        if text:
            self._queue(Layer(text, starts, ends, layer.left, once=True), new=True)

    def _unicode(self, layer: Layer) -> bool:
        parts = []
        for m in _ESCAPE.finditer(layer.text):
            code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
            if code > 0x10FFFF:
                continue
            a, b = m.span()
            s, e = layer.origin(a, b)
            if parts and 0xDC00 <= code < 0xE000 and parts[-1][1] == a and "\ud800" <= parts[-1][2] < "\udc00":
                high = parts.pop()
                a, s = high[0], int(high[3][0])
                code = 0x10000 + ((ord(high[2]) - 0xD800) << 10) + (code - 0xDC00)
            parts.append((a, b, chr(code), np.array([s]), np.array([e])))
        if parts:
            self._replaced(layer, parts)
        return bool(parts)

    def _percent(self, layer: Layer) -> bool:
        parts = []
        for m in _PERCENT.finditer(layer.text):
            data, at = bytes.fromhex(m[0].replace("%", "")), m.start()
            starts, ends = layer.starts[at : m.end() : 3], layer.ends[at + 2 : m.end() : 3]
            layers = _bytes_layers(data, starts, ends)
            inner = layers[0]
            parts.append((at, m.end(), inner.text, inner.starts, inner.ends))
            if len(layers) > 1 or _box(data):
                self._bytes(data, starts, ends, layer.left)
        if parts:
            self._replaced(layer, parts)
        return bool(parts)

    def _base64(self, layer: Layer) -> None:
        for m in _BASE64.finditer(layer.text):
            if not _long(m[0]):
                continue
            start, end = m.span()
            self._block(layer, start, end)
            for phase in (1, 2, 3):
                self._block(layer, start + phase, end, sure=False)
            for x in _BOXED.finditer(layer.text, start, end):
                if x.start() > start and _opens(layer.text, x.start(), end):
                    self._block(layer, x.start(), end)
            if "\n" not in m[0]:
                continue
            # Words of the text around may stand as lines before and after the block, and lines may be blocks of their own. A
            # block decodes alike from each earlier line that is a multiple of four characters before it.
            joints = [x.span() for x in _WRAPPED.finditer(layer.text, start, end)]
            lines = list(zip([start, *(b for _, b in joints)], [*(a for a, _ in joints), end]))
            offset, phases, widest = 0, {0}, max(b - a for a, b in lines)
            last = next(b for a, b in reversed(lines) if b - a == widest)
            runs = [0, *(k for k in range(1, len(lines)) if lines[k][1] - lines[k][0] != lines[k - 1][1] - lines[k - 1][0]), len(lines)]
            for first, after in zip(runs, runs[1:]):  # lines of one length; a wrapped block is these and a shorter one
                ends = {lines[after - 1][1], lines[min(after, len(lines) - 1)][1]}
                for k in range(first, after):
                    a, b = lines[k]
                    if b - a >= _LEAST_RUN:
                        self._block(layer, a, b)
                    head = _WRAPPED.sub("", layer.text[a : min(end, a + 40)]).translate(_TO_STANDARD)[:8]
                    packed = k < first + 3 and len(head) == 8 and "=" not in head and _box(base64.b64decode(head))
                    if offset % 4 not in phases:
                        phases.add(offset % 4)
                        self._block(layer, a, end)
                        if a < last < end:
                            self._block(layer, a, last)
                    if k == first or packed:
                        for stop in ends:
                            if stop - a >= _LEAST_RUN:
                                self._block(layer, a, stop)
                    offset += len(layer.text[a:b].rstrip("="))
            # one, two or three lines less, and no line that is shorter than the widest
            for stop in {last, *(b for _, b in lines[-4:-1])}:
                for a in {start, next(a for a, b in lines if b - a == widest)}:
                    if a < stop:
                        self._block(layer, a, stop)

    def _block(self, layer: Layer, start: int, end: int, sure: bool = True) -> None:
        """Decodes a block. One that need not begin here counts only if what comes out can hold a finding."""
        text = layer.text[start:end]
        body = _WRAPPED.sub("", text).rstrip("=").translate(_TO_STANDARD)
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            data = base64.b64decode(body + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            return
        if not data or not (sure or _READABLE.search(data)):
            return
        keep = np.ones(len(text), bool)
        for m in _WRAPPED.finditer(text):
            keep[m.start() : m.end()] = False
        at = np.flatnonzero(keep) + start
        unit = np.arange(len(data))
        self._bytes(data, layer.starts[at[unit * 8 // 6]], layer.ends[at[(unit * 8 + 7) // 6]], layer.left)


def _found(text: str, most: int) -> tuple[list[Span], list[Span], Scanner | None]:
    base = scan(text)
    if not Scanner._wrapped(text):
        return base, base, None
    deep = Scanner(text, most)
    return base, sorted({*base, *deep.found}, key=lambda s: (s.start, s.kind, s.end)), deep


def find_secrets(text: str, most: int) -> tuple[list[Span], list[Span], int, int]:
    """(base spans, all spans, decoded layers, refused layers) of a text."""
    base, spans, deep = _found(text, most)
    return base, spans, deep.layers if deep else 0, deep.refused if deep else 0


COLUMNS = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, "
    "n_layers long, n_refused long"
)


def scan_documents(docs: DataFrame, most: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, base counts by kind, base_sha256, spans (base ones and those in decoded layers), n_spans,
    n_layers, n_refused.

    docs needs doc_id and text; other columns are ignored. A null text is empty: no spans, the hash of the empty string.
    Repeated rows are scanned once each. Of a compressed stream, with all streams inside it, `most` bytes are
    scanned; what is beyond is counted in n_refused, so one hostile document cannot exhaust a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, spans, layers, refused = find_secrets(text.as_py() or "", most)
                listed = ",".join(map(str, base))
                rows.append((
                    doc_id, *(sum(s.kind == k for s in base) for k in range(len(KINDS))),
                    hashlib.sha256(listed.encode()).hexdigest(), ",".join(map(str, spans)), len(spans), layers, refused,
                ))
            kinds = [pa.string() if n in ("base_sha256", "spans") else pa.int64() for n in _NAMES_OUT]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES_OUT)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COLUMNS)


_NAMES_OUT = [x.split()[0] for x in COLUMNS.split(", ")]
MASK = "[secret]"


def masked(text: str | None, most: int) -> str | None:
    """The text with every found span and every refused one, overlapping ones together, replaced by MASK."""
    _, spans, deep = _found(text, most) if text else ([], [], None)
    places = sorted([(s.start, s.end) for s in spans] + [*(deep.hidden if deep else ())])
    if not places:
        return text
    out, at = [], 0
    for start, end in places:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, most: int = 64 << 20) -> DataFrame:
    """docs, same columns and rows, with found secrets in text replaced; n_chars, if there, is counted anew for changed texts."""
    at, sized = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(at).to_pylist()
            after = [masked(t, most) for t in before]
            columns = list(batch.columns)
            columns[at] = pa.array(after, batch.schema.field(at).type)
            if sized is not None:
                counts = [len(a) if a != b else n for a, b, n in zip(after, before, batch.column(sized).to_pylist())]
                columns[sized] = pa.array(counts, batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
