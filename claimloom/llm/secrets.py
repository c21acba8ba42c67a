"""Secret scans with a recursive decoding worklist.

A text is the first layer.  Every layer is scanned for secrets, then unwrapped:
percent escapes and Unicode or character escapes over the whole layer, base64
runs one by one (over line ends and indents, at all four alignments, for a run may
begin in the middle of what looks like one), and compressed bytes anywhere inside
them, member after member.  Bytes that are not UTF-8 count as Latin-1, and once
more without their zero bytes (UTF-16).  What comes out is a new
layer on the worklist, until nothing unwraps any more.  A layer equal to one it
was unwrapped from is not followed (a compressed file can contain itself), and a
layer with the same text from the same places is looked at once, on whatever ways
it is reached: kinds that are nested by turns make a grid of layers, not a tree.
Every character of a layer knows the stretch of the original text it came from,
so a secret in an inner layer is reported at its place in the original.

Compressed bytes are unpacked whole, whatever their size.  All that comes of them
stands for one stretch, so these layers are bytes without places: what a text has
unpacked beyond WHOLE bytes lies in an unlinked temp file that is mapped instead of
in memory, and both are read in the same way.  No result depends on where it lies.

Only texts in which a cheap pattern finds anything are looked at one by one.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import mmap
import re
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
# The three base patterns and the least length of what counts.
WORDS = ("password", "passwd", "secret", "token", "api_?key")
VALUE = r"[A-Za-z0-9+/_.=-]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32

_either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in WORDS)
ASSIGN = re.compile(rf"""({_either})["']?\x20*[:=]\x20*["']?({VALUE})""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})++")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})++|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z][A-Za-z0-9]{1,30};")
_ESCAPE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?")
#: Shorter runs cannot hold the shortest secret.
MIN_RUN = 18
_B64, _LINE_END = "[A-Za-z0-9+/_-]", r"[\x20\t]*\r?\n[\x20\t]*"
RUN = re.compile(rf"{_B64}+(?:{_LINE_END}{_B64}+)*+")
_PACKED = re.compile(rb"\x28\xb5\x2f\xfd|\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|[\x08\x18\x28\x38\x48\x58\x68\x78](?=.)", re.DOTALL)
#: What one text may hold unpacked in memory; the rest lies in files, and is read WINDOW bytes at a time where it is copied.
#: Pieces of up to OVERLAP bytes are not counted, of which one is held at each depth.
WHOLE, WINDOW, OVERLAP = 16 << 20, 1 << 20, 1 << 16
#: Packed bytes that are fed at once: what one step unpacks to is held before its size is known.
FEED = 256

#: For RE2: a superset of the texts in which anything can be found or unwrapped.
CANDIDATE = rf"""(?:{_either})["']? *[:=]|AKIA[A-Z0-9]{{{MIN_ACCESS - 4}}}|[0-9a-f]{{{MIN_HEX}}}|%[0-9A-Fa-f][0-9A-Fa-f]|\\[uUx]|&#|&[A-Za-z]|(?:{_B64}(?:{_LINE_END})?){{{MIN_RUN}}}"""
_CANDIDATE = re.compile(CANDIDATE)
# The same for bytes: all patterns are ASCII, so bytes beyond it only separate, whatever they are decoded to.
_ASSIGN, _ACCESS, _HEX, _PERCENT, _ESCAPES, _ESCAPED, _RUN, _HINT = (
    re.compile(x.pattern.encode("ascii")) for x in (ASSIGN, ACCESS, HEX, PERCENT, ESCAPES, _ESCAPE, RUN, _CANDIDATE))
_STANDARD = bytes.maketrans(b"-_", b"+/")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base secrets of one layer, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Layer:
    """A text, and for each of its characters the stretch of the original it stands for."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, above: frozenset = frozenset()):
        self.text, self.start, self.end = text, start, end
        self.above = above | {_digest(text)}

    def inner(self, text: str, start: np.ndarray, end: np.ndarray) -> Layer | None:
        layer = Layer(text, start, end, self.above)
        return layer if len(layer.above) > len(self.above) else None

    def key(self) -> bytes:
        """The same for layers of the same text from the same places."""
        places = hashlib.blake2b(_digest(self.text), digest_size=16)
        for x in (self.start, self.end):
            same = len(x) > 0 and x.strides == (0,)  # one place for all characters
            places.update(np.ascontiguousarray(x[:1] if same else x))
        return places.digest()


def _characters(raw: bytes) -> tuple[str, np.ndarray]:
    """UTF-8 text (Latin-1 if it is none) and the byte number at which each character begins (one more than characters)."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1"), np.arange(len(raw) + 1)
    data = np.frombuffer(raw, dtype=np.uint8)
    return text, np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))


def _readings(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts that the bytes may be, with the first byte of each character and the one behind it."""
    text, at = _characters(raw)
    yield text, at[:-1], at[1:]
    if b"\0" in raw:
        at = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8))
        yield raw.replace(b"\0", b"").decode("latin-1"), at, at + 1


def _replaced(layer: Layer, pattern: re.Pattern, unwrap) -> Layer | None:
    """The layer with every match of the pattern unwrapped; None if nothing was."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = unwrap(m.group())
        if got is None:
            continue
        text, first, last = got
        parts += [layer.text[at: m.start()], text]
        starts += [layer.start[at: m.start()], layer.start[m.start() + first]]
        ends += [layer.end[at: m.start()], layer.end[m.start() + last - 1]]
        at = m.end()
    if not parts:
        return None
    return layer.inner("".join([*parts, layer.text[at:]]), np.concatenate([*starts, layer.start[at:]]), np.concatenate([*ends, layer.end[at:]]))


def _percent(run: str) -> tuple[str, np.ndarray, np.ndarray]:
    text, at = _characters(bytes.fromhex(run.replace("%", "")))
    return text, at[:-1] * 3, at[1:] * 3


def _escapes(run: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    if run.startswith("&") and not run.startswith("&#"):
        text = html.unescape(run)
        return None if text == run or text.endswith(";") and run != "&semi;" else (text, np.zeros(len(text), dtype=np.int64), np.full(len(text), len(run)))
    if run.startswith("&#"):
        codes, bounds = [int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])], [0, len(run)]
    else:
        found = list(_ESCAPE.finditer(run))
        codes, bounds = [int(m.group(1), 16) for m in found], [*[m.start() for m in found], len(run)]
    if any(c > 0x10FFFF for c in codes):
        return None
    text, starts, ends = [], [], []
    k = 0
    while k < len(codes):
        c, width = codes[k], 1
        if 0xD800 <= c < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1] < 0xE000:
            c, width = 0x10000 + ((c - 0xD800) << 10) + codes[k + 1] - 0xDC00, 2
        text.append(chr(c))
        starts.append(bounds[k])
        ends.append(bounds[k + width])
        k += width
    return "".join(text), np.array(starts), np.array(ends)


def _opener(raw: memoryview):
    """A decompressor for what begins at the first byte."""
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=128 << 20)
    return zlib.decompressobj(wbits=47)


_FAULTS = (zlib.error, zstandard.ZstdError, lzma.LZMAError, OSError, EOFError)


class Room:
    """Holds bytes in memory as long as there is room, then in files; counts the latter."""

    def __init__(self, whole: int):
        self.left, self.small, self.filed = whole, min(OVERLAP, whole // 256), 0

    def held(self, pieces: Iterator[bytes]) -> bytes | mmap.mmap:
        got, size, file = [], 0, None
        for piece in pieces:
            size += len(piece)
            if file is None and size > max(self.left, self.small):
                file = tempfile.TemporaryFile()
                file.writelines(got)
                got = []
            (file.write if file else got.append)(piece)
        if file is None:
            self.left -= size if size > self.small else 0
            return b"".join(got)
        self.filed += 1
        with file:
            file.flush()
            return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def _steps(raw: memoryview, taken: list[int]) -> Iterator[bytes]:
    """Pieces of the bytes inside packed data up to its end or its first fault; ``taken`` gets the packed bytes read, 0 after a fault."""
    at = 0
    try:
        opened = _opener(raw)
        while at < len(raw) and not opened.eof:
            more = opened.decompress(raw[at: at + FEED])
            at = min(at + FEED, len(raw))
            taken[0] = at - len(opened.unused_data)
            yield more
    except _FAULTS:
        taken[0] = 0


def _members(raw: bytes | mmap.mmap, room: Room) -> Iterator[tuple[int, bytes | mmap.mmap]]:
    """Place and content of every compressed member in the bytes."""
    view, at = memoryview(raw), 0
    while m := _PACKED.search(raw, at):
        at = m.start() + 1
        if len(m.group()) == 1 and (raw[at - 1] << 8 | raw[at]) % 31:
            continue
        taken = [0]
        more = room.held(_steps(view[m.start():], taken))
        if len(more):
            yield m.start(), more
            at = m.start() + max(taken[0], 1)


def _pieces(raw: bytes | mmap.mmap, start: int, end: int) -> Iterator[bytes]:
    for at in range(start, end, WINDOW):
        yield raw[at: min(at + WINDOW, end)]


def _percent_bytes(raw: bytes | mmap.mmap, start: int, end: int) -> Iterator[bytes]:
    for at in range(start, end, 3 * WINDOW):
        yield bytes.fromhex(raw[at: min(at + 3 * WINDOW, end)].replace(b"%", b"").decode("ascii"))


def _escape_bytes(raw: bytes | mmap.mmap, start: int, end: int) -> Iterator[bytes]:
    if raw[start: start + 1] == b"&":
        got = _escapes(raw[start: end].decode("ascii"))
        yield got[0].encode("utf-8", "surrogatepass") if got else raw[start: end]
    elif any(int(m.group(1), 16) > 0x10FFFF for m in _ESCAPED.finditer(raw, start, end)):
        yield from _pieces(raw, start, end)
    else:
        for m in _ESCAPED.finditer(raw, start, end):
            yield chr(int(m.group(1), 16)).encode("utf-8", "surrogatepass")


def _replaced_bytes(raw: bytes | mmap.mmap, pattern: re.Pattern, unwrap) -> Iterator[bytes]:
    at = 0
    for m in pattern.finditer(raw):
        yield from _pieces(raw, at, m.start())
        yield from unwrap(raw, *m.span())
        at = m.end()
    yield from _pieces(raw, at, len(raw))


def _body(raw: bytes | mmap.mmap, start: int, end: int) -> Iterator[bytes]:
    """A base64 run in the standard letters, without line ends and indents."""
    for piece in _pieces(raw, start, end):
        yield piece.translate(_STANDARD, b" \t\r\n")


def _decoded(raw: bytes | mmap.mmap, start: int, end: int, offset: int) -> Iterator[bytes]:
    """The bytes of a base64 run from its letter ``offset`` on."""
    rest = b""
    for piece in _body(raw, start, end):
        skip = min(offset, len(piece))
        rest, offset = rest + piece[skip:], offset - skip
        n = len(rest) // 4 * 4
        yield base64.b64decode(rest[:n])
        rest = rest[n:]
    if len(rest) > 1:
        yield base64.b64decode(rest + b"=" * (4 - len(rest)))


def _long_enough(raw: bytes | mmap.mmap, start: int, end: int) -> bool:
    size = 0
    for piece in _body(raw, start, end) if end - start >= MIN_RUN else ():
        size += len(piece)
        if size >= MIN_RUN:
            return True
    return False


class Inside:
    """Bytes that came of a compressed member, all of which stand for one stretch; ``packed`` if they may hold members and zero bytes."""

    def __init__(self, raw: bytes | mmap.mmap, start: int, end: int, packed: bool, above: frozenset = frozenset()):
        self.raw, self.start, self.end, self.packed = raw, start, end, packed
        self.digest = hashlib.blake2b(raw, digest_size=16).digest()
        self.known = (self.digest, packed) in above
        self.above = above | {(self.digest, False), (self.digest, packed)}

    def key(self) -> tuple:
        return self.digest, self.start, self.end, self.packed

    def inner(self, raw: bytes | mmap.mmap, packed: bool) -> Iterator[Inside]:
        found = Inside(raw, self.start, self.end, packed, self.above)
        if len(raw) and not found.known:
            yield found

    def spans(self) -> set[tuple[int, int, int]]:
        found = (any(m.end(2) - m.start(2) >= MIN_VALUE for m in _ASSIGN.finditer(self.raw)),
                 any(m.end() - m.start() >= MIN_ACCESS for m in _ACCESS.finditer(self.raw)), _HEX.search(self.raw))
        return {(self.start, kind, self.end) for kind, hit in enumerate(found) if hit}

    def layers(self, room: Room) -> Iterator[Inside]:
        raw = self.raw
        if _HINT.search(raw):
            for pattern, unwrap in ((_PERCENT, _percent_bytes), (_ESCAPES, _escape_bytes)):
                if pattern.search(raw):
                    yield from self.inner(room.held(_replaced_bytes(raw, pattern, unwrap)), False)
            for m in _RUN.finditer(raw):
                if _long_enough(raw, *m.span()):
                    for offset in range(4):
                        yield from self.inner(room.held(_decoded(raw, *m.span(), offset)), True)
        if self.packed:
            if raw.find(b"\0") >= 0:
                yield from self.inner(room.held(x.replace(b"\0", b"") for x in _pieces(raw, 0, len(raw))), False)
            for _, more in _members(raw, room):
                yield from self.inner(more, True)


def _in_run(run: str) -> np.ndarray:
    """Which characters of a run are no line ends or indents."""
    return np.frombuffer(run.encode("ascii"), dtype=np.uint8) > 0x20


def _layers(layer: Layer, room: Room) -> Iterator[Layer | Inside]:
    """What one step unwraps from a layer with places."""
    for inner in (_replaced(layer, PERCENT, _percent), _replaced(layer, ESCAPES, _escapes)):
        if inner:
            yield inner
    for m in RUN.finditer(layer.text):
        if m.end() - m.start() < MIN_RUN:
            continue
        run = m.group()
        places = np.flatnonzero(_in_run(run)) + m.start()
        if len(places) < MIN_RUN:
            continue
        body = "".join(run.split()).replace("-", "+").replace("_", "/")
        for offset in range(4):
            n = (len(body) - offset) // 4 * 4 + (len(body) - offset) % 4 * ((len(body) - offset) % 4 > 1)
            raw = base64.b64decode(body[offset: offset + n] + "=" * (-n % 4))
            where = places[offset: offset + n]
            for text_in, first, behind in _readings(raw):
                if _CANDIDATE.search(text_in):
                    inner = layer.inner(text_in, layer.start[where[first * 4 // 3]], layer.end[where[-(-behind * 4 // 3) - 1]])
                    if inner:
                        yield inner
            for at, more in _members(raw, room):
                yield Inside(more, int(layer.start[where[at * 4 // 3]]), int(layer.end[where[-1]]), True)


def scan(text: str, whole: int = WHOLE) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans, all spans, layers looked at, and pieces that were held in files; only the last depends on ``whole``."""
    base = base_spans(text)
    place = np.arange(len(text) + 1)
    room = Room(whole)
    # A stack of iterators: layers are made when their turn comes.
    work: list[Iterator[Layer | Inside]] = [iter([Layer(text, place[:-1], place[1:])])]
    every, seen, layers = set(base), set(), 0
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        if isinstance(layer, Inside):
            every |= layer.spans()
            work.append(layer.layers(room))
            continue
        if layers > 1:
            every |= {(int(layer.start[s]), kind, int(layer.end[e - 1])) for s, kind, e in base_spans(layer.text)}
        work.append(_layers(layer, room))
    return base, sorted(every), layers, room.filed


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


NAMES = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_windowed"]
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_windowed long"


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text", whole: int = WHOLE) -> DataFrame:
    """One row per row: the id under its own name and the columns of NAMES.

    Spans are code points of the original text, end exclusive, by start, then by
    kind as listed.  Null and empty texts have none.  Repeated rows are scanned
    each; other columns are ignored, whatever their names.
    """
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            n = len(column)
            counts, digests, spans = np.zeros((3, n), dtype=np.int64), [nothing] * n, [""] * n
            layers, windowed = np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for i in np.flatnonzero(pc.match_substring_regex(column, CANDIDATE).to_numpy(zero_copy_only=False)):
                base, every, layers[i], windowed[i] = scan(column[i].as_py(), whole)
                for _, kind, _ in base:
                    counts[kind, i] += 1
                digests[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()),
                                              pa.array(layers), pa.array(windowed)], names=[batch.schema.names[0], *NAMES])

    slim = docs.select(F.col(doc), F.col(text).cast("string").alias("_text"))
    schema = slim.select(doc).schema
    for part in SCHEMA.split(", "):
        schema = schema.add(*part.split(" "))
    return slim.mapInArrow(run, schema)
