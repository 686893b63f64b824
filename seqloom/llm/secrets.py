"""Secrets in texts, also where they are wrapped in layers of URL, Unicode, base64 and compressed encoding."""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from array import array
from codecs import getincrementaldecoder
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from io import StringIO
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds in their order, and what each must match.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same spans as runs of hex digits of which shorter ones are dropped
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: A percent escape; the escaped percent signs before its digits unwrap with it, however many there are.
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})++")
PERCENT_UNIT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
#: A percent sign that was itself escaped, once or more. Each level is a layer of its own for chains of up to LONG_CHAIN;
#: the levels of longer ones above that go at once, between which only digits of the escape itself differ, which no layer reports.
ESCAPED_PERCENT = re.compile(r"%(?:25)+[0-9A-Fa-f]{2}")
ONCE_ESCAPED = re.compile(r"(%(?:25)+[0-9A-Fa-f]{2})|(?:%(?!25[0-9A-Fa-f]{2})[0-9A-Fa-f]{2})++")
LONG_CHAIN = 16
ESCAPE_DIGITS = re.compile(r"(?<=%)(?:25)*[0-9A-Fa-f]{2}")
#: An escape; backslashes that were doubled before it, as by JSON in JSON, unwrap with it.
ESCAPE = re.compile(r"(?<!\\)\\+(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\})")
#: Percent escapes and the characters that are left bare between them; a bare plus is a space.
URL_BYTES = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])++")
URL_BYTE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})|(.)", re.DOTALL)
#: Where base64 goes on after a line: a line of its own. Within streams any break after digits is tried as well.
NEXT_LINE = re.compile(r"""\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?=[ \t]*(?:[\r\n"'<]|\Z))""")
BREAK = re.compile(r"(?<=[A-Za-z0-9+/_-]{16})\r?\n[ \t]*(?=[A-Za-z0-9+/_-])")
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|x[\x01\x5e\x9c\xda]", re.DOTALL)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BROKEN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\udc80-\udcff]")
CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
LONE = re.compile(r"[\udc80-\udcff]")
UTF16 = re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){11}[\t\r\n\x20-\x7e]", re.DOTALL)  # of either byte order

#: Bytes of an expanded stream that are kept at once. A longer one is expanded anew, piece by piece, for each pass over it.
MAX_EXPANDED = 8 << 20
PIECE = 1 << 20

#: Runs within runs that are looked into by recursion, and digests kept of layers that came from them; beyond, work waits or repeats.
DEEPEST, MOST_SEEN = 20, 100_000

# An escape that the end of a text may cut; the rest of a run that comes in parts; and what pieces of streams need.
CUT = {PERCENT: re.compile(r"%(?:25)*[0-9A-Fa-f]?"), ESCAPE: re.compile(r"\\(?:[uxU][0-9A-Fa-f]{0,7}|u\{[0-9A-Fa-f]{0,6})?")}  # from the last backslash
REST_OF = {URL_BYTES: re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])*+"), BASE64: re.compile(r"[A-Za-z0-9+/_-]*={0,2}")}
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MANY_PERCENT = re.compile(r"%25(?:25)+(?=[0-9A-Fa-f]?\Z)")
SPACES = re.compile(r"\x20{3,}")
STRETCH = re.compile(r"[^\ufffd]{12,}")  # the shortest text that has, or wraps, a finding

Span = tuple[int, int, int]


def _hex_beside_escapes(text: str) -> Iterator[tuple[int, int]]:
    """Runs of hex digits of a layer, without the digits of percent escapes that are still to be unwrapped."""
    for m in HEX.finditer(text):
        escape = ESCAPE_DIGITS.match(text, m.start())
        start = max(escape.end(), m.start()) if escape else m.start()
        if m.end() - start >= LEAST_HEX:
            yield start, m.end()


def scan(text: str, layer: bool = False) -> list[Span]:
    """(start, kind, end) of each finding in a text, leftmost and without overlap within a kind; in an unwrapped layer escapes are no hex."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(start, 2, end) for start, end in (_hex_beside_escapes(text) if layer else map(re.Match.span, HEX.finditer(text)))]
    return sorted(found)


class Layer:
    """A text, and the spans of the document that its characters came from, as runs of characters.

    Run i begins at character ``at[i]``. With ``step[i]`` 1 its characters stand
    for one character of the document each, from ``first[i]`` on; with 0 all
    stand for ``first[i]`` to ``last[i]``. Layers keep the order of the
    document, so the span of some characters is that of their two ends.
    """

    def __init__(self, text: str, at: np.ndarray, first: np.ndarray, last: np.ndarray, step: np.ndarray):
        self.text, self.at, self.first, self.last, self.step = text, at, first, last, step

    @classmethod
    def whole(cls, text: str) -> Layer:
        zero = np.zeros(1, np.int32)
        return cls(text, zero, zero, zero + 1, zero + 1)

    def firsts(self, places: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.at, places, "right") - 1
        return (self.first[run] + self.step[run] * (places - self.at[run])).astype(np.int32)

    def lasts(self, places: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.at, places, "right") - 1
        return (self.last[run] + self.step[run] * (places - self.at[run])).astype(np.int32)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.firsts(np.array([start]))[0]), int(self.lasts(np.array([end - 1]))[0])

    def rewritten(self, text: str, begin: np.ndarray, end: np.ndarray) -> Layer:
        """The layer after the characters from ``begin[i]`` to ``end[i]``, in order and apart, became one character each."""
        gap = np.concatenate((end[:-1] < begin[1:], [end[-1] < len(self.text)])) if len(end) else np.zeros(0, bool)
        kept = np.concatenate(([0], end[gap])).astype(np.int32)
        until = np.concatenate((begin[:1], np.append(begin[1:], len(self.text))[gap])).astype(np.int32)
        some = kept < until
        kept, until = kept[some], until[some]
        if len(kept):  # kept stretches go on by the runs they have here
            where = np.searchsorted(kept, self.at, "right") - 1
            inner = self.at[(where >= 0) & (self.at > kept[where]) & (self.at < until[where])]
            starts = np.union1d(kept, inner).astype(np.int32)
            ends = np.minimum(np.append(starts[1:], len(self.text)), until[np.searchsorted(kept, starts, "right") - 1]).astype(np.int32)
        else:
            starts = ends = kept
        run = np.searchsorted(self.at, starts, "right") - 1
        order = np.argsort(np.concatenate((starts, begin)), kind="stable")
        size = np.concatenate((ends - starts, np.ones(len(begin), np.int32)))[order]
        return Layer(
            text,
            (np.cumsum(size) - size).astype(np.int32),
            np.concatenate((self.firsts(starts), self.firsts(begin)))[order],
            np.concatenate((self.lasts(starts), self.lasts(end - 1)))[order],
            np.concatenate((self.step[run], np.zeros(len(begin), np.int32)))[order].astype(np.int32),
        )


class Unwrapper:
    """The worklist over the layers of one document."""

    def __init__(self, text: str):
        self.spans: set[Span] = set()
        self.layers = 0
        self.long = 0
        self.depth = 0
        self.seen: dict[tuple, None] = {}
        self.opened: dict[tuple, bool] = {}
        self.packed: list[tuple[Pieces, bool, int, int]] = []
        self.work = [Layer.whole(text)]

    def run(self) -> None:
        """Unwrap until no layer is new. A layer seen before at the same place, as in a cycle, is left out."""
        while self.work:
            layer = self.work.pop()
            if self.layers:
                for start, kind, end in scan(layer.text, True):
                    a, b = layer.span(start, end)
                    self.spans.add((a, kind, b))
            self.layers += 1
            if PERCENT.search(layer.text):
                self._rewrite(layer, PERCENT, _percent_characters)
                if ESCAPED_PERCENT.search(layer.text):
                    self._rewrite(layer, PERCENT, _one_level)
                self._url_bytes(layer)
            self._rewrite(layer, ESCAPE, _escape_character)
            for places in _base64_runs(layer.text):
                self._base64(layer, places)
            self._drain()

    def _push(self, layer: Layer) -> None:
        if not layer.text:
            return
        key = (sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), *layer.span(0, len(layer.text)))
        if key not in self.seen:
            self.seen[key] = None
            self.work.append(layer)

    def _rewrite(self, layer: Layer, pattern: re.Pattern, decode: Callable[[re.Match], tuple[str, np.ndarray | None, np.ndarray | None]]) -> None:
        """The layer with every match of ``pattern`` decoded in place; without places a match became one character."""
        out: list[str] = []
        begin, end = array("i"), array("i")
        at = 0
        for m in pattern.finditer(layer.text):
            text, starts, ends = decode(m)
            out += [layer.text[at : m.start()], text]
            if starts is None:
                begin.append(m.start())
                end.append(m.end())
            else:
                begin.frombytes(starts.astype(np.int32).tobytes())
                end.frombytes(ends.astype(np.int32).tobytes())
            at = m.end()
        if at:
            out.append(layer.text[at:])
            self._push(layer.rewritten("".join(out), np.array(begin, np.int32), np.array(end, np.int32)))

    def _url_bytes(self, layer: Layer) -> None:
        """Streams in percent escapes and what is bare between them."""
        for m in URL_BYTES.finditer(layer.text):
            if "%" in m[0] and MAGIC.search(raw := _url_bytes(m[0])):
                starts = array("i", (m.start() + u.start() for u in URL_BYTE.finditer(m[0])))
                for found in MAGIC.finditer(raw):
                    self._packed(raw[found.start() :], *layer.span(starts[found.start()], m.end()))

    def _base64(self, layer: Layer, places: range | np.ndarray) -> None:
        """Streams and printable stretches in a base64 run, read from each of its first four digits."""
        joined = isinstance(places, np.ndarray)
        digits = "".join(map(layer.text.__getitem__, places)) if joined else layer.text[places[0] : places[-1] + 1]
        for shift in range(4):
            raw = _base64_bytes(digits[shift:])
            for found in MAGIC.finditer(raw):
                a, b = layer.span(int(places[shift + found.start() * 8 // 6]), int(places[-1]) + 1)
                if self._packed(raw[found.start() :], a, b) and not shift and not found.start() and raw[:1] not in (b"x", b"B"):
                    return  # text can start as zlib and bzip2 do
            if _is_deflated(raw):
                self._packed(raw, *layer.span(int(places[shift]), int(places[-1]) + 1), bare=True)
            for kept in (raw, raw.replace(b"\x00", b"")) if UTF16.search(raw) else (raw,):
                text = kept.decode("utf-8", "surrogateescape")
                clean = _cleaned(text, BROKEN)
                if not STRETCH.search(clean):
                    continue
                first, size = _bytes_of_characters(text)
                last = first + size - 1
                if kept is not raw:
                    whole = np.flatnonzero(np.frombuffer(raw, np.uint8)).astype(np.int32)
                    first, last = whole[first], whole[last]
                begin, end = shift + first.astype(np.int64) * 8 // 6, shift + (last.astype(np.int64) * 8 + 7) // 6
                begin, end = (places[begin], places[end]) if joined else (begin + places[0], end + places[0])
                zero = np.zeros(len(begin), np.int32)
                self._push(Layer(clean, np.arange(len(begin), dtype=np.int32), layer.firsts(begin), layer.lasts(end), zero))

    def _packed(self, raw: bytes, a: int, b: int, bare: bool = False) -> bool:
        """Whether bytes are a compressed stream, which is then looked into: all in it stands for the span it was packed in."""
        if not bare and not _tool(raw):
            return False
        key = (sha256(raw).digest(), a, b)
        if key not in self.opened:
            self.opened[key] = self._open((raw,), a, b, bare)
        return self.opened[key]

    def _open(self, raw: Iterable[bytes], a: int, b: int, bare: bool = False) -> bool:
        inside = Pieces(lambda: _joined(_expanded(raw, bare)))
        if not next(iter(inside), b""):
            return False
        self.long += inside.kept is None
        self.packed.append((inside, True, a, b))
        return True

    def _look_into(self, pieces: Pieces, raw: bool, a: int, b: int) -> None:
        """Bytes may be a stream again, or text; text is searched, and what it wraps is put on the worklist."""
        digest = sha256()
        for piece in pieces:
            digest.update(piece if raw else piece.encode("utf-8", "surrogatepass"))
        key = (digest.digest(), raw, a, b)
        if key in self.seen:
            return
        self.seen[key] = None
        if raw:
            head = next(iter(pieces), b"")
            if not (_tool(head) and self._open(pieces, a, b)) or head[:1] in (b"x", b"B"):
                self.packed.append((Pieces(lambda: _characters(pieces)), False, a, b))
                if _is_deflated(head):
                    self._open(pieces, a, b, True)
                if any(UTF16.search(piece) for piece in pieces):
                    self.packed.append((Pieces(lambda: _characters(piece.replace(b"\x00", b"") for piece in pieces)), False, a, b))
            return
        self.layers += 1
        kinds, wraps = _kinds_in(pieces)
        self.spans.update((a, kind, b) for kind in kinds)
        for sign, pattern, decode in ((PERCENT, PERCENT, _plain_percent), (ESCAPED_PERCENT, PERCENT, _plain_one_level), (ESCAPE, ESCAPE, _plain_escape)):
            if sign in wraps:
                self.packed.append((Pieces(lambda p=pattern, d=decode: _rewritten(pieces, p, d)), False, a, b))
        if PERCENT in wraps:
            self._runs(pieces, PERCENT, _url_bytes, a, b)
        if BASE64 in wraps:
            for text in (pieces, Pieces(lambda: _without_breaks(pieces))) if BREAK in wraps else (pieces,):
                for shift in range(4):
                    self._runs(text, BASE64, _base64_bytes, a, b, shift)

    def _runs(self, pieces: Pieces, pattern: re.Pattern, decode: Callable[[str], bytes], a: int, b: int, shift: int = 0) -> None:
        """Look into what each run of a text decodes to; a run that is too long to hold is found anew by its number."""
        known = -1
        for number, part, whole in _parts_of_runs(pieces, pattern, shift):
            if number == known:
                continue
            if whole:
                raw = decode(part)
                found = MAGIC.search(raw)
                if not found and (pattern is PERCENT or not (STRETCH.search("".join(_characters([raw]))) or UTF16.search(raw) or _is_deflated(raw))):
                    continue
                starts = sorted({0, *(m.start() for m in MAGIC.finditer(raw))})
                insides = [Pieces(lambda at=at: iter((raw[at:],))) for at in starts]  # noqa: B023
            else:
                known = number
                insides = [Pieces(lambda n=number: _joined(decode(p) for k, p, _ in _parts_of_runs(pieces, pattern, shift) if k == n))]
            waiting, self.packed, size = self.packed, [(inside, True, a, b) for inside in insides], len(self.seen)
            if self.depth > DEEPEST:
                self.packed = waiting + self.packed
                continue
            self.depth += 1
            self._drain()
            self.depth -= 1
            self.packed = waiting
            while len(self.seen) > max(size, MOST_SEEN):
                self.seen.popitem()

    def _drain(self) -> None:
        while self.packed:
            self._look_into(*self.packed.pop())


class Pieces:
    """Pieces of bytes or text that can be gone through again: kept up to MAX_EXPANDED, else made anew each time."""

    def __init__(self, source: Callable[[], Iterator]):
        self.source, self.kept = source, []
        size = 0
        for piece in source():
            size += len(piece)
            if size > MAX_EXPANDED:
                self.kept = None
                return
            self.kept.append(piece)
        del self.source

    def __iter__(self) -> Iterator:
        return self.source() if self.kept is None else iter(self.kept)


def _tool(head: bytes):
    """A decompressor for bytes that start as a stream."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 5 and int.from_bytes(head[:2]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _joined(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Bytes in pieces of PIECE at least, so that the first one tells what they are."""
    out: list[bytes] = []
    size = 0
    for part in parts:
        out.append(part)
        size += len(part)
        if size >= PIECE:
            yield b"".join(out)
            out, size = [], 0
    if size:
        yield b"".join(out)


def _is_deflated(raw: bytes) -> bool:
    """Whether bytes go on like a deflate stream without a head: such have no mark, so they must look packed and their first text have a stretch that could hold a finding."""
    head = raw[:64]
    if len(raw) < 12 or raw[0] & 6 not in (2, 4) or 3 * len(set(head)) < len(head):  # a block of fixed or own Huffman codes
        return False
    try:
        text = zlib.decompressobj(-15).decompress(raw, 256).decode("utf-8", "surrogateescape")
    except zlib.error:
        return False
    broken = sum(len(x) for x in BROKEN.findall(text))
    return bool(STRETCH.search(BROKEN.sub("\ufffd", text))) and 4 * broken <= len(text)


def _expanded(raw: Iterable[bytes], bare: bool = False) -> Iterator[bytes]:
    """What a stream, and those behind it, expand to, in bounded parts; what lies between them is read as it stands.

    A broken stream ends where it breaks; behind a whole one, the search for the next goes on there.
    With ``bare`` the first stream is deflated without a head.
    """
    tool, whole, rest = None, 0, b""
    for piece in raw:
        piece, at = rest + piece, 0
        rest = b""
        while at < len(piece):
            if tool is None:
                found = MAGIC.search(piece, at) if whole else None
                start = at if not whole else min(found.start() if found else len(piece), max(at, len(piece) - 5))
                if start > at:
                    yield b"\x00" + piece[at:start]
                tool = zlib.decompressobj(-15) if bare and not whole else _tool(piece[start : start + 6])
                if tool is None:
                    rest = piece[start:]
                    break
                at = start
                bounded = piece[at : at + 1] != b"\x28"
            begin = at
            data = piece[at:] if bounded else piece[at : at + 64]  # 64 bytes of zstd hold 16 blocks of 128 KiB at most
            at += len(data)
            try:
                while True:
                    out = tool.decompress(data, PIECE) if bounded else tool.decompress(data)
                    if out:
                        yield out
                    if tool.eof:
                        at -= len(tool.unused_data)
                        tool, whole = None, whole + 1
                        break
                    data = getattr(tool, "unconsumed_tail", b"")
                    if not bounded or not data and getattr(tool, "needs_input", len(out) < PIECE):
                        break
            except Exception as error:  # zstandard has an error class of its own
                if not isinstance(error, (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)) and type(error).__name__ != "ZstdError":
                    raise
                if not whole:
                    return
                tool, at = None, begin + 1
    if whole and rest:
        yield b"\x00" + rest


def _characters(raw: Iterable[bytes]) -> Iterator[str]:
    """Bytes as text; what is not UTF-8, and control characters, end a stretch."""
    decoder = getincrementaldecoder("utf-8")("replace")
    for piece in raw:
        yield CONTROLS.sub("\ufffd", decoder.decode(piece))
    yield decoder.decode(b"", True)


def _kinds_in(pieces: Iterable[str]) -> tuple[set[int], set[re.Pattern]]:
    """Kinds of findings in a text, and the patterns of wrapped text that it has."""
    kinds: set[int] = set()
    wraps: set[re.Pattern] = set()
    rest = end = ""
    for piece in pieces:
        rest = SPACES.sub("  ", rest + piece)
        kinds.update(kind for _, kind, _ in scan(rest, True))
        # The next piece goes on from less than a shortest finding, or from the end of a match that reaches over it.
        at = max(len(rest) - 64, 0)
        at = max([at, *(m.end() for m in ASSIGN.finditer(rest) if m.start() < at and m.end() < len(rest))])
        rest = rest[at:]
        end += piece
        wraps.update(pattern for pattern in (PERCENT, ESCAPED_PERCENT, ESCAPE, BASE64, BREAK) if pattern not in wraps and pattern.search(end))
        end = end[-64:]
    return kinds, wraps


def _open_at(text: str, pattern: re.Pattern) -> int:
    """Where an escape begins that the end of the text cuts, or may cut."""
    at = text.rfind("\\" if pattern is ESCAPE else "%")
    return at if at >= 0 and CUT[pattern].fullmatch(text, at) else len(text)


def _rewritten(pieces: Iterable[str], pattern: re.Pattern, decode: Callable[[str], str]) -> Iterator[str]:
    """The text with every match of ``pattern`` decoded in place."""
    rest = ""
    for piece in pieces:
        rest += piece
        cut = _open_at(rest, pattern)
        yield pattern.sub(lambda m: decode(m[0]), rest[:cut])
        rest = MANY_PERCENT.sub("%25", rest[cut:])
    yield pattern.sub(lambda m: decode(m[0]), rest)


def _plain_percent(run: str) -> str:
    return "".join(_characters([_unescaped(run)]))


def _plain_one_level(run: str) -> str:
    return _one_level(PERCENT.match(run))[0]


def _levels(escaped: str) -> int:
    """How many levels of an escape go at once: one, but of long chains all but LONG_CHAIN."""
    return max((len(escaped) - 3) // 2 - LONG_CHAIN, 1)


def _percent_characters(m: re.Match) -> tuple[str, np.ndarray, np.ndarray]:
    """The characters of a run of percent escapes, and where each begins and ends."""
    places, values = array("i"), bytearray()
    for unit in PERCENT_UNIT.finditer(m[0]):
        places.append(unit.start())
        values.append(int(unit[1], 16))
    text = values.decode("utf-8", "surrogateescape")
    starts = np.frombuffer(places, np.int32) + np.int32(m.start())
    first, size = _bytes_of_characters(text)
    ends = np.append(starts[1:], np.int32(m.end()))
    return _cleaned(text, LONE), starts[first], ends[first + size - 1]


def _one_level(m: re.Match) -> tuple[str, np.ndarray, np.ndarray]:
    """A run of percent escapes decoded once; of an escaped percent sign what it escapes is left for the next layer."""
    out = StringIO()
    starts, ends = array("i"), array("i")
    for part in ONCE_ESCAPED.finditer(m[0]):
        at = m.start() + part.start()
        if part[1]:
            size = 1 + 2 * _levels(part[0])
            out.write("%")
            out.write(part[0][size:])
            starts.append(at)
            ends.append(at + size)
        else:
            text = bytes.fromhex(part[0].replace("%", "")).decode("utf-8", "surrogateescape")
            first, size = _bytes_of_characters(text)
            out.write(_cleaned(text, LONE))
            starts.frombytes((at + 3 * first).astype(np.int32).tobytes())
            ends.frombytes((at + 3 * (first + size)).astype(np.int32).tobytes())
    return out.getvalue(), np.frombuffer(starts, np.int32), np.frombuffer(ends, np.int32)


def _escape_character(m: re.Match) -> tuple[str, None, None]:
    code = int(m[1] or m[2] or m[3] or m[4], 16)
    return (chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else "\ufffd"), None, None


def _cleaned(text: str, pattern: re.Pattern) -> str:
    """The text with what BROKEN or LONE finds replaced; long ones without an object for each match."""
    if len(text) < 4096:
        return pattern.sub("\ufffd", text)
    code = np.frombuffer(bytearray(text.encode("utf-32-le", "surrogatepass")), np.uint32)
    bad = (code >= 0xDC80) & (code <= 0xDCFF)
    if pattern is BROKEN:
        bad |= (code < 0x20) & (code != 9) & (code != 10) & (code != 13) | (code == 0x7F)
    code[bad] = 0xFFFD
    return code.tobytes().decode("utf-32-le", "surrogatepass")


def _bytes_of_characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the UTF-8 bytes of each character begin and how many they are; a lone surrogate stands for one byte."""
    if text.isascii():
        return np.arange(len(text), dtype=np.int32), np.ones(len(text), np.int32)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)
    size[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
    return (np.cumsum(size) - size).astype(np.int32), size.astype(np.int32)


def _unescaped(run: str) -> bytes:
    return PERCENT_UNIT.sub(lambda unit: chr(int(unit[1], 16)), run).encode("latin-1")


def _url_bytes(run: str) -> bytes:
    return _unescaped(run.replace("+", " "))


def _without_breaks(pieces: Iterable[str]) -> Iterator[str]:
    rest = ""
    for piece in pieces:
        rest = BREAK.sub("", rest + piece)
        cut = max(len(rest.rstrip()) - 16, 0)
        yield rest[:cut]
        rest = rest[cut:]
    yield rest


def _plain_escape(escape: str) -> str:
    return _escape_character(ESCAPE.match(escape))[0]


def _base64_bytes(run: str) -> bytes:
    body = run.rstrip("=")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body.translate({45: "+", 95: "/"}) + "=" * (-len(body) % 4))


def _parts_of_runs(pieces: Iterable[str], pattern: re.Pattern, shift: int = 0) -> Iterator[tuple[int, str, bool]]:
    """(number, text, whole) of each run; one longer than PIECE comes in parts of whole escapes or of four digits each, the first ``shift`` digits left out."""
    pattern = URL_BYTES if pattern is PERCENT else pattern
    number, rest, going_on = 0, "", False
    for piece in chain(pieces, [None]):
        rest += piece or ""
        hold = len(rest)
        if piece is not None and pattern is BASE64:
            hold = len(rest.rstrip("=").rstrip(DIGITS))
        elif piece is not None:
            hold = _open_at(rest, PERCENT)
            for m in URL_BYTES.finditer(rest):
                hold = m.start() if m.end() >= hold else hold
        at = 0
        if going_on and hold:
            at = REST_OF[pattern].match(rest).end()
            yield number, rest[:at], False
            number, going_on = number + 1, False
        for m in pattern.finditer(rest, at, hold):
            if pattern is BASE64 or "%" in m[0]:
                yield number, m[0][shift:], True
            number += 1
        rest = rest[hold:]
        if len(rest) > PIECE:
            cut = (len(rest) // 4 * 4 - 4 + (0 if going_on else shift)) if pattern is BASE64 else _open_at(rest, PERCENT)
            yield number, rest[0 if going_on or pattern is not BASE64 else shift : cut], False
            going_on, rest = True, MANY_PERCENT.sub("%25", rest[cut:])


def _base64_runs(text: str) -> Iterator[range | np.ndarray]:
    """Places of the characters of each base64 run; lines of one length, and a shorter one after them, are one run."""
    at = 0
    while m := BASE64.search(text, at):
        places, at = range(m.start(), m.end()), m.end()
        if m[0][-1] != "=" and len(m[0]) % 4 == 0:
            lines = [places]
            while (line := NEXT_LINE.match(text, at)) and len(line[1]) <= len(m[0]):
                lines.append(range(line.start(1), line.end(1)))
                at = line.end(1)
                if len(line[1]) < len(m[0]) or line[1][-1] == "=":
                    break
            if len(lines) > 1:
                places = np.concatenate([np.arange(x.start, x.stop, dtype=np.int32) for x in lines])
        yield places


def find_secrets(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base findings of a text, all findings, its number of layers and of streams too long to keep."""
    base = scan(text)
    if not (PERCENT.search(text) or ESCAPE.search(text) or BASE64.search(text)):
        return base, base, 1, 0
    work = Unwrapper(text)
    work.run()
    return base, sorted(work.spans.union(base)), work.layers, work.long


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping findings replaced by ``[SECRET]``."""
    out, at = [], 0
    stretches: list[list[int]] = []
    for start, _, end in spans:
        if stretches and start <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], end)
        else:
            stretches.append([start, end])
    for start, end in stretches:
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


def secret_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every whole text: a row for each row of ``docs``.

    n_assign, n_access, n_hex and base_sha256 describe the findings in the text
    as it stands; ``spans`` adds those that decoding brings to light, mapped to
    the characters of the document they came from. A worklist unwraps percent
    escapes, level by level, and Unicode escapes in place, base64 runs of UTF-8
    or UTF-16 text, and gzip, zlib, bare deflate, bzip2, xz and zstd streams in
    base64, or with a head in percent escapes, and looks into each new layer
    again until none is new; a layer already seen at its place is dropped, so
    cycles end. Where characters came from is kept as runs, which cost nothing
    where a text is copied unchanged. ``layers`` counts them, the text included.
    Streams are expanded and searched whole: one of more than MAX_EXPANDED, which
    ``long_streams`` counts, in pieces whose ends are carried over, so that
    memory is bounded and time grows with what it expands to.

    Null and empty texts have no findings and the hash of the empty string.
    Ids may be null or repeat; rows are independent and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers", "long_streams"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, full, layers, long_streams = find_secrets(text.as_py() or "")
                digest = sha256(joined(base).encode()).hexdigest()
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), digest, joined(full), layers, long_streams))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, layers bigint, long_streams bigint"
    return source.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with the findings of each text replaced, all its rows and columns kept; null texts stay null."""
    schema = T.StructType(docs.schema.fields)
    places = docs.columns
    at = places.index(text_col)
    counted = places.index(chars_col) if chars_col in places else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed: dict[int, str] = {}
            for row, text in enumerate(batch.column(at)):
                if text.is_valid and (spans := find_secrets(text.as_py())[1]):
                    changed[row] = redacted(text.as_py(), spans)
            columns = list(batch.columns)
            if changed:
                texts = [changed.get(row, text) for row, text in enumerate(batch.column(at).to_pylist())]
                columns[at] = pa.array(texts, columns[at].type)
                if counted is not None:
                    chars = columns[counted].to_pylist()
                    for row, text in changed.items():
                        chars[row] = len(text)
                    columns[counted] = pa.array(chars, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
