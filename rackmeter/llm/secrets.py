"""Secrets in whole texts, also behind layers of encoding.

Every text is a first layer. A work list unwraps a layer further: percent escapes and Unicode escapes are
replaced in place (the new layer keeps the words around them), base64 runs and the compressed data
in them become layers of their own. Each new layer is scanned like the first and put on the list, until no
layer yields another; a layer that was seen before at the same place is not taken again, which ends cycles.
Every layer carries a map back to the original text, so spans are places in the original: for
replaced escapes the characters themselves, for base64 and compressed data the whole run, or those of its
lines that hold the secret. Compressed data of any size is unfolded in chunks and scanned in portions.
"""

from __future__ import annotations

import base64
import bisect
import codecs
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackmeter.llm.common import lean, on_workers, text_column

# Patterns and least lengths of the base kinds, in the order in which they are listed.
KINDS = ["assign", "access", "hex"]
_NAMES = ["password", "passwd", "secret", "token", "api_?key"]
_ANY_CASE = "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", name) for name in _NAMES)
ASSIGN = re.compile(f"""({_ANY_CASE})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
ASSIGN_LENGTH = 12

PERCENT = re.compile("(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
UNICODE_ONE = re.compile(r"\\[uUx]([0-9A-Fa-f]+)")
RUN = 16
_SET = "[A-Za-z0-9+/_-]"
LINE = re.compile(f"{_SET}+")
BASE64 = re.compile(
    f"(?<!{_SET})(?:{_SET}{{{RUN},}}|{_SET}+(?=\r?\n[ \t]*{_SET}))(?:\r?\n[ \t]*{_SET}+)*={{0,2}}"
)
# Places that no match can cross, nor one in what escapes are replaced by: characters of no pattern, empty lines,
# and single spaces after letters that end no escape.
LAST_CUT = re.compile(r"""(?s).*(?:[^A-Za-z0-9+/_.=%\\"':\s-]|\n\r?\n|[g-zG-Z]\x20(?=[A-Za-z]))""")
GOES_ON = re.compile(f"(?:{_SET}|\r?\n[ \t]*(?={_SET}))*")
BLANKS = re.compile(" {512,}")
OVERLAP = 512
LONG = 1 << 21
CHUNK = 1 << 18
PORTION = 1 << 20

Source = Callable[[], Iterator[bytes]]
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the base kinds, leftmost and without overlap within a kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A decoded text and the way back: pieces of (first place here, first and last place in the original).

    Places within a linear piece move along with the original; all others stand for the whole piece.
    """

    def __init__(self, text: str, pieces: list[tuple[int, int, int, bool]]):
        self.text, self.pieces = text, pieces
        self.starts = [p[0] for p in pieces]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        first = self.pieces[bisect.bisect_right(self.starts, start) - 1]
        last = self.pieces[bisect.bisect_right(self.starts, end - 1) - 1]
        return (
            first[1] + (start - first[0]) * first[3],
            last[1] + (end - last[0]) if last[3] else last[2],
        )


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all matches decoded in place; ``decode`` yields (characters, length of their source)."""
    out, pieces, at, size = [], [], 0, 0

    def keep(end: int) -> None:
        nonlocal at, size
        while at < end:  # piece by piece of the layer below
            k = bisect.bisect_right(layer.starts, at) - 1
            below = layer.pieces[k]
            stop = min(end, layer.starts[k + 1] if k + 1 < len(layer.starts) else end)
            pieces.append((size, *layer.origin(at, stop), below[3]))
            out.append(layer.text[at:stop])
            size += stop - at
            at = stop

    for match in pattern.finditer(layer.text):
        keep(match.start())
        for text, length in decode(match[0]):
            if text:
                pieces.append((size, *layer.origin(at, at + length), False))
                out.append(text)
                size += len(text)
            at += length
    if not at:
        return None
    keep(len(layer.text))
    return Layer("".join(out), pieces)


def _percent(run: str) -> Iterator[tuple[str, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    at = 0
    while at < len(raw):
        lead = raw[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            text = raw[at : at + width].decode()
        except UnicodeDecodeError:
            text, width = "�", 1
        yield text, 3 * width
        at += width


def _unicode(run: str) -> Iterator[tuple[str, int]]:
    units = [(int(m[1], 16), len(m[0])) for m in UNICODE_ONE.finditer(run)]
    k = 0
    while k < len(units):
        code, length = units[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            code = 0x10000 + ((code - 0xD800) << 10) + (units[k + 1][0] - 0xDC00)
            length += units[k + 1][1]
            k += 1
        yield ("�" if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code)), length
        k += 1


def _packed(raw: bytes) -> bool:
    """Whether data begins like a gzip or zlib stream."""
    return raw[:2] == b"\x1f\x8b" or len(raw) > 1 and raw[0] & 15 == 8 and not (raw[0] << 8 | raw[1]) % 31


class Inflated:
    """Decompressed data of all members of gzip or zlib streams, in chunks of bounded size.

    After a pass, ``used`` is the number of source bytes that belong to the members, and ``whole`` tells whether
    they ended without an error.
    """

    def __init__(self, source: Source):
        self.source, self.used, self.whole = source, 0, False

    def __iter__(self) -> Iterator[bytes]:
        self.used, self.whole, read, held = 0, False, 0, b""
        member, members = None, 0
        for part in self.source():
            read, held, out = read + len(part), held + part, b""
            while held or len(out) == CHUNK:
                if member is None:
                    held = held.lstrip(b"\0") if members else held
                    if len(held) < 2:
                        break
                    if not _packed(held):
                        self.whole = True
                        return
                    member = zlib.decompressobj(zlib.MAX_WBITS | 32)
                try:
                    out = member.decompress(held, CHUNK)
                except zlib.error:
                    return
                held = member.unused_data if member.eof else member.unconsumed_tail
                self.used = read - len(held)
                if member.eof:
                    member, members = None, members + 1
                if out:
                    yield out
        if member is not None and (out := member.flush()):
            yield out
        self.whole = member is None and members > 0


def _head(source: Source) -> bytes:
    head = b""
    for part in source():
        head += part
        if len(head) > 1:
            break
    return head


def _unfolded(source: Source, seen: frozenset[bytes] = frozenset()) -> Iterator[str]:
    """Text of compressed data, also of several layers; data that unfolds to itself ends."""
    inflated, digest, size = Inflated(source), hashlib.blake2b(digest_size=16), 0
    for part in inflated:
        digest.update(part)
        size += len(part)
    if size and digest.digest() not in seen:
        yield from _texts(lambda: iter(Inflated(source)), seen | {digest.digest()})
    if not inflated.whole:
        yield from _portions(source, seen)


def _texts(source: Source, seen: frozenset[bytes] = frozenset()) -> Iterator[str]:
    return _unfolded(source, seen) if _packed(_head(source)) else _portions(source, seen)


def _portions(source: Source, seen: frozenset[bytes] = frozenset()) -> Iterator[str]:
    """Decoded text in portions that end where no match, escape or run can go on.

    Where there is no such place for ``LONG`` characters, a portion ends anywhere and the next one repeats its last
    ``OVERLAP`` characters, in step with base64: any part of a match that is long enough is a match as well, and all
    matches of a layer stand for the same place in the text. Compressed data that goes on beyond the
    portion it begins in is unpacked from there by another pass over the source.
    """
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    held, size, least, read, fresh = [], 0, PORTION, 0, 0
    for part in source():
        held.append(decoder.decode(part))
        size += len(held[-1])
        read += len(held[-1])
        if size < least:
            continue
        text = "".join(held)
        cut = LAST_CUT.match(text)
        at = cut.end() if cut else 0
        if at:
            yield text[:at]
            fresh = 0
        elif size >= LONG:
            text = BLANKS.sub(" " * OVERLAP, text)  # blanks alone would fill portions
            if len(text) >= PORTION:
                yield text
                at, begins = _step(text, fresh)
                for start in begins:
                    yield from _texts(_run_from(source, read - len(text) + start), seen)
                fresh = len(text) - at
        held, size = [text[at:]], len(text) - at
        least = max(PORTION, min(2 * size, LONG))
    held.append(decoder.decode(b"", True))
    if text := "".join(held):
        yield text


def _step(text: str, fresh: int) -> tuple[int, list[int]]:
    """Where the next portion starts, and the places where compressed data begins that goes on.

    Lines that begin within the first ``fresh`` characters were in the portion before as well.
    """
    at, begins = len(text) - OVERLAP, []
    run = None
    for run in BASE64.finditer(text):
        pass
    if run is None or run.end() < len(text):
        return at, begins
    lines = list(LINE.finditer(text, run.start(), run.end()))
    for line in lines:
        if line.start() >= fresh and _packed(_decode(text[line.start() : line.start() + 4])):
            begins.append(line.start())
    before = sum(max(0, min(line.end(), at) - line.start()) for line in lines)
    while at > run.start() and before % 4:
        at -= 1
        before -= text[at] not in "\r\n \t"
    return at, begins


def _run_from(source: Source, start: int) -> Source:
    """Source of the data of the base64 run that goes on from a place of the text, over line breaks, to its end."""

    def chunks() -> Iterator[bytes]:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        skip, held, run = start, "", ""
        for part in source():
            held += decoder.decode(part)
            if skip:
                gone = min(skip, len(held))
                held, skip = held[gone:], skip - gone
                if skip:
                    continue
            match = GOES_ON.match(held)
            run += "".join(LINE.findall(match[0]))
            rest = held[match.end() :]
            whole = len(run) // 4 * 4
            if whole:
                yield _decode(run[:whole])
                run = run[whole:]
            if rest.strip("\r\n \t") or len(rest) > OVERLAP:  # more than an open line break: the run has ended
                break
            held = rest
        if run:
            yield _decode(run)

    return chunks


def _decode(run: str) -> bytes:
    """Data of base64 characters; a last character that completes no byte is left out."""
    body = run.replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _decoded_from(run: str, start: int) -> Source:
    """Source of the data of base64 characters from a place on."""
    return lambda: (_decode(run[at : at + CHUNK]) for at in range(start, len(run), CHUNK))


def _base64(layer: Layer, match: re.Match) -> Iterator[Layer]:
    """Layers of a base64 run: of each of its lines, and of the lines joined.

    A line break may also part a run from a word, so data may begin with any line: compressed data is looked for
    at each, and other data is decoded at each remainder by 4 that a line begins with.
    """
    lines = list(LINE.finditer(layer.text, *match.span()))
    spans = [m.span() for m in lines]
    spans[-1] = spans[-1][0], match.end()
    for (start, end), line in zip(spans, lines):
        if len(line[0]) >= RUN:
            origin = layer.origin(start, end)
            for text in _texts(_decoded_from(line[0], 0)):
                yield Layer(text, [(0, *origin, False)])
    if len(lines) == 1:
        return
    run = "".join([m[0] for m in lines])
    if len(run) < RUN:
        return
    offsets = list(itertools.accumulate([len(m[0]) for m in lines], initial=0))
    for phase in sorted({o % 4 for o in offsets[:-1]}):
        yield _joined(layer, _decode(run[phase:]), [max(0, o - phase) for o in offsets], spans)
    for k, offset in enumerate(offsets[:-1]):
        if _packed(_decode(run[offset : offset + 4])):
            inflated = Inflated(_decoded_from(run, offset))
            if not sum(map(len, inflated)):
                continue
            last = bisect.bisect_left(offsets, offset + -(-4 * inflated.used // 3)) - 1
            origin = layer.origin(spans[k][0], spans[max(k, min(last, len(spans) - 1))][1])
            for text in _texts(lambda inflated=inflated: iter(inflated)):
                yield Layer(text, [(0, *origin, False)])


def _joined(layer: Layer, raw: bytes, offsets: list[int], spans: list[tuple[int, int]]) -> Layer:
    """Text of data of joined lines; a character stands for its line, or the two lines that share its bits."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    out, pieces, at, size = [], [], 0, 0

    def take(end: int, first: int, last: int) -> None:
        nonlocal at, size
        if end > at:
            text = decoder.decode(raw[at:end])
            if text:
                pieces.append((size, *layer.origin(spans[first][0], spans[last][1]), False))
                out.append(text)
                size += len(text)
            at = end

    for k, end in enumerate(offsets[1:]):
        take(min(len(raw), 3 * end // 4), k, k)
        if k + 1 < len(spans):
            take(min(len(raw), -(-3 * end // 4)), k, k + 1)
    if text := decoder.decode(b"", True):
        pieces.append((size, *layer.origin(*spans[-1]), False))
        out.append(text)
    return Layer("".join(out), pieces)


def _unwrap(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text and (found := _replaced(layer, PERCENT, _percent)):
        yield found
    if "\\" in text and (found := _replaced(layer, UNICODE, _unicode)):
        yield found
    for match in BASE64.finditer(text):
        if match.end() - match.start() >= RUN:
            yield from _base64(layer, match)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans of a text, and all spans: those and what decoded layers add."""
    base = base_spans(text)
    found = set(base)
    # Each layer is taken as far as it goes before the next portion is unfolded.
    seen, work = set(), [iter([Layer(text, [(0, 0, len(text), True)])])] if len(text) >= RUN else []
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if len(layer.text) < RUN:  # shorter than any secret
            continue
        digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        key = (digest, *layer.origin(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        for kind, start, end in base_spans(layer.text):
            found.add((kind, *layer.origin(start, end)))
        work.append(_unwrap(layer))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(found, key=order)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span, or run of overlapping ones, replaced by a mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _written(spans: list[Span]) -> str:
    return ",".join([f"{kind}:{start}:{end}" for kind, start, end in spans])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets per document: counts of the base kinds, hash of the base spans, all spans.

    Null and empty texts have no spans (empty strings). Repeated rows give repeated rows; other columns
    are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for value in text_column(batch, "text"):
                base, found = scan(value.as_py())
                counts.append([sum([s[0] == kind for s in base]) for kind in KINDS])
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(found))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            columns += [pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return on_workers(docs).select(F.col(key), F.col(text).alias("text")).mapInArrow(lean(find), schema)


def redacted(text: Column | str, mark: str = "[SECRET]") -> Column:
    """A text column without its secrets; null stays null. Call ``on_workers`` on the frame first."""

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        out = []
        for value in column.to_pylist():
            spans = scan(value)[1] if value else []
            out.append(redact(value, spans, mark) if spans else value)
        return pa.array(out, pa.string())

    return clean(text)
