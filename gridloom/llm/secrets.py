"""Secret scans with a recursive decoding worklist.

A text is the first layer.  Every layer is scanned for secrets; then its encoded
segments (percent escapes, Unicode and character escapes, base64, and compressed
bytes inside those) are decoded, each to a layer of its own that joins the worklist.
The worklist ends when nothing new comes out: a layer seen before, by its digest, is
not worked on again, so cycles end.  Every layer carries the place of each of its
characters in the text, exact for escapes and the whole segment for base64, so a
secret at any depth maps to a span of the text.

A base64 segment is a run of its letters, or a block of runs over consecutive lines
(line breaks may be written ``\\n``, and lines be quoted or indented).  Each is decoded
at all four offsets, since it may be glued to a path or a name, and compressed bytes
are looked for after every character that a path or name can end with.  Decoded bytes
are read whatever else they hold, and once more without zero bytes (UTF-16, UTF-32).
A block has 16 letters or more, in lines of any length.

Bytes may also be written as escapes, ``%1F%8B..`` or ``\\x1f\\x8b..`` with what needs none between them: where
such a run holds the first bytes of a compression, it is read as bytes from there.

Compressed bytes are inflated as a stream, all members of it and compression inside
compression too, and read in windows of ``WINDOW`` bytes that overlap by ``OVERLAP``, one
at a time: memory does not grow with what a segment inflates to, and nothing of it is left
out.  Only a single match or segment longer than the overlap, in a layer longer than a
window, may be seen in parts.  Escapes of either form are decoded one level for a layer of its own; where what comes
out holds escapes again, of whatever forms and however deep, all of them are resolved in one pass from left to
right for one more layer, so the work stays linear in the text.

Defined results: a null or empty text has no spans; an added span equal to, or
within, a base span of its kind is left out; very long texts are scanned whole; equal finds
at one place are listed once; repeated rows are scanned one by one; an empty table gives no
rows.  ``redact`` returns all columns as they were but the text and n_chars, whatever their
names.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import RESULT, annotate, sheltered, texts

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
#: Bytes of an inflated layer that are read at once, and by which such windows overlap.
WINDOW, OVERLAP = 8 << 20, 1 << 20

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ of 24 and more
_HEX_TABLE = bytes(0x68 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_B64_TABLE = bytes(0x62 if re.match(r"[A-Za-z0-9+/_-]", chr(c)) else 0x20 for c in range(256))
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

# %25 is an escaped %, and the like: what escapes an escape is passed over at once
_PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_LAST_BYTE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_UNICODE = re.compile(
    r"\\(?:u005[cC]|x5[cC])*(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))"
    r"|&(?:#38;|#x26;)*(?:#x([0-9A-Fa-f]{1,6});|#([0-9]{1,7});)"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# a whole run, then more runs on the lines that follow; possessive, so that long runs are read once
_BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t>#*]*+[A-Za-z0-9+/_-]++)++={0,2}")
# what every block of lines under 16 letters holds
_LINES = re.compile(rb"[A-Za-z0-9+/_-][ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t>#*]*+[A-Za-z0-9+/_-]")
_RUN = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/_\\-]))[A-Za-z0-9+/_-]+")
_GLUE = re.compile(r"[+/_-]")
_MAGIC = (b"\x1f\x8b", *(bytes([0x78, x]) for x in range(256) if (0x7800 | x) % 31 == 0), b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
#: An escape at the end of what is written, in any form; the longest has _MOST characters, and all end in one of _LAST.
_ESCAPE_AT_END = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))|&(?:#x([0-9A-Fa-f]{1,6});|#([0-9]{1,7});))\Z")
_ESCAPE_BEGIN = re.compile(r"[%\\&]")
_MOST, _LAST = 10, frozenset("0123456789abcdefABCDEF};")


def _spelled(head: tuple[tuple[int, ...], ...], escape: str, plain: str) -> str:
    """An expression for bytes (each one of some) as escapes, or as themselves where they may be."""
    of = lambda x: "|".join([escape.replace("HH", "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in f"{x:02x}")), *([re.escape(chr(x))] if re.fullmatch(plain, chr(x)) else [])])
    return "".join(f"(?:{'|'.join(map(of, byte))})" for byte in head)


#: First bytes of what may be inflated.
_HEADS = (((0x1F,), (0x8B,)), ((0x78,), (0x01, 0x5E, 0x9C, 0xDA)), tuple((x,) for x in b"BZh"), tuple((x,) for x in b"\xfd7zXZ"), tuple((x,) for x in b"\x28\xb5\x2f\xfd"))
#: Two ways to write bytes: percent escapes, and escapes of program texts; the plain characters of each.
_FORMS = (("%(?:25)*HH", r"[!-$&-~]", r"%(?:25)*+([0-9A-Fa-f]{2})|()(?!)"), (r"\\(?:x|u00)HH", r"[ -\[\]-~]", r"\\(?:(?:x|u00)([0-9A-Fa-f]{2})|([^xu]))"))
#: Each with an expression for the first bytes, for a whole stretch, for one escape, and for one byte.
_SPELLED_BYTES = tuple(
    (re.compile("|".join(_spelled(h, escape, plain) for h in _HEADS)), re.compile(f"(?s:{token}|{plain})*+"), re.compile(f"(?s:{token})"), re.compile(f"(?s:{token}|{plain})")) for escape, plain, token in _FORMS
)
_SHORT = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "0": "\0"}
_ESCAPED_BYTES = re.compile(rb"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#")
_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start and kind."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.translate(_LOWER)
    out = []
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_HEX_TABLE):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


class Layer:
    """A decoded text, and where each of its characters stands in the document."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None, whole: tuple[int, int] | None = None, chain: str = ""):
        self.text, self.starts, self.ends, self.whole, self.chain = text, starts, ends, whole, chain

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The document's span for characters a to b of this layer."""
        if self.whole:
            return self.whole
        return (self.starts[a], self.ends[b - 1]) if self.starts is not None else (a, b)


def unescaped(layer: Layer, form: str) -> Layer | None:
    """The layer with all its percent escapes, or all its character escapes, decoded; None if there are none."""
    text, out, starts, ends, at = layer.text, [], [], [], 0

    def add(piece: str, a: int, b: int, each: bool) -> None:
        out.append(piece)
        if not layer.whole:
            if each:
                spans = [layer.span(i, i + 1) for i in range(a, b)]
                starts.extend(s for s, _ in spans)
                ends.extend(e for _, e in spans)
            else:
                s, e = layer.span(a, b)
                starts.extend([s] * len(piece))
                ends.extend([e] * len(piece))

    for m in (_PERCENT if form == "url" else _UNICODE).finditer(text):
        if form == "url":
            raw = bytes.fromhex("".join(_LAST_BYTE.findall(m.group())))
            piece = raw.decode("utf-8", "replace") if len(raw) > 1 else raw.decode("latin-1")
        else:
            code = int(m[6]) if m[6] else int(next(x for x in m.groups() if x), 16)
            if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
                continue
            piece = chr(code)
        add(text[at : m.start()], at, m.start(), True)
        add(piece, m.start(), m.end(), False)
        at = m.end()
    if not at:
        return None
    add(text[at:], at, len(text), True)
    chain = f"{layer.chain}>{form}"
    return Layer("".join(out), None, None, layer.whole, chain) if layer.whole else Layer("".join(out), starts, ends, None, chain)


def resolved(layer: Layer) -> Layer:
    """The layer with all escapes of both forms decoded until none is left, in one pass.

    What is written so far is looked at from its end: as soon as it ends in an escape, that becomes the character that it
    stands for, which may end another.  A character is written once and every escape takes some away, so the work is linear.
    """
    text, out, at = layer.text, [], 0
    starts: list[int] = []
    ends: list[int] = []

    def add(unit: str | int, s: int, e: int) -> None:
        out.append(unit)
        starts.append(s)
        ends.append(e)

    def reduce() -> None:
        while out and isinstance(out[-1], str) and out[-1] in _LAST:
            tail = "".join(x if isinstance(x, str) else "\0" for x in out[-_MOST:])
            if not (m := _ESCAPE_AT_END.search(tail)):
                return
            code = int(m[7]) if m[7] else int(next(x for x in m.groups() if x), 16)
            if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
                return
            k = len(out) - (m.end() - m.start())
            s, e = starts[k], ends[-1]
            del out[k:], starts[k:], ends[k:]
            # a byte of UTF-8 stays one until its neighbours are known
            add(code if m[1] and code >= 0x80 else chr(code), s, e)

    while at < len(text):
        m = _ESCAPE_BEGIN.search(text, at)
        stop = m.start() if m else len(text)
        # characters that may still complete an escape come one by one, the rest of a stretch at once
        while at < stop and any(x in "%\\&" for x in out[-_MOST:] if isinstance(x, str)):
            add(text[at], *layer.span(at, at + 1))
            reduce()
            at += 1
        for i in range(at, stop):
            add(text[i], *layer.span(i, i + 1))
        if m:
            add(text[stop], *layer.span(stop, stop + 1))
            reduce()
        at = stop + 1
    pieces, first, last, i = [], [], [], 0
    while i < len(out):
        j = i + 1
        if isinstance(out[i], int):
            while j < len(out) and isinstance(out[j], int):
                j += 1
            raw = bytes(out[i:j])
            piece = raw.decode("utf-8", "replace") if len(raw) > 1 else raw.decode("latin-1")
            first += [starts[i]] * len(piece)
            last += [ends[j - 1]] * len(piece)
        else:
            piece = out[i]
            first.append(starts[i])
            last.append(ends[i])
        pieces.append(piece)
        i = j
    chain = f"{layer.chain}>escapes"
    return Layer("".join(pieces), None, None, layer.whole, chain) if layer.whole else Layer("".join(pieces), first, last, None, chain)


def escaped_bytes(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Stretches that spell the beginning of compressed bytes by escapes: start, end, and the bytes from there to the stretch's end."""
    for magic, run, token, unit in _SPELLED_BYTES:
        done = 0
        for m in magic.finditer(text):
            if m.start() < done:
                continue
            # a few bytes tell most stretches that only look so; the others are read to their end
            head = _plain_bytes(text[m.start() : run.match(text, m.start(), m.start() + 600).end()], token)
            kind = compression(head)
            if not kind or kind in ("zlib", "zstd") and next(inflated(kind, iter((head,)), 64), None) is None:
                continue
            raw = _plain_bytes(text[m.start() : run.match(text, m.start()).end()], token)
            # what follows the compressed bytes is text again
            raw = raw[: spent(kind, raw)]
            done = next(itertools.islice(unit.finditer(text, m.start()), len(raw) - 1, None)).end()
            yield m.start(), done, raw


def _plain_bytes(run: str, token: re.Pattern) -> bytes:
    """The bytes of a run of escapes and plain characters."""
    return token.sub(lambda m: chr(int(m[1], 16)) if m[1] else _SHORT.get(m[2], m[2]), run).encode("latin-1", "replace")


def compression(head: bytes) -> str:
    """The name of the compression that bytes begin like, or nothing."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 1 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    return "bzip2" if head[:3] == b"BZh" else "xz" if head[:6] == b"\xfd7zXZ\x00" else "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else ""


def spent(kind: str, raw: bytes) -> int:
    """How many of the bytes belong to the compressed members that they begin with; all, where the last one is broken."""
    left: list[int] = []
    for _ in inflated(kind, iter((raw,)), 1 << 20, left):
        pass
    return len(raw) - sum(left)


def inflated(kind: str, source: Iterator[bytes], step: int, left: list[int] | None = None) -> Iterator[bytes]:
    """What compressed bytes hold, all members one after the other, in pieces of up to ``step`` bytes; ends where they are broken.

    ``left`` gets the number of bytes that were read and follow the last member, if any do.
    """
    member, data = None, b""
    try:
        while True:
            if not data and not (data := next(source, b"")):
                return
            if member is None:
                data += b"" if len(data) > 6 else next(source, b"")
                if compression(data) != kind:
                    # what follows the last member
                    if left is not None:
                        left.append(len(data))
                    return
                member = {"zlib": lambda: zlib.decompressobj(zlib.MAX_WBITS | 32), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor, "zstd": lambda: zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()}[kind]()
            if kind == "zlib":
                out = member.decompress(data, step)
                data = member.unused_data if member.eof else member.unconsumed_tail
                done = member.eof
            elif kind == "zstd":
                # this library has no bound on a call's output: small bites keep it small
                bite, rest = data[:1024], data[1024:]
                out, done = member.decompress(bite), member.eof
                data = (member.unused_data if done else b"") + rest
            else:
                out, done = member.decompress(data, step), member.eof
                while out and not done and not member.needs_input:
                    yield out
                    out, done = member.decompress(b"", step), member.eof
                data = member.unused_data if done else b""
            if out:
                yield out
            if done:
                member = None
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return


def windows(source: Iterator[bytes], size: int, overlap: int) -> Iterator[bytes]:
    """The bytes in stretches of up to ``size`` new bytes, each after the first preceded by the end of the one before."""
    held, new = bytearray(), 0
    for piece in source:
        held += piece
        new += len(piece)
        if new >= size:
            yield bytes(held)
            held, new = held[-overlap:], 0
    if new:
        yield bytes(held)


def readings(raw: bytes) -> list[str]:
    """The bytes as texts, as they are and without zero bytes; only those that can hold a secret or a further segment."""
    out = []
    for x in (raw, raw.replace(b"\0", b"")) if b"\0" in raw else (raw,):
        low = x.translate(_LOWER)
        if any(w in low for w in _WORDS) or b"AKIA" in x or b"h" * 24 in x.translate(_HEX_TABLE) or b"b" * 16 in x.translate(_B64_TABLE) or _ESCAPED_BYTES.search(x) or _LINES.search(x):
            out.append(x.decode("utf-8", "replace"))
    return out


def unwrapped(raw: bytes, size: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[str, str]]:
    """Texts inside compressed bytes, window by window, and the names of the compressions around them; none if they are not compressed."""
    source, chain, seen = iter((raw,)), "", set()
    while True:
        head = next(source, b"")
        while len(head) < 64 and (more := next(source, b"")):
            head += more
        source = itertools.chain((head,), source)
        key = hashlib.blake2b(head).digest()
        # compressed bytes that hold themselves end here
        if not head or key in seen:
            return
        if not (kind := compression(head)):
            break
        seen.add(key)
        source, chain = inflated(kind, source, size), chain + ">inflate"
    if chain:
        for part in windows(source, size, min(overlap, size)):
            yield from ((text, chain) for text in readings(part))


def decoded(run: str, size: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[str, str]]:
    """What a run of base64 holds, at each offset, as texts and chains."""
    body = run.rstrip("=")
    starts: list[list[int]] = [[0], [], [], []]
    for m in _GLUE.finditer(body):
        starts[m.end() % 4].append(m.end() // 4 * 3)
    body = body.replace("-", "+").replace("_", "/")
    for k in range(4):
        part = body[k : len(body) - 1 if (len(body) - k) % 4 == 1 else len(body)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        yield from ((text, "") for text in readings(raw))
        for at in starts[k]:
            if raw.startswith(_MAGIC, at):
                yield from unwrapped(raw[at:], size, overlap)


def segments(text: str) -> list[tuple[int, int, str]]:
    """Start, end and letters of the base64 runs, and of the blocks over several lines."""
    out = [(m.start(), m.end(), m.group()) for m in _BASE64.finditer(text)]
    for m in _BLOCK.finditer(text) if "\n" in text or "\\n" in text else ():
        runs = [(x.start(), x.end(), x.group()) for x in _RUN.finditer(text, m.start(), m.end())]
        # all lines, and all but the last, which may begin other text
        ranges = {(0, len(runs)), (0, len(runs) - 1)}
        i = 0
        while i < len(runs):
            # lines of one width, with and without a shorter last one
            j = i + 1
            while j < len(runs) and len(runs[j][2]) == len(runs[i][2]):
                j += 1
            ranges |= {(i, j), (i, j + 1)} if j < len(runs) and len(runs[j][2]) < len(runs[i][2]) else {(i, j)}
            i = j
        for i, j in sorted(ranges):
            if j - i > 1 and sum(len(x[2]) for x in runs[i:j]) >= 16:
                out.append((runs[i][0], runs[j - 1][1], "".join(x[2] for x in runs[i:j])))
    return out


def scan_text(text: str, size: int = WINDOW, overlap: int = OVERLAP) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """Base spans, and spans of secrets in deeper layers with the decodings that led to them."""
    base = base_spans(text)
    raw = text.encode("utf-8", "surrogatepass")
    if b"b" * 16 not in raw.translate(_B64_TABLE) and not _ESCAPED.search(text) and not segments(text):
        return base, []
    added: dict[tuple[str, int, int], str] = {}
    # the worklist holds what a layer's segments decode to, made one layer at a time; the last one's go first
    work, seen = [fresh_layers(Layer(text), size, overlap)], {_key(text)}
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        # a layer's own text decides, with its place: the same blob elsewhere is another find
        key = _key(layer.text, layer.whole)
        if key in seen:
            continue
        seen.add(key)
        for kind, a, b in base_spans(layer.text):
            added.setdefault((kind, *layer.span(a, b)), layer.chain[1:])
        work.append(fresh_layers(layer, size, overlap))
    held: dict[str, list[tuple[int, int]]] = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    out = [(k, a, b, chain) for (k, a, b), chain in added.items() if not _within(held.get(k, []), a, b)]
    return base, sorted(out, key=_order)


def fresh_layers(layer: Layer, size: int, overlap: int) -> Iterator[Layer]:
    """The layers that one step of decoding makes of a layer."""
    if not layer.chain.endswith((">url", ">unicode", ">escapes")):
        deeper = False
        for form in ("url", "unicode"):
            if x := unescaped(layer, form):
                deeper = deeper or bool(_ESCAPED.search(x.text))
                yield x
        if deeper:
            yield resolved(layer)
    for a, b, raw in escaped_bytes(layer.text) if _ESCAPED.search(layer.text) else ():
        whole = layer.span(a, b)
        for text, chain in unwrapped(raw, size, overlap):
            yield Layer(text, whole=whole, chain=f"{layer.chain}>bytes{chain}")
    for a, b, run in segments(layer.text):
        whole = layer.span(a, b)
        for text, chain in decoded(run, size, overlap):
            yield Layer(text, whole=whole, chain=f"{layer.chain}>base64{chain}")


def _key(text: str, whole: tuple[int, int] | None = None) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, salt=b"%d" % (whole[0] if whole else 0)).digest()


def _order(x: tuple) -> tuple:
    return (x[1], KINDS.index(x[0]), x[2])


def _within(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Does one of the spans, disjoint and in order, hold a to b?"""
    from bisect import bisect_right

    i = bisect_right(spans, (a, float("inf"))) - 1
    return i >= 0 and spans[i][1] >= b


_FIELDS = (
    "n_assign long, n_access long, n_hex long, base string, spans string, "
    "added array<struct<kind:string,start:long,end:long,chain:string>>, redacted string"
)


def scan(docs: DataFrame, keep: list[str], text: str = "text", redact: bool = False) -> DataFrame:
    """The columns ``keep`` and RESULT: counts, spans, and with ``redact`` the text with every span replaced."""

    def start():
        join = lambda spans: ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)

        def work(column):
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "spans", "added", "redacted")}
            for x in texts(column):
                base, added = scan_text(x)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                every = sorted([*base, *added], key=_order)
                out["base"].append(join(base))
                out["spans"].append(join(every))
                out["added"].append([{"kind": k, "start": a, "end": b, "chain": c} for k, a, b, c in added])
                out["redacted"].append(redacted(x, every) if redact and every else None)
            return out

        return work

    return annotate(docs, start, _FIELDS, [text], keep)


def redacted(text: str, spans: list[tuple]) -> str:
    """The text with every stretch of spans replaced by ``[REDACTED]``."""
    out, at = [], 0
    for _, a, b, *_ in sorted(spans, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: base spans counted by kind, their digest, and all spans."""
    found = scan(docs, ["doc_id"], **options)
    of = lambda f: F.col(f"{RESULT}.{f}")
    return found.select("doc_id", of("n_assign"), of("n_access"), of("n_hex"), F.sha2(of("base"), 256).alias("base_sha256"), of("spans"), F.size(of("added")).cast("long").alias("n_added"))


@sheltered
def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their secrets replaced; n_chars, where there is one, follows the new text."""
    found = scan(docs, docs.columns, text, redact=True)
    new = F.col(f"{RESULT}.redacted")
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    out[text] = F.coalesce(new, out[text])
    if "n_chars" in out:
        out["n_chars"] = F.when(new.isNull(), out["n_chars"]).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return found.select(*(c.alias(k) for k, c in out.items()))
