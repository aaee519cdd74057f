"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

A response record is parsed (record headers, HTTP headers, body), its block and payload digests are verified, and two records are
derived from it. The conversion record holds the page's plain text (text/plain), the metadata record the page's title, declared language,
links and counts (application/warc-fields). Both keep the response's target URI and date, name it in WARC-Refers-To, and carry
block and payload digests of their own; the metadata record is WARC-Concurrent-To the conversion record. The source's HTTP status,
content type and digest are kept as fields. Record identifiers are made from the response's identifier (UUID 5), so reruns agree.

Digests are checked by any algorithm of DIGESTS, in base32 or hexadecimal; the payload is the body without its transfer coding (or with it, as some writers
have it). Chunked transfer and gzip, deflate and zstd contents are undone, up to 256 MB. A response that isn't text, has another coding, an unknown
or wrong digest, or is broken anywhere, is rejected with the reason.

parse_records() reads concatenated records of a file, gzip members or plain; record() writes one.

Nulls and edges: a null record yields nothing; a record that isn't a whole response yields one row of type "rejected" with the reason;
a null html (in responses()) is an empty body; an empty body yields empty text and both records; repeated rows yield their records
each; a null page_id stays null; further columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

VERSION = b"WARC/1.1"
DIGESTS = ("md5", "sha1", "sha256", "sha384", "sha512")
TEXTUAL = re.compile(r"text/.*|application/(.*[+])?(xml|json|xhtml|javascript|ecmascript|x-javascript)|application/xhtml[+]xml")
_CLEAN = str.maketrans("", "", "\r\n")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; Content-Length and WARC-Block-Digest are set here."""
    fields = [*headers, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v.translate(_CLEAN)}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and out:  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode('utf-8', 'replace')}")
        elif b":" in line:
            k, _, v = line.partition(b":")
            out.append((k.strip().decode("utf-8", "replace"), v.strip().decode("utf-8", "replace")))
    return out


def field(fields: list[tuple[str, str]], name: str, default: str = "") -> str:
    return next((v for k, v in fields if k.lower() == name.lower()), default)


def parse_record(data: bytes, at: int = 0) -> tuple[list[tuple[str, str]], bytes, int]:
    """Headers, block and the place after one record. ValueError if it isn't whole."""
    if not data.startswith(b"WARC/", at):
        raise ValueError("no WARC version line")
    line, end = data.find(b"\r\n", at), data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers don't end")
    fields = _fields(data[line + 2 : end])
    if not (size := field(fields, "Content-Length")).isdigit():
        raise ValueError("no Content-Length")
    block = data[end + 4 : end + 4 + int(size)]
    if len(block) < int(size):
        raise ValueError("block is cut short")
    return fields, block, min(len(data), end + 8 + int(size))


def parse_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """All records of a file's bytes."""
    if data[:2] == b"\x1f\x8b":
        data = decoded(data, "gzip", most=1 << 30)  # all members
    at = 0
    while at < len(data):
        fields, block, at = parse_record(data, at)
        yield fields, block
        while data[at : at + 2] == b"\r\n":
            at += 2


BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
HIDDEN = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "template", "noscript")}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME_END, _SPECIAL = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
_VALUE = {n: re.compile(rf"(?:^|\s){n}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I) for n in ("href", "lang")}
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{12,}+|[xX][0-9a-fA-F]{12,}+);?")


def unescape(text: str) -> str:
    """Character references replaced; numbers beyond all characters become U+FFFD, however many digits they have."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


class _Ends:
    """Where a tag that begins at a place ends, for a page on which one didn't: every place is looked at once, however many tags stay open."""

    def __init__(self, page: str) -> None:
        self.names = [m.start() for m in _NAME_END.finditer(page)]
        self.at = [m.start() for m in _SPECIAL.finditer(page)]
        self.end = [-1] * (len(self.at) + 1)
        after: dict[str, int] = {}
        for i in range(len(self.at) - 1, -1, -1):
            if (c := page[self.at[i]]) == ">":
                self.end[i] = self.at[i]
                continue
            if (j := after.get(c)) is not None:  # a quoted stretch is passed over
                self.end[i] = self.end[j + 1]
            after[c] = i

    def of(self, start: int) -> tuple[int, int] | None:
        """End of the name and place of the closing sign, for a name that starts here."""
        i = bisect_left(self.names, start)
        if i == len(self.names):
            return None
        end = self.end[bisect_left(self.at, self.names[i])]
        return (self.names[i], end) if end >= 0 else None


class PlainText:
    """A page's text in one pass over its tags: block elements end lines, scripts and styles go. A tag or declaration that never closes is text. The
    time is linear in the page, whatever it leaves open."""

    def __init__(self, page: str) -> None:
        self.out: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self.lang, into = "", self.out
        self.page, self.ends, open_comment = page, None, False
        text, at = 0, page.find("<")  # what isn't a tag goes out from text on
        while at >= 0:
            m = _TAG.match(page, at) if self.ends is None else None
            if m:
                closing, name, attributes = m.groups()
                end = m.end()
            else:
                closing, name, attributes, end, first = "", "", "", -1, page[at + 1 : at + 2]
                if first == "!" and not open_comment and page.startswith("--", at + 2):
                    end = page.find("-->", at + 4)
                    open_comment = end < 0
                    end += 3 if end >= 0 else 0
                if end < 0 and (first == "!" or first == "?"):
                    end = page.find(">", at + 2) + 1
                    if not end:
                        break  # no sign closes anything from here on
                elif end < 0 and (tag := self._tag(at)):
                    closing, name, attributes, end = tag
                if end < 0:
                    at = page.find("<", at + 1)
                    continue
            if at > text:
                into.append(unescape(page[text:at]))
            if name:
                name = name.lower()
                if not closing and name in HIDDEN:
                    last = HIDDEN[name].search(page, end)
                    end = (page.find(">", last.end()) + 1 if last else 0) or len(page)
                else:
                    if name in BLOCKS:
                        self.out.append("\n")
                    if name == "title":
                        into = self.out if closing else self.title
                    elif not closing and name == "a" and (v := self._value("href", attributes)):
                        self.links.append(v)
                    elif not closing and name == "html":
                        self.lang = self._value("lang", attributes) or self.lang
            text, at = end, page.find("<", end)
        if text < len(page):
            into.append(unescape(page[text:]))

    def _tag(self, at: int) -> tuple[str, str, str, int] | None:
        """(slash, name, attributes, end) of the tag at a place, if there is one, for a page on which a tag didn't close."""
        page = self.page
        slash = page[at + 1 : at + 2] == "/"
        first = page[at + 1 + slash : at + 2 + slash]
        if not (first.isascii() and first.isalpha()):
            return None
        if self.ends is None:
            self.ends = _Ends(page)
        found = self.ends.of(at + 1 + slash)
        return found and ("/" * slash, page[at + 1 + slash : found[0]], page[found[0] : found[1]], found[1] + 1)

    @staticmethod
    def _value(name: str, attributes: str) -> str:
        m = _VALUE[name].search(attributes)
        return unescape(m[1] or m[2] or m[3] or "") if m else ""


def tidy(text: str) -> str:
    return "\n".join(line for x in text.split("\n") if (line := " ".join(x.split())))


def matches_digest(said: str, data: bytes) -> bool:
    """Whether data has the labelled digest (algorithm:value in base32 or hexadecimal). An algorithm that can't be checked is an error."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in DIGESTS:
        raise ValueError(f"unknown digest algorithm {name[:20]}")
    made = hashlib.new(name, data).digest()
    return value.strip().lower() == made.hex() or value.strip().upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def unchunk(body: bytes) -> bytes:
    """The body without its chunked transfer coding."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(;.*)?", body[at:end] if end >= 0 else b"", re.DOTALL)
        if not size:
            raise ValueError("broken chunk size")
        n, at = int(size[1], 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + n])
        at += n + 2


def _inflate(data: bytes, wbits: int, most: int) -> bytes:
    """All members of a deflated body, at most `most` bytes of it."""
    out, size = [], 0
    while data:
        z = zlib.decompressobj(wbits)
        out.append(z.decompress(data, most + 1 - size))
        size += len(out[-1])
        if size > most:
            raise ValueError("body too large")
        if not z.eof:
            raise ValueError("body is cut off")
        data = z.unused_data.lstrip(b"\0") if wbits > 15 else b""
    return b"".join(out)


def decoded(body: bytes, coding: str, most: int = 1 << 28) -> bytes:
    """The body without one content coding."""
    try:
        if coding in ("gzip", "x-gzip"):
            return _inflate(body, 31, most)
        if coding == "deflate":  # with a zlib header, or without, as some servers send it
            try:
                return _inflate(body, 15, most)
            except zlib.error:
                return _inflate(body, -15, most)
        if coding == "zstd":
            with zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True) as z:
                out = z.read(most + 1)
            if len(out) > most:
                raise ValueError("body too large")
            return out
    except (zlib.error, zstandard.ZstdError) as e:
        raise ValueError(f"broken {coding} body: {e}") from e
    raise ValueError(f"content coding {coding[:20]} isn't supported")


def http_response(block: bytes) -> tuple[int, list[tuple[str, str]], bytes, bytes, bytes]:
    """Status, headers, the body as it was sent, without its transfer coding, and without its content codings."""
    head, gap, sent = block.partition(b"\r\n\r\n")
    status = re.match(rb"HTTP/\d(?:\.\d)? +(\d{3})", head)
    if not gap or not status:
        raise ValueError("no HTTP response")
    fields = _fields(head.partition(b"\r\n")[2])
    codings = lambda name: [x for x in (x.strip().lower() for x in field(fields, name).split(",")) if x not in ("", "identity")]
    payload = body = sent
    for coding in reversed(codings("Transfer-Encoding")):
        payload = body = unchunk(body) if coding == "chunked" else decoded(body, coding)
    for coding in reversed(codings("Content-Encoding")):
        body = decoded(body, coding) if body else body
    return int(status[1]), fields, sent, payload, body


def derive(data: bytes) -> list[tuple[str, list[tuple[str, str]], bytes, bytes]]:
    """The (type, headers, block, record) of the conversion and the metadata record of one response record, plain or as a gzip member."""
    fields, block, _ = parse_record(decoded(data, "gzip", most=1 << 30) if data[:2] == b"\x1f\x8b" else data)
    if field(fields, "WARC-Type") != "response":
        raise ValueError("not a response")
    source, uri, date = (field(fields, f"WARC-{x}") for x in ("Record-ID", "Target-URI", "Date"))
    if not source:
        raise ValueError("no WARC-Record-ID")
    if (said := field(fields, "WARC-Block-Digest")) and not matches_digest(said, block):
        raise ValueError("block digest differs")
    status, http, sent, payload, body = http_response(block)
    digest = field(fields, "WARC-Payload-Digest")
    if digest and not matches_digest(digest, payload) and not matches_digest(digest, sent):  # writers differ on transfer codings
        raise ValueError("payload digest differs")
    digest = digest or sha1(payload)
    kind = field(http, "Content-Type").partition(";")[0].strip().lower()
    if kind and not TEXTUAL.fullmatch(kind):
        raise ValueError(f"not text: {kind[:60]}")
    charset = re.search(r"charset=[\"']?([\w-]+)", field(http, "Content-Type"))
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    found = PlainText(page if "html" in kind or not kind else html.escape(page))
    text = tidy("".join(found.out)).encode()
    ids = {t: record_id(source, t) for t in ("conversion", "metadata")}
    common = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    conversion = [("WARC-Type", "conversion"), ("WARC-Record-ID", ids["conversion"]), *common, ("WARC-Payload-Digest", sha1(text)), ("Content-Type", "text/plain; charset=utf-8")]
    lines = [("title", tidy("".join(found.title)).replace("\n", " ")), ("language", found.lang), ("http-status", str(status)), ("content-type", field(http, "Content-Type")), ("source-payload-digest", digest), ("source-length", str(len(body))), ("text-length", str(len(text))), ("text-record", ids["conversion"])]
    lines += [("source-header", f"{k}: {v}") for k, v in http] + [("outlink", x) for x in found.links]
    facts = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines).encode()
    metadata = [("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *common, ("WARC-Concurrent-To", ids["conversion"]), ("Content-Type", "application/warc-fields")]
    return [("conversion", conversion, text, record(conversion, text)), ("metadata", metadata, facts, record(metadata, facts))]


def response(uri: str, body: bytes, date: str, headers: tuple[tuple[str, str], ...] = (("Content-Type", "text/html; charset=utf-8"),)) -> bytes:
    """A response record of a page."""
    block = b"HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body
    digest = sha1(body)
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id(uri, digest)), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], block)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (page_id, record) of pages (page_id, url, html): the crawl's output, where it isn't at hand as files."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "b"):
            made = [response(u or "", b, date) for u, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["page_id", "record"])

    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select("page_id", "url", body.alias("b")).mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, record binary")


_ROW = "warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, source_payload_digest string, block_digest string, content_length long, title string, language string, http_status int, n_links int, text string, reason string, record binary"


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response of records (page_id, record): the record and its main fields; one row of type rejected if it isn't whole."""
    bound_batches(records.sparkSession)
    names = ["page_id", *(x.split()[0] for x in _ROW.split(", "))]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def rows(data: bytes) -> list[dict]:
        try:
            made = derive(data)
        except ValueError as e:
            return [{"warc_type": "rejected", "reason": str(e)}]
        facts = _fields(made[1][2])
        same = {"source_payload_digest": field(facts, "source-payload-digest"), "title": field(facts, "title"), "language": field(facts, "language") or None, "http_status": int(field(facts, "http-status")), "n_links": sum(k == "outlink" for k, _ in facts)}
        return [same | {"warc_type": t, "record_id": field(h, "WARC-Record-ID"), "refers_to": field(h, "WARC-Refers-To"), "concurrent_to": field(h, "WARC-Concurrent-To") or None, "target_uri": field(h, "WARC-Target-URI"), "block_digest": sha1(b), "content_length": len(b), "text": b.decode() if t == "conversion" else None, "record": r} for t, h, b, r in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "record"):
            made = [rows(x) for x in part.column(1).to_pylist()]
            at = pa.array([i for i, x in enumerate(made) for _ in x], pa.int32())
            out = [r for x in made for r in x]
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), *(pa.array([r.get(n) for r in out], kinds[k]) for n, k in (x.split() for x in _ROW.split(", ")))], names)

    own = records.where("record is not null").select("page_id", "record")
    return own.mapInArrow(run, f"page_id {dict(records.dtypes)['page_id']}, {_ROW}")
