"""WARC derivative builder: responses to metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.tokens import rows

VERSION = b"WARC/1.0"
#: The namespace of record ids: equal input gives equal ids, so a task can run twice.
SPACE = uuid.UUID("7f0c2a52-4b1f-5e5c-9d51-0f6f1f6c9a10")

RECORDS = "page_id long, response_id string, metadata_id string, conversion_id string, target_uri string, date string, payload_digest string, metadata binary, conversion binary, text string, http_status int, status string"

#: Elements that hold nothing to read, elements that break a line, and cells of a row.
_RAW = ("script", "style", "template", "noscript", "svg")
_BREAKS = frozenset("p div br hr li ul ol dl dt dd tr table thead tbody h1 h2 h3 h4 h5 h6 section article nav header footer main aside blockquote pre form figure title body html".split())
_CELLS = frozenset(("td", "th"))
_CLOSE = {k: re.compile(rf"</{k}(?=[\s/>])", re.I | re.A) for k in (*_RAW, "head", "title")}
_OPEN = re.compile("<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LONG_NUMBER = re.compile("&#(?:[0-9]{20,}|[xX][0-9a-fA-F]{20,});?")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record; its length and block digest are added."""
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in head)
    return VERSION + b"\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def unzipped(data: bytes) -> bytes:
    """All members of a gzip file, or the data as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            out.append(z.decompress(data))
        except zlib.error as e:
            raise ValueError(f"bad gzip: {e}") from None
        if not z.eof:
            raise ValueError("bad gzip: a member is cut off")
        data = z.unused_data
    return b"".join(out) or data


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers in order, and the block, of each record (plain or gzip); ValueError where one is malformed.

    A record without a length takes all that follows.
    """
    data, at = unzipped(data), 0
    while True:
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        headers: list[tuple[str, str]] = []
        for line in data[at:end].split(b"\r\n")[1:]:
            if line[:1] in (b" ", b"\t") and headers:  # a folded line
                headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.decode("utf-8", "replace").strip())
            else:
                k, _, v = line.decode("utf-8", "replace").partition(":")
                headers.append((k.strip(), v.strip()))
        given = next((v for k, v in headers if k.lower() == "content-length"), str(len(data) - end - 4))
        if not (given.isascii() and given.isdigit() and len(given) < 19):
            raise ValueError("bad Content-Length")
        at = end + 4 + int(given)
        if at > len(data):
            raise ValueError("the block is cut off")
        yield headers, data[end + 4 : at]
        while data.startswith(b"\r\n", at):
            at += 2
        if at == len(data):
            return


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of the first record."""
    return next(records(data))


@dataclass
class Page:
    """What a reader sees of a page, and what it says about itself."""

    text: str = ""
    title: str | None = None
    lang: str | None = None
    links: list[str] = field(default_factory=list)


def resolved(text: str) -> str:
    """Entities as characters; a number beyond 20 digits is no character."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def read(page: str) -> Page:
    """Text, title, language and links of a page, in one pass over it.

    Comments, scripts and the like are hidden, up to the end if they never close; so is
    a head that closes.  Tags of blocks break lines, cells are parted by blanks, other
    tags leave nothing.  A tag ends at the first ``>`` outside the quotes of its
    values; a quote that never closes, and any quote after a tag that ends in none
    other, is an ordinary sign.  Without a ``>`` ahead, ``<`` is text.  What isn't there is looked for
    once, so that no page costs more than its length.
    """
    found, parts, missing = Page(), [], set()
    at, seen, quotes, size = 0, 0, True, len(page)  # ``seen``: where text is shown from

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        i = page.find(what, start)
        if i < 0:
            missing.add(what)
        return i

    def close(name: str, start: int) -> tuple[int, int] | None:
        """Where the element's end tag starts and ends."""
        if name in missing:
            return None
        m = _CLOSE[name].search(page, start)
        if m is None:
            missing.add(name)
            return None
        end = find(">", m.end())
        return m.start(), end + 1 if end >= 0 else size

    def tag_end(start: int) -> int:
        nonlocal quotes
        first = find(">", start)
        i = start
        while quotes and first >= 0:
            m = _STOP.search(page, i)
            if m is None:
                quotes = False
                break
            if m[0] == ">":
                return m.start()
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            shut = find(m[0], m.end()) if page[before] == "=" else -1
            i = shut + 1 if shut >= 0 else m.end()
        return first

    def show(start: int, end: int) -> None:
        if max(start, seen) < end:
            parts.append(page[max(start, seen) : end])

    while at < size:
        if (m := _OPEN.search(page, at)) is None:
            show(at, size)
            break
        i = m.start()
        show(at, i)
        if page.startswith("<!--", i):
            end = find("-->", i + 4)
            if end < 0:
                break
            if i >= seen:
                parts.append(" ")
            at = end + 3
            continue
        end = tag_end(i)
        if end < 0:
            show(i, size)
            break
        at = end + 1
        m = _NAME.match(page, i + 1, end)
        name = m[1].lower() if m else ""
        if i >= seen and (name in _BREAKS or name in _CELLS):
            parts.append("\n" if name in _BREAKS else " ")
        if page[i + 1] == "/":
            continue
        if name in _RAW and not (name == "svg" and page[end - 1] == "/"):
            if (stop := close(name, at)) is None:
                break
            if i >= seen:
                parts.append(" ")
            at = stop[1]
        elif name == "head" and (stop := close(name, at)):
            seen = max(seen, stop[1])
        elif name == "title" and (stop := close(name, at)):
            if found.title is None:
                found.title = " ".join(resolved(page[at : stop[0]]).split())
            show(at, stop[0])
            at = stop[0]
        elif name == "a" and (m := _HREF.search(page, i, end)):
            found.links.append(resolved(m[1].strip("\"'")))
        elif name == "html" and found.lang is None and (m := _LANG.search(page, i, end)):
            found.lang = m[1]
    found.text = _LINES.sub("\n", _BLANKS.sub(" ", resolved("".join(parts)))).strip()
    return found


def plain_text(page: str) -> str:
    """Readable text: hidden parts go, block tags break lines, entities are resolved, blanks are folded."""
    return read(page).text


def response_record(page_id, url: str | None, body: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response as a crawler writes it, for tables that hold pages only."""
    payload = (body or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    name = uuid.uuid5(SPACE, f"response|{page_id}|{url}|{digest(payload)}")
    return record("response", [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")], block)


def derive(headers: list[tuple[str, str]], block: bytes) -> dict | None:
    """The metadata and conversion records of a response; None for any other record.

    Both refer to the response's id and carry its URI, date and payload digest;
    the metadata holds the WARC and HTTP headers as they came, in order.
    """
    known: dict[str, str] = {}
    for k, v in headers:
        known.setdefault(k.lower(), v)
    if known.get("warc-type") != "response":
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = [tuple(x.strip() for x in line.partition(":")[::2]) for line in lines if ":" in line]
    charset = next((m[1] for k, v in http if k.lower() == "content-type" and (m := re.search(r"charset=[\"']?([\w-]+)", v, re.I))), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    seen = read(page)
    source, uri, date = known.get("warc-record-id", ""), known.get("warc-target-uri", ""), known.get("warc-date", "")
    given = known.get("warc-payload-digest") or digest(payload)
    number = re.match(r"HTTP/\S+ ([0-9]{1,9})(?![0-9])", status)
    about = {
        "source": {"warc-headers": [list(x) for x in headers], "http-status-line": status, "http-headers": [list(x) for x in http]},
        "payload": {"digest": given, "computed-digest": digest(payload), "length": len(payload)},
        "html": {"title": seen.title, "lang": seen.lang, "links": seen.links},
    }
    made = {}
    ids = {kind: f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}|{source}|{given}')}>" for kind in ("metadata", "conversion")}
    shared = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source)]
    meta = json.dumps(about, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    body = seen.text.encode("utf-8", "surrogatepass")
    made["metadata"] = record("metadata", [("WARC-Record-ID", ids["metadata"]), *shared, ("Content-Type", "application/json")], meta)
    made["conversion"] = record("conversion", [("WARC-Record-ID", ids["conversion"]), *shared, ("WARC-Source-Payload-Digest", given), ("Content-Type", "text/plain; charset=utf-8")], body)
    return made | {"response_id": source, "metadata_id": ids["metadata"], "conversion_id": ids["conversion"], "target_uri": uri, "date": date, "payload_digest": given, "text": seen.text, "http_status": int(number[1]) if number else None, "status": "ok"}


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
_FIELDS = [(x.split()[0], _TYPES[x.split()[1]]) for x in RECORDS.split(", ")]


def derivatives(data: bytes | None) -> Iterator[dict]:
    """What ``derive`` makes of each response of one value; a malformed rest gives a row that says so."""
    if data is None:
        return
    try:
        for headers, block in records(data):
            if made := derive(headers, block):
                yield made
    except ValueError as e:
        yield {"status": str(e)}


def _batches(pairs):
    held, size = [], 0
    for page_id, data in pairs:
        for made in derivatives(data):
            held.append(made | {"page_id": page_id})
            size += sum(len(made.get(k) or b"") for k in ("metadata", "conversion"))
            if size > 4 << 20:
                yield _batch(held)
                held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.get(k) for x in held], t) for k, t in _FIELDS], names=[k for k, _ in _FIELDS])


def derive_records(responses: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """``RECORDS`` of every WARC response in ``record_col`` (records one after the other, plain or gzip).

    A narrow step: each response's two records are made where it is read, in time
    linear in its length whatever it holds.  Null
    records and records of other types give no row; a response without a body
    gives an empty conversion.  What is no record, or a bad or cut off one, gives a row of
    nulls with the reason in ``status``, which is ``ok`` otherwise; the records before it count.
    Repeated rows repeat their records, with the same ids.  A null id stays null.  An
    empty table gives no rows.  Extra columns are not read and may have any name.
    """
    few = responses.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{record_col}`").alias("record"))
    return few.mapInArrow(lambda bs: _batches(rows(bs, "page_id", "record", step=64)), RECORDS)


def derive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The same for a table of pages: each row is first made a response record.

    Null urls and pages count as empty, and a page of any length is read whole; rows
    that repeat give equal records.
    """
    few = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return few.mapInArrow(lambda bs: _batches((i, response_record(i, u, h)) for i, u, h in rows(bs, "page_id", "url", "html", step=64)), RECORDS)


def save(records: DataFrame, folder: str, column: str) -> DataFrame:
    """One gzip member a record, one WARC file a task; returns ``path, n_records, n_bytes``.

    A file's name holds the task attempt, so a task can run twice; only the files
    named in the result belong to it.
    """
    from pyarrow import fs
    from pyspark import TaskContext

    def write(batches):
        out, path, n, size = None, None, 0, 0
        for (data,) in rows(batches, column, step=64):
            if out is None:
                files, at = fs.FileSystem.from_uri(folder)
                files.create_dir(at, recursive=True)
                t = TaskContext.get()
                path = f"{column}-{t.partitionId():06d}-{t.taskAttemptId()}.warc.gz"
                out = files.open_output_stream(f"{at}/{path}", compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(data) + z.flush()
            out.write(member)
            n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    return records.select(column).mapInArrow(write, "path string, n_records long, n_bytes long")
