"""WARC archives: writing with deduplicated payloads, and a reader that salvages damaged ones.

Every record is written as a gzip member of its own. The reader takes plain records and members of one or many
alike; a record is valid when it inflates, has its stated length and end, and matches its block digest. After a failed
check it searches for the next version line, in what the member inflates to and then in the file, or for the next
member, goes on from there and logs the bytes between as a quarantined gap. It holds two records at most.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexflow.llm.common import Workspace, arrow_map
from indexflow.llm.minhash import IdFilter

#: Tasks over which rows with one payload are spread at least when they are shuffled.
SALTS = 16
#: Bytes after which a task begins another archive.
ROLL_BYTES = 64 << 20
#: Bytes read at once, and of a record at most: more than a value of a table, and so what ``write`` makes of one, can have.
CHUNK, LARGEST = 1 << 18, (1 << 31) + (1 << 28)
#: Bytes that a step inflates at most.
INFLATED = 1 << 22
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
VERSION_LINE = re.compile(rb"WARC/1\.\d{1,3}\r\n")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit leaves the payload out but states its length and digest."""
    block = HTTP % len(payload) + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("WARC-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", SAME), ("WARC-Refers-To", name(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Found(NamedTuple):
    """A record at bytes [start, end) of its file, or with no head a gap and why it was quarantined.

    Of a record in a member of several, start is the member's and end as far as the file had to be read for it. A gap
    in such a member begins with it too, so it shares bytes with the records before it.
    """

    start: int
    end: int
    head: dict[str, str] | None
    block: bytes
    why: str = ""


class Damaged(ValueError):
    pass


def names(lines: bytes) -> list[bytes]:
    """Names of fields; that of a line that is none is empty."""
    return [name.strip().lower() if colon else b"" for name, colon, _ in (x.partition(b":") for x in lines.split(b"\r\n"))]


def is_cut(head: bytes) -> bool:
    """Whether a head was cut off and another record follows: a version line stands in it.

    One that ends a longer line may also be the end of a value, such as an address. It isn't if that line
    would be no field without it, or if a field up to there comes again after it.
    """
    first = head.index(b"\r\n") + 2
    for m in VERSION_LINE.finditer(head, first):
        before = names(head[first : m.start()])
        if not before[-1] or {*before} & {*names(head[m.end() :])} - {b"", b"warc-concurrent-to"}:
            return True
    return False


class Stream:
    """The bytes of a file from ``at`` on, or what the gzip member that begins there inflates to; ``data`` holds those not dropped yet."""

    def __init__(self, f: BinaryIO, at: int, packed: bool):
        self.f, self.begin, self.at, self.data, self.rest, self.bad = f, at, at, bytearray(), b"", ""
        self.z = zlib.decompressobj(31) if packed else None
        self.ended = False
        f.seek(at)

    def more(self) -> bool:
        """Read on; False at the end of the file or the member, or where it is damaged: ``bad`` says how."""
        size = len(self.data)
        while not self.ended and len(self.data) == size:
            chunk = self.rest or self.f.read(CHUNK)
            if not chunk:
                self.ended, self.bad = True, "the member is cut off" if self.z else ""
            elif self.z is None:
                self.at += len(chunk)
                self.data += chunk
            else:
                before = self.z.copy() if self.at > self.begin else None
                try:
                    self.data += self.z.decompress(chunk, INFLATED)
                except zlib.error as bad:
                    self.ended, self.bad = True, str(bad)
                    self.before_error(before or zlib.decompressobj(31), chunk)
                else:
                    self.at += len(chunk) - len(self.z.unconsumed_tail) - len(self.z.unused_data)
                    self.rest, self.ended = self.z.unconsumed_tail, self.z.eof
        return len(self.data) > size

    def before_error(self, z, chunk: bytes) -> None:
        """What the damaged ``chunk`` inflates to up to the damage."""
        for step in (1 << 10, 1):
            for lo in range(0, len(chunk), step):
                again = z.copy()
                try:
                    self.data += z.decompress(chunk[lo : lo + step])
                except zlib.error:
                    z, chunk = again, chunk[lo : lo + step]
                    break
                self.at += step

    def take(self, p: int) -> tuple[dict[str, str], bytes, int, bool]:
        """The record that begins at ``p`` of ``data``: head, block, where it ends, and whether its digest was there to match."""
        data, seen = self.data, p
        while (stop := data.find(b"\r\n\r\n", max(p, seen - 3))) < 0:
            if len(data) - p > 16 and not VERSION_LINE.match(data, p) or data.find(b"\r\n" + VERSION, max(p, seen - 8)) >= 0:
                break
            seen = len(data)
            if seen - p > LARGEST or not self.more():
                break
        if stop < 0 or not VERSION_LINE.match(data, p):
            raise Damaged("no record head")
        if is_cut(bytes(data[p : stop + 2])):
            raise Damaged("another record begins inside the head")
        lines = data[p:stop].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if not re.fullmatch(r"\d{1,12}", head.get("content-length", ""), re.A):
            raise Damaged("no content length")
        end = stop + 4 + int(head["content-length"])
        if end + 4 - p > LARGEST:
            raise Damaged("the record is larger than a record may be")
        while len(data) < end + 4 and self.more():
            pass
        if data[end : end + 4] != b"\r\n\r\n":
            raise Damaged("the record doesn't end where its length says")
        block = bytes(data[stop + 4 : end])
        digest = head.get("warc-block-digest", "").partition(":")
        known = digest[0].lower() == "sha1"
        if known and digest[2] != sha1_base32(block):
            raise Damaged("the block digest differs")
        return head, block, end + 4, known

    def next_version(self) -> bool:
        """Drop what stands before the next version line after the first byte; False if there is none."""
        del self.data[:1]
        while (i := self.data.find(VERSION)) < 0:
            del self.data[: max(0, len(self.data) - len(VERSION) + 1)]
            if not self.more():
                return False
        del self.data[:i]
        return True


def search(f: BinaryIO, at: int, plain: int) -> int | None:
    """Where the next gzip magic from ``at`` on or version line from ``plain`` on begins."""
    f.seek(at)
    kept = b""
    while chunk := f.read(CHUNK):
        data = kept + chunk
        first = at - len(kept)
        if found := [i for i in (data.find(MAGIC), data.find(VERSION, max(0, plain - first))) if i >= 0]:
            return first + min(found)
        at += len(chunk)
        kept = data[-(len(VERSION) - 1) :]
    return None


def members(s: Stream) -> Iterator[tuple[dict[str, str], bytes, int] | Damaged]:
    """Valid records of a gzip member and where each ends, and failed checks between them.

    The last one counts if the member ends well. If that is cut off or damaged later on, its digest must have matched;
    if the member's own checksum differs, another record must be there to explain that.
    """
    held, count = None, 0
    while s.data or s.more():
        try:
            head, block, end, known = s.take(0)
        except Damaged as bad:
            if held:
                yield held[:3]
                held = None
            yield bad
            count += 1
            if not s.next_version():
                break
            continue
        if held:
            yield held[:3]
        del s.data[:end]
        if not s.data:
            s.more()
        held, count = (head, block, s.at, known), count + 1
    if held and (not s.bad or held[3] and (count > 1 or "data check" not in s.bad and "length check" not in s.bad)):
        yield held[:3]
    if s.bad:
        yield Damaged(s.bad)


def salvage(f: BinaryIO) -> Iterator[Found]:
    """Every valid record of an archive, gzipped or plain, and every gap between them."""
    at, lost, why = 0, None, ""
    while True:
        f.seek(at)
        begin = f.read(len(VERSION))
        if not begin:
            break
        packed, failed, taken = begin.startswith(MAGIC), False, 0
        s = Stream(f, at, packed)
        if packed:
            found: Iterator = members(s)
        else:
            try:
                head, block, end, _ = s.take(0)
                s.at, found = at + end, iter([(head, block, at + end)])
            except Damaged as bad:
                s.bad, found = str(bad), iter([bad])
        for x in found:
            if isinstance(x, Damaged):
                lost, why = (at, str(x)) if lost is None else (lost, why)
                failed = True
                continue
            if lost is not None:
                yield Found(lost, s.at if failed else at, None, b"", why)
                lost, failed = None, False
            taken += 1
            yield Found(at, x[2], x[0], x[1])
        if not s.bad:
            at = s.at
            continue
        # records that were taken from the member mustn't be found again where it holds them as they are
        after = search(f, at + 1, s.at if taken else at + 1)
        if after is None:
            f.seek(0, 2)
            at = f.tell()
            break
        at = after
    if lost is not None:
        yield Found(lost, at, None, b"", why)


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4, roll_bytes: int = ROLL_BYTES, ws: Workspace | None = None) -> DataFrame:
    """Write a record per row into archives under ``folder`` and return their list: path, records, bytes.

    The payload is the html in UTF-8, a null one being empty. Of equal payloads of at least ``min_bytes`` the row with the smallest
    id is the response, the others revisit it; rows with that same id and payload are all responses, and a null id is
    the smallest only where all are null. Archives of failed attempts are not on the list. An empty table makes no archives.
    """
    ws = ws or Workspace(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(html, "UTF-8").alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    firsts = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = ws.save(firsts, "firsts")
    # payloads that surely stand once stay where they are
    told = IdFilter(firsts, "digest", ws).mark(rows)
    once = told.where("not __maybe").select("id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = told.where("__maybe").select(*rows.columns, F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    again = again.join(salted, ["digest", "salt"], "left").select("id", "url", "html", F.expr("case when first is not null and not id <=> first then first end").alias("refers_to"))
    marked = once.unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        path, out, count, size = "", None, 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, count, size = f"{folder}/{name}", 0, 0
                    out = target.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record("response" if refers is None else "revisit", page, url, payload, refers, date)) + z.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= roll_bytes:
                    out.close()
                    out = done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return ws.save(marked.transform(arrow_map, run, "path string, records long, bytes long"), "archives")


FIELDS = {"path": "string", "start": "long", "end": "long", "gap": "string", "record_type": "string", "page_id": "long", "target_uri": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "payload": "binary"}


def read(archives: DataFrame, *, payloads: bool = True, path_col: str = "path") -> DataFrame:
    """Every record and gap of the archives listed in ``archives``, one archive to a task.

    A gap has its bytes [start, end) and the failed check in ``gap``, and nothing else. Payload length and digest are those of
    the payload that was read, for revisits those that their head states. Ids come from names that ``write`` gave; other records
    have none. Null paths are skipped.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", name or "")) else None

    def row(path: str, x: Found) -> tuple:
        if x.head is None:
            return (path, x.start, x.end, x.why, *[None] * 7)
        kind, body = x.head.get("warc-type"), x.block
        if x.head.get("content-type", "").startswith("application/http"):
            body = body.partition(b"\r\n\r\n")[2]
        size, digest = len(body), sha1_base32(body)
        if kind == "revisit":
            size, digest = int(x.head.get("warc-payload-length", 0)), x.head.get("warc-payload-digest", "").rpartition(":")[2]
        return path, x.start, x.end, None, kind, page(x.head.get("warc-record-id")), x.head.get("warc-target-uri"), size, digest, page(x.head.get("warc-refers-to")), body if payloads and kind != "revisit" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in filter(None, batch.column(0).to_pylist()):
                source, name = fs.FileSystem.from_uri(path)
                with source.open_input_file(name) as f:
                    rows, size = [], 0
                    for x in salvage(f):
                        rows.append(row(path, x))
                        size += len(x.block) if payloads else 0
                        if len(rows) >= 2000 or size >= 8 << 20:
                            yield made(rows)
                            rows, size = [], 0
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(FIELDS.values())], list(FIELDS))

    tasks = archives.select(F.col(path_col).alias("path")).repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism), F.xxhash64("path"))
    return tasks.transform(arrow_map, run, ", ".join(f"{k} {v}" for k, v in FIELDS.items()))
