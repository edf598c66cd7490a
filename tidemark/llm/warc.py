"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Every record is a gzip member of its own; other archives may hold many in a member. The
reader checks each record (member, version line, headers, length, trailing line ends,
digests). After a failed check it searches for the next gzip member or version line from
which a record passes, goes on there, and logs the bytes in between as a quarantined gap.
Inside a member the inflated bytes are searched, also those before the place where a
member breaks. Files are read and members inflated in pieces; one record at a time is held
in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.files import create, filesystem
from tidemark.llm.registry import query, table, text_of
from tidemark.session import scratch_dir

#: Payloads below this are always stored.
LEAST_REVISIT = 100
SALTS = 32
FILE_BYTES = 256 << 20
RECORD_DATE = "1970-01-01T00:00:00Z"
MOST_HEADER = 1 << 20
CHUNK = 1 << 20

ROW = (
    "file string, offset long, length long, reason string, type string, record_id string, uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def record_id(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(page, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record. A revisit keeps the HTTP headers, whose length is the full payload's."""
    import hashlib

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    uri = "".join(c if c.isprintable() and c != " " else "%" + c.encode("utf-8", "replace").hex() for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {uri or record_id(page)[1:-1]}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines.insert(3, f"WARC-Refers-To: {record_id(refers_to)}")
        lines.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, salts: int) -> DataFrame:
    """page, url, payload, digest, refers_to (null: a response).

    Of equal payloads of at least ``least`` bytes the smallest id is the response; rows
    that share that id are all responses, and so are all rows if no id is known. First ids
    are counted map-side; only payloads that repeat are joined back, salted, so a payload
    that fills a third of the table is spread over ``salts`` tasks.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
        F.encode(text_of(payload_col), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    repeated = (
        rows.filter(F.length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    spread = F.pmod(F.xxhash64("page", "url"), F.lit(salts)).cast("int")
    return (
        rows.withColumn("salt", spread)
        .join(repeated, ["digest", "salt"], "left")
        .select(
            "page", "url", "payload", "digest",
            F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
        )
    )


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = LEAST_REVISIT,
    salts: int = SALTS,
) -> DataFrame:
    """Write one record per row below ``path``; returns the committed files (file, records).

    Null payloads are empty; a null or empty url becomes the page's own name. Repeated rows
    give repeated records; an empty table gives no file. Other columns are ignored. Names of
    files carry the attempt that wrote them, and only committed attempts are returned.
    """

    def write(batches):
        import gzip
        import uuid

        import pyarrow as pa

        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, count, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = create(name)
                raw = record(row["page"], row["url"], row["payload"], row["digest"], row["refers_to"])
                member = gzip.compress(raw, 5, mtime=0)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((name, count))
        if out is not None:
            out.close()
            done.append((name, count))
        if done:
            yield pa.RecordBatch.from_pydict({"file": [n for n, _ in done], "records": [c for _, c in done]})

    marked = mark_revisits(pages, id_col, url_col, payload_col, least, salts)
    marked.mapInArrow(write, "file string, records long").write.parquet(f"{path}/files")
    return pages.sparkSession.read.schema("file string, records long").parquet(f"{path}/files")


class Damaged(Exception):
    """A check failed; the message names it."""


def parse_record(data: bytes, at: int = 0, last: bool = True) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record that starts at ``at``, or Damaged.

    ``last`` says that ``data`` ends with the file, so nothing can be missing.
    """
    import hashlib

    if not data.startswith(b"WARC/1.", at):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", at, at + MOST_HEADER)
    if head_end < 0:
        raise Damaged("no end of headers")
    headers = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        name = key.decode("latin-1").lower()
        if name in headers and name != "warc-concurrent-to":
            # The headers of a record that was cut run into those of the next one.
            raise Damaged("header given twice")
        headers[name] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        raise Damaged("no content length")
    start = head_end + 4
    end = start + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record is cut" if end + 4 > len(data) else "no line ends after the block")
    block = data[start:end]
    unsure = not headers.get("warc-block-digest", "").lower().startswith("sha256:")
    if unsure and end + 4 < len(data) and not data.startswith(b"WARC/1."[: len(data) - end - 4], end + 4):
        raise Damaged("no digest, and no record after the block")
    for kind, value in (("warc-block-digest", block), ("warc-payload-digest", None)):
        algorithm, _, digest = headers.get(kind, "").partition(":")
        if value is None:
            if headers.get("warc-type") != "response":
                continue
            value = block.partition(b"\r\n\r\n")[2]
        if algorithm.lower() == "sha256" and hashlib.sha256(value).hexdigest() != digest.lower():
            raise Damaged(f"{kind} differs")
    return headers, block, end + 4


class Pieces:
    """Random access to a file in chunks."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def ends(self, offset: int) -> bool:
        return offset >= self.size

    def at(self, offset: int, n: int = CHUNK) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def find(self, marks: tuple[bytes, ...], start: int) -> int:
        """Offset of the first of ``marks`` from ``start``, or the file's size."""
        longest = max(map(len, marks))
        while start < self.size:
            data = self.at(start, CHUNK + longest)
            hits = [i for i in (data.find(m) for m in marks) if i >= 0]
            if hits and min(hits) < CHUNK:
                return start + min(hits)
            start += CHUNK
        return self.size


class Inflated:
    """Content of the gzip member at ``offset``, inflated as far as it is asked for.

    What lies before the last offset given to ``drop`` or ``find`` is let go. When all is
    read, ``end`` is the offset after the member, or ``why`` says where it broke.
    """

    def __init__(self, pieces: Pieces, offset: int):
        import zlib

        self.pieces, self.next, self.inflate = pieces, offset, zlib.decompressobj(31)
        self.held, self.start = bytearray(), 0
        self.over, self.end, self.why = False, None, None

    def more(self) -> None:
        """Inflate a piece more, or set ``over``."""
        import zlib

        data = self.inflate.unconsumed_tail
        if not data:
            data = self.pieces.at(self.next)
            self.next += len(data)
        before = self.inflate.copy()
        try:
            out = self.inflate.decompress(data, CHUNK)
        except zlib.error as e:
            self.over, self.why = True, "member: " + str(e).partition(":")[2].strip()
            # A failed call keeps what it inflated to itself.
            for n in (4096, 64, 1):
                try:
                    while data:
                        step = before.copy()
                        self.held += step.decompress(data[:n])
                        before, data = step, data[n:]
                except zlib.error:
                    pass
            return
        self.held += out
        if self.inflate.eof:
            self.over, self.end = True, self.next - len(self.inflate.unused_data)
        elif not data and not out:
            self.over, self.why = True, "member is cut"

    def fill(self, stop: int) -> None:
        while not self.over and self.start + len(self.held) < stop:
            self.more()

    def at(self, offset: int, n: int = CHUNK) -> bytes:
        self.fill(offset + n)
        return bytes(self.held[offset - self.start : offset - self.start + n])

    def ends(self, offset: int) -> bool:
        self.fill(offset + 1)
        return offset >= self.start + len(self.held)

    def drop(self, offset: int) -> None:
        del self.held[: offset - self.start]
        self.start = offset

    def find(self, mark: bytes, start: int) -> int:
        """Offset of the first ``mark`` from ``start``, or the content's size."""
        while True:
            hit = self.held.find(mark, start - self.start)
            if hit >= 0:
                self.drop(self.start + hit)
                return self.start
            size = self.start + len(self.held)
            if self.over:
                return size
            start = max(start, size - len(mark) + 1)
            self.drop(min(start, size))
            self.more()


def opened(pieces: Pieces, offset: int) -> tuple[Inflated, int | None, str | None]:
    """(content, end, why) of the gzip member at ``offset``. A long one is inflated twice."""
    content = Inflated(pieces, offset)
    content.fill(4 * CHUNK)
    whole = content
    if not content.over:
        whole = Inflated(pieces, offset)
        while not whole.over:
            whole.more()
            whole.drop(whole.start + len(whole.held))
    return content, whole.end, whole.why


def inside(content: Inflated):
    """Yield (start, end, reason, headers, block), in inflated bytes, for records and gaps."""
    at, bad, why = 0, None, ""
    while not content.ends(at):
        try:
            headers, block, end = plain_record(content, at)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = content.find(b"WARC/1.", at + 1)
            continue
        if bad is not None:
            yield bad, at, why, None, None
            bad = None
        yield at, end, None, headers, block
        at = end
        content.drop(at)
    if bad is not None:
        yield bad, at, why, None, None


def plain_record(pieces: Pieces | Inflated, offset: int) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record at ``offset`` of plain or inflated bytes, or Damaged."""
    n = CHUNK
    while True:
        data = pieces.at(offset, n)
        try:
            headers, block, end = parse_record(data)
            if end + 7 <= len(data) or pieces.ends(offset + len(data)):
                return headers, block, offset + end
        except Damaged as e:
            # Only a record that runs past what was read deserves more of the file.
            if str(e) not in ("record is cut", "no end of headers"):
                raise
            if pieces.ends(offset + len(data)) or str(e) == "no end of headers" and n > MOST_HEADER:
                raise
        n *= 4


def salvage(file):
    """Yield (offset, length, reason, headers, block) for records (no reason) and gaps.

    Records and gaps together cover the file. A gap's reason is the check that failed
    where it begins. All that one member holds has the offset and length of the member, and
    a gap's reason then ends in its inflated bytes. A member that breaks is a gap; records
    from before the break come first, with the gap's offset and length 0.
    """
    import hashlib

    def digest(headers, block):
        return hashlib.sha256(repr(sorted(headers.items())).encode() + block).digest()

    pieces, at = Pieces(file), 0
    bad, why = None, ""
    #: Records from before the break, as a member may store their bytes as they are.
    known: set[bytes] = set()
    while at < pieces.size:
        if pieces.at(at, 2) == b"\x1f\x8b":
            content, end, broken = opened(pieces, at)
            length, passed, gaps = 0 if broken else end - at, False, []
            for a, b, reason, headers, block in inside(content):
                if reason is not None:
                    gaps.append((at, length, f"{reason}; inflated bytes {a} to {b}", None, None))
                    continue
                if not passed:
                    passed = True
                    if bad is not None:
                        yield bad, at - bad, why, None, None
                        bad = None
                    known.clear()
                yield from gaps
                gaps = []
                yield at, length, None, headers, block
                if broken:
                    known.add(digest(headers, block))
            if passed:
                yield from gaps
            if passed and not broken:
                at = end
                continue
            if bad is None:
                bad, why = at, broken or (gaps[0][2].partition(";")[0] if gaps else "empty member")
        else:
            try:
                headers, block, end = plain_record(pieces, at)
            except Damaged as e:
                if bad is None:
                    bad, why = at, str(e)
            else:
                if not known or digest(headers, block) not in known:
                    if bad is not None:
                        yield bad, at - bad, why, None, None
                        bad = None
                    known.clear()
                    yield at, end - at, None, headers, block
                at = end
                continue
        at = pieces.find((b"\x1f\x8b\x08", b"WARC/1."), at + 1)
    if bad is not None:
        yield bad, pieces.size - bad, why, None, None


def read_warc(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of archives named by ``files`` (column file), gzip or plain.

    Gaps have a reason and no record columns. Of a response, length and SHA-256 are those
    of the payload read; of a revisit, those its headers state. Files without bytes give
    no rows. Each file is one task's work, so files should be of bounded size.
    """

    def read(batches):
        import hashlib

        import pyarrow as pa

        names = [c.split()[0] for c in ROW.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in ROW.split(", ")]

        def rows(name):
            system, path = filesystem(name)
            with system.open_input_file(path) as file:
                for offset, length, reason, headers, block in salvage(file):
                    if reason is not None:
                        yield name, offset, length, reason, *[None] * 7
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = headers.get("warc-type")
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if kind == "revisit":
                        stated = [x.split(b":")[1] for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")]
                        size = int(stated[0]) if stated and stated[0].strip().isdigit() else None
                        digest = headers.get("warc-payload-digest", "").partition(":")[2] or None
                    yield (
                        name, offset, length, None, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"),
                        headers.get("warc-refers-to"), size, digest, payload if keep_payload else None,
                    )

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held), kinds)], names=names)

        for files_batch in batches:
            for name in files_batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(name):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 4 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    n = max(1, files.count())
    return files.select("file").repartitionByRange(n, "file").mapInArrow(read, ROW)


SQL = f"""
WITH facts AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM facts),
marked AS (SELECT *, payload_bytes >= {LEAST_REVISIT} AND first <> page_id AS again FROM first)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM marked
"""


@query(SQL)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC archives, read back by the salvage reader."""
    files = write_warc(table(spark, folder, "pages"), scratch_dir(spark, "warc"))

    def page(column: str):
        return F.regexp_extract(column, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")

    return (
        read_warc(files, keep_payload=False)
        .filter("reason is null")
        .select(
            page("record_id").alias("page_id"), "payload_bytes", "payload_digest",
            F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
        )
    )
