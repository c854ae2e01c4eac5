r"""WARC archives: write captures as request, response or revisit, and metadata records; read and assemble them again.

A record is one string of bytes, and Spark's text writer ends each with the blank lines that end a record, so archives
are written by tasks to any file system Spark knows, compressed as a whole. The reader takes files of any writer, also
with a compressed member per record, and finds records by their lengths, not by their text. Only behind a broken place
it looks for the next line that opens a record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.workers import ship, tidied
from tickloom.session import written, written_counted

END = "\r\n\r\n"
MIN_REVISIT_BYTES = 1000
#: Captures up to so many bytes, and records of such captures (three each) in a file: some 128 MB before compression.
SIZE_CLASSES = ((1 << 16, 6000), (1 << 22, 96), (None, 3))
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 16
_FLUSH = 1 << 23
#: An archive comes to its reader in pieces of so many bytes, or in so many pieces if it is longer.
_PIECE, _PIECES = 1 << 22, 16
_LONGEST_HEAD = 1 << 20
_HEAD, _MEMBER = b"WARC/", b"\x1f\x8b\x08"


def _record_id(kind: str, key: str = "key") -> Column:
    """Record id that follows from a page's key and payload."""
    digest = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col(key).cast("string"), F.lit("none")), "digest"))
    parts = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def captures(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """``key, uri, payload, digest, size, refers_to``: of equal payloads of at least 1000 bytes the largest key is answered.

    ``digest`` is the payload's SHA-1. The others of such a group name that key in ``refers_to``. Only digests, sizes
    and keys are shuffled to find the groups, combined before; a group of any size is one small row. The revisits, keys
    and digests only, are written once. Rows that share the largest key of a group are all answered.
    Control characters of addresses are escaped; a null payload is empty, a null key revisits what a group answers.
    """
    body = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    address = F.regexp_replace(F.coalesce(pages[uri], F.lit("")), r"[\x00-\x20\x7f]", "%20")
    named = pages.select(pages[key].alias("key"), address.alias("uri"), body.alias("payload"))
    named = named.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    large = named.filter(F.col("size") >= MIN_REVISIT_BYTES).select("key", "digest")
    groups = large.groupBy("digest").agg(F.max("key").alias("answered"), F.count("*").alias("n"))
    shared = groups.filter("n > 1").select("digest", "answered")
    found = large.join(shared, "digest").filter("key < answered or key is null")
    found = found.select(F.col("key").alias("visit"), F.col("digest").alias("seen"), F.col("answered").alias("refers_to"))
    revisits = written(found.distinct(), "revisits")
    same = named["key"].eqNullSafe(F.col("visit")) & (named["digest"] == F.col("seen"))
    return named.join(revisits, same, "left").drop("visit", "seen")


def _block(kind: str, fields: list[tuple[str, Column]], content: Column) -> Column:
    """Bytes of one record, without the end. A field whose value is null is left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines).cast("binary"), F.lit(END).cast("binary"), content)


def records(captured: DataFrame) -> DataFrame:
    """``record`` bytes of three records per capture: a request and metadata concurrent to a response or revisit."""
    bytes_of = lambda text: text.cast("binary")
    revisit = F.col("refers_to").isNotNull()
    uri = ("WARC-Target-URI", F.when(F.col("uri") != "", F.col("uri")))
    answer = _record_id("response")
    host = F.coalesce(F.parse_url("uri", F.lit("HOST")), F.lit(""))
    asked = F.concat(F.lit("GET "), "uri", F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    request = _block(
        "request",
        [("WARC-Record-ID", _record_id("request")), ("WARC-Concurrent-To", answer), uri, ("Content-Type", F.lit("application/http; msgtype=request"))],
        bytes_of(asked),
    )
    status = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END)
    )
    common = [
        ("WARC-Record-ID", answer),
        uri,
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    response = _block("response", common, F.concat(bytes_of(status), "payload"))
    referred = [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _record_id("response", "refers_to"))]
    again = _block("revisit", common + referred, bytes_of(status))
    facts = F.concat(F.lit("page-id: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _block(
        "metadata",
        [("WARC-Record-ID", _record_id("metadata")), ("WARC-Concurrent-To", answer), uri, ("Content-Type", F.lit("application/warc-fields"))],
        bytes_of(facts),
    )
    all_three = F.array(request, F.when(revisit, again).otherwise(response), metadata)
    return captured.select(F.explode(all_three).alias("record"))


def write_archives(pages: DataFrame, folder: str, **columns: str) -> None:
    """Write all pages as archives, gzip files bounded in bytes, into a new folder.

    Small, large and very large captures (:data:`SIZE_CLASSES`) go to files of their own, so that as many records as a
    file takes are no more than some 128 MB, or one capture. The first pass sees the largest capture; a class without
    any is not looked for. Record ids follow from key and payload, so a task that runs again writes the same bytes.
    """
    weight = F.octet_length("payload").cast("long") + 5 * F.octet_length("uri")
    weighed = captures(pages, **columns).withColumn("weight", weight)
    sizes, above = Observation(), -1
    for number, (limit, most) in enumerate(SIZE_CLASSES):
        seen = weighed if number else weighed.observe(sizes, F.max("weight").alias("largest"))
        fits = F.lit(True) if limit is None else F.col("weight") <= limit
        rows = records(seen.filter((F.col("weight") > above) & fits)).select(F.col("record").cast("string").alias("value"))
        files = rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most)
        files.text(f"{folder}/{number}")
        if limit is None or (sizes.get["largest"] or 0) <= limit:
            return
        above = limit


def _inflated(content: bytes | bytearray) -> Iterator[bytes | None]:
    """The bytes of a file that is plain, or one or several gzip members.

    Where compressed data is broken stands ``None``; then come the members behind the start of the broken one.
    """
    if not content.startswith(_MEMBER[:2]) and _is_plain(content):
        yield content
        return
    at = 0
    while 0 <= at < len(content) and (content[at] or content[at:].strip(b"\0")):
        member, begin = zlib.decompressobj(31), at
        try:
            while not member.eof and begin < len(content):
                if part := member.decompress(content[begin : begin + _READ]):
                    yield part
                begin += _READ
        except zlib.error:
            pass
        if member.eof:
            at = min(begin, len(content)) - len(member.unused_data)
            continue
        yield None
        at = _next_member(content, at + 1)


def _next_member(content: bytes, at: int) -> int:
    """Where the next gzip member that can be read begins; -1 without any."""
    at = content.find(_MEMBER, at)
    while at >= 0 and not _opens(content, at):
        at = content.find(_MEMBER, at + 1)
    return at


def _is_plain(content: bytes) -> bool:
    """Of a file that does not start as a gzip member: whether a line opens a record before any member begins."""
    member = -1 if content.startswith(_HEAD) else _next_member(content, 0)
    return member < 0 or b"\n" + _HEAD in content[:member]


def _opens(content: bytes, at: int) -> bool:
    """Whether a gzip member seems to begin here: its first bytes can be read."""
    try:
        return bool(zlib.decompressobj(31).decompress(content[at : at + _READ]))
    except zlib.error:
        return False


class _Source:
    """Reads from chunks of bytes by length or up to a marker. ``None`` among the chunks is a break."""

    def __init__(self, chunks: Iterator[bytes | None]) -> None:
        self._chunks, self._held, self._at, self.broken = chunks, b"", 0, False

    def _more(self) -> bool:
        """Hold one more chunk; false at the end, and at a break until :meth:`next_head` has passed it."""
        while not self.broken:
            chunk = next(self._chunks, b"")
            if chunk is None:
                self.broken = True
            elif chunk:
                self._held, self._at = self._held[self._at :] + chunk, 0
                return True
            else:
                return False
        return False

    def up_to(self, marker: bytes, longest: int) -> bytes | None:
        while (found := self._held.find(marker, self._at)) < 0:
            if len(self._held) - self._at > longest or not self._more():
                return None
        taken, self._at = self._held[self._at : found], found + len(marker)
        return taken

    def exactly(self, size: int) -> bytes:
        """Fewer bytes only at the end or a break."""
        parts, missing = [], size
        while missing:
            part = self._held[self._at : self._at + missing]
            parts.append(part)
            self._at += len(part)
            missing -= len(part)
            if missing and not self._more():
                break
        return b"".join(parts)

    def give_back(self, taken: bytes) -> None:
        self._held, self._at = taken + self._held[self._at :], 0

    def skip_blank_lines(self) -> bool:
        """Go to the next byte that is no line break; false at the end or a break."""
        while True:
            while self._at < len(self._held) and self._held[self._at] in b"\r\n":
                self._at += 1
            if self._at < len(self._held):
                return True
            if not self._more():
                return False

    def _ahead(self, size: int) -> bytes:
        while len(self._held) - self._at < size and self._more():
            pass
        return self._held[self._at : self._at + size]

    def at_border(self) -> bool:
        """Whether a record may end here: blank lines follow, another record, or nothing that can be read."""
        return self._ahead(len(END)) == END.encode() or not self.skip_blank_lines() or _HEAD.startswith(self._ahead(len(_HEAD)))

    def next_head(self) -> bool:
        """Go to the next line that opens a record, past breaks; false at the end."""
        while True:
            found = self._held.find(b"\n" + _HEAD, self._at)
            if found >= 0:
                self._at = found + 1
                return True
            self._at = max(self._at, len(self._held) - len(_HEAD))
            if not self._more():
                if not self.broken:
                    return False
                self._held, self._at, self.broken = b"\n", 0, False


def _fields(lines: bytes) -> list[tuple[str, str]]:
    """Named fields; a line that starts with white space goes on with the one before."""
    found: list[list[str]] = []
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and found:
            found[-1][1] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            found.append([name.strip().lower(), value.strip()])
    return [(name, value) for name, value in found]


def parse_records(content: bytes | bytearray) -> Iterator[dict]:
    """The records of one archive.

    Behind what is broken (no head, a length that ends in the middle of something, compressed data that cannot be read)
    it goes on with the next line that opens a record, also one inside the bytes that a wrong length took, or the next
    member; ``problem`` tells of it in the record's row, or in a row of its own where no record can be told.
    """
    source = _Source(_inflated(content))
    while True:
        if not source.skip_blank_lines():
            if not source.broken:
                return
            yield {"problem": "broken data"}
            if not source.next_head():
                return
        head = source.up_to(END.encode(), _LONGEST_HEAD)
        version, _, rest = (head or b"").partition(b"\r\n")
        fields = _fields(rest)
        named = dict(reversed(fields))
        size = named.get("content-length", "")
        if not version.startswith(_HEAD) or not (size.isascii() and size.isdigit()):
            yield {"problem": "no record header"}
            if head is not None:
                source.give_back(head + END.encode())
            if not source.next_head():
                return
            continue
        block = source.exactly(int(size))
        problem = "truncated" if len(block) < int(size) else None if source.at_border() else "length differs"
        row = {
            "record_type": named.get("warc-type"),
            "record_id": named.get("warc-record-id"),
            "uri": named.get("warc-target-uri"),
            "concurrent_to": [value for name, value in fields if name == "warc-concurrent-to"],
            "refers_to": named.get("warc-refers-to"),
            "problem": problem,
        }
        payload, declared = block, None
        if named.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(END.encode())
            status, _, lines = top.partition(b"\r\n")
            declared = dict(_fields(lines)).get("content-length")
            code = status.split(b" ")[1:2]
            row["http_status"] = int(code[0]) if status.startswith(b"HTTP/") and code and code[0].isdigit() else None
        elif named.get("content-type", "").startswith("application/warc-fields"):
            row["fields"] = _fields(block)
        said = named.get("warc-payload-digest", "").removeprefix("sha1:")
        if row["record_type"] == "revisit":
            row |= {"payload_bytes": int(declared) if declared and declared.isdigit() else None, "payload_digest": said or None}
        else:
            row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}
            if said and said != row["payload_digest"]:
                row["problem"] = row["problem"] or "digest differs"
        yield row
        if problem:
            border = END.encode() + _HEAD
            inside = block.find(border)
            # The next record may also begin in the block's last bytes.
            source.give_back(block[inside:] if inside >= 0 else block[1 - len(border) :])
            if not source.next_head():
                return


_RECORD = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("refers_to", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_ARROW = {
    "record_type": pa.string(),
    "record_id": pa.string(),
    "uri": pa.string(),
    "concurrent_to": pa.list_(pa.string()),
    "refers_to": pa.string(),
    "http_status": pa.int32(),
    "fields": pa.map_(pa.string(), pa.string()),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "problem": pa.string(),
    "payload": pa.binary(),
}


def _pieces(files: DataFrame) -> DataFrame:
    """``path, piece, part``: the contents of binary files cut up, the pieces of a file in order behind each other.

    Whole values would stand in Arrow's memory, doubled as it grows, and twice in Python beside the file itself.
    """
    size = F.greatest(F.lit(_PIECE), F.ceil(F.col("length") / _PIECES))
    last = F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0))
    cut = files.select("path", "content", size.cast("int").alias("size"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
    return cut.select("path", "piece", F.substring("content", F.col("piece") * F.col("size") + 1, F.col("size")).alias("part"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytearray]]:
    """Path and content of each file, from its :func:`_pieces`; the content lasts until the next is asked for."""
    path, content = None, bytearray()
    for batch in batches:
        for of, piece, part in zip(*batch.columns):
            if piece.as_py() == 0:
                if path is not None:
                    yield path, content
                    content.clear()
                path = of.as_py()
            content += part.as_buffer()
    if path is not None:
        yield path, content


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all files in a folder. An archive is read by one task, record by record, and is one value
    of at most 2 GB before it is inflated, which the task's Python holds once.

    Digests are computed over what the archive holds; a revisit has those of its header. Of a repeated field in a
    ``warc-fields`` block the last value counts. A record without an id is named by its file and its place there.
    """
    ship(spark)
    names = [name for name in _ARROW if with_payload or name != "payload"]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        arrays = []
        for name in names:
            values = [row.get(name) for row in rows]
            if name == "fields":
                values = [None if v is None else list(dict(v).items()) for v in values]
            arrays.append(pa.array(values, _ARROW[name]))
        return pa.RecordBatch.from_arrays(arrays, names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _joined(batches):
            rows, held = [], 0
            for place, row in enumerate(parse_records(content)):
                if row.get("record_type") and not row["record_id"]:
                    row["record_id"] = f"{path}#{place}"
                rows.append(row)
                held += len(row.get("payload") or b"") + 500
                if held >= _FLUSH:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return _pieces(files).mapInArrow(tidied(parse), T.StructType([field for field in _RECORD.fields if field.name in names]))


def _owners(direct: DataFrame, rest: DataFrame) -> DataFrame:
    """``t, s``: the answers ``t`` that a record ``s`` reaches, one step of ``rest`` more each round until none is new.

    Without links between requests and metadata, as most writers leave it, no round is run.
    """
    if rest.isEmpty():
        return direct
    known = newest = direct
    while True:
        step = rest.withColumnRenamed("t", "mid").join(newest.select("t", F.col("s").alias("mid")), "mid").select("t", "s").distinct()
        newest, found = written_counted(step.join(known, ["t", "s"], "left_anti"), "owners")
        if not found:
            return known
        known = known.union(newest)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``answer`` (response, revisit or resource), ``requests``, ``metadata``.

    A request or metadata record belongs to the answer it is concurrent to, to an answer that names it, or to the answers
    of a record it is concurrent to, over any number of steps. One that belongs to none is a capture without an answer.
    Records that repeat an id of a request or metadata record count once; every answer gives a row. Records without a
    type are left out, and requests and metadata without an id, which :func:`read_archives` does not give. An empty
    table gives no rows. Give it a frame that reads stable files: it is joined several times, by ids and without payloads.
    """
    answer = F.col("record_type").isin("response", "revisit", "resource")
    answers = records.filter(answer)
    others = records.filter(~answer & F.col("record_type").isin("request", "metadata") & F.col("record_id").isNotNull())
    others = others.select("record_id", "record_type", "uri", "concurrent_to", "fields", "payload_bytes", "payload_digest", "problem")
    ids = answers.select(F.col("record_id").alias("t")).filter("t is not null").distinct()
    said = others.select(F.col("record_id").alias("s"), F.explode("concurrent_to").alias("t"))
    named = answers.select(F.explode("concurrent_to").alias("s"), F.col("record_id").alias("t"))
    links = said.union(named).filter("s is not null and t is not null").distinct()
    links = written(links.join(ids.select("t", F.lit(True).alias("direct")), "t", "left"), "links")
    owners = _owners(links.filter("direct").select("t", "s"), links.filter("direct is null").select("t", "s"))

    plain = others.groupBy("record_id").agg(
        *[F.any_value(name).alias(name) for name in ("record_type", "uri", "payload_bytes", "payload_digest", "problem")],
        F.any_value(F.map_entries("fields")).alias("fields"),
    )
    record = F.struct("record_id", "uri", "payload_bytes", "payload_digest", "problem", F.map_from_entries("fields").alias("fields"))
    owned = plain.join(owners, plain["record_id"] == owners["s"], "left")
    owner = F.coalesce(F.col("t"), F.col("record_id"))
    sides = owned.groupBy(owner.alias("owner")).agg(
        F.collect_list(F.when(F.col("record_type") == "request", record)).alias("requests"),
        F.collect_list(F.when(F.col("record_type") == "metadata", record)).alias("metadata"),
        F.any_value(F.col("t").isNull()).alias("alone"),
    )
    given = [name for name in records.columns if name != "concurrent_to"]
    nested = answers.select("record_id", F.struct(*given).alias("answer"))
    whole = nested.join(sides, nested["record_id"] == sides["owner"], "left")
    empty = F.array().cast(sides.schema["requests"].dataType)
    answered = whole.select("answer", *[F.coalesce(F.col(name), empty).alias(name) for name in ("requests", "metadata")])
    alone = sides.filter("alone").select(F.lit(None).cast(answered.schema["answer"].dataType).alias("answer"), "requests", "metadata")
    return answered.union(alone)


def page_transactions(captured: DataFrame) -> DataFrame:
    """Per capture with an answer: ``page_id, payload_bytes, payload_digest, record_type, refers_to, uri, problem``.

    The page's id stands in its metadata; ``refers_to`` is the id of the page whose response a revisit names.
    """
    page = F.get(F.filter("metadata", lambda m: m["fields"]["page-id"] != ""), F.lit(0))["fields"]["page-id"].cast("long")
    rows = captured.filter("answer is not null").select(page.alias("page_id"), "answer.*")
    named = rows.filter((F.col("record_type") == "response") & F.col("record_id").isNotNull())
    named = named.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("referred"))
    joined = rows.join(named, "refers_to", "left")
    return joined.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("referred").alias("refers_to"), "uri", "problem"
    )


def page_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages to archives in ``folder``, read these back and assemble the captures.

    Columns other than ``page_id``, ``url`` and ``html`` are not read. Null and repeated ids, null addresses and null
    texts are captures of their own (:func:`captures`); an empty table gives no rows.
    """
    write_archives(pages, folder)
    return page_transactions(assemble(written(read_archives(pages.sparkSession, folder, with_payload=False), "records")))
