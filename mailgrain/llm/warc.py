"""WARC archives as a Python data source, and the archive of a table of pages with its copies as revisits.

``spark.read.format("mailgrain_warc")`` plans a partition for each group of files of together about ``partition_bytes``; a file is never
split, as nothing in a compressed one marks a record beyond doubt, and is read as a stream. Predicates on the record's type and on other
header columns (=, <=>, in, is null, starts with and so on) are pushed down: each record's headers are parsed first, and where they don't
pass, or no column of the declared schema needs the payload, the payload is neither inflated nor decoded, but stepped over: files written here
state each member's length in the gzip field "sl", plain files in Content-Length; other gzip files have to be inflated to find the next record.

The writer cuts files at ``file_bytes``. A task names its files by a new uuid, and the commit lists them in a file ``_committed-*``, which
readers go by, so what failed or repeated tasks leave behind is never read. Files go through pyarrow's file systems (file, hdfs, s3, gs).

``archive_pages`` makes the row with the smallest id of those with equal payloads a response, and the others revisits of it. Payloads are compared
by sha256; only ids, urls and digests are shuffled, and the payloads are scanned once to write the responses: rows that are not one are
taken out by an anti-join, which Spark broadcasts under its own threshold. A group of copies is counted before the shuffle and
joined with the one row of its owner from written tables, where Spark splits a hot group.

Defined results: a null payload is empty; rows equal in id, url and payload are one response, and revisits of it; a null id comes after all
others; payloads below ``min_bytes`` are responses; repeated rows give a record each; an empty table gives an archive without records; other columns
are not read. A record that can't be parsed, or whose payload is not that of its digest, is an error that names its file and place.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .common import shared_dir, table, written

FORMAT = "mailgrain_warc"
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_type string, payload_bytes long, payload binary"
#: Header of each column that has one of its own.
HEADERS = {
    "record_id": b"warc-record-id", "record_type": b"warc-type", "target_uri": b"warc-target-uri", "date": b"warc-date",
    "refers_to": b"warc-refers-to", "payload_digest": b"warc-payload-digest", "content_type": b"content-type",
}
KINDS = {"payload_bytes": pa.int64(), "payload": pa.binary()}
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 4 << 20


class Window:
    """Bytes of a file by place, through one block read ahead."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.block = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.start <= at and at + n <= self.start + len(self.block)):
            self.file.seek(at)
            self.start, self.block = at, self.file.read(max(n, BLOCK))
        return self.block[at - self.start : at - self.start + n]


def skip_length(head: bytes) -> tuple[int, int | None]:
    """(place of the deflated data, length of the member or None) of a gzip member's first bytes."""
    if head[2:3] != b"\x08":
        raise ValueError("not a deflated gzip member")
    flags, at, total = head[3], 10, None
    if flags & 4:
        (extra,) = struct.unpack_from("<H", head, 10)
        at, end = 12, 12 + extra
        while at + 4 <= end:
            name, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
            if name == b"sl" and n == 8:
                (total,) = struct.unpack_from("<I", head, at + 4)
            at += 4 + n
        at = end
    for flag in (8, 16):
        if flags & flag:
            at = head.index(b"\0", at) + 1
    return at + 2 * bool(flags & 2), total


class Member:
    """One gzip member: its first bytes are inflated as far as asked, the rest only when it is."""

    def __init__(self, window: Window, at: int):
        self.window, self.at = window, at
        head = window.get(at, min(window.size - at, 512))
        start, self.total = skip_length(head)
        self.data, self.inflate, self.next = b"", zlib.decompressobj(-15), at + start

    def more(self, n: int) -> bool:
        """Inflate until there are ``n`` bytes; False where there are no more."""
        parts, have = [self.data], len(self.data)
        while have < n and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self.window.get(self.next, min(self.window.size - self.next, 1 << 16))
                self.next += len(raw)
                if not raw:
                    raise ValueError("cut gzip member")
            parts.append(self.inflate.decompress(raw, max(n - have, 1 << 12)))
            have += len(parts[-1])
        self.data = b"".join(parts)
        return have >= n

    def end(self) -> int:
        """Where the next member starts."""
        if self.total is not None:
            return self.at + self.total
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self.window.get(self.next, min(self.window.size - self.next, 1 << 16))
                self.next += len(raw)
                if not raw:
                    raise ValueError("cut gzip member")
            self.inflate.decompress(raw, 1 << 20)
        return self.next - len(self.inflate.unused_data) + 8


class Plain:
    """A record of an uncompressed file, with the same interface."""

    def __init__(self, window: Window, at: int):
        self.window, self.at, self.data, self.total = window, at, b"", None

    def more(self, n: int) -> bool:
        self.data = self.window.get(self.at, min(n, self.window.size - self.at))
        return len(self.data) >= n

    def end(self) -> int:
        return self.at + self.total


def parse_headers(data: bytes) -> dict[bytes, bytes]:
    """Fields by name in lower case, the first of each."""
    first, *lines = data.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    out: dict[bytes, bytes] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def unchunked(data: bytes) -> bytes:
    """A body without its chunked transfer coding."""
    out, at = [], 0
    while True:
        line, _, _ = data[at : at + 64].partition(b"\r\n")
        n = int(line.split(b";")[0], 16)
        if not n:
            return b"".join(out)
        at += len(line) + 2
        out.append(data[at : at + n])
        at += n + 2


def entity(headers: dict[bytes, bytes], block: bytes) -> bytes:
    """The payload of a record's block: what follows the HTTP head, or all of it."""
    if not headers.get(b"content-type", b"").startswith(b"application/http"):
        return block
    head, blank, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"\ntransfer-encoding: chunked" in head.lower() and blank else body


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


class Wanted:
    """Pushed filters as tests of header values; null where a header is missing, as in SQL."""

    def __init__(self):
        self.tests: list[tuple[str, object]] = []

    @staticmethod
    def test(f):
        """A function of a value for a filter that can be decided by headers alone; None for others."""
        if isinstance(f, ds.Not):
            inner = Wanted.test(f.child)
            if inner is None or isinstance(f.child, (ds.EqualNullSafe, ds.IsNull, ds.IsNotNull, ds.Not)):
                return None
            return lambda v: v is not None and not inner(v)
        known = {
            ds.EqualTo: lambda v: v == f.value, ds.EqualNullSafe: lambda v: v == f.value, ds.In: lambda v: v in f.value,
            ds.StringStartsWith: lambda v: v.startswith(f.value), ds.StringEndsWith: lambda v: v.endswith(f.value), ds.StringContains: lambda v: f.value in v,
            ds.IsNull: lambda v: v is None, ds.IsNotNull: lambda v: v is not None,
        }.get(type(f))
        if known is None or isinstance(f, (ds.EqualNullSafe, ds.IsNull)):
            return known
        return lambda v: v is not None and known(v)

    def take(self, f) -> bool:
        """Whether the filter is decided here; then it holds for every record that is read."""
        column = (f.child if isinstance(f, ds.Not) else f).attribute
        test = self.test(f)
        if len(column) != 1 or column[0] not in HEADERS or test is None:
            return False
        self.tests.append((column[0], test))
        return True

    def passes(self, values: dict) -> bool:
        return all(test(values[c]) for c, test in self.tests)


def header_values(headers: dict[bytes, bytes]) -> dict:
    out = {c: v.decode("utf-8", "replace") if (v := headers.get(h)) is not None else None for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c].removeprefix("<").removesuffix(">") if out[c] is not None else None
    if out["payload_digest"] is not None:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
    return out


def read_records(file, size: int, wanted: Wanted, columns: list[str], name: str = ""):
    """Rows of the records that pass, each a dict; the payload is touched only where a column asks for it."""
    window, at = Window(file, size), 0
    deep = "payload" in columns or "payload_bytes" in columns
    while at < size:
        try:
            record = (Member if window.get(at, 2) == b"\x1f\x8b" else Plain)(window, at)
            want, cut = 2048, -1
            while cut < 0:
                whole = record.more(want)
                cut = record.data.find(b"\r\n\r\n")
                if cut < 0 and not whole:
                    raise ValueError("record without end of headers")
                want *= 2
            headers = parse_headers(record.data[:cut])
            length = int(headers[b"content-length"])
            if isinstance(record, Plain):
                record.total = cut + 8 + length
            values = header_values(headers)
            if wanted.passes(values):
                if deep:
                    stated = headers.get(b"x-payload-length")
                    if values["record_type"] == "revisit":
                        values |= {"payload": None, "payload_bytes": int(stated) if stated else None}
                    else:
                        if not record.more(cut + 4 + length):
                            raise ValueError("cut record")
                        payload = entity(headers, record.data[cut + 4 : cut + 4 + length])
                        digest = headers.get(b"warc-payload-digest", b"")
                        if digest.startswith(b"sha1:") and base32(hashlib.sha1(payload).digest()) != values["payload_digest"]:
                            raise ValueError("payload is not that of its digest")
                        values |= {"payload": payload, "payload_bytes": len(payload)}
                yield values
            if record.end() > size:
                raise ValueError("cut record")
            at = record.end()
        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
            raise ValueError(f"{name}, byte {at}: {e}") from e


def committed_files(path: str) -> list[tuple[str, int]]:
    """(uri, size) of an archive's files: those that its commits list, or all .warc and .warc.gz files where nothing was committed."""
    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = {f.base_name: f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=False)) if f.type == fs.FileType.File}
    lists = [f for n, f in found.items() if n.startswith("_committed-")]
    if lists:
        names = [n for f in lists for n in system.open_input_stream(f.path).read().decode().split("\n") if n]
    else:
        names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
    return [(f"{path.rstrip('/')}/{n}", found[n].size) for n in sorted(names)]


class FilesPartition(ds.InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns, self.wanted = options["path"], columns, Wanted()
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self):
        groups, size = [], 0
        for uri, n in committed_files(self.path):
            if not groups or size + n > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append((uri, n))
            size += n
        return [FilesPartition(g) for g in groups]

    def read(self, partition):
        kinds = {c: KINDS.get(c, pa.string()) for c in self.columns}
        rows: dict[str, list] = {c: [] for c in kinds}

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(rows[c], k) for c, k in kinds.items()], names=list(kinds))

        held = 0
        for uri, size in partition.files if partition is not None else ():
            system, at = fs.FileSystem.from_uri(uri)
            with system.open_input_file(at) as file:
                for values in read_records(file, size, self.wanted, self.columns, uri):
                    for c in kinds:
                        rows[c].append(values[c])
                    held += len(values.get("payload") or b"") + 512
                    if held > 8 << 20:
                        yield batch()
                        rows, held = {c: [] for c in kinds}, 0
        if held:
            yield batch()


@dataclass
class Written(ds.WriterCommitMessage):
    names: list


def record_bytes(row: dict) -> bytes:
    """A whole record: its headers, an HTTP head, and the payload unless it is a revisit."""
    text = lambda c: (row.get(c) or "").encode("utf-8")
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    size = row["payload_bytes"] if revisit else len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + text("record_type"), b"WARC-Record-ID: <" + text("record_id") + b">", b"WARC-Date: " + text("date")]
    if row["target_uri"] is not None:
        head.append(b"WARC-Target-URI: " + b"".join(text("target_uri").split()))
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <" + text("refers_to") + b">", b"X-Payload-Length: %d" % size]
    head += [b"WARC-Payload-Digest: sha1:" + text("payload_digest"), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member that states its own length and that of its content in the extra field "sl"."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 24 + len(body) + 8
    if max(total, len(data)) < 1 << 32:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data))
    else:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.packed, self.level, self.file_bytes = options.get("compression", "gzip") == "gzip", int(options.get("level", 6)), int(options.get("file_bytes", 64 << 20))

    def write(self, iterator):
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        names, file, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None or size >= self.file_bytes:
                    if file is not None:
                        file.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                    file, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = record_bytes(row)
                data = gzip_member(data, self.level) if self.packed else data
                file.write(data)
                size += len(data)
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages):
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        old = [f for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("_committed-")] if self.overwrite else []
        gone = [f"{root}/{n}" for f in old for n in system.open_input_stream(f.path).read().decode().split("\n") if n]
        with system.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}") as out:
            out.write("\n".join(n for m in messages if m is not None for n in m.names).encode())
        for path in [f.path for f in old] + gone:
            system.delete_file(path)

    def abort(self, messages):
        system, root = fs.FileSystem.from_uri(self.path)
        for n in (n for m in messages if m is not None for n in m.names):
            system.delete_file(f"{root}/{n}")


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        unknown = [c for c in schema.fieldNames() if c not in HEADERS and c not in KINDS]
        if unknown:
            raise ValueError(f"no such columns of a WARC record: {unknown}")
        return WarcReader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark push filters to Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, partition_bytes: int = 64 << 20) -> DataFrame:
    """Records of an archive; without the payload's columns among ``columns`` no payload is decoded."""
    register(spark)
    kinds = dict(f.split() for f in SCHEMA.split(", "))
    chosen = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format(FORMAT).schema(chosen).option("partition_bytes", partition_bytes).load(path)


def write_warc(records: DataFrame, path: str, mode: str = "append", compression: str = "gzip", file_bytes: int = 64 << 20) -> None:
    """Write records (record_id, record_type, target_uri, date, refers_to, payload_digest, payload_bytes, payload)."""
    register(records.sparkSession)
    columns = [f.split()[0] for f in SCHEMA.split(", ") if not f.startswith("content_type")]
    records.select(*columns).write.format(FORMAT).mode(mode).option("compression", compression).option("file_bytes", file_bytes).save(path)


def base32_of_hex(sha1: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them are four letters."""
    digits = [F.lpad(F.conv(F.substring(sha1, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, url: Column, digest: Column, n: Column) -> Column:
    """A page's id, the digest of its payload, a number among rows that are equal in both, and a hash of its url."""
    return F.concat_ws(":", F.lit("urn:x-page"), F.coalesce(page_id.cast("string"), F.lit("")), digest, n.cast("string"), F.lower(F.hex(F.xxhash64(url))))


def page_records(pages: DataFrame, date: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Records of a table of pages, for ``write_warc``: responses, and revisits of the first of equal payloads."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    src = src.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    keys = ["sha", "page_id", "url"]
    digest = base32_of_hex(F.sha1("payload"))
    uses = written(src.groupBy(*keys).agg(F.count("*").alias("n"), F.first(digest).alias("payload_digest"), F.first(F.octet_length("payload").cast("long")).alias("payload_bytes")))
    # The owner of equal payloads: the smallest id, then the smallest url.
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url"))
    owners = uses.groupBy("sha").agg(first.alias("owner"), F.sum("n").alias("all"), F.max("payload_bytes").alias("size")).filter((F.col("all") > 1) & (F.col("size") >= min_bytes))
    owners = written(owners.select("sha", "owner.page_id", "owner.url", F.lit(True).alias("owns")))
    own = owners.select("sha", F.col("page_id").alias("owner_id"), F.col("url").alias("owner_url"))
    is_owner = F.col("page_id").eqNullSafe(F.col("owner_id")) & F.col("url").eqNullSafe(F.col("owner_url"))
    copies = written(uses.join(own, "sha").select(*keys, "n", "payload_digest", "payload_bytes", "owner_id", "owner_url", is_owner.alias("owns")))

    def same(a: str, b: str) -> Column:
        return F.expr(" AND ".join(f"{a}.{k} <=> {b}.{k}" for k in keys))

    date_col, none = F.lit(date), F.lit(None).cast("string")
    # Of equal payloads one row is the response; below min_bytes all are, and rows equal in everything are told apart by where they lie.
    number = F.when(F.octet_length("payload") < min_bytes, F.monotonically_increasing_id()).otherwise(0)
    plain = src.alias("s").join(copies.filter("NOT (owns AND n = 1)").select(*keys).alias("c"), same("s", "c"), "left_anti")
    again = copies.filter("owns AND n > 1").select(*keys)
    if not again.isEmpty():  # rows that are equal in everything: one of them is the response
        twice = src.alias("s").join(again.alias("c"), same("s", "c"), "left_semi")
        plain = plain.select(*keys, "payload").unionByName(twice.groupBy(*keys).agg(F.first("payload").alias("payload")))
    plain = plain.withColumn("payload_digest", digest)
    responses = plain.select(
        record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"), number).alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), date_col.alias("date"),
        none.alias("refers_to"), "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("payload").cast("binary").alias("payload"),
    )
    later = copies.withColumn("k", F.explode(F.expr("sequence(if(owns, 1L, 0L), n - 1)"))).filter("NOT owns OR n > 1")
    revisits = later.select(
        record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("k")).alias("record_id"), F.lit("revisit").alias("record_type"), F.col("url").alias("target_uri"), date_col.alias("date"),
        record_id(F.col("owner_id"), F.col("owner_url"), F.col("payload_digest"), F.lit(0)).alias("refers_to"), "payload_digest", "payload_bytes", F.lit(None).cast("binary").alias("payload"),
    )
    return responses.unionByName(revisits)


def archive_pages(pages: DataFrame, path: str, date: str, min_bytes: int = 0, **columns: str) -> None:
    """Write a table of pages as an archive."""
    write_warc(page_records(pages, date, min_bytes, **columns), path)


def page_of(record: Column) -> Column:
    """The page's id in a record's id."""
    return F.split_part(record, F.lit(":"), F.lit(3)).try_cast("long")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    archive_pages(table(spark, sf_dir, "pages"), path, "2024-02-05T00:00:00Z")
    responses = read_warc(spark, path, ("record_id", "record_type", "payload")).filter("record_type = 'response'")
    full = responses.select(page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_warc(spark, path, ("record_id", "record_type", "refers_to", "payload_digest", "payload_bytes")).filter("record_type = 'revisit'")
    return full.unionByName(revisits.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to")))


_GROUP = "CAST('0x' || substr(h, 1 + 5 * i, 5) AS BIGINT)"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({0} >> {1}) & 31), 1)"
OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS lead FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, array_to_string([{' || '.join(_LETTER.format(_GROUP, s) for s in (15, 10, 5, 0))} FOR i IN range(8)], '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to FROM f
"""
