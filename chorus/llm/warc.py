"""Operator 5, WARC: archives with revisit records and a two-level capture index.

``write_archives`` writes one WARC/1.1 record per page. Of the pages with equal payloads of at least
1000 bytes, the one with the largest page_id becomes a response, the others revisit records that
keep the HTTP header and name the response they refer to. ``read_archives`` parses the files again.
``build_index`` sorts the captures by reversed-host URL key into compressed blocks, with a sparse
directory of the blocks' first keys; ``lookup`` finds the block of every key by binary search in the
directory and reads those blocks only (a few are pushed into the scan as a filter); ``records_at`` then seeks into the
archives and reads the found records' byte ranges, neighbours in one read. The query takes digests and lengths from what these
range reads return; the pass that finds the records' places for the index hashes nothing.

Files are plain WARC: Spark's text writer stores each record as one line whose line break is the last
byte of the record's closing CR LF CR LF. So any file system that Spark reaches will do, and Spark's commit
protocol keeps exactly one copy of each file when tasks are retried.

Defined results: a null html is the empty payload; a null url is written as an empty target; a null
page_id is written as such and is smaller than any number; payloads below 1000 bytes are always
responses; rows that repeat page_id and payload are each written as that page's record; an empty table
gives no archive records and an empty result; other columns of the pages are not archived.

Scale: digests are compared, never payloads; only digests that occur twice are joined back, and the
rows of a digest are counted with partial sums, so a hot payload is no single task's work. The number
of records in a file follows their size (``FILES``), so that a file, which one task parses whole, stays below
about 130 MB, or holds one larger record. Index blocks are sorted by ranges of keys with equal keys split by
page, and the directory has one row per ``BLOCK`` captures; it is broadcast to a search only below a
measured size, otherwise joined by key ranges of its partitions. Range reads are dealt by file and ``STRETCH`` of it, so
neither a file nor a record that many entries name is gathered; a read holds at most ``READ`` bytes or one record.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.llm.shared import folder, stored

LEAST = 1000
# bytes of URL and payload up to which a record goes into files of so many records
FILES = ((64 << 10, 2000), (2 << 20, 64), (None, 1))
BLOCK = 2000
DIRECTORY_BYTES = 64 << 20
STRETCH = 32 << 20                  # bytes of a file whose wanted records are one group
READ = 4 << 20                      # bytes that one read takes from neighbouring records
GAP = 64 << 10                      # bytes between two records that are read over
FEW = 200                           # up to so many blocks are named in the scan's filter
DATE = "2026-01-01T00:00:00Z"       # one crawl time for all records of an archive


def url_key(url: Column) -> Column:
    """Reversed-host key: ``http://a.b.org/x?q`` gives ``org,b,a)/x?q``; null gives ``)/``."""
    rest = F.coalesce(F.regexp_replace(url.cast("string"), "^[^:/?#]*://", ""), F.lit(""))
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    tail = rest.substr(F.length(host) + 1, F.length(rest) + 1)
    tail = F.substring_index(tail, "#", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail == "", "/").otherwise(tail))


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1("html"))
    long = own.where(F.octet_length("html") >= LEAST)
    repeated = long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    joined = own.join(stored(repeated, "repeated"), "digest", "left")     # a measured size: few repeats move no payload
    refers = F.when((F.octet_length("html") >= LEAST) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def record(page_id: Column, url: Column, html: Column, digest: Column, refers_to: Column) -> Column:
    """A WARC record as text, without its very last line feed."""
    eol = "\r\n"
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.octet_length(html).cast("string"), F.lit(eol + eol))
    body = F.when(refers_to.isNull(), F.concat(http, html)).otherwise(http)
    name = F.coalesce(page_id.cast("string"), F.lit("null"))
    return F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: "), F.when(refers_to.isNull(), "response").otherwise("revisit"),
        F.lit(f"{eol}WARC-Record-ID: <urn:page:"), name, F.lit(f">{eol}WARC-Date: {DATE}{eol}WARC-Target-URI: "), clean,
        F.lit(f"{eol}WARC-Payload-Digest: sha1:"), digest,
        F.when(refers_to.isNull(), "").otherwise(F.concat(
            F.lit(f"{eol}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{eol}WARC-Refers-To: <urn:page:"),
            F.coalesce(refers_to, F.lit(0)).cast("string"), F.lit(">"))),
        F.lit(f"{eol}Content-Type: application/http;msgtype=response{eol}Content-Length: "), F.octet_length(body).cast("string"),
        F.lit(eol + eol), body, F.lit("\r\n\r"))


def write_archives(pages: DataFrame, path: str | None = None, files: tuple[tuple[int | None, int], ...] = FILES) -> str:
    """Write the pages as WARC files; returns the folder. Records of each size class of ``files`` are
    written by a job of their own, so one long page does not cut all files short; classes above the longest
    page are skipped."""
    path = path or folder(pages.sparkSession, "warc")
    rows = with_roles(pages)
    size = F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0))
    longest = pages.agg(F.max(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("url").cast("string")), F.lit(0)))).first()[0] or 0
    low = -1
    for most, per_file in files:
        part = rows if low < 0 else rows.where(size > low)
        if most is not None and longest > most:
            part = part.where(size <= most)
        lines = part.select(record(*[F.col(c) for c in ("page_id", "url", "html", "digest", "refers_to")]).alias("value"))
        lines.write.mode("error" if low < 0 else "append").option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)
        if most is None or longest <= most:
            break
        low = most
    return path


CAPTURE = T.StructType([T.StructField(n, t) for n, t in (
    ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()),
    ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("sound", T.BooleanType()),
    ("file", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()))])


def parse(data: bytes, at: int) -> tuple[dict[str, str], dict[str, str], memoryview, int]:
    """(record header, HTTP header, payload, end offset) of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    head = _fields(data[at:stop])
    begin = stop + 4
    end = begin + int(head["content-length"])
    cut = data.index(b"\r\n\r\n", begin, end) + 4
    return head, _fields(data[begin : cut - 4]), memoryview(data)[cut:end], end + 4


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return {"": lines[0]} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def _page(name: str | None) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(number[1]) if number else None


def facts(head: dict[str, str], http: dict[str, str], payload: memoryview, hashed: bool) -> tuple[str, int, str, bool]:
    """(type, payload length, payload digest, sound) of a record. A revisit has length and digest from its headers, a
    response from its payload if ``hashed``; ``sound`` says whether those agree with the headers."""
    kind, said, length = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    if kind != "response":
        return kind, length, said, True
    digest = hashlib.sha1(payload).hexdigest() if hashed else said
    return kind, len(payload), digest, digest == said and len(payload) == length


def read_archives(spark: SparkSession, path: str, hashed: bool = True) -> DataFrame:
    """One row per record: names, type, payload length and digest, file and byte range.

    A response's digest is taken from its payload, or from its header where not ``hashed``; ``sound``
    says whether payload and headers agree."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data, name, rows, at = content.as_buffer().to_pybytes(), file.as_py(), [], 0
                while at < len(data):
                    head, http, payload, end = parse(data, at)
                    kind, size, sha, sound = facts(head, http, payload, hashed)
                    rows.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), kind, size, sha, _page(head.get("warc-refers-to")),
                                 sound, name, at, end - at))
                    at = end
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (
                    pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()), strict=True)], CAPTURE.names)

    return files.mapInArrow(run, CAPTURE)


INDEX = T.StructType([T.StructField("block", T.StringType()), T.StructField("first", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())])
_FIELDS = ("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "sound", "file", "offset", "length")


def sort_key(key: Column, page_id: Column) -> Column:
    """Index key of a capture: URL key, then page; no key holds a tab or line break."""
    return F.concat(F.regexp_replace(key, r"[\t\r\n]", ""), F.lit("\t"), F.coalesce(page_id.cast("string"), F.lit("")))


def build_index(captures: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, directory) of the captures; stored in the shared folder.

    A block holds up to ``BLOCK`` lines ``key<TAB>page<TAB>fields`` in key order, deflated. The directory has
    the name and first key of each block."""
    spark = captures.sparkSession
    path = path or folder(spark, "cdx")
    lines = captures.select(sort_key(url_key(F.col("url")), F.col("page_id")).alias("key"),
                            F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _FIELDS[1:]]).alias("rest"))
    ordered = lines.repartitionByRange("key").sortWithinPartitions("key")

    def run(batches):
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows):
            text = "\n".join(f"{k}\t{r}" for k, r in rows).encode("utf-8")
            return pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{number:08d}"]), pa.array([rows[0][0]]), pa.array([len(rows)], pa.int32()),
                                               pa.array([zlib.compress(text, 6)], pa.binary())], INDEX.names)

        for batch in batches:
            held += zip(batch.column("key").to_pylist(), batch.column("rest").to_pylist(), strict=True)
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held, number = held[BLOCK:], number + 1
        if held:
            yield block(held)

    ordered.mapInArrow(run, INDEX).write.option("parquet.block.size", 1 << 20).parquet(path)
    blocks = spark.read.schema(INDEX).parquet(path)
    return blocks, stored(blocks.select("block", "first"), "directory")


def lookup(keys: DataFrame, blocks: DataFrame, directory: DataFrame) -> DataFrame:
    """Captures of the wanted index keys: ``keys`` has (key); gives one row per matching index line.

    A key may stand in the block whose first key is the last one not above it, and also in earlier
    blocks that begin with the same key; every such block is read."""
    spark = keys.sparkSession
    size = directory.agg(F.coalesce(F.sum(F.octet_length("first") + 40), F.lit(0)).alias("bytes")).first().bytes
    if not size:
        return keys.select("key", *[F.lit(None).cast(_type(c)).alias(c) for c in _FIELDS]).where(F.lit(False))
    wanted = keys.select("key").distinct()
    place = T.StructType([T.StructField("key", T.StringType()), T.StructField("block", T.StringType())])
    if size <= DIRECTORY_BYTES:
        rows = directory.orderBy("first", "block").collect()
        sent = spark.sparkContext.broadcast(([r.first.encode() for r in rows], [r.block for r in rows]))

        def search(batches):
            firsts, names = sent.value
            for batch in batches:
                out_k, out_b = [], []
                for key in batch.column("key").to_pylist():
                    raw = key.encode()
                    end = bisect.bisect_right(firsts, raw)
                    begin = max(0, bisect.bisect_left(firsts, raw, 0, end) - 1)
                    out_k += [key] * (end - begin)
                    out_b += names[begin:end]
                yield pa.RecordBatch.from_arrays([pa.array(out_k, pa.string()), pa.array(out_b, pa.string())], place.names)

        placed = wanted.mapInArrow(search, place)
    else:
        placed = _placed_by_ranges(wanted, directory)
    line = T.StructType([T.StructField("key", T.StringType()), *[T.StructField(c, _type(c)) for c in _FIELDS]])
    needed = placed.select("block").distinct()

    def inflate(batches):
        for batch in batches:
            for data in batch.column("data"):
                rows = [x.split("\t") for x in zlib.decompress(data.as_py()).decode("utf-8").split("\n")]
                columns = list(zip(*rows, strict=True))
                keys_out = [f"{k}\t{p}" for k, p in zip(columns[0], columns[1], strict=True)]
                typed = [pa.array(keys_out, pa.string())]
                for name, values in zip(_FIELDS, columns[1:], strict=True):
                    kind = _type(name)
                    if isinstance(kind, T.LongType):
                        typed.append(pa.array([int(v) if v else None for v in values], pa.int64()))
                    elif isinstance(kind, T.BooleanType):
                        typed.append(pa.array([v == "true" for v in values], pa.bool_()))
                    else:
                        typed.append(pa.array(values, pa.string()))
                yield pa.RecordBatch.from_arrays(typed, line.names)

    few = [r.block for r in needed.limit(FEW + 1).collect()]
    hit = blocks.where(F.col("block").isin(few)) if len(few) <= FEW else blocks.join(needed, "block", "left_semi")
    read = hit.select("data").mapInArrow(inflate, line)
    return read.join(wanted, "key", "left_semi")


def _placed_by_ranges(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """(key, block) for a directory too large to broadcast: every block that begins with the key, found by an equal
    join, and the last block that begins before it. For the latter keys and distinct first keys are merged in key order
    inside ranges; a range's first keys also enter through the last block of the range before, found from one row per range."""
    same = wanted.join(directory.select(F.col("first").alias("key"), "block"), "key")
    begins = directory.groupBy(F.col("first").alias("key")).agg(F.max("block").alias("block"))
    both = wanted.select(F.col("key"), F.lit(None).cast("string").alias("block")).unionByName(begins)
    both = both.repartitionByRange("key").sortWithinPartitions("key", F.col("block").asc_nulls_first())
    both = stored(both.withColumn("part", F.spark_partition_id()), "merged")
    last = {r.part: r.block for r in both.where("block is not null").groupBy("part").agg(F.max_by("block", F.struct("key", "block")).alias("block")).collect()}
    filled = sorted(r.part for r in both.select("part").distinct().collect())
    carried, now = [], None
    for p in filled:
        carried.append((p, now))
        now = last.get(p, now)
    starts = wanted.sparkSession.createDataFrame(carried, "part int, before string")
    order = Window.partitionBy("part").orderBy("key", F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("found", F.last("block", ignorenulls=True).over(order)).where("block is null")
    before = own.join(starts, "part", "left").select("key", F.coalesce("found", "before").alias("block")).where("block is not null")
    return before.unionByName(same)


def _type(name: str) -> T.DataType:
    return next(f.dataType for f in CAPTURE.fields if f.name == name)


def archive_file(uri: str) -> pa.NativeFile:
    """An archive file opened for reads at any offset, by the file system that its URI, as Spark gives it, names."""
    system, path = pyarrow.fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", uri), safe=":/@[]"))
    return system.open_input_file(path)


def neighbours(rows: list[tuple], most: int | None = None, gap: int | None = None) -> Iterator[list[tuple]]:
    """Rows (file, offset, length, ...), ordered by file and offset, in runs that one read serves."""
    most, gap = READ if most is None else most, GAP if gap is None else gap
    run, end = [], 0
    for row in rows:
        file, offset, length = row[:3]
        if run and (file != run[0][0] or offset > end + gap or max(end, offset + length) - run[0][1] > most):
            yield run
            run = []
        end = max(end, offset + length) if run else offset + length
        run.append(row)
    if run:
        yield run


def records_at(entries: DataFrame, keep: list[str], fields: list[T.StructField], of: Callable[[dict, dict, memoryview], tuple],
               open_file: Callable[[str], pa.NativeFile] = archive_file) -> DataFrame:
    """Columns ``keep`` of index entries with ``fields``, the values that ``of`` (record header, HTTP header, payload)
    gives for the record at each entry's ``file``, ``offset`` and ``length``.

    Tasks seek into the files that the entries name; entries that repeat a place are each answered. ``open_file`` serves file
    systems beyond those of Arrow."""
    shape = T.StructType([*[entries.schema[c] for c in keep], *fields])
    place = ["file", "offset", "length"]
    wanted = entries.select(*[F.col(c).alias(f"place_{c}") for c in place], *keep)
    dealt = wanted.repartition("place_file", F.floor(F.col("place_offset") / F.lit(STRETCH)).cast("long")).sortWithinPartitions("place_file", "place_offset")

    def run(batches):
        name, file = None, None
        try:
            for batch in batches:
                given = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
                for near in neighbours(list(zip(*given, strict=True))):
                    if near[0][0] != name:
                        if file is not None:
                            file.close()
                        name, file = near[0][0], open_file(near[0][0])
                    begin = near[0][1]
                    data = file.read_at(max(r[1] + r[2] for r in near) - begin, begin)
                    out = [(*row[3:], *of(*parse(data, row[1] - begin)[:3])) for row in near]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], shape.names)
        finally:
            if file is not None:
                file.close()

    arrow = [_ARROW[type(f.dataType)] for f in shape.fields]
    return dealt.mapInArrow(run, shape)


_ARROW = {T.LongType: pa.int64(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}


def read_records(entries: DataFrame) -> DataFrame:
    """(page_id, payload) of index entries, from their byte ranges; a revisit has an empty payload."""
    return records_at(entries, ["page_id"], [T.StructField("payload", T.BinaryType())], lambda head, http, payload: (bytes(payload),))


def checked(entries: DataFrame) -> DataFrame:
    """Index entries as their records show them, read by byte range: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to`` and ``sound``, which says whether digest, length and names agree in payload, headers and index."""
    own = entries.select("file", "offset", "length", *[F.col(c).alias(f"said_{c}") for c in ("page_id", "record_type", "refers_to")])
    fields = [T.StructField(n, _type(n)) for n in ("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "sound")]

    def of(head: dict, http: dict, payload: memoryview) -> tuple:
        kind, size, sha, sound = facts(head, http, payload, True)
        return _page(head["warc-record-id"]), kind, size, sha, _page(head.get("warc-refers-to")), sound

    read = records_at(own, ["said_page_id", "said_record_type", "said_refers_to"], fields, of)
    agree = [F.col(c).eqNullSafe(F.col(f"said_{c}")) for c in ("page_id", "record_type", "refers_to")]
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("sound") & agree[0] & agree[1] & agree[2]).alias("sound"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, index the archives' records, look every page up in the index and read its record by its byte range:
    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``sound``."""
    spark = pages.sparkSession
    own = pages.select("page_id", "url", "html")
    captures = stored(read_archives(spark, write_archives(own), hashed=False), "captures")
    blocks, directory = build_index(captures)
    clean = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "")
    keys = own.select(sort_key(url_key(clean), F.col("page_id")).alias("key"))
    return checked(lookup(keys, blocks, directory))

