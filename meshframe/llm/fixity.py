"""Merkle fixity audit of WARC archives and their replicas.

Records of an archive file lie one after another and are known by their offset ranges.  A leaf of
the file's tree hashes a record's range and content; a node hashes the range and the hashes of at
most ``FAN`` children, in order; the root stands for the file.  Replicas are compared by their roots;
only below roots that differ are children compared, level by level, down to the damaged records.

A level is one aggregation.  Files hold a bounded number of records, so no group is large, and only
hashes cross the network: records are hashed where they are read.  Records are put in order by a range
sort whose last key is unique, so one page id that holds a third of all rows is placed by many tasks.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import free_name, map_batches, needed, store, table

FAN, LEVELS = 8, 3
FILE_RECORDS = FAN**LEVELS
KEY = ["file", "part"]
DATE = "1970-01-01T00:00:00Z"
PACKED_BYTES = 1 << 14  # read of a gzip file at once: unpacked, they are a thousand times as many at most
HEAD_BYTES = 1 << 20  # where a record starts, its head ends within them
_LINE = "\r\n"


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """WARC records of ``pages`` (``page_id, url, html``): ``file, page_id, length, record``.

    File ``f`` takes the pages whose id divided by ``FILE_RECORDS`` is ``f``; pages without an id are
    spread over about a million negative files by a checksum.  Null urls and pages are empty.  The
    record id is made of the digest of url and page, so equal pages have equal records; the date is
    that of all records, since pages have none.
    """
    page = needed(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    name = F.sha2(F.concat(F.col("url"), F.lit("\n"), F.col("html")).cast("binary"), 256)
    uuid = F.concat_ws("-", *[F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    lines = ["WARC/1.0", "WARC-Type: resource", F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")), f"WARC-Date: {date}", F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    head = F.concat(F.concat_ws(_LINE, *[F.lit(x) if isinstance(x, str) else x for x in lines]), F.lit(2 * _LINE))
    record = F.concat(head.cast("binary"), body, F.lit(2 * _LINE).cast("binary"))
    file = F.when(F.col("page_id").isNull(), -1 - F.pmod(F.crc32(body), F.lit(1 << 20))).otherwise(F.floor(F.col("page_id") / FILE_RECORDS))
    return page.select(file.cast("bigint").alias("file"), "page_id", record.alias("record")).withColumn("length", F.octet_length("record").cast("bigint"))


def parsed(archive: DataFrame) -> DataFrame:
    """``archive`` with ``record_id, uri, declared`` (the content length that the head states) and ``content`` of its records.

    Columns are null where the record has no such line; ``content`` is null unless the record ends
    just after as many bytes as it declares, so a record that was cut or run together does not parse.
    """
    # the head is text up to the first empty line; Latin-1 keeps bytes and characters in step
    text = F.decode("record", "ISO-8859-1")
    at = F.instr(text, 2 * _LINE)
    head = F.decode(F.substring(F.col("record"), F.lit(1), F.greatest(at - 1, F.lit(0))), "UTF-8")
    at_, head_ = (free_name(archive.columns, x) for x in ("head_end", "head_text"))
    line = lambda name: F.nullif(F.regexp_extract(F.col(head_), rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1), F.lit(""))
    out = archive.withColumn(at_, at).withColumn(head_, head)
    out = out.withColumn("record_id", line("WARC-Record-ID")).withColumn("uri", line("WARC-Target-URI")).withColumn("declared", line("Content-Length").try_cast("bigint"))
    whole = (F.col(at_) > 0) & F.col(head_).startswith("WARC/") & (F.octet_length("record") == F.col(at_) + 3 + F.col("declared") + 4)
    content = F.substring(F.col("record"), F.col(at_) + 4, F.col("declared").cast("int"))
    return out.withColumn("content", F.when(whole, content)).drop(at_, head_)


def numbered(archive: DataFrame) -> DataFrame:
    """``archive`` written to the shared folder with ``number``, by which its rows are told apart, equal ones too."""
    return store(archive.withColumn("number", F.monotonically_increasing_id()), "warc-records")


def placed(archive: DataFrame) -> DataFrame:
    """Numbered records with their place: ``file, part, seq, offset, length, digest, page_id, number``, without the content.

    The order in a file is that of ``page_id`` (null first) and then the digest; records that are alike
    lie side by side.  What exceeds ``FILE_RECORDS`` in a file goes to further parts of it.
    """
    light = archive.select("file", "page_id", "number", "length", F.sha2("record", 256).alias("digest"))
    by = ["file", "page_id", "digest", "number"]
    # rows of a range are numbered by their place in it; the key is unique, so no range is large
    place = F.monotonically_increasing_id()
    low = F.lit((1 << 33) - 1).cast("bigint")
    sorted_ = light.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.shiftright(place, 33).cast("int").alias("_range"), place.bitwiseAND(low).alias("_at"))
    rows = store(sorted_, "warc-order")
    # a row for each file of a range: how many rows of the file lie before the range
    runs = rows.groupBy("file", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    rows = rows.join(runs, ["file", "_range"]).withColumn("_n", F.col("_at") + F.col("_shift"))
    rows = rows.withColumn("part", F.expr(f"_n div {FILE_RECORDS}").cast("int")).withColumn("seq", F.pmod(F.col("_n"), F.lit(FILE_RECORDS)).cast("int"))
    own = Window.partitionBy("file", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", "part", "seq", F.coalesce(F.sum("length").over(own), F.lit(0)).alias("offset"), "length", "digest", "page_id", "number")


def write_files(records_: DataFrame, index: DataFrame, folder: str, packed: bool = False) -> None:
    """The numbered records as WARC files ``<file>-<part>.warc`` in ``folder``, which pyarrow and all executors can open.

    ``packed`` files are ``<file>-<part>.warc.gz``, a gzip member a record.
    """
    rows = records_.select("number", "record").join(index.select("number", "file", "part", "seq"), "number")
    suffix = "warc.gz" if packed else "warc"

    def write(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, part = (k.as_py() for k in key)
        table_ = pa.Table.from_batches(list(batches)).sort_by("seq")  # at most FILE_RECORDS records
        with _opened(f"{folder}/{file}-{part}.{suffix}", "open_output_stream") as f:
            for x in table_.column("record"):
                f.write(gzip.compress(x.as_py(), mtime=0) if packed else x.as_py())
        yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int64())})

    rows.groupBy("file", "part").applyInArrow(write, "file bigint").count()


def _opened(path: str, how: str):  # noqa: ANN202
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return getattr(system, how)(at, compression=None)  # bytes as they lie, whatever the name


def _read_records(f, size: int) -> Iterator[tuple[int, int, str]]:  # noqa: ANN001
    """Offsets, lengths and digests of the records of an open file; where no record starts, all that is left is one."""
    at, held = 0, b""
    while at < size:
        end = -1
        while (end := held.find(b"\r\n\r\n")) < 0 and len(held) < HEAD_BYTES and (more := f.read(1 << 16)):
            held += more
        head = held[: max(end, 0)]
        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head) if head.startswith(b"WARC/") else None
        n = end + 4 + int(length.group(1)) + 4 if length else size - at
        n = min(n, size - at)
        digest, left = hashlib.sha256(held[:n]), n - len(held)
        while left > 0 and (more := f.read(min(left, 1 << 20))):
            digest.update(more)
            left -= len(more)
        yield at, n, digest.hexdigest()
        at, held = at + n, held[n:]


def _read_members(f, size: int) -> Iterator[tuple[int, int, str]]:  # noqa: ANN001
    """Offsets, lengths and digests of the members of an open gzip file; the digest is that of the unpacked record.

    What cannot be unpacked, or ends early, is one with all that follows, by the digest of its bytes as they lie.
    """
    at, held = 0, b""
    while at < size:
        unpack, plain, raw, n = zlib.decompressobj(31), hashlib.sha256(), hashlib.sha256(), 0
        while not unpack.eof and (piece := held or f.read(PACKED_BYTES)):
            try:
                plain.update(unpack.decompress(piece))
            except zlib.error:
                raw.update(piece)
                while more := f.read(1 << 20):
                    raw.update(more)
                yield at, size - at, raw.hexdigest()
                return
            held = unpack.unused_data
            raw.update(piece[: len(piece) - len(held)])
            n += len(piece) - len(held)
        if n == 0:  # the file is shorter than it was when it was listed
            return
        yield at, n, (plain if unpack.eof else raw).hexdigest()
        at += n


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file`` (its name), ``part, seq, offset, length, digest`` of the records of all WARC files of ``folder``.

    A file is read as a stream by one task, record by record, and hashed as it is read, so that records
    of any length are never held whole.  A name that ends in ``.gz`` is a file of gzip members, a record
    each: ``offset`` and ``length`` are those of the member in the file, and ``digest`` that of the record.
    What does not parse as a record, or as a member, is one with all that follows it in its file.  Empty
    files have no records.
    """
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    files = sorted((f.base_name, f.size) for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File)
    listed = spark.createDataFrame(files, "file string, size long").repartition(max(1, len(files)), "file")
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(f"{folder}/{name}", "open_input_stream") as f:
                    read = _read_members if name.lower().endswith(".gz") else _read_records
                    for part, found in enumerate(batched(read(f, size), FILE_RECORDS)):
                        offsets, lengths, digests = zip(*found, strict=True)
                        yield {"file": [name] * len(found), "part": [part] * len(found), "seq": list(range(len(found))), "offset": offsets, "length": lengths, "digest": digests}

    return map_batches(listed, run, schema)


def audit_files(spark: SparkSession, own: str, other: str) -> DataFrame:
    """Records that differ between two folders of WARC files, as :func:`audit` gives them."""
    return audit(*[[store(x, "warc-tree") for x in tree(store(read_files(spark, folder), "warc-index"))] for folder in (own, other)])


def _hash(start: Column, end: Column, content: Column) -> Column:
    return F.sha2(F.concat(start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), content).cast("binary"), 256)


def tree(rows: DataFrame) -> list[DataFrame]:
    """The levels of all files' trees, leaves first: ``file, part, at, start, end, hash``; an empty table has empty levels."""
    end = F.col("offset") + F.col("length")
    levels = [rows.select(*KEY, F.col("seq").alias("at"), F.col("offset").alias("start"), end.alias("end"), _hash(F.col("offset"), end, F.col("digest")).alias("hash"))]
    for _ in range(LEVELS):
        below = levels[-1].withColumn("at", F.floor(F.col("at") / FAN).cast("int")).groupBy(*KEY, "at")
        children = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "hash"))), lambda c: c["hash"])
        found = below.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(children, "").alias("content"))
        levels.append(found.select(*KEY, "at", "start", "end", _hash(F.col("start"), F.col("end"), F.col("content")).alias("hash")))
    return levels


def audit(own: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """Leaves that differ between two trees: ``file, part, seq, start, end, hash, other_hash``.

    A hash is null where a replica lacks the record; ``start`` and ``end`` are those of the first tree,
    or else of the other.  Equal trees give no row.
    """
    differing = None
    for a, b in zip(reversed(own), reversed(other), strict=True):
        if differing is not None:
            parents = differing.select(*KEY, F.col("at").alias("parent"))
            a, b = (x.withColumn("parent", F.floor(F.col("at") / FAN).cast("int")).join(parents, [*KEY, "parent"], "left_semi").drop("parent") for x in (a, b))
        right = b.select(*KEY, "at", F.col("start").alias("other_start"), F.col("end").alias("other_end"), F.col("hash").alias("other_hash"))
        both = a.join(right, [*KEY, "at"], "full").where(~F.col("hash").eqNullSafe(F.col("other_hash")))
        differing = both.select(*KEY, "at", F.coalesce("start", "other_start").alias("start"), F.coalesce("end", "other_end").alias("end"), "hash", "other_hash")
    return differing.withColumnRenamed("at", "seq")


def replica_index(index: DataFrame, replica: DataFrame) -> DataFrame:
    """The index of an archive with the lengths and digests that the records of a replica have.

    ``replica`` has ``number, length, record``; records that it lacks are lacking here too, so that the
    audit reports them.
    """
    read = replica.select("number", F.octet_length("record").cast("bigint").alias("_length"), F.sha2("record", 256).alias("_digest"))
    return index.join(read, "number").select("file", "part", "seq", "offset", F.col("_length").alias("length"), F.col("_digest").alias("digest"), "page_id", "number")


def damaged(archive: DataFrame) -> DataFrame:
    """A replica with planted damage, to show that the audit finds it: the last byte of each record whose digest starts with ``00`` is ``!``."""
    hurt = F.concat(F.expr("substring(record, 1, cast(length as int) - 1)"), F.lit("!").cast("binary"))
    return archive.withColumn("record", F.when(F.sha2("record", 256).startswith("00"), hurt).otherwise(F.col("record")))


def report(index: DataFrame, replica: DataFrame) -> DataFrame:
    """Each record of the stored ``index`` with ``leaf, root, replica_root, damaged``, audited against the replica's index.

    ``replica_root`` is null where the replica lacks all records of a file.
    """
    own = [store(x, "warc-tree") for x in tree(index)]
    other = [store(x, "warc-tree") for x in tree(store(replica, "warc-index"))]
    hits = audit(own, other).select("file", "part", "seq", F.lit(True).alias("hit"))
    roots = own[-1].select(*KEY, F.col("hash").alias("root")).join(other[-1].select(*KEY, F.col("hash").alias("replica_root")), KEY, "left")
    leaves = own[0].select(*KEY, F.col("at").alias("seq"), "hash")
    out = index.join(leaves, [*KEY, "seq"]).join(hits, [*KEY, "seq"], "left").join(roots, KEY)
    return out.select("page_id", "file", "part", "seq", "offset", "length", F.col("hash").alias("leaf"), "root", "replica_root", F.coalesce("hit", F.lit(False)).alias("damaged"))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` as WARC records with their place, leaf hash and root, audited against a written replica with planted damage.

    Null urls and pages are empty.  Pages without an id lie in negative files; pages that share an id,
    with equal or other content, are records of their own, each audited against its own copy.  Very
    long pages are hashed where they are read.  Extra columns are left behind; without pages there are
    no rows.
    """
    archive = numbered(records(table(spark, sf_dir, "pages")))
    index = store(placed(archive), "warc-index")
    replica = store(damaged(archive), "warc-replica")
    return report(index, replica_index(index, replica))


QUERIES = {"op9_merkle": op9_merkle}


def _levels(name: str) -> str:
    node = "sha256(min(s)::varchar || '-' || max(e)::varchar || ':' || string_agg(h, '' order by s, e, h))"
    out = f"{name}1 as (select file, k // {FAN} k, min(s) s, max(e) e, {node} h from {name}0 group by all)"
    for i in range(2, LEVELS + 1):
        out += f",\n{name}{i} as (select file, k // {FAN} k, min(s) s, max(e) e, {node} h from {name}{i - 1} group by all)"
    return out


_CRLF = "chr(13) || chr(10)"
_NAME = "sha256(coalesce(url, '') || chr(10) || coalesce(html, ''))"
SQL = {
    "op9_merkle": f"""
with n as (select page_id, coalesce(url, '') url, coalesce(html, '') html, {_NAME} h from pages),
p as (select page_id, page_id // {FILE_RECORDS} file, 'WARC/1.0' || {_CRLF} || 'WARC-Type: resource' || {_CRLF}
    || 'WARC-Record-ID: <urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' || {_CRLF}
    || 'WARC-Date: {DATE}' || {_CRLF} || 'WARC-Target-URI: ' || url
    || {_CRLF} || 'Content-Length: ' || strlen(html) || {_CRLF} || {_CRLF} || html || {_CRLF} || {_CRLF} record from n),
q as (select page_id, file, strlen(record) n, sha256(record) d, sha256(left(record, length(record) - 1) || '!') bad from p),
r as (select *, (row_number() over (partition by file order by page_id, d) - 1)::int seq, coalesce(sum(n) over (partition by file order by page_id, d rows between unbounded preceding and 1 preceding), 0)::bigint s from q),
a0 as (select page_id, file, seq k, s, s + n e, sha256(s::varchar || '-' || (s + n)::varchar || ':' || d) h, d from r),
b0 as (select file, seq k, s, s + n e, sha256(s::varchar || '-' || (s + n)::varchar || ':' || case when starts_with(d, '00') then bad else d end) h from r),
{_levels("a")},
{_levels("b")}
select page_id, a0.file, 0::int part, a0.k seq, a0.s "offset", a0.e - a0.s length, a0.h leaf, a{LEVELS}.h root, b{LEVELS}.h replica_root, starts_with(d, '00') damaged
from a0 join a{LEVELS} using (file) join b{LEVELS} using (file)"""
}
