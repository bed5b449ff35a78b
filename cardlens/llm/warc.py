"""WARC archives: writing with deduplicated payloads, reading with
boundary-chain verification.

Writing.  Each row becomes a record; of equal payloads (``LEAST`` bytes or
more) the smallest page is a ``response``, others are ``revisit`` records that
name it.  Records are UTF-8 text, so Spark's text writer lays them down on any
file system Spark knows, one archive per task, with its commit protocol.

Every record has the fields that the standard asks of all records (type, id,
date, length).  A record that others may revisit is named by page and payload,
and the revisits name it so; all others also have a number, which tells rows
that share a page apart.

Reading.  Spark's text reader splits the archives at the magic line, wherever a
file was split for a task, and so also at magic lines inside payloads.  Each
task emits *candidates*: place of the magic line and place where the record
that its header declares would end.  Sums of the pieces' lengths per file split
give absolute places.  Pointer jumping over the candidate-to-successor links,
from the start of each file, keeps the reachable ones: these are the records.
A record that ends with its piece was digested where it was read; one whose
payload holds magic lines is put together from its pieces.

Defined cases: a null html is an empty payload; rows with a null page_id are
written and read with a null id and are never revisited; rows that share page
and payload are each a response (and share a record id if others refer to it); control characters in a url are left out and
blanks are written as %20; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.llm.common import read, small_batches, stored
from cardlens.session import checkpoint_root

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LEAST = 100
#: Records of one archive at most; bounds a file and the rounds of jumping.
PER_FILE = 20_000


def with_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, named): ``named`` rows are
    those that others refer to."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    firsts = stored(rows.where(F.octet_length("payload") >= LEAST).groupBy("digest")
                    .agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"))
                    .where("_first < _last").select(F.col("digest").alias("_d"), "_first"))
    # no hint: Spark broadcasts the repeated digests if their measured size is small
    again = F.col("page_id") > F.col("_first")
    return rows.join(firsts, F.col("digest") == F.col("_d"), "left").select(
        "page_id", "url", "payload", "digest", F.when(again, F.col("_first")).alias("refers_to"),
        F.coalesce(F.col("page_id") == F.col("_first"), F.lit(False)).alias("named"))


def _urn(page: Column, number: Column | None = None) -> Column:
    parts = [F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"),
             F.substring("digest", 1, 16)]
    return F.concat(*parts, *([F.lit(":"), number.cast("string")] if number is not None else []),
                    F.lit(">"))


def write_archives(pages: DataFrame, folder: str, date: datetime | None = None) -> None:
    """``date``: when the pages were taken (default: now)."""
    rows = with_types(pages)
    when = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), size, F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = F.when(F.col("named"), _urn(F.col("page_id"))).otherwise(
        _urn(F.col("page_id"), F.monotonically_increasing_id()))
    url = F.replace(F.coalesce(F.regexp_replace("url", "[\\x00-\\x1f\\x7f]", ""), F.lit("")),
                    F.lit(" "), F.lit("%20"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name, F.lit(f"\r\nWARC-Date: {when}"),
        F.when(url == "", F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), url)),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "),
                                 _urn(F.col("refers_to")),
                                 F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/"
                                       "revisit/identical-payload-digest")))
        .otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END))
    (rows.select(F.concat(head, block).alias("value")).write
     .option("lineSep", END).option("maxRecordsPerFile", PER_FILE).text(folder))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(file, split, value): what stands between magic lines, in file order
    within a task."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"))


def parse(value: bytes) -> dict | None:
    """Fields of a record whose magic line stood before ``value``, or None if no
    header with a length begins there."""
    h = value.find(b"\r\n\r\n")
    if h < 0:
        return None
    fields = {}
    for line in value[:h].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        fields[k.strip().lower()] = v.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        return None
    return {"head": h + 4, "length": int(length), **{k.decode("latin-1"): v.decode(
        "utf-8", "replace") for k, v in fields.items()}}


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
    return int(text) if text.lstrip("-").isdigit() else None


def describe(value: bytes, record: dict) -> dict:
    """What a whole record (from after its magic line) says about its page."""
    block = value[record["head"]:record["head"] + record["length"]]
    h = block.find(b"\r\n\r\n")
    payload = block[h + 4:]
    stated = record.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = record.get("warc-type", "")
    if kind == "revisit":
        size = [int(x.split(b":")[1]) for x in block[:h].split(b"\r\n")
                if x.lower().startswith(b"content-length:")]
        n, digest = (size or [0])[0], stated
    else:
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
    refers = record.get("warc-refers-to")
    return {"page_id": _page(record.get("warc-record-id", "")),
            "url": record.get("warc-target-uri", ""), "payload_bytes": n,
            "payload_digest": digest, "record_type": kind,
            "refers_to": _page(refers) if refers else None, "intact": digest == stated}


_PAGE = pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("intact", pa.bool_())])
_PAGE_SQL = ("struct<page_id:long,url:string,payload_bytes:long,payload_digest:string,"
             "record_type:string,refers_to:long,intact:boolean>")


def _placed(batches: Iterator[pa.RecordBatch]
            ) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes]]]:
    """Each piece's place relative to the first piece of its file split."""
    now, place = None, 0
    for batch in batches:
        values = batch.column(2).to_pylist()
        at = []
        for file, split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                      values):
            if (file, split) != now:
                now, place = (file, split), 0
            at.append(place)
            place += len(value) + len(MAGIC)
        yield batch, at, values


def candidates(pieces: DataFrame) -> DataFrame:
    """(file, split, at, size, span, page): every piece with its place in the
    split, its length, the length its record would have after the magic line
    (null if none begins there), and the page if the record ends with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, values in _placed(batches):
            spans, pages = [], []
            for value in values:
                record = parse(value)
                span = record and record["head"] + record["length"] + len(END)
                spans.append(span)
                pages.append(describe(value, record) if record and span == len(value) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.int64()),
                 pa.array([len(v) for v in values], pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(pages, _PAGE)], names=["file", "split", "at", "size", "span", "page"])
    return pieces.mapInArrow(run, "file long, split long, at long, size long, span long, page "
                             + _PAGE_SQL)


def reachable(links: DataFrame) -> DataFrame:
    """(file, o) of the candidates of ``links(file, o, next)`` on the chain that
    starts at 0, by pointer jumping: in round k every candidate points 2^k
    records ahead, and whatever a reached one points at is reached."""
    now = stored(links.select("file", "o", F.col("next").alias("to"),
                              (F.col("o") == 0).alias("on")))
    while not now.where("on and `to` is not null").isEmpty():
        ahead = now.select(F.col("file").alias("_f"), F.col("o").alias("_o"),
                           F.col("to").alias("_to"))
        reached = now.where("on").select(F.col("file").alias("_g"), F.col("to").alias("_r"))
        now = stored(
            now.join(ahead.hint("shuffle_merge"), (now["file"] == F.col("_f"))
                     & (now["to"] == F.col("_o")), "left")
            .join(reached.hint("shuffle_merge"), (now["file"] == F.col("_g"))
                  & (now["o"] == F.col("_r")), "left")
            .select("file", "o", F.col("_to").alias("to"),
                    (F.col("on") | F.col("_r").isNotNull()).alias("on")))
    return now.where("on").select("file", "o")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, intact (the digest is the one the record states)."""
    small_batches(spark)
    found = stored(candidates(_pieces(spark, folder)))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = stored(found.groupBy("file", "split")
                    .agg(F.sum(F.col("size") + len(MAGIC)).alias("_s"))
                    .select(F.col("file").alias("_f"), F.col("split").alias("_p"),
                            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base")))
    placed = stored(found.join(splits, (found["file"] == splits["_f"])
                               & (found["split"] == splits["_p"]))
                    .select("file", "split", "at", (F.col("at") + F.col("_base")).alias("start"),
                            "size", "span", "page"))
    # the magic line stands before the piece; a file's first piece has none
    heads = placed.where(F.col("start") >= len(MAGIC)).select(
        "file", (F.col("start") - len(MAGIC)).alias("o"), "start", "size", "span", "page")
    whole = heads.where("span is not null")
    records = reachable(whole.select("file", "o", (F.col("start") + F.col("span")).alias("next")))
    named = records.select(F.col("file").alias("_f"), F.col("o").alias("_o"))
    kept = stored(whole.join(named.hint("shuffle_merge"), (F.col("file") == F.col("_f"))
                             & (F.col("o") == F.col("_o"))).drop("_f", "_o"))
    out = kept.where("page is not null").select("page.*")
    if kept.where("page is null").isEmpty():
        return out

    # payloads that hold magic lines: fetch their pieces (Spark broadcasts the
    # list of pieces if its measured size is small) and put them together
    marks = kept.select(F.col("file").alias("_f"), F.col("start").alias("_a"),
                        F.col("page").isNull().alias("_m"))
    so_far = W.partitionBy("file").orderBy("start")
    wanted = stored(placed.select("file", "split", "at", "start")
                    .join(marks.hint("shuffle_merge"), (F.col("file") == F.col("_f"))
                          & (F.col("start") == F.col("_a")), "left")
                    .withColumn("record", F.last("_a", True).over(so_far))
                    .withColumn("_m", F.last("_m", True).over(so_far)).where("_m")
                    .select(F.col("file").alias("_f"), F.col("split").alias("_p"),
                            F.col("at").alias("_at"), "start", "record"))

    def with_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, _ in _placed(batches):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "at"])
    again = _pieces(spark, folder).mapInArrow(
        with_place, "file long, split long, value binary, at long")
    parts = again.join(wanted, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_p"))
                       & (F.col("at") == F.col("_at")))

    def join_parts(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("start").to_pylist(), table.column("value").to_pylist()))
        value = MAGIC.encode().join(v for _, v in rows)
        return pa.Table.from_pylist([describe(value, parse(value))],
                                    schema=pa.schema(list(_PAGE)))
    joined = (parts.select("file", "record", "start", "value").groupBy("file", "record")
              .applyInArrow(join_parts, _PAGE_SQL.removeprefix("struct<").removesuffix(">")
                            .replace(":", " ").replace(",", ", ")))
    return out.unionByName(joined)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark).rstrip('/')}/archives/{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
