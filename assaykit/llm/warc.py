r"""WARC archives with segmented records: writing, and reassembly on reading.

Writing: a page is an HTTP response in chunked transfer framing. Blocks longer than ``segment`` bytes
become a first record and continuation records, which name it as their origin, count up and give the total
length at last; records are dealt over the archives at random, so continuations lie anywhere. Of pages
with equal payloads of at least ``least`` bytes one is a response and the others revisit it. Records end with
a blank line pair, which the text writer puts between rows, so Spark writes the archives itself.

Reading: archives are parsed by Content-Length; continuation records are grouped by origin and ordered by
segment number, their numbers and total length verified, the chunked framing decoded, and digests compared
with the headers. A revisit takes its payload's length from the record it refers to. Errors raise.

Defined cases: a null html is empty, a null url an empty URI; of equal payloads the largest page_id is the
response (rows repeated with it: one of them), a null page_id is the smallest; short payloads are always
responses; an empty table gives an empty result; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import spread_join, stored, table
from assaykit.session import shared_folder

LEAST, SEGMENT, CHUNK = 1000, 16_384, 4096
BATCH = 4 << 20
RECORDS = 500  # records of an archive, each of a segment at most: what one task holds of it
_END = "\r\n\r\n"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of a message in chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def _named(sha1: bytes) -> str:
    """A digest as headers name it."""
    return "sha1:" + base64.b32encode(sha1).decode()


def _digest(payload: bytes) -> str:
    return _named(hashlib.sha1(payload).digest())


def record(kind: str, name: str, block: bytes, **fields: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": "2024-01-01T00:00:00Z", **{k.replace("_", "-"): v for k, v in fields.items()}}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block


def page_name(row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=row)}>"


def page_records(row: int, page_id, url: str, html: bytes, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without the line pairs that end them."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    # white space has no place in a header's URI
    common = {"WARC_Target_URI": "".join(url.split()), "WARC_Payload_Digest": _digest(html), "X_Page": "" if page_id is None else str(page_id)}
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", page_name(row), http, **common, WARC_Profile=profile, WARC_Refers_To=page_name(refers_to))
        return
    block = http + chunked(html)
    if len(block) <= segment:
        yield record("response", page_name(row), block, **common)
        return
    yield record("response", page_name(row), block[:segment], **common, WARC_Segment_Number="1")
    for i, at in enumerate(range(segment, len(block), segment), 2):
        fields = {"WARC_Segment_Origin_ID": page_name(row), "WARC_Segment_Number": str(i)}
        if at + segment >= len(block):
            fields["WARC_Segment_Total_Length"] = str(len(block))
        yield record("continuation", f"<urn:uuid:{uuid.uuid5(uuid.UUID(int=row), str(i))}>", block[at : at + segment], **fields)


def _written(segment: int):
    """Records of pages, put out in batches of about BATCH bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made, held = [], 0
            for row, page_id, url, html, target in zip(pdf["row"], pdf["page_id"].astype("Int64"), pdf["url"], pdf["html"], pdf["target"].astype("Int64")):
                body = html.encode("utf-8", "surrogatepass")
                for one in page_records(row, None if page_id is pd.NA else int(page_id), url, body, None if target is pd.NA else int(target), segment):
                    made.append(one)
                    held += len(one)
                    if held >= BATCH:
                        yield pd.DataFrame({"record": made})
                        made, held = [], 0
            if made:
                yield pd.DataFrame({"record": made})

    return run


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, page_id, url, html, target): ``target`` is the row that a revisit refers to, null for responses."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("same", F.sha2("html", 256))
    long = rows.where(F.octet_length("html") >= least)
    first = long.groupBy("same").agg(F.max(F.struct("page_id", "row")).alias("top"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("same", F.col("top.row").alias("target")), "firsts")
    # only texts that have an equal are in the small table; short ones never are
    joined = spread_join(rows, first, "same", "left")
    return joined.select("row", "page_id", "url", "html", F.when(F.col("target") != F.col("row"), F.col("target")).alias("target"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    made = planned(pages, least).mapInPandas(_written(segment), "record binary")
    dealt = made.repartition(F.xxhash64("record"))
    one = dealt.select(F.col("record").cast("string").alias("value"))
    one.write.option("lineSep", _END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        start = end + 4
        stop = start + int(head["Content-Length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield head, archive[start:stop]
        at = stop + 4


def _page_of(head: dict[str, str]) -> int | None:
    return int(head["X-Page"]) if head["X-Page"] else None


def _payload(head: dict[str, str], block: bytes) -> tuple[bytes, str]:
    """The payload of a whole record, checked against its header, and its SHA-1 in hex."""
    http, _, body = block.partition(b"\r\n\r\n")
    payload = dechunked(body) if b"transfer-encoding: chunked" in http.lower() else body
    sha1 = hashlib.sha1(payload)
    if _named(sha1.digest()) != head["WARC-Payload-Digest"]:
        raise ValueError(f"{head['WARC-Record-ID']}: the payload is not the one that was archived")
    return payload, sha1.hexdigest()


_WHOLE = "name string, page_id long, record_type string, refers_to string, bytes long, sha1 string, payload binary"
_SEGMENT = "origin string, segment int, total long, block binary, digest string"
_READ = f"{_WHOLE}, {_SEGMENT}"
_FIELDS = [x.split()[0] for x in _READ.split(", ")]
_NUMBERS = {"page_id": "Int64", "segment": "Int32", "total": "Int64", "bytes": "Int64"}


def _frame(rows: list[tuple], fields: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=fields)
    return out.assign(**{c: out[c].astype(t) for c, t in _NUMBERS.items() if c in fields})


def _parsed(keep: bool):
    """Whole records as they are, segments as they lie; payloads only where ``keep`` asks for them."""
    none = (None,) * 5

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for head, block in parse(zlib.decompress(content, 47)):
                    name, kind = head["WARC-Record-ID"], head["WARC-Type"]
                    if "WARC-Segment-Number" in head:
                        page = _page_of(head) if kind == "response" else None
                        total = head.get("WARC-Segment-Total-Length")
                        origin = head.get("WARC-Segment-Origin-ID", name)
                        rows.append((name, page, kind, None, None, None, None, origin, int(head["WARC-Segment-Number"]), total and int(total), block, head.get("WARC-Payload-Digest")))
                    elif kind == "revisit":
                        rows.append((name, _page_of(head), kind, head["WARC-Refers-To"], None, None, None, *none))
                    else:
                        payload, sha1 = _payload(head, block)
                        rows.append((name, _page_of(head), kind, None, len(payload), sha1, payload if keep else None, *none))
                if rows:
                    yield _frame(rows, _FIELDS)

    return run


def _assembled(keep: bool):
    """Segments come sorted by (origin, segment); one record's blocks are held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        origin, first, blocks, total = None, None, [], None

        def close():
            if first is None or total is None or total != sum(map(len, blocks)):
                raise ValueError(f"{origin}: segments are missing or of another length than {total}")
            payload, sha1 = _payload({"WARC-Record-ID": origin, "WARC-Payload-Digest": first[1]}, b"".join(blocks))
            return (origin, first[0], "response", None, len(payload), sha1, payload if keep else None)

        for pdf in batches:
            out = []
            for page, segment, length, block, key, digest in zip(
                pdf["page_id"].astype("Int64"), pdf["segment"], pdf["total"].astype("Int64"), pdf["block"], pdf["origin"], pdf["digest"]
            ):
                if key != origin:
                    if origin is not None:
                        out.append(close())
                    origin, first, blocks, total = key, None, [], None
                if segment != len(blocks) + 1:
                    raise ValueError(f"{key}: segment {segment} follows {len(blocks)}")
                if segment == 1:
                    first = (None if page is pd.NA else int(page), digest)
                if length is not pd.NA:
                    total = int(length)
                blocks.append(block)
            if out:
                yield _frame(out, _FIELDS[:7])
        if origin is not None:
            yield _frame([close()], _FIELDS[:7])

    return run


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """(name, page_id, record_type, refers_to, bytes, sha1, payload): every record whole.

    The reader has checked each payload's length and digest, so these need no payload; revisits have none of the three. Without
    ``payloads`` that column is null, and no payload leaves the reader.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = files.mapInPandas(_parsed(payloads), _READ)
    wholes = [x.split()[0] for x in _WHOLE.split(", ")]
    single = parsed.where("origin is null").select(*wholes)
    segments = parsed.where("origin is not null").select("page_id", "origin", "segment", "total", "block", "digest")
    assembled = segments.repartition("origin").sortWithinPartitions("origin", "segment").mapInPandas(_assembled(payloads), _WHOLE)
    return single.unionByName(assembled)


def archived(pages: DataFrame, least: int = LEAST, segment: int = SEGMENT) -> DataFrame:
    """Write the archives to the shared folder, read them back, and resolve revisits.

    (page_id, payload_bytes, payload_digest, record_type, refers_to): one row per page.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least, segment)
    back = stored(read_archives(spark, path, payloads=False).drop("payload"), "records")
    asked = back.where("refers_to is not null").select(F.col("refers_to").alias("name")).distinct()
    known = back.where("record_type = 'response'").join(asked, "name", "left_semi")
    known = known.select(F.col("name").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("bytes").alias("to_bytes"), F.col("sha1").alias("to_sha1"))
    response, revisit = back.where("refers_to is null"), back.where("refers_to is not null")
    # both sides are dealt out by the join, so that a record referred to very often can be split
    resolved = revisit.join(known, "refers_to", "left")
    gone = F.raise_error(F.concat(F.col("name"), F.lit(" refers to a record that is not there")))
    return response.select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(
        resolved.select(
            "page_id",
            F.when(F.col("to_sha1").isNotNull(), F.col("to_bytes")).otherwise(gone.cast("long")).alias("payload_bytes"),
            F.col("to_sha1").alias("payload_digest"),
            "record_type",
            F.col("to_page").alias("refers_to"),
        )
    )


QUERY = "op10_warc_reassembly"
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM d
"""


def query(spark, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))
