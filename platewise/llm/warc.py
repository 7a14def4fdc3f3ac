"""WARC archives compressed with Zstandard: one frame per record and the dictionary in a leading skippable frame.

Archives are rows (archive_id, content) of a frame: Spark moves and stores them like any table, and ``save`` puts
them into a folder as files. Each holds about ARCHIVE_BYTES of uncompressed records, so no task has to hold more than
one archive and one batch of pages.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.arrays import column
from platewise.llm.common import salted_join

ARCHIVE_BYTES = 1 << 20
#: Magic number of the skippable frame that holds the dictionary.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICT_BYTES = 16 << 10
#: The dictionary is trained on so many pages of at most so many bytes.
DICT_PAGES, DICT_PAGE_BYTES = 256, 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
ARCHIVES = "archive_id string, content binary"
RECORDS = "archive_id string, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, problem string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(pages: DataFrame, *, key: str = "page_id", body: str = "html") -> bytes:
    """A dictionary from about DICT_PAGES pages, picked by a hash of their id, of at most DICT_PAGE_BYTES; empty if too few."""
    share = min(1.0, DICT_PAGES / max(1, pages.count()))
    picked = pages.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    small = picked.filter((F.octet_length(body) > 0) & (F.octet_length(body) <= DICT_PAGE_BYTES))
    rows = small.select(F.col(body).alias("b")).collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, [r["b"].encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b""


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%-._~''')}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + END + block + END


def typed(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, body, record_type and refers_to: of equal bodies of at least ``least`` bytes the page with the
    smallest id is the response and the others revisit it; shorter bodies are all responses. Null bodies are empty.

    Bodies are equal if their SHA-256 digests are; their SHA-1, which the records carry, decides nothing. However many
    pages share a body, they are spread over tasks.
    """
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(body).cast("binary"), F.lit("").cast("binary")).alias("body"))
    p = p.withColumn("d", F.sha2("body", 256))
    first = p.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
    p = salted_join(p, first.filter("pages > 1").drop("pages"), ["d"], "page_id", "left").withColumn("first", F.coalesce("first", "page_id"))
    revisit = (F.octet_length("body") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    return p.select("page_id", "url", "body", kind.alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html", least: int = 0, dictionary: bytes | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive_id, content) with a record per page row.

    Null bodies are empty payloads; a null url gives no Target-URI; repeated rows give a record each (a page that has
    the id of its response is a response too); other columns don't matter; no pages give no archives.
    """
    d = train_dictionary(pages, key=key, body=body) if dictionary is None else dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=6, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(d) if d else None)
        lead = struct.pack("<II", DICT_MAGIC, len(d)) + d if d else b""
        frames, held = [], 0

        def archive() -> pa.RecordBatch:
            content = lead + b"".join(frames)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:24]]), pa.array([content], pa.binary())], ["archive_id", "content"])

        for batch in batches:
            columns = [column(batch, x) for x in ("record_type", "page_id", "url", "body", "refers_to")]
            for i in range(batch.num_rows):
                kind, page, link, payload, refers = (c[i].as_py() for c in columns)
                raw = record(kind, page, link, payload, digest(payload), refers)
                frames.append(packer.compress(raw))
                held += len(raw)
                if held >= archive_bytes:
                    yield archive()
                    frames, held = [], 0
        if frames:
            yield archive()

    return typed(pages, key=key, url=url, body=body, least=least).mapInArrow(run, ARCHIVES)


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each. Raises ValueError where the file breaks the format."""
    at, known = 0, None
    while len(content) - at >= 8 and 0x184D2A50 <= (magic := struct.unpack_from("<I", content, at)[0]) <= 0x184D2A5F:
        size = struct.unpack_from("<I", content, at + 4)[0]
        if at + 8 + size > len(content):
            raise ValueError("skippable frame is cut off")
        if at == 0 and magic == DICT_MAGIC:
            raw = content[8 : 8 + size]
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            known = zstandard.ZstdCompressionDict(raw)
        at += 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(content):
        if content[at : at + 4] != struct.pack("<I", FRAME_MAGIC):
            raise ValueError(f"no frame at byte {at}")
        said = zstandard.get_frame_parameters(content[at : at + 32])
        one, out = unpacker.decompressobj(), []
        while not one.eof:
            piece = content[at : at + 16384]
            if not piece:
                raise ValueError("last frame is cut off")
            try:
                out.append(one.decompress(piece))
            except zstandard.ZstdError as e:
                raise ValueError(f"broken frame: {e}") from e
            at += len(piece)
        at -= len(one.unused_data)
        data = b"".join(out)
        if said.content_size not in (zstandard.CONTENTSIZE_UNKNOWN, len(data)):
            raise ValueError("frame has another size than its header says")
        yield data


def parse(raw: bytes) -> tuple[dict, str | None]:
    """Fields of RECORDS (without archive_id and problem) and what is wrong with the record, if anything."""
    out: dict = dict.fromkeys(("page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"))
    head, gap, rest = raw.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return out, "no WARC header"
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def page(name: str) -> int | None:
        x = h.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x.lstrip("-").isdigit() else None

    out |= {"page_id": page("warc-record-id"), "record_type": h.get("warc-type"), "url": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:")}
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in h]:
        return out, f"no {missing[0]}"
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + len(END) or not rest.endswith(END):
        return out, "Content-Length doesn't match"
    block = rest[: -len(END)]
    if h.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        return out, "block digest doesn't match"
    http, gap, payload = block.partition(END)
    said = next((x.partition(":")[2].strip() for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")), "")
    if not gap or not said.isdigit():
        return out, "no HTTP Content-Length"
    out["payload_bytes"] = int(said)
    if h["warc-type"] == "revisit":
        out["refers_to"] = page("warc-refers-to")
        return out, None if out["refers_to"] is not None and not payload else "revisit without target, or with a payload"
    out["payload"] = payload
    if len(payload) != int(said):
        return out, "HTTP Content-Length doesn't match"
    return out, None if digest(payload) == out["payload_digest"] else "payload digest doesn't match"


def read_archives(archives: DataFrame, *, key: str = "archive_id", content: str = "content") -> DataFrame:
    """One row per record (RECORDS). problem is null for a valid record; what is broken is reported in a row with
    the fields that could be read, and a file that can't be cut into frames ends with such a row."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, RECORDS.split(", "))])
        for batch in batches:
            for name, data in zip(column(batch, "k"), column(batch, "c")):
                rows = []
                try:
                    for raw in frames(data.as_py() or b""):
                        found, problem = parse(raw)
                        rows.append(found | {"archive_id": name.as_py(), "problem": problem})
                except ValueError as e:
                    rows.append({"archive_id": name.as_py(), "problem": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select(F.col(key).cast("string").alias("k"), F.col(content).alias("c")).mapInArrow(run, RECORDS)


def save(archives: DataFrame, folder: str) -> None:
    """Writes every archive as ``<archive_id>.warc.zst`` into a folder that all executors see at the same path."""

    def one(row) -> None:
        with open(f"{folder}/{row['archive_id']}.warc.zst", "wb") as f:
            f.write(row["content"])

    archives.foreach(one)


def load(spark, folder: str) -> DataFrame:
    """Archive files of a folder as (archive_id, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)\.warc\.zst$", 1).alias("archive_id"), "content")
