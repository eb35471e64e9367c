"""Files in: discovery, plain text, office documents and archives with their audits, read where the bytes are."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "pptx", "docx", "md", "markdown", "txt")
#: Limits of an archive: members, bytes of a member, bytes of all, ratio of expansion.
MOST_MEMBERS, MOST_BYTES, MOST_TOTAL, MOST_RATIO = 10_000, 256 << 20, 4 << 30, 100
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, length, sha256, content) of the files of known kinds under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("suffix", suffix).filter(F.col("suffix").isin(*SUFFIXES)).select("path", "suffix", "length", F.sha2("content", 256).alias("sha256"), "content")


def member_problem(name: str, size: int, packed: int, encrypted: bool, link: bool) -> str | None:
    """Why a member of an archive must not be read, if it mustn't."""
    parts = name.replace("\\", "/").split("/")
    if name.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", name) or any(p in ("", ".", "..") for p in parts):
        return "TRAVERSAL"
    if link:
        return "SYMLINK"
    if encrypted:
        return "ENCRYPTED"
    if size > MOST_BYTES:
        return "TOO_LARGE"
    if packed and size / packed > MOST_RATIO and size > 1 << 16:
        return "BOMB"
    return None


def archive_rows(path: str, raw: bytes) -> Iterator[tuple]:
    """(archive, index, member, suffix, size, sha256, problem, content) of an archive's files."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        yield path, -1, None, None, len(raw), None, "NOT_AN_ARCHIVE", None
        return
    total = 0
    for k, m in enumerate(z.infolist()):
        if m.is_dir():
            continue
        why = member_problem(m.filename, m.file_size, m.compress_size, bool(m.flag_bits & 1), (m.external_attr >> 28) == 0xA)
        total += m.file_size
        if why is None and (total > MOST_TOTAL or k >= MOST_MEMBERS):
            why = "ARCHIVE_TOO_LARGE"
        suffix = m.filename.rpartition(".")[2].lower() if "." in m.filename else ""
        data = None
        if why is None:
            try:
                data = z.read(m)
            except (zipfile.BadZipFile, RuntimeError, EOFError):
                why = "DAMAGED"
        yield path, k, m.filename, suffix, m.file_size, hashlib.sha256(data).hexdigest() if data is not None else None, why, data


_ROWS = [("archive", pa.string()), ("entry_index", pa.int32()), ("member", pa.string()), ("suffix", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("problem", pa.string()), ("content", pa.binary())]


def archive_members(archives: DataFrame) -> DataFrame:
    """Audited members of archives given as (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(*(c.to_pylist() for c in batch.columns)):
                rows = list(archive_rows(path, raw))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_ROWS)], names=[n for n, _ in _ROWS])

    return archives.select("path", "content").mapInArrow(read, "archive string, entry_index int, member string, suffix string, size long, sha256 string, problem string, content binary")


def inventory(members: DataFrame) -> DataFrame:
    """One row per different file of known kind: first occurrence in scan order as canonical; ``occurrences`` has the others."""
    good = members.filter(F.col("problem").isNull() & F.col("suffix").isin(*SUFFIXES))
    first = F.min(F.struct("archive", "entry_index", "member", "suffix", "size"))
    g = good.groupBy("sha256").agg(first.alias("f"), F.count(F.lit(1)).alias("occurrences"))
    return g.select("sha256", "f.suffix", "f.size", F.col("f.member").alias("canonical"), "occurrences")


def occurrences(members: DataFrame) -> DataFrame:
    """(sha256, archive, entry_index, path): where each file stands, one row per occurrence."""
    return members.filter("problem IS NULL").select("sha256", "archive", "entry_index", F.concat_ws("/", "archive", "member").alias("path"))


def _targets(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    folder, _, file = name.rpartition("/")
    try:
        root = ET.fromstring(z.read(f"{folder}/_rels/{file}.rels"))
    except KeyError:
        return {}
    out = {}
    for r in root:
        parts: list[str] = [] if r.get("Target", "").startswith("/") else folder.split("/")
        for p in r.get("Target", "").lstrip("/").split("/"):
            parts = parts[:-1] if p == ".." else [*parts, p]
        out[r.get("Id", "")] = "/".join(parts)
    return out


def slides(raw: bytes) -> list[str]:
    """Texts of a presentation's slides in the order the presentation lists them, with picture descriptions as lines."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    main = "ppt/presentation.xml"
    to = _targets(z, main)
    ids = [s.get(f"{_R}id") for s in ET.fromstring(z.read(main)).iter(f"{_P}sldId")]
    out = []
    for i in ids:
        root = ET.fromstring(z.read(to[i]))
        text = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in root.iter(f"{_A}p")]
        shown = [f"Mô tả hình: {n.get('descr').strip()}" for n in root.iter(f"{_P}cNvPr") if (n.get("descr") or "").strip()]
        out.append("\n".join(x for x in [*text, *shown] if x))
    return out


def virtual_pages(raw: bytes, limit: int = 12_000) -> list[str]:
    """A word-processor document as pages: a new one at each heading, or when the characters exceed the limit."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
    pages: list[list[str]] = [[]]
    for block in body if body is not None else ():
        heading = False
        if block.tag == f"{_W}p":
            style = block.find(f"{_W}pPr/{_W}pStyle")
            heading = style is not None and bool(re.match(r"(?i)heading|title", style.get(f"{_W}val", "")))
            text = ("# " if heading else "") + said(block) if said(block) else ""
        elif block.tag == f"{_W}tbl":
            text = "\n".join(" | ".join(said(c) for c in row.iter(f"{_W}tc")) for row in block.iter(f"{_W}tr"))
        else:
            text = ""
        if not text:
            continue
        if pages[-1] and (heading or sum(map(len, pages[-1])) + len(text) > limit):
            pages.append([])
        pages[-1].append(text)
    return ["\n\n".join(p) for p in pages if p]


def media(raw: bytes) -> list[tuple[str, str, bool]]:
    """(part, sha256, referenced) of the pictures of an office document; unreferenced ones are the parts no relation names."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    parts = [n for n in z.namelist() if "/media/" in n]
    named = {t for n in z.namelist() if n.endswith(".rels") for t in _targets(z, n.replace("_rels/", "").removesuffix(".rels")).values()}
    return [(n, hashlib.sha256(z.read(n)).hexdigest(), n in named) for n in parts]


def pages_of(suffix: str, raw: bytes) -> list[str]:
    if suffix == "pptx":
        return slides(raw)
    if suffix == "docx":
        return virtual_pages(raw)
    if suffix in ("md", "markdown", "txt"):
        return [raw.decode("utf-8-sig")]
    return []  # no reader for page images here


def extracted_pages(files: DataFrame) -> DataFrame:
    """(document_id, page, text, problem) of files given as (sha256, suffix, content); identity is content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, suffix, raw in zip(*(c.to_pylist() for c in batch.columns)):
                doc = "doc_" + hashlib.sha256(digest.encode()).hexdigest()[:16]
                try:
                    found = pages_of(suffix, raw)
                    rows += [(doc, k, t, None) for k, t in enumerate(found, 1)] or [(doc, 0, None, "NO_TEXT")]
                except (KeyError, ET.ParseError, UnicodeDecodeError, zipfile.BadZipFile) as e:
                    rows.append((doc, 0, None, type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["document_id", "page", "text", "problem"])

    return files.select("sha256", "suffix", "content").mapInArrow(read, "document_id string, page long, text string, problem string")


def reverified(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) where an inventory (path, size, sha256) and the files there now (path, content) differ; none if all is as listed."""
    now = files.select("path", F.length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_sha"), F.lit(True).alias("_there"))
    j = inventory.select("path", F.col("size").cast("long").alias("size"), F.regexp_replace("sha256", "^sha256:", "").alias("sha256"), F.lit(True).alias("_listed")).join(now, "path", "full_outer")
    problem = F.when(F.col("_there").isNull(), "MISSING").when(F.col("_listed").isNull(), "UNLISTED").when(~F.col("size").eqNullSafe(F.col("_size")), "SIZE").when(~F.col("sha256").eqNullSafe(F.col("_sha")), "HASH")
    return j.withColumn("problem", problem).filter("problem IS NOT NULL").select("path", "problem")
