"""Files of a workspace as rows: listings, text with its encoding, office documents, binary detection."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.text import glob_pattern

# Directories that are no content, extensions by file type.
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")
FILE_TYPES = {
    "py": ("py", "pyi"), "js": ("js", "jsx", "mjs"), "ts": ("ts", "tsx"), "md": ("md", "markdown"), "json": ("json", "jsonl"), "yaml": ("yaml", "yml"), "html": ("html", "htm"),
    "sh": ("sh", "bash"), "rust": ("rs",), "go": ("go",), "java": ("java",), "sql": ("sql",), "csv": ("csv", "tsv"),
}
#: Bytes of an office document's part that are read at most; beyond that the part is an error row.
MAX_PART = 64 << 20


def walk(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Every file below ``root`` outside of ignored directories: ``path, rel_path, name, modified, length`` (and ``content``).

    Without ``content`` no file is opened. Sorted listings are made by :func:`find_files`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^file:/*|/+$", "", root)
    rel = F.regexp_replace("path", rf"^(?:file:)?/*\Q{base.lstrip('/')}\E/+", "")
    ignored = "|".join(re.escape(d) for d in IGNORED)
    out = files.select("path", rel.alias("rel_path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length", *(["content"] if content else []))
    return out.filter(~F.col("rel_path").rlike(rf"(?:^|/)(?:{ignored})/"))


def find_files(files: DataFrame, glob: str | None = None, file_type: str | None = None, terms: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """Files by glob (on the name if it has no slash), type and words of the path, newest first, then by path; one page."""
    if glob:
        files = files.filter(F.col("rel_path" if "/" in glob else "name").rlike(glob_pattern(glob)))
    if file_type:
        files = files.filter(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*FILE_TYPES.get(file_type, (file_type,))))
    for term in terms.lower().split():
        files = files.filter(F.contains(F.lower("rel_path"), F.lit(term)))
    return files.orderBy(F.desc("modified"), "rel_path").offset(offset).limit(limit)


def list_directory(files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` paths and, on every row, how many there are in all."""
    total = files.agg(F.count("*").alias("total"))
    return files.orderBy("rel_path").limit(limit).select("rel_path", "length").join(F.broadcast(total))  # one row


def is_binary(content: Column) -> Column:
    """A zero byte, or more than a fifth of control bytes, in the first 4096."""

    @F.pandas_udf("boolean")
    def sniff(values: pd.Series) -> pd.Series:
        def one(raw) -> bool:
            head = bytes(raw or b"")[:4096]
            odd = sum(b < 9 or 13 < b < 32 for b in head)
            return b"\0" in head or odd > len(head) / 5

        return values.map(one)

    return sniff(content)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, else as Latin-1 (which every byte sequence is)."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def _xml_text(raw: bytes, text_tag: str, row_tag: str) -> str:
    rows = []
    for row in ElementTree.fromstring(raw).iter():
        if row.tag.endswith("}" + row_tag):
            rows.append("".join(t.text or "" for t in row.iter() if t.tag.endswith("}" + text_tag)))
    return "\n".join(r for r in rows if r)


def _sheet(raw: bytes, shared: list[str]) -> str:
    out = []
    for row in ElementTree.fromstring(raw).iter():
        if row.tag.endswith("}row"):
            cells = []
            for c in row:
                v = next((x.text for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t")), None) or ""
                cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
            out.append("\t".join(cells))
    return "\n".join(out)


def office_text(name: str, raw: bytes) -> str | None:
    """The text of a DOCX (paragraphs), XLSX (sheets, cells joined by tabs) or PPTX (slides); None if it is none of them."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind not in ("docx", "xlsx", "pptx"):
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:

            def part(n: str) -> bytes:
                if z.getinfo(n).file_size > MAX_PART:
                    raise ValueError("part too large")
                return z.read(n)

            number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
            if kind == "docx":
                return _xml_text(part("word/document.xml"), "t", "p")
            if kind == "pptx":
                slides = sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=number)
                return "\n\n".join(f"--- Slide {i} ---\n{_xml_text(part(n), 't', 'p')}" for i, n in enumerate(slides, 1))
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                for si in ElementTree.fromstring(part("xl/sharedStrings.xml")):
                    shared.append("".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")))
            sheets = sorted((n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=number)
            return "\n\n".join(f"--- Sheet {i} ---\n{_sheet(part(n), shared)}" for i, n in enumerate(sheets, 1))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
        return f"[error: {e}]"


def extract_text(files: DataFrame) -> DataFrame:
    """``rel_path, text`` of :func:`walk` with content: office documents by their parts, other files decoded, binaries null."""
    texts = files.withColumn("plain", F.when(~is_binary(F.col("content")), decoded(F.col("content"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            office = [office_text(n, bytes(c)) if n.lower().endswith(("docx", "xlsx", "pptx")) else None for n, c in zip(b["name"], b["content"])]
            yield pd.DataFrame({"rel_path": b["rel_path"], "text": [o if o is not None else p for o, p in zip(office, b["plain"])]})

    return texts.select("rel_path", "name", "content", "plain").mapInPandas(run, "rel_path string, text string")
