"""Documents from files: type dispatch and text extraction from the binary source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: MIME types by extension; other files are refused. Fixed values.
TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "odt": "application/vnd.oasis.opendocument.text",
    "txt": "text/plain",
}
MOST_BYTES = 100 * 1024 * 1024


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, modificationTime, content, extension`` of all files below a folder (the source leaves out empty ones)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))


def file_type(extension: Column) -> Column:
    """The MIME type, or null for a type that is not supported."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), extension)


def folder_sizes(files: DataFrame) -> DataFrame:
    """Files and bytes of each folder."""
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processing document, one per line."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    breaks = {"tab": "\t", "br": "\n", "cr": "\n"}
    lines = []
    for p in root.iter():
        if _tag(p) == "p":
            lines.append("".join((x.text or "") if _tag(x) == "t" else breaks.get(_tag(x), "") for x in p.iter()))
    return "\n".join(lines)


def odt_text(content: bytes) -> str:
    """Headings and paragraphs of an open document, blank lines between; space runs and tabs kept."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("content.xml"))

    def inner(e) -> str:
        own = {"tab": "\t", "line-break": "\n", "soft-page-break": "\f"}.get(_tag(e), "")
        if _tag(e) == "s":
            own = " " * int(next((v for k, v in e.attrib.items() if k.endswith("}c")), 1))
        return own + (e.text or "") + "".join(inner(x) + (x.tail or "") for x in e)

    return "\n\n".join(inner(e) for e in root.iter() if _tag(e) in ("p", "h"))


def decode_text(content: bytes) -> str:
    """UTF-8, or Latin-1 where that does not fit."""
    text = content.decode("utf-8", "replace")
    return content.decode("latin-1") if "�" in text else text


def extract(files: DataFrame, pdf=None) -> DataFrame:
    """``path, text, page_count, error``: one row per file.

    Empty files and unknown types are errors, not exceptions.  ``pdf`` turns
    bytes into text where a PDF library is at hand; without one PDFs are errors.
    """

    def one(extension: str, content: bytes) -> tuple[str | None, int | None, str | None]:
        if not content:
            return None, None, "empty file"
        try:
            if extension == "txt":
                text = decode_text(content)
            elif extension == "docx":
                text = docx_text(content)
            elif extension == "odt":
                text = odt_text(content)
            elif extension == "pdf" and pdf is not None:
                text = pdf(content)
            else:
                return None, None, f"unsupported type {extension!r}"
        except Exception as e:  # noqa: BLE001  a broken file must not end the job
            return None, None, f"{type(e).__name__}: {e}"
        parts = [p for p in re.split(r"\n\s*\n|\f", text) if len(p.strip()) > 20]
        per_page = 10 if extension == "docx" else 20
        return text, max(1, -(-len(parts) // per_page)), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *one(e, c)) for p, e, c in zip(batch["path"], batch["extension"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "text", "page_count", "error"]).astype({"page_count": "Int64"})

    return files.select("path", "extension", "content").mapInPandas(run, "path string, text string, page_count long, error string")


_CHAPTER = r"(?m)(?=^\s*CAPITOLUL\s+[IVXLC\d]+)"


def legal_paragraphs(docs: DataFrame, cut: int = 2000, pack: int = 1500) -> DataFrame:
    """Articles of a law text: ``doc_id, paragraph_number, chapter, content``.

    Chapters are split before their headings and articles before ``Art. N``;
    parts of fewer than 30 characters are dropped, and so are those that
    cleaning leaves with fewer than 50.  A text with fewer than ten articles is
    packed into pieces of whole sentences.
    """

    def articles(text: str) -> list[tuple[str, str]]:
        out = []
        for chapter in re.split(_CHAPTER, text):
            head = re.match(r"\s*(CAPITOLUL\s+[IVXLC\d]+[^\n]*)", chapter)
            for part in re.split(r"(?=Art\.\s*\d+[.:\s])", chapter):
                part = part.strip()
                if len(part) < 30:
                    continue
                part = re.sub(r"\s*art\.\s*\d+\s*$", "", part, flags=re.I).strip()
                if len(part) >= 50:
                    out.append((head.group(1).strip() if head else "", part[:cut]))
        return out

    def packed(text: str) -> list[tuple[str, str]]:
        out, held = [], ""
        for sentence in re.findall(r"[^.!?]+[.!?]*\s*", text):
            if held and len(held) + len(sentence) > pack:
                out.append(("", held.strip()))
                held = ""
            held += sentence
        return [x for x in [*out, ("", held.strip())] if len(x[1]) >= 100]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = articles(text or "")
                for i, (chapter, content) in enumerate(found if len(found) >= 10 else packed(text or ""), 1):
                    rows.append((doc_id, i, chapter, content))
            yield pd.DataFrame(rows, columns=["doc_id", "paragraph_number", "chapter", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, paragraph_number long, chapter string, content string")


def question_sets(spark: SparkSession, path: str) -> DataFrame:
    """JSON question sets, each file one array over many lines: one row per question, its fields as columns."""
    return spark.read.option("multiLine", True).json(path)
