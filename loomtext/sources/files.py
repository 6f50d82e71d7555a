"""Files as documents: text in its encodings, EPUB and DOCX archives, by extension."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Extensions that are read as text (fixed values).
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".log", ".csv", ".json", ".py", ".js", ".ts", ".html", ".htm", ".xml", ".yaml", ".yml")
SUFFIXES = (*TEXT_SUFFIXES, ".pdf", ".epub", ".docx")


def suffix(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def is_supported(path):
    return suffix(path).isin(*SUFFIXES)


def decoded(data: bytes) -> str:
    """UTF-8, UTF-16, Windows-1252 or Latin-1: the first that fits."""
    for encoding in ("utf-8", "utf-16", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeError:
            continue
    return data.decode("latin-1")


def _plain(html: bytes) -> str:
    body = re.sub(r"(?is)<(script|style|nav|head)\b.*?</\1>", " ", decoded(html))
    body = re.sub(r"(?i)</(p|div|h[1-6]|li|tr|blockquote)>|<br\s*/?>", "\n", body)
    import html as entities

    lines = [" ".join(x.split()) for x in entities.unescape(re.sub(r"<[^>]+>", "", body)).split("\n")]
    return "\n".join(x for x in lines if x)


def epub_text(data: bytes) -> str:
    """Chapters in spine order; members that are missing are passed over."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(book.read(opf))
        manifest = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
        names, base, chapters = set(book.namelist()), posixpath.dirname(opf), []
        for ref in (e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")):
            if (href := manifest.get(ref)) is None:
                continue
            name = posixpath.normpath(posixpath.join(base, unquote(href)))
            if name in names:
                chapters.append(_plain(book.read(name)))
    return "\n\n".join(c for c in chapters if c)


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in the order of the body; a table's row is a line of its cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        body = ElementTree.fromstring(file.read("word/document.xml"))[0]
    words = lambda e: "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t")).strip()
    out = []
    for part in body:
        if part.tag.endswith("}p"):
            out.append(words(part))
        elif part.tag.endswith("}tbl"):
            rows = [[words(c) for c in row if c.tag.endswith("}tc")] for row in part if row.tag.endswith("}tr")]
            out.append("\n".join(", ".join(filter(None, r)) for r in rows))
    return "\n\n".join(x for x in out if x)


@F.pandas_udf(StringType())
def _text(paths: pd.Series, contents: pd.Series) -> pd.Series:
    readers = {".epub": epub_text, ".docx": docx_text}

    def one(path: str, data: bytes) -> str | None:
        try:
            return readers.get(posixpath.splitext(path)[1].lower(), decoded)(bytes(data))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration):
            return None

    return pd.Series([one(p, d) for p, d in zip(paths, contents)], dtype=object)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the files under a path: unreadable ones and PDF bytes come with an error and no text."""
    files = spark.read.format("binaryFile").load(path).where(is_supported(F.col("path")))
    pdf = suffix(F.col("path")) == ".pdf"
    found = files.select("path", F.when(~pdf, _text("path", "content")).alias("text"))
    return found.withColumn("error", F.when(F.col("text").isNull(), "Cannot read"))
