"""Downloaded archives: what they are, and the main LaTeX source in them."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_INCLUDE = re.compile(r"^[^%\n]*\\(?:include|includeonly|input|@input)\b\s*\{?\s*([^}\s%]+)")
_BEGINS = re.compile(r"(?m)^\s*\\(?:documentclass|documentstyle|begin\{document\})")
_AUXILIARY = (".dtx", ".sty", ".bbl")


def sniff(data: bytes) -> str:
    """The kind of a file by its first bytes."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:4] == b"%PDF":
        return "pdf"
    if data[:4] == b"%!PS" or data[:5] == b"\x04%!PS":
        return "eps" if b"EPSF" in data[:40] else "postscript"
    if data[257:262] == b"ustar":
        return "tar"
    if data[:8] == b"\x89PNG\r\n\x1a\n" or data[:3] in (b"\xff\xd8\xff", b"GIF"):
        return "image"
    head = data[:4096]
    if b"\0" in head:
        return "unknown"
    return "tex" if re.search(rb"\\(?:documentclass|documentstyle|begin|input|section)\b", head) else "text"


def inline(name: str, files: dict[str, str], path: tuple[str, ...] = ()) -> str:
    """A file's lines with the files it includes in their place; a file that includes itself leaves nothing there."""
    out = []
    for line in files[name].splitlines():
        m = _INCLUDE.match(line)
        target = posixpath.normpath(posixpath.join(posixpath.dirname(name), m[1])).lower() if m else ""
        if m and "." not in posixpath.basename(target) and target + ".tex" in files:
            target += ".tex"
        if not m or target.endswith(".pdf"):
            out.append(line)
        elif target in files and target != name and target not in path:
            out.append(inline(target, files, (*path, name)))
    return "\n".join(out)


def main_source(files: dict[str, str]) -> str | None:
    """The main file of a set by name, its includes inlined: of those with content the one left alone, else of
    those that begin a document, without auxiliary ones, the longest; the first name on ties."""
    names = {n.lower(): t for n, t in files.items()}
    bare = {n: "\n".join(x for x in t.splitlines() if not x.startswith("%")) for n, t in names.items()}
    left = {n: inline(n, bare) for n in sorted(bare)}
    left = {n: t for n, t in left.items() if t.strip()}
    for keep in (lambda n: True, lambda n: bool(_BEGINS.search(left[n])), lambda n: not n.endswith(_AUXILIARY)):
        left = {n: t for n, t in left.items() if keep(n)}
        if len(left) == 1:
            return next(iter(left.values()))
    return left[max(sorted(left), key=lambda n: len(left[n]))] if left else None


def unwrap(data: bytes | None) -> tuple[str, str | None, str | None]:
    """``(kind, text, error)`` of a download. Printed formats have no text; nothing is ever raised."""
    if data is None:
        return "missing", None, None
    kind = sniff(data)
    try:
        while kind == "gzip":  # however many layers there are
            inner = gzip.decompress(data)
            if inner == data:
                return kind, None, "a layer that holds itself"
            data = inner
            kind = sniff(data)
        if kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                files = {m.name: t.extractfile(m).read().decode("utf-8", "ignore") for m in t if m.isfile() and m.name.lower().endswith((".tex", *_AUXILIARY))}
            return kind, main_source(files), None
        if kind in ("tex", "text"):
            return kind, data.decode("utf-8", "ignore"), None
        return kind, None, None if kind in ("pdf", "postscript", "eps") else f"cannot read {kind}"
    except (OSError, EOFError, zlib.error, tarfile.TarError) as e:
        return kind, None, type(e).__name__


def read_archives(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, kind, text, error)`` of every file below a folder, a row each, read where the task runs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    return unwrap_rows(files, "path")


def unwrap_rows(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``(key, kind, text, error)`` of the downloads in a column of bytes."""
    files = files.select(key, content)
    kind_of_key = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [unwrap(x) for x in b[content]]
            yield pd.DataFrame({key: b[key], "kind": [g[0] for g in got], "text": [g[1] for g in got], "error": [g[2] for g in got]})

    return files.mapInPandas(run, f"{key} {kind_of_key}, kind string, text string, error string")


def packed_rows(files: DataFrame, key: str, body: str) -> DataFrame:
    """``(key, content)``: texts as compressed downloads, in one layer more where the key is larger, up to seven."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = []
            for k, t in zip(b[key], b[body]):
                data = t.encode()
                for _ in range(1 + int(k) % 7):
                    data = gzip.compress(data, 1)
                packed.append(data)
            yield pd.DataFrame({key: b[key], "content": packed})

    return files.mapInPandas(run, f"{key} {kind}, content binary")
