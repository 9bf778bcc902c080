"""Files as rows: globs, ignore patterns, texts, and readers for PDF and LaTeX archives that report faults in a column."""

from __future__ import annotations

import gzip
import io
import re
import signal
import tarfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts

RESULT = "path string, text string, kind string, error string"
#: Characters of extracted texts that a task holds besides the batch it reads.
TEXTS_AT_ONCE = 4 << 20


def as_regex(pattern: str) -> str:
    """A shell pattern as a regular expression: stars and question marks cross slashes, [abc], [a-c] and [!abc] are classes; a bracket that isn't closed is itself."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] == "!")) if c == "[" else -1
        if end > 0:
            inner = pattern[at + 1 : end]
            inside = re.sub(r"([\\\[\]&^])", r"\\\1", inner.removeprefix("!"))
            out.append(f"[^{inside}]" if inner.startswith("!") else f"[{inside}]")
            at = end
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        at += 1
    return "^(?s:" + "".join(out) + ")$"


def glob_regex(glob: str) -> str:
    """A glob below a root as a regular expression of the relative path: ** is any number of folders, other stars stay in one."""
    parts = glob.strip("/").split("/")
    out = ""
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            one = as_regex(part).removeprefix("^(?s:").removesuffix(")$").replace(".*", "[^/]*")
            out += re.sub(r"(?<!\\)\.(?![*])", "[^/]", one) if "?" in part else one
            out += "" if last else "/"
    return f"^{out}$"


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path meets one of the patterns; blank lines and comments don't count, a final slash means a folder."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip().lstrip("/")
        if line and not line.startswith("#"):
            out = out | (path.startswith(line) if line.endswith("/") else path.rlike(as_regex(line)))
    return out


def files(spark: SparkSession, root: str, glob: str | Sequence[str] = "*", patterns: Sequence[str] = ()) -> DataFrame:
    """(path, content, length) below root, hidden and ignored ones left out; path is relative.

    glob: one for the names of files in any folder, or several for relative paths; a file that several of them meet is there once. Only
    files whose names can meet one are read.
    """
    globs = [glob] if isinstance(glob, str) else list(glob)
    names = sorted({"*" if g.endswith("**") else g.split("/")[-1] for g in globs})
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names[0] if len(names) == 1 else "{" + ",".join(names) + "}").load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape("/" + root.split(":")[-1].strip("/")) + "/", "")
    rows = rows.select(relative.alias("path"), "content", "length")
    if not isinstance(glob, str):
        rows = rows.where(F.col("path").rlike("|".join(map(glob_regex, globs))))
    return rows.where(~F.col("path").rlike(r"(^|/)(\.|node_modules/|__pycache__/)")).where(~ignored(F.col("path"), patterns))


def decoded(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def latex_text(content: bytes) -> str:
    """The largest .tex of a gzipped archive, or the gzipped text itself, or plain text."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if data[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            found = [m for m in t.getmembers() if m.isfile() and m.name.endswith(".tex")]
            if not found:
                raise ValueError("no .tex in archive")
            return t.extractfile(max(found, key=lambda m: m.size)).read().decode("utf-8", "ignore")
    return data.decode("utf-8", "ignore")


def pdf_text(content: bytes) -> str:
    """Checks the header; text is what stands in uncompressed text operators, as no converter is at hand."""
    if not content:
        raise ValueError("empty file")
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    return " ".join(m.decode("latin-1") for m in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", content))


def pdf_pages(content: bytes) -> list[tuple[int, str]]:
    """(number, text) of the pages that have text; a page object starts a page, as no converter is at hand."""
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    parts = re.split(rb"/Type\s*/Page\b", content)
    found = [" ".join(m.decode("latin-1") for m in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", x)) for x in (parts[1:] or parts)]
    return [(n, x) for n, x in enumerate(found, 1) if x.strip()]


def pages(rows: DataFrame) -> DataFrame:
    """(path, page, text, error): one row for each page with text of PDF files (path, content); a fault is a row with an error."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out.extend((path, n, x, None) for n, x in pdf_pages(bytes(content or b"")))
                except ValueError as e:
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"]).astype({"page": "Int64"})

    return rows.select("path", "content").mapInPandas(f, "path string, page long, text string, error string")


def marked(found: DataFrame) -> DataFrame:
    """(path, text): the pages of each file in order, each after a line with its number; a file's pages are one group."""
    page = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), "text")
    rows = found.where("error is null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", page.alias("x")))).alias("p"))
    return rows.select("path", F.array_join(F.transform("p", lambda x: x["x"]), "\n\n").alias("text"))


class Late(Exception):
    """A reader took too long."""


def within(seconds: float, read: Callable[[bytes], str], content: bytes) -> str:
    """What a reader gives, if it does in time; only a worker's main thread can be interrupted, as Spark's are."""

    def stop(*_: object) -> None:
        raise Late(f"over {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return read(content)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def robust(rows: DataFrame, readers: Sequence[tuple[str, Callable[[bytes], str]]], seconds: float = 30.0) -> DataFrame:
    """(path, text, reader, errors) of files (path, content): the first of the readers (name, function) that gives a text in time; what the
    others said stands in errors."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                text = used = None
                errors: list[str] = []
                for name, read in readers:
                    try:
                        text, used = within(seconds, read, bytes(content or b"")), name
                        break
                    except Exception as e:  # the row says what went wrong
                        errors.append(f"{name}: {e}")
                out.append((path, text, used, errors))
            yield pd.DataFrame(out, columns=["path", "text", "reader", "errors"])

    return rows.select("path", "content").mapInPandas(f, "path string, text string, reader string, errors array<string>")


def extracted(rows: DataFrame) -> DataFrame:
    """(path, text, kind, error) for each file (path, content); a fault is a row with an error, never an exception."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([(name, pa.string()) for name in ("path", "text", "kind", "error")])
        for b in batches:
            out, size = [], 0
            for path, content, kind in (tuple(c[n].as_py() for c in b.columns) for n in range(b.num_rows)):
                try:
                    text = latex_text(content) if kind == "latex" else pdf_text(content) if kind == "pdf" else content.decode("utf-8", "ignore")
                    out.append({"path": path, "text": text, "kind": kind, "error": None})
                    size += len(text)
                except Exception as e:  # the row says what went wrong
                    out.append({"path": path, "text": None, "kind": kind, "error": str(e)})
                if size >= TEXTS_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)

    ext = texts.extension(F.col("path"))
    kind = F.when(ext.isin(".txt", ".md", ".markdown", ".rst"), "text").otherwise(texts.reader(ext))
    return rows.select("path", "content", kind.alias("kind")).mapInArrow(f, RESULT)
