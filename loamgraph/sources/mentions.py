"""Paths that texts name, lines of texts, ignored files, and links looked up again."""

from __future__ import annotations

import bisect
import posixpath
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.sources.files import read_page, resolved

# What a path in a code span may not hold, how long it may be, the reference to a line after it, and the
# names without an ending that count without a slash.
FORBIDDEN = "*?[]{}<>|\"'`$\\;,=()!&#%^:"
MOST_BYTES = 512
LINE = re.compile(r":[0-9]+(?:[-:][0-9]+)?$")
BARE = frozenset(
    "AUTHORS Brewfile CODEOWNERS COPYING Containerfile Dockerfile GNUmakefile Gemfile Jenkinsfile Justfile LICENCE LICENSE Makefile NOTICE Procfile Rakefile VERSION Vagrantfile justfile makefile".split()
)
_BREAKS = {
    "lf": re.compile(rb"\n"),
    "universal": re.compile(rb"\r\n|\r|\n"),
    "unicode": re.compile(rb"\r\n|\r|\n|\x0b|\x0c|\xc2\x85|\xe2\x80\xa8|\xe2\x80\xa9"),
}
_FENCED = re.compile(r"(?ms)^ {0,3}(```+|~~~+).*?(?:^ {0,3}\1[`~]*\s*$|\Z)")
_SPAN = re.compile(r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_MD_LINK = re.compile(r"!?\[(?:[^\]\\]|\\.)*\]\(\s*<?([^)\s>]+)>?(?:\s+[^)]*)?\)")


class Lines:
    """Byte offsets of a text and the lines they are on, from 1; a line's break belongs to it. lf, universal or unicode breaks."""

    def __init__(self, source: bytes, scheme: str = "lf"):
        self.starts = [0, *(m.end() for m in _BREAKS[scheme].finditer(source))]
        self.size = len(source)

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)

    def offset(self, line: int) -> int:
        """Where a line begins; one after the last begins at the end."""
        return 0 if line < 1 else self.starts[line - 1] if line <= len(self.starts) else self.size


def candidate(span: str) -> str | None:
    """A code span that is a path as a whole, cleaned, without a reference to a line; else None."""
    span = span.strip()
    if len(span.encode()) > MOST_BYTES:
        return None
    span = LINE.sub("", span)
    named = span in BARE or "/" in span or "." in span
    plain = not any(c in FORBIDDEN or c.isspace() or not c.isprintable() for c in span) and any(c.isalnum() for c in span)
    if not (named and plain) or span.startswith(("/", "./", "../", "~", "-")) or ".." in span.split("/"):
        return None
    cleaned = posixpath.normpath(span)
    return None if cleaned == "." else cleaned


def destination(path: str, link: str) -> str | None:
    """The path that a link in the file leads to; None for what leaves the folder, or is no path."""
    try:
        parts = urlsplit(link.strip())
    except ValueError:
        return None
    if parts.scheme or parts.netloc or not parts.path:
        return None
    to = parts.path.lstrip("/") if parts.path.startswith("/") else posixpath.join(posixpath.dirname(path), parts.path)
    to = posixpath.normpath(to)
    return None if to in (".", "..") or to.startswith(("../", "/")) else to


def mentions(path: str, source: str, scheme: str = "lf") -> list[tuple[str, int | None]]:
    """(path, line) of what a file names: code spans that are paths, and where links and images lead; each path and line
    once. Code blocks say nothing. Pages have no lines."""
    if path.lower().endswith((".html", ".htm")):
        page = read_page(source)
        found = [candidate(m) for m in re.findall(r"(?is)<code\b[^>]*>([^<]*)</code>", re.sub(r"(?is)<pre\b.*?</pre>", "", source))]
        found += [destination(path, x) for x in [*page.hrefs, *re.findall(r"(?i)<img\b[^>]*?\bsrc=[\"']([^\"']*)", source)]]
        return [(x, None) for x in dict.fromkeys(x for x in found if x)]
    blank = _FENCED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    table = Lines(source.encode(), scheme)
    at = [(m.start(2), candidate(m[2])) for m in _SPAN.finditer(blank)]
    hidden = _SPAN.sub(lambda m: " " * len(m[0]), blank)
    at += [(m.start(), destination(path, m[1])) for m in _MD_LINK.finditer(hidden)]
    return list(dict.fromkeys((x, table.line(len(source[:i].encode()))) for i, x in sorted(at, key=lambda p: p[0]) if x))


def path_refs(rows: DataFrame, scheme: str = "lf") -> DataFrame:
    """(id, type, target, line) of all files (path, source)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(p.removesuffix(".md"), "mentions", t, n) for p, s in zip(frame.path, frame.source, strict=True) for t, n in mentions(p, s or "", scheme)]
            yield pd.DataFrame(out, columns=["id", "type", "target", "line"]).astype({"line": "Int32"})

    return rows.select("path", "source").mapInPandas(run, "id string, type string, target string, line int")


def ignore_pattern(lines: list[str], builtin: tuple[str, ...] = (".git/",)) -> list[tuple[bool, str]]:
    """Patterns of an ignore file as (ignored, regular expression), in order: # comments, ! takes back, a slash at the end means
    folders, one inside anchors at the top, * and ? stay within a folder and ** crosses them."""
    out = []
    for raw in (*builtin, *lines):
        text = raw.strip()
        if not text or text.startswith("#"):
            continue
        back = text.startswith("!")
        text = text[1:] if back else text
        folder, text = text.endswith("/"), text.rstrip("/")
        top, text = "/" in text, text.lstrip("/")
        shape = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?/]+|/", text))
        out.append((not back, rf"^(?:{'' if top else '(?:.*/)?'}{shape})(?:/.*{'' if folder else '|'})$"))
    return out


def ignored(path: Column, patterns: list[tuple[bool, str]]) -> Column:
    """Whether the last pattern that fits a path ignores it."""
    out = F.lit(False)
    for yes, shape in patterns:
        out = F.when(path.rlike(shape), F.lit(yes)).otherwise(out)
    return out


def relinked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose link was looked up by name led anew: those of links (link not null) go where their file's links lead now,
    the others stay; of twins that this makes one stays, and a link that leads nowhere keeps its target."""
    now = resolved(nodes).select("source", "link", F.col("target").alias("_now"), F.col("state").alias("_state"))
    rows = edges.join(now.dropDuplicates(["source", "link"]), ["source", "link"], "left")
    moved = F.when(F.col("link").isNotNull() & F.col("_state").isin("found", "missing-heading", "missing-block"), F.col("_now")).otherwise(F.col("target"))
    return rows.withColumn("target", moved).select(*edges.columns).dropDuplicates(["type", "source", "target"])


def with_files(units: DataFrame, files: DataFrame) -> DataFrame:
    """Sub-units with the type and title of their file, null where it is missing."""
    of = files.select(F.col("id").alias("_file"), F.col("type").alias("file_type"), F.col("title").alias("file_title"))
    return units.join(of, F.split_part("id", F.lit("#"), F.lit(1)) == F.col("_file"), "left").drop("_file")
