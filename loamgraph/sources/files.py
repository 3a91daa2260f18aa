"""Folders of markdown and HTML files as nodes, sub-units and links."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamgraph.functions.passages import heading_key, name_key
from loamgraph.operators.storage import kept
from loamgraph.streaming import queue

LETTERS = {"paragraph": "P", "code-block": "B", "blockquote": "Q", "list-item": "L"}
TITLE_LENGTH = 80
#: Characters of files that are parsed before their nodes are handed on.
PARSED = 1 << 20
UNIT = "ordinal int, kind string, address string, parent_address string, text string, payload string, properties string, title string, start_line int, end_line int, links array<string>"

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`\s]*)[^`]*$")
_ITEM = re.compile(r"( {0,3})(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ALIGN = re.compile(r"[ ]{0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_LINK = re.compile(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]")
_CODE = re.compile(r"(?s)(?:^|\n)(```|~~~).*?(?:\n\1|\Z)|(`+)(?!`).*?(?<!`)\2(?!`)")


def scalar(text: str) -> object:
    """A value of a front block: numbers, true and false, quoted and plain strings, lists in brackets."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in re.findall(r'"[^"]*"|\'[^\']*\'|[^,]+', text[1:-1]) if x.strip()]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"[+-]?\d+\.\d*(?:[eE][+-]?\d+)?", text) else text


def front_block(text: str) -> tuple[dict[str, object], str]:
    """The properties between two lines of ---, and the rest of the text."""
    m = re.match(r"(?s)---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|\Z)", text)
    if not m:
        return {}, text
    out: dict[str, object] = {}
    key = None
    for line in m[1].splitlines():
        if (item := re.match(r"\s*-\s+(.*)", line)) and key is not None:
            held = out[key]
            out[key] = [*(held if isinstance(held, list) else []), scalar(item[1])]
        elif pair := re.match(r"([^\s:#][^:]*):(?:\s+(.*)|\s*$)", line):
            key = pair[1].strip()
            out[key] = scalar(pair[2] or "")
    return out, text[m.end() :]


def links(text: str) -> list[str]:
    """Targets of [[...]] outside code, each once in order."""
    plain = _CODE.sub(lambda m: " " * len(m[0]), text)
    return list(dict.fromkeys(t.strip() for t in _LINK.findall(plain) if t.strip()))


def excerpt(text: str) -> str:
    line = " ".join((text.strip().split("\n") or [""])[0].split())
    return line if len(line) <= TITLE_LENGTH else line[: TITLE_LENGTH - 1] + "…"


class Units:
    """Sub-units in document order, with addresses: S1.2 for sections, S1.2P3 for leaves, S1T1R0C2 for cells."""

    def __init__(self):
        self.rows: list[dict] = []
        self.open: list[dict] = [{"address": "", "level": 0, "sections": 0, "tables": 0, "leaves": {}}]

    def add(self, kind: str, text: str, at: tuple[int, int], payload: str | None = None, address: str | None = None, parent: str | None = None, **properties) -> None:
        frame = self.open[-1]
        if address is None:
            letter = LETTERS[kind]
            frame["leaves"][letter] = frame["leaves"].get(letter, 0) + 1
            address = f"{frame['address']}{letter}{frame['leaves'][letter]}"
        self.rows.append(
            {"ordinal": len(self.rows), "kind": kind, "address": address, "parent_address": frame["address"] if parent is None else parent, "text": text, "payload": text if payload is None else payload,
             "properties": json.dumps(properties, ensure_ascii=False, sort_keys=True), "title": excerpt(text), "start_line": at[0], "end_line": at[1], "links": links(text)}
        )

    def section(self, level: int, text: str, line: int) -> None:
        while len(self.open) > 1 and self.open[-1]["level"] >= level:
            self.open.pop()
        above = self.open[-1]
        above["sections"] += 1
        address = f"{above['address']}.{above['sections']}" if above["address"] else f"S{above['sections']}"
        self.add("section", text, (line, line), address=address, parent=above["address"], **{"heading-level": level})
        self.open.append({"address": address, "level": level, "sections": 0, "tables": 0, "leaves": {}})

    def table(self, rows: list[list[str]], has_header: bool, line: int, step: int = 1) -> None:
        frame = self.open[-1]
        frame["tables"] += 1
        for r, row in enumerate(rows):
            at = line + (r + (1 if has_header and r else 0)) * step
            for c, cell in enumerate(row):
                head = rows[0][c] if has_header and r and c < len(rows[0]) else ""
                more = {"column-header": head} if head else {}
                self.add("table-cell", cell, (at, at), payload=f"{head}: {cell}" if head else cell, address=f"{frame['address']}T{frame['tables']}R{r}C{c}", header=has_header and r == 0, row=r, column=c, **more)


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def markdown_units(text: str) -> list[dict]:
    """Sub-units of a text without its front block. Sections hold what follows until a heading of their level."""
    units, lines, i = Units(), text.replace("\r\n", "\n").split("\n"), 0
    begins = lambda s: bool(_HEADING.match(s) or _FENCE.match(s) or _RULE.match(s) or _ITEM.match(s) or s.lstrip().startswith(">"))
    while i < len(lines):
        line, at = lines[i], i
        if not line.strip() or (_RULE.match(line) and not _HEADING.match(line)):
            i += 1
        elif m := _HEADING.match(line):
            units.section(len(m[1]), (m[2] or "").strip(), i + 1)
            i += 1
        elif m := _FENCE.match(line):
            i += 1
            closing = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            while i < len(lines) and not closing.match(lines[i]):
                i += 1
            units.add("code-block", "".join(x + "\n" for x in lines[at + 1 : i]), (at + 1, min(i + 1, len(lines))), **({"lang": m[2]} if m[2] else {}))
            i += 1
        elif line.lstrip().startswith(">"):
            while i < len(lines) and lines[i].strip() and (lines[i].lstrip().startswith(">") or not begins(lines[i])):
                i += 1
            body = [re.sub(r"^(?: {0,3}> ?)+", "", x).strip() for x in lines[at:i]]
            units.add("blockquote", "\n".join(x for x in body if x), (at + 1, i))
        elif m := _ITEM.match(line):
            i += 1
            while i < len(lines) and lines[i].strip() and not begins(lines[i].lstrip()):
                i += 1
            body = "\n".join([line[m.end() :].strip(), *(x.strip() for x in lines[at + 1 : i])])
            task = re.match(r"\[([ xX])\][ \t]+", body)
            units.add("list-item", body[task.end() :] if task else body, (at + 1, i), **({"checkbox": task[1] != " "} if task else {}))
            # Items below this one are items of the same section.
            while i < len(lines) and (nested := re.match(r"[ \t]+(?=(?:[-+*]|\d{1,9}[.)])[ \t])", lines[i])):
                lines[i] = lines[i][nested.end() :]
                break
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _ALIGN.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            i += 2
            while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                i += 1
            head = _cells(line)
            body = [(_cells(x) + [""] * len(head))[: len(head)] for x in lines[at + 2 : i]]
            units.table([head, *body], True, at + 1)
        else:
            i += 1
            while i < len(lines) and lines[i].strip() and not begins(lines[i]) and not re.match(r" {0,3}(?:=+|-+)[ \t]*$", lines[i]):
                i += 1
            if i < len(lines) and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[i])):
                units.section(1 if m[1][0] == "=" else 2, " ".join(x.strip() for x in lines[at:i]), at + 1)
                i += 1
            else:
                units.add("paragraph", "\n".join(x.strip() for x in lines[at:i]), (at + 1, i))
    return units.rows


# Elements that end a block of text, and those whose content isn't shown.
BLOCKS = frozenset("p div section article h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table tr td th header footer main aside nav".split())
UNSEEN = frozenset({"head", "script", "style"})


class _Page(HTMLParser):
    """Blocks of text, sub-units, meta directives and links of a page in one pass."""

    def __init__(self, prefix: str):
        super().__init__(convert_charrefs=True)
        self.prefix, self.meta, self.hrefs, self.blocks, self.units = prefix, [], [], [], Units()
        self.text: list[str] = []
        self.unseen: list[str] = []
        self.leaf: tuple[str, list[str], int] | None = None
        self.rows: list[list[str]] | None = None
        self.head, self.table_line = False, 0

    def flush(self) -> None:
        if block := " ".join(" ".join(self.text).split()):
            self.blocks.append(block)
        self.text = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name", "").startswith(self.prefix):
            self.meta.append((a["name"][len(self.prefix) :], a.get("content", "")))
        if tag == "a" and a.get("href"):
            self.hrefs.append(a["href"])
        if tag in UNSEEN:
            self.unseen.append(tag)
        elif tag == "body":
            self.unseen = []
        if self.unseen:
            return
        if tag in BLOCKS:
            self.flush()
        line = self.getpos()[0]
        if tag == "table":
            self.rows, self.head, self.table_line = [], False, line
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        kind = {"p": "paragraph", "li": "list-item", "blockquote": "blockquote", "pre": "code-block", "td": "cell", "th": "cell"}.get(tag, tag if re.fullmatch("h[1-6]", tag) else None)
        if kind and not (self.leaf and self.leaf[0] in ("blockquote", "code-block", "cell") and kind == "paragraph"):
            self.close(line)
            self.leaf = (kind, [], line)
            self.head |= tag == "th"

    def close(self, line: int) -> None:
        if self.leaf is None:
            return
        kind, parts, at = self.leaf
        self.leaf = None
        raw = "".join(parts)
        text = raw if kind == "code-block" else " ".join(raw.split())
        if kind == "cell":
            if self.rows is not None:
                (self.rows or self.rows.append([]) or self.rows)[-1].append(text)
        elif kind[0] == "h" and len(kind) == 2:
            self.units.section(int(kind[1]), text, at)
        elif text:
            self.units.add(kind, text, (at, line))

    def handle_endtag(self, tag):
        if self.unseen:
            if tag in self.unseen:
                del self.unseen[self.unseen.index(tag) :]
            return
        if tag in BLOCKS:
            self.flush()
        if tag in ("p", "li", "blockquote", "pre", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6") and not (tag == "p" and self.leaf and self.leaf[0] != "paragraph"):
            self.close(self.getpos()[0])
        if tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                self.units.table(rows, self.head, self.table_line, 0)

    def handle_data(self, data):
        if self.unseen:
            return
        self.text.append(data)
        if self.leaf:
            self.leaf[1].append(data)


def read_page(source: str, prefix: str = "node:") -> _Page:
    page = _Page(prefix)
    page.feed(source or "")
    page.close(page.getpos()[0])
    page.flush()
    return page


def page_text(source: str | None) -> str:
    """Plain text of a page: blocks apart by an empty line, white space inside a block one space."""
    return "\n\n".join(read_page(source or "").blocks)


def parse_file(path: str, source: str, default_type: str | None = None, prefix: str = "node:") -> dict:
    """A file as a node: type, title, properties (JSON), body, units and links; error says why it is none."""
    html = path.lower().endswith((".html", ".htm"))
    if html:
        page = read_page(source, prefix)
        properties: dict[str, object] = {}
        for k, v in page.meta:
            held = properties.get(k)
            properties[k] = v if held is None else [*(held if isinstance(held, list) else [held]), v]
        body, units, found = "\n\n".join(page.blocks), page.units.rows, [h for h in page.hrefs if not re.match(r"[a-z][a-z0-9+.-]*:|//|#", h)]
    else:
        properties, body = front_block(source)
        units, found = markdown_units(body), links(body)
        before = source[: len(source) - len(body)].count("\n")
        for u in units:
            u["start_line"] += before
            u["end_line"] += before
    kind = properties.pop("type", None) or default_type
    title = properties.pop("title", None) or next((u["text"] for u in units if u["kind"] == "section"), None) or posixpath.splitext(posixpath.basename(path))[0]
    return {"type": kind, "title": str(title), "properties": json.dumps(properties, ensure_ascii=False, sort_keys=True), "body": body, "units": units, "links": found, "error": None if kind else "no type"}


COLUMNS = ("id", "path", "type", "title", "properties", "body", "content_hash", "units", "links", "error")
_SHAPES = {"units": f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in UNIT.split(', '))}>>", "links": "array<string>"}
UNITS = _SHAPES["units"]
NODE = ", ".join(f"{c} {_SHAPES.get(c, 'string')}" for c in COLUMNS)


#: Paths that are opened by name; more of them are found by a join with all that is there.
LISTED = 10_000


def reserved(id_: Column) -> Column:
    """Ids that no file may have: # parts a file from a sub-unit, and reindex: names the index's own work."""
    return F.contains(id_, F.lit("#")) | F.startswith(id_, F.lit("reindex:"))


def listing(spark: SparkSession, root: str, ignore: str | None = None) -> DataFrame:
    """(file, path, modified, size) of what may be a node below root; file is where it lies. No content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx,html,htm}").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    rows = found.select(F.col("path").alias("file"), F.element_at(F.split(F.col("path"), re.escape(base), 2), -1).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return rows.where(~F.col("path").rlike(ignore)) if ignore else rows


def scan(spark: SparkSession, root: str, stored: DataFrame | None = None, default_type: str | None = None, ignore: str | None = None, prefix: str = "node:") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, state, faults) of a folder. nodes are the files that are new or whose time or size differ from those
    stored (path, content_hash, modified, size, state, generation): only these are opened. state is what to store next:
    listed files are live, a generation on, with their old hash where they weren't read, and others are tombstones. faults
    (path, error) are files of reserved ids. Where more than LISTED files have changed, whole folders are read, in which no
    other file may have a colon in its name, as Hadoop's readers can't open it."""
    there = kept(listing(spark, root, ignore), slim=True)
    id_ = F.regexp_replace("path", r"\.md$", "")
    good, bad = there.where(~reserved(id_)), there.where(reserved(id_))
    if stored is None:
        stored = spark.createDataFrame([], "path string, content_hash string, modified timestamp, size long, state string, generation int")
    todo = queue.to_read(stored, good)
    some = [r[0] for r in todo.select("file").limit(LISTED + 1).collect()]
    if not some:
        opened = good.limit(0).select("file", "path").withColumn("content", F.lit(b""))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([glob_free(f) for f in some] if len(some) <= LISTED else root)
        files = files.select(F.col("path").alias("file"), "content")
        opened = files.join(todo.select("file", "path"), "file")
    nodes = kept(parsed(opened.select("path", F.decode("content", "UTF-8").alias("source"), F.sha2("content", 256).alias("content_hash")), default_type, prefix))
    last = stored.agg(F.max("generation")).first()[0] or 0
    known = good.join(nodes.select("path", "content_hash"), "path", "left").join(stored.where("state = 'live'").select("path", F.col("content_hash").alias("_old")), "path", "left")
    state = queue.walk_state(stored, known.withColumn("content_hash", F.coalesce("content_hash", "_old")), last + 1)
    return nodes, state, bad.select("path", F.lit("reserved id").alias("error"))


def glob_free(path: str) -> str:
    """A path of one file whose signs aren't taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_folder(spark: SparkSession, root: str, default_type: str | None = None, ignore: str | None = None, prefix: str = "node:") -> DataFrame:
    """A row a file below root; ids are paths without .md. ignore: a pattern of paths left out. Files of reserved ids are none."""
    return scan(spark, root, None, default_type, ignore, prefix)[0]


def parsed(rows: DataFrame, default_type: str | None = None, prefix: str = "node:") -> DataFrame:
    """Rows (path, source, content_hash) as nodes with their sub-units."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Nodes are several times their source, so a few are made and handed on at a time.
            part = frame.source.str.len().fillna(0).cumsum() // PARSED
            for _, few in frame.groupby(part.to_numpy(), sort=False):
                out = [{"id": p.removesuffix(".md"), "path": p, "content_hash": h} | parse_file(p, s or "", default_type, prefix) for p, s, h in zip(few.path, few.source, few.content_hash, strict=True)]
                yield pd.DataFrame(out, columns=list(COLUMNS))

    return rows.select("path", "source", "content_hash").mapInPandas(run, NODE)


def units_of(nodes: DataFrame) -> DataFrame:
    """(id, file, kind, ...) of all sub-units, with the sha256 of what is embedded."""
    rows = nodes.select(F.col("id").alias("file"), F.explode("units").alias("u")).select("file", "u.*")
    return rows.select(F.concat("file", F.lit("#"), "address").alias("id"), "*", F.sha2("payload", 256).alias("content_hash"))


def names(nodes: DataFrame) -> DataFrame:
    """(name, id, n): files by the name that links may use; n counts how many share it."""
    return nodes.groupBy(name_key(F.col("path")).alias("name")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def normalize(target: Column, path: Column) -> Column:
    """./ and ../ links as the ids they name; those that climb out, and all others, as they are."""

    @F.pandas_udf(StringType())
    def run(targets: pd.Series, paths: pd.Series) -> pd.Series:
        def one(t: str, p: str) -> str:
            if not t.startswith(("./", "../")):
                return t
            file, mark, rest = t.partition("#")
            joined = posixpath.normpath(posixpath.join(posixpath.dirname(p), file))
            return t if joined == "." or joined.split("/")[0] == ".." else joined + mark + rest

        return pd.Series([one(t, p) for t, p in zip(targets, paths, strict=True)], dtype=object)

    return run(target, path)


def resolved(nodes: DataFrame) -> DataFrame:
    """(source, link, target, state) of every link: an id, else the one file of that name, else ambiguous or dangling.

    A #heading or #^block that the file hasn't makes the state missing-heading or missing-block.
    """
    rows = nodes.select(F.col("id").alias("source"), "path", F.explode("links").alias("link")).withColumn("to", normalize(F.col("link"), F.col("path")))
    rows = rows.select("source", "link", F.regexp_replace(F.split_part("to", F.lit("#"), F.lit(1)), r"\.md$", "").alias("file"), F.when(F.contains("to", F.lit("#")), F.regexp_replace("to", "^[^#]*#", "")).alias("part"))
    by_id = nodes.select(F.col("id").alias("file"), F.col("id").alias("by_id")).distinct()
    by_name = names(nodes).select("name", F.col("id").alias("by_name"), "n")
    rows = rows.join(by_id, "file", "left").join(by_name, F.lower("file") == by_name.name, "left")
    own = F.when(F.col("file") == "", F.col("source"))
    rows = rows.select("source", "link", "part", F.coalesce(own, "by_id", F.when(F.col("n") == 1, F.col("by_name"))).alias("target"), F.col("n"), "file")
    heads = units_of(nodes).where("kind = 'section'").select(F.col("file").alias("target"), heading_key(F.col("text")).alias("key")).distinct().withColumn("has", F.lit(True))
    last = F.element_at(F.split("part", "#"), -1)
    rows = rows.withColumn("key", F.when(~F.startswith("part", F.lit("^")), heading_key(last))).join(heads, ["target", "key"], "left")
    blocks = nodes.select(F.col("id").alias("target"), F.explode(F.regexp_extract_all("body", F.lit(r"(?m)(?:^|\s)\^([A-Za-z0-9-]+)\s*$"), F.lit(1))).alias("b")).select("target", F.concat(F.lit("^"), F.lower("b")).alias("block")).distinct().withColumn("has_block", F.lit(True))
    rows = rows.withColumn("block", F.lower("part")).join(blocks, ["target", "block"], "left")
    state = (
        F.when(F.col("target").isNull(), F.when(F.col("n") > 1, "ambiguous").otherwise("dangling"))
        .when(F.col("key").isNotNull() & F.col("has").isNull(), "missing-heading")
        .when(F.startswith("part", F.lit("^")) & F.col("has_block").isNull(), "missing-block")
        .otherwise("found")
    )
    return rows.select("source", "link", F.coalesce("target", "file").alias("target"), state.alias("state"))
