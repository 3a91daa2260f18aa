"""Chunks and snippets of texts, keys of headings and paths."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Where chunks are cut, the best first, and sizes in bytes.
CUTS = (b"\n## ", b"\n### ", b"\n\n", b"\n", b". ", b" ")
TARGET, MOST, OVERLAP = 1600, 4000, 200
# Texts that are chunked before their chunks are packed.
AT_ONCE = 64
# Fixed value: bytes of a passage, at most.
PASSAGE = 2048
# Words of a query that don't place a snippet.
QUIET = frozenset(
    "a an and are as at be but by do does for from has have how i in is it its no not of on or that the to was what when where which who why will with you your".split()
)


def pieces(text: bytes, most: int, cuts: tuple[bytes, ...] = CUTS) -> list[bytes]:
    """Parts of at most `most` bytes; a cut stays at the head of what follows it."""
    out, todo = [], [(text, cuts)]
    while todo:
        part, left = todo.pop()
        left = next((left[i:] for i in range(len(left)) if left[i] in part), ())
        if not left:
            out += [part[i : i + most] for i in range(0, len(part), most)]
            continue
        head, *tail = part.split(left[0])
        split = [p for p in (head, *(left[0] + t for t in tail)) if p]
        todo += [(p, left[1:] if len(p) > most else ()) for p in reversed(split)]
    return out


def chunk(text: str | None, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Pieces joined up to `target` bytes; each chunk but the first opens with the end of the one before."""
    done: list[bytes] = []
    held = b""
    for piece in pieces((text or "").encode(), most):
        if held and len(held) + len(piece) > min(target, most):
            done.append(held)
            room = min(overlap, most - len(piece)) if overlap < len(held) else 0
            held = held[len(held) - room :]
        held += piece
    return [c.decode(errors="replace") for c in (*done, held)]


def chunks(text: Column) -> Column:
    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        # Only a few texts at a time are Python's strings.
        kind = pa.list_(pa.string())
        return pa.concat_arrays([pa.array([chunk(t) for t in texts.slice(i, AT_ONCE).to_pylist()], kind) for i in range(0, len(texts), AT_ONCE)] or [pa.array([], kind)])

    return run(text)


def snippet(text: str | None, query: str = "", most: int = 200) -> str:
    """At most `most` characters around the first word of the query, cut between words; else the beginning."""
    flat = re.sub(r"[\n\r\t ]+", " ", text or "").strip(" ")
    low = flat.lower()
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w and w not in QUIET]
    hits = [p for p in map(low.find, words) if p >= 0]
    if not hits or most <= 0:
        return "" if most <= 0 else flat if len(flat) <= most else flat[:most] + "…"
    hit = min(hits)
    begin, end = max(0, hit - most // 5), min(len(flat), hit + most - most // 5)
    if begin:
        begin = next((i for i in range(begin, hit) if flat[i - 1].isspace()), hit)
    if end < len(flat):
        end = next((i for i in range(end, hit, -1) if flat[i].isspace()), hit)
    return "…" * (begin > 0) + flat[begin:end] + "…" * (end < len(flat))


def snippets(text: Column, query: str, most: int = 200) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, query, most))

    return run(text)


def all_snippets(texts: Column, query: str, most: int = 200) -> Column:
    """snippets() of an array of texts."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: [snippet(t, query, most) for t in ts])

    return run(texts)


def passage(text: str, spans: list[tuple[int, int]], best: int, limit: int = PASSAGE) -> tuple[str, int, int]:
    """The lines, counted from 1, of the best span and of whole spans beside it, as long as all fit in `limit` bytes: first
    the one after, then the one before, in turn. A best span that doesn't fit gives its first lines that do, or the
    beginning of its first line up to a word's end."""
    lines = text.replace("\r\n", "\n").split("\n")

    def joined(low: int, high: int) -> tuple[str, int, int]:
        first, last = min(s[0] for s in spans[low : high + 1]), max(s[1] for s in spans[low : high + 1])
        return "\n".join(lines[first - 1 : last]).rstrip(), first, last

    def size(t: str) -> int:
        return len(t.encode())

    got = joined(best, best)
    if size(got[0]) > limit:
        first, last = spans[best]
        while last > first and size("\n".join(lines[first - 1 : last]).rstrip()) > limit:
            last -= 1
        whole = "\n".join(lines[first - 1 : last]).rstrip()
        if size(whole) <= limit:
            return whole, first, last
        cut = whole.encode()[:limit].decode(errors="ignore")
        return (cut[: cut.rindex(" ")] if " " in cut else cut) + "…", first, first
    low = high = best
    grown = True
    while grown:
        grown = False
        for a, b in ((low, high + 1), (low - 1, high)):
            a, b = min(a, low), max(b, high)
            if 0 <= a and b < len(spans) and (a, b) != (low, high) and size((more := joined(a, b))[0]) <= limit:
                low, high, got, grown = a, b, more, True
    return got


def passage_of(text: Column, spans: Column, best: Column, limit: int = PASSAGE) -> Column:
    """passage() of each row as a struct of text, first and last; null where there is no text or no best span."""

    @F.pandas_udf("text string, first int, last int")
    def run(texts: pd.Series, all_spans: pd.Series, at: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s, b in zip(texts, all_spans, at, strict=True):
            fits = t is not None and s is not None and not pd.isna(b) and 0 <= b < len(s)
            rows.append(passage(t, [tuple(x) for x in s], int(b), limit) if fits else (None, None, None))
        return pd.DataFrame(rows, columns=["text", "first", "last"])

    return run(text, spans, best)


def heading_key(text: Column) -> Column:
    """Letters, digits and marks in lower case, all else one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}\p{M}]+", " "))


def heading_key_of(text: str) -> str:
    return " ".join("".join(c if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd" else " " for c in text.lower()).split())


def name_key(path: Column) -> Column:
    """The file's name without its ending, in lower case."""
    return F.lower(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1))


def path_ancestors(path: Column) -> Column:
    """a/b/c as [a/b/c, a/b, a]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
