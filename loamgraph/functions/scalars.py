"""Scalar functions beside those of text, passages and time."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def regexp(pattern: str | Column, value: Column) -> Column:
    """Whether the pattern is found in the value; null where either is null."""
    return F.rlike(value, F.lit(pattern) if isinstance(pattern, str) else pattern)


def register(spark: SparkSession) -> None:
    """regexp(pattern, value) for SQL, as a temporary function of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION regexp_of(pattern STRING, value STRING) RETURNS BOOLEAN RETURN value RLIKE pattern")


def clip(c: Column) -> Column:
    """Into 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def shown(score: Column) -> Column:
    """A score as it is shown: three decimals."""
    return F.round(score, 3)


def name_of(path: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def block_key(name: Column) -> Column:
    return F.concat(F.lit("^"), F.lower(name))


def fragment(link: Column) -> tuple[Column, Column]:
    """A link's page and what follows its first #, null without one; an alias after | is left out."""
    bare = F.substring_index(link, "|", 1)
    at = F.instr(bare, "#")
    return F.trim(F.when(at > 0, F.substring(bare, F.lit(1), at - 1)).otherwise(bare)), F.when(at > 0, F.substring(bare, at + 1, F.length(bare)))


def path_clean(text: Column) -> Column:
    """A path without ./ before it, doubled slashes and slashes at its ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^(\./)+", ""), "/+", "/"), F.lit("/"))


def header(title: Column, headings: Column) -> Column:
    """A leaf's place in its file: title > heading > heading, empty ones left out."""
    return F.array_join(F.filter(F.concat(F.array(title), F.coalesce(headings, F.array())), lambda x: x.isNotNull() & (F.trim(x) != "")), " > ")


def payload(body: Column, title: Column, mode: str = "full", front: Column | None = None, prefix: str = "") -> Column:
    """What of a text is embedded: after the front block (full), the title (title) or nothing (none); {title} in the prefix
    stands for the title."""
    head = {"full": front if front is not None else title, "title": title, "none": F.lit(None)}[mode]
    given = F.replace(F.lit(prefix), F.lit("{title}"), F.coalesce(title, F.lit("")))
    return F.concat(given, F.concat_ws("\n\n", F.when(F.trim(head) != "", head) if mode != "none" else F.lit(None).cast("string"), body))

