"""Words of a text for lexical ranking."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common words that carry no topic, and endings that are cut, in this order.
STOPWORDS = """
a all also an and any are as at be but by can do does each every for from
has have how i if in into is it its no not of on only or so than that the
their them then there these they this those to was what when where which
who why will with you your
""".split()
SUFFIXES = "ingly edly ing ers er ed ly es s".split()
LEAST_STEM = 3
#: What a word that has anything to cut ends in.
LAST = "e" + "".join({s[-1] for s in SUFFIXES})


def stem(token: Column) -> Column:
    """The first fitting ending is cut if three bytes stay, and then a last e likewise."""
    out = token
    for s in reversed(SUFFIXES):
        fits = token.endswith(s) & (F.octet_length(token) - len(s) >= LEAST_STEM)
        out = F.when(fits, F.substring(token, 1, F.length(token) - len(s))).otherwise(out)
    return F.when(out.endswith("e") & (F.octet_length(out) > LEAST_STEM), F.substring(out, 1, F.length(out) - 1)).otherwise(out)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits but the stopwords, stemmed."""
    return F.transform(plain_words(text), stem)


def words_of(text: str) -> list[str]:
    """A short text's words in plain Python: lower-case runs of letters and digits but the stopwords."""
    letters = "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in text.lower())
    return [w for w in letters.split() if w not in STOPWORDS]


def stem_of(word: str) -> str:
    """stem() of one word in plain Python."""
    if word[-1:] not in LAST:
        return word
    cut = lambda w, n: len(w.encode()) - n >= LEAST_STEM
    word = next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and cut(word, len(s))), word)
    return word[:-1] if word.endswith("e") and cut(word, 1) else word


def terms_of(query: str) -> list[str]:
    """The distinct stems of a query, in order."""
    return list(dict.fromkeys(map(stem_of, words_of(query))))


def forms_of(term: str) -> list[str]:
    """All words with this stem: a stem only loses a listed ending and a last e, so they are few."""
    tried = [term + e + s for e in ("", "e") for s in ("", *SUFFIXES)]
    return [w for w in tried if stem_of(w) == term and w not in STOPWORDS]


NO_WORD = r"[^\p{L}\p{Nd}]+"


def spaced_words(text: Column) -> Column:
    """A text's words, stopwords too, in lower case with one space between."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_WORD, " ")


def plain_words(text: Column) -> Column:
    """tokens() before they are stemmed."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD)
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS))
