"""Text functions; built-ins wherever one can say it."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no content, and the patterns of the tokens.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how",
    "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was",
    "what", "when", "where", "which", "with",
)
CONTENT_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_-]*"
WORD_TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"
MARKER = r"\[([A-Z][A-Z0-9]*)\]"


def words(t: Column) -> Column:
    """White-space words; an empty text has none."""
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def word_tokens(t: Column) -> Column:
    """Runs of two or more letters, digits or underscores, lower case."""
    return F.regexp_extract_all(F.lower(t), F.lit(WORD_TOKEN), F.lit(0))


def bigrams(tokens: Column) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def terms(tokens: Column) -> Column:
    """Unigrams and bigrams of a column of tokens (a column, as an expression would be worked out for each use)."""
    return F.concat(tokens, bigrams(tokens))


def content_tokens(t: Column) -> Column:
    k = F.transform(F.regexp_extract_all(t, F.lit(CONTENT_TOKEN), F.lit(0)), lambda x: F.lower(x))
    return F.filter(k, lambda x: (F.length(x) > 1) & ~x.isin(*STOPWORDS))


def coverage_share(query: Column, text: Column) -> Column:
    """Share of the query's distinct content tokens that the text has; null for a query without any."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, text)) / F.size(q))


def phrase_share(query: Column, text: Column) -> Column:
    """Share of the query's distinct neighbouring pairs that the text has; 0 for fewer than two tokens."""
    q = F.array_distinct(bigrams(query))
    return F.when(F.size(query) >= 2, F.size(F.array_intersect(q, bigrams(text))) / F.size(q)).otherwise(F.lit(0.0))


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(t), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def normalized(t: Column) -> Column:
    """Lower case, white space single."""
    return F.regexp_replace(F.trim(F.lower(t)), r"\s+", " ")


def markers(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(MARKER), F.lit(1))


def chunk_words(w: Column, max_words: int, overlap: int) -> Column:
    """Overlapping runs of words of a column (not an expression, which each chunk would work out again); the chunk that reaches the end is the last. Short tails stay: they hold more than the overlap, so merging them back would pass the limit."""
    if not 0 <= overlap < max_words:
        raise ValueError("the overlap must be smaller than the chunk")
    step = max_words - overlap
    last = F.ceil(F.greatest(F.size(w) - F.lit(max_words), F.lit(0)) / F.lit(step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, max_words), " "))
    return F.when(F.size(w) > 0, cut).otherwise(F.array().cast("array<string>"))


def normalize(text: str | None) -> str:
    """Compatibility characters and references resolved, lines joined to paragraphs, a blank line between these."""
    t = html.unescape(unicodedata.normalize("NFKC", text or "")).replace("\u00a0", " ").replace("\r\n", "\n").replace("\r", "\n")
    paragraphs = re.split(r"\n(?:[ \t\f\v]*\n)+", "\n".join(re.sub(r"[ \t\f\v]+", " ", x).strip() for x in t.split("\n")))
    return "\n\n".join(p for p in (re.sub(r"[ \t\f\v]+", " ", " ".join(x for x in q.split("\n") if x)).strip() for q in paragraphs) if p)


@F.pandas_udf(StringType())
def normalize_text(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """No built-in does compatibility normalisation, so this one is an Arrow UDF."""
    for s in it:
        yield s.map(normalize)
