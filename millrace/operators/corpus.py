"""Documents to overlapping chunks with provenance."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.text import chunk_words, word_count, words

# Tags that begin a line, and tags whose text isn't visible.
LINE_TAGS = frozenset(
    "address article aside blockquote br dd div dl dt figcaption footer h1 h2 h3 h4 h5 h6 header li main nav p section table td th tr ul ol".split()
)
HIDDEN_TAGS = frozenset("script style noscript svg".split())


#: Markup, cut into comments and declarations, whole hidden elements, tags, and the text between.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<hidden>" + "|".join(sorted(HIDDEN_TAGS)) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|</?(?P<tag>[a-z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.I | re.S,
)


def visible(page: str | None) -> str:
    """What a reader sees: text between tags, a new line at each tag that begins or ends one."""
    out = []
    for m in _MARKUP.finditer(page or ""):
        if m["text"]:
            out.append(html.unescape(m["text"]))
        elif m["tag"] and m["tag"].lower() in LINE_TAGS:
            out.append("\n")
    return "".join(out)


@F.pandas_udf(StringType())
def visible_text(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text outside scripts and styles, with line breaks where block elements begin and end."""
    for s in it:
        yield s.map(visible)


def unit_chunks(units: DataFrame, max_words: int = 220, overlap: int = 40, source: str = "source_id", unit: str = "unit_index", text: str = "text") -> DataFrame:
    """A row per chunk of each unit, without its number within the source: a map, no shuffle."""
    kept = [c for c in units.columns if c != text]
    made = units.withColumn("__w", words(F.col(text))).withColumn("__c", chunk_words(F.col("__w"), max_words, overlap))
    # outer, as otherwise a filter on the list's size is put below and works the list out again
    d = made.select(*kept, F.posexplode_outer("__c").alias("__i", "text")).where(F.col("text").isNotNull())
    d = d.withColumns({"text_sha256": F.sha2("text", 256), "word_count": word_count(F.col("text")).cast("long")})
    return d.select(*kept, chunk_id(F.col(source), F.col(unit), F.col("__i") + 1, F.col("text_sha256")).alias("chunk_id"), (F.col("__i") + 1).cast("long").alias("unit_chunk_index"), "word_count", "text_sha256", "text")


def chunks(units: DataFrame, max_words: int = 220, overlap: int = 40, source: str = "source_id", unit: str = "unit_index", text: str = "text") -> DataFrame:
    """A row per chunk: ids, places, counts and checksum, beside the unit's own columns.

    ``text`` is normalised already. ``source_chunk_index`` numbers a source's chunks: a
    unit's own chunks by place, on top of the chunks of the units before it. These come from
    one number per unit, so that no task sorts a source's texts.
    """
    step = F.lit(max_words - overlap)
    n = word_count(F.col(text))
    many = F.when(n > 0, F.ceil(F.greatest(n - max_words, F.lit(0)) / step) + 1).otherwise(0)
    per = units.select(F.col(source).alias("__source"), F.col(unit).alias("__unit"), many.alias("__n")).groupBy("__source", "__unit").agg(F.sum("__n").alias("__n"))
    before = W.partitionBy("__source").orderBy("__unit").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    d = unit_chunks(units, max_words, overlap, source, unit, text).join(per, F.col(source).eqNullSafe(F.col("__source")) & F.col(unit).eqNullSafe(F.col("__unit")))
    kept = [c for c in units.columns if c != text]
    return d.select(*kept, "chunk_id", "unit_chunk_index", (F.col("__before") + F.col("unit_chunk_index")).cast("long").alias("source_chunk_index"), "word_count", "text_sha256", "text")


def chunk_id(source: Column, unit: Column, index: Column, sha: Column) -> Column:
    return F.concat(source.cast("string"), F.lit("::u"), F.format_string("%04d", unit.cast("long")), F.lit("::c"), F.format_string("%04d", index.cast("long")), F.lit("::"), F.substring(sha, 1, 12))


def source_checks(units: DataFrame, markers: list[str], minimum_words: int, source: str = "source_id", text: str = "text") -> DataFrame:
    """(source, words, enough_words, missing_markers): which sources look incomplete. Markers are looked for in any unit, without case."""
    low = F.lower(F.col(text))
    seen = [F.max(low.contains(m.lower())).alias(f"m{i}") for i, m in enumerate(markers)]
    d = units.groupBy(source).agg(F.sum(word_count(F.col(text))).alias("words"), *seen)
    lost = F.filter(F.array(*[F.when(~F.col(f"m{i}"), F.lit(m)) for i, m in enumerate(markers)]), lambda x: x.isNotNull()) if markers else F.array().cast("array<string>")
    return d.select(source, "words", (F.col("words") >= minimum_words).alias("enough_words"), lost.alias("missing_markers"))
