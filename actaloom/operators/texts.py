"""Pages as one text a key, and claims checked against texts without moving the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaloom.session import cut

#: Keys of several texts, and claims, up to which they are broadcast (some 100 bytes each).
FEW = 100_000


def one_text(pages: DataFrame, rel: str, text: str) -> DataFrame:
    """(rel, text): pages without a null key; of several texts of one key the least, so that no run mixes them.

    Repeated rows of one text stay. Only hashes are shuffled, and the texts of keys that have several.
    """
    rows = pages.select(F.col(rel).cast("string").alias("rel"), F.col(text).cast("string").alias("text")).filter(F.col("rel").isNotNull())
    h = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    several = cut(rows.select("rel", h.alias("h")).groupBy("rel").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count_if(F.col("h").isNull()).alias("n")).filter("a <> b or n > 0 and a is not null").select("rel"))
    if not (count := several.count()):
        return rows
    several = F.broadcast(several) if count <= FEW else several
    least = rows.join(several, "rel", "left_semi").groupBy("rel").agg(F.min("text").alias("text"))
    return rows.join(several, "rel", "left_anti").unionByName(least)


def supported(claims: DataFrame, key: str, quote: str, pages: DataFrame, page_key: str, text: str) -> DataFrame:
    """Distinct claims that have a page, with `supported`: whether the page's text holds the quote.

    Few claims are broadcast to the texts, which are scanned where they lie; many are joined by
    a shuffle. Of several texts of one page the least counts.
    """
    asked = cut(claims.filter(F.col(key).isNotNull() & F.col(quote).isNotNull()).distinct())
    texts = one_text(pages, page_key, text).filter("text is not null")
    side = F.broadcast(asked) if asked.count() <= FEW else asked
    hits = texts.join(side, texts["rel"] == side[key]).select(*(F.col(c) for c in claims.columns), F.col("text").contains(F.col(quote)).alias("supported"))
    return hits.distinct()
