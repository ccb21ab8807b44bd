"""Responses that other jobs landed, as tables: keys, decoding, a cache of responses, what is left to fetch, thin articles."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import text as T
from lectern.sources import web

#: Words below which a fetched article counts as thin.
THIN_WORDS = 400
RESPONSE = "url string, final_url string, status int, content_type string, body binary"


def url_key(url: Column) -> Column:
    return F.substring(F.sha2(url.cast("binary"), 256), 1, 32)


def is_pdf(content_type: Column, body: Column) -> Column:
    magic = F.substring(body, 1, 5) == F.lit("%PDF-").cast("binary")
    return F.coalesce(F.lower(content_type).contains("pdf"), F.lit(False)) | F.coalesce(magic, F.lit(False))


def decode_bytes(body: bytes | None, charset: str | None = None) -> str | None:
    """Text of a body: by its header's charset, else the first of UTF-8, Windows-1252 and Latin-1 that fits."""
    if body is None:
        return None
    for name in filter(None, (charset, "utf-8", "cp1252")):
        try:
            return body.decode(name)
        except (UnicodeDecodeError, LookupError, ValueError):
            pass
    return body.decode("latin-1")


@F.pandas_udf(StringType())
def _decoded(body: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(b, c) for b, c in zip(body, charset, strict=True)], dtype=object)


def decoded(body: Column, content_type: Column) -> Column:
    """Text of response bodies by the charset of their content type and the fallbacks, in Arrow batches."""
    return _decoded(body, F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), "charset=([^;]*)", 1)))


def cached(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """The newest usable response per asked url (``cache``: key, the response, fetched_at); without a body it is a miss."""
    wanted = cache.where("body is not null").join(asked.select(url_key(F.col("url")).alias("key")).distinct(), "key", "left_semi")
    # The newest row is chosen by narrow columns, equal times by the body's digest; bodies join afterwards.
    wanted = wanted.withColumn("__mark", F.struct("fetched_at", F.sha2("body", 256).alias("digest")))
    newest = wanted.groupBy("key").agg(F.max("__mark").alias("__mark"))
    hits = wanted.join(newest, ["key", "__mark"]).select("key", F.struct("final_url", "status", "content_type", "body").alias("r")).dropDuplicates(["key"])
    rows = asked.select("url", url_key(F.col("url")).alias("key")).distinct().join(hits, "key")
    filled = F.coalesce("r.final_url", "url"), F.coalesce("r.status", F.lit(200)), F.coalesce("r.content_type", F.lit(""))
    return rows.select("key", "url", filled[0].alias("final_url"), filled[1].alias("status"), filled[2].alias("content_type"), "r.body")


def to_fetch(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Each url once that the cache can't serve: url, key."""
    rows = asked.select("url", url_key(F.col("url")).alias("key")).where("url is not null").distinct()
    return rows.join(cache.where("body is not null").select("key").distinct(), "key", "left_anti")


def fetch(missing: DataFrame, get: Callable[[str, bool], tuple[str, int, str, bytes]]) -> DataFrame:
    """Responses by ``get(url, plain) -> (final_url, status, content_type, body)``; a refusal (403) is tried once more, plainly.

    An exception of ``get`` is a row without status and body, whose content_type says what happened.
    """

    def one(url):
        try:
            got = get(url, False)
            return (url, *(get(url, True) if got[1] == 403 else got))
        except Exception as e:  # noqa: BLE001  any failure of one address is its row's
            return (url, url, None, f"error: {type(e).__name__}: {e}", None)

    def run(frames):
        for pdf in frames:
            rows = pd.DataFrame([one(url) for url in pdf["url"]], columns=["url", "final_url", "status", "content_type", "body"])
            yield rows.astype({"status": "Int32"})

    return missing.select("url").mapInPandas(run, RESPONSE)


def to_cache(responses: DataFrame, fetched_at: Column) -> DataFrame:
    """Cache rows of usable responses, to be appended: key, final_url, status, content_type, body, fetched_at.

    Of the responses of one key the newest is kept, of equal times that of the greatest digest of the body, as ``cached`` chooses.
    """
    names = ("final_url", "status", "content_type")
    good = responses.where("body is not null and status between 200 and 299").select(url_key(F.col("url")).alias("key"), *names, "body", fetched_at.alias("fetched_at"))
    mark = F.struct("fetched_at", F.sha2("body", 256), *names)
    return good.groupBy("key").agg(F.max_by(F.struct(*names, "body", "fetched_at"), mark).alias("r")).select("key", "r.*")


def thin_articles(pages: DataFrame, blocks: DataFrame, least: int = THIN_WORDS) -> DataFrame:
    """page_id, words, thin, gated: how much text each page gave, and whether a thin one carries paywall marks."""
    words = blocks.groupBy(F.col("doc_id").alias("page_id")).agg(F.sum(T.words(F.col("text"))).cast("long").alias("words"))
    marks = F.size(web.paywall_markers(F.coalesce("html", F.lit("")))) > 0
    rows = pages.select("page_id", marks.alias("marked")).join(words, "page_id", "left").withColumn("words", F.coalesce("words", F.lit(0)).cast("long"))
    thin = F.col("words") < least
    return rows.select("page_id", "words", thin.alias("thin"), (thin & F.col("marked")).alias("gated"))
