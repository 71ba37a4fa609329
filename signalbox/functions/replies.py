"""Parts of model replies: joined texts, client views of sources, error classes, retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbox.functions.text import text_of


def reply_text(parts: Column) -> Column:
    """The text of a reply's parts (thought boolean, text string), without its thoughts."""
    return F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: text_of(p["text"])), "")


def error_class(status: Column, message: Column) -> Column:
    """What kind of failure a reply is: auth, quota, network, model, request or other."""
    m = F.lower(text_of(message))
    return (
        F.when(status.isin(401, 403), "auth").when(status == 429, "quota").when((status == 404) | m.rlike("model .*not found"), "model")
        .when(m.rlike("fetch failed|econn|network|timed? ?out"), "network").when(status.between(400, 499), "request").otherwise("other")
    )


def error_status(kind: Column) -> Column:
    """The status that a client gets for a kind of failure."""
    return F.when(kind == "auth", 503).when(kind == "quota", 429).when(kind == "network", 502).when(kind == "model", 503).otherwise(500)


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Milliseconds to wait before an attempt: as asked for up to thirty seconds, else doubling from one to twenty."""
    return F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(30_000))).otherwise(F.least(F.lit(1000) * F.pow(F.lit(2), attempt), F.lit(20_000))).cast("bigint")


def number_or(value: Column, default: float, least: float | None = None) -> Column:
    """A setting as a number: over zero (or from ``least`` on), else the default."""
    n = value.try_cast("double")
    ok = n > 0 if least is None else n >= least
    return F.when(ok & ~F.isnan(n) & (n < float("inf")), n).otherwise(F.lit(float(default)))


def client_sources(sources: Column) -> Column:
    """The fields of sources that a client sees."""
    names = ("document_id", "source", "original_name", "document_number", "document_type", "title", "page", "score")
    return F.transform(sources, lambda s: F.struct(*[s[n].alias(n) for n in names]))
