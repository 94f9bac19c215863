"""URL filters as a temporal list join.

List changes (list, pattern, action ``add``/``remove``, day) become validity intervals
[valid_from, valid_to) with one window per (list, pattern).  A capture is looked up under every pattern that
can cover it, from the most to the least specific: its URL, all directories of its path from the deepest, its
host, and all parent domains of two labels or more from the longest.  Keys deeper than any listed
pattern aren't built.  Captures of one URL and day are judged once: their keys are exploded, joined to
the intervals that share the pattern (one array row per pattern), filtered as of the day of the fetch and
reduced to one row, which joins back to the captures.  Keys and URLs that hold more than a
thousandth of the rows, a thousand at most, are joined by broadcast (``shared.join_unique``).

The most specific key with an active entry decides; on one key ``allow`` lists win over others,
then the first list name.  Defined cases: a null or hostless URL, a null fetch day and an empty
list give verdict ``none``; repeated changes have no effect; on one day the removal is the last;
a change with a null field is ignored; repeated captures are judged one by one.  Extra columns pass
through; columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castplan.llm.shared import join_unique, materialize, without

ADDED = ["host", "verdict", "matched_list", "matched_pattern", "valid_from", "n_active"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """``(host, path)`` of a URL (lower-cased, without scheme, user, port, query and fragment)."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/]*)", 1), r"(^.*@)|(:[0-9]*$)", "")
    return F.when(host != "", host), F.regexp_extract(bare, r"^[^/]*(/.*)?$", 1)


def url_keys(url: Column, most_labels: int = 127, most_parts: int = 127) -> Column:
    """All patterns that cover a URL, the most specific first; null without a host.  Parent domains of more
    labels and directories of more parts than the given numbers are left out."""
    host, path = url_parts(url)
    page = F.regexp_replace(path, r"/+$", "")
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    n, m = F.size(labels), F.size(parts)
    top, deep = F.greatest(F.lit(2), n - (most_labels - 1)), F.least(m - 1, F.lit(most_parts))
    no = F.array().cast("array<string>")
    parents = F.when(n - 1 >= top, F.transform(F.sequence(top, n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(no)
    folders = F.when(deep >= 2, F.transform(F.sequence(deep, F.lit(2), F.lit(-1)),
                                            lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(no)
    own = F.when(page != "", F.array(F.concat(host, page))).otherwise(no)
    return F.when(host.isNotNull(), F.concat(own, folders, F.array(host), parents))


def validity_intervals(changes: DataFrame) -> DataFrame:
    """``(list_name, pattern, valid_from, valid_to)``: days on which an entry is active."""
    own = (changes.select("list_name", F.lower("pattern").alias("pattern"), "action", "day")
           .where("list_name IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')"))
    per_day = own.groupBy("list_name", "pattern", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list_name", "pattern").orderBy("day")
    steps = per_day.withColumn("was", F.lag("action").over(order)).where("was IS NULL OR was <> action")
    steps = steps.withColumn("valid_to", F.lead("day").over(order))
    return steps.where("action = 'add'").select("list_name", "pattern", F.col("day").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, changes: DataFrame, url_col: str = "url", time_col: str = "fetched_on",
                allow_lists: tuple = ("allow",)) -> DataFrame:
    """``captures`` plus the columns of ``ADDED``: the verdict (``block``, ``allow``, ``none``), the
    entry that decides and the number of active entries over all keys."""
    base = without(captures, *[c for c in ADDED if c not in (url_col, time_col)])
    spans = validity_intervals(changes)
    by_pattern = materialize(spans.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct(
        (~F.col("list_name").isin(*allow_lists)).alias("blocks"), "list_name", "valid_from", "valid_to"))).alias("spans")), "patterns")
    domain = F.split(F.substring_index("pattern", "/", 1), r"\.")
    folder = F.size(F.split("pattern", "/"))
    depth = by_pattern.agg(F.coalesce(F.max(F.size(domain)), F.lit(0)), F.coalesce(F.max(folder), F.lit(0))).first()
    url, day = F.col(url_col), F.col(time_col)
    once = base.select(url.alias("_url"), day.alias("_day")).where("_url IS NOT NULL AND _day IS NOT NULL").distinct()
    keyed = materialize(once.select("_url", "_day", F.posexplode(url_keys(F.col("_url"), *depth)).alias("rank", "pattern")), "url-keys")
    found = join_unique(keyed, by_pattern, ["pattern"], "inner").withColumn("live", F.filter(
        "spans", lambda s: (s["valid_from"] <= F.col("_day")) & (s["valid_to"].isNull() | (F.col("_day") < s["valid_to"])))).where(F.size("live") > 0)
    judged = materialize(found.groupBy("_url", "_day").agg(
        F.min(F.struct("rank", F.element_at("live", 1).alias("e"), F.col("pattern").alias("p"))).alias("_best"), F.sum(F.size("live")).alias("_n")), "judged")
    out = join_unique(base.withColumns({"_url": url, "_day": day}), judged, ["_url", "_day"], "left")
    verdict = F.when(F.col("_best").isNull(), "none").when(F.col("_best.e.blocks"), "block").otherwise("allow")
    return out.select(*base.columns, url_parts(url)[0].alias("host"), verdict.alias("verdict"),
                      F.col("_best.e.list_name").alias("matched_list"), F.col("_best.p").alias("matched_pattern"),
                      F.col("_best.e.valid_from").alias("valid_from"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_active"))
