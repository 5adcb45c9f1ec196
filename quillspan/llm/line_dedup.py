"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages are cut into text lines. For each host, the number of pages that contain a line is divided by the
host's number of pages; lines above the ratio are boilerplate and go from every page of that host.

Pages are parsed once and stored as lines. A page adds the 128-bit digests of its distinct lines, so counting moves no
text and pre-aggregates before its shuffle however large a host is. A host has at most (mean lines of its pages /
ratio) boilerplate lines, whatever its number of pages, so their digests fit one array for each host, which is joined
to the pages by host; pages of hosts with many of them are spread by a salt. The disk holds the lines, their shuffle and
the result at once; both tables are stored with zstd.

Defined results: a null url or one without a host has the host ''; null html has no lines; of hosts
with fewer than min_pages pages nothing goes. Empty lines don't count and are not kept. Rows that repeat an id, or are
equal in all, are pages of their own; a null id stays; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import kept, scratch, stored, unique_join


#: Of the stored lines and the result, which hold nearly the whole text.
CODEC = "zstd"


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def lines_of(html: Column) -> Column:
    """Text lines of a page: without scripts, styles, comments and tags; block tags and line ends part lines."""
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|nav|header|footer|article|section|aside|main|table|tr|td|th|h[1-6]|title|head|body|html|form|pre|blockquote)(?:\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    lines = F.transform(F.split(t, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\x0B\f]+", " ")))
    return F.filter(lines, lambda x: x != "")


def strip_boilerplate(pages: DataFrame, ratio: float = 0.3, min_pages: int = 4, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, host, host_pages, n_lines, n_dropped, text (the kept lines)."""
    with scratch(pages.sparkSession):
        return kept(_stripped(pages, ratio, min_pages, id_col, url_col, html_col), CODEC)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _stripped(pages: DataFrame, ratio: float, min_pages: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    rows = stored(pages.select(F.col(id_col).alias("__id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines")), CODEC)
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = rows.select("host", F.explode(F.array_distinct(F.transform("lines", _digest))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") >= 2).join(totals, "host").filter((F.col("host_pages") >= min_pages) & (F.col("n") > ratio * F.col("host_pages")))
    hosts = stored(totals.join(often.groupBy("host").agg(F.collect_list("line").alias("often")), "host", "left"))
    good = F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("often"), _digest(x)), F.lit(False)))
    joined = unique_join(rows, hosts, "host", "__id", "inner").withColumn("good", F.when(F.col("often").isNull(), F.col("lines")).otherwise(good))
    return joined.select(
        F.col("__id").alias(id_col), "host", "host_pages", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_dropped"), F.array_join("good", "\n").alias("text"),
    )
