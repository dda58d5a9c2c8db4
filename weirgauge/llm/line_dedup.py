"""Boilerplate lines of a site, by their frequency among the site's pages.

A line is boilerplate of a host if the share of the host's pages that contain it
exceeds a ratio. Only DataFrame functions are used. Lines are counted under a 128-bit
digest, so that the shuffle carries no texts; a host's boilerplate lines are at most
(lines per page / ratio) many, which bounds the list that its pages are joined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RATIO = 0.05
MIN_PAGES = 5
SALTS = 32

# What ends a line of a page, and the character references of markup.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|"
    "header|hr|html|legend|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul")
HIDDEN = (
    r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->",
)
REFERENCES = {
    "&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">",
    "&amp;": "&",
}


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, with its port; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit("")))


def page_lines(html: Column) -> Column:
    """Visible lines of a page as an array: text between block-level tags, white space
    collapsed, empty lines left out. Null html has none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, "\n")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[A-Za-z/!?][^>]*>", "")
    for name, char in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return F.filter(lines, lambda x: x != "")


def text_lines(text: Column) -> Column:
    """Lines of a plain text that have a word. Null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def drop_site_lines(
    pages: DataFrame, host: Column, lines: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``pages`` with ``host``, ``n_lines``, ``n_dropped`` and ``kept_lines``.

    A line goes if more than ``max_ratio`` of its host's pages, and ``min_pages`` at
    least, contain it. It counts once per page, however often it occurs there, and all
    its occurrences go. Pages without a host are compared with no others and keep all
    lines; pages without lines keep none. Each row is a page, also repeated ones. The
    new columns replace others of the same name. An empty table gives no rows.
    """
    new = ["host", "n_lines", "n_dropped", "kept_lines"]
    given = [c for c in pages.columns if c not in new]
    own = max(map(len, pages.columns), default=0) * "_"  # longer than any given name: none can clash
    line, site, salt, drop, kept = (own + c for c in ("lines", "site", "salt", "drop", "kept"))
    # A host's pages are dealt to salts, each of which gets the host's list: no host is
    # gathered in one task.
    marked = pages.withColumns({line: lines, site: host, salt: (F.monotonically_increasing_id() % SALTS).cast("int")})
    hosts = marked.where(F.col(site).isNotNull())
    digests = F.array_distinct(F.transform(line, lambda x: F.unhex(F.md5(x))))
    counts = hosts.select(site, F.explode(digests).alias("line")).groupBy(site, "line").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = hosts.groupBy(site).agg(F.count(F.lit(1)).alias("pages"))
    boilerplate = counts.join(totals, site).where(F.col("n") > max_ratio * F.col("pages")).groupBy(site).agg(
        F.collect_list("line").alias(drop))
    dealt = boilerplate.select(site, drop, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    left = F.when(F.col(drop).isNull(), F.col(line)).otherwise(
        F.filter(line, lambda x: ~F.array_contains(drop, F.unhex(F.md5(x)))))
    return marked.join(dealt, [site, salt], "left").withColumn(kept, left).select(
        *given, F.col(site).alias("host"), F.size(line).cast("bigint").alias("n_lines"),
        (F.size(line) - F.size(kept)).cast("bigint").alias("n_dropped"), F.col(kept).alias("kept_lines"))


def sql(max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same over ``pages`` in DuckDB's SQL."""
    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"
    text = r"regexp_replace(coalesce(html, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
    for pattern in HIDDEN:
        text = f"regexp_replace({text}, {quoted(pattern)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {quoted(rf'(?i)</?(?:{BLOCK_TAGS})[[:>:]]?[^>]*>')}, chr(10), 'g')".replace(
        "[[:>:]]?", r"\b")
    text = rf"regexp_replace({text}, '<[A-Za-z/!?][^>]*>', '', 'g')"
    for name, char in REFERENCES.items():
        text = f"replace({text}, {quoted(name)}, {quoted(char)})"
    return rf"""
with cut as (
  select page_id, url, row_number() over () as page,
         lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '')) as host,
         list_filter(list_transform(string_split({text}, chr(10)),
           lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') as lines
  from pages),
counts as (
  select host, line, count(*) as n
  from (select host, page, unnest(list_distinct(lines)) as line from cut where host is not null)
  group by host, line having count(*) >= {min_pages}),
totals as (select host, count(*) as n_pages from cut where host is not null group by host),
site as (
  select host, list(line) as dropped from counts join totals using (host) where n > {max_ratio} * n_pages group by host)
select page_id, url, cut.host, cast(len(lines) as bigint) as n_lines,
       cast(len(lines) - len(list_filter(lines, lambda x: not list_contains(coalesce(dropped, []), x))) as bigint) as n_dropped,
       array_to_string(list_filter(lines, lambda x: not list_contains(coalesce(dropped, []), x)), chr(10)) as text
from cut left join site on cut.host = site.host"""
