"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, salted_join

#: A line is boilerplate if more than RATIO of its host's pages, and at least LEAST_PAGES of them, hold it.
RATIO, LEAST_PAGES = 0.01, 4

#: The table of boilerplate is broadcast up to this many lines (about 16 bytes each), else joined by parts of a host.
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """A line is compared without the blanks around it."""
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, lines array<long>): the hashes of each host's boilerplate lines.

    Exact copies of a page within a host count as one page, both for a line and for
    the total. A host has at most (mean distinct lines of a page) / ratio such lines,
    so the arrays are bounded. Counts are aggregated before each shuffle, so a host
    with most of the rows is no single task.
    """
    pages = docs.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("page"), text.alias("text"))
    totals = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("total"))
    held = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    lines = pages.select("host", "page", F.explode(held).alias("line"))
    counts = lines.groupBy("host", "line", "page").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("one").alias("n"))
    frequent = counts.filter(F.col("n") >= least_pages).join(totals, "host").filter(F.col("n") > F.lit(ratio) * F.col("total"))
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counted: bool = True
) -> DataFrame:
    """Remove each host's boilerplate lines from its pages.

    Lines are cut at newlines and compared without surrounding blanks; blank lines are
    never counted nor dropped. Pages of a null host form one host. A null text stays
    null, an empty one empty; a page of boilerplate only becomes empty and is kept.
    Repeated rows are treated alike, and other columns, whatever their names, pass
    through. Returns the columns of docs (text_col replaced) and, if `counted`,
    lines_dropped (with underscores after it where docs has that column).
    """
    names = list(docs.columns)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    text, host = F.col("row").getField(text_col), F.col("row").getField(host_col)
    found = cut(boilerplate(rows, host, text, ratio, least_pages))
    size = found.agg(F.sum(F.size("lines") + 1)).first()[0] or 0
    at, found = rows.withColumn("at", F.coalesce(host.cast("string"), F.lit(""))), found.withColumnRenamed("host", "at")
    joined = at.join(F.broadcast(found), "at", "left") if size <= BROADCAST_LINES else salted_join(at, found, "at", "left")
    split = _lines(text)
    # by a hash set: a page's lines are held against its own boilerplate alone, not against all of the host's
    out = joined.withColumn("bad", F.array_intersect(F.transform(split, _key), F.col("lines")))
    kept = F.when(F.coalesce(F.size("bad"), F.lit(0)) <= 0, split).otherwise(
        F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("bad"), _key(x)))
    )
    out = out.withColumn("kept", kept)
    new_text = F.when(text.isNotNull(), F.when(F.col("lines").isNull(), text).otherwise(F.array_join("kept", "\n")))
    dropped = [(F.size(split) - F.size("kept")).alias(fresh(names, "lines_dropped"))] if counted else []
    return out.select(*((new_text if c == text_col else F.col("row").getField(c)).alias(c) for c in names), *dropped)


def line_dedup_sql(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    """DuckDB: (doc_id, text, lines_dropped) of every document."""
    return f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(source, '') as host, text from documents),
    pages as (select distinct host, text from d),
    totals as (select host, count(*) as total from pages group by host),
    held as (select distinct host, text, trim(line, ' ') as line
             from (select host, text, unnest(string_split(coalesce(text, ''), chr(10))) as line from pages) where trim(line, ' ') <> ''),
    bad as (select host, line from held join totals using (host) group by host, line, total
            having count(*) >= {least_pages} and count(*) > {ratio}::double * total),
    rows as (select rid, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from d),
    marked as (select d.rid, r.pos, r.line, b.line is not null as out
               from d join rows r on d.rid = r.rid left join bad b on b.host = d.host and b.line = trim(r.line, ' ')),
    back as (select rid, string_agg(line, chr(10) order by pos) filter (where not out) as text, sum(out::int) as dropped from marked group by rid)
    select d.doc_id, case when d.text is null then null else coalesce(b.text, '') end as text, cast(b.dropped as int) as lines_dropped
    from d join back b on d.rid = b.rid
    """
