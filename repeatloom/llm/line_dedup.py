"""Line dedup by site-relative frequency, in DataFrame operations only.

For every host, a line's ratio is the number of the host's pages that contain it over
the number of the host's pages. Lines above the ratio (and on at least ``least``
pages) are boilerplate there and are dropped from all of the host's pages.

Lines travel as pairs of 64-bit hashes, counted partially before the shuffle, so a host
with a third of all pages is a third of the counting but no hot key: the key is
the line. A host has at most (its lines / its pages) / ratio boilerplate lines, a short
array that is joined to its pages: broadcast where adaptive execution finds all of them
small, else with the host's pages split over tasks. Pages are not taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, read

RATIO, LEAST = 0.1, 5


def _keys(text: Column, host: Column) -> Column:
    """A page's distinct lines with other than white space, as (k1, k2)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    return F.array_distinct(F.transform(lines, lambda x: F.struct(F.xxhash64(host, F.trim(x)).alias("k1"), F.xxhash64(F.trim(x), F.lit(7)).alias("k2"))))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, text_column: str = "text", host_column: str = "source", count_column: str = "n_dropped") -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and how many were cut.

    A line is what lies between line feeds, compared without leading and trailing
    spaces; blank lines are neither counted nor dropped. A line on a page several times
    counts as one page and is dropped each time. A null text stays null, an empty text
    empty; a null host is a host of its own. Repeated rows are pages each. An empty table
    gives no rows. All columns are kept; only ``count_column`` is added, in place of any
    column of that name. A page may lose all its lines; its row stays.
    """
    names = [c for c in docs.columns if c != count_column]
    h_, d_, s_ = (free_name(docs.columns, x) for x in ("_host", "_drop", "_stay"))
    pages = docs.select(F.col(host_column).alias("host"), F.col(text_column).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.where("text is not null").select("host", F.explode(_keys(F.col("text"), F.col("host"))).alias("k"))
    counts = lines.groupBy("k.k1", "k.k2").agg(F.count("*").alias("n"), F.first("host").alias("host")).where(F.col("n") >= least)
    drop = counts.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.col("pages") * F.lit(ratio))
    found = cut(drop.select("host", F.struct("k1", "k2").alias("k")), "boilerplate")
    by_host = found.groupBy("host").agg(F.sort_array(F.collect_list("k")).alias(d_)).withColumnRenamed("host", h_)
    marked = docs.select(*names).join(by_host, F.col(host_column).eqNullSafe(F.col(h_)), "left")
    text, host = F.col(text_column), F.col(host_column)
    key = lambda x: F.struct(F.xxhash64(host, F.trim(x)).alias("k1"), F.xxhash64(F.trim(x), F.lit(7)).alias("k2"))
    all_lines = F.split(text, "\n", -1)
    stays = F.filter(all_lines, lambda x: (F.length(F.trim(x)) == 0) | ~F.array_contains(F.col(d_), key(x)))
    new = marked.withColumn(s_, F.when(F.col(d_).isNotNull() & text.isNotNull(), stays))
    return new.select(
        *[F.coalesce(F.array_join(s_, "\n"), text).alias(c) if c == text_column else F.col(c) for c in names],
        F.coalesce(F.size(all_lines) - F.when(F.col(s_).isNotNull(), F.size(s_)), F.lit(0)).cast("long").alias(count_column),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "n_dropped", "text")


OP1_SQL = f"""
with pages as (
  select row_number() over () as rid, doc_id, source, text, string_split(text, chr(10)) as lines from documents
), totals as (select source, count(*) as pages from pages group by source),
seen as (
  select distinct rid, source, trim(line, ' ') as line from (select rid, source, unnest(lines) as line from pages) where length(trim(line, ' ')) > 0
), boiler as (
  select s.source, s.line from seen s join totals t on s.source is not distinct from t.source
  group by s.source, s.line, t.pages having count(*) >= {LEAST} and count(*) > t.pages * cast({RATIO} as double)
), parts as (
  select rid, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos, source from pages
), kept as (
  select p.rid, p.pos, p.line, b.line is null as stays
  from parts p left join boiler b on p.source is not distinct from b.source and trim(p.line, ' ') = b.line
), made as (
  select rid, string_agg(line, chr(10) order by pos) filter (stays) as text, count(*) filter (not stays) as n from kept group by rid
)
select p.doc_id, cast(coalesce(m.n, 0) as bigint) as n_dropped,
       case when p.text is null then null else coalesce(m.text, '') end as text
from pages p left join made m using (rid)
"""
