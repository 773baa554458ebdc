"""Cross-site line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Lines are known by a 128-bit hash of the trimmed line. One aggregation
finds the lines that stand on two sites at all; HyperLogLog sketches of their sites, merged by aggregation, settle
those that are clearly under or over the limit, and the rest are counted exactly (with the default limit of three
sites: all lines on up to five). The first occurrence stays, all others are removed.

A line on a third of all rows is aggregated before the shuffle, and its rows are found by a broadcast of the common
lines: those on more than a 10,000th of all line places, of which there can't be more than 10,000. Texts are moved once,
to meet the places of their removed lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, is_common, join_keys, read

MIN_SITES = 3
BLANK_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
#: log2 of the sketch's registers: a standard error of about 1.6 %.
LG_REGISTERS = 12


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(docs: DataFrame, scratch: Scratch, min_sites: int, id_col: str, text_col: str, site_col: str) -> tuple[DataFrame, DataFrame]:
    """(lines on two or more sites with their places, boilerplate lines with their first place)."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), row_hash(id_col, text_col, site_col).alias("row"), F.xxhash64(site).alias("site"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANK_CHARS))
    rows = rows.where(key != "").select("doc", "row", "site", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2"))
    spread = rows.groupBy("h1", "h2").agg(F.min("site").alias("low"), F.max("site").alias("high"), F.count("*").alias("n")).where("low <> high").select("h1", "h2", "n")
    spread = scratch.save(spread, "spread")
    total = spread.agg(F.sum("n")).first()[0] or 0
    several = scratch.save(join_keys(rows, spread.select("h1", "h2", is_common(F.col("n"), total).alias("common")), ["h1", "h2"]), "several")
    sketches = several.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_REGISTERS)).alias("sites"), F.min(F.struct("doc", "pos", "row")).alias("first"), F.first("common").alias("common"))
    sketches = scratch.save(sketches, "sketches")
    zone = max(2, -(-min_sites // 10))  # six standard errors, and two sites where numbers are small
    clear = sketches.where(F.col("sites") > min_sites + zone)
    near = sketches.where(F.col("sites").between(min_sites - zone, min_sites + zone))
    counted = join_keys(several.select("h1", "h2", "site"), near.select("h1", "h2", "common"), ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = counted.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    columns = ["h1", "h2", "first", "common"]
    return several.drop("common"), scratch.save(clear.select(*columns).union(near.join(exact, ["h1", "h2"]).select(*columns)), "found")


def row_hash(id_col: str, text_col: str, site_col: str) -> Column:
    """What tells rows with the same id apart."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col), F.col(site_col).cast("string"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The documents without lines that stand on ``min_sites`` sites or more, except each line's first place.

    Lines are compared with blanks trimmed; blank lines stay. The first place is the smallest (doc_id, line number, hash
    of the row); a null doc_id comes first. Rows with the same doc_id and different texts or sites are documents of
    their own; rows that agree in all three are treated alike. A null site counts as one site. Null texts stay null;
    empty ones empty; a text that loses all lines becomes empty and its row stays. ``n_chars``, if there is one, follows
    the text. Two columns are added: ``n_lines`` and ``n_removed`` (existing ones of these names are replaced); all
    others are passed on.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_removed")
    several, found = boilerplate(docs, scratch, min_sites, id_col, text_col, site_col)
    first = F.struct("doc", "pos", "row")
    hits = join_keys(several, found, ["h1", "h2"]).where(~first.eqNullSafe(F.col("first")))
    gone = scratch.save(hits.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone")), "gone")
    columns = docs.columns
    # always by a shuffle: a broadcast of the places would not hold at every size
    at = F.col(id_col).cast("long").eqNullSafe(F.col("_doc")) & (row_hash(id_col, text_col, site_col) == F.col("_row"))
    out = docs.join(gone.withColumnsRenamed({"doc": "_doc", "row": "_row", "gone": "_gone"}).hint("merge"), at, "left").drop("_doc", "_row")
    lines = _lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.element_at(F.transform(F.array(lines), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n")), 1))
    out = out.withColumns({"n_lines": F.size(lines), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)), text_col: text})
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns, "n_lines", "n_removed")


def op5_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: lines before, lines removed and a digest of the text that stays."""
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
spread AS (
  SELECT k, min({'d': doc_id, 'p': pos}) AS f FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, (s.k IS NOT NULL AND NOT (s.f.d = l.doc_id AND s.f.p = l.pos)) AS gone
  FROM keyed l LEFT JOIN spread s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
"""
