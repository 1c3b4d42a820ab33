"""License scan by canonical digest lookup.

A text is brought to a canonical form (lower case; copyright lines out; equivalent spellings made one; everything but
letters and digits to single blanks) and its SHA-256 is joined with the digests of known license texts. What is looked
up are entire texts: the whole document, and each of its lines, as a notice usually stands on a line of its own.
Canonical forms that are empty match nothing; only forms as long as a known one are hashed.

Edge cases: null and empty texts have no license; documents without a match stay in the result; repeated rows stay; a
unit that repeats in a document counts once; known texts with the same canonical form all match; other columns are
ignored, whatever their names. The table of known texts may be of any size: the join is by digest, and Spark broadcasts
the table only where it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts
from .common import read, row_key

#: Equivalent spellings (fixed values): each left form becomes the right one. Applied in this order on lower case.
SPELLINGS = [
    ("licen[cs]e", "license"), ("sub-licen[cs]e", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"), ("https://", "http://"), ("&", " and "), ("gpl-3.0", "gnu general public license, version 3"),
    ("v(ersion)? ?([0-9])", "version $2"),
]
#: Lines that state a copyright: they name years and holders, which differ between copies of one license.
COPYRIGHT = r"(?m)^[^\n]*(copyright|©|\(c\))[ \t]+(\(c\)|©|[0-9]{4}|the |by |<|\[)[^\n]*$"

KNOWN = license_texts.known()


def _lines(text: Column) -> Column:
    """Canonical lines, joined by line feeds; blanks at their ends remain."""
    c = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    for pattern, to in SPELLINGS:
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " ")


def _whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form; null for null, the empty string if nothing is left."""
    return _whole(_lines(text))


def known_texts(spark: SparkSession, texts: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``(license, class, digest, length)`` of known texts."""
    t = spark.createDataFrame(texts or KNOWN, "license string, class string, text string")
    return t.withColumn("c", canonical(F.col("text"))).filter("c <> ''").select("license", "class", F.sha2("c", 256).alias("digest"), F.length("c").alias("length")).distinct()


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, whole, licenses, classes, n_units)`` for every input row.

    ``whole``: the license that the entire document is (the first by name if several), else null; ``licenses``: names
    over all units, ``classes`` their classes, both sorted, distinct and comma-joined; ``n_units``: distinct units found.
    """
    keys = row_key(id_col, text_col)
    c = docs.select(*keys, _lines(F.col(text_col)).alias("c")).filter("c is not null")
    whole = F.struct(_whole(F.col("c")).alias("c"), F.lit(True).alias("all"))
    lines = F.transform(F.split("c", "\n"), lambda x: F.struct(F.trim(x).alias("c"), F.lit(False).alias("all")))
    units = c.select("_k1", "_k2", F.explode(F.concat(F.array(whole), lines)).alias("u")).filter("u.c <> ''")
    # Distinct lengths are whole numbers up to that of the longest known text, so this broadcast is bounded by one text.
    units = units.join(F.broadcast(known.select("length").distinct()), F.length("u.c") == F.col("length"), "left_semi")
    digests = units.select("_k1", "_k2", "u.all", F.sha2("u.c", 256).alias("digest")).distinct()
    found = digests.join(known.select("digest", "license", "class"), "digest").groupBy("_k1", "_k2").agg(
        F.min(F.when(F.col("all"), F.col("license"))).alias("whole"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.array_join(F.sort_array(F.collect_set("class")), ",").alias("classes"),
        F.countDistinct("digest").alias("n_units"),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), *keys)
    out = rows.join(found, ["_k1", "_k2"], "left")
    return out.select("doc_id", "whole", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("classes", F.lit("")).alias("classes"), F.coalesce("n_units", F.lit(0)).alias("n_units"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), known_texts(spark))


def _sql_lines(text: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    c = f"regexp_replace(lower({text}), {quote(COPYRIGHT)}, ' ', 'g')"
    for pattern, to in SPELLINGS:
        c = f"regexp_replace({c}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')"
    return f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _sql_known() -> str:
    rows = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in k) + ")" for k in KNOWN)
    return f"(VALUES {rows}) AS k(license, class, text)"


ORACLE_OP7 = f"""
WITH known AS (SELECT DISTINCT license, class, sha256(c) AS digest FROM (SELECT license, class, trim(regexp_replace({_sql_lines("text")}, '[ \n]+', ' ', 'g')) AS c FROM {_sql_known()}) WHERE c <> ''),
d AS (SELECT doc_id, row_number() OVER () AS rid, {_sql_lines("text")} AS c FROM documents),
u AS (SELECT rid, true AS whole, trim(regexp_replace(c, '[ \n]+', ' ', 'g')) AS c FROM d UNION ALL SELECT rid, false, trim(unnest(string_split(c, chr(10)))) FROM d),
f AS (SELECT rid, min(license) FILTER (whole) AS whole, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, string_agg(DISTINCT class, ',' ORDER BY class) AS classes, count(DISTINCT digest) AS n_units
      FROM u JOIN known ON sha256(u.c) = known.digest WHERE u.c <> '' GROUP BY rid)
SELECT doc_id, whole, coalesce(licenses, '') AS licenses, coalesce(classes, '') AS classes, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units FROM d LEFT JOIN f USING (rid)
"""
