"""Line dedup by winnowing over line hashes (operator 2, DataFrame functions only).

A run is a sequence of successive lines (blank ones apart) that also occurs earlier in the
corpus, by (id, hash of the text, line); runs of at least ``min_words`` words are deleted, their
first occurrence stays.

Lines differ in length, so the winnowing windows are measured in words: from each line
forwards, and from each line backwards, the fewest lines that hold ``min_words`` words.  Of
each window the smallest line hash (the last of equals) is its fingerprint.  Any shared run that
is long enough holds a whole window, and equal windows select equal fingerprints, so no shared
run lacks a common fingerprint.

1. fingerprints that occur at one place only are dropped (a count with map-side combine);
2. positions of the others are joined: windows are keyed by all their lines, the first
   occurrence of each key by a minimum, joined back to the windows;
3. matches are extended both ways by the union of the matching forward and backward windows:
   every line of a shared run lies in the forward window from it, in the backward window to it,
   or in the forward window from the run's first line.  So extension costs a row per window and not
   per pair, and a passage in a third of all documents costs a row per copy.

Defined results: null texts stay null, empty ones empty; lines are compared without blanks at
their ends, and a document whose lines all go has an empty text; blank lines inside a deleted run
go with it; rows equal in id and text count as one document and get the same lines; null ids
are ids like others and come first; other columns, whatever their names, pass unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

MIN_WORDS = 50
BLANKS = " \t\r\f\u000b"
RARE_BLANKS = ("  ", "\t", "\r", "\f", "\u000b")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def _n_words(line: Column) -> Column:
    """Words of a line without blanks at its ends; where single spaces part them, the spaces are counted."""
    rare = reduce(Column.__or__, [F.contains(line, F.lit(b)) for b in RARE_BLANKS])
    cut = F.array_size(F.split(line, r"[ \t\n\x0B\f\r]+", -1))
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(line == "", 0).when(rare, cut).otherwise(spaces + 1).cast("long")


def _windows(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, key, mark, mark_pos, k1, k2, first, last): the windows from and to each line, with their fingerprints."""
    def line(t, i):
        return F.struct(i.alias("pos"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"), _n_words(t).alias("w"))

    # trimmed apart: a lambda works every use of its argument out anew
    trimmed = F.transform(F.split("text", "\n", -1), lambda t: F.btrim(t, F.lit(BLANKS)))
    lines = (_keyed(docs, id_col, text_col).where("text is not null")
             .select("id", "key", F.filter(F.transform(trimmed, line), lambda x: x.w > 0).alias("lines"))
             .dropDuplicates(["id", "key"])  # first: a filter below it would cut every text a second time
             .where(F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x.w) >= min_words)
             .select("id", "key", F.inline("lines")))
    doc = W.partitionBy("id", "key")
    lines = (lines.withColumn("to_here", F.sum("w").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
             .withColumn("before", F.col("to_here") - F.col("w")).withColumn("all", F.sum("w").over(doc)))
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    back = doc.orderBy("to_here").rangeBetween(1 - min_words, 0)

    def window(frame, full, first, last):
        mark = F.min(F.struct("h1", (-F.col("pos")).alias("at"))).over(frame)
        return F.when(full, F.struct(
            mark.h1.alias("mark"), (-mark["at"]).alias("mark_pos"),
            F.xxhash64(F.collect_list("h1").over(frame)).alias("k1"), F.xxhash64(F.collect_list("h2").over(frame)).alias("k2"),
            first.alias("first"), last.alias("last")))

    start = F.min("pos").over(back)
    forward = window(ahead, F.col("all") - F.col("before") >= min_words, F.col("pos"), F.max("pos").over(ahead))
    backward = window(back, (F.col("to_here") >= min_words) & (start < F.col("pos")), start, F.col("pos"))
    return (lines.select("id", "key", F.array(forward, backward).alias("ws"))
            .select("id", "key", F.inline(F.filter("ws", lambda x: x.isNotNull()))))


def deleted_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  stored: bool = False) -> DataFrame:
    """(id, key, lines): numbers (from 0) of the lines to delete; key = xxhash64(text).

    The windows are read several times: ``stored`` writes them to the shared folder at once, else each
    reading works them out anew."""
    windows = _windows(docs, id_col, text_col, min_words)
    if stored:
        windows = written(windows, "line-windows")
    place = F.struct("id", "key", "mark_pos")
    shared = (windows.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b"))
              .where("a < b").select("mark"))
    windows = windows.join(shared, "mark", "left_semi").select("id", "key", "k1", "k2", "first", "last")
    place = F.struct("id", "key", "first")
    origin = (windows.groupBy("k1", "k2").agg(F.min(place).alias("a"), F.max(place).alias("b"))
              .where("a < b").select("k1", "k2", "a"))
    later = windows.join(origin, ["k1", "k2"]).where(place > F.col("a"))
    return (later.select("id", "key", F.explode(F.sequence("first", "last")).alias("pos"))
            .groupBy("id", "key").agg(F.array_sort(F.collect_set("pos")).alias("lines")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                count_col: str | None = None) -> DataFrame:
    """``docs`` with the later repeated runs cut from the text (and the number of deleted
    lines as ``count_col``)."""
    gone = deleted_lines(docs, id_col, text_col, min_words, stored=True).select(
        F.col("id").alias("__gone_id"), F.col("key").alias("__gone_key"), F.col("lines").alias("__gone"))
    text = F.col(text_col)

    def kept(x):
        cuts = F.concat(F.array(F.lit(-1)), "__gone", F.array(F.size(x)))
        spans = F.filter(F.arrays_zip(cuts.alias("a"), F.slice(cuts, 2, F.size(cuts)).alias("b")), lambda c: c.b > c.a + 1)
        return F.array_join(F.flatten(F.transform(spans, lambda c: F.slice(x, c.a + 2, c.b - c.a - 1))), "\n")

    # as an element of an array the cut text is an argument: a step inside would cut it anew for each span
    cut = F.transform(F.array(F.split(text, "\n", -1)), kept)
    new = F.when(F.col("__gone").isNull(), text).otherwise(F.get(cut, 0))
    both = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_key")), "left")
    out = [new.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if count_col:
        out.append(F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(count_col))
    return both.select(*out)


def oracle(table: str = "documents", min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL of the same definition, without winnowing: every forward and backward window
    that also occurs earlier is deleted."""
    return f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                    unnest(range(len(string_split(text, chr(10))))) AS pos FROM {table} WHERE text IS NOT NULL),
lines AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS t,
                 len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM raw),
sums AS (SELECT doc_id, pos, t, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b,
                sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS a,
                sum(w) OVER (PARTITION BY doc_id) AS n FROM lines WHERE w > 0),
windows AS (
  SELECT doc_id, pos AS f, max(pos) OVER x AS l, list(t) OVER x AS k, n - a >= {min_words} AS ok FROM sums
  WINDOW x AS (PARTITION BY doc_id ORDER BY a RANGE BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER y, pos, list(t) OVER y, b >= {min_words} FROM sums
  WINDOW y AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW)),
ranked AS (SELECT doc_id, f, l, rank() OVER (PARTITION BY k ORDER BY doc_id, f) AS r FROM windows WHERE ok),
gone AS (SELECT DISTINCT doc_id, unnest(range(f, l + 1)) AS pos FROM ranked WHERE r > 1),
kept AS (SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY raw.pos) AS text
         FROM raw ANTI JOIN gone ON raw.doc_id = gone.doc_id AND raw.pos = gone.pos GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
       coalesce(n.n, 0)::BIGINT AS n_deleted
FROM {table} d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""
