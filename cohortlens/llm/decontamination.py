"""Benchmark decontamination by a distributed positional inverted index (operator 6,
DataFrame functions only).

Terms are maximal runs of ASCII letters and digits and of characters over 127, A-Z lower-cased.
A window is ``window`` successive terms of an item (all of them, if fewer).

1. corpus frequencies of the items' terms; of each window the rarest term is its anchor, and
   windows with a term that the corpus lacks are dropped; for proximity an item's anchors are its
   rarest places, one more than a match may miss, so that every match holds one of them;
2. postings (document, position) of the anchors; adjusted by the anchor's offset in the item, they
   give candidate alignments (document, item, shift), each once;
3. each aligned stretch of the document is intersected with the item's terms place by place:
   runs of at least a window are exact phrase matches (every word in them is hit), and stretches
   that hold most terms near their places are proximity matches (all shifts that an anchor allows
   are tried).

Postings of other terms are never stored or shuffled, and no pair is made that an anchor does not
give.  Broadcasts (item terms and anchors) are hinted only after a count; beyond
``broadcast_rows`` the same joins shuffle.

Defined results: null and empty texts have no words and no hits; items without words match nothing;
items with a null id are matched but not counted; rows equal in id and text get equal
results; rows that share an id but not the text are judged apart; an empty table on either side
gives no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)  # then ``lower`` does the same, many times faster
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), NOT_WORD, -1), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def _items(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item texts: iid, terms, n; their ids: iid, item_id): equal word sequences are one."""
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("terms")).where("size(terms) > 0")
    rows = written(rows.select("item_id", "terms", F.xxhash64("terms").alias("iid"), F.size("terms").alias("n")), "index-items")
    return rows.select("iid", "terms", "n").dropDuplicates(["iid"]), rows.select("iid", "item_id").distinct()


def alignments(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0, share: float | None = None,
               id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
               broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(aligned stretches: id, key, iid, shift, first, stretch, terms, n; item ids).

    ``stretch`` holds the document's words from position ``first`` on, where the item's
    would lie, widened by ``slack`` words on both sides.  Anchors are the rarest term of every
    window or, with ``share``, as many of an item's rarest places as any ``share`` of them must meet."""
    texts, ids = _items(items, item_id, item_text)
    places = texts.select("iid", "n", F.posexplode("terms").alias("at", "term"))
    vocabulary = broadcast_if_small(places.select("term").distinct(), broadcast_rows)
    d = _keyed(docs, id_col, text_col).where("text is not null")
    tokens = d.select("id", "key", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    frequency = written(tokens.select("term").join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("f")), "index-terms")
    counted = places.join(frequency, "term", "left").withColumn("f", F.coalesce("f", F.lit(0).cast("long")))
    if share is None:
        ahead = W.partitionBy("iid").orderBy("at").rowsBetween(0, window - 1)
        counted = (counted.withColumn("rare", F.min(F.struct("f", "term", "at")).over(ahead))
                   .where(f"at <= greatest(n - {window}, 0)").select("iid", "n", "rare.*"))
    else:  # rounded so that no place is missing
        rank = F.row_number().over(W.partitionBy("iid").orderBy("f", "term", "at"))
        counted = counted.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1)
    anchors = written(counted.where("f > 0").select("iid", "n", "term", "at").distinct(), "index-anchors")
    listed = tokens.join(broadcast_if_small(anchors.select("term").distinct(), broadcast_rows), "term", "left_semi")
    found = written(listed.join(broadcast_if_small(anchors, broadcast_rows), "term")
                    .select("id", "key", "iid", "n", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "index-alignments")
    per_doc = found.groupBy("id", "key").agg(F.collect_list(F.struct("iid", "n", "shift")).alias("found"))
    per_doc = per_doc.withColumnsRenamed({"id": "id2", "key": "key2"})
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
    # texts without a candidate stay where they are, unless there are too many ids to broadcast
    near = d.join(broadcast_if_small(per_doc.select("id2", "key2"), broadcast_rows), same, "left_semi")
    hit = near.join(per_doc, same)
    hit = hit.dropDuplicates(["id", "key"]).select("id", "key", "found", words(F.col("text")).alias("words"))

    def stretch(x):
        first = F.greatest(x.shift - slack, F.lit(0))
        return F.struct(x.iid.alias("iid"), x["shift"].alias("shift"), first.alias("first"),
                        F.slice("words", first + 1, F.greatest(x.shift + x.n + slack - first, F.lit(0))).alias("stretch"))

    rows = hit.select("id", "key", F.inline(F.transform("found", stretch)))
    return rows.join(broadcast_if_small(texts, broadcast_rows // 10), "iid"), ids


def phrase_runs(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, key, iid, first, last): runs of document words equal to an item's, a window or more."""
    same = F.filter(F.sequence(F.lit(0), F.size("stretch") - 1),
                    lambda i: F.get("stretch", i) == F.get("terms", i + F.col("first") - F.col("shift")))
    hits = (rows.where("size(stretch) >= least(n, {})".format(window))
            .select("id", "key", "iid", "n", "shift", "first", F.explode(same).alias("i"))
            .select("id", "key", "iid", "n", "shift", (F.col("first") + F.col("i")).alias("pos")))
    w = W.partitionBy("id", "key", "iid", "shift").orderBy("pos")
    hits = hits.withColumn("run", F.col("pos") - F.row_number().over(w))
    return (hits.groupBy("id", "key", "iid", "shift", "run")
            .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("n").alias("n"))
            .where(f"last - first + 1 >= least(n, {window})").select("id", "key", "iid", "first", "last"))


def proximity_matches(docs: DataFrame, items: DataFrame, slack: int = 3, share: float = 0.8, **names) -> DataFrame:
    """(id_col, item_id, first, matched): stretches that hold at least ``share`` of an item's
    terms, each within ``slack`` words of its place.

    Of a document and item the shift with most terms counts, then that with most of them exactly
    in place, then the smallest; ``first`` is the place of the item's first word in the document."""
    rows, ids = alignments(docs, items, slack=2 * slack, share=share, **names)

    def held(shift, reach):  # item words that the stretch holds within ``reach`` of their places
        def near(i):
            at = i + shift - F.col("first")
            start = F.greatest(at - reach, F.lit(0))
            return F.array_contains(F.slice("stretch", start + 1, F.greatest(at + reach + 1 - start, F.lit(0))), F.get("terms", i))
        return F.size(F.filter(F.sequence(F.lit(0), F.col("n") - 1), near))

    shift = F.col("shift")
    # every word of the item that the stretch lacks anywhere costs a place at least: most alignments end here
    rows = rows.where((F.col("n") - F.size(F.array_except("terms", "stretch"))) / F.col("n") >= share)
    # an anchor lies within the slack of its place, so the best shift within the slack of the anchor's
    near = rows.where(held(shift, 2 * slack) / F.col("n") >= share)
    near = near.select("id", "key", "iid", "n", "first", "stretch", "terms", F.explode(F.sequence(shift - slack, shift + slack)).alias("shift"))
    near = near.withColumn("matched", held(shift, slack) / F.col("n")).where(F.col("matched") >= share)
    best = F.max(F.struct("matched", held(shift, 0).alias("exact"), (-shift).alias("back")))
    return (near.groupBy("id", "key", "iid").agg(best.alias("m")).join(ids, "iid")
            .groupBy("id", "key", "item_id").agg(F.max("m").alias("m"))
            .select(F.col("id").alias(names.get("id_col", "doc_id")), "item_id", (-F.col("m.back")).alias("first"), "m.matched"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", **names) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated of every row, and its key."""
    rows, ids = alignments(docs, items, window, id_col=id_col, text_col=text_col, **names)
    runs = written(phrase_runs(rows, window), "index-runs")
    n_hit = (runs.select("id", "key", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
             .groupBy("id", "key").agg(F.count("*").alias("n_hit")))
    hit_items = (runs.select("id", "key", "iid").distinct().join(ids, "iid").groupBy("id", "key")
                 .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    hits = n_hit.join(hit_items, n_hit.id.eqNullSafe(hit_items.id) & (n_hit.key == hit_items.key), "left").select(
        n_hit.id.alias("id2"), n_hit.key.alias("key2"), "n_hit", "items")
    # cut, not matched: ``regexp_count`` keeps a result object for each word, many times slower
    n_words = F.array_size(F.array_remove(F.split("text", NOT_WORD_ANY_CASE, -1), ""))
    d = _keyed(docs, id_col, text_col).select("id", "key", F.coalesce(n_words, F.lit(0)).cast("long").alias("n_words"))
    out = d.join(hits, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "key", "n_words", n.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                      F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
                      ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = (contamination(docs, items, id_col=id_col, text_col=text_col, **names).where("contaminated")
           .select(F.col(id_col).alias("__bad_id"), F.col("key").alias("__bad_key")).distinct())
    bad = broadcast_if_small(written(bad, "index-contaminated"))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad_id")) & (F.xxhash64(F.col(text_col)) == F.col("__bad_key")), "left_anti")


def oracle(docs: str = "documents", items: str = "benchmark", window: int = WINDOW) -> str:
    """DuckDB SQL: every window of every document against every window of the items."""
    cut = r"""list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
    return f"""
WITH i AS (SELECT item_id, {cut} AS ws FROM {items}),
iw AS (SELECT DISTINCT item_id, least(len(ws), {window}) AS k,
              unnest(list_transform(range(greatest(len(ws) - {window - 1}, 1)),
                     lambda s: array_to_string(list_slice(ws, s + 1, s + least(len(ws), {window})), ' '))) AS g
       FROM i WHERE len(ws) > 0),
d AS (SELECT doc_id, coalesce({cut}, []) AS ws FROM {docs}),
dw AS (SELECT doc_id, k, unnest(list_transform(range(greatest(len(ws) - k + 1, 0)), lambda s: {{'s': s,
              'g': array_to_string(list_slice(ws, s + 1, s + k), ' ')}}), recursive := true)
       FROM d, (SELECT DISTINCT k FROM iw)),
m AS (SELECT dw.doc_id, iw.item_id, dw.s, dw.k FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""
