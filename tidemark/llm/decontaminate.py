"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (a shorter item is
one window). A window can only occur where its rarest word does, so that word is the
window's prefix: benchmark words are ordered by their number of occurrences in the documents,
ties by the word, and only the rarest word of each window is joined with the word positions.
The position of the prefix word in the window and the lengths of both sides bound where the
window can lie; what remains is compared word by word. Windows that share their rarest word
occurrence and item share the join row: they are offsets into one item.

Defined cases: a null text has no words. Items without words have no windows. Repeated
benchmark rows are one item per ``item_id``; an item whose id is null is ignored. Repeated
document rows are reported one by one, rows that share a ``doc_id`` are kept apart by their
text, a null ``doc_id`` is reported like others. Other columns pass through unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_lower, is_small, written

# Fixed value of the query contract: what separates words, after A-Z are lower case.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Join rows (window prefixes) up to this number are broadcast, some 100 bytes each.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text, in order; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS, -1), "")


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, start, n, w): the distinct windows of each item; ``w`` are their words."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("all"))
    items = items.where(F.size("all") > 0).withColumn("n", F.least(F.size("all"), F.lit(window)))
    starts = items.select("item_id", "all", "n", F.explode(F.sequence(F.lit(0), F.size("all") - F.col("n"))).alias("start"))
    return starts.select("item_id", F.slice("all", F.col("start") + 1, F.col("n")).alias("w")).distinct()


def _prefixes(windows: DataFrame, positions: DataFrame) -> DataFrame:
    """(word, at, w, items): each distinct window under its rarest word, found ``at`` that place."""
    distinct = windows.groupBy("w").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    placed = distinct.select("w", "items", F.posexplode("w").alias("at", "word"))
    vocabulary = placed.select("word").distinct()
    if is_small(vocabulary, BROADCAST_ROWS):
        vocabulary = F.broadcast(vocabulary)
    counts = positions.join(vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = placed.join(counts, "word")  # a window with a word that no document has cannot occur
    rarest = Window.partitionBy("w").orderBy("n", "word", "at")
    whole = ranked.withColumn("present", F.count(F.lit(1)).over(Window.partitionBy("w")))
    first = whole.where(F.col("present") == F.size("w")).withColumn("rank", F.row_number().over(rarest))
    return first.where("rank = 1").select("word", "at", "w", "items")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, row_hash, start, n, items) for every place where a benchmark window occurs.

    ``start`` counts words from 0, ``n`` is the window's length, ``items`` the items that have it.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), words(F.col("text")).alias("all"))
    positions = rows.select(F.explode("all").alias("word"))
    prefixes = written(_prefixes(_windows(benchmark, window), positions), "prefixes")
    begin = F.col("pos") - F.col("at")
    fits = (begin >= 0) & (begin + F.size("w") <= F.col("n_words"))
    size = F.size("all").alias("n_words")
    if is_small(prefixes, BROADCAST_ROWS):
        places = rows.select("doc_id", "row_hash", "all", size, F.posexplode("all").alias("pos", "word"))
        near = places.join(F.broadcast(prefixes), "word").where(fits)
    else:  # only positions move; the words of the documents meet the candidates afterwards
        places = rows.select("doc_id", "row_hash", size, F.posexplode("all").alias("pos", "word"))
        near = places.join(prefixes, "word").where(fits)
        near = near.withColumnsRenamed({"doc_id": "_id", "row_hash": "_hash"})
        distinct = rows.dropDuplicates(["doc_id", "row_hash"])
        near = near.join(distinct, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("row_hash")))
    return near.where(F.slice("all", begin + 1, F.size("w")) == F.col("w")).select(
        "doc_id", "row_hash", begin.alias("start"), F.size("w").alias("n"), "items"
    )


def hits_by_document(found: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n_hit, items): words inside any occurrence, and the items, sorted."""
    starts = found.groupBy("doc_id", "row_hash", "start").agg(
        F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    earlier = Window.partitionBy("doc_id", "row_hash").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("start") + F.col("n")).over(earlier), F.lit(0))
    gain = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), reached))
    return (
        starts.withColumn("gain", gain)
        .groupBy("doc_id", "row_hash")
        .agg(F.sum("gain").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20
) -> DataFrame:
    """(doc_id, row_hash, n_words, n_hit, items, contaminated) for every row of ``docs``.

    A document is contaminated if at least one word in ``one_in`` is hit.
    """
    hits = hits_by_document(occurrences(docs, benchmark, window)).withColumnsRenamed({"doc_id": "_id", "row_hash": "_hash"})
    sizes = docs.select(
        "doc_id", F.xxhash64("text").alias("row_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    joined = sizes.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id",
        "row_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    hits = hits_by_document(occurrences(docs, benchmark, window))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "n_hit")
    same = docs["doc_id"].eqNullSafe(hits["_id"]) & (F.xxhash64(docs["text"]) == hits["_hash"])
    enough = hits["n_hit"] * one_in >= F.size(words(docs["text"]))
    return docs.join(hits, same & enough, "left_anti")


#: Twin of ``op3_decontaminate`` on tables whose ids are distinct.
ORACLE = r"""
WITH docs AS (
    SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
    FROM documents
), items AS (
    SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
    FROM benchmark
), starts AS (
    SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
    FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM starts
), sizes AS (
    SELECT DISTINCT n FROM windows
), places AS (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs JOIN sizes ON len(w) >= n
), grams AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM places
), found AS (
    SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
"""
