"""Benchmark decontamination, in DataFrame functions only.

Benchmark items become windows of WINDOW consecutive normalised words (an item of fewer words is one window).  Every window has an
anchor, its longest word; the distinct windows, by anchor, are the hash set that is sent to every task.  A set above BLOCK_BYTES is cut
into blocks by a hash, and documents stream through once for each block: each word probes the anchors, and where one is met the words around
it are compared with the whole window.  Only true hits leave that stage: neither texts nor words are shuffled, and a frequent anchor is met where it
stands.  Hits find their documents by id and hash of the text: numbers alone, sent to every task up to MAX_HITS rows, by shuffle beyond.

Defined results: a null text has no words; repeated rows (same id and text) get the same result each; a null id is an id of its own;
a null item id is the empty text; items without words never occur; an empty benchmark leaves every document clean; other columns
of the inputs are kept by decontaminate() and not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, materialize

WINDOW = 10
#: Bytes of the windows that are broadcast at once, as counted by `weight`, and rows of hits (of some 150 bytes; spans count as rows).
BLOCK_BYTES, MAX_HITS = 128 << 20, 250_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: In the text as it is: a character between words, and a word with what stands before it.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PART = rf"{GAP}*[^{GAP[1:]}+"


def ascii_lower(text: Column) -> Column:
    """A-Z only; lower() does the same, faster, where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """Normalised words of a text, none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def windows(benchmark: DataFrame) -> DataFrame:
    """(anchor, offset, length, window, items): a row for each distinct window."""
    w = F.col("words")
    n = F.size(w)
    each = (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
        .where(n > 0)
        .select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.slice(w, i, WINDOW))).alias("w"))
    )
    top = F.array_max(F.transform("w", lambda x, i: F.struct(F.length(x).alias("size"), x.alias("word"), (-i).alias("back"))))
    return (
        each.groupBy("w")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(top["word"].alias("anchor"), (-top["back"]).alias("offset"), F.size("w").alias("length"), F.array_join("w", " ").alias("window"), "items")
    )


def window_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The distinct windows, in blocks of about BLOCK_BYTES each."""
    found = materialize(windows(benchmark), "windows")
    weight = F.octet_length("window") + F.octet_length("anchor") + 16 * F.size("items") + 100
    blocks = max(1, -(-(found.agg(F.sum(weight.cast("long"))).first()[0] or 0) // BLOCK_BYTES))
    return [found.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [found]


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(hit_id, hit_hash, spans, items) of contaminated documents; spans: distinct (start, end) in words, end exclusive."""
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words")).select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "word"))
    start = F.col("pos") - F.col("offset")
    here = F.array_join(F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("length")), " ")
    same = (F.col("word") == F.col("anchor")) & (start >= 0) & (here == F.col("window"))
    met = [each.join(F.broadcast(block), same).select("doc_id", "text_hash", F.struct(start.alias("start"), (start + F.col("length")).alias("end")).alias("span"), "items") for block in window_blocks(benchmark)]
    found = (
        reduce(DataFrame.unionByName, met)
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
        .agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    return materialize(found, "hits")


def beside(rows: DataFrame, found: DataFrame, same: Column, how: str) -> DataFrame:
    """rows joined with the hits, which are sent to every task if they are few; found has columns of fixed size, and spans at most."""
    size = F.sum(F.size("spans") + 1 if "spans" in found.columns else F.lit(1))
    return rows.join(F.broadcast(found) if (found.agg(size).first()[0] or 0) <= MAX_HITS else found, same, how)


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: how many words and items are hit."""
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    found = hits(docs.select("doc_id", "text"), benchmark).select("hit_id", "hit_hash", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest(F.array_join("items", ",")).alias("items_sha256"))
    joined = beside(sized, found, (F.col("text_hash") == F.col("hit_hash")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    none = F.lit(0).cast("long")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", digest(F.lit(""))).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words cut from their texts."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r}")
    found = hits(docs.select("doc_id", "text"), benchmark)
    if remove == "documents":
        own = {fresh(docs, "row_id"): F.col("doc_id"), fresh(docs, "row_hash"): F.xxhash64("text")}
        keyed = docs.withColumns(own)
        gone = found.select(F.col("hit_id").alias(fresh(keyed, "gone_id")), F.col("hit_hash").alias(fresh(keyed, "gone_hash")))
        (row_id, row_hash), (gone_id, gone_hash) = own, gone.columns
        return beside(keyed, gone, (F.col(row_hash) == F.col(gone_hash)) & F.col(row_id).eqNullSafe(F.col(gone_id)), "left_anti").drop(row_id, row_hash)
    rows, found = docs.select(F.struct("*").alias("row")), found.drop("items")
    joined = beside(rows, found, (F.xxhash64("row.text") == F.col("hit_hash")) & F.col("row.doc_id").eqNullSafe(F.col("hit_id")), "left")
    whole = F.col("row.text")
    parts = F.regexp_extract_all(whole, F.lit(PART), 0)
    kept = F.filter(parts, lambda p, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    text = F.when(F.col("spans").isNull(), whole).otherwise(F.concat(F.array_join(kept, ""), F.regexp_extract(whole, rf"({GAP}*)\z", 1)))
    return joined.select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM bi),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, di.n, item FROM di JOIN bw ON di.n = bw.n AND array_to_string(w[i:i + di.n - 1], ' ') = t),
spot AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spot USING (doc_id) LEFT JOIN its USING (doc_id)
"""
