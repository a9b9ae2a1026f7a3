"""Benchmark decontamination with a distributed positional inverted index (operator 2).

The index holds postings (term, doc_id, pos) of training tokens. Only test terms that a search can
ask for are stored: of every window of an item, the PROBES terms that are the rarest in the corpus,
counted over all documents. A search

1.  joins the probes with their postings and adjusts each to the place where the item would start;
2.  intersects the lists: an alignment (document, item, place) stays if all probes of some window
    are there (exact phrases), or within ``slop`` words of there (proximity);
3.  checks alignments on the words themselves: a window occurs where its words stand one after
    another.

Everything is DataFrame work. Postings are exploded from the texts, joined with the probe table
(broadcast only while its counted rows are under a bound) and grouped by document, item and place,
so no term, however frequent, has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.common import NO_WORD_ANY_CASE, pieces, words_of
from weftlog.plans.scratch import materialize, measured, passing_tables
from weftlog.plans.sizing import sized

WINDOW, PROBES = 13, 3
#: Numbers in alignments, or words of items, that are broadcast (some 50 MB); beyond, they are joined by shuffle.
BROADCAST_NUMBERS = 2_000_000


def item_words(items: DataFrame) -> DataFrame:
    """item_id (string) and words of the items that have words; equal rows once."""
    return items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("item")).where("item_id is not null and size(item) > 0").distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each test term stands in the corpus; terms that it lacks have 0."""
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(sized(terms), "term").groupBy("term").count()
    return terms.join(seen, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("freq"))


def probes(items: DataFrame, counts: DataFrame, window: int = WINDOW, n: int = PROBES) -> DataFrame:
    """(item_id, item, start, at, term): for each window of an item its n rarest places."""
    starts = items.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("item") - window, F.lit(0)))))
    places = starts.select("item_id", "item", "start", F.posexplode(F.slice("item", F.col("start") + 1, window)).alias("k", "term")).withColumn("at", F.col("start") + F.col("k"))
    rank = F.row_number().over(Window.partitionBy("item_id", "item", "start").orderBy("freq", "at"))
    return places.join(counts, "term").withColumn("rank", rank).where(F.col("rank") <= n).select("item_id", "item", "start", "at", "term")


def postings(docs: DataFrame, terms: DataFrame, key: list[str]) -> DataFrame:
    """(term, key columns of docs, pos) of the given terms in all texts, whole."""
    return docs.select(*key, F.posexplode(words_of(F.col("text"))).alias("pos", "term")).join(sized(terms), "term").select("term", *key, "pos")


def _item_key() -> Column:
    """What rows of positions carry instead of the item's words."""
    return F.xxhash64("item_id", "item").alias("item_key")


def alignments(found: DataFrame, wanted: DataFrame, key: list[str], slop: int = 0) -> DataFrame:
    """(key columns, item_key, place): places of an item's start at which all probes of some window agree.

    With slop > 0 probes may be up to slop words off; place is then the lowest of the starts that
    the window's first probe asks for.
    """
    wanted = wanted.withColumn("item_key", _item_key())
    places = wanted.select("item_key", "at", "term").distinct()
    # an alignment with the places it has, then the windows whose probes are all among them
    aligned = found.join(sized(places), "term").select(*key, "item_key", "at", (F.col("pos") - F.col("at")).alias("place"))
    if slop:
        near = F.explode(F.sequence(F.col("place") - slop, F.col("place") + slop))
        aligned = aligned.withColumn("place", near)
    have = aligned.groupBy(*key, "item_key", "place").agg(F.collect_set("at").alias("have"))
    windows = wanted.groupBy("item_key", "start").agg(F.collect_set("at").alias("ats"))
    # a row for each item has the probes of all its windows: its numbers count, not its rows
    numbers = F.coalesce(F.sum(F.size(F.flatten("need")) + F.size("need") + 10), F.lit(0)).alias("numbers")
    need, seen = measured(windows.groupBy("item_key").agg(F.collect_list("ats").alias("need"), F.min(F.size("ats")).alias("least")), "decon-windows", numbers)
    need = F.broadcast(need) if seen["numbers"] <= BROADCAST_NUMBERS else need
    whole = F.exists("need", lambda ats: F.size(F.array_except(ats, "have")) == 0)
    # most alignments have one probe by chance: they are told by their number before any window is looked at
    return have.join(need, "item_key").where(F.size("have") >= F.col("least")).where(whole).select(*key, "item_key", "place")


def _starts(words: Column, item: Column, place: Column, window: int) -> Column:
    """Starts in the document of the windows of item that stand there whole when item starts at place."""
    n = F.size(item)
    same = F.transform(item, lambda w, k: F.when(F.get(words, place + k) == w, F.lit("1")).otherwise(F.lit("0")))
    flags = F.concat_ws("", same)
    length = F.least(F.lit(window), n)
    ones = F.repeat(F.lit("1"), length)
    return F.transform(F.filter(F.sequence(F.lit(0), n - length), lambda k: F.substring(flags, k + 1, length) == ones), lambda k: k + place)


#: Rows of docs are told apart by these: the id, which may be null or repeated, and two hashes of the text.
_ROW = ["doc_id", "h1", "h2"]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), "text")


def _same_row(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left with the other columns of right, a table with _ROW."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in _ROW})
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    return left.join(other, on, how).drop(*[f"_{c}" for c in _ROW])


def _once(docs: DataFrame) -> DataFrame:
    """docs with equal rows once. Rows are told by their hashes first, so texts are dealt out only where some are equal."""
    repeated = docs.groupBy(*_ROW).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated, seen = measured(repeated, "decon-repeated", F.count("*").alias("rows"))
    if not seen["rows"]:
        return docs
    repeated = sized(repeated)
    return _same_row(docs, repeated, "left_anti").unionByName(_same_row(docs, repeated, "left_semi").dropDuplicates(_ROW))


def _wanted(docs: DataFrame, items: DataFrame, window: int, n_probes: int) -> DataFrame:
    terms = materialize(items.select(F.explode("item").alias("term")).distinct(), "decon-terms")
    return materialize(probes(items, term_counts(docs, terms), window, n_probes), "decon-probes")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, n_probes: int = PROBES) -> DataFrame:
    """For every row of docs (doc_id, text) what of it stands in the items of benchmark (item_id, text).

    doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256 (of the
    sorted, comma-joined ids of items with occurring windows), contaminated (20 * n_hit >=
    n_words and n_hit > 0) and items (their sorted ids). A null or empty text has no words and is
    clean; an item without words or without an id is never found; an item of fewer than ``window``
    words is one window. Rows of one doc_id, and rows with a null doc_id, are each judged by their
    own text. Other columns are ignored; an empty table gives an empty result.
    """
    with passing_tables(docs.sparkSession):
        return materialize(_contamination(_rows(docs), benchmark, window, n_probes), "decon-digests", keep=True)


def _contamination(docs: DataFrame, benchmark: DataFrame, window: int, n_probes: int) -> DataFrame:
    items, size = measured(item_words(benchmark).withColumn("item_key", _item_key()), "decon-items", F.coalesce(F.sum(F.size("item") + 10), F.lit(0)).alias("words"))
    wanted = _wanted(docs, items, window, n_probes)
    every, docs = docs, _once(docs)
    found = postings(docs, materialize(wanted.select("term").distinct(), "decon-probe-terms"), _ROW)
    pairs = alignments(found, wanted, _ROW).groupBy(*_ROW, "item_key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    pairs, seen = measured(pairs, "decon-alignments", F.coalesce(F.sum(F.size("places") + 10), F.lit(0)).alias("numbers"))
    # a row for each document and item that align; words are cut between the joins, so once for each
    aligned = _same_row(docs, F.broadcast(pairs) if seen["numbers"] <= BROADCAST_NUMBERS else pairs)
    aligned = aligned.select(*_ROW, "item_key", "places", words_of(F.col("text")).alias("words")).join(F.broadcast(items) if size["words"] <= BROADCAST_NUMBERS else items, "item_key")
    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: _starts(F.col("words"), F.col("item"), p, window))))
    hits = aligned.select(*_ROW, "item_id", F.least(F.lit(window), F.size("item")).alias("size"), starts.alias("starts")).where("size(starts) > 0")
    hits = materialize(hits, "decon-hits").groupBy(*_ROW).agg(F.collect_list(F.struct("item_id", "size", "starts")).alias("found"))
    inside = F.flatten(F.flatten(F.transform("found", lambda p: F.transform(p["starts"], lambda s: F.sequence(s, s + p["size"] - 1)))))
    ids = F.sort_array(F.array_distinct(F.transform("found", lambda p: p["item_id"])))
    hits = hits.select(*_ROW, F.size(F.array_distinct(inside)).cast("long").alias("n_hit"), ids.alias("items"))
    out = _same_row(every.select(*_ROW, F.size(pieces(F.col("text"), NO_WORD_ANY_CASE)).cast("long").alias("n_words")), hits, "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "items",
    )


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = 3, window: int = WINDOW, n_probes: int = PROBES) -> DataFrame:
    """(doc_id, item_id): documents in which the rarest terms of some window of an item stand within slop words of their places.

    Rows of one doc_id count as one; a null doc_id is found like any other. Empty tables and texts find nothing.
    """
    items = materialize(item_words(benchmark).withColumn("item_key", _item_key()), "decon-items")
    wanted = _wanted(docs, items, window, n_probes)
    found = alignments(postings(_once(_rows(docs)), wanted.select("term").distinct(), _ROW), wanted, _ROW, slop)
    return found.join(items, "item_key").select("doc_id", "item_id").distinct()


#: The same from all windows of 13 words, without an index.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, dw.n, s FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
