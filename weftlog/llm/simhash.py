"""Document fingerprints (operator 11): SimHash, and a search by permuted block tables.

A text's terms are its distinct pairs of neighbouring words (a text of one word has that word), each
with a weight, the letters in it up to 31, so that pairs of short, frequent words say little. Each
term's 128-bit hash votes with its weight on every bit: for one where the bit is set, against it where
not. The sums of votes of two bits share a long, so that 64 sums of longs, in generated code, hold a
document's votes, and a document's terms meet in the task that reads it.

Fingerprints within ``radius`` bits of each other are found by tables of blocks: of BLOCKS blocks, at
least BLOCKS - radius are equal, so that a table for each choice of two blocks, keyed by them, holds
every such pair in some bucket when radius <= BLOCKS - 2; a pair counts in the first table only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import words_of
from weftlog.plans.ordered import running
from weftlog.plans.scratch import materialize, measured, passing_tables

#: Bits of a fingerprint, the most letters that weigh in a term (a power of two less one), blocks of equal width, and the radius of the search.
BITS, LETTERS, BLOCKS, RADIUS = 128, 31, 8, 6

_WIDTH = BITS // BLOCKS
#: The bits of two places, one in each half of a long.
_PAIR = 0x0000000100000001


def terms(words: Column) -> Column:
    """Distinct terms of an array of words, as longs: a hash whose lowest bits are the term's weight."""
    n = F.size(words)
    one = lambda h, letters: h.bitwiseAND(F.lit(~LETTERS)).bitwiseOR(F.least(letters, F.lit(LETTERS)).cast("long"))
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: one(F.xxhash64(a, b), F.length(a) + F.length(b)))
    return F.array_distinct(F.when(n > 1, pairs).otherwise(F.transform(words, lambda a: one(F.xxhash64(a), F.length(a)))))


def votes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hi, lo): the fingerprint of each row of texts (keys, text), whose keys tell texts apart.

    A null text counts as an empty one; without words, or where votes tie, bits are 0.
    """
    t = texts.select(*keys, words_of(F.col("text")).alias("words")).select(*keys, F.explode_outer(terms(F.col("words"))).alias("t"))
    t = t.select(*keys, F.col("t").bitwiseAND(F.lit(LETTERS)).alias("w"), F.xxhash64("t").alias("lo"), F.xxhash64("t", F.lit(1)).alias("hi"))
    lane = lambda c, j: F.sum(F.shiftrightunsigned(c, j).bitwiseAND(F.lit(_PAIR)) * F.col("w"))
    sums = t.groupBy(*keys).agg(F.sum("w").alias("w"), *[lane(c, j).alias(f"{c}{j}") for c in ("hi", "lo") for j in range(32)])

    def half(c: str) -> Column:
        out = F.lit(0).cast("long")
        for j in range(32):
            s = F.col(f"{c}{j}")
            for votes_for, bit in ((s.bitwiseAND(F.lit(0xFFFFFFFF)), j), (F.shiftrightunsigned(s, 32), j + 32)):
                out = out.bitwiseOR(F.when(2 * votes_for > F.col("w"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
        return out

    return sums.select(*keys, half("hi").alias("hi"), half("lo").alias("lo"))


def distance(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))


def hexadecimal(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def _block(hi: Column, lo: Column, k: int) -> Column:
    word, at = (lo, k) if k < BLOCKS // 2 else (hi, k - BLOCKS // 2)
    return F.shiftrightunsigned(word, at * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1))


def _met(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the documents, by shuffle: files that compress well, and rows that are dealt out,
    are sized too low, and would be broadcast by way of the driver."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def search(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(hi, lo, hi2, lo2, distance): for each distinct fingerprint (hi, lo) of queries the other distinct ones of prints within radius.

    Both tables are dealt to the permuted tables once; a bucket's rows meet by an equi-join on table and
    key, whose large keys adaptive execution splits.
    """
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError(f"the tables find fingerprints within {BLOCKS - 2} bits")
    tables = list(combinations(range(BLOCKS), 2))

    def dealt(df: DataFrame, a: str, b: str) -> DataFrame:
        hi, lo = F.col("hi"), F.col("lo")
        key = lambda i, j: F.shiftleft(_block(hi, lo, i), _WIDTH).bitwiseOR(_block(hi, lo, j))
        keys = F.posexplode(F.array(*[key(i, j) for i, j in tables])).alias("table", "key")
        return df.select("hi", "lo").distinct().select(hi.alias(a), lo.alias(b), keys)

    left, right = dealt(queries, "hi", "lo"), dealt(prints, "hi2", "lo2")
    ends = [F.col(c) for c in ("hi", "lo", "hi2", "lo2")]
    same = [_block(ends[0].bitwiseXOR(ends[2]), ends[1].bitwiseXOR(ends[3]), k) == 0 for k in range(BLOCKS)]
    first = F.lit(False)
    for n, (i, j) in enumerate(tables):
        others = [~same[k] for k in range(j) if k != i]
        alone = F.lit(True)
        for o in others:
            alone = alone & o
        first = first | ((F.col("table") == n) & alone)
    found = _met(left, right, ["table", "key"]).where((distance(*ends) <= radius) & ((ends[0] != ends[2]) | (ends[1] != ends[3])) & first)
    return found.select(*ends, distance(*ends).alias("distance"))


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a key that is never null, a hash of the text, and its code points."""
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", key.alias("k"), F.xxhash64(text).alias("h"), F.char_length(text).cast("long").alias("n_chars"), text.alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every distinct row of docs (doc_id, text); 32 hexadecimal digits."""
    keys = ["k", "h", "n_chars"]
    rows = _rows(docs).select("doc_id", *keys, "text").dropDuplicates(keys)
    return votes(rows, ["doc_id", *keys]).select("doc_id", "n_chars", hexadecimal(F.col("hi"), F.col("lo")).alias("fingerprint"))


def digests(docs: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """For every row of docs (doc_id, text) its fingerprint, that of its edited text, and how alike they and the next document's are.

    The next document is the one with the next smaller doc_id, after the smallest the largest; rows with
    one doc_id count once for each of their texts, in the order of hashes, and a null doc_id is the
    smallest. A single document is its own next. The edited text has the last floor(n_chars/2) code points
    replaced by the first as many, or all, of the next document. Likeness is the share of equal bits.

    n_near: for the documents whose doc_id is divisible by ``every``, the stated query set, other
    documents (repeated rows once) within ``radius`` bits; null for the rest and for ids that are no
    numbers. Null and empty texts have no terms and the fingerprint 0. Repeated rows give repeated results, columns other
    than doc_id and text are ignored, and an empty table gives an empty result.
    """
    with passing_tables(docs.sparkSession):
        return materialize(_digests(docs, radius, every), "simhash-digests", keep=True)


def _digests(docs: DataFrame, radius: int, every: int) -> DataFrame:
    keys = ["k", "h", "n_chars"]
    rows = _rows(docs)
    ids, seen = measured(rows.select("doc_id", *keys), "simhash-ids", F.count("*").alias("rows"))
    ranked = running(ids.distinct(), ["doc_id", "h", "n_chars"], "n_chars").select("doc_id", *keys, "rank", "n")
    ranked, distinct = measured(ranked, "simhash-ranks", F.count("*").alias("rows"))
    texts = rows.select("k", "h", "text")
    if distinct["rows"] < seen["rows"]:
        texts = texts.dropDuplicates(["k", "h"])
    # the head of a document goes to the one whose next it is; texts are dealt by their key once for both joins
    of = ranked.select("k", "h", F.when(F.col("rank") < F.col("n"), F.col("rank") + 1).otherwise(F.lit(1)).alias("to"))
    to = ranked.select(F.col("rank").alias("to"), F.col("k").alias("k2"), F.col("h").alias("h2"), "n_chars", "doc_id")
    links = materialize(_met(of, to, "to").withColumn("half", F.floor(F.col("n_chars") / 2)), "simhash-links")
    heads = _met(texts, links, ["k", "h"]).select(F.col("k2").alias("k"), F.col("h2").alias("h"), "doc_id", F.col("to").alias("rank"), "n_chars", "half", F.substring("text", F.lit(1), F.col("half")).alias("head"))
    edited = _met(texts, heads, ["k", "h"]).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("half")), "head"))
    both = edited.select("k", "h", "doc_id", "rank", "n_chars", F.sha2("edited", 256).alias("sha"), F.posexplode(F.array("text", "edited")).alias("which", "text"))
    prints = materialize(votes(both, ["k", "h", "doc_id", "rank", "n_chars", "sha", "which"]), "simhash-prints")
    own = prints.where("which = 0").drop("which")
    other = prints.where("which = 1").select("rank", F.col("hi").alias("hi2"), F.col("lo").alias("lo2"))
    following = _met(own, ranked.select("rank", "n"), "rank").select(F.when(F.col("rank") < F.col("n"), F.col("rank") + 1).otherwise(F.lit(1)).alias("rank"), F.col("hi").alias("hi3"), F.col("lo").alias("lo3"))
    asked = own.where((F.col("doc_id").try_cast("long") % every) == 0)
    classes = own.groupBy("hi", "lo").agg(F.count("*").alias("docs"))
    found = _met(search(own, asked, radius), classes.withColumnsRenamed({"hi": "hi2", "lo": "lo2"}), ["hi2", "lo2"])
    near = found.groupBy("hi", "lo").agg(F.sum("docs").alias("others"))
    near = _met(classes, near, ["hi", "lo"], "left").select("hi", "lo", (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("near"))
    out = _met(_met(_met(own, other, "rank"), following, "rank"), near, ["hi", "lo"], "left")
    alike = lambda k: (1 - distance(F.col("hi"), F.col("lo"), F.col(f"hi{k}"), F.col(f"lo{k}")) / BITS).alias("near_edited" if k == 2 else "near_next")
    is_asked = (F.col("doc_id").try_cast("long") % every) == 0
    out = out.select("k", "h", "n_chars", F.col("sha").alias("edited_sha256"), hexadecimal(F.col("hi"), F.col("lo")).alias("fingerprint"), hexadecimal(F.col("hi2"), F.col("lo2")).alias("edited_fingerprint"), alike(2), alike(3), F.when(is_asked, F.col("near")).alias("n_near"))
    return _met(ids, out, keys).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")
