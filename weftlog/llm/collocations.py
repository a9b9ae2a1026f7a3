"""Phrase collocations (operator 13): dictionary-encoded words, packed n-grams, range partition, sort, run-length count.

Texts are cut into chunks of about CHUNK tokens, each written once as a stream of numbers of its own
dictionary, with 0 where a piece ends. The chunks' dictionaries, a row for each word of a chunk, give the
counts of words, and the frequent words a number for the whole corpus; those numbers go back to the chunks
that have the words, so that no dictionary is broadcast. A word that is not frequent ends a piece, as no
frequent phrase has it.

Each pair of neighbours, with what follows it (0 where the piece ends), is packed in a key of 12 bytes: three
numbers of 4. A chunk's keys are sorted by radix, digit after digit, and counted by runs before they are dealt
by ranges of the key, so that a phrase has a row for each chunk at most, however frequent. The sorted ranges are counted
by runs again: equal keys are a phrase of three words, and the keys that begin alike a phrase of two, whose
counts are put together where a range cuts them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.plans.ordered import running
from weftlog.plans.scratch import materialize, measured, passing_tables
from weftlog.plans.sizing import sized

#: Times that a phrase must occur, phrases of a language that are returned, and the share (in percent) of a
#: phrase's occurrences that lie in a longer phrase from which on it goes.
LEAST, FIRST, INSIDE = 10, 2_000, 50
#: Tokens of a chunk, bytes of a text that are cut at a time, parts in which the first phrases of a language are looked for.
CHUNK, SLICE, PARTS = 2_000_000, 1_000_000, 32

#: A-Z in lower case, all that ends a piece as a line feed, tabs as spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\x0d" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_NONE = 2**32 - 1
_WORD_TYPE = pa.struct([("lang", pa.string()), ("word", pa.string()), ("local", pa.int64()), ("c", pa.int64())])


class _Chunk:
    """Tokens numbered in order of appearance, from 1; words of different languages have different numbers."""

    def __init__(self) -> None:
        self.next = count(1)
        self.words: dict[str, defaultdict[bytes, int]] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, data: bytes) -> None:
        if lang not in self.words:
            self.words[lang] = defaultdict(self.next.__next__, {b"\n": 0, b"": _NONE})
        cut = data.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.words[lang].__getitem__, cut), np.uint32, len(cut))
        ids = ids[ids != _NONE]
        self.parts.append(ids)
        self.size += len(ids)

    def end_text(self) -> None:
        self.parts.append(np.zeros(1, np.uint32))
        self.size += 1

    def row(self, number: int, tail: int) -> tuple[dict, list[tuple[str, bytes]]]:
        """The chunk, and its last ``tail`` tokens, which belong to the next one: b"\\n" for the end of a piece."""
        stream = np.concatenate(self.parts)
        lang_of, word_of, local = [], [], []
        for lang, known in self.words.items():
            mine = [(w, k) for w, k in known.items() if 0 < k < _NONE]
            lang_of += [lang] * len(mine)
            word_of += [w for w, _ in mine]
            local += [k for _, k in mine]
        counts = np.bincount(stream[: len(stream) - tail], minlength=max(local, default=0) + 1)
        words = pa.StructArray.from_arrays(
            [pa.array(lang_of, pa.string()), pa.array(word_of, pa.binary()).cast(pa.string()), pa.array(local, pa.int64()), pa.array(counts[np.array(local, np.int64)], pa.int64())], fields=list(_WORD_TYPE)
        )
        name = dict(zip(local, zip(lang_of, word_of, strict=True), strict=True))
        left = [name.get(k, ("", b"\n")) for k in stream[len(stream) - tail :].tolist()] if tail else []
        return {"chunk": number, "tail": tail, "stream": stream.astype("<u4").tobytes(), "words": words}, left


_CHUNKS = "chunk long, tail int, stream binary, words array<struct<lang:string,word:string,local:long,c:long>>"


def _slices(data: bytes) -> Iterator[bytes]:
    """data in parts of about SLICE bytes, cut at white space."""
    at = 0
    while len(data) - at > SLICE:
        ends = [e for e in (data.find(b" ", at + SLICE), data.find(b"\n", at + SLICE)) if e >= 0]
        if not ends:
            break
        yield data[at : min(ends)]
        at = min(ends)
    yield data[at:]


def chunks(docs: DataFrame, tokens: int = CHUNK) -> DataFrame:
    """_CHUNKS of docs (text, lang). A long text may go on in the next chunk, which then begins with the last two tokens again:
    phrases belong to the chunk in which they begin, and the last ``tail`` tokens of a chunk begin none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        chunk = _Chunk()

        def table(row: dict) -> pa.RecordBatch:
            words = pa.ListArray.from_arrays(pa.array([0, len(row["words"])], pa.int32()), row["words"])
            return pa.record_batch([pa.array([row["chunk"]], pa.int64()), pa.array([row["tail"]], pa.int32()), pa.array([row["stream"]], pa.binary()), words], ["chunk", "tail", "stream", "words"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                for part in _slices(text.encode().translate(_TABLE)):
                    if chunk.size >= tokens:  # within a text
                        row, left = chunk.row(next(numbers), 2)
                        yield table(row)
                        chunk = _Chunk()
                        for _, word in left:
                            chunk.add(lang, word)
                    chunk.add(lang, part)
                chunk.end_text()
                if chunk.size >= tokens:
                    yield table(chunk.row(next(numbers), 0)[0])
                    chunk = _Chunk()
        if chunk.size:
            yield table(chunk.row(next(numbers), 0)[0])

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, _CHUNKS)


def radix_sorted(keys: np.ndarray) -> np.ndarray:
    """64-bit keys in order, by 16-bit digits from the lowest; numpy sorts such digits by counting."""
    top = int(keys.max(initial=0))
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        keys = keys[np.argsort(digit, kind="stable")]
    return keys


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin, and how long they are."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1] if keys.ndim == 1 else (keys[1:] != keys[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(keys)))


def _packed_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """(key, n): the packed phrases of one chunk (left) whose frequent words have numbers (right)."""
    none = pa.table({"key": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    if not left.num_rows or not right.num_rows:
        return none
    stream, tail = np.frombuffer(left.column("stream")[0].as_py(), "<u4"), left.column("tail")[0].as_py()
    local, number = (np.asarray(right.column(c)) for c in ("local", "id"))
    order = np.argsort(number)
    local, number = local[order], number[order]
    dense = np.zeros(max(int(stream.max(initial=0)), int(local.max())) + 1, np.uint64)  # 1, 2 ... in order of the numbers
    dense[local] = np.arange(1, len(local) + 1, dtype=np.uint64)
    t = np.append(dense[stream], np.zeros(2, np.uint64))
    a, b, c = t[:-2], t[1:-1], t[2:]
    if tail:
        a, b, c = a[:-tail], b[:-tail], c[:-tail]
    pair = (a > 0) & (b > 0)
    bits = np.uint64(len(local).bit_length())
    if 3 * int(bits) > 64:
        raise ValueError("a chunk has more words than its keys have room for")
    keys = radix_sorted((((a[pair] << bits) | b[pair]) << bits) | c[pair])
    if not len(keys):
        return none
    starts, n = _runs(keys)
    keys, mask = keys[starts], (np.uint64(1) << bits) - np.uint64(1)
    names = np.append(np.zeros(1, np.int64), number)
    out = np.empty((len(keys), 3), ">u4")
    for k, part in enumerate((keys >> (bits + bits), (keys >> bits) & mask, keys & mask)):
        out[:, k] = names[part.astype(np.int64)]
    offsets = np.arange(0, 12 * len(keys) + 1, 12, dtype=np.int32)
    key = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])
    return pa.table({"key": key, "n": pa.array(n, pa.int64())})


def _counted(least: int):
    """Runs of sorted (key, n): (id1, id2, id3, f). id3 is 0 for phrases of two words, of which the first and last of a range may go on in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty((0, 3), np.int64), np.empty(0, np.int64)
        first = True
        held: tuple[np.ndarray, int] | None = None  # the phrase of two words that is being counted

        def out(rows: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([*(pa.array(rows[:, k], pa.int64()) for k in range(3)), pa.array(f, pa.int64())], ["id1", "id2", "id3", "f"])

        def count_up(keys: np.ndarray, n: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, first
            threes = (n >= least) & (keys[:, 2] > 0)
            yield out(keys[threes], n[threes])
            pairs = keys.copy()
            pairs[:, 2] = 0
            if held is not None:
                pairs, n = np.vstack([held[0][None], pairs]), np.append(held[1], n)
            if not len(pairs):
                return
            starts, _ = _runs(pairs)
            pairs, sums = pairs[starts], np.add.reduceat(n, starts)
            if not last:
                held, pairs, sums = (pairs[-1], int(sums[-1])), pairs[:-1], sums[:-1]
            keep = sums >= least
            if len(keep):
                keep[0] |= first  # it may have begun in the range before
                first = False
                keep[-1] |= last
            yield out(pairs[keep], sums[keep])

        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column("key")
            at = np.frombuffer(col.buffers()[1], np.int32, count=len(col) + 1, offset=4 * col.offset)
            raw = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].view(">u4").reshape(-1, 3).astype(np.int64)
            keys, n = np.vstack([keys, raw]), np.append(n, np.asarray(batch.column("n")))
            starts, _ = _runs(keys)
            keys, n = keys[starts], np.add.reduceat(n, starts)
            yield from count_up(keys[:-1], n[:-1], False)  # the last key may go on in the next batch
            keys, n = keys[-1:], n[-1:]
        if len(keys) or held is not None:
            yield from count_up(keys, n, True)

    return run


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact in decimals of 38 digits for counts of up to 15."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right)


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, inside: int = INSIDE, tokens: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two and three words by their score.

    A-Z count as a-z, `.,;:!?` and line ends end a piece, spaces and tabs a word; a null lang is `und`. a is
    how often a phrase occurs, l and r how often the parts of its lowest-scoring cut do, n how many words the
    language has. A phrase goes if a longer candidate has it and at least ``inside`` percent of its
    occurrences. Ties go by a, then by the bytes of the phrase. Null and empty texts have no words; repeated
    rows count each time; other columns are ignored. An empty table gives an empty result.
    """
    with passing_tables(docs.sparkSession):
        return materialize(_collocations(docs, least, first, inside, tokens), "collocations", keep=True)


def _collocations(docs: DataFrame, least: int, first: int, inside: int, tokens: int) -> DataFrame:
    cut = materialize(chunks(docs, tokens), "colloc-chunks")
    words = cut.select("chunk", F.explode("words").alias("w")).select("chunk", "w.*")
    total = words.groupBy("lang").agg(F.sum("c").alias("n"))
    often = words.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    dictionary, seen = measured(running(often, ["lang", "word"], "f").select("lang", "word", "f", F.col("rank").alias("id")), "colloc-dictionary", F.count("*").alias("words"))
    if seen["words"] >= 2**32:
        raise ValueError("more frequent words than keys of 4 bytes can tell apart")
    numbered = words.select("chunk", "lang", "word", "local").join(dictionary.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of"), "local", "id")
    packed = cut.select("chunk", "tail", "stream").groupBy("chunk").cogroup(numbered.groupBy("of")).applyInArrow(_packed_counts, "key binary, n long")
    sorted_keys = packed.repartitionByRange("key").sortWithinPartitions("key")
    grams = materialize(sorted_keys.mapInArrow(_counted(least), "id1 long, id2 long, id3 long, f long"), "colloc-grams")
    # phrases of two words, with their cut
    two = grams.where("id3 = 0").groupBy("id1", "id2").agg(F.sum("f").alias("a")).where(F.col("a") >= least)
    known = sized(dictionary)
    left = known.select(F.col("id").alias("id1"), "lang", F.col("word").alias("word1"), F.col("f").alias("l"))
    right = known.select(F.col("id").alias("id2"), F.col("word").alias("word2"), F.col("f").alias("r"))
    two = two.join(left, "id1").join(right, "id2")
    two = materialize(two.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r"))), "colloc-two")
    # phrases of three, whose parts are a word and such a phrase
    head = two.select("id1", "id2", "lang", "word1", "word2", F.col("l").alias("f1"), F.col("a").alias("f12"))
    end = two.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("word2").alias("word3"), F.col("r").alias("f3"), F.col("a").alias("f23"))
    three = grams.where("id3 > 0").withColumnRenamed("f", "a").join(head, ["id1", "id2"]).join(end, ["id2", "id3"])
    three = three.withColumns({"s1": score_of(F.col("a"), F.col("f1"), F.col("f23")), "s2": score_of(F.col("a"), F.col("f12"), F.col("f3"))})
    early = F.col("s1") <= F.col("s2")
    three = materialize(three.select("id1", "id2", "id3", "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score")), "colloc-three")
    part = F.explode(F.array(F.struct("id1", "id2"), F.struct(F.col("id2").alias("id1"), F.col("id3").alias("id2")))).alias("p")
    longest = three.select(part, "a").select("p.*", "a").groupBy("id1", "id2").agg(F.max("a").alias("longer"))
    two = two.join(longest, ["id1", "id2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    phrases = two.withColumn("phrase", F.concat_ws(" ", "word1", "word2")).select(columns).unionByName(three.select(columns))
    # first within parts of a language, then among what is left
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = parts.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("k") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(F.broadcast(total) if total.limit(10_001).count() <= 10_000 else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same from all phrases of all pieces.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
one AS (SELECT lang, x AS phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM p) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
two AS (SELECT lang, w1, w2, count(*) AS f FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p)) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p)) GROUP BY ALL HAVING count(*) >= 10),
s2 AS (SELECT t.lang, w1, w2, t.f AS a, x.f AS l, y.f AS r FROM two t JOIN one x ON x.lang = t.lang AND x.phrase = w1 JOIN one y ON y.lang = t.lang AND y.phrase = w2),
s3 AS (SELECT t.lang, t.w1, t.w2, t.w3, t.f AS a, x.f AS f1, b.f AS f23, c.f AS f12, y.f AS f3,
  (CAST(1000000 AS HUGEINT) * t.f * t.f) // (CAST(x.f AS HUGEINT) * b.f) AS c1, (CAST(1000000 AS HUGEINT) * t.f * t.f) // (CAST(c.f AS HUGEINT) * y.f) AS c2
  FROM three t JOIN one x ON x.lang = t.lang AND x.phrase = t.w1 JOIN two b ON b.lang = t.lang AND b.w1 = t.w2 AND b.w2 = t.w3
  JOIN two c ON c.lang = t.lang AND c.w1 = t.w1 AND c.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.phrase = t.w3),
longer AS (SELECT lang, w1, w2, max(f) AS m FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
c AS (
  SELECT s2.lang, s2.w1 || ' ' || s2.w2 AS phrase, a, l, r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score
  FROM s2 LEFT JOIN longer g ON g.lang = s2.lang AND g.w1 = s2.w1 AND g.w2 = s2.w2 WHERE g.m IS NULL OR 100 * g.m < 50 * a
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN c1 <= c2 THEN f1 ELSE f12 END, CASE WHEN c1 <= c2 THEN f23 ELSE f3 END, least(c1, c2) FROM s3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM c)
SELECT k.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM k JOIN total USING (lang) WHERE rank <= 2000
"""
