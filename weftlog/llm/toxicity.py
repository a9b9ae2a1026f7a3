"""Toxicity by noisy-channel deobfuscation (operator 1).

1.  A character trigram model is counted over all texts: a table of 64 * 64 * 64 counts at most,
    summed in the tasks and then by key.
2.  Tokens that look disguised (symbols or digits among letters, letters three times in a row,
    single letters set apart) become a character lattice: a symbol may stand for letters or for
    nothing, a repeated letter for itself or nothing, a separator for nothing or a word's end. The
    Viterbi path under the character model is the restored text. So do tokens with a doubled letter
    that the model finds much likelier single.
3.  A classifier scores restored texts. Its features are words and their beginnings. They are
    counted over a bounded sample of labelled rows, those that the G test finds most telling are
    kept, and a logistic regression with an L2 penalty is fitted on the sample.
4.  Every whole text is scored in one pass. A task remembers the words it has seen, up to a bound.
    Two neighbouring tokens that together make a word which speaks for toxicity become a lattice
    too: they count as that word where its Viterbi path is the word in one piece.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.plans.scratch import materialize, passing_tables

#: Labelled rows that the classifier is fitted on, features kept (the size of the model), least G statistic, L2 penalty.
#: With a lower G, down to 2, more labels are learned by heart and fewer held-out ones are found, in every language.
MAX_TRAIN, MAX_FEATURES, LEAST_G, PENALTY = 12_000, 3_000, 13.0, 1.0
#: Words a task remembers before it starts anew.
MEMORY = 200_000

#: Letters that characters stand for in disguise (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
#: Channel costs (nats): reading a symbol as a letter, dropping one, dropping a repeated letter, dropping a separator, ending a word at one.
COST = {"letter": 0.5, "drop": 6.0, "repeat": 0.5, "separator": 0.7, "end": 1.5}

#: Gain (nats) from which a letter that stands twice is put on a lattice; letters of the shortest word that is sought in two pieces.
MUCH, LEAST_SPLIT = 4.0, 4

#: Places of letters in the model: 0 a word's end, 1-26 a-z, 27-59 the Latin-1 letters, 60 others.
_CODES = 64
_TABLE = np.zeros(0x250, np.uint8)
_TABLE[97:123] = np.arange(1, 27)
_TABLE[0xDF:0x100] = np.arange(27, 60)
_TABLE[0xF7] = 0
_TABLE[0x100:0x250] = 60

_SINGLE = r"(?:[^\W_]|[@$!|+])"
_SPACED = re.compile(rf"(?<!\S){_SINGLE}(?:[ \t]{_SINGLE}){{2,}}(?!\S)")
_MAYBE_SPACED = re.compile(r" \S \S(?:\s|\Z)|\A\S \S \S(?:\s|\Z)")
#: Around a token: marks that stand for no letter, or any mark three times and more; marks of exclamation at its end.
_MARK = r"(?:[^\w@$!|+(<€£¡]|([@$!|+(<€£¡])\1\1+)"
_EDGE = re.compile(rf"\A{_MARK}+|(?:{_MARK.replace('1', '2')}|!)+\Z")
_AROUND = ".,;:!?\"'()[]«»„“”¿¡…-"
_LETTERS = re.compile(r"[^\W\d_]+")
_TWICE, _THRICE = re.compile(r"([^\W\d_])\1"), re.compile(r"([^\W\d_])\1\1")


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(points), 0, np.uint8)
    low = points < len(_TABLE)
    out[low] = _TABLE[points[low]]
    out[~low & (points >= 0x370) & ~((points >= 0x2000) & (points < 0x2E80))] = 60
    return out


def char_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): counts of character trigrams over all texts, lowered, runs of other than letters as one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODES**3, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                x = _codes("\n\n".join(["", *(t.lower() for t in batch.column("text").slice(k, 200).to_pylist() if t), ""]))
                x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))].astype(np.int32)
                if len(x) > 2:
                    total += np.bincount((x[:-2] * _CODES + x[1:-1]) * _CODES + x[2:], minlength=_CODES**3)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(counts: DataFrame) -> np.ndarray:
    """-log P(c | a, b), interpolated with the shorter contexts. The table has a fixed size."""
    n = np.zeros(_CODES**3)
    for r in counts.collect():
        n[r["gram"]] = r["n"]
    n = n.reshape(_CODES, _CODES, _CODES)
    one = (n.sum((0, 1)) + 1) / (n.sum() + _CODES)
    two = (n.sum(0) + 20 * one) / (n.sum((0, 2))[:, None] + 20)
    three = (n + 20 * two[None]) / (n.sum(2)[:, :, None] + 20)
    return -np.log(three).astype(np.float32)


class Restorer:
    """Viterbi decoding of disguised tokens under a character model."""

    def __init__(self, model: np.ndarray) -> None:
        self.cost = model.tolist()
        self.known: dict[str, str] = {}

    def _options(self, raw: str) -> list[list[tuple[int, float, str]]]:
        out, codes = [], _codes(raw).tolist()
        for k, ch in enumerate(raw):
            if codes[k]:
                here = [(codes[k], 0.0, ch)]
            elif ch in LEET:
                here = [(ord(x) - 96, COST["letter"], x) for x in LEET[ch]] + [(-1, COST["drop"], "")]
            else:
                here = [(-1, COST["separator"], ""), (0, COST["end"], " ")]
            if k and ch == raw[k - 1]:
                here.append((-1, COST["repeat"], ""))
            out.append(here)
        return out

    def decode(self, raw: str) -> str:
        """The likeliest text for a disguised one (lower case)."""
        paths = {(0, 0): (0.0, None)}
        for options in self._options(raw):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, back) in paths.items():
                row = self.cost[a][b]
                for code, channel, ch in options:
                    if code < 0:
                        key, c, link = (a, b), cost + channel, back
                    elif code == 0 and b == 0:
                        continue
                    else:
                        key, c, link = (b, code), cost + channel + row[code], (back, ch)
                    if key not in new or c < new[key][0]:
                        new[key] = (c, link)
            paths = new
        cost, back = min(((c + (self.cost[a][b][0] if b else 0.0), link) for (a, b), (c, link) in paths.items()), key=lambda x: x[0])
        out = []
        while back:
            back, ch = back
            out.append(ch)
        return "".join(reversed(out))

    def _doubled(self, word: str) -> bool:
        """Whether letters stand three times in a row, or twice where once is much likelier."""
        if _THRICE.search(word):
            return True
        codes = [0, *_codes(word).tolist(), 0]
        for m in _TWICE.finditer(word):
            a, x, c = codes[m.start()], codes[m.start() + 1], codes[m.end() + 1]
            if self.cost[a][x][x] + self.cost[x][x][c] - self.cost[a][x][c] - COST["repeat"] > MUCH:
                return True
        return False

    def token(self, token: str) -> str:
        """A token (lower case, no white space) without what surrounds it, restored where it looks disguised."""
        if token.isalpha() and not _TWICE.search(token):
            return token
        if (found := self.known.get(token)) is not None:
            return found
        core = _EDGE.sub("", token)
        out = core
        if not core.isalpha() or self._doubled(core):
            out = self.decode(core) if _LETTERS.search(core) else ""
        if len(self.known) > MEMORY:
            self.known.clear()
        self.known[token] = out
        return out

    def restored(self, token: str) -> str:
        """As token(), and letters set apart as one."""
        return self.decode(token) if " " in token or "\t" in token else self.token(token)

    def tokens(self, text: str) -> set[str]:
        """Distinct lowered tokens of a text, and its runs of single letters set apart."""
        lowered = text.lower()
        out = set(lowered.split())
        if _MAYBE_SPACED.search(lowered):
            out.update(m[0].replace("\t", " ") for m in _SPACED.finditer(lowered))
        return out

    def _one(self, head: str, word: str) -> bool:
        """Whether word is likelier than head and the rest apart."""
        apart = f"{head} {word[len(head) :]}"
        if apart not in self.known:
            self.known[apart] = self.decode(apart)
        return self.known[apart] == word

    def joined(self, text: str, heads: dict[str, set[str]]) -> set[str]:
        """Words that stand in text in two pieces. heads: the words by what they may begin with."""
        order, out = text.lower().split(), set()
        for a, b in zip(order, order[1:], strict=False):
            if a in heads and (word := a + b.strip(_AROUND)) in heads[a] and self._one(a, word):
                out.add(word)
        return out

    def text(self, text: str) -> str:
        """The restored text: single letters set apart, then each token."""
        lowered = _SPACED.sub(lambda m: self.decode(m[0]), text.lower())
        return "\n".join(" ".join(self.token(t) for t in line.split()) for line in lowered.split("\n"))


def _features(restored: str) -> list[str]:
    out = []
    for w in _LETTERS.findall(restored):
        out.append(w)
        out += [w[:n] + "~" for n in (4, 5, 6) if len(w) > n]
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, toxic) of about ``most`` labelled rows to learn from, in no held-out fold.

    Several labels of a document count as its largest. The sample is by a hash of doc_id.
    """
    named = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    named = named.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = most / max(1, named.count())
    picked = named if share >= 1 else named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[np.ndarray, dict[str, float], float]:
    """The character model, the weights of the features and the intercept."""
    with passing_tables(docs.sparkSession):
        return _fit(docs, labels, most)


def _fit(docs: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, dict[str, float], float]:
    model = char_model(char_counts(docs))
    # as it is bounded, the sample is dealt out anew
    sample = materialize(labelled_sample(docs, labels, most).repartition(32, "doc_id"), "toxic-sample")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, n = Restorer(model), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {restorer.token(t) if " " not in t else restorer.decode(t) for t in restorer.tokens(text or "")}
                n[toxic > 0].update({f for w in words for f in _features(w)})
        keys = list(n[0].keys() | n[1].keys())
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], ["feature", "pos", "neg"])

    rows = sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()
    size = {r["toxic"]: r["count"] for r in rows}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 1.5)))
    if not n1 or not n0:
        return model, {}, prior
    g = sample.mapInArrow(seen, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    total = F.col("pos") + F.col("neg")
    rest = n1 + n0 - total
    g = g.where("pos + neg >= 3").withColumn("g", 2 * (part(F.col("pos"), total * n1 / (n1 + n0)) + part(F.col("neg"), total * n0 / (n1 + n0)) + part(n1 - F.col("pos"), rest * n1 / (n1 + n0)) + part(n0 - F.col("neg"), rest * n0 / (n1 + n0))))
    names = [r["feature"] for r in g.where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect()]
    if not names:
        return model, {}, prior
    place = {f: k for k, f in enumerate(names)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = {restorer.token(t) if " " not in t else restorer.decode(t) for t in restorer.tokens(text or "")}
                out.append(sorted({place[f] for w in words for f in _features(w) if f in place}))
            yield pa.record_batch([batch.column("toxic"), pa.array(out, pa.list_(pa.int32()))], ["toxic", "features"])

    table = sample.select("text", "toxic").mapInArrow(vectors, "toxic int, features array<int>").collect()
    weights, bias = _logistic([r["features"] for r in table], np.array([r["toxic"] > 0 for r in table], float), len(names))
    return model, {f: float(w) for f, w in zip(names, weights, strict=True) if w}, bias


def _logistic(rows: list[list[int]], y: np.ndarray, n: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty by Nesterov's accelerated gradient."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([f for r in rows for f in r], np.int64)
    w, v, bias, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    # the gradient's steepness is at most a quarter of the largest row sum of X'X
    often = np.bincount(col, minlength=n)
    together = np.bincount(row, often[col], len(rows)) if len(col) else np.zeros(len(rows))
    step = 1 / (0.25 * (min(float((np.bincount(col, (np.bincount(row, minlength=len(rows)) + 1.0)[row], n)).max(initial=0)), float(together.sum())) + len(rows)) + PENALTY)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, v[col], len(rows)) + vb)))
        grad = np.bincount(col, (p - y)[row], n) + PENALTY * v
        w_new, b_new = v - step * grad, vb - step * (p - y).sum()
        m = k / (k + 3)
        v, vb = w_new + m * (w_new - w), b_new + m * (b_new - bias)
        w, bias = w_new, b_new
    return w, float(bias)


def score(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text), by its whole text.

    Learns from the rows of labels (doc_id, toxic) whose crc32 of doc_id mod 5 is not 0, at most
    about ``most`` of them. A null or empty text scores as a text without features; a null doc_id
    is not held out. Where nothing is labelled, or all alike, the score is the smoothed share of
    toxic labels. Repeated rows get repeated results; other columns are ignored.
    """
    model, weights, bias = fit(docs, labels, most)
    heads: dict[str, set[str]] = {}
    for w in (f for f, weight in weights.items() if weight > 0 and f.isalpha() and len(f) >= LEAST_SPLIT):
        for k in range(1, len(w)):
            heads.setdefault(w[:k], set()).add(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        known: set[str] = set()
        telling: dict[str, list[str]] = {}
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            out = []
            for text in batch.column("text").to_pylist():
                tokens = restorer.tokens(text) | restorer.joined(text, heads) if text else set()
                if len(known) > MEMORY:
                    known.clear()
                    telling.clear()
                for t in tokens - known:
                    restored = restorer.token(t) if " " not in t else restorer.decode(t)
                    if found := [f for f in _features(restored) if f in weights]:
                        telling[t] = found
                known |= tokens
                here = {f for t in tokens & telling.keys() for f in telling[t]}
                out.append(1 / (1 + np.exp(-(bias + sum(weights[f] for f in sorted(here))))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def restore(docs: DataFrame) -> DataFrame:
    """docs with a column ``restored``: every whole text, lowered, disguised tokens restored (null stays null)."""
    model = char_model(char_counts(docs))
    keep = [c for c in docs.columns if c != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            texts = [None if t is None else restorer.text(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "restored"])

    return docs.select(*keep).mapInArrow(run, docs.select(*keep).schema.add("restored", "string"))
