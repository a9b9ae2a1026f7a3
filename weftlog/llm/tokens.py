"""Token ids in binary shards with a minimal perfect hash index (operator 9).

A data set is a folder of shards, each a range of ascending doc_id:

``<shard>.ids``  the raw ids of its documents one after another, little-endian, two bytes each where
                 the vocabulary allows it, otherwise four; every document ends with ``end_id``.
``<shard>.idx``  a head of fixed size and then arrays of 64-bit numbers at places that the head tells:
                 the blocks of the minimal perfect hash, each 64 bits and the number of bits set
                 before them, and by slot the fingerprint, the first row and the number of rows.
                 Then the id offsets (one more than the rows).
``<shard>.key``  the keys in payload order, for reading all of them.

A key is hashed to 64 bits. At a level of the hash, keys that fall on a place alone set its bit and
the others go on to the next level; the slot of a key is the number of bits before its own. The
fingerprint in the slot tells keys that are not in the shard. Where two keys of a shard share a hash, its keys are
hashed with another salt. So an access reads the head, one block
of each level it passes (fewer than three on average), one slot, two offsets and one slice of the
payload, however large the shard is. The manifest has the first and last key of each shard, by
which lookup() sends keys to shards.

Tasks write under names of their own attempt, and the manifest, a table, names the files of the
attempts that count: a repeated or lost attempt leaves at most files that nothing reads.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.common import mix
from weftlog.plans.scratch import materialize, scratch_path

#: Letters that are surely letters to a byte-level tokenizer, and texts of nothing but these, plain ASCII marks
#: (no apostrophe, which starts contractions), digits, spaces and line feeds. The tokenizer cuts such a text before
#: a single space that stands between other characters, before a line feed and before a comma or full stop
#: that follow a letter or digit, so what lies between such cuts can be encoded once and remembered.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[\\n !-&(-~{_L}]*")
_SPACED, _LINE = re.compile(f"[{_L}]+"), re.compile(f"\\n[{_L}]+")
#: White space next to a space or line feed; a comma or full stop that follows another mark or white space.
_EDGES, _MARKS = ("  ", "\n\n", " \n", "\n "), re.compile(r"[^\w][,.]|_[,.]")
#: Pieces after which a task forgets what it remembers.
MEMORY = 1_000_000


def cuts_as_known(tokenizer: str) -> bool:
    """Whether a tokenizer file (JSON text) is one whose cuts are known here: byte-level pairs with the usual
    pattern, and nothing before, after or instead that changes texts."""
    t = json.loads(tokenizer)
    pre, model = t.get("pre_tokenizer") or {}, t.get("model") or {}
    usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges", False)
    return bool(usual and plain and not t.get("normalizer") and not t.get("truncation") and not t.get("padding"))


class Encoder:
    """Ids of texts as bytes of one integer type, with a bounded memory of pieces.

    A piece that starts with a line feed, comma or full stop stands for itself, any other for itself after a space.
    Texts are cut in pieces only for a tokenizer whose cuts are known; others encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cuts = cuts_as_known(self.tok.to_str())
        self.added = tuple(x.content for x in self.tok.get_added_tokens_decoder().values())  # each is one id wherever it stands
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        self.size = np.ones(self.tok.get_vocab_size(), np.int64)
        for token, k in self.tok.get_vocab().items():
            self.size[k] = len(token)  # one character of a byte-level token is one byte
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode pieces: words in one string, from which their ids are cut by their bytes; others alone."""
        words = [x for x in new if _SPACED.fullmatch(x)]
        strings = [" " + x for x in words]
        lines = [x for x in new if _LINE.fullmatch(x)]
        words, strings = words + lines, strings + lines
        if any(x in "".join(strings) for x in self.added):  # words that no text has side by side
            words = []
        rest = list(set(new).difference(words))
        self.known.update(zip(rest, self._whole([x if x[:1] in ("\n", ",", ".") else " " + x for x in rest]), strict=True))
        if words:
            ids = np.array(self.tok.encode_batch_fast(["".join(strings)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(x.encode()) for x in strings])) + 1
            data, at = ids.tobytes(), 0
            for w, end in zip(words, (ends * self.dtype.itemsize).tolist(), strict=True):
                self.known[w] = data[at:end]
                at = end

    def _pieces(self, text: str) -> list[str] | None:
        """The first piece, which follows no space, and the others; None if the text is not plain or has an added token."""
        if not self.cuts or any(x in text for x in _EDGES) or any(x in text for x in self.added) or not _PLAIN.fullmatch(text):
            return None
        text = text.replace("\n", " \n")
        if not _MARKS.search(text):
            text = text.replace(",", " ,").replace(".", " .")
        elif " ," in text or " ." in text or "\n," in text or "\n." in text:
            return None
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY:
            self.known.clear()
        cut = [self._pieces(x) for x in texts]
        whole = [x for x, p in zip(texts, cut, strict=True) if p is None]
        starts = [p[0] for p in cut if p is not None]
        alone = iter(self._whole(whole + starts))
        out = [next(alone) if p is None else b"" for p in cut]
        found: list[tuple[int, list, list[str], list[int]]] = []
        new: dict[str, None] = {}
        for k, p in enumerate(cut):
            if p is not None:
                ids = list(map(self.known.get, p))
                missing = [j for j, x in enumerate(ids) if x is None and j]
                new.update(dict.fromkeys([p[j] for j in missing]))
                found.append((k, ids, p, missing))
        if new:
            self._learn(list(new))
        for k, ids, p, missing in found:
            for j in missing:
                ids[j] = self.known[p[j]]
            ids[0] = next(alone)
            out[k] = b"".join(ids)
        return out


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a process: a worker keeps what it remembers from task to task."""
    return Encoder(path)


# --- minimal perfect hash ------------------------------------------------------------------------


def key_hashes(keys: list, salt: int = 0) -> np.ndarray:
    """64 bits for each key, an integer, a string or null. Integers never share them; others may, and do not with another salt."""
    number = lambda ks: mix(np.array(ks, np.int64).view(np.uint64))
    if all(type(k) is int for k in keys):
        return number(keys)
    text = lambda k: int.from_bytes(hashlib.blake2b(repr(k).encode(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return np.array([text(k) if type(k) is not int else int(number([k])[0]) for k in keys], np.uint64)


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)


#: 64-bit numbers of the head: mark, width of an id, rows, keys, levels, and up to MOST_LEVELS sizes of levels in blocks.
#: The last number of the head is what the keys' hashes are salted with.
HEAD, MOST_LEVELS, MARK = 64, 58, 0x7368617264303033
#: Bytes of texts of a shard. Ranges of doc_id are cut for that many, whatever the number of shuffle partitions; a single
#: doc_id, which stays together, may have more.
SHARD_BYTES = 64_000_000
#: Rows of a shard that a reader holds at a time.
READ_ROWS = 2_000
_ONE = np.uint64(1)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def build_index(h: np.ndarray) -> dict[str, np.ndarray]:
    """The hash of distinct 64-bit hashes: the levels' sizes in blocks, the blocks' bits and the bits before each."""
    words, levels, rest = [], [], h
    while len(rest):
        if len(levels) == MOST_LEVELS:
            raise ValueError("the hashes are not distinct")
        blocks = -(-2 * len(rest) // 64)
        place = _place(rest, len(levels), 64 * blocks)
        alone = np.bincount(place, minlength=64 * blocks) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        levels.append(blocks)
        rest = rest[~alone[place]]
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    before = np.cumsum(_ones(bits)) - _ones(bits)
    return {"levels": np.array(levels, np.int64), "bits": bits, "before": before}


def find_slots(index: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """The slot of each hash, or -1 where no level has its bit."""
    slot, start, todo = np.full(len(h), -1, np.int64), 0, np.arange(len(h))
    for level, blocks in enumerate(index["levels"].tolist()):
        word, bit = np.divmod(_place(h[todo], level, 64 * blocks), 64)
        have, bit = index["bits"][start + word], bit.astype(np.uint64)
        hit = (have >> bit) & _ONE == _ONE
        below = have[hit] & ((_ONE << bit[hit]) - _ONE)
        slot[todo[hit]] = index["before"][start + word[hit]] + _ones(below)
        todo, start = todo[~hit], start + blocks
    return slot


# --- shards --------------------------------------------------------------------------------------


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path as Spark writes it, and the path there."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def _index_bytes(h: np.ndarray, sizes: list[int], width: int, first: np.ndarray | None = None, salt: int = 0) -> bytes:
    """An index file of rows whose keys have the hashes h, rows of one key side by side; keys begin at the rows ``first``, or where the hash changes."""
    if first is None:
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    index = build_index(h[first])
    slot = find_slots(index, h[first])
    slots = np.zeros((len(first), 3), "<u8")
    slots[slot, 0], slots[slot, 1], slots[slot, 2] = h[first], first, np.diff(np.append(first, len(h)))
    head = np.zeros(HEAD, "<u8")
    head[:5] = MARK, width, len(h), len(first), len(index["levels"])
    head[5 : 5 + len(index["levels"])] = index["levels"]
    head[-1] = salt
    blocks = np.stack([index["bits"], index["before"].astype("<u8")], 1)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
    return b"".join(x.tobytes() for x in (head, blocks, slots, offsets))


def _salted(h: np.ndarray, first: np.ndarray, read_keys: Callable[[], list]) -> tuple[np.ndarray, int]:
    """Hashes of the keys that differ where keys do, and their salt: h, unless two keys share one there."""
    salt = 0
    while len(np.unique(h[first])) < len(first):
        salt += 1
        h = key_hashes(read_keys(), salt)
    return h, salt


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Encode every text of docs (doc_id and text) and write the shards; returns the manifest.

    Rows go to shards by ranges of doc_id, nulls first; rows of one doc_id stand together in one
    shard. A null or empty text has the end id alone. Other columns are ignored, and an empty
    table gives an empty manifest (shard, file, first_key, last_key, n_docs, n_tokens, start).
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, base = filesystem(path)
        encoder = end = out = keys_out = None
        hashes: list[np.ndarray] = []
        begins: list[np.ndarray] = []
        sizes: list[int] = []
        first = last = None
        for batch in batches:
            if encoder is None:
                encoder = encoder_of(tokenizer)
                end = np.array([end_id], encoder.dtype).tobytes()
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}.ids")
                keys_out = pa.ipc.new_stream(key_file := fs.open_output_stream(f"{base}/{name}.key"), pa.schema([batch.schema.field("doc_id")]))
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                for ids in encoder.encode([x or "" for x in part.column("text").to_pylist()]):
                    out.write(ids + end)
                    sizes.append(len(ids) // encoder.dtype.itemsize + 1)
            keys = batch.column("doc_id").to_pylist()
            if keys:
                first, new = (first, keys[0] != last) if hashes else (keys[0], True)
                last = keys[-1]
                begins.append(np.array([new, *(a != b for a, b in zip(keys, keys[1:], strict=False))]))
                hashes.append(key_hashes(keys))
                keys_out.write_batch(batch.select(["doc_id"]))
        if out is None:
            return
        out.close()
        keys_out.close()
        key_file.close()
        starts = np.flatnonzero(np.concatenate(begins))
        h, salt = _salted(np.concatenate(hashes), starts, lambda: pa.ipc.open_stream(fs.open_input_stream(f"{base}/{name}.key")).read_all().column("doc_id").to_pylist())
        with fs.open_output_stream(f"{base}/{name}.idx") as f:
            f.write(_index_bytes(h, sizes, encoder.dtype.itemsize, starts, salt))
        key_type = batch.schema.field("doc_id").type
        row = [pa.array([task.partitionId()], pa.int64()), [f"{path}/{name}"], pa.array([first], key_type), pa.array([last], key_type), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())]
        yield pa.record_batch(row, ["shard", "file", "first_key", "last_key", "n_docs", "n_tokens"])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-size // SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    manifest = materialize(ranged.mapInArrow(write, f"shard long, file string, first_key {kind}, last_key {kind}, n_docs long, n_tokens long"), "token-manifest", keep=True)
    # one row a shard: a running sum over a few rows
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """An open shard. Only the head of the index is held; an access reads what it needs by place."""

    def __init__(self, file: str) -> None:
        self.fs, base = filesystem(file)
        self.base, self.idx, self.ids = base, self.fs.open_input_file(f"{base}.idx"), self.fs.open_input_file(f"{base}.ids")
        head = self._numbers(0, HEAD)
        if head[0] != MARK:
            raise ValueError(f"{file}: not a shard's index")
        self.width, self.rows, self.keys = (int(x) for x in head[1:4])
        self.levels = head[5 : 5 + int(head[4])].astype(np.int64).tolist()
        self.salt = int(head[-1])
        self.slots_at = HEAD + 2 * sum(self.levels)
        self.offsets_at = self.slots_at + 3 * self.keys

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.idx.close()
        self.ids.close()

    def _numbers(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.idx.read_at(8 * n, 8 * at), "<u8")

    def find(self, key) -> tuple[int, int] | None:
        """The first row of a key and how many it has, or None."""
        h = key_hashes([key], self.salt)
        start = 0
        for level, blocks in enumerate(self.levels):
            word, bit = divmod(int(_place(h, level, 64 * blocks)[0]), 64)
            bits, before = self._numbers(HEAD + 2 * (start + word), 2).tolist()
            if bits >> bit & 1:
                slot = before + (bits & ((1 << bit) - 1)).bit_count()
                fingerprint, row, n = self._numbers(self.slots_at + 3 * slot, 3).tolist()
                return (row, n) if fingerprint == int(h[0]) else None
            start += blocks
        return None

    def ids_of(self, row: int, n: int = 1) -> list[np.ndarray]:
        """The ids of n rows from one on."""
        at = self._numbers(self.offsets_at + row, n + 1).astype(np.int64)
        data = np.frombuffer(self.ids.read_at(int(at[-1] - at[0]) * self.width, int(at[0]) * self.width), f"<u{self.width}")
        return np.split(data, at[1:-1] - at[0])

    def rows_at(self, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of some rows and where they start; rows side by side are read at once."""
        ids: list[np.ndarray] = []
        at: list[np.ndarray] = []
        for run in np.split(rows, np.flatnonzero(np.diff(rows) != 1) + 1):
            if len(run):
                ids += self.ids_of(int(run[0]), len(run))
                at.append(self._numbers(self.offsets_at + int(run[0]), len(run)).astype(np.int64))
        return ids, np.concatenate(at) if at else np.zeros(0, np.int64)

    def whole(self) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The hash and the slots, for reading all of a shard."""
        blocks = self._numbers(HEAD, 2 * sum(self.levels)).reshape(-1, 2)
        index = {"levels": np.array(self.levels, np.int64), "bits": blocks[:, 0], "before": blocks[:, 1].astype(np.int64)}
        return index, self._numbers(self.slots_at, 3 * self.keys).reshape(-1, 3)


def get(file: str, key) -> np.ndarray | None:
    """The ids of a key's first row in constant time, or None if the shard does not have it."""
    with Shard(file) as shard:
        found = shard.find(key)
        return None if found is None else shard.ids_of(found[0])[0]


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids): the ids of every row of the documents named in keys (doc_id); unknown keys give no rows.

    A key's shard is found by bisection over the shards' first keys, which the driver reads from the manifest, a
    row for each shard. Each shard's keys are read in a task. Repeated keys count once; a null key finds the
    rows without a doc_id; empty tables give no rows.
    """
    kind = keys.schema["doc_id"].dataType.simpleString()
    shards = [(r["file"], r["first_key"]) for r in manifest.select("shard", "file", "first_key").orderBy("shard").collect()]
    empty = [file for file, first in shards if first is None]
    firsts = [first for _, first in shards if first is not None]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            at = [-1 if k is None else bisect_right(firsts, k) + len(empty) - 1 for k in ids]
            files = [(empty[0] if empty else None) if k is None else shards[n][0] if n >= 0 else None for k, n in zip(ids, at, strict=True)]
            yield pa.record_batch([pa.array(files, pa.string()), batch.column("doc_id")], ["file", "doc_id"])

    routed = keys.select("doc_id").distinct().mapInArrow(route, f"file string, doc_id {kind}").where("file is not null")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, Shard] | None = None
        for batch in batches:
            found, ids = [], []
            for k, (file, key) in enumerate(zip(batch.column("file").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                if held is None or held[0] != file:
                    held = (file, Shard(file))
                if at := held[1].find(key):
                    for x in held[1].ids_of(*at):
                        found.append(k)
                        ids.append(x.astype(np.int64))
            yield pa.record_batch([batch.column("doc_id").take(pa.array(found, pa.int64())), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return routed.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(read, f"doc_id {kind}, ids array<bigint>")


def read_digests(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, each found through its shard's index.

    An empty manifest gives no rows; a null doc_id is read like any other.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with Shard(file) as shard:
                    index, slots = shard.whole()
                    before, done, rows_left = None, 0, 0
                    for part in (p.slice(k, READ_ROWS) for p in pa.ipc.open_stream(shard.fs.open_input_stream(f"{shard.base}.key")) for k in range(0, p.num_rows, READ_ROWS)):
                        h = key_hashes(part.column("doc_id").to_pylist(), shard.salt)
                        slot = find_slots(index, h)
                        if (slot < 0).any() or (slots[slot, 0] != h).any():
                            raise ValueError(f"{file}: a key is not in the index")
                        # rows of one key follow its first; a key may go on from the part before
                        same = np.concatenate(([len(h) > 0 and before == h[0]], h[1:] == h[:-1])) if len(h) else np.zeros(0, bool)
                        at = np.arange(len(h))
                        run = at - np.maximum.accumulate(np.where(same, -1, at)) if len(h) else at
                        lead = np.cumprod(same).astype(bool) if len(h) else same  # still the key of the part before
                        run = np.where(lead, at + rows_left, run)
                        rows = slots[slot, 1].astype(np.int64) + run
                        ids, lo = shard.rows_at(rows)
                        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                        if len(h):
                            before, rows_left = h[-1], int(run[-1]) + 1
                        done += len(h)
                        sizes = pa.array([len(x) for x in ids], pa.int64())
                        yield pa.record_batch([part.column("doc_id"), pa.array(lo + base, pa.int64()), sizes, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    if done != shard.rows:
                        raise ValueError(f"{file}: {done} keys for {shard.rows} rows")

    shards = manifest.select("shard", "file", "start")
    # a few shards a task: there may be many, or fewer than cores
    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count() // 8)
    return shards.repartition(n, "shard").mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs as token shards and return the digests read back from the files; see write_shards() for nulls and empty tables."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_digests(write_shards(docs, tokenizer, end_id), kind)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
