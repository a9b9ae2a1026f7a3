"""Bounds that follow from the data: broadcasts by their numbers, shards by their bytes, equal rows once."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from conftest import rows
from test_operators import docs, lower, words

from weftlog.llm import decontaminate, tokens


def contaminated(text, items):
    w = decontaminate_words(text)
    hit = set()
    for item in items:
        i = decontaminate_words(item)
        n = min(13, len(i))
        windows = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if i else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
    return len(w), len(hit)


def decontaminate_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


@pytest.mark.parametrize("broadcast", [0, 2_000_000])
def test_decontamination_of_equal_rows_and_of_the_whole_benchmark(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_NUMBERS", broadcast)
    rng = random.Random(31)
    items = [words(rng, n, 300) for n in (5, 13, 40, 400)]
    whole = " . ".join([items[3], words(rng, 30, 9000), *items[:3]])
    texts = [(1, whole), *[(2, f"{words(rng, 50, 9000)} {items[2]}")] * 40, *[(None, items[1])] * 30, (None, "clean words"), (2, "another text of this id"), (3, None)]
    benchmark = spark.createDataFrame(list(enumerate([*items, None, ""])), "item_id long, text string")
    got = rows(decontaminate.contamination(docs(spark, texts), benchmark).select("doc_id", "n_words", "n_hit").na.fill(-1))
    assert got == sorted((-1 if k is None else k, *contaminated(t, items)) for k, t in texts)
    assert max(r[2] for r in got) > 400


def test_shards_follow_the_size_of_texts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(tokens, "READ_ROWS", 3)
    rng = random.Random(32)
    texts = [(k, words(rng, 40)) for k in range(200)] + [(None, "no id")] * 7 + [(50, "again"), (50, "and again")]
    manifest = tokens.write_shards(docs(spark, texts), tokens.tokenizer_path(), 2)
    shards = manifest.collect()
    assert len(shards) > 12 and sum(s.n_docs for s in shards) == len(texts)
    got = tokens.read_digests(manifest).collect()
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(tokens.tokenizer_path()), 0
    want = []
    for k, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_keys_that_share_a_hash_get_another_salt(spark, monkeypatch):
    """Without salt all strings but one share their hash with another."""
    plain = tokens.key_hashes
    monkeypatch.setattr(tokens, "key_hashes", lambda keys, salt=0: plain(keys, salt) % np.uint64(5) if salt < 2 else plain(keys, salt))
    keys = [f"k{k:02d}" for k in range(40)]
    h, salt = tokens._salted(tokens.key_hashes(keys), np.arange(40), lambda: keys)
    assert salt == 2 and len(set(h.tolist())) == 40
    index = tokens.build_index(h)
    assert sorted(tokens.find_slots(index, h).tolist()) == list(range(40))
    assert plain(keys, 1).tolist() != plain(keys, 2).tolist() and plain([1, 2], 1).tolist() == plain([1, 2]).tolist()


def test_stores():
    import pyarrow.fs

    assert tokens.filesystem("file:///tmp/x")[1] == "/tmp/x"
    fs, path = tokens.filesystem("s3a://bucket/folder?region=us-east-1")
    assert isinstance(fs, pyarrow.fs.S3FileSystem) and path == "bucket/folder"
