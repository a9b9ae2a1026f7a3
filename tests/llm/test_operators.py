"""Each operator against brute force on small fixtures with nulls, empty and repeated rows, and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlog.llm import chat, decontaminate, embeddings, html, langid, licenses, minhash, mixing, tokens, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string"


def lower(s):
    return (s or "").translate({k: k + 32 for k in range(65, 91)})


def docs(spark, texts, lang=None, source=None):
    """Rows with columns that clash with results."""
    return spark.createDataFrame([(k, t, lang[k] if lang else None, source[k] if source else None, 0, "x", "y") for k, t in texts], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGES = [None, "", " \n\t", "one", "Ünï Cödé É", "a, b. c!"]


def test_minhash(spark):
    rng = random.Random(1)
    base = [words(rng, 60, 5000) for _ in range(12)]
    near = [" ".join([*b.split()[:-1], "changed"]) for b in base]
    far = [" ".join([*b.split()[:30], *words(rng, 30, 5000).split()]) for b in base]
    texts = list(enumerate([*EDGES, *base, *near, *far, base[0].upper(), "one", *[base[1]] * 40]))
    texts += [(0, None), (3, "one")]
    got = rows(minhash.near_duplicates(docs(spark, texts)))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [(k, shingles(t)) for k, t in texts]
    up = {k: k for k, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert got == sorted((k, len(s), root(k), root(k) == k) for k, s in sets)
    assert minhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(1, words(rng, 30)), (2, "Short item, here"), (10, words(rng, 13)), (3, None), (4, "..."), (None, words(rng, 20)), (2, "Short item, here"), (5, "the the the the the the the the the the the the the the")]
    w1 = items[0][1].split()
    texts = [*EDGES, " ".join(["x", *w1[3:17], "y"]), " ".join(w1[:12]), "a SHORT item -- here b", words(rng, 200) + " " + items[2][1] + " " + words(rng, 400), "the " * 40, items[0][1] + "; " + items[0][1]]
    data = [*enumerate(texts), (6, "nothing here"), (None, items[2][1])]
    got = sorted((repr(r[0]), *r[1:]) for r in decontaminate.contamination(docs(spark, data), spark.createDataFrame(items, "item_id long, text string")).drop("items").collect())
    want = []
    for k, t in data:
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for item, text in items:
            v = WORD.findall(lower(text))
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if v and item is not None else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item))
        want.append((repr(k), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert got == sorted(want)
    near = decontaminate.proximity(docs(spark, [(1, " ".join([*w1[:6], "odd", *w1[6:14]])), (2, "no")]), spark.createDataFrame(items[:1], "item_id long, text string"))
    assert rows(near) == [(1, "1")]
    assert decontaminate.contamination(docs(spark, data).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_mixing(spark):
    rng = random.Random(3)
    source = {k: rng.choice(["b", "a", "c", None, "hot", "hot", "hot"]) for k in range(400)}
    data = [*((k, words(rng, rng.randrange(1, 60))) for k in range(394)), *((394 + k, t) for k, t in enumerate(EDGES)), (7, "again again")]
    d = docs(spark, data, source=source)
    got = mixing.digests(d)
    taken = {}
    for r in got.collect():
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 2 * r.size
        s = source[r.doc_id]
        taken[s] = (r.source_size, r.target, taken.get(s, (0, 0, 0))[2] + r.taken)
    names = sorted((s for s in taken if s is not None)) + [None]
    size = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in data if source[k] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in names:
        target = 2.0 * size[s] if s in full else level * weight[s]
        assert taken[s][0] == size[s] and taken[s][1] == pytest.approx(target)
        assert abs(taken[s][2] - target) <= 30
    assert rows(got) == rows(mixing.digests(d))
    mix = mixing.mix(d, shards=8)
    assert mix.columns == [*d.columns, "mix_shard"] and mix.count() == sum(len(r.mix_shards) for r in mixing.placed(d).select("mix_shards").collect())
    assert mixing.digests(d.limit(0)).count() == 0


def test_splitting_tree():
    quotas = [100, 3, 0, 57]
    source, shard, n = mixing.split_quotas(quotas, 16)
    assert np.bincount(source, n, 4).tolist() == quotas and np.bincount(shard, n).tolist() == [10] * 16 and n.min() > 0
    again, other = mixing.split_quotas(quotas, 16), mixing.split_quotas(quotas, 16, seed=1)
    assert np.array_equal(n, again[2]) and not (len(n) == len(other[2]) and np.array_equal(n, other[2]))
    assert [len(x) for x in mixing.split_quotas([0], 4)] == [len(x) for x in mixing.split_quotas([], 4)] == [0, 0, 0]


def test_blocks_that_fit_come_after_one_that_does_not(spark):
    sized = spark.createDataFrame([("s", 0, 400), *(("s", k, 50) for k in range(1, 13))], "key string, block int, words long")
    wanted = spark.createDataFrame([("s", 1000, 300.0)], "key string, source_size long, target double")
    for seed in range(6):  # wherever the large block comes in the order
        r = mixing.choose_blocks(sized, wanted, seed).where("extra").collect()
        assert sorted(x.block for x in r) == sorted({x.block for x in r}) and len(r) == 6 and 0 not in {x.block for x in r}


def test_full_sources_take_no_empty_block_again(spark):
    sized = spark.createDataFrame([("s", 0, 0), ("s", 1, 10)], "key string, block int, words long")
    got = mixing.choose_blocks(sized, spark.createDataFrame([("s", 10, 20.0)], "key string, source_size long, target double")).collect()
    assert {(r.block, r.passes, r.extra) for r in got} == {(0, 2, False), (1, 2, False)}


def test_shards_and_blocks_follow_the_sizes(spark):
    assert [mixing._within(x, 2048, 65536) for x in (0, 2048, 2049, 5e4, 1e9)] == [2048, 2048, 4096, 65536, 65536]
    d = docs(spark, [(k, "w " * 500) for k in range(300)], source=dict.fromkeys(range(300), "s"))
    whole = mixing.mix(d, shards=5)
    assert whole.rdd.getNumPartitions() == 5
    at = whole.selectExpr("spark_partition_id() as p", "mix_shard").distinct().collect()
    assert sorted((r.p, r.mix_shard) for r in at) == [(k, k) for k in range(5)]
    assert mixing.mix(d).rdd.getNumPartitions() == 1


def test_tokens(spark):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = [*EDGES, "Hello, world. It's a\nnew line.\n\nTwo  spaces", "x.\n,y a .b ***. $$$", "word " * 5000, "naïve Éa", "\ta", " a", "a ", "1,2.3 a_.b", " x 　y 你好"]
    data = [*enumerate(texts), (2, "again"), (None, "no id")]
    manifest = tokens.write_shards(docs(spark, data), path, 2)
    got = sorted(tokens.read_digests(manifest).collect(), key=lambda r: r.start)
    want, start = [], 0
    for k, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    files = [r.file for r in manifest.collect()]
    found = [x for x in (tokens.get(f, 6) for f in files) if x is not None]
    assert len(found) == 1 and found[0].tolist() == [*plain.encode(texts[6], add_special_tokens=False).ids, 2]
    assert all(tokens.get(f, 10**9) is None for f in files)
    shards = manifest.orderBy("shard").collect()
    assert shards[0].first_key is None and all(a.last_key < b.first_key for a, b in zip(shards, shards[1:], strict=False))
    asked = spark.createDataFrame([(k,) for k in (6, 2, 2, None, 10**9, -5, len(texts) - 1)], "doc_id long")
    got = sorted((repr(r.doc_id), r.ids) for r in tokens.lookup(manifest, asked).collect())
    assert got == sorted((repr(k), [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in data if k in (6, 2, None, len(texts) - 1))
    assert tokens.token_digests(docs(spark, data).limit(0), path, 2).count() == 0
    assert tokens.lookup(tokens.write_shards(docs(spark, data).limit(0), path, 2), asked).count() == 0


def test_string_keys(spark):
    path = tokens.tokenizer_path()
    d = spark.createDataFrame([(f"k{k:03d}", f"text {k}") for k in range(300)] + [("k007", "more")], "doc_id string, text string").repartition(4)
    manifest = tokens.write_shards(d, path, 2)
    got = tokens.read_digests(manifest, "string").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([f"k{k:03d}" for k in range(300)] + ["k007"])
    asked = spark.createDataFrame([("k007",), ("k299",), ("k3",)], "doc_id string")
    assert sorted(r.doc_id for r in tokens.lookup(manifest, asked).collect()) == ["k007", "k007", "k299"]


def test_rows_of_one_key_beyond_a_batch(spark):
    d = spark.range(45_000).selectExpr("7L as doc_id", "cast(id % 3 as string) as text").coalesce(1)
    got = sorted(r.start for r in tokens.read_digests(tokens.write_shards(d, tokens.tokenizer_path(), 2)).collect())
    assert got == list(range(0, 90_000, 2))


def test_index_reads_do_not_grow_with_the_shard(tmp_path):
    reads = {}
    for n in (1_000, 64_000):
        h = tokens.key_hashes(list(range(n)))
        (tmp_path / f"{n}.idx").write_bytes(tokens._index_bytes(h, [3] * n, 2))
        (tmp_path / f"{n}.ids").write_bytes(np.repeat(np.arange(n, dtype="<u2"), 3).tobytes())
        with tokens.Shard(f"file://{tmp_path}/{n}") as shard:
            taken, plain = [], shard._numbers
            shard._numbers = lambda at, m, taken=taken, plain=plain: taken.append(m) or plain(at, m)
            for k in range(0, n, n // 500):
                assert shard.ids_of(*shard.find(k))[0].tolist() == [k] * 3
            assert shard.find(n) is None and shard.find("x") is None and shard.find(None) is None
        reads[n] = sum(taken) / 500
    assert reads[64_000] < 1.2 * reads[1_000] < 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab ,.\n'9é_-\t", max_size=60), st.lists(st.sampled_from(["the", "word", "it's", ",", ".", " ", "\n", "12", "naïve", "<|endoftext|>"]), max_size=20).map(" ".join)), max_size=6))
def test_remembered_pieces_give_what_the_library_gives(texts):
    path = tokens.tokenizer_path()
    encoder = tokens.encoder_of(path)
    assert encoder.cuts
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
    assert got == [encoder.tok.encode(x, add_special_tokens=False).ids for x in texts]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    def with_model(pre, **kw):
        t = Tokenizer(models.BPE(vocab={"a": 0, "Ġ": 1, "b": 2, "aĠ": 3}, merges=[("a", "Ġ")], **kw))
        t.pre_tokenizer = pre
        return t

    for k, t in enumerate((with_model(pre_tokenizers.ByteLevel(add_prefix_space=True)), with_model(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)), with_model(pre_tokenizers.ByteLevel(add_prefix_space=False), dropout=0.5))):
        t.save(str(tmp_path / f"{k}.json"))
        assert not tokens.Encoder(str(tmp_path / f"{k}.json")).cuts
    one = tokens.Encoder(str(tmp_path / "1.json"))
    assert np.frombuffer(one.encode(["a b a"])[0], one.dtype).tolist() == one.tok.encode("a b a", add_special_tokens=False).ids


def test_perfect_hash():
    h = tokens.key_hashes(list(range(20_000)))
    index = tokens.build_index(h)
    slots = tokens.find_slots(index, h)
    assert sorted(slots.tolist()) == list(range(20_000))
    assert len(tokens.build_index(h[:0])["bits"]) == 0 and tokens.find_slots(tokens.build_index(h[:0]), h[:2]).tolist() == [-1, -1]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x[1], x[2] = x[0] * 3, x[0] + rng.normal(size=8) * 0.05
    x[10:30] = x[5] + rng.normal(size=(20, 8)) * 0.2
    vectors = [*x.tolist(), None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, x[0].tolist(), [1.0, 2.0]]
    data = [(k, v, None if k == 65 else int(k % 7 == 6), "clash") for k, v in enumerate(vectors)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, n_links string")
    links = {k: set() for k, *_ in data}
    ok = {k: np.array(v) for k, v, lab, _ in data if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    for i, a in ok.items():
        for j, b in ok.items():
            if i != j and data[i][2] == data[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i].add(j)
    root = {k: k for k in links}
    for _ in links:
        root = {k: min([root[k], *(root[j] for j in links[k])]) for k in links}
    want = sorted((k, len(links[k]), root[k], root[k] == k) for k in links)
    assert rows(embeddings.near_duplicates(table)) == want
    assert rows(embeddings.near_duplicates(table, block=7)) == want
    named = table.withColumn("vec_id", F.format_string("v%03d", "vec_id"))
    assert rows(embeddings.near_duplicates(named, block=9)) == [(f"v{k:03d}", n, f"v{c:03d}", kept) for k, n, c, kept in want]
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_clustered_vectors(spark):
    """Several pivots, replicated copies and skipped block pairs give what all pairs give."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(25, 12))
    x = np.repeat(centres, 24, axis=0) + rng.normal(size=(600, 12)) * 0.1
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert len(embeddings.choose_pivots(u[rng.permutation(600)], math.sqrt(2 - 2 * 0.93))) > 1
    near = (u @ u.T >= 0.93) & ~np.eye(600, dtype=bool)
    root = np.arange(600)
    for _ in range(600):
        root = np.minimum(root, np.where(near, root[None, :], 600).min(1))
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").withColumn("label", F.lit("l"))
    want = sorted((k, int(near[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(600))
    assert rows(embeddings.near_duplicates(table, block=16)) == want


def test_pivots_replicate_what_a_cell_needs():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 16)), 20, axis=0) + rng.normal(size=(600, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = embeddings.choose_pivots(x[rng.permutation(600)[:300]], 0.37)
    assert len(pivots) > 1
    home, inside = embeddings._cells(x, pivots, 0.37)
    near = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) <= 0.37
    assert all(inside[j, home[i]] for i, j in zip(*np.nonzero(near), strict=True))


def test_licenses(spark):
    texts = [*EDGES, "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 and cc/by", "GNU General Public License, version 3. All rights reserved", "general public license " * 50, "a rule of mit", "MIT License MIT License", "SPDX-License-Identifier: MPL 2.0"]
    data = [*enumerate(texts), (6, "all rights reserved"), (None, "cc by")]
    got = {(r.doc_id, r.n_words, r.n_base): r for r in licenses.scan(docs(spark, data)).collect()}
    assert len(got) == len(data)
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for k, t in data:
        w = WORD.findall(lower(t))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[k, len(w), len(at)]
        assert (r.first_word, r.last_word) == (min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[6, 8, 0].labels == "apache-2.0" and got[12, 6, 0].labels == "mpl-2.0" and got[10, 4, 0].labels == ""
    assert got[7, 8, 2].labels == "cc-by,cc-by-nc-4.0" and got[8, 9, 2].labels == "gpl,gpl-3.0,reserved"
    assert [tuple(s) for s in got[11, 4, 0].spans] == [(0, 2, "mit"), (2, 4, "mit")]
    assert len(licenses.rules()) > 300


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>H</header><nav><ul><li><a href="/">menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
    <article><h1>T &amp;  <b>x</b></h1><p>One&nbsp;two<br>three<p>Four<script>var t="</p>"</script></p><form>f</form><aside>s</aside><div id="comments"><p>reader</p></div><ul><li>i<li>j</ul></article><footer>F</footer></body></html>"""
    cases = [(1, page), (2, None), (3, ""), (4, "plain"), (5, "<p>" + "long text " * 20 + "</p><ul><li><a href=x>menu</a></ul>"), (6, "<article><p>a < b & c"), (1, page), (7, '<p title="x>y</p>')]
    table = spark.createDataFrame([(k, "u", h, "clash") for k, h in cases], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(table).collect()}
    assert got[1][0] == "T & x\n\nOne two three\n\nFour\n\ni\n\nj"
    assert got[2] == got[3] == ("", 0) and got[4] == ("plain", 5) and got[5][0] == ("long text " * 20).strip() and got[6][0] == "a < b & c"
    assert html.extract(table).count() == len(cases) and html.extract(table.limit(0)).count() == 0


def test_html_surges_by_weight():
    """The distribution decides on pages with an article too, and short or link-rich lines beside main text stay."""
    long, links = "long text " * 30, '<ul><li><a href="/a">one</a><li><a href="/b">two</a><li><a href="/c">three</a><li><a href="/d">four</a></ul>'
    assert html.main_text(f"<article>Teaser.</article><div><p>{long}</p></div>") == long.strip()  # a teaser is not the page's text
    assert html.main_text(f"<p>Trail.</p><article><p>{long}</p></article><p>Elsewhere.</p><article>Hi</article>") == f"{long.strip()}\n\nHi"
    assert html.main_text(f"<article><p>{long}</p></article>", surge=10**6) == long.strip()
    kept = html.main_text(f"{links}<div><p>{long}</p>{links}<p>The end.</p><p><a href=x>Source of it</a></p></div>{links}")
    assert kept == "\n\n".join([long.strip(), "one", "two", "three", "four", "The end.", "Source of it"])
    assert html.main_text(f"<p>{long}</p>{links}<p>The end.</p>{links}") == f"{long.strip()}\n\nThe end."


def test_html_parts_count_only_beside_the_text():
    """A name of layout drops no container that the page's text is in; comments, adverts and notices go wherever they are."""
    text = "Main text of some length that goes on. " * 5
    main, p = text.strip(), f"<p>{text}</p>"
    cases = {
        f'<body><div class="page has-sidebar"><article><h1>Head</h1>{p}</article><div class="sidebar"><p>side</p></div></div></body>': f"Head\n\n{main}",
        f'<body><div class="page-sidebar-left"><article>{p}</article><div class="sidebar"><p>side</p></div></div></body>': main,
        f'<article><div class="article-header"><h1>Headline</h1></div>{p}</article>': f"Headline\n\n{main}",
        f"<body><div><p>We use cookies to improve your experience on this site.</p></div><article><h1>T</h1>{p}</article></body>": f"T\n\n{main}",
        f'<body class="menu-open"><div id="main-menu-wrapper" class="with-footer"><main>{p}</main></div></body>': main,
        f'<div class="nav"><a href=x>a</a></div><div class="content social-wrap"><h1>Head</h1>{p}<p>Short.</p></div><div class="footer">Words</div>': f"Head\n\n{main}\n\nShort.",
        f'<div class="post share">{p}</div><div class="share">Share this</div>': main,
        f"<form id=page><div>{p}{p}</div><div class=ad>{text}</div></form>": f"{main}\n\n{main}",
        f'<article><p>short</p><div class="ad">{text}</div><div class="ad-slot">{text}</div></article>': "short",
        f'<article>{p}</article><section id="comments"><article>{p * 5}</article><article class="comment-body">{p * 5}</article></section>': main,
        f'<div class="content">{p}</div><div class="comment-list"><p>{text * 4}</p></div>': main,
        f'<article>{p}<p hidden>gone</p><div style="display: none">gone</div></article>': main,
    }
    assert {page: html.main_text(page) for page in cases} == cases


def test_html_window_decides():
    """Short lines that surge together stay; without a window only a long one does."""
    run, notice = [f"Line {k} of a text in pieces that go on." for k in range(6)], "One long line by itself that is no more than a remark at the end of the page, some way from the rest."
    gap = '<ul><li><a href="/">one link</a></li><li><a href="/">two links</a></li><li><a href="/">three</a></li></ul>'
    page = "".join(f"<div>{x}</div>" for x in run) + gap + f"<div>{notice}</div>"
    assert html.main_text(page) == "\n\n".join([*run, notice])
    assert html.main_text(page, window=1) == notice


def test_langid(spark):
    rng = random.Random(6)
    sounds = {"xx": ["ka", "to", "mi"], "yy": ["str", "ent", "ung"], "zz": ["é", "ção", "lho"]}
    lang = {k: rng.choice(sorted(sounds)) for k in range(240)}
    data = [(k, " ".join("".join(rng.choice(sounds[lang[k]]) for _ in range(3)) for _ in range(rng.randrange(5, 40)))) for k in range(240)]
    more = [(300, None), (301, ""), (302, "12 34!"), (None, data[0][1])]
    got = langid.predict(docs(spark, [*data, *more], lang=lang | dict.fromkeys((300, 301, 302, None)))).collect()
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(held) > 40 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (300, 301, 302)) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.predict(docs(spark, data)).collect()} == {"und"}  # nothing to learn from


def test_toxicity(spark):
    rng = random.Random(7)
    bad = ["idiot", "moron", "scum"]
    data, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = words(rng, 30, 90).replace("w", "word ").split()
        if toxic:
            text[5:5] = rng.sample(bad, 2)
        data.append((k, " ".join(t for t in text if not t.isdigit()) + " plain clean words here"))
        labels.append((k, int(toxic), "clash"))
    extra = [(900, None), (901, ""), (902, "you 1D10T and $cum"), (903, "an i d i o t and a moooron"), (905, "you mo ron. and an id iot"), (906, "plain words, a sccum and an idiiot"), (907, "mo words ron and id words iot"), (904, "clean words"), (0, "other text"), (None, "idiot moron")]
    d = docs(spark, [*data, *extra])
    table = spark.createDataFrame([*labels, (None, 1, ""), (5000, 1, ""), (1, None, "")], "doc_id long, toxic int, text string")
    got = toxicity.score(d, table).collect()
    assert len(got) == len(data) + len(extra)
    held = [r for r in got if r.held_out and r.doc_id is not None and 0 < r.doc_id < 400]
    assert len(held) > 50 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    one = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 900}
    assert [one[k].predicted for k in range(900, 908)] == [0, 0, 1, 1, 0, 1, 1, 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = toxicity.score(d, table.limit(0)).collect()
    assert len(none) == len(got) and len({r.score for r in none}) == 1
    r = {x.doc_id: x.restored for x in toxicity.restore(d.where("doc_id in (902, 903, 900)")).collect()}
    assert r[900] is None and "scum" in toxicity.Restorer(toxicity.char_model(toxicity.char_counts(d))).token("$cum")


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "and?"), (1, 3, "assistant", "no"), (2, 0, "user", "x"), (2, 1, "assistant", "other"), (4, 0, None, None), (4, 0, None, None), (None, 0, "user", "lost")]
    table = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.conv_id: r for r in chat.preference_rows(chat.next_answer_pairs(table)).collect()}
    r = got[1]
    assert r.n_prompt_turns == 3 and r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nand?<|end|>\n"
    assert (r.chosen, r.rejected) == ("<|assistant|>\nno<|end|>\n", "<|assistant|>\nother<|end|>\n")
    lo, hi = map(int, r.chosen_spans.split("-"))
    assert r.chosen[lo:hi] == "no<|end|>"
    assert (got[2].chosen, got[2].rejected, got[2].n_prompt_turns) == ("<|assistant|>\nother<|end|>\n", "", 1)
    assert (got[4].n_prompt_turns, got[4].chosen, got[4].rejected) == (2, "", "") and set(got) == {1, 2, 4}
    assert chat.preference_rows(chat.next_answer_pairs(table.limit(0))).count() == 0
