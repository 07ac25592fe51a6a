"""Brute-force, round-trip and held-out checks of the training-data operators, on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievewright.llm import ann, chat, html, lm, media, mixing, packing, quality, queries, simhash, warc
from sievewright.llm.components import connected_components

DOC = "doc_id long, text string, source string, size long, row_hash string, n string, class int"


def odd_docs():
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rng = random.Random(3)
    words = ["ab", "Cd", "efg", "é", "the", "of", "x1", "!!"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, twin = text(6000), text(40)
    rows = [(1, None, "a"), (2, "", "a"), (3, long, "b"), (4, long, "b"), (5, twin, None), (5, twin, None), (None, text(12), "c"), (7, "one", "c"), (8, "one\ttwo\x0b", ""), (9, " \n ", "b")]
    rows += [(10 + i, text(rng.randint(1, 60)), rng.choice("abc")) for i in range(60)]
    rows += [(100 + i, twin + f" w{i}", "a") for i in range(12)]
    return [(d, t, s, 1, "x", "y", 2) for d, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), DOC)


def words_of(text):
    return (text or "").encode().lower().split()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Packing


def test_pack(spark, docs):
    path = queries.vocabulary_path()
    from public_tokenizers import path as file
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(file("byte_bpe_50k.json"))
    special = [(500, "a <|endoftext|> b", None), (501, "<|endoftext|><|endoftext|>  x", None), (502, " <|endoftext| >\n\n<|endoftext|>", None), (503, "<|endoftext|>é 日本語\u2009 12345's", None)]
    docs = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame(special, "doc_id long, text string, n string"))
    out = [r.asDict() for r in packing.pack(docs, path).collect()]
    want = sorted(((-1 if d is None else d), tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t, *_ in odd_docs() + special)
    by = defaultdict(list)
    for r in out:
        by[-1 if r["doc_id"] is None else r["doc_id"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    got = []
    for d, rows in by.items():
        rows.sort(key=lambda r: (r["start"], r["sequence_id"]))
        copies = sum(r["start"] == 0 for r in rows)
        ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in rows]
        assert all(len(x) == r["length"] for x, r in zip(ids, rows))
        for c in range(copies):  # repeated rows are cut alike
            whole = [i for k, x in enumerate(ids) if k % copies == c for i in x]
            assert len(whole) == rows[0]["doc_tokens"]
            got.append((d, tuple(whole)))
    assert sorted(got) == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    tokens = sum(n for s in seqs.values() for _, n in s)
    assert 1024 * len(seqs) - tokens < 0.1 * tokens + 1024
    assert packing.pack(docs.limit(0), path).count() == 0


def test_cut():
    for n in range(1, 3000):
        pieces = packing.cut(n, 1024, 64)
        assert sum(x for x, _ in pieces) == n and len(pieces) <= n // 1024 + 5
        for x, k in pieces:
            assert 0 < x <= 1024 // k and k == 1024 // x


def test_ids_equal_the_other_library():
    from tokenizers import Tokenizer

    tok, enc, rng = Tokenizer.from_file(queries.vocabulary_path()), packing.encoding(queries.vocabulary_path()), random.Random(11)
    parts = ["<|endoftext|>", " ", "\n", "\t", "the", " the", "'s", "é", "日本", "\U0001f600", "12", "...", "<|", "|>", "\u00a0", "\r\n", "A", "ß", "\u0301"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert enc.encode(text, allowed_special="all") == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "one two three", "word " * 90, None])
def test_short_documents_pad_little(spark, text):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit(text).cast("string").alias("text"))
    out = packing.pack(docs, queries.vocabulary_path(), with_ids=False).agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("tokens"), F.count("*").alias("pieces")).first()
    assert 1024 * (out.n - 1) <= 1.05 * out.tokens and out.pieces <= 4 * 12_000


def test_text_that_is_not_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61ff20c3') as string) as text, 's' as source")
    assert packing.pack(docs, queries.vocabulary_path()).first().doc_tokens > 2
    assert lm.score_corpus(docs).first().n_tokens == 3 and simhash.near_duplicates(docs).count() == 1
    assert media.store_and_read(docs).first().n_bytes == 4
    nothing = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score_documents(docs, nothing).first().score == 0.5 and quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 1
    assert mixing.plan_mix(docs).first()["size"] == 2
    assert html.extract_pages(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>Some long text of the page, with a sentence. "), "text").alias("html"))).first().text != ""
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert warc.round_trip(pages).first().payload_bytes == 4


# Mixing


def word_count(text):
    return len(words_of(text))


def brute_targets(sizes):
    """Shares the excess of stopped sources again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [(5, 2, 1)[i % 3] for i in range(len(order))]))
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not stop:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in stop:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= stop
    return target


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_mix(spark, docs, small, which):
    table = docs if which == "odd" else spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.plan_mix(table).collect()
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += word_count(t)
    target = brute_targets(sizes)
    source = {d: s for d, _, s in rows}
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((d or -1, word_count(t)) for d, t, _ in rows)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] += r.taken
    for s in sizes:
        smallest = min(word_count(t) for _, t, x in rows if x == s and word_count(t))
        assert abs(taken[s] - target[s]) <= max(0.03 * target[s], 2 * smallest, 60), (s, taken[s], target[s])
    again = mixing.plan_mix(table.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in Counter(r.doc_id for r in got for _ in range(r.copies)).items()})
    assert mixing.plan_mix(table.limit(0)).count() == 0 and mixing.mix(table.limit(0)).count() == 0


def test_mix_of_many_equal_rows(spark, monkeypatch):
    """Half of all rows are one document; it is dealt out in lots, and the same on every run."""
    monkeypatch.setattr(mixing, "DEAL_ROWS", 16)
    rows = [(1, "a b c", "s")] * 150 + [(2, None, "s")] * 20 + [(10 + i, "w " * (1 + i % 30), "t" if i % 3 else None) for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan_mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, word_count(t)) for d, t, _ in rows)
    again = mixing.plan_mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and all(0 <= r.copies <= 2 for r in got)
    taken, target = sum(r.taken for r in got if r.doc_id == 1), next(r.target for r in got if r.doc_id == 1)
    assert abs(taken - target) <= 3
    mixed = Counter(r.doc_id for r in mixing.mix(docs.repartition(5)).collect())
    assert mixed == Counter({d: n for d, n in Counter(r.doc_id for r in got for _ in range(r.copies)).items()})


def test_rates_solve_the_dual(spark, small, tmp_path):
    histogram = spark.createDataFrame([("s", n, 3) for n in (5, 40, 300)] + [("t", n, 1) for n in (10, 20)], "source_key string, size long, n long")
    aims = spark.createDataFrame([("s", 1035, 700.0, 9), ("t", 30, 60.0, 2)], "source_key string, source_size long, target double, n_docs long")
    got = {r.source_key: r for r in mixing.newton_tilts(histogram, aims, 2.0, str(tmp_path)).collect()}
    value = sum(3 * n * min(2.0, math.exp(got["s"].tilt * n / got["s"].scale)) for n in (5, 40, 300))
    assert abs(value - 700) < 1e-6 and got["t"].all_in


# Language model


def brute_scores(rows):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    c = Counter()
    for d, t in rows:
        if not held(d):
            seq = [b"<s>", *words_of(t), b"</s>"]
            for k in (1, 2, 3):
                c.update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
    starts = c.pop((b"<s>",), 0)
    one = {g[0]: n for g, n in c.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)
    uni = lambda w: (one.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))

    def pair(a, w):
        return (c[a, w] + lm.PAIR * uni(w)) / ((starts if a == b"<s>" else one.get(a, 0)) + lm.PAIR)

    def triple(a, b, w):
        return (c[a, b, w] + lm.TRIPLE * pair(b, w)) / (c[a, b] + lm.TRIPLE)

    for a, b in [(b"the", b"of"), (b"<s>", b"the"), (b"never", b"the"), (b"x", b"y")]:
        assert abs(sum(triple(a, b, w) for w in [*one, b"never seen"]) - 1) < 1e-9
    want = []
    for d, t in rows:
        seq = [b"<s>", *words_of(t), b"</s>"]
        p = [pair(*seq[:2])] + [triple(*seq[i : i + 3]) for i in range(len(seq) - 2)]
        want.append((-1 if d is None else d, held(d), len(seq) - 1, sum(one.get(w, 0) > 0 for w in seq[1:]), n, sum(math.log10(uni(w)) for w in seq[1:]), sum(map(math.log10, p))))
    return sorted(want)


@pytest.mark.parametrize(("block", "shard", "lane"), [(1 << 20, 1 << 20, 256), (200, 1 << 20, 256), (300, 60, 3), (1, 500, 1)])
def test_scores(spark, docs, monkeypatch, block, shard, lane):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("LANE", lane)):
        monkeypatch.setattr(lm, name, value)
    table = docs if block > 1 else docs.where("doc_id is null or doc_id <> 3")
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in lm.score_corpus(table).collect())
    for a, b in zip(got, brute_scores([(r.doc_id, r.text) for r in table.collect()]), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)
    if block > 1 << 19:
        assert lm.score_corpus(docs.limit(0)).count() == 0
        only_held_out = docs.where("doc_id = 11 or doc_id = 1").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1)
        for r in lm.score_corpus(only_held_out).collect():
            assert r.train_tokens == r.n_known == 0 and r.score == pytest.approx(r.base_score)


def test_traversal_carries_the_state():
    """States of a small automaton, word by word, against the longest context seen."""
    rng, n = np.random.default_rng(3), 6
    text = rng.integers(0, n, 400)
    pairs, pair_at = np.unique(text[1:] * (n + 1) + text[:-1], return_inverse=True)
    triples = np.unique(pair_at[:-1] * (n + 1) + text[2:])
    word, context = pairs // (n + 1), pairs % (n + 1)
    seen2, seen3 = rng.integers(0, 3, len(pairs)), rng.integers(0, 2, len(triples))
    seen3 = np.where((seen2[triples // (n + 1)] > 0), seen3, 0)
    ends = {(c, w): i for i, (c, w) in enumerate(zip(context, word))}
    for i, t in enumerate(triples):  # a triple's last two words were seen if it was
        seen2[ends[word[t // (n + 1)], t % (n + 1)]] |= seen3[i]
    seen3 = np.where((seen2[triples // (n + 1)] > 0), seen3, 0)
    count = np.append(np.bincount(text, minlength=n), 3)
    last = np.array([ends[word[t // (n + 1)], t % (n + 1)] for t in triples])
    machine = lm.Automaton(count[:n] / count[:n].sum(), count, (context, word, seen2), (triples // (n + 1), triples % (n + 1), last, seen3))
    state = np.array([0])
    for i, w in enumerate(text):
        state, weight = machine.step(state, np.array([w]))
        pair = ends.get((text[i - 1], w)) if i else None
        assert state[0] == (n + 2 + pair if pair is not None and seen2[pair] else w + 1) and weight[0] <= 0


# WARC


def odd_pages():
    body = "<p>" + "x" * 200 + "</p>"
    trap = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\n1234567\r\n\r\nWARC/1.1\r\nContent-Length: 90\r\n\r\n" + "é" * 80
    return [(3, "http://a/b c\r\nX: y", body, "e"), (1, None, body, "e"), (2, "u", trap, "e"), (4, "v", None, "e"), (5, "v", "", "e"), (6, "w", "short", "e"), (7, "w", "short", "e"), (8, "w", trap, "e"), (3, "again", body, "e"), (None, "n", "null id " * 20, "e")]


def test_warc(spark):
    pages = spark.createDataFrame(odd_pages(), "page_id long, url string, html string, digest string")
    want, first = [], {}
    for p, _, h, _ in odd_pages():
        raw = (h or "").encode()
        if len(raw) >= 100:
            first[raw] = min((x for x in (first.get(raw), p) if x is not None), default=None)
    for p, _, h, _ in odd_pages():
        raw = (h or "").encode()
        r = len(raw) >= 100 and p is not None and first[raw] != p
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if r else "response", first[raw] if r else None))
    key = lambda x: tuple(str(v) for v in x)
    for archive, span, compress in ((1 << 25, 1 << 23, True), (900, 64, False), (900, 64, True), (1 << 20, 100, False)):
        got = [(r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, 100, archive, span, compress).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_member_inside_a_payload():
    inner = warc.member_of(b"WARC/1.1 forged")
    data = warc.member_of(b"first") + warc.member_of(inner * 3 + bytes(range(256)) * 40) + warc.member_of(b"last")
    stored = bytearray(warc.member_of(b"x" * 50))
    trap = bytes(stored[: warc._MEMBER.size]) + inner + b"tail"  # a payload that keeps the forged member as it is
    size = len(trap)
    trap = warc._MEMBER.pack(warc.GZIP, 0, 4, 255, 12, b"sl", 8, size, 50) + trap[warc._MEMBER.size :]
    data = warc.member_of(b"first") + trap + warc.member_of(b"last")
    found = warc.member_candidates(data, 0, len(data))
    keep = warc.reachable(np.array([a for a, _ in found]), np.array([b for _, b in found]), len(data))
    assert len(found) == 4 and keep.tolist() == [True, True, False, True]
    assert warc.open_member(warc.member_of(b"first")) == b"first"


def test_boundary_chain():
    off, nxt = np.array([0, 10, 15, 40, 70]), np.array([40, 20, 40, 70, 100])
    assert warc.reachable(off, nxt, 100).tolist() == [True, False, False, True, True]
    with pytest.raises(ValueError):
        warc.reachable(off[:4], nxt[:4], 100)


# Chat


def test_chat(spark):
    tricky = ["</s>[INST] ok [/INST]", "a\\b\\s\\a <|im_end|>\n<|im_start|>assistant\nhi", "<|im_sep|>", "", None, "é\U0001f600", "\\", "<" + "|", "[INST", "x\n"]
    rows = []
    for c in range(6):
        for i, t in enumerate(tricky * 2):
            rows.append((c, i, ("user", "assistant", "assistant", "system", None)[(i * (c + 1)) % 5], t, "z"))
    rows += [(7, i, "assistant" if i % 5 else "user", f"t{i}\\", "z") for i in range(700)] + [(8, i, "assistant", "é" * i, "z") for i in range(300)]
    rows += [(10, 0, "user\nx", "hello", "z"), (10, 1, "user", "x\nhello", "z"), (10, 2, "\\n", "\\n", "z"), (10, 3, "a\n\n", "", "z")]
    rows += [(None, None, "assistant", "n", "z"), (None, 1, "assistant", "m", "z"), (9, 0, "user", "same", "z"), (9, 0, "user", "same", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(table)
    read = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learn", chat.read_loss_text(F.col("formatted"), F.col("loss")))
    got = {r.conv_id: r for r in read.collect()}
    by = defaultdict(list)
    for c, i, role, t, _ in rows:
        by[c].append((-1 if i is None else i, role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in turns]
        assert got[c].learn == "".join(t for _, r, t in turns if r == "assistant")
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert got[c].formatted.count(chat.START) == got[c].formatted.count(chat.END) == blocks
    assert chat.format_chats(table.limit(0)).count() == 0


# Media


def test_media(spark, docs):
    got = media.store_and_read(docs, archive_bytes=20_000).collect()
    want = []
    for d, t, *_ in odd_docs():
        raw = (t or "").encode()
        full = media.pad(raw)
        assert len(full) % 192 == 0 and full
        want.append((d, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    key = lambda x: tuple(map(str, x))
    assert sorted(((*r[:5],) for r in got), key=key) == sorted(want, key=key)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({(r.payload_sha256, r.n_bytes) for r in got})
    assert media.store_and_read(docs.limit(0)).count() == 0


def test_member_is_retried(tmp_path, monkeypatch):
    import io
    import json
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as box:
        for i in range(3):
            box.writestr(f"{i}", media.encode_png(media.pad(b"x" * i), i))
    (tmp_path / media.MANIFEST).write_text(json.dumps([{"archive": "a.zip", "bytes": (tmp_path / "a.zip").stat().st_size, "members": 3}]))
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "rangeBytes": 100})
    real, calls = media.read_member, []

    def flaky(f, member):
        calls.append(member.filename)
        if calls.count("1") == 1 and member.filename == "1":
            raise OSError("lost")
        return real(f, member)

    monkeypatch.setattr(media, "read_member", flaky)
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert [r["name"] for r in rows] == ["0", "1", "2"] and calls == ["0", "1", "1", "2"]
    bad = bytearray((tmp_path / "a.zip").read_bytes())
    bad[70] ^= 1
    with pytest.raises(ValueError):
        real(io.BytesIO(bytes(bad)), zipfile.ZipFile(tmp_path / "a.zip").infolist()[0])


# Quality


def test_quality_on_held_out_rows(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    scored = quality.score_documents(docs, quality.fit(docs, labels))
    rows = [r for r in scored.join(labels, "doc_id").where("quality is not null").collect() if r.held_out]
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9 and sum(r.predicted for r in rows if r.quality) > 0.97 * len(good)
    assert scored.count() == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(10 + i, i % 2 if i % 7 else None) for i in range(40)] + [(None, 1), (7, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score_documents(docs, nothing).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), nothing).count() == 0


# HTML


def test_min_cut_is_a_minimum():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        s, t = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 6)) for _ in range(2 * n)]
        edges = [e for e in edges if e[0] != e[1]]
        cost = lambda side: sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html.max_flow_sides(s, t, edges)) == best


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=site-header><div id="logo">Our site</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News &amp; more</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this thing now, it is very good value.</div><div class='cookie-notice'>We use cookies. Accept?</div>
<article><h1>A   title</h1><p>First paragraph, with <b>bold</b> and <a href=x>a link</a> &lt;tag&gt; inside.<br>Second line.<p>Another paragraph without an end, long enough to be one.
<aside class="related">Related: read this other story now.</aside><ul><li>An item of the article.</li><li>Another item of it.</li></ul><p>Short.</p></article>
<section id="comments"><p>Great article, I liked it a lot, thanks for writing it.</p></section><form><label>Mail</label><input><p>Sign up for our newsletter today.</p></form>
<footer>&copy; 2024 All rights reserved.</footer></body></html>"""


def test_html():
    want = ["A title", "First paragraph, with bold and a link <tag> inside. Second line.", "Another paragraph without an end, long enough to be one.", "An item of the article.", "Another item of it.", "Short."]
    assert html.extract(PAGE) == "\n\n".join(want)
    assert html.extract(None) == html.extract("") == html.extract("<nav><a href=x>y</a></nav>") == ""
    assert html.extract("<script>never ends") == "" and html.extract("<p a='unclosed>text") is not None


SENTENCE = "A sentence that is part of the article, and long enough to be one."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><meta charset=x><body><nav><a href=/>Home</a></nav><article><p>{SENTENCE}</article></html>",
        f"<head><title>no end<body><main><p>{SENTENCE}</p></main>",
        f"<title>t</title><script>x()</script><article>{SENTENCE}</article><footer>Imprint of the site, all rights reserved.</footer>",
        f'<article class="post tags-politics category-header"><p>{SENTENCE}</p></article>',
        f'<div class="post tags-politics"><p>{SENTENCE}</p></div>',
        f"<article><p>{SENTENCE}</p><button>Like<p>Not part of it<select><option>a<option>b</article>".replace("<p>Not part of it", ""),
        f"<form><select><option>one<option>two<textarea>unclosed</form><article><p>{SENTENCE}</article>",
        f'<article><p a="1 > 0" b=\'<p>\'>{SENTENCE}</p></article><article class="comment"><p>I agree with every word of it, thanks.</p></article>',
        f"<noscript>Turn on scripts, please, to read this page.</noscript><article>{SENTENCE}<!-- <p>no</p> --></article>",
    ],
)
def test_html_lenient(page):
    assert html.extract(page) == SENTENCE


def test_html_keeps_embedded_content():
    page = "<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in this long sentence.</p><object>A fallback that is long enough to read.</object><canvas>A drawing of it, as text.</canvas></article>"
    assert html.extract(page) == "Energy is E = m in this long sentence.A fallback that is long enough to read.A drawing of it, as text.".replace("E = m", "E=m").replace(".A", ".\n\nA", 1)


def test_html_weights_are_learnt():
    site = f"<article><h1>Title</h1><div class=zig><p>{SENTENCE}</p></div></article><aside><div class=zag><p>{SENTENCE}</p></div></aside>"
    rows = [(b.by_tag > 0, b.features(), sorted(b.words)) for b in html.blocks_of(site) * 60]
    learnt = html.learn(rows)
    assert learnt.words["zig"] > 1 and learnt.words["zag"] < -1 and html.learn([]) == html.STATED
    plain = f"<div><div class=zag><p>{SENTENCE}</p></div><hr><div class=zig><p>{SENTENCE}</p></div></div>"
    assert html.extract(plain, None, learnt) == SENTENCE and html.extract(plain) == SENTENCE + "\n\n" + SENTENCE


@pytest.mark.parametrize("piece", ["<div class=story><p>%s</p></div><p><a href=x>More</a></p>" % SENTENCE, '<a "', "<a '\">", "<p>x<li>", "<!", "< ", "<title>", "<button>b"])
def test_html_time_is_linear(piece):
    import time

    def seconds(n):
        began = time.process_time()
        html.extract("<article>" + piece * n + "</article>")
        return time.process_time() - began

    seconds(100)
    assert seconds(10_000) < 14 * seconds(1250) + 0.3


def test_html_names():
    body = "<p>A sentence that is part of the article, and long enough.</p>"
    page = '<body class="home comments-open sidebar"><div class="page has-sidebar"><div class="post-content">%s</div><div class="sidebar">%s</div></div></body>'
    assert html.extract(page % (body, "<p>Popular stories of the week, with a sentence.</p>")) == body[3:-4]
    assert html.extract(f'<main>{body}<section id="comments"><article class="comment"><p>I agree with every word of it.</p></article></section></main>') == body[3:-4]
    assert html.extract(f"<div>{body}</div>" * 3).count("A sentence") == 3


def test_html_table(spark, small):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t"), (2, "v", "<p>" + "Long text. " * 20000, "t")], "page_id long, url string, html string, text string")
    got = sorted(html.extract_pages(pages).collect(), key=str)
    assert [r.page_id for r in got].count(1) == 2 and any(r.text == "" for r in got) and max(len(r.text) for r in got) > 200_000
    assert html.extract_pages(pages.limit(0)).count() == 0
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        article = r.html.partition("<article>")[2].partition("</article>")[0]
        inside = " ".join(html.html_lib.unescape(html.re.sub(r"<[^>]*>", " ", article)).split())
        assert " ".join(html.extract(r.html).split()) == inside


# SimHash


def brute_fingerprint(text):
    words = words_of(text)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, budget=2):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= budget:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [min((d for d, x in zip(ids, label) if x == own and d is not None), default=None) for own in label]


def test_simhash(spark, docs):
    rows = [(d, t) for d, t, *_ in odd_docs()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = Counter(zip([d for d, _ in rows], fps, brute_components([d for d, _ in rows], fps)))
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    firsts = {c for _, _, c in want if c is not None}
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*firsts, None])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


def test_whole_keys():
    import pyarrow as pa

    keys = sorted(random.Random(2).choices(range(9), k=100))
    batches = [pa.RecordBatch.from_pydict({"key": keys[i : i + 7]}) for i in range(0, 100, 7)]
    for rows in (1, 10, 1000):
        tables = [t["key"].to_pylist() for t in simhash.whole_keys(iter(batches), rows)]
        assert sum(tables, []) == keys and sum(len(set(t)) for t in tables) == len(set(keys))
    assert not list(simhash.whole_keys(iter([]), 5))


@pytest.mark.parametrize(("node_rows", "task_rows"), [(50_000, 200_000), (6, 200_000), (6, 40), (1, 1)])
def test_trie_join_finds_every_link(spark, node_rows, task_rows, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_ROWS", task_rows)
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = set()
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.link_forest(spark.createDataFrame([(x,) for x in signed], "fp long"), node_rows=node_rows)
    for r in edges.collect():
        assert r.a != r.b
    got = {r.id: r.component for r in connected_components(edges).collect()}
    label = brute_components(list(range(len(fps))), fps)
    groups = defaultdict(set)
    for i, x in enumerate(label):
        groups[x].add(signed[i])
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


# Embeddings


def brute_links(ids, vectors, labels, limit=0.93):
    x = np.array(vectors, dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = np.unique(labels, return_inverse=True)[1]
    near = (x @ x.T >= limit) & (code[:, None] == code[None, :])
    np.fill_diagonal(near, False)
    comp = np.array(ids)
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], comp.max()).min(axis=1))
        if (new == comp).all():
            return near.sum(axis=1), comp
        comp = new


def test_pq(spark, small):
    rng = np.random.default_rng(4)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    base = rng.normal(size=(6, 64))
    rows += [(10_000 + i, (base[i % 6] + 0.02 * (i % 9) * rng.normal(size=64)).tolist(), i % 2) for i in range(120)]
    rows += [(20_000 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(20_000, rows[0][1], rows[0][2])]
    odd = [(30_000, None, 1), (30_001, [0.0] * 64, 1), (30_002, [float("nan")] * 64, 1), (30_003, [None] + [1.0] * 63, 1), (30_004, rows[0][1], None), (30_005, [], 1), (30_006, [1.0, 2.0], 1), (30_007, [1.0, 2.0], 1)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, n int, component string")
    got = Counter(map(tuple, ann.near_duplicates(table).collect()))
    links, comp = brute_links(*map(list, zip(*rows)))
    want = Counter((v, int(n), int(c), v == c) for (v, _, _), n, c in zip(rows, links, comp))
    want.update((v, 0, v, True) for v in range(30_000, 30_006))
    want.update([(30_006, 1, 30_006, True), (30_007, 1, 30_006, False)])
    assert got == want
    assert ann.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize(("dim", "inner", "most", "parts"), [(64, 64, 2048, 1 << 19), (128, 128, 2048, 1 << 19), (384, 384, 2048, 1 << 19), (384, 32, 2048, 1 << 15), (768, 768, 2048, 1 << 19), (64, 64, 12, 1 << 13)])
def test_pq_recall(spark, dim, inner, most, parts, monkeypatch):
    """Whole query, more lists than probes, links of cosine .935 to .99, one dense group; labels of other types."""
    monkeypatch.setattr(ann, "LIST_ROWS", 48)
    monkeypatch.setattr(ann, "MOST_COARSE", most)
    monkeypatch.setattr(ann, "PART_COMPONENTS", parts)
    monkeypatch.setattr(ann, "PART_ASKS", 2)
    rng = np.random.default_rng(dim)
    basis = rng.normal(size=(inner, dim)) if inner < dim else np.eye(dim)
    draw = lambda n: ann.unit(rng.normal(size=(n, inner)) @ basis)
    x = draw(1600)
    side = draw(400)
    side = ann.unit(side - (side * x[:400]).sum(axis=1)[:, None] * x[:400])
    cos = rng.uniform(0.935, 0.99, (400, 1))
    dense = ann.unit(draw(1) + 0.15 / np.sqrt(dim) * rng.normal(size=(200, dim)))
    vectors = np.concatenate((x, cos * x[:400] + np.sqrt(1 - cos * cos) * side, dense)).astype(np.float32)
    labels = ["a" if i % 400 < 300 else "b" for i in range(2000)] + ["a"] * 200
    if dim == 128:
        labels = [5_000_000_000 + (c == "b") for c in labels]
    kind = "long" if dim == 128 else "string"
    table = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(vectors, labels))], f"vec_id long, embedding array<float>, label {kind}")
    assert ann.Quantizer(vectors.astype(np.float64), 2200 // 48).lists > 24
    want = brute_links(list(range(2200)), vectors, labels)[0]
    got = np.zeros(2200, dtype=int)
    for r in ann.near_duplicates(table).collect():
        got[r.vec_id] = r.n_links
    assert (got <= want).all() and want[:400].sum() >= 400
    assert got[:2000].sum() >= 0.99 * want[:2000].sum() and got.sum() >= 0.99 * want.sum()


# The pipeline


def test_pipeline_against_its_parts(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r.doc_id for r in quality.score_documents(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
    kept = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good]
    label = brute_components([d for d, *_ in kept], [brute_fingerprint(t) for _, t, _ in kept])
    single = [x for x, c in zip(kept, label) if x[0] == c]
    sizes = Counter()
    for _, t, s in single:
        sizes[s] += word_count(t)
    target, taken = brute_targets(sizes), Counter()
    text = {d: (t, s) for d, t, s in single}
    out = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in out} <= set(text)
    for r in out:
        if r.start == 0:
            t, s = text[r.doc_id]
            taken[s] += word_count(t)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.03 * target[s], 60)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "mixing sources", "packing"]


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_every_stage_takes_odd_rows(spark, docs, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame([(10 + i, i % 2 if i % 7 else None, 0) for i in range(40)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = docs if rows == "odd" else docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert out.columns == docs.columns
        assert (out.count() > 0) == (rows == "odd")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0


def test_registered_sql(spark, medium):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{medium}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, medium)
        res = con.execute(sql)
        cols = [c[0] for c in res.description]
        assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, res.fetchall())), name


@pytest.mark.parametrize(("total", "left", "want"), [(600, 0, 1), (600, 350, 0), (300, 0, 0)])
def test_written_tables_give_the_drivers_heap_back(spark, monkeypatch, tmp_path, total, left, want):
    """Past half of the limit and twice what was left, and only then: many jobs' garbage doesn't fill the heap to its limit."""
    from types import SimpleNamespace

    from sievewright.llm import _util

    calls = []
    heap = SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 750, freeMemory=lambda: total - 70)
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap))), System=SimpleNamespace(gc=lambda: calls.append(1)))
    monkeypatch.setattr(_util, "_left", [left])
    real = _util.trim
    monkeypatch.setattr(_util, "trim", lambda s: real(SimpleNamespace(_jvm=jvm)))
    assert _util.materialize(spark.range(3), f"file://{tmp_path}/t").count() == 3
    assert len(calls) == want and _util._left == [70 if want else left]


def test_written_tables_give_the_drivers_native_memory_back(spark, monkeypatch, tmp_path):
    """Memory that the JVM has freed outside its heap goes back to the system, not only garbage of the heap."""
    import os
    import re
    from pathlib import Path

    from sievewright.llm import _util
    from sievewright.plans import workspace

    monkeypatch.setattr(workspace, "_next", [float("inf")])
    _util.materialize(spark.range(10), f"file://{tmp_path}/t")
    jvm, zipped = spark._jvm, []
    pid = jvm.java.lang.ProcessHandle.current().pid()
    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) // 1024
    data, out = bytearray(os.urandom(1 << 18)), bytearray(1 << 18)
    for _ in range(300):
        zipped.append(jvm.java.util.zip.Deflater())
        zipped[-1].setInput(data)
        zipped[-1].deflate(out)
    for z in zipped[:-1]:  # the last one lies above what is freed
        z.end()
    monkeypatch.setattr(workspace, "_next", [0.0])
    before = resident()
    _util.materialize(spark.range(10), f"file://{tmp_path}/t")
    assert resident() < before - 40
    zipped[-1].end()
