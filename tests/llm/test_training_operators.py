"""Each operator against brute force, an exact round trip or held-out accuracy, on small fixtures with every awkward case."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairngraph.llm import bpe, components, iblt, langid, minhash, mixing, q_mixing, q_sharding, scratch, secrets, sharding, shingles, tiff, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
#: id, text: nulls, blanks, one word, copies, case, very long texts, other scripts.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "a b c d e f g h i j"), (7, "A B C d e f g h i j"), (8, "a b c d e f g h i j k"), (9, "x" * 70_000), (10, "wörter ß 漢字 🙂 " * 3000), (11, "wörter ß 漢字 🙂 " * 3000), (None, "no id here"), (12, "p\n\nq\np")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, key string, score int")


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(200)]
    out = []
    for i in range(n):
        if i % 3 == 0 or not out:
            words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))]
        else:
            words = rnd.choice(out).split()
            for _ in range(rnd.randint(0, max(1, len(words) // 8))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        out.append(" ".join(words))
    return list(enumerate(out))


# ---- op1 -----------------------------------------------------------------------------------------


def brute_components(rows, words):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = WORD.findall((t or "").translate(LOWER))
        n = min(words, len(w))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rows = ODD + [(100 + i, t) for i, t in random_texts(150)]
    got = minhash.near_duplicates(docs(spark, rows), "doc_id", "text", words, 80).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == brute_components(rows, words)
    assert [r["component_id"] for r in got if r["id"] is None] == [None]


def test_near_duplicates_of_no_rows(spark):
    assert minhash.near_duplicates(docs(spark, []), "doc_id", "text").count() == 0


def test_one_of_each_keeps_rows_without_id_and_one_of_repeats(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "")]
    assert sorted((r["doc_id"] or 0) for r in minhash.one_of_each(docs(spark, rows), "doc_id", "text").collect()) == [0, 1, 3]


@pytest.mark.parametrize("block", [512, 3])
def test_blocks_link_what_a_bucket_holds(spark, monkeypatch, block):
    # eight alike members of one bucket, each a component of its own, and two strangers
    monkeypatch.setattr(minhash, "BLOCK", block)
    h = shingles.MinHash(minhash.BANDS, minhash.ROWS, minhash.MINIMA)
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    members = []
    for i in range(10):
        s = np.unique(np.concatenate([base[: 390 - i] if i < 8 else rnd.integers(0, 1 << 63, 380, dtype=np.uint64), rnd.integers(0, 1 << 63, 10, dtype=np.uint64)]))
        m = h.minima(s)
        members.append((0, 77, i, i, len(s), bytearray((m & 255).astype(np.uint8).tobytes()), [77] + [1000 * i + k for k in range(31)], bytearray(s.tobytes())))
    df = spark.createDataFrame(members, "band int, key long, id long, component long, n long, sig binary, keys array<long>, hashes binary")
    mixed = minhash._mixed(df.select(F.col("component").alias("c_id"), "n", "keys"), 80)
    assert mixed.count() == 1
    links = minhash._block_links(df.join(mixed, "key"), 80)
    assert links.count() <= 28
    got = {r["node"]: r["component"] for r in components.components(links, scratch.Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(8)}


def test_linked_sizes_are_in_neighbouring_classes(spark):
    pairs = [(n, -(-n * 80 // 100)) for n in range(1, 3000)]
    got = {r["n"]: r["class"] for r in spark.range(1, 3000).withColumnRenamed("id", "n").select("n", minhash._size_class(80).alias("class")).collect()}
    assert all(got[n] - got[m] <= 1 for n, m in pairs)


def test_a_hot_key_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(scratch, "HOT", 0.1)
    many = scratch.Scratch(spark, "t").write(spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")))
    one = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = scratch.dealt_join(many, one, "k", "v", many)
    assert got.columns == ["k", "v", "w"] and {tuple(r) for r in got.collect()} == {(0 if i < 3000 else i, i, 0 if i < 3000 else 2 * i) for i in range(5000)}


def test_components_by_stars(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = components.components(spark.createDataFrame(edges, "a long, b long"), scratch.Scratch(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in out} == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long"), scratch.Scratch(spark, "t")).count() == 0


def test_components_are_the_same_in_one_task_and_in_many(spark, monkeypatch):
    rnd = random.Random(6)
    edges = spark.createDataFrame([(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)], "a long, b long")
    one = set(components.components(edges, scratch.Scratch(spark, "t")).collect())
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert one == set(components.components(edges, scratch.Scratch(spark, "t")).collect())


def test_rounds_over_few_rows_need_no_shuffle(spark):
    together = scratch.one_task(True)
    edges = scratch.Scratch(spark, "t").write(spark.range(1, 100).selectExpr("id AS a", "id - 1 AS b").repartition(7))
    cells = scratch.Scratch(spark, "t").write(spark.range(60).selectExpr("id % 3 AS x", "id % 4 AS y", "id % 5 AS z", "1.0D AS weight", "0.33D AS share_x", "0.25D AS share_y", "0.2D AS share_z").repartition(7))
    for df in (components._small_star(components._large_star(together(edges), together), together), mixing._scaled(cells, ["x", "y", "z"], together)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and df.rdd.getNumPartitions() == 1


def test_word_hashes_cut_pieces_at_words(monkeypatch):
    text = (" ".join("".join(random.Random(i).choice("abcXYZé") for _ in range(i % 9 + 1)) for i in range(500)) + " " + "w" * 9000).encode()
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert (whole == shingles.word_hashes(text)).all() and len(whole) == len(text.split())


# ---- op2 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    rnd = random.Random(9)
    pages = [(bytes(rnd.choice(b"aab") for _ in range(64 * 50)), 64), (bytes(rnd.randrange(256) for _ in range(40 * 21)), 40), (b"\0" * 64, 64)]
    found = list(tiff.read(tiff.write(pages, compression, predictor, 7, tile)))
    assert [(p.data, p.width) for p in found] == pages and [p.page for p in found] == [0, 1, 2]


def test_tiff_codecs_on_long_inputs():
    data = bytes(random.Random(2).choice(b"abcdefgh") for _ in range(60_000)) + b"z" * 5000
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(b"")) == b"" == tiff.packbits_decode(b"")


def test_tiff_reads_what_others_write():
    # big-endian, two rows of two samples, one plain strip after the directory
    short = [(256, 2), (257, 2), (258, 8), (259, 1), (262, 1), (278, 2)]
    entries = [(t, 3, v.to_bytes(2, "big") + b"\0\0") for t, v in short] + [(273, 4, (110).to_bytes(4, "big")), (279, 4, (4).to_bytes(4, "big"))]
    directory = b"".join(t.to_bytes(2, "big") + k.to_bytes(2, "big") + b"\0\0\0\1" + v for t, k, v in sorted(entries))
    file = (b"MM\0*\0\0\0\x08\0\x08" + directory).ljust(110, b"\0") + b"wxyz"
    assert [p.data for p in tiff.read(file)] == [b"wxyz"]


def test_tiff_pages_of_odd_files(spark):
    good = tiff.write([(b"a" * 64, 64), (b"b" * 128, 64)])
    ring = bytearray(good)
    at = int.from_bytes(good[4:8], "little")
    end = at + 2 + 12 * int.from_bytes(good[at : at + 2], "little")
    ring[end : end + 4] = good[4:8]
    df = spark.createDataFrame([("g", bytearray(good)), ("n", None), ("e", bytearray()), ("t", bytearray(good[:40])), ("r", bytearray(ring))], "page string, media binary")
    rows = tiff.pages(df.withColumnRenamed("page", "name"), "name", "media").collect()
    assert sorted((r["name"], r["page"]) for r in rows if r["error"] is None) == [("g", 0), ("g", 1)]
    assert sorted(r["name"] for r in rows if r["error"]) == ["e", "n", "r", "t"]


def test_tiff_of_texts(spark):
    rows = [r for r in ODD if r[0] is not None]
    media = tiff.from_text(docs(spark, rows), "doc_id", "text")
    sizes = {r["doc_id"]: r["n_bytes"] for r in media.collect()}
    out = {r["doc_id"]: r for r in tiff.features(tiff.pages(media, "doc_id", "media"), ["doc_id", "media_sha256"]).collect()}
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (sizes[i], out[i]["payload_bytes"], out[i]["payload_sha256"], out[i]["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert out[10]["media_sha256"] == out[11]["media_sha256"] and out[10]["feature"] == out[11]["feature"]
    assert tiff.from_text(docs(spark, []), "doc_id", "text").count() == 0


# ---- op3 -----------------------------------------------------------------------------------------

SYLLABLES = {"en": "the and ing ion ent er th wh ly ness", "de": "der sch ung und ein ich keit ä ü ver", "fr": "eau que les tion é è ment oi ç des", "es": "ción los ando mente ñ que ía ó rr ll"}


def sentences(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(sorted(SYLLABLES))
        s = SYLLABLES[lang].split()
        out.append((i, " ".join("".join(rnd.choice(s) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(8, 60))), lang))
    return out


def test_language_accuracy_and_odd_texts(spark):
    train = spark.createDataFrame([*sentences(600, 1), (900, "1 2 3", "en"), (901, None, "en"), (902, "words", None)], "doc_id long, text string, lang string")
    model = langid.train(train, "text", "lang", F.col("doc_id"), per_language=80)
    assert model.families == ["germanic", "romance"]
    held = sentences(300, 2)
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(held, "doc_id long, text string, lang string"), "doc_id", "text", model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) / 300 > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(spark), "doc_id", "text", model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[10] == odd[11]
    assert langid.identify(docs(spark, []), "doc_id", "text", model).count() == 0


def test_language_without_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(empty, "text", "lang", F.col("doc_id"))
    assert model.predict(langid.vector("words")) == ("und", 0.0)
    only = langid.train(spark.createDataFrame([(1, "the cat", "en")], "doc_id long, text string, lang string"), "text", "lang", F.col("doc_id"))
    assert only.predict(langid.vector("der hund")) == ("en", 1.0)


def test_no_language_is_left_out_and_repeats_count_once(spark):
    rows = [(i, "".join(chr(97 + (i % 300 + j * 7) % 26) for j in range(30)), f"l{i % 300}") for i in range(900)] + [(-i, "again and again", "l0") for i in range(500)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", F.col("doc_id"), most=1000)
    assert len(model.families) == 300


# ---- op4 -----------------------------------------------------------------------------------------


def test_warc_round_trip_and_revisits(spark):
    page = "<html>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n é漢</html>"
    rows = [(1, "http://a/ x\r\nevil: 1", page), (5, "http://b", page), (3, None, page), (2, "u", None), (4, "u", ""), (9, "u", "z" * 300_000), (7, "u", "unique"), (None, "u", "unique"), (5, "http://b", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    s = scratch.Scratch(spark, "t")
    raw, fresh = s.path("raw"), s.path("fresh")
    warc.write(df, "page_id", "url", "html", raw)
    headers = s.write(warc.read_headers(spark, raw))
    assert headers.count() == len(rows)
    decided = s.write(warc.resolve(headers))
    warc.rewrite(spark, raw, decided, fresh)
    out = warc.follow(warc.read_headers(spark, fresh)).collect()
    want = {}
    for i, _, t in rows:
        want.setdefault(t or "", []).append(i)
    assert len(out) == len(rows)
    for t, ids in want.items():
        sha = base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
        mine = [r for r in out if r["payload_digest"] == sha]
        top = max(i for i in ids if i is not None)
        assert sorted((r["page_id"] or 0) for r in mine) == sorted((i or 0) for i in ids)
        assert [r["page_id"] for r in mine if r["record_type"] == "response"] == [top]
        assert all(r["payload_bytes"] == len(t.encode()) for r in mine)
        assert all(r["refers_to"] == top for r in mine if r["record_type"] == "revisit")
    small = warc.resolve(headers, min_bytes=10)
    assert small.where("payload_bytes < 10 and decision = 'revisit'").count() == 0


def test_warc_files_hold_whole_records(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * 100) for i in range(20)], "page_id long, url string, html string")
    warc.write(df.coalesce(1), "page_id", "url", "html", f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.gz")
    records = list(warc.parse(gzip.decompress(file.read_bytes())))
    assert len(records) == 20 and records[0][1]["warc-type"] == "response" and warc.payload_of(records[3][2]) == b"x" * 100


def test_warc_levels_hold_the_same_records(spark, tmp_path):
    rnd = random.Random(5)
    page = [" ".join(rnd.choice(["wörter", "ß", "漢字", "🙂", "plain", "<p>"]) for _ in range(4000)) for _ in range(20)]
    df = spark.createDataFrame([(i, "u", page[i // 2]) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    data, sizes = {}, {}
    for level in ("DEFAULT_COMPRESSION", "BEST_SPEED"):
        raw, fresh = f"file://{tmp_path}/raw-{level}", f"file://{tmp_path}/fresh-{level}"
        warc.write(df, "page_id", "url", "html", raw, level=level)
        warc.rewrite(spark, raw, warc.resolve(warc.read_headers(spark, raw)), fresh, level=level)
        for kind in ("raw", "fresh"):
            files = [f.read_bytes() for f in (tmp_path / f"{kind}-{level}").glob("part-*.gz")]
            data[kind, level], sizes[kind, level] = b"".join(map(gzip.decompress, files)), sum(map(len, files))
    for kind in ("raw", "fresh"):
        assert data[kind, "BEST_SPEED"] == data[kind, "DEFAULT_COMPRESSION"] and sizes[kind, "BEST_SPEED"] > sizes[kind, "DEFAULT_COMPRESSION"]
    assert [warc.payload_of(b).decode() for _, _, b in warc.parse(data["raw", "BEST_SPEED"])] == [page[i // 2] for i in range(40)]


def test_warc_of_no_pages(spark):
    s = scratch.Scratch(spark, "t")
    raw = s.path("raw")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html", raw)
    assert warc.read_headers(spark, raw).count() == 0


# ---- op5 -----------------------------------------------------------------------------------------


def test_raking_meets_the_marginals(spark):
    rnd = random.Random(3)
    cells = {(a, b, c): rnd.randint(1, 1000) for a in "xyz" for b in "pq" for c in "uv"}
    targets = [{"x": 0.5, "y": 0.3, "z": 0.2, "absent": 0.4}, {"p": 0.9, "q": 0.1}, {"u": 0.25, "v": 0.75}]
    dims = ["source", "language", "topic"]
    df = wanted = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, language string, topic string, tokens long")
    for d, t in zip(dims, targets, strict=True):
        wanted = wanted.join(mixing._target(df, d, t), d)
    raked = mixing.rake(wanted, dims, scratch.Scratch(spark, "t"), 60)
    w = {tuple(r[d] for d in dims): r["weight"] for r in raked.collect()}
    for i, t in enumerate(targets):
        held = sum(t[v] for v in {k[i] for k in cells})
        for v in {k[i] for k in cells}:
            assert abs(sum(x for k, x in w.items() if k[i] == v) - t[v] / held) < 1e-9
    c = mixing.factor(raked, 0.4 * sum(cells.values()))
    assert abs(sum(min(cells[k], c * w[k]) for k in cells) - 0.4 * sum(cells.values())) < 1e-6


def plain_probabilities(held):
    """The same rounds over a dictionary of cells."""
    total = sum(held.values())
    shares = []
    for i in range(3):
        raised = {v: (sum(n for k, n in held.items() if k[i] == v) / total) ** mixing.TEMPER for v in {k[i] for k in held}}
        shares.append({v: x / sum(raised.values()) for v, x in raised.items()})
    w = {k: float(n) for k, n in held.items()}
    for _ in range(mixing.ROUNDS):
        for i in range(3):
            sums = {v: sum(x for k, x in w.items() if k[i] == v) for v in shares[i]}
            w = {k: x * shares[i][k[i]] / sums[k[i]] for k, x in w.items()}
    c, before = 0.0, -1.0
    while c > before:
        before = c
        open_ = sum(x for k, x in w.items() if c * x < held[k])
        c = (mixing.BUDGET * total - sum(n for k, n in held.items() if c * w[k] >= n)) / open_ if open_ else c
    return {k: min(1.0, c * x / held[k]) for k, x in w.items()}


@pytest.mark.parametrize("few", [100_000, 0])
def test_mixing_equals_the_plain_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "ONE_TASK", few)
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 1200)), rnd.choice(["a", "a", "b", None]), rnd.choice(["en", "fr", ""]), 3) for i in range(120)] + [(7, None, "c", "de", 1), (None, "x", "a", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    got = mixing.mix(df, "doc_id", "text", "source", "lang").collect()
    held = {}
    for r in got:
        k = (r["source"], r["language"], r["topic"])
        held[k] = held.get(k, 0) + r["tokens"]
    wanted = plain_probabilities(held)
    assert len(got) == len(rows) and 0 < sum(r["kept"] for r in got) < len(rows)
    assert all(r["p"] == pytest.approx(wanted[r["source"], r["language"], r["topic"]], abs=1e-9) for r in got)
    assert mixing.mix(df.limit(0), "doc_id", "text", "source", "lang").count() == 0


# ---- op6 -----------------------------------------------------------------------------------------


def brute_spans(t):
    assign = re.compile(r'((?a:(?i:password|passwd|secret|token|api_?key)))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)')
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secret_spans_equal_brute_force(spark):
    rnd = random.Random(5)
    bits = ["password: ", "secret: abcdefghijklmnop", "TOKEN=token=abcdefghijkl", "passwd = 'short'", "api_key:\"AKIA" + "Z9" * 9, "AKIAAKIA" + "Q" * 9, "0123456789abcdef", "é漢🙂", "\n", " ", "ſecret: abcdefghijklmnop", "deadbeef" * 3, "apikey='0123456789abcdef0123'"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))) for i in range(300)] + [(900, "token = \"aaaaaaaaaaaaaaaa\" é\n" * 1500), (901, None), (902, "")]
    random_ = secrets.random_strings(spark.range(600))
    words = spark.createDataFrame([("".join(rnd.choice(["the", "ing", "err", "get", "Value", "name", "_", "list"]) for _ in range(6)), 0) for _ in range(400)], "sample string, label int")
    ratio = secrets.train(random_.union(words))
    assert len(ratio) == 16384
    got = {r["row"]["doc_id"]: r for r in secrets.find(docs(spark, rows), "text", ratio).collect()}
    for i, t in rows:
        assert [tuple(x) for x in got[i]["base"]] == brute_spans(t or ""), t
    key = base64.b64encode(hashlib.sha256(b"1").digest()).decode()[:32]
    extra = secrets.find(docs(spark, [(1, f"see {key} and getValuenameinglisterr too")]), "text", ratio).first()
    assert [(x["s"], x["k"], x["e"]) for x in extra["spans"]] == [(4, 3, 36)] and not extra["base"]
    assert secrets.find(docs(spark, []), "text", ratio).count() == 0


def test_redaction_merges_overlaps(spark):
    text = "a token = \"24be64439e3e49cf46b2d7c9\" b"
    df = spark.createDataFrame([(text, [(2, 0, 35), (11, 2, 35), (36, 2, 37)]), (text, [])], "text string, spans array<struct<s:int,k:int,e:int>>")
    assert [r[0] for r in df.select(secrets.redacted("text", "spans")).collect()] == ["a [SECRET]\"[SECRET]b", text]


def plain_redaction(text, spans):
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_redaction_of_many_spans_equals_the_plain_way(spark):
    rnd, rows = random.Random(9), []
    for n in (1, 30, 700):
        text = "".join(rnd.choice("aé漢🙂\n ") for _ in range(12 * n))
        cuts = sorted((rnd.randrange(len(text) - 1), rnd.randrange(3)) for _ in range(n))
        rows.append((text, [(s, k, min(len(text), s + rnd.choice([1, 5, 40, 2000]))) for s, k in cuts]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<s:int,k:int,e:int>>")
    assert [r[0] for r in df.select(secrets.redacted("text", "spans")).collect()] == [plain_redaction(*r) for r in rows]


def test_sixteen_thousand_secrets_in_a_text_take_no_square_time(spark):
    text = "".join(f"token = \"{hashlib.md5(str(i).encode()).hexdigest()}\" and some words\n" for i in range(16_000))
    found = secrets.find(docs(spark, [(1, text)]), "text", [0.0] * 16384)
    out = found.select(F.size("base").alias("n"), secrets.redacted("text", "spans").alias("t")).first()
    assert out["n"] == 32_000 and out["t"] == "[SECRET]\" and some words\n" * 16_000


def test_random_strings_are_told_from_words(spark):
    """Keys that training hasn't seen, alone, after a path and beside a base span, and runs of ordinary words."""
    rnd = random.Random(12)
    bits = ["the", "ing", "err", "get", "Value", "name", "_", "list", "/", "user", "size", "Index"]
    word = lambda n: "".join(rnd.choice(bits) for _ in range(n))
    ratio = secrets.train(secrets.random_strings(spark.range(3000)).union(spark.createDataFrame([(word(6), 0) for _ in range(2000)], "sample string, label int")))
    keys = [base64.b64encode(hashlib.sha256(f"k{i}".encode()).digest()).decode()[:32] for i in range(400)]
    texts = [(i, f"see {('', word(15) + '/', '0123456789abcdef/')[i % 3]}{k} there") for i, k in enumerate(keys)] + [(1000 + i, f"see {word(12)} there") for i in range(400)]
    got = {r["row"]["doc_id"]: [x for x in r["spans"] if x["k"] == 3] for r in secrets.find(docs(spark, texts), "text", ratio).collect()}
    hit = sum(sum(min(x["e"], t.index(k) + 32) - max(x["s"], t.index(k)) for x in got[i]) >= 24 for (i, t), k in zip(texts, keys))
    false = sum(bool(got[1000 + i]) for i in range(400))
    assert hit / 400 >= 0.97 and false / 400 <= 0.01


# ---- op7 -----------------------------------------------------------------------------------------


def test_flow_moves_the_fewest_bytes():
    rnd = random.Random(6)
    for _ in range(30):
        sizes = [rnd.randint(0, 100) for _ in range(rnd.randint(1, 6))]
        caps = sharding.equal_capacities(sum(sizes), rnd.randint(1, 8))
        flow = sharding.solve_flow(sizes, caps)
        assert [sum(r) for r in flow] == sizes and [sum(r[j] for r in flow) for j in range(len(caps))] == caps
        stays = sum(flow[i][i] for i in range(min(len(sizes), len(caps))))
        assert stays == sum(min(a, b) for a, b in zip(sizes, caps, strict=False))


def test_reshard_is_even_gapless_and_rewrites_only_what_changes(spark, tmp_path):
    rows = [(i, t) for i, t in random_texts(700)] + [(None, "n"), (3, "again"), (3, "again"), (9001, None)]
    out = sharding.reshard(sharding.from_documents(docs(spark, rows), 5), 7, block_rows=50).collect()
    number = lambda i: -1 if i is None else i
    assert sorted((number(r["key"]), r["size"]) for r in out) == sorted((number(i), len((t or "").encode()) + 1) for i, t in rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    total = sum(r["size"] for r in out)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 7) < 6 * 500
    placed = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (1, 2, 0), (2, 2, 1)], "old int, shard int, slot long")
    manifest = {r["shard"]: r["version"] for r in sharding.rewrite(spark, placed, str(tmp_path), 3).collect()}
    assert manifest == {0: None, 1: 3, 2: 3}
    assert {p.name for p in (tmp_path / "v3").glob("shard=*")} == {"shard=2"}
    assert sharding.reshard(sharding.from_documents(docs(spark, []), 5), 7).count() == 0


def test_reshard_rewrites_whole_texts(spark, tmp_path):
    """Files of the shards that change hold every text once, repeated and null ids too; a shard that keeps its rows stays as it is."""
    rows = [(i, t) for i, t in random_texts(300)] + [(None, "n"), (3, "again"), (3, "again"), (9001, None)]
    for old, new, capacities in ((5, 7, None), (3, 3, [1 << 30] * 3)):
        path = str(tmp_path / f"{old}-{new}")
        sharding.write_layout(docs(spark, rows), old, path)
        stored = sharding.stored(spark, path, "long")
        placed = scratch.Scratch(spark, "t").write(sharding.reshard(sharding.measured(stored), new, capacities, block_rows=50))
        manifest = sharding.rewrite(spark, placed, path, 2, stored.select("file", "place", "text"))
        back = sharding.read_layout(spark, path, 2, manifest, placed, "long").collect()
        assert sorted(map(repr, ((r["key"], r["text"]) for r in back))) == sorted(map(repr, rows))
        plan = {(r["shard"], r["slot"]): (r["key"], r["old"], r["crc"]) for r in placed.collect()}
        assert {(r["shard"], r["slot"]): (r["key"], r["old"], zlib.crc32((r["text"] or "").encode())) for r in back} == plan
        assert {r["shard"]: r["version"] for r in manifest.collect()} == {i: 2 if old != new else None for i in range(new)}
        assert len(list((tmp_path / f"{old}-{new}" / "v2").glob("shard=*"))) == (new if old != new else 0)


def test_reshard_query_leaves_rewritten_shards(spark, monkeypatch):
    written = []
    monkeypatch.setattr(q_sharding.sharding, "rewrite", lambda *a, f=sharding.rewrite: written.append(a[2]) or f(*a))
    out = q_sharding.op7_reshard(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    files = spark.read.parquet(f"{written[0]}/v1").collect()
    still = {r["shard"] for r in out} - {r["shard"] for r in out if r["shard"] != r["old_shard"]} - {r["old_shard"] for r in out if r["shard"] != r["old_shard"]}
    assert {r["key"]: r["text"] for r in files} == {r["doc_id"]: text[r["doc_id"]] for r in out if r["shard"] not in still}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out if r["shard"] not in still} == {r["key"]: (r["shard"], r["slot"]) for r in files}
    assert sorted(r["doc_id"] for r in out) == sorted(text) and files
    assert all((r["size"], r["text_crc32"]) == (len((text[r["doc_id"]] or "").encode()) + 1, zlib.crc32((text[r["doc_id"]] or "").encode())) for r in out)


# ---- op8 -----------------------------------------------------------------------------------------


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(2)
    terms = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(5, 8))) for _ in range(30)})
    trie = toxicity.Trie(terms)
    for _ in range(4000):
        w = "".join(rnd.choice("abcd") for _ in range(rnd.randint(4, 9)))
        near = [t for t in terms if t[0] == w[0] and distance(t[1:], w[1:]) <= 1]
        assert trie.near(w) == (min(near) if near else None)


def test_automaton_reaches_short_terms_stems_and_first_letters():
    rnd = random.Random(5)
    word = lambda low, high: "".join(rnd.choice("abc") for _ in range(rnd.randint(low, high)))
    for _ in range(10):
        terms, stems = sorted({word(1, 8) for _ in range(12)}), sorted({word(4, 6) for _ in range(5)})
        weights = {t: rnd.choice([0.2, 0.5, 1.0]) for t in [*terms, *(s + "*" for s in stems)]}
        trie = toxicity.Trie(terms, stems, weights)
        for _ in range(300):
            w = word(1, 11).replace("c", rnd.choice("cd"))
            near = [t for t in terms if distance(t, w) <= 1] + [s + "*" for s in stems if any(distance(s, w[:n]) <= 1 for n in range(len(w) + 1))]
            assert trie.near(w, same_first=False) == min(near, key=lambda t: (-weights[t], t), default=None)


def test_toxicity_finds_edits_of_every_term():
    lexicon = toxicity.Lexicon({"trash": 1.0, "scum": 0.9, "loser": 0.3}, {"idiot": 0.4})
    assert [lexicon.look_up(w) for w in ("drash", "skum", "lozer", "idjotic", "odiots")] == [("trash", 0.5), ("scum", 0.45), ("loser", 0.15), ("idiot*", 0.2), ("idiot*", 0.2)]
    assert lexicon.look_up("harmless") is None and lexicon.look_up("x" * 70_000) is None
    # rows with an edit are clean as often as toxic: such edits weigh nothing; no rows with one: as if untested
    trusted = lexicon.trusting(toxicity.Counter({"loser": 10}), toxicity.Counter({"loser": 40}), 100, 300)
    assert trusted.look_up("lozer") is None and trusted.look_up("skum") == ("scum", 0.45)


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(1)
    plain = ["".join(rnd.choice(["an", "re", "in", "th", "er", "ou"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(900):
        words, bad = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))], i % 8 == 0
        for _ in range(rnd.randint(2, 5) if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "moron", "worthless", "zugab" + rnd.choice(plain)]))
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(df.where("doc_id % 3 <> 1"), "text", "label", F.col("doc_id"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(df, "doc_id", "text", model).collect()}
    held = [(got[i] >= 0.7, bool(bad)) for i, _, bad in rows if i % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert model.score("you are an idiott and a moron") > model.score(None) == model.score("")
    assert model.score("idiot moron worthless") > model.score("he said \"idiot moron worthless\" once")
    assert toxicity.scores(docs(spark, []), "doc_id", "text", model).count() == 0


@pytest.mark.parametrize("every", [2, 5])
def test_toxicity_learns_at_every_class_balance(spark, every):
    """Half of the rows toxic, and four fifths: the terms that mark them are learned all the same."""
    rnd = random.Random(every)
    plain = ["".join(rnd.choice(["an", "re", "in", "th", "er", "ou"]) for _ in range(rnd.randint(2, 4))) for _ in range(200)]
    rows = []
    for i in range(600):
        words, bad = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))], i % every != 0
        rows.append((i, " ".join(words + ([rnd.choice(["idiot", "moron", "worthless"]) for _ in range(3)] if bad else [])), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(df.where("doc_id % 3 <> 1"), "text", "label", F.col("doc_id"))
    assert {"idiot", "moron", "worthless"} == set(model.lexicon.words) | {t for t in ("idiot", "moron", "worthless") for s in model.lexicon.stems if t.startswith(s)}
    held = [((model.score(text) >= 0.7), bool(bad)) for i, text, bad in rows if i % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.98


def test_toxicity_without_both_labels(spark):
    model = toxicity.train(spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, label int"), "text", "label", F.col("doc_id"))
    assert model.score("idiot") == 0.0


# ---- op9 -----------------------------------------------------------------------------------------


def paragraphs(t):
    cut = [q for p in re.split(r"\n+", t) for q in (re.split(r"(?<=[.!?;|])\s+", p) if len(p) > iblt.LINE else [p])]
    return {q for q in cut if re.search(r"\S", q)}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, t) for i, t in ODD if i is not None] + [(100 + i, "\n".join(rnd.choice(["alpha. beta.", "gamma", "delta " * 60 + "end. More. x", str(rnd.random())]) for _ in range(rnd.randint(0, 120)))) for i in range(40)]
    out = {r["key"]: r for r in iblt.compare(iblt.edited(iblt.with_next(docs(spark, rows), "doc_id", "text", bucket=7))).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + following[:n]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(likeness(paragraphs(t), paragraphs(changed))) and r["near_next"] == pytest.approx(likeness(paragraphs(t), paragraphs(following)))
    assert out[10]["fingerprint"] == out[11]["fingerprint"] and out[1]["fingerprint"] == out[2]["fingerprint"]


def test_sketches_grow_until_they_peel(spark):
    df = spark.createDataFrame([([*range(1, 400)], [*range(200, 700)]), ([], []), ([5], [5]), ([1], [])], "a array<long>, b array<long>")
    # one group of far too many differences, and the groups that such texts are dealt in
    for bits in ("0", f"greatest({iblt.levels('a')}, {iblt.levels('b')})"):
        found = df.select(F.expr(iblt.differing("a", "b", iblt.sketches("a", bits), iblt.sketches("b", bits), bits)).alias("d")).collect()
        assert [(sorted(r.d.plus), sorted(r.d.minus)) for r in found] == [([*range(1, 200)], [*range(400, 700)]), ([], []), ([], []), ([1], [])]


def test_printed_fingerprints_hold_the_sketches(spark):
    """The differences of two texts come back from their printed fingerprints alone."""
    a, b = [f"line {i}" for i in range(6)], [f"line {i}" for i in range(3, 9)]
    held = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string").selectExpr(*[f"{iblt.digests(x)} AS {x}" for x in "ab"])
    r = held.selectExpr("a", "b", *[f"{iblt.line(iblt.sketches(x, '0'))} AS f{x}" for x in "ab"]).first()
    cells = [[tuple(int(v, 16) if k else int(v) for k, v in enumerate(c.split("."))) if c else (0, 0, 0) for c in f.split(" ")] for f in (r.fa, r.fb)]
    left = [(x[0] - y[0], x[1] ^ y[1]) for x, y in zip(*cells, strict=True)]
    assert len(left) == 3 * iblt.TABLE
    alone = {(n, k) for n, k in left if n in (1, -1)}
    wanted = {(1, x & (1 << 64) - 1) for x in set(r.a) - set(r.b)} | {(-1, x & (1 << 64) - 1) for x in set(r.b) - set(r.a)}
    assert alone & wanted and len(wanted) == 6


def test_next_of_one_and_of_none(spark):
    assert iblt.with_next(docs(spark, [(1, "a")]), "doc_id", "text").first()["next_text"] == "a"
    assert iblt.with_next(docs(spark, []), "doc_id", "text").count() == 0
    repeated = iblt.with_next(docs(spark, [(1, "a"), (1, "b"), (None, "c"), (2, "d")]), "doc_id", "text", bucket=1).collect()
    assert len(repeated) == 4 and {r["key"]: r["next_text"] for r in repeated}[None] == "d"


@pytest.mark.parametrize("bounds", [4, 4096])
def test_next_of_hot_keys_and_many_buckets(spark, monkeypatch, bounds):
    monkeypatch.setattr(iblt, "BOUNDS", bounds)
    rows = [(7, f"t{i}") for i in range(300)] + [(None, f"n{i}") for i in range(200)] + [(i, f"x{i}") for i in range(-40, 400)] + [(5_000_000_000 + 977 * i, f"y{i}") for i in range(60)]
    rows = [r for r in rows if r[0] != 7 or r[1] != "x7"]
    df = docs(spark, rows)
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), hashed[r[1]]))
    got = iblt.with_next(df, "doc_id", "text", bucket=10).collect()
    assert {(r["key"], r["text"], r["next_text"]) for r in got} == {(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)} and len(got) == len(rows)


# ---- op10 ----------------------------------------------------------------------------------------


def test_bpe_equals_the_merging_library(spark):
    import public_tokenizers as public
    import tiktoken

    data = bpe.read_vocabulary(public.path("byte_bpe_50k.tiktoken"))
    c = bpe.codec(data, public.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(data), special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdeé \n\t'sß0123 \x1c\x85 漢字🙂tTheing=/-_.<|>") for _ in range(rnd.randint(0, 120))) for _ in range(800)]
    texts += ["a" * 20_000, "ab" * 9000 + "\n" * 500, "<|endoftext|>", "", " " * 3000]
    for t in texts:
        ids = c.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert c.decode(ids) == t.encode()
    rows = docs(spark)
    out = {r["doc_id"]: r for r in bpe.round_trip(rows, "doc_id", "text", public.path("byte_bpe_50k.tiktoken"), public.PATTERN, True).collect()}
    for i, t in ODD:
        assert out[i]["ids"] == reference.encode_ordinary(t or "") and out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and out[i]["n_tokens"] == len(out[i]["ids"])
    ids = bpe.encode(rows, "doc_id", "text", public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode(ids, "doc_id", "ids", public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()}
    assert back == {i: t or "" for i, t in ODD}
    assert bpe.encode(docs(spark, []), "doc_id", "text", public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0


def test_mixture_sql_is_given():
    assert "PARTITION BY topic" in q_mixing.ORACLES["op5_mixture_raking"]
