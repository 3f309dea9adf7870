"""The ten operators and the pipeline against plain versions, on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def make_docs(seed=1, n=60):
    rng = random.Random(seed)
    words = {"en": "the of and that with from this ring over".split(), "de": "der und die das nicht über für straße ist".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(3, 120))), lang, rng.choice(["a", "b", None]), 0))
    rows += [(100, rows[3][1], "en", "a", 0), (101, rows[3][1], "en", "hot", 0), (102, None, None, None, 0), (103, "", "en", "a", 0), (104, " \t\n", "en", "b", 0), (105, "123 !!", "en", "b", 0)]
    rows += [(106, "Zażółć 日本 𝔘 the", "en", "a", 0), (106, "Zażółć 日本 𝔘 the", "en", "a", 0), (107, "x" * 5000, "en", "hot", 0), (None, "no id here at all", "en", "hot", 0)]
    rows += [(108 + i, rows[5][1] + " " + rows[6][1] * 9 + f" tail {i}", "en", "hot", 0) for i in range(5)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mixing_reaches_targets(docs, rows, none):
    from gridloom.llm.mixing import mix

    got = mix(docs.withColumn("size", F.lit(1)).withColumn("rank", F.lit(2))).collect()
    assert len(got) == len(rows)
    sizes, total = {}, 0
    for _, text, _, source, _ in rows:
        n = len(WORD.findall((text or "").encode()))
        sizes[source] = sizes.get(source, 0) + n
        total += n
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    want = sorted((sizes[s], round(target[s], 6)) for s in order)
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in got}) == want
    for size, goal in want:
        taken = sum(r["taken"] for r in got if r["source_size"] == size)
        assert abs(taken - goal) <= max(r["size"] for r in got)
    assert all(0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in got)
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mix(docs.repartition(5)).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in got)
    assert mix(none).count() == 0


def test_mixing_of_hot_rows(spark):
    from gridloom.llm.mixing import mix, mixed

    rows = [(None, "one two three", "hot", 0)] * 9000 + [(i, "w " * (i % 7 + 1), "b", 0) for i in range(600)] + [(7, None, "b", 0), (8, " ", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(5)
    got = mix(docs).groupBy("doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == len(rows)
    hot = next(r for r in got if r["doc_id"] is None)
    assert hot["n"] == 9000 and abs(hot["taken"] - hot["target"]) <= 3
    b = [r for r in got if r["source_size"] == sum(i % 7 + 1 for i in range(600))]
    assert abs(sum(r["taken"] for r in b) - b[0]["target"]) <= 7
    out = mixed(docs).groupBy("source", F.size(F.split("text", "[a-z]+")).alias("n")).count().collect()
    assert sum(r["count"] for r in out if r["source"] == "hot") * 3 == hot["taken"]
    assert sum(r["count"] * (r["n"] - 1) for r in out if r["source"] == "b") == sum(r["taken"] for r in b)


def test_cube_keeps_both_totals():
    from gridloom.llm.mixing import fly

    rng = np.random.default_rng(0)
    p, size, u = np.full(3000, 0.37), rng.integers(1, 900, 3000), rng.random(3000)
    flown = fly(p, size, u, False)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert abs(flown.sum() - p.sum()) < 1e-6 and abs(flown @ size - p @ size) < 1e-3
    landed = fly(p, size, u, True)
    assert set(landed) <= {0.0, 1.0} and abs(landed @ size - p @ size) <= 2


def test_toxicity_finds_planted_words(spark, none):
    from gridloom.llm.toxicity import toxicity

    rng = random.Random(2)
    plain = [f"w{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vile", "Rotten", "SCUM"])
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), "s", 0))
        marks.append((i, 1, int(bad)))
    rows += [(900, None, None, None, 0), (901, "", "en", "s", 0), (None, "vile", "en", "s", 0)]
    labels = spark.createDataFrame(marks + [(0, 1, 1), (5, 0, None)] + [(8, 1, 1)] * 30_000, "doc_id long, quality int, toxic int")
    got = toxicity(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(got) == len(rows)
    held = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] < 700 and r["held_out"]}
    assert set(held) == {i for i in range(700) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == (i % 4 == 0) for i, r in held.items()]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (900, 901)} == {next(r["score"] for r in got if r["doc_id"] == 901)}
    assert toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity(spark.createDataFrame(rows, DOCS), labels.where("toxic = 0")).collect()} == {0.0}


def test_bpe_equals_tiktoken(docs, rows, none):
    import tiktoken

    from gridloom.llm.bpe import FILE, encode_decode, read_ranks

    path = public_tokenizers.path(FILE)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    got = encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()
    texts = {i: t or "" for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_words():
    import tiktoken

    from gridloom.llm.bpe import FILE, Codec, read_ranks

    path = public_tokenizers.path(FILE)
    ranks = read_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["a" * n for n in (63, 64, 65, 66, 5001, 100_000)] + ["ab" * 500 + "a", "=-" * 300, " " * 1001 + "x", "\n" * 700, "é" * 333, "日本" * 200, "aaab" * 501]
    texts += ["".join(rng.choice("theandrs") for _ in range(n)) for n in (65, 100, 500)] + ["".join(rng.choice("ABCdef123") for _ in range(rng.randint(60, 300))) for _ in range(40)]
    for longest in (4, 64):
        for text, (ids, n, back) in zip(texts, Codec(ranks, public_tokenizers.PATTERN, longest).code(texts), strict=True):
            want = encoding.encode_ordinary(text)
            assert (ids, n, back) == (" ".join(map(str, want)), len(want), text.encode())


@pytest.mark.parametrize("block", [16, 8192])
def test_vectors_equal_brute_force(spark, block):
    from gridloom.llm.vector_dedup import near_vectors

    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    v = [(base[i % 12] + rng.normal(0, 0.12, 8)).astype(np.float32).tolist() for i in range(150)]
    v[7] = v[3]
    v[8] = [2 * x for x in v[3]]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] + [0.0] * 7, [1.0, 0.0]]
    rows = [(i, x, 0) for i, x in enumerate(v + odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in near_vectors(frame, block=block).collect()}
    assert len(got) == len(rows)
    a = np.array(v, np.float64)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    near = a @ a.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    for _ in v:
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(v))])
    for i in range(len(v)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), label[i], label[i] == i)
    for i in range(len(v), len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert near_vectors(frame.limit(0)).count() == 0


def test_vectors_with_null_and_repeated_ids(spark):
    from gridloom.llm.vector_dedup import near_vectors

    x, y, z, w = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, x), (9, y), (4, z), (4, w), (None, [0.1, 0.0, 1.0]), (7, [0.0, 1.0, 0.1]), (None, [1.0, 1.0, 1.0]), (None, [2.0, 2.0, 2.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    want = [(None, 1, 9, True), (9, 1, 9, True), (4, 1, 4, True), (4, 1, 4, True), (None, 1, 4, True), (7, 1, 4, False), (None, 1, None, True), (None, 1, None, True)]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_language_of_held_out_documents(docs, rows, none):
    from gridloom.llm.langid import identify

    got = identify(docs.withColumn("score", F.lit(1))).collect()
    assert len(got) == len(rows)
    lang = {i: x for i, _, x, *_ in rows}
    real = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 60]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in real)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in real if r["held_out"]]) > 0.9
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (102, 103, 104, 105)} == {k: ("und", 0.0) for k in (102, 103, 104, 105)}
    assert identify(none).count() == 0


def test_a_rare_language_is_learned_from_a_large_table(spark):
    from gridloom.llm.langid import learn

    few = spark.createDataFrame([(f"zażółć gęślą jaźń {i}", "pl") for i in range(3)], "text string, lang string")
    many = spark.range(120_000).select(F.concat(F.lit("the ring "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert learn(few.union(many))[0] == ["en", "pl"]


def plain_fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs, rows, none):
    from gridloom.llm.simhash import near_duplicates

    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fp = {i: plain_fingerprint(t) for i, t, *_ in rows}
    assert all(r["fp"] % (1 << 64) == fp[r["doc_id"]] for r in got)
    label = {f: min((i for i in fp if fp[i] == f and i is not None), default=None) for f in fp.values()}
    for _ in fp:
        label = {f: min((label[g] for g in label if bin(f ^ g).count("1") <= 3 and label[g] is not None), default=None) for f in label}
    assert all(r["component_id"] == label[fp[r["doc_id"]]] for r in got)
    assert near_duplicates(none).count() == 0


def test_long_posting_lists_lose_no_link(spark):
    from gridloom.llm.common import components
    from gridloom.llm.simhash import links

    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(8)]
    values = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for s in seeds for _ in range(40)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    expect = {v: v for (v,) in signed}
    while True:
        new = {v: min(expect[w] for w in expect if bin((v ^ w) & (1 << 64) - 1).count("1") <= 3) for v in expect}
        if new == expect:
            break
        expect = new
    for longest in (8, 512):
        got = {r["node"]: r["label"] for r in components(links(frame, longest)).collect()}
        assert {v: got.get(v, v) for v in expect} == expect


LICENSES = [
    (1, "Released Under  the MIT License.\nMore"),
    (2, "Apache License, Version 2.0 and cc-by/NC; under the mit license under the mit license"),
    (3, "nothing here"),
    (4, None),
    (5, ""),
    (6, "understand the mit license"),
    (7, "Licensed under the GNU General Public License, version 3."),
    (8, "straße cc by nc äcc by nc cc by ncé"),
]


def test_licenses_equal_brute_force(spark):
    from gridloom.llm.licenses import BASE, rules, scan

    assert len(rules()) > 300
    got = {r["doc_id"]: r for r in scan(spark.createDataFrame(LICENSES, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()}
    for i, text in LICENSES:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[7]["labels"] == "gpl-3" and got[3]["labels"] == "" and len(got[1]["detections"]) == 1
    plan = scan(spark.createDataFrame(LICENSES, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def plain_detections(words, rules):
    """Places of all rules, ordered by start, wider first, then priority and label, without those inside an earlier one."""
    text = " " + " ".join(words) + " "
    found = []
    for label, keyword, rx, p, weight in rules:
        if keyword in words:
            for m in re.finditer(f"(?<= )(?:{rx})(?= )", text):
                first = text[: m.start()].count(" ") - 1
                found.append((first, -(first + m[0].count(" ") + 1), p, label, weight))
    out = []
    for s, back, _, label, weight in sorted(found):
        if all(-back > e for _, e, *_ in out):
            out.append((s, -back, label, weight))
    return out


def test_license_rules_equal_brute_force(spark):
    from gridloom.llm.licenses import BODIES, NAMES, TEMPLATES, rules, scan

    rng = random.Random(11)
    plain = lambda rx: re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", rx))).replace(" ?", " ").replace("?", "")
    pieces = [plain(t.format(name)) for t, *_ in TEMPLATES for *_, name in NAMES] + [plain(b[2]) for b in BODIES]
    texts = [" ".join(rng.choice(pieces) if rng.random() < 0.4 else rng.choice("under the license of mit gpl v2 3 0 version cc by nc sa apache spdx word".split()) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += pieces + [rng.choice([", ", "; ", "-"]).join(p.upper().split()) for p in pieces]
    got = {r["i"]: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    hit = 0
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        want = plain_detections(words, rules())
        assert [tuple(d) for d in got[i]["detections"]] == want, text
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert got[i]["labels"] == ",".join(sorted(base | {d[2] for d in want}))
        hit += len(want)
    assert hit > 1000
    assert scan(spark.createDataFrame([], "i int, text string")).count() == 0


def test_license_scan_of_a_long_text_is_quick(spark):
    import time

    from gridloom.llm.licenses import scan

    text = " ".join(["word", "under the mit license", "cc by nc"] * 10_000)
    start = time.time()
    row = scan(spark.createDataFrame([(text,)], "text string")).drop("text").first()
    assert (row["n_words"], row["n_base"], len(row["detections"])) == (80_000, 20_000, 20_000)
    assert time.time() - start < 30


def test_media_round_trip(spark, rows):
    from gridloom.llm.media import UNKNOWN, digest, pad, samples, sniff, sniff_media, to_bmp, to_png, to_wav

    for _, text, *_ in rows:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192) if data else b" " * 192
        n, m, sha, crc, size, _, feature = digest(data)
        assert (n, m, sha, crc) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) and size > m * 0 and feature
        assert payload == pad(data)
        for make, kind in ((to_wav, "audio/wav"), (to_bmp, "image/bmp"), (to_png, "image/png")):
            stored = make(payload)
            assert sniff(stored, "x/y") == (kind, True, [(0, len(stored), kind)]) and samples(stored, kind) == payload
            assert sniff(stored[:-1], kind)[0] == UNKNOWN
            assert sniff(b"junk BM PK" + stored + b"RIFF", None)[2] == [(10, len(stored), kind)]
    frame = spark.createDataFrame([(1, to_png(pad(b"a")), "image/gif"), (2, None, None), (3, b"", "a/b")], "id long, content binary, media_type string")
    got = {r["id"]: (r["sniffed_type"], r["type_corrected"]) for r in sniff_media(frame).collect()}
    assert got == {1: ("image/png", True), 2: (UNKNOWN, False), 3: (UNKNOWN, True)}


def test_suffix_array_and_prefixes():
    from gridloom.llm.suffix_array import permuted_common_prefixes, suffix_array

    rng = np.random.default_rng(0)
    for _ in range(150):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 50)).astype(np.uint8)
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: bytes(s[i:]))
        if len(s):
            phi, prefix = permuted_common_prefixes(s, sa)
            for r in range(1, len(s)):
                a, b = bytes(s[sa[r] :]), bytes(s[sa[r - 1] :])
                n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                assert (phi[sa[r]], prefix[sa[r]]) == (sa[r - 1], n)


def plain_removal(texts, length=400):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        cover = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = [True] * length
        runs = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        out.append((len(t), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover, strict=True) if not c)).hexdigest()))
    return out


def repeated_rows(rows):
    rng = random.Random(9)
    line = "".join(rng.choice("abcd ") for _ in range(700))
    more = [(200 + i, "".join(rng.choice("abc") for _ in range(30)) + line[i : 500 + 3 * i] + "é" + line[:399], "en", "a", 0) for i in range(20)] + [(300, "ab" * 230, "en", "a", 0), (301, "abc" * 150, "en", "a", 0)]
    more += [(310 + i, "".join(rng.choice("xyz") for _ in range(300)) + line[100:540] + "".join(rng.choice("xyz") for _ in range(300)), "en", "a", 0) for i in range(12)]
    return rows + more


@pytest.mark.parametrize("shard", [1_500_000, 1500])
def test_suffix_dedup_equals_brute_force(rows, spark, none, shard):
    from gridloom.llm.suffix_dedup import digests

    every = repeated_rows(rows)
    got = digests(spark.createDataFrame(every, DOCS).withColumn("t", F.lit(1)).withColumn("spans", F.lit("x")).repartition(3), shard=shard).collect()
    expect = sorted((str(r[0]), *x) for r, x in zip(every, plain_removal([(r[1] or "").encode() for r in every]), strict=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == expect
    assert digests(none).count() == 0


def plain_passages(texts, length, words):
    """Each text without its maximal runs of repeated windows that hold more than so many words; the bytes that go."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone, i = set(), 0
        while i <= len(t) - length:
            j = i
            while j <= len(t) - length and seen[t[j : j + length]] > 1:
                j += 1
            if j > i and len(t[i : j - 1 + length].split()) > words:
                gone.update(range(i, j - 1 + length))
            i = j + 1
        out.append((bytes(b for k, b in enumerate(t) if k not in gone).decode(errors="ignore"), len(gone)))
    return out


@pytest.mark.parametrize("shard", [1_500_000, 700])
def test_passages_equal_brute_force(rows, spark, none, shard):
    from gridloom.llm.suffix_dedup import PASSAGE, WORDS, digests, remove_repeats

    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))
    shared = [words(52), words(55), words(45), words(300)]
    every = repeated_rows(rows) + [(400 + i, f"{words(rng.randint(1, 40))} {shared[i % 4]} {words(rng.randint(1, 40))}", "en", "a", 0) for i in range(24)]
    docs = spark.createDataFrame(every, DOCS).withColumn("z", F.col("n_chars")).repartition(3)
    expect = plain_passages([(r[1] or "").encode() for r in every], PASSAGE, WORDS)
    got = remove_repeats(docs, shard=shard)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(r[0]), str(x if r[1] is not None else None)) for r, (x, _) in zip(every, expect, strict=True))
    assert sorted((str(r["doc_id"]), r["passage_bytes"]) for r in digests(docs, shard=shard).collect()) == sorted((str(r[0]), n) for r, (_, n) in zip(every, expect, strict=True))
    assert remove_repeats(none).count() == 0


def test_many_equal_rows_are_quick(spark):
    import time

    from gridloom.llm.suffix_dedup import digests

    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij ") for _ in range(6000))
    docs = spark.createDataFrame([(None, text, "en", "a", 0)] * 4000 + [(i, text[i : i + 3000] + str(i), "en", "a", 0) for i in range(50)], DOCS)
    start = time.time()
    got = digests(docs).groupBy("n_bytes", "n_removed").count().collect()
    assert {(r["n_bytes"], r["n_removed"], r["count"]) for r in got if r["n_bytes"] == 6000} == {(6000, 6000, 4000)}
    assert time.time() - start < 60


def test_a_very_long_text(spark):
    from gridloom.llm.suffix_dedup import digests

    rng = np.random.default_rng(8)
    long = rng.integers(97, 123, 3_000_000, dtype=np.uint8).tobytes().decode()
    got = by_id(digests(spark.createDataFrame([(1, long + long[:1000], "en", "a", 0), (2, "ab" * 100_000, "en", "a", 0)], DOCS)))
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"]) == (2000, 2, 200_000)


def test_token_counts_equal_a_plain_viterbi(docs, rows, none):
    from gridloom.llm.token_counts import FILE, NORMAL, PENALTY, SPACE, read_vocabulary, token_counts

    path = public_tokenizers.path(FILE)
    vocabulary = read_vocabulary(path)
    worth = {p: s for p, s, _ in vocabulary}
    low = min(s for _, s, k in vocabulary if k == NORMAL) - PENALTY
    longest = max(map(len, worth))

    def plain(text):
        t = SPACE + text.replace(" ", SPACE) if text else ""
        best = [(0.0, 0)] + [(float("-inf"), 0)] * len(t)
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + longest) + 1):
                if t[i:j] in worth and best[i][0] + worth[t[i:j]] > best[j][0]:
                    best[j] = (best[i][0] + worth[t[i:j]], best[i][1] + 1)
            if t[i] not in worth and best[i][0] + low > best[i + 1][0]:
                best[i + 1] = (best[i][0] + low, best[i][1] + len(t[i].encode()))
        return best[-1]

    got = token_counts(docs.withColumn("score", F.lit(0)), path).collect()
    texts = {i: t or "" for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        score, pieces = plain(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_chars"]) == (pieces, len(texts[r["doc_id"]])) and abs(r["score"] - score) < 1e-3 * max(1, abs(score))
    assert token_counts(none, path).count() == 0


def test_pipeline_stages(spark, rows, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, counts = docs.columns, []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert name == cp.STAGES[-1][0] or docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    # 107 repeats one letter: it has letters, but no trigram of any learned language
    good = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and r[0] != 107]
    assert counts[0] == len(good)
    assert counts[1] == counts[2] < counts[0]
    kept = spark.read.parquet(str(tmp_path / "simhash_near_dedup"))
    assert {3, None} <= {r[0] for r in kept.select("doc_id").collect()} and kept.where("doc_id in (100, 101)").count() == 0
    assert kept.where("doc_id = 106").count() == 1
    assert sorted(map(str, cp.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
    assert cp.ORACLE_SQL is None and isinstance(docs.schema, T.StructType)


def test_unseen_scripts_are_rejected(spark, rows):
    import corpus_pipeline as cp

    rng = random.Random(5)
    odd = []
    for i in range(400):
        base = rng.choice([0x0905, 0x0E01, 0x10D0, 0x4E00, 0xAC00])
        odd.append((1000 + i, " ".join("".join(chr(base + rng.randrange(30)) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 60))), None, "x", 0))
    known = [r for r in rows if r[0] is not None and r[0] < 60]
    got = {r["doc_id"] for r in cp.language_id(spark, spark.createDataFrame(known + odd, DOCS), "").collect()}
    assert got == {r[0] for r in known}


def test_one_document_of_each_group_stays(spark):
    import corpus_pipeline as cp

    a, b, c = (" ".join(random.Random(k).choices("abcdefghijkl", k=80)) for k in range(3))
    rows = [(None, a), (None, a), (None, a.upper()), (5, b), (None, b), (7, c), (7, c.upper()), (7, c)]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], DOCS).repartition(3)
    got = [(r["doc_id"], r["text"].lower()) for r in cp.simhash_near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(None, a), (5, b), (7, c)], key=str)


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline as cp

    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_of_the_stages(spark, rows, tmp_path):
    import corpus_pipeline as cp

    more = {"tags": F.create_map(F.lit("k"), F.col("source")), "nested": F.array(F.create_map(F.lit(1), F.lit("x"))), "__known": F.lit("mine"), "score": F.lit("s"), "__t": F.lit(1), "size": F.lit(True)}
    docs = spark.createDataFrame(rows, DOCS).withColumns(more)
    for name, stage in cp.STAGES[:-1]:
        if name in ("language_id", "mixing"):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() > 50
    taken = cp.mixing(spark, docs, "").select("doc_id", "tags").collect()
    assert all(r["tags"] == {"k": next(x[3] for x in rows if x[0] == r["doc_id"])} for r in taken)
