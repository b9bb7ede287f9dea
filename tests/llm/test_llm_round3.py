"""Spelling variants, byte-level BPE and hard negatives against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import odd
import public_tokenizers
import pytest
import tiktoken
from plans import plan_text
from pyspark.sql import functions as F

from etalase.llm import byte_bpe, hard_negatives, registry, spelling
from etalase.llm.common import stored

SF = "/root/testdata/sf0.001"

# ---- spelling variants


def plain_words(docs, every=None):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and code % every == 0:
                at = code % len(word)
                word = word[:at] + word[at + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v.encode()), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best
    rows = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    return rows


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("seed", range(3))
def test_forms_of_crowded_words(spark, seed):
    draw = random.Random(seed)
    letters = ["ab", "abcé", "aaÿb\U0001f600"][seed]
    made = {"".join(draw.choices(letters, k=draw.randint(5, 9))): draw.randint(1, 40) for _ in range(250)}
    counts = spark.createDataFrame([*made.items(), (None, 3), ("nulln", None), ("four", 9)], "word string, n long")
    got = rows_of(spelling.grouped(counts))
    assert len(got) == len(made) and set(got) == plain_groups(made)


def test_repeated_words_add_up_and_chains_end_at_their_root(spark):
    chain = [("aaaaa" + "b" * i, 3 * 2**i) for i in range(12)]
    counts = spark.createDataFrame([*chain, ("aaaaa", 0)], "word string, n long")
    got = {r.word: r for r in spelling.grouped(counts).collect()}
    assert {r.root for r in got.values()} == {chain[-1][0]} and got["aaaaa"].n == 3


def test_variants_of_texts(spark):
    docs = odd.documents(spark)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    for every in (None, 2):
        assert set(rows_of(spelling.variants(docs, every))) == plain_groups(plain_words(plain, every))
    assert spelling.variants(odd.nothing(spark)).collect() == []


def test_variants_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(registry.QUERIES["op11_spelling_variants"](spark, SF))
    want = plain_groups(plain_words(docs, 97))
    assert len(got) == len(want) and set(got) == want
    assert any(form for _, form, *_ in want)


def test_words_and_keys_are_never_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(spelling, "stored", lambda df, name: plans.append(plan_text(df)) or stored(df, name))
    counts = spark.createDataFrame([("planted", 9), ("plantet", 4), ("plantel", 2), ("granted", 3)], "word string, n long")
    plans.append(plan_text(spelling.grouped(counts)))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 4
    assert not any("BroadcastExchange" in p or "ShuffledHashJoin" in p for p in plans)


def test_pivots_are_disjoint_and_least():
    draw = random.Random(5)
    for _ in range(300):
        grams = [(draw.randrange(40), p) for p in sorted(draw.sample(range(12), draw.randint(3, 7)))]
        pairs = [(x[0] + y[0], x[1], y[1]) for x in grams for y in grams if y[1] >= x[1] + 2]
        if pairs:
            a, b = spelling.pivots(grams)
            weight = {p: w for w, p in grams}
            assert b - a >= 2 and weight[a] + weight[b] == min(pairs)[0]


# ---- byte-level BPE

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def checked(spark, docs, frequent, coarse=byte_bpe.STRETCHES):
    coded = byte_bpe.encoded(docs, PATH, public_tokenizers.PATTERN, frequent=frequent, coarse=coarse, plain=byte_bpe.LETTERS)
    assert set(coded.columns) == {*docs.columns, "ids"}
    for r in coded.select("text", "ids").collect():
        assert r.ids == TIKTOKEN.encode_ordinary(r.text or "")
    for r in byte_bpe.decoded(coded, PATH).select("text", "decoded").collect():
        assert bytes(r.decoded) == (r.text or "").encode()


@pytest.mark.parametrize("frequent", [0, 40, 1 << 17])
def test_encoding_odd_rows(spark, frequent):
    docs = odd.documents(spark).withColumn("ids", F.lit("clash"))
    checked(spark, docs, frequent)
    checked(spark, docs.limit(0), frequent)


def test_encoding_of_every_kind_of_character(spark):
    draw = random.Random(1)
    kinds = [" ", "\n", "\t", " ", "\x85", " ", "\x1c", "'s", "'LL", "a", "é", "ß", "中", "文", "١", "²", "!", "\U0001f600", "é"]
    texts = ["".join(draw.choices(kinds, k=40)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    checked(spark, docs, 1 << 17)
    checked(spark, docs, 0, None)


def test_the_fold_in_spark_merges_as_the_tasks_do(spark):
    draw = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect() if r.text]
    words = {w for t in texts for w in re.findall(r" ?\w+", t)} | {"".join(draw.choices("aebt ", k=k)) for k in range(1, 40)}
    rows = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    for r in byte_bpe.with_ids(rows, RANKS).collect():
        assert r.ids == [RANKS[t] for t in byte_bpe.merged(r.word.encode(), RANKS)]


def test_long_words_merge_as_short_ones():
    draw = random.Random(3)
    for letters in ("ab", "etaoin ", "é中a"):
        for k in (65, 200, 900):
            word = "".join(draw.choices(letters, k=k)).encode()
            assert byte_bpe.merged(word, RANKS) == byte_bpe._merged_short(word, RANKS)
    assert len(byte_bpe.merged(b"a" * 300_000, RANKS)) < 300_000


def test_frequent_words_are_bounded(spark):
    texts = spark.createDataFrame([("one two two three three three " + "x" * 70,)] * 3, "text string")
    found = byte_bpe.frequent_words(texts, RANKS, public_tokenizers.PATTERN, 2)
    assert 0 < len(found) <= 2 and " three" in found
    assert byte_bpe.frequent_words(texts.limit(0), RANKS, public_tokenizers.PATTERN) == {}


def test_bpe_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op12_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---- hard negatives


def plain_mined(rows, asks, k=5, m=3, low=50, high=95):
    out = []
    rows = [r for r in rows if None not in r and None not in r[2]]
    width = max((len(v) for *_, v in rows), default=0)
    matrix = np.array([[*v, *[0] * (width - len(v))] for *_, v in rows], "int64").reshape(len(rows), width)
    for a in {(i, str(l), tuple(v)) for i, l, v in rows if asks(i)}:
        scores = matrix @ np.array([*a[2], *[0] * (width - len(a[2]))], "int64")
        order = sorted((-s, i, str(l)) for s, (i, l, _) in zip(scores.tolist(), rows, strict=True) if i != a[0])
        best = [(i, -s) for s, i, l in order if l == a[1]][:k]
        for i, p in best:
            fit = [(j, -s) for s, j, l in order if l != a[1] and low * p <= -100 * s <= high * p][:m]
            out += [(a[0], i, r, j, p, s) for r, (j, s) in enumerate(fit, 1)]
    return Counter(out)


def vectors(seed, n=400, width=11, copies=60):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 60, (6, width))
    rows = [(i, int(draw.integers(4)), (centres[draw.integers(6)] + draw.normal(0, 25, width)).round().astype(int).tolist()) for i in range(n)]
    rows += [(n + i, i % 4, rows[0][2]) for i in range(copies)]
    rows += [(10, 1, rows[10][2]), (10, 1, rows[10][2]), (20, 2, [0] * width), (n + 999, 0, [1, 2]), (n + 1000, 1, [])]
    rows += [(None, 1, rows[0][2]), (5, None, rows[0][2]), (6, 1, None), (7, 1, [1, None])]
    return rows


@pytest.mark.parametrize(("seed", "block_rows"), [(0, 8192), (1, 100), (2, 37)])
def test_mined_against_brute_force(spark, seed, block_rows):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "id long, label int, vector array<long>").withColumn("slot", F.lit("clash"))
    got = hard_negatives.mined(df, F.col("id") % 10 == 0, block_rows=block_rows)
    assert Counter(rows_of(got)) == plain_mined(rows, lambda i: i % 10 == 0)


def test_mined_without_rows_or_partners(spark):
    empty = spark.createDataFrame([], "id long, label int, vector array<long>")
    assert hard_negatives.mined(empty, F.col("id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(10, 1, [1, 2])], empty.schema)
    assert hard_negatives.mined(one, F.col("id") % 10 == 0).collect() == []
    with pytest.raises(Exception, match="integer scores"):
        hard_negatives.mined(spark.createDataFrame([(10, 1, [1 << 40])], empty.schema), F.col("id") % 10 == 0).collect()


def test_intervals_hold_and_leave_rows_out():
    draw = np.random.default_rng(4)
    for width in (8, 64, 256):
        data = draw.normal(0, 50, (600, width)).round().astype("int64")
        asked = draw.normal(0, 50, (40, width)).round().astype("int64")
        bits, aligned, rest = hard_negatives.codes(data)
        block = object.__new__(hard_negatives._Block)
        block.code, block.aligned, block.rest, block.width = hard_negatives._words(bits), aligned, rest, width
        estimate, doubt = block.intervals(asked, slice(None))
        true = asked @ data.T
        assert (np.abs(true - estimate) <= doubt).all()
        lengths = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(data, axis=1)
        assert (doubt / lengths).mean() < 0.35


def test_rotation_keeps_lengths_and_turns_back():
    data = np.random.default_rng(0).normal(size=(5, 32))
    turned = hard_negatives.rotated(data, 3)
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(data, axis=1))
    assert np.allclose(hard_negatives.unrotated(turned, 3), data)


def test_mining_query(spark):
    found = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [
        (r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding])
        for r in found
        if r.embedding is not None and r.label is not None and all(x is not None and np.isfinite(x) for x in r.embedding)
    ]
    got = registry.QUERIES["op13_hard_negatives"](spark, SF)
    assert dict(got.dtypes)["rank"] == "int"
    assert Counter(rows_of(got)) == plain_mined(rows, lambda i: i % 50 == 0)
