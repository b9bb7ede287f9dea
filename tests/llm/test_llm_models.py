"""Language model, classifiers and packing against plain versions, round trips and held-out rows."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import brute
import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from etalase.llm import lm_scoring, packing, quality_crf, registry, toxicity

SF = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def lm_by_hand(rows):
    """Scores of (doc_id, text) rows from dictionaries."""
    texts = [[*brute.words(brute.lower(t or "")), "</s>"] for _, t in rows]
    folds = [fold(d, 10) for d, _ in rows]
    words = {True: Counter(), False: Counter()}
    pairs = {True: Counter(), False: Counter()}
    for part, text in zip(folds, texts, strict=True):
        for every in (True, False):
            if part != 0 and (every or part != 1):
                words[every].update(text)
                pairs[every].update(zip(["</s>", *text], text, strict=False))
    bins = Counter()
    for part, text in zip(folds, texts, strict=True):
        if part == 1:
            for a, b in zip(["</s>", *text], text, strict=False):
                seen, both, one = words[False][a], pairs[False][a, b], words[False][b]
                step = lambda x: min(510, abs(round(8 * math.log2(x)))) if x > 0 else 511
                kind = seen.bit_length()
                bins[(kind * 512 + step(both / seen if seen else 0)) * 512 + step(one)] += 1
    keys = sorted(bins)
    mix = lm_scoring.mixture(
        np.array(keys, np.int64), np.array([bins[k] for k in keys], float), sum(words[False].values()), len(words[False])
    )
    n, v = sum(words[True].values()), len(words[True])
    out = []
    for (doc_id, _), part, text in zip(rows, folds, texts, strict=True):
        base = sum(math.log10((words[True][w] + 0.1) / (n + 0.1 * (v + 1))) for w in text)
        score = 0.0
        for a, b in zip(["</s>", *text], text, strict=False):
            seen = words[True][a]
            m = mix[:, seen.bit_length()]
            score += math.log10(m[0] * pairs[True][a, b] / max(seen, 1) + m[1] * words[True][b] / max(n, 1) + m[2] / (v + 1))
        known = sum(words[True][w] > 0 for w in text)
        out.append((doc_id, part, len(text), known, n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def lm_rows(df):
    return sorted(
        ((r.doc_id, r.fold, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()),
        key=repr,
    )


def close(got, wanted):
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    for g, w in zip(got, wanted, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6, abs=2e-5)


def test_lm_by_hand(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").take(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    close(lm_rows(lm_scoring.scored(df)), lm_by_hand(rows))
    monkeypatch.setattr(lm_scoring, "BATCH_TOKENS", 5000)
    monkeypatch.setattr(lm_scoring, "PART_ENTRIES", 10_000)
    close(lm_rows(lm_scoring.scored(df)), lm_by_hand(rows))


def test_lm_odd_rows(spark):
    df = odd.documents(spark)
    close(lm_rows(lm_scoring.scored(df)), lm_by_hand([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]))
    assert lm_scoring.scored(odd.nothing(spark)).count() == 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    held = registry.op2_lm_scoring(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).collect()[0]
    assert held[0] > held[1] + 100


def test_mixture_is_a_distribution():
    mix = lm_scoring.mixture(np.array([(3 << 18) | (8 << 9) | 16]), np.array([10.0]), 100, 20)
    assert np.allclose(mix.sum(axis=0), 1) and (mix >= 0).all() and mix[0, 0] == 0


def separable(spark, good, bad, column, n=120):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        rows.append((i, " ".join(rng.choices(good if i % 2 else bad, k=40))))
        labels.append((i, i % 2))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {column} int")


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = registry.op4_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) <= 1 and sum(toxic) >= 0.6 * len(toxic)


def test_toxicity_finds_insults_and_ignores_labels_of_held_out_rows(spark):
    words = ["bread", "house", "river", "garden", "window", "train", "summer"]
    docs, labels = separable(spark, [*words, "idiot", "scum"], words, "toxic")
    model = toxicity.train(docs, labels, toxicity.learnable())
    flipped = labels.withColumn("toxic", F.when(toxicity.learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = toxicity.train(docs, flipped, toxicity.learnable())
    assert (model.weights == again.weights).all() and model.bias == again.bias
    for r in toxicity.scored(docs, model).join(labels, "doc_id").collect():
        assert (r.score >= 0.5) == (r.toxic == 1)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {0}


def test_toxicity_keeps_the_true_share(spark):
    """A bounded sample scores by the odds of all labels, not by its own."""
    rng = random.Random(4)
    words = ["bread", "house", "river", "garden", "idiot"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=8))) for i in range(440)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 11 == 0)) for i in range(440)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), bound=40)
    order = [F.xxhash64("doc_id"), "doc_id"]
    clean = labels.where("toxic = 0").orderBy(*order).limit(40)
    alone = toxicity.train(docs, labels.where("toxic = 1").union(clean), F.lit(True), bound=40)
    assert (model.weights == alone.weights).all()
    assert model.bias - alone.bias == pytest.approx(np.log(40 / 400))


def test_features_in_pieces(monkeypatch):
    text = odd.LONG[:5000]
    whole = set(toxicity.features(text).tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 700)
    assert set(toxicity.features(text).tolist()) == whole
    assert len(toxicity.features("")) == len(toxicity.features(None)) == 0


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality_crf, "quality")])
def test_classifiers_odd_rows(spark, module, column):
    df = odd.documents(spark)
    for labels in (odd.labels(spark, column), odd.labels(spark, column).where("false")):
        model = module.train(df, labels, F.col("doc_id") >= 0)
        rows = module.scored(df, model).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.select("doc_id").collect())
        assert all(0 <= r.score <= 1 for r in rows)
        assert module.scored(odd.nothing(spark), model).count() == 0
    assert module.train(odd.nothing(spark), odd.labels(spark, column), F.col("doc_id") >= 0) is not None


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = registry.op8_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert right >= 0.95 * len(rows) and {r.quality for r in rows} == {0, 1}


def test_chain_against_listing_all_labels():
    rng = np.random.default_rng(2)
    sizes, change = np.array([4, 1, 3]), rng.normal(size=(2, 2))
    score = rng.normal(size=8)
    good, pairs, sums = quality_crf.chances(score, sizes, change)
    begin = 0
    for c, n in enumerate(sizes):
        weights = {}
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            energy = sum(score[begin + i] * y[i] for i in range(n)) + sum(change[y[i - 1], y[i]] for i in range(1, n))
            weights[tuple(y)] = math.exp(energy)
        total = sum(weights.values())
        assert sums[c] == pytest.approx(math.log(total))
        for i in range(n):
            assert good[begin + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
            for a in (0, 1):
                for b in (0, 1):
                    mass = sum(w for y, w in weights.items() if i and (y[i - 1], y[i]) == (a, b)) / total
                    assert pairs[begin + i, a, b] == pytest.approx(mass)
        begin += n


def packed(spark, df, capacity=packing.CAPACITY):
    """Rows of a packing, after checking that it is whole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    rows = packing.pack(df, registry.tokenizer_path(), capacity).collect()
    texts = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in df.select("doc_id", "text").collect()]
    wanted = Counter()
    for doc_id, ids in texts:
        for begin in range(0, len(ids), capacity):
            piece = np.array(ids[begin : begin + capacity], "<u4").tobytes()
            wanted[doc_id, begin, len(piece) // 4, zlib.crc32(piece), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return rows, sequences


def test_packing_is_whole_and_tight(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows, sequences = packed(spark, df)
    assert len(sequences) * packing.CAPACITY - sum(r.length for r in rows) < packing.CAPACITY


def test_packing_odd_rows(spark):
    df = odd.documents(spark)
    packed(spark, df)
    packed(spark, df, 64)
    assert packing.pack(odd.nothing(spark), registry.tokenizer_path()).count() == 0


def test_words_encode_as_the_tokenizer_does():
    table = packing.piece_ids(registry.tokenizer_path())
    rng = random.Random(11)
    bits = ["a", "Z", "'s", "'", "é", "É", "H̱", "Σ", "İ", "K", "1", " ", "\n", "\x1c", "\xa0", ".", ",", "!!", "%&", "_", "\x01",
            "<|endoftext|>", "<|STARTOFTEXT|>", "ß", "中", "\U0001f600", "don't ", "the ", "end. ", "w%%% "]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(3000)] + odd.TEXTS[1:]
    wanted = [table.whole(t) for t in texts]
    assert list(table.encode(texts)) == wanted
    small = packing.PieceIds(registry.tokenizer_path())
    small.LIMIT = 50
    assert [ids for t in texts for ids in small.encode([t])] == wanted and small.older


def test_other_tokenizers_encode_whole_texts(tmp_path):
    rules = json.loads(Path(registry.tokenizer_path()).read_text(encoding="utf-8"))
    rules["normalizer"] = None
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    table = packing.PieceIds(str(path))
    texts = ["The Words, THE words.", "", "É é"]
    assert list(table.encode(texts)) == [table.whole(t) for t in texts]
    assert table.whole("THE") != table.whole("the")


def test_copies_without_an_id_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    docs = spark.createDataFrame([(None, "")] * 2000, "doc_id long, text string")
    sizes = packing.pack(docs, registry.tokenizer_path(), 16).groupBy((F.col("sequence_id") / (1 << 32)).cast("int")).count()
    assert max(r["count"] for r in sizes.collect()) < 200


@pytest.mark.parametrize("seed", range(5))
def test_slack_is_least(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randrange(1, 60) for _ in range(rng.randrange(1, 40)))
    left, used_up = Counter(counts), Counter()
    for used, times in packing.minimum_bin_slack(dict(counts), 64):
        first = max(left)
        sums = {0}
        rest = Counter(left)
        rest[first] -= 1
        for length in rest.elements():
            sums |= {s + length for s in sums if s + length <= 64 - first}
        assert used[first] >= 1 and sum(k * n for k, n in used.items()) == first + max(sums)
        for length, n in used.items():
            left[length] -= n * times
            used_up[length] += n * times
        left = +left
    assert used_up == counts
