"""Decontamination and personal data against brute force, and the whole pipeline."""

import random
import time
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from etalase.llm import decontamination, pii, registry
from etalase.llm.common import table

SF = "/root/testdata/sf0.01"


def nearest(item, text):
    """Least distance of ``item`` to a beginning of ``text``."""
    last = list(range(len(text) + 1))
    for i, x in enumerate(item):
        now = [i + 1]
        for j, y in enumerate(text):
            now.append(min(now[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
        last = now
    return min(last)


def matches(texts, items, share):
    """{(text, item): least distance} over all passages of all texts."""
    found = {}
    for t, text in enumerate(texts):
        w = decontamination.normal(text)
        for i, item in enumerate(items):
            x = decontamination.normal(item)
            k = int(share * len(x) + 1e-9)
            bag = set(x)
            able = (s for s in range(len(w)) if x and sum(v in bag for v in w[s : s + len(x) + k]) >= len(x) - k)
            best = min((nearest(x, w[s : s + len(x) + k]) for s in able), default=1 << 30)
            if best <= k:
                found[t, i] = best
    return found


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"zz{rng.randrange(999)}"
        elif kind == 1:
            words.insert(at, f"zz{rng.randrange(999)}")
        elif len(words) > 1:
            del words[at]
    return words


def test_search_reaches_its_recall():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(12, 40))) for _ in range(30)]
    texts = []
    for _ in range(200):
        body = rng.choices(vocabulary, k=rng.randrange(0, 60))
        item = rng.choice(items).split()
        at = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + edited(rng, item, rng.randrange(int(0.2 * len(item)) + 1)) + body[at:]).upper())
    wanted = matches(texts, items, decontamination.EDITS)
    index = decontamination.build(list(enumerate(items)))
    got = {(t, i): d for t, i, d, _ in decontamination.search(texts, index)}
    assert not set(got) - set(wanted)
    assert len(got) >= 0.9 * len(wanted) > 90
    assert all(got[k] >= wanted[k] for k in got)
    exact = {k for k, d in wanted.items() if d == 0}
    assert exact and all(got[k] == 0 for k in exact)


@pytest.mark.parametrize("kind", range(3))
@pytest.mark.parametrize("size", [20, 40, 60, 100])
def test_recall_at_the_bound(kind, size):
    """Items with exactly k substitutions, insertions or deletions."""
    rng = random.Random(kind * 1000 + size)
    items = [[f"w{i}x{j}" for j in range(size)] for i in range(60)]
    texts = []
    for item in items:
        words = list(item)
        for at in sorted(rng.sample(range(size), size // 5), reverse=True):
            words[at : at + 1] = [["zz"], [words[at], "zz"], []][kind]
        texts.append(" ".join(["aa", *words, "bb"]))
    index = decontamination.build([(i, " ".join(x)) for i, x in enumerate(items)])
    got = {(t, i) for t, i, *_ in decontamination.search(texts, index)}
    assert sum((i, i) in got for i in range(len(items))) >= 0.93 * len(items)


@pytest.mark.parametrize("seed", range(4))
def test_windows_around_runs_hold_every_match(seed):
    """Items of 1 to 30 words that share words and runs, in texts that lie next to each other."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    items = [rng.choices(words, k=rng.randrange(1, 31)) for _ in range(25)]
    items += [[*rng.choices(words, k=4), *item] for item in items[:5]]
    index = decontamination.build([(i, " ".join(x)) for i, x in enumerate(items)])
    texts = [edited(rng, item, int(0.2 * len(item))) for item in items] + [rng.choices(words, k=40) for _ in range(10)]
    coded = [np.array([index.words.get(w.encode(), 0) for w in text] + [0], np.int64) for text in texts]
    text, ends = np.concatenate(coded), np.cumsum([len(c) for c in coded])
    known = np.zeros(len(text), bool)
    known[:-1] = (text[:-1] > 0) & (text[1:] > 0) & index.pairs[decontamination._pair_code(text[:-1], text[1:])]
    starts = {n: set(found.tolist()) for n, found in decontamination._starts(text, known, index)}
    held = 0
    for t, c in enumerate(coded):
        for item in index.items:
            k = len(item) // 5
            for s in range(len(c) - 1):
                if nearest(item.tolist(), c[s : len(c) - 1][: len(item) + k].tolist()) <= k:
                    held += 1
                    assert ends[t] - len(c) + s in starts[len(item)]
    assert held >= len(items)  # each has a text of its own


def test_too_many_repetitions_are_refused(monkeypatch):
    monkeypatch.setattr(decontamination, "MOST", 3)
    with pytest.raises(ValueError, match="more than 3"):
        decontamination.repetitions.__wrapped__(20)


def test_a_very_long_item():
    """Its walks are not a table of steps and words, and short items are not walked to its length."""
    words = [f"v{i}" for i in range(2000)]
    short = [" ".join(f"s{i}x{j}" for j in range(20)) for i in range(50)]
    index = decontamination.build([(0, " ".join(words)), *enumerate(short, 1)])
    assert sum(k.nbytes for k in index.keys.values()) < 1_000_000
    got = {(t, i): d for t, i, d, _ in decontamination.search([f"one {short[3]} two", " ".join(["a", *words, "b"])], index)}
    assert got == {(0, 4): 0, (1, 0): 0}


def test_vectorised_distances():
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 4, (200, 9)), rng.integers(1, 4, (200, 7))
    wanted = [nearest(y, x) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert decontamination.distances(a, b).tolist() == wanted
    assert decontamination.distances(np.zeros((1, 3), int), np.ones((1, 3), int)).tolist() == [3]


def test_planted_passages_are_found(spark):
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    planted = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    found = {(r.doc_id, r.item_id): r for r in registry.op3_decontamination(spark, SF).collect()}
    assert planted and planted <= set(found)
    for (doc, item), r in found.items():
        w, x = decontamination.normal(texts[doc]), decontamination.normal(items[item])
        assert r.n_words == len(x) and r.distance == nearest(x, w[r.start_word :]) <= 0.2 * len(x)


def test_decontamination_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    df = odd.documents(spark)
    items = [(1, odd.TEXTS[6][:70]), (2, ""), (None, "mail me@example.org or call"), (3, None), (4, "one"), (1, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect())
    assert got[6, 1] == 2 and got[9, None] == 2 and got[3, 4] == 2 and got[None, 4] == 3
    kept = decontamination.clean(df, bench)
    assert kept.dtypes == df.dtypes
    assert Counter(r.doc_id for r in kept.select("doc_id").collect())[6] == 0
    assert decontamination.contaminated(odd.nothing(spark), bench).count() == 0
    assert decontamination.clean(df, bench.where("false")).count() == df.count()


PERSONAL_TEXTS = [
    "a.b+c@x-y.example.org, a@b c@d.e @f.g h@@i.j k@l..m n@o.p.q.r@s.t",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.2.3 999.1.2.3.4 1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111  1111 0 5500000000000004",
    "+1 (555) 555-1234 +1 555 +12345678901234567 ++1 (2) 3.4-5678901 +1((((9",
    "x@" + "a" * 3000 + " " + "9" * 5000 + " +" + "1 " * 40,
    "ſ@ſ.com é1.2.3.4é \U0001f600+1 234 567 8901",
]


def test_personal_data_against_scanning(spark):
    rng = random.Random(7)
    made = ["".join(rng.choices("a1 .@-+()9", k=60)) for _ in range(400)]
    df = odd.documents(spark).select("doc_id", "text", "base", "found").unionByName(
        spark.createDataFrame([(100 + i, t, "x", "y") for i, t in enumerate(PERSONAL_TEXTS + made)], "doc_id long, text string, base string, found string")
    )
    rows = pii.scanned(df).collect()
    got = sorted(((r.doc_id, [(s.start, s.rank, s.kind, s.end) for s in r.base]) for r in rows), key=repr)
    assert got == sorted(((r.doc_id, brute.spans(r.text, brute.PERSONAL)) for r in df.collect()), key=repr)
    assert pii.scanned(odd.nothing(spark)).count() == 0


def test_terms_that_reveal_a_value(spark):
    rng = random.Random(3)
    common = [f"word{i}" for i in range(50)]
    text = lambda more: " ".join([*rng.choices(common, k=9), *more, *rng.choices(common, k=9)])
    rows = [text(["Quirinus", "jane@example.org"]) for _ in range(6)]
    rows += [text(["someone", f"user{i}@example.org"]) for i in range(40)] + [text(["nothing"]) for _ in range(200)]
    rows += [rows[0]] * 3 + [text(["Solitaire", "once@example.org"])] * 5
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = pii.scanned(df)
    found = spans.select("doc_id", F.explode("found").alias("s")).where("s.kind = 'term'").collect()
    words = Counter(rows[r.doc_id][r.s.start : r.s.end] for r in found)
    assert words == {"Quirinus": 9}
    clean = {r.doc_id: r.text for r in pii.sanitised(df, spans).collect()}
    assert "Quirinus" not in clean[0] and "jane@" not in clean[0] and "[email]" in clean[0]
    assert clean[100] == rows[100] and len(clean) == len(rows)


def test_terms_by_hand(spark):
    """Shares of information as counted by dictionaries."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=12)
        if i % 3 == 0:
            words.insert(rng.randrange(12), f"u{rng.randrange(4)}@example.org")
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stored = pii.stored(pii.found(df), "pii-test")
    got = {(r.value, r.term): r.share for r in pii.revealing(df, stored, -99.0, 1).collect()}
    value, both, term = defaultdict(set), defaultdict(set), Counter()
    for _, t in rows:
        w = t.split()
        term.update({x.strip(pii._EDGE) for x in w})
        for k, x in enumerate(w):
            if "@" in x:
                around = w[max(0, k - 8) : k] + w[k + 1 : k + 9]
                value["email:" + x].add(tuple(around))
                for y in around:
                    both["email:" + x, y].add(tuple(around))
    n = len(rows)
    wanted = {
        (v, t): np.log2(len(s) * n / (len(value[v]) * max(term[t], len(s)))) / np.log2(n / len(value[v]))
        for (v, t), s in both.items()
    }
    assert got == pytest.approx(wanted)


def test_copies_do_not_hide_a_term(spark):
    """Texts copied many times count once in every count."""
    texts = [f"{x} {x}{x} Quirinus jane@example.org {x} end{x}" for x in ("aaa", "bbb", "ccc")]
    rows = [t for t in texts for _ in range(100)] + [f"other text {i}" for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    stored = pii.stored(pii.found(df), "pii-copies")
    got = {(r.value, r.term): r.share for r in pii.revealing(df, stored, pii.GENERALISE, 3).collect()}
    assert got == {("email:jane@example.org", "quirinus"): pytest.approx(1.0)}
    assert Counter(r.text for r in pii.distinct_texts(df, stored).collect()) == Counter(set(rows))


def test_terms_far_from_their_value(spark):
    """In the heading and a later paragraph, by a value of two texts; near copies tell nothing."""
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choices([f"word{i}" for i in range(60)], k=n))
    rows = [f"Zebedee {some(40)} zeb@example.org {some(40)}\n\nSigned, (zebedee)." for _ in range(2)]
    copy = f"Aurelia {some(40)} aurelia@example.org {some(150)}"
    rows += [copy, f"{copy} word1", f"{copy} word2"] + [f"Signed, {some(60)}" for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = pii.scanned(df)
    found = spans.select("doc_id", F.explode("found").alias("s")).where("s.kind = 'term'").collect()
    assert Counter(rows[r.doc_id][r.s.start : r.s.end] for r in found) == {"Zebedee": 2, "zebedee": 2}
    assert not any("zebedee" in r.text.lower() for r in pii.sanitised(df, spans).collect())


def _disclosed(texts, generalise):
    """Dictionary version: (value, term) to share over whole distinct texts."""
    texts = sorted(set(texts))
    total = len(texts)
    base = [brute.spans(t, brute.PERSONAL) for t in texts]
    places, of = defaultdict(set), defaultdict(set)
    for i, spans in enumerate(base):
        for a, _, kind, b in spans:
            value = texts[i][a:b].lower()
            places[f"{kind}:{value}"].add(i)
            for x in pii.levels(kind, value):
                places[x].add(i)
                of[x].add(f"{kind}:{value}")
    first = {}
    for e in sorted(places):
        n_of = max((len(places[v]) for v in of.get(e, ())), default=len(places[e]))
        if 1 < len(places[e]) <= total ** (1 - generalise) * n_of**generalise + 1e-6:
            first.setdefault((frozenset(places[e]), n_of), e)
    n_term, inside = Counter(), []
    for t, spans in zip(texts, base, strict=True):
        n_term.update({w.strip(pii._EDGE) for w in t.lower().split()})
        clear = list(t)
        for a, _, _, b in spans:
            clear[a:b] = "@" * (b - a)
        words = {w.strip(pii._EDGE) for w in "".join(clear).lower().split()}
        inside.append({w for w in words if len(w) >= 3 and "@" not in w})
    several = set().union(*(k for k, _ in first)) if first else set()
    seen = Counter(w for i in several for w in inside[i])
    most = max((n for _, n in first), default=1)
    able = {w for w, n in seen.items() if n > 1 and n_term[w] <= total ** (1 - generalise) * most**generalise + 1e-6}
    out = {}
    for (held, n_of), e in first.items():
        for w in able:
            both = [i for i in held if w in inside[i]]
            bits = [0] * pii.SKETCHES
            for i in both:
                bits = [x | y & (2**64 - 1) for x, y in zip(bits, pii._sketch(texts[i]), strict=True)]
            evidence = sorted(x.bit_count() for x in bits)[pii.SKETCHES - 2]
            if evidence < 2:
                continue
            times = len(both) * total / (len(held) * max(n_term[w], len(both)))
            tail = evidence * (np.log(times) - 1 + 1 / times) + 0.5 * np.log(2 * np.pi * evidence)
            share = np.log2(times) / np.log2(total / n_of)
            if times > 1 and share >= generalise and tail >= np.log(len(able) * len(first) / pii.CHANCE):
                out[e, w] = share
    return out


def _people(rng, n_hosts, others):
    """Texts with addresses: each value in one text, each host in several, with words that tell the host or the name."""
    some = lambda n: " ".join(rng.choices([f"word{i}" for i in range(400)], k=n))
    rows = []
    for h in range(n_hosts):
        for k in range(5):
            rows.append(f"{some(30)} Firm{h}x, {some(20)} p{h}.{k}@firm{h}.example.org {some(40)} firm{h}X.")
    for k in range(4):
        rows.append(f"{some(30)} quirinus {some(30)} quirinus@h{k}.example.net {some(5)} 10.0.{k}.7")
    return rows + [f"{some(60)} lone{k}@lone{k}.example.com {some(20)} only{k}" for k in range(10)] + [some(80) for _ in range(others)]


def test_disclosure_against_dictionaries(spark):
    rows = _people(random.Random(23), 6, 600)
    rows += rows[:7] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = pii.stored(pii.found(df), "pii-test")
    total = pii._total(found)
    assert total == len(set(rows))
    for generalise in (0.3, 0.6):
        values = pii.stored(pii.protected(found, total, generalise), "pii-test")
        _, several = pii._holders(found, values, total, generalise)
        known = pii.stored(pii.frequencies(pii.distinct_texts(df, found), pii._words(several)), "pii-test")
        got = {(r.value, r.term): r.share for r in pii.disclosing(several, values, known, total, generalise).collect()}
        assert got == pytest.approx(_disclosed(rows, generalise)) and len(got) > 6


def test_terms_of_values_of_one_text(spark):
    """Terms that tell an address' host or name are found with addresses of one text each; other words stay."""
    rows = _people(random.Random(29), 8, 1500)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = pii.scanned(df)
    found = spans.select("doc_id", F.explode("found").alias("s")).where("s.kind = 'term'").collect()
    words = Counter(rows[r.doc_id][r.s.start : r.s.end] for r in found)
    planted = {f"{x}{h}{y}": 5 for h in range(8) for x, y in (("Firm", "x"), ("firm", "X"))} | {"quirinus": 4}
    assert words == planted


def test_personal_data_in_large_texts(spark):
    """Many values in one text, and a value in a text of 50,000 words: time in proportion, nothing cut."""
    rng = random.Random(31)
    crowd = " ".join(f"u{i}@example.org w{i}" for i in range(20_000))
    long = [" ".join([*(f"w{rng.randrange(9000)}" for _ in range(50_000)), f"Zebedee zeb@example.net d{k}"]) for k in range(3)]
    rows = [crowd, f"{crowd} again", *long, *(f"other text {i}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: (len(r.base), [rows[r.doc_id][s.start : s.end] for s in r.found if s.kind == "term"]) for r in pii.scanned(df).collect()}
    assert time.monotonic() - began < 120
    assert got[0][0] == got[1][0] == 20_000 and all("Zebedee" in got[i][1] for i in (2, 3, 4))
    assert not any(terms for i, (_, terms) in got.items() if i > 4)


def test_pipeline_stages(spark):
    """Each stage against a plain version of what it must keep."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "secret_scans", "packing"]

    clean = corpus_pipeline.stored(stages["toxicity"](spark, docs, SF), "t1")
    scores = {r.doc_id: r.score for r in registry.op4_toxicity(spark, SF).collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, s in scores.items() if s < 0.5}

    single = corpus_pipeline.stored(stages["jaccard_join"](spark, clean, SF), "t2")
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in brute.jaccard_components(rows)})

    free = corpus_pipeline.stored(stages["decontamination"](spark, single, SF), "t3")
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    kept = {r.doc_id: r.text for r in free.collect()}
    for r in single.collect():
        if any(x in r.text for x in items):
            assert r.doc_id not in kept
        else:
            assert r.doc_id in kept or decontamination_near(r.text, items)

    safe = corpus_pipeline.stored(stages["secret_scans"](spark, free, SF), "t4")
    after = {r.doc_id: r for r in safe.collect()}
    assert after.keys() == kept.keys()
    for doc_id, r in after.items():
        assert not brute.spans(r.text, brute.SECRETS) and r.n_chars == len(r.text)
        if not brute.spans(kept[doc_id], brute.SECRETS):
            assert r.text == kept[doc_id] or "[secret]" in r.text
    for part in (clean, single, free, safe):
        assert part.columns == columns

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(after)


def decontamination_near(text, items):
    return bool(matches([text], items, decontamination.EDITS))


def test_pipeline_odd_rows(spark):
    docs = odd.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF), f"odd-{name}")
        assert out.count() > 0
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, odd.nothing(spark), SF).count() == 0
    kept = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, SF)
    assert Counter(r.doc_id for r in kept.select("doc_id").collect())[6] == 1

