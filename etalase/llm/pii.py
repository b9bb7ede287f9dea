"""Personal data: fixed patterns, and terms that give a protected value away.

After information-theoretic sanitisation: a term reveals a protected value as far as the two are
informative about each other. With chances from the corpus, PMI(value; term) / IC(value) is the share
of the value's information that the term gives away: 1 when the term only ever stands by that value.
All counts are over distinct texts (copies of a text count once). There are two ways to find a term:

* beside the values, over distinct surroundings;
* over whole texts, by the value itself or by what it shares with other values (an address' host, a
  network, a number without its last digits, a word left of the ``@``), so that values of one text take part
  too. What a term tells about the shared thing is still measured against the information of the value. A
  pair counts when chance alone would hardly bring it: its Poisson tail, over all pairs of terms and values,
  must stay below ``CHANCE``. Texts that are nearly alike are one piece of evidence there, which min-hashes
  tell; evidence is counted up to 64.

Terms above the upper threshold are removed, terms above the lower one generalised, wherever they stand
in a text with the value.
"""

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etalase.llm.common import PRIME, documents_of, grams, hashed_words, mixed, stored
from etalase.sources.workspace import ship_package

# Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
METHOD = "term"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NAME = re.compile(r"[a-z]{3,}")
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&"
_EDGE_BYTES = _EDGE.encode()

NEAR_WORDS, NEAR_CHARACTERS, LEAST_LETTERS = 8, 160, 3
GENERALISE, REMOVE, LEAST_SURROUNDINGS = 0.6, 0.9, 3
FILTER_BITS, PRINT_BITS = 22, 20
# Pairs that chance may bring; min-hashes of a text; pairs a task sends at a time; parts of a large group.
CHANCE, SKETCHES, SENT, PARTS = 0.05, 4, 20_000, 64

SPAN = "struct<start:int,rank:int,kind:string,end:int>"
NEAR = "struct<value:string,term:string,start:int,end:int,around:binary>"
FOUND = f"doc_id long, print binary, base array<{SPAN}>, near array<{NEAR}>, values array<string>, "
FOUND += "levels array<struct<value:string,level:string>>, text string"
_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
_LEVEL = pa.struct([("value", pa.string()), ("level", pa.string())])
_NEAR = pa.struct(
    [("value", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("around", pa.binary())]
)


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    doubled = [2 * d - 9 * (d > 4) for d in values[1::2]]
    return (sum(values[::2]) + sum(doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` outwards, which takes one pass whatever the text."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, end) of the fixed patterns, by start and then kind."""
    found = []
    if "@" in text:
        found += [(a, 0, "email", b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [
            (m.start(), 1, "ip", m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))
        ]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            found += [(m.start(), 3, "phone", m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def levels(kind: str, value: str) -> list[str]:
    """What a value shares with others: host and words of an address, network, number without its last digits."""
    if kind == "email":
        name, _, host = value.partition("@")
        return ["host:" + host, *(f"name:{x}" for x in sorted(set(_NAME.findall(name))))]
    if kind == "ip":
        return ["network:" + value.rpartition(".")[0]]
    digits = _digits(value)
    return [f"{kind}-range:" + (digits[:8] if kind == "card" else digits[:-4])]


def _near(text: str, spans: list[tuple[int, int, str, int]]) -> list[dict]:
    """The words beside each span that touch no span."""
    out, starts, reached = [], [a for a, *_ in spans], []
    for *_, b in spans:
        reached.append(max(b, reached[-1] if reached else 0))

    def touches(a: int, b: int) -> bool:
        before = bisect_right(starts, b - 1)
        return before > 0 and reached[before - 1] > a

    for start, _, kind, end in spans:
        begin = max(0, start - NEAR_CHARACTERS)
        left = [m.span() for m in _WORD.finditer(text, begin, start) if begin == 0 or m.start() > begin]
        right = [m.span() for m in _WORD.finditer(text, end, min(len(text), end + NEAR_CHARACTERS))]
        words = left[-NEAR_WORDS:] + right[:NEAR_WORDS]
        around = hashlib.blake2b(" ".join(text[a:b] for a, b in words).encode("utf-8", "replace"), digest_size=12).digest()
        value = f"{kind}:{text[start:end].lower()}"
        for a, b in words:
            word = text[a:b]
            a, b = a + len(word) - len(word.lstrip(_EDGE)), b - len(word) + len(word.rstrip(_EDGE))
            if b - a >= LEAST_LETTERS and not touches(a, b):
                out.append({"value": value, "term": text[a:b].lower(), "start": a, "end": b, "around": around})
    return out


def _terms(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) of the words of a text that touch none of ``spans``, which are sorted by start."""
    i, taken = 0, 0
    for m in _WORD.finditer(text):
        word = m[0]
        a, b = m.end() - len(word.lstrip(_EDGE)), m.start() + len(word.rstrip(_EDGE))
        if b - a < LEAST_LETTERS:
            continue
        while i < len(spans) and spans[i][0] < b:
            taken = max(taken, spans[i][1])
            i += 1
        # A span that began before the word's end and ends behind its start touches it.
        if taken <= a:
            yield a, b, text[a:b].lower()


def _sketch(text: str) -> list[int]:
    """For each min-hash of the text's runs of three words, a bit of 64."""
    words = hashed_words([w.encode("utf-8", "replace") for w in _WORD.findall(text.lower())])
    runs = grams(words, min(3, max(len(words), 1)))
    seeds = np.arange(1, SKETCHES + 1, dtype=np.uint64) * PRIME
    least = [mixed(runs ^ seed).min() if len(runs) else np.uint64(0) for seed in seeds]
    bits = np.uint64(1) << (mixed(np.array(least, np.uint64)) >> np.uint64(58))
    return bits.view(np.int64).tolist()


def found(docs: DataFrame) -> DataFrame:
    """doc_id, a print of the text, the fixed patterns' spans and the words beside them, of every row.

    Rows that hold a value have their different values, what these share with others and their text too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, base, near, values, shared, texts = [], [], [], [], [], [], []
            for doc_id, text in documents_of(batch, "doc_id", "text"):
                text = text or ""
                spans = base_spans(text)
                ids.append(doc_id)
                prints.append(_print(text))
                base.append([dict(zip(("start", "rank", "kind", "end"), s, strict=True)) for s in spans])
                near.append(_near(text, spans))
                own = sorted({(kind, text[a:b].lower()) for a, _, kind, b in spans})
                values.append([f"{kind}:{v}" for kind, v in own])
                shared.append([{"value": f"{kind}:{v}", "level": x} for kind, v in own for x in levels(kind, v)])
                texts.append(text if spans else None)
            arrays = [pa.array(ids, pa.int64()), pa.array(prints, pa.binary())]
            arrays += [pa.array(base, pa.list_(_SPAN)), pa.array(near, pa.list_(_NEAR))]
            arrays += [pa.array(values, pa.list_(pa.string())), pa.array(shared, pa.list_(_LEVEL)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "print", "base", "near", "values", "levels", "text"])

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def _print(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode("utf-8", "replace"), digest_size=16).digest()


def _print_place(mark: bytes) -> int:
    return int.from_bytes(mark[:3], "big") >> (24 - PRINT_BITS)


def distinct_texts(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Each different text once (column text); ``prints`` holds the print of every row.

    A bit per hash of a repeated print goes to every task (a fixed 128 KB). Rows whose bit is not set
    are the only ones of their text and stay where they are; only the others are shuffled.
    """
    ship_package(docs.sparkSession)
    repeated = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = sorted({_print_place(p) for p in batch.column(0).to_pylist()})
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64())], ["place"])

    bits = np.zeros(1 << PRINT_BITS, bool)
    bits[repeated.select("print").mapInArrow(codes, "place long").distinct().toArrow().column(0).to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def part(again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            many = np.unpackbits(shared.value).astype(bool)
            for batch in batches:
                marks = [_print(t) for t in batch.column(0).to_pylist()]
                chosen = pa.array([bool(many[_print_place(m)]) == again for m in marks], pa.bool_())
                rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], ["text", "print"])
                yield rows.filter(chosen)

        return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "text string, print binary")

    return part(False).unionByName(part(True).dropDuplicates(["print"])).select("text")


class _Terms(dict):
    """For a word of a lowered text, as bytes, its term if one of the wanted may be meant, else None."""

    LIMIT = 300_000

    def __init__(self, packed: bytes):
        super().__init__()
        self.packed = packed

    def __missing__(self, word: bytes) -> str | None:
        if len(self) >= self.LIMIT:
            self.clear()
        term = word.strip(_EDGE_BYTES)
        place = xxhash.xxh3_64_intdigest(term) >> (64 - FILTER_BITS)
        meant = term.decode("utf-8") if self.packed[place >> 3] >> (7 - (place & 7)) & 1 else None
        if len(word) <= 64:
            self[word] = meant
        return meant


def _places(terms: list[str]) -> np.ndarray:
    hashes = hashed_words([t.encode("utf-8", "replace") for t in terms])
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int32)


def frequencies(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many rows of ``texts`` each of ``terms`` (a column term) stands.

    A bit per hash of a wanted term goes to every task (a fixed 512 KB), which then counts little else.
    """
    wanted = terms.select("term").distinct()
    ship_package(wanted.sparkSession)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(_places(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32())], ["place"])

    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[wanted.mapInArrow(codes, "place int").distinct().toArrow().column(0).to_numpy()] = True
    shared = wanted.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_of, counts = _Terms(shared.value), Counter()
        some = any(shared.value)
        for batch in batches:
            for text in batch.column(0).to_pylist() if some else ():
                # Bytes are split at the blanks of _WORD.
                words = set((text or "").lower().encode("utf-8", "replace").split())
                meant = set(map(term_of.__getitem__, words))
                meant.discard(None)
                counts.update(meant)
                if len(counts) > 200_000:
                    yield _told(counts)
                    counts.clear()
        yield _told(counts)

    counted = texts.select(F.col("text").cast("string")).mapInArrow(run, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term")).join(wanted, "term", "left_semi")


def _told(counts: Counter) -> pa.RecordBatch:
    columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["term", "n"])


def _total(rows: DataFrame) -> float:
    return float(max(rows.select("print").distinct().count(), 1))


def _beside(rows: DataFrame, least: int) -> DataFrame:
    """value, term, n_both and n_value over the distinct surroundings of the values of ``rows``."""
    near = rows.select(F.explode("near").alias("x")).select("x.value", "x.term", "x.around").distinct()
    values = near.select("value", "around").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_value"))
    pairs = near.groupBy("value", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= least)
    return pairs.join(values, "value")


def _shares(pairs: DataFrame, total: float, generalise: float) -> DataFrame:
    """value, term, share where it reaches ``generalise``; ``pairs`` has n_both, n_value, n_term and n_of.

    ``n_of`` texts hold the value whose information is asked for, ``n_value`` texts what the term stands by.
    """
    information = F.log2(total / F.col("n_of"))
    mutual = F.log2(F.col("n_both") * total / (F.col("n_value") * F.greatest("n_term", "n_both")))
    share = pairs.withColumn("share", F.when(information > 0, mutual / information))
    return share.where(F.col("share") >= generalise).select("value", "term", "share")


def revealing(docs: DataFrame, rows: DataFrame, generalise: float, least: int) -> DataFrame:
    """(value, term, share): terms beside a value that give away at least ``generalise`` of its information.

    ``rows`` is ``found(docs)``, stored. Only pairs with ``least`` different surroundings can be told from chance.
    """
    pairs = stored(_beside(rows, least).withColumn("n_of", F.col("n_value")), "pii-pairs")
    known = pairs.join(frequencies(distinct_texts(docs, rows), pairs), "term")
    return _shares(known, _total(rows), generalise)


def protected(rows: DataFrame, total: float, generalise: float) -> DataFrame:
    """value, n_value, n_of: what terms are held against over whole texts.

    These are the values of several texts and the levels of such, unless a level is so frequent that no term
    could tell ``generalise`` of a value through it (``n_of``: texts of its most frequent value). Of those
    that stand in the same texts only the first is kept, as all terms stand alike by them; a text with many
    values then meets its terms once for each different set of texts.
    """
    texts = rows.where(F.size("values") > 0)
    values = texts.select(F.explode("values").alias("value"), "print").distinct().withColumn("copy", F.xxhash64("print"))
    values = values.withColumn("other", F.xxhash64("print", F.lit(1)))
    marks = [F.count(F.lit(1)).alias("n_value"), F.bit_xor("copy").alias("copy"), F.bit_xor("other").alias("other")]
    single = values.groupBy("value").agg(*marks)
    levels = texts.select(F.explode("levels").alias("x"), "print").select("x.value", "x.level", "print").distinct()
    most = levels.select("value", "level").distinct().join(single.select("value", "n_value"), "value")
    most = most.groupBy("level").agg(F.max("n_value").alias("n_of"))
    wide = levels.select("level", "print").distinct().withColumn("copy", F.xxhash64("print"))
    wide = wide.withColumn("other", F.xxhash64("print", F.lit(1))).groupBy("level").agg(*marks).join(most, "level")
    every = single.withColumn("n_of", F.col("n_value")).unionByName(wide.withColumnRenamed("level", "value"))
    able = (F.col("n_value") > 1) & (F.col("n_value") <= _frequent(total, generalise))
    return every.where(able).groupBy("n_value", "n_of", "copy", "other").agg(F.min("value").alias("value")).drop("copy", "other")


def _frequent(total: float, generalise: float) -> Column:
    """The most texts that a term or level may stand in to give away that share of a value of ``n_of`` texts."""
    return F.pow(F.lit(total), 1 - generalise) * F.pow(F.col("n_of").cast("double"), generalise) * (1 + 1e-9)


def _rarity(n: Column) -> Column:
    return F.ceil(2 * F.log2(n.cast("double"))).cast("int")


def _pairs(several: DataFrame, known: DataFrame) -> DataFrame:
    """value, term, n_both and evidence over whole texts, of pairs with more than one piece of evidence.

    ``several`` has text, base and ``asked`` (value and the greatest rarity of its terms). A byte per hash of a
    term, the least rarity there, goes to every task (a fixed 4 MB), so pairs that cannot pass are not sent.
    """
    marks = [f"m{k}" for k in range(SKETCHES)]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pa.array(_places(batch.column(0).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([places, batch.column(1)], ["place", "rarity"])

    rarities = known.select("term", _rarity(F.col("n_term")).alias("rarity")).mapInArrow(codes, "place int, rarity int")
    least = rarities.groupBy("place").agg(F.min("rarity").cast("byte").alias("rarity")).toArrow()
    table = np.full(1 << FILTER_BITS, 255, np.uint8)
    table[least.column(0).to_numpy()] = least.column(1).to_numpy()
    shared = several.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def sent() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * (2 + SKETCHES)
            types = [pa.string()] * 2 + [pa.int64()] * SKETCHES
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["value", "term", *marks])

        for batch in batches:
            for text, base, asked in documents_of(batch, "text", "base", "asked"):
                words = sorted({t for *_, t in _terms(text, [(x["start"], x["end"]) for x in base])})
                rarity = shared.value[_places(words)]
                order = np.argsort(rarity, kind="stable")
                rarity, sketch = rarity[order], _sketch(text)
                for x in asked:
                    for i in order[: np.searchsorted(rarity, min(x["most"], 254), "right")].tolist():
                        rows.append((x["value"], words[i], *sketch))
                        if len(rows) >= SENT:
                            yield sent()
                            rows.clear()
        yield sent()

    sent = several.select("text", "base", "asked").mapInArrow(
        run, ", ".join(["value string", "term string", *[f"{m} long" for m in marks]])
    )
    counted = sent.groupBy("value", "term").agg(F.count(F.lit(1)).alias("n_both"), *[F.bit_or(m).alias(m) for m in marks])
    # The second largest, as near copies differ in few of their min-hashes and other texts in nearly all.
    seen = F.array_sort(F.array(*[F.bit_count(m) for m in marks]))[SKETCHES - 2]
    return counted.select("value", "term", "n_both", seen.alias("evidence")).where(F.col("evidence") > 1)


def _holders(rows: DataFrame, values: DataFrame, total: float, generalise: float) -> tuple[DataFrame, DataFrame]:
    """The texts that hold a value, each once; and those with one of ``values``, as ``asked``."""
    holders = rows.where(F.size("values") > 0).select("print", "text", "base", "values", "levels")
    holders = stored(holders.dropDuplicates(["print"]).withColumn("values", _held()).drop("levels"), "pii-holders")
    asked = values.select("value", _rarity(_frequent(total, generalise)).alias("most"))
    asked = holders.select("print", F.explode("values").alias("value")).join(asked, "value")
    asked = asked.groupBy("print").agg(F.collect_list(F.struct("value", "most")).alias("asked"))
    return holders, stored(holders.select("print", "text", "base").join(asked, "print"), "pii-several")


def _held() -> Column:
    return F.array_union("values", F.transform("levels", lambda x: x["level"]))


def _words(several: DataFrame) -> DataFrame:
    """The terms that stand in two texts of ``several`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for text, base in documents_of(batch, "text", "base"):
                counts.update({t for *_, t in _terms(text, [(x["start"], x["end"]) for x in base])})
                if len(counts) > 200_000:
                    yield _told(counts)
                    counts.clear()
        yield _told(counts)

    counted = several.select("text", "base").mapInArrow(run, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("term")


def disclosing(several: DataFrame, values: DataFrame, known: DataFrame, total: float, generalise: float) -> DataFrame:
    """(value, term, share) over whole texts; ``known`` has the terms' n_term, ``values`` is ``protected``."""
    most = values.agg(F.max("n_of")).first()[0] or 1
    able = known.where(F.col("n_term") <= total ** (1 - generalise) * most**generalise * (1 + 1e-9))
    tested = max(able.count(), 1) * max(values.count(), 1)
    pairs = _pairs(several, able).join(able, "term").join(values, "value")
    times = F.col("n_both") * total / (F.col("n_value") * F.greatest("n_term", "n_both"))
    # -log of the Poisson tail at the evidence, where chance would bring 1 / times of it.
    tail = F.col("evidence") * (F.log(times) - 1 + 1 / times) + 0.5 * F.log(2 * np.pi * F.col("evidence"))
    return _shares(pairs.where((times > 1) & (tail >= float(np.log(tested / CHANCE)))), total, generalise)


def _everywhere(holders: DataFrame, reveal: DataFrame) -> DataFrame:
    """print, start, end and share of every place of a revealing term in the texts that hold its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, text, base, terms in documents_of(batch, "print", "text", "base", "terms"):
                shares = {}
                for t in terms:
                    shares[t["term"]] = max(shares.get(t["term"], 0.0), t["share"])
                hits = [(a, b, shares[t]) for a, b, t in _terms(text, [(x["start"], x["end"]) for x in base]) if t in shares]
                columns = list(zip(*hits, strict=True)) or [()] * 3
                arrays = [pa.array([mark] * len(hits), pa.binary())]
                arrays += [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["print", "start", "end", "share"])

    # A frequent value is dealt out by the print too.
    held = holders.select("print", F.explode("values").alias("value")).withColumn("part", _part())
    dealt = reveal.groupBy("value").agg(F.collect_list(F.struct("term", "share")).alias("terms"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    told = held.join(dealt, ["value", "part"]).groupBy("print").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return holders.join(told, "print").select("print", "text", "base", "terms").mapInArrow(
        run, "print binary, start int, end int, share double"
    )


def _part(*more: str) -> Column:
    return F.pmod(F.xxhash64("print", *more), F.lit(PARTS)).cast("int")


def scanned(
    docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, least: int = LEAST_SURROUNDINGS
) -> DataFrame:
    """doc_id, print, ``base`` and ``found`` (base and method) of every row: arrays of (start, rank, kind, end).

    Spans of the method have the kind ``term`` and the rank 4 (generalised) or 5 (removed). ``least`` is for
    terms counted beside the values. A null text is empty and has none. Repeated rows each have theirs; null
    ids stay. Other columns are ignored.
    """
    rows = stored(found(docs), "pii-found")
    total = _total(rows)
    beside = stored(_beside(rows, least).withColumn("n_of", F.col("n_value")), "pii-pairs")
    values = stored(protected(rows, total, generalise), "pii-values")
    holders, several = _holders(rows, values, total, generalise)
    wanted = stored(beside.select("term").unionByName(_words(several)).distinct(), "pii-wanted")
    known = stored(frequencies(distinct_texts(docs, rows), wanted), "pii-known")
    ways = disclosing(several, values, known, total, generalise)
    ways = ways.unionByName(_shares(beside.join(known, "term"), total, generalise))
    reveal = stored(ways.groupBy("value", "term").agg(F.max("share").alias("share")), "pii-reveal")
    hits = _everywhere(holders, reveal).groupBy("print", "start", "end").agg(F.max("share").alias("share"))
    rank = F.when(F.col("share") >= remove, len(KINDS) + 1).otherwise(len(KINDS))
    span = F.struct("start", rank.alias("rank"), F.lit(METHOD).alias("kind"), "end")
    more = hits.groupBy("print").agg(F.collect_list(span).alias("more"))
    # Copies of a text are dealt out by the row too.
    more = more.select(F.col("print").alias("of"), "more", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("at"))
    dealt = rows.select("doc_id", "print", "base").withColumn("part", _part("doc_id"))
    joined = dealt.join(more, (F.col("print") == F.col("of")) & (F.col("part") == F.col("at")), "left")
    none = F.array().cast(f"array<{SPAN}>")
    every = F.array_sort(F.concat("base", F.coalesce(F.col("more").cast(f"array<{SPAN}>"), none)))
    return joined.select("doc_id", "print", "base", every.alias("found"))


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and text with protected values and revealing terms replaced or removed.

    ``spans`` is ``scanned(docs)``. Values become their kind, generalised terms the class of their shape
    (name, number, word), removed terms nothing. Of overlapping spans the first one counts.
    """
    own = spans.groupBy("doc_id", "print").agg(F.first("found").alias("found"))
    own = own.select(F.col("doc_id").alias("id"), F.col("print").alias("of"), "found")
    ship_package(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            marks = [_print(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], ["doc_id", "text", "print"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = documents_of(batch, "text", "found")
            texts = [t and _replaced(t, spans or []) for t, spans in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = narrow.mapInArrow(prints, "doc_id long, text string, print binary")
    joined = marked.join(own, (F.col("print") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", "text", "found").mapInArrow(run, "doc_id long, text string")


def _replaced(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for s in spans:
        if s["start"] < at:
            at = max(at, s["end"])
            continue
        parts.append(text[at : s["start"]])
        if s["rank"] < len(KINDS):
            parts.append(f"[{s['kind']}]")
        elif s["rank"] == len(KINDS):
            parts.append(f"[{_shape(text[s['start'] : s['end']])}]")
        at = s["end"]
    return "".join([*parts, text[at:]])


def _shape(term: str) -> str:
    return "number" if any(c.isdigit() for c in term) else "name" if term[:1].isupper() else "word"


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
