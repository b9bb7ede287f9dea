"""The operators of this folder as queries over the whole test tables, and their SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etalase.llm import (
    byte_bpe,
    decontamination,
    hard_negatives,
    jaccard_join,
    lm_scoring,
    packing,
    pii,
    quality_crf,
    quality_rules,
    secret_scans,
    spelling,
    toxicity,
    url_filters,
)
from etalase.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(folds: int) -> Column:
    return (fold(F.col("doc_id"), folds) == 0).alias("held_out")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scoring.scored(table(spark, sf_dir, "documents"))
    return scores.select(
        "doc_id",
        (F.col("fold") == lm_scoring.HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learnable(5))
    scores = toxicity.scored(docs, model)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scores.select("doc_id", held_out(5), "score", predicted)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "action"), r, strict=True)]) for r in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*rows)))
    return url_filters.judged(table(spark, sf_dir, "pages"), rules)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    scores = quality_crf.scored(docs, model)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scores.select("doc_id", held_out(5), "score", predicted)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = secret_scans.scanned(docs.select("doc_id", "text"), secret_scans.train(docs))
    counts = [counted("base", kind).alias(f"n_{kind}") for kind, *_ in secret_scans.KINDS]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(secret_scans.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scans.listed(F.col("found")).alias("spans"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.scanned(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        *[counted("base", kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("found")).alias("spans"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=97)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encoded(docs, path, public_tokenizers.PATTERN, coarse=byte_bpe.STRETCHES, plain=byte_bpe.LETTERS)
    back = byte_bpe.decoded(
        coded.select(
            "doc_id",
            F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
            "ids",
        ),
        path,
    )
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    number = lambda x: x.cast("double")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(256 * number(x)))
    vectors = rows.where(finite).select(F.col("vec_id").alias("id"), moved.alias("label"), whole.alias("vector"))
    return hard_negatives.mined(vectors, F.col("id") % 50 == 0)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in [
        op1_jaccard_join,
        op2_lm_scoring,
        op3_decontamination,
        op4_toxicity,
        op5_url_filters,
        op6_quality_rules,
        op7_packing,
        op8_quality_classifier,
        op9_secret_scans,
        op10_pii,
        op11_spelling_variants,
        op12_byte_bpe,
        op13_hard_negatives,
    ]
}

_BLANK = r"[\x20\x09-\x0D]"

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

ORACLE: dict[str, str] = {
    # Shingles as lists of words, shared shingles counted by a join, groups by a recursive query.
    "op1_jaccard_join": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '{_BLANK}+'), lambda w: w <> '') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)),
                lambda i: array_to_string(w[i:least(i + 4, len(w))], ' '))) AS shingle
            FROM words WHERE len(w) > 0
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY ALL
        ), links AS (
            SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
            WHERE 100 * shared >= 75 * (x.n + y.n - shared)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN sizes s USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
    """,
    "op5_url_filters": rf"""
        WITH cut AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), rules(rule_host, rule_path, action) AS (VALUES {_RULES}
        ), fits AS (
            SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                max_by(action, length(rule_host || rule_path)) AS action
            FROM cut JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM cut LEFT JOIN fits USING (page_id)
    """,
    # Runs of five words as rows; covered words counted once each.
    "op6_quality_rules": rf"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS t,
                list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda w: w <> '') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), runs AS (
            SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS run
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut)
        ), twice AS (SELECT doc_id, run FROM runs GROUP BY ALL HAVING count(*) > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n
            FROM runs JOIN twice USING (doc_id, run) CROSS JOIN range(5) r(k) GROUP BY doc_id
        ), counted AS (
            SELECT doc_id, len(w) AS n_words,
                CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS n_symbols,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
                len(lines) AS n_lines,
                len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({_STOPS}))) AS stops,
                len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS loud
            FROM cut LEFT JOIN covered USING (doc_id)
        ), failed AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.2
                AND stops / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.35 AND loud / n_words <= 0.4 AS kept
        FROM failed
    """,
}
