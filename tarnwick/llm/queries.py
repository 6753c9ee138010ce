"""The queries opN_* over the generated tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curriculum, divergence, fingerprint, langid, lexical, license_scan, lm_score, near_dup, packing, pieces, quality, scratch, secrets, suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scratch.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = scratch.mark()
    found = lexical.search(lexical.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))
    scratch.drop_since(scope, found)
    return found


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mixed_by_position(_table(spark, sf_dir, "documents"))


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of op13, which SQL can express."""
    return op13_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken")


def llm_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds' counts of op5, which SQL can express."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def llm_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of op7, which SQL can express."""
    return op7_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def llm_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op10, which SQL can express."""
    return quality.rule_statistics(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


def queries() -> dict[str, Query]:
    return {
        "llm_secret_counts": llm_secret_counts,
        "llm_edited_texts": llm_edited_texts,
        "llm_rule_counts": llm_rule_counts,
        "llm_mix_targets": llm_mix_targets,
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_secret_scan": op5_secret_scan,
        "op6_lm_scores": op6_lm_scores,
        "op7_fingerprints": op7_fingerprints,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_language_id": op9_language_id,
        "op10_quality_rules": op10_quality_rules,
        "op11_lexical_search": op11_lexical_search,
        "op12_source_divergence": op12_source_divergence,
        "op13_source_mix": op13_source_mix,
    }


SECRETS_SQL = r"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
    len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

EDITED_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS a, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS b FROM documents)
    SELECT doc_id, length(a) AS n_chars, sha256(left(a, length(a) - length(a) // 3) || left(b, length(a) // 3)) AS edited_sha256 FROM t"""

RULES_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM t WHERE len(w) > 2), g3 AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM g),
    many AS (SELECT doc_id, i FROM g3 QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1), marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM many, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t), dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
    c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN marked USING (doc_id))
    SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.oracle(), "op11_lexical_search": lexical.oracle(), "op12_source_divergence": divergence.oracle(), "llm_mix_targets": curriculum.oracle(), "llm_secret_counts": SECRETS_SQL, "llm_edited_texts": EDITED_SQL, "llm_rule_counts": RULES_SQL}
