"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import in_fold
    from .toxicity import toxicity, train

    docs, held_out = table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 5, 0)
    net = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data, span_text

    found = span_text(personal_data(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_generalised", "n_removed", "sanitised_sha256")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .secret_scan import candidates, dictionary, issued_labels, judged

    found = candidates(table(spark, sf_dir, "documents"), dictionary(public_tokenizers.path("piece_bpe_32k.model")), path_col="source")
    judgement = judged(found, issued_labels(F.col("value")))
    return judgement.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hexadecimal, simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(found.fp).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import corpus_mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return corpus_mix(docs).select("doc_id", "n_tokens", F.round("cell_weight", 6).alias("cell_weight"), F.round("probability", 6).alias("probability"), "sampled")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .language_id import in_fold, predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = train(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    crc = F.crc32(F.coalesce("text", F.lit("")))  # before the rows are dealt, so that texts need not travel
    found = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text", crc.alias("text_crc32")), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
RANKED = f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id), whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, n_docs),
items AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark), m AS (SELECT doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM n, whole),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM items JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranks AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0) SELECT * FROM ranks WHERE rank <= 10"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import audits, damaged

    turns = table(spark, sf_dir, "conversations")
    found = audits(turns, damaged(turns))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


# Parts of the operators that SQL can say, with their SQL.

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
MEASURES = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, w FROM t), windows AS (SELECT doc_id, k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c FROM places),
twice AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m"""


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
DIGIT = f"CAST({DIGITS}[length({DIGITS}) - k + 1] AS INT)"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN {DIGIT} WHEN {DIGIT} > 4 THEN 2 * {DIGIT} - 9 ELSE 2 * {DIGIT} END)) % 10 = 0"
PATTERNS = f"""SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT), 256) > 255)) = 0)) AS BIGINT) AS n_ip,
CAST(len(list_filter(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN})) AS BIGINT) AS n_card,
CAST(len(list_filter(regexp_extract_all(t, '\\+[0-9][ ().0-9-]+[0-9]'), lambda x: length({DIGITS}) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


CELLS = f"""SELECT source, lang, CASE WHEN contains(text, ' | ') THEN 'tables' WHEN contains(text, '@') THEN 'contacts' WHEN regexp_matches(text, '[0-9]{{9}}') THEN 'figures'
WHEN regexp_matches(text, '(?i)licen[cs]e|copyright') THEN 'notices' ELSE 'prose' END AS topic, CAST(sum(len({WORDS})) AS BIGINT) AS n_tokens FROM (SELECT source, lang, coalesce(text, '') AS text FROM documents) GROUP BY ALL"""


def mix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import cells_of, topic

    docs = table(spark, sf_dir, "documents")
    return cells_of(docs, {"source": docs["source"], "lang": docs["lang"], "topic": topic(docs["text"])})


BALANCE = "SELECT count(*) AS n_docs, CAST(sum(strlen(coalesce(text, '')) + 16) AS BIGINT) AS bytes, CAST(40 AS BIGINT) AS n_shards, true AS even, true AS gapless FROM documents"


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law promises: sizes differ by the largest row at most, slots have no gaps."""
    found = op10_sharding(spark, sf_dir)
    by_shard = found.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots"))
    even = F.max("bytes") - F.min("bytes") <= 2 * F.max("largest")
    gapless = F.bool_and((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n")))
    return by_shard.agg(F.sum("n").alias("n_docs"), F.sum("bytes").alias("bytes"), F.count("*").alias("n_shards"), even.alias("even"), gapless.alias("gapless"))


#: The whole results of these, and parts of the others'.
WHOLE = {op11_ranked_search: RANKED}
PARTS = {quality_measures: MEASURES, pattern_counts: PATTERNS, mix_cells: CELLS, shard_balance: BALANCE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_decontamination, op3_toxicity, op4_personal_data, op5_secret_scan, op6_simhash_components, op7_token_counts, op8_mixing, op9_language_id, op10_sharding, op11_ranked_search, op12_bpe_coding, op13_conversation_repair)
    return {f.__name__: f for f in (*found, *PARTS)}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in (WHOLE | PARTS).items()}
