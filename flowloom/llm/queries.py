"""The registered query of each operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import chat, decontaminate, languages, licenses, matroska, mixing, simhash, tokens, url_filter, warc
from flowloom.llm.columns import table
from flowloom.storage import materialize, scratch_path


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


ALLOW_RULES = ["com/", "www.example.com/en/"]
BLOCK_RULES = ["example.com/en/", "net/es/", "net/fr/"]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), ALLOW_RULES, BLOCK_RULES)


def op4_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(
        r"""SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text
        FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)"""
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_conversations(turns), in_order=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(matroska.to_media(table(spark, sf_dir, "documents")))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    whole = materialize(warc.reassemble(warc.read_archives(spark, path), with_payload=False), "warc-records")
    rows = warc.checked_revisits(whole)
    digest = F.when(F.col("error").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat_ws(": ", "record_id", "error")))
    return rows.select(
        warc.page_of("record_id").alias("page_id"),
        "payload_bytes",
        digest.alias("payload_digest"),
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.train(docs.filter("doc_id IS NOT NULL").filter(~languages.held_out()))
    found = languages.identify(docs, model)
    return found.select("doc_id", languages.held_out().alias("held_out"), "lang_pred", "score")


_QUERIES = (
    op1_mix_sources,
    op2_simhash_neardup,
    op3_url_filter,
    op4_chat_prefix_targets,
    op5_token_counts,
    op6_benchmark_leaks,
    op7_matroska_media,
    op8_warc_segments,
    op9_license_scan,
    op10_language_mixture,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _places(phrase: str, label: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1))
    return f"SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: {same})) AS pos, '{label}' AS label FROM d"


def _templates() -> str:
    rows = (f"({[' '.join(w.decode() for w in x) for x in sorted(t.tokens)]}, {t.need}, {t.size}, {t.alike}, '{t.label}')" for t in licenses.prepared(licenses.TEMPLATES, 0.8))
    return ", ".join(rows)


_BY_LENGTH = sorted(ALLOW_RULES + BLOCK_RULES, key=len, reverse=True)

SQL: dict[str, str] = {
    "op3_url_filter": f"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a
), c AS (
  SELECT page_id, translate(coalesce(h, ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path
  FROM b
), d AS (
  SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in _BY_LENGTH)} END AS rule FROM c
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({", ".join(f"'{r}'" for r in BLOCK_RULES)}) THEN 'block' ELSE 'allow' END AS verdict
FROM d""",
    "op4_chat_prefix_targets": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, role = 'assistant' AS target, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
    length(role) + length(text) + 14
    + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM o
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (target), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (target), '')) AS loss_sha256,
  sum(CASE WHEN target OR rn = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id""",
    "op8_warc_segments": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) || '0' AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY h) AS last,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, (5 * i // 4)::INT + 1, 2))::INT >> (3 - (5 * i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d""",
    "op9_license_scan": f"""
WITH d AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_WORDS}') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
), places AS (
  {" UNION ALL ".join(_places(p, x) for p, x in licenses.PHRASES.items())}
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS found FROM places GROUP BY doc_id
), templates AS (
  SELECT * FROM (VALUES {_templates()}) v(tokens, need, size, alike, label)
), pairs AS (
  SELECT doc_id, len(w) AS n, CASE len(w) WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS p FROM d WHERE len(w) > 0
), numbered AS (
  SELECT doc_id, p, size, unnest(range(greatest((n - 1) // (size // 2), 1))) AS k FROM pairs, (SELECT DISTINCT size FROM templates)
), blocks AS (
  SELECT doc_id, size, k, list_distinct(p[k * (size // 2) + 1 : k * (size // 2) + size - 1]) AS b FROM numbered
), shares AS (
  SELECT doc_id, k, label, alike, need, len(tokens) AS n, len(list_intersect(b, tokens)) AS shared FROM blocks JOIN templates USING (size)
), matches AS (
  SELECT *, 2 * shared - n AS closeness FROM shares WHERE shared >= need
), closest AS (
  SELECT * FROM matches m WHERE NOT EXISTS (
    SELECT 1 FROM matches o WHERE o.doc_id = m.doc_id AND o.alike = m.alike AND abs(o.k - m.k) <= 1 AND o.closeness > m.closeness)
), own AS (
  SELECT doc_id, list(DISTINCT label) AS found, max(shared / n) AS share FROM closest GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.found), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.found, []), coalesce(own.found, [])))), ',') AS labels,
  (CASE WHEN n_base > 0 THEN 1 ELSE coalesce(own.share, 0) END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)""",
}
