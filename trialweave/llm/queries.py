"""The registered query of each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


_ODD_CHAT = "</s>[INST] ok [/INST]"
_ESC = (
    r"regexp_replace(regexp_replace({0}, '<(\\*)(\||/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"
)


@query("op3_chat_formatting", rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_ODD_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{_ODD_CHAT}'
), placed AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k,
         {_ESC.format('role')} AS role_out, {_ESC.format('text')} AS text_out
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text_out) + CASE WHEN before = role THEN length('<|next|>')
            ELSE length('<|turn|><|text|><|end|>') + length(role_out) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
""")
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_digest, format_chats

    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_ODD_CHAT).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(format_chats(turns.unionByName(odd)))


@query("op4_warc", """
WITH paid AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), last AS (SELECT hex, max(page_id) AS last FROM paid GROUP BY hex)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)
         FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM paid JOIN last USING (hex)
""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    archives = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(archives, with_payload=False).drop("url")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_ngram_jaccard_join", rf"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1
), worded AS (
  SELECT first_id AS t, copies, {_WORDS} AS w FROM texts
), grams AS (
  SELECT DISTINCT t, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT t, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
), sizes AS (SELECT t, count(*) AS n FROM grams GROUP BY t
), common AS (
  SELECT a.t AS x, b.t AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.t <> b.t GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.t = x JOIN sizes q ON q.t = y WHERE 5 * c >= 4 * (p.n + q.n - c)
), reach AS (
  SELECT t AS x, t AS y FROM worded UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), groups AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x
), counted AS (SELECT x, CAST(sum(copies) AS BIGINT) AS links FROM links JOIN worded ON t = y GROUP BY x)
SELECT d.doc_id, CASE WHEN len(w) > 0 THEN class_id ELSE d.doc_id END AS class_id,
       CASE WHEN len(w) > 0 THEN s.copies - 1 + coalesce(links, 0) ELSE 0 END AS n_links
FROM documents d JOIN texts s ON s.text = coalesce(d.text, '') JOIN worded ON t = first_id
JOIN groups ON groups.x = first_id LEFT JOIN counted ON counted.x = first_id
""")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


@query("op6_benchmark_decontamination", rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), starts AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows)
), met AS (
  SELECT DISTINCT starts.r, i, starts.size, item_id FROM starts JOIN docs USING (r)
  JOIN windows ON windows.size = starts.size AND g = array_to_string(w[i : i + starts.size - 1], ' ')
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM met) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
""")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = train_toxicity(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_language, train_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train_language(docs.filter(~held_out).select("text", "lang"))
    found = docs.select("doc_id", held_out.alias("held_out"), identify_language(docs, model).alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score")


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op8_nearest_neighbours")
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutation_index import permutation_search

    return permutation_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


_URL_RULES = """VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')"""


@query("op11_url_filter", rf"""
WITH rules(verdict, host, path) AS ({_URL_RULES}
), rest AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), fitting AS (
  SELECT r, rules.verdict, rules.host || rules.path AS rule, row_number() OVER (
           PARTITION BY r ORDER BY length(rules.host) + length(rules.path) DESC, length(rules.host) DESC, rules.verdict DESC) AS k
  FROM split JOIN rules ON (split.host = rules.host OR ends_with(split.host, '.' || rules.host)) AND starts_with(split.path, rules.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fitting ON split.r = fitting.r AND k = 1
""")
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    rules = spark.sql(f"SELECT * FROM ({_URL_RULES}) AS rules(verdict, host, path)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_source_divergence", r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), each AS (SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS total FROM each GROUP BY ALL HAVING count(DISTINCT r) >= 10
), langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM docs
), cells AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL
), filled AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (total + 2) // (lang_n + 2 * v) AS q
  FROM filled JOIN langs USING (lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
), parts AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))
