"""The registered queries of the corpus operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.llm.chat import MARK, format_digests, formatted, gathered, with_turns
from fieldlake.llm.common import held_back, table
from fieldlake.llm.decontaminate import find_leaks
from fieldlake.llm.divergence import divergence
from fieldlake.llm.language import identify, train
from fieldlake.llm.line_dedup import dedup_lines
from fieldlake.llm.minhash import duplicate_classes
from fieldlake.llm.mixing import mix_sources
from fieldlake.llm.multi_index import linked_vectors
from fieldlake.llm.periodic import run_digests, with_planted_runs
from fieldlake.llm.personal import personal_digests
from fieldlake.llm.quality import quality_scores
from fieldlake.llm.secrets import secret_digests
from fieldlake.llm.warc import archive_pages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, r.first_id IS NOT NULL AND k.doc_id <> r.first_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_ESCAPED = f"""regexp_replace(replace(text, '{MARK}', '{MARK}{MARK}'),
  '(<)(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|\\|system\\|>|\\|user\\|>|\\|assistant\\|>|\\|end\\|>|\\|eot_id\\|>|\\|begin_of_text\\|>|\\|start_header_id\\|>|\\|end_header_id\\|>|s>|/s>|<SYS>>|</SYS>>)|(\\[)(/?INST\\])',
  '\\1\\3{MARK}\\2\\4', 'g')"""


@query(f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length({_ESCAPED}) + 24) AS BIGINT) AS formatted_chars, 'turns' AS layout
FROM t GROUP BY conv_id
""")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(said).alias("text"),
    )
    records = gathered(rows.unionByName(more))
    return format_digests(formatted(with_turns(records, ignore=("conv_id",))))


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("target_uri")


@query()
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item that it leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query()
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class, and the first document with the same words."""
    return duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = held_back("doc_id", 4)
    model, calibration = train(docs.filter(part != 2), "text", "lang")
    found = identify(docs.withColumn("held_out", part == 2), model, calibration, keep=["doc_id", "held_out"])
    return found.withColumnsRenamed({"lang_score": "score", "lang_rejected": "rejected"}).drop("lang_entropy")


@query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query("""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), o AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
x AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN x USING (lang, source, term)),
w AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
      FROM c JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM w JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
        CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e)
SELECT * FROM z WHERE part = 'pair' OR rank <= 50
""")
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query()
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
