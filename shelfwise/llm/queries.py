"""The registered queries of the operators, each over its whole table, with check SQL where SQL has one."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from shelfwise.llm import checksql
from shelfwise.llm.common import table
from shelfwise.llm.decontaminate import contaminated
from shelfwise.llm.langid import identify_language
from shelfwise.llm.licenses import scan_licenses
from shelfwise.llm.lines import line_report
from shelfwise.llm.mixing import mix_sources
from shelfwise.llm.quality import judge_quality
from shelfwise.llm.sentencepieces import encode_texts
from shelfwise.llm.simhash import near_duplicates
from shelfwise.llm.spelling import group_spellings
from shelfwise.llm.substrings import dedup_substrings
from shelfwise.llm.suffixes import dedup_suffixes
from shelfwise.llm.trie import prefix_trie, rebuilt
from shelfwise.llm.warc import warc_round_trip

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op9_warc", """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""")
def op9_warc(spark, sf_dir):
    return warc_round_trip(spark, table(spark, sf_dir, "pages"))


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    return identify_language(table(spark, sf_dir, "documents"))


@query("op6_mixing", checksql.MIXING)
def op6_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op1_line_dedup", checksql.LINES)
def op1_line_dedup(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))


@query("op3_license_scan", checksql.LICENSES)
def op3_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"), whole_texts=True)


@query("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_simhash", checksql.SIMHASH)
def op8_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS shingle
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY 1),
m AS (SELECT d.doc_id, s.item_id, count(*) AS n_shared
  FROM (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)) d
  JOIN s USING (shingle) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
""")
def op10_decontamination(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key").distinct()


@query("op2_substring_dedup", checksql.SUBSTRINGS)
def op2_substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


@query("op7_suffix_dedup", checksql.SUFFIXES)
def op7_suffix_dedup(spark, sf_dir):
    return dedup_suffixes(table(spark, sf_dir, "documents")).drop("kept")


@query("op11_sentencepiece")
def op11_sentencepiece(spark, sf_dir, model_path=None):
    coded = encode_texts(table(spark, sf_dir, "documents"), model_path or public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op12_prefix_trie", """
WITH RECURSIVE c AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, CAST(conv_id AS VARCHAR) AS t FROM conversations
  WHERE conv_id IS NOT NULL GROUP BY ALL),
byte AS (SELECT range AS b FROM range(256)),
crc_table AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY b) AS k FROM byte),
h AS (SELECT conv_id, donor, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(t) + 1), lambda i: CAST(ascii(t[i]) AS BIGINT))),
    lambda x, y: xor(x >> 8, k[xor(x & 255, y) + 1])), 4294967295) % 9 AS h FROM c, crc_table),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.conv_id, o.pos, o.role, o.text FROM h JOIN o ON o.conv_id = h.donor AND o.pos <= h.h
  UNION ALL SELECT h.conv_id, 1000000000 + o.pos, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id AND o.pos > h.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, role, text FROM r),
path AS (SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS path, '' AS parent, CAST(0 AS BIGINT) AS bytes FROM c
  UNION ALL
  SELECT p.conv_id, s.depth, md5(p.path || length(s.role) || ':' || s.role || s.text), p.path, octet_length(encode(s.text))
  FROM path p JOIN s ON s.conv_id = p.conv_id AND s.depth = p.depth + 1),
n AS (SELECT depth, path, any_value(parent) AS parent, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs
  FROM path GROUP BY 1, 2),
e AS (SELECT p.depth, p.path, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids
  FROM path p JOIN (SELECT conv_id, max(depth) AS depth FROM path GROUP BY 1) USING (conv_id, depth) GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, path)),
under AS (SELECT depth, path, depth AS top_depth, path AS top FROM m
  UNION ALL SELECT m.depth, m.path, u.top_depth, u.top FROM under u JOIN m ON m.depth = u.depth + 1 AND m.parent = u.path),
t AS (SELECT top_depth AS depth, top AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM under JOIN m USING (depth, path) GROUP BY 1, 2)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, t.n_leaves,
  CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM m JOIN t USING (depth, path) LEFT JOIN e USING (depth, path) LEFT JOIN n u ON u.depth = m.depth - 1 AND u.path = m.parent
""")
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


@query("op13_spelling", checksql.SPELLINGS)
def op13_spelling(spark, sf_dir):
    return group_spellings(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
