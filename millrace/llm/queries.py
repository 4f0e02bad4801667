"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from millrace.llm.byte_bpe import op10_byte_bpe
from millrace.llm.decontam import op7_decontamination
from millrace.llm.licenses import op6_licenses
from millrace.llm.media import op3_media_columns
from millrace.llm.ngram_join import op4_ngram_join
from millrace.llm.quality import op8_quality
from millrace.llm.secrets import op5_secrets
from millrace.llm.token_records import op1_token_records
from millrace.llm.toxicity import op2_toxicity
from millrace.llm.warc import op9_warc

QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_toxicity": op2_toxicity,
    "op3_media_columns": op3_media_columns,
    "op4_ngram_join": op4_ngram_join,
    "op5_secrets": op5_secrets,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_byte_bpe": op10_byte_bpe,
}

#: SHA-1 in base32: five hexadecimal digits are four characters.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '')"

_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

_JOIN = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(p.n) + any_value(q.n) - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.y, reach.r FROM reach JOIN both_ways l ON l.x = reach.doc_id WHERE reach.r < l.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY 1, 2"""

ORACLE_SQL: dict[str, str] = {"op4_ngram_join": _JOIN, "op9_warc": _WARC}
