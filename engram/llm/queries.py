"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engram.llm.decontamination import op1_benchmark_hits
from engram.llm.html import op9_main_text
from engram.llm.langid import op8_language_id
from engram.llm.licenses import op3_license_scan
from engram.llm.media import op6_media_digest
from engram.llm.mixing import op2_source_mix
from engram.llm.ngram_join import op7_ngram_components
from engram.llm.pii import op10_personal_data
from engram.llm.sharding import op5_rendezvous_shards
from engram.llm.tokens import op4_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_benchmark_hits,
        op2_source_mix,
        op3_license_scan,
        op4_token_counts,
        op5_rendezvous_shards,
        op6_media_digest,
        op7_ngram_components,
        op8_language_id,
        op9_main_text,
        op10_personal_data,
    )
    return {f.__name__: f for f in operators}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows as strings; a document's runs of the same numbers of words are looked up among them.
_OP1 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i+least(10, len(w))-1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w)-9)+1)) AS i FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT n FROM win), runs AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM d, sizes WHERE len(w) >= n)),
 hits AS (SELECT doc_id, i, r.n, item FROM runs r JOIN win USING (n, win)),
 places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS p FROM hits) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: All pairs that share a shingle, and the closure of those that link.
_OP7 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w)-1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS s FROM w),
 e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p WHERE 100*c >= 90*(na+nb-c)), g AS (FROM l UNION SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.other = g.a)
 SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(other) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s"""


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_hits": _OP1, "op7_ngram_components": _OP7}
