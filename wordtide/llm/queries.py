"""The registered queries of this subpackage, op<N>_<name>, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .exact_topk import exact_top
from .language_id import identify
from .lexical_search import rank_documents
from .mixing import mix
from .ngram_join import ngram_link_counts
from .packing import pack
from .permutation_index import nearest
from .suffix_dedup import dedup_digest
from .token_counts import token_counts
from .token_files import token_file_digest
from .url_filters import judge_urls
from .warc import warc_digest


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), count="bpe", topics="terms")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_permutation_index": op4_permutation_index,
    "op5_mixing": op5_mixing,
    "op6_exact_topk": op6_exact_topk,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_url_filters": op10_url_filters,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e2.b, r.c FROM r JOIN e2 ON e2.a = r.v),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id FROM (SELECT doc_id, list_sort(list(g)) AS gs FROM s GROUP BY doc_id))
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(l.n_links, 0) AS n_links
FROM d JOIN m ON m.v = d.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM e2 GROUP BY a) l USING (doc_id)
""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
""",
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product([CAST(x AS DOUBLE) FOR x IN q.v], [CAST(x AS DOUBLE) FOR x IN c.v]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op10_url_filters": r"""
WITH RECURSIVE rules(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
attr AS (SELECT url, tag,
  trim(regexp_replace(regexp_extract(tag, '(?i)\brel\s*=\s*("([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1), '^["'']|["'']$', '', 'g')) AS rel,
  trim(regexp_replace(regexp_extract(tag, '(?i)\bhref\s*=\s*("([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1), '^["'']|["'']$', '', 'g')) AS href,
  trim(regexp_replace(regexp_extract(tag, '(?i)\bhttp-equiv\s*=\s*("([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1), '^["'']|["'']$', '', 'g')) AS equiv,
  trim(regexp_replace(regexp_extract(tag, '(?i)\bcontent\s*=\s*("([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1), '^["'']|["'']$', '', 'g')) AS content FROM tags),
raw AS (SELECT url, coalesce(CASE WHEN regexp_matches(tag, '(?i)^<link\b') AND regexp_matches(lower(rel), '(^|\s)canonical(\s|$)') THEN href END,
  CASE WHEN regexp_matches(tag, '(?i)^<meta\b') AND lower(equiv) = 'refresh' THEN trim(regexp_replace(regexp_extract(content, '(?i)^[^;,]*[;,]\s*url\s*=\s*(.*)', 1), '^["'']|["'']$', '', 'g')) END) AS t FROM attr),
base AS (SELECT *, regexp_extract(url, '^(.*?://[^/?#]*)', 1) AS b, regexp_extract(url, '^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)', 1) AS f FROM raw WHERE t <> ''),
target AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN t LIKE '//%' THEN split_part(url, '://', 1) || ':' || t WHEN t LIKE '/%' THEN b || t
  WHEN NOT regexp_matches(t, '^(#|\?|[A-Za-z][A-Za-z0-9+.-]*:)') THEN f || CASE WHEN f LIKE '%/' THEN '' ELSE '/' END || t END AS u FROM base),
ends AS (SELECT url AS x, u AS y FROM target WHERE contains(u, '://')),
urls AS (SELECT x AS u FROM ends UNION SELECT y FROM ends UNION SELECT url FROM pages WHERE contains(url, '://')),
cut AS (SELECT u, substr(u, strpos(u, '://') + 3) AS rest FROM urls),
parts AS (SELECT u, translate(split_part(u, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM cut),
fit AS (SELECT u, scheme || '://' || host || tail AS node, host, path,
  (SELECT min(struct_pack(size := -length(r.h || r.p), rule := r.h || r.p, action := r.action)) FROM rules r
   WHERE (parts.host = r.h OR ends_with(parts.host, '.' || r.h)) AND starts_with(parts.path, r.p)) AS best FROM parts),
e AS (SELECT a.node AS a, b.node AS b FROM ends JOIN fit a ON a.u = x JOIN fit b ON b.u = y WHERE a.node <> b.node),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS v, a AS c FROM e2 UNION SELECT e2.b, r.c FROM r JOIN e2 ON e2.a = r.v),
m AS (SELECT v, min(c) AS comp FROM r GROUP BY v),
g AS (SELECT comp FROM m JOIN fit ON node = v GROUP BY comp HAVING bool_or(coalesce(best.action = 'block', false)) AND NOT bool_or(coalesce(best.action = 'allow', false)))
SELECT p.page_id, coalesce(f.host, '') AS host, coalesce(f.path, '') AS path, f.best.rule AS rule,
       coalesce(f.best.action, CASE WHEN g.comp IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, g.comp IS NOT NULL AS alias_of_blocked
FROM pages p LEFT JOIN fit f ON f.u = p.url LEFT JOIN m ON m.v = f.node LEFT JOIN g USING (comp)
""",
    "op11_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, n, j, substr(x, 400 * j + 1, 598) AS y FROM (SELECT *, unnest(range(0, (n + 199) // 200)) AS j FROM d)),
w AS (SELECT doc_id, 200 * j + i AS i, row_number() OVER (PARTITION BY substr(y, 2 * i + 1, 200) ORDER BY doc_id, 200 * j + i) AS k FROM (SELECT *, unnest(range(0, least(200, n - 99 - 200 * j))) AS i FROM p)),
r AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -200) + 100 AS new FROM w WHERE k > 1),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r) GROUP BY doc_id, run),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT row, doc_id, size, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS size, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
x AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n),
s AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * n) // l)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN x USING (term), c GROUP BY item_id, row, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0 AND doc_id IS NOT NULL) WHERE rank <= 10
""",
    "op13_collocations": r"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, [x FOR x IN string_split_regex(t, '[ \t]+') IF x <> ''] AS w FROM (SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
g AS (SELECT lang, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 5) r(m) WHERE len(w) >= m)),
f AS (SELECT lang, g, len(g) AS m, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, g),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, (2000000 * c.f) // (l.f + r.f) AS score FROM c, range(1, 4) s(k)
      JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:] WHERE k < c.m),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM k) WHERE o = 1),
s AS (SELECT lang, f, g[i:i + z - 1] AS g FROM (SELECT lang, g, f, m, z, unnest(range(1, m - z + 2)) AS i FROM c, range(2, 4) t(z) WHERE z < m)),
h AS (SELECT lang, g, max(f) AS longer FROM s GROUP BY lang, g),
o AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN h USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
""",
}
