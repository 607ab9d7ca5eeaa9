"""The queries of these operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm import (
    bloom_lines, cover_tree, debruijn, fmindex, html_text, lexical, merkle, mixing, revisits, secret_scan, suffix_levels,
    token_groups, toxicity,
)
from harborline.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op9_entropy_mix")
def op9_entropy_mix(spark, folder):
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


# Words of a text, lower-cased in ASCII only; items cut into windows of ten words or taken whole.
OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)),
hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


@query("op1_fm_decontaminate", OP1_SQL)
def op1_fm_decontaminate(spark, folder):
    found = fmindex.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op4_zstd_toxicity")
def op4_zstd_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query("op5_crf_secrets")
def op5_crf_secrets(spark, folder):
    docs = table(spark, folder, "documents")
    return secret_scan.scan_secrets(docs, secret_scan.fit(docs)).drop("clean_text")


@query("op10_dom_extract")
def op10_dom_extract(spark, folder):
    pages = table(spark, folder, "pages")
    return html_text.extract(pages, html_text.fit(pages))


# Sequences of 35 words that begin in two places, and the words they cover.
OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), places AS (
  SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), twice AS (SELECT g FROM places GROUP BY g HAVING count(*) > 1),
gone AS (
  SELECT r, list(DISTINCT p) AS ps FROM (
    SELECT r, unnest(range(i, i + 35)) AS p FROM places WHERE g IN (SELECT g FROM twice)) GROUP BY r
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS k FROM (
    SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) a
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT r AS r2, unnest(ps) AS p2 FROM gone) b WHERE a.r = b.r2 AND a.p = b.p2)
  GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""


@query("op2_debruijn_dedup", OP2_SQL)
def op2_debruijn_dedup(spark, folder):
    return debruijn.remove_repeats(table(spark, folder, "documents")).drop("clean_text")


# Every 400-byte window by the MD5 of its hex text, cut from pieces of 1,024 starts; then islands of covered bytes and what is left.
OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT r, base, substr(h, 2 * base + 1, 2 * (1024 + 399)) AS p FROM (
    SELECT r, h, unnest(range(0, len(h) // 2 - 399, 1024)) AS base FROM d WHERE len(h) >= 800)
), places AS (
  SELECT r, base + k AS i, md5(substr(p, 2 * k + 1, 800)) AS g FROM (
    SELECT r, base, p, unnest(range(0, least(1024, len(p) // 2 - 399))) AS k FROM pieces)
), starts AS (
  SELECT r, i FROM places WHERE g IN (SELECT g FROM places GROUP BY g HAVING count(*) > 1)
), marked AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM starts
), numbered AS (
  SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM marked
), runs AS (
  SELECT r, min(i) AS b, max(i) + 400 AS e FROM numbered GROUP BY r, run
), gone AS (
  SELECT r, sum(e - b) AS n, count(*) AS spans, max(e) AS last FROM runs GROUP BY r
), gaps AS (
  SELECT r, b, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS a FROM runs
), kept AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS k FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(concat(coalesce(k, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""


@query("op6_suffix_levels", OP6_SQL)
def op6_suffix_levels(spark, folder):
    return suffix_levels.remove_repeats(table(spark, folder, "documents")).drop("clean")


# All pairs by cosine, components by repeated spreading of the least id.
OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN low ON e.vec_id = low.x LEFT JOIN n ON e.vec_id = n.x
"""


@query("op8_cover_tree_dedup", OP8_SQL)
def op8_cover_tree_dedup(spark, folder):
    return cover_tree.near_duplicates(table(spark, folder, "embeddings"))


# Sets as lists of whole shingle texts, pairs over shared shingles, least id spread over links.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS t
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (
  SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.r <> b.r GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)
), reach AS (
  SELECT r AS x, r AS y FROM d UNION SELECT q.x, l.y FROM reach q JOIN links l ON q.y = l.x
), low AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON d.r = y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (r) JOIN low ON low.x = d.r
"""


@query("op7_token_groups", OP7_SQL)
def op7_token_groups(spark, folder):
    return token_groups.jaccard_components(table(spark, folder, "documents")).select(
        "doc_id", "n_shingles", "component_id"
    )


# Three captures of each page, in words that both engines read: a third of all under one URL in three spellings, a third
# under their host's, the rest under their own. Times tie and are missing, as are kinds, validators and headers.
OP3_CAPTURES = """
SELECT page_id * 3 + k AS record_id,
  CASE WHEN page_id % 3 = 0 AND k = 0 THEN 'http://www.example.com'
    WHEN page_id % 3 = 0 AND k = 1 THEN 'HTTP://WWW.example.com:80/'
    WHEN page_id % 3 = 0 THEN 'http://www.example.com/#top'
    WHEN page_id % 3 = 1 THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) || '/' ELSE url END AS url,
  CASE WHEN (page_id * 3 + k) % 61 <> 0 THEN (page_id * 37 + k * 111) % 50021 END AS ts,
  CASE WHEN (page_id + k) % 59 = 0 THEN NULL WHEN (page_id + 2 * k) % 5 < 2 THEN 'response' ELSE 'revisit' END AS kind,
  CASE WHEN (page_id + k) % 7 < 5 THEN 'e' || CAST((page_id + k * (page_id % 4)) % 9 AS STRING) END AS etag,
  CASE WHEN (page_id + k) % 4 > 0 THEN 'm' || CAST((page_id + k) % 2 AS STRING) END AS last_modified,
  (page_id + k) % 11 > 0 AS has_headers, 'd' || CAST(page_id * 3 + k AS STRING) AS date,
  't' || CAST(page_id % 8 AS STRING) AS kept, CASE WHEN page_id % 6 = 1 THEN 'v' || CAST(k AS STRING) END AS vary
FROM captures"""

# The same by an as-of join on time, after the last of the responses at one time.
OP3_SQL = rf"""
WITH captures AS (SELECT page_id, url, unnest(range(3)) AS k FROM pages),
raw AS ({OP3_CAPTURES}),
cut AS (
  SELECT *, regexp_replace(url, '#.*$', '') AS bare,
    lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', 0)) AS head FROM raw
), records AS (
  SELECT * REPLACE (regexp_replace(regexp_replace(head, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
    || CASE WHEN len(bare) = len(head) THEN '/' ELSE substr(bare, len(head) + 1) END AS url) FROM cut
), known AS (
  SELECT url, ts, max(record_id) AS record_id FROM records
  WHERE kind = 'response' AND url IS NOT NULL AND ts IS NOT NULL GROUP BY url, ts
), matched AS (
  SELECT a.record_id, k.record_id AS response_id FROM records a ASOF LEFT JOIN known k ON a.url = k.url AND a.ts >= k.ts
  WHERE a.kind = 'revisit'
), judged AS (
  SELECT a.*, b.record_id AS response_id, b.date AS old_date, b.etag AS old_etag, b.vary AS old_vary, b.kept AS old_kept,
    b.has_headers AS old_headers, CASE WHEN b.record_id IS NULL THEN 'no_response'
      WHEN coalesce(a.etag = b.etag, a.last_modified = b.last_modified, true) THEN 'resolved' ELSE 'changed' END AS status
  FROM matched m JOIN records a ON m.record_id = a.record_id LEFT JOIN records b ON m.response_id = b.record_id
)
SELECT record_id, url, CASE WHEN status = 'resolved' THEN response_id END AS response_id, status,
  CASE WHEN status = 'resolved' THEN concat_ws('|',
    coalesce(CASE WHEN has_headers THEN date END, CASE WHEN old_headers THEN old_date END, '-'),
    coalesce(CASE WHEN has_headers THEN etag END, CASE WHEN old_headers THEN old_etag END, '-'),
    coalesce(CASE WHEN has_headers THEN vary END, CASE WHEN old_headers THEN old_vary END, '-'),
    coalesce(CASE WHEN old_headers THEN old_kept END, '-')) END AS headers
FROM judged
"""


@query("op3_revisit_asof", OP3_SQL)
def op3_revisit_asof(spark, folder):
    captures = table(spark, folder, "pages").selectExpr("page_id", "url", "explode(array(0, 1, 2)) AS k")
    headers = "map('date', date, 'etag', etag, 'vary', vary, 'content-type', kept)"
    records = spark.sql(OP3_CAPTURES.replace("FROM captures", "FROM {captures}"), captures=captures).withColumn(
        "headers", F.expr(f"CASE WHEN has_headers THEN map_filter({headers}, (name, value) -> value IS NOT NULL) END")
    )
    found = revisits.resolve_revisits(records)
    parts = [F.coalesce(F.col("headers")[name], F.lit("-")) for name in ("date", "etag", "vary", "content-type")]
    text = F.when(F.col("status") == "resolved", F.concat_ws("|", *parts))
    return found.select("record_id", "url", "response_id", "status", text.alias("headers"))


# Levels of each source's tree and of the tree of subroots, and each document's way up both. The CRC is taken bit by bit.
OP11_SQL = r"""
WITH RECURSIVE h AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]),
      lambda x, i: xor(x >> 1, (3988292384 * (x & 1))::UBIGINT))) & 1 = 1 AS even,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head
  FROM documents
), d AS (
  SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(new_text) || ':' || new_text, '-')) AS new
  FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS new_text FROM h)
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d
), up AS (
  SELECT s, 0 AS l, list(leaf ORDER BY p) AS nodes FROM placed GROUP BY s
  UNION ALL SELECT s, l + 1, list_transform(range(0, len(nodes), 3),
    lambda i: sha256(array_to_string(list_slice(nodes, i + 1, i + 3), ''))) FROM up WHERE len(nodes) > 1
), sub AS (SELECT s, nodes[1] AS subroot FROM up WHERE len(nodes) = 1),
above AS (
  SELECT 0 AS l, list(subroot ORDER BY s) AS nodes FROM sub HAVING count(*) > 0
  UNION ALL SELECT l + 1, list_transform(range(0, len(nodes), 3),
    lambda i: sha256(array_to_string(list_slice(nodes, i + 1, i + 3), ''))) FROM above WHERE len(nodes) > 1
), way AS (
  SELECT r, s, 0 AS l, p, new, '' AS proof FROM placed
  UNION ALL SELECT r, s, l + 1, p // 3, sha256(before || new || after), proof || before || after
  FROM (SELECT r, s, l, p, new, proof, array_to_string(list_slice(nodes, p // 3 * 3 + 1, p), '') AS before,
    array_to_string(list_slice(nodes, p + 2, p // 3 * 3 + 3), '') AS after
    FROM way JOIN up USING (s, l) WHERE len(nodes) > 1)
), far AS (
  SELECT r, 0 AS l, s AS p, new, proof FROM way JOIN up USING (s, l) WHERE len(nodes) = 1
  UNION ALL SELECT r, l + 1, p // 3, sha256(before || new || after), proof || before || after
  FROM (SELECT r, l, p, new, proof, array_to_string(list_slice(nodes, p // 3 * 3 + 1, p), '') AS before,
    array_to_string(list_slice(nodes, p + 2, p // 3 * 3 + 3), '') AS after
    FROM far JOIN above USING (l) WHERE len(nodes) > 1)
)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, f.new AS folded_root, f.new = nodes[1] AS verified
FROM placed JOIN sub USING (s) JOIN far f USING (r) JOIN above a ON a.l = f.l AND len(nodes) = 1
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    return merkle.verify_documents(docs, merkle.without_newlines(docs))


# Lines whose key at least ten documents have, left out of all.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), k AS (
  SELECT r, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)
), often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM k WHERE key NOT IN (SELECT key FROM often) GROUP BY r
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, len(lines) - coalesce(n, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@query("op12_bloom_lines", OP12_SQL)
def op12_bloom_lines(spark, folder):
    found = bloom_lines.drop_repeated_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"))


# All terms of all documents counted and scored.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE item_id IS NOT NULL AND text IS NOT NULL
), q AS (SELECT item_id, t, count(*) AS times FROM b GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s
), m AS (SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
scores AS (
  SELECT item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN weights USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL
), ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op13_ranked_search", OP13_SQL)
def op13_ranked_search(spark, folder):
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
