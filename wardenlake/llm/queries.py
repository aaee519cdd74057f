"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe_count, langid, link_trust, media_chunks, merkle_manifest, minhash, mixing, ordinal, packing, prefix_trie, quality_mcd, secret_scan, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), k=3, percent=85)


def op2_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_features(_documents(spark, sf_dir))


def op3_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_mcd.quality(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def packing_encoder() -> tuple:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), packing_encoder())


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page's response record its conversion and metadata records; the records themselves as digests."""
    out = warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op7_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = langid.document_rows(_documents(spark, sf_dir))
    return langid.identify(rows, langid.train(rows))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages, whose markup and addresses speak too; the text model is that of the documents."""
    model = langid.train(langid.document_rows(_documents(spark, sf_dir)))
    return langid.identify(langid.page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")), model).withColumnRenamed("doc_id", "page_id")


def op8_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(_documents(spark, sf_dir))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = ordinal.train(docs, ordinal.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return ordinal.score(docs, model)


def op10_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(_documents(spark, sf_dir))


#: the contract's; OP13_SQL is written from the operator's defaults, where two of them lack the last slash
OP13_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op13_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), OP13_RULES)


QUERIES = {"op1_minhash": op1_minhash, "op2_gear_chunks": op2_gear_chunks, "op3_mcd_outliers": op3_mcd_outliers, "op4_bpe_count": op4_bpe_count, "op5_best_fit": op5_best_fit, "op6_warc_derivatives": op6_warc_derivatives, "op7_evidence_fusion": op7_evidence_fusion, "langid_pages": langid_pages, "op8_cube_mix": op8_cube_mix, "op9_ordinal_quality": op9_ordinal_quality, "op10_trigram_secrets": op10_trigram_secrets, "op11_prefix_trie": op11_prefix_trie, "op12_merkle_manifest": op12_merkle_manifest, "op13_link_trust": op13_link_trust}

#: Words by RE2 and list functions; the links by counting common shingles; components by recursion with UNION.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS ss
  FROM w
), n AS (SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(ss) AS sh FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_n >= 85 * (p.n_shingles + q.n_shingles - both_n)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reached)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) m ON m.node = n.doc_id
"""

#: CRC-32 bit by bit, since the engine has no such function. {0} is the integer.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
  list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"""

#: Paths as running concatenations of digests; a node adds to all its ancestors, which are the prefixes of its least member.
OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {CRC32_SQL.format("conv_id")} % 9 AS h FROM t),
r AS (
  SELECT c.conv_id, 0 AS part, i, x, strlen(text) AS b FROM c JOIN t ON t.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, x, strlen(text) FROM c JOIN t ON t.conv_id = c.conv_id AND i > h
), s AS (SELECT conv_id, x, b, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d FROM r),
m AS (
  SELECT conv_id, d, b, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (SELECT path, any_value(d) AS d, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n_convs, left(path, greatest(length(path) - 64, 0)) AS above FROM m GROUP BY path),
k AS (SELECT above AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY above),
z AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
a AS (SELECT m.path, count(*) FILTER (z.n_children = 0) AS n_leaves, sum((z.n_convs - 1) * z.b) AS saved FROM z JOIN m ON m.conv_id = z.conv_id AND m.d <= z.d GROUP BY m.path),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id) JOIN m USING (conv_id, d) GROUP BY path)
SELECT z.conv_id, z.d::BIGINT AS depth, u.conv_id AS parent_conv_id, z.n_convs::BIGINT AS n_convs, z.n_children::BIGINT AS n_children, a.n_leaves::BIGINT AS n_leaves,
  a.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM z JOIN a USING (path) LEFT JOIN n u ON z.d > 0 AND u.path = z.above LEFT JOIN e ON e.path = z.path
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

#: A level at a time by recursion; the groups' roots are leaves of a tree of their own, g = -1; a proof climbs both.
OP12_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {CRC32_SQL.format("doc_id")} % 7 = 0 AS bad,
    {_LEAF.format(n="(n_chars + 1)")} AS forged, n_chars FROM documents
), p AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l
), t AS (
  SELECT g, 0 AS k, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p
  UNION ALL SELECT g, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY g, k, i // 2
), s AS (SELECT g, k AS top, h AS subroot FROM t WHERE n = 1),
u AS (
  SELECT 0 AS k, g AS i, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY k, i // 2
), f AS (
  SELECT p.g, p.i, p.doc_id, p.leaf, s.top, s.subroot, 0 AS k, p.i AS at, false AS over, '' AS proof, CASE WHEN bad AND n_chars IS NOT NULL THEN forged ELSE leaf END AS h FROM p JOIN s USING (g)
  UNION ALL
  SELECT f.g, f.i, f.doc_id, f.leaf, f.top, f.subroot, CASE WHEN o.turn THEN 0 ELSE f.k + 1 END, CASE WHEN o.turn THEN f.g ELSE f.at // 2 END, f.over OR o.turn,
    f.proof || coalesce(b.h, ''), CASE WHEN o.turn THEN f.h WHEN f.at % 2 = 1 THEN sha256(b.h || f.h) ELSE sha256(f.h || coalesce(b.h, '')) END
  FROM f CROSS JOIN (SELECT max(k) AS high FROM u) q
  JOIN LATERAL (SELECT NOT f.over AND f.k = f.top AS turn) o ON true
  LEFT JOIN (SELECT g, k, i, h FROM t UNION ALL SELECT -1, k, i, h FROM u) b ON NOT o.turn AND b.g = CASE WHEN f.over THEN -1 ELSE f.g END AND b.k = f.k AND b.i = xor(f.at, 1)
  WHERE NOT (f.over AND f.k = q.high)
)
SELECT f.doc_id, f.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM f CROSS JOIN (SELECT h FROM u WHERE n = 1) r WHERE f.over AND f.k = (SELECT max(k) FROM u)
"""

_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(link_trust.RULES, key=lambda r: -len(r[0] + r[1]))]
_RULE = " ".join(f"WHEN {fits} THEN '{rule}'" for fits, rule, _ in _FITS)
_VERDICT = " ".join(f"WHEN {fits} THEN '{verdict}'" for fits, _, verdict in _FITS)
_AZ = f"'{link_trust.UPPER}', '{link_trust.LOWER}'"
_LINK = link_trust.LINK.replace("*+", "*").replace("?+", "?").replace("++", "+").replace("'", "''")

#: The rounds are written out, one table each; integers as in the operator, so that equal is equal.
OP13_SQL = f"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS MATERIALIZED (SELECT page_id, host, path, CASE {_RULE} END AS rule, CASE {_VERDICT} END AS by_rule FROM p),
l AS MATERIALIZED (
  SELECT src, dst, count(*) AS w FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{_LINK}', 1), lambda h: translate(h, {_AZ})))) AS dst FROM p)
  WHERE src <> '' AND src <> dst GROUP BY src, dst
), h AS (SELECT host FROM j UNION SELECT dst FROM l),
s AS (SELECT string_split(host, '.') AS x FROM h WHERE length(host) <= 253 AND regexp_matches(host, '[a-z]')),
f AS (SELECT DISTINCT array_to_string(x[i:], '.') AS a, array_to_string(x[i + 1:], '.') AS b FROM (SELECT x, unnest(range(1, len(x) - 1)) AS i FROM s)),
e AS (SELECT src, dst, sum(w)::BIGINT AS w FROM (SELECT src, dst, w FROM l UNION ALL SELECT a, b, 1 FROM f WHERE a <> '' AND b <> '' UNION ALL SELECT b, a, 1 FROM f WHERE a <> '' AND b <> '') GROUP BY src, dst),
g AS (SELECT 't' AS kind, src AS host, dst AS v, w FROM e UNION ALL SELECT 'd', dst, src, w FROM e),
o AS MATERIALIZED (SELECT *, (sum(w) OVER (PARTITION BY kind, host))::BIGINT AS total FROM g),
q AS (SELECT CASE by_rule WHEN 'allow' THEN 't' ELSE 'd' END AS kind, host, count(*) AS n FROM j WHERE by_rule IS NOT NULL GROUP BY ALL),
r0 AS MATERIALIZED (SELECT kind, host, n * ({link_trust.MASS} // (sum(n) OVER (PARTITION BY kind))::BIGINT) AS mass FROM q),
""" + ",\n".join(
    f"""r{i} AS MATERIALIZED (
  SELECT kind, host, sum(mass)::BIGINT AS mass FROM (
    SELECT o.kind, o.v AS host, (m // total) * w + (m % total) * w // total AS mass FROM (SELECT kind, host, mass * {link_trust.DAMPING} // 100 AS m FROM r{i - 1}) JOIN o USING (kind, host)
    UNION ALL SELECT kind, host, mass * {100 - link_trust.DAMPING} // 100 FROM r0) GROUP BY kind, host)"""
    for i in range(1, link_trust.ROUNDS + 1)
) + f""", z AS (SELECT host, coalesce(sum(mass) FILTER (kind = 't'), 0)::BIGINT AS trust, coalesce(sum(mass) FILTER (kind = 'd'), 0)::BIGINT AS distrust FROM r{link_trust.ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM j LEFT JOIN z ON z.host = j.host
"""

SQL = {"op1_minhash": OP1_SQL, "op11_prefix_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_link_trust": OP13_SQL}
