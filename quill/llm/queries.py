"""Registered queries of the training-data operators and their DuckDB statements.

Each query applies its operator with production parameters to the whole of its
table.  ``SQL`` holds a statement where SQL can express the operator; the
others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quill.llm import common, html, lines, merkle, mixing, pieces, pii, quality, shards, simhash, voting, warc, weighted, whitening

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model(name: str = PIECE_MODEL) -> bytes:
    """Bytes of a public model; read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.archive_pages(common.table(spark, sf_dir, "pages"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(common.table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(common.table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_table(common.table(spark, sf_dir, "documents"), piece_model())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(common.table(spark, sf_dir, "documents")).drop("_q_text")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(common.table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.interleave(common.table(spark, sf_dir, "documents")).drop("source")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(common.table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_queue(common.table(spark, sf_dir, "documents"))


def op10_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.weighted_fingerprints(common.table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return merkle.manifest(docs, *merkle.lowered())


def op13_quality_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_warc, op2_line_dedup, op3_quality_rules, op4_sentencepiece, op5_simhash, op6_html_text, op7_sharding,
    op8_pii, op9_mixing, op10_weighted_fingerprints, op11_whitening, op12_merkle,
    op13_quality_voting)}

BLANK = r"[\x20\x09-\x0D]"
STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
RULES = " AND ".join(f"{name} BETWEEN {low} AND {high}" for name, low, high in quality.RULES)

SQL: dict[str, str] = {}

SQL["op1_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, n, max(page_id) AS first_id FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n = f.n"""

SQL["op2_line_dedup"] = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

SQL["op3_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
           FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM
      (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len([x FOR x IN ws IF lower(x) IN ({STOP})]) AS n_stop,
             len([x FOR x IN ls IF regexp_matches(x, '(\.\.\.|…) *$')]) AS n_dots,
             len([x FOR x IN ls IF regexp_matches(x, '^ *[-*•]')]) AS n_bullets
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
             coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
             coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_share,
             coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
             coalesce(n_dots / nullif(n_lines, 0), 0) AS ellipsis_line_share,
             coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_line_share FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {RULES} AS kept FROM r"""

# the checksum goes byte by byte through its table of 256 remainders
CRC_TABLE = """s(i, v, bit) AS (SELECT i, i::UBIGINT, 0 FROM range(256) r(i) UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, bit + 1 FROM s WHERE bit < 8),
tab AS (SELECT list(v ORDER BY i) AS tt FROM s WHERE bit = 8)"""


def crc(h: str) -> str:
    """CRC-32 of the bytes in a hexadecimal string, beside ``tab``."""
    return (f"xor(list_reduce([('0x' || substr({h}, 2 * i + 1, 2))::INT::UBIGINT FOR i IN range(length({h}) // 2)], "
            "lambda c, x: xor(c >> 8, tt[(xor(c, x) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT")


SQL["op7_sharding"] = f"""
WITH RECURSIVE {CRC_TABLE},
h AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, length(h) // 2 + {shards.ROW_BYTES} AS size,
             {crc('h')} AS text_crc32, coalesce('0' || source, '1') AS src, md5('{shards.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k
      FROM h, tab),
f AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY k, doc_id) - 0.5::DOUBLE)
                / count(*) OVER (PARTITION BY src) AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, src) - 1 AS p, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 40 // n)::INTEGER AS shard,
       row_number() OVER (PARTITION BY p * 40 // n ORDER BY p) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p"""

SQL["op9_mixing"] = rf"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  coalesce('0' || source, '1') AS src, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k
           FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
             [1, 2, 3][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w, row_number() OVER (ORDER BY src) AS no
      FROM d GROUP BY src),
l AS (SELECT *, cap / w <= (sum(source_size) OVER () - sum(cap) OVER o + cap) / (sum(w) OVER () - sum(w) OVER o + w) AS full_up
      FROM s WINDOW o AS (ORDER BY cap / w, no ROWS UNBOUNDED PRECEDING)),
t AS (SELECT src, source_size, CASE WHEN full_up THEN cap::DOUBLE ELSE
             (w * (sum(source_size) OVER () - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ()))::DOUBLE
             / nullif(sum(CASE WHEN full_up THEN 0 ELSE w END) OVER (), 0) END AS target FROM l),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.src ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.src = t.src),
c AS (SELECT size, ((e * source_size + cum)::DOUBLE / target) AS fin FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
x AS (SELECT max(fin) AS cut FROM (SELECT fin, sum(sum(size)) OVER (ORDER BY fin) AS used FROM c GROUP BY fin)
      WHERE used <= (SELECT sum(size) FROM d))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (CASE WHEN size = 0 THEN 0 ELSE (cum / target <= cut)::INT + ((source_size + cum)::DOUBLE / target <= cut)::INT
                + ((2 * source_size + cum)::DOUBLE / target <= cut)::INT END))::BIGINT AS taken
FROM q, x"""


def merkle_levels(name: str, key: str, levels: int) -> str:
    """Levels over ``{name}0`` (key, pos, n, d, f: digest and folded digests by leaf): nodes, and each leaf's way up.

    A group of one node stays as it is.  ``{name}p`` has the proof so far and the folded digest of every leaf.
    """
    out = []
    for i in range(levels):
        out.append(f"""
{name}{i + 1} AS (SELECT {key}, pos // {merkle.ARITY} AS pos, (n + {merkle.ARITY - 1}) // {merkle.ARITY} AS n,
    CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE min(d) END AS d FROM {name}{i} GROUP BY {key}, pos // {merkle.ARITY}, n),
{name}r{i} AS (SELECT a.{key}, a.pos, a.n, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {name}{i} a JOIN {name}{i} b ON a.{key} = b.{key} AND a.pos // {merkle.ARITY} = b.pos // {merkle.ARITY} GROUP BY ALL),
{name}w{i + 1} AS (SELECT w.* EXCLUDE (pos, proof, f), w.pos // {merkle.ARITY} AS pos, proof || l || r AS proof,
    CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f
    FROM {name}w{i} w JOIN {name}r{i} x ON w.{key} = x.{key} AND w.pos = x.pos),""")
    return "".join(out)


def merkle_leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in (*merkle.FIELDS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


# levels enough for eight to the seventh leaves a lang and five hundred langs
SQL["op12_merkle"] = f"""
WITH RECURSIVE {CRC_TABLE},
h AS (SELECT *, coalesce({crc("hex(encode(doc_id::VARCHAR))")} % 3 = 0, false) AS hit FROM documents, tab),
d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {merkle_leaf("text")} AS leaf,
             CASE WHEN hit THEN {merkle_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
             ELSE {merkle_leaf("text")} END AS f FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
      FROM d),
a0 AS (SELECT g, pos, n, leaf AS d FROM o),
aw0 AS (SELECT doc_id, leaf, g, pos, '' AS proof, f FROM o),{merkle_levels("a", "g", 7)}
b0 AS (SELECT 1 AS k, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, d, g FROM a7),
bw0 AS (SELECT doc_id, leaf, b0.d AS subroot, 1 AS k, b0.pos, proof, f FROM aw7 JOIN b0 ON aw7.g = b0.g),{merkle_levels("b", "k", 3)}
e AS (SELECT d AS root FROM b3)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM bw3, e"""
