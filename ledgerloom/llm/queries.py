"""The operators' queries over the tables in ``sf_dir``, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embeddings, html, language, licenses, linededup, mixing, neardup, pii, quality, sentencepieces, toxicity, trie

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(divisor: int, value: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == value


def op1_toxicity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.predict(table(spark, sf_dir, "documents"), labels, _fold(3, 1))


def op2_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_language(spark, sf_dir):
    return language.predict(table(spark, sf_dir, "documents"), _fold(5, 0))


def op5_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_sentencepiece(spark, sf_dir, model: str = MODEL):
    return sentencepieces.encode(table(spark, sf_dir, "documents"), sentencepieces.load(spark, model))


def op8_embedding_near_dedup(spark, sf_dir):
    return embeddings.link(table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return quality.rules(table(spark, sf_dir, "documents"), labels)


def op10_line_dedup(spark, sf_dir):
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_gone", "text")


def op11_token_alignment(spark, sf_dir, a: str = BYTE_LEVEL, b: str = MODEL):
    return alignment.align(table(spark, sf_dir, "documents"), alignment.tokenizer_json(spark, a), sentencepieces.load(spark, b))


def op12_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_minhash_near_dedup, op4_language, op5_html_extraction, op6_mixing, op7_sentencepiece, op8_embedding_near_dedup, op9_quality_rules, op10_line_dedup, op11_token_alignment, op12_pii, op13_prefix_trie)}
WORDS = r"CAST(len(regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"
OP6_SQL = rf"""WITH d AS (SELECT doc_id, source, {WORDS.format('text')} AS size, CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS seed FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, CAST(source_size * 3 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (CAST(sum(weight) OVER () AS DOUBLE) - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
f AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM l WHERE cap > level * weight),
t AS (SELECT l.source, source_size, n, CASE WHEN l.place < f.place THEN cap ELSE coalesce(f.level * weight, 0.0) END AS target FROM l, f),
z AS (SELECT coalesce(least(64, min(CASE WHEN target >= 1 THEN CAST(floor(target) AS BIGINT) END)), 1) AS block FROM t),
k AS (SELECT CAST(floor(sum(target) / any_value(block) + 0.5) AS BIGINT) AS blocks FROM t, z),
q AS (SELECT source, count(*) AS quota FROM (SELECT source, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, source NULLS LAST, i) AS r FROM t, z, LATERAL (SELECT unnest(range(CAST(ceil(target / block) AS BIGINT) + 2)) AS i)) WHERE r <= (SELECT blocks FROM k) GROUP BY 1),
p AS (SELECT d.*, t.source_size, t.target, coalesce(q.quota, 0) AS source_quota, d.seed % least(CAST(ceil(t.n / 256) AS BIGINT), 65536) AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
h AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(source_quota) AS source_quota FROM p GROUP BY 1, 2),
hq AS (SELECT source, shard, count(*) AS quota FROM (SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * i + 1) DESC, shard, i) AS r FROM h, LATERAL (SELECT unnest(range(source_quota)) AS i) WHERE shard_size > 0) WHERE r <= source_quota GROUP BY 1, 2),
hw AS (SELECT h.source, h.shard, shard_size, least(coalesce(quota, 0) * block, shard_size * 3) AS words FROM h CROSS JOIN z LEFT JOIN hq ON h.source IS NOT DISTINCT FROM hq.source AND h.shard = hq.shard),
c AS (SELECT p.*, shard_size, words, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS passes, CAST(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY seed, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM p JOIN hw ON p.source IS NOT DISTINCT FROM hw.source AND p.shard = hw.shard)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, words - passes * shard_size - start)) AS BIGINT) AS taken FROM c"""
OP10_SQL = rf"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM s),
l AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, {WORDS.format('line')} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx, sum({WORDS.format('line')}) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM a WHERE {WORDS.format('line')} > 0),
win AS (SELECT x.doc_id, x.idx AS s, min(y.idx) AS e FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.idx BETWEEN x.idx AND x.idx + 49 AND y.upto - x.upto + x.w >= 50 GROUP BY 1, 2
  UNION SELECT y.doc_id, max(x.idx), y.idx FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.idx BETWEEN x.idx AND x.idx + 49 AND y.upto - x.upto + x.w >= 50 GROUP BY y.doc_id, y.idx),
body AS (SELECT win.doc_id, s, e, md5(string_agg(line, chr(10) ORDER BY idx)) AS h FROM win JOIN l ON l.doc_id = win.doc_id AND idx BETWEEN s AND e GROUP BY 1, 2, 3),
fst AS (SELECT *, first_value(doc_id) OVER v AS fd, first_value(s) OVER v AS fs FROM body WINDOW v AS (PARTITION BY h ORDER BY doc_id, s)),
gone AS (SELECT DISTINCT l.doc_id, pos FROM fst JOIN l ON l.doc_id = fst.doc_id AND idx BETWEEN s AND e WHERE fd <> fst.doc_id OR fs + (e - s + 1) <= s),
kept AS (SELECT a.doc_id, string_agg(line, chr(10) ORDER BY a.pos) FILTER (g.pos IS NULL) AS text, count(g.pos) AS n_gone, count(*) AS n_lines FROM a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.pos = a.pos GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_gone, 0) AS n_gone, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
#: A node is the list of the turns' digests; its subtree is what starts with it. Children of a node, in the order of their lists,
#: give the preorder: a subtree's nodes follow its top, so the interval of its numbers is their count.
OP13_SQL = r"""WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, md5(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), ':', coalesce(text, ''))) AS turn, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT c, c - c % 5 AS base FROM o),
codes AS (SELECT c, base, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes FROM k),
bits AS (SELECT c, base, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)) AS crc FROM codes),
h AS (SELECT c, base, xor(crc, CAST(4294967295 AS BIGINT)) % 9 AS h FROM bits),
r AS (SELECT h.c, 0 AS part, o.i, o.turn, o.bytes FROM h JOIN o ON o.c = h.base AND h.base <> h.c AND o.i < h.h UNION ALL SELECT h.c, 1, o.i, o.turn, o.bytes FROM h JOIN o ON o.c = h.c WHERE h.base = h.c OR o.i >= h.h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, string_agg(turn, '') OVER (PARTITION BY c ORDER BY part, i) AS path, bytes FROM r UNION ALL SELECT c, 0, '', 0 FROM k),
z AS (SELECT c, max(d) AS z FROM d GROUP BY 1),
n AS (SELECT path, CAST(max(d.d) AS BIGINT) AS depth, min(d.c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(CASE WHEN d.d = z.z THEN CAST(d.c AS VARCHAR) END, ',' ORDER BY d.c), '')) AS ends_sha256 FROM d JOIN z ON z.c = d.c GROUP BY 1),
kids AS (SELECT substr(path, 1, strlen(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
e AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children, row_number() OVER (ORDER BY n.path) - 1 AS first FROM n LEFT JOIN kids ON kids.path = n.path),
s AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.bytes) AS BIGINT) AS saved_tokens, count(*) AS size FROM e a JOIN e b ON starts_with(b.path, a.path) GROUP BY 1)
SELECT e.conv_id, e.depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256, CAST(e.first AS BIGINT) AS first, CAST(e.first + s.size AS BIGINT) AS last FROM e JOIN s ON s.path = e.path LEFT JOIN n p ON e.depth > 0 AND p.path = substr(e.path, 1, strlen(e.path) - 32)"""
ORACLES: dict[str, str] = {"op6_mixing": OP6_SQL, "op10_line_dedup": OP10_SQL, "op13_prefix_trie": OP13_SQL}
