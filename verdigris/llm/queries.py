"""Queries ``opN_<name>`` over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import id_digests
from .collocations import collocations
from .common import read_table
from .flac import media_digests
from .linededup import dedup_lines
from .mixing import rates
from .packing import pack
from .quality import quality
from .sharding import shard_documents
from .simhash import near_components
from .substrings import without_repeats
from .toxicity import toxicity
from .trie import prefix_trie
from .urls import judge_urls, labelled_urls


#: Lines that an equal line precedes by (doc_id, line number), or one within two edits of bytes, or within one where the
#: shorter has under 24 bytes.
OP9_SQL = r"""
WITH l AS (SELECT doc_id, pos, line, octet_length(encode(line)) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE length(trim(line, E' \t\n\x0b\x0c\r')) > 0),
c AS (SELECT line, n, min((doc_id, pos)) AS first FROM l GROUP BY line, n),
near AS (SELECT a.line, min(b.first) AS before FROM c a JOIN c b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.first > b.first AND least(a.n, b.n) >= 12 AND levenshtein(a.line, b.line) <= if(least(a.n, b.n) >= 24, 2, 1) GROUP BY a.line),
f AS (SELECT l.doc_id, l.pos, (l.doc_id, l.pos) > c.first AS eq, coalesce((l.doc_id, l.pos) > near.before, false) AS nr FROM l JOIN c USING (line) LEFT JOIN near USING (line)),
g AS (SELECT doc_id, list(pos) FILTER (eq OR nr) AS gone, count(*) FILTER (eq) AS n_equal, count(*) FILTER (nr AND NOT eq) AS n_near FROM f GROUP BY doc_id),
k AS (SELECT d.doc_id, string_split(d.text, chr(10)) AS parts, coalesce(g.gone, []) AS gone, coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near FROM documents d LEFT JOIN g USING (doc_id)),
t AS (SELECT *, coalesce(array_to_string(list_filter(parts, lambda x, i: NOT list_contains(gone, i)), chr(10)), '') AS kept FROM k)
SELECT doc_id, coalesce(len(parts), 0) AS n_lines, n_equal, n_near, octet_length(encode(kept)) AS n_kept_bytes, sha256(kept) AS kept_sha256 FROM t
"""


#: Paths as lists of turns: a node's parent and subtree are told by the lists that it starts with. CRC-32 bit by bit.
OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 100 AS base, xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda s, x: list_reduce([xor(s, x)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: if(v & 1 = 1, xor(v >> 1, 3988292384), v >> 1))), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT k.c, 0 AS own, t.p, role, text FROM k JOIN t ON t.c = k.base AND t.p <= k.h UNION ALL SELECT k.c, 1, t.p, role, text FROM k JOIN t ON t.c = k.c AND t.p > k.h),
o AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d FROM r),
f AS (SELECT k.c, coalesce(list({'r': o.role, 't': o.text} ORDER BY d) FILTER (d IS NOT NULL), []) AS turns FROM k LEFT JOIN o USING (c) GROUP BY k.c),
m AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM f),
n AS (SELECT turns[1:d] AS path, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(turns) = d) AS ids FROM m GROUP BY ALL),
q AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON n.d = p.d + 1 AND n.path[1:n.d - 1] = p.path),
h AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
u AS (SELECT q.*, coalesce(n_children, 0) AS n_children FROM q LEFT JOIN h USING (path)),
s AS (SELECT path[1:i] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(if(d = 0, 0, (n_convs - 1) * length(path[d].t))) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM u) GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM u JOIN s USING (path)
"""


#: Every phrase of every piece counted as a list of words; a cut's parts are phrases that are counted too.
OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')), '[^ \t]+') AS w FROM documents),
u AS MATERIALIZED (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT *, row_number() OVER () AS piece FROM p)),
q AS (SELECT lang, list(w) OVER (PARTITION BY piece ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM u),
g AS MATERIALIZED (SELECT lang, w[1:s] AS g, s, count(*) AS f FROM q, range(1, 6) z(s) WHERE s <= len(w) GROUP BY ALL HAVING s = 1 OR count(*) >= 100),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE s = 1 GROUP BY lang),
k AS MATERIALIZED (SELECT lang, g, f AS a, k, g[1:k] AS lg, g[k + 1:] AS rg FROM (SELECT *, unnest(range(1, s)) AS k FROM g WHERE s > 1)),
i AS MATERIALIZED (SELECT k.*, g.f AS l FROM k JOIN g ON g.lang = k.lang AND g.g = k.lg),
j AS MATERIALIZED (SELECT i.*, g.f AS r FROM i JOIN g ON g.lang = i.lang AND g.g = i.rg),
c AS MATERIALIZED (SELECT j.*, n, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score FROM j JOIN t USING (lang)),
b AS MATERIALIZED (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
x AS (SELECT lang, unnest(flatten(list_transform(range(1, s + 1), lambda i: list_transform(range(i, s + 1), lambda j: g[i:j])))) AS g, s, f FROM g WHERE s > 2),
m AS MATERIALIZED (SELECT lang, g, max(f) AS f FROM x WHERE len(g) < s GROUP BY ALL),
o AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN m USING (lang, g) WHERE m.f IS NULL OR 100 * m.f < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o QUALIFY rank <= 2000
"""


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read_table(spark, sf_dir, "documents"))


def op3_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_dictionary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_digests(read_table(spark, sf_dir, "documents"), "word_bpe_49k.json", end=2)


def op8_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents"))


def op9_segment_edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_equal", "n_near", F.octet_length(kept).cast("long").alias("n_kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))


def op10_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), labelled_urls(spark))


def op13_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op9_segment_edit_lines": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_pivot_collocations": OP13_SQL}
