"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import alignment, dedup, langid, lines, mixing, ngram_join, packing, quality, resampling, substrings, token_files, toxicity, urls
from scorelake.llm.common import read_table


def op1_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(read_table(spark, sf_dir, "documents"))


#: crc32 of a number's text: a step by byte, eight by bit.
CRC32_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce({CRC32_SQL.format('doc_id')} % 5 = 0, false) AS held_out, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS hash,
  ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(t, '')) AS x, unnest(range(1, length(t) + 1)) AS i FROM d WHERE length(t) > 2),
w AS (SELECT doc_id, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, x AS g FROM w WHERE x <> ' ' UNION ALL SELECT doc_id, x || y FROM w WHERE y IS NOT NULL UNION ALL SELECT doc_id, x || y || z FROM w WHERE z IS NOT NULL AND y <> ' '),
c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT doc_id, lang, hash % count(*) OVER (PARTITION BY lang) < 2000 AS chosen FROM d WHERE NOT held_out AND lang IS NOT NULL AND doc_id IS NOT NULL),
profiles AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS place FROM (
  SELECT lang, g, sum(n) AS n FROM c JOIN s USING (doc_id) WHERE chosen GROUP BY ALL) QUALIFY place < 300),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS place FROM c QUALIFY place < 300),
sizes AS (SELECT doc_id, count(*) AS k FROM own GROUP BY doc_id),
near AS (SELECT own.doc_id, p.lang, sum(300 - least(abs(own.place - p.place), 300)) AS saved FROM own JOIN profiles p USING (g) GROUP BY ALL),
best AS (SELECT doc_id, lang, 300 * k - coalesce(saved, 0) AS distance, 300 * k AS most FROM sizes CROSS JOIN (SELECT DISTINCT lang FROM profiles) LEFT JOIN near USING (doc_id, lang)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)
SELECT d.doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1::DOUBLE - distance::DOUBLE / most::DOUBLE, 0::DOUBLE) AS score FROM d LEFT JOIN best USING (doc_id)
"""


def op2_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op3_merge_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.exact_groups(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""


def op4_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"))


def op5_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(read_table(spark, sf_dir, "documents"))


#: All pairs that share a run of five words, and what links lead to.
OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b, n = x.k AND n = y.k AS same FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 5 * n >= 4 * (x.k + y.k - n)),
reach AS (SELECT doc_id AS id, doc_id AS met FROM d UNION SELECT id, b FROM reach JOIN link ON met = a),
class AS (SELECT id, min(met) AS class_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE same) AS copy FROM link GROUP BY a)
SELECT id AS doc_id, class_id, least(id, coalesce(copy, id)) AS copy_id, coalesce(n_links, 0)::BIGINT AS n_links FROM class LEFT JOIN counts ON id = a
"""


def op8_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("copies")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS hash, md5(coalesce(text, '')) AS text_hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS left_size, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight FROM w
  WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT left_size, left_weight FROM l WHERE left_size * weight <= cap * left_weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT l.source, l.source_size, CASE WHEN l.left_size * l.weight > l.cap * l.left_weight AND l.left_size >= f.left_size AND l.left_weight > f.left_weight THEN l.cap::DOUBLE
  ELSE least((f.left_size * l.weight)::DOUBLE / f.left_weight::DOUBLE, l.cap::DOUBLE) END AS target FROM l, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, floor(b.target - b.whole * b.source_size)::BIGINT AS budget,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.text_hash ROWS UNBOUNDED PRECEDING) AS upto, d.size AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN budget > 0 AND 2 * upto - own <= 2 * budget THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""


def op9_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def part_op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 takes from rules, without the trees."""
    return urls.matched(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "found.rule", F.col("found.verdict").alias("rule_verdict"))


PART_OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(verdict, name, start))
SELECT page_id, host, path, name || start AS rule, verdict AS rule_verdict FROM h LEFT JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(name || start) DESC) = 1
"""


def op10_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(read_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS x FROM d),
l AS (SELECT *, trim(regexp_replace(regexp_replace(lower(x), '\p{N}+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM x WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT t) AS n_docs FROM d GROUP BY source),
seen AS (SELECT source, line, count(DISTINCT t) AS n FROM l GROUP BY source, line HAVING count(DISTINCT t) > 10),
hot AS (SELECT seen.source, line FROM seen JOIN hosts ON seen.source IS NOT DISTINCT FROM hosts.source WHERE n > 0.02::DOUBLE * n_docs),
removed AS (SELECT doc_id, sum(len(regexp_extract_all(l.line, '[^\x20\x09-\x0D]+'))) AS n FROM l JOIN hot ON l.source IS NOT DISTINCT FROM hot.source AND l.line = hot.line GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM l GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE e IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) > 1),
c AS (SELECT doc_id, least(5, i - lag(i, 1, i - 5) OVER (PARTITION BY doc_id ORDER BY i)) AS n FROM r),
repeated AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_removed
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed <= 0.5::DOUBLE * n_words AS kept FROM a
"""

def op11_striped_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"))


def op12_suffix_tree_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.judge(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i:i + 49], ' ') END AS g FROM u),
m AS (SELECT g, min(doc_id) AS low FROM x WHERE g IS NOT NULL GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, word, i, coalesce(bool_or(doc_id > low) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM x LEFT JOIN m USING (g)),
k AS (SELECT doc_id, count_if(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: crc32 of a text's UTF-8 bytes.
TEXT_CRC32_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, octet_length(encode({0}))), lambda k: ('0x' || substr(hex(encode({0})), 2 * k + 1, 2))::BIGINT),
  lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

OP13_SQL = rf"""
WITH x AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
y AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS g FROM benchmark),
d AS (SELECT doc_id, unnest(w) AS g FROM x),
c AS MATERIALIZED (SELECT g, {TEXT_CRC32_SQL.format('g')} % 10000 AS bucket FROM (SELECT g FROM d UNION SELECT g FROM y)),
s AS (SELECT bucket, count(*) AS s FROM d JOIN c USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM y JOIN c USING (g) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000::DOUBLE * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM y) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM d JOIN c USING (g) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x LEFT JOIN weights USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_rank_order_langid, op2_bin_slack_packing, op3_merge_index_dedup, op4_repair_token_files, op5_rule_ensemble_quality,
        op6_noisy_or_toxicity, op7_lsh_forest_join, op8_threshold_mixing, op9_boosted_urls, op10_line_frequency_rules,
        op11_striped_alignment, op12_suffix_tree_substrings, op13_importance_resampling, part_op9_urls,
    )
}
ORACLE_SQL = {"op1_rank_order_langid": OP1_SQL, "op7_lsh_forest_join": OP7_SQL, "part_op9_urls": PART_OP9_SQL, "op3_merge_index_dedup": OP3_SQL, "op8_threshold_mixing": OP8_SQL, "op10_line_frequency_rules": OP10_SQL, "op12_suffix_tree_substrings": OP12_SQL, "op13_importance_resampling": OP13_SQL}
