"""The driver's queries for this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import alignment, collocations, licences, lines, minhash, mixing, neighbours, packing, quality, rans, simhash, toxicity, warc
from .common import table


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_toxic_words")


def op3_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return rans.token_archive(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 1).read(digest=True)


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.write_archive(table(spark, sf_dir, "pages")).digest()


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.minhash_components(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return alignment.align(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, b, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS first_id FROM d),
s AS (SELECT *, ('0x' || h) AS hx FROM f)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM s
"""

OP11_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS raw FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(raw, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT lang, unnest(flatten([ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
  list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])])) AS phrase FROM w),
f AS (SELECT lang, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, phrase),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT *, len(ws) AS k FROM f WHERE a >= 10 AND len(ws) > 1),
cut AS (SELECT *, unnest([1, 2]) AS cut_at FROM c),
parts AS (SELECT lang, phrase, a, cut_at, array_to_string(ws[:cut_at], ' ') AS x, array_to_string(ws[cut_at + 1:], ' ') AS y FROM cut WHERE cut_at < k),
scored AS (SELECT parts.lang, parts.phrase, parts.a, cut_at, l.a AS l, r.a AS r, (1000000::HUGEINT * parts.a * parts.a) // (l.a::HUGEINT * r.a) AS score
  FROM parts JOIN f l ON l.lang = parts.lang AND l.phrase = x JOIN f r ON r.lang = parts.lang AND r.phrase = y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
inside AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3),
gone AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY lang, phrase),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN gone USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def queries() -> dict:
    every = (op1_licence_scan, op2_toxicity_crf, op3_token_archive, op4_simhash_components, op5_quality_rules, op6_multiprobe_neighbours, op7_line_dedup, op8_source_mix, op9_warc_archive, op10_best_fit_packing, op11_collocations, op12_minhash_components, op13_token_alignment)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc_archive": OP9_SQL, "op11_collocations": OP11_SQL}
