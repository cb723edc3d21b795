"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm import (
    collocations,
    decontaminate,
    hmm,
    licenses,
    merkle,
    mixing,
    packing,
    pii,
    quality,
    repair,
    sharding,
    simhash,
    substrings,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_neighbours(_table(spark, sf_dir, "documents"))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.text_scores(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, given = F.col("pii_spans"), F.filter("pii_spans", lambda s: s["given"])
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(of(kind.name) for kind in pii.KINDS),
        F.sha2(pii.listed(given), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(_table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeated(_table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")), marked=True)


ALL = {
    f.__name__: f
    for f in (
        op1_licenses,
        op2_simhash,
        op3_quality,
        op4_packing,
        op5_decontamination,
        op6_merkle,
        op7_hmm,
        op8_pii,
        op9_sharding,
        op10_substrings,
        op11_mixing,
        op12_collocations,
        op13_repair,
    )
}
# DuckDB twins. The others have none: hashes, models, tokens, seeded orders or checked spans are beyond its SQL.
ORACLE = {
    "op10_substrings": r"""
        WITH texts AS MATERIALIZED (
            SELECT row_number() OVER () AS row_no, doc_id,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents),
        starts AS MATERIALIZED (
            SELECT row_no, i, array_to_string(words[i : i + 34], ' ') AS run
            FROM (SELECT row_no, words, unnest(range(1, len(words) - 33)) AS i FROM texts)),
        repeated AS (SELECT run FROM starts GROUP BY run HAVING count(*) > 1),
        covered AS (
            SELECT DISTINCT row_no, unnest(range(i, i + 35)) AS place FROM starts SEMI JOIN repeated USING (run)),
        kept AS (
            SELECT row_no, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS words
            FROM (SELECT row_no, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts)
            ANTI JOIN covered USING (row_no, place) GROUP BY row_no)
        SELECT doc_id, len(t.words) AS n_words, len(t.words) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(k.words, '')) AS kept_sha256
        FROM texts t LEFT JOIN kept k USING (row_no)""",
    "op11_mixing": rf"""
        WITH RECURSIVE texts AS MATERIALIZED (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS size,
                   md5(coalesce(text, '')) AS digest
            FROM documents),
        dealt AS (
            SELECT *, (row_number() OVER (PARTITION BY doc_id, source, digest) - 1) // {mixing.COPIES} AS chunk FROM texts),
        spotted AS (
            SELECT *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || digest || ':' || chunk || ':{mixing.SEED}'),
                                      1, 12))::bigint AS spot
            FROM dealt),
        sources AS MATERIALIZED (
            SELECT source, sum(size)::bigint AS source_size,
                   {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight
            FROM texts GROUP BY source),
        levels AS (
            SELECT 0 AS round, 0.0::double AS level
            UNION ALL
            SELECT round + 1, coalesce(
                (sum(source_size) * {mixing.SHARE_PERCENT}
                 - coalesce(sum(source_size) FILTER (weight * level > {mixing.MOST} * source_size), 0) * {100 * mixing.MOST})::double
                / (100 * sum(weight) FILTER (weight * level <= {mixing.MOST} * source_size))::double, 'inf')
            FROM levels, sources WHERE round < 64 GROUP BY round, level),
        seats AS MATERIALIZED (
            SELECT *, source_size // {mixing.BLOCK} AS full_blocks, (source_size + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS blocks,
                   floor(target / {mixing.BLOCK} + 0.5)::bigint AS quota,
                   ('0x' || substr(md5('blocks:' || coalesce(source, '') || ':{mixing.SEED}'), 1, 12))::bigint
                   % greatest(source_size // {mixing.BLOCK}, 1) AS shift
            FROM (SELECT source, source_size, least(weight * level, {mixing.MOST}.0::double * source_size) AS target
                  FROM sources, levels WHERE round = 64)),
        placed AS MATERIALIZED (
            SELECT t.doc_id, t.size, s.*, row_number() OVER () AS row_no,
                   coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY spot % {mixing.ROWS}, spot // {mixing.ROWS} % {mixing.CELLS},
                                            spot, digest, doc_id, chunk
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
            FROM spotted t JOIN seats s ON t.source IS NOT DISTINCT FROM s.source),
        met AS (
            SELECT row_no, start, size, quota, blocks, full_blocks, shift,
                   unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) AS block
            FROM placed WHERE size > 0),
        seated AS (
            SELECT *, CASE WHEN block < full_blocks
                      THEN ({mixing.PRIME}::hugeint * block + shift) % full_blocks ELSE full_blocks END AS seat
            FROM met),
        takes AS (
            SELECT row_no, sum((least((block + 1) * {mixing.BLOCK}, start + size) - greatest(block * {mixing.BLOCK}, start))
                               * ((seat < quota)::int + (seat + blocks < quota)::int))::bigint AS taken
            FROM seated GROUP BY row_no)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN takes USING (row_no)""",
    "op12_collocations": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), '{collocations.UPPER.decode()}', '{collocations.LOWER.decode()}'),
                                             '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        texts AS MATERIALIZED (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
        phrases AS MATERIALIZED (
            SELECT lang, size, phrase, count(*) AS f
            FROM (SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2),
                                                           lambda i: array_to_string(words[i : i + size - 1], ' '))) AS phrase
                  FROM texts, range(1, {collocations.LONGEST + 1}) AS sizes(size))
            GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::bigint AS n FROM phrases WHERE size = 1 GROUP BY lang),
        candidates AS MATERIALIZED (
            SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM phrases
            WHERE size > 1 AND f >= {collocations.LEAST}),
        cuts AS (
            SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS first_part, array_to_string(words[k + 1 :], ' ') AS rest
            FROM candidates, range(1, {collocations.LONGEST}) AS ks(k) WHERE k < size),
        scored AS (
            SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, ({collocations.SCALE}::hugeint * c.a // (x.f + y.f))::bigint AS score
            FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = first_part
            JOIN phrases y ON y.lang = c.lang AND y.phrase = rest),
        lowest AS (
            SELECT lang, phrase, a, min({{score: score, k: k, l: l, r: r}}) AS cut FROM scored GROUP BY ALL),
        inside AS (
            SELECT lang, array_to_string(words[i : i + n - 1], ' ') AS phrase, max(a) AS longer
            FROM candidates, range(2, {collocations.LONGEST}) AS ns(n), range(1, {collocations.LONGEST}) AS ids(i)
            WHERE n < size AND i + n - 1 <= size GROUP BY ALL),
        ranked AS (
            SELECT l.lang, row_number() OVER (PARTITION BY l.lang ORDER BY cut.score DESC, a DESC, l.phrase) AS rank, l.phrase, a,
                   cut.l AS l, cut.r AS r, cut.score AS score
            FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.phrase = l.phrase
            WHERE longer IS NULL OR 100 * longer < {collocations.COVERED_PERCENT} * a)
        SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals USING (lang) WHERE rank <= {collocations.TOP}""",
}
