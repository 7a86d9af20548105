"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.llm import ann_tree, bpe, line_index, merkle, ngram_join, packing, pii, quality, resampling, sharding, token_file, toxicity, vector_codes
from headwise.llm.common import read_table, scratch_path, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary() -> str:
    """The vocabulary file that the queries use; the operators take any path."""
    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    both = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_file.write(read_table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=0)
    back = token_file.read(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=pii.EVERY)
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(F.col("spans"), pii.BASE), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
        pii.scores(F.col("spans")).alias("scores"),
    )


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


@query("op5_merkle_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(read_table(spark, sf_dir, "documents"))


@query("op6_nearest_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann_tree.search(vectors, F.col("vec_id") % 20 == 0, k=20)


@query("op7_site_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    scored = quality.posterior(docs, read_table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "evidence", "site_rate", "quality", (F.col("quality") >= quality.KEEP).cast("int").alias("keep")
    )


@query("op8_exact_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), shards=40)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
    )


@query("op10_mixture_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


#: CRC-32 by bytes from a table of 256 steps; features are distinct before they get their bucket.
RESAMPLING_SQL = r"""WITH steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) r(i))),
    texts AS (SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
    cut AS MATERIALIZED (SELECT own, doc_id, row_number() OVER () AS rid, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    found AS MATERIALIZED (SELECT own, rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM cut),
    hashed AS MATERIALIZED (SELECT f, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(0, strlen(f)),
            lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT), lambda s, b: xor(t[xor(s % 256, b) + 1], s // 256))) % 10000 AS bucket
        FROM (SELECT DISTINCT f FROM found), steps),
    counted AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM found JOIN hashed USING (f) GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counted),
    summed AS (SELECT rid, sum(gain)::BIGINT AS total FROM found JOIN hashed USING (f) JOIN gains USING (bucket) WHERE own GROUP BY rid),
    scored AS (SELECT doc_id, len(w) AS words, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features,
            coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
            (weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT) AS score
        FROM cut LEFT JOIN summed USING (rid) WHERE own),
    placed AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (words >= 20) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM placed"""


@query("op11_importance_resampling", RESAMPLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: Keys are counted over documents; lines of a common key stay in the largest document only.
LINE_SQL = r"""WITH ends AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS white),
    lines AS MATERIALIZED (SELECT doc_id, i, line, translate(trim(line, white), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents), ends),
    common AS (SELECT key, max(doc_id) AS largest FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT doc_id, i, line, largest IS NOT NULL AND doc_id < largest AS gone FROM lines LEFT JOIN common USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""


@query("op12_line_dedup", LINE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_index.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def vector_code_sql(rounds: int = 4) -> str:
    """Rounds of nearest entries and floored means as a chain of tables; nearest: smallest distance, then smallest index."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, p, min(d * 256 + e) AS best FROM (
            SELECT rid, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM cut JOIN b{r} USING (p, pos) GROUP BY rid, p, e) GROUP BY rid, p)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT p, e, pos, coalesce(m, c) AS c FROM b{r} LEFT JOIN (
                SELECT p, best % 256 AS e, pos, (sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS m
                FROM a{r} JOIN cut USING (rid, p) GROUP BY ALL) USING (p, e, pos))""")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS rid, len(embedding) AS n,
            list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS xs
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS MATERIALIZED (SELECT rid, i // (n // 4) AS p, i % (n // 4) AS pos, x FROM (
            SELECT rid, n, unnest(xs) AS x, unnest(range(n)) AS i FROM kept)),
        b0 AS MATERIALIZED (SELECT p, rid AS e, pos, x AS c FROM cut WHERE rid < 256),
        {", ".join(steps)},
        coded AS (SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY rid)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
            (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, pos)) FROM b{rounds}) AS codebooks_sha256 FROM kept JOIN coded USING (rid)"""


@query("op13_vector_codes", vector_code_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))
