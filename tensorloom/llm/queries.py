"""Queries over the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, jaccard_join, language_id, lm_scoring, mixing, packing, periodic_runs, quality, suffix_dedup, token_counts, topk, toxicity, warc
from .common import new_folder, stage, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; of a null id as of empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % n


def op1_rank_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("held_out", remainder(4) == 2)
    learned = language_id.learn(d.where(~F.col("held_out")))
    d = language_id.predict(d.select("doc_id", "held_out", "text"), learned, keep=("held_out",))
    return d.select("doc_id", "held_out", "lang_pred", "score")


def op2_digest_cache(spark, sf_dir):
    import public_tokenizers

    d = token_counts.token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), new_folder(spark, "token-cache"), separable=True)
    return d.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op4_warc_zstd(spark, sf_dir):
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_array(spark, sf_dir):
    d = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), kept_text=False, keep=["doc_id"])
    return d.select("doc_id", F.col("__sd_n_bytes").alias("n_bytes"), F.col("__sd_n_removed").alias("n_removed"), F.col("__sd_n_spans").alias("n_spans"), F.col("__sd_kept").alias("kept_sha256"))


def op7_ball_tree(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_length_buckets(spark, sf_dir):
    d = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "length", "bucket", "bucket_length", "batch", "padding")


def op5_weak_supervision(spark, sf_dir):
    d = quality.features(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__q_f")
    d = stage(d, "quality")
    d = quality.judge(d, quality.fit(d))
    f = F.col("__q_f")
    return d.select("doc_id", *[f[c].alias(c) for c in quality.BASE], quality.base_failed(f).alias("base_failed"), F.col("__q_kept").alias("kept"), F.col("__q_p").alias("quality"))


def op8_context_mixing(spark, sf_dir):
    held_out = remainder(7) == 2
    d = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    d = lm_scoring.score(d, ~F.col("held_out"), keep=("held_out",))
    return d.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_token_combinations(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op10_systematic_mix(spark, sf_dir):
    d = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return d.select(
        F.col("__mix_key").alias("doc_id"),
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in texts of ids whose crc32 h is a multiple of 10 the words from a = g % n on repeat the first p of them, with g = floor(h / 10) and p = 1 + floor((n - a) / (3 + g % 8))."""
    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def repeated(x):
        w, g, n = x["w"], x["g"], F.size(x["w"])
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")

    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8"))
    d = docs.select("doc_id", "text", h.alias("h"))
    of = bound(F.struct(words(F.col("text")).alias("w"), F.floor(F.col("h") / 10).alias("g")), lambda x: F.when(F.size(x["w"]) > 0, repeated(x)))
    return d.select("doc_id", F.when(F.col("h") % 10 == 0, of).otherwise(F.col("text")).alias("text"))


def op11_suffix_automaton(spark, sf_dir):
    d = periodic_runs.periodic_runs(planted(table(spark, sf_dir, "documents")))
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_label_model(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("held_out", remainder(5) == 0)
    model = toxicity.learn(d.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.score(d, model, keep=("held_out",))


def op13_kd_filter(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rank_order": op1_rank_order,
        "op2_digest_cache": op2_digest_cache,
        "op4_warc_zstd": op4_warc_zstd,
        "op6_suffix_array": op6_suffix_array,
        "op7_ball_tree": op7_ball_tree,
        "op3_length_buckets": op3_length_buckets,
        "op5_weak_supervision": op5_weak_supervision,
        "op8_context_mixing": op8_context_mixing,
        "op9_token_combinations": op9_token_combinations,
        "op10_systematic_mix": op10_systematic_mix,
        "op11_suffix_automaton": op11_suffix_automaton,
        "op12_label_model": op12_label_model,
        "op13_kd_filter": op13_kd_filter,
    }


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(source_size AS DOUBLE) AS sz,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
      FROM s),
p AS (SELECT *, 2 * sz AS cap, row_number() OVER (ORDER BY 2 * sz / w, source NULLS LAST) AS pos,
             1.5::DOUBLE * sum(sz) OVER () - coalesce(sum(2 * sz) OVER (ORDER BY 2 * sz / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2 * sz / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest
      FROM w),
f AS (SELECT rest, w_rest FROM p WHERE NOT (cap * w_rest <= rest * w) ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN cap * w_rest <= rest * w THEN cap ELSE w * (SELECT rest FROM f) / (SELECT w_rest FROM f) END AS target,
             CAST(('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 4)) AS BIGINT) / 65536.0::DOUBLE AS u
      FROM p),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, digest, doc_id) AS i FROM d)
SELECT r.doc_id, r.size, t.source_size, t.target,
       CAST(least(2, floor(i * (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) + u)
                   - floor((i - 1) * (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) + u)) AS BIGINT) * r.size AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""


OP7_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.rid <> q.rid AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op13_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Every vector against every centroid in each round; sums and distances in whole numbers."""
    out = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS j, e AS c
       FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, e FROM v ORDER BY h, e LIMIT {k}))"""
    ]
    nearest = "SELECT rid, arg_min(j, [d, j]) AS j, min(d) AS d FROM (SELECT rid, j, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i}) GROUP BY rid"
    for i in range(rounds):
        out.append(f"a{i} AS MATERIALIZED ({nearest.format(i=i)})")
        out.append(
            f"""m{i} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM (
  SELECT j, pos, sum(x) AS s, count(*) AS n
  FROM (SELECT a.j, unnest(range({dim})) AS pos, unnest(v.e) AS x FROM a{i} a JOIN v ON v.rid = a.rid) GROUP BY j, pos) GROUP BY j)"""
        )
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.j = c{i}.j)")
    return f"""{", ".join(out)},
f AS MATERIALIZED ({nearest.format(i=rounds)})
SELECT v.vec_id, f.j AS cluster, CAST(f.d AS BIGINT) AS distance,
       CAST(sum(f.d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(f.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM f JOIN v ON v.rid = f.rid JOIN c{rounds} c ON c.j = f.j"""


def oracle_sql() -> dict[str, str]:
    return {"op13_kd_filter": op13_sql(), "op7_ball_tree": OP7_SQL, "op10_systematic_mix": OP10_SQL}
