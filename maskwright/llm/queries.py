"""The registered queries of the operators and, where SQL can say them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.llm import divergence, fim, language, lm, minhash, mixing, packing, quality, rules, secrets, topk, toxicity, vectors
from maskwright.llm.common import fold, sent_if_small, unit_draw
from maskwright.session import cut


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the four fifths whose id is not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold("doc_id", 5) != 0))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("__lang").alias("lang_pred"),
                      F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels and texts that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))
    out = toxicity.score(docs, model).withColumnRenamed("__score", "score")
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors."""
    return vectors.near_duplicate_vectors(embeddings(spark, sf_dir))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every vector whose id is divisible by 100."""
    rows = embeddings(spark, sf_dir)
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from the six sevenths that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = lm.score(docs, fold("doc_id", 7) != 2)
    return out.withColumn("held_out", fold("doc_id", 7) == 2)


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards those labelled as good, learned from labels that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = cut(labels.where((F.col("quality") == 1) & (fold("doc_id", 5) != 0)).select("doc_id").distinct())
    out = quality.resample(docs, quality.fit(docs.join(sent_if_small(good), "doc_id", "left_semi"), docs))
    return out.withColumn("held_out", fold("doc_id", 5) == 0)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    out = mixing.copies(docs)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base kinds as counts and digest, all spans as text."""
    out = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"__{n}").alias(n) for n, _ in secrets.RESULT])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and rearranged, and put together again."""
    moved = fim.restore(fim.transform(documents(spark, sf_dir).select("doc_id", "text")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{n}_sha256") for c, n in (("__output", "output"), ("__restored", "restored"))]
    return moved.select("doc_id", F.col("__units").alias("n"), F.col("__form").alias("form"), F.col("__prefix_chars").alias("prefix_chars"),
                        F.col("__middle_chars").alias("middle_chars"), *digests)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in their terms, and which terms mark a source."""
    return divergence.audit(documents(spark, sf_dir))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; the trusted texts are four fifths of those labelled as good."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.where((F.col("quality") == 1) & (unit_draw(41, "doc_id") < 0.8)).select("doc_id")
    out = rules.judge(docs, rules.fit(docs, good))
    return out.select("doc_id", *[F.col(f"__{n}").alias(n) for n in rules.RESULT])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_minhash_dedup, op3_toxicity, op4_embedding_dedup, op5_exact_top_k, op6_context_mixing,
              op7_importance_resampling, op8_mix_sources, op9_best_fit_packing, op10_secret_scan, op11_fill_in_middle,
              op12_source_divergence, op13_quality_rules)
}

_WORDS = r"'[^\x20\x09-\x0D]+'"

SQL: dict[str, str] = {
    "op2_minhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END, ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON w.doc_id = c.x""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE ok),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN n ON v.vec_id = n.x JOIN c ON v.vec_id = c.x""",
    "op5_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op8_mix_sources": rf"""
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
t AS (SELECT *, 3.0::DOUBLE * ss AS stop, (ARRAY[5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
u AS (SELECT *, stop / w AS rise FROM t),
l AS (SELECT *, (sum(ss) OVER () - coalesce(sum(stop) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM u
  WINDOW o AS (ORDER BY rise, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, ss, least(stop, (SELECT level FROM l WHERE level <= rise ORDER BY rise, source NULLS LAST LIMIT 1) * w) AS target FROM l),
r AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE least(target / ss, 3.0::DOUBLE) END AS rate FROM g)
SELECT d.doc_id, d.size::BIGINT AS size, r.ss AS source_size, r.target,
  (d.size * (floor(rate) + (('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(d.text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::INT))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), k AS (
  SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), c AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), n AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), gt AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM gt JOIN v USING (lang)
), lt AS (SELECT lang, term, sum(c) AS c FROM gt GROUP BY lang, term
), q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS q FROM lt JOIN v USING (lang)
), f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op13_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents
), lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) > 4)
), twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice CROSS JOIN range(5) AS o(k) GROUP BY r
), base AS (
  SELECT d.r, doc_id, t, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)
), u AS (SELECT r, doc_id, list_transform(string_split(t, ''), lambda x: unicode(x)::BIGINT) AS u FROM d WHERE length(t) > 2
), g AS (SELECT r, doc_id, unnest(list_transform(range(1, len(u) - 1), lambda i: ((u[i] * 1000003 + u[i + 1]) * 1000003 + u[i + 2]) % 2147483647 % 65536)) AS b FROM u
), draws AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5('41:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS held,
    ('0x' || substr(md5('53:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS part FROM labels WHERE quality = 1
), good AS (SELECT doc_id, part < 0.25 AS sets FROM draws WHERE held < 0.8
), n AS (SELECT b, count(*) AS raw, count(*) FILTER (WHERE NOT sets) AS target FROM g LEFT JOIN good USING (doc_id) GROUP BY b
), s AS (SELECT sum(raw) + 65536 AS raws, sum(target) + 65536 AS targets FROM n
), logs AS (SELECT b, round(1e6 * ln(((target + 1) * raws)::DOUBLE / ((raw + 1) * targets)::DOUBLE))::BIGINT AS x FROM n, s
), scores AS (SELECT r, doc_id, sum(x)::DOUBLE / count(*) AS score FROM g JOIN logs USING (b) GROUP BY r, doc_id
), least AS (SELECT quantile_cont(score, 0.005) - 250000 AS score FROM scores JOIN good USING (doc_id) WHERE sets
), f AS (SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(scores.score, 0) AS score FROM base LEFT JOIN scores USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.score >= least.score AS kept, f.score FROM f, least""",
}
