"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm import (
    centroids,
    common,
    decontaminate,
    html_text,
    language,
    lines,
    mixing,
    neighbours,
    pii,
    pseudo_likelihood,
    simhash,
    tokens,
    toxicity,
    whitening,
)

#: Pieces that words are cut into.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled ones that are not held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = common.remainder("doc_id", 5) == 0
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxic_flag").alias("above_language_threshold"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = common.table(spark, sf_dir, "documents")
    sized = common.stage(docs.select("doc_id", "source", mixing.words("text").alias("size")))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.remainder("doc_id", 3) == 1
    model = language.train(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of disclosing terms in every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, keep_text=False, everywhere=True, generalise=pii.GENERALISE_FROM_LARGE)

    def joined(spans: str) -> Column:
        shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(shown, ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    every = F.array(F.nullif(joined("base"), F.lit("")), F.nullif(joined("added"), F.lit("")))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined("base"), 256).alias("base_sha256"),
        F.array_join(F.array_compact(every), ",").alias("spans"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near-duplicates of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = common.stage(simhash.fingerprints(docs).select("doc_id", "fp"))
    return simhash.components(marked).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, read by the wrapper of its host."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    wrappers = common.stage(html_text.infer_wrappers(pages))
    found = html_text.extract(pages, wrappers)
    return found.select(
        "page_id",
        "url",
        F.col("main_text").alias("text"),
        F.char_length("main_text").cast("long").alias("n_chars"),
    )


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and mean of the log probabilities of every document's words."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudo_likelihood.score(docs, pseudo_likelihood.train(docs), keep_text=False)
    return found.select("doc_id", "n_words", "log_likelihood", "mean_log_likelihood")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document hit by windows of the benchmark, and the items they are from."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_token_counts(
    spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Greedy word-piece lengths of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tokens.count_tokens(docs, tokens.read_vocabulary(vocabulary))
    return found.select("doc_id", "n_tokens")


OP8_SQL = r"""
WITH lowered AS (
  SELECT 0 AS side, row_number() OVER () AS rid, CAST(doc_id AS VARCHAR) AS id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
  UNION ALL
  SELECT 1, 0, CAST(item_id AS VARCHAR),
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  FROM benchmark
), worded AS MATERIALIZED (
  SELECT side, rid, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), item_windows AS MATERIALIZED (
  SELECT DISTINCT id AS item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM worded WHERE side = 1 AND len(w) > 0)
), doc_windows AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM worded, (SELECT DISTINCT k FROM item_windows) WHERE side = 0 AND len(w) >= k)
), found AS MATERIALIZED (
  SELECT d.rid, d.i, d.k, b.item_id FROM doc_windows d JOIN item_windows b ON d.k = b.k AND d.win = b.win
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM found)) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid
)
SELECT CAST(w.id AS BIGINT) AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
       CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.w) AS contaminated
FROM worded w LEFT JOIN hit h USING (rid) LEFT JOIN named n USING (rid)
WHERE w.side = 0
"""

def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth, out of all."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = neighbours.build_index(vectors, k=20)
    return neighbours.search(index, vectors.where("vec_id % 20 = 0"), k=20)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the first principal components, whitened."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = whitening.whiten(vectors, whitening.fit(vectors))
    # Sums of squares beyond a long (from some 10^9 rows on) are null here, exact in the operator.
    deviation = F.col("deviation").try_cast("bigint").alias("deviation")
    return found.select("vec_id", "component", "n", deviation, "whitened", "explained", "identity_error")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    sums = [F.col(c).try_cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")]
    digest = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    return centroids.cluster(vectors).select("vec_id", "cluster", *sums, digest)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the lines that another one had first."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.drop_shared_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _op12_sql() -> str:
    """The rounds written out one after the other; whole numbers below 2**53 are exact as doubles."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64
)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY mark, x) - 1 AS cluster, x AS c
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS mark, x FROM kept ORDER BY 1, 2 LIMIT 8)
)""",
    ]
    for turn in range(centroids.ROUNDS + 1):
        parts.append(
            f"""a{turn} AS MATERIALIZED (
  SELECT rid, min(p) AS best FROM (
    SELECT rid, struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), cluster := cluster) AS p
    FROM kept, c{turn})
  GROUP BY rid
)"""
        )
        if turn == centroids.ROUNDS:
            break
        parts.append(
            f"""c{turn + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{turn} o LEFT JOIN (
    SELECT cluster, list(mean ORDER BY i) AS c FROM (
      SELECT cluster, i, floor(sum(v) / count(*)) AS mean FROM (
        SELECT a.best.cluster AS cluster, unnest(k.x) AS v, generate_subscripts(k.x, 1) AS i
        FROM kept k JOIN a{turn} a USING (rid))
      GROUP BY cluster, i)
    GROUP BY cluster) m USING (cluster)
)"""
        )
    last = centroids.ROUNDS
    return (
        "WITH "
        + ", ".join(parts)
        + f"""
SELECT k.vec_id, CAST(a.best.cluster AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(f.c, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM kept k JOIN a{last} a USING (rid) JOIN c{last} f ON f.cluster = a.best.cluster
"""
    )


OP13_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), worded AS (
  SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM split
), keyed AS MATERIALIZED (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM worded
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT k.rid, k.doc_id, k.line, k.place, s.key IS NOT NULL AND k.doc_id <> s.first AS gone
      FROM keyed k LEFT JOIN shared s ON k.key = s.key)
GROUP BY rid, doc_id
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_main_text": op6_main_text,
    "op7_pseudo_likelihood": op7_pseudo_likelihood,
    "op8_decontamination": op8_decontamination,
    "op9_neighbours": op9_neighbours,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_centroids": op12_centroids,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES = {"op8_decontamination": OP8_SQL, "op12_centroids": _op12_sql(), "op13_line_dedup": OP13_SQL}
