"""The numbered queries: each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import langid, lm
from holdfast.llm.alignment import aligned
from holdfast.llm.ann import nearest
from holdfast.llm.decontaminate import contamination
from holdfast.llm.hard_negatives import hard_negatives
from holdfast.llm.licenses import license_scan
from holdfast.llm.mixing import mixed
from holdfast.llm.near_dedup import near_duplicates
from holdfast.llm.packing import packed
from holdfast.llm.pii import find_personal
from holdfast.llm.registry import QUERIES, SQL, query, read
from holdfast.llm.substring_dedup import deduplicated
from holdfast.llm.toxicity import fit, fold, toxicity, training_rows

__all__ = ["QUERIES", "SQL"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_PLAIN}, []) AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS x
        FROM item, unnest(generate_series(1, greatest(1, len(w) - 9))) AS g(k) WHERE len(w) > 0),
place AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS x
          FROM doc, (SELECT DISTINCT n FROM win), unnest(generate_series(1, len(w) - n + 1)) AS g(k)),
found AS (SELECT r, k, n, item FROM place JOIN win USING (n, x)),
hit AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM found, unnest(generate_series(0, n - 1)) AS g(j) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""")
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of documents inside an occurrence of a benchmark window of ten words."""
    found = contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document, disguised forms included. Counts and digest are of the base spans."""
    return find_personal(read(spark, folder, "documents"), keep=["doc_id"])


@query()
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers
    return packed(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


@query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt outside the fold that is held out."""
    docs = read(spark, folder, "documents")
    model = fit(training_rows(docs, read(spark, folder, "labels")))
    scored = toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op1_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learnt outside the fold that is held out."""
    docs = read(spark, folder, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(langid.training_texts(docs.filter(~held), "doc_id", "text", "lang"))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM d, unnest(generate_series(1, len(w) - 19)) AS g(i)),
old AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM old, unnest(generate_series(0, 19)) AS g(j)),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without windows of 20 words that also start earlier."""
    left = deduplicated(read(spark, folder, "documents"), keep=["doc_id"])
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op5_lm(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every document, learnt outside the fold that is held out."""
    docs = read(spark, folder, "documents")
    held = fold(F.col("doc_id"), 5) == 1
    model = lm.fit(docs.filter(~held))
    out = lm.scored(docs, model, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_duplicates(read(spark, folder, "documents"))


@query()
def op4_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return nearest(read(spark, folder, "embeddings"))


@query()
def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """The licences that every document states."""
    return license_scan(read(spark, folder, "documents"), keep=["doc_id"])


@query()
def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of one and a half times all words takes of every document, its sources weighed 3, 1, 2 in turn."""
    out = mixed(read(spark, folder, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5""")
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Five positives of every hundredth vector, and for each five negatives that score nearly as high."""
    rows = read(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


@query()
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by two tokenizers, in groups of the same bytes, and their links."""
    import public_tokenizers
    return aligned(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                   public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
