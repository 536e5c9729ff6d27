"""The thin queries opN_<name>: an operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gale.llm.common import fresh, table
from gale.llm.decontaminate import decontaminate
from gale.llm.exact_dedup import exact_dedup
from gale.llm.exact_topk import top_k
from gale.llm.line_dedup import line_dedup
from gale.llm.maxent_lm import lm_scores
from gale.llm.packing import pack
from gale.llm.periodic_runs import find_runs, repeat_tail
from gale.llm.quality import quality_scores
from gale.llm.registry import register
from gale.llm.resharding import reshard
from gale.llm.secret_scan import scan_secrets
from gale.llm.simhash import simhash_dedup
from gale.llm.spelling import drop_letter, spelling_groups
from gale.llm.url_filter import judge_urls

_NORM = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@register("op1_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256({_NORM}) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY {_NORM})""")
def op1_exact_dedup(spark, sf_dir):
    """Exact dedup of all documents by an extendible-hash index on shared files."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("bucket", "chain")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op6_packing")
def op6_packing(spark, sf_dir):
    """Concatenate-and-cut packing of all documents in windows of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(), 4096, 2).drop("ids")


@register("op4_simhash_dedup")
def op4_simhash_dedup(spark, sf_dir):
    """SimHash near-dedup of all documents: 3-word shingles, links at 3 or fewer bits."""
    return simhash_dedup(table(spark, sf_dir, "documents"), 3, 3)


_WORDS = rf"regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op9_decontaminate", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
       FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
             FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
occ AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op9_decontaminate(spark, sf_dir):
    """Prefix-filtered set join of all documents with the benchmark's 10-word windows."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


@register("op8_quality")
def op8_quality(spark, sf_dir):
    """Quality score of all documents: random-indexing vectors and a two-layer network."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op5_resharding")
def op5_resharding(spark, sf_dir):
    """Minimum-cost-flow resharding of all documents from their files into 40 shards of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    old = fresh(docs, "file")
    out = reshard(docs.withColumn(old, F.col("_metadata.file_path")), old, 40)
    text = F.coalesce("text", F.lit(""))
    return out["rows"].select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col(out["shard_col"]).alias("shard"), F.col(out["slot_col"]).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@register("op7_lm_scores")
def op7_lm_scores(spark, sf_dir):
    """Hashed maximum-entropy language model: log10 probability of every document."""
    return lm_scores(table(spark, sf_dir, "documents"))


@register("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    """Secrets in all documents: rules and a character CNN over every other candidate."""
    return scan_secrets(table(spark, sf_dir, "documents"))


# The rules the contract fixes.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]


@register("op3_url_filter")
def op3_url_filter(spark, sf_dir):
    """Verdict on every page's url: rules, else trust and distrust over host links."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register("op10_line_dedup")
def op10_line_dedup(spark, sf_dir):
    """Lines of all documents that are similar (Jaccard 0.8 on word sets) to an earlier line."""
    out = line_dedup(table(spark, sf_dir, "documents"), min_words=1)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
                      F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


@register("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    """Runs of repeated words in all documents, after the contract's planted periods."""
    out = find_runs(table(spark, sf_dir, "documents"), 6, 4, rewrite=repeat_tail)
    # exact order of length / period: a fraction is larger if the cross product is
    best = F.expr("""aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>), (a, r) ->
        IF(a IS NULL OR r.length * a.period > a.length * r.period, r, a))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@register("op12_exact_topk", """
WITH e AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""")
def op12_exact_topk(spark, sf_dir):
    """The 5 largest inner products of every query vector, over all vectors."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256)


@register("op13_spelling_variants")
def op13_spelling_variants(spark, sf_dir):
    """Words of all documents, grouped by one-edit spelling variants."""
    return spelling_groups(table(spark, sf_dir, "documents"), 5, 3, 2, rewrite=drop_letter)
