"""Queries over text operators, on documents, benchmark items, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nearest
from ..operators import texts as T
from .fixtures import view
from .registry import query

TAXONOMY = {"contact": ("555-", "@"), "license": ("license", "licensed"), "insult": ("idiot", "moron", "loser", "clown"), "list": (" | ",)}
W = "[x for x in string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+') if x <> '']"
CHUNKS = f"WITH d AS (SELECT doc_id, {W} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 512) / 448.0)) AS INTEGER) + 1)) AS i FROM d WHERE len(w) > 0)"


@query(CHUNKS + " SELECT doc_id, concat(CAST(doc_id AS VARCHAR), '_chunk_', lpad(CAST(i AS VARCHAR), 4, '0')) AS chunk_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 448 AS INTEGER) AS first_word, CAST(least(i * 448 + 512, len(w)) AS INTEGER) AS end_word, CAST(least(i * 448 + 512, len(w)) - i * 448 AS INTEGER) AS word_count, md5(array_to_string(w[i * 448 + 1:i * 448 + 512], ' ')) AS text_md5 FROM c")
def document_chunks(spark, sf_dir):
    return T.chunk_words(view(spark, sf_dir, "documents")).withColumn("text_md5", F.md5("text")).drop("text")


@query("SELECT doc_id, array_to_string([x for x in [" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in TAXONOMY.items()) + "] if x IS NOT NULL], ',') AS tags FROM documents")
def document_tags(spark, sf_dir):
    return T.tag_text(view(spark, sf_dir, "documents"), TAXONOMY).select("doc_id", F.concat_ws(",", "tags").alias("tags"))


@query("SELECT doc_id, CASE WHEN length(h) < 80 AND NOT regexp_matches(h, '[.,;]$') THEN h END AS heading FROM (SELECT doc_id, trim([x for x in string_split(text, chr(10)) if trim(x) <> ''][1]) AS h FROM documents WHERE length(trim(text)) >= 50)")
def document_headings(spark, sf_dir):
    return T.page_headings(view(spark, sf_dir, "documents")).select("doc_id", "heading")


@query("SELECT doc_id, CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) AS stable_id FROM documents")
def stable_ids(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.stable_id(F.col("doc_id").cast("string")).alias("stable_id"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT query_id, vec_id, round(score * 1.0000000001::DOUBLE, 4) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (SELECT query_id, vec_id, list_cosine_similarity(q, v) AS score FROM q, v WHERE q.query_id <> v.vec_id)) WHERE place <= 5")
def cosine_top_k(spark, sf_dir):
    """Queries: every vec_id divisible by 20, against all rows."""
    vectors = view(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return nearest.cosine_top_k(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), vectors, 5)


TOKENS = "unnest(list_distinct([x for x in string_split_regex(lower(text), '[^a-z0-9_]+') if x <> '']))"


@query(f"WITH q AS (SELECT item_id AS query_id, {TOKENS} AS token FROM benchmark), r AS (SELECT DISTINCT source AS rule_id, {TOKENS} AS token FROM documents WHERE lang = 'en') SELECT query_id, rule_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rule_id) AS place FROM (SELECT query_id, rule_id, count(*) AS score FROM q JOIN r USING (token) GROUP BY ALL)) WHERE place <= 5")
def keyword_lookup(spark, sf_dir):
    """Rules: all words of a source's English documents."""
    docs = view(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("source").alias("rule_id"), "text")
    return T.lookup_rules(view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), docs)


@query(f"WITH q AS (SELECT DISTINCT item_id AS query_id, {TOKENS} AS token FROM benchmark), r AS (SELECT DISTINCT source AS rule_id, {TOKENS} AS token FROM documents) SELECT query_id, rule_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rule_id) AS place FROM (SELECT query_id, rule_id, count(*) AS score FROM q JOIN r USING (token) GROUP BY ALL)) WHERE place <= 5")
def keyword_lookup_whole(spark, sf_dir):
    """Rules: all words of a source's documents, in every language."""
    docs = view(spark, sf_dir, "documents").select(F.col("source").alias("rule_id"), "text")
    return T.lookup_rules(view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), docs)


@query("SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in T.REFUSALS) + " AS refusal FROM conversations WHERE role = 'assistant'")
def refusals(spark, sf_dir):
    return view(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refusal"))


@query("SELECT conv_id, turn, len(s) AS sentences FROM (SELECT conv_id, turn, [trim(x) for x in string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(10), 'g'), chr(10) || '+', chr(10), 'g'), chr(10)) if trim(x) <> ''] AS s FROM conversations) WHERE len(s) >= 2")
def sentence_counts(spark, sf_dir):
    return T.split_sentences(view(spark, sf_dir, "conversations")).where(F.size("sentences") > 0).select("conv_id", "turn", F.size("sentences").cast("long").alias("sentences"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^a-z0-9_])(the|of)([^a-z0-9_]|$)') AS names_english, regexp_matches(lower(text), '(^|[^a-z0-9_])(der|die)([^a-z0-9_]|$)') AS names_german FROM conversations")
def scope_words(spark, sf_dir):
    return T.scope_checks(view(spark, sf_dir, "conversations"), "text", {"english": ("the", "of"), "german": ("der", "die")}).select("conv_id", "turn", "names_english", "names_german")


@query("SELECT event_id, array_to_string(regexp_extract_all(props, '([0-9]+)', 1), ',') AS numbers, regexp_replace(props, '[0-9]+', '', 'g') AS clean FROM events")
def event_markers(spark, sf_dir):
    rows = T.clean_citations(view(spark, sf_dir, "events").select("event_id", "props"), "props", "([0-9]+)")
    return rows.select("event_id", F.concat_ws(",", "citations").alias("numbers"), F.regexp_replace("props", "[0-9]+", "").alias("clean"))
