"""Text operators: chunks, tags, sentences, vector search, and checks of answers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import kept

#: Rules that one part of a word's list holds, about.
HOT = 4096

#: Phrases by which an answer declines.
REFUSALS = ("i cannot", "i can't", "not able to", "unable to", "no information", "does not contain", "not found in", "cannot determine", "insufficient information")
#: Transitions after which a declining answer goes on regardless.
TRANSITIONS = ("however", "that said", "nevertheless", "based on", "in general", "generally")


def words(col: Column) -> Column:
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def chunk_words(docs: DataFrame, size: int = 512, overlap: int = 64, key: str = "doc_id") -> DataFrame:
    """Overlapping windows of words: chunk_id, first and last word, number of words, text. The last window is the first that reaches the end.

    Words are what stands between white space, so the text has single spaces whatever the document had. A document's
    chunks are cut before they become rows: no row carries the words of the whole document.
    """
    step = size - overlap
    rows = docs.select(key, words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / F.lit(float(step)))).cast("int")

    def chunk(i: Column) -> Column:
        first = i * step
        return F.struct(i.alias("i"), first.alias("first"), F.least(first + size, F.size("w")).alias("end"), F.array_join(F.slice("w", first + 1, F.lit(size)), " ").alias("text"))

    rows = rows.select(key, F.explode(F.transform(F.sequence(F.lit(0), last), chunk)).alias("c"))
    number = F.lpad(F.col("c.i").cast("string"), 4, "0")
    return rows.select(key, F.concat(F.col(key).cast("string"), F.lit("_chunk_"), number).alias("chunk_id"), F.col("c.i").alias("chunk_index"), F.col("c.first").alias("first_word"), F.col("c.end").alias("end_word"), (F.col("c.end") - F.col("c.first")).alias("word_count"), F.col("c.text").alias("text"))


def tag_text(df: DataFrame, taxonomy: dict[str, tuple[str, ...]], text: str = "text") -> DataFrame:
    """Classes any of whose keywords stands in the text, in the taxonomy's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return df.withColumn("tags", F.array_compact(F.array(*[F.when(reduce(Column.__or__, [low.contains(w) for w in ws]), F.lit(k)) for k, ws in taxonomy.items()])))


def page_headings(df: DataFrame, least: int = 50) -> DataFrame:
    """Texts of a length, with their heading: the first line that isn't empty, if it is short and doesn't end like a sentence."""
    line = F.trim(F.element_at(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1))
    ok = (F.length(line) < 80) & ~line.rlike("[.,;]$")
    return df.where(F.length(F.trim("text")) >= least).withColumn("heading", F.when(ok, line))


def stable_id(col: Column) -> Column:
    """The first eight hexadecimal digits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long")


def cosine(a: str, b: str) -> Column:
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(F.col(x), F.col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def dedupe_hits(hits: DataFrame, key: str, by: str, order: str) -> DataFrame:
    """The first of each key in a group."""
    return hits.withColumn("n", F.row_number().over(Window.partitionBy(by, key).orderBy(order))).where("n = 1").drop("n")


def split_sentences(df: DataFrame, text: str = "text", most_words: int = 200) -> DataFrame:
    """Sentences after bullets and semicolons became breaks; none if there are fewer than two or one is too long."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[•‣▪]", "\n"), r";\n", ".\n")
    sentences = F.filter(F.transform(F.split(clean, r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: s != "")
    fine = (F.size(sentences) >= 2) & ~F.exists(sentences, lambda s: F.size(F.split(s, r"\s+")) > most_words)
    return df.withColumn("sentences", F.when(fine, sentences).otherwise(F.array().cast("array<string>")))


def is_refusal(col: Column) -> Column:
    low = F.lower(F.coalesce(col, F.lit("")))
    return reduce(Column.__or__, [low.contains(p) for p in REFUSALS])


def select_sentences(sentences: DataFrame, k: int = 2, least: float = 0.3) -> DataFrame:
    """The k sentences nearest to the answer of each chunk, none where the nearest is too far. sentences: chunk_id, i, v, answer."""
    rows = sentences.withColumn("score", cosine("v", "answer"))
    w = Window.partitionBy("chunk_id")
    rows = rows.withColumns({"best": F.max("score").over(w), "place": F.row_number().over(w.orderBy(F.desc("score"), "i"))})
    return rows.where((F.col("best") >= least) & (F.col("place") <= k)).select("chunk_id", "i", "score", "place")


def trim_answers(df: DataFrame, answer: str = "answer", relevance: str | None = None, keep_from: float = 0.55) -> DataFrame:
    """A declining answer that goes on after a soft transition is cut to its first sentence and a clean closing one."""
    sentences = F.split(F.trim(F.coalesce(answer, F.lit(""))), r"(?<=[.!?])\s+")
    first, last, rest = F.element_at(sentences, 1), F.element_at(sentences, -1), F.lower(F.array_join(F.slice(sentences, 2, 10_000), " "))
    soft = reduce(Column.__or__, [rest.contains(t) for t in TRANSITIONS]) | rest.rlike(r"(^|\s)[0-9]+\.\s.*chunk")
    closing = F.size(F.split(last, r"\s+")).between(5, 35) & ~F.lower(last).rlike("chunk|however")
    cut = is_refusal(first) & soft & (F.size(sentences) > 1)
    if relevance:
        cut = cut & (F.coalesce(relevance, F.lit(0.0)) < keep_from)
    return df.withColumns({"was_trimmed": cut, "trimmed": F.when(cut, F.when(closing & (F.size(sentences) > 2), F.concat(first, F.lit(" "), last)).otherwise(first)).otherwise(F.col(answer))})


def scope_checks(df: DataFrame, text: str, dimensions: dict[str, tuple[str, ...]]) -> DataFrame:
    """Which dimensions a question names: any of its words as a whole word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return df.withColumns({f"names_{k}": low.rlike(r"(^|\W)(" + "|".join(ws) + r")(\W|$)") for k, ws in dimensions.items()})


class TermTrie:
    """Terms of several words each, found in texts by the longest match at each word."""

    def __init__(self, terms: list[tuple[str, str, str]]):
        self.root: dict = {}
        for dimension, term, value in terms:
            node = self.root
            for word in term_words(term):
                node = node.setdefault(word, {})
            if node is not self.root:
                node.setdefault(None, []).append((dimension, value))

    def found(self, text: str) -> list[tuple[str, str]]:
        words, out, at = term_words(text), [], 0
        while at < len(words):
            node, end, held = self.root, at, []
            for k in range(at, len(words)):
                node = node.get(words[k])
                if node is None:
                    break
                if None in node:
                    end, held = k + 1, node[None]
            out += held
            at = max(end, at + 1)
        return out


def term_words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


#: Terms that a trie is made of at most: every task holds them.
MOST_TERMS = 200_000


def scope_gaps(df: DataFrame, terms: DataFrame, rules: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, mismatched, unsupported): what a question names and the rules don't have, each a sorted list of dimension:value.

    terms: dimension, term (one word or several), value. rules: dimension, value of the rules that were retrieved. A value that is named, of a
    dimension the rules do have, but under no rule, is mismatched; of a dimension that no rule has, unsupported. Of
    terms that overlap the longest counts (``west virginia`` isn't ``virginia``); a null text names nothing.
    """
    found = [tuple(r) for r in terms.select("dimension", "term", "value").where("term is not null").distinct().limit(MOST_TERMS + 1).collect()]
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    of = sorted(found)

    @F.pandas_udf("array<struct<dimension string, value string>>")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = TermTrie(of)
        for texts in batches:
            yield pd.Series([[{"dimension": d, "value": v} for d, v in sorted(set(trie.found(t)))] if isinstance(t, str) else [] for t in texts], index=texts.index)

    rows = df.select(*key, named(F.col(text)).alias("named"))
    has = rules.groupBy("dimension").agg(F.collect_set("value").alias("values")).agg(F.map_from_entries(F.collect_list(F.struct("dimension", "values"))).alias("has"))  # the rules' few dimensions
    rows = rows.crossJoin(F.broadcast(has))  # one row

    def listed(keep) -> Column:
        return F.transform(F.filter("named", keep), lambda x: F.concat(x["dimension"], F.lit(":"), x["value"]))

    known = lambda x: F.map_contains_key("has", x["dimension"])
    return rows.select(*key, listed(lambda x: known(x) & ~F.array_contains(F.element_at("has", x["dimension"]), x["value"])).alias("mismatched"), listed(lambda x: ~known(x)).alias("unsupported"))


def answer_confidence(df: DataFrame) -> DataFrame:
    """Both sources high, one medium, none low; a scope warning caps it at medium; without grounds it is low."""
    n = F.col("has_rules").cast("int") + F.col("has_policy").cast("int")
    level = F.when(n == 2, F.when(F.col("scope_warning"), "medium").otherwise("high")).when(n == 1, "medium").otherwise("low")
    return df.withColumn("confidence", F.when(F.col("grounded"), level).otherwise("low"))


def clean_citations(df: DataFrame, text: str = "text", pattern: str = r"\[([0-9]+)\]") -> DataFrame:
    """Citation numbers in order, and the text without their markers."""
    return df.withColumns({"citations": F.regexp_extract_all(text, F.lit(pattern), 1), "clean": F.regexp_replace(text, r"\s*" + pattern, "")})


def assemble_contexts(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """One list of contexts from several columns of lists, each with its prefix."""

    def prefixed(column: str, prefix: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"[{prefix}] "), x))

    return df.withColumn("contexts", F.concat(*[prefixed(c, prefix) for c, prefix in sources.items()]))


def lookup_rules(queries: DataFrame, rules: DataFrame, k: int = 5) -> DataFrame:
    """Rules by the number of distinct words they share with a query.

    A rule's text may stand on any number of rows: its words are made distinct by Spark, not within a row. Each side's words
    become numbers of a dictionary, rare words first; words of one side only are nobody's partner. A word of more than HOT
    rules is dealt into parts, and each of its queries meets every part, so that no task holds a word's rows alone; what
    one task then sums for a (query, rule) goes on as a partial count.
    """
    def tokens(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != ""))).alias("token")).distinct()

    asked, held = kept(tokens(queries, "query_id")), kept(tokens(rules, "rule_id"))
    counts = held.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts"))
    counts = kept(counts)
    held = held.join(counts, "token").select("rule_id", "token", F.pmod(F.xxhash64("rule_id"), F.col("parts")).cast("int").alias("part"))
    asked = asked.join(counts, "token").select("query_id", "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    hits = asked.join(held, ["token", "part"]).groupBy("query_id", "rule_id").agg(F.count(F.lit(1)).alias("score"))
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rule_id"))).where(F.col("place") <= k)
