"""Search over texts: term matching, ranking, BM25, budgets, and grep over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.text import token_estimate
from loomtrace.session import written

#: Okapi BM25.
K1, B = 1.2, 0.75


def terms_of(query: str) -> list[str]:
    """The query's words in lower case, in order, repeated ones kept."""
    return query.lower().split()


def matched_terms(hay: Column, terms: list[str]) -> Column:
    """How many terms stand in the text (as substrings of its lower case)."""
    low = F.lower(hay)
    hits = [F.coalesce(F.contains(low, F.lit(t)).cast("int"), F.lit(0)) for t in terms]
    return sum(hits[1:], hits[0]) if hits else F.lit(0)


def match_any(hay: Column, query: str) -> Column:
    """Any term matches; an empty query matches all."""
    terms = terms_of(query)
    return matched_terms(hay, terms) > 0 if terms else F.lit(True)


def match_all(hay: Column, query: str) -> Column:
    """All terms match."""
    terms = terms_of(query)
    return matched_terms(hay, terms) == len(terms) if terms else F.lit(True)


def freshness(updated: Column, now: str) -> Column:
    """1 for now, a half after 30 days; 0 for no time."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(updated)) / F.lit(86_400e6))
    return F.coalesce(1.0 / (1.0 + age / 30.0), F.lit(0.0))


def rank(docs: DataFrame, query: str, now: str, base: float = 0.2, authority: float = 0.5, limit: int = 20) -> DataFrame:
    """``docs`` (``id, title, text, updated``) that match, best first: ``id, score, freshness``; ties by freshness, then id.

    The whole of ``docs`` is filtered by the terms before the limit, so no match is hidden by it. A plain top-n.
    """
    terms = terms_of(query)
    hay = F.concat_ws(" ", "title", "text")
    fresh = freshness(F.col("updated"), now)
    score = F.lit(base) + matched_terms(hay, terms) / F.lit(max(1, len(terms))) + 0.15 * fresh + 0.1 * authority
    hits = docs.filter(match_any(hay, query)).select("id", F.round(score, 6).alias("score"), F.round(fresh, 6).alias("freshness"))
    return hits.orderBy(F.desc("score"), F.desc("freshness"), "id").limit(limit)


def fit_budget(hits: DataFrame, budget: int, text: str, *order: Column) -> DataFrame:
    """The ranked hits up to, without, the first that overflows the token budget. ``hits`` are the rows of a top-n."""
    upto = F.sum(token_estimate(F.col(text))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.withColumn("tokens_upto", upto).filter(F.col("tokens_upto") <= budget)


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """``id, score`` of the best documents by Okapi BM25 over ``id, text`` (words: runs of letters and digits, lower case).

    One pass: only the counts of the query's words and the length are kept of a document; corpus statistics are sums over all.
    """
    terms = sorted(set(terms_of(query)))
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counted = docs.select("id", words.alias("w")).select("id", F.size("w").alias("len"), *[F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    counted = written(counted)  # a few numbers a text; statistics and scores both read these
    corpus = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    both = counted.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms))) or "false").join(F.broadcast(corpus))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return both.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no (from 1), line``: every line of every text, split at LF, CR LF or CR."""
    return docs.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def grep(docs: DataFrame, key: str, text: str, pattern: str, fixed: bool = False, ignore_case: bool = False) -> DataFrame:
    """The matching lines. Texts without a match are left out before they are split."""
    body = rf"\Q{pattern}\E" if fixed else pattern
    body = f"(?i){body}" if ignore_case else body
    return lines(docs.filter(F.col(text).rlike(body)), key, text).filter(F.col("line").rlike(body))


def grep_counts(docs: DataFrame, key: str, text: str, pattern: str, **how: bool) -> DataFrame:
    """``key, n_lines``: matching lines of each text that has any."""
    return grep(docs, key, text, pattern, **how).groupBy(key).agg(F.count("*").alias("n_lines"))


def grep_context(docs: DataFrame, key: str, text: str, pattern: str, around: int) -> DataFrame:
    """Matching lines with ``around`` lines before and after, each line once: ``key, line_no, line, is_match``.

    Works within each text's own array of lines: no window, no join.
    """
    held = docs.filter(F.col(text).rlike(pattern)).select(key, F.split(text, r"\r\n|\r|\n").alias("all"))
    near = F.transform("all", lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line"), line.rlike(pattern).alias("is_match")))
    shown = F.filter(near, lambda x: F.exists(F.slice(near, F.greatest(F.lit(1), x["line_no"] - around), F.lit(2 * around + 1) - F.greatest(F.lit(0), around - x["line_no"] + 1)), lambda y: y["is_match"]))
    return held.select(key, F.inline(shown))


def line_window(docs: DataFrame, key: str, text: str, offset: int, limit: int, max_chars: int) -> DataFrame:
    """Lines ``offset`` (from 1) to ``offset + limit - 1`` of every text, up to the line that passes ``max_chars`` in all."""
    cut = F.slice(F.split(text, r"\r\n|\r|\n"), offset, limit)
    upto = F.transform(cut, lambda line, i: F.struct((i + offset).alias("line_no"), line.alias("line"), F.aggregate(F.slice(cut, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)).alias("chars_upto")))
    return docs.filter(F.col(text).isNotNull()).select(key, F.inline(F.filter(upto, lambda x: x["chars_upto"] <= max_chars)))


def catalog_search(rows: DataFrame, columns: list[str], query: str, key: str, limit: int) -> DataFrame:
    """Rows whose columns together hold the whole query (trimmed, in lower case), the smallest keys; an empty query matches all."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower()))).orderBy(key).limit(limit)


def matching_records(index: DataFrame, records: DataFrame, key: str, text: str, query: str, **literal: str) -> DataFrame:
    """Records of the index rows that match any word of the query, with fixed values in further columns (filters before the join)."""
    for column, value in literal.items():
        records = records.filter(F.col(column) == value)
    return records.join(index.filter(match_any(F.coalesce(text, F.lit("")), query)).select(key), key)
