"""Full-text search with BM25, in natural-language and boolean mode.

The terms of a query are few and known when the plan is made, so a search explodes nothing: each document's words are
an array made by built-in functions, and a term's frequency, a prefix's expansions and a phrase are told from it row by
row. One aggregation gives the corpus statistics, and one join with their single row the scores.

Boolean mode: ``+word`` is required, ``-word`` excludes (wherever it stands in the query), ``word*`` is a prefix and
``"a phrase"`` is required, or excluded after ``-``. Words of a boolean query are not filtered by length or stop words,
so a required stop word finds nothing. The words of a phrase are adjacent after stop words have gone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, LONGEST, K1, B = 3, 84, 1.2, 0.75
#: The default stop words: fixed values.
STOP_WORDS = (
    "a", "about", "an", "are", "as", "at", "be", "by", "com", "de", "en", "for", "from", "how", "i", "in", "is", "it", "la", "of", "on", "or",
    "that", "the", "this", "to", "was", "what", "when", "where", "who", "will", "with", "und", "www",
)
_WORD = "[0-9A-Za-z\\u0080-\\x{10FFFF}]+"


def _word_class(blend: str) -> str:
    return _WORD[:-2] + re.escape(blend) + "]+"


def tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS, shortest: int = SHORTEST, longest: int = LONGEST, blend: str = "") -> Column:
    """The index words of a text: runs of ASCII letters and digits and all characters beyond ASCII, lower-cased, of
    ``shortest`` to ``longest`` characters, without stop words. A word that holds one of the ``blend`` characters
    counts whole and then in parts. Null gives no words."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_word_class(blend) if blend else _WORD})"), F.lit(1))
    if blend:
        parts = "[" + re.escape(blend) + "]+"
        words = F.flatten(F.transform(words, lambda w: F.when(w.rlike(parts), F.concat(F.array(w), F.split(w, parts))).otherwise(F.array(w))))
    words = F.transform(words, lambda w: F.lower(w))
    stop = sorted(set(w.lower() for w in stop_words))
    keep = F.filter(words, lambda w: (F.length(w) >= shortest) & (F.length(w) <= longest))
    return F.filter(keep, lambda w: ~w.isin(stop)) if stop else keep


def document(*columns: str) -> Column:
    """Several columns as one text; nulls are left out."""
    return F.concat_ws(" ", *columns)


@dataclass(frozen=True)
class Term:
    text: str
    required: bool = False
    excluded: bool = False
    prefix: bool = False
    phrase: tuple[str, ...] = ()


def parse_natural(query: str, stop_words: Iterable[str] = STOP_WORDS, blend: str = "") -> list[Term]:
    """The words of a query, each as often as it stands there."""
    stop = {w.lower() for w in stop_words}
    out = []
    for w in re.findall(f"[0-9A-Za-z\u0080-\U0010ffff{re.escape(blend)}]+", query):
        for part in [w, *(re.split(f"[{re.escape(blend)}]+", w) if blend and re.search(f"[{re.escape(blend)}]", w) else [])]:
            if SHORTEST <= len(part) <= LONGEST and part.lower() not in stop:
                out.append(Term(part.lower()))
    return out


def parse_boolean(query: str, stop_words: Iterable[str] = STOP_WORDS) -> list[Term]:
    """Operators bind to the word or phrase that follows, also after blanks; of several signs the last counts."""
    out = []
    for sign, phrase, word, star in re.findall("([+-]?)\\s*(?:\"([^\"]*)\"|([0-9A-Za-z\u0080-\U0010ffff]+)(\\*?))", query):
        if phrase:
            words = tuple(t.text for t in parse_natural(phrase, stop_words))
            if words:
                out.append(Term(phrase.lower(), sign != "-", sign == "-", phrase=words))
        elif word:
            out.append(Term(word.lower(), sign == "+", sign == "-", prefix=bool(star)))
    return out


def index(df: DataFrame, key: str, text: Column, **how) -> DataFrame:
    """key, words (array) and doc_len of every row: the form that searches read, and that can be written once."""
    return df.select(F.col(key).alias("doc_key"), tokens(text, **how).alias("words")).withColumn("doc_len", F.size("words"))


def postings(index_: DataFrame) -> DataFrame:
    """term, doc_key, tf, doc_len: one row for each word of each document."""
    return index_.select("doc_key", "doc_len", F.explode("words").alias("term")).groupBy("term", "doc_key", "doc_len").agg(F.count("*").alias("tf"))


def corpus_stats(index_: DataFrame) -> DataFrame:
    """One row: n_docs (also those without words), n_words, avgdl (1 if there are no documents)."""
    return index_.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("n_words")).withColumn(
        "avgdl", F.when(F.col("n_docs") > 0, F.col("n_words") / F.col("n_docs")).otherwise(1.0))


def _hits(term: Term) -> Column:
    """The distinct words of a document that a term stands for."""
    if term.prefix:
        return F.array_distinct(F.filter("words", lambda w: w.startswith(term.text)))
    return F.when(F.array_contains("words", term.text), F.array(F.lit(term.text))).otherwise(F.array().cast("array<string>"))


def _has_phrase(words: tuple[str, ...]) -> Column:
    return F.contains(F.concat(F.lit("\x00"), F.array_join("words", "\x00"), F.lit("\x00")), F.lit("\x00" + "\x00".join(words) + "\x00"))


def search(index_: DataFrame, terms: list[Term], k1: float = K1, b: float = B) -> DataFrame:
    """doc_key and score of the documents that match, best first, equals by key. No terms, no documents.

    score = sum of ln((N - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avgdl)) over
    the words hit; df counts the postings of a term, for a prefix those of all its expansions."""
    wanted = [Term(w, required=True) for t in terms if t.phrase and not t.excluded for w in t.phrase] + [t for t in terms if not t.phrase and not t.excluded]
    if not wanted:
        return index_.select("doc_key", F.lit(0.0).alias("score")).limit(0)
    rows = index_
    for k, t in enumerate(wanted):
        rows = rows.withColumn(f"hit{k}", F.transform(_hits(t), lambda h: F.size(F.filter("words", lambda w: w == h))))
    stats = rows.agg(
        F.count("*").alias("n_docs"), F.sum("doc_len").alias("n_words"), *(F.sum(F.size(f"hit{k}")).alias(f"df{k}") for k in range(len(wanted))))
    found = F.lit(False)
    for k in range(len(wanted)):
        found = found | (F.size(f"hit{k}") > 0)
    for k, t in enumerate(wanted):
        if t.required:
            found = found & (F.size(f"hit{k}") > 0)
    for t in terms:
        if t.phrase:
            found = found & (~_has_phrase(t.phrase) if t.excluded else _has_phrase(t.phrase))
        elif t.excluded:
            found = found & (F.size(_hits(t)) == 0)
    rows = rows.filter(found).crossJoin(F.broadcast(stats))  # one row of statistics
    norm = k1 * (1 - b + b * F.col("doc_len") / F.greatest(F.col("n_words") / F.col("n_docs"), F.lit(1e-9)))
    score = F.lit(0.0)
    for k in range(len(wanted)):
        idf = F.log((F.col("n_docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5) + 1)
        score = score + idf * F.aggregate(f"hit{k}", F.lit(0.0), lambda acc, tf: acc + tf * (k1 + 1) / (tf + norm))
    return rows.select("doc_key", score.alias("score")).orderBy(F.desc("score"), "doc_key")


def match(df: DataFrame, key: str, text: Column, query: str, boolean: bool = False, stop_words: Iterable[str] = STOP_WORDS, blend: str = "") -> DataFrame:
    """``search`` of a table's text in one step."""
    terms = parse_boolean(query, stop_words) if boolean else parse_natural(query, stop_words, blend)
    return search(index(df, key, text, stop_words=tuple(stop_words), blend=blend), terms)
