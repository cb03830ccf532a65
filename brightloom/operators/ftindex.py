"""A stored inverted index: postings by term, maintained by inserts, updates and deletes, and read by searches.

Every change is a segment: its postings (term, doc_key, tf, doc_len, positions) are range-partitioned and sorted by
term, so that a search reads the row groups of its own terms only and a hot term spreads over files; beside them lie
the change of each term's document frequency, the change of the corpus statistics, and the keys that the segment takes
out of the ones before it. A version is the segments up to its number; readers may pin one. Old rows are tokenised
again by updates and deletes, so the statistics are exact at every version and no segment is rewritten; ``compact``
merges them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators import fulltext
from brightloom.operators.fulltext import B, K1, STOP_WORDS, Term
from brightloom.sources.versions import Versions


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _moved(places: str, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


class FullTextIndex:
    """An index of the text columns of a table below ``path``. Documents have a unique key that is not null."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._versions = Versions(spark, f"{path}/_versions")
        self._known: dict[int, dict] = {}
        how = self._segment(1)["how"]
        self.key, self.columns, self.stop_words, self.blend = how["key"], how["columns"], tuple(how["stop_words"]), how["blend"]

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, columns: Sequence[str], stop_words: Sequence[str] = STOP_WORDS, blend: str = "") -> FullTextIndex:
        """Build the index of a whole table (its back-fill) as version 1."""
        self = cls.__new__(cls)
        self.spark, self.path, self._known = df.sparkSession, path, {}
        self._versions = Versions(self.spark, f"{path}/_versions")
        self.key, self.columns, self.stop_words, self.blend = key, list(columns), tuple(stop_words), blend
        self._write(df, None, 0)
        return self

    def version(self) -> int:
        return self._versions.last()

    def insert(self, rows: DataFrame) -> int:
        """Index more documents; the new version."""
        return self._write(rows, None, self.version())

    def delete(self, old: DataFrame) -> int:
        """Take documents out; ``old`` holds their rows as they were indexed."""
        return self._write(None, old, self.version())

    def update(self, old: DataFrame, new: DataFrame) -> int:
        """Index documents anew; ``old`` holds their rows as they were indexed, ``new`` as they are now."""
        return self._write(new, old, self.version())

    def _words(self, df: DataFrame) -> DataFrame:
        return fulltext.index(df, self.key, fulltext.document(*self.columns), stop_words=self.stop_words, blend=self.blend)

    def _write(self, new: DataFrame | None, old: DataFrame | None, base: int) -> int:
        name = self._versions.draft()
        at = f"{self.path}/{name}"
        counted, change = [], {"docs": 0, "words": 0}
        if new is not None:
            places = self._words(new).select("doc_key", "doc_len", F.posexplode("words").alias("at", "term"))
            postings = places.groupBy("term", "doc_key", "doc_len").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))
            # equal terms are dealt by their documents too: a hot one is many files
            postings.repartitionByRange("term", "doc_key").sortWithinPartitions("term", "doc_key").write.parquet(f"{at}/postings")
            written = self.spark.read.parquet(f"{at}/postings")
            counted.append(written.groupBy("term").agg(F.count("*").alias("df")))
            change["docs"] += new.count()
            change["words"] += written.agg(F.sum("tf")).first()[0] or 0
        if old is not None:
            words = self._words(old)
            words.select("doc_key").write.parquet(f"{at}/deletes")
            counted.append(words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg((-F.count("*")).alias("df")))
            r = words.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("w")).first()
            change["docs"] -= r["n"]
            change["words"] -= r["w"]
        reduce(DataFrame.unionByName, counted).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
        told = {"folder": name, "postings": new is not None, "deletes": old is not None, **change}
        if not base:
            told["how"] = {"key": self.key, "columns": self.columns, "stop_words": list(self.stop_words), "blend": self.blend}
        self._versions.commit(base + 1, json.dumps(told))
        return base + 1

    def _segment(self, k: int) -> dict:
        if k not in self._known:
            self._known[k] = json.loads(self._versions.content(k))
        return self._known[k]

    def _segments(self, version: int | None) -> list[dict]:
        return [self._segment(k) for k in range(1, (self.version() if version is None else version) + 1)]

    def stats(self, version: int | None = None) -> tuple[int, int]:
        """The number of documents (also those without words) and of their words."""
        own = self._segments(version)
        return sum(s["docs"] for s in own), sum(s["words"] for s in own)

    def postings(self, version: int | None = None, only: Column | None = None) -> DataFrame:
        """term, doc_key, doc_len, tf, positions of the documents at a version; ``only`` restricts the terms read."""
        own, out, gone = self._segments(version), [], None
        for s in reversed(own):
            if s["postings"]:
                part = self.spark.read.parquet(f"{self.path}/{s['folder']}/postings")
                part = part.filter(only) if only is not None else part
                out.append(part if gone is None else part.join(gone, "doc_key", "left_anti").select(part.columns))
            if s["deletes"]:
                more = self.spark.read.parquet(f"{self.path}/{s['folder']}/deletes")
                gone = more if gone is None else gone.unionByName(more)
        if not out:
            raise ValueError("the index has no postings")
        return reduce(DataFrame.unionByName, out)

    def terms(self, version: int | None = None) -> DataFrame:
        """term and df, the number of documents that hold it."""
        parts = [self.spark.read.parquet(f"{self.path}/{s['folder']}/terms") for s in self._segments(version)]
        return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def search(self, terms: list[Term], version: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """doc_key and score of the documents that match, best first, equals by key; as ``fulltext.search``, but only
        the rows of the query's terms are read. Document frequencies (one row) are read when the plan is made."""
        version = self.version() if version is None else version
        wanted = [Term(w, required=True) for t in terms if t.phrase and not t.excluded for w in t.phrase] + [t for t in terms if not t.phrase and not t.excluded]
        if not wanted:
            return self.postings(version).select("doc_key", F.lit(0.0).alias("score")).limit(0)
        unwanted = [t for t in terms if t.excluded]
        term = F.col("term")

        def hit(t: Term) -> Column:
            return term.startswith(t.text) if t.prefix else term == t.text

        whole = sorted({t.text for t in wanted + unwanted if not t.prefix and not t.phrase} | {w for t in terms for w in t.phrase})
        only = _any(([term.isin(whole)] if whole else []) + [hit(t) for t in wanted + unwanted if t.prefix])
        parts = [self.spark.read.parquet(f"{self.path}/{s['folder']}/terms").filter(only) for s in self._segments(version)]
        df = reduce(DataFrame.unionByName, parts).agg(*(F.coalesce(F.sum(F.when(hit(t), F.col("df"))), F.lit(0)).alias(f"df{k}") for k, t in enumerate(wanted))).first()
        n_docs, n_words = self.stats(version)
        norm = k1 * (1 - b + b * F.col("doc_len") / (max(n_words, 1) / max(n_docs, 1)))
        weight = F.lit(0.0)
        for k, t in enumerate(wanted):
            idf = F.log(F.lit((n_docs - df[k] + 0.5) / (df[k] + 0.5) + 1))
            weight = weight + F.when(hit(t), idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).otherwise(0.0)
        phrases = [t for t in terms if t.phrase]
        flags = [F.max(hit(t)).alias(f"has{k}") for k, t in enumerate(wanted)] + [F.max(hit(t)).alias(f"not{k}") for k, t in enumerate(unwanted) if not t.phrase]
        places = {w: f"at{k}" for k, w in enumerate(sorted({w for t in phrases for w in t.phrase}))}
        flags += [F.max(F.when(term == w, F.col("positions"))).alias(name) for w, name in places.items()]
        found = self.postings(version, only).groupBy("doc_key").agg(F.sum(weight).alias("score"), *flags)
        found = found.filter(_any([F.col(f"has{k}") for k in range(len(wanted))]))
        for k, t in enumerate(wanted):
            found = found.filter(F.col(f"has{k}")) if t.required else found
        for k, t in enumerate(unwanted):
            found = found.filter(~F.col(f"not{k}")) if not t.phrase else found
        for t in phrases:
            shifted = [_moved(places[w], k) for k, w in enumerate(t.phrase)]
            adjacent = F.coalesce(F.size(reduce(F.array_intersect, shifted)) > 0, F.lit(False))
            found = found.filter(~adjacent if t.excluded else adjacent)
        return found.select("doc_key", "score").orderBy(F.desc("score"), "doc_key")

    def match(self, query: str, boolean: bool = False, version: int | None = None) -> DataFrame:
        """``search`` by a query's text."""
        return self.search(fulltext.parse_boolean(query, self.stop_words) if boolean else fulltext.parse_natural(query, self.stop_words, self.blend), version)

    def compact(self, df: DataFrame, path: str) -> FullTextIndex:
        """The index of the table as it is now, in one segment below another path."""
        return FullTextIndex.create(df, path, self.key, self.columns, self.stop_words, self.blend)
