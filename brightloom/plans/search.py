"""Full-text, spatial and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions import spatial, vector
from brightloom.operators import fulltext
from brightloom.operators.ftindex import FullTextIndex
from brightloom.plans.registry import Tables, query
from brightloom.sources import scratch

_STOP = "[" + ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS) + "]"


def _words(stop: str = _STOP, text: str = "text") -> str:
    """The index words of a text in the oracle's SQL."""
    return (f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: lower(w)), "
            f"lambda w: length(w) BETWEEN 3 AND 84 AND NOT list_contains({stop}, w))")


def _base(documents: str = "documents") -> str:
    return f"ix AS (SELECT doc_id, w, len(w) AS dl FROM (SELECT doc_id, {_words()} AS w FROM {documents})), st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM ix)"


_BASE = _base()


def _scored(terms: list[str], where: str, documents: str = "documents") -> str:
    """BM25 over whole words; ``where`` picks documents by tf0, tf1, …"""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    score = " + ".join(f"ln((n - df{k} + 0.5) / (df{k} + 0.5) + 1) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(terms)))
    return f"WITH {_base(documents)}, tf AS (SELECT *, {tf} FROM ix), df AS (SELECT {df} FROM tf) SELECT doc_id, round({score}, 6) AS score FROM tf, st, df WHERE {where}"


_stored: dict[tuple[str, str], FullTextIndex] = {}
_CHANGED = "doc_id % 10 = 3"
_NEW_TEXT = "a license to change the version of this worthless text"


def _index(t: Tables) -> FullTextIndex:
    """The stored index of the documents, built once in a session and then read by every search. Version 1 is the table; version 2 has some texts
    changed, version 3 has some documents less."""
    key = (t.spark.sparkContext.applicationId, t.directory)
    if key not in _stored:
        _stored[key] = FullTextIndex.create(t.documents, scratch.folder(t.spark, "fulltext"), "doc_id", ["text"])
    return _stored[key]


def _found(t: Tables, q: str, boolean: bool = True, version: int = 1):
    ix = _index(t)
    if version > 1 and ix.version() < 2:
        old = t.documents.filter(_CHANGED)
        ix.update(old, old.withColumn("text", F.lit(_NEW_TEXT)))
    if version > 2 and ix.version() < 3:
        ix.delete(t.documents.filter("doc_id % 10 = 7"))
    return ix.match(q, boolean, version).select(F.col("doc_key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, CAST(len(w) AS INT) AS doc_len, len(list_distinct(w)) AS n_terms FROM (SELECT doc_id, {_words()} AS w FROM documents)")
def fts_tokenize_stats(t: Tables):
    ix = fulltext.index(t.documents, "doc_id", F.col("text"))
    return ix.select(F.col("doc_key").alias("doc_id"), "doc_len", F.size(F.array_distinct("words")).cast("long").alias("n_terms"))


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_words()}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def fts_postings(t: Tables):
    return _index(t).postings(1).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("SELECT s.doc_id, score, quality, toxic FROM (" + _scored(["only", "license", "worthless"], "tf0 + tf1 + tf2 > 0") + ") s LEFT JOIN labels l ON s.doc_id = l.doc_id ORDER BY score DESC, s.doc_id LIMIT 20")
def fts_natural(t: Tables):
    best = _found(t, "only license worthless", False).orderBy(F.desc("score"), "doc_id").limit(20)
    return best.join(t.labels, "doc_id", "left").orderBy(F.desc("score"), "doc_id")


@query(_scored(["license", "version", "apache"], "tf0 > 0 AND tf1 > 0"))
def fts_bool_required(t: Tables):
    return _found(t, "+license +version apache")


@query(_scored(["license"], "tf0 > 0 AND NOT list_contains(w, 'apache')"))
def fts_bool_excluded(t: Tables):
    return _found(t, "-apache +license")


@query(f"WITH {_BASE}, m AS (SELECT doc_id, dl, x, count(*) AS tf FROM (SELECT doc_id, dl, unnest(list_filter(w, lambda x: starts_with(x, 'licens'))) AS x FROM ix) GROUP BY 1, 2, 3), df AS (SELECT count(*) AS df FROM m) "
       "SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM m, st, df GROUP BY doc_id")
def fts_prefix(t: Tables):
    return _found(t, "licens*")


@query(_scored(["general", "public", "license"], "contains('|' || array_to_string(w, '|') || '|', '|general|public|license|')"))
def fts_phrase(t: Tables):
    return _found(t, '"general public license"')


_AFTER = f"(SELECT doc_id, CASE WHEN {_CHANGED} THEN '{_NEW_TEXT}' ELSE text END AS text FROM documents)"


@query(_scored(["license", "worthless"], "tf0 + tf1 > 0", _AFTER))
def fts_after_update(t: Tables):
    return _found(t, "license worthless", False, 2)


@query(_scored(["license", "worthless"], "tf0 > 0 AND NOT list_contains(w, 'apache')", f"(SELECT * FROM {_AFTER} WHERE doc_id % 10 <> 7)"))
def fts_after_delete(t: Tables):
    return _found(t, "+ license - apache worthless", True, 3)


@query(f"WITH {_BASE} SELECT count(*) AS n FROM ix WHERE list_contains(w, 'license') OR list_contains(w, 'idiot')")
def fts_match_count(t: Tables):
    return _found(t, "license idiot", False).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(len(w) AS INT) AS doc_len FROM (SELECT doc_id, {_words(chr(91) + chr(39) + 'and' + chr(39) + ', ' + chr(39) + 'que' + chr(39) + chr(93))} AS w FROM documents)")
def fts_custom_stopwords(t: Tables):
    return fulltext.index(t.documents, "doc_id", F.col("text"), stop_words=("AND", "que")).select(F.col("doc_key").alias("doc_id"), "doc_len")


@query("SELECT doc_id, CAST(len(w) AS INT) AS doc_len FROM (SELECT doc_id, list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '[0-9A-Za-z\\x{80}-\\x{10FFFF}.]+'), "
       "lambda w: CASE WHEN contains(w, '.') THEN list_concat([w], regexp_split_to_array(w, '[.]+')) ELSE [w] END)), lambda w: lower(w)), "
       f"lambda w: length(w) BETWEEN 3 AND 84 AND NOT list_contains({_STOP}, w)) AS w FROM documents)")
def fts_blend(t: Tables):
    return fulltext.index(t.documents, "doc_id", F.col("text"), blend=".").select(F.col("doc_key").alias("doc_id"), "doc_len")


# --- rectangles made of numbers: a part's price and size, a query box of constants

_BOXES = "(SELECT p_partkey, p_retailprice AS x0, p_size AS y0, p_retailprice + 10 AS x1, p_size + 5 AS y1 FROM part)"


def _boxes(t: Tables):
    box = spatial.box(F.col("p_retailprice"), F.col("p_size"), F.col("p_retailprice") + 10, F.col("p_size") + 5)
    return t.part.select("p_partkey", box.alias("b"))


_Q = (910.0, 10.0, 1000.0, 30.0)


def _query_box():
    return spatial.box(*(F.lit(v) for v in _Q))


@query(f"SELECT p_partkey FROM {_BOXES} WHERE x0 <= 1000 AND x1 >= 910 AND y0 <= 30 AND y1 >= 10")
def mbr_intersects(t: Tables):
    return _boxes(t).filter(spatial.intersects(F.col("b"), _query_box())).select("p_partkey")


@query(f"SELECT p_partkey FROM {_BOXES} WHERE x0 >= 910 AND x1 <= 1000 AND y0 >= 10 AND y1 <= 30")
def mbr_within(t: Tables):
    return _boxes(t).filter(spatial.within(F.col("b"), _query_box())).select("p_partkey")


@query(f"SELECT p_partkey FROM {_BOXES} WHERE x0 >= 910 AND x1 <= 1000 AND y0 >= 10 AND y1 <= 30")
def mbr_contains(t: Tables):
    return _boxes(t).filter(spatial.contains(_query_box(), F.col("b"))).select("p_partkey")


@query("SELECT a.p_partkey FROM part a JOIN part b ON b.p_partkey = 5 AND a.p_size = b.p_size AND a.p_retailprice = b.p_retailprice")
def mbr_equal(t: Tables):
    one = F.broadcast(_boxes(t).filter("p_partkey = 5").select(F.col("b").alias("q")))  # one row
    return _boxes(t).crossJoin(one).filter(spatial.equal(F.col("b"), F.col("q"))).select("p_partkey")


@query(f"SELECT p_partkey FROM {_BOXES} WHERE NOT (x0 <= 1000 AND x1 >= 910 AND y0 <= 30 AND y1 >= 10)")
def mbr_disjoint(t: Tables):
    return _boxes(t).filter(spatial.disjoint(F.col("b"), _query_box())).select("p_partkey")


_TRACK = "(SELECT s_suppkey, s_nationkey * 4.0 AS x, s_acctbal / 100 AS y FROM supplier)"


@query(f"SELECT s_suppkey FROM {_TRACK} WHERE x <= 60 AND x + 3 >= 20 AND y <= 50 AND y + 2 >= 10")
def mbr_from_geometry(t: Tables):
    x, y = F.col("s_nationkey") * 4.0, F.col("s_acctbal") / 100
    line = F.format_string("LINESTRING(%s %s, %s %s)", *(v.cast("string") for v in (x, y, x + 3, y + 2)))
    return t.supplier.filter(spatial.intersects(spatial.mbr_from_wkt(line), spatial.box(F.lit(20), F.lit(10), F.lit(60), F.lit(50)))).select("s_suppkey")


@query(f"SELECT s_suppkey FROM {_TRACK} WHERE x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 50")
def mbr_from_binary(t: Tables):
    point = spatial.wkb_point(F.col("s_nationkey") * 4.0, F.col("s_acctbal") / 100)
    return t.supplier.filter(spatial.within(spatial.mbr_from_wkb(point), spatial.box(F.lit(20), F.lit(10), F.lit(60), F.lit(50)))).select("s_suppkey")


# --- vectors

_V = [round((-1) ** k * 0.05 * (k % 7 + 1), 3) for k in range(64)]
_VSQL = "[" + ", ".join(map(str, _V)) + "]::DOUBLE[]"


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_VSQL}), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_VSQL}), vec_id LIMIT 10")
def vec_l2_topk(t: Tables):
    return vector.nearest(t.embeddings, "embedding", "vec_id", _V, 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {_VSQL}), 6) AS distance FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_VSQL}), vec_id LIMIT 10")
def vec_cosine_topk(t: Tables):
    return vector.nearest(t.embeddings, "embedding", "vec_id", _V, 10, vector.cosine_distance).select("vec_id", F.round("distance", 6).alias("distance"))
