"""MinHash near-dedup by fast similarity sketching (operator 3).

Sketch: in round i every shingle is thrown into one of ``t`` bins with a random value, and a bin keeps the least
(round, value); rounds t .. 2t-1 send all shingles to bin i-t, so that every coordinate is filled for certain, and a
text stops as soon as all its bins are full (about t log t hash values instead of t times the set's size). Equal
coordinates estimate the Jaccard similarity with the concentration of independent min-hashes.

Steps: sketch -> one representative for each distinct shingle set -> banding (``bands`` of ``rows`` coordinates; at
similarity 0.75 the default misses a pair with probability 2e-5) -> exact check on the full sets -> components. In a
bucket, members are first compared with the bucket's least document; then, among what this leaves in different
components, all pairs of different components whose sketches may belong to similar sets (two bits of each coordinate are
compared; a pair at the threshold fails this with probability 3e-5). So a group of n near copies costs n exact
comparisons and not n squared, and texts that only share a passage are told apart by their sketches.

A hot bucket, as a common passage makes, is dealt once more: its members meet only where they also agree in the bits of
one of ``FINE`` choices of ``FINE_WIDTH`` coordinates. A pair at the threshold agrees in none with probability 6e-7; two
texts of similarity 0.3 agree in any with 0.008, so that the pairs to look at are fewer by that factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shingles import U64, WordHashes, as_binary, mix, pieces, release, set_name, shingle_sets
from .workspace import Workspace

SHINGLE, THRESHOLD, COORDINATES, BANDS, ROWS = 5, 75, 512, 40, 5
#: Bits of each coordinate that pairs of a bucket are compared by.
PLANES = 2
#: Bits of the filter that keeps texts without candidates out of the second pass; its size never grows: beyond one
#: candidate for 8 bits a join does the same.
FILTER_BITS = 1 << 26
_BUCKET_BITS = 32768
#: Members from which a bucket is hot, and the choices of coordinates that deal it once more.
HOT, FINE, FINE_WIDTH = 4096, 256, 14


def sketch(values: np.ndarray, starts: np.ndarray, t: int) -> np.ndarray:
    """The sketches (texts x t, uint64) of sets given one after another; a row of an empty set is all ones."""
    docs = len(starts) - 1
    out = np.full(docs * t, ~U64(0), dtype=U64)
    doc = np.repeat(np.arange(docs), np.diff(starts))
    for i in range(2 * t):
        if not len(values):
            break
        h = mix(values ^ mix(np.array([i + 1], dtype=U64)))
        place = ((h >> U64(32)) * U64(t) >> U64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, doc * t + place, (h & U64(0xFFFFFFFF)) | U64(i << 32))
        full = (out.reshape(docs, t) != ~U64(0)).all(axis=1)
        if full.any():
            rest = ~full[doc]
            values, doc = values[rest], doc[rest]
    return out.reshape(docs, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts x bands, int64) keys of the bands' contents."""
    parts = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def planes(sketches: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate as bit planes, 64 coordinates to a word: (texts x 2 * words, int64)."""
    n, t = sketches.shape
    words = -(-t // 64)
    bits = np.zeros((n, PLANES, words * 64), dtype=np.uint8)
    scrambled = mix(sketches)
    for j in range(PLANES):
        bits[:, j, :t] = (scrambled >> U64(j)) & U64(1)
    return np.packbits(bits, axis=2, bitorder="little").view(np.int64).reshape(n, PLANES * words)


def most_differing(t: int, threshold: int, sigmas: float = 4.0) -> int:
    """So many of t coordinates differ at most in their bits for sets at the threshold, but for the upper tail beyond
    ``sigmas`` standard deviations (3e-5 for the default)."""
    p = (1 - threshold / 100) * (1 - 2.0**-PLANES)
    return int(t * p + sigmas * (t * p * (1 - p)) ** 0.5) + 1


def _differing(t: int) -> str:
    words = -(-t // 64)
    return " + ".join("bit_count(" + " | ".join(f"(a.planes[{j * words + w}] ^ b.planes[{j * words + w}])" for j in range(PLANES)) + ")" for w in range(words))


def _choices(t: int) -> str:
    """The coordinates of choice j, out of all choices as one constant of a plan."""
    rng = np.random.default_rng(t)
    width = min(FINE_WIDTH, t)
    chosen = ",".join(str(c) for _ in range(FINE) for c in rng.permutation(t)[:width].tolist())
    return f"slice(cast(split('{chosen}', ',') as array<int>), j * {width} + 1, {width})"


def _bits(planes: str, t: int) -> list[str]:
    """SQL of both bits of coordinate c."""
    words = -(-t // 64)
    return [f"(shiftright({planes.format(p=f'[cast(c div 64 as int) + {j * words}]')}, c % 64) & 1L)" for j in range(PLANES)]


def _fine(t: int) -> str:
    """SQL of the fine buckets of a row: an array of numbers."""
    one, two = _bits("planes{p}", t)
    return f"transform(sequence(0, {FINE - 1}), j -> aggregate({_choices(t)}, 0L, (x, c) -> x * 4 + {one} * 2 + {two}))"


def _first_fine(t: int) -> str:
    """SQL of the first fine bucket that a pair shares."""
    one, two = _bits("(a.planes{p} ^ b.planes{p})", t)
    return f"filter(sequence(0, {FINE - 1}), j -> forall({_choices(t)}, c -> {one} + {two} = 0))[0]"


def _sketcher(size: int, t: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), as_binary(batch.column(1)).to_pylist()
            for a, b in pieces(texts):
                values, starts = shingle_sets(texts[a:b], size, cache)
                drawn = sketch(values, starts, t)
                keys, bits = band_keys(drawn[:, : bands * rows], bands, rows), planes(drawn)
                n = np.diff(starts)
                names = pa.array([set_name(values[starts[k] : starts[k + 1]]) if n[k] else None for k in range(b - a)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bits.shape[1], bits.shape[1], dtype=np.int32)), pa.array(bits.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), names, lists, flat], ["doc_id", "n_shingles", "set_id", "keys", "planes"])
        cache.clear()
        release()
    return run


def _full_sets(size: int, bitmap=None):
    """Shingle sets of the documents; with a bitmap, of those whose id may be a candidate's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bits = WordHashes(), np.frombuffer(bitmap.value, dtype=np.uint8) if bitmap else None
        for batch in batches:
            if bits is not None:
                place = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            texts = as_binary(batch.column(1)).to_pylist()
            for a, b in pieces(texts):
                values, starts = shingle_sets(texts[a:b], size, cache)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["node", "set"])
        cache.clear()
        release()
    return run


def _place(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _bitmap(work: Workspace, nodes: DataFrame):
    """A bitmap of FILTER_BITS bits of the nodes; at most FILTER_BITS / 8 bytes reach the driver."""
    rows = (
        nodes.select(_place("node").alias("p"))
        .groupBy(F.floor(F.col("p") / _BUCKET_BITS).alias("b"))
        .agg(F.bitmap_construct_agg((F.col("p") % _BUCKET_BITS)).alias("bits"))
    )
    out = bytearray(FILTER_BITS // 8)
    for r in rows.toLocalIterator():
        out[r["b"] * _BUCKET_BITS // 8 : (r["b"] + 1) * _BUCKET_BITS // 8] = r["bits"]
    return work.broadcast(bytes(out))


def _verified(work: Workspace, docs: DataFrame, pairs: DataFrame, size: int, threshold: int, name: str, filter_bits: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as edges (u, v)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    named = docs.filter("doc_id is not null")
    few = ends.agg(F.approx_count_distinct("node")).first()[0] <= filter_bits // 8
    if few:
        bitmap = _bitmap(work, ends)
        texts, sets = named.select("doc_id", "text", _place("doc_id").alias("place")), _full_sets(size, bitmap)
    else:  # too many for a filter of a bounded size: their texts are shuffled once
        texts, sets = named.select("doc_id", "text").join(ends.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), _full_sets(size)
    sets = work.save(texts.mapInArrow(sets, "node long, set array<long>"), f"{name}_sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")).hint("merge"), "b")
    common = both.select("a", "b", F.size("set_a").alias("na"), F.size("set_b").alias("nb"), F.size(F.array_intersect("set_a", "set_b")).alias("i"))
    edges = work.save(common.filter(f"100 * i >= {threshold} * (na + nb - i)").select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}_edges")
    work.drop(f"{name}_sets")
    if few:
        work.forget(bitmap)
    return edges


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, coordinates: int = COORDINATES, bands: int = BANDS, rows: int = ROWS, filter_bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id long, text string; others ignored).

    Two documents are linked when 100 * intersection >= threshold * union of their shingle sets; component_id is the
    least doc_id reachable by links and kept says that it is the row's own. Null, empty and blank texts have no
    shingles and link with nothing. Rows with the same doc_id count as one document. A row whose doc_id is null links
    with nothing, has a null component_id, and is kept. An empty table gives an empty result."""
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = work.save(
        docs.mapInArrow(_sketcher(size, coordinates, bands, rows), "doc_id long, n_shingles long, set_id binary, keys array<long>, planes array<long>"), "sketches")
    known = sketches.filter("doc_id is not null and n_shingles > 0")
    classes = work.save(known.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")), "classes")
    # rows that share an id are one document, whichever their sets: the least id of a set links with all of them
    same_id = known.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo <> hi").select("doc_id")
    same_id = (
        known.join(same_id.hint("shuffle_merge"), "doc_id", "left_semi").select("doc_id", "set_id").join(classes, "set_id")
        .select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    )
    leaders = known.join(classes.select("set_id", F.col("node").alias("doc_id"), "n").hint("merge"), ["set_id", "doc_id"]).dropDuplicates(["set_id"])
    placed = leaders.select(F.col("doc_id").alias("node"), "n", F.explode("keys").alias("key"))
    shared = work.save(placed.groupBy("key").agg(F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n"), F.count("*").alias("m")).filter("m > 1").drop("m"), "shared")
    member = work.save(placed.join(shared.hint("merge"), "key").select("key", "node", "n", "hub", "hub_n"), "member")
    near = f"100 * least({{0}}, {{1}}) >= {threshold} * greatest({{0}}, {{1}})"
    first = work.save(
        member.filter("node <> hub").filter(near.format("n", "hub_n")).groupBy(F.col("hub").alias("a"), F.col("node").alias("b"))
        .agg(F.lit(1).alias("one")).select("a", "b"), "first")
    work.drop("shared")
    edges = _verified(work, docs, first, size, threshold, "one", filter_bits).unionByName(same_id)
    joined = components(work, edges, "cc_one")
    part = work.save(joined, "part_one")
    # what a bucket still holds in different components
    labelled = (
        member.join(part.select("node", "component").hint("merge"), "node", "left")
        .select("key", "node", "n", "hub", F.coalesce("component", "node").alias("component"))
    )
    labelled = work.save(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo <> hi")
    mixed = mixed.select(F.col("key").bitwiseXOR(F.lit(0).cast("long")).alias("key"), (F.col("m") > hot).alias("hot"))
    left = labelled.join(mixed.hint("merge"), "key")
    left = work.save(left.join(leaders.select(F.col("doc_id").alias("node"), "planes", "keys").hint("merge"), "node"), "mixed")
    dealt = left.filter("not hot").select("*", F.lit(-1).alias("choice"), F.lit(0).cast("long").alias("fine"))
    if left.filter("hot").limit(1).count():
        dealt = dealt.unionByName(left.filter("hot").select("*", F.posexplode(F.expr(_fine(coordinates))).alias("choice", "fine")))
        dealt = work.save(dealt, "dealt")
    a, b = dealt.alias("a"), dealt.alias("b")
    second = (
        a.join(b.hint("merge"), F.expr("a.key = b.key and a.choice = b.choice and a.fine = b.fine and a.node < b.node and a.component <> b.component and a.node <> a.hub and " + near.format("a.n", "b.n")
                                        + f" and {_differing(coordinates)} <= {most_differing(coordinates, threshold)}"
                                        + " and array_intersect(a.keys, b.keys)[0] = a.key"  # once, in the first bucket that they share
                                        + f" and (a.choice < 0 or {_first_fine(coordinates)} = a.choice)"))
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")
    )
    second = work.save(second, "second")
    if second.limit(1).count():
        more = _verified(work, docs, second, size, threshold, "two", filter_bits)
        linked = more.join(part.select(F.col("node").alias("u"), F.col("component").alias("cu")).hint("merge"), "u", "left")
        linked = linked.join(part.select(F.col("node").alias("v"), F.col("component").alias("cv")).hint("merge"), "v", "left")
        over = components(work, linked.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")), "cc_two")
        over = work.save(over, "part_two").select(F.col("node").alias("component"), F.col("component").alias("final"))
        moved = part.join(over.hint("merge"), "component", "left").select("node", F.coalesce("final", "component").alias("component"))
        fresh = over.select(F.col("component").alias("node"), F.col("final").alias("component"))
        part = work.save(moved.unionByName(fresh).groupBy("node").agg(F.min("component").alias("component")), "part")
    work.drop("member", "labelled", "mixed", "dealt", "first", "second")
    named = work.save(
        classes.select("set_id", "node").join(part.hint("merge"), "node", "left").select("set_id", F.coalesce("component", "node").alias("component")), "named")
    # rows of one hot set meet in a join that adaptive execution can split
    out = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")).join(named.hint("merge"), "set_id", "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group, that of the least doc_id.

    Rows without a doc_id and texts without words stay. Of rows that share a doc_id one stays, the first by a hash of
    its columns, whatever their texts. Null, empty and very long texts are told apart as in ``near_duplicates``; an
    empty table gives an empty result; extra columns pass whatever their names."""
    found = near_duplicates(docs, **parameters).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id_")).distinct()
    stay = docs.join(found.hint("merge"), F.col("doc_id") == F.col("kept_id_"), "left_semi")
    # the join's partitions serve the ranking too
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns), "text"))
    return stay.withColumn("rank_", first).filter("rank_ = 1").select(*docs.columns).unionByName(docs.filter("doc_id is null"))
