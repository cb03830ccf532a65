"""Document fingerprints by winnowing (operator 4), with DataFrame functions only.

The lower-cased words of a text are hashed, every k of them in a row give a gram's 31-bit hash, and of each window of
w grams the least hash is chosen, the rightmost of equals, with its position (the number of its first word). So any
passage of w + k - 1 words that two texts share is found in both fingerprints, and none shorter than k words is. Words
of more than ``LONGEST`` characters are cut into pieces of so many from their start, so that texts without blanks have grams
too. A text of fewer than w + k - 1 words, for which nothing is promised, has its single words as grams; a text
without words has an empty fingerprint.

The hash is a rolling polynomial modulo 2^31 - 1. Arrays have no running state in SQL, so it does not roll word by word:
the hashes of 2, 4, 8 … words in a row are each made of two of the step before, for all places at once, and those that add up to k
are put together: log k passes over an array, and no gram is hashed from its words anew. A hash and its position are
one 64-bit number whose order is that of the hash and, among equals, of the position from the right, so the least
number of a window is its choice; minima of windows of 1, 2, 4 … grams are doubled up likewise. All is done row by row
inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import least_hashes

K, W, LONGEST, ROWS_PER_RANGE, MOST_RANGES, KEYS_PER_RANGE = 5, 8, 16, 500, 1 << 17, 8
_LOW, _PRIME, _BASE = (1 << 32) - 1, (1 << 31) - 1, 1_000_003


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _key(gram: Column, place: Column) -> Column:
    return F.shiftleft(gram, 32) + (F.lit(_LOW) - place)


def _joined(first: Column, second: Column, width: int, more: int) -> Column:
    """Hashes of ``width`` words in a row, each with the hash of the ``more`` words that follow."""
    power = pow(_BASE, more, _PRIME)
    ahead = F.slice(second, width + 1, F.greatest(F.size(second) - width, F.lit(0)))
    return F.filter(F.zip_with(first, ahead, lambda a, b: (a * power + b) % _PRIME), lambda x: x.isNotNull())


def rolling(h: Column, k: int = K) -> Column:
    """The polynomial hashes of all k neighbours in an array of numbers below 2^31 - 1."""
    def bits(state: Column, width: int, rest: int) -> Column:
        """state.all: hashes of ``width`` in a row; state.out: those of the lower bits of k, put together so far."""
        done = k & (width - 1)
        if rest & 1:
            out = _joined(state["all"], state["out"], width, done) if done else state["all"]
        else:
            out = state["out"]
        if rest == 1:
            return out
        return _let(F.struct(_joined(state["all"], state["all"], width, width).alias("all"), out.alias("out")), lambda s: bits(s, width * 2, rest >> 1))

    return _let(F.struct(h.alias("all"), h.alias("out")), lambda s: bits(s, 1, k))


def selected(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen grams as packed numbers, in the order of the text (array of long)."""
    def grams(h: Column) -> Column:
        several = F.when(F.size(h) >= w + k - 1, rolling(h, k)).otherwise(h)
        return F.transform(several, _key)

    def least(m: Column) -> Column:
        n, width, out = F.size(m), 1, m
        while width < w:
            step = min(width, w - width)
            out = _let(out, _shifted(step))
            width += step
        # the last windows are cut short by the text's end
        return F.array_distinct(F.slice(out, 1, F.greatest(n - (w - 1), F.lit(1))))

    def chosen(h: Column) -> Column:
        return F.when(F.size(h) >= w + k - 1, _let(grams(h), least)).otherwise(grams(h))

    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"([^\\x20\\x09-\\x0D]{{1,{LONGEST}}})"), F.lit(1))
    return _let(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(_PRIME))), chosen)


def _shifted(step: int) -> Callable[[Column], Column]:
    """Each element with the one ``step`` further on: the lesser of both."""
    return lambda x: F.zip_with(x, F.slice(x, step + 1, F.greatest(F.size(x) - step, F.lit(0))), lambda a, b: F.least(a, b))


def told(chosen: Column) -> Column:
    """A fingerprint as text: hash:position, comma-joined."""
    return F.concat_ws(",", F.transform(chosen, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit(":"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("string"))))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two fingerprints' hashes; 1 where both are empty."""
    def hashes(x: Column) -> Column:
        return F.array_distinct(F.transform(x, lambda y: F.shiftright(y, 32)))

    def ratio(p: Column) -> Column:
        both = F.size(F.array_intersect(p["x"], p["y"]))
        union = F.size(p["x"]) + F.size(p["y"]) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both / union)

    return _let(F.struct(hashes(a).alias("x"), hashes(b).alias("y")), ratio)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars and fingerprint (array of hash, position) of every row.

    A null text counts as empty and has an empty fingerprint; very long ones are read whole. Repeated rows stay
    repeated, doc_id may be null, an empty table gives an empty result; other columns are ignored, whatever their names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chosen = selected(text, k, w)
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.transform(chosen, lambda x: F.struct(
        F.shiftright(x, 32).alias("hash"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).alias("position"))).alias("fingerprint"))


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at most the key, by a search of two levels."""
    if not bounds:
        return F.lit(0)
    block = max(1, int(len(bounds) ** 0.5))
    firsts = F.split(F.lit(",".join(bounds[::block])), ",")
    blocks = F.split(F.lit(" ".join(",".join(bounds[a : a + block]) for a in range(0, len(bounds), block))), " ")
    coarse = F.size(F.filter(firsts, lambda b: b <= key))
    fine = F.size(F.filter(F.split(F.get(blocks, coarse - 1), ","), lambda b: b <= key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * block + fine)


def with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE, most_ranges: int = MOST_RANGES, extra: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, text and the extra columns, and ``next`` (a struct of text and those) of the following row by doc_id.

    Nulls come first, rows of one doc_id (and those without) are ordered by a hash of their text, and the first row
    follows the last. The rows are cut into ranges of this order at keys that a sample of them has, so that neither
    many rows of one doc_id nor many without are one range; the first row of a range is dealt to the range before it too, and the very first to
    the last, so each range finds its successors by itself and no task sees all rows. The number of ranges grows with
    the table up to ``most_ranges``; the driver holds ``KEYS_PER_RANGE`` keys for each."""
    # null or not, the id with its sign turned, the text's hash: as text that sorts alike
    low = F.lit(-(1 << 63))
    key = F.concat(F.when(F.col("doc_id").isNull(), "0").otherwise("1"), F.lpad(F.hex(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").bitwiseXOR(low)), 16, "0"), F.lpad(F.hex(F.xxhash64("text").bitwiseXOR(low)), 16, "0"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", key)
    known = rows.agg(F.count("*").alias("n"), F.min("key").alias("lo")).first()
    parts = max(1, min(most_ranges, known["n"] // rows_per_range))
    drawn = sorted(r["key"] for r in least_hashes(rows.select("key"), F.col("key"), parts * KEYS_PER_RANGE, known["n"]).collect()) if parts > 1 else []
    bounds = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)} - {known["lo"]}) if drawn else []
    rows = rows.select("doc_id", "text", "key", *extra).withColumn("own", _range_of(F.col("key"), bounds))
    at_cut = F.col("key").isin(bounds) if len(bounds) < 64 else F.get(F.split(F.lit(",".join(bounds)), ","), F.col("own") - 1) == F.col("key")
    places = F.array(
        F.struct(F.col("own").alias("part"), F.lit(0).alias("guest")),
        F.when(at_cut, F.struct((F.col("own") - 1).alias("part"), F.lit(1).alias("guest"))),
        F.when(F.col("key") == F.lit(known["lo"]), F.struct(F.lit(len(bounds)).alias("part"), F.lit(2).alias("guest"))))
    dealt = rows.withColumn("at", F.explode(F.array_compact(places))).drop("own")
    columns = [c for c in dealt.columns if c not in ("doc_id", "key", "at")]
    order = Window.partitionBy("at.part").orderBy("at.guest", "key", "text")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("at.guest = 0").select("doc_id", *columns, "next")


def compared(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has the last half of the text's code points replaced by as many from the start of the next
    document (by doc_id; see ``with_next`` for nulls, repeats and the last). Texts may be null (empty) or very long;
    other columns are ignored; an empty table gives an empty result, and a single row is its own next."""
    rows = with_next(docs, extra=(selected(F.coalesce(F.col("text"), F.lit("")), k, w).alias("chosen"),))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    done = rows.select("doc_id", n.cast("long").alias("n_chars"), "chosen", F.col("next.chosen").alias("next_chosen"), edited.alias("edited"))
    done = done.withColumn("edited_chosen", selected(F.col("edited"), k, w))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), told(F.col("chosen")).alias("fingerprint"),
        told(F.col("edited_chosen")).alias("edited_fingerprint"), likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"),
        likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"))
