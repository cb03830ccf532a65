"""Mixing sources to target weights by min-cost flow (operator 5).

Documents may belong to several sources. They are aggregated by membership pattern (the set of their sources); the
patterns and sources form a small network: words flow from a pattern, each repetition of its documents costing more
than the one before (convex, up to ``most_copies``), to one of its sources, and from there into the source's quota.
The cheapest flow that fills the quotas as far as it can says how many words each pattern gives, which is a number of
whole rounds over its documents and a rest; the rest goes to documents in the order of a seeded hash, and a document
that does not fit is left out, until less is missing than the smallest document left has. The order is never sorted in
one place: hash ranges are added up first, and only the range in which the rest ends is ranked.

Quotas share all words by weight (5, 2, 1, repeating over the sources by code point, null last); a quota stops at
``most_copies`` times its source's size and what is left is shared again by weight.

The driver holds one row for each pattern and source, whatever the number of documents; more than ``most_patterns`` of
them are refused, for the flow is one problem over all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WEIGHTS, MOST_COPIES, BINS, SEED, MOST_PATTERNS = (5, 2, 1), 3, 4096, 7, 1_000_000
#: So many patterns at most are broadcast; more are joined.
FEW_PATTERNS = 20_000
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: str = "text") -> Column:
    """The number of runs without blanks (0x20, 0x09-0x0D); 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: dict, weights: dict, most: float = MOST_COPIES) -> dict[object, float]:
    """Share the sum of the sizes by weight; a share stops at ``most`` times its size, the excess is shared anew."""
    total, share, open_ = float(sum(sizes.values())), dict.fromkeys(sizes, 0.0), [s for s in sizes]
    left = total
    while open_:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight > most * sizes[s]}
        if not over:
            return share | {s: left * weights[s] / weight for s in open_}
        for s in (s for s in open_ if s in over):
            share[s] = float(most * sizes[s])
            left -= share[s]
        open_ = [s for s in open_ if s not in over]
    return share


def cheapest_flow(patterns: Sequence[tuple[frozenset, float]], quota: dict, most_copies: int = MOST_COPIES) -> list[float]:
    """Words taken from each pattern: the flow that fills the quotas as far as they can be, at the least cost.

    The k-th copy of a word costs k - 1, and all costs lie on the arcs from the start to the patterns. A path that fills
    more never lessens what these arcs carry, so the cheapest flow is the largest one of first copies, enlarged as far as
    second copies go, and so on: one network after the other, each by blocking flows (all shortest paths of a phase at once)."""
    place = {s: k for k, s in enumerate(quota)}
    need = [float(q) for q in quota.values()]
    members = [sorted(place[s] for s in own) for own, _ in patterns]
    sent: list[dict[int, float]] = [{} for _ in patterns]  # pattern -> source -> words
    users: list[set[int]] = [set() for _ in need]
    tiny = max(1e-6, 1e-13 * sum(need))
    for _ in range(most_copies):
        left = [float(words) for _, words in patterns]
        while True:
            far_p, far_s = [-1] * len(left), [-1] * len(need)
            edge = [k for k, w in enumerate(left) if w > tiny]
            for k in edge:
                far_p[k] = 0
            starts, depth, open_ = edge, 0, False
            while edge and not open_:
                reached = []
                for k in edge:
                    for s in members[k]:
                        if far_s[s] < 0:
                            far_s[s] = depth + 1
                            reached.append(s)
                            open_ = open_ or need[s] > tiny
                depth += 2
                edge = []
                for s in reached if not open_ else ():
                    for k in users[s]:
                        if far_p[k] < 0:
                            far_p[k] = depth
                            edge.append(k)
            if not open_:
                break
            at_p, at_s, ways = [0] * len(left), [0] * len(need), [sorted(u) for u in users]
            for k in starts:
                while left[k] > tiny and _augment(k, left, need, members, sent, users, far_p, far_s, at_p, at_s, ways, tiny):
                    pass
    return [sum(x.values()) for x in sent]


def _augment(first: int, left, need, members, sent, users, far_p, far_s, at_p, at_s, ways, tiny: float) -> bool:
    """Send what one shortest path from a pattern to an open source can carry; False where there is none any more."""
    path = [first]  # pattern, source, pattern, …: from a source back to a pattern goes what that pattern sent there
    while path:
        u = path[-1]
        if len(path) % 2:
            own = members[u]
            while at_p[u] < len(own) and far_s[own[at_p[u]]] != far_p[u] + 1:
                at_p[u] += 1
            if at_p[u] < len(own):
                path.append(own[at_p[u]])
                continue
            path.pop()
            if path:
                at_s[path[-1]] += 1
            continue
        if need[u] > tiny:
            amount = min(left[first], need[u], *(sent[path[k + 1]][path[k]] for k in range(1, len(path) - 1, 2)))
            left[first] -= amount
            need[u] -= amount
            for k in range(0, len(path), 2):
                pattern, source = path[k], path[k + 1]
                sent[pattern][source] = sent[pattern].get(source, 0.0) + amount
                users[source].add(pattern)
                if k:
                    sent[pattern][path[k - 1]] -= amount
                    if sent[pattern][path[k - 1]] <= tiny:
                        users[path[k - 1]].discard(pattern)
            return True
        while at_s[u] < len(ways[u]) and (far_p[ways[u][at_s[u]]] != far_s[u] + 1 or sent[ways[u][at_s[u]]].get(u, 0.0) <= tiny):
            at_s[u] += 1
        if at_s[u] < len(ways[u]):
            path.append(ways[u][at_s[u]])
        else:
            path.pop()
            at_p[path[-1]] += 1
    return False


#: Whether a row is drawn by one of its pattern's picks: all that fitted the words missing then, up to a place in the order or at it (edge -1).
_DRAWN = "exists(picks, p -> weight > 0 and weight <= p.lack and coalesce(bin < p.edge or if(p.edge < 0, struct(order, doc_id, size) = p.upto, struct(order, doc_id, size) <= p.upto), false))"


def _key_type(rows: DataFrame) -> str:
    return f"struct<order: long, doc_id: {rows.schema['doc_id'].dataType.simpleString()}, size: long>"


def _few(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= FEW_PATTERNS else table.hint("merge")


def _draw(rows: DataFrame, rest: dict[tuple, int]) -> dict[tuple, list]:
    """The picks (see ``_DRAWN``) that fill each pattern's rest until what is missing is less than its smallest row left.

    Each round takes, in order, the rows that fit into what is missing up to the first that does not, or the largest
    one that fits if that is more. Both together exceed what is missing, so that each round at least halves it. The
    driver holds one row for each pattern and round."""
    spark, lack, picks = rows.sparkSession, dict(rest), {p: [] for p in rest}
    every = 1 << 52
    while lack:
        state = spark.createDataFrame([(list(p), n, picks[p]) for p, n in lack.items()], f"pattern array<string>, lack long, picks array<struct<lack: long, edge: long, upto: {_key_type(rows)}>>")
        left = rows.join(_few(state, len(lack)), "pattern").filter("weight > 0 and weight <= lack").filter(f"not {_DRAWN}").drop("picks")
        sums = left.groupBy("pattern", "bin").agg(F.first("lack").alias("lack"), F.sum("weight").alias("words"), F.max(F.struct("weight", "order", "doc_id", "size")).alias("best"))
        # at most patterns * bins rows of sums, dealt by pattern
        sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        ends = sums.groupBy("pattern").agg(
            F.max("best").alias("best"), F.min(F.when(F.col("upto") > F.col("lack"), F.col("bin"))).alias("edge"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("lack"), F.col("upto"))), F.lit(0)).alias("before")).collect()
        edges = spark.createDataFrame([(r["pattern"], r["edge"], r["before"]) for r in ends if r["edge"] is not None], "pattern array<string>, edge long, before long")
        # ranked are only the rows of one bin in each pattern
        inside = left.join(_few(edges, len(ends)), "pattern").filter("bin = edge")
        inside = inside.withColumn("upto", F.col("before") + F.sum("weight").over(Window.partitionBy("pattern").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
        fit = inside.filter("upto <= lack").groupBy("pattern").agg(F.max("upto").alias("got"), F.max(F.struct("order", "doc_id", "size")).alias("key")).collect()
        last = {tuple(r["pattern"]): r for r in fit}
        missing = {}
        for r in ends:
            p = tuple(r["pattern"])
            got, key = (last[p]["got"], tuple(last[p]["key"])) if p in last else (r["before"], None)
            edge = every if r["edge"] is None else r["edge"]
            if r["best"]["weight"] > got:
                got, edge, key = r["best"]["weight"], -1, tuple(r["best"])[1:]
            picks[p].append((lack[p], edge, key))
            if lack[p] > got and r["edge"] is not None:
                missing[p] = lack[p] - got
        lack = missing
    return picks


def _pattern(sources: Column | None) -> Column:
    """A row's sources, sorted; "t" is the null source and comes after all others."""
    names = sources if sources is not None else F.array(F.col("source").cast("string"))
    return F.array_sort(F.array_distinct(F.transform(names, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("t")))))


def _order(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))), F.lit(1 << 52))


def mix(docs: DataFrame, sources: Column | None = None, weights: Sequence[float] = WEIGHTS, most_copies: int = MOST_COPIES, seed: int = SEED,
        bins: int = BINS, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """Every row of ``docs`` with size (words), source_size, target (of its first source) and copies (how often the mix
    repeats it, 0 to ``most_copies``): doc_id, text's hash as ``row``, size, source_size, target, copies.

    ``sources`` is an array of source names, the column ``source`` alone by default; a null name is a source, the
    last. A null text has no words; an empty document is never repeated and counts as taken 0 times. Repeated rows
    are treated alike. An empty table gives an empty result; without any words all targets are 0. The seeded order
    depends on doc_id and the words' number only, so that reruns agree."""
    work = Workspace(docs.sparkSession, "mixing")
    rows = docs.select(F.col("doc_id"), n_words().alias("size"), _pattern(sources).alias("pattern"), _order(seed).alias("order"))
    wide = (1 << 52) // bins
    rows = rows.groupBy("pattern", "order", "doc_id", "size").agg(F.count("*").alias("n"))  # repeated rows are drawn together
    rows = work.save(rows.withColumn("bin", F.floor(F.col("order") / wide)).withColumn("weight", F.col("size") * F.col("n")), "sizes")
    binned = work.save(rows.groupBy("pattern", "bin").agg(F.sum("weight").alias("words")), "bins")
    found = binned.groupBy("pattern").agg(F.sum("words").alias("words")).orderBy("pattern").limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns of sources")
    patterns = [(frozenset(r["pattern"]), r["words"]) for r in found]
    size: dict[str, int] = {}
    for members, words in patterns:
        for s in members:
            size[s] = size.get(s, 0) + words
    every = sorted(size, key=lambda s: s.encode())  # code points; "t" marks the null source and comes last
    weight = {s: weights[k % len(weights)] for k, s in enumerate(every)}
    overall = sum(w for _, w in patterns)
    quota = quotas(size, weight, most_copies)
    if sum(size.values()) != overall:  # overlapping sources share the words there are
        quota = {s: q * overall / max(sum(size.values()), 1) for s, q in quota.items()}
    taken = cheapest_flow(patterns, quota, most_copies)
    plan = []
    for r, words in zip(found, taken, strict=True):
        rounds = min(int(words / r["words"] + 1e-9), most_copies) if r["words"] else 0
        first = min(r["pattern"], key=every.index) if r["pattern"] else None
        plan.append((r["pattern"], size.get(first, 0), float(quota.get(first, 0.0)), rounds, 0 if rounds == most_copies else round(words - rounds * r["words"])))
    drawn = _draw(rows, {tuple(p[0]): p[4] for p in plan if p[4] > 0})
    picks = f"array<struct<lack: long, edge: long, upto: {_key_type(rows)}>>"
    told = docs.sparkSession.createDataFrame(  # at most most_patterns rows
        [(*p[:4], drawn.get(tuple(p[0]), [])) for p in plan], f"pattern array<string>, source_size long, target double, rounds int, picks {picks}")
    out = rows.join(_few(told, len(plan)), "pattern").withColumn("copies", F.col("rounds") + F.expr(f"if({_DRAWN}, 1, 0)"))
    # repeated rows come back in pieces, so that no row holds all of them
    out = out.withColumn("piece", F.explode(F.expr("sequence(0L, (n - 1) div 4096)"))).withColumn("k", F.explode(F.expr("sequence(1L, least(4096L, n - piece * 4096))")))
    return out.select("doc_id", "pattern", "order", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes from the document, repeats counted)."""
    return mix(docs, **parameters).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Null, empty and blank texts are not taken; rows that share doc_id, sources and text are taken alike; doc_id and
    source may be null; an empty table, or one without words, gives an empty result; other columns pass whatever their names."""
    work = Workspace(docs.sparkSession, "mixed")
    copies = work.save(mix(docs, **parameters).filter("copies > 0 and size > 0").groupBy("doc_id", "order", "pattern").agg(F.max("copies").alias("copies")), "copies")
    a = docs.withColumn("mix_order_", _order(parameters.get("seed", SEED))).withColumn("mix_pattern_", _pattern(parameters.get("sources")))
    met = a.join(copies.select(F.col("doc_id").alias("mix_id_"), F.col("order").alias("mix_at_"), F.col("pattern").alias("mix_of_"), F.col("copies").alias("mix_copies_")),
                 F.col("doc_id").eqNullSafe(F.col("mix_id_")) & (F.col("mix_order_") == F.col("mix_at_")) & (F.col("mix_pattern_") == F.col("mix_of_")))
    return met.withColumn("mix_copy_", F.explode(F.expr("sequence(1, mix_copies_)"))).select(*docs.columns)
