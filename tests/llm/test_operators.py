"""The operators against brute-force versions on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from brightloom.llm import bpe, embeddings, hmm, license_scan, minhash, mixing, secret_scan, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(n)]
    for k in range(0, n, 5):  # near copies, exact copies and odd ones
        own = out[k].split()
        own[rng.randrange(len(own))] = "changed"
        out[(k + 1) % n] = " ".join(own)
        out[(k + 2) % n] = out[k].upper()
    return out + ["", None, "  \t", "a b", "A  B", "word " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, ("s2", "s10", None)[k % 3], "x", 1) for k, t in enumerate(texts(120))]
    rows += [rows[3], (None, "alpha beta", "en", "s2", "y", 2), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, spans string, component long")


def components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_minhash_equals_all_pairs(docs):
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    n = max(sets) + 1
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(n, links)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2 and links
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert sorted(map(tuple, minhash.near_duplicates(docs, filter_bits=8).collect()), key=str) == sorted(map(tuple, got), key=str)  # the join in place of the filter
    assert sorted(map(tuple, minhash.near_duplicates(docs, hot=1).collect()), key=str) == sorted(map(tuple, got), key=str)  # every bucket dealt once more
    assert minhash.near_duplicates(docs.limit(0)).collect() == [] == minhash.drop_near_duplicates(docs.limit(0)).collect()
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({a for a in sets if want[a] == a})


def test_a_common_passage_and_near_copies(spark):
    """A passage in all texts fills buckets; near copies, of which the least is no hub, are found in fine buckets too."""
    rng = random.Random(8)
    passage = " ".join(rng.choices(WORDS, k=30))
    rows = []
    for k in range(120):
        own = [f"w{rng.randrange(5000)}" for _ in range(28)]
        rows.append((k, passage + " " + " ".join(own)))
        if k % 4 == 0:
            own[27] = "changed"
            rows.append((1000 + k, passage + " " + " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(x, y) for x, y in itertools.combinations(range(len(ids)), 2) if 100 * len(sets[ids[x]] & sets[ids[y]]) >= 75 * len(sets[ids[x]] | sets[ids[y]])]
    want = dict(zip(ids, (ids[c] for c in components(len(ids), links)), strict=True))
    for hot in (minhash.HOT, 4, 1):
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, hot=hot).collect()} == want and len(links) == 30


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    s = minhash.sketch(np.concatenate([a, b, a[:1]]), np.array([0, 400, 800, 801]), 512)
    assert (s != ~np.uint64(0)).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.09


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.05 * rng.standard_normal((30, 16)), base[:5]])
    rows = [(k, [float(v) for v in np.float32(r)], k % 2, 1) for k, r in enumerate(x)]
    odd = [(200, None, 1, 1), (201, [0.0] * 16, 1, 1), (202, [float("nan")] * 16, 1, 1), (203, [1.0, None] * 8, 1, 1), (204, rows[1][1], None, 1), (None, rows[1][1], 1, 1), (205, [1.0], 1, 1), (206, [], 0, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, node int")
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (np.arange(len(u))[:, None] % 2 == np.arange(len(u)) % 2) & ~np.eye(len(u), dtype=bool)
    want = components(len(u), zip(*np.nonzero(near), strict=True))
    for cell, block, large, sample in ((256, 512, 4, 50_000), (8, 512, 4, 50_000), (256, 8, 4, 50_000), (8, 4, 1, 32)):  # the last: cells are split on
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, cell=cell, block=block, large=large, sample=sample).collect()}
        for k in range(len(u)):
            assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (near[k].sum(), want[k], want[k] == k)
        assert all(got[k[0]]["n_links"] == 0 and got[k[0]]["kept"] for k in odd)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_mixing(docs):
    """Wholes, repeats, reruns, empty tables."""
    rows = docs.collect()
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    source = {r["doc_id"]: r["source"] for r in rows}
    for r in got:
        if r["doc_id"] is not None:
            s = source[r["doc_id"]]
            size[s] += r["size"]
            taken[s] += r["taken"]
            target[s] = r["target"]
            assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()), key=str)
    sizes = {"a": 10, "b": 1000, "c": 100, "d": 500}
    weights = dict(zip(sizes, (5, 2, 1, 5), strict=True))
    q = mixing.quotas(sizes, weights)
    assert q["a"] == 30 and all(q[s] <= 3 * sizes[s] + 1e-9 for s in q) and abs(sum(q.values()) - 1610) < 1e-6
    assert mixing.mixed(docs.limit(0)).count() == 0
    # each source's taken words come near its target: less is missing than the smallest document left has
    for s in size:
        left = [r["size"] for r in got if r["doc_id"] is not None and source[r["doc_id"]] == s and not r["taken"] and r["size"]]
        assert taken[s] <= target[s] + 1 and target[s] - taken[s] < min(left, default=60) + 2
    copies = Counter({(r["doc_id"], r["size"]): r["taken"] // max(r["size"], 1) for r in got})
    drawn = mixing.apply_mix(docs)
    assert drawn.columns == docs.columns
    assert Counter(r["doc_id"] for r in drawn.collect()) == Counter({i: n * sum(r["doc_id"] == i and len((r["text"] or "").split()) == w for r in rows) for (i, w), n in copies.items() if n})
    assert mixing.apply_mix(docs.limit(0)).count() == 0 and mixing.apply_mix(docs.filter("text is null")).collect() == []


def test_flow_of_overlapping_sources():
    patterns = [(frozenset("a"), 10.0), (frozenset("ab"), 10.0), (frozenset("b"), 10.0)]
    assert mixing.cheapest_flow(patterns, {"a": 20.0, "b": 10.0}) == pytest.approx([10, 10, 10])
    assert sum(mixing.cheapest_flow(patterns, {"a": 60.0, "b": 0.0})) == pytest.approx(60)


def test_bpe_equals_the_library(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(4)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x1AB0), rng.randrange(0x10000, 0x1F900)])) for _ in range(40)) for _ in range(300)]
    odd += ["ΑΣ ΣΑΣ", "don't we'll", "x<|endoftext|>y", "a\x1cb \x85c", "", "ß İ"] + [t_ or "" for t_ in texts(40, 9)]
    own = bpe.WordBpe(path)
    for text, ids in zip(odd, own.encode(odd), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(ids, np.uint32)) == want
        assert own.decode(ids) == t.decode(want, skip_special_tokens=False)
    def told(i, text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert sorted((str(r["doc_id"]), *r[1:]) for r in bpe.digests(docs, path).collect()) == sorted(told(r["doc_id"], r["text"]) for r in docs.collect())
    assert bpe.digests(docs.limit(0), path).collect() == []


def test_hmm(docs):
    got = hmm.score(docs, most_words=8).collect()
    rows = docs.collect()
    tokens = [((r["text"] or "").encode().lower().split() + [None], r["doc_id"]) for r in rows]
    counts = Counter(itertools.chain.from_iterable(w for w, i in tokens if i is None or zlib.crc32(str(i).encode()) % 10))
    n, v = sum(counts.values()), len(counts)
    base = sorted(round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6) for w, _ in tokens)
    assert sorted(round(r["base_score"], 6) for r in got) == pytest.approx(base, abs=1e-5)
    assert sorted(r["n_known"] for r in got) == sorted(sum(x in counts for x in w) for w, _ in tokens)
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    assert hmm.score(docs.limit(0)).count() == 0


def test_forward_equals_all_paths():
    rng = np.random.default_rng(1)
    model = hmm.Hmm(rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1, 1, 1], 2).T)
    seqs = [np.array(s) for s in ([0, 2, 1], [1], [2, 2, 0, 1])]
    for s, got in zip(seqs, hmm.likelihoods(model, seqs), strict=True):
        total = sum(
            model.start[p[0]] * model.emit[s[0], p[0]] * np.prod([model.move[p[k - 1], p[k]] * model.emit[s[k], p[k]] for k in range(1, len(s))])
            for p in itertools.product(range(2), repeat=len(s)))
        assert got == pytest.approx(math.log10(total))
    starts, moves, emits, _ = hmm.expected(model, seqs)
    assert starts.sum() == pytest.approx(3) and moves.sum() == pytest.approx(5) and emits.sum() == pytest.approx(8)


def test_licenses(docs, spark):
    rows = [(1, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "RELEASED under the MIT licence"), (3, "plain words of a text"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0."),
            (6, "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nx")]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.told(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Apache-2.0", 2: "MIT", 3: "", 4: "", 5: "", None: "CC-BY-NC-4.0", 6: "ISC"}
    rows = docs.collect()
    got = license_scan.told(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in rows) and all(r["licenses"] == "" and r["n_licenses"] == 0 and r["best"] == 0 for r in got)
    assert license_scan.told(docs.limit(0)).collect() == []


def test_secrets(spark, docs):
    key = hashlib.sha1(b"1").hexdigest()
    rows = [(1, f'and token = "{key}" and'), (2, f"see commit {key} of"), (3, None), (4, "3963522770391943"), (5, f"a api_key={key[:32]};\nb password = 'Zk3x9Qw8Lm2Np7Rt5Vy1Ab4Cd'"), (6, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan(df).collect()}
    assert [got[k]["n_secrets"] for k in (1, 2, 3, 4, 5, 6)] == [1, 0, 0, 0, 2, 0]
    s = got[1]["secrets"][0]
    assert rows[0][1][s["start"] : s["end"]] == key
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert clean[1] == 'and token = "<secret>" and' and clean[2] == rows[1][1] and clean[3] is None
    same = secret_scan.redact(docs)
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert secret_scan.redact(docs.limit(0)).collect() == [] == secret_scan.told(docs.limit(0)).collect()


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        toxic = int(rng.random() < 0.2)
        own = rng.choices(WORDS, k=rng.randint(5, 80))
        for _ in range(toxic * 2):
            own.insert(rng.randrange(len(own)), "grob" + rng.choice(WORDS)[:3])
        rows.append((k, " ".join(own), toxic))
        labels.append((k, 1, toxic))
    rows += [(700, None, 0), (701, "", 0), (None, "alpha", 0)]
    labels += [(5, 0, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in truth if k is not None and zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == [] == toxicity.drop_toxic(docs.limit(0), labels).collect()
    long = spark.createDataFrame([(900, "alpha beta " * 100_000 + "grobalp " * 3, 0), (901, "alpha beta " * 100_000, 0)], docs.schema)
    assert {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs.unionByName(long), labels).filter("doc_id >= 900").collect()} == {900: 1, 901: 0}
    assert [r["doc_id"] for r in toxicity.drop_toxic(docs.unionByName(long), labels).filter("doc_id >= 900").collect()] == [901]
    assert toxicity.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0


def test_context_of_secrets_is_the_whole_text(spark):
    key, other = hashlib.sha1(b"2").hexdigest(), hashlib.sha1(b"3").hexdigest()
    rows = [(1, f"GITHUB_ACCESS_TOKEN={key}\n"), (2, f'x AWS_SECRET_ACCESS_KEY="{key}"'), (3, f"my_service_auth_token: {key}\n"), (4, f"é see commit {key} of"), (5, f"SERVICE_SECRET_TOKEN={key}\nGITHUB_ACCESS_TOKEN={other} and")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [rows[r["doc_id"] - 1][1][s["start"] : s["end"]] for s in r["secrets"]] for r in secret_scan.scan(df).collect()}
    assert got == {1: [key], 2: [key], 3: [key], 4: [], 5: [key, other]}
    assert {r["text"] for r in secret_scan.redact(df.filter("doc_id = 1")).collect()} == {"GITHUB_ACCESS_TOKEN=<secret>\n"}


def test_mixing_fills_the_target_past_long_documents(spark):
    rows = [(k, "w " * 100, "a") for k in range(400)] + [(400, "w " * 20_000, "a")] + [(500 + k, "w " * 100, "b") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    for seed in range(6):
        got = mixing.mixed(df, weights=(1, 1), seed=seed).collect()
        assert sum(r["taken"] for r in got if r["doc_id"] <= 400) == 40_000 and len(got) == len(rows)
    # whatever fits is used, and repeated rows are taken alike
    sizes = [random.Random(5).choice([1, 7, 50, 900]) for _ in range(60)]
    rows = [(k, "w " * n, "a") for k, n in enumerate(sizes)] + [(None, "w w", "a")] * 3 + [(100, "w " * (sum(sizes) // 3), "b")]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1), seed=1).collect()
    assert len(got) == len(rows) and len({r["taken"] for r in got if r["doc_id"] is None}) == 1
    a = [r for r in got if r["doc_id"] != 100]
    missing = a[0]["target"] + 0.5 - sum(r["taken"] for r in a)
    assert 0 <= missing and all(r["taken"] or r["size"] * (3 if r["doc_id"] is None else 1) > missing for r in a)


def test_licenses_inside_lines_paragraphs_and_comments(spark):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 300).split()
    gpl = next(t for n, t in license_scan.TEMPLATES if n == "GPL-3.0" and len(t) > 100).split()

    def comment(mark, words):
        return "\n".join([mark + " Copyright", mark] + [f"{mark} " + " ".join(words[k : k + 8]) for k in range(0, len(words), 8)] + [mark, mark + " " + "other words here " * 30])

    rows = [(1, "Copyright (c) 2024 Acme Inc. All rights reserved."), (2, "This project is released under the MIT License."), (3, comment("#", mit)), (4, comment(" *", gpl)), (5, comment("dnl", gpl)),
            (6, "alpha beta " * 300 + "it is Licensed under CC BY-SA 4.0. All Rights Reserved by us " + "gamma delta " * 300), (7, "the license of the software is free, and all rights are ours"), (8, "Released under the MIT License.\n\nplain")]
    got = {r["doc_id"]: r for r in license_scan.told(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r["licenses"] for k, r in got.items()} == {1: "proprietary", 2: "MIT", 3: "MIT", 4: "GPL-3.0", 5: "GPL-3.0", 6: "CC-BY-SA-4.0,proprietary", 7: "", 8: "MIT"}
    found = {r["doc_id"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1][0]["unit"] == "all rights reserved" and found[1][0]["dice"] == 1 and len(found[8]) == 1


def test_forest_keeps_its_recall_in_dense_labels():
    rng = np.random.default_rng(6)

    def unit(x):
        return x / np.linalg.norm(x, axis=1)[:, None]

    for mean in (0.9, 0.95):
        centre = unit(rng.standard_normal((1, 64)))
        base = unit(np.sqrt(mean) * centre + np.sqrt((1 - mean) / 64) * rng.standard_normal((20_000, 64)))
        far = rng.standard_normal((2_000, 64))
        a = base[:2_000]
        far = unit(far - (far * a).sum(axis=1)[:, None] * a)
        x = np.concatenate([base, 0.982 * a + np.sqrt(1 - 0.982**2) * far]).astype(np.float32)
        met = np.zeros(2_000, dtype=bool)
        for t in range(embeddings.TREES):
            row, cell = embeddings.route(embeddings.grow(x, 7, t), x)
            cells = {}
            for r, c in zip(row.tolist(), cell.tolist(), strict=True):
                cells.setdefault(r, set()).add(c)
            met |= np.array([bool(cells[k] & cells[20_000 + k]) for k in range(2_000)])
        assert met.all(), (mean, met.mean())


def test_hmm_fills_its_vocabulary_from_ties(spark):
    docs = spark.createDataFrame([(k, " ".join(w for w in ("alpha", "beta", "gamma", "delta") for _ in range(20))) for k in range(30)], "doc_id long, text string")
    for r in hmm.score(docs, most_words=3, states=4).collect():
        assert r["score"] > 0.8 * r["base_score"]
