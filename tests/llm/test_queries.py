"""Registered queries against their SQL, and the pipeline's stages against brute-force versions."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from brightloom.llm import bpe, minhash, mixing, queries, toxicity
from tests.compare import differences

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert differences(spark, DATA, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_stages(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    source = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, held = source, [source]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append(docs)
    raw, clean, distinct, masked, mix, encoded = held
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for stage in held[1:5]:
        assert stage.schema == source.schema
    good = {r["doc_id"] for r in toxicity.toxicity(raw, labels).filter("predicted = 0").collect()}
    assert {r["doc_id"] for r in clean.collect()} == good

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {r["doc_id"]: shingles(r["text"]) for r in clean.collect()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in distinct.collect()) == sorted(i for i in sets if find(i) == i)
    before = {r["doc_id"]: r["text"] for r in distinct.collect()}
    for r in masked.collect():
        assert r["text"] == re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1<secret>\2", before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mixed(masked).collect()}
    assert Counter(r["doc_id"] for r in mix.collect()) == Counter({i: n for i, n in taken.items() if n})
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own = bpe.load(P.path("word_bpe_49k.json"))
    assert encoded.count() == mix.count()
    size = {r["doc_id"]: r["n_tokens"] for r in encoded.collect()}
    for r in mix.collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids
        assert size[r["doc_id"]] == len(ids) and own.decode(own.encode([r["text"]])[0]) == t.decode(ids, skip_special_tokens=False)


def test_run_is_registered():
    assert len(corpus_pipeline.STAGES) == 5 and callable(corpus_pipeline.run) and minhash.SHINGLE == 5
