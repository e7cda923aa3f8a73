"""The pipeline against a brute-force version of its stages."""

import base64
import collections
import hashlib
import math

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from tests.llm.test_operators import _classes, _rows, SCHEMA

from offergrid.llm import mixing, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 7 == 0) for i in range(40)], "doc_id long, bad boolean").selectExpr(
        "doc_id", "CAST(1 AS INT) AS quality", "CAST(bad AS INT) AS toxic").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        after = out.collect()
        texts = {r["doc_id"]: r["text"] for r in before}
        if name == "exact_dedup":
            best = {}
            for d, t in texts.items():
                key = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
                best[key] = min(best.get(key, (1, 0)), (-len(t or ""), d))
            assert {r["doc_id"] for r in after} == {d for _, d in best.values()}
        if name == "near_dedup":
            assert {r["doc_id"] for r in after} == set(_classes(texts).values())
        if name == "mixing":
            plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
            assert collections.Counter(r["doc_id"] for r in after) == plan
            for source in {r["source"] for r in before}:
                rs = [r for r in mixing.mix(docs).collect() if r["source"] == source]
                taken = sum(r["copies"] * r["size"] for r in rs)
                assert abs(taken - math.floor(rs[0]["target"])) <= max(r["size"] for r in rs) / 2 + 1
        if name == "byte_bpe":
            assert len(after) == len(before) and all(r["round_trip"] for r in after)
        docs = spark.createDataFrame(after, out.schema)


def _plain_mix(docs, weights=(5, 2, 1), share=1.5, most=2):
    """Copies per doc_id, in plain Python: water line by capping again and again, cut in the order of hashed ids."""
    size = {d: len((t or "").split()) for d, t, _ in docs}  # the fixture's white space is ASCII
    of = collections.defaultdict(list)
    for d, _, source in docs:
        of[source].append(d)
    order = sorted(of, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(order)}
    total = {x: sum(size[d] for d in of[x]) for x in order}
    target, open_, left = {}, set(order), share * sum(total.values())
    while open_:
        line = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if most * total[x] < line * weight[x]}
        target |= {x: most * total[x] for x in full} if full else {x: line * weight[x] for x in open_}
        left -= sum(most * total[x] for x in full)
        open_ = open_ - full if full else set()
    out = collections.Counter()
    for x in order:
        budget = math.floor(target[x])
        rounds, rest = divmod(budget, total[x]) if total[x] else (0, budget)
        start = 0
        for d in sorted(of[x], key=lambda d: (hashlib.md5(f"mix:{d}".encode()).hexdigest(), d)):
            part = max(0, min(size[d], rest - start))
            out[d] = rounds + (start < rest and 2 * part >= size[d])
            start += size[d]
    return +out


def test_run_is_the_chain_of_its_stages(spark, folder):
    """Plain Python for exact and near copies, the mix and the tokens; the scorer's own verdicts for the first stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    verdicts = {r["doc_id"]: r["predicted"] for r in toxicity.judge(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    kept = {r["doc_id"]: r for r in docs.collect() if not verdicts[r["doc_id"]]}
    best = {}
    for d, r in kept.items():
        text = r["text"] or ""
        key = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (1, 0)), (-len(text), d))
    unique = {d: kept[d] for _, d in best.values()}
    classes = set(_classes({d: r["text"] for d, r in unique.items()}).values())
    copies = _plain_mix([(d, unique[d]["text"], unique[d]["source"]) for d in sorted(classes)])
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter(r["doc_id"] for r in got) == copies and sum(copies.values()) > 10
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in got:
        ids = library.encode_ordinary(kept[r["doc_id"]]["text"] or "")
        assert (list(r["token_ids"]), r["n_tokens"], r["round_trip"]) == (ids, len(ids), True)


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
