"""The stages against brute force, each on its own input, and the pipeline as a whole."""

import hashlib
import os

import brute
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
from paytrail.llm import bpe, credentials, queries
from paytrail.sources.scratch import pin

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = queries.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = pin(stage(spark, docs, SF), name).df
        out.append((docs.toArrow().to_pylist(), after.toArrow().to_pylist(), after.columns))
        docs = after
    return out


def test_stages_return_documents(stages):
    names = pq.read_schema(f"{SF}/documents.parquet").names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "byte_bpe"]
    assert all(columns == names for _, _, columns in stages[:-1])


def test_toxic_documents_go(stages):
    before, after, _ = stages[0]
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    kept = {r["doc_id"] for r in after}
    assert all(r in before for r in after)
    clean = [i for i, t in toxic.items() if not t]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages[1]
    group = brute.near_duplicates([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in group.values()})
    assert all(r in before for r in after)


def test_benchmark_passages_go(stages):
    before, after, _ = stages[2]
    items = [(str(r["item_id"]), r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    hit = {r["doc_id"] for r in before if brute.contamination(r["text"], items)[1]}
    left = {r["doc_id"]: r for r in after}
    assert all(left[r["doc_id"]] == r for r in before if r["doc_id"] not in hit)
    assert not any(brute.contamination(r["text"], items)[1] for r in after)
    assert all(r["n_chars"] == len(r["text"] or "") for i, r in left.items() if i in hit)


def test_secrets_are_masked(stages):
    before, after, _ = stages[3]
    left = {r["doc_id"]: r for r in after}
    assert len(left) == len(before)
    for r in before:
        spans = [s for k, rule in enumerate(credentials.RULES) for s in rule.spans(r["text"] or "")]
        assert bool(spans) == (left[r["doc_id"]] != r)
        assert not any(rule.spans(left[r["doc_id"]]["text"] or "") for rule in credentials.RULES)


def test_ids_decode_to_the_text(stages):
    import tiktoken

    before, after, _ = stages[4]
    ranks = bpe.read_ranks(public_tokenizers.path(queries.BPE_VOCABULARY))
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] or "" for r in before}
    assert {r["doc_id"]: (r["ids"], r["n_tokens"]) for r in after} == {i: (ids := public.encode_ordinary(t), len(ids)) for i, t in text.items()}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in after)


def test_pipeline_is_registered(spark, stages):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, SF).toArrow().to_pylist()
    assert sorted(rows, key=lambda r: r["doc_id"]) == sorted(stages[-1][1], key=lambda r: r["doc_id"])
    assert [n for n in entry.queries() if n.startswith("op")] == [f"op{n}_{x}" for n, x in enumerate("sharding topk near_duplicates decontamination token_counts toxicity secrets byte_bpe language_model warc quality fill_in_middle filter_audit".split(), 1)]
