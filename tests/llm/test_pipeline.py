"""The pipeline's stages, each against brute force on its own input."""

import collections
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from hyperweft.llm import secret_scan
from hyperweft.llm.common import written
from .test_operators import base_counts, brute_components, words

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows, names = docs.columns, [docs.collect()], []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
        names.append(name)
        rows.append(docs.collect())
        assert name == "packing" or docs.columns == columns
    given, good, single, clean, mixed, packed = rows

    failed = {r["doc_id"] for r in given for c in [base_counts(r["text"])] if c[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert {r["doc_id"] for r in good} <= {r["doc_id"] for r in given} - failed and len(good) >= 0.85 * (len(given) - len(failed))
    assert set(good) <= set(given)

    sets, home = brute_components([(r["doc_id"], r["text"]) for r in good])
    assert collections.Counter(single) == collections.Counter(r for r in good if home[r["doc_id"]] == r["doc_id"])

    before = {r["doc_id"]: r["text"] for r in single}
    assert {r["doc_id"] for r in clean} == before.keys() and len(clean) == len(single)
    for r in clean:
        t = before[r["doc_id"]]
        hit = [m for p, g, n in secret_scan.KINDS.values() for m in re.finditer(f"({p})", t) if len(m[g]) >= n]
        if not hit:
            assert r["text"] == t or "[SECRET]" in r["text"]
        assert all(m[0] not in r["text"] for m in hit) and r["n_chars"] == len(r["text"])

    size, taken, source = collections.Counter(), collections.Counter(), {}
    for r in clean:
        size[r["doc_id"]] += len(words(r["text"]))
        source[r["doc_id"]] = r["source"]
    for r in mixed:
        taken[r["doc_id"]] += len(words(r["text"]))
    assert all(n <= 2 * size[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(set(source.values()))

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in mixed:
        want[r["doc_id"]] += len(t.encode(r["text"], add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == want and names == [n for n, _ in corpus_pipeline.STAGES]
