"""The pipeline's stages, and the whole of it, against plain Python."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest


import corpus_pipeline
from assaykit.llm import token_files
from tests.llm.test_operators import classes, containment


@pytest.fixture(scope="module")
def folder(docs, crowded, rows, spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    crowded.write.parquet(f"{top}/documents.parquet")
    items = [(1, " ".join(rows[2][1].split()[3:40])), (2, " ".join(rows[8][1].split()[:30])), (3, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_run(spark, folder, rows, crowded):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        assert docs.columns == crowded.columns and {r.score for r in docs.select("score").distinct().collect()} <= {"extra"}
        docs = corpus_pipeline.materialize(docs, name)
        after = Counter((r.doc_id, r.text) for r in docs.collect())
        seen[name] = after
        own = Counter((i, t) for i, t, _ in before)
        if name == "language_id":
            assert all(n == own[k] for k, n in after.items())
            assert {k for k in own if k not in after} >= {(i, t) for i, t in own if not any(c.isalpha() for c in t or "")}
        elif name == "ngram_join":
            want = {c for _, c, _ in classes([(i, t) for i, t, _ in before])}
            assert {i for i, _ in after} == want and set(after.values()) == {1}
        elif name == "decontamination":
            bad = {(i, t) for i, t, _ in before if any(n and s >= 0.8 * n for s, n in (containment(t, x) for x in items))}
            assert bad and after == Counter({k: n for k, n in own.items() if k not in bad})
        else:
            assert set(after) <= set(own) and max(after.values()) <= 3
    ids, start, want = token_files.encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer, 0, []
    mixed = docs.select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert Counter((r.doc_id, r.text) for r in mixed) == seen["mixing"]
    for r in mixed:  # in the order of the mix
        own = np.array([*ids.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


def test_stages_of_nothing(spark, nothing, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0


def test_names_and_registration():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "mixing", "token_files"]
    known = __spark_entry__.queries()
    assert "pipeline" in known and all(sum(k.startswith(f"op{n}_") for k in known) == 1 for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(known)
