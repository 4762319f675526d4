"""The corpus pipeline against what its stages have to do, on a small folder of tables."""

from __future__ import annotations

import random

import pytest
import sentencepiece
from public_tokenizers import path

import corpus_pipeline
from mailsift.llm import personal
from tests.llm.test_llm import brute_components, quality_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    texts = [" ".join(r.choices([f"w{k}" for k in range(90)], k=r.randint(30, 60))) + "." for _ in range(40)]
    texts += [t.replace("w3 ", "W3 ") for t in texts[:10]]  # copies but for case
    texts += [" ".join(f"{w}###" if k % 2 else w for k, w in enumerate(t.split())) for t in texts[10:20]]  # junk
    texts += ["short", None, f"{texts[25]} write to a.b@mail.example.com"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, texts


def test_stages_one_by_one(spark, folder):
    where, texts = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where).cache()
        assert docs.columns == columns, name
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    good, single, masked, mixed = kept
    assert sorted(i for i, _ in good) == [*range(50), 62] and all(quality_brute(t)[0] >= 10 for _, t in good)
    ids = sorted(i for i, _ in good)
    roots = brute_components([texts[i] for i in ids])
    assert sorted(i for i, _ in single) == sorted({ids[k] for k in roots})
    assert all(not personal.base_spans(t) for _, t in masked) and any("<EMAIL>" in t for _, t in masked) == (62 in dict(single))
    assert {i for i, _ in mixed} <= dict(masked).keys() and all(dict(masked)[i] == t for i, t in mixed)
    words = lambda rows: sum(quality_brute(t)[0] for _, t in rows)
    assert abs(words(mixed) - 1.5 * words(masked)) <= 3 * 61


def test_whole_run(spark, folder):
    where, _ = folder
    rows = corpus_pipeline.run(spark, where).collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    assert rows and all(r["parity"] and r["restored"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(processor.encode(processor.decode(r["ids"])) == r["ids"] for r in rows)
