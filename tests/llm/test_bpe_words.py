"""Word parts against the library, on random signs that meet every rule of the splitter."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lathe.llm import bpe

SIGNS = [*"abcXYZ'`~!@#$%^&*()<>|{}[]0123456789  \n\t\x00\x01\x1c\x7f\x85\xa0é ÀÖ×÷ßİıȺƀǅ̸̱̈ 中一Ⅷ²½ŉſKͅΣςσ‍🙂", "<|endoftext|>", "<|startoftext|>", "'s ", "'ll", "n't", "endoftext"]


@pytest.mark.parametrize("cache_bytes", [bpe.CACHE_BYTES, 2000])
def test_words_equal_the_library(monkeypatch, cache_bytes):
    monkeypatch.setattr(bpe, "CACHE_BYTES", cache_bytes)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    rng = random.Random(1)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 60))) for _ in range(8000)] + [None, "", " "]
    rows = pa.table({"doc_id": list(range(len(texts))), "text": texts}).to_batches(max_chunksize=500)
    for out in bpe._encode(bpe.vocabulary_path())(iter(rows)):
        for i, ids, decoded in zip(*(c.to_pylist() for c in out.columns), strict=True):
            want = library.encode(texts[i] or "", add_special_tokens=False).ids
            assert bpe.unpack(ids) == want and decoded == library.decode(want, skip_special_tokens=False)


def test_vocabulary_with_white_space_is_refused():
    with pytest.raises(ValueError, match="white space"):
        bpe.Coder(bpe.vocabulary_path("byte_bpe_50k.json"))


def test_whole_rows_stay_with_their_ids(spark):
    rows = [(1, "a b", "x"), (None, None, "y"), (3, "q" * 9000 + " and " + "z!" * 900, "z"), (3, "q" * 9000, "w"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = bpe.encode(docs, whole=True, leaf_chars=200).collect()
    alone = {r["doc_id"]: r for r in bpe.encode(docs.filter("ids <> 'w'")).collect()}
    assert sorted(map(str, (tuple(r["row"]) for r in got))) == sorted(map(str, rows))
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for r in got:
        assert bpe.unpack(r["ids"]) == library.encode(r["row"]["text"] or "", add_special_tokens=False).ids
    assert bpe.unpack(alone[1]["ids"]) == library.encode("a b", add_special_tokens=False).ids


def test_stages_on_an_empty_table(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == [] and (name == "bpe" or out.columns == docs.columns), name


_WORKER = r"""
import random, re, sys
import pyarrow as pa
from lathe.llm import bpe

def held():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = random.Random(1)
    for _ in range(40):
        texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(60)) + " and the rest of it" * 70 for _ in range(500)]
        columns = {"doc_id": pa.array(range(500)), "text": pa.array(texts)}
        if sys.argv[1] == "whole":  # as the pipeline's rows travel
            columns["row"] = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        yield pa.RecordBatch.from_pydict(columns)

before = held()
print(max(held() - before for _ in bpe._encode(bpe.vocabulary_path())(batches())))
"""


@pytest.mark.parametrize("rows", ["narrow", "whole"])
def test_a_worker_stays_small(rows):
    # Two workers share an executor with the JVM; 1.2 million different words go through this one.
    done = subprocess.run([sys.executable, "-c", _WORKER, rows], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(done.stdout) < 180  # MB
