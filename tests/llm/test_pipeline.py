"""The pipeline against a plain version of each stage, on the smallest tables."""

import ast
import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockloom.llm import decontaminate as d
from blockloom.llm import quality
from tests.llm.test_decontaminate import lcs
from tests.llm.test_line_dedup import brute as cut_lines
from tests.llm.test_minhash import brute as near
from tests.llm.test_tokens import expected

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_against_a_plain_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    items = [(d.words(r.text), d.answer_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in docs.collect() if model.score(r.text or "") >= quality.KEEP]
    rows = [(i, t) for i, t, _, _ in cut_lines(rows, 0.1, 2)]
    group = near(rows, 5)
    rows = [(i, t) for i, t in rows if group[i] == i]

    def leaks(text):
        w = d.words(text)
        for seq, answer in items:
            n = len(seq)
            if len(set(w) & set(seq)) < 0.4 * len(set(seq)):
                continue
            for start in d.passages(len(w)):
                part = w[max(0, start - n) : start + d.PASSAGE + n]
                share = lcs(seq, part) / n
                if share >= d.LEAK or share >= d.PARAPHRASE and any(part[k : k + len(answer)] == answer for k in range(len(part))):
                    return True
        return False

    rows = [(i, t) for i, t in rows if not leaks(t)]
    got = {}
    for p in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u2").astype("<u4").tobytes()))
    assert set(got) == {i for i, _ in rows}
    assert all(b"".join(x for _, x in sorted(got[i])) == expected("word_bpe_49k.json", t, 2).tobytes() for i, t in rows)


def test_stages_on_odd_rows(spark, docs, empty, tmp_path):
    """Null, empty, long, repeated and clashing rows through every stage, each with its defined result."""
    base = docs.where("doc_id = 0").first().text
    spark.createDataFrame([(i, i % 2, 0) for i in range(14)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, base[:200]), (1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = docs.withColumns({c: F.lit(1) for c in ("bl_gone", "bl_score", "bl_leaked", "bl_host", "bl_lines", "bl_salt", "kept", "component_id", "score", "item_id", "start", "ids")})
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        kept[name] = out.collect()
        if name != "packing":
            assert out.columns == odd.columns, name
        none = stage(spark, empty, str(tmp_path))
        assert none.count() == 0 and (name == "packing" or none.columns == empty.columns), name
    rows = docs.collect()
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert sorted(str(r.doc_id) for r in kept["quality classifier"]) == sorted(str(r.doc_id) for r in rows if model.score(r.text or "") >= quality.KEEP)
    lines = cut_lines(rows, 0.1, 2)
    assert sorted(((r.doc_id, r.text) for r in kept["line dedup"]), key=str) == sorted(((i, t) for i, t, _, _ in lines), key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept["line dedup"])
    group = near([(r.doc_id, r.text) for r in rows], 5)
    assert sorted(str(r.doc_id) for r in kept["near dedup"]) == sorted(str(r.doc_id) for r in rows if r.doc_id is None or group[r.doc_id] == r.doc_id)
    assert sorted(str(r.doc_id) for r in kept["benchmark decontamination"]) == sorted(str(r.doc_id) for r in rows if r.doc_id not in (0, 1, 2))
    tokens = {}
    for p in kept["packing"]:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    want = {}
    for r in rows:
        want[r.doc_id] = want.get(r.doc_id, 0) + len(expected("word_bpe_49k.json", r.text, 2))
    assert tokens == want


def test_stages_keep_the_columns_of_documents(spark, docs):
    small = docs.where("doc_id is not null")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, small, SF).columns == docs.columns, name
    assert corpus_pipeline.line_stage(spark, small, SF).schema == docs.schema
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "benchmark decontamination", "packing"]


def test_nothing_else_imports_the_subpackage():
    top = Path(corpus_pipeline.__file__).parent / "blockloom"
    for f in top.rglob("*.py"):
        if "llm" in f.relative_to(top).parts:
            continue
        names = []
        for n in ast.walk(ast.parse(f.read_text())):
            if isinstance(n, ast.ImportFrom):
                names += [n.module or "", *(f"{n.module}.{a.name}" for a in n.names)]
            elif isinstance(n, ast.Import):
                names += [a.name for a in n.names]
            elif isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value.startswith("blockloom.llm"):
                names.append(n.value)
        assert not any(re.search(r"\bllm\b", x) for x in names), f
