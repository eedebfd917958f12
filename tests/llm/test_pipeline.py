"""The stages in order, on odd rows and on the given tables; SQL against the queries."""

import re

import pytest

import corpus_pipeline
from compare import difference, duck
from tickloom.llm.oracles import ORACLES
from tickloom.llm.queries import llm_queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(llm_queries()[name](spark, sf_dir), duck(sf_dir), ORACLES[name]) is None


def test_every_stage_takes_odd_rows(spark, sf_dir, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert set(docs.columns) <= set(out.columns), name
            assert out.count() <= docs.count()


def test_long_lines_are_kept_once(spark, sf_dir):
    """A passage on one line between lines of each document's own, and a document of one line copied whole."""
    long, other, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 50), ("b", 60), ("c", 49)))
    texts = [f"x\n{long}\ny", f"p\n{long}\n\nq\n{short}", other, other, f"{short}\nz\n{long}\n{long}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir).collect()}
    assert got == {0: texts[0], 1: f"p\nq\n{short}", 2: other, 3: "", 4: f"{short}\nz"}


def test_pipeline(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "pieces"]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns or k == 4, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:])) and seen[1] == seen[0] and len(seen[4]) == len(seen[3]) > 700
    assert docs.filter("not round_trip").count() == 0
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {" ".join(w[i:i + 10]) for w in items for i in range(len(w) - 9)}
    for r in docs.select("text").limit(200).collect():
        words = re.findall(r"\w+", r.text.lower())
        assert not grams & {" ".join(words[i:i + 10]) for i in range(len(words) - 9)}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(seen[4])
