"""The pipeline against its operators, stage by stage, on the smallest tables."""

import corpus_pipeline
from test_operators import SMALL, brute_components

from sievestone.llm import decontaminate
from sievestone.llm.shared import read


def test_pipeline(spark):
    docs = read(spark, SMALL, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        left = {r.doc_id: r.text for r in out.collect()}
        assert left.items() <= rows.items() and len(left) > 0.7 * len(rows)
        if name == "minhash_near_duplicates":
            assert set(left) == {i for i, (_, c) in brute_components(rows.items(), 5).items() if i == c}
        if name == "benchmark_decontamination":
            items = [" ".join(decontaminate.words_of(r.text)) for r in read(spark, SMALL, "benchmark").collect()]
            assert not any(i in " ".join(decontaminate.words_of(t)) for t in left.values() for i in items)
        path = corpus_pipeline.scratch(spark, name)
        out.write.parquet(path)
        docs, rows = spark.read.parquet(path), left
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == set(rows)


def test_rows_with_null_and_repeated_ids(spark):
    words = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(None, words("a")), (None, words("a")), (5, words("a")), (6, words("b")), (6, words("b")), (6, words("c")), (7, words("c")), (2, words("d")), (7, words("d")), (7, words("e")), (None, words("f")), (None, words("f")),
            (None, None), (None, None), (8, ""), (8, ""), (9, "")]
    out = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    want = [(5, words("a")), (6, words("b")), (6, words("c")), (2, words("d")), (7, words("e")), (None, words("f")), (None, None), (8, ""), (9, "")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    leak = read(spark, SMALL, "benchmark").filter("text is not null").first().text
    rows = [(None, leak), (1, leak), (1, words("a")), (None, words("b")), (None, None), (1, words("a"))]
    out = corpus_pipeline.without_benchmark(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [r for r in rows if r[1] != leak]))
