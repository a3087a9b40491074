"""The pipeline as a whole, on the driver's smallest tables, against plain Python."""

import collections
import os

import cases
from test_corpus_operators import brute_components
from test_row_operators import base_quality, brute_lines, water

import corpus_pipeline
from loomspan.llm import decontaminate

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lambda d: {r.doc_id: (r.doc_id, r.text, r.lang, r.source) for r in d.collect()}
    stage = dict(corpus_pipeline.STAGES)
    before = rows(docs)

    one = stage["quality rules"](spark, docs, DATA).cache()
    after = rows(one)
    assert one.schema == docs.schema and all(after[i] == before[i] for i in after)
    assert not any(base_quality(r[1])[5] for r in after.values())
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality == 1 and not base_quality(before[r.doc_id][1])[5]}
    assert good <= set(after)

    two = stage["line dedup"](spark, one, DATA).cache()
    assert cases.spread((r.doc_id, r.text) for r in two.collect()) == cases.spread(x[:2] for x in brute_lines(list(after.values())))

    three = stage["near duplicates"](spark, two, DATA).cache()
    assert {r.doc_id for r in three.collect()} == {x[0] for x in brute_components(list(rows(two).values())) if x[3]}

    four = stage["decontamination"](spark, three, DATA).cache()
    gone = set(rows(three)) - set(rows(four))
    items = [" ".join(cases.words(r.text)).lower() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    holds = {i for i, r in rows(three).items() if any(x in " ".join(cases.words(r[1])).lower() for x in items)}
    assert holds <= gone
    assert gone == {r.doc_id for r in decontaminate.leaks(three, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}

    five = stage["mixing"](spark, four, DATA).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in four.collect():
        sizes[r.source] += len(cases.words(r.text))
    for r in five:
        taken[r.source] += len(cases.words(r.text))
    target = water(sizes)
    for s in sizes:
        largest = max(len(cases.words(r.text)) for r in four.collect() if r.source == s)
        assert abs(taken[s] - target[s]) <= max(5, 0.02 * target[s], largest / 2)
    assert max(collections.Counter(r.doc_id for r in five).values()) <= 2
    assert cases.spread(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == cases.spread(tuple(r) for r in five)


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert os.path.exists(os.path.join(os.path.dirname(corpus_pipeline.__file__), "bench.py"))
