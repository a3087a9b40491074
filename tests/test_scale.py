"""Cases that grow: many titles, deep titles, short runs, circles in listings, marks inside texts."""

import random
import time
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan import lineage
from loomspan.functions import strings, vectors
from loomspan.operators import context, folds, refine, similarity
from loomspan.operators.chunkers import ByBlock, BySection
from loomspan.plans import ingest
from loomspan.schema import BLOCK
from loomspan.sources import files


def block(i, kind, text, level=0, source="s"):
    return (source, kind, text, 0, [0, 0, 1, 1], level, "", "", [], [], i, i, "{}")


def test_breadcrumbs_of_random_titles(spark):
    """Against the folds' stack: blank titles, levels 0, negative, beyond the places with windows."""
    rng = random.Random(0)
    rows = [block(i, rng.choice(["title", "title", "text"]), rng.choice(["", " ", f"t{i}", f"u{i} "]), rng.choice([0, 1, 2, 3, 5, 7, 9, 12, -1, None] if k < 3 else [12, 14, 9, 12, 13, 8]), f"s{k}") for k in range(6) for i in range(150)]
    got = {(r.source, r.block_index): (r.title_path, r.title_level) for r in context.with_breadcrumb(spark.createDataFrame(rows, BLOCK)).collect()}
    for k in range(6):
        titles = folds.Titles()
        for r in rows:
            if r[0] == f"s{k}":
                if r[1] == "title":
                    titles.enter({"title_level": r[5], "text": r[2]})
                assert got[r[0], r[10]] == (titles.path, titles.level), r
    assert max(p.count(" > ") for p, _ in got.values()) > context.PLACES


def test_a_document_of_many_titles(spark):
    n = 100_000
    d = spark.range(n).select(F.lit("s").alias("source"), F.lit("title").alias("kind"), F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 6 + 1).cast("int").alias("title_level"), F.col("id").cast("int").alias("block_index"), F.col("id").cast("int").alias("reading_order"))
    began = time.time()
    last = context.with_breadcrumb(d).orderBy(F.desc("block_index")).first()
    assert last.title_path.endswith(f"t{n - 1}") and time.time() - began < 30


@pytest.mark.parametrize("window", [1, 3, 4, 7])
def test_smoothing_of_short_runs(spark, window):
    rng = np.random.default_rng(window)
    runs = {n: rng.random(n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 20)}
    d = spark.createDataFrame([(n, i, float(x)) for n, v in runs.items() for i, x in enumerate(v)], "run_id int, vec_id int, sim double")
    got = {}
    for r in similarity.polynomial_smooth(d, window, 2).orderBy("vec_id").collect():
        got.setdefault(r.run_id, []).append(r.smooth)
    for n, v in runs.items():
        assert got[n] == pytest.approx(folds.smoothed(v, window, 2).tolist()), n
    for k in (1, 2):
        found = {(r.run_id, r.vec_id): r.d for r in similarity.polynomial_smooth(d, window, 2, derivative=k, out="d").collect()}
        for n, v in runs.items():
            assert [found[n, i] for i in range(n)] == pytest.approx(folds.smoothed(v, window, 2, k).tolist(), abs=1e-9), (n, k)


def test_local_minima(spark):
    """A parabola has one; flat stretches and maxima have none; the chunker cuts where the windows do."""
    x = np.arange(20)
    for v, want in ((0.3 + (x - 9) ** 2 / 400, [9]), (0.9 - (x - 9) ** 2 / 400, []), (np.full(20, 0.5), [])):
        d = spark.createDataFrame([(1, int(i), float(s)) for i, s in enumerate(v)], "run_id int, vec_id int, sim double")
        assert [r.vec_id for r in similarity.local_minima(d, 5, 2, tolerance=0.004).filter("is_break").collect()] == want
    vecs = np.repeat(np.eye(4), 6, axis=0) + 0.02 * np.random.default_rng(0).random((24, 4))
    groups = folds.semantic_groups(vecs, folds.SemanticRules(threshold=10, window=3, order=2, minima=0.6))
    assert [g[0] for g in groups] == [0, 6, 12, 18]


def test_marks_inside_texts_are_no_cuts(spark):
    text = f"A first {strings.MARK}sentence here. {strings.CUT}Another one{strings.KEPT} there! The end{strings.MARK}"
    got = spark.createDataFrame([(text,)], "t string").select(strings.split_sentences(F.col("t"), folds.DELIMITERS, "prev", 3)).first()[0]
    assert got == strings.split_sentences_py(text, folds.DELIMITERS, "prev", 3) == [f"A first {strings.MARK}sentence here.", f"{strings.CUT}Another one{strings.KEPT} there!", f"The end{strings.MARK}"]


def test_folders_by_uri(spark, tmp_path):
    """As paths of file systems other than the local one are read."""
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for at, text in (("a.txt", "one"), ("deep/b.txt", "two"), ("deep/er/c.TXT", "three"), ("deep/d.bin", "x")):
        (tmp_path / at).write_text(text)
    uri = f"file://{tmp_path}"
    found = files.fetch(spark, folder=uri, extensions=["txt"])
    assert sorted(r.path for r in found.collect()) == [f"{uri}/a.txt", f"{uri}/deep/b.txt", f"{uri}/deep/er/c.TXT"]
    assert sorted(r.value for r in files.read_rows(found).collect()) == ["one", "three", "two"]
    assert files.fetch(spark, folder=uri, recursive=False).count() == 1
    assert ingest.ingest(spark, f"{uri}/deep/er/", "by_block").first().page_content == "three"
    assert ingest.ingest(spark, f"{uri}/a.txt", "by_block").first().source == f"{uri}/a.txt"


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda k, d=None: d)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077")))
    conf = types.SimpleNamespace(get=lambda k, d=None: "hdfs://x/y/")
    assert lineage.shared_folder(types.SimpleNamespace(conf=conf)) == "hdfs://x/y"


def test_a_circle_in_a_listing(spark):
    d = spark.createDataFrame([(1, None, "a", True), (2, 1, "b", True), (2, 2, "b", True)], "id int, parent_id int, name string, is_folder boolean")
    with pytest.raises(ValueError, match="deeper"):
        files.listed_files(d, most_levels=5)


def test_context_by_document(spark):
    """Documents over several batches, long and short, in one task each."""
    rows = [block(i, "text" if i else "title", f"{k} word " * (400 if k % 3 == 0 else 5), 1, f"s{k}") for k in range(9) for i in range(7)]
    chunks = refine.refine(BySection()(spark.createDataFrame(rows, BLOCK)))
    many = chunks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("chunk_index", F.col("k")).drop("k")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = refine.add_context(many, lambda p: str(len(p))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 36
    for r in got:
        whole = "\n\n".join([r.page_content] * 4)
        summary = str(len(refine.SUMMARY_PROMPT.format(strings.trim_middle_py(whole, refine.MOST_CHARS))))
        info = whole if len(whole) <= refine.WHOLE_CHARS else summary
        assert (r.doc_summary, r.chunk_context) == (summary, str(len(refine.CONTEXT_PROMPT.format(info, r.page_content))))


def test_context_by_a_model_that_takes_the_shared_part_apart(spark):
    class Model:
        def generate(self, prompt):
            return "summary"

        def generate_contextual(self, context, prompt):
            return f"{len(context)}+{len(prompt)}"

    chunks = BySection()(spark.createDataFrame([block(0, "text", "one two")], BLOCK))
    r = refine.add_context(chunks, Model()).first()
    assert sum(map(int, r.chunk_context.split("+"))) == len(refine.CONTEXT_PROMPT.format("one two", "one two")) and r.doc_summary == "summary"


@pytest.mark.parametrize("mode", ["path", "base64"])
def test_chunks_without_images_are_spread(spark, mode):
    """Beside images, rows that want none are joined in tasks of about equal size."""
    kinds = ["text"] * 7 + ["image"]
    rows = [(f"/a/s{i % 40}.pdf", kinds[i % 8], "t", 0, [0, 0, 1, 1], 0, "", f"{i}.png" if kinds[i % 8] == "image" else "", [], [], i, i, "{}") for i in range(800)]
    chunks = ByBlock()(spark.createDataFrame(rows, BLOCK))
    images = spark.createDataFrame([(f"file:/a/{i}.png", b"x") for i in range(7, 800, 16)], "path string, content binary")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        d = refine.refine(chunks, images=images, base_dir="/a", image_mode=mode)
        each = [r[0] for r in d.groupBy(F.spark_partition_id()).count().select("count").collect()]
        got = d.select("extras.img_path", "extras.image_b64").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(each) == 800 and max(each) < 400
    assert sum(r.image_b64 == "data:image/png;base64,eA==" if mode == "base64" else (r.img_path or "").startswith("/a/") for r in got) == 50


def test_percentiles_of_short_runs():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 8, 13, 100, 1001):
        for q in (0, 5, 25, 25.0, 33.3, 50, 75, 99.9, 100):
            x = np.round(rng.random(n), 9)
            assert vectors.percentile(x, q) == np.percentile(x, q), (n, q)
