"""Files, parsing, refinement, sinks, streaming."""

import base64
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import strings, tokens, vectors
from loomspan.operators import chunkers, folds, refine, similarity
from loomspan.plans import ingest, registry_io
from loomspan.schema import BLOCK, CHUNK
from loomspan.sinks import chunks as sinks
from loomspan.sources import files
from loomspan.streaming import chunks as streaming

ITEMS = [
    {"type": "text", "text": "Chapter", "text_level": 1, "bbox": [1, 2, 3, 4], "page_idx": 0},
    {"type": "text", "text": "First paragraph of the text. It has two sentences."},
    {"type": "list", "list_items": [" a ", " ", "b"]},
    {"type": "table", "table_body": "<table>x</table>", "table_caption": ["Cap"]},
    {"type": "image", "img_path": "images/p.png", "page_idx": 1},
    {"type": "code", "code_body": "print(1)"},
    {"type": "odd", "text": "unknown type"},
    {"type": "discarded", "text": "page 1"},
    {"type": "table", "text_level": 2, "text": "titled table"},
    {"text": ""},
]


@pytest.fixture
def tree(tmp_path):
    for name in ("a.PDF", "b.txt", "_hidden.pdf", ".dot.pdf", "noext", "sub/c.pdf"):
        p = tmp_path / "files" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("Part one.\n\n  \n\nPart two.")
    os.symlink(tmp_path / "files" / "sub", tmp_path / "files" / "link")
    return str(tmp_path / "files")


@pytest.fixture
def output(tmp_path):
    out = tmp_path / "out"
    (out / "images").mkdir(parents=True)
    (out / "images" / "p.png").write_bytes(b"\x89PNG data")
    (out / "x_content_list.json").write_text(json.dumps(ITEMS))
    return str(out)


def test_fetch(spark, tree):
    names = lambda d: sorted(os.path.relpath(r.source, tree) for r in d.collect())
    assert names(files.fetch(spark, folder=tree, extensions=["pdf"])) == [".dot.pdf", "_hidden.pdf", "a.PDF", "sub/c.pdf"]
    assert names(files.fetch(spark, folder=tree, extensions=[".PDF"], recursive=False)) == [".dot.pdf", "_hidden.pdf", "a.PDF"]
    row = files.fetch(spark, path=f"{tree}/b.txt", metadata={"k": "v"}).first()
    assert (row.mime_type, row.metadata) == ("text/plain", {"k": "v"})
    assert files.fetch_named(spark, tree, "noext").first().mime_type == "application/octet-stream"
    for bad in ({}, {"path": "a", "folder": "b"}):
        with pytest.raises(ValueError):
            files.fetch(spark, **bad)
    with pytest.raises(FileNotFoundError):
        files.fetch(spark, path=f"{tree}/none")


def test_ingest_text(spark, tree):
    rows = ingest.ingest(spark, f"{tree}/b.txt", "by_block").orderBy("chunk_index").collect()
    assert [(r.page_content, r.prev_chunk_index, r.next_chunk_index) for r in rows] == [("Part one.", None, 1), ("Part two.", 0, None)]
    with pytest.raises(ValueError):
        ingest.ingest(spark, f"{tree}/a.PDF")


def test_ingest_output(spark, output):
    rows = ingest.ingest(spark, output, "by_block", captions=True).orderBy("chunk_index").collect()
    assert [r.kind for r in rows] == ["title", "text", "list", "table", "image", "text", "text", "title", "text"]
    assert [r.page_content for r in rows][2:6] == ["a\nb", "<table>x</table>", "", "print(1)"]
    assert rows[4].extras.inferred_caption == "Image — Chapter — p.2"
    assert rows[7].title_path == "Chapter > titled table"
    images = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(output)
    row = ingest.ingest(spark, output, "by_block", image_mode="base64", image_files=images).filter("kind = 'image'").first()
    assert row.extras.image_b64 == "data:image/png;base64," + base64.b64encode(b"\x89PNG data").decode()
    row = ingest.ingest(spark, output, "by_block", image_files=images).filter("kind = 'image'").first()
    assert row.extras.img_path == os.path.join(output, "images/p.png")
    assert ingest.ingest_from_json(spark, f"{output}/x_content_list.json", "by_token", tables=False).filter("kind = 'table'").count() == 0


@pytest.mark.parametrize("strategy", sorted(chunkers.STRATEGIES))
def test_every_strategy(spark, output, strategy):
    rows = ingest.ingest(spark, output, strategy).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    for r in rows:
        for link, back in ((r.next_chunk_index, "prev_chunk_index"), (r.prev_chunk_index, "next_chunk_index")):
            assert link is None or rows[link][back] == r.chunk_index
        assert len(r.content_hash) == 16 and r.token_count >= 0


def test_numbers_by_several_chunkers(spark):
    """Chunkers that fold share a pass, of which each document's chunks come out as by each alone."""
    blocks = spark.createDataFrame([(f"d{i % 3}", k, t, i, [0, 0, 1, 1], 1 if k == "title" else 0, "", "", [], [], i, i, "{}") for i, (k, t) in enumerate([("title", "T"), ("text", "One. Two is longer. Three!"), ("table", "x"), ("discarded", "9"), ("text", "a b " * 900)] * 6)], BLOCK)
    by = {n: c() for n, c in chunkers.STRATEGIES.items()} | {"with discarded": chunkers.ByToken(include_discarded=True)}
    want = sorted((n, r.source, r.chunk_index) for n, c in by.items() for r in c(blocks).select("source", "chunk_index").collect())
    assert sorted(map(tuple, chunkers.numbers(blocks, by).collect())) == want
    plan = registry_io.strategies(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_empty_blocks(spark):
    none = spark.createDataFrame([], BLOCK)
    for make in set(chunkers.STRATEGIES.values()):
        assert make()(none).count() == 0


def test_strip_is_pythons(spark):
    samples = ["  x　", "\x1fx", " a b ", "", "\x85 y​", "\tz\n"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").select("i", strings.strip(F.col("s")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [s.strip() for s in samples]


def test_counters_agree(spark):
    samples = ["", " ", "a b  c", "é ü", "😀 x", "a" * 99]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    for t in [*tokens.BUILT_IN.values(), tokens.resolve(lambda s: len(s) + 1)]:
        assert [r.n for r in df.select("i", t.column(F.col("s")).alias("n")).orderBy("i").collect()] == t.count_batch(samples)


def test_trim_middle(spark):
    df = spark.createDataFrame([("x" * 100,), ("y" * 101,), (None,)], "s string").select(strings.trim_middle(F.col("s"), 100).alias("s")).collect()
    assert df[0].s == "x" * 100 and len(df[1].s) == 100 and df[2].s is None
    assert df[1].s == "y" * 40 + " […] " + "y" * 55


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [2.0, 2.0])], "a array<double>, z array<double>, c array<double>").select(vectors.cosine(F.col("a"), F.col("z")).alias("zero"), vectors.cosine(F.col("a"), F.col("c")).alias("half")).first()
    assert row.zero == 0 and row.half == pytest.approx(2**-0.5)
    x = np.random.default_rng(0).random(20)
    assert np.allclose(folds.smoothed(x, 3, 2), x)
    line = np.arange(20.0)
    assert np.allclose(folds.smoothed(line, 7, 2), line)
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate((0.1, 0.2, 0.4, 0.9))], "run_id int, vec_id int, sim double")
    assert [r.is_break for r in similarity.breakpoints(d).orderBy("vec_id").collect()] == [True, False, False, False]  # below 0.175
    with pytest.raises(vectors.InvalidEmbedderError):
        vectors.resolve_embedder(3)
    assert vectors.resolve_embedder(lambda t: [[1] for _ in t])(["a"]) == [[1.0]]


def test_percentile_of_semantic_groups():
    vecs = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1], [0, 1]])
    groups = folds.semantic_groups(vecs, folds.SemanticRules())
    assert groups == [[0, 1], [2, 3, 4]]
    merged = folds.semantic_groups(vecs, folds.SemanticRules(skip_window=1, threshold=99.0))
    assert merged == [[0, 1, 2, 3, 4]]


def test_context_and_vision(spark, output):
    chunks = ingest.ingest(spark, output, "by_block")
    out = refine.add_context(chunks, lambda p: f"len {len(p)}").orderBy("chunk_index").collect()
    assert all(r.doc_summary.startswith("len") for r in out)
    assert [bool(r.chunk_context) for r in out] == [bool(r.page_content.strip()) for r in out]

    def broken(prompt):
        raise OSError("no model")

    assert refine.add_context(chunks, broken).first().doc_summary == ""
    with pytest.raises(Exception):
        refine.add_context(chunks, broken, on_error="raise").collect()
    images = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(output)
    seen = refine.add_vision(ingest.ingest(spark, output, "by_block", image_mode="base64", image_files=images), lambda p, i: f" seen {i[:14]} ")
    assert [r.page_content for r in seen.filter("kind = 'image'").collect()] == ["seen data:image/png"]


def test_sinks(spark, output, tmp_path):
    chunks = ingest.ingest(spark, output, "by_block")
    sinks.write_jsonl(chunks, str(tmp_path / "lines"), single_file=True)
    lines = [json.loads(x) for p in (tmp_path / "lines").glob("part-*") for x in p.read_text().splitlines()]
    assert list(lines[0]) == CHUNK.fieldNames()
    assert [x["chunk_index"] for x in lines] == list(range(len(lines)))
    assert lines[0]["prev_chunk_index"] is None and lines[3]["extras"]["captions"] == ["Cap"] and "img_path" not in lines[3]["extras"]
    back = sinks.read_jsonl(spark, str(tmp_path / "lines"))
    assert sorted(back.drop("extras").collect(), key=lambda r: r.chunk_index) == sorted(chunks.drop("extras").collect(), key=lambda r: r.chunk_index)
    sinks.write_json_array(chunks, str(tmp_path / "all.json"))
    assert json.loads((tmp_path / "all.json").read_text()) == lines
    assert json.loads(sinks.formatted(chunks, "langchain").first().metadata)["source"]
    assert "position_int" not in json.loads(sinks.formatted(chunks, "llamaindex").first().metadata)
    with pytest.raises(ValueError):
        sinks.formatted(chunks, "nope")


def test_json_array_in_ranges(spark, tmp_path, monkeypatch):
    """The file is what json gives; it is read in many ranges, also where an element is longer than some."""
    monkeypatch.setattr(sinks, "RANGE", 2000)
    texts = ["x" * 5000, '\n    {\n', "é}],\r\u2028", '"\\"', ""] * 4
    rows = [("d%02d" % (i % 7), "text", t, 0, [0, 0, 1, i], 0, "", "", [], [], i, i, "{}") for i, t in enumerate(texts)]
    chunks = chunkers.ByBlock()(spark.createDataFrame(rows, BLOCK).repartition(5))
    want = [json.loads(r.value) for r in chunks.orderBy("source", "chunk_index").select(sinks.json_line().alias("value")).collect()]
    for indent in (4, 0):
        path = str(tmp_path / f"{indent}.json")
        sinks.write_json_array(chunks, path, indent)
        pad = " " * indent
        assert open(path, newline="").read() == "[\n" + ",\n".join("\n".join(pad + x for x in json.dumps(w, ensure_ascii=False, indent=indent).split("\n")) for w in want) + "\n]\n"
        d = sinks.read_json_array(spark, path)
        assert d.rdd.getNumPartitions() == -(-os.path.getsize(path) // 2000)
        got = sorted(d.collect(), key=lambda r: r.place)
        assert [r.place for r in got] == list(range(len(texts)))
        assert [(r.source, r.chunk_index, r.page_content, r.position_int) for r in got] == [(w["source"], w["chunk_index"], w["page_content"], w["position_int"]) for w in want]
    sinks.write_json_array(chunks.filter("false"), path)
    assert open(path).read() == "[]\n" and sinks.read_json_array(spark, path).count() == 0
    (tmp_path / "other.json").write_text('[{"source": "a"}]')
    with pytest.raises(ValueError):
        sinks.read_json_array(spark, str(tmp_path / "other.json"))


def test_json_array_query_reads_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(sinks, "RANGE", 100_000)
    d = registry_io.json_array_file(spark, "/root/testdata/sf0.001")
    assert d.rdd.getNumPartitions() > 5 and d.agg({"place": "max"}).first()[0] == d.count() - 1


def test_web_names_and_download(spark, tmp_path):
    urls = ["https://h.example:8080/a/b?x=1", "https://h.example:8080/a/b?x=2", "https://h.example/bad"]

    def get(url):
        if url.endswith("bad"):
            raise OSError
        return url.encode()

    rows = files.download(spark, urls, get, str(tmp_path)).collect()
    assert len({r.path for r in rows}) == 2 and all(os.path.basename(r.path).startswith("h.example:8080_a_b_") for r in rows)


def test_rotated_rects(spark, output):
    chunks = ingest.ingest(spark, output, "by_block").filter("chunk_index = 0").withColumn("position_int", F.expr("array(array(0, 100, 200, 300, 600))"))
    get = lambda r: tuple(round(v, 6) for v in sinks.pdf_rects(chunks, 500.0, 1000.0, rotation=r).select("x", "y", "w", "h").first())
    assert get(0) == (50, 400, 100, 400)
    assert get(90) == (400, 50, 400, 100)
    assert get(180) == (350, 400, 100, 400)
    assert get(270) == (200, 350, 400, 100)


def test_stream(spark, output, tmp_path):
    stream = streaming.content_list_stream(spark, output)
    q = streaming.chunk_stream(stream, chunkers.ByBlock(), str(tmp_path / "sink"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 9
    assert streaming.new_documents(stream).isStreaming
