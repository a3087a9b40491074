"""What users bring: chunkers, parsers, models, vision, drawings."""

import asyncio
import json
import os
import pickle
import types

import pytest
from pyspark.sql import functions as F

from loomspan import interfaces
from loomspan.functions import tokens
from loomspan.functions.models import ChatModel
from loomspan.operators import refine
from loomspan.operators.chunkers import ByBlock, ByToken
from loomspan.plans import ingest
from loomspan.schema import BLOCK
from loomspan.sinks import drawing
from loomspan.sources import parsers, web


def blocks(spark, *texts):
    return spark.createDataFrame([("s", "text", t, i, [0, 0, 500, 500], 0, "", "", [], [], i, i, "{}") for i, t in enumerate(texts)], BLOCK)


def test_chunk_batches(spark):
    a, b = blocks(spark, "one", "two"), blocks(spark, "three")
    got = ByBlock().chunk_batch([a, b], ["x", "y"]).orderBy("source", "chunk_index").collect()
    assert [(r.source, r.chunk_index, r.page_content) for r in got] == [("x", 0, "one"), ("x", 1, "two"), ("y", 0, "three")]
    assert ByToken().chunk(a, "z").first().source == "z" and ByToken().chunk(a).first().source == "s"
    with pytest.raises(ValueError, match="sources"):
        ByBlock().chunk_batch([a], [])
    with pytest.raises(ValueError, match="at least one"):
        ByBlock().chunk_batch([], [])


def test_a_chunker_of_ones_own(spark):
    mine = interfaces.PerDocument(lambda rows: [{"page_content": r["text"].upper(), "block_indices": [r["block_index"]]} for r in rows])
    got = ingest.run(blocks(spark, "one", "two"), mine).orderBy("chunk_index").collect()
    assert [(r.page_content, r.next_chunk_index, bool(r.content_hash)) for r in got] == [("ONE", 1, True), ("TWO", None, True)]
    with pytest.raises(ValueError, match="when it is made"):
        ingest.run(blocks(spark, "x"), mine, chunk_size=3)
    with pytest.raises(Exception, match="not fields of a chunk: contents"):
        interfaces.PerDocument(lambda rows: [{"contents": "x"}])(blocks(spark, "x")).collect()


def test_bases(spark):
    with pytest.raises(TypeError):
        interfaces.Refinery()

    class Loud(interfaces.Refinery):
        def enrich(self, chunks):
            return chunks.withColumn("page_content", F.upper("page_content"))

    class Count(interfaces.Sink):
        def export(self, chunks, target=None):
            return chunks.groupBy("source").count()

    class Words(interfaces.Tokenizer):
        def count_tokens(self, text):
            return len(text.split())

    class Letters(interfaces.Embedder):
        def embed_batch(self, texts):
            return [[float(len(t))] for t in texts]

    c = ByBlock()(blocks(spark, "one two", "x"))
    assert [r.page_content for r in Loud().enrich_batch([c, c]).collect()].count("ONE TWO") == 2 and Loud()(c).count() == 2
    assert Count().export_batch([c, c]).first()["count"] == 4 and Count()(c).first()["count"] == 2
    assert tokens.resolve(Words()).count("a b c") == 3 and Words().count_tokens_batch(["a", "b c"]) == [1, 2] and Letters().embed("abc") == [3.0]

    class Nothing(interfaces.Fetcher):
        def fetch(self, spark, path=None, folder=None, **options):
            return spark.range(1)

    assert Nothing()(spark).count() == 1
    with pytest.raises(NotImplementedError):
        Nothing().fetch_named(spark, "f", "n")


def test_models_called_asynchronously():
    m = ChatModel("u", "m", send=lambda u, h, b: {"choices": [{"message": {"content": b["messages"][-1]["content"] + "!"}}]})

    async def both():
        return await asyncio.gather(m.generate_async("a"), m.generate_async("b"))

    assert asyncio.run(both()) == ["a!", "b!"] and m.generate_batch(["x"]) == ["x!"]


def test_tokenizers_that_arent_there():
    with pytest.raises(tokens.InvalidTokenizerError) as e:
        tokens.resolve("no-such-vocabulary")
    assert set(e.value.backend_errors) == {"tokenizers", "tiktoken", "transformers"}


def test_content_list_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    out = str(tmp_path / "out")

    def run(folder, name, data):
        deep = os.path.join(folder, "cut-name", "auto")
        os.makedirs(deep)
        with open(os.path.join(deep, "x_content_list.json"), "w") as f:
            json.dump([{"type": "text", "text": f"{name} {len(data)}"}], f)

    p = parsers.ContentListParser(run, output=out)
    got = ingest.ingest(spark, str(tmp_path / "a.pdf"), "by_block", parse=p).collect()
    assert [r.page_content for r in got] == ["a.pdf 4"]
    docs = spark.createDataFrame([(str(tmp_path / "a.pdf"),) * 2], "source string, path string")
    assert p.process_batch([docs]).first().text == "a.pdf 4"
    with pytest.raises(Exception, match="left no"):
        parsers.ContentListParser(lambda *_: None)(docs).collect()
    with pytest.raises(Exception, match="mineru isn't installed"):
        parsers.ContentListParser()(docs).collect()


def test_layout_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")

    def convert(path):
        box = types.SimpleNamespace(l=0.0, t=90.0, r=50.0, b=10.0, coord_origin="BOTTOMLEFT")
        prov = [types.SimpleNamespace(page_no=1, bbox=box)]
        items = [types.SimpleNamespace(label="section_header", text="T", level=1, prov=prov), types.SimpleNamespace(label="table", prov=prov, export_to_html=lambda d: "<t/>", caption_text=lambda d: "cap"), types.SimpleNamespace(label="text", text="x", prov=[])]
        page = types.SimpleNamespace(size=types.SimpleNamespace(width=100.0, height=100.0))
        return types.SimpleNamespace(iterate_items=lambda: [(i, 0) for i in items], pages={1: page})

    docs = spark.createDataFrame([(str(tmp_path / "a.pdf"),) * 2], "source string, path string")
    got = parsers.LayoutParser(convert).process(docs).orderBy("block_index").collect()
    assert [(r.kind, r.text, r.title_level, r.html, r.captions, r.bbox) for r in got] == [("title", "T", 3, "", [], [0, 100, 500, 900]), ("table", "", 0, "<t/>", ["cap"], [0, 100, 500, 900]), ("text", "x", 0, "", [], [0, 0, 0, 0])]
    with pytest.raises(Exception, match="docling isn't installed"):
        parsers.LayoutParser()(docs).collect()


def test_vision_reads_images_by_their_path(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(b"png!")
    rows = [("s", "image", "", 0, [0, 0, 1, 1], 0, "", str(tmp_path / n), [], [], i, i, "{}") for i, n in enumerate(("i.png", "missing.png"))]
    c = ByBlock()(spark.createDataFrame(rows, BLOCK))

    class Eyes(interfaces.Model):
        def generate(self, prompt):
            return ""

        def generate_vision(self, prompt, image):
            return image

    got = refine.add_vision(c, Eyes()).orderBy("chunk_index").collect()
    assert [r.page_content for r in got] == ["data:image/png;base64,cG5nIQ==", ""]


def test_drawn_pages(spark, tmp_path):
    c = ByBlock()(blocks(spark, "one", "two", "three").withColumn("page_idx", F.col("page_idx") * 2).withColumn("kind", F.when(F.col("block_index") == 0, "title").otherwise("text")))
    r = drawing.write_pdfs(c, str(tmp_path / "pdfs"), 100, 200).first()
    data = open(r.path, "rb").read()
    assert r.n_pages == 5 and data.startswith(b"%PDF-1.4") and data.rstrip().endswith(b"%%EOF")
    assert data.count(b"/Type /Page ") == 5 and data.count(b" re S") == 3 and b"0.85 0.1 0.1 RG" in data
    start = int(data.split(b"startxref\n")[1].split()[0])
    assert data[start : start + 4] == b"xref"
    first = int(data[start:].split(b"\n")[3].split()[0])
    assert data[first:].startswith(b"1 0 obj")


def test_web_fetcher(spark, tmp_path):
    def get(url):
        if url.endswith("/broken"):
            raise OSError
        return url.encode()

    f = web.WebFetcher(str(tmp_path / "pages"), "html", get)
    got = sorted((r.source, os.path.basename(r.path), r.mime_type) for r in f.fetch(spark, "http://h.example/a/b", urls=["https://g.example/x?q=1", "http://h.example/broken"]).collect())
    assert [x[0] for x in got] == ["http://h.example/a/b", "https://g.example/x?q=1"] and got[0][1:] == ("h.example_a_b.html", "text/html")
    with pytest.raises(ValueError, match="at least one URL"):
        f(spark, "/no/url")
    with pytest.raises(ValueError, match="mode"):
        web.WebFetcher(str(tmp_path), "png")
    with pytest.raises(ImportError, match="playwright"):
        web.Browser()("http://h.example")


def test_browser_waits_prints_and_closes():
    done = []

    class Page:
        def goto(self, url, wait_until, timeout):
            done.append((url, timeout))

        def wait_for_load_state(self, state, timeout):
            raise TimeoutError(state)

        def emulate_media(self, media):
            done.append(media)

        def pdf(self, format, print_background):
            return b"%PDF"

        def content(self):
            return "<p>é"

        def close(self):
            done.append("closed")

    b = web.Browser("pdf")
    b._context = types.SimpleNamespace(new_page=Page)
    assert b("http://x") == b"%PDF" and done == [("http://x", 30_000), "screen", "closed"]
    b.mode = "html"
    assert b("http://x") == "<p>é".encode() and done[-1] == "closed"
    assert pickle.loads(pickle.dumps(web.Browser("html")))._context is None
