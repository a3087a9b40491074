"""Adapters of services, with transports of their own."""

import os

import pytest

from loomspan.functions import models
from loomspan.operators import chunkers
from loomspan.plans import fixtures
from loomspan.sources.drive import Drive


def reply(text):
    return {"choices": [{"message": {"content": text}}]}


def test_model_repeats_and_gives_up():
    waits, calls = [], []

    def send(url, headers, body):
        calls.append((url, headers, body))
        if len(calls) < 3:
            raise models.Busy
        return reply("done")

    m = models.ChatModel("http://api/v1/", "m", "k", send=send, sleep=waits.append)
    assert m.generate("hi", system="s", max_tokens=5) == "done" and waits == [1, 2]
    url, headers, body = calls[-1]
    assert url == "http://api/v1/chat/completions" and headers["Authorization"] == "Bearer k" and body["max_tokens"] == 5 and len(body["messages"]) == 2

    def busy(*_):
        raise models.Busy

    with pytest.raises(models.Busy):
        models.ChatModel("u", "m", send=busy, sleep=waits.append).generate("x")
    assert waits[2:] == [1, 2, 4, 8]


def test_model_kinds():
    seen = []
    m = models.ChatModel("u", "m", send=lambda u, h, b: seen.append(b) or reply('{"a": 1}'))
    assert m.generate_json("x") == {"a": 1} and seen[-1]["response_format"]
    m.generate_vision("x", "data:image/png;base64,AA")
    assert seen[-1]["messages"][0]["content"][1]["image_url"]["url"].startswith("data:")
    m.generate_contextual("ctx ", "q")
    assert seen[-1]["messages"][0]["content"] == "ctx q"


@pytest.mark.parametrize(("answer", "want"), [('{"split_index": 4}', 4), ("passage 7, or 8", 7), ("none", None), ("[1]", 1), ('{"split_index": "x"}', None)])
def test_split_index(answer, want):
    assert models.split_index(answer) == want


def test_guided_by_a_model(spark):
    blocks = fixtures.blocks(spark, "/root/testdata/sf0.001").filter("source = 'doc:1'")
    rows = chunkers.Guided(models.choice(lambda prompt: "no idea"))(blocks).collect()
    assert rows and all(r.page_content for r in rows)


def test_drive(spark, tmp_path):
    pages = {
        "a/sites/h.example:/sites/x": {"id": "S"},
        "a/sites?search=x%20y": {"value": [{"id": "S"}, {"id": "Z"}]},
        "a/sites/S/drive": {"id": "D"},
        "a/drives/D/root/children": {"value": [{"id": "1", "name": "f", "folder": {}}, {"id": "2", "name": "n.pdf"}], "@odata.nextLink": "more"},
        "more": {"value": [{"id": "3", "name": "m.txt"}]},
        "a/drives/D/items/1/children": {"value": [{"id": "4", "name": "n.pdf"}, {"id": "5", "name": "broken.txt"}]},
    }

    def fetch(url, token):
        if "/5/" in url:
            raise OSError
        return url.encode()

    d = Drive("a/", "t", lambda url, token: pages[url], fetch)
    assert d.site_id(url="https://h.example/sites/x") == d.site_id(name="x y") == "S"
    with pytest.raises(ValueError):
        d.site_id()
    rows = d.download(spark, "S", str(tmp_path)).collect()
    assert sorted(os.path.basename(r.path) for r in rows) == ["m.txt", "n.pdf", "n_4.pdf"]
    assert {r.mime_type for r in rows} == {"application/pdf", "text/plain"}
