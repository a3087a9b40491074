"""Hand-computed cases of the folds and their rules."""

import random

import pytest

from loomspan.functions import tokens
from loomspan.functions.strings import split_sentences_py
from loomspan.operators import chunkers as C
from loomspan.operators import folds


def block(i, text, kind="text", level=0, **more):
    return {"source": "s", "kind": kind, "text": text, "page_idx": 0, "bbox": [0, 0, 1, 1], "title_level": level, "html": "", "img_path": "", "captions": [], "footnotes": [], "block_index": i, "reading_order": i, **more}


def by_len(s):
    return len(s)


def test_breadcrumb_is_positional():
    t, seen = folds.Titles(), []
    for text, level in [("A", 2), ("B", 2), ("C", 2), ("D", 3), ("E", 1), ("F", 3), ("  ", 2)]:
        t.enter(block(0, text, "title", level))
        seen.append(t.path)
    assert seen == ["A", "A > B", "A > C", "A > C > D", "E", "E > F", "E"]


def test_token_window_may_exceed_its_limit_by_the_overlap():
    blocks = [block(0, "a" * 50), block(1, "b" * 500)]
    out = folds.token_chunks(blocks, by_len, 512, 64, False)
    assert [c["block_indices"] for c in out] == [[0], [0, 1]]


def test_token_oversized_block_stands_alone_with_its_kind():
    blocks = [block(0, "a" * 10), block(1, "b" * 600, "list"), block(2, "c" * 10)]
    out = folds.token_chunks(blocks, by_len, 512, 64, False)
    assert [(c["kind"], c["block_indices"]) for c in out] == [("text", [0]), ("list", [1]), ("text", [2])]


def test_token_empty_block_counts():
    out = folds.token_chunks([block(0, "")], tokens.BUILT_IN["heuristic"].count, 512, 64, False)
    assert [c["page_content"] for c in out] == [""]


def test_sentence_packing():
    text = "Hello world. This is a simple test! How are you doing? I am fine, thank you."
    rules = folds.SentenceRules(chunk_size=10, overlap=0)
    out = folds.sentence_chunks([block(0, text)], tokens.BUILT_IN["word"].count, rules)
    assert [c["page_content"] for c in out] == ["Hello world. This is a simple test!", "How are you doing? I am fine, thank you."]


@pytest.mark.parametrize(
    ("kinds", "want"),
    [
        ([("title", "T"), ("text", "Some text of it here.")], [("text", "T\n\nSome text of it here.")]),
        ([("title", "T"), ("title", "U")], [("title", "T"), ("title", "U")]),
        ([("title", "T"), ("table", "cells")], [("title", "T"), ("table", "cells")]),
        ([("title", "T")], [("title", "T")]),
    ],
)
def test_deferred_title(kinds, want):
    blocks = [block(i, t, k, 1) for i, (k, t) in enumerate(kinds)]
    out = folds.sentence_chunks(blocks, tokens.BUILT_IN["heuristic"].count, folds.SentenceRules())
    assert [(c["kind"], c["page_content"]) for c in out] == want


def test_compat_keeps_the_empty_title():
    blocks = [block(0, "T", "title", 1), block(1, "Some text of it here.")]
    out = folds.sentence_chunks(blocks, tokens.BUILT_IN["heuristic"].count, folds.SentenceRules(compat=True))
    assert [(c["kind"], c["page_content"]) for c in out] == [("text", "T\n\nSome text of it here."), ("title", "")]


def test_overlap_tail_is_emitted_again_before_an_oversized_sentence():
    text = "aaaaaaaaaaaa. bbbbbbbbbbbb. " + "c" * 60 + "."
    out = folds.sentence_chunks([block(0, text)], by_len, folds.SentenceRules(chunk_size=30, overlap=15))
    assert [c["page_content"] for c in out] == ["aaaaaaaaaaaa. bbbbbbbbbbbb.", "bbbbbbbbbbbb.", "c" * 60 + "."]


def test_short_pieces_are_dropped():
    parts = split_sentences_py("a" * 22 + ". " + "b" * 23 + ". ", [". "], "prev", 24)
    assert parts == ["b" * 23 + "."]


def test_recursive_split_bounds_and_hard_cut():
    text = " ".join("word%d" % i for i in range(200))
    pieces = folds.recursive_split(text, tokens.BUILT_IN["word"].count, 60)
    assert [len(p.split()) for p in pieces] == [60, 60, 60, 20] and " ".join(pieces) == text
    assert all(len(p) <= 10 for p in folds.recursive_split("x" * 95, by_len, 10, hard=True))
    assert folds.recursive_split("x" * 95, by_len, 10) == ["x" * 95]


def test_guided_offsets_are_true():
    text = "First sentence here it is. Second sentence follows it now. Third one ends the run here."
    out = folds.guided_chunks([block(0, text)], by_len, lambda p, a, z: z, 60, 30, 5, False)
    assert all(c["page_content"] in text for c in out)
    assert "".join(c["page_content"].replace(" ", "") for c in out) == text.replace(" ", "")


def test_guided_gives_up_after_retries():
    asked = []
    out = folds.guided_chunks([block(0, "One sentence of it. Two sentences of it. Three of them now.")], by_len, lambda p, a, z: asked.append(a) or 99, 100, 25, 5, False)
    assert len(asked) % 3 == 0 and len(out) == len(asked) // 3


def test_multipass_levels_and_parents():
    base = [folds.new_chunk("x" * 400, "text", folds.Titles(), [block(i, "")], i) for i in range(6)]
    base.insert(3, folds.new_chunk("T", "table", folds.Titles(), [block(9, "")], 9))
    out = folds.linked(folds.multipass_chunks(base, tokens.BUILT_IN["heuristic"].count, "mini", [("normal", 512), ("large", 2048)], True), "s")
    assert [c["chunk_index"] for c in out] == list(range(len(out)))
    normal = [c for c in out if c["granularity"] == "normal"]
    assert [c["kind"] for c in normal] == ["text", "table", "text"]
    by_index = {c["chunk_index"]: c for c in out}
    for c in base:
        parent = by_index[c["extras"]["parent_chunk_index"]]
        assert parent["granularity"] == "normal" and c["page_content"] in parent["page_content"]
    for level in ("mini", "normal", "large"):
        row = [c for c in out if c["granularity"] == level]
        assert row[0]["prev_chunk_index"] is None and row[-1]["next_chunk_index"] is None
        assert all(a["next_chunk_index"] == b["chunk_index"] for a, b in zip(row, row[1:]))


def test_every_kept_block_is_in_a_token_chunk():
    rng = random.Random(1)
    for _ in range(50):
        blocks = [block(i, "w" * rng.randint(0, 80), rng.choice(["text", "list", "title", "table", "discarded"]), 1) for i in range(30)]
        out = folds.token_chunks(blocks, by_len, 100, rng.choice([0, 30]), False)
        assert {i for c in out for i in c["block_indices"]} == {b["block_index"] for b in blocks if b["kind"] != "discarded"}
        firsts = [c["block_indices"][-1] for c in out]
        assert firsts == sorted(firsts)


@pytest.mark.parametrize(
    "make",
    [
        lambda: C.ByToken(0), lambda: C.ByToken(10, 10), lambda: C.BySentence(chunk_size=0), lambda: C.BySentence(include_delim="x"), lambda: C.Recursive(min_chars=0),
        lambda: C.Semantic(threshold=101), lambda: C.Semantic(threshold_type="x"), lambda: C.Guided(candidate_size=0), lambda: C.FixedSize(10, 10), lambda: C.chunker("nope"),
    ],
)
def test_bad_options(make):
    with pytest.raises(ValueError):
        make()


def test_tokenizers():
    assert tokens.resolve(None).count("abc") == 1
    assert tokens.resolve(len).count("abc") == 3

    class Duck:
        def count_tokens(self, text):
            return 7

    assert tokens.resolve(Duck()).count("x") == 7
    with pytest.raises(tokens.InvalidTokenizerError) as e:
        tokens.resolve("no-such-vocabulary")
    assert set(e.value.backend_errors) == {"tokenizers", "tiktoken", "transformers"}
    with pytest.raises(tokens.InvalidTokenizerError):
        tokens.resolve(3)
