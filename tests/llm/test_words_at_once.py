"""New words of a chunk are cut all at once, and what a task learnt leaves with it."""

import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing
from gleaner.llm.tokens import WordIds, default_path, word_ids

TEXTS = ["It's x1y2 né, NÉE été's", None, "", "<|endoftext|> <|ENDOFTEXT|> A<|b", "x1y2 ¿qué? Åx ﬁn İx á ''s 's\x1ft", "WORD word, Word's (word) 12.5% ...", "été"]


def library(text, end):
    return Tokenizer.from_file(default_path()).encode(text or "", add_special_tokens=False).ids + [end]


def test_new_words_are_cut_at_once():
    encoder, calls = WordIds(default_path()), []
    cut = encoder.cut
    encoder.cut = lambda text: calls.append(text) or cut(text)
    found, limits = encoder.encode(TEXTS, 3)
    assert [found[a:b].tolist() for a, b in zip(limits, limits[1:])] == [library(t, 3) for t in TEXTS]
    assert len(calls) == 1


def test_words_leave_with_the_task():
    with word_ids(default_path()) as encoder:
        encoder.encode(["alpha beta, x1"], 0)
        assert len(encoder.words.index) == 3 and encoder.pieces.index
    assert not encoder.words.index and not encoder.pieces.index
    with pytest.raises(ZeroDivisionError), word_ids(default_path()) as again:
        again.encode(["gamma"], 0)
        raise ZeroDivisionError
    assert again is encoder and not again.words.index


@pytest.mark.parametrize("rows", [1, 3, 1024])
def test_slices_give_the_same_pieces(docs_of, monkeypatch, rows):
    monkeypatch.setattr(packing, "SLICE_ROWS", rows)
    docs = docs_of([(i, t) for i, t in enumerate(TEXTS)] + [(99, "word " * 4100), (None, "x")]).coalesce(1)
    found = {(r.doc_id, r.piece): (r.start, r.length) for r in packing.tokenized_pieces(docs).collect()}
    lengths = {i: len(library(t, 0)) for i, t in enumerate(TEXTS)} | {None: 2}
    assert found == {(d, 0): (0, n) for d, n in lengths.items()} | {(99, 0): (0, 2048), (99, 1): (2048, 2048), (99, 2): (4096, 5)}
