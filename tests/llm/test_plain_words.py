"""Words of ASCII letters, alone or before one mark, are encoded without the tokenizer's pattern and get the library's ids."""

import string

import numpy as np
from tokenizers import Tokenizer

from gleaner.llm.tokens import WordIds, default_path


def test_plain_words_need_no_pattern():
    path = default_path()
    encoder, library, cuts = WordIds(path), Tokenizer.from_file(path), []
    cut = encoder.cut
    encoder.cut = lambda text: cuts.append(text) or cut(text)
    words = ["Word", "word,", "ENDS.", "a", "I", "z!", "token", "'", "!", "a'b", "it's", "x1", "1.", "né,", "<|", "ab<|", "<|endoftext|>"]
    words += [f"marked{c}" for c in string.punctuation] + [f"{c}b" for c in string.punctuation]
    for word in words:
        got = np.frombuffer(encoder._encode(word.encode("utf-8")), np.int32).tolist()
        assert got == library.encode(word, add_special_tokens=False).ids, word
    assert not {"word", "word,", "ends.", "a", "token", "marked."} & set(cuts) and {"a'b", "x1", "né,"} <= set(cuts)
