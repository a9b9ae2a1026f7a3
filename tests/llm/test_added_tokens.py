"""The string of an added token in a text is its id, as in the library's own call."""

from __future__ import annotations

import numpy as np

from weftlog.llm import tokens


def test_added_tokens():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    plain = Tokenizer.from_file(path)
    added = [x.content for x in plain.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in added
    texts = ["no token here", *(form.replace("{}", x) for x in added for form in ("hello {} end", "{}", "a{}b", "one two{}{}\nthree, four.", "a  {}\t{}", "It's {} ."))]
    encoder = tokens.Encoder(path)
    for _ in range(2):  # with and without remembered pieces
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
        assert got == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert 50256 in got[1]
