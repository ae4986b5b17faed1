"""Special tokens within a text are what the library, as loaded, makes of them."""

import random

import numpy as np
from tokenizers import Tokenizer

from rangeweave.llm import tokens


def test_special_tokens_equal_the_library():
    lib = Tokenizer.from_file(tokens.tokenizer_path())
    r = random.Random(31)
    texts = ["x <|endoftext|> z", "<|endoftext|>", "a<|endoftext|>b c", "a  <|endoftext|>\n\n b", "\n<|endoftext|>", "<|endoftext|", "a\n<|endoftext|>\nb <|endoftext|> <|endoftext|>"]
    texts += ["".join(r.choice(["<|endoftext|>", " ", "\n", "a", "é", ".", "  ", "<|", "x y"]) for _ in range(20)) for _ in range(300)]
    for t in texts:
        assert tokens.encode_texts([t], tokens.tokenizer_path(), 7)[0] == np.array(lib.encode(t, add_special_tokens=False).ids + [7], "<u4").tobytes()
    assert np.frombuffer(tokens.encode_texts([texts[0]], tokens.tokenizer_path(), 7)[0], "<u4").tolist() == [87, 220, 50256, 1976, 7]
