import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from stratalog.llm.queries import tokenizer_file
from stratalog.llm.tokens import ByteEncoder, WordEncoder


@pytest.mark.parametrize(("cls", "name"), [(ByteEncoder, "byte_bpe_50k.json"), (WordEncoder, "word_bpe_49k.json")])
def test_added_tokens_are_the_untouched_library_s(cls, name):
    plain = Tokenizer.from_file(tokenizer_file(name))
    r = random.Random(9)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "<|", "|>", " ", "  ", "\n", "word", "é", "́", "̸", "'s", "B1", "中", "don", "'", "t", "."]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n", "<|<|endoftext|>|>", "don<|endoftext|>'t"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    want = [np.asarray(x.ids, "<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    got = list(cls(tokenizer_file(name)).encode(texts))
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_one_id_for_an_added_token():
    assert np.frombuffer(next(ByteEncoder(tokenizer_file("byte_bpe_50k.json")).encode(["a <|endoftext|> b"])), "<u4").tolist() == [64, 220, 50256, 275]
