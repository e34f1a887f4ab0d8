"""Texts that hold an added token, against the plain tokenizer."""

import numpy as np
from tokenizers import Tokenizer

from hourloom.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z", "one two\n<|endoftext|><|endoftext|>", "a <|endoftext| > b", "no marker here"]


def test_ids_are_those_of_the_plain_tokenizer(spark):
    path = packing.vocabulary_file()
    plain = Tokenizer.from_file(path)
    want = {i: [*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(TEXTS)}
    assert 50256 in want[0]
    assert all(np.frombuffer(packing.Encoder(path).encode(t), "<u4").tolist() == want[i][:-1] for i, t in enumerate(TEXTS))
    rows = packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows} == want


def test_a_normaliser_sends_all_texts_to_the_tokenizer(tmp_path):
    plain = Tokenizer.from_file(packing.vocabulary_file())
    from tokenizers import AddedToken, normalizers

    plain.normalizer = normalizers.Lowercase()
    plain.add_tokens([AddedToken("hello there", normalized=True)])
    plain.save(str(tmp_path / "own.json"))
    encoder = packing.Encoder(str(tmp_path / "own.json"))
    for text in ["say HELLO there now", "Say more"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
