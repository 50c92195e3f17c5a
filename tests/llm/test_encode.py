import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from binloom.llm.encode import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def parts(texts):
    flat, first = Encoder(PATH).encode(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(first, first[1:])]


def test_special_cases():
    texts = ["", None, " ", "Hello  World's\n\tit's.", "<|endoftext|> A<|ENDOFTEXT|>b", "a.b,,c!!", "ΟΔΟΣ. Σ x.", "é. .́e",
             "12.5% a-b--c...d …. x", "x" * 5000, "don't.'s"]
    assert parts(texts) == whole(texts)
    assert parts([]) == []


def test_random_texts():
    rng = random.Random(3)
    letters = "ab'sStT \n.,!?:;&%$*#\"<|>()-_12é́Σσİ…가 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [t.replace("<", "") for t in texts]
    for i in range(0, len(texts), 500):
        assert parts(texts[i:i + 500]) == whole(texts[i:i + 500])


def test_small_cache_and_other_tokenizers(monkeypatch):
    monkeypatch.setattr("binloom.llm.encode.CACHED_WORDS", 3)
    assert parts(["a b c d", "d e f a"]) == whole(["a b c d", "d e f a"])
    plain = Encoder(public_tokenizers.path("byte_bpe_50k.json"), by_word=False)
    flat, first = plain.encode(pa.array(["Two  words", None]))
    assert np.diff(first).tolist() == [3, 0] and len(flat) == 3
