import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkcast.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(2)
    letters = "aaaaeeiinnooorrsttthhlldcumpgf''  .,!1239\n\tÉéß#<|>üИжñ世界ΣςİÅÅ­　🙂é"
    out = ["", " ", "\n\t", "Hello, world! It's we'll 12345", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext", "ΑΣ ΣΑΣ", "I'LL'S",
           "hahahahahahahahahaha" * 20, "ab" * 3000, "!" * 500, "ẹ́ ṩ ﬁ", "\x1c\x1d\x85\xa0 x​y"]
    for n in [3, 10, 40, 200] * 120:
        out.append("".join(rng.choice(letters) for _ in range(n)))
    out += ["".join(chr(rng.choice([rng.randrange(1, 0xd800), rng.randrange(0xe000, 0x11000)])) for _ in range(30)) for _ in range(300)]
    return out + [" ".join(f"long{i % 331}ing" for i in range(60_000))]


def test_equals_merging(reference):
    mine = bpe.WordBpe(PATH)
    for text in texts():
        want = reference.encode(text, add_special_tokens=False).ids
        packed = mine.encode(text)
        assert [int.from_bytes(packed[i:i + 4], "little") for i in range(0, len(packed), 4)] == want, text[:80]
        assert mine.decode(packed) == reference.decode(want, skip_special_tokens=False)


def test_frames(spark, reference):
    rows = [(1, "One two", "x"), (1, "One two", "x"), (None, "three", None), (4, None, "y"), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    key = lambda r: (r[0] or 0, r[1])
    want = [(d, (e := reference.encode(t or "", add_special_tokens=False)).__len__(), reference.decode(e.ids, skip_special_tokens=False))
            for d, t, _ in rows]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded) for r in got), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).collect() == []
