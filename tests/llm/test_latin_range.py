"""Every character that op9's shortcut takes, against the library."""

import numpy as np
import pyarrow as pa

import public_tokenizers as P
from sparkloom.llm import op9_huffman_ids as op9


def test_each_character_of_the_range():
    own = op9.word_bpe(P.path("word_bpe_49k.json"))
    chars = [chr(i) for i in (*range(0x20, 0x7F), *range(0xA1, 0x250))]
    texts = [t for c in chars for t in (c, f"{c}li", f"a{c}b 1{c}2", f"li{c}")]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(pa.array(texts))]
    want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
