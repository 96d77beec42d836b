import zlib

import numpy as np
import pytest

from trackloom.llm import token_output as t
from trackloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, n_tokens string, start string"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(t.tokenizer_path())


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_pack_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**bits, n).astype(np.uint32)
    assert (t.unpack(t.pack(ids, bits), n, bits) == ids).all()


def test_bits():
    assert [t.bits_for(x) for x in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize(
    "text",
    ["", " ", "  a  b ", "it's we'll 123abc a_b", "a\n\n b\t c\r\n", "Ära übère ñandú ×÷ ½ Ⅷ", "x<|endoftext|>y", "日本語 text", "tail\n ", " a b\x1cc", "'S 'll", "don't_stop!? ...  --"],
)
def test_encoder_equals_library(text):
    encoder = t.Encoder(open(t.tokenizer_path(), encoding="utf-8").read(), entries=3)
    want = library().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def test_query_round_trip(spark):
    long = "word " * 30000
    rows = [(3, "three words here"), (None, "no id"), (1, None), (2, ""), (3, "three words here"), (3, "another"), (7, long), (9, "end ñ")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = t.encode_documents(spark, docs).orderBy("start").collect()
    tk, start = library(), 0
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3, 7, 9]
    texts = {}
    for d, x in rows:
        ids = np.array([*tk.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        texts.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == start
        assert (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        start += r.n_tokens


def test_random_access(spark):
    docs = spark.createDataFrame([(k, f"alpha {k} " * 9000) for k in range(6)], "doc_id long, text string").coalesce(1)
    scratch = Scratch(spark, "t")
    manifest = t.write_shards(docs, t.tokenizer_path(), f"{scratch.path}/s", scratch=scratch).collect()
    tk = library()
    seen = 0
    for m in manifest:
        shard = t.Shard(m.path)
        for k, d in enumerate(shard.doc_ids.tolist()):
            assert shard.document(k).tolist() == [*tk.encode(f"alpha {d} " * 9000, add_special_tokens=False).ids, 2]
            seen += 1
    assert seen == 6


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert t.encode_documents(spark, docs).collect() == []
