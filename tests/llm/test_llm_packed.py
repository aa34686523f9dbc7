import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lagwise.llm import packed_ids as K
from lagwise.llm import queries
from lagwise.session import fresh_path
from llm_data import LONG, empty_documents, odd_documents, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a", "  b", "a  b", "a \n b", "x\t y", "<|endoftext|> a b", "it's 's ok 'll", "a\n\nb", "\n", "naïve café", "12 34 5", "a\r\nb", "a b c",
    "日本 語", "a ", "! !!", "don't stop", "word's. (x) a_b ²x ½", "é x", "  z", "a\nb\nc d", "I'm 'tis", "x." * 50,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [[*e.ids, 0] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_remembered_words_give_the_library_s_ids(spark, folder, library):
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    encoder = K.ByteLevelEncoder(PATH, memory=300)
    found = [ids for at in range(0, len(texts), 50) for ids in encoder(texts[at : at + 50])]
    assert [[*np.frombuffer(f, dtype="<u4").tolist(), 0] for f in found] == expected(library, texts)


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31])
def test_pack_and_unpack_any_run(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003)
    payload = K.pack(ids, bits)
    assert len(payload) == 126 * bits
    for start, stop in ((0, 1003), (77, 501), (8, 16), (5, 6), (1003, 1003)):
        assert K.unpack(payload, bits, start, stop).tolist() == ids[start:stop].tolist()
    assert K.width(50_257) == 16 and K.width(65_537) == 17 and K.width(1) == 1


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="70000 does not fit into 16 bits"):
        K.pack(np.array([1, 70_000]), 16)
    assert K.pack(np.array([65_535]), 16)[:2] == b"\xff\xff" and K.pack(np.zeros(0, dtype=int), 16) == b""
    assert K.vocabulary_size(PATH) == Tokenizer.from_file(PATH).get_vocab_size()


def test_round_trip_and_random_access(spark, library, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_IDS", 200)
    target = fresh_path(spark, "packed")
    K.write_packed(odd_documents(spark), target, PATH, 50_257, part_bytes=1 << 18)
    rows = K.read_documents(spark, target).collect()
    texts = sorted(((r[0], r[1]) for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [i for i, _ in texts]
    ids = expected(library, [t for _, t in texts])
    assert sorted(map(tuple, (r.ids for r in rows))) == sorted(map(tuple, ids))
    stream = [x for r in rows for x in r.ids]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)
    for start, stop in ((0, 10), (150, 420), (len(stream) - 5, len(stream)), (3, 3)):
        assert K.read_run(spark, target, start, stop).tolist() == stream[start:stop]
    assert len(LONG) > 1 << 20


def test_no_documents_and_whole_table(spark, folder, library):
    target = fresh_path(spark, "packed")
    K.write_packed(empty_documents(spark), target, PATH, 50_257)
    assert K.read_documents(spark, target).collect() == []
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    ids = expected(library, [r.text for r in docs])
    start, want = 0, []
    for r, own in zip(docs, ids):
        want.append((r.doc_id, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
        start += len(own)
    found = queries.QUERIES["op4_packed_ids"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == want
