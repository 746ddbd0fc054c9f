"""Bit packing, and token files against the tokenizers library."""

import zlib

import numpy as np
import pytest
from support import odd_documents, rows

from loomset.llm import bitpack, token_files
from loomset.llm.queries import vocabulary_path
from loomset.session import scratch_path

SMALL = "/root/testdata/sf0.001"


def test_bit_packing_round_trip():
    rng = np.random.default_rng(1)
    for width in range(1, bitpack.WIDEST + 1):
        for n in (0, 1, 7, 8, 9, 1001):
            values = rng.integers(0, 1 << width, n, dtype=np.uint64)
            data = bitpack.pack(values, width)
            assert len(data) == bitpack.n_bytes(n, width) == (n * width + 7) // 8
            assert (bitpack.unpack(data, n, width) == values).all()


def test_bits_of_a_vocabulary():
    assert [bitpack.bits_for(n) for n in (0, 1, 2, 255, 256, 49407)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        bitpack.pack(np.array([8], np.uint64), 3)


@pytest.mark.parametrize("bits", [3, 16, 17])
def test_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    texts = [rng.integers(0, 1 << bits, n) for n in (0, 5, 1, 200, 0, 33, 64, 3)]
    writer = token_files.Writer(str(tmp_path), "x.bin", bits, 16)
    for k, ids in enumerate(texts):
        writer.add(None if k == 4 else k, ids.astype(np.uint32))
    assert writer.close() == ("x.bin", 8, sum(map(len, texts)))
    whole = np.concatenate(texts)
    with token_files.TokenFile(f"{tmp_path}/x.bin") as file:
        for a in range(0, len(whole), 7):
            for b in (a, a + 1, a + 16, a + 90, len(whole) + 5):
                assert (file.ids(a, b) == whole[a:b]).all()
        for at_once in (1, 40, 1000):
            found = list(file.documents(at_once))
            assert [i for i, _, _ in found] == [0, 1, 2, 3, None, 5, 6, 7]
            assert all((ids == t).all() for (_, _, ids), t in zip(found, texts))
        assert (file.document(3) == texts[3]).all()


def test_damage_is_noticed(tmp_path):
    writer = token_files.Writer(str(tmp_path), "x.bin", 9, 16)
    writer.add(1, np.arange(100, dtype=np.uint32))
    writer.close()
    path = tmp_path / "x.bin"
    data = bytearray(path.read_bytes())
    data[20] ^= 1
    path.write_bytes(bytes(data))
    with token_files.TokenFile(str(path)) as file, pytest.raises(ValueError):
        file.ids(0, 5)
    path.write_bytes(bytes(data[:-1]))
    with pytest.raises(ValueError):
        token_files.TokenFile(str(path))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def test_ids_are_the_librarys(library, monkeypatch):
    alphabet = "aA eé'sRE lĺ̸ΣςİŞ<|endoftext|>\t \x1c\x85 3٣日本🎉.,!?\n  "
    latin = 4 * "'" + "abSsTtRrEeVvLlMmDd  0123456789.,;:!?-_<|>" + "".join(map(chr, range(0x7F, 0x100)))
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(some), rng.integers(0, 60))) for some in (alphabet, latin) for _ in range(3000)]
    texts += ["<|endoftext|> it's <|startoftext|>x", "x" * 20000 + " y", "́ a", " ", "", "I'LL'S''s Don'T"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    coding = token_files.Coder(vocabulary_path("word_bpe_49k.json"))
    assert [coding.encode(t) for t in texts] == want
    monkeypatch.setattr(token_files, "CACHED", 50)
    monkeypatch.setattr(token_files, "PART", 7)
    again = token_files.Coder(vocabulary_path("word_bpe_49k.json"))
    assert [again.encode(t) for t in texts[::7]] == want[::7]


def test_every_narrow_character(library):
    coding = token_files.Coder(vocabulary_path("word_bpe_49k.json"))
    for c in map(chr, range(0x100)):
        for text in (c, f"a{c}b", f"1{c}1", f"x {c}{c} y", f"é{c}"):
            assert np.frombuffer(coding.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file_ids", [1 << 25, 3000])
def test_files_of_documents(spark, library, monkeypatch, file_ids):
    monkeypatch.setattr(token_files, "BLOCK", 500)
    monkeypatch.setattr(token_files, "FILE_IDS", file_ids)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id - 50 AS doc_id", "text")
    odd = rows(spark, [(i + 10**6 if i else i, t) for i, t in odd_documents()])
    docs = docs.unionByName(odd.select("doc_id", "text")).repartition(5).withColumn("part", docs["doc_id"] * 0)
    files = token_files.write(docs, scratch_path(spark, "files"), vocabulary_path("word_bpe_49k.json"), 2)
    got = sorted(map(tuple, token_files.digests(files).collect()), key=lambda r: r[1])
    texts = {}
    for i, t in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        texts.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    order = [i for i, *_ in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    at = 0
    for i, start, n, crc in got:
        assert start == at
        texts[i].remove((n, crc))
        at += n
    assert not any(texts.values())
    back = {r["start"]: r["ids"] for r in token_files.documents(files).collect()}
    assert {s: zlib.crc32(np.array(x, "<u4").tobytes()) for s, x in back.items()} == {s: c for _, s, _, c in got}


def test_no_documents(spark, nothing):
    files = token_files.write(nothing, scratch_path(spark, "files"), vocabulary_path("word_bpe_49k.json"), 2)
    assert token_files.digests(files).collect() == [] == files.collect()
