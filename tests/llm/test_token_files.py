import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import token_files
from cohortlens.llm.token_files import FileReader, FileWriter, encoder, ids_of, planes_of, read_digests, read_ids, write_ids
from cohortlens.session import scratch_path

TEXTS = ["The Quick  brown\tfox's 123 jumps.\n", "<|startoftext|>x <|endoftext|>", "é é 日本語😀", "a b c\x1fd", "word " * 5000, "I'M they'Re", "<|STARTOFTEXT|> A<|endoftext|>B", "ΣΑΣ Σ İstanbul A\u0301 e\u0301\u00a0x\u2003y", "\u0301 \u0301a \u200b", "\x01 a\x01b \x01\x01 c"]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_are_a_transposition(bits):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, np.uint64).astype("<u4")
        planes = planes_of(ids, bits)
        assert len(planes) == (32 if bits else 4)
        assert ids_of(planes, n).tolist() == ids.tolist()
    assert planes_of(np.array([0x04030201], "<u4"), False) == [b"\x01", b"\x02", b"\x03", b"\x04"]


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(bits):
    rng = random.Random(2)
    docs = [(i if i else None, np.array([rng.randrange(50_000) for _ in range(rng.choice([0, 1, 5, 300]))], "<u4")) for i in range(60)]
    out, records = FileWriter(bits, block=64), []
    for i in range(0, len(docs), 7):
        part = docs[i : i + 7]
        records += out.add([d for d, _ in part], [x.tobytes() for _, x in part])
    records += out.close()
    reader = FileReader(b"".join(r + b"\n" for r in records))
    assert set(reader.blocks[:-1, 1].tolist()) == {64}
    assert [(d, x.tolist()) for d, x in reader.documents()] == [(d, x.tolist()) for d, x in docs]
    assert FileWriter().close() == []


def test_word_table_gives_the_ids_of_whole_texts(spark, files):
    path = files("word_bpe_49k.json")
    model, whole = encoder(path), Tokenizer.from_file(path)
    assert model.by_word and not encoder(files("byte_bpe_50k.json")).by_word
    texts = TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text, ids in zip(texts, model.encode([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_of_plain_letters_skip_nothing(files):
    """Words that go to the model at once have the ids of the whole course."""
    path = files("word_bpe_49k.json")
    model, whole = token_files.Encoder(path), Tokenizer.from_file(path)
    assert model.letters and token_files.Encoder(files("byte_bpe_50k.json")).letters is None
    rng = random.Random(8)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "aäöüßéèñçœøðþªºµŉǆǅ", "".join(map(chr, range(0xAA, 0x280))), "aAzZ09'", "e\u0301ïΣσς日"]
    words = ["".join(rng.choice(kinds[min(i % 7, 4)]) for _ in range(rng.randint(1, 14))) for i in range(4000)]
    words = [w for w in words if w.split() == [w]]
    for word, ids in zip(words, model._words(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(word, add_special_tokens=False).ids, word


def test_words_are_forgotten_by_generations(spark, files, monkeypatch):
    path = files("word_bpe_49k.json")
    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    model, whole = token_files.Encoder(path), Tokenizer.from_file(path)
    asked = []
    plain = model._words
    monkeypatch.setattr(model, "_words", lambda words: asked.extend(words) or plain(words))
    texts = [f"often seen words, and w{i} x{i}y. z{i}, \x01 q{i}\x01" for i in range(400)]
    for i in range(0, len(texts), 5):
        for text, ids in zip(texts[i : i + 5], model.encode([x.encode() for x in texts[i : i + 5]]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(model.known) < 100 and len(model.old) < 100
    assert asked.count("often") == 1 and asked.count("words") == 1


def test_ranges_follow_bytes(spark, make, files, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    to = scratch_path(spark, "ids")
    docs = [(i, "some words here " * 20) for i in range(100)]
    write_ids(make(docs), files("word_bpe_49k.json"), to)
    assert 10 <= read_ids(spark, to).select("file").distinct().count() <= 17
    assert [r["doc_id"] for r in read_digests(spark, to).orderBy("start").collect()] == list(range(100))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_written_and_read_back(spark, make, odd, files, name):
    path = files(name)
    whole = Tokenizer.from_file(path)
    docs = odd + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(-5, "negative id")]
    to = scratch_path(spark, "ids")
    write_ids(make(docs), path, to, block=256)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    want, start = [], 0
    for doc, text in order:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in read_digests(spark, to).orderBy("start").collect()]
    assert got == want
    assert sorted(len(r["ids"]) for r in read_ids(spark, to).collect()) == sorted(w[2] for w in want)


def test_empty_table(spark, make, files):
    to = scratch_path(spark, "ids")
    write_ids(make([]), files("word_bpe_49k.json"), to)
    assert read_digests(spark, to).count() == 0
