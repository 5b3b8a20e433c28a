import random
import zlib

import numpy as np
import sentencepiece
from hypothesis import given, settings, strategies as st

from cohortlens.llm.sentencepiece_codec import MARK, Codec, codec, decode_documents, encode_and_decode, encode_documents


def load(files):
    path = files("piece_bpe_32k.model")
    return codec(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_ids_equal_the_library_on_documents(spark, files):
    model, library = load(files)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert model.encode(text).tolist() == library.encode(text)
        assert model.decode(library.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abethrn  \n▁é日😀.,<>0x1AF", max_size=80))
def test_ids_equal_the_library_on_any_text(text):
    import public_tokenizers

    model, library = load(public_tokenizers.path)
    assert model.encode(text).tolist() == library.encode(text)


def test_very_long_stretches_are_streamed_in_a_window(files):
    model, library = load(files)
    rng = random.Random(3)
    text = "".join(rng.choice("etaoin") for _ in range(4000))
    assert model.encode(text).tolist() == library.encode(text)
    parts = list(model.stream(MARK + text))
    assert len(parts) > 100 and "".join(p for x in parts for p in x) == MARK + text


class Unigram(Codec):
    """A model with scores, made by hand."""

    def __init__(self, scores):
        self.merges, self.score, self.pairs = False, scores, {}
        self.ids = {p: i for i, p in enumerate(scores)}
        self.longest = max(map(len, scores))
        self.lowest = min(scores.values()) - 10
        self.tails = {p[i:] for p in scores for i in range(len(p))}


def test_unigram_paths_have_the_best_score():
    rng = random.Random(5)
    pieces = {"".join(rng.choice("abc") for _ in range(n)): -rng.random() * 10 for n in (1, 1, 1, 2, 2, 2, 3, 3, 4, 5) for _ in range(3)}
    model = Unigram(pieces)
    cost = lambda p: pieces.get(p, model.lowest)
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 60)))
        best = [0.0] + [None] * len(text)
        for j in range(1, len(text) + 1):
            best[j] = max(best[i] + cost(text[i:j]) for i in range(j) if text[i:j] in pieces or j - i == 1)
        path = [p for x in model.stream(text) for p in x]
        assert "".join(path) == text
        assert np.isclose(sum(map(cost, path)), best[-1])


def test_table_is_bounded(files, monkeypatch):
    model, library = load(files)
    monkeypatch.setattr(model, "remembered", 50)
    model.known.clear()
    for i in range(500):
        assert model.encode(f"word{i} other") is not None
        assert len(model.known) <= 50


def test_round_trip_of_a_table(make, odd, files):
    path = files("piece_bpe_32k.model")
    _, library = load(files)
    docs = odd + [(1, "Plain  text.\n"), (2, "with ▁ mark"), (3, "日本語 😀"), (4, "a b " * 2000)]
    rows = encode_and_decode(make(docs), path).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["decoded"] is not None
        assert zlib.crc32(np.array(r["ids"], "<i4").tobytes()) == r["ids_crc32"]
    same = {r["doc_id"]: r["same"] for r in rows}
    assert not same[2] and all(v for k, v in same.items() if k != 2)
    ids = encode_documents(make(docs), path)
    assert {(r["doc_id"], tuple(r["ids"])) for r in ids.collect()} == {(d, tuple(library.encode(t or ""))) for d, t in docs}
    back = {(r["doc_id"], r["text"]) for r in decode_documents(ids, path).collect()}
    assert back == {(d, (t or "").replace("▁", " ")) for d, t in docs}
    assert encode_and_decode(make([]), path).count() == 0


def test_unknown_ids_decode_to_nothing(spark, files):
    rows = spark.createDataFrame([(1, [999_999, -1, 0, 1]), (2, None)], "doc_id long, ids array<int>")
    assert {r["text"] for r in decode_documents(rows, files("piece_bpe_32k.model")).collect()} == {""}


def test_a_worker_keeps_one_operators_tables():
    from cohortlens.llm import common

    gone = []
    first, second = (lambda: gone.append(1)), (lambda: gone.append(2))
    common.hold(first)
    common.hold(first)
    assert gone == []
    common.hold(second)
    common.hold(None)
    common.hold(None)
    assert gone == [1, 2]
