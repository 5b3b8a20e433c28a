import sentencepiece
from tokenizers import Tokenizer

from cohortlens.llm.token_counts import count_tokens, counter

LONG = "The quick  brown\tfox jumps.\n" * 400 + "x▁y " * 50 + "word " * 3000 + "😀" * 30


def test_sentencepiece_counts_equal_the_library(make, odd, files):
    path = files("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd + [(1, LONG), (2, "</s> <s> special"), (3, " lead"), (4, "a" * 5000), (5, LONG.replace(" ", "  "))]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(make(docs), path, most_bytes=500).collect())
    want = []
    for doc, text in docs:
        n = len(model.encode(text or ""))
        want.append((doc or -1, len((text or "").encode()), n, n > 4096))
    assert got == sorted(want)
    assert any(w[3] for w in want)


def test_long_texts_are_cut(files):
    model = counter(files("piece_bpe_32k.model"))
    assert model.cuts
    pieces = model.cut(LONG, 500)
    assert len(pieces) > 5 and " ".join(pieces) == LONG


def test_json_counts_equal_the_library(make, odd, files):
    path = files("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    docs = odd + [(1, LONG), (2, "<|endoftext|> inside")]
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in count_tokens(make(docs), path).collect())
    assert got == sorted((d or -1, len(model.encode(t or "", add_special_tokens=False).ids)) for d, t in docs)


def test_empty_table(make, files):
    assert count_tokens(make([]), files("piece_bpe_32k.model")).count() == 0
