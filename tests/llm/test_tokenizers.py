"""The BPE and the token counts against the libraries, on whole texts and on odd ones."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from vigil.llm.bpe import WordBPE, digests  # noqa: E402
from vigil.llm.token_counts import PieceCounter, token_counts, vocabulary  # noqa: E402

ODD = [
    "", " ", "  \n ", "a", "Á é", "ΑΣ ΣΑΣ", "İstanbul ẞ", "it's don't WE'LL 'sabc !'s", "12 3a4 ½ ²", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|> <|endoftext|",
    "aaaa aaaaaaa aaa" * 30, "a\x1cb\x1fc\x85d\xa0e f　g", "▁x ▁ ▁▁y  z   w ", "a\n\n b\n c \n\n\n", "\n", "\n\nx", " x", "日本語 テキスト 🙂🙃", "\x00\x01", "x" * 5000, "tab\tsep\r\nnext", "<s> </s> <unk> <0x0A>",
    "%%%ñ### la&&& $$$", "é" * 300, "o" * 2999 + " " + "ab" * 700,
]


def texts():
    return ODD + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]


def test_bpe_is_the_librarys():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    own, library = WordBPE(path, entries=2000), Tokenizer.from_file(path)
    for start in range(0, len(texts()), 40):
        part = texts()[start : start + 40]
        for text, (ids, decoded) in zip(part, own.encode(part), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
            assert decoded == library.decode(want, skip_special_tokens=False), text[:80]
            assert own.decode(ids) == decoded


def test_bpe_reads_every_code_point_as_the_library():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    own, library = WordBPE(path), Tokenizer.from_file(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 1 << 14):
        part = [" ".join(f"a{chr(c)}B {chr(c)}1" for c in points[k : k + 64]) for k in range(start, min(start + (1 << 14), len(points)), 64)]
        want = library.encode_batch(part, add_special_tokens=False)
        for text, (ids, _), w in zip(part, own.encode(part), want, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == w.ids, [hex(ord(x)) for x in text]


def test_bpe_cuts_words_together():
    """Many new words need few calls of the library, with the pre-tokens that each has by itself."""
    from types import SimpleNamespace

    own, calls = WordBPE(str(public_tokenizers.path("word_bpe_49k.json"))), []
    words = list(dict.fromkeys([f"{a}{k}{b}" for k in range(400) for a in ("é", "Σ'S", "\u0308x", "日本", "İ", "\u200b") for b in ("", "'LL", "½", "!!", "\x1c")]))
    plain = list(dict.fromkeys(["'", "''s", "'s's", "don't", "WE'LL", "'rex", "a\x1cb", "\x00", "12a3", "%%'d'", *(f"A{k}'ve" for k in range(500))]))
    for cut, given in ((own._cut_other, words), (own._cut_ascii, plain)):
        (data, sizes, counts), (data_1, sizes_1, counts_1) = cut(given), own._cut_each(given)
        assert data == data_1 and sizes.tolist() == sizes_1.tolist() and counts.tolist() == counts_1.tolist()
    library = own.pre_tokenizer
    own.pre_tokenizer = SimpleNamespace(pre_tokenize_str=lambda text: calls.append(1) or library.pre_tokenize_str(text))
    whole = own.encode([" ".join(words + plain)])
    assert 0 < len(calls) < len(words) / 100
    apart = own.encode(words + plain)
    assert whole[0][0] == b"".join(a for a, _ in apart) and whole[0][1] == " ".join(b for _, b in apart if b)


@pytest.mark.parametrize("hot", [10**6, 50, 0])
def test_counts_are_the_librarys(spark, hot):
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate(texts()))
    found = token_counts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).repartition(5), path, hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == {i: (len(t.encode()), len(library.encode(t))) for i, t in rows} and len(found) == len(rows)
    words = {w for _, t in rows for w in PieceCounter.split(t)}
    assert vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), path).count() == len(words)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, "x"), (1, "one two", "x"), (None, "one two", None), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    empty = hashlib.sha256(b"").hexdigest()
    found = digests(docs, str(public_tokenizers.path("word_bpe_49k.json"))).collect()
    assert sorted(r.n_tokens for r in found) == [0, 0, 2, 2]
    assert {r.ids_sha256 for r in found if not r.n_tokens} == {empty}
    counted = token_counts(docs, str(public_tokenizers.path("piece_bpe_32k.model"))).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in counted) == [(0, 0), (0, 0), (7, 2), (7, 2)]
    assert token_counts(docs.limit(0), str(public_tokenizers.path("piece_bpe_32k.model"))).count() == 0
    assert digests(docs.limit(0), str(public_tokenizers.path("word_bpe_49k.json"))).count() == 0
