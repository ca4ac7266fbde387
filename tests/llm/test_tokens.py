import public_tokenizers
import sentencepiece
from headway.llm import tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_lengths_equal_whole_text_encoding(spark, make_docs):
    texts = [None, "", " ", "a", "  two  blanks ", "<s> x </s>", "línea\nñ\t　 x", "word " * 30_000, "x" * 50_000, "é  è " * 9_000, "a▁ b " * 8000]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "again"), (None, "no id")]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(make_docs(rows), MODEL, split_chars=1000, batch_bytes=5000).collect()}
    want = {(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in rows}
    assert got == want


def test_other_library(spark, make_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(1, "Hello  world <|endoftext|> ñ"), (2, None), (3, "a b " * 5000)]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(make_docs(rows), path).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in rows}


def test_empty_table_and_extra_columns(spark, make_docs):
    df = make_docs([(1, "a")]).selectExpr("*", "1 as n_tokens", "2 as n_bytes")
    assert tokens.count_tokens(df, MODEL).count() == 1
    assert tokens.count_tokens(df.filter("false"), MODEL).count() == 0


def test_split_is_lossless():
    text = "ab cd  ef\ngh " * 500
    assert " ".join(tokens.split_text(text, 50)) == text
