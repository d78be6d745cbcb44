import public_tokenizers
from tokenizers import Tokenizer

from attesta.llm.token_counts import count_tokens, safe_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", "Hello  world\n\n x", "it's we'll 'S", "<|endoftext|> and a <|endoftext|>b", " nbsp 　 wide", "x" * 40_000,
         "word " * 20_000, "tab\tand \t spaces   " * 3000, "日本語 テキスト" * 4000, " lead", "trail ", "a \u0085b  c 1 2 33"]


def test_equals_whole_text_encoding(docs):
    rows = list(enumerate(TEXTS))
    tok = Tokenizer.from_file(PATH)
    want = {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    for most_chars in (16_384, 50):
        got = count_tokens(docs(rows), PATH, most_chars=most_chars, most_bytes=3000).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_pieces_join_to_the_text():
    for t in TEXTS:
        if t:
            assert "".join(safe_pieces(t, 50)) == t


def test_null_ids_and_empty_table(docs):
    got = count_tokens(docs([(None, "a b"), (1, "a"), (1, "a")]), PATH).collect()
    assert len(got) == 3 and count_tokens(docs([]), PATH).count() == 0
