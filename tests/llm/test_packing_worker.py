import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from conegrid.llm import packing  # noqa: E402


def test_the_whole_tokenizer_is_loaded_only_for_texts_that_need_it(monkeypatch):
    """It holds 30 MB in each Python worker; texts with the special token's string still get its ids."""
    path, loads, plain = public_tokenizers.path("byte_bpe_50k.json"), [], tokenizers.Tokenizer

    class Watched:
        @staticmethod
        def from_file(file):
            loads.append(file)
            return plain.from_file(file)

    monkeypatch.setattr(packing, "_workers", {})
    monkeypatch.setattr(tokenizers, "Tokenizer", Watched)
    texts = ["two words", "", None, "Über  alles\nhier"]
    want = lambda t: [*plain.from_file(path).encode(t or "", add_special_tokens=False).ids, 0]
    assert [x.tolist() for x in packing.token_ids(texts, path)] == [want(t) for t in texts] and not loads
    special = ["a <|endoftext|> b", "<|endoftext|>"]
    assert [x.tolist() for x in packing.token_ids(special, path)] == [want(t) for t in special] and len(loads) == 1
