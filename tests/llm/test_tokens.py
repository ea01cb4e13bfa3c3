import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from logloom.llm import tokens  # noqa: E402


def test_words_are_looked_up_once(monkeypatch):
    class Memo(dict):
        asked = 0

        def __contains__(self, word):
            self.asked += 1
            return super().__contains__(word)

    memo = Memo()
    monkeypatch.setattr(tokens, "worker_memo", lambda owner: memo)
    own = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True, plain=False)
    texts = ["one two two three", "", "three four one\nfive"]
    assert own.encode(texts) == [own._whole(t) for t in texts]
    assert not memo.asked
