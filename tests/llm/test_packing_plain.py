"""New words of Latin letters are encoded many at a time, with the tokenizer's own ids."""

from __future__ import annotations

import public_tokenizers

from tokenlm.llm import packing

WORDS = ["Straße", "über", "zuver", "a", "é", "ß", "ÿ", "µ", "ª", "don't", "x1", "日本", "été", "ǅ", "İs", "K", "naïve,", "zz--", "</w>", "<|endoftext|>", "w" * 70, "ÀÉ", "thhe", "ingning", "ſ"]


def test_plain_words_have_the_tokenizers_ids(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    e, own = packing.Encoder(path), Tokenizer.from_file(path)
    own.encode_special_tokens = True
    seen: list[str] = []
    plain = e.plain
    monkeypatch.setattr(e, "plain", lambda words: seen.extend(words) or plain(words))
    texts = [*WORDS, " ".join(WORDS), " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(224 + i // 676 % 20)}" for i in range(9000))]
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [[*own.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert {"straße", "über", "thhe", "é"} <= set(seen) and not {"x1", "日本", "don't"} & set(seen)
    assert len(seen) == len(set(seen))
