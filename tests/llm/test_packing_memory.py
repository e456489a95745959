"""What a worker holds while it packs."""

from orogen.llm import bpe, packing


def test_packing_holds_few_words(spark, monkeypatch):
    """Words are kept up to a bound that leaves room for what earlier stages hold; ids stay the same."""
    monkeypatch.setattr(bpe, "_encoders", {})
    path = packing.default_tokenizer()
    small, large = bpe.encoder(path, limit=50), bpe.WordEncoder(path)
    texts = [" ".join(f"w{i}x{k}" for i in range(40)) for k in range(9)]
    assert [a.tolist() for a in small.encode_many(texts, chars=100)] == [a.tolist() for a in large.encode_many(texts)]
    assert len(small.words) <= 50 < len(large.words) and bpe.encoder(path, limit=50) is small
