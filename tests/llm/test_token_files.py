"""Counts of every shipped vocabulary against its library, on texts with odd white space."""

import base64
import random

import pytest

from codeloom.llm import token_counts

ODD = ["a", "B", "é", "e\u0301", "\u0301", "Σ", "İ", "'s", "9", ".", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "<|endoftext|>", "<|startoftext|>", "中", "😀", "word", " the"]


def library(path):
    import public_tokenizers

    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda x: len(t.encode(x, add_special_tokens=False).ids)
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda x: len(sp.encode(x))
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda x: len(e.encode_ordinary(x))


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "drops"), ("byte_bpe_50k.json", "keeps"), ("byte_bpe_50k.tiktoken", "keeps"), ("byte_bpe_multi_50k.tiktoken", "keeps"), ("piece_bpe_32k.model", "unknown")])
def test_counts_equal_the_library(name, kind):
    import public_tokenizers

    path = public_tokenizers.path(name)
    r = random.Random(7)
    texts = ["hello  world\n\nthe quick brown fox", "", " ", "\n\n"] + ["".join(r.choices(ODD, k=r.randint(1, 30))) for _ in range(3000)]
    counter, want = token_counts.Counter(path), library(path)
    assert counter.kind == kind
    assert counter.count([t.encode() for t in texts]) == [want(t) for t in texts]


def test_other_tokenizers_are_not_split():
    split = {"type": "Split", "pattern": {"Regex": r"\\s"}, "behavior": "Removed", "invert": False}
    assert token_counts.treatment({"pre_tokenizer": split}) == "unknown"
    assert token_counts.treatment({"pre_tokenizer": {**split, "pattern": {"Regex": r"[a-z ]+"}, "invert": True}}) == "unknown"
    assert token_counts.treatment({"pre_tokenizer": None, "normalizer": {"type": "Prepend", "prepend": "_"}}) == "unknown"


def test_the_cache_is_bounded_in_bytes(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "CACHE_BYTES", 5000)
    c = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(50):
        assert c.count([b"x%d" % i * 300]) == [c.lengths(["x%d" % i * 300])[0]]
        assert sum(map(len, c.known)) <= 5000
