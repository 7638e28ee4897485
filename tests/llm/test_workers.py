"""What a worker keeps between tasks, and gives back."""

from reelmill.llm import common, tokens
from reelmill.llm.queries import WORD_TOKENIZER


def test_caches_are_given_back():
    first = tokens.encoder(WORD_TOKENIZER, "word")
    ids = first(["one two three", None, ""])
    assert len(first.known) and tokens.encoder.cache_info().currsize
    common.give_back()
    assert tokens.encoder.cache_info().currsize == 0
    again = tokens.encoder(WORD_TOKENIZER, "word")
    assert again is not first
    assert [x.tolist() for x in again(["one two three", None, ""])] == [x.tolist() for x in ids]


def test_a_small_cache_bounds_memory_not_results():
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} again and 12 more {i}" for i in range(300)]
    wide, narrow = tokens.Encoder(WORD_TOKENIZER, "word"), tokens.Encoder(WORD_TOKENIZER, "word", 20)
    assert [x.tolist() for x in narrow(texts)] == [x.tolist() for x in wide(texts)]
    assert len(wide.known) > 300 and len(narrow.known) + len(narrow.known.old) < 80


def test_the_pipeline_packs_with_a_small_cache(monkeypatch):
    import corpus_pipeline

    told = {}
    monkeypatch.setattr(corpus_pipeline.packing, "pieces", lambda *args, **options: told.update(options))
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda parts: parts)
    corpus_pipeline.packed(None, None, "")
    assert told["cache"] < tokens.CACHE
