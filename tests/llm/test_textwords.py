import numpy as np

from castplan.llm import textwords as tw


def test_span_hashes_don_t_depend_on_where_a_span_stands():
    """Also across the pieces in which a long text is summed up."""
    rng = np.random.default_rng(1)
    word = rng.integers(0, 256, 37).astype(np.uint8)
    for n in (100, tw._PIECE - 20, tw._PIECE, 3 * tw._PIECE + 5):
        data = rng.integers(0, 256, n + 100).astype(np.uint8)
        places = [0, 41, n // 2, n - 20, n + 40]
        for p in places:
            data[p:p + len(word)] = word
        places = [p for p in places if (data[p:p + len(word)] == word).all()]
        at = np.array(places)
        found = tw.span_hash(tw.prefix_hash(data), at, at + len(word))
        alone = tw.span_hash(tw.prefix_hash(word), np.array([0]), np.array([len(word)]))
        assert len(places) >= 3 and set(found.tolist()) == set(alone.tolist())


def test_words_of_a_long_text():
    text = (b"one two\tthree " * 60_000)[:800_001]
    data = np.frombuffer(text, np.uint8)
    hashes, starts, ends, first = tw.word_hashes(data, np.array([0, len(data)]), tw.SPACE_WORDS)
    words = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    assert words == text.split() and first.tolist() == [0, len(words)]
    assert len(set(hashes.tolist())) == len(set(words)) and len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words))
