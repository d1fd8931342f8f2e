"""Fast encoders give exactly the library's ids."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from frames import LONG, ROWS

from keelson.llm import vocab

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("abcXYZ019 ") + ["  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "é", "é", "ß", "İ", "漢", "'s", "'LL", "!", "<|endoftext|>", "<|", "▁", "½", "ª", "\x00", "the", "ing", " of "]


def odd_texts(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 40))) for _ in range(n)] + [r[1] or "" for r in ROWS if r[1] is not LONG] + ["a" * 5000, LONG[:20_000]]


@pytest.fixture(scope="module")
def words():
    return vocab.WordVocab(WORDS)


@pytest.fixture(scope="module")
def pieces():
    return vocab.PieceVocab(PIECES)


def test_word_ids_equal_the_library(words):
    assert words.by_part
    for text in odd_texts():
        want = words.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text.encode()), words.dtype).tolist() == want, text[:60]


def test_piece_ids_equal_the_library(pieces):
    assert pieces.by_word
    for text in odd_texts():
        assert np.frombuffer(pieces.encode(text.encode()), "<u2").tolist() == pieces.library.encode(text), text[:60]


def test_whole_token_shortcut_is_proved(pieces):
    assert len(pieces.whole) > 10_000
    for word, coded in list(pieces.whole.items())[::37]:
        assert len(pieces.library.encode(word.decode())) == 1 == len(coded) // 2


def test_every_string_of_the_word_vocabulary_merges_to_itself(words):
    """Then merging by the joined string equals merging by the listed pairs.

    Each string is merged, alone, by the pairs listed before its own; what is left must be
    exactly the pair that makes it.
    """
    with open(WORDS, encoding="utf-8") as file:
        model = json.load(file)["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    assert [model["vocab"][a + b] for a, b in pairs] == list(range(512, 512 + len(pairs)))
    for k, (a, b) in enumerate(pairs):
        joined = a + b
        end = joined.endswith("</w>")
        parts = list(joined[:-4] if end else joined)
        if end:
            parts[-1] += "</w>"
        while len(parts) > 2:
            best = min(zip(parts, parts[1:]), key=lambda p: rank.get(p, len(pairs)))
            if rank.get(best, len(pairs)) >= k:
                break
            i = next(i for i in range(len(parts) - 1) if (parts[i], parts[i + 1]) == best)
            parts[i : i + 2] = [best[0] + best[1]]
        assert parts == [a, b], (k, a, b)


def test_table_stays_bounded(words, pieces, monkeypatch):
    monkeypatch.setattr(vocab, "CACHE_BYTES", 4 << 20)
    monkeypatch.setattr(vocab, "GROUP", 2_000)  # many groups, and long texts cut between words
    text = " ".join(f"w{i}x{i % 7}" for i in range(90_000)).encode()
    for fresh, known in ((vocab.WordVocab(WORDS), words), (vocab.PieceVocab(PIECES), pieces)):
        most = 0
        first = fresh.table.words
        for at in range(0, len(text), 40_000):
            part = text[at : at + 40_000].strip()
            assert fresh.encode(part) == known.encode(part)
            most = max(most, fresh.table.nbytes)
            assert fresh.table.words >= first
        assert most <= 2 * vocab.CACHE_BYTES


def test_texts_encoded_together_equal_single_ones(words, pieces):
    texts = [t.encode() for t in odd_texts(200)]
    for coder, plain in ((words, lambda t: words.library.encode(t, add_special_tokens=False).ids), (pieces, pieces.library.encode)):
        assert [c.tolist() for c in coder.encode_all(texts)] == [plain(t.decode()) for t in texts]


def test_one_vocabulary_at_a_time():
    first = vocab.word_vocab(WORDS)
    assert vocab.word_vocab(WORDS) is first
    vocab.piece_vocab(PIECES)
    assert list(vocab._kept) == [(vocab.PieceVocab, PIECES)]
    vocab.release()
    assert not vocab._kept


def test_words_of_signs_and_letters(words):
    rng = random.Random(8)
    signs = list("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'") + ["’", "é", "ß", "÷", "×", "A", "z", "9"]
    for _ in range(4000):
        word = "".join(rng.choice(["abc", "Xy", *signs]) for _ in range(rng.randrange(1, 6)))
        assert words._code(word.encode()) == words.library.encode(word, add_special_tokens=False).ids, word
