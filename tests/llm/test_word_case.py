"""The encoder folds the case of words where the tokenizer does, and nowhere else."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import tokens


@pytest.mark.parametrize("name, folds", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_those_of_the_library(name, folds):
    path, rng = public_tokenizers.path(name), random.Random(1)
    encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    assert encoder.folds is folds
    if not folds:
        return  # word by word is for vocabularies that part at white space
    parts = ["A", "J", "j", "É", "é", "J̌", "K", "K", "İ", "ß", "'S", "'ll", " ", "  ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "9", "日", "!", "Σ", "\x1c", "　", "The"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    ids, sizes = encoder.texts(texts, 1)
    at = 0
    for found, n in zip(library.encode_batch(texts, add_special_tokens=False), sizes.tolist()):
        assert ids[at:at + n].tolist() == [*found.ids, 1]
        at += n


def test_parts_of_words_share_their_ids():
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    stems = ["the", "Stone", "weather", "caf\u00e9", "\u00c9l\u00e8ve", "stra\u00dfe"]
    texts = [" ".join(rng.choice(stems) + rng.choice([".", ",", "!?", ")", "'s", "-", ";\"", "", "7", "%%%"]) for _ in range(100)) for _ in range(20)]
    odd = ["a", "B", "\u00df", "\u00d7", "\u00f7", "\u00c3", "\u0130", "\u0131", "\u00aa", "'", "'s", "'LL", ",", "=", "=\u0338", "x\u0327", "5", "\u3042\u3099", "\u1100\u1161",
           " ", "\x1c", "\x00", "\x7f", "\u2003", "\u4f60", "<|endoftext|>", "<|", "|>"]
    for batch in (texts, [], ["", " "], ["x\xe9", ",y"], *[["".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(n)] for n in (1, 1, 50, 2000)]):
        ids, sizes = encoder.texts(batch, 1)
        want = [[*e.ids, 1] for e in library.encode_batch(batch, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        if batch is texts:
            assert len(encoder.place) <= 17  # six stems, two of them in another case too, and nine endings; 60 before


def test_letters_that_the_library_treats_otherwise():
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = ["stone", "caf\u00e9", "\u00c9", "weather"] * 60
    flat, sizes = encoder.encoded_letters(words)
    want, lengths = encoder.encoded(words)
    assert flat.tolist() == want.tolist() and sizes.tolist() == lengths.tolist()
    encoder.closes[:] = False  # no word is seen to end: the plain way
    flat, sizes = encoder.encoded_letters(words)
    assert flat.tolist() == want.tolist() and sizes.tolist() == lengths.tolist()


def test_plain_words_from_the_model():
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    words = [*"abcdefghijklmnopqrstuvwxyz", "the", "z" * 300, *["".join(rng.choice("etaoinshrdqxz") for _ in range(rng.randint(1, 14))) for _ in range(3000)]]
    flat, sizes = encoder.encoded_plain(words)
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert flat.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
