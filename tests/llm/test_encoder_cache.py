"""Which parts an encoder keeps: frequent ones stay, and a long one does not keep the others out."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm.encoding import TextEncoder

NAMES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def counting(name, spaced):
    """An encoder, and the list of the numbers of parts that it encodes."""
    encoder, encoded = TextEncoder(str(public_tokenizers.path(name)), 1, spaced), []
    inner = encoder._encode_parts
    encoder._encode_parts = lambda parts: (encoded.append(len(parts)), inner(parts))[1]
    return encoder, encoded


@pytest.mark.parametrize(("name", "spaced"), NAMES)
def test_a_long_part_keeps_no_other_out(name, spaced):
    encoder, encoded = counting(name, spaced)
    text = "head " + " ".join(f"{a}{b}" for a in "abcdefgh" for b in "mnopqrst") + " " + "z" * 100 + " end"
    first = encoder.encode([text])[0].tolist()
    assert encoder.encode([text])[0].tolist() == first
    assert encoded[0] >= 64 and encoded[1] == 1


@pytest.mark.parametrize(("name", "spaced"), NAMES)
def test_frequent_parts_outlast_rare_ones(monkeypatch, name, spaced):
    monkeypatch.setattr(TextEncoder, "MOST_PARTS", 100)
    encoder, encoded = counting(name, spaced)
    rnd = random.Random(5)
    letters = lambda n: "".join(rnd.choices("abcdefghij", k=n))
    frequent = [letters(4) for _ in range(40)]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(name)))
    for _ in range(30):
        text = "head " + " ".join(frequent + [letters(9) for _ in range(20)])
        assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert len(encoder.places) == len(encoder.kept_begins) == len(encoder.kept_ends) <= 100
        assert list(encoder.places.values()) == list(range(len(encoder.places)))
    assert max(encoded[1:]) <= 21


@pytest.mark.parametrize(("name", "spaced"), NAMES)
@pytest.mark.parametrize("most", [0, 1, 7, 150])
def test_ids_do_not_depend_on_what_is_kept(monkeypatch, name, spaced, most):
    monkeypatch.setattr(TextEncoder, "MOST_PARTS", most)
    monkeypatch.setattr(TextEncoder, "BATCH", 300)
    rnd = random.Random(most)
    pick = ["a", "b", "é", ".", ",", "\n", " ", "ß", "12", "İ", "word"]
    texts = [" ".join("".join(rnd.choices(pick, k=rnd.choice([1, 2, 3, 4, 80]))) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    encoder = TextEncoder(str(public_tokenizers.path(name)), 1, spaced)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(name)))
    want = [e.ids + [1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in encoder.encode(texts[::-1])] == want[::-1]
    assert len(encoder.places) <= most
