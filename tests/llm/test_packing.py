"""Packing: every id in exactly one piece, limits kept, ids as the tokenizer gives them."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import orc_tokens, packing
from factloom.llm.encoding import TextEncoder

TEXTS = [None, "", " ", "one", "a b\n c  d", "x " * 3000, "word. " * 500 + "<|endoftext|> tail", "ß İ Σ é é 漢字", *["doc number %d, with some words." % i * (i % 40) for i in range(300)]]


def reference(name, texts):
    t = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(monkeypatch, name, spaced):
    import random

    monkeypatch.setattr(TextEncoder, "BATCH", 2_000)
    rnd = random.Random(3)
    alphabet = [" ", " ", "a", "b", "'s", "é", "́", "\n", "\t", "\x1c", "\x85", "　", "1", "!", "İ", "Σ", "<|endoftext|>", "漢", "​", "\xa0", "\r\n", "😀", ",", "."]
    texts = TEXTS + [" ".join("".join(rnd.choices(alphabet, k=rnd.randint(0, 5))) for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    encoder = TextEncoder(str(public_tokenizers.path(name)), 1, spaced)
    assert [x.tolist() for x in encoder.encode(texts)] == reference(name, texts)
    assert [x.tolist() for x in encoder.encode(texts[::-1])] == reference(name, texts[::-1])


@pytest.mark.parametrize(("tokens", "segments", "loss"), [(2048, 256, None), (64, 3, 40)])
def test_pack(spark, tokens, segments, loss):
    docs = spark.createDataFrame([(i if i != 5 else None, t, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, start long").repartition(3)
    rows = packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), tokens=tokens, segments=segments, loss=loss, prompt="start").collect()
    ids = reference("byte_bpe_50k.json", TEXTS)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, want in enumerate(ids):
        pieces = sorted(by_doc[i if i != 5 else None], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(bytes(p["ids"]), "<u4") for p in pieces]).tolist() == want
        assert [p["start"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist()
        assert {p["doc_tokens"] for p in pieces} == {len(want)}
        assert sum(p["loss"] for p in pieces) == max(0, len(want) - 2)
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        size = sum(p["length"] for p in pieces)
        assert [p["offset"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist()
        assert size <= tokens and len(pieces) <= segments and sum(p["loss"] for p in pieces) <= (loss or tokens)
        padding += 0 if size & (size - 1) == 0 else tokens - size
        total += size
    assert padding == 0 and total == sum(map(len, ids))
    assert packing.pack(docs.limit(0), str(public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_orc_round_trip(spark, tmp_path, monkeypatch):
    import zlib

    monkeypatch.setattr(orc_tokens, "TEXT_BYTES_PER_FILE", 4000)
    name = "word_bpe_49k.json"
    keys = [None if i == 3 else i * 7 % 301 - 20 for i in range(len(TEXTS))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in zip(keys, TEXTS, strict=True)] + [(5, "same", 1), (5, "same", 1)], "doc_id long, text string, range long").repartition(3)
    orc_tokens.write(docs, f"{tmp_path}/t", str(public_tokenizers.path(name)))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in orc_tokens.layout(spark, f"{tmp_path}/t").collect())
    assert [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    order = [g[1] for g in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    want = reference(name, TEXTS + ["same", "same"])
    crc = sorted((-999 if k is None else k, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for k, w in zip([*keys, 5, 5], want, strict=True))
    assert sorted((-999 if g[1] is None else g[1], *g[2:]) for g in got) == crc
    assert len(list(tmp_path.joinpath("t").glob("*.orc"))) > 1
    orc_tokens.write(docs.limit(0), f"{tmp_path}/e", str(public_tokenizers.path(name)))
    assert orc_tokens.layout(spark, f"{tmp_path}/e").count() == 0
