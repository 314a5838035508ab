"""Mixing, packing and the string kernel against plain simulations, and very long texts."""

import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import mixing, orc_tokens, packing, queries, simhash, toxicity, url_templates

COLUMNS = "doc_id long, text string, source string"


def filled(sizes, weights, budget, repeats=2):
    """Targets by resharing, source after source."""
    target, open_, left = {}, set(sizes), Fraction(budget)
    while open_:
        total = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / total > repeats * sizes[s]]
        if not full:
            return target | {s: left * weights[s] / total for s in open_}
        for s in full:
            target[s] = Fraction(repeats * sizes[s])
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    return target


def test_fair_queue_word_by_word(spark):
    """All sources are served at once, each at the rate of its target, until the budget is spent; words are counted one by one."""
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 9, 60])), rnd.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(250)] + [(900, None, "empty"), (901, "w w", "tiny"), (901, "w w", "tiny")]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    served = mixing.schedule(docs).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = filled(sizes, weights, Fraction(3 * sum(sizes.values()), 2))
    assert {r["source"]: round(r["target"], 6) for r in served} == {s: round(float(want[s]), 6) for s in sizes}
    for s in sizes:
        queue = sorted((r for r in served if r["source"] == s and r["size"]), key=lambda r: (r["round"], r["virtual_finish"]))
        done, words = 0, 0
        for r in queue:
            for _ in range(r["size"]):
                done += 1
                words += done <= want[s]
            assert abs(r["virtual_finish"] - done / float(want[s])) < 1e-9
            assert r["served"] == min(r["size"], max(0, math.floor(want[s]) - done + r["size"]))
        assert words == math.floor(want[s]) or words == 2 * sizes[s]


def plain_pack(documents, limits, first):
    """Items of (doc, start, ids, prompt left); every sequence takes the largest dot product among what fits, else cuts the largest."""
    capacity = np.array(limits, dtype=float)
    items, out, number = [], [], first

    def close(chosen):
        nonlocal number
        flat = [(d, start + i, t) for d, start, ids, _ in chosen for i, t in enumerate(ids)]
        while flat:
            size = len(flat) if len(flat) == limits[0] else 2 ** int(math.log2(len(flat)))
            out.extend((number, at, d, place) for at, (d, place, _) in enumerate(flat[:size]))
            flat, number = flat[size:], number + 1

    for d, (ids, prompt) in enumerate(documents):
        step = min(limits[0], limits[2])
        for start in range(0, len(ids), step):
            piece = ids[start : start + step]
            item = (d, start, piece, max(0, min(len(piece), prompt - start)))
            if len(piece) == limits[0]:
                close([item])
            else:
                items.append(item)
    while items:
        left, chosen = capacity.copy(), []
        while left[0] > 0 and left[1] > 0 and items:
            demands = [np.array([len(x[2]), 1, len(x[2]) - x[3]], dtype=float) for x in items]
            worth = [float((d / capacity) @ (left / capacity)) for d in demands]
            fitting = [i for i, d in enumerate(demands) if (d <= left).all()]
            if fitting:
                i = max(fitting, key=lambda i: (worth[i], -i))
                chosen.append(items.pop(i))
                left -= demands[i]
                continue
            i = max(range(len(items)), key=lambda i: (worth[i], -i))
            d, start, ids, quiet = items[i]
            take = int(min(left[0], len(ids) - 1, quiet + left[2]))
            if take > 0:
                chosen.append((d, start, ids[:take], min(quiet, take)))
                items[i] = (d, start + take, ids[take:], max(0, quiet - take))
            break
        close(chosen)
    return out


def test_packing_against_a_plain_packer(spark):
    rnd = random.Random(6)
    texts = ["some words " * rnd.randint(1, 30) + str(i) for i in range(120)]
    name = str(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [e.ids + [1] for e in Tokenizer.from_file(name).encode_batch(texts, add_special_tokens=False)]
    prompts = [rnd.randint(0, 20) for _ in texts]
    docs = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(texts, prompts, strict=True))], "doc_id long, text string, quiet long").coalesce(1)
    for limits in ((64, 3, 40), (128, 16, 128)):
        rows = packing.pack(docs, name, tokens=limits[0], segments=limits[1], loss=limits[2], prompt="quiet").collect()
        got = sorted((r["sequence_id"], r["offset"] + k, r["doc_id"], r["start"] + k) for r in rows for k in range(r["length"]))
        assert got == sorted(plain_pack(list(zip(ids, prompts, strict=True)), limits, 0))


def test_instruction_packing_keeps_its_limits(spark):
    rows = queries.instruction_packing(spark, "/root/testdata/sf0.001").collect()
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        assert sum(p["length"] for p in pieces) <= 2048 and len(pieces) <= 16 and sum(p["loss"] for p in pieces) <= 1536
    talks = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
    assert {r["doc_id"] for r in rows if r["start"] == 0} == {r["doc_id"] for r in rows} and len({r["doc_id"] for r in rows}) == talks
    assert all(sum(p["length"] for p in rows if p["doc_id"] == r["doc_id"]) == r["doc_tokens"] for r in rows if r["start"] == 0)


def subsequences(word):
    """Weights of the gapped subsequences of three characters of a word between its ends, by enumeration."""
    letters, out = [0, *word, 0], {}
    for i, j, k in itertools.combinations(range(len(letters)), 3):
        gaps = k - i - 2
        if gaps <= toxicity.MOST_GAPS:
            key = (letters[i], letters[j], letters[k])
            out[key] = out.get(key, 0) + toxicity.DECAY**gaps
    return out


def test_kernel_by_enumeration():
    texts = [b"grobian", b"groobian", b"robin", b"on", b"a", b"knave"]
    words = [w for row in toxicity.words_of(texts) for w in row]
    assert len(words) == len(texts)
    features = toxicity.features(words).astype(float)
    for (a, x), (b, y) in itertools.combinations(zip(words, features, strict=True), 2):
        left, right = subsequences(a), subsequences(b)
        scale = math.sqrt(toxicity.self_kernel(np.array([len(a)]))[0] * toxicity.self_kernel(np.array([len(b)]))[0])
        assert abs(x @ y - sum(v * right.get(k, 0) for k, v in left.items()) / scale) < 1e-5
    assert features[0] @ features[1] > features[0] @ features[2] > features[0] @ features[5]


def test_svm_by_gradient_descent():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=200) > 0.2, 1.0, -1.0)
    weight = rng.uniform(0.5, 2, size=200)
    w = toxicity.svm(x, y, weight)
    full = np.hstack([x, np.ones((200, 1))])
    penalty = np.full(6, 1e-2 * weight.sum() / 100)
    penalty[-1] *= 1e-3
    loss = lambda v: (penalty * v * v).sum() + (weight * np.maximum(0, 1 - y * (full @ v)) ** 2).sum()
    plain = np.zeros(6)
    for _ in range(20_000):
        plain -= 5e-4 * (penalty * plain - full.T @ (weight * y * np.maximum(0, 1 - y * (full @ plain))))
    assert loss(w) <= loss(plain) + 1e-3


def test_very_long_texts(spark, tmp_path):
    """A text of two million characters and a url of four thousand segments."""
    long = " ".join(f"Word{i * 7919 % 100003}" for i in range(220_000))
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + " x"), (4, "")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {found[i]["component_id"] for i in (1, 2, 3)} == {1} and found[4]["component_id"] == 4
    name = str(public_tokenizers.path("word_bpe_49k.json"))
    orc_tokens.write(docs, f"{tmp_path}/t", name)
    want = Tokenizer.from_file(name).encode(long, add_special_tokens=False).ids + [1]
    rows = {r["doc_id"]: r for r in orc_tokens.layout(spark, f"{tmp_path}/t").collect()}
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == len(want) and rows[2]["start"] == len(want)
    assert rows[1]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    packed = packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "length", "doc_tokens").collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 1) == next(r["doc_tokens"] for r in packed if r["doc_id"] == 1)
    urls = spark.createDataFrame([(1, "http://a.x/" + "seg/" * 4_000), (2, "http://a.x/seg")], "page_id long, url string")
    assert {r["verdict"] for r in url_templates.filter_urls(urls, queries.RULES).collect()} == {"allow"}
