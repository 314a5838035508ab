"""The corpus pipeline against brute force on a small fixture, stage by stage."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from factloom.llm import queries, simhash, suffix_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    syllables = ["tha", "ing", "re", "on", "ble", "ti", "st", "nd", "ea", "our"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(90)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 5 == 0
        text = prose(rnd.randint(30, 120)) + (" grobian" if toxic else "")
        rows.append((i, text, "en", rnd.choice(["a", "b", None]), len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i * 7 + 1][1], "en", "c", 1) for i in range(10)]  # exact copies
    rows += [(1100 + i, rows[i * 7 + 2][1] + " tha", "en", "c", 1) for i in range(10)]  # near copies
    rows += [(1200 + i, prose(60) + " " + passage + " " + prose(60), "en", "a", 1) for i in range(6)]
    rows += [(1300, None, "en", "a", None), (1301, "", None, None, 0), (None, prose(40), "en", "b", 3)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def similar_groups(texts):
    """A number for each text, equal for those that links of similarity 0.8 or more join."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return group


def without_repeats(words, length):
    """Words of each text without those in windows of so many words that occur elsewhere too."""
    seen = Counter(tuple(w[k : k + length]) for w in words.values() for k in range(len(w) - length + 1))
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - length + 1) if seen[tuple(w[k : k + length])] > 1 for j in range(k, k + length)}
        out[i] = [x for j, x in enumerate(w) if j not in gone]
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.shared.staged(stage(spark, docs, folder), f"test-{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        kept.append(out)
        docs = out
    clean, single, cut, mixed, packed = kept
    source = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert sorted((r["text"] or "") for r in clean.collect()) == sorted((r["text"] or "") for r in source if "grobian" not in (r["text"] or ""))
    rows = clean.collect()
    best = {}
    for r, g in zip(rows, similar_groups([r["text"] for r in rows]), strict=True):
        best[g] = min(best.get(g, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    assert sorted(best.values()) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in single.collect())
    assert not {1000, 1009, 1100, 1109} & {r["doc_id"] for r in single.collect()}
    before = {r["doc_id"]: (r["text"] or "").split() for r in single.collect()}
    after = {r["doc_id"]: (r["text"] or "").split() for r in cut.collect()}
    assert after == without_repeats(before, corpus_pipeline.PASSAGE_WORDS)
    assert sum(before[i] != after[i] for i in before) >= 6
    texts = {r["doc_id"]: r["text"].split() for r in cut.collect() if r["text"]}
    for r in mixed.collect():
        assert texts[r["doc_id"]][: len(r["text"].split())] == r["text"].split()
    words = sum(len(t) for t in texts.values())
    assert abs(sum(len(r["text"].split()) for r in mixed.collect()) - 1.5 * words) < 10
    pieces = packed.collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mixed.collect()}


def test_odd_tables(spark, tmp_path):
    """No rows, one very long text, repeated rows, and extra columns with the stages' own names."""
    names = f"{COLUMNS}, row string, _row long, t1 long, name string, ids string, size long, key long, fp long"
    extra = ("r", 1, 2, "n", "i", 3, 4, 5)
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(60_000))
    rows = [(1, long, "en", "a", 5, *extra), (2, "one two three", "en", "a", 13, *extra), (2, "one two three", "en", "a", 13, *extra), (None, None, None, None, None, *([None] * 8))]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for i, some in enumerate((rows, [])):
        folder = f"{tmp_path}/{i}"
        spark.createDataFrame(some, names).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            docs = corpus_pipeline.shared.staged(stage(spark, docs, folder), f"odd-{i}-{k}")
            assert docs.columns == [x.split()[0] for x in names.split(", ")]
        assert {r["doc_id"] for r in docs.collect()} == ({1, 2} if some else set())
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == ({1, 2} if some else set())


def test_registered():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert sorted(queries.queries()) == sorted(["op1_top_k", "op2_mix", "op3_nearest", "op4_suffix_dedup", "op5_url_filter", "op6_toxicity", "op7_warc", "op8_pack", "op9_simhash", "op10_orc_tokens", "op11_hilbert_shards", "op12_prefix_trie", "op13_fill_middle", "instruction_packing"])
    assert simhash and suffix_dedup
