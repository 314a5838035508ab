import random
from itertools import combinations

import corpus_pipeline
from factloom.llm import near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_similarity(a, b):
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def prose(rnd, n):
    return ["".join(rnd.choices(["tha", "ing", "re", "on", "ble", "ti"], k=rnd.randint(2, 5))) for _ in range(n)]


def test_stage_links_all_near_copies_and_only_those(spark):
    rnd = random.Random(3)
    rows, originals = [], []
    for i in range(60):
        words = prose(rnd, rnd.randint(60, 300))
        originals.append(words)
        rows.append((i, " ".join(words)))
    for i in range(60):  # edits of 1 to 9 words: similarities on both sides of 0.8
        words = list(originals[i])
        for at in rnd.sample(range(len(words)), 1 + i % 9):
            words[at] = prose(rnd, 1)[0] + "x"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " "), (203, "tha ing"), (204, "THA  ing"), (None, "re on ble")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], COLUMNS).repartition(3)
    root = {i: i for i, _ in rows[:120]}
    find = lambda i: i if root[i] == i else find(root[i])
    near = 0
    for (i, a), (j, b) in combinations(rows[:120], 2):
        if brute_similarity(a, b) >= 0.8:
            near += 1
            low, high = sorted((find(i), find(j)))
            root[high] = low
    assert 20 <= near < 60
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=lambda i: (i is None, i)) == [*sorted({find(i) for i in root}), 200, 203, None]


def test_chains_of_near_copies(spark):
    """Copies of copies, of which the first and the last are unlike, and a large group with some that hang on by one link."""
    rnd = random.Random(4)
    words = prose(rnd, 300)
    chain = [list(words)]
    for i in range(12):
        step = list(chain[-1])
        for k in range(7):
            step[(i * 23 + k * 3) % 300] = prose(rnd, 1)[0] + "y"
        chain.append(step)
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)]
    rows += [(100 + i, " ".join([*words, *prose(rnd, 5)])) for i in range(40)] + [(500, " ".join(prose(rnd, 90)))]
    assert brute_similarity(rows[0][1], rows[12][1]) < 0.8 <= min(brute_similarity(rows[i][1], rows[i + 1][1]) for i in range(12))
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], COLUMNS).repartition(3), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 500]


def test_tiles_find_all_links_of_a_group(spark, monkeypatch):
    """A group whose texts share a base but are mostly unlike each other, compared in one tile and in many."""
    rnd = random.Random(6)
    base = prose(rnd, 150)
    rows = []
    for i in range(120):
        words = list(base)
        for at in rnd.sample(range(150), rnd.choice([1, 2, 5, 7, 9])):
            words[at] = prose(rnd, 1)[0] + str(i % 90)
        rows.append((i, " ".join(words)))
    root = {i: i for i, _ in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    for (i, a), (j, b) in combinations(rows, 2):
        if brute_similarity(a, b) >= 0.8:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    wanted = sorted({find(i) for i in root})
    assert 10 < len(wanted) < 100
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], COLUMNS).repartition(3)
    for size in (1 << 20, 1 << 14):
        monkeypatch.setattr(near_copies, "TILE_BYTES", size)
        assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == wanted
