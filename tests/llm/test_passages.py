import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_cuts_passages_of_51_words(spark):
    rnd = random.Random(8)
    prose = lambda n: ["".join(rnd.choices("abcdeñ", k=rnd.randint(1, 8))) + str(rnd.randrange(10**4)) for _ in range(n)]
    rows, expected, i = [], {}, 0
    for size in (40, 50, 51, 52, 55, 60, 63, 90):
        passage = prose(size)
        for gap in (" ", "\n"):
            before, after = prose(30), prose(30)
            rows.append((i, " ".join(before) + " " + gap.join(passage) + " " + " ".join(after), "en", "a", 7))
            expected[i] = before + (passage if size <= 50 else []) + after
            i += 1
    rows += [(900, None, "en", "a", None), (901, " ", "en", "a", 1)]
    out = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "").collect()}
    assert {k: out[k]["text"].split() for k in expected} == expected
    assert all(r["n_chars"] == (len(r["text"]) if r["doc_id"] >= 4 else 7) for r in out.values() if r["doc_id"] < 900)
    assert out[900]["text"] is None and out[901]["text"] == " " and len(out) == len(rows)


def test_digest_counts_repeated_words(spark):
    """n_words_removed against all pairs of word windows."""
    from factloom.llm import suffix_dedup

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abé", k=rnd.randint(1, 6))) + str(rnd.randrange(10**3))
    passages = [[word() for _ in range(n)] for n in (8, 9, 10, 11, 14, 30)]
    texts = [None, "", "a b c", "x " * 40]
    for i in range(60):
        words = [word() for _ in range(rnd.randint(0, 30))] + rnd.choice(passages)[rnd.randrange(3) :] + [word() for _ in range(rnd.randint(0, 30))]
        texts.append(rnd.choice([" ", "\n", "  "]).join(words))
    texts += texts[5:8]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 400, words=10).collect()}
    split = [(t or "").split() for t in texts]
    seen: dict = {}
    for w in split:
        for k in range(len(w) - 9):
            seen[tuple(w[k : k + 10])] = seen.get(tuple(w[k : k + 10]), 0) + 1
    for i, w in enumerate(split):
        gone = {j for k in range(len(w) - 9) if seen[tuple(w[k : k + 10])] > 1 for j in range(k, k + 10)}
        assert got[i]["n_words_removed"] == len(gone), i
        assert got[i]["n_bytes"] == len((texts[i] or "").encode())
