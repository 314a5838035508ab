import random

from factloom.llm import mixing, queries

COLUMNS = "doc_id long, text string, source string, n_chars long"


def test_documents_come_in_the_order_of_the_mix(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 40)), rnd.choice(["a", "b", "c", None]), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    order = [(r["doc_id"], r["served"]) for r in mixing.mix(docs).collect()]
    assert [(r["doc_id"], len(r["text"].split())) for r in mixing.mixed_documents(docs).collect()] == order
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for r in mixing.schedule(docs).collect():
        first[r["doc_id"]] = min(first.get(r["doc_id"], (float("inf"), 0)), (r["virtual_finish"], r["doc_id"]))
    assert [r["doc_id"] for r in queries.op2_mix(spark, str(tmp_path)).collect()] == sorted(first, key=first.get)
