import __spark_entry__
from quillon.operators.inverted import index_texts


def test_texts_of_any_length_come_back(spark, tmp_path):
    long = "  ".join(f"w{i % 700}" for i in range(20000))
    rows = [("short", "a b\n a  c"), ("long", long), ("twice", "x y x"), ("twice", "y x"), ("blank", " \t "), ("empty", ""), ("none", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.decoded) for r in __spark_entry__.queries()["inverted_index_roundtrip"](spark, str(tmp_path)).collect())
    assert got == sorted((k, " ".join(t.split())) for k, t in rows if t is not None)
    index = {(r.doc_id, r.word): sorted(r.positions) for r in index_texts(docs.where("doc_id = 'short'"), "doc_id", "text").collect()}
    assert index == {("short", "a"): [0, 2], ("short", "b"): [1], ("short", "c"): [3]}
