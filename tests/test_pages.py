from quillon.sources import pages
from quillon.sources.papers import from_openalex

PAGE = '{"results": [{"id": "https://x/W%d", "display_name": "T%d", "abstract_inverted_index": {"a": [0]}}]}'


def folder(tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(PAGE % (i, i))
    return str(tmp_path)


def test_batch(spark, tmp_path):
    spark.dataSource.register(pages.PaperPages)
    df = spark.read.format("paper_pages").option("source", "openalex").option("query", folder(tmp_path)).option("cursor", "1").option("pages", "5").load()
    assert {r.paper_id for r in from_openalex(df).collect()} == {"openalex_W1", "openalex_W2"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.dataSource.register(pages.PaperPages)
    stream = spark.readStream.format("paper_pages").option("query", folder(tmp_path / "in")).load()
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() >= 1


def test_patience():
    calls, slept = [], []

    def flaky(source, query, cursor):
        calls.append(cursor)
        if len(calls) < 3:
            raise OSError("busy")
        return "body", None

    assert pages.patient(flaky, "s", "q", 7, sleep=slept.append) == ("body", None) and slept == [3.0, 6.0]
    assert pages.patient(lambda *a: (_ for _ in ()).throw(OSError()), "s", "q", 0, sleep=slept.append) == (None, None)


def test_queries():
    assert pages.arxiv_query(["cs.LG"], ["thin film"]) == 'cat:cs.LG OR all:"thin film"'
    assert pages.rotating_query(["a", "b", "c"], 0) == "a b" and pages.rotating_query(["a", "b", "c"], 1) == "c a b"
    assert pages.rotating_query(["a", "b", "c"], 2).endswith("mechanism") and pages.rotating_query([], 0) == "" and len(pages.rotating_query(["x" * 500], 0)) == 400
