from quillon.operators import gaps


def test_key_words_of_several_pieces_are_met_as_a_whole(spark):
    texts = {"p1": "Grain-boundary of (Ba,Sr)TiO3", "p2": "a boundary, TiO3, Sr and grain", "p3": "the hot pressed α phase", "p4": "shot pressed αβ", "p5": "grain-boundary2"}
    papers = spark.createDataFrame([(k, t, None) for k, t in texts.items()], "paper_id string, title string, abstract string")
    needles = spark.createDataFrame([("h", ["grain-boundary"]), ("i", ["(Ba,Sr)TiO3"]), ("j", ["α"]), ("k", ["hot pressed"]), ("l", ["boundary"])], "h string, k array<string>")
    got = {(r.h, r.paper_id) for r in gaps.mentions(needles, "h", "k", papers).collect()}
    assert got == {("h", "p1"), ("i", "p1"), ("j", "p3"), ("k", "p3"), ("l", "p1"), ("l", "p2")}
