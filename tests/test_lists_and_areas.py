"""Lists typed by hand, stores by ZIP area, and networks that are carried over."""

from tiermark.operators import choosing, listed, stores


def test_hand_lists(spark):
    rows = [("a", "1", 3, 1, "QL"), ("a", "1", 2, 5, "PA ST"), ("a", "1", 2, 4, "BEST QL;"), ("a", "2", 1, 2, None), ("a", "3", 4, 3, "QL/ST"), ("b", "3", 5, 1, ""), ("b", "4", 1, 2, "PASTE")]
    schema = "list string, id string, tier int, pos int, limits string"
    codes = spark.createDataFrame([("1", "x"), ("1", "y"), ("1", "x"), ("3", "x"), ("3", "z"), ("9", "q")], "id string, code string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in listed.hand_lists(spark.createDataFrame(rows, schema), codes).collect()}
    assert got == {
        ("a", "1", "x"): (2, True, False, False), ("a", "1", "y"): (2, True, False, False), ("a", "2", "RX2"): (1, False, False, False), ("a", "3", "z"): (4, True, False, True),
        ("b", "3", "x"): (5, False, False, False), ("b", "3", "z"): (5, False, False, False), ("b", "4", "RX4"): (1, False, True, False),
    }
    assert listed.hand_lists(spark.createDataFrame([], schema), codes).count() == 0


def test_areas_decide(spark):
    clients = spark.createDataFrame([(1, 45.0, -93.0), (2, 47.0, -95.0)], "client int, lat double, lon double")
    areas = spark.createDataFrame([("A", 45.1, -93.0), ("B", 45.6, -93.0)], "zip string, lat double, lon double")
    shops = spark.createDataFrame([(1, "A", 45.0, -93.0), (2, "A", 45.7, -93.0), (3, "A", None, -93.0), (4, "A", 0.0, 0.0), (5, "B", 45.01, -93.0), (6, "C", 45.0, -93.0), (7, None, 45.0, -93.0)], "npi int, zip string, lat double, lon double")
    got = {(r.client, r.npi): (round(r.distance, 1), r.approximate) for r in stores.nearby_by_area(clients, areas, shops).collect()}
    assert got == {(1, 1): (0.0, False), (1, 2): (48.4, False), (1, 3): (6.9, True), (1, 4): (6.9, True)}
    assert stores.nearby_by_area(clients.limit(0), areas, shops).count() == 0


def test_carried(spark):
    plans = lambda *p: spark.createDataFrame([(x,) for x in p], "plan string")
    alike = spark.createDataFrame([("new1", "gone"), ("new2", "gone"), ("new2", "gone2"), ("new2", "gone"), ("kept", "gone"), ("new1", "kept"), ("other", "gone")], "plan string, source string")
    network = spark.createDataFrame([("kept", 1), ("gone", 2), ("gone", 3), ("gone2", 4), ("unknown", 5)], "plan string, npi int")
    got = sorted((r.plan, r.npi) for r in choosing.carried(network, plans("kept", "new1", "new2", "new3"), plans("kept", "gone", "gone2"), alike).collect())
    assert got == [("kept", 1), ("new1", 2), ("new1", 3), ("new2", 2), ("new2", 3), ("new2", 4)]
