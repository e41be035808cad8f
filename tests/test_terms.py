"""Terms of fills by hand-made cases."""

from tiermark.operators import terms

SHARED = "price long, negotiated long, preferred boolean, captured boolean, insulin boolean, month long, has_row boolean, ded_applies string, tier int"
STORE = f"id int, {SHARED}, brand_fee long, generic_fee long, pref_type int, pref_amount long, std_type int, std_amount long"
MAIL = f"id int, {SHARED}, mail_price long, mail_type int, mail_amount long"


def read(df, *columns):
    return {r.id: tuple(r[c] if c != "terms" else tuple(r.terms) for c in columns) for r in df.collect()}


def test_fill_terms(spark):
    two = (1, 500, 2, 25)
    rows = [
        (0, 1000, None, True, False, False, None, True, "Y", 3, 150, 50, *two),
        (1, 1000, None, False, False, False, None, True, "N", 2, 150, 50, *two),
        (2, 1000, 400, None, False, None, None, True, None, 1, 0, None, 0, 9, 2, None),
        (3, 1000, 400, True, True, False, None, True, "N", 4, 150, 50, *two),
        (4, 1000, None, True, True, True, 2100, True, "N", 4, 150, 50, *two),
        (5, 1000, None, True, True, True, None, None, None, 4, 150, 50, None, None, None, None),
        (6, 1000, None, True, None, True, 2100, True, "N", 4, 150, 50, *two),
        (7, 1000, 5, True, False, False, None, None, None, 4, 150, 50, None, None, None, None),
        (8, None, None, True, False, False, None, True, "Y", 5, None, 50, 0, 0, None, 7),
    ]
    assert read(terms.fill_terms(spark.createDataFrame(rows, STORE)), "terms") == {
        0: ((1000, 150, 1, 500, True, None),), 1: ((1000, 50, 2, 25, False, None),), 2: ((400, 0, 2, 0, True, None),), 3: ((1000, 0, 1, 500, False, None),),
        4: ((1000, None, None, None, None, 2100),), 5: ((1000, None, None, None, None, 3500),), 6: ((None, None, None, None, None, 3500),),
        7: ((None, None, None, None, None, 0),), 8: ((None, 50, 0, 0, True, None),),
    }
    assert terms.fill_terms(spark.createDataFrame([], STORE)).count() == 0


def test_mail_terms(spark):
    rows = [
        (0, 1000, None, True, False, False, None, True, "Y", 3, 2900, 1, 1000),
        (1, 1000, 700, True, False, False, None, True, "N", 3, None, 2, 20),
        (2, 1000, 700, True, True, False, None, True, None, 3, 2900, 2, None),
        (3, 1000, None, True, True, False, None, True, "Y", 3, 0, 1, 900),
        (4, 1000, None, True, False, False, None, True, "Y", 3, 2900, 0, 900),
        (5, 1000, None, True, False, False, None, None, None, 3, 2900, None, None),
        (6, 1000, None, True, True, True, 1200, None, None, 3, 2900, None, None),
        (7, 1000, None, True, None, True, 1200, True, "N", 3, 2900, 1, 3000),
    ]
    assert read(terms.mail_terms(spark.createDataFrame(rows, MAIL)), "offered", "terms") == {
        0: (True, (1000, 0, 1, 333, True, None)), 1: (True, (700, 0, 2, 20, False, None)), 2: (True, (966, 0, 2, 0, True, None)), 3: (True, (None, 0, 1, 300, True, None)),
        4: (False, (None,) * 6), 5: (False, (None,) * 6), 6: (True, (966, None, None, None, None, 1200)), 7: (True, (None, None, None, None, None, 3500)),
    }


def test_phases(spark):
    schema = "id int, price long, preferred boolean, insulin boolean, copay long, coins long, has_row boolean, pref_type int, pref_amount long, std_type int, std_amount long, ded_applies string"
    rows = [
        (0, 1000, True, False, None, None, True, 1, 1500, 2, 25, "Y"),
        (1, 1000, False, False, None, None, True, 1, 300, 2, 25, "N"),
        (2, 1000, True, None, None, None, True, 0, 300, 0, 25, None),
        (3, 5000, True, True, 4000, 50, None, None, None, None, None, None),
        (4, 9000, True, True, None, None, None, None, None, None, None, None),
        (5, 0, True, True, None, None, None, None, None, None, None, None),
        (6, 9000, True, False, 1, 1, None, None, None, None, None, None),
    ]
    assert read(terms.phases(spark.createDataFrame(rows, schema)), "deductible_phase", "initial_phase") == {
        0: (1000, 1000), 1: (250, 250), 2: (1000, 0), 3: (2500, 2500), 4: (3500, 3500), 5: (3500, 3500), 6: (None, None),
    }
