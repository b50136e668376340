import random

from saldo.operators import insights as I


def test_containment_inside_words_at_any_number_of_titles(spark):
    rng = random.Random(3)
    fixed = [(1, "GrabFood monthly", "Upcoming"), (2, "od mon", "Upcoming"), (3, "x", "Confirmed"), (4, "Grab", "Paid"), (5, "日本の", "Tentative"), (6, None, "Upcoming")]
    rows = fixed + [(100 + i, f"title {i} {rng.random()}", "Upcoming") for i in range(10_500)]
    upcoming = spark.createDataFrame(rows, "id long, title string, status string")
    names = ["grab", "grabfood monthly fee", "food", "box", "今日本の店", "itle 7 ", "qq", "", None]
    got = {r.merchant: r.upcoming_id for r in I.match_upcoming(spark.createDataFrame([(n,) for n in names], "merchant string"), upcoming).collect()}
    titles = [(i, t.lower()) for i, t, s in rows if t is not None and s != "Paid"]
    assert got == {n: None if n is None else min((i for i, t in titles if n in t or t in n), default=None) for n in names}
