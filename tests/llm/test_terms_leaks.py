"""Term counts and leaks on fixtures with nulls, ties, repeated rows and clashing column names."""

from latentia.llm import leaks, terms


def test_term_counts(spark):
    rows = [("a\tb  b", 1), ("a c ", 2), (None, 3), ("", 4), (" \t ", 5), ("a\tb  b", 1), ("x" * 5000, 6)]
    df = spark.createDataFrame(rows, "line string, term long").repartition(3)
    got = {r.term: (r.occurrences, r.records, r.n_records) for r in terms.term_counts(df, "line").collect()}
    assert got == {"a": (3, 3, 4), "b": (4, 2, 4), "c": (1, 1, 4), "x" * 5000: (1, 1, 4)}
    assert terms.term_counts(df.limit(0), "line").count() == 0


def test_light_terms_are_exact(spark, monkeypatch):
    monkeypatch.setattr(terms, "HEAVY_SLOTS", 2)
    monkeypatch.setattr(terms, "SUMMARY_SLOTS", 2)
    rows = [(" ".join(f"t{j}" for j in range(i % 17)),) for i in range(400)]
    df = spark.createDataFrame(rows, "line string").repartition(4)
    want = {}
    for (t,) in rows:
        for w in t.split():
            want[w] = want.get(w, 0) + 1
    assert {r.term: r.occurrences for r in terms.term_counts(df, "line").collect()} == want


def test_grouped_records_and_marks(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (3, None)] + [(100 + i, f"w{i}") for i in range(60)] + [(200 + i, "a") for i in range(5)]
    df = spark.createDataFrame(rows, "sent_id long, word string")
    got = {r.term: r for r in terms.mark_terms(terms.term_counts(df, "word", record="sent_id")).collect()}
    assert (got["a"].occurrences, got["a"].records, got["a"].n_records, got["a"].mark) == (8, 7, 68, "common")
    assert (got["b"].occurrences, got["b"].records, got["b"].mark) == (2, 1, "rare")


def test_grouped_records_with_few_slots(spark, monkeypatch):
    """Records spread over partitions and batches, one holding a third of the rows, heavy and light terms."""
    monkeypatch.setattr(terms, "HEAVY_SLOTS", 3)
    monkeypatch.setattr(terms, "SUMMARY_SLOTS", 12)
    rows = [(0 if i % 3 == 0 else i % 40, f"t{(i * i) % (3 if i % 2 else 23)}") for i in range(900)]
    df = spark.createDataFrame(rows, "sent_id int, word string").repartition(5)
    want = {}
    for r, w in rows:
        want.setdefault(w, []).append(r)
    got = {r.term: (r.occurrences, r.records, r.n_records) for r in terms.term_counts(df, "word", record="sent_id").collect()}
    assert got == {w: (len(r), len(set(r)), len({a for a, _ in rows})) for w, r in want.items()}
    assert terms.term_counts(df.limit(0), "word", record="sent_id").count() == 0


def test_leaks(spark, monkeypatch):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:12])), (2, " ".join(w[5:15]).upper()), (3, "w1 w2"), (4, None), (5, ""), (6, " ".join(w[:12])), (7, " ".join(w[20:24] + w[30:36]))]
    lines = [(10, "x, y! " + " -- ".join(w[:11]) + "."), (11, " ".join(w)), (12, " ".join(w[:9])), (13, None), (14, ""), (11, " ".join(w)), (15, "w1 w2")]
    a = spark.createDataFrame([(i, t, "k") for i, t in lines], "id long, text string, win string")
    b = spark.createDataFrame(items, "item long, text string")
    run = lambda **k: {(r.line_id, r.item_id): (r.shared, r.item_windows) for r in leaks.leaked(a, "id", "text", b, "item", "text", **k).collect()}
    want = {(10, 1): (2, 3), (10, 6): (2, 3), (11, 1): (3, 3), (11, 6): (3, 3), (11, 2): (1, 1)}
    assert run() == want
    assert run(short_items=2) == want | {(i, 3): (1, 1) for i in (10, 11, 12, 15)}
    monkeypatch.setattr(leaks, "SKETCH_LIMIT", 0)
    assert run() == want
    assert leaks.leaked(a, "id", "text", b.limit(0), "item", "text").count() == 0
