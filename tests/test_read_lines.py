"""Pieces of text read off images, by example and against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import read_lines as R

PIECE = "doc_id long, page long, pos long, x double, y double, width double, height double, text string, confidence double, weight double"


def frame(spark, rows):
    return spark.createDataFrame([(1, p, k, x, y, w, 8.0, t, c, 1.0) for k, (p, x, y, w, t, c) in enumerate(rows)], PIECE)


def test_pieces_of_a_line_are_joined(spark):
    rows = [(1, 0.0, 10.0, 30.0, "Total", 0.9), (1, 50.0, 12.0, 30.0, "amount", 0.5), (1, 120.0, 12.0, 30.0, "far word", 0.9), (1, 0.0, 40.0, 9.0, "X", 0.3), (1, 50.0, 41.0, 30.0, "chosen one", 0.9), (2, 82.0, 42.0, 30.0, "next page", 0.9), (1, None, 60.0, 9.0, "lost", 0.9), (1, 0.0, 60.0, 9.0, None, 0.9)]
    got = {(r.text, r.x, r.width, r.confidence) for r in R.joined_pieces(frame(spark, rows)).collect()}
    assert got == {("Total amount", 0.0, 80.0, 0.9), ("far word", 120.0, 30.0, 0.9), ("X chosen one", 0.0, 80.0, 0.9), ("next page", 82.0, 30.0, 0.9), ("lost", None, None, 0.9), ("", 0.0, 9.0, 0.9)}


def test_a_chain_grows_with_what_it_takes_in(spark):
    """Gaps are measured from the right end of all that is joined so far."""
    rnd = random.Random(4)
    rows = sorted([(rnd.choice([1, 2]), float(rnd.randrange(0, 400, 10)), float(rnd.randrange(0, 60, 6)), float(rnd.randrange(5, 60)), rnd.choice(["X", "ab", "words here", "longer text"]), 0.5) for _ in range(300)], key=lambda r: (r[0], r[2], r[1]))
    want, held = [], None
    for p, x, y, w, t, _ in rows:
        gap = x - held[1] - held[3] if held else None
        if held and held[0] == p and abs(held[2] - y) <= 14 and -4 <= gap <= 48 and (held[4] in R.MARKS or t in R.MARKS or len(held[4]) <= 3 or len(t) <= 3 or gap <= 24):
            right = max(held[1] + held[3], x + w)
            held = [p, min(held[1], x), min(held[2], y), right - min(held[1], x), held[4] + " " + t]
            want[-1] = held
        else:
            held = [p, x, y, w, t]
            want.append(held)
    got = R.joined_pieces(frame(spark, rows).repartition(3)).collect()
    assert sorted((r.page, r.x, r.y, r.width, r.text) for r in got) == sorted(map(tuple, want)) and len(want) < 280


def test_the_best_reading_of_each_text_stays(spark):
    rows = [(1, 0.0, 100.0, 30.0, "Invoice total", 0.7), (1, 0.0, 200.0, 30.0, "INVOICE TOTAL", 0.9), (1, 0.0, 300.0, 30.0, "blurred words", 0.3), (1, 0.0, 400.0, 30.0, "X", 0.1), (1, 0.0, 500.0, 30.0, "ok", 0.5), (1, 0.0, 550.0, 30.0, "aaaa", 0.9), (1, 0.0, 600.0, 30.0, "www.site.org", 0.9), (1, 0.0, 5.0, 30.0, "My tab", 0.9), (1, 0.0, 990.0, 30.0, "status bar", 0.9), (1, 0.0, 650.0, 30.0, "Search", 0.9)]
    names = lambda shot: {r.text for r in R.best_readings(frame(spark, rows), spark.createDataFrame([(1, 1000, shot)], "doc_id long, image_height int, screenshot boolean")).collect()}
    assert names(True) == {"X"} and names(False) == {"INVOICE TOTAL", "X", "My tab", "status bar", "Search"}
    assert R.best_readings(frame(spark, rows), spark.createDataFrame([], "doc_id long, image_height int, screenshot boolean")).count() == 5


def test_rows_of_a_page(spark):
    rows = [(1, 200.0, 10.0, 40.0, "12O,5S", 0.9), (1, 0.0, 14.0, 30.0, "Cуммa", 0.5), (1, 60.0, 22.0, 20.0, "--", 0.99), (1, 0.0, 23.0, 20.0, "2O25-1-3", 0.7), (2, 0.0, 23.0, 20.0, "№", 0.7), (0, 0.0, 1.0, None, "x", 0.2), (1, 5.0, None, 1.0, "no height", 0.9)]
    got = {(r.page, r.text, r.confidence) for r in R.page_rows(frame(spark, rows)).collect()}
    assert got == {(1, "Сумма | 120,55", 0.99), (1, "2025-01-03", 0.7), (1, "x", 0.2)}


@pytest.mark.parametrize("text,want", [("2O25/1l/3", "2025-11-03"), ("2025-13-01", "2025-13-01"), ("1899-01-01", "1899-01-01"), ("l.O2.2025", "1.02.2025"), ("Ивaнoв", "Иванов"), ("Сopy", "Copy"), ("I", "I"), (None, ""), (" a  b ", "a b")])
def test_tokens(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(R.token(F.col("v")).alias("r")).first().r == want


def test_nothing_to_read(spark):
    assert R.joined_pieces(frame(spark, [])).collect() == [] and R.page_rows(frame(spark, [])).collect() == []
