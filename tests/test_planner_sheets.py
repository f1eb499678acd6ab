"""Planner sheets of several layouts: headers, choices and roll-ups against hand-written cells."""

import datetime as dt

import pytest

from staffwise.operators import planner as pl
from staffwise.operators import rollup as ru

CELLS = "workbook string, sheet string, row int, col int, value string"
OPI, VRI, CSA = "1. Weekly Planner OPI", "2. Weekly Planner VRI", "csa x"


def sheet(workbook, name, headers, weeks):
    """Cells of a sheet: ``headers`` three texts each, ``weeks`` maps a date to the metrics' values."""
    rows = [(workbook, name, 3, 3, "Week Of:")]
    rows += [(workbook, name, 4 + i, 3 + j, h) for i, hs in enumerate(headers) for j, h in enumerate(hs) if h is not None]
    for c, (day, values) in enumerate(weeks.items()):
        rows.append((workbook, name, 3, 6 + c, day))
        rows += [(workbook, name, 4 + i, 6 + c, v) for i, v in enumerate(values) if v is not None]
    return rows


@pytest.fixture(scope="module")
def facts(spark):
    opi = [("USD", "L3", "Volume (ACTUAL)"), ("Global", "L3", "Volume (ACTUAL)"), ("USD", "L3", "AHT (ACTUAL)"),
           ("Global", "L3", "AHT (ACTUAL)"), ("USD", "OCC Assumptions (L3):", None), ("Global", "OCC Assumptions (L3):", None),
           ("USD", "L3", "Staffing Requirement (Variance)"), ("Global", "L3", "Staffing Requirement (Variance)"), ("note", None, None)]
    vri = [("OCC Assumptions (L4):", None, None), ("OCC Assumptions (L5):", None, None), ("Combined", "L4", "Volume (ACTUAL)")]
    csa = [("Combined", "OLY", "Volume (ACTUAL)"), ("Combined", "BOA", "Volume (ACTUAL)"), ("OLY", "OLY", "Q4 Time"), ("BOA", "BOA", "Q4 Time"),
           ("OCC Assumptions (OLY):", None, None), ("OCC Assumptions (BOA):", None, None)]
    cells = sheet("x", OPI, opi, {"05-01-2025": ["1,000", "3,000", "10", "20", "80%", "60%", "-2", "5", "text"],
                                  "12-01-2025": ["0", "0", "7", "9", "50%", None, "1", None, None]})
    cells += sheet("x", VRI, vri, {"05-01-2025": ["70%", "90%", "12"], "12-01-2025": [None, "60%", "3"]})
    cells += sheet(CSA, OPI, csa, {"05-01-2025": ["10", "30", "2", "4", "50%", "90%"]})
    return pl.shape_planner(spark.createDataFrame(cells, CELLS)).cache()


W1, W2 = dt.date(2025, 1, 5), dt.date(2025, 1, 12)


def test_each_layout_is_read_from_its_own_cells(facts):
    got = {(r["workbook"], r["sheet"], r["week"], r["metric"]): r["value"] for r in facts.collect()}
    assert got["x", OPI, W1, "USD L3 Volume (ACTUAL)"] == 1000 and got["x", OPI, W1, "Global OCC Assumptions (L3):"] == 0.6
    assert got["x", VRI, W2, "OCC Assumptions (L5):"] == 0.6 and got[CSA, OPI, W1, "OLY OLY Q4 Time"] == 2
    assert got["x", OPI, W1, "USD L3 Staffing Requirement (Variance)"] == -2
    assert not any(k[3] == "note" for k in got)


def test_video_assumptions(facts):
    got = {(r["week"], r["usd"], r["level"]): r["occ_assumption"] for r in pl.occ_video(facts).collect()}
    assert got == {(W1, "Combined", "L4"): 0.7, (W1, "Combined", "L5"): 0.9, (W1, "Combined", "Combined"): pytest.approx(0.8),
                   (W2, "Combined", "L5"): 0.6, (W2, "Combined", "Combined"): 0.6}


def test_sheet_kinds(facts):
    got = {(r["workbook"], r["sheet"]): (r["kind"], r["media"]) for r in pl.sheet_kinds(facts).collect()}
    assert got == {("x", OPI): ("OPI", "OPI"), ("x", VRI): ("VRI", "VIDEO"), (CSA, OPI): ("OPI", "OPI")}


def test_roll_ups(facts):
    w = {(r["week"], r["family"], r["usd"], r["level"]): (r["weighted"], r["volume"]) for r in ru.rollup_weighted(facts).collect()}
    assert w[W1, "AHT (ACTUAL)", "Combined", "L3"] == (pytest.approx(17.5), 4000)
    assert w[W1, "OCC Assumptions", "Combined", "Combined"] == (pytest.approx(0.65), 4000)
    assert w[W2, "AHT (ACTUAL)", "Combined", "L3"] == (None, 0)     # no volume
    assert (W2, "OCC Assumptions", "Global", "L3") not in w         # no cell
    s = {(r["week"], r["family"]): r["value"] for r in ru.rollup_staffing(facts).collect()}
    assert s == {(W1, "Staffing Requirement (Variance)"): 3, (W2, "Staffing Requirement (Variance)"): 1}
    site = {(r["family"], r["site"]): (r["weighted"], r["n_sites"]) for r in ru.rollup_site(facts).collect()}
    assert site["Q4 Time", "Combined"] == (3.5, 2) and site["OCC Assumptions", "Combined"] == (pytest.approx(0.8), 2)
    assert site["OCC Assumptions", "OLY"] == (0.5, 1) and ("AHT (ACTUAL)", "Combined") not in site


@pytest.mark.parametrize("choice, want", [
    ("Global L3", {"Global L3 Volume (ACTUAL)", "Global L3 AHT (ACTUAL)", "Global OCC Assumptions (L3):",
                   "Global L3 Staffing Requirement (Variance)"}),
    ("Combined L4", {"OCC Assumptions (L4):", "Combined L4 Volume (ACTUAL)"}),
    ("BOA", {"Combined BOA Volume (ACTUAL)", "BOA BOA Q4 Time", "OCC Assumptions (BOA):"}),
    ("Combined", {"Combined Combined Q4 Time", "Combined Combined OCC Assumptions:"}),
    ("Combined Combined", {"Combined Combined Volume (ACTUAL)", "Combined Combined AHT (ACTUAL)", "Combined OCC Assumptions (Combined):",
                           "Combined Combined Q4 Time", "Combined Combined OCC Assumptions:", "Combined L4 Volume (ACTUAL)"})])
def test_choices(facts, choice, want):
    assert {r["metric"] for r in pl.select_choice(ru.derived(facts), choice).collect()} == want


def test_a_missing_sheet_is_an_error(spark, facts):
    cells = spark.createDataFrame(sheet("x", OPI, [], {"05-01-2025": []}), CELLS)
    with pytest.raises(ValueError, match="VRI"):
        pl.shape_planner(cells, [VRI])
