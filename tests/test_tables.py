"""Table cells and terminology excerpts."""

from types import SimpleNamespace

from pagemill.operators import sampling, tables


def item(i, text, x, y, size=8.0):
    return (1, 1, 1, i, text, float(x), float(y), len(text) * 0.5 * size, size)


def test_cells_of_a_journal_table(spark):
    rows = [
        ("", "Control", "Treated", "P"), ("Female", "389 (63.0)", "0", "<.001"), ("Time from last interview", "", "", ""), ("  to death, mean (SD)", "6.6 (5.1)", "7.2", ".20"), ("Male", "228", "12", ".5"),
    ]
    items, n = [], 0
    for r, texts in enumerate(rows):
        for x, t in zip((50, 200, 260, 320), texts):
            if t.strip():
                indent = len(t) - len(t.lstrip())
                items.append(item(n, t.strip(), x + 4 * indent, 700 - 10 * r))
                n += 1
    got = tables.table_cells(spark.createDataFrame(items, tables.ITEMS)).collect()
    by = {(r["row"], r["column"]): r for r in got}
    assert {r["status"] for r in got} == {"RESOLVED"} and {r["column"] for r in got} == {0, 1, 2, 3}
    assert by[1, 1]["text"] == "389 (63.0)" and by[0, 3]["text"] == "P"
    ids = [i for r in got for i in r["item_ids"]]
    assert sorted(ids) == list(range(n)) and len({r["cell_id"] for r in got}) == len(got)


def test_wrapped_label_is_one_cell(spark):
    items = [item(0, "Name", 50, 700), item(1, "N", 200, 700), item(2, "Time from last interview,", 50, 690), item(3, "to death", 54, 680), item(4, "Male", 50, 670), item(5, "12", 200, 670)]
    got = {r["row"]: r for r in tables.table_cells(spark.createDataFrame(items, tables.ITEMS)).collect() if r["column"] == 0}
    assert got[1]["text"] == "Time from last interview, to death"


def test_unresolved_tables_say_why(spark):
    one = tables.table_cells(spark.createDataFrame([item(0, "a", 50, 700), item(1, "b", 200, 700)], tables.ITEMS)).collect()
    assert [r["status"] for r in one] == ["SINGLE_ROW"]
    assert tables.cells_of([]) == ("NO_ITEMS", [])
    assert tables.alignment([(0.0, 10.0), (0.0, 20.0)]) == "left" and tables.alignment([(5.0, 20.0), (0.0, 20.0)]) == "right" and tables.alignment([(1.0, 2.0)]) == "left"


def unit(i, kind, words, page=1):
    return SimpleNamespace(unit_id=f"u{i}", type=kind, text=words, page=page)


def test_samples_keep_to_the_budget(spark):
    units = [unit(0, "TITLE", "A title")]
    for p in range(30):
        units += [unit(f"{p}h", "HEADING", f"Heading {p}", p + 1), *[unit(f"{p}b{k}", "BODY", f"Body text COPD {p} {k} " * 14, p + 1) for k in range(4)], unit(f"{p}c", "CAPTION", f"Table {p}. A caption", p + 1)]
    got = sampling.samples_of(units)
    assert sum(len(t) for _, t in got) <= sampling.BUDGET and got[0] == ("title", "A title")
    assert sum(s == "opening" for s, _ in got) == 5 and " | " in next(t for s, t in got if s == "headings")
    assert sampling.samples_of([unit(0, "BODY", "small"), unit(1, "REFERENCE", "no")]) == [("whole", "small")]
    rows = [(7, i, u.unit_id, u.page, u.type, u.text) for i, u in enumerate(units)]
    assert [(r["pass"], r["excerpt"]) for r in sampling.term_samples(spark.createDataFrame(rows, sampling.UNITS)).orderBy("seq").collect()] == got


def test_definitions():
    assert "(COPD)" in sampling.definition("We study chronic obstructive pulmonary disease (COPD) here") and sampling.definition("nothing") is None
