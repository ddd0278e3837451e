import math
import random

import pytest
from conftest import rows

from lodestream.operators.units import Evidence, Unit, alone, caption_unit, column_unit, decode_statements, decode_tables, found_quantities, readings, statement_evidence, to_number, viterbi_units

CASES = [
    ("calcined at 1,140° C", [("temperature", 1413.15)]), ("(0.865 ± 0.02) tesla", [("magnetic_field", 688.345)]), ("T = 385-412 deg C", [("temperature", 671.65)]),
    ("milled for 17 h and 50 min", [("duration", 64200)]), ("soaking time 5h20min", [("duration", 19200)]), ("half an hour", [("duration", 1800)]), ("7½ h", [("duration", 27000)]),
    ("1.95e4 µA/cm2", [("current_density", 195)]), ("2.78 × 10⁵ A m−1", [("magnetic_field", 278)]), ("5.91×10^4 kPa", [("pressure", 59100)]), ("1 870 psi", [("pressure", 12893.196)]),
    ("22.1 kJ·m^-3", [("energy_product", 22.1)]), ("1 MGOe", [("energy_product", 7.957747)]), ("35 Å", [("length", 3.5)]), ("8,78mT", [("magnetic_field", 6.98690)]),
    ("121MPa, 0.959 days", [("pressure", 121000), ("duration", 82857.6)]), ("−15 deg C / 0.558 hours", [("temperature", 258.15), ("duration", 2008.8)]),
    ("78 °C/min", []), ("heating rate of 5 K min−1", []), ("sweep rate 23 mV/s", []), ("73 mT/s", []), ("9 peaks assigned to SmCo5", []), ("scan step 0.09°", []), ("2.1 g/cm3", []), ("pH 6", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_stated_quantities(text, want):
    got = [(r.unit.quantity, r.value * r.unit.factor + r.unit.offset) for r in readings(text) if r.unit]
    assert [q for q, _ in got] == [q for q, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-5) for (_, a), (_, b) in zip(got, want, strict=True))


def test_numbers():
    assert [to_number(x) for x in ("1,234", "12,34", "1,234,567", "1.5e3", "−3", "1 870", "1.234,5", "½", "x")] == [1234, 12.34, 1234567, 1500, -3, 1870, 1234.5, 0.5, None]


def test_names_of_columns_and_captions():
    assert column_unit("Field (10³ Oe)")[1] == 1000 and column_unit("J / mA/cm²")[0].factor == 10 and column_unit("(BH)max") is None and column_unit("Rate (K/min)") is None
    assert caption_unit("Table 1. X (Hc given in kOe)", "Hc")[0].name == "Oe" and caption_unit("Table 1", "Hc") is None and caption_unit(None, "Hc") is None
    assert alone("[kPa]")[0].quantity == "pressure" and alone("kPa 3") is None


def test_unit_from_the_sentence_or_metadata():
    assert statement_evidence("230", "the final figure was 230", '{"qualifiers": {"units": "kA/m"}}')[0][1][0].unit.factor == 1
    assert statement_evidence("28,300", "the instrument reports nm; the final figure was 28,300", None)[0][1][0].unit.quantity == "length"
    assert statement_evidence("33.4", "the final figure was 33.4", None) == [] and statement_evidence(None, None, None) == [] and statement_evidence("5", None, "no json") == []


def test_viterbi_finds_a_switch_without_text():
    m, mm = Unit("length", "m", 1e9), Unit("length", "mm", 1e6)
    values = [0.0010, 0.0011, 0.0012, 1.3, 1.2, 1.25]
    path = viterbi_units(values, [[Evidence(m, 1.0, 0)]] + [[] for _ in values[1:]], [(m, 1.0), (mm, 1.0)])
    assert path == [0, 0, 0, 1, 1, 1]
    assert viterbi_units([], []) == [] and viterbi_units([1.0], [[]]) == [-1]


def test_text_outweighs_the_level():
    m, mm = Unit("length", "m", 1e9), Unit("length", "mm", 1e6)
    assert viterbi_units([1.0, 1.0, 1.0], [[Evidence(m, 1.0, 0)], [Evidence(mm, 1.0, 0)], [Evidence(m, 1.0, 0)]]) == [0, 1, 0]


TABLE = "record_id bigint, source_file string, paper_id string, page int, table_index int, caption string, columns array<string>, rows array<map<string,string>>, col string, unit string"
EDGE = "edge_id bigint, source string, relation string, target string, paper_id string, evidence_quote string, metadata string, quantity string"


def test_tables_and_edges(spark):
    t = spark.createDataFrame(
        [
            (1, None, None, None, None, "T (P given in bar)", ["Sample", "P", "d [nm]", "x"], [{"Sample": "A1", "P": "2", "d [nm]": "3–5", "x": "0.1"}, {"Sample": "A2", "P": "5 kPa", "d [nm]": None, "x": ""}, None], "clash", "clash"),
            (2, None, None, None, None, None, None, None, None, None), (3, None, None, None, None, "", [], [], None, None),
            (4, None, None, None, None, None, ["Sample", "t"], [{"Sample": "units", "t": "[min]"}, {"Sample": "A", "t": "2"}, {"Sample": "B", "t": "n/a"}], None, None),
            (5, None, None, None, None, None, ["t"], [{"t": "7"}], None, None),
        ], TABLE)
    e = spark.createDataFrame([(1, "s", "HAS_VALUE", "300 K", None, None, None, "x"), (2, "s", "HAS_VALUE", None, "p", None, None, "x"), (3, "s", "isA", "300 K", "p", None, None, "x"), (None, "s", "HAS_VALUE", "1 K", "p", None, None, "x"), (5, "s", "HAS_CONDITION", "5 " * 3000, "p", None, None, "x")], EDGE)
    q = spark.createDataFrame([("temperature",), ("pressure",), ("length",), ("duration",), (None,)], "quantity string")
    got = rows(found_quantities(e, t, q))
    assert got == sorted([("edge", 1, -1, "target", "temperature", 300), ("table", 1, 0, "P", "pressure", 200), ("table", 1, 1, "P", "pressure", 5), ("table", 1, 0, "d [nm]", "length", 4), ("table", 4, 1, "t", "duration", 120)], key=repr)
    assert found_quantities(e, t, q.limit(0)).count() == 0
    assert decode_tables(t.limit(0)).count() == 0 and decode_statements(e.limit(0)).count() == 0


def test_blocks_change_no_row(spark):
    r = random.Random(2)
    quote = lambda k: None if k % 3 else f"given in {r.choice(['kPa', 'MPa', 'bar'])} or {r.choice(['kPa', 'MPa', 'bar'])}: {k % 17 + 1}"
    data = [(k, "s", "HAS_VALUE", f"{k % 17 + 1} {r.choice(['kPa', 'MPa', 'bar'])}" if k % 3 else f"{k % 17 + 1}", "p" if k % 5 else "q", quote(k), None, "x") for k in range(300)]
    e = spark.createDataFrame(data, EDGE)
    want = rows(decode_statements(e))
    assert len(want) == 300 and rows(decode_statements(e, block=7)) == want and rows(decode_statements(e, block=5, fan=3)) == want


def test_a_clear_level_outvotes_a_caption_but_no_unit_beside_the_number(spark):
    table = lambda caption, cells: spark.createDataFrame([(1, None, None, None, None, caption, None, [{"P": c} for c in cells], None, None)], TABLE)
    common = lambda *x: [r.common for r in decode_tables(table(*x)).orderBy("row_no").collect()]
    assert common("T (P given in kPa)", ["2 MPa", "3", "2.5 MPa"]) == [2000, 3000, 2500]  # a wrong caption
    assert common("T (P given in kPa)", ["2 MPa", "3 kPa", "2.5 MPa"]) == [2000, 3, 2500]
    assert common("T (P given in kPa)", ["2", "2500", "3"]) == [2, 2500, 3]
    # a switch that no text tells; the silent readings are decoded, not reported
    t = table(None, ["1 MPa", "1.1", "1200", "1300", "1250 kPa"])
    assert [(r.common, r.named) for r in decode_tables(t).orderBy("row_no").collect()] == [(1000, True), (1100, False), (1200, False), (1300, False), (1250, True)]


def test_levels_decide_between_named_units(spark):
    at = lambda k, target, quote=None, unit=None: (k, "s", "HAS_VALUE", target, "p", quote, f'{{"qualifiers": {{"unit": "{unit}"}}}}' if unit else None, "x")
    # metadata says kPa, the sentence MPa, the readings before and after are MPa; ids lie in different ranges
    e = spark.createDataFrame([at(1, "2 MPa"), at(50, "3", "the gauge reads MPa; it was 3", "kPa"), at(100, "2 MPa"), at(150, "4 kPa")], EDGE)
    assert [x for *_, x, _ in sorted(map(tuple, decode_statements(e, block=10).select("row_id", "common", "named").collect()))] == [2000, 3000, 2000, 4]
    assert len(statement_evidence("3", "given in kPa or in MPa: 3", None)[0][1]) == 2
    t = spark.createDataFrame([(1, None, None, None, None, "T (P given in MPa)", None, [{"P": "2 MPa"}, {"P": "3"}, {"P": "2 MPa"}], None, None)], TABLE)
    assert [r.common for r in decode_tables(t).orderBy("row_no").collect()] == [2000, 3000, 2000]
    t = spark.createDataFrame([(1, None, None, None, None, "T (P [kPa] given in MPa)", None, [{"P [kPa]": "2 MPa"}, {"P [kPa]": "3"}, {"P [kPa]": "2 MPa"}], None, None)], TABLE)
    assert [r.common for r in decode_tables(t).orderBy("row_no").collect()] == [2000, 3000, 2000]


def test_runs_are_counted_per_device(spark):
    e = spark.createDataFrame([(k, "s", "HAS_VALUE", f"{k + 1} K", f"p{k % 3}", None, None, "x") for k in range(200)], EDGE)
    assert rows(decode_statements(e, block=7)) == rows(decode_statements(e)) and decode_statements(e, block=7).count() == 200
