import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.sources import delimited
from loomtext.sources.delimited import MARK, cheapest_edits

FIELD = '(?:"(?:[^"]|"")*"|[^"%s]*)' % MARK


def brute_reason(structure, width):
    """The definition, read off a regular expression."""
    if not re.fullmatch(f"{FIELD}(?:{MARK}{FIELD})*", structure):
        return "quoting"
    return None if len(re.findall(f"{MARK}({FIELD})", MARK + structure)) == width else "columns"


def reason(structure, width):
    qi, qd, di, dd = cheapest_edits(structure, width)
    return "quoting" if qi + qd else "columns" if di + dd else None


def test_edits_say_what_the_definition_says_for_every_short_structure():
    for n in range(7):
        for s in map("".join, itertools.product(f'x"{MARK}', repeat=n)):
            assert reason(s, 3) == brute_reason(s, 3), repr(s)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=f'x"{MARK}', max_size=40), st.integers(1, 5))
def test_edits_on_longer_structures(s, width):
    assert reason(s, width) == brute_reason(s, width)


SHIPPING = "row_id bigint, rel_path string, line_no int, parcel string, city string, status string, extra string, loaded_at timestamp, line string"
MEASURES = "row_id bigint, rel_path string, line_no int, c0 string, loaded_at timestamp, delimiter string"


def test_shipping_reasons(spark):
    rows = [(1, "f", 1, "PKG-12", "A", "Held", None), (2, "f", 2, '"PKG-12"', '"a ""b"""', "lost", None), (3, "f", 3, "PKG-1", "A", "held", None), (4, "f", 4, None, None, None, None),
            (5, "f", 5, 'PKG-12"', "A", "held", None), (6, "f", 6, "PKG-12", '"a', 'b"', "held"), (7, "f", 7, "PKG-12", "A", "held", ""), (8, "f", 8, " PKG-12\r", "", "IN transit ", None), (9, None, None, "x" * 50_000, "A", "held", None)]
    df = spark.createDataFrame([(*r, None, "clash") for r in rows], SHIPPING)
    got = {r.row_id: r.reason for r in delimited.parse_shipping(df).collect()}
    assert got == {1: None, 2: None, 3: "value", 4: "columns", 5: "quoting", 6: None, 7: "columns", 8: None, 9: "value"}
    assert {r.row_id: r.city for r in delimited.loaded_shipping(df).collect()} == {1: "A", 2: 'a "b"', 6: "a\tb", 8: None}


def test_measurements_need_their_header(spark):
    rows = [(1, "a", 1, "Table: x"), (2, "a", 2, '"sensor";reading_mm;status;measured_on'), (3, "a", 3, "S-1;;stable;2024-02-29"), (4, "a", 4, "S-1;1.5;watch;2023-02-29"), (5, "a", 5, " \r"), (6, "a", 6, "S-1,1,watch,2024-01-01"),
            (7, "a", 2, "sensor;reading_mm;status;measured_on"), (8, "b", 1, "S-1;1;watch;2024-01-01"), (9, "a", 7, None), (10, "a", 3, "S-1;;stable;2024-02-29"), (11, "a", 8, "S-1;+1.;watch;2024-01-01"), (12, "a", None, "S-1;1;watch;2024-01-01")]
    df = spark.createDataFrame([(*r, None, "clash") for r in rows], MEASURES)
    got = {r.row_id: r.reason for r in delimited.parse_measurements(df).collect()}
    assert got == {3: None, 4: "value", 6: "columns", 10: None, 11: "value"}


def test_empty_tables(spark):
    assert delimited.rejected_rows(spark.createDataFrame([], SHIPPING), spark.createDataFrame([], MEASURES)).count() == 0


def test_every_character_of_a_value_is_kept(spark):
    city = "a\u0001b\u00021\u00020c"
    df = spark.createDataFrame([(1, "f", 1, "ABC-12", city, "held", None, None), (2, "f", 2, "ABC-13", f'"{city}"', "held", None, None)], "row_id bigint, rel_path string, line_no int, parcel string, city string, status string, extra string, loaded_at timestamp")
    assert {r["city"] for r in delimited.loaded_shipping(df).collect()} == {city}
