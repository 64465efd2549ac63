"""Work that is done once: fewer passes over tables, sources and tokens."""

import os

import pytest

from leafmill.codec import compose, draw, reader
from leafmill.codec.scan import END, Name, Op, Scanner
from leafmill.plans import layouts, quote_queries

DATA = "/root/testdata/sf0.001"




def lineitem_scans(df) -> int:
    """How often the plan reads prices of lineitem."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in row and "l_extendedprice" in row for row in text.split("\n"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("texts", [layouts.invoice_texts, layouts.paged_texts, quote_queries.quotation_texts])
def test_texts_take_one_pass_over_lines(spark, texts):
    assert lineitem_scans(texts(spark, DATA)) == 1


def test_a_source_is_opened_once(monkeypatch):
    data = draw.create([(612.0, 792.0, [("text", [72.0, 700.0], "once")])])
    opened = []
    own = reader.Reader.__init__
    monkeypatch.setattr(reader.Reader, "__init__", lambda self, *a: (opened.append(1), own(self, *a))[1])
    merged = compose.merge([(data, None)] * 4)
    assert len(opened) == 1 and len(reader.Reader(merged.data).pages()) == 4


@pytest.mark.parametrize("refs", [True, False])
def test_short_tokens_read_as_long_ones(refs):
    s = Scanner(b"1 -2.5 +.5 /A /B#20C /D#zz (x) (y\\051) true nul null 3 0 R 1.2.3 T* ' \"% c\n-x", 0)
    found = []
    while (x := s.value(refs)) is not END:
        found.append(x)
    first = [1, -2.5, 0.5, Name("A"), Name("B C"), Name("D#zz"), b"x", b"y)", True, Op("nul"), None]
    assert found[: len(first)] == first and found[-1] == Op("-x")
    assert (len(found) == len(first) + 7) if refs else (len(found) == len(first) + 9)
