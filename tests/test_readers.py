"""CSV exports as they come, and p-values of large groups."""

import math

import pytest

from morphospark.functions.stats import t_tail, t_two_sided_p
from morphospark.sources.readers import read_csv, read_table


def test_text_columns_missing_tokens_and_uri(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ImageNumber,x,note,mixed,none\n1,1.5,first,1,\n2,NaN,NA,5D,\n")
    (tmp_path / "b.csv").write_text("ImageNumber,x,note,mixed,none\n3, 2e3 ,third,,NULL\n")
    df = read_table(spark, f"file:{tmp_path}")
    assert dict(df.dtypes) == {"ImageNumber": "bigint", "x": "double", "note": "string", "mixed": "string",
                               "none": "double"}
    assert sorted(tuple(r) for r in df.collect()) == [
        (1, 1.5, "first", "1", None), (2, None, None, "5D", None), (3, 2000.0, "third", None, None)]


def test_other_column_order_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ImageNumber,a,b\n1,10,20\n")
    (tmp_path / "b.csv").write_text("ImageNumber,b,a\n2,20,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path)).collect()


def test_p_value_of_known_cases_and_large_groups():
    # One and two degrees of freedom have closed forms; at many the normal tail with its first correction holds.
    for t in (0.1, 1.0, 3.0, 50.0):
        assert t_tail(t, 1.0) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-12)
        assert t_tail(t, 2.0) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)
    for df in (1e7, 1e9, 1e11, 1e13):
        for t in (0.01, 0.5, 0.9999, 1.0, 1.5, 1.7321, 2.0, 5.0, 10.0):
            tail = math.erfc(t / math.sqrt(2)) + math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t ** 3 + t) / (2 * df)
            assert t_tail(t, df) == pytest.approx(tail, rel=1e-9)
    for t in (0.3, 1.0, 1.8, 6.0):  # both sides of the change of method, an odd step of 1e-6 apart
        assert t_tail(t, 99999.95) == pytest.approx(t_tail(t, 100000.05), rel=1e-7)
    assert t_tail(99.0, 100.0) < t_tail(99.0, 99.0) < 1e-90
    assert t_tail(3.0, 199.9999) == pytest.approx(t_tail(3.0, 200.0001), rel=1e-6)
    assert t_two_sided_p(0.0, 10) == 1.0 and t_two_sided_p(1.0, 2) == 0.0 and t_two_sided_p(None, 9) is None
