"""The open orders' fields of the order lines: the same from written and from unwritten lines, which are read once."""

from types import SimpleNamespace

from conftest import SF_SMALL

from castplan.operators import open_orders as oo
from castplan.plans import registry
from castplan.sources.adapter import ErpViews

DETAIL = ("order_number long, line_number int, product_number string, job_type string, quantity_ordered int, "
          "pieces_shipped_to_date int, extended_order_value int, job_number string, required_date string")
HEADER = "order_number long, customer_name string, customer_po string, ship_date date, job_number string, required_date string"


def test_written_and_unwritten_lines_give_the_same_orders(spark, tmpdir_path):
    detail = spark.createDataFrame([
        (1, 1, " p1 ", "JOB", 2, 0, 10, " j1", "2001-02-03"), (1, 1, " p1 ", "JOB", 2, 0, 10, " j1", "2001-02-03"), (1, 2, "p2", None, None, 0, 5, "  ", "TBD"),
        (2, 1, "p3", "", 1, 0, None, None, None), (3, 1, "p4", "JOB", 4, 0, 4, "J9", "20010203"), (None, 1, "p5", "JOB", 1, 0, 1, "J5", "2001-01-01")], DETAIL)
    header = spark.createDataFrame([(1, "A", "", None, "j7", "2001-05-01"), (1, "B", "", None, None, "20010601"), (2, "C", "", None, " ", "2001-05-01"),
                                    (None, "D", "", None, "J5", "2001-01-01")], HEADER)
    erp = ErpViews(header, detail, None, None, None)
    got = oo.open_orders_by_job(erp).collect()
    assert sorted(got) == sorted(oo.open_orders_by_job(oo.materialize_order_lines(erp, f"{tmpdir_path}/lines")).collect())
    # every line of an order meets every header of it; a job's first key is the line's
    assert {r["job_key"]: (r["open_part"], str(r["open_due"]), r["open_qty"], r["open_value"]) for r in got} == {
        "J1": ("p1", "2001-02-03", 8, 40), "J7": ("p2", "2001-05-01", 0, 5)}


def test_assembled_orders_write_no_order_lines(spark, monkeypatch):
    def written(*_):
        raise AssertionError("the open orders read the order lines once")
    monkeypatch.setattr(registry, "_MEMO", {})
    monkeypatch.setattr(registry, "oo", SimpleNamespace(**{**vars(oo), "materialize_order_lines": written}))
    assert registry.assembled_orders(spark, SF_SMALL).count() > 0
