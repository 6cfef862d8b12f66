from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallywick.contract import IngestError
from tallywick.functions.exprs import parsed_timestamp
from tallywick.sources import ingest


def csv(tmp_path, text, name="orders.csv"):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_headers():
    find = ingest.detect_mapping
    assert find(["Order No", "Customer Email", "Order Date", "Grand Total"]) == {"customer_id": "Customer Email", "order_date": "Order Date", "amount": "Grand Total"}
    assert find(["amount", "note", "order_date", "customer_id"]) == {c: c for c in ("customer_id", "order_date", "amount")}
    # no column serves twice, and case and punctuation don't matter
    assert len(set(find(["Date", "e-mail", "TOTAL"]).values())) == 3
    assert find(["E-Mail", "EMAIL", "x"]) == {"customer_id": "E-Mail"}


def test_money_and_types(spark, tmp_path):
    got = ingest.load_orders(spark, csv(tmp_path, "customer_id,order_date,amount\nu1,2021-04-03,EUR 12.50\nu2,2021-04-05,\"1,200\"\nu1,2021-05-01,7\nu3,2021-05-02,£0.99\n"))
    assert (got.preset, got.rows_in, got.rows_out, got.n_customers, got.dropped) == ("auto", 4, 4, 3, {})
    assert sorted(r.amount for r in got.orders.collect()) == [0.99, 7.0, 12.5, 1200.0]
    assert [t for _, t in got.orders.dtypes] == ["string", "timestamp_ntz", "double"]


def test_preset_mapping_and_errors(spark, tmp_path):
    stripe = csv(tmp_path, "fee,Customer Email,Amount,Created (UTC)\n1,m@n,8.25,2022-09-09 17:30:00\n")
    assert ingest.load_orders(spark, stripe, preset="Stripe").preset == "stripe"
    own = csv(tmp_path, "buyer,day,price\nk7,2022-03-09,19\n", "own.csv")
    got = ingest.load_orders(spark, own, mapping={"customer_id": "buyer", "order_date": "day", "amount": "price"})
    assert got.preset == "custom" and got.orders.first().customer_id == "k7"
    unknown = csv(tmp_path, "left,right\n3,4\n", "unknown.csv")
    with pytest.raises(IngestError, match="Could not map"):
        ingest.load_orders(spark, unknown)
    for preset, said in (("ledger", "Unknown preset"), ("generic", "not present")):
        with pytest.raises(IngestError, match=said):
            ingest.load_orders(spark, own, preset=preset)
    with pytest.raises(FileNotFoundError):
        ingest.load_orders(spark, str(tmp_path / "nowhere.csv"))


def test_each_row_is_left_out_for_its_first_reason(spark, tmp_path):
    text = "customer_id,order_date,amount\nu1,2021-04-03,4\nu2,soon,5\nu3,2021-04-04,-1\nu4,2021-04-04,0\nu5,2021-04-04,n/a\n  ,2021-04-04,6\nnan,soon,\n"
    got = ingest.load_orders(spark, csv(tmp_path, text))
    assert got.dropped == {"blank_customer": 2, "bad_date": 1, "bad_amount": 1, "nonpositive_amount": 2}
    assert [r.customer_id for r in got.orders.collect()] == ["u1"]
    kept = ingest.load_orders(spark, csv(tmp_path, text), drop_nonpositive=False)
    assert "nonpositive_amount" not in kept.dropped and kept.rows_out == 3
    with pytest.raises(IngestError, match="No valid order rows"):
        ingest.load_orders(spark, csv(tmp_path, "customer_id,order_date,amount\nu1,soon,3\n", "none.csv"))


def test_dates(spark):
    texts = ["2024-01-01T10:00:00+02:00", "2024-03-05", "03/04/2024", "20240102", "12345", "1704067200", "not-a-date", "2024-01-01 10:00:00 UTC", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.d for r in rows.select("i", parsed_timestamp(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [datetime(2024, 1, 1, 10), datetime(2024, 3, 5), datetime(2024, 3, 4), datetime(2024, 1, 2), None, None, None, datetime(2024, 1, 1, 10), None]
    assert rows.where("i = 2").select(parsed_timestamp(F.col("t"), day_first=True).alias("d")).first().d == datetime(2024, 4, 3)


def test_map_argument():
    assert ingest.parse_map_arg(" amount = Sum paid ,date=When,customer=Client no.,,") == {"customer_id": "Client no.", "order_date": "When", "amount": "Sum paid"}
    with pytest.raises(IngestError, match="Unknown --map key"):
        ingest.parse_map_arg("warehouse=Depot 4")
    with pytest.raises(IngestError, match="Bad --map entry"):
        ingest.parse_map_arg("date=When,amount")
