import csv

import pytest

from tallywick import cli, report
from tallywick.operators import clv, cohorts, lists, quality, segments
from tallywick.sources import ingest, sample, sinks
from tallywick.sources.sample import generate_orders, write_sample


@pytest.fixture(scope="module")
def sample_file(spark, tmp_path_factory):
    return write_sample(spark, str(tmp_path_factory.mktemp("sample") / "orders.csv"), n_customers=120, seed=11)


def test_report_command(spark, sample_file, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main(["report", sample_file, "-o", str(out), "--store", "<script>x</script>", "--clv-method", "heuristic"]) == 0
    page = (out / "report.html").read_text(encoding="utf-8")
    for title in ("Overview", "RFM segments", "Monthly retention cohorts", "Customer lifetime value", "Customer action lists", "Marketing playbook"):
        assert f"<h2>{title}</h2>" in page
    assert "<script" not in page and "&lt;script&gt;" in page and "http" not in page
    said = capsys.readouterr().out
    assert "columns (auto)" in said and f"report -> {out / 'report.html'}" in said
    with open(out / "customers.csv", encoding="utf-8") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == lists.LIST_COLUMNS and len(rows) == 120
    with open(out / "churn_risk.csv", encoding="utf-8") as f:
        values = [float(r["predicted_clv"]) for r in csv.DictReader(f)]
    assert values == sorted(values, reverse=True)


def test_other_commands(spark, sample_file, tmp_path, capsys):
    assert cli.main(["segments", sample_file]) == 0
    assert "Champions" in capsys.readouterr().out
    assert cli.main(["cohort", sample_file]) == 0
    assert "monthly cohorts" in capsys.readouterr().out
    made = tmp_path / "s.csv"
    assert cli.main(["sample", "-o", str(made), "--customers", "10"]) == 0 and made.exists()
    p = tmp_path / "m.csv"
    p.write_text("buyer,day,price\nk7,2022-03-09,19\nk8,2022-05-01,4\nk7,2022-06-30,2\n")
    assert cli.main(["segments", str(p), "--map", "customer=buyer,date=day,amount=price"]) == 0


def test_sample_without_a_path_says_where_it_is(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(sample, "sample_path", lambda n, seed: str(tmp_path / "kept" / f"{n}.csv"))
    for _ in range(2):  # made once, found again
        assert cli.main(["sample", "--customers", "8"]) == 0
        path = tmp_path / "kept" / "8.csv"
        assert str(path) in capsys.readouterr().out and path.exists()


def test_errors_exit_with_2(spark, tmp_path, capsys):
    assert cli.main(["segments", str(tmp_path / "none.csv")]) == 2
    p = tmp_path / "bad.csv"
    p.write_text("foo,bar\n1,2\n")
    assert cli.main(["segments", str(p)]) == 2
    assert cli.main(["segments", str(p), "--map", "foo"]) == 2
    assert "error:" in capsys.readouterr().err


def test_pieces_of_the_page(spark):
    assert report.shade(None) == "#ffffff" and report.shade(2.0) == report.shade(1.0) != report.shade(0.0)
    assert report.line_chart([(0, 1.0)]) == "" and "polyline" in report.line_chart([(0, 1.0), (1, 0.5)])
    assert "No customer" in report.bar_chart([])
    rows = spark.createDataFrame([("a", "2024-01-01", 5.0)], "customer_id string, order_date string, amount double")
    res = ingest.from_frame(rows)
    rfm, value = segments.compute_rfm(res.orders), clv.compute_clv(res.orders)
    inputs = report.ReportInputs(res, quality.check_orders(res.orders), rfm, cohorts.compute_cohorts(res.orders), value, lists.build_customer_lists(rfm, value))
    assert "Your store" in report.render_html(inputs)


def test_sinks(spark, tmp_path):
    df = generate_orders(spark, 20)
    sinks.export_table(df, str(tmp_path / "t"), "parquet")
    assert spark.read.parquet(str(tmp_path / "t")).count() == df.count()
    with pytest.raises(ValueError):
        sinks.export_table(df, str(tmp_path / "x"), "excel")
