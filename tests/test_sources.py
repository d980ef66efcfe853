import pytest

from statwright.api import Tools
from statwright.sources import layout, pages
from statwright.store import Store


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))


def test_roles_prefer_exact_names_and_leave_balances():
    roles = layout.roles_of(["Posting Date", "Transaction Date", "Narrative", "Amount", "Running Balance", "DR/CR"])
    assert roles == {"date": "Transaction Date", "description": "Narrative", "amount": "Amount", "type": "DR/CR"}
    assert layout.roles_of(["Date", "Details", "Withdrawal"])["amount"] == "Withdrawal"


def test_account_names():
    assert [layout.account_of(x) for x in ("acme_checking_2026q1", "gold-card-2026-03", "Savings 2", "2026")] == ["Acme Checking", "Gold Card", "Savings 2", "2026"]


def test_preamble_delimiters_and_encodings():
    one, _ = layout.layout_of("Account;1\nOwner;x\n\nBuchungstag;Verwendungszweck;Betrag;Währung\n01.02.2024;Bäcker;-1,50;EUR\n".encode("cp1252"))
    assert (one.delimiter, one.header_row, one.encoding) == (";", 3, "cp1252")
    with pytest.raises(layout.LayoutError):
        layout.layout_of(b"a,b\n1,2\n")


@pytest.fixture
def tools(spark, tmp_path):
    return Tools(Store(spark, str(tmp_path / "store")), tmp_path / "categories.yaml")


def test_import_end_to_end(tools, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head = "Date,Description,Amount\n"
    write(folder, "card_2026q1.csv", head + "2026-01-05,COFFEE A,-4.50\n2026-01-05,COFFEE A,-4.50\n2026-01-20,PAYROLL,1000.00\n2026-02-01,TRIP SAO PAULO BR 12.50 BRL,-2.50\n,,\n2026-02-02,zero,0.00\n")
    write(folder, "card_2026q2.csv", head + "2026-02-01,TRIP SAO PAULO BR 12.50 BRL,-2.50\n2026-03-01,NETFLIX.COM,-15.99\n2026-03-02,odd,n/a\n")
    write(folder, "uk.csv", "Date,Description,Paid Out,Paid In,Balance\n31/01/2026,Tesco,\"1,250.00\",,10\n01/02/2026,Refund,,5.00,15\n")
    write(folder, "broken.csv", head + "never,x,1\n")
    got = tools.import_statements(str(folder))
    by = {r["file"]: r for r in got["imported"]}
    assert (by["card_2026q1.csv"]["rows_read"], by["card_2026q1.csv"]["rows_inserted"]) == (5, 4)
    assert by["card_2026q2.csv"]["rows_inserted"] == 1 and by["card_2026q2.csv"]["error_count"] == 1
    assert by["uk.csv"]["account"] == "Uk" and by["uk.csv"]["rows_inserted"] == 2
    assert by["broken.csv"]["error_count"] == 1
    view = tools.overview()
    assert view["transaction_count"] == 7 and view["total_out"] == round(4.5 * 2 + 2.5 + 15.99 + 1250, 2) and view["total_in"] == 1005.0
    again = tools.import_statements(str(folder))
    assert again["total_inserted"] == 0 and tools.overview()["transaction_count"] == 7
    assert tools.import_statements(str(folder), force=True)["total_inserted"] == 0
    assert tools.spending_by_country()["countries"][0]["country"] == "Home country"
    (tmp_path / "categories.yaml").write_text("categories:\n  - category: Brew\n    match: ['^coffee']\n")
    assert tools.apply_category_rules()["changed"] == 2
    assert tools.spending_by_merchant(category="Brew")["merchants"][0]["transactions"] == 2
    assert tools.import_statements(str(tmp_path / "none")).keys() == {"error"}


LINES = [
    ("Payments and Credits", 20, 200), ("Summary", 20, 200), ("Total Payments and Credits -$40.00", 20, 590), ("Detail", 20, 100),
    ("01/05/26* PAYMENT RECEIVED -$40.00", 20, 590), ("New Charges", 20, 200), ("Total New Charges $30.00", 20, 590), ("Detail", 20, 100),
    ("01/06/26 COFFEE PLACE $12.00", 20, 590), ("OAKLAND", 60, 120), ("555-123-4567", 60, 140), ("01/07/26 HOTEL X $20.00", 20, 590), ("100.00 BRL", 60, 120),
    ("01/08/26 REFUND SHOP -$2.00", 20, 590), ("Continued on next page", 400, 590), ("Year-to-Date Summary", 20, 300), ("01/09/26 NOT A ROW $9.00", 20, 590),
]


def test_statement_pages(spark):
    lines = spark.createDataFrame([("s", 0, t, float(a), float(b), float(k)) for k, (t, a, b) in enumerate(LINES)], "file string, page int, text string, x0 double, x1 double, top double")
    rows = pages.directed(pages.rows_of(lines))
    got = [(r["date"], r["description"], float(r["signed"]), r["detail"]) for r in rows.orderBy("row").collect()]
    assert got == [("01/05/26", "PAYMENT RECEIVED", 40.0, ""), ("01/06/26", "COFFEE PLACE OAKLAND", -12.0, ""), ("01/07/26", "HOTEL X", -20.0, "100.00 BRL"), ("01/08/26", "REFUND SHOP", 2.0, "")]
    assert pages.kinds(rows).first()["kind"] == "credit_card"
    checks = {r["bucket"]: (r["printed"], r["extracted"], r["ok"]) for r in pages.reconciled(lines, rows).collect()}
    assert [float(x) for x in checks["out"][:2]] == [30.0, 32.0] and checks["out"][2] is False
    assert [float(x) for x in checks["in"][:2]] == [40.0, 42.0]


def test_import_of_pdf_files(spark, tools, tmp_path, monkeypatch):
    folder = tmp_path / "pdf"
    folder.mkdir()
    for name in ("card.pdf", "grid.PDF", "plain.pdf", "empty.pdf", "words.pdf"):
        (folder / name).write_bytes(name.encode())
    got = tools.import_statements(str(folder))["imported"]
    assert len(got) == 5 and all(r["error_count"] == 1 and not r["rows_read"] for r in got)  # no such library, or no PDF
    printed = [(0, t, float(a), float(b), float(k)) for k, (t, a, b) in enumerate(LINES)]
    grids = [[["Account", "1"]], [["", "", ""], ["Date", "Description", "Amount"], ["2026-03-01", "RENT", "-700.00"], [None, "", ""]], [["Date", "Description", "Amount"], ["2026-03-02", "PAY", "900.00"]]]

    def fake(content, password=None):
        plain = [(0, "02/01/26 BOOK SHOP -$5.00", 20.0, 590.0, 1.0), (0, "02/02/26 PAYROLL $50.00", 20.0, 590.0, 2.0)]
        return {b"card.pdf": ([], printed), b"grid.PDF": (grids, printed), b"plain.pdf": ([], plain), b"words.pdf": ([], [(0, "hello", 1.0, 2.0, 3.0)])}.get(content, ([], []))

    monkeypatch.setattr(pages, "read_pdf", fake)
    by = {r["file"]: r for r in tools.import_statements(str(folder))["imported"]}
    assert [(c["bucket"], c["printed"], c["ok"]) for c in by["card.pdf"]["reconciliation"]] == [("in", 40.0, False), ("out", 30.0, False)] and by["plain.pdf"]["reconciliation"] == []
    assert {f: (r["rows_inserted"], r["error_count"]) for f, r in by.items()} == {"card.pdf": (4, 0), "grid.PDF": (2, 0), "plain.pdf": (2, 0), "empty.pdf": (0, 1), "words.pdf": (0, 1)}
    rows = {(r["source_file"], r["source_row"]): (str(r["posted_on"]), r["raw_description"], r["amount_cents"], r["original_currency"]) for r in tools.store.ledger().collect()}
    assert rows["card.pdf", 2] == ("2026-01-05", "PAYMENT RECEIVED", 4000, None) and rows["card.pdf", 5] == ("2026-01-08", "REFUND SHOP", 200, None)
    assert rows["card.pdf", 4] == ("2026-01-07", "HOTEL X", -2000, "BRL") and rows["card.pdf", 3][1:3] == ("COFFEE PLACE OAKLAND", -1200)
    assert rows["grid.PDF", 2][1:3] == ("RENT", -70000) and rows["grid.PDF", 3][1:3] == ("PAY", 90000)
    assert rows["plain.pdf", 2][2] == -500 and rows["plain.pdf", 3][2] == 5000


def test_watched_folder(spark, tmp_path):
    from statwright.streaming.folder import watch

    folder = tmp_path / "drop"
    folder.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    write(folder, "a.csv", "Date,Description,Amount\n2026-01-05,COFFEE,-4.50\n")
    watch(spark, str(folder), store, str(tmp_path / "cp")).awaitTermination(120)
    write(folder, "b.csv", "Date,Description,Amount\n2026-01-06,TEA,-3.50\n")
    watch(spark, str(folder), store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.ledger().count() == 2


def test_a_commit_that_stops_halfway_leaves_the_old_version(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    write(folder, "a.csv", "Date,Description,Amount\n2026-01-05,COFFEE,-4.50\n")
    store.import_path(str(folder))
    with monkeypatch.context() as patch:
        patch.setattr("statwright.store.json.dumps", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            store.commit(ledger=store.ledger())
    assert (store.version(), store.ledger().count(), store.log().count()) == (1, 1, 1)
    store.commit(ledger=store.ledger())
    assert (store.version(), store.ledger().count(), store.log().count()) == (2, 2, 1)


def test_imports_add_folders_and_join_many(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    monkeypatch.setattr("statwright.store.FOLDERS", 2)
    write(folder, "f.csv", "Date,Description,Amount\n2026-01-01,TEA,-1.50\n")
    got = store.import_path(str(folder))[0]
    assert got["plan"]["layout"]["roles"]["amount"] == "Amount" and got["plan"]["date_format"] == "%Y-%m-%d" and got["plan"]["sign_mode"]
    first = store.folders()
    store.commit(accounts=spark.createDataFrame([("B", "USD")], "account string, currency string"))
    assert len(store.folders()["accounts"]) == 2 and store.folders()["accounts"][0] == first["accounts"][0] and store.folders()["ledger"] == first["ledger"]
    store.commit(accounts=spark.createDataFrame([("C", "USD")], "account string, currency string"))
    assert len(store.folders()["accounts"]) == 1 and sorted(r["account"] for r in store.accounts().collect()) == ["B", "C", "F"]
    store.commit(log=store.log())
    assert store.log().count() == 1 and store.log().where("layout IS NULL").count() == 0


def test_rules_that_the_engine_cannot_read_are_left_out(spark):
    from statwright.functions.categories import rules_from

    found = rules_from({"categories": [{"category": "A", "match": ["(?P<x>a)", "(", "b+"]}]})
    assert [r.pattern for r in found] == ["b+"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import statwright.__main__ as cli

    monkeypatch.setenv("STATWRIGHT_HOME", str(tmp_path / "home"))
    monkeypatch.setattr("statwright.session.local_session", lambda *a, **k: spark)
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "card.csv", "Date,Description,Amount\n" + "".join(f"2026-0{k}-05,NETFLIX.COM,-15.99\n2026-0{k}-07,ODD SHOP {k},-{k}.00\n" for k in range(1, 7)))
    assert cli.main(["import", str(tmp_path / "none")]) == 1 and cli.main(["import", str(folder)]) == 0
    assert "12 imported, 0 skipped" in capsys.readouterr().out
    assert cli.main(["status"]) == 0 and '"transaction_count": 12' in capsys.readouterr().out
    assert cli.main(["subscriptions", "--as-of", "2026-06-20"]) == 0 and "monthly" in capsys.readouterr().out
    assert cli.main(["categories", "--limit", "3"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_trip_and_fee_tools(tools, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head = "Date,Description,Amount\n"
    body = "".join(f"2026-09-{12 + k},PLACE {k} SAO PAULO BR {10 + k}.00 BRL,-{4 + k}.00\n2026-09-{13 + k},FOREIGN TRANSACTION FEE,-0.{11 + 2 * k}\n" for k in range(5))
    write(folder, "card.csv", head + body + "2026-09-15,TOUR SHOP SAO PAULO BR,-8.00\n2026-11-02,HOME STORE,-3.00\n")
    assert tools.import_statements(str(folder))["total_inserted"] == 12
    got = tools.find_trips()
    assert got["count"] == 1 and got["trips"][0]["start"] == "2026-09-12" and got["trips"][0]["countries"] == ["Brazil"]
    costs = tools.foreign_transaction_costs()
    assert costs["fee_count"] == 5 and costs["by_currency"]["BRL"]["transactions"] == 5 and costs["suspected_conversion_count"] <= 1
    assert tools.monthly_summary()["months"][0]["month"] == "2026-11" and tools.get_transactions(merchant="home")["total_matching"] == 1
    assert tools.spending_by_category()["total_spent"] == tools.overview()["total_out"]
    assert tools.compare_periods("2026-09-01", "2026-09-30", "2026-11-01", "2026-11-30")["period_b"]["total"] == 3.0
    assert tools.find_subscriptions(as_of="2026-12-01")["count"] == 0 and tools.suggest_category_rules()["returned"] >= 1
