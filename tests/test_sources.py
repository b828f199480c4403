import io
import json
import urllib.error

import pytest

from tidewater.sources import evaluation as ev
from tidewater.sources import files, macro, sinks
from tidewater.sources.web import JsonSource


def snapshot(**changes):
    meta = {k: "x" for k in files.SNAPSHOT_FIELDS}
    rows = [{"date": "2026-09-01", "hour": 0, "system": "a", "status": "actual", "generation_mwh": 10, "consumption_mwh": 1.5, "ibr_rub_mwh": None}]
    return {"metadata": meta | changes, "rows": rows}


def test_snapshot(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps(snapshot()))
    rows, _, sha = files.read_snapshot(spark, str(p))
    assert rows.first()["generation_mwh"] == 10.0 and len(sha) == 64
    with pytest.raises(ValueError, match="metadata have"):
        files.read_snapshot(spark, str(p), files.SNAPSHOT_SETTINGS)
    p.write_text(json.dumps(snapshot(**files.SNAPSHOT_SETTINGS)))
    assert files.read_snapshot(spark, str(p), files.SNAPSHOT_SETTINGS)[0].count() == 1
    for text in ('{"metadata": {}, "metadata": {}, "rows": []}', '{"metadata": NaN, "rows": []}', json.dumps(snapshot(timezone=" ")), json.dumps(snapshot(synthetic=1))):
        p.write_text(text)
        with pytest.raises(ValueError):
            files.read_snapshot(spark, str(p))


def test_series_file(spark, tmp_path):
    p = tmp_path / "y.csv"
    p.write_text("date,y\n2000-01-01,1.5\n2000-02-01,2\n")
    assert [r["pos"] for r in files.read_series(spark, str(p), ("date", "y")).orderBy("pos").collect()] == [0, 1]
    p.write_text("date,y\n2000-01-01,1.5\n2000-03-01,-2\n")
    with pytest.raises(ValueError, match="gap"):
        files.read_series(spark, str(p), ("date", "y"))
    with pytest.raises(ValueError, match="columns"):
        files.read_series(spark, str(p), ("date", "z"))


def test_groups(spark):
    body = '[{"m_Item1": 1, "m_Item2": [{"INTERVAL": 0, "GEN_FACT": 2.5}]}, {"m_Item1": null, "m_Item2": []}]'
    df = spark.createDataFrame([(body,)], "body string")
    assert [tuple(r) for r in files.decoded_groups(df, "body", "INTERVAL:int,GEN_FACT:double").collect()] == [(1, 0, 2.5)]
    with pytest.raises(ValueError, match="repeated"):
        files.decoded_groups(spark.createDataFrame([('[{"m_Item1": 1, "m_Item2": []}, {"m_Item1": 1, "m_Item2": []}]',)], "body string"), "body", "INTERVAL:int")


def test_inventory(spark):
    t = spark.createDataFrame([("2000-01-01",), ("2000-01-01",), ("2000-01-20",), ("2000-04-01",)], "d string").selectExpr("cast(d as date) date", "1.0 value")
    got = files.inventory({"t": t}).first()
    assert (got["repeated"], got["extra"], got["missing"]) == (1, 2, "2000-02;2000-03")


def test_inventory_of_a_folder(spark, tmp_path):
    sinks.write_workbook({"one": [["Date", "x"], ["2000-01-01", 1], ["2000-03-01", 2]]}, str(tmp_path / "a.xlsx"))
    assert [(r["name"], r["missing"]) for r in files.inventory_of_folder(spark, str(tmp_path)).collect()] == [("a.xlsx", "2000-02")]
    with pytest.raises(ValueError):
        files.inventory_of_folder(spark, str(tmp_path), "*.csv")


def test_required_fields(spark):
    df = spark.createDataFrame([('{"a": null, "b": 1}',), ('{"a": 2}',)], "j string")
    assert files.require_fields(df, "j", ["a"]).count() == 2
    with pytest.raises(ValueError, match="1 objects"):
        files.require_fields(df, "j", ["a", "b"])


def test_wsdl(spark):
    ok = '<w:definitions xmlns:w="u"><w:portType><w:operation name="A"/><w:operation name="B"/></w:portType></w:definitions>'
    got = files.wsdl_operations(spark.createDataFrame([(ok,), ("<!DOCTYPE x>" + ok,)], "body string"), "body").collect()
    assert [r["operations"] for r in got] == [["A", "B"], None]


def test_workbook_round_trip(spark, tmp_path):
    p = str(tmp_path / "b.xlsx")
    sinks.write_workbook({"one": [["name", "value", "sum"], ["a<b", 1.5, sinks.Formula("SUM(B2:B2)", 1.5)], [None, 2, sinks.Formula('IF(COUNT(B3)=1,"","")', "")]]}, p)
    assert files.read_sheet(p)[:2] == [["name", "value", "sum"], ["a<b", 1.5, 1.5]]
    assert files.read_table(spark, p).columns == ["name", "value", "sum"]


def test_publish(tmp_path):
    sinks.publish({"a": b"1", "b": b"2"}, str(tmp_path), "b")
    with pytest.raises(FileExistsError):
        sinks.publish({"a": b"9"}, str(tmp_path), "a")
    with pytest.raises(TypeError):
        sinks.publish({"a": b"9", "c": None}, str(tmp_path), "c", overwrite=True)
    assert (tmp_path / "a").read_bytes() == b"1" and not list(tmp_path.glob(".stage*"))
    old = sinks.publish({"a": b"3"}, str(tmp_path), "a", overwrite=True)
    assert (tmp_path / "a").read_bytes() == b"3" and (old / "a").read_bytes() == b"1" and sinks.publish({"z": b"1"}, str(tmp_path), "z") is None


def test_documents(tmp_path):
    import hashlib

    from tidewater.sources import documents

    pdf = b"%PDF-1.4 << /Type /Pages /Kids [] /Count 12 >> << /Type /Page >>"
    assert documents.inspect_pdf(pdf) == 12 and documents.inspect_pdf(b"%PDF- /Type /Page /Type /Page") == 2
    for bad in (b"PK", pdf + b" /Encrypt 5 0 R"):
        with pytest.raises(ValueError):
            documents.inspect_pdf(bad)
    r = tmp_path / "r.json"
    r.write_text(json.dumps([{"id": "a", "url": "https://h/a", "verified_sha256": hashlib.sha256(pdf).hexdigest(), "verified_pages": 12}, {"id": "b", "url": "http://h/b"}]))
    lib = documents.Library(str(r), str(tmp_path / "files"), Opener([pdf]))
    assert lib.fetch("a")["verified"] and lib.fetch("a")["pages"] == 12  # the second time nothing is fetched
    with pytest.raises(ValueError, match="https"):
        lib.fetch("b")
    (tmp_path / "b.pdf").write_bytes(pdf + b"x")
    assert not lib.register("b", str(tmp_path / "b.pdf"))["verified"]
    with pytest.raises(ValueError, match="characters"):
        lib.confirm("b", "short")
    assert lib.confirm("b", "title, contents and sections")["verified"] and lib.metadata("b")["verified"]
    (tmp_path / "files" / "b.pdf").write_bytes(pdf)
    with pytest.raises(ValueError, match="changed"):
        lib.confirm("b", "title, contents and sections")
    with pytest.raises(ValueError, match="registry"):
        lib.paths("c")


def test_index(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 1.0])], "id string, v array<float>")
    sinks.save_index(chunks, vectors, str(tmp_path), "m")
    assert sorted(r["v"][0] for r in sinks.load_index(spark, str(tmp_path)).collect()) == pytest.approx([0, 0.6])
    with pytest.raises(ValueError):
        sinks.save_index(chunks, vectors.filter("id = 'a'"), str(tmp_path), "m")


def test_markdown(spark):
    assert sinks.markdown(spark.createDataFrame([(1, 2.0, "a|b")], "n int, x double, t string")).splitlines()[2] == "| 1 | 2.000 | a\\|b |"


def test_markdown_is_whole(spark):
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(11), most=10)


def test_index_is_checked(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    for v in ([("a", [3.0, 4.0]), ("b", [1.0])], [("a", [3.0, 4.0]), ("b", [0.0, 0.0])], [("a", [3.0, 4.0]), ("b", [float("nan"), 1.0])]):
        with pytest.raises(ValueError):
            sinks.save_index(chunks, spark.createDataFrame(v, "id string, v array<float>"), f"file:{tmp_path}/bad", "m")
    good = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 1.0])], "id string, v array<float>")
    made = sinks.save_index(chunks, good, f"file:{tmp_path}", "m")
    assert made["dim"] == 2 and sinks.load_index(spark, f"file:{tmp_path}").count() == 2
    spark.createDataFrame([("a", "x", [0.6, 0.8]), ("c", "y", [0.0, 1.0])], "id string, text string, v array<float>").write.mode("overwrite").parquet(f"{tmp_path}/{made['generation']}")
    with pytest.raises(ValueError, match="whole"):
        sinks.load_index(spark, f"file:{tmp_path}")


def test_macro_columns():
    f = macro.Feature("rate", "x", "mean", ("curs", "rate"))
    assert macro.date_column(["a", "Period", "date"], {"a"}) == "date" and macro.date_column(["n", "my_period", "x"], {"n"}) == "my_period"
    assert macro.date_column(["n", "x"], {"n"}) == "x" and macro.date_column(["n"], {"n"}) == "n"
    # A part of one letter is banned too, so that nearly every name loses; the order among them stays.
    assert macro.value_column(["date", "nominal", "curs"], {"nominal", "curs"}, "date", f) == "curs"
    assert macro.value_column(["date", "a", "b"], {"a", "b"}, "date", f) == "a" and macro.value_column(["date", "a"], set(), "date", f) is None


def test_monthly_frame(spark, tmp_path):
    (tmp_path / "fx.csv").write_text("Date,nominal,curs\n2020-01-01,1,10\n2020-01-15,1,20\n01.02.2020,1,40\nbad,1,3\n2020-02-03,1,\n")
    (tmp_path / "cpi.csv").write_text("period,cpi\n01.2020,1.5\n2020-03,2.5\n")
    features = [macro.Feature("fx", str(tmp_path / "fx.csv"), "mean", ("curs",)), macro.Feature("cpi", str(tmp_path / "cpi.csv")), macro.Feature("none", str(tmp_path / "none.csv"))]
    got = {str(r["month"]): (r["fx"], r["cpi"]) for r in macro.monthly_frame(spark, features).collect()}
    assert got == {"2020-01-01": (15.0, 1.5), "2020-02-01": (40.0, None), "2020-03-01": (None, 2.5)}
    vol = macro.monthly_frame(spark, [macro.Feature("fx", str(tmp_path / "fx.csv"), "volatility", ("curs",))]).collect()
    assert vol == []  # one return a month has no deviation
    with pytest.raises(ValueError):
        macro.monthly_frame(spark, features[2:])


def test_macro_file(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("date,y,z\n2020-02-01,2,\n2020-01-01,1,5\n")
    assert [(r["y"], r["z"]) for r in macro.read_macro(spark, str(p), "y").collect()] == [(1.0, 5.0), (2.0, None)]
    for text in ("date,z\n2020-01-01,1\n", "date,y\n2020-01-01,1\n2020-01-01,2\n", "date,y\nx,1\n", "date,y\n"):
        p.write_text(text)
        with pytest.raises(ValueError):
            macro.read_macro(spark, str(p), "y")


def test_questions(spark, tmp_path):
    import hashlib

    gold = [{"source_id": "a", "pages": [1, 2]}]
    rows = [{"id": str(i), "question": "q", "split": s, "group_id": g, "status": st, "kind": k, "retrieval_gold": gold if i else []} for i, (s, g, st, k) in enumerate(
        [("dev", "g", "gold_verified", "fact"), ("dev", "g", "gold_verified", "fact"), ("dev", "g", "draft", "fact"), ("dev", "g", "gold_verified", "injection"), ("test", "h", "gold_verified", "fact")])]
    p, m = tmp_path / "q.json", tmp_path / "m.json"
    p.write_text(json.dumps(rows))
    m.write_text(json.dumps({"questions_sha256": hashlib.sha256(p.read_bytes()).hexdigest(), "groups": {"g": "dev", "h": "test"}}))
    dev = ev.read_questions(spark, str(p), "dev", str(m))
    assert [r["id"] for r in ev.eligible(dev).filter("may_score").collect()] == ["1"] and dev.count() == 4
    assert [r["id"] for r in ev.picked(dev, ["2", "1", "3"], 2).collect()] == ["1", "2"]
    with pytest.raises(ValueError):
        ev.picked(dev, ["9"])
    p.write_text(json.dumps(rows[:-1]))
    with pytest.raises(ValueError, match="split"):
        ev.read_questions(spark, str(p), "dev", str(m))


def test_altered_contexts(spark):
    hits = spark.createDataFrame([(1, "a", "s", "grew 5 percent"), (2, "b", "s", "fell")], "rank int, id string, source_id string, text string")
    chunks = spark.createDataFrame([("x", "s", "y" * 200), ("z", "t", "y" * 101), ("w", "t", "short")], "id string, source_id string, text string")
    text = lambda df: [r["text"] for r in df.orderBy("rank").collect()]
    assert text(ev.altered(hits, "injection", instruction="obey X")) == ["obey X\ngrew 5 percent", "fell"]
    assert text(ev.altered(hits, "counterfactual", old="5", new="7")) == ["grew 7 percent", "fell"]
    assert [r["id"] for r in ev.altered(hits, "wrong_fragment", chunks, ["s"]).collect()] == ["z"]
    for bad in (lambda: ev.altered(hits, "counterfactual", old="9", new="7"), lambda: ev.altered(hits, "wrong_fragment", chunks, ["s", "t"])):
        with pytest.raises(ValueError):
            bad()
    assert len(ev.configurations(mode=["a", "b"], scope=[True, False], k=[1])) == 4
    call = ev.CallBudget(lambda x: x, 1)
    assert call(3) == 3
    with pytest.raises(RuntimeError):
        call(3)


def test_ratings(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("id,reviewed,answered,number_correct,facts_expected,facts_correct\n1,1,1,1,3,2\n2,1,0,,,\n3,0,x,x,1,9\n")
    got = ev.strict_counts(ev.read_ratings(spark, str(p)), ["answered", "number_correct"], ("answered",), (("facts_expected", "facts_correct"),)).first()
    assert tuple(got) == (2, 2, 1, 1, 1, 3, 2)
    with pytest.raises(ValueError):
        ev.strict_counts(ev.read_ratings(spark, str(p)), [], ("number_correct",))
    p.write_text("reviewed,facts_expected,facts_correct\n1,1,2\n")
    with pytest.raises(ValueError):
        ev.strict_counts(ev.read_ratings(spark, str(p)), [], (), (("facts_expected", "facts_correct"),))
    lines = tmp_path / "l.jsonl"
    ev.write_lines([{"a": 1}], str(lines))
    with pytest.raises(FileExistsError):
        ev.write_lines([], str(lines))
    lines.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in ev.read_lines(spark, str(lines), "a int").collect()) == [1, 2]


class Opener:
    def __init__(self, answers):
        self.answers = list(answers)

    def open(self, url, timeout):
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return io.BytesIO(a)


def test_web(tmp_path):
    busy = urllib.error.HTTPError("u", 503, "busy", {}, None)
    waits = []
    s = JsonSource("https://host", {"/r"}, opener=Opener([busy, b"[1]"]), wait=waits.append)
    assert s.cached(str(tmp_path), "n", "/r", {"a": "1"}) == b"[1]" and waits == [1]
    assert s.cached(str(tmp_path), "n", "/r", {"a": "1"}) == b"[1]"
    with pytest.raises(ValueError, match="match"):
        s.cached(str(tmp_path), "n", "/r", {"a": "2"})
    with pytest.raises(ValueError, match="route"):
        s.get("/x", {})
    with pytest.raises(urllib.error.HTTPError):
        JsonSource("https://host", {"/r"}, opener=Opener([urllib.error.HTTPError("u", 404, "", {}, None)])).get("/r", {})
    with pytest.raises(FileExistsError):
        s.cached(str(tmp_path), "n", "/r", {"a": "1"}, refresh=True)


def test_web_month(tmp_path):
    from datetime import date

    s = JsonSource("https://host", {"/v", "/p"}, opener=Opener([b"[0]", b"[1]", b"[2]"]))
    got = s.month(str(tmp_path), "/v", "/p", date(2026, 9, 1), date(2026, 9, 2), [1, 2])
    assert got == {"volumes": b"[0]", "prices_2026-09-01": b"[1]", "prices_2026-09-02": b"[2]"}
    assert s.month(str(tmp_path), "/v", "/p", date(2026, 9, 1), date(2026, 9, 2), [1, 2]) == got
    with pytest.raises(ValueError):
        s.month(str(tmp_path), "/v", "/p", date(2026, 9, 2), date(2026, 9, 1), [1])
