import io
import json
import os
import sqlite3
import zipfile

import pytest

from tidemark import cli
from tidemark.plans.suggest import write_metrics
from tidemark.plans.findings import DiffResult
from tidemark.sinks import narrative
from tidemark.sources.files import SqliteSource
from tidemark.sources.tables import LoadError, jdbc, jdbc_options, load, masked
from tidemark.streaming.watch import compare_stream, watch

ROWS = [(1, "a", 1.5), (2, "b", None)]


def values(df):
    return sorted(tuple(r) for r in df.collect())


def sheet(path):
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t> k </t></si><si><t>s</t></si><si><t>x</t></si><si><t>a</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row><row><c r="A2"><v>1</v></c><c r="B2" t="s"><v>3</v></c><c r="C2"><v>1.5</v></c></row><row><c r="A3"><v>2</v></c><c r="B3" t="inlineStr"><is><t>b</t></is></c></row></sheetData></worksheet>')


def test_formats(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k;s;x\n1;a;1.5\n2;b;\n")
    (tmp_path / "t.json").write_text('[{"k": 1, "s": "a", "x": 1.5}, {"k": 2, "s": "b", "x": null}]')
    (tmp_path / "lines.json").write_text('{"k": 1, "s": "a", "x": 1.5}\n{"k": 2, "s": "b"}\n')
    sheet(tmp_path / "t.xlsx")
    with sqlite3.connect(tmp_path / "t.db") as db:
        db.execute("CREATE TABLE zz (a)")
        db.execute("CREATE TABLE aa (k INTEGER, s TEXT, x REAL)")
        db.executemany("INSERT INTO aa VALUES (?, ?, ?)", ROWS)
    spark.createDataFrame([(1, "a", 1.5), (2, "b", float("nan"))], "k bigint, s string, x double").write.parquet(str(tmp_path / "t.parquet"))
    for name in ("t.csv", "t.json", "lines.json", "t.xlsx", "t.db", "t.parquet"):
        df = load(spark, str(tmp_path / name))
        assert [f"{c} {t}" for c, t in df.dtypes] == ["k bigint", "s string", "x double"], name
        assert df.where("x IS NULL").count() == 1 and df.count() == 2, name
    assert values(load(spark, f"sqlite:///{tmp_path}/t.db::aa")) == values(load(spark, str(tmp_path / "t.db")))


def test_errors(spark, tmp_path):
    (tmp_path / "t.avro").write_text("")
    with pytest.raises(LoadError):
        load(spark, str(tmp_path / "t.avro"))
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none.csv"))
    with pytest.raises(LoadError):
        load(spark, "postgresql://u:p@h/db")
    assert "p@ss" not in masked("postgresql://u:p@ss@h/db") and masked("postgresql://h/db") == "postgresql://h/db"
    assert jdbc_options("mysql+pymysql://u:pw@h:3306/db::s.t") == {"dbtable": "`s.t`", "url": "jdbc:mysql://h:3306/db", "user": "u", "password": "pw"}
    decoded = jdbc_options('mssql://us%40er:p%40ss%2Fw@h/db::my "t"')
    assert decoded == {"dbtable": '"my ""t"""', "url": "jdbc:sqlserver://h;databaseName=db", "user": "us@er", "password": "p@ss/w"}


def test_databases_are_read_in_ranges(spark, tmp_path):
    derby = {"url": f"jdbc:derby:{tmp_path}/derby;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark._jvm.java.lang.Class.forName(derby["driver"])
    except Exception:
        pytest.skip("no database driver here")
    spark.range(1000).selectExpr("id AS k", "id % 7 AS v").write.format("jdbc").options(**derby, dbtable="T").save()
    whole, split = jdbc(spark, derby | {"dbtable": "T"}), jdbc(spark, derby | {"dbtable": "T"}, split_by="k", parts=4)
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() == 4
    assert values(whole) == values(split) and whole.count() == 1000
    assert jdbc(spark, derby | {"dbtable": "T"}, split_by="v", parts=3).count() == 1000


def test_sqlite_in_parts(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (k INTEGER, x, s)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, k if k % 2 else k / 2, None if k % 3 else f"v{k}") for k in range(1000)])
        db.execute("CREATE TABLE u (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
        db.execute("INSERT INTO u VALUES ('a', 1)")
        db.execute("CREATE TABLE e (k INTEGER)")
    spark.dataSource.register(SqliteSource)
    read = lambda table: spark.read.format("tidemark_sqlite").option("path", path).option("table", table).option("rows", "300").load()
    assert read("t").rdd.getNumPartitions() == 4 and read("t").dtypes == [("k", "bigint"), ("x", "double"), ("s", "string")]
    assert values(read("t").select("k", "x")) == [(k, float(k if k % 2 else k / 2)) for k in range(1000)]
    assert values(read("u")) == [("a", 1)] and read("e").count() == 0


def test_csv_is_split_unless_values_hold_line_breaks(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("k,s\n" + "".join(f'{k},"a, b"\n' for k in range(20_000)))
    (tmp_path / "broken.csv").write_text('k,s\n1,"a\nb"\n2,"c ""d"""\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        plain = load(spark, str(tmp_path / "plain.csv"))
        assert plain.rdd.getNumPartitions() > 1 and plain.count() == 20_000
        assert load(spark, str(tmp_path / "plain.csv"), multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert values(load(spark, str(tmp_path / "broken.csv"))) == [(1, "a\nb"), (2, 'c "d"')]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "b.csv").write_text("k,s\n" + "".join(f"{k},x\n" for k in range(50)))
    (tmp_path / "a.csv").write_text("k,s\n" + "".join(f"{k},x\n" for k in range(20)))
    assert cli.main(["diff", "b.csv", "a.csv", "--json", "-s", "etl", "-e", "out.html"], spark) == 1
    assert json.loads(capsys.readouterr().out)["summary"]["severity"] == "FAIL"
    assert os.path.exists("out.html")
    assert cli.main(["diff", "b.csv", "b.csv", "--story"], spark) == 0
    assert cli.main(["init", "-f", "b.csv", "-b", "shop"], spark) == 0 and os.path.exists("metrics.yaml")
    assert write_metrics(load(spark, "b.csv"), "shop").endswith("metrics_generated.yaml")
    assert write_metrics(load(spark, "b.csv"), "shop", provider=lambda p: "not: [valid").endswith("metrics_draft.yaml")
    assert cli.main(["diff", "none.csv", "a.csv"], spark) == 2
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    capsys.readouterr()
    for name, told in (("openai", "OPENAI_API_KEY is not set"), ("nobody", "no provider 'nobody'")):
        assert cli.main(["diff", "b.csv", "b.csv", "--story", "--llm", name, "--no-metrics"], spark) == 0
        assert told in capsys.readouterr().err
    (tmp_path / "bad.yaml").write_text("- 1")
    assert cli.main(["diff", "b.csv", "b.csv", "-m", "bad.yaml"], spark) == 0 and "metrics are skipped" in capsys.readouterr().err


@pytest.mark.parametrize(("name", "answer"), [("claude", {"content": [{"type": "text", "text": "told"}]}), ("openai", {"choices": [{"message": {"content": "told"}}]}), ("deepseek", {"choices": [{"message": {"content": "told"}}]}), ("gemini", {"candidates": [{"content": {"parts": [{"text": "told"}]}}]})])
def test_services(name, answer, monkeypatch):
    service, sent = narrative.SERVICES[name], []
    monkeypatch.setenv(service.key_variable, "secret-key")

    def open_(request, timeout):
        sent.append(request)
        return io.BytesIO(json.dumps(answer).encode())

    monkeypatch.setattr(narrative, "urlopen", open_)
    result = DiffResult(1, 2, ())
    assert narrative.story(result, provider=name) == "told"
    body = json.loads(sent[0].data)
    assert "secret-key" in str(sent[0].headers) and "row_delta" in json.dumps(body) and "secret-key" not in sent[0].full_url
    monkeypatch.setattr(narrative, "urlopen", lambda *a, **k: (_ for _ in ()).throw(OSError("down")))
    assert narrative.story(result, provider=name) is None


def test_watch(tmp_path):
    p = tmp_path / "x"
    p.write_text("1")
    assert watch((str(p),), lambda: None, every=0.01, rounds=3) == 0
    seen = []

    def touch():
        seen.append(1)

    stamps = iter([100, 200, 200])
    import tidemark.streaming.watch as w

    old, w._stamps = w._stamps, lambda paths: (next(stamps),)
    try:
        assert watch((str(p),), touch, every=0.0, rounds=2) == 1 and seen == [1]
        # a rerun that fails is tried again at the next look
        stamps, told, tries = iter([100, 200, 200, 200]), [], iter([ValueError("half a file"), None])

        def rerun():
            if (e := next(tries)) is not None:
                raise e

        assert watch((str(p),), rerun, every=0.0, rounds=3, failed=told.append) == 2 and [str(e) for e in told] == ["half a file"]
    finally:
        w._stamps = old


def test_stream(spark, tmp_path):
    df = spark.range(40).selectExpr("id AS k", "CAST(id % 2 AS STRING) AS s")
    df.where("k < 10").write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    compare_stream(df, stream, lambda epoch, r: out.append(r.rows_after), str(tmp_path / "cp")).awaitTermination(120)
    assert out == [10]
