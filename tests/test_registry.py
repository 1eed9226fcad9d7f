"""Importing, merging, overriding, and the files around a registry."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from glossweave.operators import registry as R
from glossweave.operators.dictionary import ENTITY
from glossweave.plans import fixtures as X
from glossweave.plans.queries import _CARDS, _save
from glossweave.sources import files, snapshots, web
from glossweave.streaming import sessions


def entity(ord_, id_, name, kind="organization", statuses=(), aliases=(), sources=("s",), metadata=None):
    return (ord_, id_, name, kind, list(statuses), list(aliases), list(sources), metadata or {}, [])


def merged(spark, *rows):
    return R.merge(spark.createDataFrame(list(rows), ENTITY), _save(spark)).orderBy("ord").collect()


def test_merge(spark):
    a = entity(0, "a", "Первый пример", aliases=["Общий знак"], sources=["s1"], statuses=["extremist"], metadata={"k": "1", "x": "y"})
    b = entity(1, "b", "Второй пример", aliases=["Общий знак"], sources=["s2"], statuses=["foreign_agent"], metadata={"k": "2"})
    (m,) = merged(spark, a, b)
    assert (m.id, m.name, m.aliases, m.sources, m.statuses) == ("a", "Первый пример", ["Общий знак", "Второй пример"], ["s1", "s2"], ["foreign_agent", "extremist"])
    assert m.metadata == {"k": "2", "x": "y"}
    assert len(merged(spark, a, entity(1, "b", "Второй пример", aliases=["Общий знак"], sources=["s1"]))) == 2
    assert len(merged(spark, a, entity(1, "b", "первый Пример", sources=["s1"]))) == 1
    chain = [entity(i, f"n{i}", f"Название номер{i}", aliases=[f"Связка звено{i}", f"Связка звено{i + 1}"], sources=[f"s{i}"]) for i in range(12)]
    assert len(merged(spark, *chain)) == 1


def test_drop_source(spark):
    df = spark.createDataFrame([entity(0, "a", "n", sources=["foreign_agents", "rosfinmonitoring"], statuses=["foreign_agent", "terrorist_extremist"]), entity(1, "b", "m", sources=["foreign_agents"], statuses=["foreign_agent"])], ENTITY)
    (r,) = R.without_source(df, "foreign_agents").collect()
    assert (r.id, r.sources, r.statuses) == ("a", ["rosfinmonitoring"], ["terrorist_extremist"])


def test_listed_lines(spark):
    got = {(r.name, r.entity_type) for r in R.import_listed(X.lines(spark, X.LIST_LINES)).collect()}
    assert {("Org", "organization"), ("Person", "person"), ("Второй Пример", "person")} <= got
    assert all(n != "x" for n, _ in got)


def test_titles(spark):
    m = R.import_materials(X.lines(spark, X.TITLE_LINES), limit=2).orderBy("ord").collect()
    assert [(r.name, r.metadata["number"]) for r in m] == [("Title", "1"), ("Second", "2")]


def test_tables(spark):
    header = ["№", "Имя", "a", "b", "Полное имя", "c", "Вид", "d", "e", "Статус"]
    rows = [("f", 0, []), ("f", 1, []), ("f", 2, header), ("f", 3, ["1", "Тестов Иван «Псевдо»", None, "x", None, None, "Физическое лицо"]), ("f", 4, ["2", "«Клуб 24/7», Латвия", "", "", "", "", "юр"]), ("f", 5, [])]
    a = R.import_foreign_agents(spark.createDataFrame(rows, "file string, row int, cells array<string>")).orderBy("ord").collect()
    assert [(r.name, r.entity_type) for r in a] == [("Тестов Иван", "person"), ("Клуб 24/7", "organization")]
    assert a[0].metadata["Имя"] == "Тестов Иван «Псевдо»" and a[0].metadata["row_number"] == "1"
    assert {"Псевдо", "Тестов", "Testov"} <= set(a[0].aliases)
    rows = [("f", 2, header), ("f", 3, ["1", "", "", "", "Общество друзей (Клуб), Польша", "", "", "", "", "исключен"]), ("f", 4, ["2", "", "", "", "Общество друзей воды (ОДВ), Польша"])]
    (u,) = R.import_undesirable_organizations(spark.createDataFrame(rows, "file string, row int, cells array<string>")).collect()
    assert u.name == "Общество друзей воды" and "ОДВ" in u.aliases


def test_overrides_cards_and_forms(spark):
    e = X.entities(spark)
    cards = spark.createDataFrame([("e1", "old", "person", "", "extremist; terrorist", "", "", "0", "n"), ("gone", "Gone", "person", "", "", "s", "", "1", "")], _CARDS)
    aliases = spark.createDataFrame([("e1", "Маша", 0)], "card_id string, alias string, ord long")
    r = {x.id: x for x in R.apply_overrides(e, cards, aliases).collect()}["e1"]
    assert (r.statuses, r.aliases, r.metadata["manual_notes"]) == (["foreign_agent", "terrorist", "extremist"], ["Маша"], "n")
    synced = {x.card_id: x for x in R.sync_cards(cards, e).collect()}
    assert len(synced) == 6 and synced["e1"].is_active == "0" and synced["e1"].canonical_name == "Тестова Мария Примеровна"
    forms = spark.createDataFrame([("e1", "Тестовой", 0)], "card_id string, form string, ord long")
    off = spark.createDataFrame([("e1", "МАША", 0)], "card_id string, form string, ord long")
    f = R.card_forms(e, aliases, forms, off).where("entity_id = 'e1'").orderBy("ord").collect()
    assert [(x.text, x.source_type) for x in f[:3]] == [("Тестова Мария Примеровна", "base"), ("Тестова", "base"), ("Тестовой", "manual")]
    assert "Testova" in {x.text for x in f if x.source_type == "auto_translit"} and "Маша" not in {x.text for x in f}
    assert R.upsert_row(aliases, spark.createDataFrame([("e1", "маша!", 0), ("e1", "Маня", 0)], aliases.schema), "alias").count() == 2
    assert R.delete_row(aliases, "e1", "alias", "МАША").count() == 0
    assert [c.card_id for c in R.list_cards(cards, aliases, "маша").collect()] == ["e1"]
    assert R.list_cards(cards, aliases, "", require_query=True).count() == 0


def sheet(rows):
    out = io.BytesIO()
    cells = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r + 1}"><v>{v}</v></c>' for c, v in row) + "</row>" for r, row in rows)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_spreadsheets_documents_and_pages(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheet([(0, [(0, "h"), (2, "k")]), (3, [(1, 12.0), (2, 0.5)])]))
    rows = files.first_sheet(files.read_xlsx(spark, f"file://{tmp_path}/a.xlsx")).orderBy("row").collect()
    assert [(r.row, r.cells) for r in rows] == [(0, ["h", None, "k"]), (1, []), (2, []), (3, [None, "12", "0.5"])]
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>a  b</w:t></w:r><w:r><w:t> c</w:t></w:r></w:p><w:p/></w:body></w:document>')
    assert [(r.line, r.text) for r in files.read_lines(spark, f"file://{tmp_path}/a.docx").collect()] == [(0, "a b c")]
    (tmp_path / "a.html").write_text("<script>x</script><p>Организации</p>1. A &amp; B<br>2. C<div>", encoding="utf-8")
    assert [r.text for r in files.read_lines(spark, f"file://{tmp_path}/a.html").orderBy("line").collect()] == ["Организации", "1. A & B", "2. C"]
    with pytest.raises(ValueError):
        files.read_lines(spark, "a.pdf")


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    e = X.entities(spark)
    none = spark.createDataFrame([], "card_id string, alias string, form string, ord long")
    assert snapshots.current_version(spark, root) == "unversioned"
    snapshots.write_snapshot(e, R.card_forms(e, none, none, none), root, "v1")
    back = snapshots.read_snapshot(spark, root).orderBy("ord").collect()
    assert [r.id for r in back] == ["e1", "e2", "e3", "e4", "e5"] and "Testova" in back[0].runtime_forms
    part = next((tmp_path / "db/v1/agents").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"\n")
    part.with_name(f".{part.name}.crc").unlink()  # the file system's own checksum, which would speak first
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, root, "v1")


def test_links(spark):
    html = "<a href='/x/list.docx'>a</a> <a class=q href=\"b.xlsx?v=1\">b</a>"
    feed = "<rss><channel><item><link>http://h/x.html</link><enclosure url='http://h/y.docx'/></item></channel></rss>"
    script = "ExternalApi.setBaseUrl('https://h/api/'); let id = 'abcdef01-23'"
    rows = [("http://h/p/q?z", html, "text/html"), ("http://h", feed, "application/rss+xml"), ("http://h", script, "")]
    df = spark.createDataFrame(rows, "url string, content string, content_type string").coalesce(1)
    assert [r.download_url for r in web.download_urls(df, [".xlsx", ".docx"], with_export=True).collect()] == ["http://h/p/b.xlsx?v=1", "http://h/y.docx", "https://h/api/rest/registry/abcdef01-23/export?"]
    got = spark.range(1).select(web.extension_of_response(F.lit("http://h/a"), F.lit("text/html"), F.lit('x; filename="r.XLS"')), web.safe_stem(F.lit("http://h.org/a b.c.docx?x"))).first()
    assert tuple(got) == (".xls", "a_b.c")


def event(i, minute, action, value="0"):
    from datetime import datetime, timedelta

    return ("s", i, datetime(2024, 1, 1) + timedelta(minutes=minute), action, value, "text", ["a", "b", "c"], ["g", "g", "h"], [True, True, False], ["c"])


def test_sessions(spark, tmp_path):
    rows = [event(1, 0, "create"), event(2, 1, "toggle", "0"), event(3, 2, "toggle", "1"), event(4, 20, "page", "9"), event(5, 49, "toggle", "7"), event(6, 49, "apply"), event(7, 50, "apply"), event(8, 60, "create"), event(9, 91, "toggle")]
    df = spark.createDataFrame(rows, sessions.EVENTS)
    batch = [(r.event_id, r.status, r.selected, r.page) for r in sessions.replay(df).orderBy("event_id").collect()]
    assert [b[1] for b in batch] == ["created", "shown", "shown", "shown", "unavailable", "applied", "unavailable", "created", "unavailable"]
    assert batch[1][2] == ["a", "c"] and batch[2][2] == ["b", "c"]
    df.where("event_id < 4").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: sessions.answers(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    run()
    df.where("event_id >= 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    stream = [(r.event_id, r.status, r.selected, r.page) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("event_id").collect()]
    assert stream == batch
