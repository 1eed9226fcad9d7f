"""From a review to marked text, registry builds and edits, and what goes in and out of a registry."""

import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glossweave.operators import build, dictionary, matching, presentation, registry
from glossweave.operators.dictionary import ENTITY
from glossweave.plans import fixtures as X
from glossweave.sources import settings, sinks, snapshots, web, workbooks
from glossweave.streaming import polling


@pytest.fixture()
def save(spark, tmp_path):
    def write(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/tables/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/tables/{name}")

    return write


def test_reviews_become_marked_text(spark):
    entities = X.entities(spark)
    both = presentation.analyze(matching.mentions(X.texts(spark), entities), entities).collect()
    by = {r.doc_id: r for r in both}
    assert by[1].review is None and by[1].marked_text.startswith("Мария Тестова* дала")
    assert by[5].marked_text == "Ветка сломалась." and by[5].review is None
    assert by[4].marked_text is None and by[4].review.ambiguous_count == 1 and by[4].review.selected == []
    chosen = [by[4].review.candidates[1].candidate_id]
    reviews = spark.createDataFrame([(4, by[4].text, by[4].review.candidates, chosen), (6, by[6].text, by[6].review.candidates, None)], f"doc_id long, text string, candidates array<{presentation.CANDIDATE}>, selected array<string>")
    done = {r.doc_id: r.marked_text for r in presentation.apply_reviews(reviews, entities).collect()}
    assert done[4] == "В тексте есть Общее имя*.\n\n_* Вторая организация — признана нежелательной организацией_"
    assert done[6] == by[6].text


def test_overlapping_choices_take_the_earliest_and_longest(spark):
    def c(i, start, end):
        return (f"c{i}", f"g{i}", "t", start, end, "e1", 0.0, "ambiguous", "", False, True)

    df = spark.createDataFrame([([c(0, 2, 5), c(1, 0, 3), c(2, 0, 4), c(3, 4, 6), c(4, 9, 9)], ["c0", "c1", "c2", "c3"])], f"candidates array<{presentation.CANDIDATE}>, selected array<string>")
    (r,) = df.select(presentation.chosen_matches(F.col("candidates"), F.col("selected")).alias("m")).collect()
    assert [(m.start, m.end) for m in r.m] == [(0, 4), (4, 6)]


def test_json_of_matches(spark):
    entities = X.entities(spark)
    rows = {r.doc_id: json.loads(r.json) for r in presentation.matches_json(matching.mentions(X.texts(spark), entities), entities).collect()}
    assert [(m["entity"]["id"], m["start"], m["end"], m["match_type"]) for m in rows[8]["matches"]] == [("e5", 12, 44, "exact"), ("e5", 55, 58, "context_acronym")]
    assert [c["id"] for c in rows[4]["ambiguous_matches"][0]["candidates"]] == ["e2", "e3"] and rows[4]["matches"] == []
    assert rows[5] == {"matches": [], "ambiguous_matches": []}


def test_merged_rows_are_in_order_of_type_and_name(spark, save):
    rows = [(0, "z", "Яна Общая Фамилия", "person", ["foreign_agent"], ["Общий знак"], ["a"], {}, []), (1, "y", "Бета Союз", "organization", ["extremist"], ["Общий знак"], ["a"], {}, []), (2, "x", "Альфа Союз", "organization", ["extremist"], ["Общий знак"], ["a"], {}, [])]
    merged = registry.merge(spark.createDataFrame(rows, ENTITY), save)
    assert [r.id for r in merged.orderBy("ord").collect()] == ["x", "y", "z"]
    keys = dictionary.keys(dictionary.terms(merged)).where("size(entity_ids) = 3").collect()
    assert keys[0].entity_ids == ["x", "y", "z"] and keys[0].term.id == "x"


def test_build_replace_and_edit(spark, save):
    listed = registry.import_listed(X.lines(spark, X.LIST_LINES))
    built = build.build({"rosfinmonitoring": listed}, build.no_manual(spark), save)
    names = [(r.entity_type, r.name) for r in built.entities.orderBy("ord").collect()]
    assert names == sorted(names) and ("person", "Второй Пример") in names
    assert build.count_own(built.entities).first().entity_count == len(names) - 2
    assert {r.card_id for r in built.manual.cards.collect()} == {r.id for r in built.entities.collect()}
    fewer = registry.import_listed(X.lines(spark, ["Физические лица", "1. Третий Пример"]))
    again = build.replace_source(built.entities, "rosfinmonitoring", fewer, built.manual, save)
    assert {r.name for r in again.entities.collect()} == {"Третий Пример", "АУЕ", "Russian antiwar committee"}
    assert "Второй Пример" in {r.canonical_name for r in again.manual.cards.collect()}
    with pytest.raises(ValueError):
        build.build({"nowhere": listed}, build.no_manual(spark), save)

    target = again.entities.where("name = 'Третий Пример'").first().id
    editor = build.Editor(again, target)
    manual = editor.add_form("  Третьего   Примера ")
    changed = editor.apply(manual, save)
    forms = lambda r: {x.text for x in r.forms.where(F.col("entity_id") == target).collect()}
    assert "Третьего Примера" in forms(changed)
    assert "Третьего Примера" in changed.entities.where(F.col("id") == target).first().runtime_forms
    editor = build.Editor(changed, target)
    assert editor.add_form("третьего примера").manual_forms.count() == 1
    assert editor.remove_form("ТРЕТЬЕГО ПРИМЕРА").manual_forms.count() == 0
    automatic = sorted(forms(again))[0]
    off = editor.apply(editor.disable_form(automatic), save)
    assert automatic not in forms(off)
    assert build.Editor(off, target).restore_form(automatic).disabled_auto_forms.count() == 0
    aliases = editor.set_aliases(["Один", " Два", "Один", ""]).manual_aliases.orderBy("ord").collect()
    assert [(x.card_id, x.alias) for x in aliases] == [(target, "Один"), (target, "Два")]
    assert editor.add_alias("Новый знак").manual_aliases.count() == 1
    for wrong in (lambda: editor.add_form(automatic), lambda: editor.add_alias("третий пример"), lambda: editor.disable_form("нет такой"), lambda: build.Editor(again, "none"), lambda: build.card(again.entities, again.manual.cards, "none")):
        with pytest.raises(ValueError):
            wrong()
    assert build.card(again.entities, again.manual.cards, target).count() == 1
    cards = registry.list_cards(again.manual.cards, again.manual.manual_aliases, "третий", entities=again.entities).collect()
    assert [(c.canonical_name, c.statuses) for c in cards] == [("Третий Пример", ["terrorist_extremist"])]


def test_workbook_round_trip(spark, save, tmp_path):
    path = f"file://{tmp_path}/manual.xlsx"
    assert workbooks.read_manual(spark, path).cards.count() == 0
    built = build.build({}, build.no_manual(spark), save)
    target = built.entities.where("name = 'АУЕ'").first().id
    manual = build.Editor(built, target).set_aliases(["Знак <&> один", "  "])
    workbooks.write_manual(manual, path)
    back = workbooks.read_manual(spark, path)
    assert sorted(map(tuple, back.cards.collect())) == sorted(map(tuple, manual.cards.select(*back.cards.columns).collect()))
    assert [(x.card_id, x.alias, x.alias_type) for x in back.manual_aliases.collect()] == [(target, "Знак <&> один", "manual")]
    assert back.manual_forms.collect() == [] and back.disabled_auto_forms.columns == ["card_id", "form", "reason", "ord"]


def test_bundles_are_verified_and_rotate(spark, save, tmp_path):
    root, path = f"file://{tmp_path}/registry", f"file://{tmp_path}/bundle.zip"
    built = build.build({"rosfinmonitoring": registry.import_listed(X.lines(spark, X.LIST_LINES))}, build.no_manual(spark), save)
    with pytest.raises(FileNotFoundError):
        snapshots.ready_folder(spark, root)
    sums = snapshots.export_bundle(built.entities, built.forms, path, "v1")
    assert set(sums) == set(snapshots.BUNDLE_FILES)
    folder = snapshots.ready_folder(spark, root, lambda: path)
    assert snapshots.folder_version(spark, folder) == "v1" and snapshots.folder_version(spark, f"{root}/nowhere") == "unversioned"
    back = snapshots.read_folder(spark, folder)
    pick = lambda df: [(r.id, r.name, r.statuses, r.aliases, r.sources, r.metadata, r.runtime_forms) for r in df.orderBy("ord").collect()]
    assert pick(back) == pick(built.entities)
    snapshots.export_bundle(built.entities.limit(1), built.forms, path, "v2")
    snapshots.import_bundle(spark, path, root)
    assert [snapshots.folder_version(spark, f"{root}/{n}") for n in ("current", "previous")] == ["v2", "v1"]
    raw = snapshots.read_bytes(spark, path)
    for change in ({"agents.json": b"[]"}, {"../evil": b""}, {"forms.json": None}):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(out, "w") as new:
            for n in {*old.namelist(), *change}:
                content = change[n] if n in change else old.read(n)
                if content is not None:
                    new.writestr(n, content)
        with pytest.raises(ValueError):
            snapshots.open_bundle(out.getvalue())


def test_updates_are_polled_once_and_go_on(spark, tmp_path):
    folder, checkpoint, seen, reads = tmp_path / "updates", f"file://{tmp_path}/checkpoint", [], []
    folder.mkdir()

    def registry_now():
        reads.append(len(reads))
        return spark.range(len(reads))

    def handle(batch, entities, number):
        seen.append(([r.update_id for r in batch.orderBy("update_id").collect()], entities.count()))

    for rows in ([10, 11], [12]):
        (folder / f"{rows[0]}.json").write_text("\n".join(json.dumps({"update_id": i, "text": "x"}) for i in rows))
        q = polling.serve(polling.poll(spark, folder=str(folder)), registry_now, handle, checkpoint, once=True)
        q.awaitTermination(120)
    assert [ids for ids, _ in seen if ids] == [[10, 11], [12]]
    assert [n for ids, n in seen if ids][0] < [n for ids, n in seen if ids][1]
    reader = polling.UpdateReader(polling.FileFeed(str(folder)))
    rows, end = reader.read({"next": 11})
    assert [r[0] for r in rows] == [11, 12] and end == {"next": 13}
    assert [r[0] for r in reader.readBetweenOffsets({"next": 10}, {"next": 12})] == [10, 11]


def test_fetching_falls_back_and_archives(spark, tmp_path):
    pages = {
        "http://a/x": RuntimeError("down"),
        "http://b/page": web.Payload(b"<a href='/f/list.docx'>f</a>", "text/html", "", "http://b/page"),
        "http://b/f/list.docx": web.Payload(b"PK", "application/octet-stream", "", "http://b/f/list.docx"),
        "http://c/none": web.Payload(b"<p>", "text/html", "", "http://c/none"),
    }

    def get(url):
        if isinstance(pages[url], Exception):
            raise pages[url]
        return pages[url]

    root, at = f"file://{tmp_path}/archive", lambda: datetime(2024, 3, 5, 7, 8, 9)
    first = web.fetch(spark, "src", ["http://a/x", "http://b/page"], [".docx"], root, get=get, now=at)
    again = web.fetch(spark, "src", ["http://b/page"], [".docx"], root, get=get, now=at)
    assert first == f"{root}/2024-03-05/src/070809_list.docx" and again == f"{root}/2024-03-05/src/070809_list_1.docx"
    assert snapshots.read_bytes(spark, first) == b"PK" and snapshots.exists(spark, f"{root}/raw_pages/2024-03-05/src/070809_page.html")
    with pytest.raises(RuntimeError, match="down"):
        web.fetch(spark, "src", ["http://a/x", "http://c/none"], [".docx"], root, get=get, now=at)


def test_settings(spark):
    lines = ["# note", "", "A=1", "B = 'two' ", "C=\"x=y\"", "no sign", "E="]
    assert settings.settings(lines, {"A": " 3 ", "Z": ""}, ("A", "B")) == {"A": "3", "B": "two", "C": "x=y"}
    with pytest.raises(ValueError):
        settings.settings(lines, {}, ("E",))
    assert settings.ids(" 1,2, ,3") == [1, 2, 3]
    assert spark.createDataFrame([(" 1,2, ,3",)], "v string").select(settings.id_list(F.col("v"))).first()[0] == [1, 2, 3]
    assert [settings.poll_seconds(x) for x in ("33", "0", "x", None)] == [33, 1, 20, 20]
    assert settings.download_headers("a", "t")["Authorization"] == "Bearer t" and "Authorization" not in settings.download_headers("a")
    assert settings.local_version(datetime(2024, 1, 2, 3, 4, 5)) == "local-20240102030405"


def test_outbox(spark, tmp_path):
    answers = spark.createDataFrame([(1, "one <two>\nthree", 7, "{}"), (2, "x", None, None)], "chat_id long, text string, message_id long, reply_markup string")
    rows = [(r.chat_id, r.no, r.method, json.loads(r.payload)) for r in sinks.outbox(answers, limit=9).orderBy("chat_id", "no").collect()]
    assert [(c, n, m) for c, n, m, _ in rows] == [(1, 0, "edit"), (1, 1, "send"), (2, 0, "send")]
    assert rows[0][3]["text"] == "one &lt;two&gt;" and "reply_markup" not in rows[0][3] and rows[1][3]["reply_markup"] == "{}"
    entities = X.entities(spark)
    found = matching.mentions(X.texts(spark), entities)
    sinks.write_matches(found, entities, f"{tmp_path}/json")
    assert spark.read.text(f"{tmp_path}/json").count() == len(X.TEXTS)
    sinks.write_texts(presentation.annotate(presentation.with_entities(found, entities)), f"{tmp_path}/texts")
    assert spark.read.json(f"{tmp_path}/texts").count() == len(X.TEXTS)


def test_command_line(spark, tmp_path, capsys):
    from glossweave import cli

    folder, listed = f"file://{tmp_path}/registry", tmp_path / "list.html"
    listed.write_text("".join(f"<p>{x}</p>" for x in X.LIST_LINES), encoding="utf-8")
    assert cli.main(["--registry", folder, "--update", f"rosfinmonitoring=file://{listed}", "--version", "v9", "--export", f"file://{tmp_path}/out.zip"], spark) == 0
    assert json.loads(snapshots.open_bundle(snapshots.read_bytes(spark, f"file://{tmp_path}/out.zip"))["manifest.json"])["version"] == "v9"
    assert cli.main(["--registry", folder, "--text", "Здесь Второй Пример.", "--json"], spark) == 0
    out = capsys.readouterr().out
    assert "Здесь Второй Пример*." in out and '"match_type":"exact"' in out
    assert not [p for p in (tmp_path / "registry").iterdir() if p.name.startswith("scratch")]
    with pytest.raises(SystemExit):
        cli.main(["--registry", folder], spark)
