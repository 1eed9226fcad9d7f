"""Small invented registries and texts that queries and tests share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.dictionary import ENTITY

ENTITIES = [
    ("e1", "Тестова Мария Примеровна", "person", ["foreign_agent"], []),
    ("e2", "Первая организация", "organization", ["foreign_agent"], ["Общее имя"]),
    ("e3", "Вторая организация", "organization", ["undesirable_organization"], ["Общее имя"]),
    ("e4", "Центр городских наблюдений Ветка", "organization", ["foreign_agent"], ["Ветка"]),
    ("e5", "Лаборатория Выдуманных Измерений", "organization", ["undesirable_organization"], []),
]
TEXTS = [
    (1, "Мария Тестова дала комментарий."),
    (2, "Комментарий Марии Тестовой."),
    (3, "Мария Тестова пришла. Тестова ответила."),
    (4, "В тексте есть Общее имя."),
    (5, "Ветка сломалась."),
    (6, "Проект «Ветка» закрыт."),
    (7, "Проект городских наблюдений «Ветка» закрыт."),
    (8, "ЛВИ молчит. Лаборатория выдуманных измерений ответила. ЛВИ подтвердила."),
]
SURFACES = [
    "Россия", "город Казань", "Республика Татарстан", "Московская область", "Выдуманная область", "область", "Фонд", "Фонд города",
    "ИНН 1234567", "12345", "АБВ", "abc", "news", "ab cd", "Ветка", "Дом", "решение суда", "Центр наблюдений", "Улан-Удэ", "R2", "Лаборатория «Х»", "",
]
SPANS = [(1, 0, 5), (1, 3, 4), (1, 6, 9), (2, 2, 8), (2, 2, 4), (2, 4, 9), (2, 9, 12), (3, 5, 6), (4, 0, 10), (4, 1, 2), (4, 3, 4), (4, 10, 11)]
LIST_LINES = ["x", "Организации", "1. Org", "", "2) Лаборатория «Выдумка» (ЛВ), *", "Физические лица", "3. Person, 01.01.1970", "4. Второй Пример г.р. 1980"]
TITLE_LINES = ["head", "1.", "Title; решение вынесено тогда-то", "after", "2", "решение вынесено", "Second", "3)", "Third"]


def entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *e[:4], e[4], ["test"], {}, []) for i, e in enumerate(ENTITIES)], ENTITY)


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def lines(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(rows)], "file string, line int, text string")


def sql_values(rows: list[tuple], names: str) -> str:
    """Rows as a DuckDB table expression."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({names})"
