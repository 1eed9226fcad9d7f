"""Registry builds: all sources as one, one source replaced, and the manual tables edited."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from . import registry as R

#: The manual tables and their columns, in the order in which a workbook has them.
SHEETS = {
    "cards": ["card_id", "canonical_name", "entity_type", "official_statuses", "manual_statuses", "source_keys", "source_urls", "is_active", "notes"],
    "manual_aliases": ["card_id", "alias", "alias_type", "comment"],
    "manual_forms": ["card_id", "base_surface", "form", "form_type", "comment"],
    "disabled_auto_forms": ["card_id", "form", "reason"],
    "change_log": ["timestamp", "action", "card_id", "details"],
}


@dataclass(frozen=True)
class Manual:
    """The manual tables; all but the cards have ``ord``, the order of their rows."""

    cards: DataFrame
    manual_aliases: DataFrame
    manual_forms: DataFrame
    disabled_auto_forms: DataFrame


@dataclass(frozen=True)
class Registry:
    """Entities with their forms, and the manual tables they were built with."""

    entities: DataFrame
    forms: DataFrame
    manual: Manual


def no_manual(spark: SparkSession) -> Manual:
    """Empty manual tables."""

    def empty(name: str) -> DataFrame:
        extra = ", ord long" if name != "cards" else ""
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in SHEETS[name]) + extra)

    return Manual(*(empty(n) for n in list(SHEETS)[:4]))


def _finished(parts: list[DataFrame], manual: Manual, save: R.Save) -> Registry:
    merged = R.merge(R.stacked(parts), save)
    entities = save(R.apply_overrides(merged, manual.cards, manual.manual_aliases), "with_overrides")
    cards = save(R.sync_cards(manual.cards, entities), "cards")
    manual = replace(manual, cards=cards)
    forms = save(R.card_forms(entities, manual.manual_aliases, manual.manual_forms, manual.disabled_auto_forms), "forms")
    return Registry(R.with_forms(entities, forms), forms, manual)


def build(sources: dict[str, DataFrame], manual: Manual, save: R.Save) -> Registry:
    """A registry of the imported sources, in their fixed order, and the built-in rows."""
    unknown = set(sources) - set(V.SOURCE_STATUSES)
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
    parts = [sources[s] for s in V.SOURCE_STATUSES if s in sources]
    return _finished([*parts, R.builtins(manual.cards.sparkSession)], manual, save)


def replace_source(entities: DataFrame, source: str, imported: DataFrame, manual: Manual, save: R.Save) -> Registry:
    """A registry in which one source's rows are new ones; what only that source knew goes."""
    if source not in V.SOURCE_STATUSES:
        raise ValueError(f"unknown source: {source}")
    return _finished([R.without_source(entities, source), imported, R.builtins(entities.sparkSession)], manual, save)


def count_own(entities: DataFrame) -> DataFrame:
    """(entity_count): entities that aren't only built-in ones."""
    return entities.where(F.array_join("sources", "; ") != "builtins").agg(F.count("*").alias("entity_count"))


# --- editing -------------------------------------------------------------------------------------------------------


def card(entities: DataFrame, cards: DataFrame, card_id: str) -> DataFrame:
    """The entity and the card of an id in one row; an error if either is missing."""
    found = entities.where(F.col("id") == card_id).join(cards.where(F.col("card_id") == card_id), F.col("id") == F.col("card_id")).limit(1)
    if found.isEmpty():
        raise ValueError(f"no card {card_id}")
    return found


def _normal(values: DataFrame, column: str) -> set[str]:
    """Normal forms of one card's values."""
    return {r[0] for r in values.select(T.normalize(F.col(column))).distinct().collect()}


def _clean(spark: SparkSession, value: str) -> str:
    return " ".join(value.split())


def _added(table: DataFrame, row: dict[str, str], value: str) -> DataFrame:
    spark = table.sparkSession
    names = [c for c in table.columns if c != "ord"]
    new = spark.createDataFrame([(*[row.get(c, "") for c in names], 0)], ", ".join(f"{c} string" for c in names) + ", ord long")
    return R.upsert_row(table.select(*names, "ord"), new, value)


class Editor:
    """Changes to one card's manual rows; each returns the registry's manual tables, and ``apply`` the new registry."""

    def __init__(self, registry: Registry, card_id: str):
        self.registry, self.card_id = registry, card_id
        self.spark = registry.entities.sparkSession
        self.entity = registry.entities.where(F.col("id") == card_id)
        if self.entity.isEmpty():
            raise ValueError(f"no card {card_id}")

    def _of_card(self, table: DataFrame) -> DataFrame:
        return table.where(F.col("card_id") == self.card_id)

    def _automatic(self, with_disabled: bool) -> set[str]:
        none = no_manual(self.spark)
        off = self._of_card(self.registry.manual.disabled_auto_forms) if with_disabled else none.disabled_auto_forms
        return _normal(R.card_forms(self.entity, none.manual_aliases, none.manual_forms, off), "text")

    def add_form(self, form: str, base_surface: str = "") -> Manual:
        """A form that isn't made automatically; one that is there already changes nothing."""
        form = _clean(self.spark, form)
        wanted = _normal(self.spark.createDataFrame([(form,)], "v string"), "v")
        if not form or wanted & self._automatic(True):
            raise ValueError("the form is empty or made automatically")
        m = self.registry.manual
        base = _clean(self.spark, base_surface) or self.entity.first()["name"]
        return replace(m, manual_forms=_added(m.manual_forms, {"card_id": self.card_id, "base_surface": base, "form": form, "form_type": "manual"}, "form"))

    def remove_form(self, form: str) -> Manual:
        m = self.registry.manual
        return replace(m, manual_forms=R.delete_row(m.manual_forms, self.card_id, "form", form))

    def add_alias(self, alias: str) -> Manual:
        """An alias that the card doesn't have."""
        alias = _clean(self.spark, alias)
        wanted = _normal(self.spark.createDataFrame([(alias,)], "v string"), "v")
        own = _normal(self.entity.select(F.explode(F.concat(F.array("name"), "aliases")).alias("v")), "v")
        if not alias or wanted & own:
            raise ValueError("the alias is empty or the card has it")
        m = self.registry.manual
        return replace(m, manual_aliases=_added(m.manual_aliases, {"card_id": self.card_id, "alias": alias, "alias_type": "manual"}, "alias"))

    def set_aliases(self, aliases: list[str]) -> Manual:
        """All of the card's manual aliases replaced, in order, each once; other cards' rows stay before them."""
        m = self.registry.manual
        rest = m.manual_aliases.where(F.col("card_id") != self.card_id)
        top = rest.agg(F.max("ord").alias("top")).first().top
        values = list(dict.fromkeys(v for v in (_clean(self.spark, a) for a in aliases) if v))
        rows = [(self.card_id, v, "manual", "", (-1 if top is None else top) + 1 + i) for i, v in enumerate(values)]
        new = self.spark.createDataFrame(rows, "card_id string, alias string, alias_type string, comment string, ord long")
        return replace(m, manual_aliases=rest.select(*new.columns).unionByName(new))

    def remove_alias(self, alias: str) -> Manual:
        m = self.registry.manual
        return replace(m, manual_aliases=R.delete_row(m.manual_aliases, self.card_id, "alias", alias))

    def disable_form(self, form: str, reason: str = "") -> Manual:
        """An automatic form left out from now on."""
        form = _clean(self.spark, form)
        wanted = _normal(self.spark.createDataFrame([(form,)], "v string"), "v")
        if not form or not wanted & self._automatic(False):
            raise ValueError("only forms that are made automatically can be left out")
        m = self.registry.manual
        return replace(m, disabled_auto_forms=_added(m.disabled_auto_forms, {"card_id": self.card_id, "form": form, "reason": _clean(self.spark, reason)}, "form"))

    def restore_form(self, form: str) -> Manual:
        m = self.registry.manual
        return replace(m, disabled_auto_forms=R.delete_row(m.disabled_auto_forms, self.card_id, "form", form))

    def apply(self, manual: Manual, save: R.Save) -> Registry:
        """The registry with changed manual tables: entities as they are, forms made anew."""
        bare = self.registry.entities.withColumn("runtime_forms", F.array().cast("array<string>"))
        forms = save(R.card_forms(bare, manual.manual_aliases, manual.manual_forms, manual.disabled_auto_forms), "edited_forms")
        return Registry(R.with_forms(bare, forms), forms, manual)
