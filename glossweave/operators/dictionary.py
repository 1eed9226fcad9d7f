"""The dictionary: surfaces of entities by stemmed key, and what the text must hold for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.names import probes, search_keys, token_spec

ENTITY = "ord long, id string, name string, entity_type string, statuses array<string>, aliases array<string>, sources array<string>, metadata map<string,string>, runtime_forms array<string>"


def surfaces(entity_type: Column, name: Column, aliases: Column, runtime_forms: Column) -> Column:
    """All surfaces of an entity with their kinds, in order of precedence."""
    none = F.array().cast("array<string>")
    aliases, runtime_forms = F.coalesce(aliases, none), F.coalesce(runtime_forms, none)
    own = F.concat(F.array(name), aliases)
    initials = F.array_distinct(F.filter(F.transform(own, lambda s: T.acronym(s, V.MATCHER_ACRONYM_STOPS, False)), lambda a: a != ""))
    kinds = [
        ("exact", F.array(name)),
        ("alias", aliases),
        ("runtime_form", runtime_forms),
        ("person_alias", F.when(entity_type == "person", T.person_variants(name)).otherwise(none)),
        ("acronym", F.when(entity_type == "organization", initials).otherwise(none)),
        ("component", F.when(entity_type == "organization", T.latin_components(own)).otherwise(none)),
    ]

    def of_kind(kind: str, values: Column) -> Column:
        return F.transform(values, lambda s: F.struct(s.alias("surface"), F.lit(kind).alias("kind")))

    return F.concat(*[of_kind(*x) for x in kinds])


def terms(entities: DataFrame) -> DataFrame:
    """(key, surface, kind, entity columns, ord, pos): one row per surface that is telling enough."""
    each = entities.select("ord", "id", "name", "entity_type", "sources", F.posexplode(surfaces(F.col("entity_type"), F.col("name"), F.col("aliases"), F.col("runtime_forms"))).alias("pos", "s"))
    each = each.select("*", "s.surface", "s.kind").drop("s").withColumn("key", T.key(F.col("surface")))
    good = F.when(F.col("kind") == "runtime_form", T.is_significant_form(F.col("surface"))).otherwise(T.is_significant(F.col("surface")))
    return each.where(good & (F.col("key") != ""))


def keys(dictionary: DataFrame) -> DataFrame:
    """One row per key: its first term, the entities that share it, and specs and probes for the text."""
    toks = T.tokens(F.col("surface"))
    rows = dictionary.withColumn("toks", toks)
    first = F.min_by(F.struct("surface", "kind", "id", "name", "entity_type", "sources"), F.struct("ord", "pos")).alias("term")
    # an entity's place is that of its first term under the key
    per_entity = rows.groupBy("key", "id").agg(
        F.min(F.struct("ord", "pos")).alias("at"), first, F.max(F.col("entity_type") == "person").alias("person"), F.min(F.size("toks") == 1).alias("single"),
        F.collect_set(F.get("toks", F.lit(0))).alias("first_tokens"),
    )
    grouped = per_entity.groupBy("key").agg(
        F.min_by("term", "at").alias("term"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x.id).alias("entity_ids"),
        F.max("person").alias("person"),
        F.min("single").alias("single"),
        F.array_distinct(F.flatten(F.collect_list("first_tokens"))).alias("first_tokens"),
    )
    first_token = F.substring_index("key", " ", 1)
    gate = F.when(F.col("person"), F.array_distinct(F.flatten(F.transform(F.concat(F.array(first_token), "first_tokens"), search_keys)))).otherwise(F.array(first_token))
    specs = F.transform(T.tokens(F.col("term.surface")), lambda t: token_spec(t, F.col("person")))
    out = grouped.select("key", "term", "entity_ids", "person", "single", gate.alias("gate"), specs.alias("specs"))
    return out.withColumn("probes", F.array_distinct(probes(F.get("specs", F.lit(0)))))
