"""Temperature mixing of sources, with DataFrame functions only.

A source's share of all tokens (words) to the power ``exponent``, normalised, is
its weight: 1 keeps the shares, 0 makes all sources equal.  The exponent is
bisected: the smallest in [0, 1] at which no source is passed over more than
``max_repeats`` times under the budget, or the one in [0, 16] whose weights have
``entropy`` bits; with neither it is 1, and both together are an error, as is a
limit or a target that no exponent in the range meets.  Each round evaluates the
exponents that five bisections could visit as one aggregation over the table of
sources, so the sources may be many.

Weights become passes over a source: with ``budget_tokens`` a source gets its
weight's part of the budget; with none, the budget is the one under which the
least repeated source gets one whole pass, so no document is left out.  Every
pass is a permutation of the source by a keyed hash; a last, partial pass takes
documents from its start until the quota is met.  A document's place in its
source's stream, as a fraction, names its block, so that every block holds the
weights' mix.

Order inside a source comes from sums over hash ranges, of about ``range_docs``
documents each, and then inside a range, so no source is ever in one task.  A
null source is a source of its own.  Null and empty texts count one token, else
they could never be placed.  Repeated rows are placed each.  Other columns are
kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Staging

ROUNDS, FAN = 8, 32  # 32 ** 8 > 2 ** 40 steps over [0, 1]


def n_words(text: str = "text") -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, one at least."""
    return F.greatest(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def key(seed: int, *columns: Column) -> Column:
    """A hash in [0, 2**60) that names a place in a permutation."""
    joined = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def exponent(sources: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget_tokens: int | None = None) -> float:
    """The exponent that meets the limit on passes, or the target entropy, for (source, tokens)."""
    if max_repeats is not None and entropy is not None:
        raise ValueError("give a limit on repetition or a target entropy, not both")
    total = sources.agg(F.sum("tokens").alias("all")).first()["all"]
    if total is None or (max_repeats is None and entropy is None):
        return 1.0
    shares = sources.select((F.col("tokens") / F.lit(float(total))).alias("p"))
    low, high = 0.0, 1.0 if entropy is None else 16.0
    for number in range(ROUNDS):
        grid = [low + (high - low) * i / FAN for i in range(FAN + 1)]
        tried = shares.select("p", F.explode(F.array(*[F.lit(x) for x in grid])).alias("a")).withColumn("w", F.pow("p", F.col("a")))
        seen = tried.groupBy("a").agg(
            F.sum("w").alias("z"),
            F.sum(F.col("w") * F.log2("w")).alias("wl"),
            F.max(F.col("w") / F.col("p")).alias("most"),
            F.min(F.col("w") / F.col("p")).alias("least"),
        )
        # passes over the most repeated source, and bits; both fall as the exponent grows
        budget = F.col("z") / F.col("least") if budget_tokens is None else F.lit(budget_tokens / total)
        passes, bits = F.col("most") / F.col("z") * budget, F.log2("z") - F.col("wl") / F.col("z")
        value, target = (passes, max_repeats * (1 + 1e-12)) if entropy is None else (bits, entropy)
        found = {r.a: r.v for r in seen.select("a", value.alias("v")).collect()}  # FAN + 1 numbers
        if number == 0 and (found[grid[-1]] > target or (entropy is not None and found[0.0] < entropy - 1e-9)):
            raise ValueError(f"no exponent in [0, {high:g}] meets {'max_repeats=%g' % max_repeats if entropy is None else 'entropy=%g' % entropy}: it gives {found[grid[-1]]:.6g} to {found[0.0]:.6g}")
        met = {a for a, v in found.items() if v <= target}
        if grid[0] in met:
            return grid[0]
        i = next((i for i, a in enumerate(grid) if a in met), FAN)
        low, high = grid[i - 1], grid[i]
    return high


def weights(docs: DataFrame, source: str = "source", max_repeats: float | None = None, entropy: float | None = None, budget_tokens: int | None = None, staging: Staging | None = None) -> DataFrame:
    """(source, docs, tokens, share, weight, quota, passes) of each source; ``quota`` in tokens."""
    staging = staging or Staging(docs.sparkSession, "mixing")
    table = staging.write(docs.select(F.col(source).alias("source"), n_words().alias("n")).groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")), "sources")
    a = exponent(table, max_repeats, entropy, budget_tokens)
    one = table.agg(F.sum("tokens").alias("all")).first()["all"] or 1
    raw = table.withColumn("share", F.col("tokens") / F.lit(float(one))).withColumn("raw", F.pow("share", F.lit(a)))
    z = raw.agg(F.sum("raw").alias("z"), F.max(F.col("tokens") / F.col("raw")).alias("pass")).first()
    budget = float(budget_tokens) if budget_tokens is not None else (z["z"] or 1.0) * (z["pass"] or 1.0)
    weighed = raw.withColumn("weight", F.col("raw") / F.lit(z["z"] or 1.0))
    # rounded to whole tokens; a hair's breadth below a whole pass is a whole pass
    quota = F.round(F.col("weight") * F.lit(budget)).cast("long")
    return weighed.select("source", "docs", "tokens", "share", "weight", F.when(F.abs(quota - F.col("tokens")) <= 1, F.col("tokens")).otherwise(quota).alias("quota")).withColumn("passes", F.col("quota") / F.col("tokens"))


def _placed(docs: DataFrame, source: str = "source", blocks: int = 64, seed: int = 17, range_docs: int = 50_000, max_repeats: float | None = None, entropy: float | None = None, budget_tokens: int | None = None, staging: Staging | None = None) -> DataFrame:
    staging = staging or Staging(docs.sparkSession, "mixing")
    table = staging.write(weights(docs, source, max_repeats, entropy, budget_tokens, staging), "weights")
    rows = docs.select("doc_id", F.col(source).alias("source"), n_words().alias("tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    # sources are few or many: the join is left to the optimiser, which can split a hot source
    known = table.select(F.col("source").alias("s"), F.col("tokens").alias("source_tokens"), "quota", F.greatest(F.ceil(F.col("docs") / range_docs), F.lit(1)).cast("long").alias("ranges"))
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    last = F.ceil(F.col("quota") / F.col("source_tokens")).cast("int")
    each = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))))).where("quota > 0")
    each = each.withColumn("key", key(seed, F.col("pass"), F.col("doc_id"), F.col("digest")))
    each = staging.write(each.withColumn("range", F.expr(f"key DIV ({1 << 60}L DIV ranges)")), "placed")
    staging.keep("placed")
    # only a source's last pass can be cut short
    sums = each.groupBy("source", "pass", "range").agg(F.sum("tokens").alias("n"))
    by_range = Window.partitionBy("source", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "pass", "range", F.coalesce(F.sum("n").over(by_range), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "pass", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    same = ranked.source.eqNullSafe(starts.source) & (ranked["pass"] == starts["pass"]) & (ranked["range"] == starts["range"])
    found = ranked.join(starts, same).select(ranked["*"], starts.before)
    at = F.col("pass") * F.col("source_tokens") + F.col("before") + F.col("within")
    block = F.least(F.floor(at * blocks / F.col("quota")), F.lit(blocks - 1)).cast("int")
    return found.where(at < F.col("quota")).select("doc_id", "source", "tokens", "pass", block.alias("block"), "key", "digest")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The placed rows: id, source, tokens, pass, block and key; a document stands once for each pass that takes it."""
    return _placed(docs, **options).drop("digest")


def apply_mixing(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """The documents, each as often as it was placed; the columns stay the same.

    Rows that share id, text and source are copies of one document; an id may be null.
    """
    of = F.col("doc_id").alias("id"), F.col("digest").alias("digest"), F.col("source").alias("from")
    times = _placed(docs, source=source, **options).groupBy(*of).agg(F.count("*").alias("times"))
    # the input's columns go in one struct, so that no name can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.withColumns({"doc": F.col("row.doc_id"), "text": F.md5(F.coalesce("row.text", F.lit(""))), "source": F.col(f"row.`{source}`")}).dropDuplicates(["doc", "text", "source"])
    kept = rows.join(times, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text") == F.col("digest")) & F.col("source").eqNullSafe(F.col("from")))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
