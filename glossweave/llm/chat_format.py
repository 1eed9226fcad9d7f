"""Chat formatting of typed content parts, with DataFrame functions only.

A turn holds a list of parts (text, image, audio, document).  A visitor goes
through them in order: a text part gives its text, any other part gives a
placeholder of its kind, an entry in the list of attachments (turn, place, kind,
reference, expanded tokens) and its expanded token count.  A turn with a plain
text column is one text part.

Template: ``<|turn|>role<|body|>content<|end|>`` per turn, with
``<|part:kind:reference:units|>`` for what isn't text.  In roles and texts a
backslash is doubled and every ``<`` is followed by one more backslash, so no
``<|`` stands in them, nor where one part ends and the next begins; kinds and
references are percent-encoded.  No content can open, close or imitate a control
string, and `read_back` restores all of it.  Text parts side by side read back
as one.

The loss mask lists the spans (code points) of the assistant's texts inside the
formatted string; placeholders and markup are outside it.

Places are running sums over the pieces of a conversation, in a window, so a long
conversation costs its length.  A null text is empty, a null role is an empty
role, a null part kind is text, a null or negative number of units is 1 or 0, a
null turn comes first; equal turns are ordered by role, then content.  A
conversation is one output row, however long; conversations without an id are
one conversation.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END, PART, PART_END = "<|turn|>", "<|body|>", "<|end|>", "<|part:", "|>"

#: Tokens that one unit of a part stands for: an image by tiles, audio by seconds, a document by pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}

PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"
#: What stands for itself neither in a kind nor in a reference; the percent sign is coded first and read last.
CODED = {"%": "%25", "<": "%3C", "|": "%7C", ":": "%3A"}


def escape(text: Column) -> Column:
    """Text in which no ``<`` stands before a ``|``, nor at its end."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    """What `escape` was given."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("\\\\"), F.lit("\\"))


def encode(name: Column) -> Column:
    """A kind or a reference inside a placeholder."""
    for plain, code in CODED.items():
        name = F.replace(name, F.lit(plain), F.lit(code))
    return name


def decode(name: Column) -> Column:
    """What `encode` was given."""
    for plain, code in reversed(CODED.items()):
        name = F.replace(name, F.lit(code), F.lit(plain))
    return name


def text_part(text: Column) -> Column:
    """A list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


PIECE = "struct<out:string,loss:boolean,kind:string,ref:string,tokens:bigint>"


def _visit(parts: Column, learned: Column) -> Column:
    """Each part as the piece of output it becomes; a text's kind is empty."""
    known = F.create_map(*[F.lit(x) for kv in UNIT_TOKENS.items() for x in kv])

    def one(p: Column) -> Column:
        kind = F.lower(F.coalesce(p.kind, F.lit("text")))
        is_text = kind == "text"
        units = F.greatest(F.coalesce(p.units, F.lit(1)), F.lit(0))
        ref = F.coalesce(p.ref, F.lit(""))
        mark = F.concat(F.lit(PART), encode(kind), F.lit(":"), encode(ref), F.lit(":"), units.cast("string"), F.lit(PART_END))
        return F.struct(
            F.when(is_text, escape(F.coalesce(p.text, F.lit("")))).otherwise(mark),
            is_text & learned,
            F.when(is_text, F.lit("")).otherwise(kind),
            ref,
            F.when(is_text, F.lit(0)).otherwise(units * F.coalesce(F.element_at(known, kind), F.lit(1))),
        ).cast(PIECE)

    return F.transform(F.coalesce(parts, F.array().cast(PARTS)), one)


def _markup(*out: Column) -> Column:
    return F.array(F.struct(F.concat(*out), F.lit(False), F.lit(""), F.lit(""), F.lit(0)).cast(PIECE))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: (conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens).

    ``turns`` has conv_id, turn, role, and ``parts`` or else ``text``; anything
    else in it is ignored.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else text_part(F.col("text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    # one exchange, by conversation: the windows and the last grouping keep to it
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "parts")) - 1)
    pieces = F.concat(_markup(F.lit(TURN), escape(F.col("role")), F.lit(BODY)), _visit(F.col("parts"), F.col("role") == loss_role), _markup(F.lit(END)))
    each = numbered.select("conv_id", "i", F.posexplode(pieces).alias("j", "p")).select("conv_id", "i", "j", "p.*")
    before = Window.partitionBy("conv_id").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.length("out")).over(before).cast("int"))
    grouped = placed.groupBy("conv_id").agg((F.max("i") + 1).cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("i", "j", "out", "loss", "kind", "ref", "tokens", "end"))).alias("pieces"), F.sum("tokens").alias("expanded_tokens"))
    start = lambda p: p["end"] - F.length(p.out)
    return grouped.select(
        "conv_id", "n_turns",
        F.array_join(F.transform("pieces", lambda p: p.out), "").alias("formatted"),
        F.transform(F.filter("pieces", lambda p: p.loss), lambda p: F.struct(start(p).alias("start"), p["end"].alias("end"))).alias("loss_spans"),
        F.transform(F.filter("pieces", lambda p: p.kind != ""), lambda p: F.struct(p.i.alias("turn"), start(p).alias("start"), p.kind.alias("kind"), p.ref.alias("ref"), p.tokens.alias("tokens"))).alias("attachments"),
        "expanded_tokens",
    )


def _parts(body: Column) -> Column:
    """The parts of a turn's content; texts side by side are one."""
    mark = r"<\|part:([^<|:]*):([^<|:]*):([0-9]+)\|>"
    # before and after each placeholder stands a text, empty or not
    texts, marks = F.split(body, mark, -1), F.regexp_extract_all(body, F.lit(mark), F.lit(0))

    def part(kind: Column, text: Column, ref: Column, units: Column) -> Column:
        return F.struct(kind, text, ref, units).cast("struct<kind:string,text:string,ref:string,units:int>")

    none = F.lit(None)

    def both(t: Column, m: Column) -> Column:
        own = F.when(t != "", F.array(part(F.lit("text"), unescape(t), none, none))).otherwise(F.array().cast(PARTS))
        other = F.array(part(decode(F.regexp_extract(m, mark, 1)), none, decode(F.regexp_extract(m, mark, 2)), F.regexp_extract(m, mark, 3)))
        return F.when(m.isNull(), own).otherwise(F.concat(own, other))

    return F.flatten(F.zip_with(texts, marks, both))


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (role, text, parts) and ``loss_text``, parsed from the formatted string and its spans alone; ``text`` is that of the text parts."""
    raw = F.slice(F.split(F.col("formatted"), r"<\|turn\|>", -1), 2, 1 << 30)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, BODY, 1)
        body = F.replace(F.substr(x, F.length(role) + len(BODY) + 1), F.lit(END), F.lit(""))
        text = F.regexp_replace(body, r"<\|part:[^<]*?\|>", "")
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), _parts(body).alias("parts"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s.start + 1, s["end"] - s.start))), "")
    return formatted.withColumn("turns", F.transform(raw, turn)).withColumn("loss_text", loss)
