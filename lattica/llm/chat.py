"""Chat formatting with typed content parts, with DataFrame operations only.

A message is a list of parts: text, image, audio or document. Visiting a message turns it into text: text parts are
escaped, every other part becomes a placeholder, in order, whose reference and number of tokens after expansion are
recorded. Turns are marked, and the code points that training learns from are recorded as spans. `read_turns` and
`read_masked` read a formatted conversation back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A part. text: of a text part; uri: what another part refers to; width, height in pixels; seconds; pages.
PART = "struct<type: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"
#: Types of parts that have a placeholder of their own; any other type than text is an attachment.
KINDS = ("image", "audio", "document")

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>\n"
#: Marks an escaped control string (an invisible separator); it stands after the string's first character.
STUFF = "\u2063"
#: What must not stand in a text as it is: this template's marks and those of other ones, as the first character, any
#: number of marks of escaping, and the rest. No such string begins inside another one.
_FIRST, _REST = r"([<\[])", r"(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\]|/?(?:start|end)_of_turn>)"
CONTROL, STUFFED = f"{_FIRST}({STUFF}*){_REST}", f"{_FIRST}{STUFF}({STUFF}*){_REST}"
_MARK = r"<\|(text|image|audio|document|attachment)\|>"


@dataclass(frozen=True)
class Expansion:
    """Tokens that an attachment becomes: an image one for each tile, audio by its length, a document by its pages."""

    tile: int = 28
    audio_per_second: float = 25.0
    per_page: int = 256
    unknown: int = 1


def escaped(text: Column) -> Column:
    """text with one more STUFF in every control string, stuffed or not, so that none is left as it is and nothing is lost."""
    return F.regexp_replace(text, CONTROL, f"$1{STUFF}$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, STUFFED, "$1$2$3")


def text_parts(text: Column) -> Column:
    """A message of one text part; a null is an empty text."""
    empty = lambda kind: F.lit(None).cast(kind)
    fields = {"type": F.lit("text"), "text": F.coalesce(text, F.lit("")), "uri": empty("string"), "width": empty("int"), "height": empty("int"), "seconds": empty("double"), "pages": empty("int")}
    return F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _kind(part: Column) -> Column:
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind.isin("text", *KINDS), kind).otherwise("attachment")


def visited(parts: Column) -> Column:
    """A message's parts as text. A single text stands by itself; otherwise each part begins with the mark of its type."""
    marked = F.transform(parts, lambda p: F.concat(F.lit("<|"), _kind(p), F.lit("|>"), F.when(_kind(p) == "text", escaped(F.coalesce(p["text"], F.lit("")))).otherwise("")))
    alone = (F.size(parts) == 1) & (_kind(F.get(parts, 0)) == "text")
    return F.when(alone, escaped(F.coalesce(F.get(parts, 0)["text"], F.lit("")))).otherwise(F.array_join(marked, ""))


def tokens(part: Column, sizes: Expansion) -> Column:
    """Tokens that a part's placeholder is expanded to, at least one; 0 for text, which no placeholder stands for."""
    tiles = F.ceil(part["width"] / sizes.tile) * F.ceil(part["height"] / sizes.tile)
    by_kind = F.when(_kind(part) == "image", tiles).when(_kind(part) == "audio", F.ceil(part["seconds"] * sizes.audio_per_second)).when(_kind(part) == "document", part["pages"] * sizes.per_page)
    return F.when(_kind(part) == "text", 0).otherwise(F.greatest(F.lit(1), F.coalesce(by_kind, F.lit(sizes.unknown)))).cast("long")


def attachments(parts: Column, sizes: Expansion) -> Column:
    """array<struct<part, type, uri, tokens>>: the parts that are no text, in order, with their places in the message."""
    seen = F.transform(parts, lambda p, i: F.struct(i.cast("long").alias("part"), _kind(p).alias("type"), p["uri"].alias("uri"), tokens(p, sizes).alias("tokens")))
    return F.filter(seen, lambda a: a["type"] != "text")


def formatted(turns: DataFrame, parts: str | None = None, learn: tuple[str, ...] = ("assistant",), sizes: Expansion = Expansion()) -> DataFrame:
    """(conv_id, n_turns, formatted, spans, attachments, attachment_tokens) of turns (conv_id, turn, role, text); more columns don't matter.

    parts: the name of a column array<PART> to take the messages from; without it, and where it is null or empty, a
    message is its text. spans: for each turn its role, the message's first code point in formatted and in its own turn,
    from 0, its length, and loss, whether its role is one of `learn`. Turns are in order of turn (null first), then role
    and text, so repeated rows stay. Null roles and texts are ''; rows without conv_id are one conversation. A
    conversation is formatted whole, so its text must fit into a string of Spark's (2 GB). No rows give no rows.
    """
    message = text_parts(F.col("text"))
    if parts is not None:
        given = F.col(parts).cast(f"array<{PART}>")
        message = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(message)
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), message.alias("parts"))
    rows = rows.select("conv_id", "turn", "role", visited(F.col("parts")).alias("body"), attachments(F.col("parts"), sizes).alias("found"))
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(MESSAGE))
    rows = rows.withColumns({"piece": F.concat(head, "body", F.lit(END)), "offset": F.length(head).cast("long")})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumns({"place": F.row_number().over(order), "before": F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    span = F.struct("role", (F.col("before") + F.col("offset")).alias("start"), "offset", F.length("body").cast("long").alias("length"), F.col("role").isin(*learn).alias("loss"))
    found = F.transform("found", lambda a: F.struct((F.col("place") - 1).cast("long").alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece", span.alias("span"), found.alias("found")))).alias("t"))
    out = whole.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join("t.piece", "").alias("formatted"), F.col("t.span").alias("spans"), F.flatten("t.found").alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def _pieces(text: Column) -> Column:
    """The turns of a formatted conversation, each without the mark that begins it."""
    parts = F.split(text, F.lit(r"<\|start\|>"))
    return F.slice(parts, F.lit(2), F.size(parts))


def _parts(body: Column) -> Column:
    texts, kinds = F.split(body, F.lit(_MARK)), F.regexp_extract_all(body, F.lit(_MARK), F.lit(1))
    part = lambda kind, text: F.struct(kind.alias("type"), unescaped(text).alias("text"))
    several = F.transform(kinds, lambda k, i: part(k, F.get(texts, i + 1)))
    return F.when(F.size(kinds) == 0, F.array(part(F.lit("text"), body))).otherwise(several)


def read_turns(text: Column) -> Column:
    """array<struct<role, parts array<struct<type, text>>>>: the turns of a formatted conversation, unescaped; no text but in text parts."""

    def turn(piece: Column) -> Column:
        two = F.split(piece, F.lit(r"<\|message\|>"))
        body = F.get(two, 1)
        return F.struct(unescaped(F.get(two, 0)).alias("role"), _parts(F.substring(body, F.lit(1), F.length(body) - len(END))).alias("parts"))

    return F.transform(_pieces(text), turn)


def read_masked(text: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, span by span; each span is taken from its own turn, so the whole is read once."""
    taken = F.zip_with(_pieces(text), spans, lambda piece, s: F.when(s["loss"], F.substring(F.concat(F.lit(START), piece), (s["offset"] + 1).cast("int"), s["length"].cast("int"))).otherwise(""))
    return F.array_join(F.transform(taken, unescaped), "")


def chat_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted conversations."""
    done = formatted(turns)
    read = done.select("conv_id", "n_turns", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), read_masked(F.col("formatted"), F.col("spans")).alias("loss"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(F.transform(t["parts"], lambda p: p["text"]), ""), F.lit("\n")))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
