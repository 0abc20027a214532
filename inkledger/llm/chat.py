"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor flattens each message's parts in order: text is escaped, an image, audio or document part becomes a numbered
placeholder with a record of its reference and of the tokens it expands to. Messages are framed by control strings; a
control string inside a text gets a backslash after its first character (one more if it has some), so texts read back
exactly. All work on texts is done on message rows before a conversation's rows meet.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Frames of roles; any other role (null: empty) is written out in a frame of its own.
FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER, SAYS, OTHER_END = "[ROLE]", "[SAYS]", "[/ROLE]"
#: What must not stand in a text as it is, without its first character: frames and placeholders.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|/?ROLE\]|SAYS\]|(?:IMAGE|AUDIO|DOCUMENT) \d+\])"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")
ENDS = r"\[/INST\]|</s>|<</SYS>>|\[/ROLE\]"
PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType())])


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder stands for; parts without a size count once."""

    patch: int = 14
    audio_rate: float = 12.5
    page_tokens: int = 258
    visitors: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def visit(self, part: Column) -> Column:
        """Expanded tokens of one part, by its type; types unknown here count their text."""
        known = {
            "image": lambda p: F.ceil(p["width"] / self.patch) * F.ceil(p["height"] / self.patch),
            "audio": lambda p: F.ceil(p["seconds"] * self.audio_rate),
            "document": lambda p: p["pages"] * self.page_tokens,
        } | self.visitors
        out = text_tokens(part["text"])
        for kind, tokens in known.items():
            out = F.when(part["type"] == kind, F.coalesce(tokens(part).cast("long"), F.lit(1))).otherwise(out)
        return out.cast("long")


def text_tokens(text: Column) -> Column:
    """Runs of non-blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]
    return F.struct(F.lit("text").alias("type"), text.alias("text"), *none)


def frame(role: Column) -> tuple[Column, Column]:
    """Opening and closing strings of a message."""
    head, tail = F.concat(F.lit(OTHER), escape(role), F.lit(SAYS)), F.lit(OTHER_END)
    for name, (a, b) in FRAMES.items():
        head, tail = F.when(role == name, a).otherwise(head), F.when(role == name, b).otherwise(tail)
    return head, tail


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", expansion: Expansion = Expansion()) -> DataFrame:
    """One row for each conversation: conv, formatted, loss_spans, attachments, n_turns, expanded_tokens.

    ``loss_spans`` are (start, length) in code points of the formatted text, one for each assistant message's content.
    ``attachments`` are (number, type, ref, tokens) in order. Messages go by turn (nulls first), then role, then the
    flattened text, so ties and repeated rows have a fixed order. Null roles and texts count as empty, null parts or an
    empty list as no content; rows with a null conversation form one conversation. Other columns are not read.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(parts, F.array().cast(T.ArrayType(PART))).alias("parts"))
    is_media = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
    flat = F.transform("parts", lambda p: F.struct(is_media(p).alias("media"), F.when(is_media(p), F.upper(p["type"])).otherwise(escape(F.coalesce(p["text"], F.lit("")))).alias("text"), p["type"].alias("type"), p["ref"].alias("ref"), expansion.visit(p).alias("tokens")))
    rows = rows.select("conv", "turn", "role", flat.alias("flat")).withColumn("n_media", F.size(F.filter("flat", lambda p: p["media"])).cast("long"))
    rows = rows.withColumn("order_text", F.array_join(F.transform("flat", lambda p: p["text"]), ""))
    order = Window.partitionBy("conv").orderBy("turn", "role", "order_text")
    rows = rows.withColumn("media_before", F.sum("n_media").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    at = F.coalesce("media_before", F.lit(0)).cast("long")
    number = lambda i: at + F.size(F.filter(F.slice("flat", 1, i), lambda q: q["media"]))
    mixed = F.array_join(F.transform("flat", lambda p, i: F.when(p["media"], F.concat(F.lit("["), p["text"], F.lit(" "), number(i).cast("string"), F.lit("]"))).otherwise(p["text"])), "")
    head, tail = frame(F.col("role"))
    content = F.when(F.col("n_media") == 0, F.col("order_text")).otherwise(mixed)
    media = F.filter(F.transform("flat", lambda p, i: F.struct(p["media"].alias("media"), F.struct(number(i).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")).alias("at"))), lambda x: x["media"])
    attached = F.when(F.col("n_media") > 0, F.transform(media, lambda x: x["at"]))
    tokens = F.aggregate("flat", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    rows = rows.select("conv", "turn", "role", "order_text", head.alias("head"), content.alias("content"), tail.alias("tail"), attached.alias("attached"), tokens.alias("tokens"))
    size = F.char_length("head") + F.char_length("content") + F.char_length("tail")
    rows = rows.withColumn("end", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.struct("end", F.concat("head", "content", "tail").alias("piece"), F.when(F.col("role") == "assistant", F.struct((F.col("end") - size + F.char_length("head")).alias("start"), F.char_length("content").cast("long").alias("length"))).alias("loss"), "attached", "tokens")
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return whole.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("p", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss_spans"),
        F.flatten(F.filter(F.transform("p", lambda x: x["attached"]), lambda x: x.isNotNull())).alias("attachments"),
        F.size("p").cast("long").alias("n_turns"),
        F.aggregate(F.transform("p", lambda x: x["tokens"]), F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The messages of a formatted conversation, unescaped: array of (role, text). Placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, ENDS), lambda x: x != "")

    def one(x: Column) -> Column:
        says = F.locate(SAYS, x)
        role, text = unescape(F.substring(x, F.lit(len(OTHER) + 1), says - 1 - len(OTHER))), F.substring(x, says + len(SAYS), F.char_length(x))
        for name, (head, _) in FRAMES.items():
            mine = x.startswith(head)
            role, text = F.when(mine, name).otherwise(role), F.when(mine, F.substring(x, F.lit(len(head) + 1), F.char_length(x))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """The corpus query: all conversations and number -1, digests read back from the formatted text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    chats = format_chats(rows.unionAll(extra).withColumn("parts", F.array(text_part(F.col("text")))))
    back = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens")


#: The same digests straight from the table; the formatted length adds frames and one backslash for each escape.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|/?ROLE\]|SAYS\]|(?:IMAGE|AUDIO|DOCUMENT) \d+\])', '\1\\\2\3', 'g') AS escaped,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
      ELSE 19 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|/?ROLE\]|SAYS\]|(?:IMAGE|AUDIO|DOCUMENT) \d+\])', '\1\\\2\3', 'g')) END AS frame
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, escaped)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, escaped) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + frame)::BIGINT AS formatted_chars,
  sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS expanded_tokens
FROM sized GROUP BY conv_id
"""
