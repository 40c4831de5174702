"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar: a conversation is its turns one after another, a turn is an opening mark, the text and the
closing mark of its role: ``[INST]..[/INST]`` (user), ``<<SYS>>..<</SYS>>`` (system), ``<s>..</s>``
(assistant), ``[ROLE=name]..[/ROLE]`` (any other). Inside a text ``\\b`` stands for a backslash,
``\\l`` for the ``[`` and ``\\c`` for the ``<`` that would begin a mark, in a name ``\\r`` for ``]``.

Every turn is first rendered as it stands and parsed again. Where that finds another turn, or a mark
inside the text, the whole conversation is rendered with its texts escaped. The formatted table is
written, read back and parsed whole, and a digest of the recovered turns is compared with that of
the source: a difference stops the job.

The loss mask is a run for each turn: characters to skip and characters to learn from, the latter
being those of assistant texts. A conversation is one string by contract, so its turns meet in one
row; the rows of one conversation are gathered, never those of several.

Edge cases: null texts and roles are empty; turns are ordered by turn, role, text, nulls first, so
ties and repeated rows have one order; a null conv_id is a conversation; an empty table gives no
rows; further columns are ignored; empty texts are turns like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE=", "]", "[/ROLE]")
#: Any mark, and where a turn begins and ends.
CONTROL = r"\[/?INST\]|<</?SYS>>|</?s>|\[ROLE=|\[/ROLE\]"
TURN = r"(?s)\[INST\].*?\[/INST\]|<<SYS>>.*?<</SYS>>|<s>.*?</s>|\[ROLE=[^\]]*\].*?\[/ROLE\]"
ROLES_LEARNT = ("assistant",)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.regexp_replace(out, r"\[(?=/?INST\]|ROLE=|/ROLE\])", r"\\l")
    return F.regexp_replace(out, r"<(?=/?s>|</?SYS>>)", r"\\c")


def unescape(text: Column) -> Column:
    for code, sign in (("\\l", "["), ("\\c", "<"), ("\\r", "]"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def render(role: Column, text: Column, escaped: bool) -> Column:
    name = F.replace(escape(role), F.lit("]"), F.lit("\\r")) if escaped else role
    text = escape(text) if escaped else text
    out = F.concat(F.lit(OTHER[0]), name, F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for known, (begin, end) in MARKS.items():
        out = F.when(role == known, F.concat(F.lit(begin), text, F.lit(end))).otherwise(out)
    return out


def _bounds(piece: Column) -> tuple[Column, Column, Column]:
    """Role, length of the opening mark, length of both marks."""
    begin = F.position(F.lit("]"), piece)
    role, both = unescape(F.substring(piece, F.lit(len(OTHER[0]) + 1), begin - len(OTHER[0]) - 1)), begin + len(OTHER[2])
    for known, (a, b) in MARKS.items():
        own = F.startswith(piece, F.lit(a))
        role, begin, both = F.when(own, known).otherwise(role), F.when(own, len(a)).otherwise(begin), F.when(own, len(a) + len(b)).otherwise(both)
    return role, begin, both


def parse_turn(piece: Column) -> Column:
    """(role, text) of a turn as the grammar has it."""
    role, begin, both = _bounds(piece)
    return F.struct(role.alias("role"), unescape(F.substring(piece, begin + 1, F.char_length(piece) - both)).alias("text"))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order."""
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def loss_run(piece: Column) -> Column:
    """(skip, take): formatted characters before the learnt ones of this turn, and those."""
    role, begin, both = _bounds(piece)
    learnt = role.isin(*ROLES_LEARNT)
    return F.struct(F.when(learnt, begin).otherwise(F.char_length(piece)).alias("skip"), F.when(learnt, F.char_length(piece) - both).otherwise(0).alias("take"))


def _digest(turns: Column) -> Column:
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns_sha256 of the source), written in the shared folder, from rows of
    conv_id, turn, role, text."""
    empty = F.lit("")
    turns = rows.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    plain = render(F.col("role"), F.col("text"), False)
    found = F.expr("parsed.role = role AND parsed.text = text")
    turns = turns.withColumn("plain", plain).withColumn("parsed", parse_turn(F.col("plain")))
    marks = F.size(F.regexp_extract_all("plain", F.lit(CONTROL), F.lit(0)))
    same = found & (marks == 2) & (F.element_at(pieces(F.col("plain")), 1) == F.col("plain"))
    turns = turns.withColumn("clean", F.coalesce(same, F.lit(False))).withColumn("safe", F.when(F.col("clean"), F.lit(None)).otherwise(render(F.col("role"), F.col("text"), True)))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "safe"))).alias("turns"), F.min("clean").alias("clean"))
    shown = F.transform("turns", lambda t: F.when(F.col("clean"), render(t["role"], t["text"], False)).otherwise(F.coalesce(t["safe"], render(t["role"], t["text"], True))))
    return common.materialize(whole.select("conv_id", F.array_join(shown, "").alias("formatted"), _digest(F.col("turns")).alias("turns_sha256")), "chats")


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, turns_sha256, loss_runs) of formatted conversations; if
    turns_sha256 is among the input's columns, other turns than the source's are an error."""
    cut = formatted.withColumn("pieces", pieces(F.col("formatted")))
    cut = cut.withColumn("turns", F.transform("pieces", parse_turn)).withColumn("seen", _digest(F.col("turns")))
    if "turns_sha256" in formatted.columns:
        same = (F.col("seen") == F.col("turns_sha256")) & (F.array_join("pieces", "") == F.col("formatted"))
        cut = cut.withColumn("seen", F.when(same, F.col("seen")).otherwise(F.raise_error(F.concat(F.lit("not the source's turns: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
    return cut.select("conv_id", "formatted", "turns", F.col("seen").alias("turns_sha256"), F.transform("pieces", loss_run).alias("loss_runs"), "pieces")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema))
    back = parse_conversations(format_conversations(rows))
    masked = F.transform(F.arrays_zip("pieces", "loss_runs"), lambda x: F.substring(x["pieces"], x["loss_runs"]["skip"] + 1, x["loss_runs"]["take"]))
    learnt = F.array_join(F.transform(masked, unescape), "")
    out = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "turns_sha256", learnt.alias("learnt"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
d AS (SELECT *, length(text) - length(replace(text, '\', '')) AS slashes,
    (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '[ROLE=', ''))) // 6 + (length(text) - length(replace(text, '[/ROLE]', ''))) // 7
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8 AS marks,
    CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 ELSE 14 + length(role) END AS extra FROM c),
e AS (SELECT *, bool_or(marks > 0 OR contains(text, '\b') OR contains(text, '\l') OR contains(text, '\c') OR contains(text, '\r')) OVER (PARTITION BY conv_id) AS escaped FROM d)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(text) + extra + CASE WHEN escaped THEN slashes + marks ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
