"""Training examples from session exchanges: one per reply, with all that came before as context.

A session is an exchange of requests and responses, one row per turn. Its template is

    <|im_start|>ROLE
    TEXT<|im_end|>

with a line feed after each end mark. Inside texts every ``\\`` and ``<`` gets a ``\\`` behind it, so
no control string can occur there and the change can be undone; roles are written in URL encoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.llm.store import column

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
REPLY = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<])\\", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.url_encode(F.coalesce(role, F.lit(""))), F.lit("\n"))


def reply_examples(
    exchanges: DataFrame, session: str = "session", frame_index: str = "frame_index", role: str = "role", payload: str = "payload",
) -> DataFrame:
    """Every assistant turn as an example of its own.

    Returns ``session``, ``example`` (1, 2, ... per session), ``formatted``, and the mask of the one trainable
    reply in it as ``loss_start`` and ``loss_end`` (code points, end exclusive). Turns behind the last
    reply, or of a session without reply, form a last example with an empty mask, so no turn is lost.

    A null payload is an empty text, a null role an empty role. Turns are ordered by ``frame_index``, nulls
    first, equal ones by role and text; repeated rows stay repeated. Rows with a null session
    form one session. Other columns are ignored. An empty table gives no example. A session is the unit
    of an example and is put together in one row.
    """
    turn = F.struct(column(frame_index).alias("at"), F.coalesce(column(role), F.lit("")).alias("role"), F.coalesce(column(payload), F.lit("")).alias("text"))
    sessions = exchanges.select(column(session).alias("session"), turn.alias("turn")).groupBy("session").agg(
        F.array_sort(F.collect_list("turn"), lambda a, b: F.when(a.at.eqNullSafe(b.at) & (a.role == b.role) & (a.text == b.text), 0)
                     .when(_before(a, b), -1).otherwise(1)).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(_head(t.role).alias("head"), escaped(t.text).alias("body"), (t.role == REPLY).alias("reply")))
    cut = F.filter(F.transform("parts", lambda p, i: F.when(p.reply | (i == F.size("parts") - 1), i + 1)), lambda i: i.isNotNull())
    examples = (
        sessions.select("session", parts.alias("parts"))
        .select("session", "parts", F.posexplode(cut).alias("example", "upto"))
        .select("session", (F.col("example") + 1).cast("long").alias("example"), F.col("parts")[F.col("upto") - 1].alias("last"),
                F.concat_ws("", F.transform(F.slice("parts", 1, F.col("upto") - 1), lambda p: F.concat(p.head, p.body, F.lit(END)))).alias("context"))
        .withColumn("formatted", F.concat("context", "last.head", "last.body", F.lit(END)))
    )
    begin = F.char_length("context") + F.char_length("last.head")
    return examples.select(
        "session", "example", "formatted", begin.cast("long").alias("loss_start"),
        (begin + F.when(F.col("last.reply"), F.char_length("last.body")).otherwise(0)).cast("long").alias("loss_end"))


def _before(a: Column, b: Column) -> Column:
    """Turn order: index with nulls first, then role, then text."""
    same = a.at.eqNullSafe(b.at)
    earlier = (a.at.isNull() & b.at.isNotNull()) | F.coalesce(a.at < b.at, F.lit(False))
    return earlier | (same & (a.role < b.role)) | (same & (a.role == b.role) & (a.text < b.text))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example as an array of (``role``, ``text``)."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        F.url_decode(F.regexp_extract(p, r"^<\|im_start\|>([^\n]*)\n", 1)).alias("role"),
        unescaped(F.regexp_replace(p, r"^<\|im_start\|>[^\n]*\n", "")).alias("text")))


def read_loss(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    """The text under the mask, without escapes."""
    return unescaped(F.substring(formatted, (loss_start + 1).cast("int"), (loss_end - loss_start).cast("int")))
