"""Chat formatting that can be read back without loss. Only DataFrame functions.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<s>[INST]" role "[/INST]" text "</s>\\n"

Neither role nor text may hold one of the control strings ``<s> </s> [INST] [/INST]``. The escape puts one backslash behind
the opening bracket of a control string, and one more into what already looks escaped (``<s>`` to ``<\\s>``, ``<\\s>`` to
``<\\\\s>``), so it can always be undone and leaves all other text as it is.

Round trip: a conversation is rendered as it stands, parsed again and compared with its source turns; if they differ, its
contents are escaped and it is parsed again. One round is enough, because escaped content holds no control string and
unescaping is the escape's inverse; anything else stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE, END = "<s>[INST]", "[/INST]", "</s>", "</s>\n"
CONTROL = r"[<\[]/?(?:s>|INST\])"
ESCAPED_FORM = r"([<\[])\\(\\*/?(?:s>|INST\]))"
PLAIN_FORM = r"([<\[])(\\*/?(?:s>|INST\]))"
TURN = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN_FORM, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED_FORM, "$1$2")


def _render(turns: Column, content) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), content(t["role"]), F.lit(MIDDLE), content(t["text"]), F.lit(END))), "")


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; null if there is none."""
    start = F.length(_before(text, mark)) + len(mark) + 1
    return F.when(F.contains(text, F.lit(mark)), F.substr(text, start))


def _turn(piece: Column, content) -> Column:
    """A turn from what follows its opening; null when it breaks the grammar."""
    role, rest = _before(piece, MIDDLE), _after(piece, MIDDLE)
    text, tail = _before(rest, CLOSE), _after(rest, CLOSE)
    good = (tail == "\n") & ~F.rlike(role, F.lit(CONTROL)) & ~F.rlike(text, F.lit(CONTROL))
    return F.when(good, F.struct(content(role).alias("role"), content(text).alias("text")))


def _parse(formatted: Column, content) -> Column:
    """The turns, null if the text as a whole breaks the grammar. Pieces are cut where a turn opens."""
    pieces = F.split(formatted, r"<s>\[INST\]", -1)
    turns = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: _turn(p, content))
    return F.when((F.element_at(pieces, 1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped; null if it breaks the grammar."""
    return _parse(formatted, unescape)


def masked(formatted: Column, learnt: str = "assistant") -> Column:
    """The stretches of a formatted conversation under the loss mask, as they stand there: texts of one role."""
    own = F.filter(_parse(formatted, lambda c: c), lambda t: unescape(t["role"]) == learnt)
    return F.transform(own, lambda t: t["text"])


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv_id, formatted``: one row per conversation.

    Turns stand in order of their number (nulls first); equal numbers by role, then text; repeated rows are all kept. A
    null role or text is empty. Rows with a null conversation id are one conversation. An empty table gives no rows;
    other columns are not read. A conversation is one text, so it must fit into one row.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("row")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("row")).alias("source"))
    source = grouped.select("conv_id", F.transform("source", lambda t: F.struct(t["role"], t["text"])).cast(
        f"array<{TURN}>").alias("source"))
    plain = source.withColumn("plain", _render(F.col("source"), lambda c: c))
    checked = plain.withColumn("same", F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    escaped = checked.withColumn("formatted", F.when(F.col("same"), F.col("plain")).otherwise(
        _render(F.col("source"), escape)))
    same = F.col("same") | F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("conversation cannot be read back: "), F.col("conv_id").cast("string")))
    return escaped.select("conv_id", F.when(same, F.col("formatted")).otherwise(failed.cast("string")).alias("formatted"))
