"""Chat formatting with DataFrame expressions only.

Template. A turn is ``<|turn|>ROLE<|text|>TEXT<|end|>``; adjacent turns of one role share a header and
are parted by ``<|next|>``, so that merging loses no boundary. Inside roles and texts a backslash is put
after the first character of every control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
also where backslashes already stand there), which no other step can undo by accident and which
``parse`` takes away again. Control strings of other templates therefore never appear raw.

Turns are sorted inside parts of ``part_turns`` consecutive turn numbers, each part is rendered on its
own, and only the rendered parts of a conversation meet: a conversation with a third of all rows is
sorted and escaped by many tasks, and the last step sees one row for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
_RAW = r"(<(?=\\*(?:\||/?s>))|\[(?=\\*/?INST\]))"
_MARKED = r"(<(?=\\+(?:\||/?s>))|\[(?=\\+/?INST\]))\\"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED, "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(TEXT))


def format_chats(turns: DataFrame, loss_role: str = "assistant", part_turns: int = 64) -> DataFrame:
    """One formatted text for each conversation.

    Input: ``conv_id``, ``turn``, ``role``, ``text``. Result: ``conv_id``, ``segments`` (array of
    ``text``, ``loss``; their concatenation is the formatted text, ``loss`` marks texts of ``loss_role``)
    and ``formatted``.

    Null roles and texts are empty strings. A null ``conv_id`` is a conversation of its own, null turn
    numbers come first. Rows of equal turn number follow by role, then text; repeated rows are kept as
    repeated turns. An empty table gives no rows.
    """
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / part_turns).cast("long").alias("part"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def render(ts: Column) -> Column:
        """Pieces of a sorted array of turns, without the header of the first and the end of the last."""

        def one(t: Column, i: Column) -> Column:
            before = F.get(ts, i - 1)["role"]
            joint = F.when(i == 0, F.lit("")).when(before == t["role"], F.lit(NEXT)).otherwise(
                F.concat(F.lit(END), _header(escape(t["role"])))
            )
            return F.array(piece(joint, F.lit(False)), piece(escape(t["text"]), t["role"] == loss_role))

        return F.flatten(F.transform(ts, one))

    parts = (
        rows.groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .select(
            "conv_id",
            F.struct(
                F.col("part"),
                F.col("ts")[0]["role"].alias("first"),
                F.element_at("ts", -1)["role"].alias("last"),
                render(F.col("ts")).alias("pieces"),
            ).alias("p"),
        )
    )

    def join_part(p: Column, i: Column) -> Column:
        before = F.get(F.col("ps"), i - 1)["last"]
        joint = F.when(i == 0, _header(escape(p["first"]))).when(before == p["first"], F.lit(NEXT)).otherwise(
            F.concat(F.lit(END), _header(escape(p["first"])))
        )
        return F.concat(F.array(piece(joint, F.lit(False))), p["pieces"])

    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps")).select(
        "conv_id",
        F.concat(
            F.flatten(F.transform("ps", join_part)), F.array(piece(F.lit(END), F.lit(False)))
        ).alias("segments"),
    )
    return whole.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of ``role``, ``text``, unescaped, in order."""
    runs = F.split(formatted, r"<\|end\|>")
    runs = F.slice(runs, 1, F.size(runs) - 1)

    def turns_of(run: Column) -> Column:
        halves = F.split(F.substring(run, len(TURN) + 1, 2**31 - 1), r"<\|text\|>", 2)
        role = unescape(halves[0])
        return F.transform(
            F.split(halves[1], r"<\|next\|>"),
            lambda text: F.struct(role.alias("role"), unescape(text).alias("text")),
        )

    return F.flatten(F.transform(runs, turns_of))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the output of ``format_chats``."""
    loss = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return formatted.select(
        "conv_id", parse(F.col("formatted")).alias("turns"), loss.alias("loss"), "formatted"
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
