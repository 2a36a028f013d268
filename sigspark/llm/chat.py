"""Chat formatting by prefix-target expansion: every assistant turn is an example with all earlier turns as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.scalar import let
from sigspark.llm.common import running_sums

#: The template. No text or role can hold "<|" once it is escaped, so these strings occur only where the template puts them.
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TARGET = "assistant"


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def format_conversations(turns: DataFrame, target: str = TARGET) -> DataFrame:
    """(conv_id, n_turns, formatted, targets), one row a conversation.

    ``formatted`` is all turns in the template; ``targets`` has (turn, context_end, start, end)
    for each ``target`` turn, in code points: what stands before ``context_end`` and the turn's
    header are context, and only start..end carries loss. An example is thus a prefix of
    ``formatted``, so a conversation's text is kept once, not once for each example;
    ``expand_examples`` writes the examples out.

    Rows are ordered by turn (null first), then role and text; repeated rows each count.
    Null role and text are empty. Rows whose conv_id is null are one conversation. An empty
    table gives no rows; other columns are ignored. A conversation is the unit of output and
    is held in one row; conversations are spread by a hash of their id.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    begin = F.coalesce(F.sum(F.length("piece").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.withColumn("n", F.row_number().over(by)).withColumn("context_end", begin)
    start = F.col("context_end") + F.length("head")
    span = F.when(F.col("role") == target, F.struct("n", "turn", "context_end", start.alias("start"), (start + F.length("body")).alias("end")))
    packed = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("targets"),
    )
    return packed


def expand_examples(conversations: DataFrame, keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """(conv_id, example, turn, context_chars, context, reply) from ``format_conversations``: one row for each target turn.

    ``context`` is the formatted conversation up to and with the turn's header, ``reply`` its
    trainable text, both as formatted. Contexts are cut where they are read: without them the
    work is linear in a conversation, as replies are cut from the turns they lie in. Null ids
    stay; conversations without a target turn give no row, or with ``outer`` one without an
    example; empty tables give none. Columns named in ``keep`` are repeated in each row.
    """
    def cut(pieces: Column, places: Column) -> Column:
        def example(t: Column) -> Column:
            i = t["n"] - 1
            skip = t["start"] - F.get(places, i) - len(START)
            reply = F.substring(F.get(pieces, i), (skip + 1).cast("int"), (t["end"] - t["start"]).cast("int"))
            return F.struct(t["turn"].alias("turn"), t["start"].alias("context_chars"), reply.alias("reply"))

        return F.transform("targets", example)

    # Bound once: the optimizer would write the splitting into each lambda that names it.
    made = let(_pieces(F.col("formatted")), lambda pieces: let(_places(pieces), lambda places: cut(pieces, places)))
    explode = F.posexplode_outer if outer else F.posexplode
    each = conversations.withColumn("examples", made).select("conv_id", "formatted", *keep, explode("examples").alias("example", "e"))
    context = F.substring(F.col("formatted"), F.lit(1), F.col("e.context_chars").cast("int"))
    return each.select("conv_id", "example", "e.turn", "e.context_chars", context.alias("context"), "e.reply", *keep)


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted conversation, unescaped."""
    return F.transform(_pieces(formatted), _turn)


def _pieces(formatted: Column) -> Column:
    """What follows each ``START``, as written."""
    return F.slice(F.split(formatted, r"\Q" + START + r"\E", -1), 2, 1 << 30)


def _turn(piece: Column) -> Column:
    return F.struct(
        unescape(F.replace(F.substring_index(piece, "\n", 1), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
        unescape(F.substring(piece, F.instr(piece, F.lit("\n")) + 1, F.length(piece) - F.instr(piece, F.lit("\n")) - len(END) - 1)).alias("text"),
    )


def _places(pieces: Column) -> Column:
    """Where in a formatted conversation each of its pieces has its ``START``."""
    return running_sums(F.transform(pieces, lambda p: (F.length(p) + len(START)).cast("long")))


def digests(conversations: DataFrame) -> DataFrame:
    """What can be read back from ``format_conversations`` and its examples: counts and hashes of all turns, and of all text under the loss mask, in order.

    Turns are read from ``formatted``, the text under the mask from the replies of
    ``expand_examples``. One row a conversation; one without a target has an empty loss; an
    empty table gives no rows.
    """
    def back(pieces: Column) -> Column:
        said = F.transform(pieces, lambda p: let(_turn(p), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
        return F.struct(F.size(pieces).cast("long").alias("n"), F.sha2(F.array_join(said, ""), 256).alias("said"))

    whole = F.struct(let(_pieces(F.col("formatted")), back).alias("turns"), F.length("formatted").cast("long").alias("chars"))
    examples = expand_examples(conversations.withColumn("whole", whole), ("whole",), outer=True)
    reply = F.when(F.col("example").isNotNull(), F.struct("example", unescape(F.col("reply")).alias("reply")))
    rows = examples.groupBy("conv_id").agg(
        F.first("whole").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(reply)), lambda x: x["reply"]), "").alias("loss"),
        F.count("example").alias("n_examples"),
        F.coalesce(F.sum("context_chars"), F.lit(0)).cast("long").alias("context_chars"),
    )
    return rows.select(
        "conv_id",
        F.col("whole.turns.n").alias("n_turns"),
        F.col("whole.turns.said").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("whole.chars").alias("formatted_chars"),
        "n_examples",
        "context_chars",
    )
