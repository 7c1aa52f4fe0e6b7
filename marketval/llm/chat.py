r"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written `<turn>role`, a line break, `<says>text`, a line break, `</turn>` and a line
break. In roles and texts a backslash is doubled and each mark gets a backslash in front, so a mark
that follows a line break is always the template's own, and reading returns every text exactly.

Prefix sums of turn tokens (words) choose the windows: a window takes turns while they fit into
`budget`, less the system turn's tokens and `history`. It opens with the system turn (a leading turn
of that role), then repeats the last turns of the window before, as many as fit into `history`
tokens, then come its own turns. Only own assistant turns carry loss, so each target counts once. A
turn longer than the budget has a window of its own.

Rows go by turn, then role, then text (nulls first). A null text or role is read as empty; rows with
a null conv_id form one conversation. Repeated rows are turns like others. An empty table gives no
windows. A conversation becomes one row of turns, because its digest covers all of its text.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketval.llm.common import table
from marketval.llm.registry import query

BUDGET = 1024
HISTORY = 256
OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>"
WORD = r"[^\x20\x09-\x0D]+"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, SAYS, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def unescaped(text: Column) -> Column:
    for mark in (OPEN, SAYS, CLOSE):
        text = F.replace(text, F.lit("\\" + mark), F.lit(mark))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(f"\n{SAYS}"))


def _written(turn: Column) -> Column:
    return F.concat(_head(turn), turn["text"], F.lit(f"\n{CLOSE}\n"))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """`rows(conv_id, turn, role, text)` to one row per window: `conv_id, window, formatted`,
    `repeated` (how many leading turns the windows before have shown) and `loss`, the
    (start, length) spans in code points of the texts to learn from."""
    raw_role, raw_text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = rows.select("conv_id", "turn", raw_role.alias("raw_role"), raw_text.alias("raw_text"))
    counted = narrow.withColumn("tokens", F.regexp_count("raw_text", F.lit(WORD)).cast("long"))
    order = W.partitionBy("conv_id").orderBy("turn", "raw_role", "raw_text")
    turn = F.struct(
        F.row_number().over(order).alias("at"),
        F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
        "tokens", escaped(F.col("raw_role")).alias("role"), escaped(F.col("raw_text")).alias("text"),
        (F.col("raw_role") == "assistant").alias("target"))
    convs = (counted.select("conv_id", turn.alias("t")).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list("t")).alias("turns")))

    first = F.get("turns", F.lit(0))
    convs = convs.withColumn("system", F.when(first["role"] == "system", F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0)))
    convs = convs.withColumn("body", F.slice("turns", F.size("system") + 1, F.size("turns"))).drop("turns")
    taken = F.coalesce(F.get("system", F.lit(0))["tokens"], F.lit(0).cast("long"))
    convs = convs.withColumn("room", F.greatest(F.lit(budget - history).cast("long") - taken, F.lit(1).cast("long")))

    def fill(state: Column, t: Column) -> Column:
        opens = (t["upto"] - state["base"] > F.col("room")) | (F.size(state["starts"]) == 0)
        place = (t["at"] - F.size("system")).cast("int")
        return F.struct(F.when(opens, F.concat(state["starts"], F.array(place))).otherwise(state["starts"]).alias("starts"),
                        F.when(opens, t["upto"] - t["tokens"]).otherwise(state["base"]).alias("base"))

    empty = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("base"))
    starts = F.aggregate("body", empty, fill, lambda s: F.when(F.size(s["starts"]) == 0, F.array(F.lit(1))).otherwise(s["starts"]))
    convs = convs.withColumn("starts", starts)

    def span(k: Column) -> Column:
        """Own turns of window k, counted from 0."""
        begin = F.get("starts", k)
        return F.slice("body", begin, F.coalesce(F.get("starts", k + 1), F.size("body") + 1) - begin)

    def window(k: Column) -> Column:
        before = F.when(k > 0, span(k - 1)).otherwise(F.slice("body", 1, 0))
        last = F.element_at(before, -1)["upto"]
        recent = F.filter(before, lambda t: last - t["upto"] + t["tokens"] <= history)
        opening = F.concat("system", F.when(k > 0, recent).otherwise(F.slice("body", 1, 0)))
        return F.struct(k.alias("window"), opening.alias("opening"), span(k).alias("own"))

    each = convs.select("conv_id", F.size("system").alias("n_system"), F.explode(F.transform(
        F.sequence(F.lit(0), F.size("starts") - 1), window)).alias("w")).select("conv_id", "n_system", "w.*")
    each = (each.withColumn("lead", F.array_join(F.transform("opening", _written), ""))
            .withColumn("repeated", F.when(F.col("window") > 0, F.size("opening")).otherwise(0)))

    def mark(state: Column, t: Column) -> Column:
        starts_at = state["at"] + F.char_length(_head(t))
        here = F.struct(starts_at.alias("start"), F.char_length(t["text"]).alias("length"))
        return F.struct((state["at"] + F.char_length(_written(t))).alias("at"),
                        F.when(t["target"], F.concat(state["spans"], F.array(here))).otherwise(state["spans"]).alias("spans"))

    zero = F.struct(F.char_length("lead").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return each.select(
        "conv_id", "window", F.concat("lead", F.array_join(F.transform("own", _written), "")).alias("formatted"),
        "repeated", F.aggregate("own", zero, mark, lambda s: s["spans"]).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the learned texts of each window, from its text, mask and repeat count alone."""
    pieces = F.split("formatted", f"\n{CLOSE}\n", -1)
    own = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, f"\n{SAYS}")
        role = piece.substr(F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        text = piece.substr(cut + len(SAYS) + 1, F.char_length(piece))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    learned = F.transform("loss", lambda x: unescaped(F.col("formatted").substr(x["start"] + 1, x["length"])))
    return formatted.select("conv_id", "window", F.transform(own, turn).alias("turns"), learned.alias("learned"),
                            F.char_length("formatted").alias("chars"))


def with_marked_conversation(rows: DataFrame) -> DataFrame:
    """Conversation -7: a user and an assistant turn whose text holds control strings."""
    said = F.lit("\\### Assistant: </turn> ok")
    extra = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


@query("op8_chat_windows")
def op8(spark, folder):
    back = read_back(windows(with_marked_conversation(table(spark, folder, "conversations"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("window", told.alias("told"), F.array_join("learned", "").alias("learned"))
    convs = back.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"), F.sort_array(F.collect_list(part)).alias("parts"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    joined = {c: F.array_join(F.col(f"parts.{c}"), "") for c in ("told", "learned")}
    return convs.select(
        "conv_id", "n_turns", F.sha2(joined["told"], 256).alias("turns_sha256"),
        F.char_length(joined["learned"]).cast("long").alias("loss_chars"),
        F.sha2(joined["learned"], 256).alias("loss_sha256"), "formatted_chars", "n_windows")
