"""Chat formatting with Spark expressions only.

Turns are sorted structs of a group; adjacent turns of one role become one block whose parts are told apart
by a separator, and a block's pieces are concatenated.  Beside the formatted text each conversation has its
pieces with a loss flag, so the mask is exact without any offsets.

Defined cases: a null text is empty, a null role is the empty role, and a null turn sorts first.  Repeated
turns keep all rows, in the order of role and text.  A null conversation id is a conversation of its own.
Control strings, line ends in roles and the escape sign itself are escaped and come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Double the escape sign, then break every control string with a single one."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and without line ends, since one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/|"))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``."""
    return unescape(F.replace(role, F.lit("<\\/|"), F.lit("\n")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, pieces (array of piece and loss flag) and formatted text of every conversation."""
    turn = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(item: Column, at: Column) -> Column:
        opens = (at == 0) | (F.get("turns", at - 1)["role"] != item["role"])
        closes = (at == F.size("turns") - 1) | (F.get("turns", at + 1)["role"] != item["role"])
        head = F.when(opens, F.concat(F.lit(OPEN), escape_role(item["role"]), F.lit("\n"))).otherwise(F.lit(NEXT))
        tail = F.when(closes, F.lit(CLOSE)).otherwise(F.lit(""))
        piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(escape(item["text"]), item["role"] == LEARNED), piece(tail, F.lit(False)))

    return (grouped.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("pieces"))
            .select("conv_id", "pieces", F.array_join("pieces.piece", "").alias("formatted")))


def read_turns(formatted: Column) -> Column:
    """Array of role and text of each turn, read back from a formatted text."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def parts(block: Column) -> Column:
        cut = F.instr(block, "\n")
        role = unescape_role(F.substring(block, F.lit(1), cut - 1))
        body = F.regexp_replace(F.substring(block, cut + 1, F.length(block)), r"<\|im_end\|>\n$", "")
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, parts))


def learned_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(pieces, lambda x: x["loss"]), lambda x: unescape(x["piece"])), "")
