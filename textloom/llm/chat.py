"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is written ``<turn ROLE>TEXT</turn>`` and a newline.  Inside roles and
texts ``&`` and ``<`` (in roles ``>`` too) become entities, so no text can
hold a control string, and reading back restores every text.

Every assistant turn becomes one example: all turns up to it, of which only
that reply's text is trainable.  Turns after the last assistant turn make one
closing example in which nothing is trainable, so that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINABLE = "assistant"
END = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("&gt;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&gt;"), F.lit(">")))


def examples(conversations: DataFrame) -> DataFrame:
    """The training examples of each conversation, with spans of what is trainable.

    Rows: conv_id, example (0-based), n_turns (of the conversation), last
    (whether the example holds all its turns), formatted, loss_start and
    loss_length (code points; length 0 where nothing is trainable).

    Turns go by ``turn``, ties by role and text, nulls first.  Null roles and
    texts are empty; a null conv_id is one conversation; repeated rows are
    turns of their own; an empty table gives no rows; other columns are
    ignored.  An example holds its whole context, so a conversation must fit a
    row, as in any prefix format.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_conversation = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def head(t: Column) -> Column:
        return F.concat(F.lit("<turn "), escaped_role(t["role"]), F.lit(">"))

    parts = by_conversation.select(
        "conv_id",
        F.size("turns").alias("n_turns"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escaped(t["text"]).alias("body"))).alias("parts"),
    )
    targets = F.filter(F.sequence(F.lit(1), F.col("n_turns")), lambda i: F.get("parts", i - 1)["role"] == TRAINABLE)
    # One past the end stands for the closing example.
    closing = F.when(F.get("parts", F.col("n_turns") - 1)["role"] == TRAINABLE, F.array().cast("array<int>")).otherwise(F.array(F.col("n_turns") + 1))
    exploded = parts.select("conv_id", "n_turns", "parts", F.posexplode(F.concat(targets, closing)).alias("example", "upto"))
    rendered = F.transform(F.slice("parts", F.lit(1), F.least("upto", F.col("n_turns"))), lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    body = F.get("parts", F.col("upto") - 1)["body"]
    return exploded.select(
        "conv_id", "example", "n_turns", (F.col("upto") >= F.col("n_turns")).alias("last"), F.array_join(rendered, "").alias("formatted"), F.coalesce(F.length(body), F.lit(0)).alias("loss_length")
    ).select(
        "conv_id",
        "example",
        "n_turns",
        "last",
        "formatted",
        F.when(F.col("loss_length") > 0, F.length("formatted") - F.col("loss_length") - len(END)).otherwise(F.length("formatted")).alias("loss_start"),
        "loss_length",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as structs of role and text."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    # Each piece is "<turn ROLE>TEXT"; neither part holds a raw control string, and a role no raw bracket.
    return F.transform(
        pieces,
        lambda p: let_role(p, F.instr(p, ">")),
    )


def let_role(piece: Column, at: Column) -> Column:
    return F.struct(
        unescaped_role(F.substr(piece, F.lit(len("<turn ") + 1), at - (len("<turn ") + 1))).alias("role"),
        unescaped(F.substr(piece, at + 1)).alias("text"),
    )


def digest(expanded: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: what reading them back yields."""
    turns = F.when(F.col("last"), read_back(F.col("formatted")))
    loss = unescaped(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    told = expanded.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), loss.alias("loss"), turns.alias("turns"))
    told = told.withColumns(
        {
            "n": F.size("turns").cast("long"),
            "sha": F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256),
        }
    ).drop("turns")
    by = told.groupBy("conv_id").agg(
        F.max(F.when(F.col("sha").isNotNull(), F.col("n"))).alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
    )
    return by.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def oracle(table: str = "conversations", extra: str = "") -> str:
    """DuckDB SQL for ``digest``, from the turns themselves; ``extra``: SELECT of more rows."""
    role_chars = "length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))"
    text_chars = "length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))"
    return f"""
    with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from {table} {extra})),
    s as (select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
                 sum({role_chars} + {text_chars} + {len("<turn >") + len(END)}) over w as upto
          from t window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding))
    select conv_id, max(n)::bigint as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
           coalesce(length(string_agg(text, '' order by i) filter (role = '{TRAINABLE}')), 0)::bigint as loss_chars,
           sha256(coalesce(string_agg(text, '' order by i) filter (role = '{TRAINABLE}'), '')) as loss_sha256,
           sum(case when role = '{TRAINABLE}' or i = n then upto else 0 end)::bigint as formatted_chars
    from s group by conv_id"""
