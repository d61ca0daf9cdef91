r"""Operator 8, chat formatting: budgeted windows of whole turns with loss masks.

DataFrame functions only. Template: a window is ``<s>`` and its turns; a turn is an opener by
role (``[SYS]``, ``[INST]``, ``[/INST]``, else ``[ROLE]name[/ROLE]``), the text and ``</s>``.

Escaping is reversible: each backslash of a text is doubled, and a single backslash is put
behind the first character of each control string, so none of them can occur in a text. A
backslash run of even length is thus data; a single backslash marks a broken control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPENERS = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
BEGIN, END, ROLE, ROLE_END = "<s>", "</s>", "[ROLE]", "[/ROLE]"
_CONTROL = r"<(?=/?s>)|\[(?=/?(?:SYS|INST|ROLE)\])"
#: Tokens that a turn's marks cost, counted with its text; at least 1 bounds the turns of a window.
MARK_TOKENS = 2


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    """A doubled backslash is one; a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turn_tokens(text: Column) -> Column:
    """Default length of a text: its runs of letters or digits and its other visible characters."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]")).cast("long")


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 512, tokens=turn_tokens) -> DataFrame:
    """Windows of at most ``budget`` tokens that cover every turn once as new.

    Columns: conv_id, window (from 0), n_repeated, n_new, n_tokens, text, loss (array of
    start, end: code points of ``text``, end exclusive).

    A conversation's leading system turn opens each of its windows. Turn lengths are summed up
    along the conversation; a turn belongs to the window of the budget's multiple in which it
    starts, and one that would overrun that multiple gets a window of its own. Before its new
    turns a window repeats the last ones before them, at most ``history`` tokens, as far as the
    budget has room. Repeated turns are masked: each assistant text is a target once. A turn
    isn't cut: one that doesn't fit beside the system turn has a window with that alone, which is the
    only kind that runs over the budget. ``n_tokens`` counts texts and marks, the repeated ones too.

    Prefix sums go over chunks of 256 turns first, so that a conversation with any share of all
    rows is spread over tasks; a window's turns are bounded by the budget. Null texts and roles
    count as empty; rows of one turn number are ordered by role and text and all kept; other columns
    are ignored; an empty table gives none.
    """
    base = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body")
    ).withColumn("cost", tokens(F.col("body")) + MARK_TOKENS).withColumn("chunk", F.floor(F.col("turn") / 256))
    # place of each turn and tokens before it: sums of chunks, then sums inside a chunk
    chunks = base.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("rows"), F.sum("cost").alias("sum"), F.min(F.struct("turn", "role", "body", "cost")).alias("first"))
    ahead = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select(
        F.col("conv_id").alias("c_conv"), F.col("chunk").alias("c_chunk"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("sum_before"),
        F.first("first").over(W.partitionBy("conv_id").orderBy("chunk")).alias("lead"),
    )
    inner = W.partitionBy("conv_id", "chunk").orderBy("turn", "role", "body")
    placed = base.withColumns({"at": F.row_number().over(inner), "upto": F.sum("cost").over(inner.rowsBetween(W.unboundedPreceding, W.currentRow))})
    same = placed.conv_id.eqNullSafe(chunks.c_conv) & (placed.chunk == chunks.c_chunk)
    is_system = F.col("lead.role") == "system"
    placed = placed.join(chunks, same).select(
        "conv_id", "role", "body", "cost",
        (F.col("at") - 1 + F.col("rows_before")).cast("long").alias("place"),
        F.when(is_system, F.col("lead.body")).alias("system"),
        F.when(is_system, F.col("lead.cost")).otherwise(0).alias("system_cost"),
        (F.col("upto") - F.col("cost") + F.col("sum_before")).alias("start"),
    )
    # where the system turn leaves little, history gives way; where it leaves nothing, each turn is alone
    left = F.lit(budget) - F.col("system_cost")
    room = F.greatest(F.when(left - history >= budget // 4, left - history).otherwise(F.least(left, F.lit(budget // 4))), F.lit(1))
    start = F.greatest(F.col("start") - F.col("system_cost"), F.lit(0))
    is_lead = (F.col("place") == 0) & F.col("system").isNotNull()
    grid = F.floor(start / room)
    late = start + F.col("cost") > (grid + 1) * room
    placed = placed.withColumns({"grid": F.when(is_lead, 0).otherwise(grid), "own": F.when(is_lead, False).otherwise(late), "is_lead": is_lead, "from": start, "room": room})
    # history: each turn is also offered to the windows that begin within ``history`` tokens after it
    made = placed.groupBy("conv_id", "grid", "own").agg(
        F.min("place").alias("first_place"), F.min("from").alias("first_from"), F.sum(F.when(F.col("is_lead"), 0).otherwise(F.col("cost"))).alias("new_cost"), F.first("system_cost").alias("system_cost"), F.first("system").alias("system"),
        F.sort_array(F.collect_list(F.struct("place", "role", "body", "is_lead"))).alias("new"),
    )
    room_left = F.least(F.lit(history), F.greatest(F.lit(budget) - F.col("system_cost") - F.col("new_cost"), F.lit(0)))
    made = made.withColumn("history", F.when(F.col("first_place") == 0, 0).otherwise(room_left))
    # equi-join on blocks of ``history`` tokens: what lies at most that far before is in this or the block before
    width = max(1, history)
    want = made.where("history > 0").select(F.col("conv_id").alias("w_conv"), F.col("grid").alias("w_grid"), F.col("own").alias("w_own"), "first_place", "first_from", F.col("history").alias("w_history"), F.explode(F.array(F.floor(F.col("first_from") / width), F.floor(F.col("first_from") / width) - 1)).alias("block"))
    give = placed.where(~F.col("is_lead")).select("conv_id", "place", "role", "body", "cost", "from", F.floor(F.col("from") / width).alias("g_block"))
    near = (give.conv_id.eqNullSafe(want.w_conv)) & (give.g_block == want.block) & (F.col("place") < F.col("first_place")) & (F.col("from") >= F.col("first_from") - F.col("w_history"))
    past = give.join(want, near).groupBy("w_conv", "w_grid", "w_own").agg(F.sum("cost").alias("past_cost"), F.sort_array(F.collect_list(F.struct("place", "role", "body"))).alias("past"))
    both = made.join(past, made.conv_id.eqNullSafe(past.w_conv) & (made.grid == past.w_grid) & (made.own == past.w_own), "left")
    return _render(both, budget)


def _render(windows: DataFrame, budget: int) -> DataFrame:
    piece = "struct<role:string,body:string,repeated:boolean>"
    head = F.when(F.col("system").isNotNull() & (F.col("first_place") > 0), F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("body"), F.lit(True).alias("repeated")))).otherwise(F.array().cast(f"array<{piece}>"))
    old = F.coalesce(F.transform("past", lambda x: F.struct(x.role.alias("role"), x.body.alias("body"), F.lit(True).alias("repeated"))), F.array().cast(f"array<{piece}>"))
    new = F.transform("new", lambda x: F.struct(x.role.alias("role"), x.body.alias("body"), F.lit(False).alias("repeated")))

    def opener(role: Column) -> Column:
        known = F.when(role == "system", OPENERS["system"]).when(role == "user", OPENERS["user"]).when(role == "assistant", OPENERS["assistant"])
        return known.otherwise(F.concat(F.lit(ROLE), escape(role), F.lit(ROLE_END)))

    shown = F.transform(F.concat(head, old, new), lambda x: F.struct(opener(x.role).alias("open"), escape(x.body).alias("body"), (~x.repeated & (x.role == "assistant")).alias("target"), x.repeated.alias("repeated")))
    out = windows.withColumn("turns", shown)
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda x: F.concat(x.open, x.body, F.lit(END))), ""))
    # a running sum of lengths places the targets
    start = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc.at + F.length(x.open)
        e = a + F.length(x.body)
        span = F.when(x.target, F.array(F.struct(a.alias("start"), e.alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.struct((e + len(END)).alias("at"), F.concat(acc.spans, span).alias("spans"))

    loss = F.aggregate("turns", start, step).spans
    order = W.partitionBy("conv_id").orderBy("first_place")
    return out.select(
        "conv_id", (F.row_number().over(order) - 1).cast("long").alias("window"), F.size(F.filter("turns", lambda x: x.repeated)).cast("long").alias("n_repeated"),
        F.size("new").cast("long").alias("n_new"), (F.col("system_cost") + F.col("new_cost") + F.coalesce("past_cost", F.lit(0))).cast("long").alias("n_tokens"), text.alias("text"), loss.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, body: the new ones), targets (array of unescaped loss texts)."""
    parts = F.filter(F.split(F.substring(F.col("text"), len(BEGIN) + 1, 2**31 - 1), F.lit(r"\Q" + END + r"\E")), lambda x: x != "")

    def parse(x: Column) -> Column:
        at = lambda n: F.substring(x, n + 1, 2**31 - 1) if isinstance(n, int) else x.substr(n + 1, F.lit(2**31 - 1))
        close = F.instr(x, ROLE_END)
        role = F.when(x.startswith(OPENERS["assistant"]), "assistant").when(x.startswith(OPENERS["user"]), "user").when(x.startswith(OPENERS["system"]), "system").otherwise(unescape(x.substr(F.lit(len(ROLE) + 1), close - 1 - len(ROLE))))
        body = F.when(x.startswith(OPENERS["assistant"]), at(len(OPENERS["assistant"]))).when(x.startswith(OPENERS["user"]), at(len(OPENERS["user"]))).when(x.startswith(OPENERS["system"]), at(len(OPENERS["system"]))).otherwise(x.substr(close + len(ROLE_END), F.lit(2**31 - 1)))
        return F.struct(role.alias("role"), unescape(body).alias("body"))

    turns = F.transform(parts, parse)
    return windows.select(
        "conv_id", "window",
        F.slice(turns, F.col("n_repeated").cast("int") + 1, F.size(turns)).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s.start + 1).cast("int"), (s.end - s.start).cast("int")))).alias("targets"),
        F.length("text").cast("long").alias("n_chars"),
    )


def chat_digest(windows: DataFrame) -> DataFrame:
    """The digest of each conversation, read back from its formatted windows.

    A digest over a conversation needs its whole text in one row; that is this report's nature
    (a conversation must fit Spark's 2 GB string), not the operator's.
    """
    joined = lambda c: F.array_join(c, "")
    per = read_back(windows).select(
        "conv_id", "window", "n_chars", F.size("turns").cast("long").alias("n"), joined(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.body, F.lit("\n")))).alias("turns"), joined(F.col("targets")).alias("targets")
    )
    by = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    targets = joined(F.transform("w", lambda x: x.targets))
    return by.select(
        "conv_id", "n_turns", sha(joined(F.transform("w", lambda x: x.turns))).alias("turns_sha256"), F.length(targets).cast("long").alias("loss_chars"), sha(targets).alias("loss_sha256"), "formatted_chars"
    )
