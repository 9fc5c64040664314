"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens choose the windows. They lay a grid of cells of
``span`` tokens over a conversation: the turns that lie within a cell are one
part, a turn that crosses into the cell where it ends is another. A crossing
turn joins the part before it if both fit the span, else the part after it, else
it stands alone; so a window exceeds the span only by a turn that does so alone.
Each window repeats the conversation's system turn and as many of the turns
before it as the budget leaves room for; repeated turns are masked, so each
assistant text is a target once.

A turn is written ``### role: text </turn>`` and a line break. In texts ``\\``,
``#`` and ``<`` are preceded by ``\\``, and roles are URL-encoded, so no text
can hold a mark, and reading undoes it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

HEAD, SEP, TAIL = "### ", ": ", " </turn>\n"
#: Turn numbers a block of the prefix sums spans.
BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<])", "$1")


def format_windows(turns: DataFrame, span: int = 512, history: int = 256) -> DataFrame:
    """``conv_id, window, formatted, n_repeated, n_targets, spans, n_tokens, over_budget`` per window.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Tokens
    are words. The budget of a window is ``span + history``. Its target turns
    hold at most ``span`` tokens (less, if the system turn exceeds ``history``);
    before them stand the system turn (the first turn, if its role is system)
    and the last whole turns that fit ``history`` with it. ``spans`` (start,
    length in code points) is the loss mask: the target assistant texts as
    written. ``over_budget``: a turn, which is never cut, exceeds the budget by
    itself or with the system turn; no other window does. Null text or role: empty. Turns go by turn (null first), role,
    text; repeated rows are turns of their own; a null conv_id is a
    conversation. An empty table gives no rows.

    A conversation of any length is spread: sums go by blocks of turns first,
    and only windows, bounded by their span, are gathered.
    """
    t = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumns({"tokens": F.size(words(F.col("text"))).cast("bigint"), "block": F.floor(F.col("turn") / BLOCK)})
    order = ["turn", "role", "text"]
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    t = t.withColumns({"at": before(inside), "rank": F.row_number().over(inside)})
    is_system = (F.col("rank") == 1) & (F.col("role") == "system")
    blocks = t.groupBy("conv_id", "block").agg(F.sum("tokens").alias("tokens"), F.max(F.when(is_system, F.col("tokens"))).alias("head"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"),
        F.col("block").alias("b_block"),
        before(by_block).alias("offset"),
        (F.row_number().over(by_block) == 1).alias("first"),
        F.coalesce(F.first("head").over(by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0)).alias("system"),
    )
    t = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))).select(
        "conv_id", *order, "tokens", "system", (F.col("at") + F.col("offset")).alias("at"), (F.col("first") & is_system).alias("is_system")
    )
    t = t.withColumn("room", F.when(F.col("system") <= history, F.lit(span)).otherwise(F.greatest(F.lit(1), span + history - F.col("system"))))
    t = t.withColumn("cell", F.floor((F.greatest(F.col("at") + F.col("tokens"), F.lit(1)) - 1) / F.col("room")))
    t = t.withColumn("part", 2 * F.col("cell") + (F.col("at") >= F.col("cell") * F.col("room")).cast("int"))
    windows = _windows(t, span, history)
    parts = windows.select(F.col("conv_id").alias("p_conv"), F.explode("parts").alias("p_part"), "window", "after")
    t = t.join(parts, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part")))
    # kind: 0 system again, 1 history, 2 target
    place = lambda w, kind: F.struct(w.alias("window"), F.lit(kind).alias("kind"))
    repeats = F.filter("after", lambda x: ~F.col("is_system") & (x["start"] - F.col("at") <= x["allowed"]))
    places = F.flatten(F.array_compact(F.array(F.array(place(F.col("window"), 2)), F.transform(repeats, lambda x: place(x["window"], 1)))))
    row = ["conv_id", *order, "tokens"]
    rows = t.select(*row, F.explode(places).alias("place")).select(*row, "place.window", "place.kind")
    later = windows.where("window > 0").select(F.col("conv_id").alias("l_conv"), "window")
    system = t.where("is_system").select(*row).join(later, F.col("conv_id").eqNullSafe(F.col("l_conv"))).select(*row, "window", F.lit(0).alias("kind"))
    head = F.concat(F.lit(HEAD), F.url_encode("role"), F.lit(SEP))
    rows = rows.unionByName(system).withColumns({"head": F.char_length(head), "body": F.char_length(escape(F.col("text"))), "piece": F.concat(head, escape(F.col("text")), F.lit(TAIL))})
    in_window = Window.partitionBy("conv_id", "window").orderBy("kind", *order)
    start = F.coalesce(F.sum(F.char_length("piece")).over(in_window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("head")
    rows = rows.withColumns({"n": F.row_number().over(in_window), "start": start})
    turn = F.struct("n", "kind", "role", "start", "body", "piece")
    spans = F.transform(F.filter("all", lambda x: (x["kind"] == 2) & (x["role"] == "assistant")), lambda x: F.struct(x["start"].alias("start"), x["body"].cast("bigint").alias("length")))
    return (
        rows.groupBy("conv_id", "window")
        .agg(F.sort_array(F.collect_list(turn)).alias("all"), F.sum("tokens").alias("n_tokens"), F.sum((F.col("kind") < 2).cast("int")).alias("n_repeated"), F.sum((F.col("kind") == 2).cast("int")).alias("n_targets"))
        .select("conv_id", "window", F.concat_ws("", F.col("all.piece")).alias("formatted"), "n_repeated", "n_targets", spans.alias("spans"), "n_tokens", (F.col("n_tokens") > span + history).alias("over_budget"))
    )


def _windows(t: DataFrame, span: int, history: int) -> DataFrame:
    """``conv_id, window, parts, after`` per window: the parts it has (three at most), and the windows that start within ``history`` tokens after it.

    Odd parts lie within a cell, even ones are crossing turns: some two parts a
    span of tokens, so a conversation has few parts against its words. ``after``
    holds the number, start and tokens of history that such a window may repeat.
    """
    by_part = Window.partitionBy("conv_id").orderBy("part")
    within = lambda p: p % 2 == 1
    step = lambda c, k: F.lag(c, k).over(by_part) if k > 0 else F.lead(c, -k).over(by_part)
    parts = t.groupBy("conv_id", "part").agg(F.sum("tokens").alias("held"), F.min("at").alias("start"), F.max("system").alias("system"), F.max("room").alias("room"))
    back = ~within(F.col("part")) & within(step("part", 1)) & (step("held", 1) + F.col("held") <= F.col("room"))
    parts = parts.withColumn("back", F.coalesce(back, F.lit(False)))
    both = F.col("held") + step("held", -1) + F.when(step("back", -2), step("held", -2)).otherwise(0)
    ahead = F.coalesce(~within(F.col("part")) & within(step("part", -1)) & (both <= F.col("room")), F.lit(False))
    parts = parts.withColumn("own", F.when(F.col("back"), step("part", 1)).when(ahead, step("part", -1)).otherwise(F.col("part")))
    windows = parts.groupBy("conv_id", "own").agg(F.collect_set("part").alias("parts"), F.min("start").alias("start"), F.sum("held").alias("held"), F.max("system").alias("system"))
    by_own = Window.partitionBy("conv_id").orderBy("own")
    left = F.least(history - F.col("system"), span + history - F.col("system") - F.col("held"))
    windows = windows.withColumns({"window": (F.row_number().over(by_own) - 1).cast("bigint"), "allowed": F.greatest(F.lit(0), left)})
    near = F.collect_list(F.struct("window", "start", "allowed")).over(Window.partitionBy("conv_id").orderBy("start").rangeBetween(0, history))
    windows = windows.withColumn("near", near).withColumn("near", F.lead("near").over(by_own))
    return windows.select("conv_id", "window", "parts", F.filter("near", lambda x: x["window"] > F.col("window")).alias("after"))


def read_windows(windows: DataFrame) -> DataFrame:
    """``conv_id, window, turns (role, text), loss (texts), formatted``: the target turns and the texts under the mask, read back."""
    pieces = F.split(F.col("formatted"), TAIL.replace("\n", "\\n"))
    targets = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_targets"))

    def turn(p: Column) -> Column:
        colon = F.instr(p, SEP)
        return F.struct(
            F.url_decode(F.substring(p, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)).alias("role"), unescape(F.substring(p, colon + len(SEP), F.char_length(p))).alias("text")
        )

    loss = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window", F.transform(targets, turn).alias("turns"), loss.alias("loss"), "formatted")


def digest_conversations(windows: DataFrame) -> DataFrame:
    """Per conversation, from what ``read_windows`` reads back: turns, digests and lengths."""
    r = read_windows(windows).select(
        "conv_id",
        F.struct(
            F.col("window"),
            F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns"),
            F.concat_ws("", "loss").alias("loss"),
        ).alias("part"),
        F.size("turns").cast("bigint").alias("n"),
        F.char_length("formatted").cast("bigint").alias("chars"),
    )
    parts = r.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    turns, loss = F.concat_ws("", F.col("parts.turns")), F.concat_ws("", F.col("parts.loss"))
    return parts.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
