r"""Chat formatting into budgeted windows (operator 4, DataFrame functions only).

Template of a turn: ``<|start|>`` role ``<|text|>`` text ``<|end|>`` and a newline.  In roles and
texts a backslash is doubled and put after the first character of every control string (of this
template and of common others), so that none occurs in the output but as a mark; dropping the
backslash before any character reads the original back.

A conversation's turns, ordered by (turn, role, hash of the text), are cut into spans by prefix sums of
their tokens.  A span closes before the turn that would pass the budget with the system turn (a first
turn of that role) and the history, which each window repeats.  The history is the longest run of
whole turns at the end of the span before that has at most ``history`` tokens and leaves room for the span's
first turn.  So only a window that has a single new turn can exceed the budget, and only if that turn
and the system turn alone exceed it.  The loss mask covers the texts of assistant turns where they
are new; repeated ones are masked.  Every turn is new in exactly one window.

A conversation may hold a third of all rows.  Spans are chosen without texts: keys and token counts are
range-partitioned by conversation and order, summed within each partition, and each partition's sums are
added to those after it (one row per partition and conversation).  From the prefix sums follow
stretches of ``STRETCH`` budgets, which are cut into spans by themselves; a stretch begins without history.  Texts
join their places by (conversation, turn, role, hash) and are gathered window by window.  Tokens are
estimated by a pattern (words and single marks) plus 4 for the marks of a turn.

Defined results: null texts and roles are empty; null turns come first; null conversation ids are one
conversation; repeated rows are turns of their own; a very long text is a turn like others, in a window
with the system turn alone; window numbers ascend, with gaps from stretch to stretch; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>\n"
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
MARKS = 4
BUDGET, HISTORY = 1024, 128
STRETCH = 32  # budgets cut into spans at once


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, hash, tokens) with seq, before (tokens of the turns before it, without the
    system turn), system (whether it is that turn) and first (the conversation's first row)."""
    rows = written(turns.repartitionByRange("conv", "turn", "role", "hash").withColumn("part", F.spark_partition_id()), "chat-turns")
    rows = rows.withColumn("slice", F.struct("part", "conv"))
    order = W.partitionBy("slice").orderBy("turn", "role", "hash").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.count("*").over(order)).withColumn("upto", F.sum("tokens").over(order))
    per = rows.groupBy("slice").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), F.min(F.struct("turn", "role", "hash", "tokens")).alias("first"))
    whole = W.partitionBy("slice.conv").orderBy("slice.part").rowsBetween(W.unboundedPreceding, 0)
    per = per.select("slice", F.first("first").over(whole).alias("first"), (F.sum("n").over(whole) - F.col("n")).alias("n"), (F.sum("sum").over(whole) - F.col("sum")).alias("sum"))
    rows = rows.join(per, "slice").withColumn("seq", F.col("n") + F.col("nth") - 1)
    system = F.col("first.role") == "system"
    head = F.when(system, F.col("first.tokens")).otherwise(0)
    before = F.greatest(F.col("sum") + F.col("upto") - F.col("tokens") - head, F.lit(0))
    return rows.select("conv", "turn", "role", "hash", "tokens", "seq", before.alias("before"), (system & (F.col("seq") == 0)).alias("system"), "first")


def _spans(budget: int, history: int) -> Column:
    """(start, from) of every span of a stretch ``ts``: prefix sums at which its new turns and its
    repeated ones begin."""
    cap = budget - F.col("head")
    none = F.array().cast("array<struct<start:bigint,from:bigint>>")

    def add(spans, x):
        last = F.get(spans, F.size(spans) - 1)
        room = F.greatest(F.least(F.lit(history), cap - x.tokens), F.lit(0))
        begin = F.array_min(F.transform(F.filter("ts", lambda y: (y.before >= last.start) & (y.before >= x.before - room) & (y.before <= x.before)), lambda y: y.before))
        span = F.struct(x.before.alias("start"), F.coalesce(begin, x.before).alias("from"))
        return F.when(last.isNotNull() & (x.before + x.tokens - last["from"] <= cap), spans).otherwise(F.concat(spans, F.array(span)))

    return F.aggregate("ts", none, add)


def places(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv, turn, role, hash, tokens, seq, window, new): each turn once for every window that holds it."""
    stretch = F.floor(F.col("before") / (STRETCH * budget)).alias("stretch")
    turn = F.struct("seq", "before", "tokens", "turn", "role", "hash")
    g = _prefix_sums(turns).groupBy("conv", stretch).agg(
        F.array_sort(F.collect_list(F.when(~F.col("system"), turn))).alias("ts"), F.first("first").alias("first"))
    g = g.withColumn("head", F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(0))
    g = g.withColumn("spans", _spans(budget, history)).withColumn("last", F.greatest(F.size("spans") - 1, F.lit(0)))
    numbers = F.sequence(F.lit(0), F.col("last"))

    def held(x):
        span = lambda w: F.get(F.col("spans"), w)
        following = lambda w: F.coalesce(F.get(F.col("spans"), w + 1)["start"], x.before + 1)
        return F.transform(F.filter(numbers, lambda w: (span(w)["from"] <= x.before) & (x.before < following(w))),
                           lambda w: F.struct(w.alias("span"), (span(w)["start"] <= x.before).alias("new")))

    body = F.transform("ts", lambda x: F.struct(x.turn.alias("turn"), x.role.alias("role"), x.hash.alias("hash"), x.tokens.alias("tokens"),
                                                x.seq.alias("seq"), held(x).alias("at")))
    always = F.transform(numbers, lambda w: F.struct(w.alias("span"), ((w == 0) & (F.col("stretch") == 0)).alias("new")))
    system = F.struct(F.col("first.turn").alias("turn"), F.col("first.role").alias("role"), F.col("first.hash").alias("hash"),
                      F.col("first.tokens").alias("tokens"), F.lit(0).cast("long").alias("seq"), always.alias("at"))
    g = g.select("conv", "stretch", F.explode(F.when(F.col("first.role") == "system", F.concat(F.array(system), body)).otherwise(body)).alias("x"))
    g = g.select("conv", "stretch", "x.*").withColumn("at", F.explode("at"))
    window = F.col("stretch") * (STRETCH * budget) + F.col("at.span")
    return g.select("conv", "turn", "role", "hash", "tokens", "seq", window.alias("window"), F.col("at.new").alias("new"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, id_col: str = "conv_id",
            turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: id_col, window, n_turns, n_repeated, n_tokens, text, loss.

    ``text`` is the formatted window, ``loss`` the (start, end) character ranges of it that
    are trained on; its first ``n_repeated`` turns are context."""
    empty = F.lit("")
    t = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"),
                     F.coalesce(F.col(text_col), empty).alias("text")).withColumn("hash", F.xxhash64("text"))
    keys = ["conv", "turn", "role", "hash"]
    tokens = F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKS
    placed = places(t.select(*keys, tokens.alias("tokens")), budget, history)
    text = t.dropDuplicates(keys).select(*[F.col(k).alias(f"t_{k}") for k in keys], "text")
    same = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys]
    t = placed.join(text, same).select("conv", "window", "seq", "role", "new", "tokens",
                                       F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT)).alias("open"), escape(F.col("text")).alias("body"))
    new = F.col("new")
    turn = F.struct("seq", (~new).alias("repeated"), (new & (F.col("role") == "assistant")).alias("target"), "open", "body")
    w = t.groupBy("conv", "window").agg(F.array_sort(F.collect_list(turn)).alias("ts"), F.sum("tokens").alias("n_tokens"))
    size = lambda x: F.length(x["open"]) + F.length(x["body"]) + len(END)
    start = F.aggregate("ts", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + size(x))))
    w = w.withColumn("at", start)
    spans = F.filter(F.transform("ts", lambda x, i: F.struct(
        (F.get("at", i) + F.length(x["open"])).alias("start"), (F.get("at", i) + F.length(x["open"]) + F.length(x["body"])).alias("end"), x.target.alias("t"))),
        lambda x: x.t)
    return w.select(
        F.col("conv").alias(id_col), "window", F.size("ts").cast("long").alias("n_turns"),
        F.size(F.filter("ts", lambda x: x.repeated)).cast("long").alias("n_repeated"), "n_tokens",
        F.array_join(F.transform("ts", lambda x: F.concat(x["open"], x["body"], F.lit(END))), "").alias("text"),
        F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))).alias("loss"))


def parse(text: Column) -> Column:
    """The (role, text) of every turn of a formatted window."""
    parts = F.slice(F.split(text, r"<\|start\|>", -1), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, TEXT) + len(TEXT), F.length(p) - F.instr(p, TEXT) - (len(TEXT) + len(END)) + 1)).alias("text")))


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its windows: id_col, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_windows."""
    text = F.col("text")
    back = formatted.select(
        F.col(id_col), "window", F.length("text").alias("chars"), F.slice(parse(text), F.col("n_repeated").cast("int") + 1, 1 << 30).alias("turns"),
        F.array_join(F.transform("loss", lambda x: unescape(F.substr(text, x.start + 1, x.end - x.start))), "").alias("loss"))
    back = back.select(id_col, "window", "chars", F.size("turns").alias("n"),
                       F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("turns"), "loss")
    g = back.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("ws"),
                                 F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    joined = lambda c: F.array_join(F.transform("ws", lambda x: x[c]), "")
    return g.select(id_col, "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"),
                    F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"),
                    "formatted_chars", "n_windows")
