"""Chat formatting in budgeted windows (DataFrame functions only).

A conversation becomes one or more windows of at most ``budget`` tokens.
Running sums of turn tokens choose the windows: each starts with the system
turn and up to ``history`` tokens of turns shown before, then takes new turns
while they fit; a turn larger than the budget stands alone.  Turns shown again
are context only: the loss mask covers the text of each assistant turn once,
in the window where it is new.

Every turn is written as ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``.
Control strings inside a text get a backslash after their first character (one
more if backslashes stand there already), so none survives and removing one
backslash restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings of common templates.  Each starts with < or [.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>\n"


def _tails() -> str:
    quoted = sorted({"".join("\\" + c if not c.isalnum() else c for c in s[1:]) for s in CONTROL}, key=len, reverse=True)
    return "|".join(quoted)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_tails()})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\({_tails()})", "$1$2$3")


def pack_role(role: Column) -> Column:
    """A role on one line: the same escape, and percent signs and line ends encoded."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unpack_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def tokens(text: Column) -> Column:
    """Token estimate of a turn: its words and marks, plus the template's own."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")) + 4).cast("long")


def turns_of(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """One row per turn: its place ``i``, tokens ``n``, and what a window that starts there repeats.

    ``first`` is the earliest turn that a window starting at ``i`` shows again
    (``i`` itself if the repeated turns would not fit), ``again`` their tokens
    with the system turn's.  Running sums and range frames over them give both.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), tokens(text).alias("n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = (t.withColumn("i", F.row_number().over(order) - 1)
          .withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
          .withColumn("head", F.first(F.when(F.col("role") == "system", F.col("n")).otherwise(F.lit(0))).over(
              order.rowsBetween(Window.unboundedPreceding, 0))))
    near = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, 0)
    t = (t.withColumn("first", F.greatest(F.col("i") - F.count(F.lit(1)).over(near) + 1, F.least("i", (F.col("head") > 0).cast("int"))))
          .withColumn("shown", F.col("before") - F.greatest(F.min("before").over(near), F.least("before", "head"))))
    lead = F.when(F.col("i") > 0, F.col("head")).otherwise(F.lit(0))
    fits = F.col("n") + lead + F.col("shown") <= budget
    return t.select("conv_id", "i", "role", "text", "n", "head", F.when(fits, F.col("first")).otherwise(F.col("i")).cast("int").alias("first"),
                    (lead + F.when(fits, F.col("shown")).otherwise(F.lit(0))).alias("again"))


def windows_of(turns: DataFrame, budget: int) -> DataFrame:
    """``conv_id, window, n_repeated, shown``: each window's turns (role, text), the repeated ones first."""
    packed = F.struct("i", "role", "text", "n", "first", "again", "head")
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(packed)).alias("ts"))
    convs = convs.withColumn("cuts", F.expr(f"""aggregate(ts, named_struct('cuts', array(0), 'used', 0L), (s, t) ->
        IF(s.used + t.n <= {budget} OR t.i = 0,
           named_struct('cuts', s.cuts, 'used', s.used + t.n),
           named_struct('cuts', array_append(s.cuts, t.i), 'used', t.n + t.again)), s -> s.cuts)"""))
    spans = F.expr("""transform(cuts, (c, k) -> named_struct('window', k,
        'n_repeated', c - ts[c].first + IF(c > 0 AND ts[c].head > 0, 1, 0),
        'shown', transform(concat(slice(ts, 1, IF(c > 0 AND ts[c].head > 0, 1, 0)),
            slice(ts, ts[c].first + 1, IF(k + 1 < size(cuts), cuts[k + 1], size(ts)) - ts[c].first)),
            t -> named_struct('role', t.role, 'text', t.text))))""")
    return convs.select("conv_id", F.explode(spans).alias("w")).select("conv_id", "w.*")


def format_chats(rows: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """``conv_id, window, formatted, n_repeated, loss``: the training windows of all conversations.

    ``loss`` is the mask: (start, length) in code points of ``formatted`` for
    each new assistant text; ``n_repeated`` turns lead the window that an
    earlier window had as new.  Rows are ordered by (turn, role, text), NULL
    turns first; NULL roles and texts are empty; repeated rows are turns of
    their own; a NULL conv_id is one conversation.  A conversation is one row
    group and must fit a task.  Other columns are ignored.
    """
    w = windows_of(turns_of(rows.select("conv_id", "turn", "role", "text"), budget, history), budget)
    lines = F.transform("shown", lambda t: F.struct(
        F.concat(F.lit(START), pack_role(t["role"]), F.lit("\n")).alias("open"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("target")))
    w = w.withColumn("lines", lines)
    formatted = F.array_join(F.transform("lines", lambda x: F.concat(x["open"], x["body"], F.lit(END))), "")
    mask = F.expr(f"""aggregate(transform(lines, (x, i) -> named_struct('x', x, 'i', i)),
        named_struct('at', 0L, 'out', cast(array() as array<struct<start:bigint,length:bigint>>)),
        (s, l) -> named_struct(
            'at', s.at + char_length(l.x.open) + char_length(l.x.body) + {len(END)},
            'out', IF(l.x.target AND l.i >= n_repeated, array_append(s.out, named_struct(
                'start', s.at + char_length(l.x.open), 'length', cast(char_length(l.x.body) as bigint))), s.out)), s -> s.out)""")
    return w.select("conv_id", "window", formatted.alias("formatted"), "n_repeated", mask.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars``, parsed from the formatted windows and their masks alone."""
    turn = F.split("formatted", F.lit(r"<\|im_end\|>\n"))
    new = F.expr("slice(ps, n_repeated + 1, size(ps) - 1 - n_repeated)")
    parsed = windows.withColumn("ps", turn).withColumn("ps", new)
    parsed = parsed.withColumn("turns", F.transform("ps", lambda p: F.struct(
        unpack_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text"))))
    loss = F.transform("loss", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    parsed = parsed.select("conv_id", F.struct("window", "turns", F.array_join(loss, "").alias("loss"),
                                               F.char_length("formatted").cast("long").alias("chars")).alias("w"))
    joined = parsed.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return joined.select("conv_id", F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
                         F.array_join(F.transform("ws", lambda w: w["loss"]), "").alias("loss_text"),
                         F.aggregate("ws", F.lit(0).cast("long"), lambda s, w: s + w["chars"]).alias("formatted_chars"))
