"""Event routing and notifications (JN4-6, JN9, FIL6-7, FIL13, FN10-14, PRJ12, STR6, STR8-10, AGG16).

Fan-out joins a message stream with a subscription edge table.  Edge tables
are configuration (tens to hundreds of rows, fixed by the deployment), so
they are broadcast: the message side is never shuffled for routing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import lookup
from ..plans.routing import (CUSTOMER_CATEGORY, CUSTOMER_CATEGORY_DEFAULT, INCIDENTS_CHANNEL, INTERNAL_CHANNEL,
                             INTERNAL_CHANNEL_DEFAULT, URGENCY_COLOR, URGENCY_EMOJI)


def fan_out(messages: DataFrame, subscriptions: DataFrame, topic: str = "topic") -> DataFrame:
    """JN5/JN6: one output row per (message, subscribed consumer).

    ``subscriptions`` is the configured edge table (broadcast; its size is
    fixed by configuration, e.g. 58 or 240 edges)."""
    return messages.join(F.broadcast(subscriptions), topic)


def allow(df: DataFrame, column: str, values) -> DataFrame:
    """FIL6/FIL7: attribute allow-list (compiled to an in-set predicate)."""
    return df.filter(F.col(column).isin(list(values)))


def split_priority(messages: DataFrame, topics, topic: str = "topic") -> tuple:
    """STR9: (priority lane, normal lane) by topic."""
    p = F.col(topic).isin(list(topics))
    return messages.filter(p), messages.filter(~p | F.col(topic).isNull())


def dead_letter(messages: DataFrame, max_receive: int, receive_count: str = "receive_count") -> tuple:
    """STR8: (live, dead): a message moves to the dead-letter queue once its
    receive count exceeds ``max_receive``."""
    dead = F.col(receive_count) > max_receive
    return messages.filter(~dead), messages.filter(dead)


def drop_older_than(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """FIL13: message retention -- keep rows newer than ``as_of - days``."""
    return df.filter(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))


def backlog(messages: DataFrame, as_of, topic: str = "topic", sent: str = "sent_at",
            stale_after_s: int = 900) -> DataFrame:
    """AGG16/STR10: visible depth and age of the oldest message per queue."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.min(sent).cast("timestamp"))
    return (messages.groupBy(topic)
            .agg(F.count(F.lit(1)).alias("depth"), F.floor(age / 1000000).cast("long").alias("oldest_age_s"))
            .withColumn("stale", F.col("oldest_age_s") > stale_after_s))


def _sweep(key: list, width: int):
    """A pass over rows sorted by (key, ``_us``): a row is accepted when its key's last accepted
    row is ``width`` or more microseconds earlier.  Adds ``_dup``, ``_acc`` (the key's last accepted
    time) and ``_open``: the decision hangs on rows before this pass (the unbroken chain that a
    range starts with).  ``_carry`` on a group's first row gives the time accepted before it; only
    one row of state passes from batch to batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def starts(batch):
        """True where a row's key differs from the row before (NULL is a key); the first is left to the caller."""
        new = np.zeros(batch.num_rows, bool)
        for c in key:
            a, b = batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)
            differ = pc.fill_null(pc.not_equal(a, b), False)
            new[1:] |= pc.or_(differ, pc.not_equal(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
        return new

    def run(batches):
        held = None                              # (key values, last time, last accepted time, chain is open)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            times = batch.column("_us")
            known = times.is_valid().to_numpy(zero_copy_only=False)
            us = times.fill_null(-2**62).to_numpy()
            new = starts(batch)
            mine = [batch.column(c)[0].as_py() for c in key]
            new[0] = held is None or held[0] != mine
            first = new.copy()                   # a chain begins: another key, or a pause of the width
            first[1:] |= us[1:] - us[:-1] >= width
            if not new[0]:
                first[0] = us[0] - held[1] >= width
            begin = np.flatnonzero(first)
            bounds = np.r_[begin if len(begin) and begin[0] == 0 else np.r_[0, begin], n].astype(int)
            accepted, opened = first & known, np.zeros(n, bool)
            carry = batch.column("_carry")[0].as_py() if held is None and "_carry" in batch.schema.names else None
            # chains that outlast the width after their first row are walked from accepted row to accepted row
            lasts = np.maximum(us[np.maximum(bounds[1:] - 1, 0)], us[bounds[:-1]])
            walk = np.flatnonzero(lasts - us[bounds[:-1]] >= width)
            if not first[0] or carry is not None:
                walk = np.union1d(walk, [0])
            for c in walk:
                lo, hi = bounds[c], bounds[c + 1]
                t, at = us[lo:hi], 0
                last = carry if c == 0 and carry is not None else held[2] if c == 0 and not first[0] else None
                accepted[lo:hi] = False
                if last is not None:
                    at = int(np.searchsorted(t, last + width))
                while at < hi - lo:
                    accepted[lo + at] = True
                    at = int(np.searchsorted(t, t[at] + width))
            accepted &= known
            if held is None or (not first[0] and held[3]):
                opened[:bounds[1]] = True        # up to the first break
            idx = np.maximum.accumulate(np.where(accepted, np.arange(n), -1))
            before = carry if carry is not None else held[2] if held is not None and not new[0] else None
            acc = np.where(known, np.where(idx >= 0, us[np.maximum(idx, 0)], -2**62 if before is None else before), -2**62)
            row = [batch.column(c)[n - 1].as_py() for c in key]
            held = (row, int(us[-1]), int(acc[-1]), bool(opened[-1]))
            out = batch.drop_columns(["_carry"]) if "_carry" in batch.schema.names else batch
            for name, col in (("_dup", pa.array(~accepted & known)), ("_acc", pa.array(acc)), ("_open", pa.array(opened))):
                out = out.append_column(name, col)
            yield out
    return run


def _with_groups(run):
    """``run`` over the runs of equal ``_grp`` in a sorted partition, a fresh state for each."""
    import numpy as np

    def outer(batches):
        def cut():
            for b in batches:
                g = b.column("_grp").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(edges, edges[1:]):
                    if hi > lo:
                        yield g[lo], b.slice(lo, hi - lo)
        pieces = cut()
        ahead = next(pieces, None)
        while ahead is not None:
            grp = ahead[0]

            def group():
                nonlocal ahead
                while ahead is not None and ahead[0] == grp:
                    b, ahead = ahead[1], None
                    yield b
                    ahead = next(pieces, None)
            yield from run(group())
    return outer


def gap_dedup(df: DataFrame, key, ts: str, gap_s: int, tiebreak=()) -> DataFrame:
    """STR6/STR7 (batch form): flag rows less than ``gap_s`` after their key's last accepted row.

    The interval runs from the sighting that was accepted, as a queue's
    deduplication interval and a nonce's lifetime do: duplicates do not extend
    it.  NULL is a key like any other; a row without a time is no duplicate.

    Rows are range-partitioned on (key, time, tiebreak, row hash), so a hot
    key is cut into many ranges, and each range is swept in order with one row
    of state.  Only the unbroken chain that a range starts with (no pause of
    ``gap_s`` since the range before) hangs on earlier rows; those few rows
    are swept again, one task per run of linked ranges, from what the range
    before accepted last.
    """
    from ..session import materialize
    key = [key] if isinstance(key, str) else list(key)
    width = int(gap_s) * 1000000
    d = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    d = d.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
    order = [F.col(c) for c in dict.fromkeys([*key, "_us", *tiebreak, "_tie"])]
    d = d.repartitionByRange(*order).withColumn("_rng", F.spark_partition_id()).sortWithinPartitions(*order)

    def swept(x):
        return T.StructType(list(x.schema.fields)).add("_dup", "boolean").add("_acc", "long").add("_open", "boolean")
    d = materialize(d.mapInArrow(_sweep(key, width), swept(d)), "sweep")
    # one row per range (bounded by the partition count): its first and last key and what it accepted last
    ends = d.groupBy("_rng").agg(F.min_by(F.struct(*key), F.struct(*order)).alias("head"),
                                 F.max_by(F.struct(F.struct(*key).alias("k"), F.col("_acc").alias("acc"), F.col("_open").alias("open")),
                                          F.struct(*order)).alias("tail"))
    w = Window.orderBy("_rng")
    ends = ends.withColumn("before", F.lag("tail").over(w))
    same = F.coalesce(F.to_json("head", {"ignoreNullFields": "false"}) == F.to_json("before.k", {"ignoreNullFields": "false"}), F.lit(False))
    ends = ends.withColumn("linked", same & F.coalesce(F.col("before.open"), F.lit(False)))
    ends = ends.select("_rng", F.max(F.when(~F.col("linked"), F.col("_rng"))).over(w).alias("_grp"),
                       F.when(same & ~F.col("before.open") & (F.col("before.acc") > -2**62), F.col("before.acc")).alias("_carry"))
    chains = d.filter("_open").drop("_dup", "_acc", "_open").join(F.broadcast(ends), "_rng")
    chains = chains.repartition("_grp").sortWithinPartitions("_grp", "_rng", *order)
    again = chains.mapInArrow(_with_groups(_sweep(key, width)), swept(chains.drop("_carry")))
    cols = [*df.columns, "_dup"]
    out = d.filter("NOT _open").select(*cols).unionByName(again.select(*cols))
    return out.withColumnRenamed("_dup", "is_duplicate")


def content_dedup_id(*cols) -> Column:
    """STR6: content-based deduplication id = sha256 of the body."""
    return F.sha2(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]), 256)


def internal_channel(event_type) -> Column:
    """FN10: internal channel by operational event type."""
    return lookup(INTERNAL_CHANNEL, event_type, INTERNAL_CHANNEL_DEFAULT)


def customer_category(event_type) -> Column:
    """FN11: customer channel category by operational event type."""
    return lookup(CUSTOMER_CATEGORY, event_type, CUSTOMER_CATEGORY_DEFAULT)


def notification_targets(events: DataFrame, tenant_config: DataFrame) -> DataFrame:
    """JN9 + FN10-14: every (event, sink, channel) delivery, in one pass.

    * internal Slack always, plus the incidents channel for p1 unless that is
      already the channel (``array_distinct``);
    * the tenant's own provider(s): left join on tenant id; nothing for an
      unknown tenant or ``provider = 'none'``; ``both`` yields two targets.

    One left join (the configuration side is one row per tenant; AQE
    broadcasts it when small) and one generator over all targets.
    ``events(event_id, type, urgency, tenant_id)``;
    ``tenant_config(tenant_id, provider, slack_channels map, teams_channels map)``.
    """
    ch = internal_channel(F.col("type"))
    esc = F.when(F.col("urgency") == "p1", F.lit(INCIDENTS_CHANNEL)).otherwise(ch)

    def target(sink, chan):
        return F.struct(F.lit(sink).alias("sink"), chan.alias("channel"))
    internal = F.array_distinct(F.array(target("internal-slack", ch), target("internal-slack", esc)))
    cat = customer_category(F.col("type"))
    prov = F.col("provider")
    # a provider block that is missing, or has no channel for the category, gets no delivery
    slack = F.when(prov.isin("slack", "both") & F.col("slack_channels")[cat].isNotNull(), target("slack", F.col("slack_channels")[cat]))
    teams = F.when(prov.isin("teams", "both") & F.col("teams_channels")[cat].isNotNull(), target("teams", F.col("teams_channels")[cat]))
    customer = F.filter(F.array(slack, teams), lambda x: x.isNotNull())
    joined = events.join(tenant_config, "tenant_id", "left")
    return (joined.select("event_id", F.explode(F.concat(internal, customer)).alias("t"))
                  .select("event_id", "t.sink", "t.channel"))


def _details_pairs(details: Column):
    return F.map_entries(F.coalesce(details, F.create_map().cast("map<string,string>")))


def render_slack(df: DataFrame) -> Column:
    """PRJ12: Slack blocks payload (header, fields, message, action buttons) as JSON."""
    emoji = lookup(URGENCY_EMOJI, F.col("urgency"), URGENCY_EMOJI["info"])
    txt = "struct<type:string,text:string,emoji:boolean>"
    field = "struct<type:string,text:string>"

    def mk(label, c):
        return F.when(F.col(c).isNotNull(), F.struct(F.lit("mrkdwn").alias("type"),
                                                     F.concat(F.lit(f"*{label}:* "), F.col(c)).alias("text")))
    fixed = F.filter(F.array(mk("Service", "service"), mk("Version", "version"), mk("Environment", "environment"),
                             mk("Time", "timestamp")), lambda x: x.isNotNull())
    extra = F.transform(_details_pairs(F.col("details")),
                        lambda e: F.struct(F.lit("mrkdwn").alias("type"),
                                           F.concat(F.lit("*"), e["key"], F.lit(":* "), e["value"]).alias("text")))
    fields = F.concat(fixed, extra)

    def button(label, c):
        return F.when(F.col(c).isNotNull(), F.struct(
            F.lit("button").alias("type"),
            F.struct(F.lit("plain_text").alias("type"), F.lit(label).alias("text")).alias("text"),
            F.col(c).alias("url")))
    actions = F.filter(F.array(button("View Details", "actionUrl"), button("View Logs", "logsUrl")),
                       lambda x: x.isNotNull())
    elem_t = "array<struct<type:string,text:struct<type:string,text:string>,url:string>>"

    def block(type_, text=None, fields_=None, elements=None):
        return F.struct(F.lit(type_).alias("type"),
                        (text if text is not None else F.lit(None).cast(txt)).alias("text"),
                        (fields_ if fields_ is not None else F.lit(None).cast(f"array<{field}>")).alias("fields"),
                        (elements if elements is not None else F.lit(None).cast(elem_t)).alias("elements"))
    header = block("header", F.struct(F.lit("plain_text").alias("type"),
                                      F.concat(emoji, F.lit(" "), F.col("title")).alias("text"),
                                      F.lit(True).alias("emoji")))
    fsec = F.when(F.size(fields) > 0, block("section", fields_=fields))
    msg = F.when(F.col("message").isNotNull() & (F.col("message") != ""),
                 block("section", F.struct(F.lit("mrkdwn").alias("type"), F.col("message").alias("text"),
                                           F.lit(None).cast("boolean").alias("emoji"))))
    act = F.when(F.size(actions) > 0, block("actions", elements=actions))
    blocks = F.filter(F.array(header, fsec, msg, act), lambda b: b.isNotNull())
    return F.to_json(F.struct(blocks.alias("blocks")))


def render_teams(df: DataFrame) -> Column:
    """PRJ12: adaptive-card payload (title, fact set, message, actions) as JSON."""
    color = lookup(URGENCY_COLOR, F.col("urgency"), "default")

    def fact(title, c):
        return F.when(F.col(c).isNotNull(), F.struct(F.lit(title).alias("title"), F.col(c).alias("value")))
    facts = F.concat(F.filter(F.array(fact("Service", "service"), fact("Version", "version"),
                                      fact("Environment", "environment"), fact("Time", "timestamp")),
                              lambda x: x.isNotNull()),
                     F.transform(_details_pairs(F.col("details")),
                                 lambda e: F.struct(e["key"].alias("title"), e["value"].alias("value"))))
    elem = ("struct<type:string,size:string,weight:string,text:string,color:string,wrap:boolean,"
            "facts:array<struct<title:string,value:string>>>")

    def el(type_, text=None, size=None, weight=None, color_=None, wrap=None, facts_=None):
        def v(x, t):
            return x if x is not None else F.lit(None).cast(t)
        return F.struct(F.lit(type_).alias("type"), v(size, "string").alias("size"), v(weight, "string").alias("weight"),
                        v(text, "string").alias("text"), v(color_, "string").alias("color"),
                        v(wrap, "boolean").alias("wrap"),
                        v(facts_, "array<struct<title:string,value:string>>").alias("facts")).cast(elem)
    title = el("TextBlock", F.col("title"), F.lit("Large"), F.lit("Bolder"), color)
    fset = F.when(F.size(facts) > 0, el("FactSet", facts_=facts))
    msg = F.when(F.col("message").isNotNull() & (F.col("message") != ""),
                 el("TextBlock", F.col("message"), wrap=F.lit(True)))
    body = F.filter(F.array(title, fset, msg), lambda b: b.isNotNull())

    def action(label, c):
        return F.when(F.col(c).isNotNull(), F.struct(F.lit("Action.OpenUrl").alias("type"),
                                                     F.lit(label).alias("title"), F.col(c).alias("url")))
    actions = F.filter(F.array(action("View Details", "actionUrl"), action("View Logs", "logsUrl")),
                       lambda x: x.isNotNull())
    content = F.struct(F.lit("http://adaptivecards.io/schemas/adaptive-card.json").alias("$schema"),
                       F.lit("AdaptiveCard").alias("type"), F.lit("1.4").alias("version"), body.alias("body"),
                       F.when(F.size(actions) > 0, actions).alias("actions"))
    att = F.struct(F.lit("application/vnd.microsoft.card.adaptive").alias("contentType"), content.alias("content"))
    return F.to_json(F.struct(F.lit("message").alias("type"), F.array(att).alias("attachments")))
