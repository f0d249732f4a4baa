"""State from event ledgers: running, corrected, as-of and bitemporal.

Rows are (ctx, seq, op, qty) with op in set / add / remove / planned / revise.  All running values go through
``scan.prefix_scan``, so a context with a third of all events still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros
from .scan import prefix_scan


def signed(op: str = "op", qty: str = "qty") -> Column:
    return F.when(F.col(op) == "add", F.col(qty)).when(F.col(op) == "remove", -F.col(qty)).otherwise(F.lit(0)).cast("bigint")


def running_state(
    facts: DataFrame, keys: Sequence[str] = ("ctx",), order: str | Sequence[str] = "seq"
) -> DataFrame:
    """Adds value, previous, last_reset and status (ok / missing_baseline / invalid) to set, add and remove rows.

    A quantity below zero marks its key invalid from that row on.
    """
    live = facts.filter(F.col("op").isin("set", "add", "remove"))
    at = order if isinstance(order, str) else order[-1]
    moved = prefix_scan(live, keys, order, {"moved": ("sum", signed())}, keep_block=True)
    is_set = F.col("op") == "set"
    anchor = F.when(is_set, F.col("qty") - F.col("moved"))
    based = prefix_scan(moved, keys, order, {
        "base": ("last", anchor), "base_before": ("last<", anchor), "last_reset": ("last", F.when(is_set, F.col(at))),
    }, keep_block=True)
    valued = based.withColumn("value", F.col("base") + F.col("moved")).withColumn(
        "previous", F.col("base_before") + F.col("moved") - signed())
    low = prefix_scan(valued, keys, order, {"low": ("min", F.col("value"))})
    status = F.when(F.col("value").isNull(), "missing_baseline").when(F.col("low") < 0, "invalid").otherwise("ok")
    return low.withColumn("status", status).drop("moved", "base", "base_before", "low")


def current_state(facts: DataFrame, keys: Sequence[str] = ("ctx",), order: str = "seq") -> DataFrame:
    """Last value and status of each key."""
    rows = running_state(facts, keys, order)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("value", "status"), order).alias("s"), F.count("*").alias("events"))
    return last.select(*keys, F.when(F.col("s.status") == "ok", F.col("s.value")).alias("value"), F.col("s.status").alias("status"), "events")


def state_changes(facts: DataFrame, keys: Sequence[str] = ("ctx",), order: str = "seq") -> DataFrame:
    """Per event: before, after, delta."""
    rows = running_state(facts, keys, order)
    return rows.select(*keys, order, "op", F.col("previous").alias("before"), F.col("value").alias("after"),
                       (F.col("value") - F.col("previous")).alias("delta"), "status")


def omitted_subject(facts: DataFrame) -> DataFrame:
    """facts(ctx, seq, subj): a null subject means the only subject seen so far in its context, else it is unresolved."""
    first = facts.filter(F.col("subj").isNotNull()).groupBy("ctx", "subj").agg(F.min("seq").alias("seq")).withColumn("new", F.lit(1).cast("bigint"))
    flagged = facts.join(first, ["ctx", "subj", "seq"], "left")
    seen = prefix_scan(flagged, ["ctx"], "seq", {"live": ("sum", F.coalesce("new", F.lit(0))), "latest": ("last", F.col("subj"))})
    return seen.select(
        "ctx", "seq", F.when(F.col("subj").isNotNull(), F.col("subj")).when(F.col("live") == 1, F.col("latest")).alias("subject"),
        F.when(F.col("subj").isNotNull(), "given").when(F.col("live") == 1, "resolved")
        .when(F.col("live") == 0, "none").otherwise("ambiguous").alias("status"))


def transfer_rows(events: DataFrame) -> DataFrame:
    """events(seq, kind, holder, other, qty) -> ledger rows; a transfer takes from its holder and gives to the other."""
    def row(who: str, op: str) -> Column:
        return F.struct(F.col(who).alias("ctx"), F.lit(op).alias("op"))

    parts = (
        F.when(F.col("kind") == "has", F.array(row("holder", "set")))
        .when(F.col("kind") == "add", F.array(row("holder", "add")))
        .when(F.col("kind") == "use", F.array(row("holder", "remove")))
        .when(F.col("kind") == "transfer", F.array(row("holder", "remove"), row("other", "add")))
    )
    return events.select("seq", "qty", F.explode(parts).alias("p")).select("p.ctx", "seq", "p.op", "qty")


def apply_corrections(facts: DataFrame) -> DataFrame:
    """The latest revision of an event replaces its quantity; the event keeps its place."""
    latest = facts.filter("op = 'revise' AND target IS NOT NULL").groupBy("ctx", F.col("target").alias("seq")).agg(F.max_by("qty", "seq").alias("new_qty"))
    kept = facts.filter("op <> 'revise'").join(latest, ["ctx", "seq"], "left")
    return kept.withColumn("qty", F.coalesce("new_qty", "qty")).drop("new_qty", "target")


def state_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose value or status differs between two replays."""
    b = before.select(*keys, F.col("value").alias("before"), F.col("status").alias("status_before"))
    a = after.select(*keys, F.col("value").alias("after"), F.col("status").alias("status_after"))
    both = b.join(a, list(keys), "full_outer")
    same = F.col("before").eqNullSafe(F.col("after")) & F.col("status_before").eqNullSafe(F.col("status_after"))
    return both.filter(~same)


def state_as_of(changes: DataFrame, at: Column) -> DataFrame:
    """State at effective time ``at`` from changes(ctx, seq, kind, before, after, delta, effective_at).

    kind "quantity" adds its delta; kind "value" needs the current value to equal ``before`` and replaces it.  The
    baseline is ``before`` of the first observed change.  Holds: an untimed change, a missing numeric baseline, a value
    change that does not fit the state at its effective time.
    """
    base = changes.groupBy("ctx").agg(
        F.min_by("before", "seq").alias("baseline"), F.bool_or(F.col("effective_at").isNull()).alias("untimed"))
    seen = changes.filter(F.col("effective_at") <= at).withColumn("eff", micros(F.col("effective_at")))
    # Effective time is cut into one-day blocks, in microseconds.
    order, day = ["eff", "seq"], 86_400_000_000
    amount = F.when(F.col("kind") == "quantity", F.col("delta")).otherwise(0).cast("bigint")
    moved = prefix_scan(seen, ["ctx"], order, {"moved": ("sum", amount)}, block=day, keep_block=True)
    is_value = F.col("kind") == "value"
    fixed = F.when(is_value, F.struct((F.col("after") - F.col("moved")).alias("v")))
    prior = prefix_scan(moved, ["ctx"], order, {"anchor": ("last", fixed), "anchor_before": ("last<", fixed)}, block=day)
    rows = prior.join(base, "ctx")
    state = F.when(F.col("anchor").isNotNull(), F.col("anchor.v") + F.col("moved")).otherwise(F.col("baseline") + F.col("moved"))
    before_here = F.when(F.col("anchor_before").isNotNull(), F.col("anchor_before.v") + F.col("moved")).otherwise(F.col("baseline") + F.col("moved"))
    rows = rows.withColumn("state", state).withColumn("conflict", is_value & ~before_here.eqNullSafe(F.col("before")))
    rows = rows.withColumn("no_base", ~is_value & F.col("state").isNull())
    ends = rows.groupBy("ctx").agg(
        F.max_by("state", F.struct("eff", "seq")).alias("state"), F.bool_or("conflict").alias("conflict"), F.bool_or("no_base").alias("no_base"))
    reason = (F.when(F.col("untimed"), "untimed_state_change").when(F.col("no_base"), "missing_baseline")
              .when(F.col("conflict"), "time_order_state_conflict"))
    out = base.join(ends, "ctx", "left").withColumn("reason", reason)
    value = F.when(F.col("conflict").isNull(), F.col("baseline")).otherwise(F.col("state"))
    return out.select("ctx", F.when(F.col("reason").isNull(), value).alias("value"), "reason")


def event_ledger(events: DataFrame, definitions: DataFrame) -> DataFrame:
    """events(seq, action, polarity, modality, condition, has_roles) + status; only executed events have effects."""
    known = definitions.select("action", "effect").withColumn("defined", F.lit(True))
    status = (
        F.when(~F.col("polarity"), "negative").when(F.col("modality") != "asserted", F.col("modality"))
        .when(~F.col("condition"), "condition_false").when(F.col("condition").isNull() | ~F.col("has_roles"), "pending")
        .when(F.col("defined").isNull(), "uninterpreted").otherwise("executed")
    )
    return events.join(known, "action", "left").withColumn("status", status).select(
        "seq", "action", "status", F.when(F.col("status") == "executed", F.col("effect")).alias("effect"))


def asof_last(probes: DataFrame, rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """For each probe(key, seq, ...) the last ``value`` of rows(key, seq) strictly before it: an as-of join by one
    scan over the union of both sides, without a range join."""
    cols = probes.columns
    right = rows.select(key, "seq", value.alias(name), F.lit(0).alias("_probe"))
    left = probes.withColumn(name, F.lit(None).cast(right.schema[name].dataType)).withColumn("_probe", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True)
    # A probe sorts before a row of the same time, so only earlier rows count.
    order = both.withColumn("_tie", 1 - F.col("_probe"))
    seen = prefix_scan(order.withColumnRenamed(name, "_v"), [key], ["seq", "_tie"], {name: ("last", F.col("_v"))})
    return seen.filter("_probe = 1").select(*cols, name)


def locations(events: DataFrame) -> DataFrame:
    """Last place per item from events(seq, item, place, where_item): a move to where another item is copies that
    item's place at that moment.  Copies of copies are resolved by pointer jumping, so rounds grow with the log of the
    longest chain."""
    from ..session import materialize

    copies = events.filter(F.col("where_item").isNotNull())
    target = asof_last(copies.select("seq", "item", F.col("where_item").alias("key")), events.select(
        F.col("item").alias("key"), "seq"), "key", F.col("seq"), "source_seq")
    links = events.join(target.select("seq", "source_seq"), "seq", "left").select(
        "seq", "item", "place", F.when(F.col("where_item").isNotNull(), F.col("source_seq")).alias("next"))
    links = materialize(links, "places")
    while not links.filter(F.col("next").isNotNull()).isEmpty():  # a copy looks back only, so this ends
        ahead = links.select(F.col("seq").alias("next"), F.col("place").alias("p2"), F.col("next").alias("n2"))
        links = materialize(links.join(ahead, "next", "left").select(
            "seq", "item", F.coalesce("place", "p2").alias("place"), F.when(F.col("place").isNull(), F.col("n2")).alias("next")), "places")
    return links.groupBy("item").agg(F.max_by("place", "seq").alias("place"), F.max("seq").alias("seq"))


def state_at_anchor(facts: DataFrame, anchors: DataFrame, after: bool = False) -> DataFrame:
    """State just before (or after) the one event that an anchor(ask, ctx, kind) describes.

    No matching event or several of them hold with a reason; facts also carry ``kind``.
    """
    named = anchors.join(facts.select("ctx", "kind", "seq"), ["ctx", "kind"], "left")
    counts = named.groupBy("ask", "ctx").agg(F.count("seq").alias("n"), F.min("seq").alias("seq"))
    rows = running_state(facts)
    probes = counts.filter("n = 1").select("ask", "ctx", (F.col("seq") + (1 if after else 0)).alias("seq"))
    value = asof_last(probes, rows, "ctx", F.col("value"), "value")
    return counts.join(value.select("ask", "value"), "ask", "left").select(
        "ask", "value", F.when(F.col("n") == 0, "no_event").when(F.col("n") > 1, "ambiguous_event")
        .when(F.col("value").isNull(), "no_state").otherwise("ok").alias("reason"))


def valid_at(intervals: DataFrame, points: DataFrame, key: str, bucket_days: int = 30) -> DataFrame:
    """For each point(key, t): how many intervals [at, until) of the key hold it, and the value if exactly one does.

    Intervals are cut into day buckets and meet points on (key, bucket), so no range join is needed; an open interval
    ends with the last point, which bounds its buckets.
    """
    end = points.agg(F.max("t").alias("end"))  # one row

    def bucket(c: Column) -> Column:
        return F.floor(micros(c) / (bucket_days * 86_400_000_000))

    closed = intervals.join(F.broadcast(end)).withColumn("to", F.least(F.coalesce("until", F.col("end") + F.expr("INTERVAL 1 SECOND")), F.col("end") + F.expr("INTERVAL 1 SECOND")))
    cut = closed.filter("at < to").select(key, "at", "to", "value", F.explode(F.sequence(bucket(F.col("at")), bucket(F.col("to")))).alias("b"))
    asked = points.select(key, "t").distinct().withColumn("b", bucket(F.col("t")))
    hits = asked.join(cut, [key, "b"]).filter("at <= t AND t < to").groupBy(key, "t").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    return asked.select(key, "t").join(hits, [key, "t"], "left").select(
        key, "t", F.when(F.col("n") == 1, F.col("value")).alias("value"),
        F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"))


def relation_lookup(facts: DataFrame, kind: str, asks: DataFrame) -> DataFrame:
    """A relation occurrence is four binary facts (rel, pred, obj); answers asks(actor, other) if exactly one fits."""
    wide = facts.groupBy("rel").pivot("pred", ["kind", "actor", "other", "value"]).agg(F.first("obj"))
    fits = wide.filter(F.col("kind") == kind).groupBy("actor", "other").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    return asks.distinct().join(fits, ["actor", "other"], "left").select(
        "actor", "other", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("value")).alias("value"))


def leading_word_referent(names: DataFrame, subjects: DataFrame) -> DataFrame:
    """Resolve names(name) to the single subject whose leading words equal it; several or none stay unresolved."""
    words = F.split("subject", " ")
    lead = subjects.select("subject", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("name"))
    hits = names.distinct().join(lead.distinct(), "name", "left").groupBy("name").agg(F.count("subject").alias("n"), F.min("subject").alias("s"))
    return hits.select("name", "n", F.when(F.col("n") == 1, F.col("s")).alias("referent"))


def action_effects(events: DataFrame, programs: DataFrame, calls: DataFrame) -> DataFrame:
    """Effect triples of events(seq, action, version, roles MAP) bound to versioned programs.

    programs(action, version, step, op, s, p, o) with "$role" placeholders; calls(action, version, callee,
    callee_version) inline other programs to any depth; calls that lead back to their program are an error.  A version must match exactly.  A missing role leaves the
    event pending; no program leaves it uninterpreted.
    """
    frames = events.select("seq", "action", "version", "roles", F.lit(0).alias("depth"))
    everything = frames
    most = calls.select("action", "version").distinct().count()  # a chain without a cycle calls each program once
    for depth in count(1):
        frames = frames.join(calls, ["action", "version"]).select(
            "seq", F.col("callee").alias("action"), F.col("callee_version").alias("version"), "roles", F.lit(depth).alias("depth"))
        if frames.isEmpty():
            break
        if depth > most:
            raise ValueError("calls form a cycle")
        everything = everything.unionByName(frames)
    steps = everything.join(programs, ["action", "version"], "left")

    def fill(c: str) -> Column:
        name = F.substring(F.col(c), 2, 100)
        return F.when(F.col(c).startswith("$"), F.try_element_at("roles", name)).otherwise(F.col(c))

    bound = steps.select("seq", "depth", "step", "op", fill("s").alias("s"), fill("p").alias("p"), fill("o").alias("o"))
    broken = F.col("step").isNotNull() & (F.col("s").isNull() | F.col("p").isNull() | F.col("o").isNull())
    state = bound.groupBy("seq").agg(F.bool_or(broken).alias("broken"), F.count("step").alias("steps"))
    status = F.when(F.col("steps") == 0, "uninterpreted").when(F.col("broken"), "pending").otherwise("executed")
    done = bound.join(state.withColumn("status", status).select("seq", "status"), "seq")
    executed = F.col("status") == "executed"
    rows = done.select("seq", "status", "depth", "step", *[F.when(executed, F.col(c)).alias(c) for c in ("op", "s", "p", "o")])
    return rows.filter(F.col("s").isNotNull() | ~executed).distinct()


def experience_shapes(events: DataFrame, shape: Sequence[str], fingerprint: Column) -> DataFrame:
    """Adds shape_id and fingerprint: 16 hex digits of the canonical shape, a digest of the values."""
    canon = F.concat_ws("|", *[F.col(c).cast("string") for c in shape])
    return events.withColumn("shape_id", F.substring(F.sha2(canon, 256), 1, 16)).withColumn(
        "fingerprint", F.sha2(fingerprint.cast("string"), 256))


def concept_candidates(exp: DataFrame) -> DataFrame:
    """Roles and status of concepts from exp(action, shape_id, fingerprint, seq).

    Distinct experiences in order: three construct, the fourth validates, the rest apply.  Another shape of the same
    action makes it inactive, or a conflict if that one also has three distinct experiences.  Only the first four
    places per shape are ranked, whatever its size.
    """
    from pyspark.sql import Window

    distinct = exp.groupBy("action", "shape_id", "fingerprint").agg(F.min("seq").alias("seq"))
    sizes = distinct.groupBy("action", "shape_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("action", "shape_id").orderBy("seq")
    head = distinct.withColumn("rn", F.row_number().over(w)).filter("rn <= 4")
    marks = head.groupBy("action", "shape_id").agg(
        F.max(F.when(F.col("rn") == 3, F.col("seq"))).alias("built_at"), F.max(F.when(F.col("rn") == 4, F.col("seq"))).alias("validated_at"))
    rivals = sizes.groupBy("action").agg(F.count("*").alias("shapes"), F.count_if(F.col("n") >= 3).alias("strong"))
    status = (F.when(F.col("strong") > 1, "conflict").when(F.col("shapes") > 1, "inactive")
              .when(F.col("validated_at").isNotNull(), "active").otherwise("candidate"))
    return sizes.filter("n >= 3").join(marks, ["action", "shape_id"]).join(rivals, "action").select(
        "action", "shape_id", F.col("n").alias("experiences"), "built_at", "validated_at",
        F.greatest(F.col("n") - 4, F.lit(0)).alias("applied"), status.alias("status"))


def cross_domain_candidates(exp: DataFrame, min_domains: int = 3) -> DataFrame:
    """Abstract shapes seen in at least ``min_domains`` domains; the first event of each domain trains."""
    first = exp.groupBy("shape_id", "domain").agg(F.min("seq").alias("train_seq"), F.count("*").alias("n"))
    wide = first.groupBy("shape_id").agg(F.count("*").alias("domains"))
    return first.join(wide.filter(F.col("domains") >= min_domains), "shape_id").select("shape_id", "domain", "domains", "train_seq", "n")


def preference_choice(options: DataFrame, experiences: DataFrame) -> DataFrame:
    """Per decision the option with the best (sum of active signals, goal fit, control fit, utility), then smallest id."""
    signal = experiences.filter("active").groupBy("option").agg(F.sum("signal").alias("signal"))
    scored = options.join(signal, "option", "left").withColumn("signal", F.coalesce("signal", F.lit(0)))
    return scored.groupBy("decision").agg(F.min_by("option", F.struct(*(-F.col(c) for c in ("signal", "goal_fit", "control_fit", "utility")), "option")).alias("option"))


def recall(asks: DataFrame, memory: DataFrame) -> DataFrame:
    """asks(kind, key) looked up exactly in memory(kind, key, value, source); a miss holds."""
    return asks.distinct().join(memory, ["kind", "key"], "left").select(
        "kind", "key", "value", "source", F.when(F.col("source").isNull(), "hold").otherwise("found").alias("status"))


def ledger_search(kinds: dict[str, DataFrame], needle: str) -> DataFrame:
    """(kind, id, at) of every record(id, at, body) whose text holds ``needle``, ignoring case, in time order."""
    out = None
    for kind, df in kinds.items():
        part = df.filter(F.lower("body").contains(needle.lower())).select(F.lit(kind).alias("kind"), F.col("id").cast("bigint").alias("id"), "at")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.asc_nulls_last("at"), "kind", "id")
