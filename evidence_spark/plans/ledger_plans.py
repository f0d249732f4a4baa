"""Queries over the event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import dialogue as D
from ..operators import filters as FL
from ..operators import ledger as L
from ..operators.scan import prefix_scan
from .registry import Tables, query

OPS = {"signup": "set", "click": "add", "purchase": "remove", "view": "planned", "error": "revise"}


def ledger(t: Tables) -> DataFrame:
    """events as ledger rows; an error revises the same user's previous event."""
    rows = t.events.select(
        F.col("user_id").alias("ctx"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"),
        F.element_at(F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv]), F.col("event_type")).alias("op"),
        F.round("value").cast("bigint").alias("qty"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "ts")
    prev = prefix_scan(rows, ["ctx"], "seq", {"target": ("last", F.col("seq"))}, strict=True)
    return prev.withColumn("target", F.when(F.col("op") == "revise", F.col("target")))


LEDGER_SQL = """led AS (SELECT user_id AS ctx, event_id AS seq, event_type AS kind,
  CASE event_type WHEN 'signup' THEN 'set' WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'remove' WHEN 'view' THEN 'planned' ELSE 'revise' END AS op,
  CAST(round(value) AS BIGINT) AS qty, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts,
  CASE WHEN event_type = 'error' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS target FROM events)"""


def run_sql(src: str, name: str, keys: str = "ctx") -> str:
    """CTEs computing the running state of ledger rows ``src`` as ``name``."""
    return f"""{name}_g AS (SELECT *, count(*) FILTER (op = 'set') OVER (PARTITION BY {keys} ORDER BY seq) AS grp FROM {src} WHERE op IN ('set', 'add', 'remove')),
 {name}_v AS (SELECT *, CASE WHEN grp > 0 THEN sum(CASE WHEN op = 'remove' THEN -qty ELSE qty END) OVER (PARTITION BY {keys}, grp ORDER BY seq)::BIGINT END AS value,
   CASE WHEN grp > 0 THEN min(seq) OVER (PARTITION BY {keys}, grp) END AS last_reset FROM {name}_g),
 {name} AS (SELECT *, lag(value) OVER (PARTITION BY {keys} ORDER BY seq) AS previous, CASE WHEN value IS NULL THEN 'missing_baseline'
   WHEN min(value) OVER (PARTITION BY {keys} ORDER BY seq) < 0 THEN 'invalid' ELSE 'ok' END AS status FROM {name}_v),
 {name}_end AS (SELECT {keys}, CASE WHEN status = 'ok' THEN value END AS value, status, events FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC) AS rn,
   count(*) OVER (PARTITION BY {keys}) AS events FROM {name}) WHERE rn = 1)"""


@query("e1_current_state", f"WITH {LEDGER_SQL}, {run_sql('led', 'r')} SELECT ctx, value, status, events FROM r_end")
def e1(t: Tables):
    return L.current_state(ledger(t))


@query("w5_running_state", f"WITH {LEDGER_SQL}, {run_sql('led', 'r')} SELECT ctx, seq, op, qty, value, previous, last_reset, status FROM r")
def w5(t: Tables):
    return L.running_state(ledger(t)).select("ctx", "seq", "op", "qty", "value", "previous", "last_reset", "status")


@query("e2_state_changes", f"WITH {LEDGER_SQL}, {run_sql('led', 'r')} SELECT ctx, seq, op, previous AS before, value AS after, value - previous AS delta, status FROM r")
def e2(t: Tables):
    return L.state_changes(ledger(t))


@query("e3_omitted_subject", f"""WITH {LEDGER_SQL}, f AS (SELECT ctx, seq, CASE WHEN kind IN ('signup', 'click') THEN kind END AS subj FROM led),
 n AS (SELECT *, CASE WHEN subj IS NOT NULL AND row_number() OVER (PARTITION BY ctx, subj ORDER BY seq) = 1 THEN 1 ELSE 0 END AS new FROM f),
 s AS (SELECT *, sum(new) OVER (PARTITION BY ctx ORDER BY seq) AS live, last_value(subj IGNORE NULLS) OVER (PARTITION BY ctx ORDER BY seq) AS latest FROM n)
 SELECT ctx, seq, CASE WHEN subj IS NOT NULL THEN subj WHEN live = 1 THEN latest END AS subject,
   CASE WHEN subj IS NOT NULL THEN 'given' WHEN live = 1 THEN 'resolved' WHEN live = 0 THEN 'none' ELSE 'ambiguous' END AS status FROM s""")
def e3(t: Tables):
    facts = ledger(t).select("ctx", "seq", F.when(F.col("kind").isin("signup", "click"), F.col("kind")).alias("subj"))
    return L.omitted_subject(facts)


def transfers(t: Tables) -> DataFrame:
    kinds = {"signup": "has", "click": "add", "view": "use", "purchase": "transfer"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    return t.events.filter("event_type <> 'error'").select(
        F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").alias("holder"),
        (F.col("user_id") + 1).alias("other"), F.round("value").cast("bigint").alias("qty"))


@query("e4_transfer_ledger", f"""WITH x AS (SELECT event_id AS seq, event_type AS e, user_id AS h, CAST(round(value) AS BIGINT) AS qty FROM events WHERE event_type <> 'error'),
 led AS (SELECT seq, h AS ctx, CASE e WHEN 'signup' THEN 'set' WHEN 'click' THEN 'add' ELSE 'remove' END AS op, qty FROM x
   UNION ALL SELECT seq, h + 1, 'add', qty FROM x WHERE e = 'purchase'), {run_sql('led', 'r')} SELECT ctx, value, status, events FROM r_end""")
def e4(t: Tables):
    return L.current_state(L.transfer_rows(transfers(t)))


CORRECTED_SQL = """rev AS (SELECT ctx, target AS seq, max_by(qty, seq) AS new_qty FROM led WHERE op = 'revise' AND target IS NOT NULL GROUP BY ctx, target),
 cor AS (SELECT l.ctx, l.seq, l.kind, l.op, coalesce(new_qty, qty) AS qty, l.ts FROM led l LEFT JOIN rev USING (ctx, seq) WHERE op <> 'revise')"""


@query("e5_apply_corrections", f"WITH {LEDGER_SQL}, {CORRECTED_SQL}, {run_sql('cor', 'r')} SELECT ctx, value, status, events FROM r_end")
def e5(t: Tables):
    return L.current_state(L.apply_corrections(ledger(t)))


DIFF_SQL = """SELECT ctx, b.value AS before, b.status AS status_before, a.value AS after, a.status AS status_after FROM {b} b FULL JOIN {a} a USING (ctx)
 WHERE b.value IS DISTINCT FROM a.value OR b.status IS DISTINCT FROM a.status"""


@query("e6_correction_impact", f"WITH {LEDGER_SQL}, {CORRECTED_SQL}, {run_sql('led', 'r')}, {run_sql('cor', 'c')} " + DIFF_SQL.format(b="r_end", a="c_end"))
def e6(t: Tables):
    rows = ledger(t)
    return L.state_diff(L.current_state(rows), L.current_state(L.apply_corrections(rows)), ["ctx"])


@query("u4_state_diff", f"WITH {LEDGER_SQL}, nv AS (SELECT * FROM led WHERE kind <> 'purchase'), {run_sql('led', 'r')}, {run_sql('nv', 'c')} " + DIFF_SQL.format(b="r_end", a="c_end"))
def u4(t: Tables):
    rows = ledger(t)
    return L.state_diff(L.current_state(rows), L.current_state(rows.filter("kind <> 'purchase'")), ["ctx"])


AS_OF = "2024-01-20 00:00:00"
# Changes in observed order; clicks report something that took effect a day earlier, and a set is a value change.
CHANGES_SQL = """ch AS (SELECT ctx, seq, CASE WHEN op = 'set' THEN 'value' ELSE 'quantity' END AS kind, previous AS before, value AS after,
   value - previous AS delta, CASE WHEN op = 'add' THEN ts - INTERVAL 1 DAY ELSE ts END AS eff FROM r WHERE status = 'ok')"""


def changes(t: Tables) -> DataFrame:
    rows = L.running_state(ledger(t)).filter("status = 'ok'")
    return rows.select(
        "ctx", "seq", F.when(F.col("op") == "set", "value").otherwise("quantity").alias("kind"), F.col("previous").alias("before"),
        F.col("value").alias("after"), (F.col("value") - F.col("previous")).alias("delta"),
        F.when(F.col("op") == "add", F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")).alias("effective_at"))


@query("e7_state_as_of", f"""WITH {LEDGER_SQL}, {run_sql('led', 'r')}, {CHANGES_SQL},
 b AS (SELECT ctx, arg_min_null(before, seq) AS baseline FROM ch GROUP BY ctx),
 s AS (SELECT *, count(*) FILTER (kind = 'value') OVER w AS g FROM ch WHERE eff <= TIMESTAMP '{AS_OF}' WINDOW w AS (PARTITION BY ctx ORDER BY eff, seq)),
 v AS (SELECT s.*, CASE WHEN g = 0 THEN baseline + sum(delta) OVER w ELSE sum(CASE WHEN kind = 'value' THEN after ELSE delta END) OVER w END AS state
   FROM s JOIN b USING (ctx) WINDOW w AS (PARTITION BY ctx, g ORDER BY eff, seq)),
 p AS (SELECT v.*, coalesce(lag(state) OVER w, CASE WHEN row_number() OVER w = 1 THEN baseline END) AS was FROM v JOIN b USING (ctx) WINDOW w AS (PARTITION BY ctx ORDER BY eff, seq)),
 e AS (SELECT ctx, arg_max_null(state, struct_pack(eff, seq)) AS state, bool_or(kind = 'value' AND was IS DISTINCT FROM before) AS conflict, bool_or(kind <> 'value' AND state IS NULL) AS nobase FROM p GROUP BY ctx)
 SELECT ctx, CASE WHEN NOT coalesce(nobase, FALSE) AND NOT coalesce(conflict, FALSE) THEN CASE WHEN e.ctx IS NULL THEN baseline ELSE state END END::BIGINT AS value,
   CASE WHEN nobase THEN 'missing_baseline' WHEN conflict THEN 'time_order_state_conflict' END AS reason FROM b LEFT JOIN e USING (ctx)""")
def e7(t: Tables):
    return L.state_as_of(changes(t), F.lit(AS_OF).cast("timestamp_ntz"))


@query("e8_event_ledger", """WITH x AS (SELECT event_id AS seq, event_type AS action, event_type <> 'error' AS polarity, CASE WHEN event_type = 'view' THEN 'planned' ELSE 'asserted' END AS modality,
  CASE WHEN value > 1 THEN value < 200 END AS condition, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 3 AS roles FROM events),
 d AS (SELECT * FROM (VALUES ('signup', 'sets'), ('click', 'adds')) v(action, effect)),
 s AS (SELECT seq, x.action, effect, CASE WHEN NOT polarity THEN 'negative' WHEN modality <> 'asserted' THEN modality WHEN NOT condition THEN 'condition_false'
   WHEN condition IS NULL OR NOT roles THEN 'pending' WHEN effect IS NULL THEN 'uninterpreted' ELSE 'executed' END AS status FROM x LEFT JOIN d USING (action))
 SELECT seq, action, status, CASE WHEN status = 'executed' THEN effect END AS effect FROM s""")
def e8(t: Tables):
    ev = t.events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("action"), (F.col("event_type") != "error").alias("polarity"),
        F.when(F.col("event_type") == "view", "planned").otherwise("asserted").alias("modality"),
        F.when(F.col("value") > 1, F.col("value") < 200).alias("condition"), (F.get_json_object("props", "$.k").cast("bigint") >= 3).alias("has_roles"))
    defs = t.spark.createDataFrame([("signup", "sets"), ("click", "adds")], "action string, effect string")
    return L.event_ledger(ev, defs)


def moves(t: Tables) -> DataFrame:
    """Clicks and sign-ups move a user to place k; a purchase moves the user to where the next user is."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.filter("event_type IN ('click', 'signup', 'purchase')").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("item"), F.when(F.col("event_type") != "purchase", k).alias("place"),
        F.when(F.col("event_type") == "purchase", F.col("user_id") + 1).alias("where_item"))


@query("e9_locations", """WITH RECURSIVE m AS (SELECT event_id AS seq, user_id AS item, CASE WHEN event_type <> 'purchase' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS place,
   CASE WHEN event_type = 'purchase' THEN user_id + 1 END AS w FROM events WHERE event_type IN ('click', 'signup', 'purchase')),
 l AS (SELECT c.seq, max(o.seq) AS nxt FROM m c JOIN m o ON o.item = c.w AND o.seq < c.seq GROUP BY c.seq),
 last AS (SELECT item, max(seq) AS seq FROM m GROUP BY item),
 walk AS (SELECT item, seq, seq AS pos FROM last UNION ALL SELECT walk.item, walk.seq, l.nxt FROM walk JOIN l ON l.seq = walk.pos),
 ends AS (SELECT walk.item, walk.seq, m.place, row_number() OVER (PARTITION BY walk.item ORDER BY walk.pos) AS rn FROM walk JOIN m ON m.seq = walk.pos)
 SELECT item, place, seq FROM ends WHERE rn = 1""")
def e9(t: Tables):
    return L.locations(moves(t))


@query("e10_ledger_search", """SELECT 'event' AS kind, event_id AS id, CAST(epoch_us(ts) AS BIGINT) AS at FROM events WHERE contains(lower(event_type || ' ' || props), '"k": 7')
 UNION ALL SELECT 'turn', conv_id * 1000 + turn, NULL FROM conversations WHERE contains(lower(text), '"k": 7')
 UNION ALL SELECT 'document', doc_id, NULL FROM documents WHERE contains(lower(text), '"k": 7')""")
def e10(t: Tables):
    none = F.lit(None).cast("bigint").alias("at")
    kinds = {
        "event": t.events.select(F.col("event_id").alias("id"), micros(F.col("ts")).alias("at"), F.concat_ws(" ", "event_type", "props").alias("body")),
        "turn": t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), none, F.col("text").alias("body")),
        "document": t.documents.select(F.col("doc_id").alias("id"), none, F.col("text").alias("body")),
    }
    return L.ledger_search(kinds, '"K": 7')


@query("e11_action_effects", """WITH x AS (SELECT event_id AS seq, event_type AS action, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
 p AS (SELECT * FROM (VALUES ('click', 1, 'add', 'likes'), ('purchase', 1, 'add', 'owns'), ('purchase', 2, 'add', 'likes'), ('signup', 1, 'set', 'member')) v(action, step, op, pred))
 SELECT seq, CASE WHEN p.step IS NULL THEN 'uninterpreted' WHEN k < 5 THEN 'pending' ELSE 'executed' END AS status, CASE WHEN p.pred = 'likes' AND x.action = 'purchase' THEN 1 ELSE 0 END AS depth,
   CASE WHEN p.pred = 'likes' THEN 1 ELSE p.step END AS step, CASE WHEN k >= 5 THEN op END AS op, CASE WHEN k >= 5 AND p.step IS NOT NULL THEN CAST(user_id AS VARCHAR) END AS s,
   CASE WHEN k >= 5 THEN pred END AS p, CASE WHEN k >= 5 AND p.step IS NOT NULL THEN CAST(k AS VARCHAR) END AS o FROM x LEFT JOIN p USING (action)""")
def e11(t: Tables):
    """A purchase owns its item and calls the click program; an item number below 5 counts as a missing role."""
    k = F.get_json_object("props", "$.k")
    ev = t.events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.lit(1).alias("version"), F.map_filter(
        F.create_map(F.lit("agent"), F.col("user_id").cast("string"), F.lit("item"), F.when(k.cast("bigint") >= 5, k)), lambda _, v: v.isNotNull()).alias("roles"))
    programs = t.spark.createDataFrame(
        [("click", 1, 1, "add", "$agent", "likes", "$item"), ("purchase", 1, 1, "add", "$agent", "owns", "$item"), ("signup", 1, 1, "set", "$agent", "member", "$item")],
        "action string, version int, step int, op string, s string, p string, o string")
    calls = t.spark.createDataFrame([("purchase", 1, "click", 1)], "action string, version int, callee string, callee_version int")
    return L.action_effects(ev, programs, calls)


EXP_SQL = """ex AS (SELECT event_id AS seq, event_type AS action, user_id % 5 AS domain, substr(sha256(event_type || '|' || CAST(value >= 100 AS VARCHAR) || '|' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 50 AS VARCHAR)), 1, 16) AS shape_id,
  sha256(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS fingerprint FROM events WHERE event_type NOT IN ('view', 'error'))"""


def experiences(t: Tables) -> DataFrame:
    """Executed, asserted, positive events: views are only planned and errors negative."""
    rows = t.events.filter("event_type NOT IN ('view', 'error')").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("action"), (F.col("user_id") % 5).alias("domain"),
        (F.col("value") >= 100).alias("high"), F.floor(F.get_json_object("props", "$.k").cast("bigint") / 50).alias("bucket"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return L.experience_shapes(rows, ["action", "high", "bucket"], F.col("cents"))


@query("e12_experience_shapes", f"WITH {EXP_SQL} SELECT action, shape_id, count(*) AS n, count(DISTINCT fingerprint) AS experiences FROM ex GROUP BY ALL")
def e12(t: Tables):
    return experiences(t).groupBy("action", "shape_id").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("experiences"))


@query("e13_concept_candidates", f"""WITH {EXP_SQL}, d AS (SELECT action, shape_id, fingerprint, min(seq) AS seq FROM ex GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY action, shape_id ORDER BY seq) AS rn FROM d),
 z AS (SELECT action, shape_id, count(*) AS n, max(seq) FILTER (rn = 3) AS built_at, max(seq) FILTER (rn = 4) AS validated_at FROM r GROUP BY ALL),
 a AS (SELECT action, count(*) AS shapes, count(*) FILTER (n >= 3) AS strong FROM z GROUP BY action)
 SELECT action, shape_id, n AS experiences, built_at, validated_at, greatest(n - 4, 0) AS applied, CASE WHEN strong > 1 THEN 'conflict' WHEN shapes > 1 THEN 'inactive'
   WHEN validated_at IS NOT NULL THEN 'active' ELSE 'candidate' END AS status FROM z JOIN a USING (action) WHERE n >= 3""")
def e13(t: Tables):
    return L.concept_candidates(experiences(t))


@query("e14_cross_domain_candidates", f"""WITH {EXP_SQL}, f AS (SELECT shape_id, domain, min(seq) AS train_seq, count(*) AS n FROM ex GROUP BY ALL), w AS (SELECT shape_id, count(*) AS domains FROM f GROUP BY ALL)
 SELECT shape_id, domain, domains, train_seq, n FROM f JOIN w USING (shape_id) WHERE domains >= 3""")
def e14(t: Tables):
    return L.cross_domain_candidates(experiences(t))


@query("w3_first_per_domain", f"""WITH {EXP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY seq) AS rn FROM ex)
 SELECT seq, shape_id, CASE WHEN rn <= 3 THEN 'train' WHEN rn = 4 THEN 'validate' ELSE 'apply' END AS part FROM r""")
def w3(t: Tables):
    """The rank of every row is not needed: only the third and fourth places bound the parts."""
    ex = experiences(t).select("seq", "shape_id")
    w = Window.partitionBy("shape_id").orderBy("seq")
    head = ex.withColumn("rn", F.row_number().over(w)).filter("rn <= 4")
    edge = head.groupBy("shape_id").agg(F.max(F.when(F.col("rn") <= 3, F.col("seq"))).alias("third"), F.max(F.when(F.col("rn") == 4, F.col("seq"))).alias("fourth"))
    part = F.when(F.col("seq") <= F.col("third"), "train").when(F.col("seq") == F.col("fourth"), "validate").otherwise("apply")
    return ex.join(edge, "shape_id").select("seq", "shape_id", part.alias("part"))


@query("e15_preference_choice", """WITH s AS (SELECT l_partkey AS option, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END)::BIGINT AS signal FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
 o AS (SELECT p_brand AS decision, p_partkey AS option, p_size AS goal_fit, length(p_name) AS control_fit, p_retailprice AS utility FROM part),
 r AS (SELECT decision, o.option, row_number() OVER (PARTITION BY decision ORDER BY coalesce(signal, 0) DESC, goal_fit DESC, control_fit DESC, utility DESC, o.option) AS rn FROM o LEFT JOIN s USING (option))
 SELECT decision, option FROM r WHERE rn = 1""")
def e15(t: Tables):
    options = t.part.select(F.col("p_brand").alias("decision"), F.col("p_partkey").alias("option"), F.col("p_size").alias("goal_fit"),
                            F.length("p_name").alias("control_fit"), F.col("p_retailprice").alias("utility"))
    seen = t.lineitem.select(F.col("l_partkey").alias("option"), (F.col("l_returnflag") != "N").alias("active"),
                             F.when(F.col("l_returnflag") == "A", 1).otherwise(-1).cast("bigint").alias("signal"))
    return L.preference_choice(options, seen)


@query("e16_recall", """SELECT DISTINCT 'customer' AS kind, CAST(ctx AS VARCHAR) AS key, c_name AS value, c_mktsegment AS source, CASE WHEN c_custkey IS NULL THEN 'hold' ELSE 'found' END AS status
 FROM (SELECT user_id * 100 AS ctx FROM events) LEFT JOIN customer ON c_custkey = ctx""")
def e16(t: Tables):
    asks = t.events.select(F.lit("customer").alias("kind"), (F.col("user_id") * 100).cast("string").alias("key"))
    memory = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"), F.col("c_mktsegment").alias("source"))
    return L.recall(asks, memory)


@query("f8_validate_events", f"""WITH {LEDGER_SQL} SELECT ctx, seq, 'bad_quantity' AS code FROM led WHERE qty < 0 OR qty IS NULL UNION ALL SELECT ctx, seq, 'unknown_type' FROM led WHERE op = 'planned'
 UNION ALL SELECT ctx, seq, 'revise_without_target' FROM led WHERE op = 'revise' AND target IS NULL UNION ALL SELECT ctx, seq, 'revise_forward' FROM led WHERE op = 'revise' AND target >= seq""")
def f8(t: Tables):
    return FL.validate_events(ledger(t), ["set", "add", "remove", "revise"])


# --- joins over time and relations ---


@query("j9_state_before_event", f"""WITH {LEDGER_SQL}, {run_sql('led', 'r')}, a AS (SELECT ctx AS ask, ctx, count(*) FILTER (kind = 'signup' AND qty > 150) AS n, min(seq) FILTER (kind = 'signup' AND qty > 150) AS seq FROM led GROUP BY ctx),
 v AS (SELECT a.ask, arg_max_null(value, r.seq) AS value FROM a JOIN r ON r.ctx = a.ctx AND r.seq < a.seq WHERE n = 1 GROUP BY ask)
 SELECT ask, value, CASE WHEN n = 0 THEN 'no_event' WHEN n > 1 THEN 'ambiguous_event' WHEN value IS NULL THEN 'no_state' ELSE 'ok' END AS reason FROM a LEFT JOIN v USING (ask)""")
def j9(t: Tables):
    rows = ledger(t).withColumn("kind", F.when((F.col("kind") == "signup") & (F.col("qty") > 150), "big_signup").otherwise(F.col("kind")))
    anchors = rows.select(F.col("ctx").alias("ask"), "ctx").distinct().withColumn("kind", F.lit("big_signup"))
    return L.state_at_anchor(rows, anchors)


@query("j10_valid_at", """WITH i AS (SELECT o_custkey AS cust, o_orderdate AS a, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 90 DAY END AS until, o_orderkey AS value FROM orders),
 p AS (SELECT DISTINCT o_custkey AS cust, l_shipdate AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 h AS (SELECT p.cust, p.t, count(*) AS n, min(value) AS value FROM p JOIN i ON i.cust = p.cust AND i.a <= p.t AND (until IS NULL OR p.t < until) GROUP BY ALL)
 SELECT p.cust, CAST(epoch_us(p.t) AS BIGINT) AS t, CASE WHEN n = 1 THEN value END AS value, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM p LEFT JOIN h ON h.cust = p.cust AND h.t = p.t""")
def j10(t: Tables):
    iv = t.orders.select(F.col("o_custkey").alias("cust"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"),
                         F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 90 DAY")).alias("until"), F.col("o_orderkey").alias("value"))
    pts = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("cust"), F.col("l_shipdate").cast("timestamp_ntz").alias("t"))
    return L.valid_at(iv, pts, "cust").withColumn("t", micros(F.col("t")))


@query("j11_relation_lookup", """WITH o AS (SELECT DISTINCT o_custkey AS a FROM orders), s AS (SELECT o_custkey AS actor, n_name AS other, count(*) AS n, min(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS v
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY ALL),
 k AS (SELECT DISTINCT o_custkey AS actor, n_name AS other FROM orders CROSS JOIN nation)
 SELECT CAST(k.actor AS VARCHAR) AS actor, k.other, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN v END AS value FROM k LEFT JOIN s ON s.actor = k.actor AND s.other = k.other""")
def j11(t: Tables):
    """Each line is one occurrence of a supply relation told by four facts; asked for every customer and nation."""
    occ = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
           .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")))
    rel = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    facts = occ.select(rel.alias("rel"), F.explode(F.array(
        F.struct(F.lit("kind").alias("pred"), F.col("l_returnflag").alias("obj")), F.struct(F.lit("actor").alias("pred"), F.col("o_custkey").cast("string").alias("obj")),
        F.struct(F.lit("other").alias("pred"), F.col("n_name").alias("obj")), F.struct(F.lit("value").alias("pred"), rel.alias("obj")))).alias("f")).select("rel", "f.pred", "f.obj")
    nations = t.nation.agg(F.collect_list("n_name").alias("names"))  # 25 rows by definition of the table
    asks = t.orders.select(F.col("o_custkey").cast("string").alias("actor")).distinct().join(F.broadcast(nations)).select("actor", F.explode("names").alias("other"))
    return L.relation_lookup(facts, "R", asks)


@query("j12_leading_word_referent", """WITH s AS (SELECT DISTINCT p_name || ' ' || p_type AS subject FROM part), n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part
   UNION SELECT DISTINCT p_name || ' ' || p_type FROM part)
 SELECT name, count(subject) AS n, CASE WHEN count(subject) = 1 THEN min(subject) END AS referent FROM n LEFT JOIN s ON s.subject = name OR starts_with(s.subject, name || ' ') GROUP BY name""")
def j12(t: Tables):
    full = F.concat_ws(" ", "p_name", "p_type")
    names = t.part.select(F.explode(F.array("p_name", F.split("p_name", " ")[0], full)).alias("name"))
    return L.leading_word_referent(names, t.part.select(full.alias("subject")).distinct())


@query("j14_entity_leakage", """WITH a AS (SELECT DISTINCT o_custkey AS e FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT o_custkey AS e FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
 SELECT count(*) AS shared, count(*) = 0 AS valid FROM a JOIN b USING (e)""")
def j14(t: Tables):
    from ..operators.rules import entity_leakage

    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    rows = t.orders.select(F.col("o_custkey").alias("entity"), early.alias("train"))
    return entity_leakage(rows.filter("train").select("entity"), rows.filter("NOT train").select("entity"))


# --- decay, streaks and firsts ---

ACT_SQL = """SELECT conv, node, pow(0.75::DOUBLE, e - l) AS activation, 0.15::DOUBLE * pow(0.75::DOUBLE, e - l) AS bonus FROM (SELECT conv, node, max(turn) AS l FROM h GROUP BY ALL)
 JOIN (SELECT conv, max(turn) AS e FROM h GROUP BY ALL) USING (conv) WHERE pow(0.75::DOUBLE, e - l) >= 0.02"""


def turn_words(t: Tables) -> DataFrame:
    from ..functions import text as T

    return t.conversations.select(F.col("conv_id").alias("conv"), "turn", F.explode(T.content_terms(F.col("text"), 3)).alias("node"))


@query("w7_activation", r"""WITH h AS (SELECT conv_id AS conv, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: length(w) >= 3)) AS node FROM conversations) """ + ACT_SQL)
def w7(t: Tables):
    return D.activation(turn_words(t))


@query("a21_usage_decay", """WITH l AS (SELECT source, row_number() OVER (ORDER BY doc_id) AS turn FROM labels JOIN documents USING (doc_id) WHERE quality = 1)
 SELECT source, round(pow(0.98::DOUBLE, (SELECT max(turn) FROM l) - max(turn)), 9) AS usage FROM l GROUP BY source HAVING pow(0.98::DOUBLE, (SELECT max(turn) FROM l) - max(turn)) >= 0.02""")
def a21(t: Tables):
    from .match_plans import source_usage

    return source_usage(t).select("source", F.round("usage", 9).alias("usage"))


@query("w6_keep_recent", """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'view')
 SELECT user_id, event_id, rn <= 10 AS kept, CASE WHEN rn > 10 THEN sha256(CAST(event_id AS VARCHAR) || '|' || event_type) END AS summary FROM r""")
def w6(t: Tables):
    rows = t.events.select("user_id", "event_id", "event_type", (F.col("event_type") != "view").alias("active"))
    out = D.keep_recent(rows, "user_id", "event_id", 10)
    digest = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    return out.select("user_id", "event_id", "kept", F.when(~F.col("kept"), digest).alias("summary"))


@query("w8_ask_back_streak", """WITH v AS (SELECT user_id AS conv, event_id AS turn, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'A' ELSE 'accept' END AS verdict FROM events),
 g AS (SELECT *, sum(CASE WHEN verdict <> 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY turn) AS grp FROM v),
 s AS (SELECT *, CASE WHEN verdict = 'A' THEN sum(CASE WHEN verdict = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY conv, grp ORDER BY turn) ELSE 0 END::BIGINT AS streak FROM g)
 SELECT conv, turn, verdict, streak, CASE WHEN verdict = 'A' AND streak % 3 = 0 THEN 'B2' ELSE verdict END AS final FROM s""")
def w8(t: Tables):
    v = t.events.select(F.col("user_id").alias("conv"), F.col("event_id").alias("turn"), F.when(F.col("event_type").isin("click", "view", "error"), "A").otherwise("accept").alias("verdict"))
    return D.ask_back_streak(v)


@query("w9_milestone_first", "SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL")
def w9(t: Tables):
    return D.milestone_first(t.events, ["user_id", "event_type"], "event_id")


@query("w11_repeat_acceptance", """SELECT user_id AS conv, event_id AS turn, event_type AS claim, CAST(json_extract_string(props, '$.k') AS BIGINT) AS evidence,
 row_number() OVER (PARTITION BY user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY event_id) > 1 AS repeat FROM events""")
def w11(t: Tables):
    acc = t.events.select(F.col("user_id").alias("conv"), F.col("event_id").alias("turn"), F.col("event_type").alias("claim"), F.get_json_object("props", "$.k").cast("bigint").alias("evidence"))
    return D.repeat_acceptance(acc)


# --- totals and comparisons of current state ---


@query("a12_total", f"""WITH {LEDGER_SQL}, {run_sql('led', 'r')}, m AS (SELECT ctx // 10 AS team, count(DISTINCT ctx) AS members, count(value) AS known, sum(value)::BIGINT AS s FROM r_end GROUP BY ALL)
 SELECT team, members, known, CASE WHEN members >= 2 AND known = members THEN s END AS total FROM m""")
def a12(t: Tables):
    from ..operators.answers import total

    return total(L.current_state(ledger(t)).withColumn("team", F.floor(F.col("ctx") / 10)), "team", "ctx", "value")


@query("a13_compare", f"""WITH {LEDGER_SQL}, {run_sql('led', 'r')}, n AS (SELECT DISTINCT ctx FROM led)
 SELECT n.ctx AS a, n.ctx + 1 AS b, CASE WHEN x.value IS NULL OR y.value IS NULL THEN NULL WHEN x.value > y.value THEN 'more' WHEN x.value < y.value THEN 'fewer' ELSE 'same' END AS outcome
 FROM n LEFT JOIN r_end x ON x.ctx = n.ctx LEFT JOIN r_end y ON y.ctx = n.ctx + 1""")
def a13(t: Tables):
    from ..operators.answers import compare

    rows = ledger(t)
    asks = rows.select(F.col("ctx").alias("a"), (F.col("ctx") + 1).alias("b")).distinct()
    return compare(asks, L.current_state(rows).select(F.col("ctx").alias("who"), "value"))


@query("a14_attribute_compare", """SELECT a.p_partkey AS a, b.p_partkey AS b, u.attr, u.av, u.bv FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1,
 LATERAL (VALUES ('name', a.p_name, b.p_name), ('brand', a.p_brand, b.p_brand), ('type', a.p_type, b.p_type), ('size', CAST(a.p_size AS VARCHAR), CAST(b.p_size AS VARCHAR))) u(attr, av, bv) WHERE u.av <> u.bv""")
def a14(t: Tables):
    from ..operators.answers import attribute_compare

    entries = t.part.select(F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"),
                            F.lit("size"), F.col("p_size").cast("string")).alias("attrs"))
    return attribute_compare(t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")), entries)


@query("a15_unique_answer", "SELECT l_orderkey AS ask, count(DISTINCT l_suppkey) AS bindings, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS answer FROM lineitem GROUP BY ALL")
def a15(t: Tables):
    from ..operators.answers import unique_answer

    return unique_answer(t.lineitem.select(F.col("l_orderkey").alias("ask"), F.col("l_suppkey").alias("binding")))
