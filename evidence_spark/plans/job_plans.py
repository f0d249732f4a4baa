"""Queries for streaming twins, the SQL surface and measurement jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import register as X
from ..functions import text as T
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import match as M
from ..operators import quality as Q
from ..operators import rules as R
from ..session import materialize, shared_dir, spread
from ..streaming import jobs as S
from . import match_plans as MP
from .corpus_plans import EV_SQL
from .ledger_plans import LEDGER_SQL, ledger, run_sql, turn_words
from .match_plans import SCORES_SQL, TERMS
from .registry import ORACLES, Tables, query


def replay(t: Tables, rows: DataFrame, label: str, parts: int = 4, order: str | None = None) -> tuple[DataFrame, str]:
    """Rows written as files and read back as a stream, one file per micro-batch; also the folder for results.

    With ``order`` the files are written one after the other, as the stream takes them by age."""
    root = f"{shared_dir(t.spark)}/evidence_spark/stream-{label}-{uuid.uuid4().hex}"
    if order is None:
        rows.repartition(parts).write.parquet(f"{root}/in")
    else:
        ranged = materialize(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "stream")
        for part in range(parts):
            ranged.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(f"{root}/in")
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), root


def drain(writer, root: str) -> None:
    query_ = writer.start()
    query_.awaitTermination()  # an availableNow stream ends by itself
    if query_.exception():
        raise query_.exception()


def collect_updates(t: Tables, stream: DataFrame, root: str, mode: str) -> DataFrame:
    """Every emitted row with its batch number, from a finished run."""

    def store(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/b={n}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    # State of several variables is kept by this provider only.
    t.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        drain(stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True), root)
    finally:
        t.spark.conf.set(provider, before)
    return t.spark.read.parquet(f"{root}/out").drop("b")


@query("t1_stream_state", f"WITH {LEDGER_SQL}, {run_sql('led', 'r')} SELECT ctx, value, status, events FROM r_end")
def t1(t: Tables):
    stream, root = replay(t, ledger(t).select("ctx", "seq", "op", "qty"), "state", order="seq")
    out = collect_updates(t, S.stream_state(stream), root, "update")
    return out.groupBy("ctx").agg(F.max_by(F.struct("value", "status", "events"), F.struct("events", "batch")).alias("s")).filter("s.events > 0").select("ctx", "s.value", "s.status", "s.events")


# A user's events as turns; a session ends after six hours without one.
@query("t2_stream_sessions", r"""WITH e AS (SELECT user_id AS conv, event_id AS turn, ts, event_type AS node, json_extract_string(props, '$.k') AS slot,
   CASE WHEN event_type IN ('click', 'view', 'error') THEN 'A' ELSE 'accept' END AS verdict, CASE WHEN event_type = 'purchase' THEN CAST(round_even(value, 0) AS BIGINT) END AS value FROM events),
 g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY conv ORDER BY ts, turn)),
 s AS (SELECT *, sum(cut) OVER (PARTITION BY conv ORDER BY ts, turn) AS no FROM g),
 t AS (SELECT *, row_number() OVER (PARTITION BY conv, no ORDER BY ts, turn) AS n, sum(CASE WHEN verdict <> 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY conv, no ORDER BY ts, turn) AS run FROM s),
 h AS (SELECT conv, no, arg_min(turn, n) AS session, count(*) AS turns FROM t GROUP BY ALL),
 r AS (SELECT conv, no, run, count(*) FILTER (verdict = 'A') AS a FROM t GROUP BY ALL), d AS (SELECT conv, no, sum(a // 3)::BIGINT AS demoted, (arg_max(a, run) % 3)::BIGINT AS streak FROM r GROUP BY ALL),
 v AS (SELECT conv, no, count(*) AS held_n, sum(x)::BIGINT AS held_sum FROM (SELECT conv, no, slot, arg_min(value, n) AS x FROM t WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 f AS (SELECT conv, no, count(DISTINCT node) AS filled_n FROM t WHERE verdict = 'accept' GROUP BY ALL),
 p AS (SELECT conv, no, node, max(n) AS hit FROM t GROUP BY ALL), q AS (SELECT conv, no, pow(0.75::DOUBLE, turns - hit) AS a FROM p JOIN h USING (conv, no)),
 y AS (SELECT conv, no, count(*) AS active_n, round(sum(a), 6) AS activation FROM q WHERE a >= 0.02 GROUP BY ALL)
 SELECT conv, session, turns, streak, demoted, coalesce(held_n, 0) AS held_n, coalesce(held_sum, 0) AS held_sum, coalesce(filled_n, 0) AS filled_n, active_n, activation
 FROM h JOIN d USING (conv, no) LEFT JOIN v USING (conv, no) LEFT JOIN f USING (conv, no) JOIN y USING (conv, no)""")
def t2(t: Tables):
    """The last state of every session."""
    stream, root = replay(t, session_turns(t), "sessions", order="ts")
    out = collect_updates(t, S.stream_sessions(stream), root, "update")
    last = out.groupBy("conv", "session").agg(F.max_by(F.struct("turns", "streak", "demoted", "held_n", "held_sum", "filled_n", "active_n", "activation"), "turns").alias("s"))
    return last.select("conv", "session", "s.*").withColumn("activation", F.round("activation", 6))


def session_turns(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(
        F.col("user_id").alias("conv"), F.col("event_id").alias("turn"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("node"), F.when(kind.isin("click", "view", "error"), "A").otherwise("accept").alias("verdict"),
        F.get_json_object("props", "$.k").alias("slot"), F.when(kind == "purchase", F.bround("value", 0).cast("bigint")).alias("value"))


@query("t2b_stream_activation", r"""WITH h AS (SELECT conv_id AS conv, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: length(w) >= 3)) AS node FROM conversations),
 l AS (SELECT conv, node, max(turn) AS turn FROM h GROUP BY ALL) SELECT conv, node, pow(0.75::DOUBLE, (SELECT max(turn) FROM h WHERE h.conv = l.conv AND h.node = l.node) - turn) AS activation, turn FROM l""")
def t2b(t: Tables):
    stream, root = replay(t, turn_words(t), "activation", order="turn")
    out = collect_updates(t, S.stream_activation(stream), root, "update")
    return out.groupBy("conv", "node").agg(F.max_by("activation", "batch").alias("activation"), F.max("turn").alias("turn"))


@query("t3_stream_verdicts")
def t3(t: Tables):
    """Each micro-batch of user turns is matched against the index lines."""
    lines = M.source_lines(MP.index(t))
    stream, root = replay(t, t.user_turns().select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), F.col("text").alias("question")), "verdicts", 2)

    def work(batch: DataFrame) -> DataFrame:
        return M.best_by_source(lines, batch, 0.72)

    drain(S.run_each(stream, work, f"{root}/out", f"{root}/ck"), root)
    return t.spark.read.schema("q bigint, source string, score double").parquet(f"{root}/out").select("q", "source", "score")


def event_log(t: Tables) -> DataFrame:
    return t.events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "event_id")


_MINUTE = "CAST(epoch_us({}) AS BIGINT) // 60000000"


def _counted(t: Tables, count, mode: str, label: str) -> DataFrame:
    """Windows of the replayed events with their count, as the running stream has left them.

    Windows that come out only once the watermark has passed them need a last row far behind them; it is not counted."""
    rows = event_log(t).select("ts", "kind")
    if mode == "append":
        end = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select("ts", F.lit("~end").alias("kind"))
        rows = rows.unionByName(end)
    stream, root = replay(t, rows, label, order="ts")
    out = collect_updates(t, count(stream).select("w.start", "w.end", "kind", "n"), root, mode).filter("kind <> '~end'")
    minute = lambda c: F.expr(f"unix_micros({c}) div 60000000")
    return out.groupBy(minute("start").alias("start"), minute("end").alias("end"), "kind").agg(F.max("n").alias("n"))


@query("t4_stream_unknown_counts", f"""SELECT {_MINUTE.format("date_trunc('day', ts)")} AS start, {_MINUTE.format("date_trunc('day', ts)")} + 1440 AS "end", event_type AS kind, count(*) AS n FROM events GROUP BY ALL""")
def t4(t: Tables):
    """Days, updated while the stream runs."""
    return _counted(t, lambda s: S.unknown_counts(s), "update", "days")


@query("t4b_stream_sliding_counts", f"""WITH m AS (SELECT event_type AS kind, epoch_us(ts) // 60000000 AS m, unnest(range(4)) AS i FROM events),
 s AS (SELECT kind, (m // 15 - i) * 15 AS start FROM m) SELECT start::BIGINT AS start, (start + 60)::BIGINT AS "end", kind, count(*) AS n FROM s GROUP BY ALL""")
def t4b(t: Tables):
    """Hours that begin every quarter of an hour, each given out once, when the watermark has passed it."""
    return _counted(t, lambda s: S.unknown_counts(s, "1 hour", slide="15 minutes"), "append", "sliding")


@query("t4c_stream_bursts", """WITH g AS (SELECT event_type AS kind, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
 s AS (SELECT kind, ts, sum(cut) OVER (PARTITION BY kind ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
 SELECT CAST(epoch_us(min(ts)) AS BIGINT) // 60000000 AS start, CAST(epoch_us(max(ts)) + 1800000000 AS BIGINT) // 60000000 AS "end", kind, count(*) AS n FROM s GROUP BY kind, no""")
def t4c(t: Tables):
    """Bursts: a window lasts until half an hour has passed without a row."""
    return _counted(t, lambda s: S.burst_counts(s), "append", "bursts")


@query("t5_stream_dedup", "SELECT event_type AS kind, count(*) AS n, count(DISTINCT event_id) AS distinct_ids FROM events GROUP BY event_type")
def t5(t: Tables):
    twice = event_log(t).unionByName(event_log(t))
    stream, root = replay(t, twice, "dedup", order="ts")
    out = collect_updates(t, S.stream_dedup(stream, ["event_id"]), root, "append")
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_ids"))


def as_of_stream(t: Tables, late: str) -> DataFrame:
    """AS_OF_ROWS of all changes, replayed in the order in which they were observed."""
    from .ledger_plans import AS_OF, changes

    rows = changes(t).withColumn("effective_at", F.col("effective_at").cast("timestamp"))
    stream, root = replay(t, rows, "late", 4, "seq")
    at = t.spark.range(1).select(F.unix_micros(F.lit(AS_OF).cast("timestamp")).alias("at")).first()["at"]
    return collect_updates(t, S.stream_as_of(stream, at, late), root, "update")


@query("t6_stream_late_effective", ORACLES["e7_state_as_of"])
def t6(t: Tables):
    """Late effective times: the last state of each context.  Effects lie a day back at most, so none is too late."""
    out = as_of_stream(t, "2 days").filter("NOT late")
    return out.groupBy("ctx").agg(F.max_by(F.struct("value", "reason"), "changes").alias("s")).select("ctx", "s.value", "s.reason")


@query("t7_stream_corroboration", f"""WITH {EV_SQL} SELECT topic, TRUE AS two_domains FROM ev WHERE NOT denied AND domain <> '' AND topic IS NOT NULL GROUP BY topic HAVING count(DISTINCT domain) >= 2""")
def t7(t: Tables):
    """Which two domains a topic met first depends on arrival, so only that they differ is compared."""
    from .corpus_plans import page_evidence

    stream, root = replay(t, page_evidence(t).filter("NOT denied").select("topic", "domain"), "corroborate", 3)
    return collect_updates(t, S.stream_corroboration(stream), root, "append").select("topic", (F.col("first") != F.col("second")).alias("two_domains"))


# --- SQL surface ---


@query("x1_passage_labels", "SELECT item_id, 0 AS n_labels, length(text) > 150 AS long FROM benchmark")
def x1(t: Tables):
    """Without a classifier nothing is guessed; with one its labels arrive."""
    def by_length(texts):
        return texts.map(lambda s: ["long"] if len(s) > 150 else [])

    none = X.passage_labels(t.benchmark, "text").select("item_id", F.size("labels").alias("n_labels"))
    some = X.passage_labels(t.benchmark, "text", by_length).select("item_id", (F.size("labels") > 0).alias("long"))
    return none.join(some, "item_id")


@query("x2_coverage_function", "WITH " + MP.grams_sql("pg", "(SELECT p_partkey, p_name FROM part) p", "p_partkey", "p_name") + ", " + MP.grams_sql("tg", "(SELECT p_partkey, p_name || ' ' || lower(p_type) AS x FROM part) p", "p_partkey", "x") +
       ", s AS (SELECT p_partkey, sum(pg.n)::BIGINT AS s, sum(tg.n)::BIGINT AS u FROM pg JOIN tg USING (p_partkey, gram) GROUP BY ALL) SELECT p_partkey, s::DOUBLE / (SELECT sum(n) FROM pg x WHERE x.p_partkey = s.p_partkey)::DOUBLE AS cov, sqrt((s::DOUBLE / (SELECT sum(n) FROM pg x WHERE x.p_partkey = s.p_partkey)::DOUBLE) * (u::DOUBLE / (SELECT sum(n) FROM tg x WHERE x.p_partkey = s.p_partkey)::DOUBLE)) AS geo FROM s")
def x2(t: Tables):
    other = F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"))
    return spread(t.part).select("p_partkey", X.coverage(F.col("p_name"), other).alias("cov"), X.geometric_coverage(F.col("p_name"), other).alias("geo"))


@query("x3_char_grams_table", "WITH " + MP.grams_sql("g", "benchmark", "item_id", "text") + " SELECT item_id, gram, n FROM g")
def x3(t: Tables):
    X.register(t.spark)
    t.benchmark.createOrReplaceTempView("evidence_items")
    return t.spark.sql("SELECT item_id, g.gram, CAST(g.n AS BIGINT) AS n FROM evidence_items, LATERAL char_grams(text) g")


@query("x4_decayed_activation", """WITH y AS (SELECT o_custkey, pow(0.75::DOUBLE, 2000 - max(year(o_orderdate))) AS a FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN a >= 0.02 THEN a ELSE 0.0 END AS activation FROM y""")
def x4(t: Tables):
    X.register(t.spark)
    t.orders.createOrReplaceTempView("evidence_orders")
    return t.spark.sql("SELECT o_custkey, decayed_activation(max(year(o_orderdate)), 2000) AS activation FROM evidence_orders GROUP BY o_custkey")


# --- measurement ---

HELD = """al AS (SELECT p_brand AS node, p_name AS phrase, row_number() OVER (PARTITION BY p_brand ORDER BY p_name DESC) AS rn FROM (SELECT DISTINCT p_brand, p_name FROM part))"""


@query("q1_held_out_routing", f"""WITH {HELD}, {MP.grams_sql('g', '(SELECT DISTINCT phrase FROM al)', 'phrase', 'phrase')}, tt AS (SELECT phrase, sum(n)::BIGINT AS t FROM g GROUP BY ALL),
 pp AS (SELECT x.phrase AS a, y.phrase AS b, sum(x.n)::BIGINT AS sa, sum(y.n)::BIGINT AS sb FROM g x JOIN g y USING (gram) GROUP BY ALL),
 s AS (SELECT q.node AS own, l.node, max(sqrt((sa::DOUBLE / ta.t) * (sb::DOUBLE / tb.t))) AS score FROM al q JOIN pp ON b = q.phrase JOIN al l ON l.phrase = a AND l.rn > 1 JOIN tt ta ON ta.phrase = a JOIN tt tb ON tb.phrase = b WHERE q.rn = 1 GROUP BY ALL),
 w AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, node) AS k FROM s)
 SELECT own, node AS winner, score, node = own AS hit, score >= 0.43 AS answered FROM w WHERE k = 1""")
def q1(t: Tables):
    """Each brand's last name is held out of the index and asked."""
    from pyspark.sql import Window

    w = Window.partitionBy("node").orderBy(F.desc("phrase"))
    al = MP.brand_aliases(t).withColumn("rn", F.row_number().over(w))
    asked = al.filter("rn = 1").select(F.col("node").alias("own"), F.col("phrase").alias("question"))
    index = al.filter("rn > 1").select("node", "phrase")
    best = M.best_partners(asked, "own", "question", index, "node", "phrase").select(F.col("q").alias("own"), F.col("node").alias("winner"), "score")
    return best.select("own", "winner", "score", (F.col("winner") == F.col("own")).alias("hit"), (F.col("score") >= 0.43).alias("answered"))


@query("q2_frozen_questions", """SELECT doc_id, min(md5('11|' || doc_id)) AS place FROM (SELECT DISTINCT doc_id, string_split(text, chr(10))[1] AS line FROM documents) d WHERE line NOT IN (SELECT line FROM (SELECT string_split(text, chr(10))[1] AS line, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1) GROUP BY doc_id ORDER BY 2, 1 LIMIT 200""")
def q2(t: Tables):
    """First lines that occur in exactly one document, 200 of them by a seeded order."""
    line = F.split("text", "\n")[0]
    once = t.documents.groupBy(line.alias("line")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    place = F.md5(F.concat_ws("|", F.lit("11"), F.col("doc_id").cast("string")))
    return once.select("doc_id", place.alias("place")).orderBy("place", "doc_id").limit(200)


@query("q4_miss_diagnosis", """WITH RECURSIVE n AS (SELECT DISTINCT o_custkey AS q, l_suppkey % 25 AS got FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
 x AS (SELECT q, got, c_nationkey AS want FROM n JOIN customer ON c_custkey = q), r AS (SELECT x.*, a.n_regionkey AS ra, b.n_regionkey AS rb FROM x JOIN nation a ON a.n_nationkey = got JOIN nation b ON b.n_nationkey = want)
 SELECT q, got, CASE WHEN got = want THEN 'exact' WHEN ra = rb THEN 'connected' ELSE 'disconnected' END AS diagnosis, CASE WHEN got = want THEN 0 WHEN ra = rb THEN 2 END AS hops FROM r""")
def q4(t: Tables):
    """The nation a supplier points to against the customer's own: exact, connected through a region, or not at all."""
    got = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("q"), (F.col("l_suppkey") % 25).cast("int").alias("got")).distinct()
    want = got.join(t.customer.select(F.col("c_custkey").alias("q"), F.col("c_nationkey").alias("want")), "q")
    up = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    edges = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    hops = G.hop_distance(edges, up.select(F.col("src").alias("seed"), F.col("src").alias("node")))
    far = hops.select(F.expr("CAST(substring(seed, 2) AS INT)").alias("got"), F.when(F.col("node").startswith("n"), F.expr("TRY_CAST(substring(node, 2) AS INT)")).alias("want"), "hops")
    j = want.join(far, ["got", "want"], "left")
    name = F.when(F.col("hops") == 0, "exact").when(F.col("hops").isNotNull(), "connected").otherwise("disconnected")
    return j.select("q", "got", name.alias("diagnosis"), "hops")


@query("q5_ablation", f"""WITH {SCORES_SQL}, a AS (SELECT q, max(score) >= 0.75 AS r FROM node_scores GROUP BY q),
 n1 AS (SELECT fr.q, max(sqrt((ls::DOUBLE / lt) * (qs::DOUBLE / qt))) >= 0.75 AS r FROM pairs JOIN (SELECT item_id AS q, text AS fragment FROM benchmark) fr USING (fragment) GROUP BY fr.q)
 SELECT a.q, CASE WHEN n1.r = a.r THEN 'same' WHEN a.r THEN 'fixed' ELSE 'broken' END AS change FROM a JOIN n1 ON n1.q = a.q""")
def q5(t: Tables):
    """Do the fragments help?  Best score at least 0.75 without and with them."""
    idx = MP.index(t)
    plain = t.questions().select("q", F.col("question").alias("fragment"), F.lit(1.0).alias("weight"))

    def right(frags: DataFrame) -> DataFrame:
        return M.top_nodes(idx, frags, 1).groupBy("q").agg((F.max("score") >= 0.75).alias("right"))

    return Q.regression_diff(right(plain), right(MP.item_fragments(t)), "q")


@query("q6_answer_scoring", """SELECT CASE WHEN l_returnflag = 'N' THEN 'hold' WHEN l_quantity >= 10 THEN 'correct' ELSE 'wrong' END AS outcome, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL""")
def q6(t: Tables):
    """Answers in words against known quantities: no number holds; small quantities are answered one too high."""
    q = F.col("l_quantity").cast("int")
    answer = F.when(F.col("l_returnflag") == "N", "I do not know.").otherwise(F.concat(F.lit("It was "), F.when(q >= 10, q).otherwise(q + 1), F.lit(" kg in all.")))
    first = F.get(F.filter(T.extract_numbers(answer), lambda x: x["unit"] == "kg"), F.lit(0))["value"]
    outcome = F.when(first.isNull(), "hold").when(first == F.col("l_quantity"), "correct").otherwise("wrong")
    return t.lineitem.select("l_linestatus", outcome.alias("outcome")).groupBy("outcome", "l_linestatus").agg(F.count("*").alias("n"))


@query("q8_closure_probe", """WITH RECURSIVE e AS (SELECT l_orderkey AS c, l_linenumber AS s, l_linenumber + 1 AS o FROM lineitem GROUP BY ALL), w(c, s, o) AS (SELECT c, s, o FROM e UNION SELECT w.c, w.s, e.o FROM w JOIN e ON e.c = w.c AND e.s = w.o) SELECT c, count(*) AS facts FROM w GROUP BY c""")
def q8(t: Tables):
    """Chains of an order's line numbers, one context per order: closure size."""
    facts = t.lineitem.select(F.col("l_orderkey").alias("ctx"), F.col("l_linenumber").cast("string").alias("s"), F.lit("before").alias("p"), (F.col("l_linenumber") + 1).cast("string").alias("o"))
    rule = R.Rule("before_transitive", (("?a", "before", "?b"), ("?b", "before", "?c")), ("?a", "before", "?c"))
    return R.closure(facts, [rule]).groupBy(F.col("ctx").alias("c")).agg(F.count("*").alias("facts"))


@query("q9_top_hits", f"""WITH {SCORES_SQL}, {MP.EVIDENCE_SQL.replace('hits AS', 'eh AS')}, r AS (SELECT q, source, pure, row_number() OVER (PARTITION BY q ORDER BY pure DESC, source) AS k FROM support), w AS (SELECT DISTINCT node AS q, source FROM eh JOIN documents ON doc_id = u)
 SELECT b.item_id AS q, count(w.source) AS reachable, coalesce(bool_or(k = 1), FALSE) AS top1, coalesce(bool_or(k <= 3), FALSE) AS top3 FROM benchmark b LEFT JOIN w ON w.q = b.item_id LEFT JOIN r ON r.q = w.q AND r.source = w.source GROUP BY b.item_id""")
def q9(t: Tables):
    """Is a source that really holds the item among the first or the first three?  Items no source holds count apart."""
    from pyspark.sql import Window

    s = M.support_scores(MP.best_of(t))
    w = Window.partitionBy("q").orderBy(F.desc("pure"), "source")
    ranked = s.withColumn("k", F.row_number().over(w)).select("q", "source", "k")
    held = M.evidence_hits(*MP.evidence_inputs(t)).select(F.col("node").alias("q"), F.col("u").alias("doc_id")).join(t.documents.select("doc_id", "source"), "doc_id").select("q", "source").distinct()
    j = t.questions().select("q").join(held, "q", "left").join(ranked, ["q", "source"], "left")
    return j.groupBy("q").agg(F.count("source").alias("reachable"), F.coalesce(F.bool_or(F.col("k") == 1), F.lit(False)).alias("top1"), F.coalesce(F.bool_or(F.col("k") <= 3), F.lit(False)).alias("top3"))
