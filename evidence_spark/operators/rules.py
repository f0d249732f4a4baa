"""Rule inference over a fact table: joins generated from rules, run to a fixpoint.

facts(ctx, s, p, o); a rule is (id, body patterns, head pattern) with variables written "?x".  Rules are few and live
on the driver; facts stay distributed.  Every round joins one delta atom with the known facts (semi-naive), drops
known and denied heads and writes the delta.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .fixpoint import COMPACT, union_all

Triple = tuple[str, str, str]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    body: tuple[Triple, ...]
    head: Triple

    def check(self) -> "Rule":
        bound = {x for atom in self.body for x in atom if x.startswith("?")}
        if not self.body or any(x.startswith("?") and x not in bound for x in self.head):
            raise ValueError(f"unsafe rule {self.rule_id}")
        return self


def fact_id(prefix: str = "") -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.col(prefix + c) for c in "spo"]), 256)


def _atom(facts: DataFrame, atom: Triple) -> DataFrame:
    """Rows matching one pattern: constants become filters, repeated variables equalities, variables columns."""
    df, cols = facts, {}
    for col, term in zip("spo", atom):
        if not term.startswith("?"):
            df = df.filter(F.col(col) == term)
        elif term in cols:
            df = df.filter(F.col(col) == F.col(cols[term]))
        else:
            cols[term] = col
    return df.select("ctx", *[F.col(c).alias(v) for v, c in cols.items()])


def rule_body_join(atoms: Sequence[tuple[Triple, DataFrame]]) -> DataFrame:
    """Conjunctive join of patterns on the context and their shared variables.  The next atom is one that shares a
    variable with what is bound, so no cross join arises within connected bodies."""
    todo = list(atoms)
    out, bound = None, set()
    while todo:
        k = next((k for k, x in enumerate(todo) if out is None or any(t in bound for t in x[0])), 0)
        pattern, facts = todo.pop(k)
        rows = _atom(facts, pattern)
        names = {t for t in pattern if t.startswith("?")}
        out = rows if out is None else out.join(rows, ["ctx", *sorted(bound & names)])
        bound |= names
    return out


def _head(df: DataFrame, head: Triple, *extra: Column) -> DataFrame:
    cols = [(F.col(t) if t.startswith("?") else F.lit(t)).alias(c) for c, t in zip("spo", head)]
    return df.select("ctx", *cols, *extra)


#: Shapes of facts that are told apart; where there are more, every fact may meet every other one.
SHAPES = 256
_SEPARATOR, _NULL = "\x1f", "\x00"
#: A fact's shape: its terms without their digits, as equal terms have equal shapes.
Shape = tuple[str | None, str | None, str | None]


def _shape(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", "")


def _kind() -> Column:
    return F.concat_ws(_SEPARATOR, *[F.coalesce(_shape(F.col(c)), F.lit(_NULL)) for c in "spo"])


def _bare(term: str) -> str:
    return "".join(x for x in term if x not in "0123456789")


def _of_kinds(df: DataFrame, kinds: set[Shape] | None, among: set[Shape] | None) -> DataFrame:
    """Rows whose shape is one of ``kinds``; ``among`` are the shapes that there are."""
    if kinds is None or kinds == among:
        return df
    return df.filter(F.col("kind").isin(sorted({_SEPARATOR.join(_NULL if x is None else x for x in k) for k in kinds})))


def _meeting(rule: Rule, sources: Sequence[set[Shape] | None]) -> tuple[list[set[Shape]], set[Shape]] | None:
    """(shapes of each atom's facts that may take part, shapes of the heads), from the shapes of each atom's source; None if
    that can't be told.  A rule that no shapes let fire has no heads."""
    if any(x is None for x in sources):
        return None
    found: list[tuple[dict, tuple[Shape, ...]]] = [({}, ())]
    for atom, kinds in zip(rule.body, sources, strict=True):
        longer = []
        for bound, used in found:
            for kind in kinds:
                names = dict(bound)
                if all((names.setdefault(term, x) if term.startswith("?") else _bare(term)) == x for term, x in zip(atom, kind, strict=True)):
                    longer.append((names, (*used, kind)))
        found = longer
        if len(found) > SHAPES * SHAPES:
            return None
    heads = {tuple(names[x] if x.startswith("?") else _bare(x) for x in rule.head) for names, _ in found}
    return [{used[k] for _, used in found} for k in range(len(rule.body))], heads


def _between(rule: Rule) -> list[str]:
    """Variables of a rule that its head does not tell."""
    return sorted({x for atom in rule.body for x in atom if x.startswith("?")} - set(rule.head))


def _parents(rules: Sequence[Rule]) -> Column:
    """The ids of a fact's parents, from the fact, the number of its rule (``ord``) and the variables ``_between`` (``mid``)."""
    out = F.array().cast("array<string>")
    for order, rule in enumerate(rules):
        at = {x: F.col(c) for c, x in reversed(list(zip("spo", rule.head, strict=True)))} | {x: F.get("mid", F.lit(k)) for k, x in enumerate(_between(rule))}
        ids = [F.sha2(F.concat_ws(_SEPARATOR, *[at[x] if x.startswith("?") else F.lit(x) for x in atom]), 256) for atom in rule.body]
        out = F.when(F.col("ord") == order, F.array(*ids)).otherwise(out)
    return out


def closure(facts: DataFrame, rules: Sequence[Rule], denied: DataFrame | None = None, max_rounds: int | None = None, proofs: bool = False) -> DataFrame:
    """(ctx, s, p, o, round[, rule, parents]): least fixpoint of the rules over asserted facts.

    A denied fact is neither used nor derived.  With ``proofs`` the first proof of each derived fact is kept: the
    earliest round, then rule order, then the smallest parents.  Parents are kept as what the rule's variables stand for
    and become ids where they are read.  Facts whose shapes no rule brings together are not joined.
    """
    rules = [r.check() for r in rules]
    key = ["ctx", "s", "p", "o"]
    known0 = facts.select(*key).distinct()
    if denied is not None:
        known0 = known0.join(denied.select(*key), key, "left_anti")
    known0 = known0.withColumn("round", F.lit(0))
    if proofs:
        known0 = known0.withColumn("ord", F.lit(None).cast("int")).withColumn("mid", F.lit(None).cast("array<string>"))
    delta = materialize(known0.withColumn("kind", _kind()), "facts")
    shapes = delta.select(*[_shape(F.col(c)).alias(c) for c in "spo"]).distinct().limit(SHAPES + 1).collect()
    young = {tuple(r) for r in shapes} if len(shapes) <= SHAPES else None
    parts, older = [delta], []
    seen, before = young, set()
    result = lambda: union_all(parts).select(*key, "round", *_named(rules, proofs))
    for rnd in count(1):
        known = union_all(parts)
        old = union_all(older) if older else None
        heads, made = [], set()
        for order, rule in enumerate(rules):
            for i in range(len(rule.body)):
                # Atoms before the delta see only older facts, so a pair of deltas is joined once.
                if i > 0 and old is None:
                    continue
                kinds = [young if k == i else (before if k < i else seen) for k in range(len(rule.body))]
                met = _meeting(rule, kinds)
                if met is not None and not met[1]:
                    continue
                made = made | met[1] if met is not None and made is not None and len(made | met[1]) <= SHAPES else None
                sources = [delta if k == i else (old if k < i else known) for k in range(len(rule.body))]
                atoms = [(a, _of_kinds(src, met and met[0][k], kinds[k])) for k, (a, src) in enumerate(zip(rule.body, sources, strict=True))]
                rows = rule_body_join(atoms)
                if proofs:
                    mid = F.array(*[F.col(x).cast("string") for x in _between(rule)]).cast("array<string>")
                    heads.append(_head(rows, rule.head, F.lit(order).alias("ord"), mid.alias("mid")))
                else:
                    heads.append(_head(rows, rule.head).distinct())
        if not heads:
            return result()
        new = union_all(heads)
        if proofs:
            # Dealt before the parents are worked out, so that no id is shuffled.
            new = new.repartition(*key).groupBy(*key).agg(F.min(F.struct("ord", _parents(rules).alias("parents"), "mid")).alias("m")).select(*key, F.col("m.ord").alias("ord"), F.col("m.mid").alias("mid"))
        else:
            new = new.distinct()
        if made is None or seen is None or made & seen:
            new = new.join(_of_kinds(known, made and seen and made & seen, seen).select(*key), key, "left_anti")
        if denied is not None:
            new = new.join(denied.select(*key), key, "left_anti")
        older = list(parts)
        delta = materialize(new.withColumn("round", F.lit(rnd)).withColumn("kind", _kind()), "facts")
        if delta.isEmpty():
            return result()
        if max_rounds is not None and rnd > max_rounds:
            raise RuntimeError(f"closure: more than {max_rounds} rounds needed")
        parts.append(delta)
        before, young = seen, made
        seen = None if seen is None or made is None or len(seen | made) > SHAPES else seen | made
        if len(parts) >= COMPACT:
            older = [materialize(union_all(older + parts[len(older) : -1]), "facts")]
            parts = [*older, delta]


def _named(rules: Sequence[Rule], proofs: bool) -> list[Column]:
    if not proofs:
        return []
    return [F.get(F.array(*[F.lit(r.rule_id) for r in rules]).cast("array<string>"), F.col("ord")).alias("rule"), _parents(rules).alias("parents")]


def _expand(derived: DataFrame, goals: DataFrame, cut: Callable[[Column], Column]) -> list[DataFrame]:
    """Levels (n, fact, depth) of the facts below each of goals(n, parents, round), whose parents are ids ``cut`` short."""
    steps = derived.filter(F.size("parents") > 0).select("round", cut(fact_id()).alias("fact"), F.transform("parents", cut).alias("parents"))
    most = goals.agg(F.max("round").alias("r")).first()["r"]
    cur = goals.select("n", F.explode(F.array_distinct("parents")).alias("fact"))
    levels = [cur.withColumn("depth", F.lit(1))]
    # A parent is of an earlier round than its child, and a fact of round 0 has none.
    for depth in range(1, most or 0):
        below = cur.join(steps.filter(F.col("round") <= most - depth).drop("round"), "fact")
        cur = materialize(below.select("n", F.explode("parents").alias("fact")).distinct(), "proof")
        levels.append(cur.withColumn("depth", F.lit(depth + 1)))
    return levels


def proof(derived: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, fact, depth): every fact in the first proof of each target, with its greatest depth below it.

    ``derived`` comes from ``closure(..., proofs=True)``; premises order first when sorted by descending depth.
    """
    name = lambda c: F.lower(F.hex(c))
    asked = targets.select(F.unhex(fact_id()).alias("n")).distinct()
    own = derived.select(F.unhex(fact_id()).alias("n"), F.transform("parents", F.unhex).alias("parents"), "round")
    goals = materialize(asked.join(own, "n", "left"), "goals")
    top = goals.select("n", F.col("n").alias("fact"), F.lit(0).alias("depth"))
    return union_all([top, *_expand(derived, goals, F.unhex)]).groupBy(name("n").alias("target"), name("fact").alias("fact")).agg(F.max("depth").alias("depth"))


def proof_sizes(derived: DataFrame, targets: DataFrame) -> DataFrame:
    """(ctx, s, p, o, facts, depth): how many facts the first proof of each target has, itself included, and how deep it is.

    ``targets`` are rows of ``derived``.  They go by number, the facts below them by the first 128 bits of their ids."""
    key = ["ctx", "s", "p", "o"]
    cut = lambda c: F.unhex(F.substring(c, 1, 32))
    goals = materialize(targets.select(*key, "round", F.transform("parents", cut).alias("parents"), F.monotonically_increasing_id().alias("n")), "goals")
    # Dealt by target, so that both sums are made where the rows are.
    below = union_all(_expand(derived, goals, cut)).repartition("n").groupBy("n", "fact").agg(F.max("depth").alias("depth"))
    sizes = below.groupBy("n").agg(F.count("*").alias("facts"), F.max("depth").alias("depth"))
    return goals.join(sizes, "n", "left").select(*key, (F.coalesce("facts", F.lit(0)) + 1).alias("facts"), F.coalesce("depth", F.lit(0)).alias("depth"))


def closure_bundles(facts: DataFrame, rules: Sequence[Rule], proof_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All independent proofs: (bundles(ctx, s, p, o, rule, premises, bundle_id), complete(ctx, complete)).

    facts(ctx, s, p, o, fid).  A bundle is the set of asserted fact ids a proof rests on; combining parents unites
    their sets.  With ``proof_limit`` at most so many bundles per fact are kept; any cut marks its context incomplete.
    """
    from pyspark.sql import Window

    key = ["ctx", "s", "p", "o"]
    bid = F.sha2(F.concat_ws("\x1f", *key, "rule", F.array_join("premises", "\x1e")), 256)
    rules = [r.check() for r in rules]
    if proof_limit is None:
        return _all_bundles(facts, rules).withColumn("bundle_id", bid), facts.select("ctx").distinct().withColumn("complete", F.lit(True))
    base = facts.select(*key, F.lit("asserted").alias("rule"), F.array("fid").alias("premises")).withColumn("bundle_id", bid)
    bundles = delta = materialize(base.dropDuplicates(["bundle_id"]), "bundles")
    cut = None
    while True:
        made = []
        for rule in rules:
            for i in range(len(rule.body)):
                made.append(_bundle_join(rule, [delta if k == i else bundles for k in range(len(rule.body))]))
        new = union_all(made).withColumn("bundle_id", bid).dropDuplicates(["bundle_id"]).join(bundles.select("bundle_id"), "bundle_id", "left_anti")
        # A proof of an asserted fact from that very fact adds nothing.
        both = bundles.withColumn("_new", F.lit(0)).unionByName(new.select(*bundles.columns).withColumn("_new", F.lit(1)))
        w = Window.partitionBy(*key).orderBy("_new", F.size("premises"), "bundle_id")
        ranked = materialize(both.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= proof_limit + 1), "bundles")
        over = ranked.filter(F.col("_rn") > proof_limit).select("ctx").distinct()
        cut = over if cut is None else cut.unionByName(over)
        delta = ranked.filter((F.col("_new") == 1) & (F.col("_rn") <= proof_limit)).select(*bundles.columns)
        bundles = ranked.filter(F.col("_rn") <= proof_limit).select(*bundles.columns)
        if delta.isEmpty():
            break
    complete = facts.select("ctx").distinct().join(cut.distinct().withColumn("cut", F.lit(True)), "ctx", "left").select("ctx", F.col("cut").isNull().alias("complete"))
    return bundles, complete


def _all_bundles(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every bundle (ctx, s, p, o, rule, premises), semi-naive: a round writes only what is new, and joins only atoms that a
    head of the round before may match, so rules that do not feed each other need one round."""
    same = ["ctx", "s", "p", "o", "rule", "premises"]
    bid = F.sha2(F.concat_ws("\x1f", "ctx", "s", "p", "o", "rule", F.array_join("premises", "\x1e")), 256)
    base = facts.select("ctx", "s", "p", "o", F.lit("asserted").alias("rule"), F.array("fid").alias("premises"))
    delta = materialize(base.distinct(), "bundles")
    parts, older, heads = [delta], [], None
    while True:
        known, made, fired = union_all(parts), [], []
        old = union_all(older) if older else None
        for rule in rules:
            for i, atom in enumerate(rule.body):
                # Atoms before the delta see only older bundles, so a pair of deltas is joined once.
                if (i > 0 and old is None) or (heads is not None and not any(_may_match(atom, head) for head in heads)):
                    continue
                made.append(_bundle_join(rule, [delta if k == i else (old if k < i else known) for k in range(len(rule.body))]))
                fired.append(rule)
        if not made:
            return known
        new = union_all(made).select(*same).distinct()
        # Only a bundle of the same rule can be the same one; asserted ones come first and have a name of their own.
        before = parts if any(r.rule_id == "asserted" for r in fired) else parts[1:]
        if before:
            seen = union_all(before).filter(F.col("rule").isin(sorted({r.rule_id for r in fired})))
            new = new.withColumn("_b", bid).join(seen.select(bid.alias("_b")), "_b", "left_anti").drop("_b")
        delta = materialize(new, "bundles")
        if delta.isEmpty():
            return known
        older, heads = list(parts), [r.head for r in fired]
        parts.append(delta)
        if len(parts) >= COMPACT:
            older = [parts[0], materialize(union_all(parts[1:-1]), "bundles")]
            parts = [*older, delta]


def _may_match(atom: Triple, head: Triple) -> bool:
    return all(a.startswith("?") or h.startswith("?") or a == h for a, h in zip(atom, head, strict=True))


def _bundle_join(rule: Rule, sources: Sequence[DataFrame]) -> DataFrame:
    rows, bound = None, set()
    for k, (atom, src) in enumerate(zip(rule.body, sources, strict=True)):
        view = _bundle_atom(src, atom, k)
        names = {t for t in atom if t.startswith("?")}
        rows = view if rows is None else rows.join(view, ["ctx", *sorted(bound & names)])
        bound |= names
    union = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"_p{k}") for k in range(len(rule.body))]))))
    return _head(rows, rule.head, F.lit(rule.rule_id).alias("rule"), union.alias("premises"))


def _bundle_atom(src: DataFrame, atom: Triple, n: int) -> DataFrame:
    df, cols = src, {}
    for col, term in zip("spo", atom):
        if not term.startswith("?"):
            df = df.filter(F.col(col) == term)
        elif term in cols:
            df = df.filter(F.col(col) == F.col(cols[term]))
        else:
            cols[term] = col
    return df.select("ctx", *[F.col(c).alias(v) for v, c in cols.items()], F.col("premises").alias(f"_p{n}"))


def retract(bundles: DataFrame, gone: DataFrame) -> DataFrame:
    """Facts that keep at least one proof none of whose premises was retracted, with their remaining proofs."""
    key = ["ctx", "s", "p", "o"]
    # Written, so that a bundle's number is the same wherever it is read; a number is all that the joins carry.
    rows = materialize(bundles.select(*key, "premises").withColumn("_b", F.monotonically_increasing_id()), "retract")
    hit = rows.select("_b", F.explode("premises").alias("fid")).join(gone.select("fid"), "fid", "left_semi").select("_b").distinct()
    return rows.drop("premises").join(hit, "_b", "left_anti").groupBy(*key).agg(F.count("*").alias("bundles"))


def induce_rule(examples: DataFrame) -> DataFrame:
    """One row per rule shape (shape): pattern items in order, or a reason for rejection.

    examples(shape, example, pos, idx, value): pos 0.. are the body atoms in order and -1 the head, idx 0..2 the slot.
    Slots with one value everywhere stay constants; slots with the same value in every example share a variable.
    """
    sizes = examples.groupBy("shape").agg(F.count_distinct("example").alias("examples"))
    # The signature of a slot is its value per example; it is hashed, so its size does not grow with the examples.
    sig = examples.groupBy("shape", "pos", "idx").agg(
        F.count("*").alias("seen"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.sum(F.xxhash64("example", "value").cast("decimal(38,0)")).alias("sig"))
    from pyspark.sql import Window

    slots = sig.join(sizes, "shape").withColumn("aligned", F.col("seen") == F.col("examples")).withColumn("const", F.col("lo") == F.col("hi"))
    w = Window.partitionBy("shape").orderBy("first_at")
    firsts = slots.filter("NOT const").groupBy("shape", "sig").agg(F.min(F.struct(F.when(F.col("pos") < 0, 1000).otherwise(F.col("pos")).alias("q"), "idx")).alias("first_at"))
    named = firsts.withColumn("var", F.concat(F.lit("?v"), F.row_number().over(w).cast("string"))).drop("first_at")
    items = slots.join(named, ["shape", "sig"], "left").withColumn("item", F.when(F.col("const"), F.col("lo")).otherwise(F.col("var")))
    body_vars = items.filter("pos >= 0 AND NOT const").select("shape", "var").distinct().withColumn("bound", F.lit(True))
    flagged = items.join(body_vars, ["shape", "var"], "left")
    packed = flagged.groupBy("shape").agg(
        F.array_sort(F.collect_list(F.struct("pos", "idx", "item"))).alias("items"),  # three slots per atom of a rule
        F.bool_and("aligned").alias("aligned"), F.bool_or(~F.col("const")).alias("general"),
        F.bool_or((F.col("pos") < 0) & ~F.col("const") & F.col("bound").isNull()).alias("unbound"), F.max("examples").alias("examples"))
    reason = (F.when(~F.col("aligned"), "unaligned").when(F.col("unbound"), "unbound").when(~F.col("general") | (F.col("examples") < 2), "no_generalisation"))
    return packed.select("shape", "examples", F.array_join(F.transform("items", lambda x: F.concat(F.when(x["pos"] < 0, "=> ").otherwise(""), x["item"])), " ").alias("rule"), reason.alias("reason"))


def gate_rule(base: Sequence[Rule], candidate: Rule, facts: DataFrame, cases: DataFrame) -> DataFrame:
    """One row (fixed, broken, wrong_corrections, accepted) for a candidate rule.

    facts carry the case in ``ctx``; cases(ctx, s, p, o, expected, is_correction).  Both closures run over all cases at
    once.  Accepted: all corrections entailed, nothing broken, something fixed, all validation cases right.
    """
    key = ["ctx", "s", "p", "o"]

    def outcome(rules: Sequence[Rule], name: str) -> DataFrame:
        held = closure(facts, rules).select(*key).withColumn("held", F.lit(True))
        return cases.join(held, key, "left").select(*key, "is_correction", (F.coalesce("held", F.lit(False)) == F.col("expected")).alias(name))

    before = outcome(base, "was").select(*key, "was") if base else cases.select(*key, (~F.col("expected")).alias("was"))
    rows = outcome([*base, candidate], "now").join(before, key)
    agg = rows.agg(
        F.count_if(~F.col("was") & F.col("now")).alias("fixed"), F.count_if(F.col("was") & ~F.col("now")).alias("broken"),
        F.count_if(F.col("is_correction") & ~F.col("now")).alias("wrong_corrections"), F.count_if(~F.col("is_correction") & ~F.col("now")).alias("wrong_validation"))
    ok = (F.col("fixed") > 0) & (F.col("broken") == 0) & (F.col("wrong_corrections") == 0) & (F.col("wrong_validation") == 0)
    return agg.withColumn("accepted", ok)


def order_comparison(facts: DataFrame, denied: DataFrame, asks: DataFrame) -> DataFrame:
    """asks(a, b): true / false if a strict order derives exactly one direction and does not deny it, else null."""
    from .graph import reaches

    both = asks.select("a", "b").unionByName(asks.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = reaches(facts.select(F.col("hi").alias("src"), F.col("lo").alias("dst")), both)
    over = up.withColumn("over", F.lit(True))
    under = up.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("under"))
    no = denied.select(F.col("hi").alias("a"), F.col("lo").alias("b"), F.lit(True).alias("denied"))
    j = asks.join(over, ["a", "b"], "left").join(under, ["a", "b"], "left").join(no, ["a", "b"], "left")
    o, u = F.col("over").isNotNull(), F.col("under").isNotNull()
    return j.select("a", "b", F.when(F.col("denied") | (o == u), None).otherwise(o).alias("taller"))


def entity_leakage(train: DataFrame, validation: DataFrame) -> DataFrame:
    """(shared, valid): any entity on both sides invalidates the split."""
    shared = train.select("entity").distinct().join(validation.select("entity").distinct(), "entity", "left_semi")
    return shared.agg(F.count("*").alias("shared")).withColumn("valid", F.col("shared") == 0)
