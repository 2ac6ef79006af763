"""Event rules, held scores, interval, containment and name joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from foliolens.operators import events, intervals, overlap, rules, turns

# --- event rules -------------------------------------------------------------------------------------------

RULES = "rule_id string, priority string, repeat string, enabled boolean, new_arc boolean"


def plain_events(flags, rule_rows, triggers, blockers, effects, follow_ups, most):
    order = {p: i for i, p in enumerate(events.PRIORITIES)}
    out = []
    for entity in sorted({e for e, _ in flags}):
        held = {f for e, f in flags if e == entity}
        need = {r[0]: {f for i, f in triggers if i == r[0]} for r in rule_rows}
        stop = {r[0]: {f for i, f in blockers if i == r[0]} for r in rule_rows}
        enabled, used, arc = {r[0]: r[3] for r in rule_rows}, {}, 0
        fresh = {r[0] for r in rule_rows}
        for nth in range(1, most + 2):
            could = []
            for i, priority, repeat, _, new_arc in rule_rows:
                again = i not in used if repeat == "once" else used.get(i, -1) < arc if repeat == "once-per-arc" else i in fresh
                if need[i] and enabled[i] and need[i] <= held and not stop[i] & held and again:
                    could.append((order.get(priority, 9), i, new_arc))
            if not could:
                break
            assert nth <= most, "goes on"
            _, i, new_arc = min(could)
            out.append((entity, nth, i))
            arc += new_arc
            used[i] = arc
            fresh.discard(i)
            sets = {}
            for r, f, on in effects:
                if r == i:
                    sets[f] = sets.get(f, False) or on
            changed = {f for f, on in sets.items() if on != (f in held)}
            held ^= changed
            fresh |= {r for r in need if (need[r] | stop[r]) & changed}
            turned = {}
            for r, o, on in follow_ups:
                if r == i:
                    turned[o] = turned.get(o, False) or on
            for o, on in turned.items():
                enabled[o] = on
                if on:
                    fresh.add(o)
    return sorted(out)


def spark_events(spark, flags, rule_rows, triggers, blockers, effects, follow_ups, most):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = events.fired(
        t(flags, "entity long, flag string"), t(rule_rows, RULES), t(triggers, "rule_id string, flag string"), t(blockers, "rule_id string, flag string"),
        t(effects, "rule_id string, flag string, sets boolean"), t(follow_ups, "rule_id string, other_id string, enables boolean"), most,
    )
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed", range(6))
def test_events_against_a_loop(spark, seed):
    r = random.Random(seed)
    names, given = [f"r{i}" for i in range(8)], [f"f{i}" for i in range(7)]
    rule_rows = [(n, r.choice([*events.PRIORITIES, "other"]), r.choice(["once", "once", "once-per-arc", "repeatable"]), r.random() < 0.8, r.random() < 0.2) for n in names]
    pick = lambda n: [(r.choice(names), r.choice(given)) for _ in range(n)]
    triggers, blockers = pick(14), pick(4)
    triggers += triggers[:2]
    effects, follow_ups = [(*x, r.random() < 0.6) for x in pick(14)], [(r.choice(names), r.choice(names), r.random() < 0.6) for _ in range(5)]
    flags = [(e, f) for e in range(12) for f in given if r.random() < 0.5]
    try:
        want = plain_events(flags, rule_rows, triggers, blockers, effects, follow_ups, 12)
    except AssertionError:
        with pytest.raises(RuntimeError):
            spark_events(spark, flags, rule_rows, triggers, blockers, effects, follow_ups, 12)
        return
    assert spark_events(spark, flags, rule_rows, triggers, blockers, effects, follow_ups, 12) == want and want


def test_events_that_block_themselves_go_round_or_never_begin(spark):
    rule = lambda i, repeat="repeatable": (i, "normal", repeat, True, False)
    own = spark_events(spark, [(1, "a")], [rule("x")], [("x", "a")], [("x", "done")], [("x", "done", True)], [], 5)
    assert own == [(1, 1, "x")]
    flip = ([rule("on"), rule("off")], [("on", "a"), ("off", "b")], [], [("on", "a", False), ("on", "b", True), ("off", "b", False), ("off", "a", True)])
    with pytest.raises(RuntimeError, match="go on"):
        spark_events(spark, [(1, "a")], *flip, [], 6)
    assert spark_events(spark, [(1, "z")], [rule("x"), rule("empty", "once")], [("x", "a")], [], [], [], 3) == []
    assert spark_events(spark, [], [rule("x")], [("x", "a")], [], [], [], 3) == []


def test_events_on_the_table(spark, sf):
    from foliolens.plans import catalog

    flags = sorted({(r.user_id, r.event_type) for r in spark.read.parquet(f"{sf}/events.parquet").collect()})
    got = sorted(map(tuple, catalog.QUERIES["story_events"](spark, sf).collect()))
    assert got == plain_events(flags, *catalog.EVENT_RULES, 100) and got


# --- held scores -------------------------------------------------------------------------------------------


def plain_scores(rows, least, most):
    score, seen, out = {}, set(), []
    for k, scene, at, by in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2])):
        by = 0 if (k, scene) in seen or by is None else by
        seen.add((k, scene))
        score[k] = min(most, max(least, score.get(k, 0) + by))
        out.append((at, score[k]))
    return sorted(out)


@pytest.mark.parametrize("parts,batch", [(1, 10_000), (7, 10_000), (5, 3)])
def test_held_scores_over_many_partitions(spark, parts, batch):
    r = random.Random(parts)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), f"s{r.randrange(300)}", i, r.choice([None, -4, -1, 2, 5])) for i in range(700)]
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = turns.capped_steps(spark.createDataFrame(rows, "k string, scene string, at int, by int"), "k", "scene", "at", "by", -5, 10)
        assert sorted((x["at"], x.score) for x in df.collect()) == plain_scores(rows, -5, 10)
        none = turns.capped_steps(spark.createDataFrame([], "k string, scene string, at int, by int"), "k", "scene", "at", "by", -5, 10)
        assert none.count() == 0
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


# --- intervals ---------------------------------------------------------------------------------------------


def test_interval_join_against_all_ranges(spark):
    r = random.Random(1)
    ranges = [(i, lo := r.randrange(-500, 500), lo + r.choice([0, 1, 7, 100, 3000, -1]), f"k{i}") for i in range(60)] + [(99, -(2**62), 2**62, "all"), (98, None, 4, "x"), (3, 5, 5, "k3")]
    values = [(i, r.choice([None, r.randrange(-700, 4000)])) for i in range(400)] + [(1000, 2**40), (1001, -(2**40))]
    t = spark.createDataFrame(ranges, "nth int, lo long, hi long, kind string")
    for used in (ranges, ranges[:20]):
        got = intervals.located(spark.createDataFrame(values, "id int, v long"), "v", t.limit(0).unionByName(spark.createDataFrame(used, t.schema)), "lo", "hi", "nth", "kind", "kind")
        want = {i: min(((n, k) for n, lo, hi, k in used if lo is not None and v is not None and lo <= v <= hi), default=(0, None))[1] for i, v in values}
        assert {x.id: x.kind for x in got.collect()} == want
    assert {x.kind for x in intervals.located(spark.createDataFrame(values, "id int, v long"), "v", t.limit(0), "lo", "hi", "nth", "kind", "kind").collect()} == {None}


def test_many_ranges_meet_by_equality(spark):
    ranges = spark.range(10_000).select(F.col("id").alias("nth"), (F.col("id") * 50).alias("lo"), (F.col("id") * 50 + 70).alias("hi"), F.col("id").alias("kind"))
    rows = intervals.located(spark.range(100_000).withColumn("v", F.col("id") * 5), "v", ranges, "lo", "hi", "nth", "kind", "kind")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wrong = rows.filter(~F.col("kind").eqNullSafe(F.greatest(F.floor((F.col("v") - 21) / 50), F.lit(0)))).filter("v < 500000")
    assert wrong.count() == 0


# --- containment -------------------------------------------------------------------------------------------


def plain_shingles(text, k):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


@pytest.mark.parametrize("percent", [50, 80])
def test_containment_against_all_pairs(spark, percent):
    r = random.Random(percent)
    base = [[f"w{r.randrange(40)}" for _ in range(60)] for _ in range(6)]

    def body():
        at = r.randrange(30)
        return " ".join(w if r.random() < 0.97 else "odd" for w in r.choice(base)[at : at + r.randrange(3, 30)])

    bodies = [(i, body()) for i in range(80)] + [(100, None), (101, " "), (102, "two words"), (103, "Two  WORDS"), (104, "w1")] + [(200 + i, " ".join(base[0][:20])) for i in range(5)]
    prompts = [(i, " ".join(sum((r.choice(base) for _ in range(r.randrange(1, 4))), []))) for i in range(15)] + [(50, "two words"), (51, None), (52, " ".join(base[0])), (53, " ".join(base[0]))]
    pairs, rows = overlap.contained(spark.createDataFrame(bodies, "b int, text string"), spark.createDataFrame(prompts, "p int, text string"), "b", "p", percent=percent)
    a, b = ({k: plain_shingles(t, 5) for k, t in x} for x in (bodies, prompts))
    one = lambda sets: {k: min(j for j, t in sets.items() if t == s) for k, s in sets.items()}
    ca, cb = one(a), one(b)
    want = {(x, y, len(a[x] & b[y]), len(a[x])) for x in set(ca.values()) for y in set(cb.values()) if a[x] and 100 * len(a[x] & b[y]) >= percent * len(a[x])}
    assert {tuple(x) for x in pairs.collect()} == want and want
    assert {tuple(x) for x in rows.collect()} == {(k, ca[k], len(s), sum(x == ca[k] for x, *_ in want)) for k, s in a.items()}


# --- names -------------------------------------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_confusable_names_against_all_pairs(spark):
    import unicodedata

    r = random.Random(2)
    names = ["anna", "hanna", "Anna", "한지우", "한지유", "안지우", "김", "갇", "a", "", None, "anna"] + ["".join(r.choice("abc") for _ in range(r.randrange(2, 7))) for _ in range(60)]
    split = {n: unicodedata.normalize("NFD", n) for n in names if n}
    for edits in (1, 2):
        got = {tuple(x) for x in rules.confusable(spark.createDataFrame([(n,) for n in names], "n string"), "n", edits).collect()}
        assert got == {(a, b) for a in split for b in split if a < b and plain_distance(split[a], split[b]) <= edits}
    assert ("anna", "hanna") in got


# --- titles --------------------------------------------------------------------------------------------------


def test_titles_are_made_unique_as_by_a_loop(spark):
    from foliolens.operators import audits, segments
    from foliolens.sources import corpus

    r = random.Random(3)
    rows = [(g, i, r.choice(["a", "b", "a (2)", "a (3)", "a (2) (2)", "b (2)", "c", None] if g % 2 else ["a", "b", "c"])) for g in range(12) for i in range(r.randrange(1, 14))]
    want = {}
    for g, i, t in rows:
        taken, key, n = want.setdefault(g, {}), t, 2
        while t is not None and key in taken:
            key, n = f"{t} ({n})", n + 1
        taken[key if t is not None else (i,)] = (i, key)
    got = segments.number_repeats(spark.createDataFrame(rows, "g int, pos int, title string").repartition(5), ["g"], "title", "pos")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((g, *x) for g, t in want.items() for x in t.values()), key=str)
    docs = spark.createDataFrame([("f", "# a\nx\n# a (2)\ny\n# a\nz\n")], "name string, text string")
    found = segments.sections(docs)
    assert sorted(x.title for x in found.collect()) == ["a", "a (2)", "a (3)"]
    same = audits.snapshot_counts(audits.snapshot_diff(corpus.stamp(corpus.stamps(found)), found, ["file", "title"]), "file").collect()
    assert [tuple(x) for x in same] == [("f", 0, 0, 0, 3)]


# --- runs to promote -------------------------------------------------------------------------------------------


def plain_places(texts, least, most_words):
    words, out = [(t or "").split() for t in texts], []
    for n in range(2, most_words + 1):
        rows = [(d, p, n, " ".join(w[p : p + n])) for d, w in enumerate(words) for p in range(len(w) - n + 1)]
        count = {}
        for r in rows:
            count[r[3]] = count.get(r[3], 0) + 1
        out += [r for r in rows if count[r[3]] >= least]
    return out


def plain_counts(places, symbol, least):
    uses, last = {}, {}
    for d, p, n, run in sorted(places):
        before = last.get((d, run))
        last[d, run] = p
        if before is None or before + n <= p:
            uses.setdefault((run, n), []).append((d, p))
    rows = [(run, n, len(at), len(at) * (len(run) - symbol) - (len(run) + symbol + 2)) for (run, n), at in uses.items()]
    return {r for r in rows if r[2] >= least and r[3] > 0}, uses


def plain_promoted(texts, symbol, least, most_words, most):
    places, out = plain_places(texts, least, most_words), []
    while len(out) < most:
        rows, uses = plain_counts(places, symbol, least)
        if not rows:
            break
        best = min(rows, key=lambda r: (-r[3], r[0]))
        out.append((len(out) + 1, *best))
        taken = {(d, p + i) for d, p in uses[best[:2]] for i in range(best[1])}
        places = [x for x in places if not any((x[0], x[1] + i) in taken for i in range(x[2]))]
    return out


def test_runs_to_promote_against_plain_counts(spark):
    from foliolens.operators import promotion

    r = random.Random(8)
    phrases = [" ".join(r.choice("abcdefgh") * r.randrange(1, 5) for _ in range(r.randrange(2, 7))) for _ in range(6)]
    texts = ["  ".join(r.choice([*phrases, "x", f"own{r.randrange(99)}"]) for _ in range(r.randrange(12))) for _ in range(40)] + [None, "", "la la la la la la la la la"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = {tuple(x) for x in promotion.run_savings(docs, symbol=2).collect()}
    assert rows == plain_counts(plain_places(texts, 4, 6), 2, 4)[0] and rows
    got = [tuple(x) for x in promotion.promoted(docs, symbol=2, most=5).orderBy("nth").collect()]
    assert got == plain_promoted(texts, 2, 4, 6, 5) and len(got) > 2
    assert promotion.promoted(docs.limit(0)).count() == 0


def test_promoted_runs_of_the_table(spark, sf):
    from foliolens.plans import catalog

    texts = [x.text for x in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert [tuple(x) for x in catalog.QUERIES["promoted_runs"](spark, sf).orderBy("nth").collect()] == plain_promoted(texts, 1, 4, 6, 8)
