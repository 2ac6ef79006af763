"""Operators whose syntax the tables lack, on small texts; each audit with a case that must be found."""

import random

import pytest
from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import audits, rules, segments, slots, turns
from foliolens.operators.contains import contained_nowhere, contains_join
from foliolens.sources import corpus
from foliolens.streaming import turns as stream

BOOK = """# Book
- entries: 2
# `kb.one` first
- activation_setting: always
- activation_when: [x]
- keywords: [Apple, "b c", `d`]
## Entry text
 body <!-- note -->one　
## Other
no
# kb.two
- activation_setting: a
- activation_when: b
- keywords: [apple,apple,1,2,3,4]
## 입력 본문
"""
STORY = "intro\n# `One`\na\n## Two\n\nb\n### Two\nc\n#### deep\nd\n# **Empty**\n\n# Last\n"


def one(spark, column, text, **more):
    names = {"text": text, **more}
    return spark.createDataFrame([tuple(names.values())], ", ".join(f"{k} string" for k in names)).select(column.alias("x")).first().x


def test_lengths_keys_and_trims(spark):
    t = F.col("text")
    text = "a😐b☀️"
    assert one(spark, F.array(T.code_points(t), T.utf16_units(t), T.measured(t)), text) == [5, 6, 6]
    assert one(spark, T.match_key(t), " A　b C\x1c\n") == "abc" and one(spark, T.trimmed(t), "　 a b\x1c\n") == "a b"
    assert one(spark, T.size_label(F.array(F.lit(3), F.lit(4))), "") == "3×4" and one(spark, T.size_label(F.array(F.lit(3))), "") == "—"
    assert one(spark, F.array(T.display_label(F.lit(""), t), T.display_label(F.lit("k"), t)), "slug") == ["slug", "k"]
    assert one(spark, T.line_of(t, F.lit(5)), "a\nb\nc") == 3 and one(spark, T.fingerprint(t), "\n") == "01ba4719c80b6fe9"


def test_titles_ids_and_roster(spark):
    t = F.col("text")
    text = "# SAFE x\n## Two \n#### four\n### two\n## `char.ab-c` Ann\nsee CHAR.ab and kb.x-1."
    assert one(spark, T.headings(t), text) == ["two", "`char.ab-c` ann"]
    assert one(spark, T.stable_ids(t), text) == ["char.ab-c", "char.ab", "kb.x-1"] and one(spark, T.roster(t), text) == ["ab-c"]


def test_entries(spark):
    rows = audits.entry_flags(segments.entry_blocks(spark.createDataFrame([("p", BOOK)], "project string, text string"), ["project"])).orderBy("rank").collect()
    assert [(r.entry_id, r["rank"], r.body) for r in rows] == [("kb.one", 0, "body one"), ("kb.two", 1, "")]
    assert rows[0].keywords == ["Apple", "b c", "d"] and rows[0].when_missing and not rows[0].keyword_count_bad and not rows[0].keyword_repeated
    assert rows[1].keyword_count_bad and rows[1].keyword_repeated and not rows[1].setting_missing
    assert one(spark, audits.empty_registry(F.col("text")), "# x\n- entries: [] \n") and not one(spark, audits.empty_registry(F.col("text")), BOOK)


def test_collisions(spark):
    entries = spark.createDataFrame([("a", 0, ["X y", "z"]), ("b", 1, ["xY"]), ("a", 2, ["xy"])], "entry_id string, rank int, keywords array<string>")
    assert [(r.k, r.owners) for r in audits.collisions(entries).collect()] == [("xy", ["a", "b"])]
    assert sorted((r.entry_id, r.previous) for r in audits.previous_owner(entries).collect()) == [("a", "b"), ("b", "a")]
    assert audits.repeated(entries, "entry_id").collect()[0].n == 2


def test_sections_and_diff(spark):
    made = lambda t: segments.sections(spark.createDataFrame([("s", t)], "name string, text string"))
    assert [r.title for r in made(STORY).orderBy("pos").collect()] == ["One", "Two", "Two (2)", "Empty", "Last"]
    assert made("no heading").first().title == segments.WHOLE
    assert made(STORY).filter("title = 'Empty'").first().digest == "01ba4719c80b6fe9"
    diff = audits.snapshot_diff(made(STORY), made(STORY.replace("\nd", "\ne").replace("# **Empty**", "# New")), ["file", "title"])
    assert {r.title: r.status for r in diff.collect()} == {"One": "same", "Two": "same", "Two (2)": "changed", "Empty": "removed", "New": "added", "Last": "same"}
    assert one(spark, audits.route(F.col("text"), [("kb", "book"), ("k", "late")], "none"), "KB x") == "book"


@pytest.mark.parametrize("limit", [0, 100])
def test_contains_join_both_ways(spark, limit):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["", "abc", "a long text here", "long", "가나다 라"])], "i int, t string")
    phrases = spark.createDataFrame([(i, p) for i, p in enumerate(["", "a", "long text here", "나다", "zzz", "abc"])], "j int, p string")
    assert sorted((r.i, r.j) for r in contains_join(texts, phrases, "t", "p", limit).collect()) == [(1, 1), (1, 5), (2, 1), (2, 2), (4, 3)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_contains_join_against_brute_force(spark, limit):
    r = random.Random(4)
    word = lambda: "".join(r.choice("ab가🦊") for _ in range(r.randrange(1, 4)))
    texts = [None, "", "  ", *(r.choice([" ", "  ", "\n"]).join(word() for _ in range(r.randrange(30))) for _ in range(80))]
    phrases = [None, "", " ", "a b", *(" ".join(word() for _ in range(r.randrange(1, 6))) for _ in range(60)), *(t[2:14] for t in texts[3:40]), *(t[1:7] for t in texts[3:20])]
    left = spark.createDataFrame(list(enumerate(texts)) + [(0, "a b a b")], "i int, t string")
    right = spark.createDataFrame(list(enumerate(phrases)) + [(3, "a b")], "j int, p string")
    want = sorted((i, j) for i, t in [*enumerate(texts), (0, "a b a b")] for j, p in [*enumerate(phrases), (3, "a b")] if t is not None and p and p in t)
    assert sorted((x.i, x.j) for x in contains_join(left, right, "t", "p", limit).collect()) == want and want
    gone = sorted(x.j for x in contained_nowhere(right, left, "p", "t").collect())
    assert gone == sorted(j for j, p in [*enumerate(phrases), (3, "a b")] if p and not any(p in t for t in [*texts, "a b a b"] if t))
    with pytest.raises(ValueError, match="both"):
        contains_join(left, left, "t", "t")


def test_slots(spark):
    entries = spark.createDataFrame([(f"k{i}", i, [w]) for i, w in enumerate(["aa", "bb", "cc", "dd", "never"])], "entry_id string, rank int, keywords array<string>")
    scenes = spark.createDataFrame([("s1", "AA bb cc d d"), ("s2", "a a"), ("s3", "none")], "label string, text string")
    allocated = slots.allocate(slots.hits(scenes, entries))
    load = {r.label: r for r in slots.scene_load(scenes, allocated).collect()}
    assert (load["s1"].loaded, load["s1"].dropped, load["s1"].grade) == ("k0,k1,k2", "k3", "WARN") and (load["s3"].hits, load["s3"].grade) == (0, "PASS")
    rates = slots.load_rates(entries, allocated, 3)
    assert {r.entry_id: r["class"] for r in rates.collect()} == {"k0": "ok", "k1": "ok", "k2": "ok", "k3": "all dropped", "k4": "untested"}
    assert [(r.entry_id, r.verdict) for r in slots.always_on(rates, 5, 0.6).collect()] == [("k0", "FAIL")]


def test_symbols(spark):
    text = "ⓝ⇒🦊 and → = to `←x` 날씨=☀☁ 중\n😐중립 🙂호의 😄친밀 ★"
    docs = spark.createDataFrame([(1, text, "· ★")], "doc_id int, text string, legend string")
    assert {r.symbol: r.kind for r in audits.undefined_symbols(docs, ["doc_id"]).collect()} == {"ⓝ": "operator", "⇒": "operator", "🦊": "emoji"}
    assert {r.symbol: r.n for r in audits.symbol_use(docs, ["doc_id"]).collect()}["→"] == 1
    assert one(spark, audits.legend_of(F.col("text"), "## 기호"), "# a\n## 기호\n→ x\n### y\n## b\n").strip() == "→ x\n### y"


def test_assets(spark, tmp_path):
    config = '{"characters": {"ann": {"ko": "안", "seed": 1}, "bob": {"tags": "A, b ,c,d,e"}}, "situations": {"calm": {"size": [1, 2]}}, "scenes": {"hq": {}}}'
    axes = corpus.axes(spark.createDataFrame([(config,)], "text string"))
    paths = audits.asset_paths(axes)
    assert sorted(r.rel_path for r in paths.collect()) == ["ann/calm.png", "bob/calm.png", "scene/hq.png"]
    (tmp_path / "ann").mkdir()
    for name in ("ann/calm.png", "ann/odd.PNG", ".hidden.png", "note.txt"):
        (tmp_path / name).write_bytes(b"x" * 10)
    found = corpus.read_files(spark, str(tmp_path), ".png")
    assert {r.rel_path: r.bytes for r in found.collect()} == {"ann/calm.png": 10, "ann/odd.PNG": 10}
    assert {r.axis: (r.have, r.total) for r in audits.coverage(paths, found, "rel_path", "axis").collect()} == {"characters": (1, 2), "scenes": (0, 1)}
    assert {r.rel_path: r.status for r in audits.against_expected(found.select("rel_path"), paths.select("rel_path"), "rel_path").collect()}["ann/odd.PNG"] == "unknown"
    assert one(spark, T.leading_tags(F.col("text")), "A, b ,c,,d,e") == "a, b, c, d"
    assert audits.first_of(paths, "rel_path", 2).first().more == 1


def test_sources(spark, tmp_path):
    (tmp_path / "scenes.txt").write_text("# note\n\na: x: y\nlabel only\nb:  \n")
    assert [tuple(r) for r in corpus.read_scenes(spark, str(tmp_path / "scenes.txt")).collect()] == [("a", "x: y"), ("label only", "label only"), ("b", "b")]
    (tmp_path / "t.md").write_bytes(b"a\r\nb\rc")
    assert corpus.read_texts(spark, str(tmp_path / "t.md")).first().text == "a\nb\nc"
    stamp = corpus.stamp(spark.createDataFrame([('{"f": {"t": "d"}}',)], "text string"))
    assert [tuple(r) for r in stamp.collect()] == [("f", "t", "d")]
    corpus.write_snapshot(stamp, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 1
    many = spark.createDataFrame([("f", "t", "d"), ("f", "u", "e"), ("g", 'q"1', "d")], "file string, title string, digest string")
    corpus.write_stamp(many, str(tmp_path / "stamp"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(corpus.read_stamp(spark, str(tmp_path / "stamp"))) == rows(many) and corpus.read_stamp(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "one.json").write_text('{\n "f": {\n  "t": "d",\n  "u": "e"\n },\n "g": {"q": "d"}\n}\n')
    assert rows(corpus.read_stamp(spark, str(tmp_path / "one.json"))) == [("f", "t", "d"), ("f", "u", "e"), ("g", "q", "d")]
    listed = {r.name: (r.is_dir, r.bytes) for r in corpus.list_folder(spark, str(tmp_path)).filter("name in ('t.md', 'snap', '.x')").collect()}
    assert listed["t.md"] == (False, 6) and listed["snap"][0]
    assert corpus.first_source(spark, None, str(tmp_path / "none"), str(tmp_path / "t.md"), str(tmp_path)) == str(tmp_path / "t.md")
    assert [tuple(r) for r in corpus.inline_scenes(spark, [("a", "x"), ("b", None)]).collect()] == [("a", "x"), ("b", "")]
    parts = spark.createDataFrame([(1, "a🦊"), (1, "b"), (1, None), (2, None), (3, "")], "k int, text string")
    assert {r.k: r.measured for r in corpus.measure_parts(parts, "k").collect()} == {1: 5, 2: 0, 3: 0}


def test_findings_and_grades(spark):
    rows = spark.createDataFrame([("b", 7001), ("a", 7001), ("c", 6501), ("d", 6500)], "name string, n int")
    graded = rows.withColumn("g", audits.grade(F.col("n")))
    assert {r.name: r.g for r in graded.collect()} == {"a": "FAIL", "b": "FAIL", "c": "WARN", "d": "PASS"}
    out = {r.check: r for r in audits.verdicts([audits.finding(graded, "size", F.col("g"), "name"), audits.finding(graded, "info", "INFO", "name")]).collect()}
    assert (out["size"].ok, out["size"].fails, out["size"].warns, out["info"].ok, out["info"].infos) == (False, 2, 1, True, 4)
    both = [audits.finding(graded, "size", F.col("g"), "name"), audits.finding(graded, "info", "INFO", "name")]
    assert [tuple(r) for r in audits.overall(both).collect()] == [(False, 2, 2, 1, 4)]
    assert [tuple(r) for r in audits.offenders(both, 1).select("check", "subject", "more").collect()] == [("size", "a", 1)]
    assert audits.overall([audits.finding(graded.limit(0), "none", "FAIL", "name")]).first().ok
    with pytest.raises(ValueError):
        audits.grade(F.col("n"), 9, 5)


def test_streamed_turns_equal_the_batch(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"say word{(c + t) % 5}") for c in range(6) for t in range(6)]
    schema = "conv_id long, turn long, role string, text string"
    for part in range(3):  # three micro-batches, two turns each
        spark.createDataFrame([r for r in rows if r[1] // 2 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    entries = spark.createDataFrame([(i, i, [f"word{i}"]) for i in range(5)], "entry_id int, rank int, keywords array<string>")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    heard, match = stream.activated(source, entries)
    got = []
    query = heard.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, match(df).collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(got) == sorted(map(tuple, turns.activated(spark.createDataFrame(rows, schema), entries).collect())) and got


def test_held_score(spark):
    steps = {"a": [5, 5, 5, 5, -5, -5], "b": [-9, 1, None, 3], None: [2, 2]}
    rows = [(k, f"s{i}", i, x) for k, xs in steps.items() for i, x in enumerate(xs)] + [("a", "s0", 90, 7), ("c", "s", 1, 4), ("c", "s", 2, 4)]
    out = turns.capped_steps(spark.createDataFrame(rows, "k string, scene string, at int, by int"), "k", "scene", "at", "by", -5, 10).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["at"]):
        got.setdefault(r.k, []).append(r.score)
    assert got == {"a": [5, 10, 10, 10, 5, 0, 0], "b": [-5, -4, -4, -1], None: [2, 4], "c": [4, 4]}


def prompt(kind, more=""):
    return f"# {kind} profile\n## Rules\nBe kind. `char.ann`\n## Output\nshort{more}\n"


def entry(i, keywords, body="a body", setting="always"):
    return f"# `kb.{i}`\n- activation_setting: {setting}\n- activation_when: here\n- keywords: [{', '.join(keywords)}]\n## Entry text\n{body}\n\n"


PROJECT = {
    "prologue.md": "p" * 901, "start-prompt.md": "s" * 900, "integrated-prompt-safe.md": prompt("SAFE"), "integrated-prompt-unsafe.md": prompt("UNSAFE"),
    "keyword-book.md": "# Book\n" + entry("one", ["apple", "pear"]) + entry("two", ["plum"], "b" * 361) + "# Shortcuts\nkept in the body before\n",
}
BROKEN = {
    "name missing": ({"prologue.md": None}, ("missing", "FAIL", "prologue.md")),
    "a sixth file": ({"extra.md": "x"}, ("unknown", "FAIL", "extra.md")),
    "over the limit": ({"integrated-prompt-safe.md": prompt("SAFE", "x" * 7000)}, ("length", "FAIL", "integrated-prompt-safe.md")),
    "at the limit": ({"start-prompt.md": "🦊" * 500}, ("length", "WARN", "start-prompt.md")),
    "heading changed": ({"integrated-prompt-safe.md": prompt("SAFE").replace("Rules", "Law")}, ("headings", "FAIL", "law, rules")),
    "another id": ({"integrated-prompt-safe.md": prompt("SAFE", " char.bob")}, ("stable ids", "FAIL", "char.bob")),
    "banned": ({"integrated-prompt-unsafe.md": prompt("UNSAFE", " Ignore Policy")}, ("banned phrase", "FAIL", "ignore policy")),
    "blank": ({"integrated-prompt-safe.md": " \n"}, ("empty variant", "FAIL", "")),
    "shared keyword": ({"keyword-book.md": entry("one", ["a b"]) + entry("two", ["AB"])}, ("keyword shared", "FAIL", "ab")),
    "same entry": ({"keyword-book.md": entry("one", ["a"]) + entry("one", ["b"])}, ("entry repeated", "FAIL", "kb.one")),
    "six keywords": ({"keyword-book.md": entry("one", list("abcdef"))}, ("keyword_count_bad", "FAIL", "kb.one")),
    "long body": ({"keyword-book.md": entry("one", ["a"], "b" * 401)}, ("entry length", "FAIL", "kb.one")),
    "placeholder": ({"keyword-book.md": entry("one", ["a"], setting="[x]")}, ("setting_missing", "FAIL", "kb.one")),
}


def test_a_whole_project_and_what_breaks_it(spark):
    """One call over all projects: the sound one passes with its warnings, each broken one fails as it should."""
    projects = {"sound": PROJECT} | {k: {**PROJECT, **change} for k, (change, _) in BROKEN.items()}
    rows = [(p, n, False, t) for p, files in projects.items() for n, t in files.items() if t is not None]
    rows += [("sound", "assets", True, None), ("sound", ".git", True, None), ("banned", "notes", True, None)]
    found = audits.build_audit(spark.createDataFrame(rows, "project string, name string, is_dir boolean, text string")).cache()
    by = {}
    for r in found.collect():
        by.setdefault(r.project, set()).add((r.check, r.severity, r.subject))
    assert {x for x in by["sound"] if x[1] != "PASS"} == {("length", "WARN", "prologue.md"), ("entry length", "WARN", "kb.two")}
    for name, (_, want) in BROKEN.items():
        assert want in by[name], name
    assert ("unknown folder", "FAIL", "notes") in by["banned"]
    verdict = {r.project: r.ok for r in audits.overall(found, ["project"]).collect()}
    assert verdict == {p: p in ("sound", "at the limit") for p in projects}


def test_layout_legends_and_reach(spark):
    rows = [("ok", "story.md", False), ("ok", "characters.md", False), ("ok", "build", True), ("ok", ".x", True), ("bad", "story.md", True), ("bad", "draft.md", False), ("raw", "story.md", False), ("raw", "characters.md", False)]
    entries = spark.createDataFrame(rows, "project string, name string, is_dir boolean")
    got = {(r.project, r.check, r.subject) for r in audits.project_layout(entries).collect()}
    assert got == {("bad", "source missing", "story.md"), ("bad", "source missing", "characters.md"), ("bad", "unexpected", "draft.md"), ("bad", "build missing", "build"), ("raw", "build missing", "build")}
    assert {(r.project, r.check) for r in audits.project_layout(entries, True).collect()} == {("bad", "source missing"), ("bad", "unexpected")}
    legend = "→ then\n× never\n"
    docs = spark.createDataFrame([(1, f"# x\n{legend}a → b", legend), (2, f"a → b\n{legend}", legend), (3, "none", "")], "i int, text string, legend string")
    marked = audits.legend_symbols(docs, ["i"])
    assert {(r.i, r.symbol): r.status for r in marked.collect()} == {(1, "→"): "ok", (1, "×"): "unused", (2, "→"): "before", (2, "×"): "unused"}
    assert {r.i: (r.symbols, r.verdict) for r in audits.legend_counts(marked, ["i"]).collect()} == {1: (2, "WARN"), 2: (2, "FAIL")}
    axes = spark.createDataFrame([("characters", "ann"), ("characters", "bob"), ("situations", "calm"), ("scenes", "hq"), ("monsters", "orc")], "axis string, slug string")
    texts = spark.createDataFrame([("see ann",), ("at hq",)], "text string")
    assert {(r.slug, r.severity) for r in audits.unreachable(axes, texts).collect()} == {("bob", "INFO"), ("calm", "FAIL")}
    assert audits.unreachable(axes, texts.limit(0)).count() == 0 and tuple(audits.totals(axes).first()) == (2, 2, 2)
    files = spark.createDataFrame([("ann/calm.png", 22 << 20), ("bob/calm.PNG", 1), ("scene/hq.png", 3 << 20)], "rel_path string, bytes long")
    seen = {(r.check, r.severity, r.subject) for r in audits.inventory(audits.asset_paths(axes), files).collect()}
    assert seen == {("huge", "FAIL", "ann/calm.png"), ("unknown", "FAIL", "bob/calm.PNG"), ("heavy", "INFO", "scene/hq.png"), ("missing", "INFO", "bob/calm.png"), ("missing", "INFO", "mob/orc.png")}
    assert [r.check for r in audits.inventory(audits.asset_paths(axes), files.limit(0)).filter("severity = 'FAIL'").collect()] == ["none found"]


def test_text_forms(spark):
    t = F.col("text")
    assert one(spark, T.listed_keywords(t), "# kb\n- keywords: [a, 'b']  \n x]") == ["a", "b"] and one(spark, T.listed_keywords(t), "- keywords: a, b") == []
    text = "a\r\nb\x0bc\u2028d\n"
    assert one(spark, T.any_lines(t), text) == text.splitlines() and one(spark, T.percent(F.lit(0.256), 1, 7), "") == "   25.6%"
    assert one(spark, T.served_url(F.lit("a/b"), t, F.lit(""), F.lit(None)), "x.png").endswith("/a/b@main/x.png")


def test_rules(spark):
    books = spark.createDataFrame([(1, "# kb.x\n# Shortcut `sum`\n- name: a name of length\n- description: d\n\n## Shortcut prompt\ndo it\n# Shortcut `b`\n- name: b\n")], "i int, text string")
    got = {r.shortcut_id: (r["name"], r.prompt, r.over) for r in rules.shortcut_flags(rules.shortcut_blocks(books, ["i"])).collect()}
    assert got == {"sum": ("a name of length", "do it", ["name"]), "b": ("b", "", ["description", "prompt"])}
    names = spark.createDataFrame([(n,) for n in ("anna", "anne", "bo", "annabella", "an", "")], "n string")
    assert sorted((r.a, r.b) for r in rules.confusable(names, "n", 2).collect()) == [("an", "anna"), ("an", "anne"), ("an", "bo"), ("anna", "anne")]
    rows = spark.createDataFrame([(1, "x", "y", None), (2, "x", "z", None), (3, "q", "r", "s"), (4, "x", "y", None)], "k int, a string, b string, c string")
    assert sorted(map(tuple, rules.too_close(rows, "k", ["a", "b", "c"]).collect())) == [(1, 2, 1), (1, 4, 0), (2, 4, 1)]
    lines = spark.createDataFrame([("1. go",), ("Ann: \"hi\"",), ("a | b",), ("he said: no",)], "line string")
    assert [r.form for r in rules.form_lines(lines).collect()] == ["menu", "speech", "menu", "prose"]
    assert [r.text for r in rules.with_residue(spark.createDataFrame([("see a/b.md",), ("TODO",), ("fine / good",)], "text string"), ["text"]).collect()] == ["see a/b.md", "TODO"]


def test_columns_named_like_our_own(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "n string, share int")
    assert sorted(map(tuple, rules.shares(rows, "n").toDF("k", "n", "share").collect())) == [("a", 2, 2 / 3), ("b", 1, 1 / 3)]
    assert [tuple(r) for r in rules.counts_outside(rows, "n", 2, 9).collect()] == [("b", 1)]
    assert [tuple(r) for r in audits.repeated(rows, "n").collect()] == [("a", 2)]
    assert [tuple(r) for r in rules.crowded_shortcuts(rows, "n", 1).collect()] == [("a", 2)]
    docs = spark.createDataFrame([(1, "x → y → z", "mine", "own")], "doc_id int, text string, symbol string, kind string")
    assert [(r.doc_id, r.symbol, r.n, r.first_pos) for r in audits.symbol_rows(docs).collect()] == [(1, "→", 2, 3)]


def test_attributes_that_nobody_named_stay(spark):
    import json

    config = {
        "base": "masterpiece", "n": 3, "list": [{"x": 1}],
        "characters": {"ann": {"ko": "앤", "seed": 7, "loras": [{"name": "a", "weight": 0.5}], "tags": "x, y"}, "bob": {}},
        "scenes": {"hall": {"size": "wide", "ko": None}, "yard": {"size": [832, 1216], "more": {"deep": [1, {"k": "v"}]}}, "odd": 5},
        "styles": {"a b": {"seed": 12345678901, "unknown axis": True}},
    }
    rows = {(r.axis, r.slug): r for r in corpus.axes(spark.createDataFrame([(json.dumps(config),), (None,), ("[1]",), ("no json",)], "text string")).collect()}
    assert {k: json.loads(r.attributes) for k, r in rows.items()} == {(a, s): x for a, slugs in config.items() if isinstance(slugs, dict) for s, x in slugs.items()}
    assert rows["characters", "ann"].seed == 7 and rows["styles", "a b"].seed == 12345678901 and rows["scenes", "yard"]["size"] == [832, 1216]
    sizes = spark.createDataFrame([(list(x["size"]) if x["size"] else None, k[1]) for k, x in rows.items()], "size array<int>, slug string")
    assert {r.slug: r.label for r in sizes.select("slug", T.size_label(F.col("size")).alias("label")).collect()} == {"ann": "—", "bob": "—", "hall": "—", "yard": "832×1216", "odd": "—", "a b": "—"}
