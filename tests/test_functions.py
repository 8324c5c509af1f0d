"""Functions and operators against plain Python, on cases and on random text."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from scriven.functions import detect as D
from scriven.functions import formats, lexers, neardup, stubs, tokens
from scriven.functions import lines as L
from scriven.operators import bundle, similar
from scriven.operators.cache import ResultCache
from scriven.operators.condense import condense, usable, with_savings
from scriven.plans import options as O
from scriven.plans import reports


def apply(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    return [r.x for r in df.select("i", fn(F.col("text")).alias("x")).orderBy("i").collect()]


def noise(seed, alphabet, count=300, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(most))) for _ in range(count)]


EDGE = [None, "", "\n", "a", "a\n", "a\r\nb\r\n", "\r", "a\n\n\n\nb", "  \n\t\u00a0\n x \n\n", "\n\na"]


def test_lines(spark):
    want = [None if t is None else lexers.split_lines(t) for t in EDGE]
    assert apply(spark, L.lines, EDGE) == want
    assert apply(spark, L.collapse_blank_lines, EDGE) == [None if t is None else lexers.collapse(t) for t in EDGE]
    many = noise(1, "ab \n\r\t")
    assert apply(spark, L.collapse_blank_lines, many) == [lexers.collapse(t) for t in many]


def naive_cstyle(text, docs=()):
    out, i, n = [], 0, len(text)
    while i < n:
        if text.startswith("//", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            if text.startswith(docs, i) if docs else False:
                out.append(text[i:end])
            i = end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            out.append("\n" * text.count("\n", i, n if end < 0 else end))
            i = n if end < 0 else end + 2
        elif text[i] in "\"'`":
            j = i + 1
            while j < n and text[j] != text[i]:
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        else:
            out.append(text[i])
            i += 1
    return lexers.collapse("".join(out))


def test_cstyle(spark):
    many = noise(2, "/*\"'\\\n a", 600) + ["/*" + "x\n" * 50_000, '"' + "\\x" * 100_000, "/*" * 100_000, "", "a /* b */ c // d"]
    assert apply(spark, lexers.cstyle, many) == [naive_cstyle(t) for t in many]
    rust = noise(3, "/!a\n\"", 300)
    assert apply(spark, lambda t: lexers.cstyle(t, "rust"), rust) == [naive_cstyle(t, ("///", "//!")) for t in rust]
    assert apply(spark, lambda t: lexers.cstyle(t, "rust", True), ["/// a\nb", None]) == ["b", None]


def naive_block(text, begin, end, left, quote=False, line=None):
    out, i, n = [], 0, len(text)
    while i < n:
        if line and text.startswith(line, i):
            while i < n and text[i] != "\n":
                i += 1
        elif text.startswith(begin, i):
            i += len(begin)
            while i + left < n and not text.startswith(end, i):
                out.append("\n" if text[i] == "\n" else "")
                i += 1
            if i + left < n:
                i += len(end)
        elif quote and text[i] == "'":
            j = text.find("'", i + 1)
            j = n if j < 0 else j + 1
            out.append(text[i:j])
            i = j
        else:
            out.append(text[i])
            i += 1
    return lexers.collapse("".join(out))


def test_html_css_sql(spark):
    html = noise(4, "<!-> \na", 500) + ["<!-- a\n\n\nb -->c", "<!-- open", "x<!---->y", "<!--" + "-\n" * 60_000]
    assert apply(spark, lexers.html, html) == [naive_block(t, "<!--", "-->", 2) for t in html]
    css = noise(5, "/* \na", 500) + ["/* a", "a{}/**/b"]
    assert apply(spark, lexers.css, css) == [naive_block(t, "/*", "*/", 1) for t in css]
    sql = noise(6, "/*-' \na", 500) + ["select '--' -- x"]
    assert apply(spark, lexers.sql, sql) == [naive_block(t, "/*", "*/", 1, True, "--") for t in sql]


def test_python_ruby_shell_yaml():
    assert lexers.strip_python('"""doc\nmore"""\nx = """kept # yes"""  # no\ny = "#"\n\n\n\nz = 1 # q') == 'x = """kept # yes"""  \ny = "#"\n\nz = 1 '
    assert lexers.strip_ruby("#!/usr/bin/ruby\n# x\n=begin\nno\n=end\nputs 'a#b' # c\n") == "#!/usr/bin/ruby\n\nputs 'a#b'"
    assert lexers.strip_shell("\n#!/bin/sh\n# c\necho \"a # b\" # c\necho $# x") == "#!/bin/sh\n\necho \"a # b\"\necho $"
    assert lexers.strip_yaml("a: 'it''s # x' # y\nb#c: 1\n# z") == "a: 'it''s # x'\nb#c: 1"
    for fn in (lexers.strip_python, lexers.strip_ruby, lexers.strip_shell, lexers.strip_yaml):
        for t in noise(7, "#\"'\\\n ab", 300) + ["", "'" * 9, '"' + "\\" * 5]:
            fn(t)


def test_text_dedup(spark):
    many = [*EDGE, *noise(8, "aAb \n", 400), "x\n" * 20_000, "\n".join(map(str, range(20_000)))]
    assert apply(spark, formats.text_dedup, many) == [None if t is None else formats.dedup_lines(t) for t in many]


def test_logs(spark):
    log = "2024-01-02 03:04:05.5Z ERROR id 12345\n\n2025-01-02T03:04:05+01:00 ERROR id 9999\nx 0123abcd4567 123e4567-e89b-12d3-a456-426614174000 12 12345678 \u00e912345"
    assert apply(spark, formats.log_collapse, [log, None, "", "a\nb\na"]) == ["[\u00d72] <ts> ERROR id <n>\nx <hex> <uuid> 12 <hex> \u00e9<n>", None, "", "[\u00d72] a\nb"]
    many = noise(9, "xy\n", 300, 60)

    def brute(t):
        count = {}
        for x in lexers.split_lines(t):
            if x.strip():
                count[x] = count.get(x, 0) + 1
        return "\n".join(f"[\u00d7{n}] {k}" if n > 1 else k for k, n in count.items())

    assert apply(spark, formats.log_collapse, many) == [brute(t) for t in many]


def test_diff_and_json(spark):
    diff = "diff --git a/x b/x\nindex 1\n--- a/x\n+++ b/x\n@@ -1 +1 @@ f\n same\n-old\n+new\n\\ No newline"
    assert apply(spark, formats.diff_compact, [diff, None, ""]) == ["diff --git a/x b/x\n--- a/x\n+++ b/x\n---\n-old\n+new", None, ""]
    docs = ['{"b": 1, "a": {"x": null, "y": {"z": []}}, "c": [null, "", {}]}', "[]", "null", '{"a": 1, "a": 2}', "{'a': 1}", '{"a": NaN}', "{", "[" * 200 + "]" * 200, "[" * 100_000, '{"n": 1.0, "e": "\u00e9"}', None]
    assert apply(spark, formats.json_clean, docs) == ['{"b":1,"c":[null,"",{}]}', "[]", "null", '{"a":2}', None, None, None, None, None, '{"e":"\u00e9","n":1.0}', None]


def test_patterns(spark):
    texts = ["  keep 12\n34\n\n x", None, "", "none"]
    assert apply(spark, lambda t: formats.strip_patterns(t, ["[0-9]+", "("]), texts) == ["  keep\n x", None, "", "none"]
    assert apply(spark, lambda t: formats.strip_patterns(t, ["("]), ["a\n\n"]) == ["a\n\n"]


def test_budget(spark):
    def brute(t, budget):
        if -(-len(t) // 4) <= budget:
            return t
        out = ""
        for x in lexers.split_lines(t):
            if -(-len(out + x + "\n") // 4) > budget:
                break
            out += x + "\n"
        return out + formats.notice(budget)

    many = noise(10, "abc\n", 300, 80) + ["", "x" * 99]
    for budget in (0, 1, 5):
        assert apply(spark, lambda t: formats.within_budget(t, budget), many) == [brute(t, budget) for t in many]
    assert apply(spark, lambda t: formats.within_budget(t, 1), [None]) == [None]


def test_tokens(spark):
    assert apply(spark, tokens.approximate, ["", "a", "abcd", "abcde", None]) == [0, 1, 1, 2, None]
    assert apply(spark, tokens.bpe_counter("/opt/tokenizers/byte_bpe_50k.tiktoken"), ["", "hello world", None]) == [0, 2, None]
    df = spark.createDataFrame([(0, 0), (10, 5), (10, 20)], "b long, a long")
    assert [r.x for r in df.select(tokens.saved_pct(F.col("b"), F.col("a")).alias("x")).collect()] == [0.0, 50.0, 0.0]


@pytest.mark.parametrize(
    "text, kind, language",
    [
        ('{"a": [1]}', "json", None),
        ("  [1, 2]", "json", None),
        ("{ not json", "text", None),
        ("diff --git a/b c/d\n", "diff", None),
        ("x\n--- a\n+++ b\n", "diff", None),
        ("INFO a\nWARN b\nx\n", "logs", None),
        ("INFO a\nb\n", "text", None),
        ("<!DOCTYPE html><p>", "code", "html"),
        ("#!/bin/sh\necho", "code", "shell"),
        ("  select 1", "code", "sql"),
        ("#include <a.h>", "code", "c"),
        ("use x;\nfn main() {}", "code", "rust"),
        ("interface A {}", "code", "typescript"),
        ("fun main() { val x = 1 }", "code", "kotlin"),
        ("import Foundation", "code", "swift"),
        ("public class A {}", "code", "java"),
        ("require 'x'\ndef f\nend", "code", "ruby"),
        ("import os\ndef f(): pass", "code", "python"),
        ("package p\nfunc f() {}", "code", "go"),
        ("const x = 1", "code", "javascript"),
        ("struct A\nenum B", "code", "generic"),
        ("plain words", "text", None),
        ("", "text", None),
    ],
)
def test_detect(spark, text, kind, language):
    got = apply(spark, D.by_content, [text])[0]
    assert (got.content_type, got.language) == (kind, language)


def test_detect_by_path_and_name(spark):
    df = spark.createDataFrame([("a/b.cpp",), ("x.RB",), (".rs",), (None,), ("d.e/f",), ("a.log",)], "p string")
    got = [r.k.language or r.k.content_type for r in df.select(D.by_path(F.col("p"), F.lit("words")).alias("k")).collect()]
    assert got == ["c", "text", "text", "text", "text", "logs"]
    assert D.parse_type("c++") == ("code", "c")
    with pytest.raises(D.UnknownType):
        D.parse_type("nonsense")
    assert len(D.ALIASES) == 41


def naive_type(text):
    """The rules one by one, over str."""
    if text is None:
        return None
    if text.startswith(("diff --git", "--- ")) or ("\n+++ " in text and "\n--- " in text):
        return "diff", None
    if text.lstrip(L.WHITE)[:1] in ("{", "["):
        try:
            D.load_json(text)
            return "json", None
        except ValueError:
            pass
    all_lines = lexers.split_lines(text)
    if len(all_lines) >= 3 and sum(any(s in x for s in D.SIGNALS) for x in all_lines) * 10 > len(all_lines) * 3:
        return "logs", None
    head = text.lstrip(L.WHITE)
    if head.startswith(D.DOCTYPES):
        return "code", "html"
    if text.startswith("#!/"):
        return "code", "shell"
    if head[:8].upper().startswith(D.VERBS):
        return "code", "sql"
    found = [name for name, groups in D.WORDS if all(any(w in text for w in g) for g in groups)]
    if not found and sum(w in text for w in D.GENERIC) >= 2:
        found = ["generic"]
    return ("code", found[0]) if found else ("text", None)


def test_detect_against_the_rules_one_by_one(spark):
    rng = random.Random(7)
    words = [*D.SIGNALS, *D.GENERIC, *D.DOCTYPES, *D.VERBS, *(w for _, groups in D.WORDS for g in groups for w in g), "diff --git", "--- ", "+++ ", "#!/", "{", "}", "[1]", '{"a":1}', "sel\u0435ct ", "\u017felect ", "\u00df"]
    blank = ["\n", "\n", "\r\n", " ", "\t", "\u00a0", "\u2003", "\x85", "\u3000", "é", "x "]
    texts = ["".join(rng.choice(words if rng.random() < 0.3 else blank) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    texts += [None, "", "\n\n\n", "\u2003 {}", "\u00a0[1, 2]", "\x85select 1", " " * 300_000 + "select 1", "{" * 200_000]
    got = apply(spark, D.by_content, texts)
    assert [x and tuple(x) for x in got] == [naive_type(t) for t in texts]
    assert len({x for x in got}) > 12


def test_detect_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT cast(unhex('7B22FF227D') AS string) AS text")
    assert tuple(df.select(D.by_content(F.col("text")).alias("k")).first().k) == ("text", None)


STUBS = [
    ("rust", "trait A { fn d(&self); }\nfn f<T: Into<u8>>(a: T) -> Vec<u8> where T: Copy {\n  x\n}\nfn g() {}\n", "trait A { fn d(&self); }\nfn f<T: Into<u8>>(a: T) -> Vec<u8> where T: Copy { /* ... */ }\nfn g() { /* ... */ }\n"),
    ("java", "class A { int y = f(1); @Override public <T> void m(List<T> a) throws E, G { if (x) { y(); } } }", "class A { int y = f(1); @Override public <T> void m(List<T> a) throws E, G { /* ... */ } }"),
    ("csharp", "class A { public A(int x) : base(x) { Y(); } int P { get; set; } }", "class A { public A(int x) : base(x) { /* ... */ } int P { get; set; } }"),
    ("c", "struct s { int a; };\nstatic int *f(void)\n{\n  return 0;\n}\nvoid A::g() const { h(); }\n", "struct s { int a; };\nstatic int *f(void)\n{ /* ... */ }\nvoid A::g() const { /* ... */ }\n"),
    ("go", "func f(x interface{}) error {\n\treturn nil\n}\ntype T struct {\n\ta int\n}\n", "func f(x interface{}) error { /* ... */ }\ntype T struct {\n\ta int\n}\n"),
    ("javascript", "function f(a) { return '}'; }\nconst g = async (x) => { y(x); };\nconst h = x => x * 2;\nclass A { m() { return 1; } }", "function f(a) { /* ... */ }\nconst g = async (x) => { /* ... */ };\nconst h = x => { /* ... */ };\nclass A { m() { /* ... */ } }"),
    ("php", "<?php\nfunction f($a): int {\n  return 1;\n}\n", "<?php\nfunction f($a): int { /* ... */ }\n"),
    ("kotlin", "fun f(a: Int): Int {\n  return a\n}\nfun g() = 1\n", "fun f(a: Int): Int { /* ... */ }\nfun g() = 1\n"),
    ("swift", "func f(a: Int) -> Int {\n  return a\n}\ninit(x: Int) { y = x }\n", "func f(a: Int) -> Int { /* ... */ }\ninit(x: Int) { /* ... */ }\n"),
    ("python", "class A:\n    @p\n    async def f(\n        self,\n        d={'a': 1},\n    ) -> int:\n        '''\nflush\n        '''\n        def g():\n            pass\n        return 1\n\nx = 1\ndef one(): return 2\n", "class A:\n    @p\n    async def f(\n        self,\n        d={'a': 1},\n    ) -> int:\n        ...\n\nx = 1\ndef one():\n    ..."),
    ("ruby", "def self.f(a)\n  a.each do |x|\n    puts 'end'\n  end\nend\ndef g = 1\nputs 1", "def self.f(a)\n  # ...\nend\ndef g = 1\nputs 1"),
    ("generic", "x = 1", "x = 1"),
]


@pytest.mark.parametrize("language, text, want", STUBS, ids=[s[0] for s in STUBS])
def test_stubs(language, text, want):
    assert stubs.stub(text, language) == want
    assert stubs.stub("", language) == "" and stubs.stub("}}}{{{(((", language) is not None


def test_near_blocks(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(500)}"
    a = [word() for _ in range(40)]
    b = [*a[:-1], "other"]
    c = [word() for _ in range(40)]
    text = "\n\n".join([" ".join(a), " ".join(c), " ".join(b), " ".join(c)])
    assert apply(spark, neardup.drop_near_blocks, [text, None, "", "x"]) == [" ".join(a) + "\n\n" + " ".join(c), None, "", "x"]


def test_a_block_alone_needs_no_signature(monkeypatch):
    made = []
    signature = neardup.signature
    monkeypatch.setattr(neardup, "signature", lambda text: (made.append(text), signature(text))[1])
    assert neardup.distinct_blocks("a b\nc\n") == "a b\nc" and neardup.distinct_blocks("a\n\n \n\na") == "a" and not made
    assert neardup.distinct_blocks("a\n\nb") == "a\n\nb" and made == ["a", "b"]


def test_batches_are_worked_on_in_pieces():
    import tracemalloc

    import pyarrow as pa

    from scriven.operators.condense import _python_step

    texts = [f"{i} " + "word " * 2000 for i in range(3000)] + [None, ""]
    n = len(texts)
    step = _python_step(O.Options(smart=True)).func
    columns = pa.array(texts), pa.array(["text"] * n), pa.array([None] * n, pa.string()), pa.array([False] * n), pa.array([True] * n)
    tracemalloc.start()
    try:
        got = step(*columns)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 15_000_000  # of 30 MB of text
    assert got.to_pylist() == texts


def test_exact_tokens_are_counted_in_pieces(monkeypatch):
    import pyarrow as pa

    from scriven.functions import batches

    monkeypatch.setattr(batches, "PIECE", 25)
    texts = ["ab", None, "", "x" * 100, "cd e", "\u00e9" * 12, None]
    enc = tokens._encoding(EXACT)
    for n in range(len(texts) + 1):
        got = batches.mapped(lambda t, k: len(enc.encode_ordinary(t)) + k, pa.int64(), pa.array(texts[:n], pa.string()), pa.array(range(n), pa.int64()))
        assert got.to_pylist() == [None if t is None else len(enc.encode_ordinary(t)) + k for k, t in enumerate(texts[:n])]


def test_signatures_and_pairs(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(50)) for _ in range(20)]
    texts = base + base[:5] + [t.rsplit(" ", 1)[0] + " x" for t in base[5:10]] + [base[0], "a b", "a b", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = similar.signatures(df)
    got = {r.doc_id: r.signature for r in sigs.collect()}
    want = {i: s for i, t in enumerate(texts) if t and (s := neardup.signature(t)) is not None}
    assert set(got) == set(want) and all((want[i] == got[i]).all() for i in want)
    band = lambda s, b: tuple(s[b * 4 : b * 4 + 4])
    pairs = {(i, j) for i, j in itertools.combinations(sorted(want), 2) if any(band(want[i], b) == band(want[j], b) for b in range(16)) and (want[i] == want[j]).mean() >= 0.72}
    assert sorted((r.doc_id_a, r.doc_id_b) for r in similar.pairs(sigs).collect()) == sorted(pairs)


def test_bundle_and_corpus_budget(spark):
    rows = [("b", "two\nlines"), ("a", "first"), ("c", "x" * 50), (None, "none"), ("d", None)]
    df = spark.createDataFrame([("g", p, t, 2, 1) for p, t in rows], "g string, path string, condensed string, tokens_before long, tokens_after long")
    whole = bundle.bundle(df, ["g"]).first()
    text = "".join(f"// === {p} ===\n{t}\n\n" for p, t in sorted(r for r in rows if None not in r))
    assert whole.bundle == text and (whole.documents, whole.tokens_before, whole.tokens_after) == (3, 6, 3)
    for budget in range(0, 40):
        got = bundle.corpus_budget(df, budget).orderBy(F.col("path").asc_nulls_last()).collect()
        out, cut = "", False
        for line in text.split("\n")[:-1]:
            if len(out + line + "\n") > 4 * budget:
                cut = True
                break
            out += line + "\n"
        assert "".join(r.chunk for r in got) == out + (formats.notice(budget) if cut else ""), budget
        if budget > 12:
            break


def test_condense(spark):
    texts = ["a\nA\nb", '{"a": null, "b": 1}', "{bad", "INFO 1\nINFO 1\nx", "diff --git a\n x\n+y", "use a;\nfn f() { 1 } // c", "import os\ndef f():\n    return 1 # c\n", None, "", "# not code"]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id int, text string, condensed string")
    got = {r.doc_id: r for r in condense(df).collect()}
    assert [got[i].condensed for i in range(len(texts))] == ["a\nb", '{"b":1}', "{bad", "[\u00d72] INFO 1\nx", "diff --git a\n+y", "use a;\nfn f() { 1 } ", "import os\ndef f():\n    return 1 ", None, "", "# not code"]
    assert all(r.error is None for r in got.values())
    forced = {r.doc_id: r for r in condense(df, forced="json").collect()}
    assert forced[1].condensed == '{"b":1}' and forced[0].error and forced[7].error is None
    stubbed = {r.doc_id: r for r in condense(df, O.Options(stubs=True, smart=True, patterns=("os",), budget=1000)).collect()}
    assert stubbed[5].condensed == "use a;\nfn f() { /* ... */ } // c" and stubbed[6].condensed == "import\ndef f():\n    ..."
    assert usable(df).count() == len(texts) - 2
    assert with_savings(condense(df)).where("doc_id = 0").first().saved_pct == 50.0
    assert condense(df.limit(0)).count() == 0


def test_signatures_in_batches(spark):
    rng = random.Random(3)
    alphabet = ["a", "b\u00e9", "\u3000", " ", "\n", "\x1c", "\x1f x", "w" * 30, "\U0001f600", "\x85", "z "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(400)]
    texts += [None, "", " \u2003\n", "a", "a b", "a b c", "x" * 5000 + " y z", " ".join(f"w{i}" for i in range(50_000))]
    texts += [" ".join("q" * n for n in (a, 1, 1)) for a in range(48, 60)]  # about as long as one block of MD5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sigs = similar.signatures(df)
    want = {i: s.tolist() for i, t in enumerate(texts) if t and (s := neardup.signature(t)) is not None}
    assert {r.doc_id: r.signature for r in sigs.collect()} == want
    assert "Generate" not in sigs._jdf.queryExecution().executedPlan().toString()  # no row a shingle
    twice = similar.signatures(spark.createDataFrame([(1, "a b c d"), (1, "e f"), (1, None)], "doc_id long, text string")).collect()
    assert [r.signature for r in twice] == [[min(x) for x in zip(neardup.signature("a b c d").tolist(), neardup.signature("e f").tolist())]]


def test_options(tmp_path):
    a, b = tmp_path / "a.toml", tmp_path / "b.toml"
    b.write_text('[defaults]\nbudget = 5\nstubs = true\n[strip]\npatterns = ["x"]\n')
    assert O.load(a, b) == O.Options(budget=5, stubs=True, patterns=("x",))
    a.write_text("broken [")
    assert O.load(a, b).budget == 5
    a.write_text("[defaults]\nsmart = true\n")
    assert O.load(a, b) == O.Options(smart=True)
    assert O.merge(O.load(b), O.Options(budget=7, smart=True, patterns=("y", "x"))) == O.Options(budget=7, stubs=True, smart=True, patterns=("x", "y"))
    assert O.merge(O.load(b), O.Options(), budget=0).budget == 0


def test_cache(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([(1, "a\na"), (2, "a\na"), (3, None)], "doc_id int, text string")
    day = dt.date(2024, 1, 31)
    first = cache.through(df, today=day)
    assert sorted((r.doc_id, r.condensed) for r in first.collect()) == [(1, "a"), (2, "a"), (3, None)]
    cache.through(df, today=day).collect()
    assert cache.size()[0] == 1
    cache.through(df, O.Options(budget=0), today=day + dt.timedelta(days=40)).collect()
    assert cache.size()[0] == 2 and cache.size()[1] > 0
    assert cache.evict(today=day + dt.timedelta(days=40)) == 1 and cache.size()[0] == 1
    cache.clear()
    assert cache.size() == (0, 0)


def test_cache_looks_up_without_finding_types(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([(1, "a # b\na # b", "x.py"), (2, "a # b\na # b", "x.txt"), (3, "a # b\na # b", None), (4, None, "x.py")], "doc_id int, text string, path string")
    assert "ArrowEvalPython" not in cache.through(df)._jdf.queryExecution().executedPlan().toString()
    by_path = cache.through(df, path="path")
    assert "ArrowEvalPython" not in by_path._jdf.queryExecution().executedPlan().toString()
    assert cache.size()[0] == 2  # of the content, in both runs, and of Python
    assert sorted((r.doc_id, r.content_type, r.condensed) for r in by_path.collect()) == [(1, "code", "a \na "), (2, "text", "a # b"), (3, "text", "a # b"), (4, None, None)]
    cache.through(df, forced="text")
    assert cache.size()[0] == 3


def test_reports(spark):
    facts = spark.createDataFrame([("en", 1_000_000, 400_000), ("fr", 10, 20), ("en", 1_000_000, 600_000), (None, 0, 0)], "language string, tokens_before long, tokens_after long")
    assert reports.totals(facts).first().tokens_before == 2_000_010
    assert [r.language for r in reports.ranked(facts).orderBy("rank").collect()] == ["en", None, "fr"]
    best = reports.best_model(reports.cost_by_model(facts, reports.prices(spark))).first()
    assert best.model == reports.price_rows()[0][1] and best.monthly_usd == pytest.approx(best.cost_saved * 3000)
    assert reports.cost_by_model(facts, reports.prices(spark), "NOTHING").count() == 0
    assert reports.estimate(facts, reports.prices(spark), "nothing").first().error_code == -32602
    row = spark.createDataFrame([(1234567, 0.5)], "n long, x double").select(
        reports.number(F.col("n")).alias("a"), reports.short_number(F.col("n")).alias("b"), reports.short_number(F.lit(12345)).alias("c"), reports.usd(F.col("x")).alias("d"), reports.usd(F.lit(2.0)).alias("e"), reports.usd(F.lit(0.001)).alias("f")
    ).first()
    assert tuple(row) == ("1,234,567", "1.2M", "12 345", "$0.5000", "$2.00", "$0.001000")
    assert len(json.loads(reports.estimate(facts, reports.prices(spark)).first().meta)) == 10


EXACT = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_condense_with_exact_counts_and_budget(spark):
    count = tokens.bpe_counter(EXACT)
    exact = lambda t: len(tokens._encoding(EXACT).encode_ordinary(t))
    texts = ["日本語の文章です\nもう一行\n" * 40, "plain words here\n" * 100, "short", "", None, '{"a": 1, "b": null}', "éàü ñ\n\n\nx 12345\n" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in (O.Options(), O.Options(budget=60), O.Options(budget=60, smart=True, patterns=("[0-9]{3,}",)), O.Options(stubs=True, budget=0)):
        rough = {r.doc_id: r.condensed for r in condense(df, O.Options(stubs=options.stubs, smart=options.smart, patterns=options.patterns)).collect()}
        for r in condense(df, options, count=count).collect():
            if r.text is None:
                assert r.tokens_before is r.tokens_after is r.condensed is None
                continue
            assert r.tokens_before == exact(r.text) and r.tokens_after == exact(r.condensed)
            whole = rough[r.doc_id]
            if options.budget is None or exact(whole) <= options.budget:
                assert r.condensed == whole
                continue
            assert r.condensed.endswith(formats.notice(options.budget))
            kept = r.condensed.removesuffix(formats.notice(options.budget))
            n = kept.count("\n")
            all_lines = lexers.split_lines(whole)
            assert kept == "".join(x + "\n" for x in all_lines[:n]) and exact(kept) <= options.budget < exact(kept + all_lines[n] + "\n")


def test_own_options_of_rows(spark):
    code = "fn f() -> u8 {\n    1\n}\nuse x;\nfn g() {}\nlet a;\n"
    block = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, code, True, None, None), (2, code, False, None, None), (3, f"{block}\n\nOther words stand here\n\n{block}.", None, True, None), (4, f"{block}\n\nOther words stand here\n\n{block}.", None, None, None), (5, "a b c d\n" * 9 + "e\n" * 3 + "f", None, None, 1), (6, "a\nb", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ast boolean, near boolean, most long")
    got = {r.doc_id: r.condensed for r in condense(df, stubbed=F.col("ast"), smart=F.col("near"), budget=F.col("most")).collect()}
    alone = lambda i, o: condense(df.where(f"doc_id = {i}"), o).first().condensed
    assert got == {1: alone(1, O.Options(stubs=True)), 2: alone(2, O.Options()), 3: alone(3, O.Options(smart=True)), 4: alone(4, O.Options()), 5: alone(5, O.Options(budget=1)), 6: alone(6, O.Options())}
    assert got[1] != got[2] and got[3] != got[4]


def test_ruby_keeps_the_first_line():
    assert lexers.strip_ruby("#!/usr/bin/env ruby\n# note\nputs 1 # why\n") == "#!/usr/bin/env ruby\n\nputs 1"


def test_dedup_in_python_and_on_the_jvm(spark):
    texts = [t for t in [*EDGE, *noise(5, "ab A\n\t", 200, 60)]]
    assert apply(spark, formats.text_dedup, texts) == [None if t is None else formats.dedup_lines(t) for t in texts]


def test_sample_report(spark):
    from scriven.plans import samples

    rows = samples.report(spark).collect()
    for mode in ("standard", "stubbed"):
        each = [r for r in rows if r["mode"] == mode and not r.is_total]
        total = next(r for r in rows if r["mode"] == mode and r.is_total)
        assert len(each) == {"standard": 12, "stubbed": 6}[mode]
        assert total.tokens_before == sum(r.tokens_before for r in each) and total.tokens_after == sum(r.tokens_after for r in each)
        assert abs(total.saved_pct - 100 * (total.tokens_before - total.tokens_after) / total.tokens_before) < 1e-9
        assert all(r.tokens_after < r.tokens_before for r in each)
