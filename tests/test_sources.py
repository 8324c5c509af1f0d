"""Scans, payloads, ledger and streams on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from scriven.operators.condense import condense
from scriven.plans.ledger import Ledger
from scriven.sources import payloads, scan
from scriven.streaming import flows


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "build"  # the root itself is never skipped
    files = {
        "a.py": "x = 1\n", "sub/b.rs": "fn f() {}\r\n", "sub/deep/c.txt": "text", "node_modules/d.py": "no", ".git/e.py": "no", "sub/target/f.py": "no",
        "blank.py": " \n\t", "g.bin": "no", "_h.py": "y", "old.gen.py": "no", "gen/x/i.py": "no", "keep/gen2.py": "z", "n.php5": "no",
    }
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    (root / "bad.py").write_bytes(b"\xff\xfe\x00")
    (root / scan.IGNORE_FILE).write_text("# comment\n\n*.gen.py\ngen/\n")
    return root


def test_scan(spark, tree):
    want = {"a.py": "x = 1\n", "sub/b.rs": "fn f() {}\r\n", "sub/deep/c.txt": "text", "keep/gen2.py": "z"}
    assert {r.path: r.text for r in scan.scan_folder(spark, str(tree)).collect()} == want
    assert {r.path: r.text for r in scan.scan_local(spark, str(tree)).collect()} == want | {"_h.py": "y"}
    assert {r.path for r in scan.scan_folder(spark, str(tree), ["sub/*"]).collect()} == {"a.py", "old.gen.py", "keep/gen2.py", "gen/x/i.py"}
    assert scan.scan_file(spark, str(tree / "g.bin")).first().text == "no"
    both = scan.scan_many(spark, [str(tree / "a.py"), str(tree / "sub")]).collect()
    assert len(both) == 3
    assert scan.from_text(spark, " \n").count() == 0 and scan.from_text(spark, "x").count() == 1
    with pytest.raises(Exception):
        scan.scan_file(spark, str(tree / "bad.py")).collect()


def test_payloads(spark):
    rows = [
        {"hookEventName": "Post", "tool_name": "Read", "tool_input": {"file_path": "a.txt"}, "tool_response": {"content": [{"type": "image"}, {"type": "text", "text": "same line here\nsame line here\n"}]}},
        {"hookEventName": "Post", "tool_response": "plain plain plain\nplain plain plain"},
        {"tool_response": {"content": []}},
        {"tool_response": "  "},
        {"tool_response": "short"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("not json",), (None,)], "payload string")
    docs = payloads.payload_documents(df)
    assert docs.count() == 3
    out = payloads.payload_answers(docs).collect()
    assert len(out) == 2 and json.loads(next(r.response for r in out if r.path == "a.txt"))["hookSpecificOutput"]["additionalContext"].endswith("same line here")


def test_requests(spark):
    call = lambda i, tool, **a: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": tool, "arguments": a}})
    lines = [call(1, "compress", text="a\na"), call(2, "count_tokens", text="abcde"), call(3, "compress"), call(4, "nope", text="x"), call(5, "compress", text="{", content_type="json"), json.dumps({"id": 6, "method": "other"}), json.dumps({"method": "note"}), "", "broken",
             call(7, "estimate_cost", text="word " * 100, model="GEMINI"), call(8, "estimate_cost", text="x", model="zzz"), call(9, "compress", text="x", content_type="zzz"), call(10, "compress", text='{"a":null}', content_type="json")]
    got = {r.id: json.loads(r.response) for r in payloads.answers(payloads.requests(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()}
    assert set(got) == {str(i) for i in range(1, 11)}
    assert got["1"]["result"]["content"][0]["text"] == "a" and got["2"]["result"]["meta"]["tokens"] == 2
    assert [got[str(i)]["error"]["code"] for i in (3, 4, 5, 6, 8, 9)] == [-32602, -32602, -32603, -32601, -32602, -32602]
    assert len(got["7"]["result"]["meta"]) == 2 and got["10"]["result"]["content"][0]["text"] == "{}"


def test_ledger_and_stream(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.rows().count() == 0
    docs = spark.createDataFrame([(1, "a\na"), (2, None), (3, '{"a":1}')], "doc_id long, text string")
    ledger.record(condense(docs))
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        flows.into_ledger(flows.read_documents(spark, str(tmp_path / "in")), ledger, str(tmp_path / "check")).awaitTermination()
    assert ledger.rows().count() == 4
    total = json.loads(ledger.to_json().first().json)
    assert total["total"]["documents"] == 4 and total["by_language"]["text"]["tokens_after"] == 2
    ledger.reset()
    assert ledger.rows().count() == 0


def test_stream_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "en", 4, 2), ("2024-01-01 00:50:00", "en", 4, 2), ("2024-01-01 05:00:00", "fr", 1, 1)]
    df = spark.createDataFrame(rows, "ts string, language string, tokens_before long, tokens_after long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    flows.savings_by_window(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.language, r.documents) for r in spark.table("w").collect()} == {("en", 2), ("fr", 1)}
    assert flows.savings_by_session(df).count() == 3
    logs = df.select("ts", F.concat(F.lit("id "), (F.col("tokens_before") + 12340).cast("string")).alias("line"))
    logs.write.parquet(str(tmp_path / "logs"))
    fresh = flows.new_templates(spark.readStream.schema(logs.schema).parquet(str(tmp_path / "logs")))
    fresh.writeStream.format("memory").queryName("t").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("t").count() == 1


def test_requests_with_options_of_their_own(spark):
    code = "fn f() -> u8 {\n    1\n}\nuse x;\n"
    asks = [{"text": code, "content_type": "rust", "ast": True}, {"text": code, "content_type": "rust"}, {"text": "a b c d\n" * 9 + "e", "budget": 2}, {"text": "x", "budget": -1}, {"text": "x", "budget": "many", "ast": 1}]
    lines = [(json.dumps({"jsonrpc": "2.0", "id": str(i), "method": "tools/call", "params": {"name": "compress", "arguments": a}}),) for i, a in enumerate(asks)]
    got = {r.id: json.loads(r.response) for r in payloads.answers(payloads.requests(spark.createDataFrame(lines, "value string"))).collect()}
    text = lambda i: got[str(i)]["result"]["content"][0]["text"]
    assert "/* ... */" in text(0) and "/* ... */" not in text(1)
    assert text(2) == "a b c d\n// cut to fit a budget of 2 tokens\n" and text(3) == "x"
    assert "4" not in got or text(4) == "x"


def test_what_a_file_holds_before_an_edit(spark):
    message = lambda event, tool, path: (json.dumps({"hookEventName": event, "tool_name": tool, "tool_input": {"file_path": path}}),)
    asks = [message("PreToolUse", "Edit", "a.txt"), message("PreToolUse", "Write", "gone.txt"), message("PreToolUse", "Read", "a.txt"), message("PostToolUse", "Edit", "a.txt"), message("PreToolUse", "Write", "b.txt")]
    files = spark.createDataFrame([("a.txt", "same line of words\n" * 5), ("b.txt", " ")], "path string, text string")
    docs = payloads.edited_documents(spark.createDataFrame(asks, "payload string"), files)
    got = payloads.payload_answers(docs, suppress=None).collect()
    out = json.loads(got[0].response)["hookSpecificOutput"]
    assert len(got) == 1 and got[0].path == "a.txt" and out["hookEventName"] == "PreToolUse" and "suppressOutput" not in out and out["additionalContext"].endswith("same line of words")
