"""Documents inside of messages: tool payloads and requests, one JSON text for each row; and the answers.

Messages are parsed by JSON paths on the JVM.  Rows that aren't JSON, and blank ones, are
dropped, as are requests without an id (notifications).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions.tokens import Counter, approximate, saved_pct
from ..operators.condense import condense, usable
from ..plans import reports
from ..plans.options import Options

_BLOCKS = "array<struct<type:string,text:string>>"
REQUEST = "id string, method string, params struct<name:string,arguments:struct<text:string,content_type:string,model:string,ast:boolean,smart:boolean,budget:long>>"
UNKNOWN_METHOD, BAD_PARAMS, INTERNAL = -32601, -32602, -32603
#: Tokens beyond which a budget is none.
MOST = 1 << 28
TOOLS = ("compress", "count_tokens", "estimate_cost")


def response_text(payload: Column) -> Column:
    """The first text block of a tool's response, else the response itself if it is a plain string."""
    blocks = F.from_json(F.get_json_object(payload, "$.tool_response.content"), _BLOCKS)
    first = F.get(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), 0)["text"]
    whole = F.get_json_object(payload, "$.tool_response")
    return F.coalesce(first, F.when(~D.left(whole).rlike(r"^[\[{]"), whole))


def payload_documents(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """(event, tool, path, text) of each message with a response that isn't blank."""
    p = F.col(payload)
    got = messages.select(
        F.get_json_object(p, "$.hookEventName").alias("event"), F.get_json_object(p, "$.tool_name").alias("tool"), F.get_json_object(p, "$.tool_input.file_path").alias("path"), response_text(p).alias("text")
    )
    return usable(got)


def edited_documents(messages: DataFrame, files: DataFrame, payload: str = "payload") -> DataFrame:
    """(event, tool, path, text): for each message before a file is written or edited, what the file (path, text) holds now.

    Messages about files that aren't there, or are blank, have no row.
    """
    p = F.col(payload)
    asked = messages.select(F.get_json_object(p, "$.hookEventName").alias("event"), F.get_json_object(p, "$.tool_name").alias("tool"), F.get_json_object(p, "$.tool_input.file_path").alias("path"))
    asked = asked.where((F.col("event") == "PreToolUse") & F.col("tool").isin("Write", "Edit"))
    return usable(asked.join(files.select("path", "text"), "path").select("event", "tool", "path", "text"))


def payload_answers(documents: DataFrame, suppress: bool | None = False, count: Counter = approximate) -> DataFrame:
    """(path, response): JSON for the documents that became shorter; no row for the others.  ``suppress`` None leaves that key out."""
    done = condense(documents, Options(), path="path", count=count).where("error is null and tokens_after < tokens_before")
    head = F.format_string("[%d → %d tokens, %.0f%% saved]\n\n", "tokens_before", "tokens_after", saved_pct(F.col("tokens_before"), F.col("tokens_after")))
    quiet = [] if suppress is None else [F.lit(suppress).alias("suppressOutput")]
    body = F.struct(F.struct(F.col("event").alias("hookEventName"), *quiet, F.concat(head, "condensed").alias("additionalContext")).alias("hookSpecificOutput"))
    return done.select("path", F.to_json(body).alias("response"))


def requests(messages: DataFrame, value: str = "value") -> DataFrame:
    """(id, method, tool, text, content_type, model, ast, smart, budget) of each request line; an option of another type is null."""
    parsed = messages.where(D.left(F.col(value)) != "").select(F.from_json(value, REQUEST, {"mode": "PERMISSIVE"}).alias("r")).where("r.id is not null")
    a = "r.params.arguments"
    return parsed.select("r.id", "r.method", F.col("r.params.name").alias("tool"), F.col(f"{a}.text").alias("text"), F.col(f"{a}.content_type").alias("content_type"), *[F.col(f"{a}.{c}").alias(c) for c in ("model", "ast", "smart", "budget")])


def answers(reqs: DataFrame, options: Options = Options(), count: Counter = approximate) -> DataFrame:
    """(id, response) for each request: the condensed text, the count or the cost table, and meta with the numbers; or an error.

    A request to condense may have ``ast`` (bodies are stubbed), ``smart`` and ``budget`` of its own.
    """
    known = F.create_map(*[x for name, (kind, lang) in D.ALIASES.items() for x in (F.lit(name), F.struct(F.lit(kind).alias("content_type"), F.lit(lang).cast("string").alias("language")))])
    asked = reqs.withColumnRenamed("content_type", "__asked").withColumn("__forced", F.try_element_at(known, F.col("__asked")))
    own = lambda c: F.when(F.col("tool") == "compress", F.col(c)) if c in reqs.columns else None
    limit = own("budget")
    limit = limit if limit is None else F.when(limit >= 0, F.least(limit, F.lit(MOST)))
    done = condense(asked, options, count=count, kind=F.col("__forced"), stubbed=own("ast"), smart=own("smart"), budget=limit)
    pct = F.round(saved_pct(F.col("tokens_before"), F.col("tokens_after")), 1).alias("saved_pct")
    meta = F.struct("tokens_before", "tokens_after", pct, D.display(F.col("content_type"), F.col("language")).alias("content_type"))
    chosen = F.filter(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(p).alias("provider"), F.lit(v).alias("usd_per_mtok")) for _, m, p, v in reports.price_rows()]), lambda x: F.contains(x["model"], F.lower(F.coalesce("model", F.lit("")))))
    priced = F.transform(chosen, lambda x: x.withField("cost_before", F.col("tokens_before") / F.lit(1e6) * x["usd_per_mtok"]).withField("cost_after", F.col("tokens_after") / F.lit(1e6) * x["usd_per_mtok"]))
    table = F.array_join(F.transform(priced, lambda x: F.format_string("%s (%s): %s → %s", x["model"], x["provider"], reports.usd(x["cost_before"]), reports.usd(x["cost_after"]))), "\n")
    content = lambda text: F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    result = lambda text, m: F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("id"), F.struct(content(text).alias("content"), m.alias("meta")).alias("result")))
    failure = lambda code, why: F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("id"), F.struct(F.lit(code).alias("code"), why.alias("message")).alias("error")))
    response = (
        F.when(F.col("method") != "tools/call", failure(UNKNOWN_METHOD, F.concat(F.lit("unknown method: "), F.col("method"))))
        .when(~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False)), failure(BAD_PARAMS, F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit("")))))
        .when(F.col("text").isNull(), failure(BAD_PARAMS, F.lit("missing argument: text")))
        .when(F.col("__asked").isNotNull() & F.col("__forced").isNull(), failure(BAD_PARAMS, F.concat(F.lit("unknown content type: "), F.col("__asked"))))
        .when(F.col("tool") == "count_tokens", result(F.concat(F.col("tokens_before").cast("string"), F.lit(" tokens")), F.struct(F.col("tokens_before").alias("tokens"))))
        .when(F.col("error").isNotNull(), failure(INTERNAL, F.col("error")))
        .when((F.col("tool") == "estimate_cost") & (F.size(chosen) == 0), failure(BAD_PARAMS, F.concat(F.lit("no model matches: "), F.col("model"))))
        .when(F.col("tool") == "estimate_cost", result(table, priced))
        .otherwise(result(F.col("condensed"), meta))
    )
    return done.select("id", response.alias("response"))
