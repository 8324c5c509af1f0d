"""The queries of the library over the test tables, and the same in DuckDB SQL.

Inputs that the tables lack (logs, diffs, source code) are made from rows, alike in both; where
the rule itself is beyond SQL, the SQL writes down the result that such an input must have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import formats, lexers, neardup, stubs
from ..functions import lines as L
from ..functions.tokens import approximate, bpe_counter, saved_pct
from ..operators import bundle, similar
from ..operators.cache import ResultCache
from ..operators.condense import condense
from ..sources import payloads, scan
from ..sources.scratch import scratch
from . import ledger, reports, samples
from .options import Options

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- pieces of SQL

_WS = f"'{L.WHITE}'"


def _lines(x: str) -> str:
    return f"list_transform(CASE WHEN {x} = '' OR ends_with({x}, chr(10)) THEN string_split({x}, chr(10))[:-2] ELSE string_split({x}, chr(10)) END, lambda l: CASE WHEN ends_with(l, chr(13)) THEN l[:-2] ELSE l END)"


def _exploded(columns: str, source: str, text: str) -> str:
    return f"SELECT {columns}, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT *, {_lines(text)} AS ls FROM {source})"


def _collapsed(columns: str, source: str, text: str, alias: str = "condensed") -> str:
    blank = f"list_transform({_lines(text)}, lambda x: CASE WHEN trim(x, {_WS}) = '' THEN '' ELSE x END)"
    return f"""SELECT {columns}, array_to_string(CASE WHEN len(k) > 0 AND k[-1] = '' THEN k[:-2] ELSE k END, chr(10)) AS {alias} FROM (
  SELECT *, list_filter(list_transform(range(1, len(b) + 1), lambda i: CASE WHEN b[i] <> '' OR (i > 1 AND b[i - 1] <> '') THEN b[i] END), lambda x: x IS NOT NULL) AS k
  FROM (SELECT *, {blank} AS b FROM {source}))"""


def _tokens(x: str) -> str:
    return f"CAST((length({x}) + 3) // 4 AS BIGINT)"


def _template(x: str) -> str:
    stamps = formats.TEMPLATES[0][0]
    uuid = formats.TEMPLATES[1][0]
    x = f"regexp_replace({x}, '{stamps}', '<ts>', 'g')"
    x = f"regexp_replace({x}, '{uuid}', '<uuid>', 'g')"
    x = rf"regexp_replace({x}, '\b[0-9a-fA-F]{{8,}}\b', '<hex>', 'g')"
    return rf"regexp_replace({x}, '\b[0-9]{{4,}}\b', '<n>', 'g')"


_DEDUP = f"""
ex AS ({_exploded("doc_id, source, lang, text", "documents", "text")}),
ky AS (SELECT *, lower(trim(line, {_WS})) AS k FROM ex),
mk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS nth, lag(k) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ky),
kept AS (SELECT doc_id, string_agg(CASE WHEN k = '' THEN '' ELSE line END, chr(10) ORDER BY pos) AS condensed FROM mk
  WHERE (k <> '' AND nth = 1) OR (k = '' AND (before IS NULL OR before <> '')) GROUP BY doc_id),
done AS (SELECT d.doc_id, d.source, d.lang, d.text, coalesce(condensed, '') AS condensed FROM documents d LEFT JOIN kept USING (doc_id)),
facts AS (SELECT *, {_tokens("text")} AS tokens_before, {_tokens("condensed")} AS tokens_after FROM done)"""
_PCT = "CASE WHEN tokens_before <= 0 THEN CAST(0 AS DOUBLE) ELSE greatest(tokens_before - tokens_after, 0) / tokens_before * 100 END AS saved_pct"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings of line deduplication of each document."""
    docs = _table(spark, sf_dir, "documents").withColumn("condensed", formats.text_dedup(F.col("text")))
    return docs.select("doc_id", "source", "lang", approximate(F.col("text")).alias("tokens_before"), approximate(F.col("condensed")).alias("tokens_after"))


# ---------------------------------------------------------------- text, types, formats


@query(f"WITH {_DEDUP} SELECT doc_id, condensed FROM facts")
def text_dedup_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", formats.text_dedup(F.col("text")).alias("condensed"))


_SUMS = "count(*) AS documents, CAST(sum(tokens_before) AS BIGINT) AS tokens_before, CAST(sum(tokens_after) AS BIGINT) AS tokens_after"


@query(f"WITH {_DEDUP} SELECT *, {_PCT} FROM (SELECT source, {_SUMS} FROM facts GROUP BY source)")
def text_savings_by_source(spark, sf_dir):
    sums = _facts(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))
    return sums.withColumn("saved_pct", saved_pct(F.col("tokens_before"), F.col("tokens_after")))


@query(f"WITH {_DEDUP} SELECT lang AS language, CAST(grouping(lang) AS INTEGER) AS is_total, {_SUMS}, CAST(greatest(sum(tokens_before) - sum(tokens_after), 0) AS BIGINT) AS saved, "
       "CAST(greatest(sum(tokens_before) - sum(tokens_after), 0) AS DOUBLE) / sum(tokens_before) * 100 AS saved_pct FROM facts GROUP BY ROLLUP (lang)")  # fmt: skip
def savings_by_language(spark, sf_dir):
    return reports.by_label(_facts(spark, sf_dir).withColumnRenamed("lang", "language"))


@query(f"WITH {_DEDUP}, per AS (SELECT lang AS language, {_SUMS} FROM facts GROUP BY lang), s AS (SELECT *, greatest(tokens_before - tokens_after, 0) AS saved FROM per) "
       "SELECT *, CAST(row_number() OVER (ORDER BY saved DESC, language) AS INTEGER) AS rank, saved / CAST(1000000 AS DOUBLE) * 3 AS saved_usd FROM s")  # fmt: skip
def ranked_languages(spark, sf_dir):
    return reports.ranked(_facts(spark, sf_dir).withColumnRenamed("lang", "language"))


_COSTS = f"""WITH {_DEDUP}, p(ordinal, model, provider, usd_per_mtok) AS (VALUES {reports.price_values()}),
t AS (SELECT CAST(sum(tokens_before) AS BIGINT) AS tokens_before, CAST(sum(tokens_after) AS BIGINT) AS tokens_after FROM facts),
c AS (SELECT *, tokens_before / CAST(1000000 AS DOUBLE) * usd_per_mtok AS cost_before, tokens_after / CAST(1000000 AS DOUBLE) * usd_per_mtok AS cost_after FROM p, t),
costs AS (SELECT *, greatest(cost_before - cost_after, 0) AS cost_saved FROM c)"""


@query(f"{_COSTS} SELECT * FROM costs")
def cost_by_model(spark, sf_dir):
    return reports.cost_by_model(_facts(spark, sf_dir), reports.prices(spark))


@query(f"{_COSTS} SELECT * FROM costs WHERE contains(lower(model), 'gemini')")
def cost_of_chosen_models(spark, sf_dir):
    return reports.cost_by_model(_facts(spark, sf_dir), reports.prices(spark), "Gemini")


@query(f"{_COSTS} SELECT model, provider, cost_saved, cost_saved * 3000 AS monthly_usd FROM costs WHERE cost_saved > 0 ORDER BY cost_saved DESC, ordinal LIMIT 1")
def best_model(spark, sf_dir):
    return reports.best_model(reports.cost_by_model(_facts(spark, sf_dir), reports.prices(spark)))


@query()
def estimate_cost(spark, sf_dir):
    return reports.estimate(_facts(spark, sf_dir), reports.prices(spark))


def _sql_language(x: str) -> str:
    has = lambda words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
    head = f"ltrim({x}, {_WS})"
    whens = [f"WHEN {' OR '.join(f'''starts_with({head}, '{w}')''' for w in D.DOCTYPES)} THEN 'html'", f"WHEN starts_with({x}, '#!/') THEN 'shell'", f"WHEN {' OR '.join(f'''starts_with(upper({head}), '{w}')''' for w in D.VERBS)} THEN 'sql'"]
    whens += [f"WHEN {' AND '.join(has(g) for g in groups)} THEN '{name}'" for name, groups in D.WORDS]
    whens.append("WHEN " + " + ".join(f"CAST(contains({x}, '{w}') AS INTEGER)" for w in D.GENERIC) + " >= 2 THEN 'generic'")
    return f"CASE {' '.join(whens)} END"


_ALL = "SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'events', props FROM events"
_SIGNAL = " OR ".join(f"contains(l, '{s}')" for s in D.SIGNALS)
_DETECT = f"""WITH a AS ({_ALL}),
b AS (SELECT origin, text, {_lines("text")} AS ls, {_sql_language("text")} AS found FROM a),
c AS (SELECT origin, found, CASE WHEN starts_with(text, 'diff --git') OR starts_with(text, '--- ') OR (contains(text, chr(10) || '+++ ') AND contains(text, chr(10) || '--- ')) THEN 'diff'
  WHEN ltrim(text, {_WS})[1] IN ('{{', '[') AND json_valid(text) THEN 'json'
  WHEN len(ls) >= 3 AND len(list_filter(ls, lambda l: {_SIGNAL})) * 10 > len(ls) * 3 THEN 'logs'
  WHEN found IS NOT NULL THEN 'code' ELSE 'text' END AS content_type FROM b)
SELECT origin, content_type, CASE WHEN content_type = 'code' THEN found END AS language, count(*) AS n FROM c GROUP BY 1, 2, 3"""


@query(_DETECT)
def detect_types(spark, sf_dir):
    parts = [("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text"), ("events", "props")]
    rows = None
    for name, column in parts:
        one = _table(spark, sf_dir, name).select(F.lit(name).alias("origin"), D.by_content(F.col(column)).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("origin", F.col("kind.content_type").alias("content_type"), F.col("kind.language").alias("language")).agg(F.count("*").alias("n"))


@query(_collapsed("page_id", "(SELECT page_id, regexp_replace(html, '<!--(?:[^-]|-[^-]|--[^>])*-->', '', 'g') AS h FROM pages)", "h"))
def html_strip_comments(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", lexers.html(F.col("html")).alias("condensed"))


@query(f"SELECT template, count(*) AS n FROM (SELECT {_template('line')} AS template FROM ({_exploded('doc_id', 'documents', 'text')}) WHERE trim(line, {_WS}) <> '') GROUP BY 1")
def log_templates(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.explode(L.lines(F.col("text"))).alias("line")).where(~L.is_blank(F.col("line")))
    return rows.groupBy(formats.log_template(F.col("line")).alias("template")).agg(F.count("*").alias("n"))


_LOG = "SELECT user_id, event_id AS pos, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' ' || event_type || ' user=' || user_id AS line FROM events"


@query(f"""WITH l AS ({_LOG}), t AS (SELECT user_id, pos, {_template("line")} AS k FROM l), g AS (SELECT user_id, k, count(*) AS n, min(pos) AS first FROM t GROUP BY 1, 2)
SELECT user_id, string_agg(CASE WHEN n > 1 THEN '[×' || n || '] ' || k ELSE k END, chr(10) ORDER BY first) AS condensed FROM g GROUP BY user_id""")
def log_collapse_users(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit(" "), "event_type", F.lit(" user="), F.col("user_id").cast("string"))
    logs = e.select("user_id", "event_id", line.alias("line")).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("rows"))
    return logs.select("user_id", formats.log_collapse(F.array_join(F.transform("rows", lambda x: x["line"]), "\n")).alias("condensed"))


_SIGN = "CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '+' ELSE ' ' END"
_ITEM = "'part ' || l_partkey || ' from ' || l_suppkey"


@query(f"""SELECT l_orderkey, string_agg(line, chr(10) ORDER BY pos, line) AS condensed FROM (
  SELECT l_orderkey, l_linenumber AS pos, {_SIGN} || {_ITEM} AS line FROM lineitem WHERE l_returnflag IN ('R', 'A')
  UNION ALL SELECT DISTINCT l_orderkey, unnest([-3, -2, -1, 0]), unnest(['diff --git a/o b/o', '--- a/o', '+++ b/o', '---']) FROM lineitem) GROUP BY 1""")
def diff_compact(spark, sf_dir):
    sign = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(" ")
    line = F.concat(sign, F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" from "), F.col("l_suppkey").cast("string"))
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("rows"))
    head = F.lit("diff --git a/o b/o\nindex 1..2 100644\n--- a/o\n+++ b/o\n@@ -1,9 +1,9 @@\n")
    return items.select("l_orderkey", formats.diff_compact(F.concat(head, F.array_join(F.transform("rows", lambda x: x["line"]), "\n"))).alias("condensed"))


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS condensed FROM events")
def json_clean_props(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", formats.json_clean(F.col("props")).alias("condensed"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '{"items":[null,"",' || c_nationkey || '],"key":' || c_custkey || '}'
  ELSE '{"box":{"name":"' || c_name || '"},"items":[null,"",' || c_nationkey || '],"key":' || c_custkey || '}' END AS condensed FROM customer""")
def json_clean_nested(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), "c_name", F.lit('"')))
    text = F.concat(F.lit('{ "key": '), key, F.lit(', "none": null, "box": { "name": '), name, F.lit(', "empty": { "list": [ ] } }, "items": [ null, "", '), F.col("c_nationkey").cast("string"), F.lit(" ] }"))
    return _table(spark, sf_dir, "customer").select("c_custkey", formats.json_clean(text).alias("condensed"))


PATTERNS = ["[0-9]+", "https?://[^ ]*", "("]
_STRIPPED = f"""WITH ex AS ({_exploded("doc_id", "documents", "text")}),
s AS (SELECT *, trim(regexp_replace(regexp_replace(line, '[0-9]+', '', 'g'), 'https?://[^ ]*', '', 'g'), {_WS}) AS x FROM ex),
j AS (SELECT doc_id, string_agg(line[:length(line) - length(ltrim(line, {_WS}))] || x, chr(10) ORDER BY pos) AS t FROM s WHERE x <> '' GROUP BY doc_id)
SELECT d.doc_id, coalesce(rtrim(t, {_WS}), '') AS condensed FROM documents d LEFT JOIN j USING (doc_id)"""


@query(_STRIPPED)
def strip_patterns(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", formats.strip_patterns(F.col("text"), PATTERNS).alias("condensed"))


BUDGET = 100


def _sql_notice(budget: int) -> str:
    return "'" + formats.notice(budget).rstrip("\n") + "' || chr(10)"


@query(f"""WITH ex AS ({_exploded("doc_id", "(SELECT * FROM documents WHERE length(text) > " + str(4 * BUDGET) + ")", "text")}),
r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM ex),
k AS (SELECT doc_id, string_agg(line || chr(10), '' ORDER BY pos) FILTER (WHERE used <= {4 * BUDGET}) AS head FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(text) <= {4 * BUDGET} THEN text ELSE coalesce(head, '') || {_sql_notice(BUDGET)} END AS condensed FROM documents d LEFT JOIN k USING (doc_id)""")
def budget_prefix(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", formats.within_budget(F.col("text"), BUDGET).alias("condensed"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("condensed", formats.text_dedup(F.col("text")))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("source", path.alias("path"), "condensed", approximate(F.col("text")).alias("tokens_before"), approximate(F.col("condensed")).alias("tokens_after"))


_FILES = f"{_DEDUP}, files AS (SELECT source, source || '/' || doc_id || '.txt' AS path, condensed, tokens_before, tokens_after FROM facts), ch AS (SELECT *, '// === ' || path || ' ===' || chr(10) || condensed || chr(10) || chr(10) AS chunk FROM files)"


@query(f"WITH {_FILES} SELECT source, string_agg(chunk, '' ORDER BY path) AS bundle, {_SUMS} FROM ch GROUP BY source")
def dir_bundle(spark, sf_dir):
    return bundle.bundle(_files(spark, sf_dir), ["source"])


CORPUS_BUDGET = 20_000


@query(f"""WITH {_FILES}, cl AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT path, {_lines("chunk")} AS ls FROM ch)),
r AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY path, pos) AS used FROM cl)
SELECT path, string_agg(line || chr(10), '' ORDER BY pos) AS chunk FROM r WHERE used <= {4 * CORPUS_BUDGET} GROUP BY path
UNION ALL SELECT NULL, {_sql_notice(CORPUS_BUDGET)} WHERE (SELECT sum(length(chunk)) FROM ch) > {4 * CORPUS_BUDGET}""")
def corpus_budget(spark, sf_dir):
    return bundle.corpus_budget(_files(spark, sf_dir).select("path", "condensed"), CORPUS_BUDGET)


# ---------------------------------------------------------------- near duplicates

_SHINGLES = f"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{L.WHITE_CLASS}+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE w END) AS s FROM w),
h AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(s), 1, 7) AS BIGINT) AS h FROM sh),
sig AS (SELECT doc_id, [{", ".join(f"min((h * {int(a)} + {int(b)}) % {neardup.PRIME})" for a, b in zip(neardup.A, neardup.B))}] AS signature FROM h GROUP BY doc_id)"""


@query(f"WITH {_SHINGLES} SELECT doc_id, signature FROM sig")
def minhash_signatures(spark, sf_dir):
    return similar.signatures(_table(spark, sf_dir, "documents"))


@query(f"""WITH {_SHINGLES}, b AS (SELECT doc_id, i, signature[4 * i + 1 : 4 * i + 4] AS band FROM sig, range(16) t(i)),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.i = y.i AND x.band = y.band AND x.doc_id < y.doc_id),
s AS (SELECT a, b, len(list_filter(range(1, 65), lambda i: x.signature[i] = y.signature[i])) / CAST(64 AS DOUBLE) AS similarity FROM p JOIN sig x ON x.doc_id = a JOIN sig y ON y.doc_id = b)
SELECT a AS doc_id_a, b AS doc_id_b, similarity FROM s WHERE similarity >= {neardup.THRESHOLD}""")
def similar_pairs(spark, sf_dir):
    return similar.pairs(similar.signatures(_table(spark, sf_dir, "documents")))


@query()
def neardup_blocks(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return c.select("conv_id", neardup.drop_near_blocks(F.array_join(F.transform("turns", lambda x: x["text"]), "\n\n")).alias("condensed"))


# ---------------------------------------------------------------- source code


def _code(name: str, source: str, template: str, expected: str, fn: Callable[[Column], Column]) -> None:
    """A query over source text made from rows: {key} and {size} of part; ``expected`` is what must come out."""
    slot = {"{key}": "p_partkey", "{size}": "p_size", "{brand}": "p_brand"}

    def parts(text: str) -> list[str]:
        out, rest = [], text
        while rest:
            at = min((i for i in (rest.find(s) for s in slot) if i >= 0), default=len(rest))
            if at:
                out.append(rest[:at])
            rest = rest[at:]
            for s in slot:
                if rest.startswith(s):
                    out.append(s)
                    rest = rest[len(s) :]
        return out

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.concat(*[F.col(slot[p]).cast("string") if p in slot else F.lit(p) for p in parts(template)])
        return _table(spark, sf_dir, "part").select("p_partkey", fn(text).alias("condensed"))

    run.__name__ = name
    run.__doc__ = source
    query("SELECT p_partkey, " + " || ".join(slot[p] if p in slot else "'" + p.replace("'", "''") + "'" for p in parts(expected)) + " AS condensed FROM part")(run)


_code("strip_cstyle", "C-like comments", '/* {brand}\n\n\n*/\nint part_{key} = {size}; // size\nchar *s = "// {brand} /* kept */";\n', 'int part_{key} = {size}; \nchar *s = "// {brand} /* kept */";', lexers.cstyle)
_code("strip_rust_docs", "Rust doc comments stay", "/// keeps {key}\n// goes\nfn f() -> i32 { {size} }\n", "/// keeps {key}\n\nfn f() -> i32 { {size} }", lambda t: lexers.cstyle(t, "rust"))
_code("strip_css", "CSS comments", "/* {brand} */\n.p{key} { width: {size}px; /* x */ background: url(//cdn/{key}) }\n", ".p{key} { width: {size}px;  background: url(//cdn/{key}) }", lexers.css)
_code("strip_sql", "SQL comments", "-- {brand}\nSELECT '-- kept {key}', {size} /* two\nlines */ FROM part; -- end", "SELECT '-- kept {key}', {size} \n FROM part; ", lexers.sql)
_code("strip_python", "Python comments and docstrings", 'def f{key}():\n    """{brand}."""\n    # note\n    x = "# {size}"  # why\n    return x\n', 'def f{key}():\n\n    x = "# {size}"  \n    return x', lexers.python)
_code("strip_ruby", "Ruby comments", "=begin\n{brand}\n=end\n# note\nx = \"a # {size}\" # why\nputs {key}\n", 'x = "a # {size}"\nputs {key}', lexers.ruby)
_code("strip_shell", "shell comments", "#!/bin/sh\n# {brand}\necho '# {size}' # why\nexit {key}\n", "#!/bin/sh\n\necho '# {size}'\nexit {key}", lexers.shell)
_code("strip_yaml", "YAML comments", "# {brand}\nkey: {key} # why\nurl: a#b\nsize: '# {size}'\n", "key: {key}\nurl: a#b\nsize: '# {size}'", lexers.yaml)
_code("stub_c", "C bodies", "#include <x.h>\nint f{key}(int a) {\n  if (a) { return {size}; }\n  return 0;\n}\nint g;\n", "#include <x.h>\nint f{key}(int a) { /* ... */ }\nint g;\n", lambda t: stubs.stub_bodies(t, "c"))
_code("stub_python", "Python bodies", "import os\n\ndef f{key}(a: int = {size}) -> int:\n    if a:\n        return 1\n    return 2\n\nX = {key}", "import os\n\ndef f{key}(a: int = {size}) -> int:\n    ...\n\nX = {key}", lambda t: stubs.stub_bodies(t, "python"))
_code("stub_ruby", "Ruby bodies", "class A\n  def f{key}(a)\n    if a\n      {size}\n    end\n  end\nend", "class A\n  def f{key}(a)\n    # ...\n  end\nend", lambda t: stubs.stub_bodies(t, "ruby"))
_code("stub_rust", "Rust bodies", "impl P {\n    fn f{key}(&self) -> Vec<u8> {\n        let c = '{'; vec![{size}]\n    }\n}\n", "impl P {\n    fn f{key}(&self) -> Vec<u8> { /* ... */ }\n}\n", lambda t: stubs.stub_bodies(t, "rust"))
_code("stub_typescript", "TypeScript bodies", "export class A {\n  async m{key}(x: number): Promise<void> {\n    await g({size});\n  }\n}\nconst h = (a: string) => {\n  return a;\n};\n", "export class A {\n  async m{key}(x: number): Promise<void> { /* ... */ }\n}\nconst h = (a: string) => { /* ... */ };\n", lambda t: stubs.stub_bodies(t, "typescript"))
_code("stub_java", "Java bodies", "public class A {\n    int x = {size};\n    public A() { x = 1; }\n    int f{key}(int a) throws E {\n        for (;;) { }\n    }\n}\n", "public class A {\n    int x = {size};\n    public A() { /* ... */ }\n    int f{key}(int a) throws E { /* ... */ }\n}\n", lambda t: stubs.stub_bodies(t, "java"))
_code("stub_go", "Go bodies", "package p\n\nfunc (t *T) F{key}(a int) (int, error) {\n\treturn {size}, nil\n}\n", "package p\n\nfunc (t *T) F{key}(a int) (int, error) { /* ... */ }\n", lambda t: stubs.stub_bodies(t, "go"))


# ---------------------------------------------------------------- the whole path


_WHOLE_BUDGET = 4 * 2000


@query(f"""WITH {_DEDUP}, ex2 AS ({_exploded("doc_id", "facts", "condensed")}),
s2 AS (SELECT *, trim(regexp_replace(line, '[0-9]{{12,}}', '', 'g'), {_WS}) AS x FROM ex2),
j2 AS (SELECT doc_id, rtrim(string_agg(line[:length(line) - length(ltrim(line, {_WS}))] || x, chr(10) ORDER BY pos), {_WS}) AS t FROM s2 WHERE x <> '' GROUP BY doc_id),
f2 AS (SELECT d.doc_id, d.text, coalesce(t, '') AS t FROM documents d LEFT JOIN j2 USING (doc_id)),
ex3 AS ({_exploded("doc_id", "(SELECT * FROM f2 WHERE length(t) > " + str(_WHOLE_BUDGET) + ")", "t")}),
r3 AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM ex3),
k3 AS (SELECT doc_id, string_agg(line || chr(10), '' ORDER BY pos) FILTER (WHERE used <= {_WHOLE_BUDGET}) AS head FROM r3 GROUP BY doc_id),
c3 AS (SELECT f2.doc_id, text, CASE WHEN length(t) <= {_WHOLE_BUDGET} THEN t ELSE coalesce(head, '') || {_sql_notice(2000)} END AS condensed FROM f2 LEFT JOIN k3 USING (doc_id))
SELECT doc_id, 'text' AS content_type, CAST(NULL AS VARCHAR) AS language, condensed, {_tokens("text")} AS tokens_before, {_tokens("condensed")} AS tokens_after, CAST(NULL AS VARCHAR) AS error FROM c3""")
def condense_documents(spark, sf_dir):
    """Everything at once; the documents are text without blank lines, so each is one block."""
    done = condense(_table(spark, sf_dir, "documents"), Options(smart=True, patterns=("[0-9]{12,}",), budget=2000))
    return done.select("doc_id", "content_type", "language", "condensed", "tokens_before", "tokens_after", "error")


EXACT = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def condense_exact_budget(spark, sf_dir):
    """Exact tokens of a public vocabulary, and a budget in them."""
    done = condense(_table(spark, sf_dir, "documents"), Options(patterns=("[0-9]{12,}",), budget=300), count=bpe_counter(EXACT))
    return done.select("doc_id", "condensed", "tokens_before", "tokens_after")


_EXT = ", ".join(f"('{e}', '{k}', {'NULL' if x is None else repr(x)})" for e, (k, x) in D.EXTENSIONS.items())


@query(f"""WITH x(ext, content_type, language) AS (VALUES {_EXT}), n AS (SELECT *, row_number() OVER (ORDER BY ext) - 1 AS i, count(*) OVER () AS many FROM x)
SELECT doc_id, content_type, CAST(language AS VARCHAR) AS language, CASE WHEN content_type = 'code' THEN 'code(' || language || ')' ELSE content_type END AS shown, coalesce(language, content_type) AS label
FROM documents JOIN n ON doc_id % many = i""")
def resolve_paths(spark, sf_dir):
    """Types by extension, which come before the content's, and their labels."""
    ext = F.get(F.array(*map(F.lit, sorted(D.EXTENSIONS))), (F.col("doc_id") % len(D.EXTENSIONS)).cast("int"))
    found = _table(spark, sf_dir, "documents").select("doc_id", D.resolve(F.col("text"), F.concat(F.lit("a.b/c."), ext)).alias("k")).select("doc_id", "k.*")
    return found.withColumns({"shown": D.display(F.col("content_type"), F.col("language")), "label": D.label(F.col("content_type"), F.col("language"))})


@query("""SELECT n_nationkey, '{"n_name":"' || n_name || '"}' || chr(10) AS text FROM nation WHERE n_regionkey <> 1""")
def folder_scan(spark, sf_dir):
    """A tree of files written from nation, read back without a folder that a pattern excludes."""
    root = scratch(spark, "tree")
    _table(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey").repartition("n_nationkey").write.partitionBy("n_regionkey", "n_nationkey").json(root)
    files = scan.scan_folder(spark, root, ["n_regionkey=1"])
    return files.select(F.regexp_extract("path", "n_nationkey=([0-9]+)/", 1).cast("int").alias("n_nationkey"), "text")


@query(f"WITH {_DEDUP} SELECT 'text' AS language, 0 AS is_total, {_SUMS}, CAST(greatest(sum(tokens_before) - sum(tokens_after), 0) AS BIGINT) AS saved FROM facts UNION ALL SELECT NULL, 1, {_SUMS}, CAST(greatest(sum(tokens_before) - sum(tokens_after), 0) AS BIGINT) FROM facts")
def ledger_totals(spark, sf_dir):
    """Two runs written to a ledger, one of them again, and its totals."""
    book = ledger.Ledger(spark, scratch(spark, "ledger"))
    docs = _table(spark, sf_dir, "documents")  # each run takes its documents first: no filter passes what isn't deterministic
    book.record(condense(docs.where("doc_id % 2 = 0")), "even")
    for _ in range(2):
        book.record(condense(docs.where("doc_id % 2 <> 0")), "odd")
    return reports.by_label(book.rows()).drop("saved_pct")


@query(f"WITH {_DEDUP} SELECT doc_id, condensed, 'text' AS content_type, tokens_before, tokens_after FROM facts")
def cached_results(spark, sf_dir):
    """The results of a second run, in which all are looked up."""
    kept = ResultCache(spark, scratch(spark, "cache"))
    docs = _table(spark, sf_dir, "documents")
    kept.through(docs)
    return kept.through(docs).select("doc_id", "condensed", "content_type", "tokens_before", "tokens_after")


@query(f"""WITH {_DEDUP}, s AS (SELECT source, {_SUMS} FROM facts GROUP BY source)
SELECT source, format('{{:,}}', tokens_before) || ' → ' || format('{{:,}}', tokens_after) || ' tokens (' || CAST(CAST(round(CASE WHEN tokens_before <= 0 THEN 0 ELSE greatest(tokens_before - tokens_after, 0) / tokens_before * 100 END) AS INTEGER) AS VARCHAR) || '% saved)' AS line FROM s""")
def summary_lines(spark, sf_dir):
    sums = _facts(spark, sf_dir).groupBy("source").agg(F.sum("tokens_before").alias("b"), F.sum("tokens_after").alias("a"))
    return sums.select("source", reports.summary_line(F.col("b"), F.col("a")).alias("line"))


@query()
def sample_report(spark, sf_dir):
    return samples.report(spark)


_ASKS = "conv_id, turn, CASE turn % 3 WHEN 0 THEN 40 WHEN 1 THEN 1000000 END AS budget"


@query(f"""WITH q AS (SELECT {_ASKS}, text FROM conversations), d AS (SELECT *, conv_id || ':' || turn AS id, coalesce(budget, 1000000) * 4 AS room FROM q),
ex AS ({_exploded("id, room, text", "d", "text")}),
mk AS (SELECT *, lower(trim(line, {_WS})) AS k, row_number() OVER (PARTITION BY id, lower(trim(line, {_WS})) ORDER BY pos) AS nth, lag(lower(trim(line, {_WS}))) OVER (PARTITION BY id ORDER BY pos) AS before FROM ex),
kept AS (SELECT id, any_value(room) AS room, string_agg(CASE WHEN k = '' THEN '' ELSE line END, chr(10) ORDER BY pos) AS t FROM mk WHERE (k <> '' AND nth = 1) OR (k = '' AND (before IS NULL OR before <> '')) GROUP BY id),
ex2 AS ({_exploded("id, room, t", "kept", "t")}),
r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY pos) AS used FROM ex2),
h AS (SELECT id, string_agg(line || chr(10), '' ORDER BY pos) FILTER (WHERE used <= room) AS head FROM r GROUP BY id)
SELECT id, CASE WHEN length(t) <= room THEN t ELSE coalesce(head, '') || {_sql_notice(40)} END AS condensed FROM kept JOIN h USING (id)""")
def request_answers(spark, sf_dir):
    """Requests with budgets of their own, as lines, and the texts of the answers."""
    budget = F.when(F.col("turn") % 3 == 0, 40).when(F.col("turn") % 3 == 1, 1_000_000)
    args = F.struct("text", F.lit("text").alias("content_type"), budget.alias("budget"))
    line = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.lit("tools/call").alias("method"), F.struct(F.lit("compress").alias("name"), args.alias("arguments")).alias("params")))
    done = payloads.answers(payloads.requests(_table(spark, sf_dir, "conversations").select(line.alias("value"))))
    return done.select("id", F.get_json_object("response", "$.result.content[0].text").alias("condensed"))


@query()
def payload_responses(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    block = F.struct(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.concat("text", F.lit("\n"), "text").alias("text"))).alias("content")).alias("tool_response"), F.lit("Read").alias("tool_name"), F.lit("PostToolUse").alias("hookEventName"), F.struct(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file_path")).alias("tool_input"))
    return payloads.payload_answers(payloads.payload_documents(c.select(F.to_json(block).alias("payload"))))


@query(f"""WITH f AS (SELECT date_trunc('hour', ts) AS start, event_type AS language, {_tokens("props")} AS tokens_before, {_tokens("json(props)::VARCHAR")} AS tokens_after FROM events)
SELECT start, start + INTERVAL 1 HOUR AS "end", language, {_SUMS} FROM f GROUP BY start, language""")
def savings_by_hour(spark, sf_dir):
    from ..streaming.flows import savings_by_window

    e = _table(spark, sf_dir, "events")
    facts = e.select("ts", F.col("event_type").alias("language"), approximate(F.col("props")).alias("tokens_before"), approximate(formats.json_clean(F.col("props"))).alias("tokens_after"))
    return savings_by_window(facts)
