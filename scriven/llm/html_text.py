"""Main text of web pages by line-block distribution.

Markup is stripped: comments, scripts and styles with their contents, then tags.  Tags of
paragraphs and the like end a line, tags of sections (article, nav, footer ...) end ``WINDOW``
lines, so that sections lie apart.  The length of a line is its characters that aren't white
space; the block of a line is the length of it and the ``WINDOW`` - 1 lines after it.  Text begins
where a block surges to ``SURGE`` (or the page's greatest block, if that is less) and ends
where a block dives to zero; the lines between are kept.

Rows: page_id, text (the non-empty kept lines), n_lines (how many), surge_line and dive_line
(the first and last of them, counted from 0 over all lines).

Cases.  Null html gives null text and counts; a page without text gives an empty text, no
lines and null places.  Comments, scripts and styles that aren't closed reach to the end of
the page.  Rows with a null page_id and repeated rows are treated like others; other columns
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import table

WINDOW = 3
SURGE = 86
_DROP = [r"<!--.*?(-->|\z)", r"<script\b.*?(</script[ \t\r\n]*>|\z)", r"<style\b.*?(</style[ \t\r\n]*>|\z)"]
_REST = r"""[^<>"']*("[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>"""
_SECTION = r"</?(article|aside|body|footer|form|head|header|html|main|nav|section|title)\b" + _REST
_LINE = r"</?(address|blockquote|br|center|dd|div|dl|dt|fieldset|figcaption|figure|h[1-6]|hr|li|ol|option|p|pre|table|tbody|td|tfoot|th|thead|tr|ul)\b" + _REST
_TAG = r"<[a-z/!?]" + _REST
_BLANKS = r"[ \t\r\f\v]+"
_py = lambda p: re.compile(p.replace(r"\z", r"\Z"), re.I | re.S)
_drop, _section, _line, _tag, _blanks = [_py(p) for p in _DROP], _py(_SECTION), _py(_LINE), _py(_TAG), re.compile(_BLANKS)


def lines_of(page: str) -> list[str]:
    """Lines of text of a page, with blank ones."""
    for p in _drop:
        page = p.sub("", page)
    page = _tag.sub("", _line.sub("\n", _section.sub("\n" * WINDOW, page)))
    page = entities.unescape(page).replace(" ", " ")
    return [x.strip(" ") for x in _blanks.sub(" ", page).split("\n")]


def kept(length: np.ndarray, bound: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Which lines lie between a surge and the next dive, for the lines of many pages."""
    if not len(length):
        return np.zeros(0, bool)
    total = np.concatenate(([0], np.cumsum(length)))
    end = np.repeat(bound[1:], np.diff(bound))
    at = np.arange(len(length))
    block = total[np.minimum(at + window, end)] - total[at]
    page = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    most = np.zeros(len(bound) - 1, np.int64)
    np.maximum.at(most, page, block)
    up = (block >= np.minimum(surge, most)[page]) & (block > 0)
    change = up | (block == 0)
    change[bound[:-1][np.diff(bound) > 0]] = True  # a page begins outside of text
    last = np.maximum.accumulate(np.where(change, at, 0))
    return up[last]


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """(page_id, text, n_lines, surge_line, dive_line) of each page; see the module's text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pages in tc.batches(it, "html"):
            lines = [lines_of(p) if p is not None else [] for p in pages]
            bound = np.concatenate(([0], np.cumsum([len(x) for x in lines])))
            length = np.array([len(x) - x.count(" ") for page in lines for x in page], np.int64)
            keep = kept(length, bound, window, surge) & (length > 0)
            out: list[list] = [[], [], [], []]
            for i, page in enumerate(lines):
                own = np.flatnonzero(keep[bound[i] : bound[i + 1]])
                null = pages[i] is None
                out[0].append(None if null else "\n".join(page[k] for k in own))
                out[1].append(None if null else len(own))
                out[2].append(int(own[0]) if len(own) else None)
                out[3].append(int(own[-1]) if len(own) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.string()), *(pa.array(x, pa.int32()) for x in out[1:])], ["page_id", "text", "n_lines", "surge_line", "dive_line"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, text string, n_lines int, surge_line int, dive_line int")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def _sql(name: str) -> str:
    q = lambda p: p.replace("'", "''")
    text = "html"
    for p in _DROP:
        text = f"regexp_replace({text}, '{q(p)}', '', 'gis')"
    text = f"regexp_replace({text}, '{q(_SECTION)}', repeat(chr(10), {WINDOW}), 'gis')"
    text = f"regexp_replace({text}, '{q(_LINE)}', chr(10), 'gis')"
    text = f"regexp_replace({text}, '{q(_TAG)}', '', 'gis')"
    for a, b in (("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&quot;", "'\"'"), ("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        text = f"regexp_replace({text}, '{a}?', {b}, 'g')"
    return rf"""
WITH page AS (SELECT row_number() OVER () AS r, page_id, string_split(regexp_replace(replace({text}, chr(160), ' '), '{_BLANKS}', ' ', 'g'), chr(10)) AS lines FROM {name}),
line AS (SELECT r, page_id, trim(unnest(lines), ' ') AS line, generate_subscripts(lines, 1) - 1 AS i FROM page),
block AS (SELECT *, length(replace(line, ' ', '')) AS n, sum(length(replace(line, ' ', ''))) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS b FROM line),
edge AS (SELECT *, least({SURGE}, max(b) OVER (PARTITION BY r)) AS top FROM block),
state AS (SELECT *, last_value(CASE WHEN b = 0 THEN 0 WHEN b >= top THEN 1 END IGNORE NULLS) OVER (PARTITION BY r ORDER BY i) AS inside FROM edge),
kept AS (SELECT * FROM state WHERE inside = 1 AND n > 0)
SELECT any_value(p.page_id) AS page_id, coalesce(string_agg(k.line, chr(10) ORDER BY k.i), '') AS text, count(k.i) AS n_lines, min(k.i) AS surge_line, max(k.i) AS dive_line
FROM page p LEFT JOIN kept k ON p.r = k.r GROUP BY p.r
"""


SQL = _sql("pages")
