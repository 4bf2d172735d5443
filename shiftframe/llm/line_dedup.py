"""Line dedup by overlapping three-line windows, in DataFrame functions alone.

A document's lines are its text cut at line feeds. Every run of `window` consecutive lines is hashed (two 64-bit hashes
with different salts). Of equal windows, the one that comes first by (id, text hash, position) stays and all later
ones are removed: each covers its lines, overlapping covers merge into runs, and the lines between the runs remain.
Windows are judged on the input, not on what is left.

Null texts stay null with zero lines; empty texts have one empty line; documents with fewer lines than a window are
left as they are. Rows equal in id and text count as one document and get the same result; rows that share an id with
different texts are told apart by the text's hash; a null id sorts first. Empty tables give empty results. All other
columns are carried along; columns named n_lines or n_removed are replaced, unless counts=False. A text that loses every line is empty.

A window in a third of all rows is one row for each task before the shuffle of the aggregate; the join back to the
windows reads a written table, so that AQE can split a hot window's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(id, th, pos, h1, h2) of each window of consecutive lines."""
    lines = rows.select("id", "th", F.split("text", "\n").alias("lines")).where(F.size("lines") >= window)

    def hashed(at: Column) -> Column:
        own = [F.col("lines")[at + k] for k in range(window)]
        return F.struct(at.alias("pos"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(0x5EED), *reversed(own)).alias("h2"))

    each = F.transform(F.sequence(F.lit(0), F.size("lines") - window), hashed)
    return lines.select("id", "th", F.explode(each).alias("w")).select("id", "th", "w.*")


def _kept(lines: Column, later: Column, window: int) -> Column:
    """The lines outside the merged covers of the windows that start at the sorted positions `later`."""
    starts = F.filter(later, lambda x, i: (i == 0) | (x - later[i - 1] > window))
    last = F.filter(later, lambda x, i: (i == F.size(later) - 1) | (later[i + 1] - x > window))
    gap = lambda i: (  # noqa: E731  lines between the covers i - 1 and i
        F.when(i == 0, F.lit(0)).otherwise(last[i - 1] + window),
        F.when(i == F.size(starts), F.size(lines)).otherwise(starts[i]),
    )
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), lambda i: F.slice(lines, gap(i)[0] + 1, F.greatest(gap(i)[1] - gap(i)[0], F.lit(0)))))


def line_dedup(docs: DataFrame, *, window: int = 3, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with repeated windows of lines removed from the text, plus n_lines and n_removed (not with counts=False)."""
    if window < 1:
        raise ValueError("window must be at least 1")
    row = F.struct(*[docs[x] for x in docs.columns])
    rows = docs.select(row.alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("th", F.xxhash64("text"))
    windows = _windows(rows, window)
    where = F.struct("id", "th", "pos")
    firsts = windows.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts, _ = c.saved(firsts, "line-windows")
    later = windows.join(firsts, ["h1", "h2"]).where(~where.eqNullSafe(F.col("first")))
    removed = later.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("later"))
    at = rows.alias("a").join(removed.alias("b"), F.expr("a.id <=> b.id AND a.th = b.th"), "left").select("a.row", "a.text", "b.later")
    at = at.withColumn("lines", F.when(F.col("text").isNotNull(), F.split("text", "\n")))
    at = at.withColumn("kept", F.when(F.col("later").isNotNull(), _kept(F.col("lines"), F.col("later"), window)))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    left = F.when(F.col("kept").isNull(), n).otherwise(F.size("kept")).cast("long")
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    out = [text.alias(x) if x == text_col else F.col(f"row.`{x}`").alias(x) for x in docs.columns if not counts or x not in ("n_lines", "n_removed")]
    return at.select(*out, n.alias("n_lines"), (n - left).alias("n_removed")) if counts else at.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(c.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(len(l) - 2)) AS pos FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY l[pos + 1], l[pos + 2], l[pos + 3] ORDER BY doc_id, pos) AS nth FROM p),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM w, range(3) t(k) WHERE nth > 1),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
kept AS (SELECT a.doc_id, string_agg(line, chr(10) ORDER BY a.pos) AS text, count(*) AS n
         FROM lines a ANTI JOIN covered b ON a.doc_id = b.doc_id AND a.pos = b.pos GROUP BY 1)
SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, (coalesce(len(d.l), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
