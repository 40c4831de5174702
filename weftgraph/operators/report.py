"""Reporting over run logs: scan, pivot, baselines, speed-ups, nested output, parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.scratch import materialize, scratch_path
from weftgraph.sources.text import numbered_lines, write_lines

#: (kind, pattern with a key and a value group); the first that matches a line counts.
RULES = (
    ("start", r"^RUN: (Start)()"),
    ("variable", r"^RUN: Variable (\S+) = (\S+)"),
    ("command", r"^(?:RUN|INFO): (CommandLine) (.*)"),
    ("host", r"^INFO: (Hostname) (.*)"),
    ("single", r"^STAT SINGLE (\S+ \S+) (.*)"),
    ("distribution", r"^STAT DISTRIBUTION (\d+ \S+ \S+) (.*)"),
    ("header", r"^()(STATTYPE.*)"),
    ("stat", r"^()(STAT,.*)"),
)
BLOCK = 1 << 16


def scan(lines: DataFrame) -> DataFrame:
    """(line, kind, key, value) of the lines that a rule matches. The fields of a STAT line are those of
    the last header before it; the statistic of a loop is key-loop, that of one of its instances
    key-loop-number."""
    found = F.coalesce(*(F.when(F.col("value").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("value", p, 1).alias("key"), F.regexp_extract("value", p, 2).alias("value"))) for k, p in RULES))
    rows = lines.select("line", found.alias("f")).filter("f IS NOT NULL").select("line", "f.*")
    own = carried(rows, F.when(F.col("kind") == "header", F.col("value")), "header").filter("kind <> 'header'")
    name, body, part = F.split("header", ","), F.split("value", ","), F.split("key", " ")
    field = lambda f: F.get(body, (F.array_position(name, f) - 1).cast("int"))
    loop = F.when(field("LOOP") != "(NULL)", field("LOOP"))
    key = F.when(F.col("kind") == "stat", F.concat_ws("-", field("CATEGORY"), loop)).when(F.col("kind") == "single", F.concat_ws("-", part)).when(F.col("kind") == "distribution", F.concat_ws("-", F.get(part, F.lit(1)), F.get(part, F.lit(2)), part[0]))
    value = F.when(F.col("kind") == "stat", field("sum")).otherwise(F.col("value"))
    return own.select("line", "kind", F.coalesce(key, "key").alias("key"), value.alias("value"))


def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The rows with the last value that is not null up to their line: within blocks of lines, and over
    the blocks' last ones."""
    own = materialize(rows.withColumn("_v", value).withColumn("_block", F.floor(F.col("line") / BLOCK)), "log")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = own.groupBy("_block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("line"))).alias("_last"))  # a row a block
    base = lasts.select("_block", F.last("_last", ignorenulls=True).over(before).alias("_base"))
    within = F.last("_v", ignorenulls=True).over(Window.partitionBy("_block").orderBy("line"))
    return own.withColumn("_in", within).join(base, "_block").withColumn(name, F.coalesce("_in", "_base")).drop("_v", "_block", "_in", "_base")


def with_run(rows: DataFrame) -> DataFrame:
    """The rows with ``run``: how many starts there have been up to the line, from 1. Counted within
    blocks of lines, and over the blocks' sums."""
    own = materialize(rows.withColumn("block", F.floor(F.col("line") / BLOCK)), "log")
    start = F.when(F.col("kind") == "start", 1).otherwise(0)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("block").agg(F.sum(start).alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a block
    within = F.sum(start).over(Window.partitionBy("block").orderBy("line"))
    return own.withColumn("within", within).join(base, "block").withColumn("run", F.col("base") + F.col("within")).drop("block", "base", "within")


def pivot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a run: numbers of a key are added up, of other values the last stays."""
    own = rows.filter((F.col("kind") != "start") & (F.col("run") > 0))
    number = F.when(F.col("value").rlike(r"^-?\d+(\.\d+)?$") & (F.col("key") != "Threads"), F.col("value").cast("double"))
    each = own.groupBy("run", "key").agg(F.sum(number).alias("total"), F.max_by("value", "line").alias("last"))
    each = each.select("run", "key", F.coalesce(F.col("total").cast("string"), "last").alias("v"))
    return each.groupBy("run").pivot("key", keys).agg(F.first("v"))


def project(df: DataFrame, include: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """Columns to keep (all if not given) without those excluded, sorted by name."""
    return df.select(*sorted(c for c in df.columns if (include is None or c in include) and c not in exclude))


def finished(df: DataFrame, timeout: float | None = None) -> DataFrame:
    """Runs with a command line and a time; a run that timed out has the time-out as its time."""
    time = F.col("Time").cast("double")
    out = df.filter("coalesce(CommandLine, '') <> ''").withColumn("Time", time if timeout is None else F.coalesce(time, F.when(F.col("Timeout").isNotNull(), F.lit(timeout))))
    return out.filter("Time IS NOT NULL")


def named(df: DataFrame) -> DataFrame:
    """(.., Algo, Kind): the program's name and the variant its options tell; a variant that two
    command lines share is made unique by its place in their order."""
    algo = F.regexp_extract("CommandLine", r"^(?:.*/)?(\w+)", 1)
    kind = F.coalesce(F.nullif(F.regexp_extract("CommandLine", r"-algo[= ](\w+)", 1), F.lit("")), F.nullif(F.regexp_extract("CommandLine", r"-(\w+)$", 1), F.lit("")), F.lit("default"))
    lines = df.select("CommandLine").distinct().withColumns({"Algo": algo, "Kind": kind})
    place = F.row_number().over(Window.partitionBy("Algo", "Kind").orderBy("CommandLine"))
    unique = lines.withColumn("Kind", F.when(place > 1, F.concat("Kind", F.lit("."), place)).otherwise(F.col("Kind")))
    return df.join(unique, "CommandLine")


def numeric(df: DataFrame, ids: list[str], drop: str) -> DataFrame:
    """Id columns, and numeric columns whose name does not match the pattern."""
    import re

    kinds = ("bigint", "int", "double", "float", "smallint", "tinyint")
    return df.select(*ids, *(c for c, t in df.dtypes if c not in ids and (t in kinds or t.startswith("decimal")) and not re.search(drop, c)))


def melt(df: DataFrame, ids: list[str], values: list[str], by: str, levels: list, agg=F.avg) -> DataFrame:
    """The values long, then wide again by the levels of ``by``, aggregated, and joined back."""
    long = df.unpivot([*ids, by], [F.col(v).cast("double").alias(v) for v in values], "variable", "value")
    wide = long.withColumn("cell", F.concat_ws(".", "variable", F.col(by).cast("string"))).groupBy(*ids).pivot("cell", [f"{v}.{k}" for v in values for k in levels]).agg(agg("value"))
    return df.join(wide, ids, "left")


def baseline(df: DataFrame, time: str = "Time") -> DataFrame:
    """Each configuration with Ref, the least time on one thread, and Mean, its own mean time."""
    ref = df.filter("Threads = 1").groupBy("Algo", "Hostname").agg(F.min(time).alias("Ref"))
    mean = df.groupBy("Algo", "Hostname", "Threads").agg(F.avg(time).alias("Mean"))
    return mean.join(ref, ["Algo", "Hostname"], "left")


def speedup(df: DataFrame) -> DataFrame:
    return df.withColumns({"Speedup": F.col("Ref") / F.nullif("Mean", F.lit(0.0)), "Seconds": F.col("Mean") / 1000})


def nested(df: DataFrame, ids: list[str], order: str, *values: str) -> DataFrame:
    """One JSON text for each combination of ids: the rows in the order of a column."""
    rows = F.sort_array(F.collect_list(F.struct(order, *values)))
    return df.groupBy(*ids).agg(rows.alias("data")).select(*ids, F.to_json(F.struct(*ids, "data")).alias("json"))


def number_range(texts: Column) -> Column:
    """Sorted distinct numbers of ``a``, ``a:b`` and ``a:b:step`` joined by commas."""

    def one(text: Column) -> Column:
        p = F.transform(F.split(text, ":"), lambda x: F.trim(x).cast("int"))
        return F.sequence(p[0], F.coalesce(F.get(p, F.lit(1)), p[0]), F.coalesce(F.get(p, F.lit(2)), F.lit(1)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(texts, ","), one))))


def grid(spark: SparkSession, **ranges: str) -> DataFrame:
    """The product of parameter ranges, one row a run; the ranges are what was typed in."""
    out = spark.range(1).drop("id")
    for name, text in ranges.items():
        out = out.crossJoin(spark.range(1).select(F.explode(number_range(F.lit(text))).alias(name)))
    return out


def _log(spark, sf_dir) -> DataFrame:
    """A log with eleven lines a run, a run an event, in a file."""
    own = spark.read.parquet(f"{sf_dir}/events.parquet")
    program = F.concat(F.lit("./bin/"), F.col("event_type"), F.lit(" -algo="), F.element_at(F.array(F.lit("sync"), F.lit("async")), (F.col("user_id") % 2 + 1).cast("int")))
    swapped = F.col("event_id") % 3 == 0  # headers with another order of the fields

    def stat(loop: str, key: str, value: Column) -> Column:
        return F.when(swapped, F.concat_ws(",", F.lit("STAT"), F.lit(key), F.lit(loop), value, F.lit(1), value)).otherwise(F.concat_ws(",", F.lit("STAT"), F.lit(loop), F.lit(key), F.lit(1), value, value))

    made = F.array(
        F.lit("RUN: Start"),
        F.concat(F.lit("INFO: CommandLine "), program),
        F.concat(F.lit("INFO: Hostname h"), F.col("user_id") % 3),
        F.concat(F.lit("RUN: Variable Threads = "), F.col("user_id") % 4 + 1),
        F.lit("noise that no rule knows"),
        F.when(swapped, F.lit("STATTYPE,CATEGORY,LOOP,sum,n,T0")).otherwise(F.lit("STATTYPE,LOOP,CATEGORY,n,sum,T0")),
        stat("(NULL)", "Time", F.floor(F.col("value") * 100)),
        stat("main", "Iterations", F.col("event_id") % 10),
        stat("main", "Iterations", F.col("event_id") % 3),
        F.concat(F.lit("STAT SINGLE Conflicts main "), F.col("event_id") % 7),
        F.concat(F.lit("STAT DISTRIBUTION "), F.col("event_id") % 2, F.lit(" Steps main "), F.col("event_id") % 5),
    )
    path = scratch_path(spark, "log")
    write_lines(own.select("event_id", F.posexplode(made).alias("k", "value")), path, "event_id", "k")
    return numbered_lines(spark, path)


KEYS = ["CommandLine", "Conflicts-main", "Hostname", "Iterations-main", "Threads", "Time"]


def _runs(spark, sf_dir) -> DataFrame:
    return pivot(with_run(scan(_log(spark, sf_dir))), KEYS)


def _table(spark, sf_dir) -> DataFrame:
    own = named(finished(_runs(spark, sf_dir))).withColumns({"Threads": F.col("Threads").cast("int"), "Iterations": F.col("Iterations-main").cast("double")})
    return own.select("run", "Algo", "Kind", "Hostname", "Threads", "Time", "Iterations")


def _q_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    project(_table(spark, sf_dir)).write.option("header", True).csv(path)
    return spark.read.option("header", True).csv(path, schema="Algo string, Hostname string, Iterations double, Kind string, Threads int, Time double, run long")


def _q_melt(spark, sf_dir):
    own = melt(_table(spark, sf_dir).select("Algo", "Hostname", "Threads", "Time"), ["Algo", "Hostname"], ["Time"], "Threads", [1, 2], F.max)
    return own.select("Algo", "Hostname", "Threads", "Time", F.col("`Time.1`").alias("t1"), F.col("`Time.2`").alias("t2"))


def _q_range(spark, sf_dir):
    return spark.range(1).select(F.explode(number_range(F.lit("1:4,2,8:20:4,16"))).alias("n"))


QUERIES = {
    "rep_scan": lambda s, d: scan(_log(s, d)).groupBy("kind", "key").agg(F.count("*").alias("n"), F.sum(F.try_to_number("value", F.lit("999999999")).cast("long")).alias("total")),
    "rep_pivot": lambda s, d: _runs(s, d).select("run", *(F.col(f"`{k}`").alias(k.replace("-", "_")) for k in KEYS)),
    "rep_project": lambda s, d: project(_table(s, d), ["run", "Algo", "Time", "Threads"], ["Threads"]),
    "rep_csv": _q_csv,
    "rep_filter": lambda s, d: finished(_runs(s, d)).agg(F.count("*").alias("n"), F.sum(F.col("Time").cast("long")).alias("total")),
    "rep_regex": lambda s, d: _table(s, d).groupBy("Algo", "Kind").agg(F.count("*").alias("n")),
    "rep_numeric": lambda s, d: numeric(_table(s, d), ["run"], "^Iter"),
    "rep_melt": _q_melt,
    "rep_fillna": lambda s, d: _q_melt(s, d).withColumn("t1", F.when(F.col("Hostname") != "h1", F.col("t1"))).fillna(0),
    "rep_baseline": lambda s, d: baseline(_table(s, d)).select("Algo", "Hostname", "Threads", F.round("Mean", 6).alias("Mean"), "Ref"),
    "rep_speedup": lambda s, d: speedup(baseline(_table(s, d))).select("Algo", "Hostname", "Threads", F.round("Speedup", 9).alias("Speedup"), F.round("Seconds", 9).alias("Seconds")),
    "rep_json": lambda s, d: nested(_table(s, d).groupBy("Algo", "Threads").agg(F.count("*").alias("n")), ["Algo"], "Threads", "n"),
    "rep_plot": lambda s, d: _table(s, d).groupBy("Threads").agg(F.sum(F.col("Time").cast("long")).alias("total"), F.count("Time").alias("n")),
    "rep_range": _q_range,
    "rep_product": lambda s, d: grid(s, threads="1:8", delta="0:10:5", seed="1"),
}
_T = """t AS (SELECT row_number() OVER (ORDER BY event_id) AS run, event_type AS Algo, CASE user_id % 2 WHEN 0 THEN 'sync' ELSE 'async' END AS Kind,
  'h' || user_id % 3 AS Hostname, CAST(user_id % 4 + 1 AS INTEGER) AS Threads, CAST(floor(value * 100) AS DOUBLE) AS Time, CAST(event_id % 10 + event_id % 3 AS DOUBLE) AS Iterations, event_id % 7 AS Conflicts FROM events)"""
_M = "m AS (SELECT Algo, Hostname, max(Time) FILTER (Threads = 1) AS t1, max(Time) FILTER (Threads = 2) AS t2 FROM t GROUP BY 1, 2)"
_B = "r AS (SELECT Algo, Hostname, min(Time) AS Ref FROM t WHERE Threads = 1 GROUP BY 1, 2), b AS (SELECT Algo, Hostname, Threads, avg(Time) AS Mean, Ref FROM t LEFT JOIN r USING (Algo, Hostname) GROUP BY 1, 2, 3, Ref)"
ORACLES = {
    "rep_scan": """WITH x AS (SELECT 'start' AS kind, 'Start' AS key, NULL::BIGINT AS v FROM events UNION ALL SELECT 'command', 'CommandLine', NULL FROM events UNION ALL SELECT 'host', 'Hostname', NULL FROM events
UNION ALL SELECT 'variable', 'Threads', user_id % 4 + 1 FROM events UNION ALL SELECT 'stat', 'Time', CAST(floor(value * 100) AS BIGINT) FROM events UNION ALL SELECT 'stat', 'Iterations-main', event_id % 10 FROM events
UNION ALL SELECT 'stat', 'Iterations-main', event_id % 3 FROM events UNION ALL SELECT 'single', 'Conflicts-main', event_id % 7 FROM events UNION ALL SELECT 'distribution', 'Steps-main-' || event_id % 2, event_id % 5 FROM events)
SELECT kind, key, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM x GROUP BY 1, 2""",
    "rep_pivot": f"""WITH {_T} SELECT run, './bin/' || Algo || ' -algo=' || Kind AS CommandLine, CAST(CAST(Conflicts AS DOUBLE) AS VARCHAR) AS Conflicts_main, Hostname, CAST(Iterations AS VARCHAR) AS Iterations_main,
  CAST(Threads AS VARCHAR) AS Threads, CAST(Time AS VARCHAR) AS Time FROM t""",
    "rep_project": f"WITH {_T} SELECT Algo, Time, run FROM t",
    "rep_csv": f"WITH {_T} SELECT Algo, Hostname, Iterations, Kind, Threads, Time, run FROM t",
    "rep_filter": f"WITH {_T} SELECT count(*) AS n, CAST(sum(CAST(Time AS BIGINT)) AS BIGINT) AS total FROM t",
    "rep_regex": f"WITH {_T} SELECT Algo, Kind, count(*) AS n FROM t GROUP BY 1, 2",
    "rep_numeric": f"WITH {_T} SELECT run, Threads, Time FROM t",
    "rep_melt": f"WITH {_T}, {_M} SELECT Algo, Hostname, Threads, Time, t1, t2 FROM t LEFT JOIN m USING (Algo, Hostname)",
    "rep_fillna": f"WITH {_T}, {_M} SELECT Algo, Hostname, Threads, Time, CASE WHEN Hostname <> 'h1' THEN coalesce(t1, 0) ELSE 0 END AS t1, coalesce(t2, 0) AS t2 FROM t LEFT JOIN m USING (Algo, Hostname)",
    "rep_baseline": f"WITH {_T}, {_B} SELECT Algo, Hostname, Threads, round(Mean, 6) AS Mean, Ref FROM b",
    "rep_speedup": f"WITH {_T}, {_B} SELECT Algo, Hostname, Threads, round(Ref / nullif(Mean, 0), 9) AS Speedup, round(Mean / 1000, 9) AS Seconds FROM b",
    "rep_json": f"""WITH {_T}, c AS (SELECT Algo, Threads, count(*) AS n FROM t GROUP BY 1, 2)
SELECT Algo, '{{"Algo":"' || Algo || '","data":[' || string_agg('{{"Threads":' || Threads || ',"n":' || n || '}}', ',' ORDER BY Threads) || ']}}' AS json FROM c GROUP BY 1""",
    "rep_plot": f"WITH {_T} SELECT Threads, CAST(sum(CAST(Time AS BIGINT)) AS BIGINT) AS total, count(Time) AS n FROM t GROUP BY 1",
    "rep_range": "SELECT CAST(x AS INTEGER) AS n FROM (VALUES (1), (2), (3), (4), (8), (12), (16), (20)) v(x)",
    "rep_product": "SELECT CAST(t AS INTEGER) AS threads, CAST(d AS INTEGER) AS delta, 1 AS seed FROM range(1, 9) a(t), (VALUES (0), (5), (10)) b(d)",
}
