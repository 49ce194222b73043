"""Row queries over sheets: filter tree, order, paging, projection, and expansions along dependencies.

Sheets are DataFrames of text columns with ``excel_row``.  NULL and '' are the
same to every comparison; comparisons are of text, except for excel_row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import containing
from ..operators.positions import numbers_within, running_sums
from ..session import stored

PAGE = 100  # fixed value: rows of a page at most
GROUPED = 500_000  # rows that one task groups, on average
SLOTS = ("relevance", "constraint", "calculation", "choice_filter")
FULLTEXT = {"survey": ("name", "labels_concat_lower", "hints_concat_lower"), "choices": ("list_name", "value", "labels_concat_lower"), "settings": ("form_title", "form_id")}


def with_virtual(sheet: DataFrame) -> DataFrame:
    """labels_concat_lower and hints_concat_lower: all languages, lower case."""
    cols = sheet.columns
    joined = lambda stem: F.lower(F.concat_ws(" ", *[F.col(f"`{c}`") for c in cols if c == stem or c.startswith(stem + ":")]))
    return sheet.withColumns({"labels_concat_lower": joined("label"), "hints_concat_lower": joined("hint")})


def _text(name: str, known: list[str]) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in known else F.lit("")


def compile_filter(tree: dict, columns: list[str], sheet: str = "survey") -> Column:
    """The filter tree as a predicate. A column the sheet lacks is blank."""
    if len(tree) != 1:
        raise ValueError(f"one operator is wanted: {tree}")
    op, arg = next(iter(tree.items()))
    if op in ("and", "or"):
        parts = [compile_filter(t, columns, sheet) for t in arg]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if op == "and" else (out | p)
        return out
    if op == "not":
        return ~compile_filter(arg[0] if isinstance(arg, list) else arg, columns, sheet)
    if op == "fulltext":
        names, pattern = arg if len(arg) == 2 else (FULLTEXT[sheet], arg[0])
        parts = [F.rlike(_text(n, columns), F.lit(pattern)) for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out
    name = arg[0]
    c = _text(name, columns)
    if op == "eq":
        return c == str(arg[1])
    if op == "in":
        return c.isin([str(v) for v in arg[1]])
    if op == "has":
        return c != ""
    if op == "regex":
        return F.rlike(c, F.lit(arg[1]))
    if op == "between":
        _, lo, hi, *how = arg
        low, high = (how[0], how[1]) if len(how) == 2 else (how[0], how[0]) if how else ("incl", "incl")
        if name == "excel_row":
            c, lo, hi = F.col("excel_row"), int(lo), int(hi)
        return (c >= lo if low.startswith("incl") else c > lo) & (c <= hi if high.startswith("incl") else c < hi)
    raise ValueError(f"unknown operator {op}")


def ordered(sheet: DataFrame, where: dict | None, order_by: list[tuple[str, str]] | None, kind: str = "survey") -> tuple[DataFrame, list[Column]]:
    """The rows that match, and what they are ordered by."""
    rows = with_virtual(sheet)
    known = rows.columns
    if where:
        rows = rows.where(compile_filter(where, known, kind))
    keys = []
    for name, way in order_by or [("excel_row", "asc")]:
        c = F.col("excel_row").cast("bigint") if name == "excel_row" else _text(name, known)
        keys.append(c.desc() if way == "desc" else c.asc())
    return rows, [*keys, F.col("excel_row").asc()]


def projected(sheet: DataFrame, known: list[str], columns: list[str] | None) -> list[Column]:
    """The columns asked for, or the sheet's; those it lacks are blank."""
    return [F.col(f"`{c}`") if c in known else F.lit(None).cast("string").alias(c) for c in columns or sheet.columns]


def query(sheet: DataFrame, where: dict | None = None, order_by: list[tuple[str, str]] | None = None, start: int = 0, limit: int = PAGE, columns: list[str] | None = None, kind: str = "survey") -> DataFrame:
    """A page of rows; its last column more_results says whether rows follow. For pages far in, see ``pages``."""
    if not 0 < limit <= PAGE:
        raise ValueError(f"limit is 1 to {PAGE}")
    rows, keys = ordered(sheet, where, order_by, kind)
    page = rows.orderBy(*keys).offset(start).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*keys))  # over a page
    page = page.withColumn("__n", place).withColumn("more_results", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > limit)
    return page.where(F.col("__n") <= limit).select(*projected(sheet, rows.columns, columns), "more_results")


def non_empty_columns(sheet: DataFrame) -> list[str]:
    """Columns with any content, by one aggregation."""
    counts = sheet.agg(*[F.count_if(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "").alias(str(k)) for k, c in enumerate(sheet.columns)]).first()
    return [c for k, c in enumerate(sheet.columns) if counts[k]]


# ---- groups


def marker_pairs(survey: DataFrame) -> DataFrame:
    """(name, kind, begin_row, end_row) of groups and repeats: a begin pairs with the first later end of its depth.

    Depth is a running sum over all markers.  Between two begins of one depth
    lies an end of it, so the marker after a begin, among those of its depth, is
    its end.  Sum and numbers are taken by ranges of rows.
    """
    kind = F.regexp_replace("type", "_", " ")
    step = F.when(kind.startswith("begin"), 1).when(kind.startswith("end"), -1).otherwise(0)
    marks = survey.where(step != 0).select("excel_row", "name", kind.alias("k"), step.alias("step"))
    summed = running_sums(marks, ["excel_row"], {"open": F.col("step")})
    deep = summed.withColumn("depth", F.when(F.col("step") == 1, F.col("open")).otherwise(F.col("open") + 1))
    numbered = numbers_within(deep, ["depth"], ["excel_row"], "n")
    ends = numbered.where("step = -1").select("depth", (F.col("n") - 1).alias("n"), F.col("excel_row").alias("end_row"))
    begins = numbered.where("step = 1").join(ends, ["depth", "n"], "left")
    return begins.select("name", F.substring("k", 7, 20).alias("kind"), F.col("excel_row").alias("begin_row"), "end_row", "depth")


def row_kind(survey: DataFrame, which: str) -> DataFrame:
    """all, fields, or groups; groups come with the row of their end."""
    marker = F.rlike("type", F.lit(r"^(begin|end)[ _](group|repeat)$"))
    if which == "all":
        return survey
    if which == "fields":
        return survey.where(~F.coalesce(marker, F.lit(False)))
    pairs = marker_pairs(survey).select(F.col("begin_row").alias("excel_row"), F.col("end_row").alias("group_end_excel_row"))
    return survey.join(pairs, "excel_row")


def get_row(survey: DataFrame, excel_row: int) -> DataFrame:
    pairs = marker_pairs(survey).select(F.col("begin_row").alias("excel_row"), F.col("end_row").alias("group_end_excel_row"))
    return survey.where(F.col("excel_row") == excel_row).join(pairs, "excel_row", "left")


def enclosing_groups(survey: DataFrame, seeds: DataFrame) -> DataFrame:
    """(excel_row, group, kind, depth) of the groups around each seed row."""
    around = containing(seeds.select("excel_row"), "excel_row", marker_pairs(survey), "begin_row", "end_row")
    return around.select("excel_row", F.col("name").alias("group"), "kind", "depth")


# ---- dependencies


def refs(survey: DataFrame, slots: tuple[str, ...] = SLOTS) -> DataFrame:
    """(source, target, slot): the fields each row's expressions refer to, once each."""
    have = [s for s in slots if s in survey.columns]
    found = F.array(*[F.struct(F.lit(s).alias("slot"), F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(f"`{s}`"), F.lit("")), F.lit(r"\$\{([^}]+)\}"), F.lit(1))).alias("names")) for s in have])
    rows = survey.select(F.col("name").alias("source"), F.explode(found).alias("x"))
    return rows.select("source", F.explode("x.names").alias("target"), "x.slot").select("source", F.trim("target").alias("target"), "slot")


def group_edges(survey: DataFrame) -> DataFrame:
    """Edges from each field to what its enclosing groups refer to."""
    groups = enclosing_groups(survey, survey).select("excel_row", "group")
    named = survey.select("excel_row", F.col("name").alias("source")).join(groups, "excel_row")
    return named.join(refs(survey).withColumnRenamed("source", "group"), "group").select("source", "target").distinct()


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, row_limit: int | None = None, reverse: bool = False) -> DataFrame:
    """(seed, node, depth): what each seed depends on (or what depends on it), with the least number of steps.

    The frontier is joined with the edges until nothing new is found or
    max_depth is reached; each round is written to the shared folder, which
    cuts its lineage.
    """
    source, target = ("target", "source") if reverse else ("source", "target")
    e = edges.select(F.col(source).alias("node"), F.col(target).alias("next")).distinct()
    found = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    front, depth = found, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = front.join(e, "node").select("seed", F.col("next").alias("node")).distinct()
        new = new.join(found.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        new = stored(new, "closure")
        if new.isEmpty():
            break
        found, front = found.unionByName(new), new
    found = found.where("depth > 0")
    if row_limit is not None:
        found = found.withColumn("__n", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))).where(F.col("__n") <= row_limit).drop("__n")
    return found


def closure_of_all(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth) for every source: the least number of steps to all that it depends on, itself included where it lies on a cycle.

    Once all pairs of up to r steps are known, a pair of r + 1 to 2r steps is one
    of exactly r and one of up to r, for its shortest path has a node r steps in.
    So a chain of d steps takes log2(d) rounds, each path of it is made once, and
    what is known stays as it is. Pairs are grouped by as many tasks as there are
    ``GROUPED`` of them, whatever their bytes.
    """
    known = stored(edges.select(F.col("source").alias("seed"), F.col("target").alias("node")).distinct().withColumn("depth", F.lit(1)), "reach")
    least, reached = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    while max_depth is None or reached < max_depth:
        heads = known.where(F.col("depth") == reached).select("seed", F.col("node").alias("by"))
        if heads.isEmpty():
            break
        tails = known.select(F.col("seed").alias("by"), "node", (F.col("depth") + reached).alias("depth"))
        paths = heads.join(tails, "by").select("seed", "node", "depth")
        if max_depth is not None:
            paths = paths.where(F.col("depth") <= max_depth)
        tasks = max(least, 2 * known.count() // GROUPED)  # known and, where paths meet little, as many new
        both = known.unionByName(paths).repartition(tasks, "seed", "node")
        found = both.groupBy("seed", "node").agg(F.min("depth").alias("depth")).where(F.col("depth") > reached)
        known = known.unionByName(stored(found, "reach"))
        reached *= 2
    return known


def closure_sql(edges_view: str, seeds_view: str, max_depth: int) -> str:
    """The bounded closure as one recursive query."""
    return f"""WITH RECURSIVE reach(seed, node, depth) AS (
        SELECT name, name, 0 FROM {seeds_view}
        UNION ALL SELECT r.seed, e.target, r.depth + 1 FROM reach r JOIN {edges_view} e ON e.source = r.node WHERE r.depth < {int(max_depth)})
      SELECT seed, node, min(depth) AS depth FROM reach WHERE depth > 0 GROUP BY seed, node"""


def expand_choices(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """The choice rows of each select row's list."""
    lists = rows.select("excel_row", F.regexp_extract("type", r"^select_(?:one|multiple)\s+(\S+)", 1).alias("list_name")).where("list_name <> ''")
    return lists.join(choices.withColumnRenamed("excel_row", "choice_row"), "list_name")


def form_summary(survey: DataFrame, choices: DataFrame) -> DataFrame:
    """One row: counts, the next free rows, and how many choice lists there are."""
    kind = F.regexp_replace("type", "_", " ")
    s = survey.agg(
        F.count_if(~kind.rlike("^(begin|end) ")).alias("n_fields"), F.count_if(kind == "begin group").alias("n_groups"), F.count_if(kind == "begin repeat").alias("n_repeats"),
        (F.coalesce(F.max("excel_row"), F.lit(1)) + 1).alias("next_survey_row"),
    )
    c = choices.agg(F.count(F.lit(1)).alias("n_choices"), F.countDistinct("list_name").alias("n_lists"), (F.coalesce(F.max("excel_row"), F.lit(1)) + 1).alias("next_choice_row"))
    return s.join(F.broadcast(c), F.lit(True))


def preview(sheet: DataFrame, kind: str = "survey", n: int = 10) -> DataFrame:
    """The first n rows of a sheet, as a summary shows them: the columns that name a row, and its label."""
    shown = {"survey": ("excel_row", "type", "name", "label"), "choices": ("excel_row", "list_name", "value", "label")}[kind]
    cells = [F.col(c) if c in sheet.columns else F.lit(None).cast("string").alias(c) for c in shown]
    return sheet.orderBy("excel_row").limit(n).select(*cells)
