"""Which files to process in which order, and where each file goes afterwards.

The plans are tables; nothing is moved here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import Sql, extension, is_document, quote, slug, stem
from ledgerloom.operators.ordered import ROWS_PER_TASK, Ordering, with_row_number, with_running_sum


def union_origins(incoming: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents of both folders, marked with where they came from."""
    both = incoming.withColumn("origin", F.lit("incoming")).unionByName(
        processed.withColumn("origin", F.lit("processed")), allowMissingColumns=True)
    return both.filter(is_document("file_name"))


def position(file_name: Sql, origin: Sql, path: Sql) -> Sql:
    """Sortable processing position: by name, incoming files before processed ones."""
    return f"concat_ws('\\0', {file_name}, IF({origin} = 'incoming', '0', '1'), {path})"


def processing_order(files: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Number the files of each week in processing order. `files` has (week_id, seq)."""
    return with_row_number(files, Ordering(("week_id",), ("seq",), rows_per_task), "n")


def _claims(arriving: DataFrame, present: DataFrame, place: list[str]) -> DataFrame:
    """Per place: the first arriving file, and whether something lies there already.

    One table, so that the files need a single join, which the skew join can split
    when many files share a name.
    """
    rows = arriving.selectExpr(*place, "seq", "false AS lies_there").unionByName(
        present.selectExpr(*place, "CAST(NULL AS STRING) AS seq", "true AS lies_there"))
    return rows.groupBy(*place).agg(F.min("seq").alias("__first"),
                                    F.bool_or("lies_there").alias("__taken"))


_NUMBERED = r"(?s)^(.*_.{8})_([0-9]{1,9})(\.[^.]*)?$"  # a name with a piece of the hash and a number
_ALL_DIGITS = "^[1-9][0-9]{7}$"  # a piece of the hash that is written like a number


def _hashed(name: Sql, piece: Sql) -> Sql:
    return f"concat({stem(name)}, '_', {piece}, {extension(name)})"


def _numbers(claims: DataFrame) -> DataFrame:
    """Per name with a piece of the hash: the numbers from 2 on that it is in use with, sorted.

    Every place that is claimed is in use in the end. A name with a piece of the hash that is all digits counts too, also if
    its file need not take it: that is a number above 10,000,000.
    """
    part = {n: f"regexp_extract(name, {quote(_NUMBERED)}, {n})" for n in (1, 2, 3)}
    return (
        claims.filter(f"file_name RLIKE {quote(_NUMBERED)} OR __piece RLIKE {quote(_ALL_DIGITS)}")
        .selectExpr("week_id", "category_slug", f"explode(array(file_name, IF(__arrives AND __piece RLIKE {quote(_ALL_DIGITS)}, {_hashed('file_name', '__piece')}, NULL))) AS name")
        .selectExpr("week_id", "category_slug", f"concat({part[1]}, {part[3]}) AS __name", f"try_cast({part[2]} AS INT) AS __number")
        .filter("__number >= 2").groupBy("week_id", "category_slug", "__name")
        .agg(F.sort_array(F.collect_set("__number")).alias("__numbers")))


def _free(n: Sql, taken: Sql) -> Sql:
    """The number at place `n`, 2 being the first, among those that a sorted array has not: found by bisection."""
    middle = "CAST((b.lo + b.hi) DIV 2 AS INT)"
    right = f"get({taken}, {middle}) - {middle} <= {n}"
    halve = (f"named_struct('lo', IF(b.lo < b.hi AND {right}, {middle} + 1, b.lo), "
             f"'hi', IF(b.lo < b.hi AND NOT {right}, {middle}, b.hi))")
    below = f"aggregate(sequence(1, length(bin(size({taken})))), named_struct('lo', 0, 'hi', size({taken})), (b, step) -> {halve}, b -> b.lo)"
    return f"{n} + IF({taken} IS NULL, 0, {below})"


def routing_plan(files: DataFrame, occupied: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Target folder and name of each processed file; no two files of a week get the same place, and none one that is taken.

    `files` has (week_id, file_name, category, sha1, origin, folder, seq), folder
    being where a processed file lies now. The first file of a name keeps it unless
    that place is taken at the start, by a processed file or by one of `occupied`
    (week_id, category_slug, file_name); the others get a piece of their hash. The first to want such a name gets it,
    again unless it is taken; those left are numbered from 2 on, past numbers that are taken. A
    file already in its folder stays.

    The files are read once and ordered twice: by the place they claim first, then by the name they have or want.
    """
    place = ["week_id", "category_slug", "file_name"]
    target = files.selectExpr("*", f"{slug('category')} AS category_slug").selectExpr(
        *place, "folder", "seq", "coalesce(substring(sha1, 1, 8), '') AS __piece",
        "CASE WHEN origin = 'processed' THEN IF(folder = category_slug, 'stay', 'reroute') ELSE 'move' END AS action")
    # A file that goes elsewhere also claims the place it leaves, as a row without action.
    claims = target.selectExpr("*", "explode(IF(action = 'reroute', array(true, false), array(true))) AS __goes").selectExpr(
        "week_id", "IF(__goes, category_slug, folder) AS category_slug", "file_name", "seq", "IF(__goes, __piece, '') AS __piece",
        "IF(__goes, action, NULL) AS action", "__goes AND action <> 'stay' AS __arrives")
    if occupied is not None:
        claims = claims.unionByName(occupied.selectExpr(
            *place, "CAST(NULL AS STRING) AS seq", "'' AS __piece", "CAST(NULL AS STRING) AS action", "false AS __arrives"))
    # What lies at a place comes before what arrives there; the first of all has it.
    held = with_row_number(claims, Ordering(tuple(place), ("__arrives", "seq"), rows_per_task), "__n").filter("action IS NOT NULL OR __n = 1")
    named = held.selectExpr("*", "__arrives AND __n > 1 AS __clash").selectExpr(
        "*", f"IF(__clash, {_hashed('file_name', '__piece')}, file_name) AS __name")
    # The same for names with a piece of the hash: what has one comes first, then those that want it.
    by_name = Ordering(("week_id", "category_slug", "__name"), ("__clash", "seq"), rows_per_task)
    wanted = claims.filter("__arrives").selectExpr(
        "week_id", "category_slug", f"{_hashed('file_name', '__piece')} AS __name", "true AS __clash", "seq")
    ranked = with_running_sum(named, by_name, "IF(__clash OR __n = 1, 1L, 0L)", "__rank", measured=wanted)
    return ranked.filter("action IS NOT NULL").join(_numbers(claims), list(by_name.groups), "left").selectExpr(
        *place, "seq", "action",
        f"""CASE WHEN NOT __clash THEN file_name WHEN __rank = 1 THEN __name
            ELSE concat({stem('file_name')}, '_', __piece, '_', {_free('__rank', '__numbers')}, {extension('file_name')}) END AS target_name""")


def undo_plan(processed: DataFrame, incoming: DataFrame) -> DataFrame:
    """move/skip for each processed file of a week that is undone.

    A file is skipped when its name already lies in incoming, or when an earlier
    file of the same name takes that place.
    """
    documents = processed.filter(is_document("file_name"))
    names = ["week_id", "file_name"]
    return documents.join(_claims(documents, incoming, names), names).selectExpr(
        *names, "seq", "IF(NOT __taken AND seq = __first, 'move', 'skip') AS action")
