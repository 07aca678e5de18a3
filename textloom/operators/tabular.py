"""Delimited rows, many-to-many normalisation, last-wins lookup, SQL export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.sources.shared import materialize


def tsv_fields(rows: DataFrame, value: str = "value") -> DataFrame:
    """S3, P2. The input with ``fields``: stripped lines split at tabs, at least two fields."""
    return rows.withColumn("fields", F.split(X.strip(value), "\t")).where(F.size("fields") > 1)


def rectangle(rows: DataFrame, start_row: int = 0, end_row: int | None = None, start_col: int = 0, end_col: int | None = None) -> DataFrame:
    """S4. Rows [start_row, end_row) and columns [start_col, end_col] of a row table.

    ``row_no`` is the first column; the others are counted from 0.
    """
    columns = [c for c in rows.columns if c != "row_no"]
    kept = columns[start_col : None if end_col is None else end_col + 1]
    inside = F.col("row_no") >= start_row
    if end_row is not None:
        inside &= F.col("row_no") < end_row
    return rows.where(inside).select("row_no", *kept)


def write_delimited(rows: DataFrame, path: str, sep: str = ",") -> None:
    """S2, S4. Rows as delimited files without header; quotes are doubled inside quotes."""
    rows.write.csv(path, sep=sep, header=False, quote='"', escape='"', emptyValue='""')


def last_wins(rows: DataFrame, key: str, value: str, order: str = "row_no") -> DataFrame:
    """P13, A7. (key, value): the value of each key's last row; grouped with partial maxima."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.max_by(value, order).alias("value"))


def numbered(df: DataFrame, order: tuple[str, ...], name: str = "id", within: tuple[str, ...] = ()) -> DataFrame:
    """W7, W10. ``df`` with ``name``: 1..n by ``order``, in each group of ``within`` if given.

    The rows are sorted by range and written once; each part's size gives the offset of the
    next, so that no task has all rows, or all rows of a group. Rows alike in ``order`` get
    their numbers in any order; nulls come first.
    """
    rows = df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    # the number of a row within its part is in the low 33 bits
    rows = materialize(rows.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    # one row for each part of the sort
    offsets = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    out = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + place + 1)
    out = out.select(*df.columns, name)
    if within:
        starts = materialize(out.groupBy(*within).agg((F.min(name) - 1).alias("__start")), "starts")
        starts = starts.select(*(F.col(c).alias(f"__{c}") for c in within), "__start")
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in within]
        out = out.join(starts, same).withColumn(name, F.col(name) - F.col("__start")).select(*df.columns, name)
    return out


def dense_ids(names: DataFrame, name: str = "name") -> DataFrame:
    """W7. (id, name): 1..n by name over distinct names."""
    distinct = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    return numbered(distinct, ("name",)).select("id", "name")


def group_members(rows: DataFrame, group: str = "name", members: str = "members", sep: str = "・") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A4, W7, J4, X17. Groups (id, name), members (id, name) and bridge (group_id, member_id).

    Groups are numbered by row_no, one for each row; members by name. A row meets every group
    of its name, so groups of equal names multiply; a member twice in one cell counts once.
    """
    groups = numbered(rows.select("row_no", F.col(group).alias("name")), ("row_no",)).select("id", "name")
    listed = rows.select(F.col(group).alias("name"), F.explode(F.array_distinct(F.split(members, sep))).alias("member"))
    people = dense_ids(listed, "member")
    bridge = listed.join(people.select(F.col("name").alias("member"), F.col("id").alias("member_id")), "member")
    bridge = bridge.join(groups.select(F.col("id").alias("group_id"), "name"), "name").select("group_id", "member_id")
    return groups, people, bridge


def insert_statements(table: str, rows: DataFrame, columns: dict[str, str], order: str, batch: int = 1000, escape: bool = True) -> DataFrame:
    """S8. (batch_no, statement): INSERT statements of ``batch`` rows each, in order of ``order``.

    columns gives each column's kind, 'int' or 'str'. Strings stand in double quotes, which
    ``escape`` doubles inside.
    """
    number = F.floor((F.col(order) - 1) / batch).cast("long")
    cells = []
    for c, kind in columns.items():
        if kind == "int":
            cells.append(F.col(c).cast("long").cast("string"))
        elif kind == "str":
            s = F.col(c).cast("string")
            cells.append(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')) if escape else s, F.lit('"')))
        else:
            raise TypeError(f"{c}: {kind}")
    row = F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")"))
    packed = rows.groupBy(number.alias("batch_no")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))).alias("rs"))
    head = f"INSERT INTO {table}({', '.join(columns)}) VALUES"
    return packed.select("batch_no", F.concat(F.lit(head), F.array_join(F.transform("rs", lambda x: x["r"]), ", "), F.lit(";")).alias("statement"))
