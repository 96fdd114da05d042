"""Loading CIF lines with the lines that can't be read set apart, with the reason.

Cells are exploded into (row, column, value), joined with a rule table, validated, and the errors aggregated per row; the clean rows are what an
anti-join with the errors leaves. All steps are SQL expressions. What a line means depends on the lines before it (text fields, the loop header in
force): blocks are cut into chunks of lines, and the lines are shuffled and sorted once, by chunk. A chunk doesn't know whether it begins in a text
field, so it is summed up for both cases; one small row a chunk is then scanned per block and tells every chunk which case holds and what it carries on.
A block with a third of all rows thus spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import Scratch

CHUNK = 2048  # lines of a block that one window scans

#: A value: quoted (the quote closes only before a blank or the end), a comment, or anything up to the next blank.
TOKEN = r"""'(?:[^']++|'(?=\S))*+'(?=\s|$)|"(?:[^"]++|"(?=\S))*+"(?=\s|$)|#.*|\S+"""
CLOSED = r"""^(?:'(?:[^']++|'(?=\S))*+'|"(?:[^"]++|"(?=\S))*+")$"""
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?:\([0-9]+\))?$"

#: Rule table: column, lowest and highest value, whether the lowest itself is allowed. Columns without a rule hold anything.
RULES = [
    ("_cell_length_a", 0.0, None, False), ("_cell_length_b", 0.0, None, False), ("_cell_length_c", 0.0, None, False),
    ("_atom_site_fract_x", None, None, True), ("_atom_site_fract_y", None, None, True), ("_atom_site_fract_z", None, None, True),
    ("_atom_site_occupancy", 0.0, 1.0, True),
]
REASONS = ["quoting", "column_count", "bad_number", "out_of_range"]  # in the order in which the first one counts


def _first(raw: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(raw, r"^\s*(\S+)", 1))


def _event(tag: F.Column) -> F.Column:
    """What a line's first word does to the loop in force; loops of anisotropic displacements hold no sites."""
    header = tag.startswith("_atom_site_") & ~tag.startswith("_atom_site_aniso")
    return F.when(header, "header").when(tag.startswith("_"), "tag").when(tag.rlike("^(loop_|data_|save_|stop_|global_)"), "word")


def read_lines(cif_lines: DataFrame) -> DataFrame:
    """Cell-length and site lines with their column names and values: (row_id, block_id, line_no, kind, heads, cells).

    Lines in text fields, comments, headers and other tags are left out, and so are site lines without headers. Columns are those of the line's own loop. A line
    delivered twice is scanned once and both deliveries get the result. Null lines count as empty; tags are read without regard to case.
    """
    lines = cif_lines.select("row_id", "block_id", "line_no", F.coalesce("raw_line", F.lit("")).alias("raw")).withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
    order = Window.partitionBy("block_id", "chunk").orderBy("line_no", "row_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.select("*", F.col("raw").startswith(";").alias("mark"), _event(_first(F.col("raw"))).alias("event"), F.coalesce(F.lag("line_no").over(order) == F.col("line_no"), F.lit(False)).alias("again"))
    lines = lines.select("*", F.sum((F.col("mark") & ~F.col("again")).cast("long")).over(so_far).alias("marks"))
    # case 0: the chunk begins outside a text field; case 1: inside
    seen = [F.when(~F.col("mark") & ((F.col("marks") + p) % 2 == 0), F.col("event")) for p in (0, 1)]
    starts = [F.coalesce(((e == "word") & ~F.col("again")).cast("long"), F.lit(0)) for e in seen]
    lines = lines.select("*", *[F.last(e, True).over(so_far).alias(f"state{p}") for p, e in enumerate(seen)], *[F.sum(v).over(so_far).alias(f"loop{p}") for p, v in enumerate(starts)])
    lines = Scratch(cif_lines.sparkSession, "cif-lines").keep(lines.where(F.col("mark") | F.col("event").isNotNull() | F.col("raw").rlike(r"^\s*[^\s#]")))
    last = F.struct("line_no", "row_id")
    chunks = lines.groupBy("block_id", "chunk").agg(F.max("marks").alias("marks"), *[F.max_by(f"state{p}", last).alias(f"state{p}") for p in (0, 1)], *[F.max(f"loop{p}").alias(f"loop{p}") for p in (0, 1)])
    before = Window.partitionBy("block_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("inside", F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2 == 1)
    case = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    carry = chunks.select("block_id", "chunk", "inside", F.last(case("state"), True).over(before).alias("old_state"), F.coalesce(F.sum(case("loop")).over(before), F.lit(0)).alias("old_loop"), case("loop").alias("loops"))
    outside = ~F.col("mark") & ((F.col("marks") + F.col("inside").cast("int")) % 2 == 0)
    # the columns of every loop that a chunk has lines of, in one row a chunk: lines are joined once
    of_header = lines.where("event = 'header' and not again").select("block_id", "chunk", "line_no", "mark", "marks", "loop0", "loop1", _first(F.col("raw")).alias("tag")).join(carry, ["block_id", "chunk"]).where(outside)
    heads = of_header.groupBy("block_id", (F.col("old_loop") + case("loop")).alias("loop")).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "tag"))), lambda h: h["tag"]).alias("columns"))
    loops = carry.select("block_id", "chunk", F.posexplode(F.sequence(F.col("old_loop"), F.col("old_loop") + F.col("loops"))).alias("k", "loop")).join(heads, ["block_id", "loop"], "left")
    loops = loops.groupBy("block_id", "chunk").agg(F.map_from_entries(F.collect_list(F.when(F.col("columns").isNotNull(), F.struct("k", "columns")))).alias("columns"))
    full = lines.drop("again").join(carry.select("block_id", "chunk", "inside", "old_state").join(loops, ["block_id", "chunk"]), ["block_id", "chunk"]).where(outside).withColumn("tag", _first(F.col("raw")))
    data = F.col("event").isNull() & ~F.col("tag").startswith("#") & (F.coalesce(case("state"), "old_state") == "header")
    lined = full.withColumn("kind", F.when(F.col("tag").rlike("^_cell_length_[abc]$"), "cell").when(data, "site")).where("kind is not null")
    lined = lined.withColumn("columns", F.element_at("columns", case("loop").cast("int")))
    plain = F.split(F.trim(F.regexp_replace("raw", r"\s+", " ")), " ")
    odd = F.filter(F.regexp_extract_all("raw", F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("#"))
    tokens = F.when(F.col("raw").rlike("['\"#]"), odd).otherwise(plain)
    cell = F.col("kind") == "cell"
    values = F.when(cell, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))).otherwise(tokens)
    return lined.select("row_id", "block_id", "line_no", "kind", F.when(cell, F.array("tag")).otherwise(F.col("columns")).alias("heads"), values.alias("cells")).where("heads is not null")


def _errors(read: DataFrame) -> DataFrame:
    """(row_id, severity): the place in REASONS of the first reason that holds for each line that can't be read."""
    rules = read.sparkSession.createDataFrame(RULES, "column string, low double, high double, low_in boolean")
    quoted = F.exists("cells", lambda t: t.rlike("^['\"]") & ~t.rlike(CLOSED))
    shape = read.select("row_id", F.when(quoted, 0).when(F.size("cells") != F.size("heads"), 1).alias("shape"), "heads", "cells")
    # row, column, value; lines whose shape is wrong keep one row without
    values = shape.select("row_id", "shape", F.explode_outer(F.when(F.col("shape").isNull(), F.arrays_zip("heads", "cells"))).alias("c")).select("row_id", "shape", F.col("c.heads").alias("column"), F.col("c.cells").alias("value"))
    checked = values.join(F.broadcast(rules), "column", "left").where("shape is not null or low_in is not null")  # seven rows, fixed above
    number = F.regexp_replace("value", r"\([0-9]+\)$", "").try_cast("double")
    is_number = F.col("value").rlike(NUMBER)
    low = F.when(F.col("low_in"), number < F.col("low")).otherwise(number <= F.col("low"))
    outside = is_number & (F.coalesce(low, F.lit(False)) | F.coalesce(number > F.col("high"), F.lit(False)))
    severity = F.coalesce("shape", F.when(~is_number & ~F.col("value").isin("?", "."), 2).when(outside, 3))
    return checked.select("row_id", severity.alias("severity")).where("severity is not null").groupBy("row_id").agg(F.min("severity").alias("severity"))


def rejected_lines(cif_lines: DataFrame) -> DataFrame:
    """(row_id, reason) of cell-length and site lines that can't be read, with the first reason of REASONS that holds.

    An empty table gives no rows. Site lines of a loop without headers have no kind and are not reported.
    """
    return _errors(read_lines(cif_lines)).select("row_id", F.element_at(F.array(*map(F.lit, REASONS)), F.col("severity") + 1).alias("reason"))


def clean_values(cif_lines: DataFrame) -> DataFrame:
    """(row_id, block_id, line_no, column, value, number) of the lines that can be read: an anti-join with the errors. '?' and '.' give a null number."""
    read = Scratch(cif_lines.sparkSession, "cif").keep(read_lines(cif_lines))
    rows = read.join(_errors(read), "row_id", "left_anti")
    zipped = rows.select("row_id", "block_id", "line_no", F.explode(F.arrays_zip(F.col("heads").alias("name"), F.col("cells").alias("text"))).alias("c"))
    number = F.when(F.col("c.text").rlike(NUMBER), F.regexp_replace("c.text", r"\([0-9]+\)$", "").try_cast("double"))
    return zipped.select("row_id", "block_id", "line_no", F.col("c.name").alias("column"), F.col("c.text").alias("value"), number.alias("number"))
