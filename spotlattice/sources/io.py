"""Discovery, readers, guards and the append-only ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlattice.functions.expr import blank_to_null, number

POSITIONS = ("barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres")
# Which positions file is taken first, by layout.
_FLAT_ORDER = ("tissue_positions.csv.gz", "tissue_positions.csv", "tissue_positions_list.csv.gz", "tissue_positions_list.csv")
_H5_ORDER = ("tissue_positions_list.csv", "tissue_positions.csv")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path", "length")


def _rank(name: Column, order: tuple[str, ...]) -> Column:
    rank = F.lit(None).cast("int")
    for i, suffix in reversed(list(enumerate(order))):
        rank = F.when(name.endswith(suffix), i).otherwise(rank)
    return rank


def discover(files: DataFrame, root: str) -> DataFrame:
    """Samples below ``root`` from a table of paths: nested, flat and h5 layouts.

    One row per sample: of several layouts the later one wins (nested, flat,
    h5); positions files are preferred in the order of their layout.
    """
    rel = F.regexp_replace(F.col("path"), f"^(file:)?/*{root.strip('/')}/", "")
    f = files.select("path", rel.alias("rel")).withColumn("name", F.element_at(F.split("rel", "/"), -1))
    f = f.withColumns({"dir": F.regexp_replace("rel", "/?[^/]*$", ""), "top": F.split("rel", "/")[0], "depth": F.size(F.split("rel", "/"))})

    nested = f.filter(F.col("name").rlike(r"^matrix\.mtx(\.gz)?$")).select(F.element_at(F.split("dir", "/"), -2).alias("sample_id"), "dir", F.col("path").alias("matrix"), "top")
    nested = nested.join(f.filter(F.col("name").rlike(r"^barcodes\.tsv(\.gz)?$")).select("dir").distinct(), "dir", "left_semi")
    position = f.filter(F.col("name").rlike(r"^tissue_positions.*\.csv(\.gz)?$")).groupBy("top").agg(F.min("path").alias("positions"))
    nested = nested.join(position, "top").select("sample_id", "matrix", "positions", F.lit("mtx").alias("layout"), F.lit(0).alias("rank"))

    def prefixed(suffix: str, layout: str, rank: int, order: tuple[str, ...], needs: str | None) -> DataFrame:
        m = f.filter(F.col("name").rlike(f"^.+_{suffix}$")).select("dir", F.regexp_extract("name", f"^(.+)_{suffix}$", 1).alias("sample_id"), F.col("path").alias("matrix"))
        if needs:
            m = m.join(f.filter(F.col("name").rlike(f"^.+_{needs}$")).select("dir", F.regexp_extract("name", f"^(.+)_{needs}$", 1).alias("sample_id")).distinct(), ["dir", "sample_id"], "left_semi")
        p = f.withColumn("r", _rank(F.col("name"), order)).filter("r IS NOT NULL")
        p = p.select("dir", F.regexp_extract("name", "^(.+)_tissue_positions", 1).alias("sample_id"), "path", "r").groupBy("dir", "sample_id").agg(F.min_by("path", "r").alias("positions"))
        return m.join(p, ["dir", "sample_id"]).select("sample_id", "matrix", "positions", F.lit(layout).alias("layout"), F.lit(rank).alias("rank"))

    flat = prefixed(r"matrix\.mtx(?:\.gz)?", "flat", 1, _FLAT_ORDER, r"barcodes\.tsv(?:\.gz)?")
    h5 = prefixed(r"filtered_feature_bc_matrix\.h5", "h5", 2, _H5_ORDER, None)
    both = nested.unionByName(flat).unionByName(h5)
    best = both.groupBy("sample_id").agg(F.max_by(F.struct("matrix", "positions", "layout"), F.struct("rank", "matrix")).alias("s"))
    return best.select("sample_id", "s.layout", "s.matrix", "s.positions")


def select_samples(found: DataFrame, allow: list[str] | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The requested samples in their order and the missing ids, or the first ``most`` by id."""
    if allow is None:
        ordered = found.orderBy("sample_id")
        return (ordered.limit(most) if most is not None else ordered), None
    spark = found.sparkSession
    wanted = spark.createDataFrame([(i, s) for i, s in enumerate(allow)], "place int, sample_id string")
    return found.join(F.broadcast(wanted), "sample_id").orderBy("place"), wanted.join(found, "sample_id", "left_anti")


def parse_mtx(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coordinate MatrixMarket text ``(path, line_no, value)`` to zero-based triplets, and the size line of each path."""
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    first = body.groupBy("path").agg(F.min("line_no").alias("at"))
    cells = body.select("path", "line_no", *(parts[i].try_cast("bigint").alias(c) for i, c in enumerate(("gene", "spot", "n"))))
    sizes = cells.join(first, ["path"]).filter("line_no = at").select("path", F.col("gene").alias("n_genes"), F.col("spot").alias("n_spots"), F.col("n").alias("n_values"))
    triplets = cells.join(first, "path").filter("line_no > at").select("path", (F.col("gene") - 1).alias("gene"), (F.col("spot") - 1).alias("spot"), "n")
    return triplets, sizes


def read_mtx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files of a path, split by line; lines keep their order within a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), "value")
    return parse_mtx(lines)


def csc_to_triplets(arrays: DataFrame) -> DataFrame:
    """(sample_id, gene, spot, n) of rows ``(sample_id, data, indices, indptr)``, one column of the matrix a spot."""
    column = arrays.select("sample_id", "data", "indices", "indptr", F.posexplode("indptr").alias("spot", "low"))
    column = column.withColumn("high", F.get("indptr", F.col("spot") + 1)).filter("high > low")
    cell = column.select("sample_id", "data", "indices", F.col("spot").cast("bigint").alias("spot"), F.explode(F.sequence("low", F.col("high") - 1)).alias("at"))
    cell = cell.withColumn("i", F.col("at").cast("int"))
    return cell.select("sample_id", F.get("indices", "i").cast("bigint").alias("gene"), "spot", F.get("data", "i").cast("bigint").alias("n"))


def line_index(texts: DataFrame) -> DataFrame:
    """(path, ordinal, value) of whole files ``(path, value)``; an empty last line is no line."""
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return texts.select("path", F.posexplode(lines).alias("ordinal", "value"))


def parse_positions(rows: DataFrame) -> DataFrame:
    """Typed positions of text rows with six columns; a header row is told by its first cell."""
    kinds = ("string", "int", "int", "int", "double", "double")
    keys = [c for c in rows.columns if c not in POSITIONS]
    return rows.filter(F.lower(F.trim("barcode")) != "barcode").select(*keys, *(F.col(c) if k == "string" else number(F.col(c), k).alias(c) for c, k in zip(POSITIONS, kinds, strict=True)))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return parse_positions(spark.read.schema(", ".join(f"{c} string" for c in POSITIONS)).csv(path))


def align(positions: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Spots in tissue with the ordinal of their barcode and coordinates x, y."""
    keys = [k for k in ("dataset_id", "sample_id") if k in barcodes.columns] + ["barcode"]
    inside = positions.filter(F.coalesce(F.col("in_tissue"), F.lit(1)) == 1) if "in_tissue" in positions.columns else positions
    return inside.join(barcodes, keys).select(*keys, "spot_idx", F.col("pxl_col_in_fullres").alias("x"), F.col("pxl_row_in_fullres").alias("y"))


def guard_violations(spots: DataFrame, barcodes: DataFrame, features: DataFrame, shapes: DataFrame, least: int = 50) -> DataFrame:
    """(sample_id, guard, expected, found) of samples whose counts disagree; nothing is raised."""
    count = lambda df, name: df.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name))
    g = shapes.join(count(barcodes, "b"), "sample_id", "left").join(count(features, "f"), "sample_id", "left").join(count(spots, "s"), "sample_id", "left").fillna(0, ["b", "f", "s"])
    def check(guard: str, expected: Column, found: Column, bad: Column) -> Column:
        return F.struct(F.lit(guard).alias("guard"), expected.cast("bigint").alias("expected"), found.alias("found"), bad.alias("bad"))

    b, f, s = F.col("b"), F.col("f"), F.col("s")
    checks = F.array(
        check("barcodes", F.col("n_spots"), b, b != F.col("n_spots")),
        check("features", F.col("n_genes"), f, f != F.col("n_genes")),
        check("spots", F.lit(least), s, s < least),
    )
    return g.select("sample_id", F.explode(checks).alias("c")).filter("c.bad").select("sample_id", "c.guard", "c.expected", "c.found")


def unique_names(features: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Repeated names get ``.1``, ``.2``, … in the order of their gene."""
    n = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("gene")) - 1
    return features.withColumn("unique_name", F.when(n == 0, F.col("name")).otherwise(F.concat_ws(".", "name", n)))


def sum_by_name(values: DataFrame, features: DataFrame) -> DataFrame:
    """Values of genes that share a name, added up per spot."""
    return values.join(features.select("gene", "name"), "gene").groupBy("spot", "name").agg(F.sum("v").alias("v"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header: all texts, missing spellings as null."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.select(*(blank_to_null(F.col(c)).alias(c) for c in rows.columns))


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def new_rows(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of ``batch``, cast to the ledger's columns, that neither the ledger nor an earlier row of the batch holds."""
    cast = batch.select(*((F.col(c) if c in batch.columns else F.lit(None)).cast(ledger.schema[c].dataType).alias(c) for c in ledger.columns)).dropDuplicates()
    return cast.join(ledger, _same(cast, ledger), "left_anti")


def _same(a: DataFrame, b: DataFrame) -> Column:
    on = F.lit(True)
    for c in a.columns:
        on = on & a[c].eqNullSafe(b[c])
    return on


def append_new(batch: DataFrame, path: str) -> None:
    """Appends what is new to a Parquet ledger; also the body of the streaming sink.

    One writer at a time: reading and appending are two steps, and two writers could add the same row.
    """
    spark = batch.sparkSession
    new_rows(batch, spark.read.parquet(path)).write.mode("append").parquet(path)


def dedup_exact(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct rows, and one row with the numbers before, after and removed."""
    one = df.dropDuplicates()
    counts = df.agg(F.count(F.lit(1)).alias("n_before")).crossJoin(one.agg(F.count(F.lit(1)).alias("n_after")))
    return one, counts.withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def check_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Each manifest row with the size found for its file name and whether it agrees; null where there is no file."""
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("found_bytes"))
    return manifest.join(found, "file_name", "left").withColumn("size_ok", F.coalesce(F.col("found_bytes") == F.col("expected_bytes"), F.lit(False)))


def backfill_notes(rows: DataFrame, stages: dict[str, str], suffixes: dict[str, str]) -> DataFrame:
    """Blank notes of methods with a suffix become ``<stage>-full-replication<suffix>``."""
    look = lambda pairs, c: F.element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), F.col(c))
    made = F.concat(look(stages, "dataset_id"), F.lit("-full-replication"), look(suffixes, "method_id"))
    return rows.withColumn("notes", F.coalesce(F.nullif(F.trim("notes"), F.lit("")), made, F.col("notes")))


def union_configs(spark: SparkSession, pattern: str) -> DataFrame:
    """Tables of many configuration folders in one read, tagged with the folder's name."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(pattern)
    return rows.withColumn("config_id", config_of(F.col("_metadata.file_path")))


def config_of(path: Column) -> Column:
    return F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)


def run_summary(runs: DataFrame) -> DataFrame:
    """Per stage: units asked for, done and failed, first start, last end and the microseconds between."""
    g = runs.groupBy("stage_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("discovered"), F.sum((F.col("status") == "success").cast("bigint")).alias("processed"), F.min("started").alias("started"), F.max("finished").alias("finished")
    )
    status = F.when(F.col("processed") == F.col("discovered"), "success").when(F.col("processed") > 0, "partial").otherwise("failed")
    return g.withColumns({"micros": F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp")), "status": status})


def failure_rows(runs: DataFrame, most: int = 500) -> DataFrame:
    """Failed runs with their message on one line, cut to ``most`` characters."""
    return runs.filter("status <> 'success'").withColumn("message", F.substring(F.regexp_replace("message", r"[\t\r\n]+", " "), 1, most))
