"""JSON, JSONL and HTML sources, and sinks that replace or append as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from factloom.sources import published

# bytes 80 to 9F of windows-1252 as ISO-8859-1 reads them, and what they stand for; five are undefined
UNDEFINED = "\x81\x8d\x8f\x90\x9d"
CONTROLS = "".join(chr(i) for i in range(0x80, 0xA0) if chr(i) not in UNDEFINED)
WINDOWS = CONTROLS.encode("latin-1").decode("cp1252")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 if they are valid, else windows-1252 if all are defined there, else ISO-8859-1."""
    latin = F.decode(content, "ISO-8859-1")
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(~latin.rlike(f"[{UNDEFINED}]"), F.translate(latin, CONTROLS, WINDOWS)).otherwise(latin)


def read_manifest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole-file JSON manifests, each an object or an array of objects, in the first of three encodings that fits."""
    rows = F.from_json(decoded(F.col("content")), ArrayType(StructType.fromDDL(schema) if isinstance(schema, str) else schema))
    return spark.read.format("binaryFile").load(path).select(F.inline(rows))


_KEPT: dict[tuple, tuple[list, DataFrame]] = {}


def read_manifest_kept(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A manifest kept in memory until one of its files has another time or size."""
    key = (path, schema if isinstance(schema, str) else schema.simpleString(), spark.sparkContext.applicationId)
    state = sorted(tuple(r) for r in spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length").collect())  # one row a file
    was = _KEPT.get(key)
    if was is None or was[0] != state:
        if was is not None:
            was[1].unpersist()
        _KEPT[key] = state, read_manifest(spark, path, schema).persist()
    return _KEPT[key][1]


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSONL log; blank lines are skipped, broken ones are null rows."""
    return spark.read.schema(schema).json(path)


def read_log_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSONL log that fails on a line that is no object of the schema, such as a truncated last one or NaN."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", False).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_log(rows: DataFrame, path: str, check: bool = True) -> None:
    """Appends rows to a JSONL log; NaN and infinities are refused first, and with `check` so is a log that can't be read whole."""
    spark = rows.sparkSession
    if check and _exists(spark, path):
        read_log_strict(spark, path, rows.schema).write.format("noop").mode("overwrite").save()
    for name, kind in rows.dtypes:
        if kind in ("double", "float"):
            bad = F.isnan(name) | F.col(name).isin(float("inf"), float("-inf"))
            rows = rows.withColumn(name, F.when(bad, F.raise_error(F.lit(f"{name} is not a finite number")).cast(kind)).otherwise(F.col(name)))
    rows.write.mode("append").json(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Replaces a table as a whole: the rows are a new version beside the old one, and one small file that names it is renamed last. Read it by `read_replaced`."""
    published.publish(rows, path, path.rstrip("/").rsplit("/", 1)[-1])


def read_replaced(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was last replaced: at any time all of it."""
    return published.read(spark, path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the data files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, sha256) of all files below a folder whose names fit, by their paths within it: modules, manifests or documents that are frozen."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.substring_index(F.replace("path", F.lit("file:///"), F.lit("file:/")), root.removeprefix("file://") + "/", -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def freeze_errors(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(name, error) of what is frozen (name, path, sha256) and is `missing` now (path, sha256), or has another digest (`sha mismatch`)."""
    d = frozen.join(now.select("path", F.col("sha256").alias("_now")), "path", "left")
    error = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("sha256"), "sha mismatch")
    return d.select("name", error.alias("error")).where("error is not null")


def write_sealed(rows: DataFrame, path: str, by: str) -> None:
    """Writes results as JSON, and beside them the digest of each file and what they were made by."""
    rows.write.json(f"{path}/results")
    file_digests(rows.sparkSession, f"{path}/results").withColumn("made_by", F.lit(by)).coalesce(1).write.json(f"{path}/seal")


def broken_seals(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, sealed) of files whose digest isn't the sealed one, or that only one side has."""
    sealed = spark.read.schema("name string, sha256 string, made_by string").json(f"{path}/seal").select("name", F.col("sha256").alias("sealed"))
    return file_digests(spark, f"{path}/results").join(sealed, "name", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("sealed")))


def read_sealed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Results whose files are those that were sealed; others are refused before anything is read."""
    if not broken_seals(spark, path).isEmpty():
        raise ValueError(f"files in {path} are not those that were sealed")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/results")


def registry_cells(html: Column) -> Column:
    """Cells of a registry row, tags removed and white space squeezed."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    return F.transform(raw, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"(?U)\s+", " ")))


def registry_record(rows: DataFrame, html: str, fields: list[str]) -> DataFrame:
    """Named fields of registry rows by the place of their cells, with the document link and the number in their links."""
    cell = registry_cells(F.col(html))
    named = [F.get(cell, i).alias(f) for i, f in enumerate(fields)]
    links = {"doc_url": r'href="([^"]*verdocumento[^"]*)"', "nif": r"[?&]nif=([^\"&]+)", "numfol": r"[?&]NUMFOL=([^\"&]+)"}
    found = [F.nullif(F.regexp_extract(html, "(?i)" + p, 1), F.lit("")).alias(n) for n, p in links.items() if n not in fields]
    return rows.select("*", *named, *found)


# Where a row's document is, by the number in its link.
DOCUMENT = "https://www.cnmv.es/webservices/verdocumento/ver?e="


def _links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'), F.lit(1))


def _document(html: Column) -> Column:
    """The address of the first linked document, NULL without one."""
    return F.concat(F.lit(DOCUMENT), F.substring_index(F.get(F.filter(_links(html), lambda x: F.contains(x, F.lit("verdocumento"))), 0), "e=", -1))


def _linked(html: Column, mark: str, value: str) -> Column:
    """What follows a mark in the first link that has it."""
    first = F.get(F.filter(_links(html), lambda x: F.contains(x, F.lit(mark))), 0)
    return F.nullif(F.regexp_extract(first, mark + value, 1), F.lit(""))


def _record(**fields: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def prospectus_row(html: Column, year: Column) -> Column:
    """The record of a prospectus row: a register with its version apart, a role without entities, in capitals."""
    c = registry_cells(html)
    reg, cell, late = F.get(c, 1), lambda i: F.get(c, i), lambda i: F.coalesce(F.get(c, i), F.lit(""))
    base = F.regexp_extract(reg, r"^([^.\-]*)", 1)
    role = F.upper(F.trim(F.regexp_replace(cell(5), "&[^;]+;", " ")))
    return _record(
        family=F.lit("cnmv_folletos_emision"), source_record_key=F.concat(F.lit("FOL_"), reg), registro_oficial=base, version_suffix=F.nullif(F.regexp_extract(reg, r"^[^.\-]*(.*)$", 1), F.lit("")), rol=role, emisor=cell(2), nif=_linked(html, "nif=", "([A-Z0-9]+)"),
        fecha_registro=cell(0), denominacion=cell(5), nominal=late(6), isin=late(7), admision=late(8), doc_url=_document(html), year=year,
    )


def final_terms_row(html: Column) -> Column:
    """The record of a row of final terms: twelve cells, and the number of the prospectus that it links."""
    c = registry_cells(html)
    names = {"source_record_key": 3, "finalidad": 0, "presentacion": 1, "ult_mod": 2, "emisor": 4, "fecha_reg": 5, "registro_oficial": 6}
    rest = {"tipo_valor": 8, "nominal": 9, "isin": 10, "admision": 11}
    cells = lambda x: {k: F.get(c, i) for k, i in x.items()}
    return _record(family=F.lit("cnmv_ccff"), **cells(names), numfol_link=_linked(html, "NUMFOL=", r"(\d+)"), doc_url=_document(html), **cells(rest))


def admission_row(html: Column) -> Column:
    """The record of an admission row."""
    c = registry_cells(html)
    cell, late = lambda i: F.get(c, i), lambda i: F.coalesce(F.get(c, i), F.lit(""))
    return _record(
        family=F.lit("cnmv_admision"), source_record_key=F.concat(F.lit("ADM_"), cell(1)), registro_oficial=cell(1), emisor=cell(2), fecha_registro=cell(0), denominacion=cell(5), nominal=cell(6), isin=late(7), mercados=late(8), doc_url=_document(html)
    )
