"""Versions of a table that are published as a whole, and records that are sealed by file, by content and by id.

A version is a folder that is never changed. What readers see is named by one small file, which is replaced last and at once, so a reader
before, between and after the steps of a publication finds a whole table.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import lexemes as L

POINTER = "CURRENT"
OWN = "candidate_file_sha256"


def _fs(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file aside and renames it over the old one, in one step."""
    at, fs, jvm = _fs(spark, path)
    aside = f"{path}.{uuid.uuid4().hex[:8]}"
    out = fs.create(at(aside), True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at(aside), at(path), over)


def pointer(spark: SparkSession, path: str) -> dict | None:
    """What is published at the path: version and seal; None before the first publication."""
    at, fs, jvm = _fs(spark, path)
    if not fs.exists(at(f"{path}/{POINTER}")):
        return None
    stream = fs.open(at(f"{path}/{POINTER}"))
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def content_digest(rows: DataFrame) -> str:
    """A digest of the rows as a multiset, whatever their order and files: the sum of the digests of their JSON, and their number."""
    own = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring(own, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16, 31, 46)]
    r = rows.select(*(w.alias(f"w{i}") for i, w in enumerate(words))).agg(F.count("*"), *(F.sum(f"w{i}") for i in range(4))).first()
    return hashlib.sha256(",".join(str(x or 0) for x in r).encode()).hexdigest()


def stage(rows: DataFrame, path: str, name: str) -> dict:
    """The first step of a publication: a new version beside the others, which no reader sees yet, and its seal."""
    version = f"v-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(f"{path}/{version}")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{version}")
    return {"id": name, "version": version, "content_sha256": content_digest(written)}


def release(spark: SparkSession, path: str, seal: dict, keep: int = 2) -> None:
    """The second step: readers see the version from now on. Versions before the last `keep` go; a reader may still be in the last ones."""
    was = pointer(spark, path)
    history = [seal["version"], *([was["version"], *was["history"]] if was else [])]
    _put(spark, f"{path}/{POINTER}", json.dumps({**seal, "history": history[1:keep]}, sort_keys=True))
    at, fs, _ = _fs(spark, path)
    for old in history[keep:]:
        fs.delete(at(f"{path}/{old}"), True)


def publish(rows: DataFrame, path: str, name: str, keep: int = 2) -> dict:
    """Publishes the rows as the table's new version."""
    seal = stage(rows, path, name)
    release(rows.sparkSession, path, seal, keep)
    return seal


def read(spark: SparkSession, path: str, name: str | None = None, check: bool = False) -> DataFrame:
    """The published version; with `check` its content is held against its seal first, and with a name its id."""
    now = pointer(spark, path)
    if now is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    rows = spark.read.parquet(f"{path}/{now['version']}")
    if check and content_digest(rows) != now["content_sha256"]:
        raise ValueError(f"the content of {path} is not what was sealed")
    if name is not None and now["id"] != name:
        raise ValueError(f"{path} holds {now['id']}, not {name}")
    return rows


def canonical_digest(text: Column, without: str = OWN) -> Column:
    """SHA-256 of a JSON object with its keys in order and one field left out; NULL where the text is no object."""

    def work(x: pd.Series) -> pd.Series:
        def one(s: str | None) -> str | None:
            try:
                obj = json.loads(s) if s is not None else None
            except ValueError:
                return None
            if not isinstance(obj, dict):
                return None
            obj.pop(without, None)
            return hashlib.sha256(json.dumps(obj, ensure_ascii=False, sort_keys=True).encode()).hexdigest()

        return x.map(one)

    return F.pandas_udf(work, "string")(text)


def sealed_error(files: DataFrame, seals: DataFrame) -> DataFrame:
    """Adds `error` to sealed records (case_id, content): NULL if file digest, content digest and id are those that were sealed.

    seals: case_id, sha256. A file of no sealed case and one with other bytes are `candidate seal mismatch`; content that isn't what its own field declares, or
    another id within, is `candidate content seal mismatch`, also where the file's digest fits.
    """
    own = F.get_json_object("content", f"$.{OWN}").eqNullSafe(canonical_digest(F.col("content"))) & F.get_json_object("content", "$.case_id").eqNullSafe(F.col("case_id"))
    d = files.join(seals.select("case_id", F.col("sha256").alias("_sealed")), "case_id", "left")
    error = F.when(~L.valid_id(F.col("case_id")), "invalid case id").when(~F.coalesce(F.col("_sealed") == F.sha2("content", 256), F.lit(False)), "candidate seal mismatch").when(~own, "candidate content seal mismatch")
    return d.withColumn("error", error).drop("_sealed")
