"""Manifests, digests, archive rules and required assets; rule violations come back as rows."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import near


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    """path, bytes, sha256 and md5 of every file."""
    return files.select("path", F.octet_length(content).cast("long").alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.md5(F.col(content).cast("binary")).alias("md5"))


def upsert(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """Latest entry per path; of entries recorded at one time the new one."""
    both = manifest.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)))
    order = Window.partitionBy("path").orderBy(F.col("recorded_utc").desc(), F.col("__turn").desc())
    return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__turn")


def failures(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries whose file is missing or differs."""
    found = files.select("path", F.col("bytes").alias("f_bytes"), F.col("sha256").alias("f_sha"))
    met = manifest.join(found, "path", "left")
    why = F.when(F.col("f_sha").isNull(), "missing").when(~F.col("bytes").eqNullSafe(F.col("f_bytes")), "size").when(~F.col("sha256").eqNullSafe(F.col("f_sha")), "sha256")
    return met.withColumn("failure", why).filter("failure IS NOT NULL").select("path", "failure")


def missing_assets(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.join(present, "path", "left_anti")


def band_metadata_failures(bands: DataFrame) -> DataFrame:
    """Products that do not have exactly the two bands, with nodata in use and equal to 0."""
    rules = bands.groupBy("product").agg(
        (F.sort_array(F.collect_set("band")) == F.array(F.lit("Sigma0_VH"), F.lit("Sigma0_VV"))).alias("bands"),
        F.every("nodata_used").alias("used"),
        F.every(F.coalesce(F.col("nodata") == 0, F.lit(False))).alias("zero"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("band_index", "band"))), lambda s: s["band"]), ",").alias("order"),
    )
    return rules.withColumn("ok", F.col("bands") & F.col("used") & F.col("zero"))


def archive_failures(archives: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules that an archive breaks against its catalog entry, one row each."""
    c = catalog.select("scene_id", *[F.col(x).alias(f"c_{x}") for x in ("bytes", "md5", "relative_orbit", "pass_direction", "start_time")])
    met = archives.join(c, "scene_id", "left")
    same: dict[str, Column] = {
        "bytes": F.col("bytes").eqNullSafe(F.col("c_bytes")),
        "md5": F.col("md5").eqNullSafe(F.col("c_md5")),
        "relative_orbit": F.col("relative_orbit").eqNullSafe(F.col("c_relative_orbit")),
        "pass_direction": F.upper("pass_direction").eqNullSafe(F.upper("c_pass_direction")),
        "start_time": F.substring("start_time", 1, 19).eqNullSafe(F.substring("c_start_time", 1, 19)),
        "mode": F.col("mode") == "IW",
        "polarizations": F.size(F.array_except(F.array(F.lit("VV"), F.lit("VH")), "polarizations")) == 0,
    }
    rules = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in same.items()])
    return met.select("scene_id", F.explode(F.array_compact(rules)).alias("rule"))


def xml_fields(documents: DataFrame, names: list[str], keys: list[str], xml: str = "xml") -> DataFrame:
    """(keys, name, values): the trimmed texts of all elements of each name, in document order, whatever their namespace prefix; empty texts are left out.

    A document is parsed once for all names.  One that is not well-formed is an error; null and empty ones have no rows.
    """
    own = documents.select(*keys, xml)
    schema = documents.select(*keys).schema.add("name", "string").add("values", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for part in batches:
            rows, found, texts = [], [], []
            for k, text in enumerate(part.column(len(keys)).to_pylist()):
                values = _element_texts(text, names, known) if text else {}
                rows += [k] * len(values)
                found += values.keys()
                texts += values.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns[: len(keys)]), pa.array(found, pa.string()), pa.array(texts, pa.list_(pa.string()))], [*keys, "name", "values"])

    return own.mapInArrow(run, schema)


def _element_texts(xml: str, names: list[str], known: dict[str, list[str]]) -> dict[str, list[str]]:
    """Trimmed texts by name of one document; ``known`` holds which names a qualified name stands for."""
    found: dict[str, list[str]] = {}
    around: list[list[str]] = [[]]
    pieces: list[str] = []

    def done(*_: object) -> None:
        if pieces:
            if around[-1] and (text := "".join(pieces).strip(" \t\r\n")):
                for n in around[-1]:
                    found.setdefault(n, []).append(text)
            pieces.clear()

    def start(name: str, _: object) -> None:
        done()
        if name not in known:
            known[name] = [n for n in names if n in (name, name.partition(":")[2])]
        around.append(known[name])

    def end(_: str) -> None:
        done()
        around.pop()

    # without namespaces, so that names are as written and prefixes need no declaration
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, pieces.append
    # a comment or an instruction ends a text, too
    parser.CommentHandler = parser.ProcessingInstructionHandler = done
    parser.Parse(xml, True)
    return found


def member_kind(name: Column) -> Column:
    """Kind of an archive member by its path."""
    low = F.lower(name)
    return (
        F.when(low.endswith("manifest.safe"), "manifest")
        .when(low.contains("/measurement/") & low.endswith(".tiff"), "measurement")
        .when(low.contains("/annotation/calibration/calibration-"), "calibration")
        .when(low.contains("/annotation/calibration/noise-"), "noise")
        .when(low.contains("/annotation/") & low.endswith(".xml"), "annotation")
        .otherwise("other")
    )


def member_counts(members: DataFrame) -> DataFrame:
    """Per archive and kind: members per polarization."""
    low = F.lower("member")
    pol = F.when(low.contains("-vv-"), "vv").when(low.contains("-vh-"), "vh").otherwise("none")
    return members.select("archive", member_kind(F.col("member")).alias("kind"), pol.alias("pol")).groupBy("archive", "kind").agg(*[F.count_if(F.col("pol") == p).alias(p) for p in ("vv", "vh", "none")])


def changed_samples(aligned: DataFrame, source: DataFrame, value: str, row_off: int, col_off: int, keys: list[str], relative: float = 1e-6, absolute: float = 1e-7) -> DataFrame:
    """Aligned cells whose value differs from the source's at the shifted index by more than the tolerances; none expected."""
    there = source.select(*keys, (F.col("row") - row_off).alias("row"), (F.col("col") - col_off).alias("col"), F.col(value).cast("double").alias("__source"))
    met = aligned.join(there, [*keys, "row", "col"]).filter(F.col("__source").isNotNull())
    return met.filter(~F.coalesce(near(F.col(value).cast("double"), F.col("__source"), absolute + relative * F.abs("__source")), F.lit(False))).drop("__source")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
