"""Readers: documents, line files, catalogues, region files, rasters."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

PREDICTION = T.StructType([
    T.StructField("type_label", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("area", T.LongType()),
    T.StructField("bbox_xywh", T.ArrayType(T.DoubleType())),
    T.StructField("rle", T.StructType([T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("counts", T.StringType())])),
    T.StructField("candidate_id", T.StringType()), T.StructField("raw_index", T.LongType()), T.StructField("candidate_rle_sha1", T.StringType()),
    *[T.StructField(n, T.DoubleType()) for n in ("stability_score", "area_clean", "solidity", "aspect_sym_moment", "dist_to_center", "curvature_ratio", "centroid_x", "centroid_y")],
    T.StructField("filter_status", T.StringType()), T.StructField("reject_reason", T.StringType()),
])


def read_predictions(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Candidates of prediction documents: ``{"predictions": [...]}`` or a bare list.

    A file is one document, or with ``per_line`` (as ``write_documents`` leaves them) every line is one, so files may be
    large and are split. One row per prediction with ``file`` and its 0-based ``position`` in the document.
    """
    doc = spark.read.text(path, wholetext=not per_line).select(F.input_file_name().alias("file"), F.trim("value").alias("v")).where("v <> ''")
    whole = T.StructType([T.StructField("predictions", T.ArrayType(PREDICTION))])
    rows = F.when(F.col("v").startswith("["), F.from_json("v", T.ArrayType(PREDICTION), {"mode": "FAILFAST"})).otherwise(
        F.from_json("v", whole, {"mode": "FAILFAST"})["predictions"])
    return doc.select("file", F.posexplode(rows).alias("position", "p")).select("file", "position", "p.*")


def read_list_documents(spark: SparkSession, path: str, schema: T.StructType, per_line: bool = False) -> DataFrame:
    """Rows of JSON documents that must be lists, one a file or one a line; another form fails the job."""
    doc = spark.read.text(path, wholetext=not per_line).select(F.input_file_name().alias("file"), F.trim("value").alias("v")).where("v <> ''")
    bad = F.raise_error(F.concat(F.lit("not a list: "), F.col("file"))).cast(T.ArrayType(schema))
    rows = F.when(F.col("v").startswith("["), F.from_json("v", T.ArrayType(schema), {"mode": "FAILFAST"})).otherwise(bad)
    return doc.select("file", F.explode(rows).alias("r")).select("file", "r.*")


def read_coco(spark: SparkSession, path: str, image: T.StructType, annotation: T.StructType) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of one COCO document."""
    category = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("supercategory", T.StringType())])
    schema = T.StructType([T.StructField("images", T.ArrayType(image)), T.StructField("annotations", T.ArrayType(annotation)), T.StructField("categories", T.ArrayType(category))])
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return tuple(doc.select(F.explode(c).alias("r")).select("r.*") for c in ("images", "annotations", "categories"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one fails the job."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` of text files: lines of a file are numbered from 1, whatever ranges it is read in.

    A byte range is read in order by one task, so its lines have consecutive ids there; how many lines the earlier
    ranges of the file hold is one aggregate over all lines, with one row per range.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select("file", "_start", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    return lines.join(offsets, ["file", "_start"]).select("file", (F.col("_at") + F.col("_off")).alias("line_no"), "value")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """File and 1-based number of lines that are no JSON objects, for the error message."""
    bad = F.expr("try_parse_json(value) is null or schema_of_variant(try_parse_json(value)) not like 'OBJECT%'")
    return numbered_lines(spark, path).where("trim(value) <> ''").where(bad).select("file", "line_no")


def read_coco_lines(spark: SparkSession, path: str, image: T.StructType, annotation: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Images and annotations (with ``image_id``) of a COCO document cut into one line per image."""
    schema = T.StructType([*image.fields, T.StructField("annotations", T.ArrayType(annotation))])
    rows = read_jsonl(spark, path, schema)
    return rows.drop("annotations"), rows.select(F.col("id").alias("image_id"), F.explode("annotations").alias("a")).select("image_id", "a.*")


def flatten_catalogue(nested: DataFrame) -> DataFrame:
    """Rows of a nested catalogue: key 'gid, view' -> map of 'SBlim<x>' -> map of object id -> figures.

    ``nested``: galaxy_key STRING, limits MAP<STRING, MAP<STRING, STRUCT<...>>>.
    """
    a = nested.select("galaxy_key", F.explode("limits").alias("limit_name", "objects"))
    b = a.select("galaxy_key", "limit_name", F.explode_outer("objects").alias("sat_id", "o"))
    return b.select(
        F.trim(F.split("galaxy_key", ",")[0]).cast("int").alias("galaxy_id"), F.trim(F.split("galaxy_key", ",")[1]).alias("view_id"),
        F.regexp_extract("limit_name", r"([\d.]+)", 1).cast("double").alias("sb_limit"), F.col("sat_id").cast("int").alias("sat_id"), "o.*")


# Region class names as written and as used.
REGION_TYPES = {"Inner Galaxy": "Inner", "Inner": "Inner", "Halo": "Halo", "Shells": "Shells", "Stream": "Stream", "Tail": "Tail"}


def parse_regions(lines: DataFrame) -> DataFrame:
    """Shapes of region files. ``lines``: file, line_no, value.

    A comment ``# Feature<id> <galaxy> <type>`` names the next ``polygon(...)`` or ``line(...)``;
    other lines in between do not matter. Unknown types and shapes with bad, fewer than four, or
    an odd number of coordinates are dropped. Order only matters inside one (small) file.
    """
    from maskwright.functions.policies import literal_map

    head, shape = r"^#\s*Feature(\d+)\s+(\S+)\s+(.+?)\s*$", r"^(polygon|line)\(([^)]+)\)"
    text = F.trim("value")
    events = lines.select("file", "line_no", text.alias("v")).where(F.col("v").rlike(head) | F.col("v").rlike(shape))
    rows = events.withColumn("_h", F.lag("v").over(W.partitionBy("file").orderBy("line_no")))
    rows = rows.where(F.col("v").rlike(shape) & F.coalesce(F.col("_h").rlike(head), F.lit(False)))
    kind = literal_map(REGION_TYPES)[F.regexp_extract("_h", head, 3)]
    nums = F.transform(F.split(F.regexp_extract("v", shape, 2), ","), lambda x: F.trim(x).try_cast("double"))
    out = rows.select("file", "line_no", F.regexp_extract("_h", head, 1).cast("long").alias("feature_id"), F.regexp_extract("_h", head, 2).alias("galaxy"),
                      kind.alias("type"), F.regexp_extract("v", shape, 1).alias("kind"), nums.alias("n"))
    good = out.where(F.col("type").isNotNull() & (F.size("n") >= 4) & (F.size("n") % 2 == 0) & ~F.exists("n", lambda x: x.isNull()))
    verts = F.expr("transform(sequence(0, size(n) div 2 - 1), i -> struct(get(n, 2 * i) as ra, get(n, 2 * i + 1) as dec))")
    return good.select("file", "line_no", "feature_id", "galaxy", "type", "kind", verts.alias("verts"))


def read_fixed_width(lines: DataFrame, columns: Sequence[tuple[str, int, int, str]]) -> DataFrame:
    """Columns (name, first, last, type; 1-based bytes) of fixed-width text; unreadable rows are left out."""
    cols = [F.expr(f"try_cast(nullif(trim(substring(value, {a}, {b - a + 1})), '') as {kind})").alias(n) for n, a, b, kind in columns]
    return lines.select(*cols).dropna(how="any")


def enumerate_grid(galaxies: DataFrame, views: Sequence[str]) -> DataFrame:
    """Sample universe of galaxies times a short list of views."""
    rows = galaxies.select("galaxy_id", F.explode(F.array(*[F.lit(v) for v in views])).alias("view_id"))
    return rows.withColumn("base_key", F.concat(F.format_string("%05d", "galaxy_id"), F.lit("_"), F.col("view_id")))


def enumerate_paths(paths: DataFrame, pattern: str = r"(\d{5})_([^/_.]+)") -> DataFrame:
    """Sample universe from file names."""
    hit = paths.where(F.col("path").rlike(pattern))
    return hit.select(F.regexp_extract("path", pattern, 1).cast("int").alias("galaxy_id"), F.regexp_extract("path", pattern, 2).alias("view_id")).distinct()


def artifact_manifest(spark: SparkSession, path: str, first_mib_only: bool = False) -> DataFrame:
    """SHA-1 and SHA-256 of every file under a path (optionally of its first MiB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    content = F.substring("content", 1, 1 << 20) if first_mib_only else F.col("content")
    return files.select("path", "length", F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"))


# -- images -------------------------------------------------------------------------------------

_FITS_TYPES = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def fits_image(blob: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header cards and array of the primary image of a (gzipped) FITS file."""
    raw = gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob
    cards: dict[str, str] = {}
    pos, done = 0, False
    while not done:
        for i in range(pos, pos + 2880, 80):
            card = raw[i:i + 80].decode("ascii", "replace")
            if card.startswith("END") and card[3:].strip() == "":
                done = True
                break
            if card[8:10] == "= ":
                text = re.match(r"\s*'((?:[^']|'')*)'|([^/]*)", card[10:])
                cards[card[:8].strip()] = (text.group(1) if text.group(1) is not None else text.group(2)).strip()
        pos += 2880
    dims = [int(cards[f"NAXIS{i}"]) for i in range(int(cards["NAXIS"]), 0, -1)]
    kind = np.dtype(_FITS_TYPES[int(cards["BITPIX"])])
    data = np.frombuffer(raw, kind, int(np.prod(dims)), pos).reshape(dims)
    scale, zero = float(cards.get("BSCALE", 1)), float(cards.get("BZERO", 0))
    if scale != 1 or zero != 0:
        data = data * scale + zero
    return cards, data


def png_gray(blob: bytes) -> np.ndarray:
    """Array of a non-interlaced 8 or 16 bit gray or palette PNG."""
    pos, idat, head = 8, [], None
    while pos < len(blob):
        n = int.from_bytes(blob[pos:pos + 4], "big")
        kind, body = blob[pos + 4:pos + 8], blob[pos + 8:pos + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            idat.append(body)
        pos += 12 + n
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    if head[8] not in (8, 16) or head[9] not in (0, 3) or head[12]:
        raise ValueError("unsupported PNG form")
    step = head[8] // 8
    flat = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, w * step + 1)
    out = np.zeros((h, w * step), np.uint8)
    zero = np.zeros(w * step, np.uint8)
    for y in range(h):
        f, line, up = flat[y, 0], flat[y, 1:].copy(), out[y - 1] if y else zero
        if f == 2:
            line += up
        elif f == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif f in (3, 4):
            for i in range(len(line)):
                a = int(line[i - step]) if i >= step else 0
                b, c = int(up[i]), int(up[i - step]) if i >= step else 0
                if f == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                line[i] = (int(line[i]) + guess) & 255
        out[y] = line
    return out if step == 1 else out.view(">u2").astype(np.int32)


def raster(blob: bytes) -> np.ndarray:
    if blob[:6] == b"\x93NUMPY":
        return np.load(io.BytesIO(blob))
    if blob[:4] == b"\x89PNG":
        return png_gray(blob)
    return fits_image(blob)[1]


def read_instance_maps(spark: SparkSession, path: str) -> DataFrame:
    """Runs of every label in instance rasters (NPY, gray PNG, integer FITS), one file per task row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, blob in zip(pdf["path"], pdf["content"]):
                img = raster(blob).astype(np.int64)
                edge = np.ones((img.shape[0], img.shape[1] + 1), bool)
                edge[:, 1:-1] = img[:, 1:] != img[:, :-1]
                y, x = np.nonzero(edge)
                keep = x < img.shape[1]
                end = np.append(x[1:], 0)
                ys, x0, x1 = y[keep], x[keep], end[keep]
                ids = img[ys, x0]
                on = ids > 0
                yield pd.DataFrame({"path": p, "inst_id": ids[on], "y": ys[on], "x0": x0[on], "x1": x1[on]})

    return files.mapInPandas(job, "path string, inst_id long, y int, x0 int, x1 int")


def read_photometric(spark: SparkSession, path: str) -> DataFrame:
    """One row per image line: path, header map, y, values (float)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, blob in zip(pdf["path"], pdf["content"]):
                cards, img = fits_image(blob)
                img = img.astype(np.float32)
                for a in range(0, img.shape[0], 256):
                    part = img[a:a + 256]
                    yield pd.DataFrame({"path": p, "header": [cards] * len(part), "y": np.arange(a, a + len(part)), "values": list(part)})

    return files.mapInPandas(job, "path string, header map<string,string>, y int, values array<float>")
