"""Data sets: identities, numbering, splits, merging, augmentation and their checks.

Checks return the offending rows. ``require_none`` turns a check into an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from maskwright.functions.policies import CATEGORY_ID, literal_map, normalize_type_label
from maskwright.operators.numbering import number_rows

# Markers in file names of noisy copies, and fields carried as provenance.
NOISE_MARK, OLD_NOISE_MARK = "__noise_", "__snr"
PROVENANCE = ("label_source", "human_fix", "human_fix_kind", "source_candidate_id", "source_raw_index",
              "source_candidate_rle_sha1", "source_prediction_path", "final_mask_rle_sha1", "manual_note")
IMAGE_FIELDS = ("width", "height", "galaxy_id", "view_id", "orientation", "variant", "base_key", "snr_tag", "noise_tag")
ANNOTATION_FIELDS = ("category_id", "segmentation", "bbox", "area", "iscrowd")


def require_none(check: DataFrame, message: str, shown: int = 5) -> None:
    """Fail with a few of the offending rows if a check has any."""
    rows = check.limit(shown).collect()
    if rows:
        raise ValueError(f"{message}: {rows}")


# -- names and hashes --------------------------------------------------------------------


def base_key(galaxy: Column, view: Column) -> Column:
    return F.format_string("%05d_%s", galaxy, view)


def parse_base_key(key: Column) -> Column:
    """(galaxy_id, view_id); a key without a numeric prefix fails the job."""
    ok = key.rlike(r"^\d+_.+$")
    bad = F.raise_error(F.concat(F.lit("invalid base key "), key)).cast("int")
    return F.struct(
        F.when(ok, F.regexp_extract(key, r"^(\d+)_", 1).cast("int")).otherwise(bad).alias("galaxy_id"),
        F.regexp_extract(key, r"^\d+_(.+)$", 1).alias("view_id"))


def parse_sample_name(name: Column) -> Column:
    """galaxy, orientation, threshold and type of names like 00011_eo_SB27.5_streams; NULL if unlike."""
    pattern = r"^(\d+)_([a-z]+)_SB([\d.]+)_(streams|satellites)"
    return F.when(name.rlike(pattern), F.struct(
        F.regexp_extract(name, pattern, 1).cast("int").alias("galaxy_id"),
        F.regexp_extract(name, pattern, 2).alias("orientation"),
        F.regexp_extract(name, pattern, 3).try_cast("double").alias("threshold"),
        F.regexp_extract(name, pattern, 4).alias("type")))


def galaxy_of(galaxy: Column, file_name: Column) -> Column:
    """Galaxy id field, else the five digits in the file name, else an error."""
    parsed = F.regexp_extract(file_name, r"(\d{5})_", 1)
    return F.coalesce(galaxy.cast("int"), F.when(parsed != "", parsed.cast("int")),
                      F.raise_error(F.concat(F.lit("no galaxy id in "), file_name)).cast("int"))


def short_sha1(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def candidate_id(label: Column, index: Column) -> Column:
    prefix = F.when(label == "satellites", "sat").when(label == "streams", "stream").otherwise(
        F.coalesce(F.nullif(F.substring(F.replace(label, F.lit(" "), F.lit("_")), 1, 8), F.lit("")), F.lit("cand")))
    return F.format_string("%s_%04d", prefix, index)


def assign_stable_ids(masks: DataFrame, order: Sequence[Column], counts: str = "counts") -> DataFrame:
    """raw_index over the image, candidate_id per class, and the mask hash; present values stay."""
    out = number_rows(masks, ["image_id"], list(order), "_ri", start=0)
    out = number_rows(out, ["image_id", "type_label"], [F.col("_ri")], "_ti", start=0)
    new = {"raw_index": F.col("_ri"), "candidate_id": candidate_id(F.col("type_label"), F.col("_ti")),
           "candidate_rle_sha1": short_sha1(F.col(counts))}
    for name, value in new.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in masks.columns else value)
    return out.drop("_ri", "_ti")


def split_side(key: Column, ratio: float, seed: int = 42, rest: str = "val") -> Column:
    """Side of a group: first 32 bits of SHA-256 of 'seed:key' as a share of the full range."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    share = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return F.when(share < F.lit(ratio), F.lit("train")).otherwise(F.lit(rest))


def file_seed(base: int, *parts: Column) -> Column:
    """base + SHA-256 of the joined parts modulo 2^31."""
    low = F.conv(F.substring(F.sha2(F.concat_ws("_", *parts), 256), -8, 8), 16, 10).cast("long")
    return F.lit(base).cast("long") + low.bitwiseAND(F.lit(2147483647))


# -- small policies over tables -------------------------------------------------------------


def apply_prompt_thresholds(masks: DataFrame, limits: DataFrame) -> DataFrame:
    """Masks scoring at least the threshold of their class. ``limits`` is one row per class."""
    return masks.join(limits, "type_label").where("score >= min_score").drop("min_score")


def core_exclusion(masks: DataFrame, side: int, radius_frac: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """Masks with a flag for the central circle, and per-image figures. Empty masks count as hits."""
    flagged = masks.withColumn("core_hit", F.coalesce(F.col("dist_to_center") < F.lit(radius_frac * side), F.lit(True)))
    hit = F.col("core_hit")
    solid = F.coalesce("solidity", F.lit(0.0))
    figures = flagged.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_masks"), F.count_if(hit).alias("n_core"),
        F.expr("percentile(dist_to_center, array(0.05D, 0.5D, 0.95D))").alias("_q"),
        F.min(F.when(hit, F.col("area"))).alias("core_area_min"), F.max(F.when(hit, F.col("area"))).alias("core_area_max"),
        F.avg(F.when(hit, F.col("area"))).alias("core_area_mean"), F.avg(F.when(hit, solid)).alias("core_solidity_mean"))
    zero = F.lit(0.0)
    return flagged, figures.select(
        "image_id", "n_masks", "n_core", F.coalesce(F.col("_q")[0], zero).alias("dist_p05"),
        F.coalesce(F.col("_q")[1], zero).alias("dist_p50"), F.coalesce(F.col("_q")[2], zero).alias("dist_p95"),
        "core_area_min", "core_area_max", "core_area_mean", F.nullif("core_solidity_mean", zero).alias("core_solidity_mean"))


def low_confidence_probe(masks: DataFrame, low: float, top: int = 15) -> DataFrame:
    """Counts at a low threshold and the largest satellites of each image."""
    from pyspark.sql import Window as W

    seen = masks.where(F.col("score") >= F.lit(low))
    counts = seen.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_raw_total"),
                                          F.count_if(F.col("type_label") == "satellites").alias("n_raw_satellites"))
    w = W.partitionBy("image_id").orderBy(F.col("area").desc(), F.col("score").desc(), "inst_id")
    best = seen.where("type_label = 'satellites'").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return counts.join(best.select("image_id", "rank", "inst_id", "area", "score"), "image_id", "left")


def split_by_render(samples: DataFrame, renders: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Samples with a render, and those without (to be warned about)."""
    have = renders.select(*on).distinct()
    return samples.join(have, list(on), "left_semi"), samples.join(have, list(on), "left_anti")


def render_path(root: str, condition: Column, variant: Column, profile: Column, key: Column) -> Column:
    """Path of a render; a noisy condition without a profile fails the job."""
    noisy = condition != "clean"
    bad = F.raise_error(F.lit("noisy render without a profile"))
    return F.when(noisy & profile.isNull(), bad.cast("string")).when(
        noisy, F.concat_ws("/", F.lit(root), F.lit("noisy"), variant, profile, key, F.lit("0000.png"))
    ).otherwise(F.concat_ws("/", F.lit(root), F.lit("current"), variant, key, F.lit("0000.png")))


# -- numbering and order -----------------------------------------------------------------------


def renumber(images: DataFrame, annotations: DataFrame, image_order: Sequence[Column],
             annotation_order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Consecutive 1-based ids for both tables; annotations follow their image."""
    new_images = number_rows(images, [], list(image_order), "new_id")
    ids = new_images.select(F.col("id").alias("image_id"), F.col("new_id").alias("new_image_id"))
    new_ann = number_rows(annotations.join(ids, "image_id"), [], list(annotation_order), "new_id")
    return (new_images.withColumn("id", F.col("new_id")).drop("new_id"),
            new_ann.withColumn("id", F.col("new_id")).withColumn("image_id", F.col("new_image_id")).drop("new_id", "new_image_id"))


# Steps an ordering policy may name.
ORDER_STEPS = {"area_desc": ("area", True), "area_asc": ("area", False),
               "centroid_x_asc": ("centroid_x", False), "centroid_y_asc": ("centroid_y", False)}


def order_columns(policy: Sequence[str], strict: bool = True) -> list[Column]:
    """Sort columns of a policy; an unknown step is an error, or skipped if not ``strict``."""
    out = []
    for step in policy:
        if step not in ORDER_STEPS:
            if strict:
                raise ValueError(f"unknown ordering step {step!r}")
            continue
        name, down = ORDER_STEPS[step]
        col = F.coalesce(F.col(name), F.lit(0))
        out.append(col.desc() if down else col.asc())
    return out


def order_instances(masks: DataFrame, policy: Sequence[str], tie: str = "inst_id", strict: bool = True) -> DataFrame:
    return number_rows(masks, ["image_id"], [*order_columns(policy, strict), F.col(tie)], "rank")


def replay_instance_ids(sats: DataFrame, max_stream: DataFrame, policy: Sequence[str]) -> DataFrame:
    """Ids the surviving satellites got: after the largest stream id, in policy order."""
    ranked = order_instances(sats, policy).join(max_stream, "image_id", "left")
    return ranked.withColumn("instance_id", F.coalesce("max_stream_id", F.lit(0)) + F.col("rank")).drop("rank", "max_stream_id")


def resolve_replayed(requests: DataFrame, replayed: DataFrame) -> DataFrame:
    """Instance of each request by mask hash, else by candidate id; NULL where neither is known."""
    by_sha = replayed.where("candidate_rle_sha1 is not null").groupBy("image_id", "candidate_rle_sha1").agg(F.max("instance_id").alias("_s"))
    by_id = replayed.where("candidate_id is not null").groupBy("image_id", "candidate_id").agg(F.max("instance_id").alias("_c"))
    out = requests.join(by_sha, ["image_id", "candidate_rle_sha1"], "left").join(by_id, ["image_id", "candidate_id"], "left")
    return out.withColumn("instance_id", F.coalesce("_s", "_c")).drop("_s", "_c")


def select_candidate(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """One prediction per request; all given selectors must agree. Status: ok, none or ambiguous.

    ``requests``: request_id, image_id and nullable candidate_id, raw_index, candidate_rle_sha1.
    Joins on whichever selector is present, so no request is compared with a whole image.
    """
    p = predictions.select("image_id", F.col("candidate_id").alias("p_id"), F.col("raw_index").alias("p_index"),
                           F.col("candidate_rle_sha1").alias("p_sha"))
    picks = []
    for cond, left, right in (
        ("candidate_rle_sha1 is not null", "candidate_rle_sha1", "p_sha"),
        ("candidate_rle_sha1 is null and candidate_id is not null", "candidate_id", "p_id"),
        ("candidate_rle_sha1 is null and candidate_id is null and raw_index is not null", "raw_index", "p_index"),
    ):
        r = requests.where(cond)
        picks.append(r.join(p.withColumnRenamed("image_id", "_img"), (r["image_id"] == F.col("_img")) & (r[left] == F.col(right)), "left").drop("_img"))
    none = requests.where("candidate_rle_sha1 is null and candidate_id is null and raw_index is null")
    picks.append(none.selectExpr("*", "cast(null as string) p_id", "cast(null as bigint) p_index", "cast(null as string) p_sha"))
    all_ = reduce(DataFrame.unionByName, picks)
    ok = (F.col("p_index").isNotNull() & (F.col("candidate_id").isNull() | (F.col("candidate_id") == F.col("p_id")))
          & (F.col("raw_index").isNull() | (F.col("raw_index") == F.col("p_index"))))
    return all_.groupBy("request_id", "image_id").agg(F.count_if(ok).alias("_n"), F.max(F.when(ok, F.col("p_index"))).alias("_i")).select(
        "request_id", "image_id",
        F.when(F.col("_n") == 1, "ok").when(F.col("_n") == 0, "none").otherwise("ambiguous").alias("status"),
        F.when(F.col("_n") == 1, F.col("_i")).alias("raw_index"))


# -- export -------------------------------------------------------------------------------------


def resolve_mask_source(instances: DataFrame, predictions: DataFrame) -> DataFrame:
    """Where the mask of an instance row comes from: prediction, class_map or legacy_map.

    A row that claims a prediction without one in the table is marked missing; see ``unresolved``.
    """
    known = predictions.where("raw_index is not null").select("image_id", "raw_index").distinct().withColumn("_p", F.lit(1))
    out = instances.join(known, ["image_id", "raw_index"], "left")
    src = (
        F.when(F.col("_p") == 1, "prediction")
        .when(F.col("source") == "sam3_post", "missing")
        .when(F.col("map_file").isNotNull() & F.col("local_id").isNotNull(), "class_map")
        .otherwise("legacy_map"))
    return out.withColumn("mask_source", src).drop("_p")


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("mask_source = 'missing'")


def export_images(samples: DataFrame, variants: Sequence[str], renders: DataFrame, dataset: str = "dr1") -> DataFrame:
    """One row per sample and variant that has a render, in sample and variant order."""
    rows = samples.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(variants)])))
    rows = rows.select("*", F.col("_v.v").alias("variant"), F.col("_v.i").alias("variant_rank")).drop("_v")
    rows = rows.join(renders.select("base_key", "variant", "condition").distinct(), ["base_key", "variant", "condition"], "left_semi")
    plain = (F.lit(dataset) == "dr1") & (F.col("condition") == "clean")
    name = F.concat(F.col("base_key"), F.lit("_"), F.col("variant"), F.when(plain, "").otherwise(F.concat(F.lit("__"), F.col("condition"))))
    return rows.withColumn("file_name", F.concat(F.lit("images/"), name, F.lit(".png"))).withColumn("dataset", F.lit(dataset))


def export_annotations(images: DataFrame, instances: DataFrame, masks: DataFrame) -> DataFrame:
    """Annotations of every exported image: category, box, area, provenance; empty masks skipped.

    ``masks`` has area and box per (base_key, inst_id), already resolved.
    """
    cat = literal_map(CATEGORY_ID)[normalize_type_label(F.col("type_label"))].cast("long")
    rows = images.select(F.col("id").alias("image_id"), "base_key").join(instances, "base_key").join(masks, ["base_key", "inst_id"])
    return rows.where("area > 0").select("image_id", "inst_id", cat.alias("category_id"), "area", "bbox_x", "bbox_y", "bbox_w", "bbox_h",
                                         F.lit(0).alias("iscrowd"), *[c for c in PROVENANCE if c in instances.columns])


def provenance_json(row: DataFrame) -> DataFrame:
    """Provenance fields as JSON text; to_json leaves NULL fields out."""
    return row.withColumn("provenance", F.to_json(F.struct(*[c for c in PROVENANCE if c in row.columns])))


# -- splits ----------------------------------------------------------------------------------------


def group_split(images: DataFrame, ratio: float = 0.8, seed: int = 42, prior: DataFrame | None = None,
                key: str = "galaxy_id", rest: str = "val") -> DataFrame:
    """Images with ``split``; a group stays on one side, and on its earlier side if it had one.

    The side is a function of the key alone, so nothing is shuffled unless ``prior``
    (key, prior_split) is given.
    """
    if prior is None:
        return images.withColumn("split", split_side(F.col(key), ratio, seed, rest))
    known = images.join(prior.select(key, "prior_split"), key, "left")
    return known.withColumn("split", F.coalesce("prior_split", split_side(F.col(key), ratio, seed, rest))).drop("prior_split")


def holdout_split(examples: DataFrame, key: Column, holdout_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    return examples.withColumn("split", split_side(key, 1.0 - holdout_ratio, seed, "holdout"))


def split_manifest(images: DataFrame, annotations: DataFrame, key: str = "galaxy_id") -> DataFrame:
    """Groups, images and annotations per side."""
    n = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("_a"))
    per_group = images.join(n.withColumnRenamed("image_id", "id"), "id", "left").groupBy("split", key).agg(
        F.count(F.lit(1)).alias("i"), F.sum(F.coalesce("_a", F.lit(0))).alias("a"))
    return per_group.groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("i").alias("n_images"), F.sum("a").alias("n_annotations"))


def leakage(images: DataFrame, manifest: DataFrame, side: str, key: str = "galaxy_id") -> DataFrame:
    """Groups of ``images`` that belong to the other side, or to no side, of a manifest (key, split)."""
    mine = images.select(key).distinct()
    m = manifest.groupBy(key).agg(F.max(F.col("split") == side).alias("_own"), F.max(F.col("split") != side).alias("_other"))
    out = mine.join(m, key, "left")
    kind = F.when(F.coalesce("_other", F.lit(False)), "in_other_side").when(~F.coalesce("_own", F.lit(False)), "outside_own_side")
    return out.select(key, kind.alias("problem")).where("problem is not null")


def manifest_overlap(manifest: DataFrame, key: str = "galaxy_id") -> DataFrame:
    """Groups listed on both sides."""
    return manifest.groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(key)


# -- merging ------------------------------------------------------------------------------------------


def compose(sources: Sequence[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge sources (label, images, annotations): the first source with a file name keeps it.

    Returns images, annotations (both still with their old ids and ``source_rank``), and the duplicate
    file names with the fields in which the copies differ (empty string: identical).
    """
    if len(sources) == 1:
        label, images, annotations = sources[0]
        none = images.select("file_name", F.lit("").alias("differs")).limit(0)
        return images.withColumn("source_rank", F.lit(0)), annotations.withColumn("source_rank", F.lit(0)), none
    imgs = reduce(DataFrame.unionByName, [i.withColumn("dataset_source", F.lit(s)).withColumn("source_rank", F.lit(r)) for r, (s, i, _) in enumerate(sources)])
    anns = reduce(DataFrame.unionByName, [a.withColumn("source_rank", F.lit(r)) for r, (_, _, a) in enumerate(sources)])
    fields = [c for c in IMAGE_FIELDS if c in imgs.columns]
    first = imgs.groupBy("file_name").agg(F.min("source_rank").alias("_first"), F.count(F.lit(1)).alias("_n"),
                                          *[F.count_distinct(F.to_json(F.struct(c))).alias(f"_d_{c}") for c in fields])
    kept = imgs.join(first.select("file_name", "_first"), "file_name").where("source_rank = _first").drop("_first")
    kept_anns = anns.join(kept.select(F.col("id").alias("image_id"), "source_rank"), ["image_id", "source_rank"], "left_semi")
    # Copies have equal annotations when count and order-free digest of the listed fields agree.
    cols = [c for c in ANNOTATION_FIELDS if c in anns.columns]
    digest = anns.groupBy("image_id", "source_rank").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("_h"),
        F.bit_xor(F.hash(*cols)).alias("_x"))
    dup = imgs.join(first.where("_n > 1"), "file_name").select("file_name", F.col("id").alias("image_id"), "source_rank", *[f"_d_{c}" for c in fields])
    per = dup.join(digest, ["image_id", "source_rank"], "left").withColumn(
        "_sig", F.concat_ws(":", F.coalesce("_c", F.lit(0)).cast("string"), F.coalesce("_h", F.lit(0)).cast("string"), F.coalesce("_x", F.lit(0)).cast("string")))
    bad = per.groupBy("file_name").agg(*[F.max(f"_d_{c}").alias(f"_d_{c}") for c in fields],
                                       F.count_distinct("_sig").alias("_sigs"), F.count_distinct(F.coalesce("_c", F.lit(0))).alias("_counts"))
    differs = F.concat_ws(",", *[F.when(F.col(f"_d_{c}") > 1, F.lit(c)) for c in fields],
                          F.when(F.col("_counts") > 1, F.lit("annotation_count")).when(F.col("_sigs") > 1, F.lit("annotations")))
    return kept, kept_anns, bad.select("file_name", differs.alias("differs"))


def category_mismatch(sources: Sequence[DataFrame]) -> DataFrame:
    """Categories that are not the same in every source (compared with the first)."""
    ref = sources[0].select("id", "name", "supercategory")
    diffs = []
    for i, other in enumerate(sources[1:], 1):
        o = other.select("id", "name", "supercategory")
        diffs += [ref.exceptAll(o).withColumn("only_in", F.lit(0)), o.exceptAll(ref).withColumn("only_in", F.lit(i))]
    return reduce(DataFrame.unionByName, diffs)


# -- augmentation ---------------------------------------------------------------------------------------


def noise_augment(images: DataFrame, annotations: DataFrame, tags: Sequence[str],
                  noisy_variants: Sequence[str] = ("linear_magnitude",)) -> tuple[DataFrame, DataFrame]:
    """Clean rows first, then one copy per tag of each eligible image, annotations along with it.

    Copies are made by exploding a short tag list; ``copy_rank`` keeps the order for renumbering.
    """
    eligible = F.col("variant").isin(*noisy_variants)
    clean = F.array(F.struct(F.lit(0).alias("r"), F.lit("clean").alias("t")))
    noisy = F.array(*[F.struct(F.lit(i + 1).alias("r"), F.lit(t).alias("t")) for i, t in enumerate(tags)])
    rows = images.withColumn("_c", F.explode(F.when(eligible, F.concat(clean, noisy)).otherwise(clean)))
    tag = F.col("_c.t")
    file = F.when(F.col("_c.r") == 0, F.col("file_name")).otherwise(F.concat(
        F.lit("images/"), F.col("base_key"), F.lit("_"), F.col("variant"), F.lit(NOISE_MARK), F.replace(tag, F.lit("."), F.lit("p")), F.lit(".png")))
    out = rows.select(*[c for c in images.columns if c not in ("file_name",)], file.alias("file_name"),
                      F.col("file_name").alias("source_file_name"), F.col("id").alias("source_image_id_in_base"),
                      tag.alias("snr_tag"), tag.alias("noise_tag"), F.col("_c.r").alias("copy_rank"))
    keys = out.select(F.col("source_image_id_in_base").alias("image_id"), "copy_rank")
    anns = annotations.join(keys, "image_id").withColumn("source_annotation_id_in_base", F.col("id"))
    return out, anns


def already_augmented(images: DataFrame) -> DataFrame:
    """Images that carry a noise tag or a noise marker in their name."""
    tagged = [F.coalesce(F.col(c) != "clean", F.lit(False)) for c in ("snr_tag", "noise_tag") if c in images.columns]
    named = F.coalesce(F.col("file_name").contains(OLD_NOISE_MARK) | F.col("file_name").contains(NOISE_MARK), F.lit(False))
    return images.where(reduce(Column.__or__, tagged, named))


def dimension_check(images: DataFrame, renders: DataFrame, on: Sequence[str]) -> DataFrame:
    """Images whose render is missing or of another size (render_width, render_height)."""
    out = images.join(renders, list(on), "left")
    return out.withColumn("problem", F.when(F.col("render_width").isNull(), "missing").when(
        (F.col("width") != F.col("render_width")) | (F.col("height") != F.col("render_height")), "size")).where("problem is not null")


def coverage_missing(keys: DataFrame, renders: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(base_key, noise_tag) pairs without a noisy render."""
    want = keys.select("base_key").distinct().withColumn("noise_tag", F.explode(F.array(*[F.lit(t) for t in tags])))
    return want.join(renders.select("base_key", "noise_tag").distinct(), ["base_key", "noise_tag"], "left_anti")


def expected_counts(images: DataFrame, annotations: DataFrame, n_tags: int,
                    noisy_variants: Sequence[str] = ("linear_magnitude",)) -> DataFrame:
    """Images and annotations an augmented set must have, as one row."""
    n = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("_a"))
    rows = images.join(n.withColumnRenamed("image_id", "id"), "id", "left")
    times = F.when(F.col("variant").isin(*noisy_variants), F.lit(1 + n_tags)).otherwise(F.lit(1))
    return rows.agg(F.sum(times).cast("long").alias("n_images"), F.sum(times * F.coalesce("_a", F.lit(0))).cast("long").alias("n_annotations"))


def view_problems(images: DataFrame, views: Sequence[str], key_pattern: str, noisy_variants: Sequence[str]) -> DataFrame:
    """Images with a view or key outside the allowed ones, or a noisy copy of a wrong variant."""
    noisy = (F.coalesce(F.col("noise_tag"), F.lit("clean")) != "clean") | F.coalesce(F.col("file_name").contains(NOISE_MARK), F.lit(False))
    why = (F.when(~F.col("view_id").isin(*views), "view").when(~F.col("base_key").rlike(key_pattern), "base_key")
           .when(noisy & ~F.col("variant").isin(*noisy_variants), "noisy_variant"))
    return images.withColumn("problem", why).where("problem is not null")


# -- conditions, shadows, bookkeeping ------------------------------------------------------------------------


def clone_condition(instances: DataFrame, conditions: Sequence[str], origin: str = "clean") -> DataFrame:
    """Copy the labels of the clean condition to others, with where they came from."""
    rows = instances.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    return rows.withColumn("cloned_from_condition", F.lit(origin)).withColumn("label_mode", F.lit("inherited_from_clean"))


def missing_artifacts(samples: DataFrame, artifacts: DataFrame, required: Sequence[str]) -> DataFrame:
    """(base_key, artifact) pairs that are required and absent."""
    want = samples.select("base_key").distinct().withColumn("artifact", F.explode(F.array(*[F.lit(a) for a in required])))
    return want.join(artifacts.select("base_key", "artifact").distinct(), ["base_key", "artifact"], "left_anti")


def pending_samples(samples: DataFrame, artifacts: DataFrame, required: Sequence[str], forced: Sequence[str] = ()) -> DataFrame:
    """Samples still to do: not every required artifact exists, or the sample is forced."""
    done = artifacts.where(F.col("artifact").isin(*required)).select("base_key", "artifact").distinct().groupBy("base_key").agg(
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(set(required)))
    if forced:
        done = done.where(~F.col("base_key").isin(*forced))
    return samples.join(done, "base_key", "left_anti")


def shadow_bootstrap(instances: DataFrame, galaxies: Sequence[int] | None = None, stream_label: str = "streams") -> DataFrame:
    """Stream instances only, for the wanted galaxies."""
    rows = instances.where(F.col("type_label") == stream_label)
    return rows if galaxies is None else rows.where(F.col("galaxy_id").isin(*galaxies))


def satellite_leak(shadow: DataFrame) -> DataFrame:
    return shadow.where("type_label = 'satellites'")


def threshold_categories(thresholds: DataFrame) -> DataFrame:
    """A stream and a satellite category per threshold with consecutive ids (a list of a few limits)."""
    text = F.when(F.col("threshold") == F.floor("threshold"), F.floor("threshold").cast("string")).otherwise(F.col("threshold").cast("string"))
    kinds = F.array(F.struct(F.lit(0).alias("k"), F.lit("stellar_stream").alias("n")), F.struct(F.lit(1).alias("k"), F.lit("satellite").alias("n")))
    rows = thresholds.select("threshold", "position", text.alias("_t"), F.explode(kinds).alias("_k"))
    return rows.select((F.col("position") * 2 + F.col("_k.k") + 1).cast("long").alias("id"),
                       F.concat(F.col("_k.n"), F.lit("_SB"), F.col("_t")).alias("name"), F.col("_k.n").alias("supercategory"), "threshold")


def view_index(galaxies: DataFrame, vectors: Sequence[tuple[float, float, float]]) -> tuple[DataFrame, DataFrame]:
    """One row per galaxy and viewing direction, and the number of views per galaxy."""
    los = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(c)).alias(n) for c, n in zip(v, "xyz")]) for i, v in enumerate(vectors)])
    rows = galaxies.withColumn("_v", F.explode(los)).select(
        "galaxy_id", F.format_string("los%02d", F.col("_v.i")).alias("view_id"), F.col("_v.x").alias("vx"), F.col("_v.y").alias("vy"), F.col("_v.z").alias("vz"))
    rows = rows.withColumn("base_key", base_key(F.col("galaxy_id"), F.col("view_id")))
    return rows, rows.groupBy("galaxy_id").agg(F.count(F.lit(1)).alias("n_views"))


def prefer_grouped_source(files: DataFrame) -> DataFrame:
    """Of several files for a key keep the one under the folder of its galaxy, else the first path."""
    grouped = F.col("path").contains(F.concat(F.lit("/"), F.substring("base_key", 1, 5), F.lit("/")))
    return files.groupBy("profile", "base_key").agg(F.min(F.struct((~grouped).cast("int").alias("_g"), "path")).alias("_b")).select(
        "profile", "base_key", F.col("_b.path").alias("path"))


def regroup_plan(files: DataFrame, views_complete: int = 24) -> tuple[DataFrame, DataFrame]:
    """Target path of each flat file under its galaxy, and which galaxies have all views."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.withColumn("_n", name).where(F.col("_n").rlike(r"^\d+_[^.]+"))
    rows = rows.withColumn("galaxy_id", F.regexp_extract("_n", r"^(\d+)_", 1).cast("int")).withColumn("view_id", F.regexp_extract("_n", r"^\d+_([^.]+)", 1))
    plan = rows.select("condition", "path", "galaxy_id", "view_id", F.concat(F.format_string("%05d", F.col("galaxy_id")), F.lit("/"), F.col("_n")).alias("target"))
    views = plan.select("condition", "galaxy_id", "view_id").distinct().groupBy("condition", "galaxy_id").agg(F.count(F.lit(1)).alias("n_views"))
    return plan, views.withColumn("complete", F.col("n_views") == views_complete)


def manifest_counters(instances: DataFrame) -> DataFrame:
    """Per sample: raw and post counts, kept per class, largest ids."""
    kept = F.col("kept_in_post")
    return instances.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(kept).alias("n_post"),
        *[F.count_if(kept & (F.col("type_label") == c)).alias(f"n_{c}") for c in CATEGORY_ID],
        F.max(F.when(F.col("type_label") == "tidal_features", F.col("inst_id"))).alias("max_stream_id"),
        F.max(F.when(kept, F.col("inst_id"))).alias("max_final_id"))


def rebuild_dataset(images: DataFrame, annotations: DataFrame, tags: Sequence[str], ratio: float = 0.8, seed: int = 42,
                    prior: DataFrame | None = None, noisy_variants: Sequence[str] = ("linear_magnitude",)) -> tuple[DataFrame, DataFrame]:
    """Split by group, then augment; every clean image and its copies share one side.

    Returns images and annotations of both sides with ``split``, numbered per side.
    """
    sided = group_split(images, ratio, seed, prior)
    imgs, anns = noise_augment(sided, annotations, tags, noisy_variants)
    imgs = number_rows(imgs, ["split"], [F.least("copy_rank", F.lit(1)), F.col("source_image_id_in_base"), F.col("copy_rank")], "new_id")
    link = imgs.select(F.col("source_image_id_in_base").alias("image_id"), "copy_rank", "split", F.col("new_id").alias("new_image_id"))
    anns = anns.join(link, ["image_id", "copy_rank"])
    anns = number_rows(anns, ["split"], [F.col("new_image_id"), F.col("source_annotation_id_in_base")], "new_id")
    return imgs.withColumn("id", F.col("new_id")).drop("new_id"), anns.withColumn("id", F.col("new_id")).withColumn(
        "image_id", F.col("new_image_id")).drop("new_id", "new_image_id")


def class_manifest(shapes: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Shapes per class and galaxy, one column per class of a fixed list."""
    return shapes.groupBy("galaxy").agg(*[F.count_if(F.col("type") == c).alias(c) for c in classes], F.count("type").alias("n_shapes"))


def annotation_tally(images: DataFrame, annotations: DataFrame, categories: Sequence[tuple[int, str]]) -> DataFrame:
    """Images regrouped by (galaxy_view, variant) from their file name, instances per class."""
    stem = F.regexp_extract("file_name", r"([^/]+)\.png$", 1)
    keyed = images.select("id", F.regexp_extract(stem, r"^(\d+_[^_]+)_", 1).alias("galaxy_view"), F.regexp_extract(stem, r"^\d+_[^_]+_(.+)$", 1).alias("variant"))
    per = annotations.groupBy("image_id").agg(*[F.count_if(F.col("category_id") == i).alias(n) for i, n in categories])
    out = keyed.join(per.withColumnRenamed("image_id", "id"), "id", "left").na.fill(0)
    return out.groupBy("galaxy_view", "variant").agg(F.count(F.lit(1)).alias("n_images"), *[F.sum(n).alias(n) for _, n in categories])
