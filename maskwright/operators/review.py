"""Review data: weak labels, examples, revisions, corrections and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from maskwright.operators.quantiles import exact_quantiles


def reject_candidates(raw: DataFrame, post: DataFrame, pairs: DataFrame, max_iou: float = 0.3) -> DataFrame:
    """Raw masks that did not survive (by mask hash) and do not match a ground truth."""
    near = pairs.where(F.col("iou") > F.lit(max_iou)).select("image_id", F.col("pred_id").alias("inst_id")).distinct()
    kept = post.select("image_id", "candidate_rle_sha1").distinct()
    return raw.join(kept, ["image_id", "candidate_rle_sha1"], "left_anti").join(near, ["image_id", "inst_id"], "left_anti")


# Labels allowed per task family, reason codes, link states, safe variants, stages.
LABEL_SPACES = {
    "satellite_mv": ("accept", "minor_fix", "reject", "route_to_ev"),
    "satellite_ev": ("confirm_complete", "add_missing", "confirm_empty"),
    "stream_ev": ("confirm_complete", "add_missing_fragment", "delete_fragment", "redraw", "confirm_empty", "uncertain"),
}
REASON_CODES = ("uncertain_extension", "ambiguous_link", "halo_confusion", "escalate")
LINK_STATES = ("superseded", "active")
WRITEBACK_VARIANTS = ("gt_complete", "gt_empty")
ID_LIMIT = 255


def _allowed(family: Column, label: Column) -> Column:
    ok = F.lit(False)
    for name, labels in LABEL_SPACES.items():
        ok = ok | ((family == name) & label.isin(*labels))
    return F.coalesce(ok, F.lit(False))


def invalid_labels(rows: DataFrame) -> DataFrame:
    """Rows whose label is not of their family, or whose reason code is not allowed."""
    bad = ~_allowed(F.col("family"), F.col("label"))
    if "reason_code" in rows.columns:
        code = F.col("reason_code")
        bad = bad | (code.isNotNull() & ((F.col("family") != "stream_ev") | ~code.isin(*REASON_CODES)))
    return rows.where(bad)


def invalid_links(links: DataFrame) -> DataFrame:
    return links.where(~F.coalesce(F.col("status").isin(*LINK_STATES), F.lit(False)))


# -- weak labels --------------------------------------------------------------------------------


class SilverPolicy:
    """Thresholds of the weak labels; keyword arguments override the defaults."""

    # Fixed values.
    DEFAULTS = {"accept_iou": 0.7, "reject_iou": 0.1, "min_area_ratio": 0.5, "max_area_ratio": 2.0, "boundary_f1": 0.3,
                "confidence": 0.5, "ambiguity_gap": 0.15, "mixed_dominance": 3.0}

    def __init__(self, **over: float):
        unknown = set(over) - set(self.DEFAULTS)
        if unknown:
            raise ValueError(f"unknown thresholds {sorted(unknown)}")
        self.values = {**self.DEFAULTS, **over}

    def __getattr__(self, name: str):
        try:
            return F.lit(float(self.__dict__["values"][name]))
        except KeyError as e:
            raise AttributeError(name) from e


def silver_mv(matches: DataFrame, coverage: DataFrame, policy: SilverPolicy | None = None) -> DataFrame:
    """Weak label of each candidate; candidates that cannot be decided are left out."""
    p = policy or SilverPolicy()
    c = F.col
    rows = matches.join(coverage.select("image_id", "exhaustivity_confident"), "image_id")
    unclear = c("overlaps_multiple_gt") | ((c("second_best_iou") > 0) & (c("best_iou") - c("second_best_iou") < p.ambiguity_gap))
    good = (
        (c("best_iou") >= p.accept_iou) & c("area_ratio").between(p.min_area_ratio, p.max_area_ratio)
        & (c("boundary_f1") >= p.boundary_f1) & (c("confidence_score") >= p.confidence))

    def out(label: str, confidence: Column) -> Column:
        return F.struct(F.lit(label).alias("decision_label"), confidence.cast("double").alias("confidence"))

    label = (
        F.when(c("filter_status").isin("prior_rejected", "core_rejected"), out("reject", F.lit(0.95)))
        .when(c("best_iou") < p.reject_iou, out("reject", F.lit(0.90)))
        .when(unclear, F.lit(None))
        .when(F.coalesce(good, F.lit(False)), out("accept", c("best_iou")))
        .when(~c("exhaustivity_confident"), out("route_to_ev", F.lit(0.5))))
    signals = ("best_iou", "second_best_iou", "area_ratio", "boundary_f1", "confidence_score", "filter_status", "overlaps_multiple_gt")
    return rows.withColumn("_l", label).where("_l is not null").select(
        "image_id", "pred_id", "best_gt_id", "_l.decision_label", F.round("_l.confidence", 4).alias("confidence"),
        F.col("_l.confidence").alias("raw_confidence"), F.struct(*signals).alias("signals"))


def silver_mv_by_instance(labels: DataFrame, index: str = "pred_id") -> DataFrame:
    """Best label other than reject per ground truth: accept first, then confidence, then order."""
    rank = F.when(F.col("decision_label") == "accept", 2).when(F.col("decision_label") == "route_to_ev", 1).otherwise(0)
    best = F.max(F.struct(rank.alias("r"), "raw_confidence", (-F.col(index)).alias("i"), "decision_label", "confidence"))
    return labels.where("best_gt_id is not null and decision_label <> 'reject'").groupBy("image_id", "best_gt_id").agg(best.alias("_b")).select(
        "image_id", F.col("best_gt_id").alias("inst_id"), F.format_string("inst_%03d", "best_gt_id").alias("candidate_key"),
        F.col("_b.decision_label").alias("decision_label"), F.col("_b.confidence").alias("confidence"))


def ev_variants(instances: DataFrame, images: DataFrame, hide: int, missing_label: str) -> DataFrame:
    """Variants of each image: complete, empty, or the largest ``hide`` instances hidden.

    Ids are listed largest first (smaller id on ties). The list is the output itself; the hidden
    ones come from a rank limited before the shuffle.
    """
    w = W.partitionBy("image_id").orderBy(F.col("area").desc(), "inst_id")
    top = instances.select("image_id", "inst_id", "area").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= hide)
    hidden = top.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "inst_id"))), lambda s: s["inst_id"]).alias("hidden"))
    all_ids = instances.groupBy("image_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("a"), "inst_id"))), lambda s: s["inst_id"]).alias("ids"))
    none = F.array().cast("array<bigint>")
    base = images.select("image_id").distinct().join(all_ids, "image_id", "left").join(hidden, "image_id", "left")

    def variant(name: Column, label: str, seen: Column, gone: Column) -> Column:
        return F.struct(name.alias("variant_id"), F.lit(label).alias("decision_label"), seen.alias("visible_instance_ids"), gone.alias("hidden_instance_ids"))

    dropped = F.concat(F.lit("drop_top"), F.size("hidden").cast("string"))
    some = F.array(variant(F.lit("gt_complete"), "confirm_complete", F.col("ids"), none),
                   variant(dropped, missing_label, F.array_except("ids", "hidden"), F.col("hidden")))
    empty = F.array(variant(F.lit("gt_empty"), "confirm_empty", none, none))
    return base.select("image_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("num_instances"),
                       F.explode(F.when(F.col("ids").isNull(), empty).otherwise(some)).alias("v")).select(
        "image_id", F.concat(F.lit("image:"), F.col("v.variant_id")).alias("candidate_key"), "v.*", F.lit(1.0).alias("confidence"), "num_instances")


def ev_from_predictions(coverage: DataFrame, policy: SilverPolicy | None = None, stream: bool = False) -> DataFrame:
    """Image labels from prediction coverage; undecided images are left out."""
    p = policy or SilverPolicy()
    c = F.col
    gt, lost, extra = c("num_gt"), c("num_gt_unmatched"), c("num_pred_unmatched")

    def out(label: str, confidence) -> Column:
        value = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(label).alias("decision_label"), value.cast("double").alias("confidence"))

    empty = (gt == 0) & (extra == 0)
    if stream:
        label = (F.when(empty, out("confirm_empty", 0.95))
                 .when(c("exhaustivity_confident"), out("confirm_complete", c("mean_matched_iou")))
                 .when(lost > 0, out("add_missing_fragment", 0.5)).when(extra > 0, out("delete_fragment", 0.5)))
    else:
        gfrac = F.coalesce(F.try_divide("unmatched_gt_area", "total_gt_area"), F.lit(0.0))
        pfrac = F.coalesce(F.try_divide("unmatched_pred_area", "total_pred_area"), F.lit(0.0))
        label = (F.when(empty, out("confirm_empty", 0.95))
                 .when((lost == 0) & (extra == 0), out("confirm_complete", c("mean_matched_iou")))
                 .when((extra > 0) & (lost == 0), out("remove_fp", 0.6)).when((lost > 0) & (extra == 0), out("add_missing", 0.6))
                 .when(pfrac >= gfrac * p.mixed_dominance, out("remove_fp", 0.55))
                 .when(gfrac >= pfrac * p.mixed_dominance, out("add_missing", 0.55)))
    return coverage.withColumn("_l", label).where("_l is not null").select("image_id", "_l.*")


# -- hashes ------------------------------------------------------------------------------------------


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of parts joined by NUL; a NULL part counts as an empty one."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def rle_json(height: Column, width: Column, counts: Column) -> Column:
    """Mask as JSON with sorted keys and no blanks."""
    return F.to_json(F.struct(counts.alias("counts"), F.array(height, width).alias("size")))


def revision_hash_mv(sample: Column, revision: Column, spec: Column, prompt: Column, mask_json: Column, box_json: Column,
                     crop_json: Column, context_sha1: Column, source: Column, instance: Column) -> Column:
    return joined_hash(F.lit("satellite_mv"), sample, revision, spec, prompt, mask_json, box_json, crop_json, context_sha1, source, instance)


def revision_hash_ev(family: Column, sample: Column, revision: Column, spec: Column, prompt: Column, image_sha1: Column,
                     state_hash: Column, hints_hash: Column, variant: Column) -> Column:
    """Optional parts (hints, variant) only take part when present."""
    fixed = [F.coalesce(p.cast("string"), F.lit("")) for p in (family, sample, revision, spec, prompt, image_sha1, state_hash)]
    return F.sha2(F.concat_ws("\x00", *fixed, hints_hash, variant), 256)


def annotation_state_hash(runs: DataFrame, instances: DataFrame) -> DataFrame:
    """Digest of all masks and instance rows of an image, in two levels.

    Each mask is hashed over its ordered runs, each image over its ordered instance digests, so
    what is collected at once is one mask or one digest per instance.
    """
    per_mask = runs.groupBy("image_id", "inst_id").agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))),
        lambda r: F.concat_ws(",", r["y"].cast("string"), r["x0"].cast("string"), r["x1"].cast("string"))), ";"), 256).alias("_m"))
    rows = instances.select("image_id", "inst_id", "type_label").join(per_mask, ["image_id", "inst_id"], "left")
    line = F.concat_ws(":", F.col("inst_id").cast("string"), "type_label", F.coalesce("_m", F.lit("")))
    per_image = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("inst_id", line.alias("l")))).alias("_r"))
    return per_image.select("image_id", F.sha2(F.array_join(F.transform("_r", lambda r: r["l"]), "\n"), 256).alias("annotation_state_hash"))


# -- examples -----------------------------------------------------------------------------------------


def examples_mv(instances: DataFrame, boxes: DataFrame, contexts: DataFrame, spec_id: str, prompt_id: str, crop_size: int = 384,
                source: str = "authoritative", label: Column | None = None) -> DataFrame:
    """Examples of single masks: box, crop centre, label and revision hash. Empty masks are left out.

    ``instances``: image_id, inst_id, sample_id, rle_json, decision_label (or ``label``);
    ``contexts``: sample_id, bare_context_sha1.
    """
    rows = instances.join(boxes, ["image_id", "inst_id"]).where("bbox_w > 0").join(contexts, "sample_id")
    ints = [F.col(c).cast("int") for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")]
    cx, cy = ints[0] + F.expr("cast(bbox_w as int) div 2"), ints[1] + F.expr("cast(bbox_h as int) div 2")
    rejected = source != "authoritative"
    inst = F.lit(None).cast("long") if rejected else F.col("inst_id")
    key = F.format_string("rej_raw_rejected_%03d", "inst_id") if rejected else F.format_string("inst_%03d", "inst_id")
    box = F.concat(F.lit("["), F.concat_ws(",", *[i.cast("string") for i in ints]), F.lit("]"))
    crop = F.concat(F.lit("["), F.concat_ws(",", cx.cast("string"), cy.cast("string"), F.lit(str(crop_size)), F.lit('"zero"')), F.lit("]"))
    h = revision_hash_mv(F.col("sample_id"), F.lit("rev_00"), F.lit(spec_id), F.lit(prompt_id), F.col("rle_json"), box, crop,
                         F.col("bare_context_sha1"), F.lit(source), inst)
    return rows.select(
        F.lit("satellite_mv").alias("task_family"), "image_id", "inst_id", "sample_id", key.alias("candidate_id"), cx.alias("center_x"), cy.alias("center_y"),
        box.alias("candidate_bbox_xywh"), F.lit(source).alias("candidate_source"),
        (label if label is not None else F.col("decision_label")).alias("decision_label"), h.alias("revision_hash"))


def examples_ev(variants: DataFrame, instances: DataFrame, states: DataFrame, images: DataFrame, family: str, type_label: str,
                spec_id: str, prompt_id: str) -> DataFrame:
    """One example per image variant; hints only from visible instances of the type.

    ``visible_instance_ids`` NULL (older labels) means all instances of the type. ``instances``:
    image_id, inst_id, type_label, rle_json; ``images``: image_id, sample_id, review_image_sha1.
    """
    typed = instances.where(F.col("type_label") == type_label).select("image_id", "inst_id", "rle_json")
    seen = variants.join(typed, "image_id").where("visible_instance_ids is null or array_contains(visible_instance_ids, inst_id)")
    hint = F.concat(F.lit('{"instance_id": '), F.col("inst_id").cast("string"), F.lit(', "rle": '), F.col("rle_json"), F.lit("}"))
    hints = seen.groupBy("image_id", "candidate_key").agg(F.array_sort(F.collect_list(F.struct("inst_id", hint.alias("h")))).alias("_h"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_h", lambda s: s["h"]), ", "), F.lit("]"))
    rows = variants.join(hints, ["image_id", "candidate_key"], "left").join(states, "image_id").join(images, "image_id")
    hh = F.when(F.col("_h").isNotNull(), F.sha2(text, 256))
    return rows.select(
        F.lit(family).alias("task_family"), "image_id", "sample_id", "candidate_key", "variant_id", "decision_label",
        F.coalesce(F.size("_h"), F.lit(0)).cast("long").alias("n_hints"), hh.alias("fragment_hints_hash"),
        revision_hash_ev(F.lit(family), F.col("sample_id"), F.lit("rev_00"), F.lit(spec_id), F.lit(prompt_id), F.col("review_image_sha1"),
                         F.col("annotation_state_hash"), hh, F.col("variant_id")).alias("revision_hash"))


def with_example_ids(examples: DataFrame, order: list[Column]) -> DataFrame:
    """Counter ids per family over the ordered union of all its sources, from 0."""
    from maskwright.operators.numbering import number_rows

    numbered = number_rows(examples, ["task_family"], order, "_n", start=0)
    return numbered.withColumn("example_id", F.format_string("%s_%06d", F.substring("task_family", 1, 6), "_n")).drop("_n")


def dedupe_assets(requests: DataFrame) -> DataFrame:
    """Asset paths asked for, each once: contexts by (sample, variant), crops by content key."""
    crop_key = F.concat_ws("_", "center_x", "center_y", "size", "pad_mode")
    paths = F.array(
        F.concat(F.lit("review_context/"), F.col("sample_id"), F.lit("_"), F.col("variant"), F.lit(".png")),
        F.concat(F.lit("review_crops/"), F.col("sample_id"), F.lit("/"), crop_key, F.lit("_"), F.col("spec_id"), F.lit(".png")))
    return requests.select(F.explode(paths).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n_uses"))


def chat_rows(examples: DataFrame, prompts: DataFrame) -> DataFrame:
    """Two-turn chat line per example with keys in alphabetical order.

    ``prompts`` (fixed_prompt_id, isolation_token, text_template) is a short configuration table.
    Mask tasks carry a crop and a context image, image tasks the review image.
    """
    p = prompts.select("fixed_prompt_id", F.concat_ws(" ", "isolation_token", "text_template").alias("_text"))
    rows = examples.join(p, "fixed_prompt_id")
    img = F.lit("image")
    none = F.lit(None).cast("string")
    text = F.struct(none.alias("path"), F.col("_text").alias("text"), F.lit("text").alias("type"))

    def image(path: Column) -> Column:
        return F.struct(path.alias("path"), none.alias("text"), img.alias("type"))

    content = F.when(F.col("task_family") == "satellite_mv", F.array(text, image(F.col("crop_path")), image(F.col("context_path")))).otherwise(
        F.array(text, image(F.col("review_image_path"))))
    user = F.to_json(F.struct(content.alias("content"), F.lit("user").alias("role")))
    reply = F.to_json(F.struct(F.col("decision_label").alias("content"), F.lit("assistant").alias("role")))
    meta = F.to_json(F.struct("example_id", "fixed_prompt_id", "revision_hash"))
    line = F.concat(F.lit('{"messages":['), user, F.lit(","), reply, F.lit('],"metadata":'), meta, F.lit("}"))
    return rows.select("example_id", "task_family", line.alias("line"))


def content_hash(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Digest of a table of lines in key order, as a two-level tree.

    Lines are hashed one by one, digests combined per bucket (the first three hex digits of the key's
    hash), buckets combined last: the final step sees at most 4096 digests.
    """
    leaf = lines.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 3).alias("b"), F.sha2(F.col(line), 256).alias("h"))
    # Sum of 60-bit digest parts is independent of order and combines on the map side.
    part = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    per = leaf.groupBy("b").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(part)])
    text = F.concat_ws(":", "b", "n", *[f"s{i}" for i in range(4)])
    return per.agg(F.sum("n").alias("num_records"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("content_sha256"))


# -- corrections ----------------------------------------------------------------------------------------


def latest_links(links: DataFrame) -> DataFrame:
    """Link per original revision; a later one replaces an earlier one (``seq`` orders them)."""
    cols = [c for c in links.columns if c not in ("original_task_revision_id", "seq")]
    return links.groupBy("original_task_revision_id").agg(F.max_by(F.struct(*cols), "seq").alias("_l")).select("original_task_revision_id", "_l.*")


def superseded(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Tasks with a flag whether their revision has been replaced."""
    hit = latest_links(links).where("status = 'superseded'").select(F.col("original_task_revision_id").alias("task_revision_id"), F.lit(True).alias("_s"))
    return tasks.join(hit, "task_revision_id", "left").withColumn("is_superseded", F.coalesce("_s", F.lit(False))).drop("_s")


def stale_check(records: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Records with whether the hash of the current state still equals theirs."""
    now = current.select(*key, F.col("revision_hash").alias("_now"))
    return records.join(now, key, "left").withColumn("is_current", F.coalesce(F.col("revision_hash") == F.col("_now"), F.lit(False))).drop("_now")


def write_back_refusals(corrections: DataFrame) -> DataFrame:
    """Corrections that may not change the ground truth, with the reason."""
    ev = F.col("task_family").isin("satellite_ev", "stream_ev")
    why = (F.when(~F.col("is_current"), "stale_revision")
           .when(ev & F.col("variant_id").isNotNull() & ~F.col("variant_id").isin(*WRITEBACK_VARIANTS), "variant_not_safe")
           .when((F.col("task_family") == "satellite_mv") & (F.col("candidate_source") == "pre_merge_rejected"), "rejected_candidate")
           .when((F.col("task_family") == "satellite_mv") & F.col("inst_id").isNull(), "no_instance"))
    return corrections.withColumn("refusal", why)


def replace_instance(state: DataFrame, corrected: DataFrame) -> DataFrame:
    """Label map after replacing the pixels of corrected instances; they win over all others."""
    from maskwright.operators.runs import difference_runs, union_runs

    touched = corrected.select("image_id", "inst_id").distinct()
    kept = state.select("image_id", "inst_id", "y", "x0", "x1").join(touched, ["image_id", "inst_id"], "left_anti")
    left = difference_runs(kept, union_runs(corrected), null_keys=False).select("image_id", "inst_id", "y", "x0", "x1")
    return left.unionByName(corrected.select("image_id", "inst_id", "y", "x0", "x1"))


def rewrite_images(state: DataFrame, corrected: DataFrame) -> DataFrame:
    """State with every image of ``corrected`` replaced as a whole."""
    done = corrected.select("image_id").distinct()
    return state.join(done, "image_id", "left_anti").unionByName(corrected.select(*state.columns))


def rewrite_streams(state: DataFrame, instances: DataFrame, corrected: DataFrame, stream_label: str = "streams") -> tuple[DataFrame, DataFrame]:
    """New stream masks over unchanged satellites; ids that are no streams are refused."""
    streams = instances.where(F.col("type_label") == stream_label).select("image_id", "inst_id").distinct()
    foreign = corrected.select("image_id", "inst_id").distinct().join(streams, ["image_id", "inst_id"], "left_anti")
    refused = foreign.select("image_id").distinct()
    good = corrected.join(refused, "image_id", "left_anti")
    edited = good.select("image_id").distinct()
    cols = ["image_id", "inst_id", "y", "x0", "x1"]
    old = streams.join(edited, "image_id", "left_semi")
    return replace_instance(state.join(old, ["image_id", "inst_id"], "left_anti").select(*cols), good), foreign


def import_outcomes(corrections: DataFrame) -> DataFrame:
    """Outcome of each line of a batch of corrections, in batch order within a sample.

    The first accepted correction of a sample changes its state, so every later image-level
    correction of the sample is stale, whatever else is wrong with it (the state is checked first);
    single-mask corrections do not depend on the image state.
    Only the position of the first accepted line matters, hence an aggregate and a join instead
    of a sequential pass. Needs the columns of ``write_back_refusals`` and ``line_no``.
    """
    checked = write_back_refusals(corrections)
    first = checked.where("refusal is null").groupBy("sample_id").agg(F.min("line_no").alias("_first"))
    ev = F.col("task_family").isin("satellite_ev", "stream_ev")
    out = checked.join(first, "sample_id", "left")
    late = ev & (F.col("line_no") > F.col("_first"))
    return out.withColumn("refusal", F.when(late, F.lit("stale_revision")).otherwise(F.col("refusal"))).withColumn(
        "outcome", F.when(F.col("refusal").isNull(), "OK").otherwise("rejected")).drop("_first")


def re_export_keys(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'OK'").select("sample_id").distinct()


# -- audit log -------------------------------------------------------------------------------------------


def reserved_ids(log: DataFrame) -> DataFrame:
    """Ids ever reserved by prepared or committed entries."""
    live = log.where(F.col("status").isin("prepared", "committed"))
    return live.select("image_id", F.explode(F.array("assigned_instance_id", "deleted_instance_id")).alias("inst_id")).where("inst_id is not null").distinct()


def audit_fold(log: DataFrame) -> DataFrame:
    """Number of reserved ids and the largest one per image."""
    return reserved_ids(log).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_reserved"), F.max("inst_id").alias("max_reserved_id"))


SOURCE = ("source_prediction_path", "source_candidate_id", "source_candidate_rle_sha1")


def log_entries(verdicts: DataFrame, operation: str, id_column: str) -> DataFrame:
    """Prepared and committed log rows of the requests that went through."""
    kind = {"assigned_instance_id": F.lit(None).cast("long"), "deleted_instance_id": F.lit(None).cast("long")}
    kind[id_column] = F.col(id_column)
    rows = verdicts.where(F.col("outcome").isin("adopted", "deleted"))
    return rows.select("image_id", "request_id", F.explode(F.array(F.lit("prepared"), F.lit("committed"))).alias("status"),
                       F.lit(operation).alias("operation"), *[v.alias(k) for k, v in kind.items()])


def delete_instances(requests: DataFrame, instances: DataFrame, log: DataFrame, boxes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Guarded deletion of satellites: verdict per request (with a snapshot) and the remaining rows."""
    gone = log.where("operation = 'delete_authoritative_satellite' and status = 'committed'").select(
        "image_id", F.col("deleted_instance_id").alias("inst_id"), F.lit(True).alias("_gone")).distinct()
    have = instances.select("image_id", "inst_id", "type_label", F.lit(True).alias("_have"))
    out = requests.join(have, ["image_id", "inst_id"], "left").join(gone, ["image_id", "inst_id"], "left")
    verdict = (F.when(F.col("_have").isNull() & F.col("_gone").isNotNull(), "already_deleted").when(F.col("_have").isNull(), "missing")
               .when(F.col("type_label") != "satellites", "unsupported_type").otherwise("deleted"))
    out = out.withColumn("outcome", verdict).withColumn("deleted_instance_id", F.when(F.col("outcome") == "deleted", F.col("inst_id")))
    if boxes is not None:
        out = out.join(boxes, ["image_id", "inst_id"], "left")
    hit = out.where("outcome = 'deleted'").select("image_id", "inst_id").distinct()
    return out.drop("_have", "_gone"), instances.join(hit, ["image_id", "inst_id"], "left_anti")


def route_overrides(overrides: DataFrame) -> DataFrame:
    """One row per rule entry: force_keep from an outside source if its hash is listed, else from the raw layer.

    ``overrides``: base_key, force_keep, force_drop and inject_from_json, arrays of structs with
    candidate_rle_sha1, candidate_id, raw_index, note (inject: candidate_rle_sha1, path).
    """
    keep = overrides.select("base_key", F.lit("force_keep").alias("rule"), F.explode("force_keep").alias("e"), "inject_from_json")
    drop = overrides.select("base_key", F.lit("force_drop").alias("rule"), F.explode("force_drop").alias("e"), "inject_from_json")
    rows = keep.unionByName(drop).select("base_key", "rule", "e.*", F.expr(
        "get(filter(inject_from_json, i -> i.candidate_rle_sha1 = e.candidate_rle_sha1), 0).path").alias("_path"))
    return rows.withColumn("source", F.when(F.col("rule") == "force_drop", F.lit(None)).when(F.col("_path").isNotNull(), F.col("_path")).otherwise("raw_layer")).drop("_path")


def override_summary(outcomes: DataFrame, dry_run: bool = False) -> DataFrame:
    """ok, failed and skipped entries per rule (``error`` NULL: went through)."""
    fine = F.col("error").isNull()
    return outcomes.groupBy("rule").agg(
        F.count_if(fine & F.lit(not dry_run)).alias("ok"), F.count_if(~fine).alias("failed"), F.count_if(fine & F.lit(dry_run)).alias("skipped_dry_run"))


# -- spot checks -----------------------------------------------------------------------------------------


SIGNALS = ("best_iou", "area_ratio", "boundary_f1", "confidence_score")


def spot_check_mv(labels: DataFrame, accept_iou: float = 0.7, confidence: float = 0.5) -> DataFrame:
    """Per label: count, signal figures, broken accepts, suspicious rejects and edge cases."""
    s = F.col("signals")
    iou = s["best_iou"]
    accept, reject = F.col("decision_label") == "accept", F.col("decision_label") == "reject"
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in SIGNALS:
        aggs += [F.min(s[k]).alias(f"{k}_min"), F.max(s[k]).alias(f"{k}_max"), F.avg(s[k]).alias(f"{k}_mean")]
    t = float(accept_iou)
    aggs += [
        F.count_if(accept & ((iou < t) | F.coalesce(s["confidence_score"] < confidence, F.lit(False)))).alias("bad_accept"),
        F.count_if(reject & (iou > t) & s["area_ratio"].between(0.5, 2.0) & (s["filter_status"] == "kept")).alias("suspect_reject"),
        F.count_if(accept & (iou >= t) & (iou < t + 0.05)).alias("edge_accept"),
        F.count_if(~accept & (iou >= t - 0.05) & (iou < t)).alias("edge_other")]
    out = labels.groupBy("decision_label").agg(*aggs)
    signals = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), s[k].cast("double").alias("value")) for k in SIGNALS]))
    medians = exact_quantiles(labels.select("decision_label", signals.alias("e")).select("decision_label", "e.*"), ["decision_label", "signal"], "value", {"median": 0.5})
    wide = medians.groupBy(F.col("decision_label").alias("_label")).agg(*[F.max(F.when(F.col("signal") == k, F.col("median"))).alias(f"{k}_median") for k in SIGNALS])
    return out.join(wide, F.col("decision_label").eqNullSafe(F.col("_label")), "left").drop("_label")


def spot_check_ev(variants: DataFrame) -> DataFrame:
    """Per label and variant: count, visible/hidden overlaps, empty labels with visible instances."""
    return variants.groupBy("decision_label", "variant_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.arrays_overlap("visible_instance_ids", "hidden_instance_ids")).alias("bad_overlap"),
        F.count_if((F.col("decision_label") == "confirm_empty") & (F.size("visible_instance_ids") > 0)).alias("bad_empty"))


def mv_ev_consistency(mv: DataFrame, ev: DataFrame) -> DataFrame:
    """Images whose masks are all accepted against their image label, and the coverage of both."""
    m = mv.groupBy("image_id").agg(F.every(F.col("decision_label") == "accept").alias("_all"))
    e = ev.where("variant_id = 'gt_complete' or variant_id is null").groupBy("image_id").agg(F.max("decision_label").alias("_ev"))
    both = m.join(e, "image_id", "full_outer")
    every = F.coalesce("_all", F.lit(False))
    return both.agg(
        F.count_if(every).alias("all_accept"), F.count_if(every & (F.col("_ev") == "confirm_complete")).alias("consistent"),
        F.count_if(every & F.col("_ev").isNotNull() & (F.col("_ev") != "confirm_complete")).alias("inconsistent"),
        F.count_if(every & F.col("_ev").isNull()).alias("missing_ev"),
        F.count_if(F.col("_all").isNotNull() & F.col("_ev").isNotNull()).alias("in_both"),
        F.count_if(F.col("_all").isNotNull() & F.col("_ev").isNull()).alias("mv_only"),
        F.count_if(F.col("_all").isNull()).alias("ev_only"))
