"""Sources, sinks, joins of file tables, exports and batches."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.q_raster import KEY, lab_pixels
from checks.q_tables import _USABLE
from checks.registry import check
from checks.views import Tables
from tilewright.operators import stats
from tilewright.operators import tiling as t
from tilewright.plans import exports as ex
from tilewright.sources import images as im
from tilewright.sources import masks as ms
from tilewright.sources import tables as tb


@check("s01_discovered_files")
def _(spark, sf):
    return im.discover_images(spark, {"ordinary": [sf]}, extensions=(".parquet",)).select(
        "label", "label_id", F.element_at(F.split("source_path", "/"), -1).alias("file"), "sha256")


@check("s03_listed_files")
def _(spark, sf):
    return im.list_images(spark, sf, extensions=(".parquet",)).select("name", "length")


@check("s02_unpacked_rasters", "select vec_id image_id, p//8 y, p%8 x, cast(trunc(greatest(0,least(255,(cast(v as double)+0.5)*255))) as int) code from (select vec_id, unnest(range(0,64)) p, unnest(embedding) v from embeddings)")
def _(spark, sf):
    """Rasters packed to bytes per image, then unpacked by row and column arithmetic."""
    v = F.col("embedding")
    packed = Tables(spark, sf).raw("embeddings").select("vec_id", F.transform(v, lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (e.cast("double") + 0.5) * 255)).cast("int")).alias("raster"))
    return packed.select("vec_id", F.posexplode("raster").alias("p", "code")).select(
        F.col("vec_id").alias("image_id"), F.floor(F.col("p") / 8).alias("y"), (F.col("p") % 8).alias("x"), "code")


@check("s04_upload_checks", """with u as (select page_id, case page_id%6 when 0 then 'image/jpeg' when 1 then 'image/webp' when 2 then 'text/html' when 3 then '' end ct, concat('f',cast(page_id as varchar), case page_id%5 when 0 then '.JPEG' when 1 then '.png' when 2 then '.gif' when 3 then '.tiff' else '' end) nm, length(html)*200000 sz from pages),
    e as (select *, coalesce(case ct when 'image/jpeg' then '.jpg' when 'image/png' then '.png' when 'image/webp' then '.webp' end, case page_id%5 when 0 then '.jpg' when 1 then '.png' when 3 then '.tiff' end) ext from u)
    select page_id, coalesce(ext,'') extension, case when ext is null then 'unsupported type' when sz>2147483648 then 'too large' end reason from e""")
def _(spark, sf):
    p = F.col("page_id")
    kind = F.when(p % 6 == 0, "image/jpeg").when(p % 6 == 1, "image/webp").when(p % 6 == 2, "text/html").when(p % 6 == 3, "")
    ending = F.when(p % 5 == 0, ".JPEG").when(p % 5 == 1, ".png").when(p % 5 == 2, ".gif").when(p % 5 == 3, ".tiff").otherwise("")
    rows = Tables(spark, sf).raw("pages").select(p, kind.alias("content_type"), F.concat(F.lit("f"), p.cast("string"), ending).alias("name"), (F.length("html").cast("bigint") * 200000).alias("size"))
    return im.check_uploads(rows).select("page_id", F.coalesce("extension", F.lit("")).alias("extension"), "reason")


@check("s05_mask_files", """select vec_id, case when vec_id%5=4 then 'bad' else 'ok' end status, case when vec_id%5=4 then 0 else 64 end n from embeddings""")
def _(spark, sf):
    """Masks written as .npy bytes by the workers, then read back; every fifth one has the wrong type."""
    @F.pandas_udf("binary")
    def as_npy(codes: pd.Series, wrong: pd.Series) -> pd.Series:
        out = []
        for values, bad in zip(codes, wrong):
            buffer = io.BytesIO()
            np.save(buffer, np.asarray(values, dtype=np.int16 if bad else np.uint8).reshape(8, 8))
            out.append(buffer.getvalue())
        return pd.Series(out)

    codes = F.transform("embedding", lambda e: F.when(e >= 0.1, 1).when(e <= -0.1, 3).otherwise(2))
    files = Tables(spark, sf).raw("embeddings").select(
        F.concat(F.lit("/m/"), F.col("vec_id").cast("string"), F.lit(".npy")).alias("path"), as_npy(codes, F.col("vec_id") % 5 == 4).alias("content"))
    read = ms.unpack_masks(files).withColumn("vec_id", F.regexp_extract("mask_file", r"^(\d+)", 1).cast("bigint"))
    return read.groupBy("vec_id").agg(
        F.when(F.count("error") > 0, "bad").otherwise("ok").alias("status"), F.count("code").alias("n"))


@check("s07_conflict_rows", f"with {_USABLE} select sha256, label, label_id, source_path from v_sources semi join (select sha256 from gr where nl>1) using(sha256)")
def _(spark, sf):
    from tilewright.operators import dataset as ds

    return ds.conflicts(Tables(spark, sf).sources()).select("sha256", "label", "label_id", "source_path").orderBy("sha256", "label_id", "source_path")


@check("s08_manifest_paths", f"with {_USABLE} select source_path, concat('/data/', label, '/', sha256[1:16], '_', list_last(string_split(source_path,'/'))) dataset_path from us")
def _(spark, sf):
    from tilewright.operators import dataset as ds

    rows = ds.deduplicate(Tables(spark, sf).sources()).withColumn("split", F.lit("train"))
    return ds.manifest(rows, "/data").select("source_path", F.replace("dataset_path", F.lit("/train/"), F.lit("/")).alias("dataset_path"))


@check("s06_manifest_text_round_trip", "select source_path, label_id, n_chars::bigint n from v_sources")
def _(spark, sf):
    """Manifest columns to CSV text and back through the typed parser (``label_id`` becomes a number)."""
    rows = Tables(spark, sf).sources().select(F.to_csv(F.struct("source_path", F.col("label_id").cast("string").alias("label_id"), "n_chars")).alias("line"))
    parsed = rows.select(F.from_csv("line", "source_path string, label_id int, n bigint").alias("r"))
    return parsed.select("r.*")


@check("s09_merged_summaries", """with u as (select user_id doc, event_type key, event_id seq, cast(event_id%1000 as varchar) v from events), l as (select doc, key, arg_max(v, seq) v from u group by 1,2)
    select doc, concat('{', string_agg(concat('"',key,'":"',v,'"'), ',' order by key), '}') summary from l group by 1""")
def _(spark, sf):
    rows = Tables(spark, sf).raw("events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 1000).cast("string").alias("v"))
    return tb.summary_documents(rows, "doc", "key", "seq", "v")


@check("s10_history_union", """select run_id, stage, epoch, case when stage='A' then val_auc end val_auc, case when stage='N' then val_loss end val_loss, case when stage='R' then val_f1 end val_f1 from v_history """)
def _(spark, sf):
    rows = Tables(spark, sf).history()
    return tb.combine_histories([
        rows.where("stage = 'A'").select("run_id", "stage", "epoch", "val_auc"), rows.where("stage = 'N'").select("run_id", "stage", "epoch", "val_loss"),
        rows.where("stage = 'R'").select("run_id", "stage", "epoch", "val_f1")])


_IMAGES = """i as (select concat('img', cast(d.doc_id as varchar), '.png') image, coalesce(l.toxic,0)=1 excluded, coalesce(l.quality,1)=1 applied, case when d.doc_id%17=0 then 'broken' end error from documents d left join labels l on d.doc_id=l.doc_id)"""


def _images(tables):
    return tables.raw("documents").join(tables.raw("labels"), "doc_id", "left").select(
        F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"), (F.coalesce("toxic", F.lit(0)) == 1).alias("excluded"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("correction_applied"), F.when(F.col("doc_id") % 17 == 0, "broken").alias("error"))


@check("s11_export_files", f"""with {_IMAGES}, k as (select unnest(['color-masks','color-previews','corrected-masks','corrected-previews','corrected-originals']) a, unnest(['npy','png','npy','png','png']) e)
    select image, a artefact, concat(a,'/',replace(image,'.png',''),'.',e) path from i, k where not excluded and error is null and (a like 'color-%' or applied)""")
def _(spark, sf):
    return ex.export_files(_images(Tables(spark, sf)), "all")


@check("s12_available_artifacts", "with w as (select sha256[1:24] key, label s from v_sources where n_chars%2=0), st as (select distinct sha256[1:24] key, label s from v_sources where n_chars%3=0) select w.key, w.s settings_json from w semi join st using(key,s)")
def _(spark, sf):
    rows = Tables(spark, sf).sources().select(F.substring("sha256", 1, 24).alias("key"), F.col("label").alias("settings_json"), "n_chars")
    return ex.available_artifacts(rows.where("n_chars % 2 = 0").drop("n_chars"), rows.where("n_chars % 3 = 0"))


@check("s12_missing_artifacts", "with w as (select sha256[1:24] key, label s from v_sources where n_chars%2=0), st as (select distinct sha256[1:24] key, label s from v_sources where n_chars%3=0) select w.key, w.s settings_json from w anti join st using(key,s)")
def _(spark, sf):
    rows = Tables(spark, sf).sources().select(F.substring("sha256", 1, 24).alias("key"), F.col("label").alias("settings_json"), "n_chars")
    return ex.missing_artifacts(rows.where("n_chars % 2 = 0").drop("n_chars"), rows.where("n_chars % 3 = 0"))


@check("a26_batch_header", f"""with {_IMAGES}, r as (select case when excluded then 'skipped' when error is not null then 'error' when not applied then 'skipped' else 'ok' end s from i)
    select count(*) total_images, count(*) filter(s='ok') success_count, count(*) filter(s='skipped') skipped_count, count(*) filter(s='error') failure_count from r""")
def _(spark, sf):
    return stats.batch_header(ex.export_records(_images(Tables(spark, sf)), "corrected-masks"))


@check("b03_export_records", f"""with {_IMAGES}, k as (select unnest(['color-masks','corrected-masks','all']) kind)
    select image, kind, case when excluded then 'skipped' when error is not null then 'error' when kind='corrected-masks' and not applied then 'skipped' else 'ok' end status,
        case when excluded then 'excluded' when error is null and kind='corrected-masks' and not applied then 'open-sketch' end reason from i, k""")
def _(spark, sf):
    rows = _images(Tables(spark, sf))
    parts = [ex.export_records(rows, kind) for kind in ("color-masks", "corrected-masks", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("image", "kind", "status", "reason")


def _files(tables):
    n = F.col("doc_id")
    return tables.raw("documents").select("doc_id", F.concat(F.lit("S"), n.cast("string"), F.when(n % 4 == 0, ".PNG").when(n % 4 == 1, ".jpg").when(n % 4 == 2, ".txt").otherwise(".tif")).alias("name"))


_FILES = "f as (select doc_id, concat('S', cast(doc_id as varchar), case doc_id%4 when 0 then '.PNG' when 1 then '.jpg' when 2 then '.txt' else '.tif' end) as name from documents)"


@check("j01_image_sketch_pairs", f"with {_FILES} select f.name, concat('/s/', f.name) sketch_path from f join labels using(doc_id) where doc_id%4<>2")
def _(spark, sf):
    tables = Tables(spark, sf)
    sketches = _files(tables).join(tables.raw("labels"), "doc_id").select("name", F.concat(F.lit("/s/"), "name").alias("sketch_path"))
    return ex.image_pairs(_files(tables).select("name"), sketches)


@check("j02_segmentation_records", f"with {_FILES} select concat('S', cast(doc_id as varchar)) stem, f.name, concat('S', cast(doc_id as varchar), '.npy') mask_name from f join labels using(doc_id) where doc_id%4 in (0,1)")
def _(spark, sf):
    tables = Tables(spark, sf)
    masks = tables.raw("labels").select(F.concat(F.lit("S"), F.col("doc_id").cast("string"), F.lit(".npy")).alias("mask_name"))
    return ex.segmentation_records(_files(tables).select("name"), masks)


@check("j04_mask_sources", "select concat('i',cast(d.doc_id as varchar)) image, case when l.doc_id is null then 'error' else 'ok' end status, case when l.doc_id is null then concat('''i',cast(d.doc_id as varchar),'''') end error from documents d left join labels l on d.doc_id=l.doc_id")
def _(spark, sf):
    tables = Tables(spark, sf)
    name = F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("image")
    manifest = tables.raw("documents").select(name, F.lit("ok").alias("status"), F.lit("m.npy").alias("mask_file"))
    sources = tables.raw("labels").select(name, F.lit("/p").alias("source_path"))
    return ex.with_sources(ex.mask_records(manifest, manifest.select("mask_file")), sources).select("image", "status", "error")


@check("b04_dataset_build", f"with {_USABLE} select (select count(*) from us) manifest_rows, (select coalesce(sum(files),0)::bigint from gr where nl>1) conflict_rows, (select count(distinct sha256) from us) hashes")
def _(spark, sf):
    from tilewright.plans.dataset_build import build_dataset

    build = build_dataset(Tables(spark, sf).sources(), "/data")
    one = lambda df, *c: df.agg(*c).withColumn("_one", F.lit(1))
    left = one(build.manifest, F.count(F.lit(1)).alias("manifest_rows"), F.count_distinct("sha256").alias("hashes"))
    return left.join(one(build.conflicts, F.count(F.lit(1)).alias("conflict_rows")), "_one").drop("_one")


@check("b01_batch_masks")
def _(spark, sf):
    from checks.q_segments import SMALL
    from tilewright.plans.segmentation import batch_masks

    masks, records = batch_masks(t.with_size(Tables(spark, sf).rgb().select(*KEY, "r", "g", "b")), SMALL)
    counts = masks.pixels("code").groupBy("image_id", F.col("code").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("pixels"))
    return records.join(counts, "image_id")


def _sketched(tables):
    """Mosaics with a drawn frame; every third image's frame has a gap and stays open."""
    y, x, i = F.col("y"), F.col("x"), F.col("image_id")
    frame = (y.isin(5, 26) & x.between(4, 27)) | (x.isin(4, 27) & y.between(5, 26))
    gap = (i % 3 == 2) & (x == 4) & (y == 12)
    pixels = t.with_size(lab_pixels(tables).withColumn("line", frame & ~gap))
    sketches = tables.mosaic().select("image_id").distinct().select(
        i, F.lit(1).alias("lines"), F.when(i % 3 == 2, 2).otherwise(0).alias("open_ends"), F.lit(0).alias("open_ends_on_edge"),
        F.when(i % 3 == 2, 0).otherwise(1).alias("closed_lines"), F.when(i % 4 == 1, "outside").otherwise("inside").alias("region_mode"))
    return pixels, sketches


@check("c11_corrected_images")
def _(spark, sf):
    from tilewright.operators.crop import CropSettings
    from tilewright.plans.segmentation import correct_with_sketch

    pixels, sketches = _sketched(Tables(spark, sf))
    done = correct_with_sketch(pixels, sketches, CropSettings(0.3, 0.3, 2))
    return done.full_stats.join(done.crops.select("image_id", "left", "top", "right", "bottom", "fallback"), "image_id", "left")


