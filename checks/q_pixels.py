"""Pixel neighbourhoods, components, masks and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_raster import _LAB, KEY, lab_pixels
from checks.q_tables import r6
from checks.registry import check
from checks.views import Tables
from tilewright.functions import scalar as s
from tilewright.operators import components as co
from tilewright.operators import illumination as il
from tilewright.operators import morphology as mo
from tilewright.operators import relax, stats
from tilewright.operators import tiling as t
from tilewright.operators.edges import seed_labels

CHUNK = 16  # smaller than a mosaic, so labels have to meet across chunk borders
DIMS = "d as (select image_id, max(y)+1 h, max(x)+1 w from v_mosaic group by 1)"
_DISK1 = "(o.dy*o.dy+o.dx*o.dx<=1)"


def _off(radius2: float, reach: int) -> str:
    return f"of as (select dy, dx from unnest(range(-{reach},{reach + 1})) a(dy), unnest(range(-{reach},{reach + 1})) b(dx) where dy*dy+dx*dx<={radius2})"


def _morph(source: str, value: str, how: str, name: str) -> str:
    """SQL of one erosion or dilation step over the offsets in ``of``."""
    return (f"{name} as (select p.image_id, p.y, p.x, {how}(q.{value}) {value} from {source} p join of on true join {source} q "
            f"on q.image_id=p.image_id and q.y=p.y+of.dy and q.x=p.x+of.dx group by 1,2,3)")


@check("m01_erosion_dilation", f"with {_off(4, 2)}, s as (select image_id, y, x, r v from v_mosaic), {_morph('s', 'v', 'min', 'e')}, {_morph('s', 'v', 'max', 'd')} select e.image_id, e.y, e.x, e.v eroded, d.v dilated from e join d using(image_id,y,x)")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, "r")
    return mo.sweep(rows, {"eroded": ("r", "min"), "dilated": ("r", "max")}, mo.disk(2)).drop("r")


@check("m02_gradients", f"""with {_LAB}, {_off(1, 1)}, g as (select p.image_id, p.y, p.x, max(q.lab_l)-min(q.lab_l) gl, max(q.lab_a)-min(q.lab_a) ga, max(q.lab_b)-min(q.lab_b) gb from lab p join of on true
    join lab q on q.image_id=p.image_id and q.y=p.y+of.dy and q.x=p.x+of.dx group by 1,2,3) select image_id, y, x, round(gl,4) gl, round(sqrt(gl*gl+ga*ga+gb*gb),4) gradient from g""")
def _(spark, sf):
    lab = lab_pixels(Tables(spark, sf)).select(*KEY, "lab_l", "lab_a", "lab_b")
    both = mo.gradient(mo.lab_gradient(lab, 1), "lab_l", 1, "gl")
    return both.select(*KEY, F.round("gl", 4).alias("gl"), F.round("gradient", 4).alias("gradient"))


@check("m03_robust_gradient", """with q as (select image_id, quantile_cont(abs(v),0.95) p from v_mosaic where abs(v)>1e-6 group by 1)
    select image_id, y, x, round(greatest(0,least(1,abs(v)/p)),6) g from v_mosaic join q using(image_id)""")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, F.abs("v").alias("a"))
    return mo.robust_normalise(rows, "a", "g").select(*KEY, *r6("g"))


_MASK = "s as (select image_id, y, x, case when code=2 then 1 else 0 end v from v_mosaic)"


@check("m04_open_close", f"with {_off(1, 1)}, {_MASK}, {_morph('s', 'v', 'min', 'a')}, {_morph('a', 'v', 'max', 'b')}, {_morph('b', 'v', 'max', 'c')}, {_morph('c', 'v', 'min', 'd')} select image_id, y, x, v from d")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, (F.col("code") == 2).cast("int").alias("m"))
    return mo.open_close(rows, "m", 1, "v").select(*KEY, "v")


@check("m04_close_square", f"with {_off(2, 1)}, {_MASK}, {_morph('s', 'v', 'max', 'a')}, {_morph('a', 'v', 'min', 'b')} select image_id, y, x, v from b")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, (F.col("code") == 2).cast("int").alias("m"))
    return mo.close_square(rows, "m", "v").select(*KEY, "v")


def _labels(source: str, diagonal: bool) -> str:
    """Recursive closure of pixel adjacency, smallest pixel key per component."""
    near = "abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1" if diagonal else "abs(a.y-b.y)+abs(a.x-b.x)<=1"
    return f"""ed as (select a.image_id, a.y*1000+a.x s, b.y*1000+b.x t from {source} a join {source} b on a.image_id=b.image_id and b.y between a.y-1 and a.y+1 and b.x between a.x-1 and a.x+1 and {near}),
        rc as (select image_id, s n, s r from ed union select rc.image_id, ed.t, rc.r from rc join ed on ed.image_id=rc.image_id and ed.s=rc.n),
        lb as (select image_id, n//1000 y, n%1000 x, min(r) l from rc group by 1,2,3)"""


_TALC = "tc as (select image_id, y, x from v_mosaic where code=3)"


def _key_of(label):
    return F.shiftright(label, 32) * 1000 + F.bitwise_and(label, F.lit(0xFFFFFFFF)) if hasattr(F, "bitwise_and") else (
        F.shiftright(label, 32) * 1000 + label.bitwiseAND(F.lit(0xFFFFFFFF)))


@check("m06_components", f"with {_TALC}, {_labels('tc', True)} select image_id, y, x, l as label from lb")
def _(spark, sf):
    talc = Tables(spark, sf).mosaic().where("code = 3").select(*KEY)
    labelled = co.label_components(talc, chunk=CHUNK)
    return labelled.select(*KEY, _key_of(F.col("label")).alias("label"))


@check("m06_component_counts", f"with {_TALC}, {_labels('tc', True)} select image_id, count(distinct l) n from lb group by 1")
def _(spark, sf):
    talc = Tables(spark, sf).mosaic().where("code = 3").select(*KEY)
    return co.label_components(talc, chunk=CHUNK).select("image_id", "label").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@check("m07_small_objects_removed", f"with {_TALC}, {_labels('tc', False)}, a as (select image_id, l from lb group by 1,2 having count(*)>=3) select image_id, y, x from lb join a using(image_id,l)")
def _(spark, sf):
    talc = Tables(spark, sf).mosaic().where("code = 3").select(*KEY)
    return co.drop_small(talc, 3, chunk=CHUNK)


@check("m05_class_cleaning")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, "code")
    return mo.postprocess(rows, "code", 3, 1)


@check("m08_distance_threshold", f"""with {_off(2.25, 1)}, {_MASK}, {_morph('s', 'v', 'min', 'e')}, a as (select image_id, max(v) m from e group by 1)
    select e.image_id, e.y, e.x, case when m>0 then e.v else s.v end deep from e join s using(image_id,y,x) join a using(image_id)""")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, (F.col("code") == 2).cast("int").alias("m"))
    return mo.deeper_than(rows, "m", 1.5, "deep").select(*KEY, "deep")


@check("m08_squared_distances", f"with {_MASK} select a.image_id, a.y, a.x, min(pow(a.y-b.y,2)+pow(a.x-b.x,2)) d2 from s a join s b on a.image_id=b.image_id and b.v=0 group by 1,2,3")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, (F.col("code") == 2).cast("int").alias("m"))
    return mo.squared_distances(rows, "m")


@check("m08_max_erosion_radius", f"with {_MASK}, q as (select a.image_id, a.y, a.x, min(pow(a.y-b.y,2)+pow(a.x-b.x,2)) d2 from s a join s b on a.image_id=b.image_id and b.v=0 group by 1,2,3) select image_id, cast(greatest(ceil(sqrt(max(d2)))-1,0) as int) radius from q group by 1")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, (F.col("code") == 2).cast("int").alias("m"))
    return mo.max_erosion_radius(rows, "m")


@check("m09_exterior_split", f"""with {DIMS}, fr as (select image_id, y, x from v_mosaic where code<>2), {_labels('fr', False)}, b as (select distinct lb.image_id, l from lb join d using(image_id) where y=0 or x=0 or y=h-1 or x=w-1)
    select lb.image_id, y, x, b.l is not null exterior from lb left join b on b.image_id=lb.image_id and b.l=lb.l""")
def _(spark, sf):
    rows = t.with_size(Tables(spark, sf).mosaic().select(*KEY, "code"))
    return co.exterior_split(rows, F.col("code") == 2, chunk=CHUNK).select(*KEY, "exterior")


@check("m10_region_growth", """with sd as (select image_id, y, x, case when v>0.22 then (y*7+x)%5+1 end region, code from v_mosaic), us as (select * from sd where region is not null or code<>1),
    st as (select image_id, y, x, 0 d, region from us where region is not null
        union all select n.image_id, n.y, n.x, s.d+1, min(s.region) from (select * from st) s join us n on n.image_id=s.image_id and n.y between s.y-1 and s.y+1 and n.x between s.x-1 and s.x+1 and n.region is null
        where s.d<25 group by n.image_id, n.y, n.x, s.d),
    bs as (select image_id, y, x, min(d) d from st group by 1,2,3)
    select image_id, y, x, min(st.region) region from st join bs using(image_id,y,x,d) group by 1,2,3""")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().withColumn("region", F.when(F.col("v") > 0.22, (F.col("y") * 7 + F.col("x")) % 5 + 1).otherwise(0))
    return relax.grow_regions(rows, "region", F.col("code") != 1, chunk=CHUNK)


@check("m11_seeded_flooding")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, F.abs("v").alias("g"), F.when(F.col("v") > 0.22, F.col("y") * 1000 + F.col("x")).alias("seed"), "code")
    return relax.flood(rows.where("code <> 3"), "seed", "g").select(*KEY, "label", F.round("cost", 6).alias("cost"))


@check("m11_seeds", f"with {_TALC}, {_labels('tc', True)} select image_id, count(*) n, count(distinct l) parts from lb group by 1")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, (F.col("code") == 3).cast("int").alias("m"))
    seeds = seed_labels(rows, "m", 0)
    return seeds.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seed").alias("parts"))


@check("m11_eroded_seeds")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, (F.col("code") == 2).cast("int").alias("m"))
    return seed_labels(rows, "m", 1)


@check("m13_boundary_barrier")
def _(spark, sf):
    from tilewright.operators.cluster import TwoStepSettings

    lab = t.with_size(lab_pixels(Tables(spark, sf)))
    return il.boundary_barrier(lab, TwoStepSettings(local_shadow_radius=24), 1).select(*KEY, *r6("barrier"))


@check("m13_bilateral_background", f"""with {DIMS}, s as (select m.image_id, y, x, h, w, r::double v from v_mosaic m join d using(image_id)), {_off(9, 3)},
    p as (select s.image_id, s.y, s.x, s.v, h-1-abs(h-1-abs(s.y+dy)) qy, w-1-abs(w-1-abs(s.x+dx)) qx, dy, dx from s join of on true),
    k as (select p.image_id, p.y, p.x, q.r v, exp(-(dy*dy+dx*dx)/(2*9.0::double)-pow(q.r-p.v,2)/(2*900.0::double)) wt from p join v_mosaic q on q.image_id=p.image_id and q.y=p.qy and q.x=p.qx)
    select image_id, y, x, round(sum(wt*v)/sum(wt),6) smooth from k group by 1,2,3""")
def _(spark, sf):
    rows = t.with_size(Tables(spark, sf).mosaic().select(*KEY, "r"))
    return il.bilateral(rows, "r", 3, 30.0, 3.0, "smooth", chunk=CHUNK).select(*KEY, *r6("smooth"))


@check("m13_shadow_correction")
def _(spark, sf):
    from tilewright.operators.cluster import TwoStepSettings

    lab = t.with_size(lab_pixels(Tables(spark, sf)))
    return il.correct_shadows(lab, TwoStepSettings(local_shadow_radius=40)).select(*KEY, F.round("lab_l", 4).alias("lab_l"), "applied")


@check("m14_equalised_lightness")
def _(spark, sf):
    rows = t.with_size(Tables(spark, sf).mosaic().select(*KEY, "r"))
    return il.stretch(il.equalise(rows, "r", "e"), "e", "gray").select(*KEY, "e", "gray")


@check("m14_normalised_gray")
def _(spark, sf):
    from tilewright.operators.normalise import normalised
    from tilewright.operators.raster import to_chunks

    found = normalised(to_chunks(t.with_size(Tables(spark, sf).rgb().select(*KEY, "r", "g", "b")), ["r", "g", "b"])).pixels("r", "g", "b", "gray")
    return found.select(*KEY, *[F.col(c).cast("int").alias(c) for c in ("r", "g", "b", "gray")])


@check("m14_percentile_stretch", """with q as (select image_id, quantile_cont(r,0.01) lo, quantile_cont(r,0.99) hi from v_mosaic group by 1)
    select image_id, y, x, case when hi>lo then cast(trunc(greatest(0,least(255,(r-lo)*255.0::double/(hi-lo)))) as int) else r end gray from v_mosaic join q using(image_id)""")
def _(spark, sf):
    return il.stretch(Tables(spark, sf).mosaic().select(*KEY, "r"), "r", "gray").select(*KEY, "gray")


@check("m15_skeleton_nodes", f"""with {_TALC}, n as (select a.image_id, a.y, a.x, count(*)-1 neighbours from tc a join tc b on a.image_id=b.image_id and b.y between a.y-1 and a.y+1 and b.x between a.x-1 and a.x+1 group by 1,2,3)
    select *, case when neighbours=1 then 'endpoint' when neighbours>2 then 'junction' when neighbours=2 then 'chain' else 'isolated' end role from n""")
def _(spark, sf):
    return mo.skeleton_nodes(Tables(spark, sf).mosaic().where("code = 3").select(*KEY))


@check("j11_neighbour_counts", """select a.image_id, a.y, a.x, count(*) n from v_mosaic a join v_mosaic b on a.image_id=b.image_id and a.code=b.code and abs(a.y-b.y)+abs(a.x-b.x)=1 and b.y between a.y-1 and a.y+1 and b.x between a.x-1 and a.x+1 group by 1,2,3""")
def _(spark, sf):
    rows = Tables(spark, sf).mosaic().select(*KEY, "code")
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    asked = rows.select("image_id", "code", (F.col("y")).alias("py"), F.col("x").alias("px"), F.explode(offsets).alias("o")).select(
        "image_id", "code", "py", "px", (F.col("py") + F.col("o.dy")).alias("y"), (F.col("px") + F.col("o.dx")).alias("x"))
    return asked.join(rows, ["image_id", "code", "y", "x"]).groupBy("image_id", F.col("py").alias("y"), F.col("px").alias("x")).agg(F.count(F.lit(1)).alias("n"))


@check("j08_pixels_in_boxes", """with b as (select vec_id//16 image_id, vec_id%16 box, vec_id%13 x0, vec_id%11 y0, vec_id%13+9 x1, vec_id%11+7 y1 from embeddings)
    select m.image_id, box, count(*) n, sum(r)::bigint total from v_mosaic m join b on b.image_id=m.image_id and x>=x0 and x<x1 and y>=y0 and y<y1 group by 1,2""")
def _(spark, sf):
    tables = Tables(spark, sf)
    v = F.col("vec_id")
    boxes = tables.raw("embeddings").select(F.expr("vec_id div 16").alias("image_id"), (v % 16).alias("box"), (v % 13).alias("x0"), (v % 11).alias("y0"), (v % 13 + 9).alias("x1"), (v % 11 + 7).alias("y1"))
    return stats.box_counts(tables.mosaic(), boxes, ["box"], {"total": F.col("r")}).select("image_id", "box", "n", "total")


@check("a30_component_stats", f"""with {_LAB}, {_TALC}, {_labels('tc', True)}
    select lb.image_id, l as label, count(*) area, min(x) x0, min(y) y0, max(x)+1 x1, max(y)+1 y1, round(avg(x),6) cx, round(avg(y),6) cy, round(avg(lab_l),4) mean_lab_l, round(avg(r),6) mean_r from lb join lab using(image_id,y,x) group by 1,2""")
def _(spark, sf):
    lab = lab_pixels(Tables(spark, sf))
    labelled = co.label_components(lab.where("code = 3").select(*KEY), chunk=CHUNK)
    out = stats.component_stats(labelled.join(lab, KEY), ["image_id", "label"])
    return out.select("image_id", _key_of(F.col("label")).alias("label"), "area", "x0", "y0", "x1", "y1", *r6("cx", "cy"), F.round("mean_lab_l", 4).alias("mean_lab_l"), *r6("mean_r"))


@check("a31_mask_boxes", """select image_id, coalesce(min(x) filter(v>0.3),0) x0, coalesce(min(y) filter(v>0.3),0) y0, coalesce(max(x) filter(v>0.3)+1,max(x)+1) x1, coalesce(max(y) filter(v>0.3)+1,max(y)+1) y1 from v_mosaic group by 1""")
def _(spark, sf):
    return stats.mask_box(Tables(spark, sf).mosaic(), F.col("v") > 0.3)


@check("a35_band_delta_e", f"""with {_LAB} select image_id, round(sqrt(pow(avg(lab_l) filter(code=3)-avg(lab_l) filter(code=2),2)+pow(avg(lab_a) filter(code=3)-avg(lab_a) filter(code=2),2)+pow(avg(lab_b) filter(code=3)-avg(lab_b) filter(code=2),2)),4) delta_e from lab group by 1""")
def _(spark, sf):
    return stats.band_delta_e(lab_pixels(Tables(spark, sf)), "image_id", F.col("code") == 3, F.col("code") == 2).withColumn("delta_e", F.round("delta_e", 4))


@check("b02_mask_previews", """with o(code,cr,al) as (values (1,0,0.65::double),(2,118,0.12::double),(3,0,0.62::double)), px as (select image_id, round(avg(trunc(r*(1-al)+cr*al)),6) mean_r from v_rgb join o using(code) group by 1),
    st as (select image_id, round_even(count(*) filter(code=1)/count(*)*100.0,2) ore, round_even(count(*) filter(code=3)/count(*)*100.0,2) talc from v_rgb group by 1) select * from px join st using(image_id)""")
def _(spark, sf):
    from tilewright.plans.exports import preview_pixels

    rows = Tables(spark, sf).rgb()
    shown = preview_pixels(rows).groupBy("image_id").agg(F.round(F.avg("r"), 6).alias("mean_r"))
    return shown.join(stats.class_percentages(rows, "image_id", s.class_name(F.col("code"))).select("image_id", "ore", "talc"), "image_id")
