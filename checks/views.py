"""The library's record types derived from the test tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.scale import spread_for_python

SQL_VIEWS: dict[str, str] = {
    "v_tiles": """
        select user_id image_id, event_id tile_id, least(value/100.0, 1.0) prob,
               cast(json_extract_string(props,'$.k') as double)/100.0 ore_ratio,
               event_type<>'error' centre_inside, ts from events""",
    "v_pixels": """
        select vec_id image_id, cast(p//8 as int) y, cast(p%8 as int) x, cast(v as double) v,
               case when v>=0.1 then 1 when v<=-0.1 then 3 else 2 end code
        from (select vec_id, unnest(range(0,64)) p, unnest(embedding) v from embeddings)""",
    "v_mosaic": """
        select image_id//16 image_id, cast(((image_id%16)//4)*8+y as int) y, cast(((image_id%16)%4)*8+x as int) x,
               v, code, cast(floor(least(greatest((v+0.5)*255,0),255)) as int) r from v_pixels""",
    "v_rgb": """
        select image_id, y, x, code, r, (r*7+y*3)%256 g, (r*13+x*5)%256 b from v_mosaic""",
    "v_sources": """
        select case when cast(substring(source,4) as int)%4=3 then 'difficult' else 'ordinary' end as label,
               case when cast(substring(source,4) as int)%4=3 then 1 else 0 end label_id,
               concat(source,'/',lpad(cast(doc_id as varchar),9,'0'),'.png') source_path, sha256(text) sha256, n_chars
        from documents""",
    "v_pred": """
        select d.doc_id image_id, l.quality y_true, ((d.n_chars*7)%100)/100.0 prob
        from documents d join labels l on d.doc_id=l.doc_id""",
    "v_history": """
        select l_suppkey run_id, l_returnflag stage,
               row_number() over (partition by l_suppkey,l_returnflag order by l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity,l_discount,l_tax) epoch,
               l_tax drift, l_discount*10 val_f1, l_quantity/50.0 val_auc, l_extendedprice/100000.0 val_loss
        from lineitem""",
    "v_samples": """
        select event_id sample_id, user_id pid, ts, cast(event_id*13%101 as double) sm,
               cast(event_id*29%101 as double) mem, value*10 fb_mb from events""",
    "v_points": """
        select c_custkey//40 image_id,
               concat('e_',cast(c_custkey*37%1000 as varchar),'_',cast(c_custkey*91%800 as varchar)) endpoint_id,
               cast(c_custkey*37%1000 as double) x, cast(c_custkey*91%800 as double) y, c_custkey seq from customer""",
    "v_segments": """
        select p_partkey//64 image_id, p_partkey segment_id, p_size area, cast(p_partkey*17%1300 as double) cx,
               cast(p_partkey*23%1000 as double) cy, p_retailprice/100 l, cast(p_partkey%31 as double)-15 a,
               cast(p_partkey%43 as double)-21 b, cast(p_partkey%3 as int) region_id,
               cast(p_partkey%7 as int)-1 "cluster" from part""",
    "v_raw_settings": """
        select c_custkey image_id,
               case when c_custkey%5=0 then c_name when c_custkey%7=0 then null
                    when c_custkey%11=0 then 'nan' when c_custkey%13=0 then '-1'
                    else cast(c_custkey*3.7::double as varchar) end raw, c_mktsegment flag from customer""",
    "v_sizes": """
        select doc_id image_id, cast(300+n_chars%1500 as int) w, cast(300+(n_chars*7)%1100 as int) h from documents""",
}


class Tables:
    """Readers for the test tables and the derived record views."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """Rows dealt to all tasks by ``key``: a file of less than a split's size would be one task, whatever is made of its rows."""
        return spread_for_python(self.raw(name), key)

    def tiles(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("image_id"), F.col("event_id").alias("tile_id"),
            F.least(F.col("value") / 100.0, F.lit(1.0)).alias("prob"),
            (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("ore_ratio"),
            (F.col("event_type") != "error").alias("centre_inside"), F.col("ts").cast("timestamp").alias("ts"),
        )

    def pixels(self) -> DataFrame:
        v, p = F.col("v"), F.col("p")
        return self.spread("embeddings", "vec_id").select("vec_id", F.posexplode("embedding").alias("p", "v")).select(
            F.col("vec_id").alias("image_id"), (p / 8).cast("int").alias("y"), (p % 8).cast("int").alias("x"),
            v.cast("double").alias("v"),
            F.when(v.cast("double") >= 0.1, 1).when(v.cast("double") <= -0.1, 3).otherwise(2).alias("code"),
        )

    def mosaic(self) -> DataFrame:
        i = F.col("image_id") % 16
        return self.pixels().select(
            F.expr("image_id div 16").alias("image_id"), (F.floor(i / 4) * 8 + F.col("y")).cast("int").alias("y"),
            ((i % 4) * 8 + F.col("x")).cast("int").alias("x"), "v", "code",
            F.floor(F.least(F.greatest((F.col("v") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))).cast("int").alias("r"),
        )

    def rgb(self) -> DataFrame:
        r = F.col("r")
        return self.mosaic().select(
            "image_id", "y", "x", "code", "r", ((r * 7 + F.col("y") * 3) % 256).alias("g"),
            ((r * 13 + F.col("x") * 5) % 256).alias("b"),
        )

    def sources(self) -> DataFrame:
        hard = F.substring("source", 4, 10).cast("int") % 4 == 3
        return self.raw("documents").select(
            F.when(hard, "difficult").otherwise("ordinary").alias("label"),
            F.when(hard, 1).otherwise(0).alias("label_id"),
            F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".png")).alias("source_path"),
            F.sha2("text", 256).alias("sha256"), "n_chars",
        )

    def pred(self) -> DataFrame:
        return self.raw("documents").join(self.raw("labels"), "doc_id").select(
            F.col("doc_id").alias("image_id"), F.col("quality").alias("y_true"),
            (((F.col("n_chars") * 7) % 100) / 100.0).alias("prob"),
        )

    def history(self) -> DataFrame:
        from pyspark.sql.window import Window

        order = Window.partitionBy("l_suppkey", "l_returnflag").orderBy(
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("run_id"), F.col("l_returnflag").alias("stage"),
            F.row_number().over(order).alias("epoch"), F.col("l_tax").alias("drift"),
            (F.col("l_discount") * 10).alias("val_f1"), (F.col("l_quantity") / 50.0).alias("val_auc"),
            (F.col("l_extendedprice") / 100000.0).alias("val_loss"),
        )

    def samples(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("sample_id"), F.col("user_id").alias("pid"), F.col("ts").cast("timestamp").alias("ts"),
            (F.col("event_id") * 13 % 101).cast("double").alias("sm"),
            (F.col("event_id") * 29 % 101).cast("double").alias("mem"), (F.col("value") * 10).alias("fb_mb"),
        )

    def points(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            F.expr("c_custkey div 40").alias("image_id"),
            F.concat(F.lit("e_"), (k * 37 % 1000).cast("string"), F.lit("_"), (k * 91 % 800).cast("string")).alias("endpoint_id"),
            (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 800).cast("double").alias("y"), k.alias("seq"),
        )

    def segments(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            F.expr("p_partkey div 64").alias("image_id"), k.alias("segment_id"), F.col("p_size").alias("area"),
            (k * 17 % 1300).cast("double").alias("cx"), (k * 23 % 1000).cast("double").alias("cy"),
            (F.col("p_retailprice") / 100).alias("l"), ((k % 31).cast("double") - 15).alias("a"),
            ((k % 43).cast("double") - 21).alias("b"), (k % 3).cast("int").alias("region_id"),
            ((k % 7).cast("int") - 1).alias("cluster"),
        )

    def raw_settings(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("image_id"),
            F.when(k % 5 == 0, F.col("c_name")).when(k % 7 == 0, None).when(k % 11 == 0, "nan").when(k % 13 == 0, "-1")
            .otherwise((k * F.lit(3.7)).cast("string")).alias("raw"), F.col("c_mktsegment").alias("flag"),
        )

    def sizes(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("image_id"), (300 + F.col("n_chars") % 1500).cast("int").alias("w"),
            (300 + (F.col("n_chars") * 7) % 1100).cast("int").alias("h"),
        )
