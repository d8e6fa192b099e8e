"""Scalar expressions: names, keys, numbers, settings, jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import Tables
from tilewright.functions import scalar as s
from tilewright.functions import settings as st


@check("f01_safe_file_names", """
    select doc_id, coalesce(nullif(trim(regexp_replace(concat(text,'.png'), '[^A-Za-zА-Яа-я0-9._-]+', '_', 'g'), '._'), ''), 'image') file_name
    from documents""")
def _(spark, sf):
    return Tables(spark, sf).raw("documents").select(
        "doc_id", s.safe_file_name(F.concat("text", F.lit(".png"))).alias("file_name"))


@check("f02_file_keys", """
    select source_path, concat(sha1(source_path)[1:12], '_', coalesce(nullif(trim(regexp_replace(source_path,'[^A-Za-z0-9_.-]+','_','g'),'_'),''),'image')) edit_key,
           sha256(source_path)[1:12] settings_key from v_sources""")
def _(spark, sf):
    path = F.col("source_path")
    return Tables(spark, sf).sources().select(path, s.edit_file_key(path).alias("edit_key"), s.settings_file_key(path).alias("settings_key"))


@check("f03_artifact_keys", """
    select source_path, sha256(concat('{"classSchema":2,"image":"', source_path, '","settings":{"max_work_side":1300,"morph_radius":1},"source":"/data/',
        source_path, '","sourceMtimeNs":', cast(n_chars*1000 as varchar), ',"sourceSize":', cast(n_chars as varchar), '}'))[1:24] artifact_key
    from v_sources""")
def _(spark, sf):
    path, size = F.col("source_path"), F.col("n_chars")
    settings = F.struct(F.lit(1300).alias("max_work_side"), F.lit(1).alias("morph_radius"))
    return Tables(spark, sf).sources().select(
        path, s.artifact_key(path, F.concat(F.lit("/data/"), path), size, size * 1000, settings).alias("artifact_key"))


@check("f04_artifact_key_validity", """
    with keys as (select source_path, case when n_chars%3=0 then sha256[1:24] when n_chars%3=1 then upper(sha256[1:24]) else sha256[1:23] end k from v_sources)
    select source_path, regexp_full_match(k, '[0-9a-f]{24}') valid from keys""")
def _(spark, sf):
    n, sha = F.col("n_chars"), F.col("sha256")
    key = F.when(n % 3 == 0, F.substring(sha, 1, 24)).when(n % 3 == 1, F.upper(F.substring(sha, 1, 24))).otherwise(F.substring(sha, 1, 23))
    return Tables(spark, sf).sources().select("source_path", s.is_artifact_key(key).alias("valid"))


@check("f05_bounded_int", """
    select image_id, case when try_cast(raw as double) is null or isnan(try_cast(raw as double)) then 7
        else cast(trunc(greatest(3.0, least(1200.0, try_cast(raw as double)))) as int) end k from v_raw_settings""")
def _(spark, sf):
    return Tables(spark, sf).raw_settings().select("image_id", s.bounded_int(F.col("raw"), 7, 3, 1200).alias("k"))


@check("f06_bounded_float", """
    select image_id, case when try_cast(raw as double) is null then 56.0 when isnan(try_cast(raw as double)) then 1000.0
        else round(greatest(0.0, least(1000.0, try_cast(raw as double))),6) end l_min from v_raw_settings""")
def _(spark, sf):
    return Tables(spark, sf).raw_settings().select(
        "image_id", F.round(s.bounded_float(F.col("raw"), 56.0, 0, 1000), 6).alias("l_min"))


def _settings_sql() -> str:
    parts = []
    for section in st.SECTIONS:
        for key, kind, default, low, high in st.SECTIONS[section]:
            n = "try_cast(raw as double)"
            kept = f"greatest({float(low)}::double, least({float(high)}::double, {n}))"
            if kind == "int":
                body = f"case when {n} is null or isnan({n}) then {default} else cast(trunc({kept}) as int) end"
            else:
                body = f"case when {n} is null then {float(default)}::double when isnan({n}) then {float(high)}::double else {kept} end"
            parts.append(f'{body} as "{section}_{key}"')
    return f"select image_id, {', '.join(parts)} from v_raw_settings"


@check("f07_settings_parsers", _settings_sql())
def _(spark, sf):
    keys = sorted({row[0] for rows in st.SECTIONS.values() for row in rows})
    params = F.create_map(*[x for key in keys for x in (F.lit(key), F.col("raw"))])
    fields = [f for section in st.SECTIONS for f in st.parsed_fields(F.col("params"), section, f"{section}_")]
    return Tables(spark, sf).raw_settings().withColumn("params", st.numbers(params)).select("image_id", *fields)


@check("f08_flag_values", """
    select image_id, case when lower(trim(w)) in ('1','true','yes','on') then true when lower(trim(w)) in ('0','false','no','off') then false else false end flag
    from (select image_id, case image_id%6 when 0 then ' YES ' when 1 then 'off' when 2 then '1' when 3 then flag when 4 then 'True' end w from v_raw_settings)""")
def _(spark, sf):
    k = F.col("image_id") % 6
    word = F.when(k == 0, " YES ").when(k == 1, "off").when(k == 2, "1").when(k == 3, F.col("flag")).when(k == 4, "True")
    return Tables(spark, sf).raw_settings().select("image_id", s.flag_value(word).alias("flag"))


_DOCS_SQL = """
    select image_id, case image_id%8
        when 0 then concat('{"a2":{"morph_radius":"', coalesce(raw,'x'), '"},"excluded_from_exports":"yes"}')
        when 1 then concat('{"approach":{"morph_radius":', cast(image_id%11 as varchar), '},"sketch":{}}')
        when 2 then concat('{"target":"approach","settings":{"morph_radius":', cast(image_id%5 as varchar), '}}')
        when 3 then concat('{"target":"sketch","settings":{"connection_max_distance":"', coalesce(raw,'x'), '"},"excluded_from_exports":true}')
        when 4 then concat('{"target":"corrected","settings":{"crop_min_area_ratio":0.', cast(image_id%9 as varchar), '}}')
        when 5 then concat('{"corrected":{"crop_min_area_ratio":0.', cast(image_id%7 as varchar), ',"crop_max_rotation_degrees":"9"}}')
        when 6 then concat('not json ', flag) end as doc from v_raw_settings"""


def _docs(tables):
    k, raw = F.col("image_id") % 8, F.coalesce("raw", F.lit("x"))
    text = lambda n: (F.col("image_id") % n).cast("string")
    doc = (
        F.when(k == 0, F.concat(F.lit('{"a2":{"morph_radius":"'), raw, F.lit('"},"excluded_from_exports":"yes"}')))
        .when(k == 1, F.concat(F.lit('{"approach":{"morph_radius":'), text(11), F.lit('},"sketch":{}}')))
        .when(k == 2, F.concat(F.lit('{"target":"approach","settings":{"morph_radius":'), text(5), F.lit("}}")))
        .when(k == 3, F.concat(F.lit('{"target":"sketch","settings":{"connection_max_distance":"'), raw, F.lit('"},"excluded_from_exports":true}')))
        .when(k == 4, F.concat(F.lit('{"target":"corrected","settings":{"crop_min_area_ratio":0.'), text(9), F.lit("}}")))
        .when(k == 5, F.concat(F.lit('{"corrected":{"crop_min_area_ratio":0.'), text(7), F.lit(',"crop_max_rotation_degrees":"9"}}')))
        .when(k == 6, F.concat(F.lit("not json "), F.col("flag")))
    )
    return tables.raw_settings().select("image_id", doc.alias("doc"))


_SETTINGS_FROM_DOCS = f"""
    with docs as ({_DOCS_SQL}),
    ok as (select image_id, case when json_valid(doc) then doc end doc from docs),
    t as (select image_id, doc is not null customized,
        coalesce(json_extract_string(doc,'$.a2.morph_radius'), json_extract_string(doc,'$.approach.morph_radius'),
            case when json_extract_string(doc,'$.target')='approach' then json_extract_string(doc,'$.settings.morph_radius') end) m,
        case when json_extract_string(doc,'$.target')='sketch' then json_extract_string(doc,'$.settings.connection_max_distance') end d,
        coalesce(json_extract_string(doc,'$.corrected.crop_min_area_ratio'),
            case when json_extract_string(doc,'$.target')='corrected' then json_extract_string(doc,'$.settings.crop_min_area_ratio') end) c,
        coalesce(lower(json_extract_string(doc,'$.excluded_from_exports')) in ('yes','true'), false) excluded from ok)
    select image_id, customized, excluded,
        case when try_cast(m as double) is null or isnan(try_cast(m as double)) then 1 else cast(trunc(greatest(0.0::double, least(8.0::double, try_cast(m as double)))) as int) end morph_radius,
        case when try_cast(d as double) is null then 300.0::double when isnan(try_cast(d as double)) then 3000.0::double else greatest(0.0::double, least(3000.0::double, try_cast(d as double))) end max_distance,
        case when try_cast(c as double) is null then 0.5::double else greatest(0.1::double, least(1.0::double, try_cast(c as double))) end min_area, 0 rotation
    from t"""


@check("f09_settings_sections", _SETTINGS_FROM_DOCS)
def _(spark, sf):
    parsed = st.with_settings(_docs(Tables(spark, sf)), "doc", "s")
    return parsed.select(
        "image_id", "s.customized", F.col("s.excluded_from_exports").alias("excluded"), "s.a2.morph_radius",
        F.col("s.sketch.connection_max_distance").alias("max_distance"), F.col("s.correction.crop_min_area_ratio").alias("min_area"),
        F.col("s.correction.crop_max_rotation_degrees").alias("rotation"))


@check("f10_verdict_words", """
    select tile_id, case when ore_ratio>0.10 then 'оталькованная' when prob>=0.50 then 'труднообогатимая' else 'рядовая' end verdict from v_tiles""")
def _(spark, sf):
    return Tables(spark, sf).tiles().select("tile_id", s.verdict(F.col("ore_ratio"), F.col("prob")).alias("verdict"))


@check("f11_error_texts", r"""
    select doc_id, case when t='' then 'Segmentation job failed' else right(list_last(string_split_regex(regexp_replace(t,'^\s+|\s+$','','g'), '\r\n|\r|\n')), 500) end error
    from (select doc_id, case when doc_id%9=0 then '' else concat(text, chr(10)) end t from documents)""")
def _(spark, sf):
    trace = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat("text", F.lit("\n")))
    return Tables(spark, sf).raw("documents").select("doc_id", s.error_text(trace).alias("error"))


_JOB_SQL = """select event_id, user_id, case event_id%5
        when 0 then concat('{"talc_ratio":0.', lpad(cast(event_id%100 as varchar),2,'0'), ',"is_talcose":true,"verdict":"ok","classes":["ore","talc"]}')
        when 1 then concat('{"talc_ratio":"0.5","difficulty_probability":0.', lpad(cast(event_id%97 as varchar),2,'0'), '}')
        when 2 then '{"verdict":7,"is_difficult":true}'
        when 3 then concat('{"stage":"', event_type, '","processed_tiles":', cast(event_id%40 as varchar), ',"total_tiles":"40","percent":', cast(event_id%101 as varchar), '}')
        else props end doc from events"""


def _jobs(tables):
    k, text = F.col("event_id") % 5, lambda n: (F.col("event_id") % n).cast("string")
    doc = (
        F.when(k == 0, F.concat(F.lit('{"talc_ratio":0.'), F.lpad(text(100), 2, "0"), F.lit(',"is_talcose":true,"verdict":"ok","classes":["ore","talc"]}')))
        .when(k == 1, F.concat(F.lit('{"talc_ratio":"0.5","difficulty_probability":0.'), F.lpad(text(97), 2, "0"), F.lit("}")))
        .when(k == 2, '{"verdict":7,"is_difficult":true}')
        .when(k == 3, F.concat(F.lit('{"stage":"'), F.col("event_type"), F.lit('","processed_tiles":'), text(40), F.lit(',"total_tiles":"40","percent":'), text(101), F.lit("}")))
        .otherwise(F.col("props"))
    )
    return tables.raw("events").select("event_id", "user_id", doc.alias("doc"))


@check("f12_job_analysis", f"""
    with j as ({_JOB_SQL})
    select event_id, case when json_type(doc,'$.talc_ratio') in ('DOUBLE','UBIGINT') then cast(json_extract_string(doc,'$.talc_ratio') as double) end talc_ratio,
        case when json_type(doc,'$.talc_ratio') in ('DOUBLE','UBIGINT') then coalesce(json_extract_string(doc,'$.is_talcose')='true', false) end is_talcose,
        case when json_type(doc,'$.difficulty_probability') in ('DOUBLE','UBIGINT') then cast(json_extract_string(doc,'$.difficulty_probability') as double) end difficulty,
        case when json_type(doc,'$.difficulty_probability') in ('DOUBLE','UBIGINT') then false end is_difficult,
        case when json_type(doc,'$.verdict')='VARCHAR' then json_extract_string(doc,'$.verdict') end verdict,
        coalesce(json_array_length(doc,'$.classes'),0) n_classes
    from j""")
def _(spark, sf):
    a = s.job_analysis(F.col("doc"))
    return _jobs(Tables(spark, sf)).withColumn("a", a).select(
        "event_id", "a.talc_ratio", "a.is_talcose", F.col("a.difficulty_probability").alias("difficulty"), "a.is_difficult",
        "a.verdict", F.greatest(F.coalesce(F.size("a.classes"), F.lit(0)), F.lit(0)).alias("n_classes"))


@check("f13_job_progress", f"""
    with j as ({_JOB_SQL})
    select event_id, case when event_id%5=3 then json_extract_string(doc,'$.stage') end stage,
        case when event_id%5=3 then cast(json_extract_string(doc,'$.processed_tiles') as double) end processed,
        cast(null as double) total, case when event_id%5=3 then cast(json_extract_string(doc,'$.percent') as double) end percent
    from j""")
def _(spark, sf):
    return _jobs(Tables(spark, sf)).withColumn("p", s.job_progress(F.col("doc"))).select(
        "event_id", "p.stage", F.col("p.processed_tiles").cast("double").alias("processed"),
        F.col("p.total_tiles").cast("double").alias("total"), "p.percent")


@check("f14_percent_done", """
    select image_id, case when d is not null then greatest(0.0, least(100.0, round_even(d, 1))) end as percent
    from (select image_id, case when not isnan(try_cast(raw as double)) then try_cast(raw as double) end d from v_raw_settings)""")
def _(spark, sf):
    number = s.parse_number(F.col("raw"))
    rows = Tables(spark, sf).raw_settings().select("image_id", number.alias("d"))
    return rows.select("image_id", F.when(F.col("d").isNotNull() & ~F.isnan("d"), s.percent_done(F.col("d"))).alias("percent"))


@check("f32_sigmoid_softmax", """
    with v as (select vec_id, cast(embedding[1] as double) a, cast(embedding[2] as double) b, cast(embedding[3] as double) c, cast(embedding[4] as double) d from embeddings)
    select vec_id, round(1/(1+exp(-a)),6) p, round(exp(a)/(exp(a)+exp(b)+exp(c)+exp(d)),6) s1, round(exp(d)/(exp(a)+exp(b)+exp(c)+exp(d)),6) s4 from v""")
def _(spark, sf):
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    soft = s.softmax(e)
    same = s.softmax_array(F.array(*e))
    return Tables(spark, sf).raw("embeddings").select(
        "vec_id", F.round(s.sigmoid(e[0]), 6).alias("p"), F.round(soft[0], 6).alias("s1"), F.round(same[3], 6).alias("s4"))


@check("f24_class_codes", """
    select user_id*100000+event_id id, case event_id%7 when 1 then 'ore' when 3 then 'talc' when 4 then 'damage' when 5 then 'damage' else 'matrix' end class_name,
        case when event_id%7 between 1 and 4 then cast(event_id%7-1 as double) end class_index,
        case event_id%7 when 1 then 1 when 3 then 3 when 4 then 4 when 5 then 4 else 2 end code from events""")
def _(spark, sf):
    code = (F.col("event_id") % 7).cast("int")
    return Tables(spark, sf).raw("events").select(
        (F.col("user_id") * 100000 + F.col("event_id")).alias("id"), s.class_name(code).alias("class_name"),
        s.class_index(code).cast("double").alias("class_index"), s.class_code(s.class_name(code)).alias("code"))


@check("w12_training_phases", """
    select run_id, stage, epoch, case when epoch>20 then 4 when epoch>8 then 2 else 1 end unfrozen,
        case when epoch<=5 then 'head_only' else 'layer4_finetune' end phase from v_history""")
def _(spark, sf):
    return Tables(spark, sf).history().select(
        "run_id", "stage", "epoch", s.unfreeze_level(F.col("epoch")).alias("unfrozen"), s.training_phase(F.col("epoch"), 5).alias("phase"))


@check("j03_settings_with_defaults", f"""
    with docs as ({_DOCS_SQL}), saved as (select image_id, doc from docs where image_id%8 < 6)
    select i.image_id, s.doc is not null and json_valid(s.doc) customized,
        coalesce(lower(json_extract_string(case when json_valid(s.doc) then s.doc end,'$.excluded_from_exports')) in ('yes','true'), false) excluded
    from v_raw_settings i left join saved s on i.image_id=s.image_id""")
def _(spark, sf):
    from tilewright.plans.exports import with_image_settings

    tables = Tables(spark, sf)
    saved = _docs(tables).where(F.col("image_id") % 8 < 6)
    return with_image_settings(tables.raw_settings().select("image_id"), saved, "image_id").select(
        "image_id", "settings.customized", F.col("settings.excluded_from_exports").alias("excluded"))
