"""Column expressions for names, keys, numbers, verdicts and job documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds and texts that results depend on.
TALC_LIMIT = 0.10
DIFFICULT_LIMIT = 0.50
VERDICT_TALC = "оталькованная"
VERDICT_DIFFICULT = "труднообогатимая"
VERDICT_ORDINARY = "рядовая"
CLASS_NAMES = ("ore", "matrix", "talc", "damage")
CLASS_CODES = {"ore": 1, "matrix": 2, "talc": 3, "damage": 4}
LEGACY_DAMAGE_CODE = 5
GRAY_MEAN, GRAY_STD = 0.449, 0.226
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
DEFAULT_JOB_ERROR = "Segmentation job failed"

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def safe_file_name(name: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(name, "[^A-Za-zА-Яа-я0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("image"))


def edit_file_key(image: Column) -> Column:
    """Edit document key: 12 hex digits of sha1, then an ASCII-safe name."""
    cleaned = F.btrim(F.regexp_replace(image, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.concat(F.substring(F.sha1(image), 1, 12), F.lit("_"), F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("image")))


def settings_file_key(image: Column) -> Column:
    return F.substring(F.sha2(image, 256), 1, 12)


def artifact_key(image: Column, source: Column, size: Column, mtime_ns: Column, settings: Column, schema: int = 2) -> Column:
    """Content key of a colour artefact: sha256 of JSON with sorted keys, first 24 digits."""
    document = F.to_json(F.struct(
        F.lit(schema).alias("classSchema"), image.alias("image"), settings.alias("settings"), source.alias("source"),
        mtime_ns.alias("sourceMtimeNs"), size.alias("sourceSize"),
    ))
    return F.substring(F.sha2(document, 256), 1, 24)


def is_artifact_key(key: Column) -> Column:
    return F.coalesce(key.rlike("^[0-9a-f]{24}$"), F.lit(False))


def parse_number(text: Column) -> Column:
    """Text to double: plain numbers, ``nan`` and ``inf``; anything else is NULL."""
    trimmed = F.lower(F.trim(text))
    return (
        F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))
        .when(trimmed.rlike("^[+-]?nan$"), F.lit(float("nan")))
        .when(trimmed.rlike("^[+]?inf(inity)?$"), F.lit(float("inf")))
        .when(trimmed.rlike("^-inf(inity)?$"), F.lit(float("-inf")))
    )


def clamp_int(number: Column, default: int, low: int, high: int) -> Column:
    kept = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number)).cast("int")
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(kept)


def clamp_float(number: Column, default: float, low: float, high: float) -> Column:
    """NaN ends at the upper bound, as the order of min and max demands."""
    kept = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number))
    return F.when(number.isNull(), F.lit(float(default))).when(F.isnan(number), F.lit(float(high))).otherwise(kept)


def bounded_int(text: Column, default: int, low: int, high: int) -> Column:
    return clamp_int(parse_number(text), default, low, high)


def bounded_float(text: Column, default: float, low: float, high: float) -> Column:
    return clamp_float(parse_number(text), default, low, high)


def flag_value(text: Column, default: bool = False) -> Column:
    word = F.lower(F.trim(text))
    return (
        F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False)
        .otherwise(F.lit(default))
    )


def verdict(talc_ratio: Column, probability: Column) -> Column:
    return (
        F.when(talc_ratio > TALC_LIMIT, VERDICT_TALC).when(probability >= DIFFICULT_LIMIT, VERDICT_DIFFICULT)
        .otherwise(VERDICT_ORDINARY)
    )


def error_text(trace: Column) -> Column:
    """Last line of a trace, at most its last 500 characters."""
    trimmed = F.regexp_replace(trace, r"^\s+|\s+$", "")
    last = F.element_at(F.split(trimmed, "\r\n|\r|\n"), -1)
    return F.when(F.coalesce(trace, F.lit("")) == "", F.lit(DEFAULT_JOB_ERROR)).otherwise(F.right(last, F.lit(500)))


_ANALYSIS = T.StructType([
    T.StructField("talc_ratio", T.DoubleType()), T.StructField("is_talcose", T.BooleanType()),
    T.StructField("difficulty_probability", T.DoubleType()), T.StructField("is_difficult", T.BooleanType()),
    T.StructField("verdict", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("classification_classes", T.ArrayType(T.StringType())),
])


def _is_json_string(document: Column, key: str) -> Column:
    """A string field keeps its quotes in the raw text, a number does not."""
    return document.rlike(f'"{key}"\\s*:\\s*"')


def job_analysis(document: Column) -> Column:
    """Typed view of a finished job: ill-typed fields drop out, flags need their number."""
    parsed = F.from_json(document, _ANALYSIS, {"mode": "PERMISSIVE"})
    flag = lambda number, name: F.when(
        parsed[number].isNotNull(), F.coalesce(parsed[name], F.lit(False)))
    result = F.struct(
        parsed["talc_ratio"].alias("talc_ratio"), flag("talc_ratio", "is_talcose").alias("is_talcose"),
        parsed["difficulty_probability"].alias("difficulty_probability"),
        flag("difficulty_probability", "is_difficult").alias("is_difficult"),
        F.when(_is_json_string(document, "verdict"), parsed["verdict"]).alias("verdict"),
        parsed["classes"].alias("classes"), parsed["classification_classes"].alias("classification_classes"),
    )
    useful = F.coalesce(
        parsed["talc_ratio"].isNotNull() | parsed["difficulty_probability"].isNotNull()
        | _is_json_string(document, "verdict") | parsed["classes"].isNotNull()
        | parsed["classification_classes"].isNotNull(), F.lit(False))
    return F.when(useful, result)


_PROGRESS = T.StructType([
    T.StructField("stage", T.StringType()), T.StructField("processed_tiles", T.LongType()),
    T.StructField("total_tiles", T.LongType()), T.StructField("percent", T.DoubleType()),
])


def job_progress(document: Column) -> Column:
    parsed = F.from_json(document, _PROGRESS, {"mode": "PERMISSIVE"})
    stage = F.when(_is_json_string(document, "stage"), parsed["stage"])
    fields = [stage, parsed["processed_tiles"], parsed["total_tiles"], parsed["percent"]]
    useful = F.coalesce(*[F.when(f.isNotNull(), True) for f in fields], F.lit(False))
    return F.when(useful, F.struct(
        stage.alias("stage"), parsed["processed_tiles"].alias("processed_tiles"),
        parsed["total_tiles"].alias("total_tiles"), parsed["percent"].alias("percent")))


def percent_done(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(value, 1)))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def softmax_array(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def standard_gray(value: Column) -> Column:
    return (value / 255.0 - GRAY_MEAN) / GRAY_STD


def standard_rgb(channels: list[Column]) -> list[Column]:
    return [(c / 255.0 - m) / s for c, m, s in zip(channels, IMAGENET_MEAN, IMAGENET_STD)]


def class_name(code: Column) -> Column:
    """Codes 1..4, the legacy code as damage, everything else as matrix."""
    return (
        F.when(code == 1, "ore").when(code == 3, "talc").when((code == 4) | (code == LEGACY_DAMAGE_CODE), "damage")
        .otherwise("matrix")
    )


def class_code(name: Column) -> Column:
    return F.when(name == "ore", 1).when(name == "matrix", 2).when(name == "talc", 3).when(name == "damage", 4)


def class_index(code: Column) -> Column:
    """Model index 0..3; codes outside 1..4 have none."""
    return F.when(code.between(1, 4), code - 1)


def unfreeze_level(epoch: Column) -> Column:
    """How many encoder stages train in an epoch of the progressive schedule."""
    return F.when(epoch > 20, 4).when(epoch > 8, 2).otherwise(1)


def training_phase(epoch: Column, head_only_epochs: int) -> Column:
    return F.when(epoch <= head_only_epochs, "head_only").otherwise("layer4_finetune")
