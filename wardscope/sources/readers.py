"""Scans: CSV in several encodings, XML items, GeoJSON features, landed payloads.

CSV columns are read as text and cast where they are used, so a bad value is a
NULL in one cell and never a failed scan.  No scan infers a schema, which would
read the data twice.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import address_region, number
from wardscope.operators.contract import require_columns
from wardscope.operators.dedupe import keep_first

KOREAN_CHARSET = "x-windows-949"

RENAMES = {
    # fixed values: source column -> canonical column
    "기관코드": "entity_id", "병원명": "name", "등급": "grade", "주소": "address", "전화": "phone",
    "위도": "lat", "경도": "lon", "시도": "province", "시군구": "district", "시군구코드": "region_key",
    "시군구명": "district", "가용병상": "available", "전체병상": "total", "포화율": "saturation", "상태": "status",
    "API기준시각": "source_ts", "수집시각": "collected_ts", "직선거리_km": "straight_km", "도로거리_km": "road_km",
    "예상시간_분": "eta_min", "경로상태": "route_status", "경로결과코드": "route_code", "경로요청키": "route_key",
    "응급의학과전문의수": "specialists", "암호화요양기호": "catalog_id", "매칭점수": "match_score",
    "매칭상태": "match_state", "매칭률": "match_rate", "데이터품질": "quality", "인구": "population",
    "병상포화도점수": "s_load", "병상데이터기관수": "n_reporting", "접근성점수": "s_access",
    "인구대비병상점수": "s_pop", "의료진부족점수": "s_staff", "완성항목수": "n_components", "regionRisk": "risk",
    "위험등급": "risk_grade", "위험등급명": "risk_grade_name", "산출상태": "calc_state", "클러스터": "cluster",
}


def canonical(df: DataFrame) -> DataFrame:
    """Known source columns under their canonical names, all others untouched."""
    taken: set[str] = set()
    out = []
    for c in df.columns:
        name = RENAMES.get(c, c)
        name = c if name in taken else name
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def read_csv(spark: SparkSession, path, required: list[str] | None = None, strict: bool = True) -> DataFrame:
    """All-text CSV by header (a byte-order mark is dropped); a malformed line is an error unless ``strict`` is off."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("ignoreLeadingWhiteSpace", False)
    df = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    if required:
        require_columns(df, required, str(path))
    return df


def read_optional(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """The CSV if it exists, otherwise an empty frame with the given columns."""
    try:
        df = read_csv(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)
    return df.select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    )


def with_optional_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def read_ledgers(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The hand-kept tables; a missing one is an error, not an empty table."""
    return {name: read_csv(spark, path) for name, path in paths.items()}


def read_registry(spark: SparkSession, path) -> DataFrame:
    """Registry resident file in the Korean code page, all text."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # the scan looks it up when it runs
    return spark.read.option("header", True).option("encoding", KOREAN_CHARSET).csv(path)


def numbered_lines(spark: SparkSession, path, charset: str = "UTF-8") -> DataFrame:
    """(path, line, value): the lines of each file that are not blank, numbered from 0 in file order.

    A file is read by as many tasks as it has splits.  Each split counts its lines, the counts of the
    splits before it are summed per file, and a line's number is that sum and its place in its split.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # the scan looks it up when it runs
    split = ["path", "_start"]
    # one column: a separator that no text has, and no quotes; unlike the text source this one knows code pages
    text = spark.read.schema("value string").option("encoding", charset).option("sep", "\u0001").option("quote", "").csv(path)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), "value").filter(F.trim("value") != "")
    # counts rows within a task; a split's lines follow each other in one task
    lines = lines.withColumn("_place", F.monotonically_increasing_id())
    splits = lines.groupBy(*split).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")
    return lines.join(splits.select(*split, offset.alias("_offset")), split).select("path", (F.col("_place") + F.col("_offset")).alias("line"), "value")


def read_positional(
    spark: SparkSession, path, columns: int = 6, skip: int = 2, charset: str = KOREAN_CHARSET, multi_line: bool = False
) -> DataFrame:
    """Korean code page file with ``skip`` leading lines and a header line, addressed by position; blank lines do not count.

    One file is read by many tasks.  ``multi_line`` is for files whose quoted fields hold line breaks: their
    lines cannot be told from a split, so each file is one task's work.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    if not multi_line:
        fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(columns)))
        return numbered_lines(spark, path, charset).filter(F.col("line") > skip).select(fields.alias("_f")).select("_f.*")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = spark.read.schema(schema).option("encoding", charset).option("multiLine", True).csv(path)
    # a multi-line file is read as one split, so this id counts lines from 0 within each file
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_line", line).filter(F.col("_line") > skip).drop("_line")


def newest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """Last path by name among those matching a glob."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return None
    return files.agg(F.max("path")).first()[0]


def file_period(path: str) -> str | None:
    found = re.search(r"(\d{6})", path.rsplit("/", 1)[-1])
    return found.group(1) if found else None


def choose_residents(spark: SparkSession, folder: str, regions: DataFrame, source: str | None = None, period: str | None = None) -> DataFrame:
    """Residents from an explicit file, else the newest registry file, else the newest fallback file."""
    from wardscope.operators.population import residents_from_fallback, residents_from_registry

    if period is not None and not re.fullmatch(r"\d{6}", period):
        raise ValueError("period must be YYYYMM")
    path = source or newest_file(spark, folder, f"mois_population_{period}.csv" if period else "mois_population_*.csv")
    if path:
        return residents_from_registry(read_registry(spark, path), regions, file_period(path))
    if period:
        raise FileNotFoundError(f"no registry file for {period}")
    path = newest_file(spark, folder, "101_DT_1B04006_Y_*.csv")
    if not path:
        raise FileNotFoundError("no resident source found")
    year = re.search(r"Y_(\d{4})", path)
    return residents_from_fallback(read_positional(spark, path), regions, year.group(1) if year else None)


def read_xml_items(spark: SparkSession, path, schema: T.StructType, tag: str = "item") -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def response_facts(spark: SparkSession, path) -> DataFrame:
    """Result code, announced total and received rows of each landed XML response."""
    docs = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    code = F.trim(F.coalesce(F.nullif(F.expr("xpath_string(value, '//resultCode')"), F.lit("")), F.expr("xpath_string(value, '//returnReasonCode')")))
    return docs.select(
        "file", code.alias("result_code"),
        F.expr("xpath_string(value, '//totalCount')").try_cast("bigint").alias("announced"),
        F.size(F.expr("xpath(value, '//item')")).cast("bigint").alias("received"),
    )


def response_violations(facts: DataFrame) -> DataFrame:
    """Responses with a bad result code or fewer rows than announced."""
    bad = F.when(~F.col("result_code").eqNullSafe(F.lit("00")), "result_code").when(
        ~F.col("announced").eqNullSafe(F.col("received")), "incomplete"
    )
    return facts.select(bad.alias("check"), F.col("file").alias("key"), F.col("result_code").alias("detail")).filter("check is not null")


def catalog_violations(catalog: DataFrame, announced: int) -> DataFrame:
    """A multi-page catalogue must be complete, with non-empty unique ids."""
    from wardscope.operators import contract as C

    ids = catalog.select(F.nullif(F.trim(F.col("catalog_id")), F.lit("")).alias("catalog_id"))
    return C.expected_count(ids, announced, "catalog_rows").unionByName(C.unique(ids, ["catalog_id"], "catalog_id"))


MASTER_ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("hpid", "phpid", "dutyName", "dutyEmcls", "dutyEmclsName", "wgs84Lat", "wgs84Lon", "dutyAddr", "dutyTel3", "dutyTel1")]
)


def master_rows(items: DataFrame, received: str | None = None) -> DataFrame:
    """Typed master rows from raw list records, the first received per id (by the ``received`` number, else by name)."""
    def text(name: str) -> Column:
        return F.nullif(F.coalesce(F.col(name), F.lit("")), F.lit(""))

    grades = F.create_map(*[F.lit(x) for pair in V.GRADE_BY_CODE.items() for x in pair])
    code = F.coalesce(F.col("dutyEmcls"), F.lit(""))
    address = F.coalesce(F.col("dutyAddr"), F.lit(""))
    province, district = address_region(address)
    rows = items.select(
        F.coalesce(text("hpid"), text("phpid")).alias("entity_id"),
        F.coalesce("dutyName", F.lit("")).alias("name"),
        F.coalesce(text("dutyEmclsName"), F.try_element_at(grades, code), code).alias("grade"),
        number("wgs84Lat").alias("lat"), number("wgs84Lon").alias("lon"), address.alias("address"),
        F.coalesce(text("dutyTel3"), F.col("dutyTel1"), F.lit("")).alias("phone"),
        province.alias("province"), district.alias("district"),
        (text("wgs84Lat").isNull() | text("wgs84Lon").isNull()).alias("coord_missing"),
        (F.col(received) if received else F.lit(None).cast("bigint")).alias("_received"),
    ).filter("entity_id is not null")
    return keep_first(rows, ["entity_id"], ["_received", "name", "address"]).drop("_received")


def feed_rows(items: DataFrame) -> DataFrame:
    """Feed records: availability, capacity and source stamp per id."""
    return items.select(
        F.trim("hpid").alias("entity_id"), number("hvec").alias("available"), number("hvs01").alias("total"), F.col("hvidate").alias("source_ts")
    )


def specialist_counts(items: DataFrame) -> DataFrame:
    """Emergency specialists per catalogue id; negative or unreadable counts are an error row."""
    rows = items.filter(F.col("dgsbjtCd") == V.STAFF_SUBJECT_CODE)
    count = F.coalesce(F.nullif(F.trim("dtlSdrCnt"), F.lit("")), F.lit("0")).try_cast("int")
    return rows.groupBy("catalog_id").agg(
        F.sum(count).cast("double").alias("specialists"), F.count_if(count.isNull() | (count < 0)).alias("n_bad")
    )


_ROUTE = "struct<routes:array<struct<result_code:int,summary:struct<distance:string,duration:string>>>>"


def route_results(payloads: DataFrame, body: str = "payload") -> DataFrame:
    """Road distance, time, code and status out of landed route answers."""
    first = F.get(F.from_json(F.col(body), _ROUTE)["routes"], 0)
    code = first["result_code"]
    km = first["summary"]["distance"].try_cast("double") / 1000
    minutes = first["summary"]["duration"].try_cast("double") / 60
    malformed = km.isNull() | minutes.isNull()
    finite = (F.abs(km) < float("inf")) & (F.abs(minutes) < float("inf")) & ~F.isnan(km) & ~F.isnan(minutes)
    bad = ~finite | (km < 0) | (minutes < 0)
    status = (
        F.when(first.isNull(), V.ROUTE_NONE)
        .when(code == 104, V.ROUTE_OK_ZERO)
        .when(~code.eqNullSafe(F.lit(0)), F.concat(F.lit(V.ROUTE_ERROR_PREFIX), F.coalesce(code.cast("string"), F.lit("None"))))
        .when(malformed, V.ROUTE_BAD_FORMAT)
        .when(bad, V.ROUTE_BAD_VALUE)
        .otherwise(V.ROUTE_OK)
    )
    rows = payloads.withColumn("route_status", status).withColumn("route_code", F.when(first.isNotNull(), code))
    ok, zero = F.col("route_status") == V.ROUTE_OK, F.col("route_status") == V.ROUTE_OK_ZERO
    return rows.withColumn("road_km", F.when(zero, 0.0).when(ok, km)).withColumn("eta_min", F.when(zero, 0.0).when(ok, minutes))


_POLYGON = "array<array<array<double>>>"


def read_boundaries(spark: SparkSession, path) -> DataFrame:
    """GeoJSON features: one row per polygon with rings of ``struct<x, y>``."""
    properties = "struct<code:string,name:string,sidoCode:string,sido:string,areaSqm:bigint>"
    schema = (
        "type string, metadata map<string,string>, "
        f"features array<struct<type:string,properties:{properties},geometry:struct<type:string,coordinates:string>>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    feature = doc.select(F.col("metadata")["version"].alias("version"), F.explode("features").alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    shapes = F.when(kind == "Polygon", F.array(F.from_json(raw, _POLYGON))).when(
        kind == "MultiPolygon", F.from_json(raw, f"array<{_POLYGON}>")
    )

    def ring(points: Column) -> Column:
        pairs = F.filter(points, lambda p: F.size(p) >= 2)
        return F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))

    return feature.select(
        "version", F.col("f.properties.code").alias("code"), F.trim("f.properties.name").alias("name"),
        F.col("f.properties.sidoCode").alias("province_code"), F.trim("f.properties.sido").alias("province"),
        kind.alias("geometry_type"), F.explode_outer(shapes).alias("_s"),
    ).select("*", F.transform(F.col("_s"), ring).alias("rings")).drop("_s")
