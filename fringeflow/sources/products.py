"""Provider products, XML annotations and manifests as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

# What stands for an attribute that isn't there.
MISSING = ("", "NA", "N/A", "NOT AVAILABLE")

PRODUCT = (
    "properties struct<sceneName:string,fileID:string,platform:string,pathNumber:int,orbit:int,flightDirection:string,polarization:string,processingLevel:string,beamModeType:string,startTime:string,stopTime:string,"
    "url:string,pgeVersion:string,centerLat:double,centerLon:double,bytes:bigint,burst:struct<subswath:string,fullBurstID:string>>, geometry struct<type:string,coordinates:array<array<array<double>>>>, "
    "umm struct<AdditionalAttributes:array<struct<Name:string,Values:array<string>>>>, "
    "baseline struct<stateVectors:struct<positions:struct<prePosition:array<double>,prePositionTime:string,postPosition:array<double>,postPositionTime:string>,velocities:struct<preVelocity:array<double>,postVelocity:array<double>>>>"
)


def utc(text: Column) -> Column:
    """ISO-8601 with Z, an offset or neither as a timestamp without zone, in UTC."""
    zoned = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    given = F.when(zoned.rlike(r"[+-]\d\d:?\d\d$"), zoned).otherwise(F.concat(zoned, F.lit("+00:00")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(given).cast("timestamp_ntz"))


def attribute(umm: Column, name: str) -> Column:
    """First value of the named attribute; null where it is missing or says so."""
    value = F.get(F.get(F.filter(umm["AdditionalAttributes"], lambda a: a["Name"] == name), F.lit(0))["Values"], F.lit(0))
    return F.when(~value.isin(*MISSING), value)


def channels(polarization: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(polarization, F.lit(""))), F.lit(r"\b([HV]{2})\b"), F.lit(1))


def state_vectors(baseline: Column) -> Column:
    """Struct (pre, post) of times, positions and velocities; null if any is missing."""
    pos, vel = baseline["stateVectors"]["positions"], baseline["stateVectors"]["velocities"]
    parts = [pos["prePosition"], pos["prePositionTime"], vel["preVelocity"], pos["postPosition"], pos["postPositionTime"], vel["postVelocity"]]
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    one = lambda x, t, v: F.struct(utc(t).alias("time"), x.alias("position"), v.alias("velocity"))
    return F.when(whole, F.struct(one(*[parts[k] for k in (0, 1, 2)]).alias("pre"), one(*[parts[k] for k in (3, 4, 5)]).alias("post")))


def records(products: DataFrame, preferred: str | None = None) -> DataFrame:
    """Flat records of a provider's products (:data:`PRODUCT`), one for each granule, the first by start time.

    Spacings and incidences stay null: they come from annotations, by
    :func:`enriched`.  Products of unknown direction have a null direction.
    """
    p = F.col("properties")
    name = F.coalesce(p["sceneName"], p["fileID"], F.lit(""))
    seen = channels(p["polarization"])
    pol = F.coalesce(F.get(F.filter(seen, lambda c: c == F.lit((preferred or "").upper())), F.lit(0)), F.get(seen, F.lit(0)), p["polarization"], F.lit(""))
    digits = F.regexp_extract(F.coalesce(p["platform"], F.lit("")), r"(?i)sentinel-?1([A-D])", 1)
    direction = F.upper(p["flightDirection"])
    ring = F.get(F.col("geometry.coordinates"), F.lit(0))
    wkt = F.when(F.size(ring) > 0, F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda q: F.concat_ws(" ", F.get(q, F.lit(0)).cast("string"), F.get(q, F.lit(1)).cast("string"))), ", "), F.lit("))"))).otherwise("POLYGON EMPTY")
    burst = p["burst"]
    version = F.regexp_replace(F.trim(p["pgeVersion"]), r"^0+(?=\d)", "")
    rows = products.select(
        name.alias("granule_id"), F.when(digits != "", F.concat(F.lit("S1"), F.upper(digits))).otherwise(F.substring(F.upper(F.coalesce(p["platform"], name)), 1, 3)).alias("platform"),
        F.upper(F.coalesce(p["beamModeType"], attribute(F.col("umm"), "BEAM_MODE"), F.lit("IW"))).alias("mode"),
        F.coalesce(burst["subswath"], attribute(F.col("umm"), "SUBSWATH_NAME"), F.upper(F.coalesce(p["beamModeType"], F.lit("IW")))).alias("subswath"),
        F.when(burst.isNotNull(), F.coalesce(burst["fullBurstID"], attribute(F.col("umm"), "BURST_ID_FULL"), F.lit(""))).otherwise(name).alias("full_burst_id"),
        p["pathNumber"].alias("relative_orbit"), F.coalesce(p["orbit"], F.lit(0)).alias("absolute_orbit"), F.when(direction.isin("ASCENDING", "DESCENDING"), direction).alias("flight_direction"),
        pol.alias("polarization"), utc(p["startTime"]).alias("acquisition_time"), version.alias("ipf_version"),
        *[F.lit(None).cast("double").alias(c) for c in ("range_pixel_spacing_m", "azimuth_pixel_spacing_m", "incidence_near_deg", "incidence_far_deg")],
        wkt.alias("footprint_wkt"), F.coalesce(p["url"], F.lit("")).alias("url"), F.when(F.upper(p["processingLevel"]) == "BURST", "BURST").otherwise("SLC").alias("product_type"),
        p["centerLat"].alias("center_lat"), p["centerLon"].alias("center_lon"), state_vectors(F.col("baseline")).alias("state_vectors"),
    )
    first = Window.partitionBy("granule_id").orderBy("acquisition_time", "full_burst_id", "url")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def read_products(spark: SparkSession, path: str, preferred: str | None = None) -> DataFrame:
    """Records of a catalogue response: a JSON document with ``products``."""
    kind = "array<struct<" + PRODUCT.replace("properties struct", "properties:struct").replace(", geometry struct", ",geometry:struct").replace(", umm struct", ",umm:struct").replace(", baseline struct", ",baseline:struct") + ">>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<products:{kind}>")["products"]).alias("p"))
    return records(raw.select("p.*"), preferred)


_POINT = "geolocationGridPoint:array<struct<pixel:int,line:int,incidenceAngle:double>>"
_CONTENT = (
    "adsHeader struct<missionId:string,productType:string,polarisation:string,mode:string,swath:string,startTime:string,stopTime:string,absoluteOrbitNumber:int>, "
    "generalAnnotation struct<productInformation:struct<pass:string,platformHeading:double,rangeSamplingRate:double,radarFrequency:double>>, "
    "imageAnnotation struct<imageInformation:struct<slantRangeTime:double,rangePixelSpacing:double,azimuthPixelSpacing:double,azimuthTimeInterval:double,numberOfSamples:int,numberOfLines:int,incidenceAngleMidSwath:double>>, "
    "swathTiming struct<linesPerBurst:int,samplesPerBurst:int,burstList:struct<_count:int,burst:array<struct<azimuthTime:string>>>>, "
    f"geolocationGrid struct<geolocationGridPointList:struct<{_POINT}>>"
)


def _annotation(at: str) -> list[Column]:
    """The fields of an annotation that stands in columns below ``at``."""
    c = lambda path: F.col(f"{at}{path}")
    points = F.filter(c("geolocationGrid.geolocationGridPointList.geolocationGridPoint"), lambda q: q["pixel"].isNotNull() & q["incidenceAngle"].isNotNull())

    def mean_at(side):
        some = F.filter(points, lambda q: q["pixel"] == side(F.transform(points, lambda r: r["pixel"])))
        return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda t, q: t + q["incidenceAngle"]) / F.size(some))

    head, image, info, timing = "adsHeader", "imageAnnotation.imageInformation", "generalAnnotation.productInformation", "swathTiming"
    return [
        c(f"{head}.missionId").alias("mission_id"), c(f"{head}.polarisation").alias("polarisation"), c(f"{head}.mode").alias("mode"), c(f"{head}.swath").alias("swath"), c(f"{head}.startTime").alias("start_time"),
        c(f"{head}.absoluteOrbitNumber").alias("absolute_orbit"), c(f"{info}.pass").alias("pass"), c(f"{info}.platformHeading").alias("platform_heading_deg"), c(f"{info}.rangeSamplingRate").alias("range_sampling_rate_hz"),
        c(f"{image}.rangePixelSpacing").alias("range_pixel_spacing_m"), c(f"{image}.azimuthPixelSpacing").alias("azimuth_pixel_spacing_m"), c(f"{image}.incidenceAngleMidSwath").alias("incidence_mid_deg"),
        mean_at(F.array_min).alias("incidence_near_deg"), mean_at(F.array_max).alias("incidence_far_deg"), c(f"{timing}.linesPerBurst").alias("lines_per_burst"), c(f"{timing}.samplesPerBurst").alias("samples_per_burst"),
        F.coalesce(c(f"{timing}.burstList._count"), F.size(c(f"{timing}.burstList.burst"))).alias("n_bursts"),
    ]


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each annotation file: header, spacings, and the mean incidence at the nearest and farthest pixels of its grid."""
    raw = spark.read.format("xml").option("rowTag", "product").schema(_CONTENT).load(path)
    return raw.select(F.input_file_name().alias("source"), *_annotation(""))


def processor_version(xml: Column) -> Column:
    """The version of the first software called IPF, else of the first that has one; null without."""
    named = F.xpath(xml, F.lit("//*[name()='safe:software'][contains(translate(@name,'ipf','IPF'),'IPF')]/@version"))
    any_one = F.xpath(xml, F.lit("//*[name()='safe:software']/@version"))
    first = lambda a: F.get(F.filter(F.transform(a, lambda v: F.trim(v)), lambda v: v != ""), F.lit(0))
    return F.coalesce(first(named), first(any_one))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(source, ipf_version) of manifests, as written."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), processor_version(F.col("value")).alias("ipf_version"))


def read_burst_metadata(spark: SparkSession, path: str, subswath: str | None = None, polarization: str | None = None) -> DataFrame:
    """One row a file: the annotation of the first product of the swath and channel asked for, the swaths there are, and the processor's version.

    Files without such a product have no row.
    """
    content = _CONTENT.replace(" struct<", ":struct<").replace(", ", ",")
    kind = f"metadata struct<product:array<struct<_source_filename:string,swath:string,polarisation:string,content:struct<{content}>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value", F.from_xml("value", kind).alias("x"))
    fits = lambda q: (F.lit(subswath is None) | (F.upper(q["swath"]) == F.lit((subswath or "").upper()))) & (F.lit(polarization is None) | (F.upper(q["polarisation"]) == F.lit((polarization or "").upper())))
    entries = F.col("x.metadata.product")
    swaths = F.array_sort(F.array_distinct(F.filter(F.transform(entries, lambda q: F.upper(q["swath"])), lambda s: s.isNotNull())))
    rows = raw.select("source", processor_version(F.col("value")).alias("ipf_version"), swaths.alias("available_swaths"), F.get(F.filter(entries, fits), F.lit(0)).alias("q")).where("q.content is not null")
    return rows.select("source", F.col("q._source_filename").alias("source_filename"), "ipf_version", "available_swaths", *_annotation("q.content."))


def enriched(rows: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Records with spacings, incidences and version from annotations where these have them."""
    fields = ("range_pixel_spacing_m", "azimuth_pixel_spacing_m", "incidence_near_deg", "incidence_far_deg", "ipf_version")
    have = [f for f in fields if f in annotations.columns]
    one = annotations.groupBy(key).agg(*[F.first(f, ignorenulls=True).alias(f"_{f}") for f in have])
    out = rows.join(one, key, "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in have}).drop(*[f"_{f}" for f in have])
