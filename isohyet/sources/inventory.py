"""Listings: capability files, data years, what is still to fetch, feature collections, counts, scene searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.bands import BANDS, FIRST_YEAR, MOST_CLOUD, in_season, of_decade
from isohyet.functions.geo import bind, oriented
from isohyet.operators.features import shape_of, tag_kind
from isohyet.sources.station_headers import first_lines


def to_fetch(listing: DataFrame, local: DataFrame, counties: list[str] | None = None, qc_version: int | None = None) -> DataFrame:
    """Listed files (path, size, county, qc) without a local copy of that path and size, of some counties or one qc version only; capability files have none (null) and always count."""
    wanted = listing if counties is None else listing.where(F.col("county").isin(counties))
    if qc_version is not None:
        wanted = wanted.where(F.col("qc").isNull() | (F.col("qc") == qc_version))
    return wanted.join(local.select("path", "size"), ["path", "size"], "left_anti").orderBy("path")


def data_years(files: DataFrame) -> DataFrame:
    """(station, year): the distinct years that the names of station files tell."""
    return files.select("station", F.regexp_extract("path", r"_([0-9]{4})\.csv$", 1).alias("y")).where("y <> ''").select("station", F.col("y").cast("int").alias("year")).distinct()


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _global(lines: str, key: str, nth: int) -> F.Column:
    """The nth value of the last global of that name, as text; null where there is none."""
    of = F.filter(lines, lambda x: x.startswith(f"{key},G,"))
    fields = F.from_csv(F.try_element_at(of, F.lit(-1)), ", ".join(f"f{i} string" for i in range(6)))
    return fields[f"f{nth + 2}"]


def capability(spark: SparkSession, path: str) -> DataFrame:
    """parse_capability() of the files at path."""
    return parse_capability(_whole(spark, path))


def parse_capability(files: DataFrame) -> DataFrame:
    """(path, src_id, name, county, lat, lon, height_m, valid_from, valid_to, version, rows) of capability files (path, value).

    rows: array of (id, id_type, met_domain_name, first_year, last_year), fields quoted as in CSV. Coordinates stay text for
    their decimal places.
    """
    files = files.select("path", F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    start, end = F.array_position("lines", "data"), F.array_position("lines", "end data")
    fields = "id string, id_type string, met_domain_name string, first_year string, last_year string"
    year = lambda c: F.floor(c.try_cast("double")).cast("int")
    row = lambda r: F.struct(r["id"].alias("id"), r["id_type"].alias("id_type"), r["met_domain_name"].alias("met_domain_name"), year(r["first_year"]).alias("first_year"), year(r["last_year"]).alias("last_year"))
    rows = F.transform(F.slice("lines", start + 2, F.greatest(end - start - 2, F.lit(0))), lambda line: bind(F.from_csv(line, fields), row))
    return files.select(
        "path", _global("lines", "src_id", 0).alias("src_id"), _global("lines", "observation_station", 0).alias("name"), _global("lines", "historic_county_name", 0).alias("county"),
        _global("lines", "location", 0).alias("lat"), _global("lines", "location", 1).alias("lon"), _global("lines", "height", 0).try_cast("double").alias("height_m"),
        _global("lines", "date_valid", 0).alias("valid_from"), _global("lines", "date_valid", 1).alias("valid_to"), _global("lines", "collection_version_number", 0).alias("version"), rows.alias("rows"),
    )


#: Lines in which an annual file's header is sought.
HEADER_LINES = 40


def annual_headers(spark: SparkSession, path: str) -> DataFrame:
    """parse_annual_headers() of the files under path, which are read as far as their first lines."""
    return parse_annual_headers(first_lines(spark, path, HEADER_LINES).select("path", "value"))


def parse_annual_headers(files: DataFrame) -> DataFrame:
    """(path, src_id, lat, lon, height_m) from the first lines of annual files (path, value), up to 'data'; null where not given."""
    first = F.slice(F.split(F.regexp_replace("value", "\r", ""), "\n", HEADER_LINES + 1), 1, HEADER_LINES)
    heads = files.select("path", first.alias("lines")).withColumn("end", F.array_position("lines", "data"))
    heads = heads.withColumn("lines", F.when(F.col("end") > 0, F.expr("slice(lines, 1, cast(end - 1 AS int))")).otherwise(F.col("lines")))
    number = lambda key, nth: _global("lines", key, nth).try_cast("double")
    return heads.select("path", _global("lines", "midas_station_id", 0).alias("src_id"), number("location", 0).alias("lat"), number("location", 1).alias("lon"), number("height", 0).alias("height_m"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, kind, coordinates JSON) of the features of GeoJSON files."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), "f.geometry.coordinates")


def _places(positions: F.Column) -> F.Column:
    """Positions (longitude, latitude, more) as places."""
    return F.transform(positions, lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon")))


def geometry(rows: DataFrame, kind: str = "kind", coordinates: str = "coordinates") -> DataFrame:
    """rows of features() with shape and rings instead of kind and coordinates: points, lines and polygons, single or many.

    A polygon's first ring is its outer one, the others are holes, whichever way they run; all parts of a feature are rings of one row. Many points
    or lines are rings of one row too, each of its own. What isn't such a geometry, or can't be read, has no shape and no rings.
    """
    position = "array<double>"
    read = lambda depth: F.from_json(coordinates, "array<" * depth + position + ">" * depth)
    of = lambda name: F.col(kind) == name
    polygons = F.when(of("MultiPolygon"), read(3)).when(of("Polygon"), F.array(read(2)))
    turned = F.flatten(F.transform(polygons, lambda p: F.transform(p, lambda ring, i: oriented(_places(ring), i == 0))))
    lines = F.transform(F.when(of("MultiLineString"), read(2)).when(of("LineString"), F.array(read(1))), _places)
    points = F.transform(F.when(of("MultiPoint"), read(1)).when(of("Point"), F.array(read(0))), lambda p: _places(F.array(p)))
    shape = F.when(F.col("rings").isNotNull(), F.when(F.col(kind).endswith("Polygon"), "polygon").when(F.col(kind).endswith("LineString"), "line").otherwise("point"))
    return rows.withColumn("rings", F.coalesce(turned, lines, points)).withColumn("shape", shape).drop(kind, coordinates)


def overpass(spark: SparkSession, path: str) -> DataFrame:
    """(feature, kind, shape, points) of the elements of Overpass pages that are of a kind that counts: nodes and ways; relations have relation_members()."""
    e = _elements(spark, path).where(F.col("type").isin("node", "way"))
    points = F.when(F.col("type") == "node", F.array(F.struct("lat", "lon"))).otherwise(F.coalesce("geometry", F.array().cast("array<struct<lat:double,lon:double>>")))
    shaped = e.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("feature"), tag_kind(F.col("tags")).alias("kind"), "type", points.alias("points"))
    return shaped.where("kind is not null").withColumn("shape", shape_of(F.col("type"), F.col("points"))).where("shape is not null").select("feature", "kind", "shape", "points")


def relation_members(spark: SparkSession, path: str) -> DataFrame:
    """(feature, kind, way, points): the member ways of relations that count, as features.assemble() takes them."""
    r = _elements(spark, path).where("type = 'relation'").select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("feature"), tag_kind(F.col("tags")).alias("kind"), F.posexplode("members").alias("way", "m"))
    return r.where("kind is not null and m.type = 'way'").select("feature", "kind", "way", F.col("m.geometry").alias("points"))


def _elements(spark: SparkSession, path: str) -> DataFrame:
    place = "array<struct<lat: double, lon: double>>"
    schema = f"elements array<struct<type: string, id: bigint, lat: double, lon: double, tags: map<string,string>, geometry: {place}, members: array<struct<type: string, geometry: {place}>>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("elements"))


def esri_pages(spark: SparkSession, path: str) -> DataFrame:
    """(properties, rings): attributes and all rings of the features of Esri JSON pages, longitude before latitude there.

    Outer rings run with the clock there and holes against it: all are turned.
    """
    schema = "features array<struct<attributes: map<string,string>, geometry: struct<rings: array<array<array<double>>>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    rings = F.transform("f.geometry.rings", lambda ring: F.reverse(_places(ring)))
    return f.select(F.col("f.attributes").alias("properties"), rings.alias("rings"))


def boundary_code(properties: str = "properties") -> F.Column:
    """The first property whose name ends in 'cdo', else in 'cd', by name."""
    entries = F.array_sort(F.map_entries(properties))
    pick = lambda end: F.get(F.filter(entries, lambda e: F.lower(e["key"]).endswith(end) & e["value"].isNotNull()), F.lit(0))["value"]
    return F.coalesce(pick("cdo"), pick("cd"))


def counts(rows: DataFrame, code: str = "GEOGRAPHY_CODE", value: str = "OBS_VALUE") -> DataFrame:
    """(code, n): blank values skipped, of equal codes the last row."""
    placed = rows.withColumn("__at", F.monotonically_increasing_id()).where(F.trim(value) != "")
    return placed.groupBy(F.col(code).alias("code")).agg(F.max_by(F.col(value).try_cast("double"), "__at").alias("n"))


def last_by_id(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key, the last in order: later listings of a station win."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("__key")).agg(last.alias("r")).select("r.*")


def search_scenes(scenes: DataFrame, cloud: float = MOST_CLOUD) -> DataFrame:
    """Scenes (scene_id, day, platform, cloud_cover, assets) of the growing season from the designated platforms of their decade.

    Their cloud cover is known to be under a limit, all bands are there; clearest first.
    """
    ok = in_season(F.col("day")) & (F.year("day") >= FIRST_YEAR) & (F.col("cloud_cover") < cloud) & of_decade(F.col("platform"), F.col("day"))
    bands = F.size(F.array_intersect("assets", F.array(*map(F.lit, BANDS)))) == len(BANDS)
    return scenes.where(ok & bands).orderBy("cloud_cover", "scene_id")


def sites(layers: dict[str, DataFrame]) -> DataFrame:
    """(ref_code, name, hyperlink, designation) of the features of several layers, by designation; missing properties are empty texts.

    Layers follow each other: a site in two of them has two rows.
    """
    text = lambda key: F.coalesce(F.try_element_at("properties", F.lit(key)), F.lit(""))
    rows = [f.select(text("ref_code").alias("ref_code"), text("name").alias("name"), F.trim(text("hyperlink")).alias("hyperlink"), F.lit(d).alias("designation")) for d, f in layers.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def with_land_area(stations: DataFrame, layer: DataFrame, ring_m: int = 10_000, epoch: int = 2020) -> DataFrame:
    """stations (src_id) with land_m2: that of their ring of one size and epoch in the layer (src_id, ring_m, epoch, land_m2), 0 if there is none."""
    one = layer.where((F.col("ring_m") == ring_m) & (F.col("epoch") == epoch)).select("src_id", "land_m2")
    return stations.join(one, "src_id", "left").withColumn("land_m2", F.coalesce("land_m2", F.lit(0.0)))


def build_units(boundaries: DataFrame, counts_: DataFrame, translate: DataFrame | None = None) -> DataFrame:
    """boundaries (code, ...) with population, null where no count has the code (counts: code, n); codes go through translate (code, to) first, as they are where it has none."""
    rows = boundaries
    if translate is not None:
        rows = rows.join(translate.select(F.col("code").alias("__from"), F.col("to").alias("__to")), F.col("code") == F.col("__from"), "left")
        rows = rows.withColumn("code", F.coalesce("__to", "code")).drop("__from", "__to")
    return rows.join(counts_.select(F.col("code").alias("__code"), F.col("n").alias("population")), F.col("code") == F.col("__code"), "left").drop("__code")


def pilot(stations: DataFrame, key: str, n: int) -> DataFrame:
    """The first n stations by key: the feature of a pilot run."""
    return stations.orderBy(key).limit(n)
