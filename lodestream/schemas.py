"""Schemas of the engine's relations; the SQL guard takes its allow-list from here."""

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType()}


def _of(columns: str) -> T.StructType:
    """A schema from 'name kind, name kind'."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(","))])


MANIFEST = _of("doc_id string, title string, publisher string, doc_type string, jurisdiction string, cities string, language string, published_on string, effective_from string, superseded_by string, is_current string, source_url string, retrieved_on string, sha256 string")
BLOCK = _of("doc_id string, page int, block_no int, kind string, level int, text string, size double, bold boolean, ocr boolean")
CHUNK = _of("chunk_id string, doc_id string, heading_path string, text string, embed_text string, page_start int, page_end int, parent_id string, token_count int")
PARENT = _of("parent_id string, doc_id string, heading_path string, text string, token_count int")
BULLETIN = _of("date date, city string, aqi int, aqi_category string, prominent_pollutant string, stations_reporting int, stations_total int")
CITY_DAILY_TABLE = _of("city string, date date, aqi int, aqi_category string, prominent_pollutant string, stations_reporting int, stations_total int")
CATEGORIES = _of("aqi_category string, severity_rank int, aqi_min int, aqi_max int")
STATIONS = _of("station_id string, name string, city string, state string, latitude double, longitude double, agency string")
READINGS = _of("station_id string, date date, pm25 double, pm10 double, no2 double, so2 double, co double, o3 double, aqi int, aqi_category string, coverage_pct double")
CITY_VIEW = _of("city string, date date, pm25 double, pm10 double, max_station_aqi int, n_stations long")

#: Relations that ad-hoc SQL may read.
RELATIONS = {"city_aqi_daily": CITY_DAILY_TABLE, "aqi_categories": CATEGORIES, "stations": STATIONS, "readings_daily": READINGS, "city_daily": CITY_VIEW}

# The bands of the index, as (category, rank, lowest, highest).
BANDS = (("Good", 1, 0, 50), ("Satisfactory", 2, 51, 100), ("Moderate", 3, 101, 200), ("Poor", 4, 201, 300), ("Very Poor", 5, 301, 400), ("Severe", 6, 401, 500))
#: Rows of the bulletins as they arrive.
ARRIVING = _of("row_id long, board string, city string, date date, aqi int, aqi_category string, ingested_at timestamp_ntz")
