"""Column types of the tables that operators exchange."""

FOUND = "track_id string, file_name string, gpx_index bigint, point_type string, raw_lat string, raw_lon string, raw_ele string, raw_time string, extensions string"
POINTS = "track_id string, gpx_index bigint, point_type string, lat double, lon double, ele double, time_raw string, extensions string"
POINT_TYPES = ("wpt", "rtept", "trkpt")
KINDS = ("missing", "unparsable", "duplicate", "backtracking")
SCHEMA_VERSION = "2.0.0"
