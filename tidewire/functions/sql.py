"""The library's functions for queries in SQL text: scalar and table functions in SQL, and a table function over wire frames.

``register`` makes them known to a session, for as long as it lasts. Each equals the Column form of the same name.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Name, parameters, what comes back, and the body.
SCALARS = {
    "tw_clamp": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN x < low THEN low WHEN x > high THEN high ELSE x END"),
    "tw_km": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "2 * 6371.0D * asin(sqrt(tw_clamp(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2), 0D, 1D)))",
    ),
    "tw_flat_km": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, factor DOUBLE DEFAULT 111.32D", "DOUBLE",
        "sqrt(power(lat2 - lat1, 2) + power((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), 2)) * factor",
    ),
    "tw_time_bin": (
        "t TIMESTAMP_NTZ, minutes INT", "TIMESTAMP_NTZ",
        "timestampadd(MINUTE, CAST(floor(timestampdiff(SECOND, TIMESTAMP_NTZ'2000-01-01 00:00:00', t) / (minutes * 60)) * minutes AS INT), TIMESTAMP_NTZ'2000-01-01 00:00:00')",
    ),
    "tw_has_position": ("lat DOUBLE, lon DOUBLE, box DOUBLE DEFAULT 0D", "BOOLEAN", "lat IS NOT NULL AND lon IS NOT NULL AND NOT (abs(lat) <= box AND abs(lon) <= box)"),
    "tw_link_key": ("a STRING, b STRING", "STRING", "CASE WHEN a < b THEN concat(a, ':', b) ELSE concat(b, ':', a) END"),
    "tw_free_space_db": ("km DOUBLE, mhz DOUBLE DEFAULT 868D", "DOUBLE", "20 * log10(4 * pi() * km * 1000 / (299792458.0D / (mhz * 1e6D)))"),
}
TABLES = {
    # the hops of a path that have the right length, as far as its count goes, without the receiver's own at the end
    "tw_path": (
        "hashes ARRAY<STRING>, hops INT, size INT, receiver STRING", "pos INT, hash STRING",
        """SELECT CAST(h.pos AS INT) + 1, h.col FROM (SELECT transform(filter(hashes, (x, i) -> length(x) = size * 2 AND (hops IS NULL OR i < greatest(hops, 0))), x -> upper(x)) AS valid, receiver AS rx) v,
           LATERAL posexplode(CASE WHEN size(valid) > 1 AND startswith(coalesce(rx, ''), element_at(valid, -1)) THEN slice(valid, 1, size(valid) - 1) ELSE valid END) h""",
    ),
}


class _Frame:
    """One row for a well-formed frame, none for another; see sources.wire.decode_frame."""

    def eval(self, raw: str):
        try:
            frame = bytes.fromhex(raw or "")
        except ValueError:
            return
        if len(frame) < 2 or len(raw) != 2 * len(frame):
            return
        route = frame[0] & 3
        skip = 5 if route in (0, 3) else 1
        if len(frame) <= skip:
            return
        size, hops = (frame[skip] >> 6) + 1, frame[skip] & 63
        end = skip + 1 + size * hops
        if size > 3 or len(frame) <= end:
            return
        path = [frame[k : k + size].hex().upper() for k in range(skip + 1, end, size)]
        yield route, frame[0] >> 2 & 15, frame[1:5].hex().upper() if skip == 5 else None, size, hops, path


def register(spark: SparkSession) -> None:
    """Make all functions known to the session; doing so again changes nothing."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, kind, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({kind}) RETURN {body}")
    frame = udtf(_Frame, returnType="route int, payload_type int, transport string, hash_size int, hop_count int, path_hashes array<string>")
    spark.udtf.register("tw_frame", frame)
