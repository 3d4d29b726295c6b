"""Topics, JSON envelopes and radio frames, decoded by column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed values of the topic format, and the networks of prefixes unless given.
SUFFIXES = ("packets", "status", "neighbors", "neighbours")
PREFIXES = {"mesh": "main", "mesh-test": "test"}


def parse_topic(df: DataFrame, topic: str = "topic", prefixes: dict[str, str] = PREFIXES, test_regions: list[str] | None = None) -> DataFrame:
    """Adds region, observer, suffix and network, all null unless the topic is prefix/region/64-hex/suffix.

    Blanks around a part and its case don't matter. ``prefixes`` names the network of each accepted prefix; a topic of one of
    the ``test_regions`` is in the network "test" whatever its prefix.
    """
    p = F.split(F.col(topic), "/")
    prefix, region, observer, suffix = (f(F.trim(F.get(p, F.lit(k)))) for k, f in enumerate((F.lower, F.upper, F.upper, F.lower)))
    good = (F.size(p) == 4) & prefix.isin(*prefixes) & region.rlike("^[A-Z0-9]{2,8}$") & observer.rlike("^[0-9A-F]{64}$") & suffix.isin(*SUFFIXES)
    named = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])[prefix]
    network = F.when(region.isin(*(test_regions or [])), "test").otherwise(named)
    return df.withColumns({k: F.when(good, v) for k, v in {"region": region, "observer": observer, "suffix": suffix, "network": network}.items()})


def number_field(payload: Column, *names: str) -> Column:
    """The first of the fields that holds a finite number, given as a number or as text."""
    values = [F.get_json_object(payload, f"$.{n}").try_cast("double") for n in names]
    return F.coalesce(*[F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for v in values])


def _byte(frame: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(frame, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def decode_frame(df: DataFrame, raw: str = "raw_hex") -> DataFrame:
    """Adds route, payload_type, transport, hash_size, hop_count, path_hashes and packet_id; null for malformed frames.

    Byte 0: route in bits 0-1. Routes 0 and 3 carry four transport bytes. Then a length byte: hops in six bits, hash
    size less one in two (four is refused); the path; the payload, which must not be empty. packet_id is the SHA-256
    of byte 0 without its route bits and the payload, so that copies over other routes share it.
    """
    x = F.upper(F.col(raw))
    well = x.rlike("^([0-9A-F]{2})+$") & (F.length(x) >= 4)
    route = _byte(x, 0).bitwiseAND(F.lit(3))
    skip = F.when(route.isin(0, 3), 5).otherwise(1)
    length = _byte(x, skip)
    size, hops = F.shiftright(length, 6) + 1, length.bitwiseAND(F.lit(63))
    begin = skip + 1
    end = begin + size * hops
    good = well & (size < 4) & (F.length(x) / 2 > end)
    path = F.when(hops > 0, F.transform(F.sequence(F.lit(0), hops - 1), lambda i: F.substr(x, (begin + i * size) * 2 + 1, size * 2))).otherwise(F.array().cast("array<string>"))
    first = F.lpad(F.hex(_byte(x, 0).bitwiseAND(F.lit(0xFC))), 2, "0")
    made = {
        "route": route, "payload_type": F.shiftright(_byte(x, 0), 2).bitwiseAND(F.lit(15)), "transport": F.when(route.isin(0, 3), F.substr(x, F.lit(3), F.lit(8))),
        "hash_size": size, "hop_count": hops, "path_hashes": path, "packet_id": F.upper(F.sha2(F.unhex(F.concat(first, F.substr(x, end * 2 + 1, F.length(x)))), 256)),
    }
    return df.withColumns({k: F.when(good, v) for k, v in made.items()})


def status_fields(df: DataFrame, stats: str = "stats") -> DataFrame:
    """Adds battery_mv, uptime_secs, tx_secs, rx_secs, channel_use and air_use from a JSON record, each under any of its
    names; rows without any of them are kept, as raw_only, if they hold statistics of an owner's device, else left out."""
    s = F.col(stats)
    up = F.coalesce(number_field(s, "uptime_secs", "uptimeSecs"), F.floor(number_field(s, "uptime_ms", "uptimeMs") / 1000).cast("double"))
    fields = {
        "battery_mv": number_field(s, "battery_mv", "batteryMv"), "uptime_secs": up, "tx_secs": number_field(s, "tx_air_secs", "txAirSecs"), "rx_secs": number_field(s, "rx_air_secs", "rxAirSecs"),
        "channel_use": number_field(s, "channel_utilization", "channel_utilization_pct", "channel_util", "channelUtil", "channelUtilization"),
        "air_use": number_field(s, "air_util_tx", "air_util_tx_pct", "tx_air_util", "tx_air_utilization", "airUtilTx"),
    }
    found = df.withColumns(fields)
    none = F.lit(True)
    for name in fields:
        none = none & F.col(name).isNull()
    return found.withColumn("raw_only", none).where(~F.col("raw_only") | F.get_json_object(s, "$.mqtt").isNotNull())


def neighbour_list(df: DataFrame, body: str) -> DataFrame:
    """Adds neighbours: the array under ``nodes`` or ``neighbours`` as JSON texts, null if neither is an array."""
    either = F.coalesce(F.get_json_object(F.col(body), "$.nodes"), F.get_json_object(F.col(body), "$.neighbours"))
    return df.withColumn("neighbours", F.when(either.startswith("["), F.from_json(either, "array<string>")))


#: Payload types by their numbers.
PAYLOADS = {2: "direct message", 3: "acknowledgement", 4: "advert", 5: "channel message", 8: "path", 9: "trace"}


def payload_name(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PAYLOADS.items() for x in pair])
    return F.coalesce(names[kind], F.concat(F.lit("type "), kind.cast("string")))


def advert_is_verified(direction: Column, kind: Column, decoded: Column) -> Column:
    """False for a sent advert that couldn't be decoded: its fields don't prove where it came from."""
    return ~((direction == "tx") & (kind == 4) & ~decoded)


def status_is_own(observer: Column, claimed: Column) -> Column:
    """Whether a status names the topic's device, or none; another or a malformed id refuses it."""
    given = F.upper(F.trim(claimed))
    return claimed.isNull() | (given == "") | F.coalesce(given.rlike("^[0-9A-F]{64}$") & (given == F.upper(F.trim(observer))), F.lit(False))
