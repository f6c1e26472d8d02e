"""URL hosts and the address class they belong to."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwarden import domains as d
from siftwarden.functions.regex import java_pattern, let, spans

URL = java_pattern(d.URL, ignore_case=True)
_AUTHORITY = r"^[a-zA-Z]+://([^/?#]*)"
_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
_IPV6 = r"^(?=.*:)(?!.*:::)(?!.*::.*::)(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}$"


def url_spans(text: str) -> Column:
    """All http(s) URLs in a text column."""
    return spans(text, URL, f"{text} RLIKE '(?i)https?://'")


def url_host(url: Column) -> Column:
    """Lower-case host of an http(s) URL without user info, port and final dots."""
    netloc = F.regexp_extract(url, _AUTHORITY, 1)
    host = F.regexp_replace(netloc, r"^.*@", "")
    bracketed = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_replace(host, r":.*$", "")
    return F.regexp_replace(
        F.lower(F.when(host.startswith("["), bracketed).otherwise(plain)), r"\.+$", ""
    )


def _ipv4_number(host: Column) -> Column:
    return F.aggregate(
        F.split(host, r"\."), F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o.cast("bigint")
    )


def _ipv4_class(host: Column) -> Column:
    def classify(number: Column) -> Column:
        chain = F.when(F.lit(False), F.lit("public"))
        for low, high, label in d.IPV4_BLOCKS:
            chain = chain.when(
                number.between(int(ipaddress.ip_address(low)), int(ipaddress.ip_address(high))),
                label,
            )
        return chain.otherwise("public")

    return let(_ipv4_number(host), classify)


def _ipv6_class(host: Column) -> Column:
    lead = F.conv(F.coalesce(F.nullif(F.split_part(host, F.lit(":"), F.lit(1)), F.lit("")), F.lit("0")), 16, 10).cast("int")
    second = F.conv(F.coalesce(F.nullif(F.split_part(host, F.lit(":"), F.lit(2)), F.lit("")), F.lit("0")), 16, 10).cast("int")
    return (
        F.when(host == "::1", "loopback")
        .when(lead.between(0xFE80, 0xFEBF), "link_local")
        .when(lead.between(0xFC00, 0xFDFF), "private")
        .when((lead == 0x2001) & ((second < 0x0200) | (second == 0x0DB8)), "private")
        .when((lead < 0x2000) | lead.between(0x4000, 0xFE7F), "reserved")
        .otherwise("public")
    )


def host_class(host: Column) -> Column:
    """metadata, localhost, private, loopback, link_local, reserved, public or name."""
    return (
        F.when(host == d.METADATA_HOST, "metadata")
        .when(host == "localhost", "localhost")
        .when(host.rlike(_IPV4), _ipv4_class(host))
        .when(host.rlike(_IPV6) & (host.contains("::") | (F.size(F.split(host, ":")) == 8)), _ipv6_class(host))
        .otherwise("name")
    )


def is_internal(host: Column) -> Column:
    return ~host_class(host).isin("public", "name")
