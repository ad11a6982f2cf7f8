"""Link rules: host and platform of a URL, refusal reasons, restricted IPv4 and IPv6 ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorframe.functions.whitespace import strip

# Platform domains, after lower-casing and dropping "www.".
PLATFORM_DOMAINS = {
    "instagram.com": "Instagram",
    "youtube.com": "YouTube",
    "youtu.be": "YouTube",
    "facebook.com": "Facebook",
    "fb.watch": "Facebook",
    "tiktok.com": "TikTok",
    "x.com": "X",
    "twitter.com": "X",
}

# IPv4 ranges that may not be fetched.
RESTRICTED_CIDRS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
]
INTERNAL_HOSTS = ["localhost", "127.0.0.1", "::1", "metadata.google.internal"]


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty when there is none."""
    server = F.regexp_replace(authority(url), r"^.*@", "")
    bare = F.when(server.startswith("["), F.regexp_extract(server, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(server, r":[^:]*$", ""))
    return F.regexp_replace(F.lower(strip(bare)), r"\.+$", "")


def normalise_domain(domain: Column) -> Column:
    return F.regexp_replace(strip(F.lower(domain)), r"^www\.", "")


def detect_platform(url: Column) -> Column:
    pairs = [F.lit(x) for kv in PLATFORM_DOMAINS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), normalise_domain(authority(url))), F.lit("Unknown"))


def match_expected_platform(url: Column, expected: Column) -> Column:
    """Only a link that may be fetched matches anything, ``Auto`` included."""
    return url_reason(url).isNull() & ((expected == "Auto") | (detect_platform(url) == expected))


def ipv4_number(host: Column) -> Column:
    """An IPv4 literal as BIGINT, NULL for anything else."""
    octets = F.transform(F.split(host, r"\."), lambda o: o.try_cast("bigint"))
    fine = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda o: o <= 255)
    return F.when(fine, F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o))


def cidr_bounds(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    low = 0
    for part in base.split("."):
        low = low * 256 + int(part)
    return low, low + (1 << (32 - int(bits))) - 1


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv6_groups(host: Column) -> Column:
    """The eight 16-bit groups of an IPv6 literal, NULL for anything else. A dotted IPv4 tail counts as two groups; a zone is left out."""

    def undotted(bare: Column) -> Column:
        tail = lambda n: F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535))))
        return F.when(bare.contains("."), F.lower(_let(ipv4_number(F.regexp_extract(bare, r"([0-9.]+)$", 1)), tail))).otherwise(bare)

    def split(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))

    def filled(halves: Column) -> Column:
        both = F.array(split(F.get(halves, F.lit(0))), split(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))))
        zeros = lambda b: F.concat(b[0], F.array_repeat(F.lit("0"), F.lit(8) - F.size(b[0]) - F.size(b[1])), b[1])
        return F.when(F.size(halves) == 2, _let(both, lambda b: F.when(F.size(b[0]) + F.size(b[1]) <= 7, zeros(b)))).when(F.size(halves) == 1, split(halves[0]))

    def numbers(whole: Column) -> Column:
        fine = (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fine, F.transform(whole, lambda g: F.conv(g, 16, 10).cast("int")))

    bare = F.regexp_replace(F.lower(host), "%.*$", "")
    return F.when(host.contains(":"), _let(bare, lambda x: _let(undotted(x), lambda t: _let(F.split(t, "::", -1), lambda h: _let(filled(h), numbers)))))


def _restricted_ipv4(number: Column) -> Column:
    out = F
    for cidr in RESTRICTED_CIDRS:
        out = out.when(number.between(*cidr_bounds(cidr)), cidr)
    return out


def restricted_range(host: Column) -> Column:
    """The first restricted range that holds the IPv4 or IPv6 literal, NULL when none does. A mapped IPv4 address counts as that address."""

    def of_groups(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        low = (at(0) == 0) & (at(1) == 0) & (at(2) == 0) & (at(3) == 0) & (at(4) == 0)
        last = at(6).cast("bigint") * 65536 + at(7)
        return (
            F.when(low & (at(5) == 65535), _let(last, _restricted_ipv4))
            .when(low & (at(5) == 0) & (last == 0), "::/128")
            .when(low & (at(5) == 0) & (last == 1), "::1/128")
            .when(at(0).bitwiseAND(F.lit(0xFE00)) == 0xFC00, "fc00::/7")
            .when(at(0).bitwiseAND(F.lit(0xFFC0)) == 0xFE80, "fe80::/10")
            .when(at(0).bitwiseAND(F.lit(0xFF00)) == 0xFF00, "ff00::/8")
            .when((at(0) == 0x2001) & ((at(1) < 0x0200) | (at(1) == 0x0DB8)) | (at(0) == 0x2002) | (at(0) == 0x3FFF) & (at(1) < 0x1000), "reserved")
            .when((at(0).bitwiseAND(F.lit(0xE000)) != 0x2000) & (at(0).bitwiseAND(F.lit(0xFFC0)) != 0xFEC0), "reserved")
        )

    return F.when(host.contains(":"), _let(ipv6_groups(host), of_groups)).otherwise(_let(ipv4_number(host), _restricted_ipv4))


def _address(host: Column) -> Column:
    """struct(family, hi, lo) of an IPv4 or IPv6 literal, leading bits first; NULL for anything else. A mapped IPv4 address is that address."""
    fields = "struct<family:int,hi:bigint,lo:bigint>"

    def of(family: int, hi: Column, lo: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo")).cast(fields)

    def of_groups(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i)).cast("bigint")
        half = lambda i: F.shiftleft(at(i), 48).bitwiseOR(F.shiftleft(at(i + 1), 32)).bitwiseOR(F.shiftleft(at(i + 2), 16)).bitwiseOR(at(i + 3))
        mapped = (half(0) == 0) & (at(4) == 0) & (at(5) == 65535)
        return F.when(g.isNotNull(), F.when(mapped, of(4, F.shiftleft(at(6) * 65536 + at(7), 32), F.lit(0).cast("bigint"))).otherwise(of(6, half(0), half(4))))

    def of_number(n: Column) -> Column:
        return F.when(n.isNotNull(), of(4, F.shiftleft(n, 32), F.lit(0).cast("bigint")))

    return F.when(host.contains(":"), _let(ipv6_groups(host), of_groups)).otherwise(_let(ipv4_number(host), of_number))


def _lead(address: str, bits: str) -> Column:
    """The first ``bits`` of an address as struct(hi, lo); the others are zero."""
    hi = f"IF({bits} = 0, 0L, IF({bits} >= 64, {address}.hi, shiftleft(shiftrightunsigned({address}.hi, 64 - {bits}), 64 - {bits})))"
    lo = f"IF({bits} <= 64, 0L, IF({bits} >= 128, {address}.lo, shiftleft(shiftrightunsigned({address}.lo, 128 - {bits}), 128 - {bits})))"
    return F.expr(f"named_struct('hi', {hi}, 'lo', {lo})")


def restricted_ip_join(ips: DataFrame, cidrs: DataFrame) -> DataFrame:
    """``ips`` (host) that lie in any range of a CIDR table (base, bits) of IPv4 and IPv6 ranges, by equality on (family, length, leading bits).

    An address is repeated once per prefix length of its family, at most 129 times, so there is no range or nested-loop join.
    """
    ranges = cidrs.select(F.col("bits").cast("int").alias("bits"), _address(F.col("base")).alias("_r")).where("_r IS NOT NULL")
    ranges = ranges.select(F.col("_r.family").alias("family"), "bits", _lead("_r", "bits").alias("lead")).distinct()
    lengths = ranges.groupBy("family").agg(F.collect_set("bits").alias("_bits"))  # two rows
    a = ips.withColumn("_a", _address(F.col("host"))).where("_a IS NOT NULL").withColumn("family", F.col("_a.family"))
    a = a.join(F.broadcast(lengths), "family").withColumn("bits", F.explode("_bits")).withColumn("lead", _lead("_a", "bits"))
    # A range inside a wider one adds nothing; without it an address meets one range at most, and equal rows stay apart.
    wider = ranges.join(F.broadcast(lengths), "family").withColumn("_b", F.explode("_bits")).where("_b < bits").withColumn("_l", _lead("lead", "_b"))
    inside = wider.join(ranges.withColumnsRenamed({"bits": "_b", "lead": "_l"}), ["family", "_b", "_l"], "left_semi").select("family", "bits", "lead")
    key = ["family", "bits", "lead"]
    return a.join(ranges.join(inside, key, "left_anti"), key).select(*ips.columns)


def url_reason(url: Column) -> Column:
    """The first rule a link breaks, NULL when it may be fetched."""

    def of_parts(x: Column) -> Column:
        u, server, host, port = x["u"], x["server"], x["host"], x["port"]
        scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
        return (
            F.when(u.isNull() | (u == ""), "empty")
            .when(u.rlike(r"[\\\x00-\x20\x7f]"), "forbidden_character")
            .when(F.regexp_replace(server, r"^.*@", "").startswith("[") & ipv6_groups(host).isNull(), "malformed")
            .when(~scheme.isin("http", "https"), "protocol")
            .when(server.contains("@"), "credentials")
            .when(host == "", "missing_host")
            .when(host.isin(INTERNAL_HOSTS) | host.endswith(".localhost") | host.endswith(".internal"), "internal_host")
            .when((port != "") & ~port.rlike(r"^\d{1,5}$"), "invalid_port")
            .when((port != "") & (port.try_cast("int") > 65535), "invalid_port")
            .when((port != "") & ~port.try_cast("int").isin(80, 443), "port")
            .when(restricted_range(host).isNotNull(), "restricted_address")
        )

    u = strip(url)
    port = F.regexp_extract(F.regexp_replace(authority(u), r"^.*@", ""), r":([^:\]]*)$", 1)
    return _let(F.struct(u.alias("u"), authority(u).alias("server"), host_of(u).alias("host"), port.alias("port")), of_parts)
