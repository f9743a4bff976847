"""Scalar functions on addresses, hosts and accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import let

IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"
#: Tokens that mean the machine itself.
LOCAL = ("", "-", "::1", "127.0.0.1", "localhost", "::ffff:127.0.0.1")
#: Reserved IPv4 blocks (network, prefix length, globally routable, private).
BLOCKS = (
    ("0.0.0.0", 8, False, True), ("10.0.0.0", 8, False, True), ("100.64.0.0", 10, False, False), ("127.0.0.0", 8, False, True),
    ("169.254.0.0", 16, False, True), ("172.16.0.0", 12, False, True), ("192.0.0.0", 24, False, True), ("192.0.2.0", 24, False, True),
    ("192.168.0.0", 16, False, True), ("198.18.0.0", 15, False, True), ("198.51.100.0", 24, False, True), ("203.0.113.0", 24, False, True),
    ("224.0.0.0", 4, True, False), ("240.0.0.0", 4, False, True),
)


def is_ipv4(text: Column) -> Column:
    """Four numbers up to 255 without leading zeros."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.coalesce(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.lit(False))


_OCTETS = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _groups(text: Column) -> Column:
    """Text whose last part, if that is an IPv4 address behind a colon, is two groups of hexadecimal digits."""

    def hexed(v: Column) -> Column:
        return F.concat(F.regexp_extract(text, r"^(.*:)[^:]*$", 1), F.lower(F.hex(F.shiftright(v, 16))), F.lit(":"), F.lower(F.hex(v % 65536)))

    return F.when(text.rlike(rf":{_OCTETS}$"), let(ipv4_long(F.substring_index(text, ":", -1)), hexed)).otherwise(text)


def _is_groups(text: Column) -> Column:
    whole = text.rlike(r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    short = text.rlike(r"^(?=.*::)(?!.*::.*::)([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?::([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?$") & (F.size(F.split(text, ":")) <= 8 + text.rlike("^::|::$").cast("int"))
    return F.coalesce(whole | short, F.lit(False))


def is_ipv6(text: Column) -> Column:
    """Groups of hexadecimal digits, one run of which ``::`` may stand for; the last two may be an IPv4 address."""
    return F.coalesce(let(_groups(text), _is_groups), F.lit(False))


def ip_hex(text: Column) -> Column:
    """The 128 bits of an address as 32 lower-case hexadecimal digits, however it is spelt; null for what is none. An IPv4
    address has those of its mapped form (``::ffff:a.b.c.d``)."""

    def expand(flat: Column) -> Column:
        side = lambda part: F.array_join(F.transform(F.filter(F.split(part, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0")), "")
        ends = F.struct(side(F.substring_index(flat, "::", 1)).alias("a"), F.when(flat.contains("::"), side(F.substring_index(flat, "::", -1))).otherwise("").alias("b"))
        return F.when(_is_groups(flat), let(ends, lambda e: F.concat(e["a"], F.repeat(F.lit("0"), 32 - F.length(e["a"]) - F.length(e["b"])), e["b"])))

    mapped = let(ipv4_long(text), lambda v: F.concat(F.lit(MAPPED), F.lpad(F.lower(F.hex(v)), 8, "0")))
    return F.coalesce(mapped, let(_groups(text), expand))


#: The first 96 bits of IPv4 addresses.
MAPPED = "0" * 20 + "ffff"


def ip_key(text: Column) -> Column:
    """``ip_hex`` as 16 bytes, which order and join as addresses do."""
    return F.unhex(ip_hex(text))


def _embedded(digits: Column) -> Column:
    """The IPv4 number within 32 hexadecimal digits, else null."""
    return F.when(digits.startswith(MAPPED), F.conv(F.substring(digits, 25, 8), 16, 10).cast("long"))


def is_ip(text: Column) -> Column:
    return is_ipv4(text) | is_ipv6(text)


def ipv4_long(text: Column) -> Column:
    """An IPv4 address as a number, else null."""
    return F.when(is_ipv4(text), F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda total, x: total * 256 + x.try_cast("long")))


def _number(block: str) -> int:
    out = 0
    for x in block.split("."):
        out = out * 256 + int(x)
    return out


def _in(value: Column, wanted: int) -> Column:
    """Whether an address number lies in a block whose flag number ``wanted`` is set the telling way."""
    hit = F.lit(False)
    for net, bits, routable, private in BLOCKS:
        if (private if wanted else not routable):
            hit = hit | value.between(_number(net), _number(net) + (1 << (32 - bits)) - 1)
    return hit


def is_public_ip(text: Column) -> Column:
    """A globally routable address; names and shared (100.64/10) space are not. A mapped address is its IPv4 address."""
    return F.coalesce(let(ip_hex(text), lambda h: F.coalesce(let(_embedded(h), lambda v: ~_in(v, 0)), ~h.rlike(rf"{_LOCAL6}|^0064ff9b0001"))), F.lit(False))


#: Digits that private, loopback, link-local and documentation addresses begin with.
_LOCAL6 = "^0{31}[01]$|^fe[89ab]|^f[cd]|^20010db8|^0100000000000000"


def is_private_ip(text: Column) -> Column:
    """A private, loopback, link-local or documentation address. A mapped address is its IPv4 address."""
    return F.coalesce(let(ip_hex(text), is_private_hex), F.lit(False))


def is_private_hex(digits: Column) -> Column:
    """The same of ``ip_hex`` of an address."""
    return F.coalesce(let(_embedded(digits), lambda v: _in(v, 1)), digits.rlike(_LOCAL6))


def ip_scope(text: Column) -> Column:
    """loopback, multicast, private or public; empty for what is no address."""
    low = F.lower(text)
    return (
        F.when(~is_ip(text), "")
        .when(text.startswith("127.") | (low == "::1"), "loopback")
        .when(ipv4_long(text).between(_number("224.0.0.0"), _number("239.255.255.255")) | low.startswith("ff"), "multicast")
        .when(is_private_ip(text), "private")
        .otherwise("public")
    )


def norm_ip(token: Column) -> Column:
    """A token without a mapped-address prefix and, after an IPv4 address, without a port."""
    bare = F.regexp_replace(F.trim(token), r"(?i)^::ffff:", "")
    return F.regexp_replace(bare, r"^([^:]*\.[^:]*\.[^:]*\.[^:.]*):\d+$", "$1")


def _remote(token: Column) -> Column:
    return F.when(~token.isin(*LOCAL), token)


def extract_src(remote: Column) -> Column:
    """Address or workstation of ``ws (ip)`` or ``ip:port``; null when local."""
    pattern = r"^(.*?)\s*\((.*)\)\s*$"

    def read(raw: Column) -> Column:
        inner = F.coalesce(let(norm_ip(F.regexp_extract(raw, pattern, 2)), _remote), let(F.trim(F.regexp_extract(raw, pattern, 1)), _remote))
        return F.when((raw == "") | (raw == "-:-"), None).when(raw.rlike(pattern), inner).otherwise(let(norm_ip(raw), _remote))

    return let(F.trim(F.coalesce(remote, F.lit(""))), read)


def clean_user(user: Column) -> Column:
    """``DOMAIN\\user``: domain cut to its first label and upper-cased, name lower-cased; ``-`` is no domain."""

    def full(parts: Column) -> Column:
        dom, name = parts["dom"], parts["name"]
        return F.when(name.isin("", "-"), "").when(dom.isin("", "-"), name).otherwise(F.concat(dom, F.lit("\\"), name))

    def clean(u: Column) -> Column:
        dom = F.upper(F.trim(F.substring_index(F.substring_index(u, "\\", 1), ".", 1)))
        name = F.lower(F.regexp_replace(F.trim(F.regexp_extract(u, r"^[^\\]*\\(.*)$", 1)), r"^\\+|\\+$", ""))
        parts = F.struct(dom.alias("dom"), name.alias("name"))
        return F.when(u.isin("-", "-\\-", ""), "").when(u.contains("\\"), let(parts, full)).otherwise(F.lower(u))

    return let(F.regexp_replace(F.trim(F.coalesce(user, F.lit(""))), r"^\\+", ""), clean)


def short_user(user: Column) -> Column:
    """The account without its domain, lower-cased."""
    return F.lower(F.trim(F.substring_index(F.coalesce(user, F.lit("")), "\\", -1)))


def spn_host(spn: Column) -> Column:
    """Host of a service principal name, else empty."""
    s = F.trim(F.coalesce(spn, F.lit("")))
    s = F.when(s.contains("/"), F.regexp_replace(s, r"^[^/]*/", "")).otherwise(s)
    s = F.trim(F.regexp_replace(s, r"[/:@].*$", ""))
    return F.when(F.lower(s) == "krbtgt", "").otherwise(s)


def remote_src(token: Column) -> Column:
    """A remote address or host; empty for local tokens and X displays."""
    return let(norm_ip(F.coalesce(token, F.lit(""))), lambda t: F.when(t.isin(*LOCAL) | t.startswith(":"), "").otherwise(t))


def kh_target(raw: Column) -> Column:
    """First host of a known_hosts entry, without brackets and port; empty for hashed ones."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    first = F.trim(F.substring_index(t, ",", 1))
    bare = F.when(first.startswith("["), F.regexp_extract(first, r"^\[([^\]]*)", 1)).otherwise(first)
    return F.when((t == "") | t.startswith("("), "").otherwise(remote_src(bare))


def rdp_session_src(remote: Column) -> Column:
    """Remote source of a session event; empty for consoles and link-local peers."""
    src = F.coalesce(extract_src(remote), F.lit(""))
    local = (F.lower(F.trim(F.coalesce(remote, F.lit("")))) == "local") | src.rlike(r"(?i)(?:^|:)fe80|^0:0:fe80")
    return F.when(local, "").otherwise(src)


def split_account(user: Column) -> Column:
    """struct(domain, account)."""
    has = user.contains("\\")
    return F.struct(F.when(has, F.substring_index(user, "\\", 1)).otherwise("").alias("domain"), F.when(has, F.regexp_replace(user, r"^[^\\]*\\", "")).otherwise(user).alias("account"))


#: Parts of names of networks that rent out machines or hide their users.
HOSTING = (
    "hosting", "datacenter", "data center", "dedicated", "colocation", "colo ", "vps", "server", "cloud", "virtual", "vpn", "proxy", "seedbox", "datacamp",
    "amazon", "aws", "google", "microsoft", "azure", "ovh", "digitalocean", "digital ocean", "hetzner", "linode", "akamai", "cloudflare", "vultr",
    "leaseweb", "contabo", "scaleway", "alibaba", "tencent", "huawei", "oracle", "m247", "choopa", "fastly", "ionos", "godaddy", "namecheap", "rackspace",
    "softlayer", "gcore", "g-core", "limestone", "psychz", "quadranet", "hostinger", "dreamhost", "kamatera", "netcup", "worldstream", "serverius",
    "hostwinds", "frantech", "buyvm", "colocrossing", "hostkey", "ipxo", "nordvpn", "mullvad", "expressvpn", "cyberghost", "surfshark", "proton",
    "windscribe", "ipvanish", "private internet", "aeza", "stark industries", "chang way", "flokinet", "njalla", "pq hosting",
    "mivocloud", "bucklog", "spectre operations", "railnet", "green floid",
)


def is_hosting(org: Column) -> Column:
    """Whether a network's name tells of hosting, clouds, proxies or VPNs."""
    low = F.lower(F.coalesce(org, F.lit("")))
    return low.rlike("|".join(x.replace(".", r"\.") for x in HOSTING))
