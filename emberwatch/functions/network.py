"""IP address tests on text columns, inside the JVM."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.sqltext import lit

# IPv4 blocks that count as private, loopback or reserved.
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
PUBLIC_V4 = ["192.0.0.9/32", "192.0.0.10/32"]  # public addresses inside a block above

# IPv6 as leading hex digits of the full 32-digit form. Everything
# outside 2xxx/3xxx is private or reserved but for multicast and old site-local;
# inside 2xxx/3xxx only the listed blocks are.
OPEN_V6 = r"^(?:[23]|ff|fe[c-f])"
PRIVATE_V6 = r"^(?:20010[01]|20010db8|2002)"
PUBLIC_V6 = r"^(?:2001000100000000000000000000000[12]|20010003|200100040112|2001002|2001003)"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


HEX_GROUP = "^[0-9a-f]{1,4}$"


def _blocks(blocks: list[str]) -> str:
    nets = [ipaddress.ip_network(b) for b in blocks]
    return "(" + " OR ".join(f"n BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in nets) + ")"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _v4_number(ip: str) -> str:
    parts = [f"try_cast(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)]
    return "(" + " + ".join(parts) + ")"


def _private_v4(ip: str) -> str:
    return _let(_v4_number(ip), "n", f"{_blocks(PRIVATE_V4)} AND NOT {_blocks(PUBLIC_V4)}")


def _private_v6(ip: str) -> str:
    # A dotted IPv4 tail becomes two hex groups.
    tail = "regexp_extract(a, '([0-9.]+)$', 1)"
    two_groups = _let(_v4_number(tail), "n", "concat(lower(hex(shiftright(n, 16))), ':', lower(hex(n & 65535)))")
    undotted = (
        f"CASE WHEN NOT contains({tail}, '.') THEN a WHEN {tail} RLIKE {lit(V4)} "
        f"THEN concat(regexp_replace(a, '[0-9.]+$', ''), {two_groups}) END"
    )
    # '::' stands for as many zero groups as are missing.
    left = "filter(split(substring_index(b, '::', 1), ':'), (g, i) -> NOT (i = 0 AND substring_index(b, '::', 1) = ''))"
    right = "filter(split(substring_index(b, '::', -1), ':'), (g, i) -> NOT (i = 0 AND substring_index(b, '::', -1) = ''))"
    widened = (
        f"CASE WHEN NOT contains(b, '::') THEN split(b, ':') "
        f"WHEN size(split(b, '::')) = 2 AND size({left}) + size({right}) < 8 "
        f"THEN concat({left}, array_repeat('0', 8 - size({left}) - size({right})), {right}) END"
    )
    digits = (
        f"CASE WHEN size(c) = 8 AND forall(c, g -> g RLIKE {lit(HEX_GROUP)}) "
        f"THEN array_join(transform(c, g -> lpad(g, 4, '0')), '') END"
    )
    private = f"NOT d RLIKE {lit(OPEN_V6)} OR (d RLIKE {lit(PRIVATE_V6)} AND NOT d RLIKE {lit(PUBLIC_V6)})"
    plain = f"lower(regexp_replace({ip}, '%.+$', ''))"
    hex_text = _let(_let(_let(plain, "a", undotted), "b", widened), "c", digits)
    return f"coalesce({_let(hex_text, 'd', private)}, false)"


def is_private_ip(ip: str) -> Column:
    """True for empty, ``-`` and private/loopback/reserved addresses; false for non-addresses.

    ``ip`` is a column name. The IPv6 branch runs only for texts with a colon.
    """
    return F.expr(
        f"CASE WHEN {ip} IS NULL OR {ip} IN ('', '-') THEN true WHEN {ip} RLIKE {lit(V4)} THEN {_private_v4(ip)} "
        f"WHEN contains({ip}, ':') THEN {_private_v6(ip)} ELSE false END"
    )
