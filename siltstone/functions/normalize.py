"""Column functions for accounts, process identifiers, paths and addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.keys import host_key, present, trimmed, user_key

__all__ = ["host_key", "user_key", "is_machine_account", "is_correlating_user", "process_uid", "windows_path", "basename", "routable_ip", "is_ignorable_ip"]

# Accounts that say nothing about who acted.
BUILT_IN_ACCOUNTS = ("system", "local service", "network service", "anonymous logon", "nt authority\\system", "nt authority\\local service", "nt authority\\network service", "nt authority\\anonymous logon")
BUILT_IN_LEAVES = ("system", "local service", "network service", "anonymous logon")
SERVICE_PREFIXES = ("dwm-", "umfd-", "font driver host\\")
# Addresses that identify no peer.
IGNORED_ADDRESSES = ("0.0.0.0", "127.0.0.1", "::", "::1", "255.255.255.255", "-")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_H = "[0-9a-f]{1,4}"
IPV6 = "(?:" + "|".join([f"(?:{_H}:){{7}}{_H}", *(f"(?:{_H}:){{1,{8 - k}}}(?::{_H}){{1,{k - 1}}}" for k in range(2, 8)), f"{_H}:(?::{_H}){{1,6}}", f"(?:{_H}:){{1,7}}:", f":(?:(?::{_H}){{1,7}}|:)"]) + ")"
# An IPv6 literal whose last two groups are written as an IPv4 address.
IPV6_IPV4 = "(?:" + "|".join([f"(?:{_H}:){{6}}", *(f"(?:{_H}:){{{k}}}(?::{_H}){{0,{5 - k}}}:" for k in range(1, 6)), f":(?::{_H}){{0,5}}:"]) + f"){IPV4}"


def is_machine_account(user: Column) -> Column:
    """Whether a normalised account is a computer's."""
    return F.coalesce(F.endswith(user, F.lit("$")), F.lit(False))


def is_correlating_user(user: Column) -> Column:
    """Whether a normalised account tells actors apart: no computer, session or built-in account."""
    leaf = F.element_at(F.split(user, r"\\"), -1)
    no = user.isNull() | is_machine_account(user) | user.isin(*BUILT_IN_ACCOUNTS) | leaf.isin(*BUILT_IN_LEAVES)
    for prefix in SERVICE_PREFIXES:
        no = no | F.startswith(user, F.lit(prefix))
    return ~F.coalesce(no, F.lit(True))


def process_uid(uid: Column) -> Column:
    """Process identifier without blanks and braces, upper case; null where missing."""
    return present(F.upper(trimmed(F.regexp_replace(trimmed(uid), r"^\{+|\}+$", ""))))


def windows_path(path: Column) -> Column:
    """Trimmed lower-case path, kernel volume names as drive C; null where missing."""
    return present(F.regexp_replace(F.lower(trimmed(path)), r"^\\device\\harddiskvolume\d+\\", r"c:\\"))


def basename(path: Column) -> Column:
    """Last segment of a path with slashes of either kind."""
    return F.nullif(F.element_at(F.split(path, r"[\\/]"), -1), F.lit(""))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def canonical_ip6(address: Column) -> Column:
    """A valid IPv6 literal in lower case in its shortest form; one that stands for an IPv4 address as that."""

    def hexed(high: Column, low: Column) -> Column:
        return F.lower(F.hex(high.cast("int") * 256 + low.cast("int")))

    tail = F.split(F.regexp_extract(address, rf":({IPV4})$", 1), r"\.")
    prefix = F.regexp_extract(address, rf"^(.*:){IPV4}$", 1)
    plain = F.when(address.contains("."), F.concat(prefix, hexed(tail[0], tail[1]), F.lit(":"), hexed(tail[2], tail[3]))).otherwise(address)

    def groups(a: Column) -> Column:
        halves = F.split(a, "::")
        left, right = (F.filter(F.split(F.coalesce(h, F.lit("")), ":"), lambda g: g != "") for h in (halves[0], F.get(halves, F.lit(1))))
        return F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)

    def number(g: Column) -> Column:
        return F.conv(g, 16, 10).cast("int")

    def shortest(g: Column) -> Column:
        four = F.concat_ws(".", *((number(g[i]).bitwiseAND(0xFF00) / 256).cast("int").cast("string") if half else number(g[i]).bitwiseAND(0xFF).cast("string") for i in (6, 7) for half in (True, False)))

        def compressed(a: Column) -> Column:
            out = a
            for n in range(2, 9):
                # The first of the longest runs of two zeros or more is left out.
                run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
                out = F.when(a.rlike(run), F.concat(F.regexp_extract(a, run, 1), F.lit("::"), F.regexp_extract(a, run, 2))).otherwise(out)
            return out

        mapped = (F.array_join(F.slice(g, 1, 5), "") == "00000") & (g[5] == "ffff")
        return F.when(mapped, four).otherwise(_let(F.array_join(g, ":"), compressed))

    def small(a: Column) -> Column:
        return F.transform(groups(a), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))

    return _let(plain, lambda a: _let(small(a), shortest))


def routable_ip(ip: Column) -> Column:
    """The address in canonical form without zone, IPv4-mapped ones as IPv4; null for invalid ones and such that name no peer.

    Loopback, unspecified, link-local, multicast and broadcast addresses are dropped, private ranges kept.
    """
    bare = F.lower(F.regexp_replace(trimmed(ip), "%.*$", ""))
    six = F.when(bare.rlike(rf"^(?:{IPV6}|{IPV6_IPV4})$"), canonical_ip6(bare))
    known = F.when(bare.contains(":"), six).when(bare.rlike(rf"^{IPV4}$"), bare)

    def peer(a: Column) -> Column:
        return F.when(~a.rlike(r"^(?:127|22[4-9]|23\d)\.|^169\.254\.|^fe[89ab][0-9a-f]:|^ff[0-9a-f]{2}:") & ~a.isin(*IGNORED_ADDRESSES), a)

    return _let(known, peer)


def is_ignorable_ip(ip: Column) -> Column:
    """Whether an address names no peer."""
    return routable_ip(ip).isNull()
