"""Column functions that read values of source records; what does not convert gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.keys import present
from siltstone.functions.normalize import IPV4, IPV6, IPV6_IPV4, basename

# Fixed values of the record format.
SOURCE_BY_CHANNEL = {
    "microsoft-windows-sysmon/operational": "sysmon",
    "security": "winsec",
    "microsoft-windows-powershell/operational": "powershell",
    "windows powershell": "powershell",
}
SEVERITY_ID = {1: 1, 2: 1, 3: 2, 4: 3, 5: 5}
DIRECTION = {"true": "Outbound", "false": "Inbound"}
STATUS_ID = {"AUDIT_SUCCESS": 1, "AUDIT_FAILURE": 2}
STATUS = {1: "Success", 2: "Failure"}


def looked_up(table: dict, key: Column) -> Column:
    """Value of a fixed lookup table, null for keys it lacks."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def text_value(value: Column) -> Column:
    """Non-empty text other than the placeholder '-'."""
    return present(value)


def number_value(value: Column) -> Column:
    """A decimal or 0x-hex string of any length as bigint; null beyond the range of bigint."""
    digits = F.nullif(F.regexp_extract(value, r"^0[xX]0*([0-9a-fA-F]*)$", 1), F.lit(""))
    # Sixteen digits from 8 on, and longer ones, are beyond bigint.
    fits = (F.length(digits) <= 15) | ((F.length(digits) == 16) & digits.rlike("^[0-7]"))
    hexed = F.when(fits, F.conv(digits, 16, 10).try_cast("bigint"))
    zero = F.when(value.rlike(r"^0[xX]0+$"), F.lit(0).cast("bigint"))
    return F.coalesce(hexed, zero, F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("bigint")))


def port_value(value: Column) -> Column:
    """A port number up to 65,535 from a string of digits."""
    n = F.when(value.rlike(r"^0*\d{1,5}$"), value.try_cast("int"))
    return F.when(n <= 65535, n)


def ip_value(value: Column) -> Column:
    """A valid IPv4 or IPv6 literal as it is, loopback and the like included; null for anything else."""
    return F.when(value.rlike(rf"^{IPV4}$") | F.lower(value).rlike(rf"^(?:{IPV6}|{IPV6_IPV4})(?:%\S+)?$"), value)


def channel_source(channel: Column) -> Column:
    """Source of a log channel; other channels are 'winevt', no channel is null."""
    return F.when(channel.isNotNull(), F.coalesce(looked_up(SOURCE_BY_CHANNEL, F.lower(channel)), F.lit("winevt")))


def qualified_user(name: Column, domain: Column) -> Column:
    """DOMAIN\\name unless the name is qualified already or there is no domain."""
    name, domain = present(name), present(domain)
    return F.when(domain.isNull() | name.contains("\\") | name.contains("@"), name).otherwise(F.concat(domain, F.lit("\\"), name))


def user_domain(user: Column) -> Column:
    """The part before the first backslash, null without one."""
    return F.when(user.contains("\\"), F.split_part(user, F.lit("\\"), F.lit(1)))


def hash_list(value: Column) -> Column:
    """'ALG=HEX,...' as array of (algorithm, value); null if any part has another form."""
    parts = F.split(value, ",")
    fine = F.forall(parts, lambda p: p.rlike(r"^[^=]+=.+$"))
    pair = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("algorithm"), F.substr(p, F.locate("=", p) + 1).alias("value")))
    return F.when(fine, pair)


def clean_description(text: Column) -> Column:
    """Text without citations, markdown links (their words stay) and code tags, blanks collapsed."""
    out = F.regexp_replace(text, r"\(Citation: [^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"</?code>", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
