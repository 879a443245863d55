"""Events as one line of text for reading and checking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_line(m: Column, o: Column) -> Column:
    """Ordered 'key=value' parts joined by ' | '; empty parts are left out.

    m is the record's map of texts (see sources.records.with_record), o the event document (see
    operators.rules.with_document); columns id, ts, host, user_name, event_code, process_name,
    parent_process, command_line, file_path, src_ip and dst_ip come first and the record fills in, for
    some parts the document too. Where record and document have different destination ports, both are
    shown and marked CONFLICT. Script text is cut at 300 characters after blanks are collapsed, as it is
    a summary for reading.
    """
    port = F.nullif(o["dst_endpoint"]["port"], F.lit(""))

    def kept(name: str) -> Column:
        return F.coalesce(at(name), F.nullif(F.try_element_at(o["unmapped"], F.lit(name)), F.lit("")))

    def at(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names))

    def first(column: str, *names: str) -> Column:
        own = F.nullif(F.col(column), F.lit(""))
        return F.coalesce(own, at(*names)) if names else own

    def part(key: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value))

    raw_port = at("DestinationPort")
    conflict = raw_port.isNotNull() & port.isNotNull() & (raw_port != port)
    shown = F.when(conflict, F.concat(F.lit(":"), port, F.lit(" (RawLog DestinationPort="), raw_port, F.lit(" CONFLICT)"))).otherwise(F.coalesce(F.concat(F.lit(":"), F.coalesce(raw_port, port)), F.lit("")))
    src, dst = first("src_ip", "SourceIp"), first("dst_ip", "DestinationIp")
    net = F.when(src.isNotNull() | dst.isNotNull(), F.concat(F.coalesce(src, F.lit("")), F.lit("->"), F.coalesce(dst, F.lit("")), shown))
    script = F.substring(F.trim(F.regexp_replace(at("ScriptBlockText"), r"\s+", " ")), 1, 300)
    moment = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Event "), F.col("id").cast("string")),
        part("TS", F.concat(moment, F.lit("+00:00"))),
        part("Host", first("host")),
        part("User", first("user_name", "AccountName", "TargetUserName")),
        F.concat(F.lit("Code="), F.coalesce(first("event_code", "EventID"), F.lit(""))),
        part("Proc", first("process_name", "SourceImage", "ProcessName")),
        part("Parent", first("parent_process", "ParentImage")),
        part("Cmd", first("command_line", "CommandLine")),
        part("TargetProc", F.coalesce(at("TargetImage"), F.nullif(o["process"]["file"]["path"], F.lit("")), F.nullif(o["process"]["name"], F.lit("")))),
        part("GrantedAccess", kept("GrantedAccess")),
        part("ScriptBlock", script),
        part("Net", net),
        part("Share", kept("ShareName")),
        part("ShareFile", kept("RelativeTargetName")),
        part("Service", kept("ServiceName")),
        part("ServiceImage", at("ImagePath", "ServiceFileName")),
        part("RegKey", kept("TargetObject")),
        part("File", F.coalesce(at("TargetFilename"), F.nullif(F.col("file_path"), F.lit("")))),
    )
