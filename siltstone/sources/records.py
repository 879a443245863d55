"""Source records of several layouts to one normalised event row.

A record is a JSON object with a channel, an event number and event data; the layouts differ in where
those lie (flat, under winlog, under Event). What a layout keeps is brought to one map of texts, the
document and the columns are read from it, and every key whose value went nowhere stays in `unmapped`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.normalize import IPV4, basename
from siltstone.functions.parse import DIRECTION, SEVERITY_ID, STATUS, STATUS_ID, channel_source, hash_list, ip_value, looked_up, number_value, port_value, qualified_user, text_value, user_domain
from siltstone.operators.rules import unwrapped
from siltstone.operators.timestamps import clock_zone, normalise, pinned

_LAYOUTS = (
    "winlog struct<event_id:string,channel:string,event_data:map<string,string>>, host string, "
    "Event struct<System:struct<Provider:struct<Name:string>,EventID:string,Computer:string,TimeCreated:struct<SystemTime:string>>,EventData:struct<Data:string>>"
)
# --- what an event's record says, by event: class, activity, and which key holds what --------------
#
# Fixed values of the event schema and of the log sources. An event is named by source and number, with `*`
# for the source's other events; places in the document map to keys of the record.

_IMAGE = {"pid": "ProcessId", "uid": "ProcessGuid", "path": "Image"}
_HOLDER = {"pid": "ProcessId", "path": "ProcessName"}
_PARENT = {"pid": "ParentProcessId", "uid": "ParentProcessGuid", "path": "ParentImage", "cmd": "ParentCommandLine"}
_CREATOR = {"pid": "ProcessId", "path": "ParentProcessName"}
_SYSMON_USER = {"name": "User"}
_SUBJECT = {"name": "SubjectUserName", "domain": "SubjectDomainName", "sid": "SubjectUserSid"}
_TARGET = {"name": "TargetUserName", "domain": "TargetDomainName"}
_TARGET_SID, _TARGET_USER_SID = {**_TARGET, "sid": "TargetSid"}, {**_TARGET, "sid": "TargetUserSid"}
_FROM = {"ip": "IpAddress", "port": "IpPort"}


def _event(cls: int, activity: int, **places: dict[str, str]) -> tuple[int, int, dict[str, str]]:
    return cls, activity, {f"{place}.{part}": key for place, parts in places.items() for part, key in parts.items()}


EVENTS = {
    "sysmon:1": _event(1007, 1, process={**_IMAGE, "cmd": "CommandLine", "integrity": "IntegrityLevel", "hashes": "Hashes"}, process_user=_SYSMON_USER, parent=_PARENT, actor_user=_SYSMON_USER, actor=_PARENT),
    "sysmon:2": _event(1001, 6, actor=_IMAGE, file={"path": "TargetFilename"}),
    "sysmon:3": _event(4001, 1, actor_user=_SYSMON_USER, actor=_IMAGE, src={"ip": "SourceIp", "port": "SourcePort", "hostname": "SourceHostname"},
                       dst={"ip": "DestinationIp", "port": "DestinationPort", "hostname": "DestinationHostname"}, connection={"protocol_name": "Protocol", "initiated": "Initiated"}),
    "sysmon:5": _event(1007, 2, process=_IMAGE),
    "sysmon:7": _event(1005, 1, actor=_IMAGE, module={"path": "ImageLoaded", "hashes": "Hashes"}),
    "sysmon:8": _event(1007, 4, actor={"pid": "SourceProcessId", "uid": "SourceProcessGuid", "path": "SourceImage"}, process={"pid": "TargetProcessId", "uid": "TargetProcessGuid", "path": "TargetImage"}),
    "sysmon:10": _event(1007, 3, actor={"pid": "SourceProcessId", "uid": "SourceProcessGUID", "path": "SourceImage"}, process={"pid": "TargetProcessId", "uid": "TargetProcessGUID", "path": "TargetImage"}),
    "sysmon:11": _event(1001, 1, actor=_IMAGE, file={"path": "TargetFilename"}),
    "sysmon:12": _event(201001, 0, actor=_IMAGE, reg_key={"path": "TargetObject"}),
    "sysmon:13": _event(201002, 2, actor=_IMAGE, reg_value={"path": "TargetObject", "data": "Details"}),
    "sysmon:15": _event(1001, 1, actor=_IMAGE, file={"path": "TargetFilename", "hashes": "Hash"}),
    "sysmon:22": _event(4003, 1, actor=_IMAGE, query={"hostname": "QueryName"}),
    "sysmon:23": _event(1001, 4, actor_user=_SYSMON_USER, actor=_IMAGE, file={"path": "TargetFilename", "hashes": "Hashes"}),
    "sysmon:*": _event(0, 0, actor_user=_SYSMON_USER, actor=_IMAGE),
    "winsec:4688": _event(1007, 1, process={"pid": "NewProcessId", "path": "NewProcessName", "cmd": "CommandLine"}, process_user=_TARGET_USER_SID, parent=_CREATOR, actor_user=_SUBJECT, actor=_CREATOR),
    "winsec:4689": _event(1007, 2, process=_HOLDER, actor_user=_SUBJECT),
    "winsec:4624": _event(3002, 1, user=_TARGET_USER_SID, actor_user=_SUBJECT, actor=_HOLDER, src={**_FROM, "hostname": "WorkstationName"}, logon={"type_id": "LogonType", "protocol": "AuthenticationPackageName"}),
    "winsec:4634": _event(3002, 2, user=_TARGET_USER_SID, logon={"type_id": "LogonType"}),
    "winsec:4647": _event(3002, 2, user=_TARGET_USER_SID, logon={"type_id": "LogonType"}),
    "winsec:4648": _event(3002, 1, user=_TARGET, actor_user=_SUBJECT, actor=_HOLDER, src=_FROM, dst={"hostname": "TargetServerName"}),
    "winsec:4672": _event(3003, 1, user=_SUBJECT),
    "winsec:4768": _event(3002, 3, user=_TARGET_SID, src=_FROM),
    "winsec:4769": _event(3002, 4, user=_TARGET, src=_FROM),
    "winsec:4776": _event(3002, 1, user={"name": "TargetUserName"}, src={"hostname": "Workstation"}, logon={"protocol": "PackageName"}),
    **{f"winsec:{n}": _event(3001, a, user=_TARGET_SID, actor_user=_SUBJECT) for n, a in ((4720, 1), (4722, 2), (4724, 4), (4738, 99))},
    **{f"winsec:{n}": _event(3006, 3, group={"name": "TargetUserName", "domain": "TargetDomainName", "uid": "TargetSid"}, user={"name": "MemberName", "sid": "MemberSid"}, actor_user=_SUBJECT) for n in (4728, 4732)},
    **{f"winsec:{n}:File": _event(1001, a, actor_user=_SUBJECT, actor=_HOLDER, file={"path": "ObjectName"}) for n, a in ((4656, 14), (4663, 99))},
    **{f"winsec:{n}:Key": _event(201001, 99, actor_user=_SUBJECT, actor=_HOLDER, reg_key={"path": "ObjectName"}) for n in (4656, 4663)},
    **{f"winsec:{n}:Process": _event(1007, 3, actor_user=_SUBJECT, actor=_HOLDER, process={"path": "ObjectName"}) for n in (4656, 4663)},
    "winsec:4657": _event(201002, 3, actor_user=_SUBJECT, actor=_HOLDER, reg_value={"path": "ObjectName", "name": "ObjectValueName", "data": "NewValue"}),
    **{f"winsec:{n}": _event(4001, a, actor={"pid": "ProcessId", "path": "Application"}, src={"ip": "SourceAddress", "port": "SourcePort"}, dst={"ip": "DestAddress", "port": "DestPort"}, connection={"protocol_num": "Protocol"})
       for n, a in ((5154, 7), (5156, 1), (5157, 5), (5158, 99))},
    **{f"winsec:{n}": _event(0, 0, actor_user=_SUBJECT, src=_FROM) for n in (5140, 5145)},
    **{f"winsec:{n}": _event(0, 0, actor_user=_SUBJECT, actor={"pid": "CallerProcessId", "path": "CallerProcessName"}) for n in (4798, 4799)},
    "winsec:*": _event(0, 0, actor_user=_SUBJECT, actor=_HOLDER),
    "*": _event(0, 0, actor_user={"name": "AccountName", "domain": "Domain", "sid": "UserID"}),
}
PLACES = sorted({place for _, _, places in EVENTS.values() for place in places})
#: Parts that are written only where the part they belong to is there.
_ONLY_WITH = {"domain": "name", "sid": "name", "hashes": "path", "data": "path"}
_NUMBERS = ("pid", "type_id", "protocol_num")


def with_record(rows: DataFrame, raw: str, to: str) -> DataFrame:
    """rows with the map `to` of the record's texts: top-level members, event data, and the envelope by flat names.

    Null for what is no JSON object. Of equal keys the more specific place counts, within one the last.
    Each document is parsed once; the steps are pinned, as lambdas would evaluate them anew per entry.
    """
    got = pinned(rows, {"__r_text": unwrapped(F.col(raw))})
    got = pinned(got, {"__r_flat": F.from_json("__r_text", "map<string,string>"), "__r_shape": F.from_json("__r_text", _LAYOUTS)})
    shape = F.col("__r_shape")
    held = shape["Event"]["EventData"]["Data"]
    pair = "struct<Name:string,Value:string>"
    listed = F.when(held.startswith("["), F.from_json(held, f"array<{pair}>")).when(held.startswith("{"), F.array(F.from_json(held, pair)))
    named = F.filter(F.coalesce(listed, F.array().cast(f"array<{pair}>")), lambda d: d["Name"].isNotNull())
    host = F.from_json(shape["host"], "name string")["name"]
    place = {
        "EventID": F.coalesce(shape["winlog"]["event_id"], shape["Event"]["System"]["EventID"]),
        "Channel": F.coalesce(shape["winlog"]["channel"], shape["Event"]["System"]["Provider"]["Name"]),
        "Hostname": F.coalesce(shape["Event"]["System"]["Computer"], host),
        "@timestamp": shape["Event"]["System"]["TimeCreated"]["SystemTime"],
    }
    envelope = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in place.items())), lambda e: e["value"].isNotNull())
    got = pinned(got, {"__r_named": named, "__r_env": envelope, "__r_data": F.coalesce(F.map_entries(shape["winlog"]["event_data"]), F.array())})
    got = pinned(got, {"__r_names": F.transform("__r_named", lambda d: d["Name"]), "__r_keys": F.transform("__r_env", lambda e: e["key"]), "__r_dkeys": F.transform("__r_data", lambda e: e["key"])})
    names, keys, inner = F.col("__r_names"), F.col("__r_keys"), F.col("__r_dkeys")
    # The last of equal names: none of those after it is the same.
    last = F.filter("__r_named", lambda d, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), d["Name"]) & ~F.array_contains(keys, d["Name"]))
    data = F.filter("__r_data", lambda e: ~F.array_contains(keys, e["key"]) & ~F.array_contains(names, e["key"]))
    top = F.filter(F.map_entries("__r_flat"), lambda e: ~e["key"].isin("winlog", "Event") & ~F.array_contains(keys, e["key"]) & ~F.array_contains(names, e["key"]) & ~F.array_contains(inner, e["key"]))
    whole = F.map_from_entries(F.concat(top, data, F.transform(last, lambda d: F.struct(d["Name"].alias("key"), d["Value"].alias("value"))), F.col("__r_env")))
    got = pinned(got, {to: F.when(F.col("__r_text").rlike(r"^\s*\{") & F.col("__r_flat").isNotNull(), whole)})
    return got.drop("__r_text", "__r_flat", "__r_shape", "__r_named", "__r_env", "__r_data", "__r_names", "__r_keys", "__r_dkeys")


def _filled(**parts: Column) -> Column:
    """A struct of the parts, null where all are."""
    there = reduce(lambda a, b: a | b, (c.isNotNull() for c in parts.values()))
    return F.when(there, F.struct(*(c.alias(n) for n, c in parts.items())))


def parse_records(lines: DataFrame, uid: str, raw: str, offset: Column | None = None, received: Column | None = None) -> DataFrame:
    """One normalised row per record: the event's columns, its nested document, what stays unmapped, and `reject`, why it is none.

    offset is the clock of EventTime, a zone or offset; Sysmon's UtcTime is UTC and goes first; layouts
    without an EventTime are read by their @timestamp. Reasons are 'unreadable', 'no channel', 'no event
    number' and 'no time'.

    Which key holds what is looked up in EVENTS, a place of the document at a time. A key counts as used
    only where its value was written; all others stay in unmapped, placeholders and what did not convert
    among them. Members of the document that hold nothing are null.
    """
    given = lines.select(
        F.col(uid).alias("uid"), F.col(raw).alias("raw"), (offset if offset is not None else F.lit(None).cast("string")).alias("_clock"), (received if received is not None else F.lit(None).cast("timestamp")).alias("_seen")
    )
    rows = with_record(given, "raw", "m")

    def member(key: Column | str) -> Column:
        return F.try_element_at("m", F.lit(key) if isinstance(key, str) else key)

    def text(key: str) -> Column:
        return text_value(member(key))

    source = channel_source(text("Channel"))
    rows = pinned(rows, {"source": source, "_number": number_value(text("EventID"))})
    number = F.col("_number").cast("string")
    named, other = F.concat_ws(":", "source", number), F.concat(F.col("source"), F.lit(":*"))
    handled = F.concat_ws(":", named, F.when(text("ObjectName").isNotNull(), text("ObjectType")))
    known = F.array(*map(F.lit, EVENTS))
    event = F.when(number.isin("4656", "4663") & (F.col("source") == "winsec"), F.when(F.array_contains(known, handled), handled).otherwise(other))
    event = F.coalesce(event, F.when(F.array_contains(known, named), named), F.when(F.col("source").isin("sysmon", "winsec"), other), F.lit("*"))
    rows = pinned(rows, {"_event": event})

    # One lookup gives the keys of all places, one pass over them the record's texts.
    each = {e: F.array(*(F.lit(places.get(place)).cast("string") for place in PLACES)) for e, (_, _, places) in EVENTS.items()}
    rows = pinned(rows, {"_k": F.try_element_at(F.create_map(*(x for e, ks in each.items() for x in (F.lit(e), ks))), F.col("_event"))})
    rows = pinned(rows, {"_raw": F.transform("_k", lambda k: F.try_element_at("m", k))})
    index = {place: i for i, place in enumerate(PLACES)}

    def value(place: str) -> Column:
        part = place.partition(".")[2]
        got = F.col("_raw")[index[place]]
        if part in _NUMBERS:
            return number_value(got)
        kind = {"ip": ip_value, "port": port_value, "hashes": hash_list, "initiated": lambda c: looked_up(DIRECTION, c)}
        return kind.get(part, text_value)(got)

    def written(place: str) -> Column:
        owner, _, part = place.partition(".")
        first = f"{owner}.{_ONLY_WITH.get(part, '')}"
        if part == "name" and owner == "reg_value":
            first = "reg_value.path"
        return F.when(value(first).isNotNull(), value(place)) if first in PLACES and owner != "group" else value(place)

    rows = pinned(rows, {"_v": F.struct(*(written(place).alias(place.replace(".", "__")) for place in PLACES))})

    def at(place: str) -> Column:
        return F.col("_v")[place.replace(".", "__")] if place in PLACES else F.lit(None).cast("string")

    sysmon = F.col("source") == "sysmon"
    uses_utc = sysmon & text("UtcTime").isNotNull()
    stamp = F.coalesce(F.when(uses_utc, text("UtcTime")), text("EventTime"), text("@timestamp"))
    field = F.when(uses_utc, "UtcTime").when(text("EventTime").isNotNull(), "EventTime").when(text("@timestamp").isNotNull(), "@timestamp")
    zone = F.when(uses_utc, F.lit("+00:00")).otherwise(clock_zone(F.col("_clock")))
    logged = F.when(member("@timestamp").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}Z$"), F.unix_millis(F.try_to_timestamp(member("@timestamp"))))
    severity = looked_up(SEVERITY_ID, member("SeverityValue").try_cast("int"))
    status = looked_up(STATUS_ID, member("EventType"))
    sequence = number_value(member("RecordNumber"))

    def user(place: str) -> Column:
        name, domain = at(f"{place}.name"), at(f"{place}.domain")
        domain = F.coalesce(domain, F.when(sysmon, user_domain(name)))
        return _filled(name=F.when(sysmon, name).otherwise(qualified_user(name, at(f"{place}.domain"))), domain=domain, uid=at(f"{place}.sid"))

    none_hashes = F.lit(None).cast("array<struct<algorithm:string,value:string>>")

    def file(place: str) -> Column:
        path = at(f"{place}.path")
        return _filled(path=path, name=basename(path), hashes=at(f"{place}.hashes") if f"{place}.hashes" in PLACES else none_hashes)

    def process(place: str, **more: Column) -> Column:
        return _filled(pid=at(f"{place}.pid"), uid=at(f"{place}.uid"), name=basename(at(f"{place}.path")), file=file(place), cmd_line=at(f"{place}.cmd"), integrity=at(f"{place}.integrity"), **more)

    rows = pinned(rows, {"_stamp": stamp, "_field": field, "_zone": zone, "_logged": logged, "_severity": severity, "_status": status, "_sequence": sequence})
    rows = normalise(rows, "_stamp", F.col("_zone"), F.lit(None).cast("string"), F.col("_seen"), "time_us")
    rows = pinned(rows, {
        "_actor_user": user("actor_user"), "_actor": process("actor"), "_process": process("process", user=user("process_user"), parent_process=process("parent")), "_user": user("user"),
        "class_uid": looked_up({e: c for e, (c, _, _) in EVENTS.items()}, F.col("_event")), "activity_id": looked_up({e: a for e, (_, a, _) in EVENTS.items()}, F.col("_event")),
    })
    provider = text("SourceName")
    document = F.struct(
        "class_uid", "activity_id", (F.col("class_uid").cast("bigint") * 100 + F.col("activity_id")).alias("type_uid"), F.floor(F.col("time_us") / F.lit(1000)).alias("time"),
        F.coalesce("_severity", F.lit(0)).alias("severity_id"), text("Severity").alias("severity"), F.col("_status").alias("status_id"), looked_up(STATUS, F.col("_status")).alias("status"),
        F.struct(
            F.col("uid"), F.struct(F.coalesce(provider, text("Channel")).alias("name"), F.lit("Microsoft").alias("vendor_name")).alias("product"), text("Channel").alias("log_name"), provider.alias("log_provider"),
            number.alias("event_code"), F.col("_sequence").alias("sequence"), F.col("_stamp").alias("original_time"), F.col("_logged").alias("logged_time"),
        ).alias("metadata"),
        _filled(hostname=text("Hostname")).alias("device"), _filled(user=F.col("_actor_user"), process=F.col("_actor")).alias("actor"), F.col("_process").alias("process"), F.col("_user").alias("user"),
        _filled(name=at("group.name"), domain=at("group.domain"), uid=at("group.uid")).alias("group"), file("file").alias("file"), _filled(file=file("module")).alias("module"),
        _filled(path=at("reg_key.path")).alias("reg_key"), _filled(path=at("reg_value.path"), name=at("reg_value.name"), data=at("reg_value.data")).alias("reg_value"),
        _filled(ip=at("src.ip"), port=at("src.port"), hostname=at("src.hostname")).alias("src_endpoint"), _filled(ip=at("dst.ip"), port=at("dst.port"), hostname=at("dst.hostname")).alias("dst_endpoint"),
        _filled(protocol_name=at("connection.protocol_name"), protocol_num=at("connection.protocol_num"), direction=at("connection.initiated")).alias("connection_info"),
        _filled(hostname=at("query.hostname")).alias("query"), at("logon.type_id").alias("logon_type_id"), at("logon.protocol").alias("auth_protocol"),
        F.struct(F.col("_field").alias("time_field"), F.col("_zone").alias("time_utc_offset")).alias("provenance"),
    )
    used = [F.when(at(place).isNotNull(), F.col("_k")[index[place]]) for place in PLACES]
    used += [F.when(text(k).isNotNull(), F.lit(k)) for k in ("Channel", "Hostname", "SourceName", "Severity")]
    used += [F.when(sysmon & text("User").isNotNull(), F.lit("User")), F.lit("EventID"), F.when(F.col("_sequence").isNotNull(), F.lit("RecordNumber")), F.when(F.col("_severity").isNotNull(), F.lit("SeverityValue"))]
    used += [F.when(F.col("_status").isNotNull(), F.lit("EventType")), F.when(F.col("_logged").isNotNull(), F.lit("@timestamp")), F.col("_field")]
    rows = pinned(rows, {"document": document, "_used": F.array_distinct(F.array_compact(F.array(*used)))})

    # The columns of an event: its process is the one started or ended, else the acting one; its user is the account of a logon, else the acting one, else the process's.
    started = (F.col("class_uid") == 1007) & F.col("activity_id").isin(1, 2) & F.col("_process").isNotNull()
    logon = F.col("class_uid").isin(3002, 3003)
    of_event = {n: F.when(started, F.col("_process")[n]).otherwise(F.col("_actor")[n]) for n in ("pid", "file", "cmd_line")}
    own_user = F.coalesce(F.when(logon, F.col("_user")["name"]).otherwise(F.col("_actor_user")["name"]), F.when(started, F.col("_process")["user"]["name"]))

    def column_ip(end: str) -> Column:
        bare = F.regexp_replace(F.col("document")[end]["ip"], "%.*$", "")
        return F.regexp_replace(bare, rf"(?i)^(?:0{{0,4}}:){{2,6}}ffff:({IPV4})$", "$1")

    reject = (
        F.when(F.col("m").isNull(), "unreadable").when(F.col("source").isNull(), "no channel").when(F.col("_number").isNull(), "no event number").when(F.col("time_us").isNull(), "no time")
    )
    return rows.select(
        "uid", "raw", reject.alias("reject"), "time_us", "source", number.alias("event_code"), F.col("document.device.hostname").alias("host"), own_user.alias("user_name"),
        of_event["file"]["path"].alias("process_name"), of_event["pid"].alias("process_id"), F.when(started, F.col("_process")["parent_process"]["file"]["path"]).alias("parent_process"),
        column_ip("src_endpoint").alias("src_ip"), column_ip("dst_endpoint").alias("dst_ip"), F.col("document.file.path").alias("file_path"), of_event["cmd_line"].alias("command_line"),
        "class_uid", "activity_id", "document", F.map_filter("m", lambda k, v: ~F.array_contains(F.col("_used"), k)).alias("unmapped"),
    )


def reject_counts(parsed: DataFrame) -> DataFrame:
    """(reject, n): records by reason of rejection, '' for accepted ones."""
    return parsed.groupBy(F.coalesce("reject", F.lit("")).alias("reject")).agg(F.count(F.lit(1)).alias("n"))
