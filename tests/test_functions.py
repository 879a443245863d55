"""Scalar functions: tables of inputs and results."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import minhash, parse
from siltstone.functions.keys import code_key, host_key, one_per_record, user_key
from siltstone.functions.normalize import basename, is_correlating_user, is_ignorable_ip, is_machine_account, process_uid, routable_ip, windows_path
from siltstone.operators.dedup import exact_key


def values(spark, expression, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


CASES = {
    "user": (lambda c: user_key(c, ("corp.example", "corp")), ["CORP\\pbeesly", "dschrute@CORP.EXAMPLE", "corp.example\\mscott", "UTICA$", "CORP\\UTICA$", "-", None, "", " NT AUTHORITY\\SYSTEM", "CORP\\"],
             ["pbeesly", "dschrute", "mscott", "utica$", "utica$", None, None, None, "nt authority\\system", None]),
    "host": (host_key, ["UTICA.corp.example", " newyork", "wec.internal.cloudapp.net. ", None, "-", "", "\t", ".x"], ["UTICA", "NEWYORK", "WEC", None, None, None, None, None]),
    "code": (code_key, ["12", " 7 ", "", "-", None], ["12", "7", None, None, None]),
    "uid": (process_uid, ["{74328515-2c3c}", "74328515-2C3C", " {a} ", "-", None, "{}"], ["74328515-2C3C", "74328515-2C3C", "A", None, None, None]),
    "path": (windows_path, ["\\Device\\HarddiskVolume2\\Windows\\System32\\lsass.exe", "C:\\Windows\\CMD.exe ", None], ["c:\\windows\\system32\\lsass.exe", "c:\\windows\\cmd.exe", None]),
    "base": (basename, ["c:\\a\\b.exe", "/x/y", "z", "c:\\"], ["b.exe", "y", "z", None]),
    "ip": (routable_ip, ["192.168.1.50", "::ffff:10.0.1.4", "0.0.0.0", "127.0.0.1", "::", "::1", "255.255.255.255", "fe80::1%eth0", "-", None, "224.0.0.5", "256.1.1.1", "2001:DB8::5", "169.254.3.3", "ff02::1"],
           ["192.168.1.50", "10.0.1.4", None, None, None, None, None, None, None, None, None, None, "2001:db8::5", None, None]),
    "number": (parse.number_value, ["0x1a4", "900", "0x", "-", None, "1.5", "-3"], [420, 900, None, None, None, None, -3]),
    "port": (parse.port_value, ["443", "70000", "x", None], [443, None, None, None]),
    "channel": (parse.channel_source, ["Security", "security", "Microsoft-Windows-Sysmon/Operational", "Windows PowerShell", "System", None], ["winsec", "winsec", "sysmon", "powershell", "winevt", None]),
    "domain": (parse.user_domain, ["A\\b", "b", None], ["A", None, None]),
    "clean": (parse.clean_description, ["a (Citation: X y) [link](http://z) <code>q</code>  b", None], ["a link q b", None]),
}


@pytest.mark.parametrize("name", CASES)
def test_table(spark, name):
    expression, inputs, wanted = CASES[name]
    assert values(spark, expression, inputs) == wanted


def test_accounts(spark):
    names = ["utica$", "pbeesly", None, "system", "nt authority\\system", "dwm-1", "font driver host\\umfd-0", "corp\\local service", "corp\\ann"]
    assert values(spark, is_machine_account, names) == [True] + [False] * 8
    assert values(spark, is_correlating_user, names) == [False, True, False, False, False, False, False, False, True]
    assert values(spark, is_ignorable_ip, ["0.0.0.0", "192.168.1.100", None]) == [True, False, True]


def test_hash_list(spark):
    got = values(spark, parse.hash_list, ["SHA1=AB,MD5=CD=E", "Unknown", "SHA1=", None])
    assert [[tuple(h) for h in x] if x else x for x in got] == [[("SHA1", "AB"), ("MD5", "CD=E")], None, None, None]


def test_exact_key_golden(spark):
    rows = spark.createDataFrame([("2020-05-02 03:00:15",), ("2020-05-02 03:00:45",), ("2020-05-02 03:01:15",)], "t string")
    key = exact_key(F.lit("CUR-001"), F.lit("UTICA"), F.lit("pbeesly"), F.lit("GUID-1"), F.to_timestamp("t"))
    got = [r[0] for r in rows.select(key).collect()]
    first = "afccc1ecf50f9d90dbc6874e63ebcb8b13913b11773a5c89c1a06c3a81a30c34"
    assert got == [first, first, "442ac4fc2cf12f075419bc33e71c70bf8bcf562bb70a6c39966e908ad3c2da73"]


def test_minhash(spark):
    import hashlib

    text = "powershell.exe -nop -w hidden Invoke-WebRequest http://10.0.0.1/a x"
    words = sorted({w for w in ["powershell.exe", "-nop", "-w", "hidden", "invoke-webrequest", "http:", "10.0.0.1", "x"] if len(w) > 1})
    hashes = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") for w in words]
    want = [min((a * h + b) % minhash.PRIME for h in hashes) for a, b in zip(minhash.MULTIPLIERS, minhash.OFFSETS)]
    sig = lambda c: minhash.signature(minhash.tokens(c))
    got = values(spark, sig, [text, None, ""])
    assert got[0] == want and got[1] == [0] * 64 and got[2] == [0] * 64
    assert values(spark, lambda c: minhash.similarity(sig(c), sig(c)), [text]) == [1.0]


def test_one_per_record(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), (None, 1, 3), (None, 1, 4)], "uid string, at int, id int").withColumn("__x", F.lit(1))
    assert sorted(r["id"] for r in one_per_record(rows, "uid", "at", "id").collect()) == [2, 3, 4]


def test_addresses_are_canonical(spark):
    import ipaddress
    import random

    from siltstone.functions.normalize import routable_ip

    r = random.Random(3)
    texts = ["::", "::1", "1::", "::ffff:10.0.0.1", "0:0:0:0:0:FFFF:0A00:0002", "2001:DB8:0:0:1:0:0:1", "2001:db8::0:1", "fe80::1", "FF02::1", "::ffff:127.0.0.1", "64:ff9b::1.2.3.4", "10.0.0.300", "1.2.3", "fe80::1%eth0", "2001:db8::1%eth0", ":::", "1:2", "", "-", "127.0.0.1", "169.254.1.1", "239.1.1.1", "255.255.255.255", "0.0.0.0"]
    for _ in range(300):
        groups = [r.choice(["0", "0", "0000", "1", "00ab", "FFFF"]) for _ in range(8)]
        text = ":".join(groups)
        if r.random() < 0.5:
            i, j = sorted(r.sample(range(9), 2))
            text = ":".join(groups[:i]) + "::" + ":".join(groups[j:])
        texts.append(text)

    def want(text):
        try:
            a = ipaddress.ip_address(text.split("%")[0])
        except ValueError:
            return None
        if a.version == 6 and a.ipv4_mapped:
            a = a.ipv4_mapped
        return None if a.is_loopback or a.is_unspecified or a.is_link_local or a.is_multicast or str(a) == "255.255.255.255" else str(a)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", routable_ip(F.col("t")).alias("a")).collect()
    # The 0.0.0.0/8 range and the like are told by equality only, as 0.0.0.0 itself.
    assert [(r["t"], r["a"]) for r in rows if r["a"] != want(r["t"])] == []
