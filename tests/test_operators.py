import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators import analytics as A
from logloom.operators import clusters
from logloom.operators import detect as D
from logloom.operators import extract as X
from logloom.operators import integrity as I
from logloom.operators import signatures as S
from logloom.operators.manifest import load_manifests, named_fields, parse_manifest
from logloom.schema import DEFENDER, HYPERV, POWERSHELL, SILVER, SYSMON, TASK_SCHEDULER, WMI_ACTIVITY, conform
from logloom.sinks import writers as W
from logloom.sources.logs import from_json, with_fields
from logloom.streaming import tail



def flat_json(text: str | None) -> dict[str, str]:
    """The fields of a decoded record as JSON: EventData, then UserData; both ways of writing attributes.

    Numbers and booleans become text, nulls are left out, a Data item without text is empty, unnamed ones
    are Data0, Data1 ..., lists of scalars get numbered names; what isn't an event gives nothing.
    """
    out: dict[str, str] = {}
    try:
        event = json.loads(text or "")["Event"]
        parts = [event.get("EventData"), event.get("UserData")]
    except (ValueError, KeyError, TypeError, AttributeError):
        return out

    def plain(v: object) -> str:
        return v if isinstance(v, str) else json.dumps(v)

    def item(v: object, unnamed: list[int]) -> None:
        if isinstance(v, dict):
            inner = v.get("#attributes")
            name = v.get("@Name") or (inner.get("Name") if isinstance(inner, dict) else None)
            shown = v.get("#text")
            value = "" if shown is None else plain(shown)
        else:
            name, value = None, plain(v)
        if name is None:
            name = f"Data{unnamed[0]}"
            unnamed[0] += 1
        out[name] = value

    def visit(node: object, unnamed: list[int]) -> None:
        if not isinstance(node, dict):
            return
        for k, v in node.items():
            if k.startswith("@") or k in ("#text", "#attributes") or v is None:
                continue
            if k == "Data":
                for x in v if isinstance(v, list) else [v]:
                    if x is not None:
                        item(x, unnamed)
            elif isinstance(v, dict):
                if "#text" in v:
                    out[k] = "" if v["#text"] is None else plain(v["#text"])
                else:
                    visit(v, unnamed)
            elif isinstance(v, list):
                for i, x in enumerate(v):
                    if isinstance(x, dict):
                        visit(x, unnamed)
                    elif x is not None:
                        out[f"{k}{i}"] = plain(x)
            else:
                out[k] = plain(v)

    unnamed = [0]
    for p in parts:
        visit(p, unnamed)
    return out


T0 = datetime(2023, 11, 14, 22, 13, 20)


def silver(spark, *events):
    """events: (event_id, channel, data, seconds)."""
    rows = [(i, T0 + timedelta(seconds=e[3] if len(e) > 3 else i), e[0], e[1], "test-pc", e[2]) for i, e in enumerate(events)]
    return conform(spark.createDataFrame(rows, "record_id long, ts timestamp_ntz, event_id int, channel string, computer string, data map<string,string>"))


def process(image, command="", parent=""):
    return (1, SYSMON, {"Image": image, "CommandLine": command, "ParentImage": parent})


POSITIVE = {
    "byovd_driver_install": (7045, "System", {"ServiceName": "ZAMGUARD64"}),
    "hvci_registry_tamper": (4657, "Security", {"ObjectName": "\\REGISTRY\\MACHINE\\SYSTEM\\Control\\CI\\Config", "ObjectValueName": "VulnerableDriverBlocklistEnable"}),
    "vss_deletion": (8193, "Application", {}),
    "hyperv_vm_shutdown": (13002, HYPERV, {}),
    "scheduled_task_creation": (4698, "Security", {"TaskName": "\\T"}),
    "qwcrypt_process": process("C:\\x\\RBCW.exe"),
    "ps_qwcrypt_patterns": (4104, POWERSHELL, {"ScriptBlockText": "get-vm | stop"}),
    "webdav_lolbin": process("C:\\Windows\\rundll32.exe", "\\\\h@SSL\\DavWWWRoot\\a.dll"),
    "ransom_note_creation": (11, SYSMON, {"TargetFilename": "C:\\u\\akira_README.txt"}),
    "webclient_service_start": (7036, "System", {"param1": "WebClient", "param2": "running"}),
    "adexplorer_recon": (12, SYSMON, {"TargetObject": "HKCU\\Software\\Sysinternals\\Active Directory Explorer\\EulaAccepted"}),
    "zemana_driver_load": (6, SYSMON, {"ImageLoaded": "C:\\t\\z.sys", "SignatureStatus": "Valid", "Hashes": "SHA1=96a7749d856cb49de32005bcdd8621f38e2b4c05"}),
    "dll_sideload": (7, SYSMON, {"ImageLoaded": "C:\\t\\Srvcli.dll"}),
    "ps_history_wipe": (23, SYSMON, {"TargetFilename": "C:\\u\\ConsoleHost_history.txt"}),
    "rpivot_chisel": process("C:\\t\\c.exe", "client --reverse"),
    "wmi_lateral_movement": (5861, WMI_ACTIVITY, {}),
    "sevenz_staging": process("C:\\7z.exe", "a -mhe x", "C:\\wmiprvse.exe"),
    "fake_browser_task": (140, TASK_SCHEDULER, {"TaskName": "\\GoogleUpdateTaskX"}),
    "workers_dev_dns": (22, SYSMON, {"Image": "C:\\t\\a.exe", "QueryName": "a.workers.dev"}),
    "vssadmin_wmic": process("C:\\vssadmin.exe", "vssadmin DELETE shadows /all"),
    "bcdedit_recovery": process("C:\\bcdedit.exe", "/set RecoveryEnabled No"),
    "wevtutil_cl": process("C:\\wevtutil.exe", "wevtutil cl Security"),
    "defender_disable": (5001, DEFENDER, {}),
    "comsvcs_lsass": (10, SYSMON, {"TargetImage": "C:\\Windows\\lsass.exe"}),
    "rmm_install": (11, SYSMON, {"TargetFilename": "C:\\u\\AnyDesk.exe"}),
    "rdp_enable": (13, SYSMON, {"TargetObject": "HKLM\\x\\fDenyTSConnections", "Details": "DWORD (0x00000000)"}),
    "local_admin_creation": (4732, "Security", {"GroupSid": "S-1-5-32-544"}),
    "smb_admin_share": (5140, "Security", {"ShareName": "\\\\*\\ADMIN$", "IpAddress": "10.0.0.1"}),
    "explorer_lolbin": process("C:\\mshta.exe", "", "C:\\Windows\\explorer.exe"),
}
NEGATIVE = [
    (7045, "Security", {"ServiceName": "zam"}),
    (4657, "Security", {"ObjectName": "\\Other", "ObjectValueName": "VulnerableDriverBlocklistEnable"}),
    (6, SYSMON, {"ImageLoaded": "C:\\Program Files\\Zemana\\z.sys", "SignatureStatus": "Valid", "Hashes": "SHA1=96a7749d856cb49de32005bcdd8621f38e2b4c05"}),
    (7, SYSMON, {"ImageLoaded": "C:\\Windows\\System32\\srvcli.dll"}),
    (22, SYSMON, {"Image": "C:\\chrome.exe", "QueryName": "a.workers.dev"}),
    (11, SYSMON, {"TargetFilename": "C:\\Program Files\\AnyDesk.exe"}),
    (13, SYSMON, {"TargetObject": "HKLM\\x\\fDenyTSConnections", "Details": "DWORD (0x00000001)"}),
    (4732, "Security", {"GroupSid": "S-1-5-32-545"}),
    (5140, "Security", {"ShareName": "\\\\*\\ADMIN$", "IpAddress": "::1"}),
    (7036, "System", {"param1": "WebClient", "param2": "stopped"}),
    (1, "Security", {"Image": "C:\\vssadmin.exe", "CommandLine": "delete shadows"}),
    (10, SYSMON, None),
]


def test_rules(spark):
    assert set(POSITIVE) == {r.name for r in D.RULES}
    found = D.detect_events(silver(spark, *POSITIVE.values())).collect()
    by_record = {}
    for r in found:
        by_record.setdefault(r["record_id"], set()).add(r["kind"])
    assert all(name in by_record.get(i, ()) for i, name in enumerate(POSITIVE)), [n for i, n in enumerate(POSITIVE) if n not in by_record.get(i, ())]
    assert D.detect_events(silver(spark, *NEGATIVE)).count() == 0
    evidence = next(r for r in found if r["kind"] == "workers_dev_dns")["evidence"]
    assert evidence == ["QueryName=a.workers.dev", "Image=C:\\t\\a.exe"]


def kill(at):
    return (1, SYSMON, {"Image": "C:\\taskkill.exe", "CommandLine": "taskkill /F /IM sqlservr.exe"}, at)


@pytest.mark.parametrize(("times", "bursts"), [([0, 2, 4, 6, 8], 1), ([0, 2, 4, 6], 0), ([0, 20, 40, 60, 81], 0), ([0, 20, 40, 50, 60], 1), ([0, 1, 2, 3, 4, 5, 6, 7, 8, 70, 71, 72, 73, 74], 2)])
def test_kill_bursts(spark, times, bursts):
    assert D.detect_bursts(silver(spark, *map(kill, times))).filter("kind = 'taskkill_av_cluster'").count() == bursts


def test_stop_bursts(spark):
    stop = lambda at: (4688, "Security", {"NewProcessName": "C:\\net1.exe", "CommandLine": "net stop GxVss"}, at)
    assert D.detect_all(silver(spark, stop(0), stop(1), stop(2))).filter("kind = 'service_stop_avset'").count() == 1
    assert D.detect_all(silver(spark, stop(0), stop(1))).count() == 0


def greedy(times, width, least):
    """(start, count) of each burst, one hit after the other."""
    out, i = [], 0
    times = sorted(times)
    while i < len(times):
        n = sum(times[i] <= t <= times[i] + width for t in times)
        n -= sum(t == times[i] for t in times[:i])
        if n >= least:
            out.append((times[i], n))
        i += n if n >= least else 1
    return out


def test_long_runs_by_doubling(spark):
    import random

    r = random.Random(9)
    times = {k: [r.randint(0, span) for _ in range(n)] for k, (n, span) in {"dense": (150, 300), "thin": (60, 3000), "ties": (40, 3), "one": (1, 1)}.items()}
    times["gaps"] = [t + 10_000 * (t % 3) for t in times["dense"]]
    rows = [(k, T0 + timedelta(seconds=t), i, 7, "c", f"{k}{i}") for k, ts in times.items() for i, t in enumerate(ts)] + [("one", None, 5, 7, "c", "no time")]
    hits = spark.createDataFrame(rows, "who string, ts timestamp_ntz, record_id long, event_id int, channel string, shown string")
    want = sorted((k, T0 + timedelta(seconds=t), n) for k, ts in times.items() for t, n in greedy(ts, 20, 4))
    found = [clusters.bursts(hits, 20_000_000, 4, ["who"], long_run=x).collect() for x in (0, 50, 1 << 18)]
    for f in found:
        assert sorted((x["who"], x["start_ts"], x["n"]) for x in f) == want
        assert all(len(x["shown"]) == x["n"] and x["shown"][-1] == f"{x['who']}{x['record_id']}" for x in f)
    assert len({repr(sorted(f)) for f in found}) == 1
    everyone = sorted((T0 + timedelta(seconds=t), n) for t, n in greedy([t for ts in times.values() for t in ts], 20, 4))
    for x in (0, 1 << 18):
        assert sorted((b["start_ts"], b["n"]) for b in clusters.bursts(hits, 20_000_000, 4, [], long_run=x).collect()) == everyone


def test_runs_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BUCKETS", 3)
    times = [*range(0, 400, 7), *range(1000, 1100, 9), 5000]
    hits = spark.createDataFrame([(T0 + timedelta(seconds=t), i, 7, "c", "") for i, t in enumerate(times)], "ts timestamp_ntz, record_id long, event_id int, channel string, shown string")
    for x in (0, 1 << 18):
        got = sorted((b["start_ts"], b["n"]) for b in clusters.bursts(hits, 10_000_000, 2, [], long_run=x).collect())
        assert got == sorted((T0 + timedelta(seconds=t), n) for t, n in greedy(times, 10, 2))


def test_hot_logon_ids_are_paired_in_slices(spark):
    import random

    r = random.Random(2)
    events = [(r.choice([4624, 4624, 4634, 4647]), "Security", {"TargetLogonId": "0x3e7" if i % 3 else f"0x{i % 40}"}, r.choice([i, i // 40, 5])) for i in range(400)]
    evt = silver(spark, *events)
    plain = sorted(map(repr, A.logon_sessions(evt, hot_rows=1 << 30).collect()))
    for hot in (7, 50, 200):
        assert sorted(map(repr, A.logon_sessions(evt, hot_rows=hot).collect())) == plain
    host = sorted(map(repr, A.logon_sessions(evt, by_host=True, hot_rows=7).collect()))
    assert host == sorted(map(repr, A.logon_sessions(evt, by_host=True).collect())) and len(plain) > 50


def burst_kinds(spark, image, commands):
    rows = [(1, SYSMON, {"Image": f"C:\\{image}", "CommandLine": c}, i) for i, c in enumerate(commands)]
    return {r["kind"] for r in D.detect_bursts(silver(spark, *rows)).collect()}


def test_bursts_of_listed_names(spark):
    kills = lambda *names: burst_kinds(spark, "taskkill.exe", [f"taskkill /F /IM {n}" for n in names])
    assert kills("thebat.exe", "XFSSVCCON.exe", "masvc", "macmnsvc.exe", '"sqlagent.exe"') == {"taskkill_av_cluster"}
    assert kills("McAfeeFramework.exe", "tomcat9.exe", "HitmanPro.Alert.exe", "mysqld-nt.exe", "sql*") == {"taskkill_av_cluster"}
    assert kills(*["notepadxx.exe", "mynode.exe", "javaw.exe", "superbackup.exe"] * 3) == set()
    assert burst_kinds(spark, "taskkill.exe", ["C:\\backup\\taskkill.exe /im other.exe"] * 6) == set()
    stops = lambda *names: burst_kinds(spark, "net.exe", [f"net stop {n}" for n in names])
    assert stops("SQLBrowser", "MSExchangeSA", "swi_filter") == {"service_stop_avset"}
    assert stops("wbengine", "vss /y", "MSSQL$ANY") == {"service_stop_avset"}
    assert stops('"Veeam Mount Service"', "GxCVD(Instance001)", "SQLTELEMETRY$X") == {"service_stop_avset"}
    assert stops("novss", "myservice1", "vssx", "comms", "snacks") == set()
    assert not {"KILLED_PROCESSES", "STOPPED_SERVICES"} & S.COMPLETE


def test_sessions(spark):
    on = lambda i, at, kind="10": (4624, "Security", {"TargetLogonId": i, "LogonType": kind, "IpAddress": "-"}, at)
    off = lambda i, at: (4634, "Security", {"TargetLogonId": i}, at)
    out = A.logon_sessions(silver(spark, on("a", 0), on("a", 5), off("a", 9), off("a", 12), off("b", 1), on("c", 2), (4634, "Security", {}, 3))).orderBy("logon_id").collect()
    assert [(r["logon_id"], r["duration_secs"], r["logon_type"], r["ip_address"]) for r in out] == [("a", 4, 10, None), ("c", None, 10, None)]


def test_script_blocks(spark):
    part = lambda i, n, text, path=None: (4104, POWERSHELL, {"ScriptBlockId": i, "MessageNumber": n, "ScriptBlockText": text} | ({"Path": path} if path else {}))
    out = {r["script_id"]: r for r in A.script_blocks(silver(spark, part("x", "2", "b"), part("x", "1", "a", "p.ps1"), part("y", None, "only"))).collect()}
    assert (out["x"]["text"], out["x"]["parts"], out["x"]["path"], out["y"]["text"]) == ("ab", 2, "p.ps1", "only")


def test_indicators(spark):
    rows = spark.createDataFrame([(i, f"10.0.0.1 and 127.0.0.1 ü10.0.0.2x {'AB' * 16} C:\\Temp\\a.exe") for i in range(12)], "record_id long, text string").withColumn("ts", F.lit(T0).cast("timestamp_ntz"))
    out = {(r["kind"], r["value"]): r for r in A.indicators(rows, "text").collect()}
    assert set(out) == {("ip_address", "10.0.0.1"), ("md5", "ab" * 16), ("file_path", "C:\\Temp\\a.exe")}
    assert out["ip_address", "10.0.0.1"]["n"] == 12 and out["ip_address", "10.0.0.1"]["record_ids"] == list(range(10))


def test_hunts(spark):
    evt = silver(
        spark,
        (4769, "Security", {"TicketEncryptionType": "0x17"}),
        (4769, "Security", {"TicketEncryptionType": "0x11"}),
        (4768, "Security", {"PreAuthType": "0"}),
        (4662, "Security", {"AccessMask": "0x100"}),
        (5145, "Security", {"ShareName": "\\\\*\\c$"}),
        (5861, WMI_ACTIVITY, None),
        (4702, "Security", {}),
        (10, SYSMON, {"TargetImage": "C:\\LSASS.exe"}),
        (5007, DEFENDER, {}),
    )
    want = {"kerberoast": [0], "asrep": [2], "dcsync": [3], "lateral-smb": [4], "wmi-persistence": [5], "scheduled-task": [6], "lsass-access": [7], "defender-tamper": [8]}
    assert {n: [r["record_id"] for r in X.hunt(evt, n).collect()] for n in X.HUNTS} == want
    with pytest.raises(ValueError):
        X.hunt(evt, "no such")


def test_extractors(spark):
    evt = silver(
        spark,
        (4778, "Security", {"AccountName": "u", "SessionID": "3", "ClientAddress": "10.1.1.1"}),
        (1116, DEFENDER, {"Threat Name": "Bad", "Severity Name": "High", "Path": "p"}),
        (5861, WMI_ACTIVITY, {"ESS": "f", "CONSUMER": "c", "PossibleCause": "x"}),
        (4776, "Security", {"PackageName": "NTLM", "Workstation": "ws", "TargetUserName": "t"}),
        (4688, "Security", {"NewProcessName": "C:\\CertUtil.exe", "NewProcessId": "0x1a", "ProcessId": "0x10"}),
        (1, SYSMON, {"Image": "C:\\x.exe", "ProcessId": "77", "ParentProcessId": "5"}),
        (4624, "Security", {}),
    )
    out = {r["record_id"]: r for r in X.extract_all(evt).collect()}
    assert [out[i]["kind"] for i in range(6)] == ["RdpSession", "Defender", "Wmi", "LateralMovement", "ProcessExecution", "ProcessExecution"] and 6 not in out
    assert (out[0]["session_id"], out[1]["threat_name"], out[2]["filter_name"], out[2]["consumer_name"], out[3]["target_host"]) == (3, "Bad", "f", "c", "ws")
    assert (out[4]["pid"], out[4]["parent_pid"], out[4]["is_lolbin"], out[5]["pid"], out[5]["is_lolbin"]) == (26, 16, True, 77, False)


def test_manifests(spark):
    xml = '<m xmlns="u"><provider guid="{ABC}"><events><event value="7" template="t"/><event value="8" template="none"/></events><templates><template tid="t"><data name="First"/><data name="Second"/></template></templates></provider></m>'
    assert parse_manifest(xml) == {("{abc}", 7): ["First", "Second"]} and parse_manifest("<broken") == {}
    rows = spark.createDataFrame([(7, "ABC", {"Param1": "x", "Param2": "y", "Param3": "z", "Own": "o"}), (9, "ABC", {"Param1": "x"})], "event_id int, provider_guid string, data map<string,string>")
    assert [r["data"] for r in named_fields(rows, parse_manifest(xml)).orderBy("event_id").collect()] == [{"First": "x", "Second": "y", "Param3": "z", "Own": "o"}, {"Param1": "x"}]


def test_manifest_folders(spark, tmp_path):
    """UTF-16, folders below, broken files, the first definition by path; renaming by a join that Spark chooses."""
    made = lambda guid, *events: '<m><provider guid="%s"><events>%s</events><templates>%s</templates></provider></m>' % (
        guid,
        "".join(f'<event value="{i}" template="t{i}"/>' for i, _ in events),
        "".join(f'<template tid="t{i}">' + "".join(f'<data name="{n}"/>' for n in names) + "</template>" for i, names in events),
    )
    (tmp_path / "below").mkdir()
    (tmp_path / "a.man").write_bytes(made("{ABC}", (7, ["First"]), (8, ["Own", "Other"])).encode("utf-16"))
    (tmp_path / "b.man").write_text(made("abc", (7, ["Later"]), (9, ["Nine"])))
    (tmp_path / "below" / "c.man").write_text(made("{def}", (7, [])))
    (tmp_path / "broken.man").write_text("<m><provider")
    (tmp_path / "empty.man").write_text("")
    (tmp_path / "other.txt").write_text(made("{xyz}", (1, ["No"])))
    known = load_manifests(spark, f"file://{tmp_path}")
    assert sorted((r["guid"], r["event_id"], r["fields"]) for r in known.collect()) == [("{abc}", 7, ["First"]), ("{abc}", 8, ["Own", "Other"]), ("{abc}", 9, ["Nine"]), ("{def}", 7, [])]
    events = [(7, "{ABC}", {"Param1": "x"}), (8, "abc", {"Param2": "y", "Param3": "z"}), (7, None, {"Param1": "n"}), (7, "def", {"Param1": "d"}), (5, "abc", None)]
    rows = spark.createDataFrame(events, "event_id int, provider_guid string, data map<string,string>")
    got = named_fields(rows, known).select("event_id", "provider_guid", "data").collect()
    want = [(7, "{ABC}", {"First": "x"}), (8, "abc", {"Other": "y", "Param3": "z"}), (7, None, {"Param1": "n"}), (7, "def", {"Param1": "d"}), (5, "abc", None)]
    plain = lambda rows: sorted(str((i, g, sorted((d or {}).items()))) for i, g, d in rows)
    assert plain(got) == plain(want)


@pytest.mark.parametrize(
    ("event", "flat"),
    [
        ({"EventData": {"Data": [{"@Name": "LogonType", "#text": "10"}]}}, {"LogonType": "10"}),
        ({"EventData": {"Data": [{"#attributes": {"Name": "LogonType"}, "#text": 7}]}}, {"LogonType": "7"}),
        ({"EventData": {"Image": "i", "ProcessId": 4242, "Elevated": True, "Nulled": None}}, {"Image": "i", "ProcessId": "4242", "Elevated": "true"}),
        ({"EventData": {"Data": ["alpha", "beta"]}}, {"Data0": "alpha", "Data1": "beta"}),
        ({"EventData": {"Data": {"@Name": "ServiceName", "#text": "s"}}}, {"ServiceName": "s"}),
        ({"EventData": {"Data": [{"@Name": "TargetSid"}]}}, {"TargetSid": ""}),
        ({"UserData": {"RuleAndFileData": {"PolicyName": "p"}}}, {"PolicyName": "p"}),
        ({"EventData": []}, {}),
    ],
)
def test_flat_json(event, flat):
    assert flat_json(json.dumps({"Event": event})) == flat
    assert flat_json("garbage") == {} and flat_json(None) == {}


def test_fields_in_the_jvm(spark):
    import random

    r = random.Random(6)

    def value(depth):
        kind = r.randint(0, 6 if depth < 4 else 3)
        if kind == 4:
            return [value(depth + 1) if r.random() < 0.5 else r.choice(["i", None, 3]) for _ in range(r.randint(0, 3))]
        if kind >= 5:
            return node(depth + 1)
        return ["t", 7, True, None][kind]

    def node(depth):
        out = {r.choice(["A", "b", "@x", "#text", "#attributes", "Data", "é"]): value(depth) for _ in range(r.randint(0, 4))}
        out |= {"Data": [r.choice([{"@Name": "N", "#text": "v"}, {"#attributes": {"Name": "M"}, "#text": 5}, {"@Name": "", "#text": None}, "plain", None, 1, {"@Name": "O"}]) for _ in range(r.randint(0, 4))]} if r.random() < 0.5 else {}
        return dict(sorted(out.items())) if depth else out

    def plain(x):
        """As a VARIANT has it: keys in order, no list or object where a text is meant."""
        if isinstance(x, dict):
            return {k: plain(v) for k, v in sorted(x.items()) if not (k in ("#text", "@Name") and isinstance(v, (list, dict)))}
        return [plain(v) for v in x if not isinstance(v, list)] if isinstance(x, list) else x

    events = [{"Event": {p: plain(node(0)) for p in r.sample(["EventData", "UserData", "System"], 2)}} for _ in range(300)]
    texts = [json.dumps(e) for e in events] + ["garbage", "[1]", '{"Event": 5}', '{"Event": {"EventData": [1]}}', None]
    got = with_fields(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string"))
    # What stands deeper, or under a name that comes again, must agree too.
    for x in got.collect():
        assert x["data"] == flat_json(x["json"]), x["json"]
    plan = from_json(got.select("json"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_deeper_elements_stay_json(spark):
    tree = {"leaf": "x"}
    for _ in range(20):
        tree = {"a": tree}
    (row,) = with_fields(spark.createDataFrame([(json.dumps({"Event": {"EventData": tree}}),)], "json string")).collect()
    assert list(row["data"]) == ["a"] and json.loads(row["data"]["a"]) and row["data"]["a"].endswith('{"leaf":"x"}}}}}}}}}')


def test_from_json(spark):
    text = json.dumps({"Event": {"System": {"EventID": {"#text": 4624, "#attributes": {"Qualifiers": 0}}, "Computer": "pc", "Provider": {"#attributes": {"Name": "P"}}, "TimeCreated": {"#attributes": {"SystemTime": "2024-01-02T03:04:05.678901Z"}}}, "EventData": {"A": 1}}})
    r = from_json(spark.createDataFrame([(text, 5)], "json string, record_id long")).first()
    assert (r["event_id"], r["computer"], r["provider"], r["ts"], r["data"], r["record_id"]) == (4624, "pc", "P", datetime(2024, 1, 2, 3, 4, 5, 678901), {"A": "1"}, 5)


def test_tracing(spark):
    rows = [("EventLog-Application", True, 0, 1, 4), ("EventLog-Security", False, 0, 1, 4)]
    out = I.tracing_tampering(spark.createDataFrame(rows, "name string, running boolean, events_lost long, log_mode int, buffers int"))
    assert {(r["name"], r["code"]) for r in out.collect()} == {("EventLog-System", "SESSION_MISSING"), ("EventLog-Security", "SESSION_STOPPED")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=cmd", 1, {"k": "v"}), ("a\u202eb", None, None)], "t string, n int, m map<string,string>")
    W.write_csv(df, f"file://{tmp_path}/csv")
    assert {r["t"] for r in spark.read.option("header", "true").option("escape", '"').csv(f"file://{tmp_path}/csv").collect()} == {"'=cmd", "a\u202eb"}
    assert [json.loads(x)["n"] for x in W.json_lines(df)] == [1, None]
    assert "a b" in W.table(df) and W.table(df).endswith("2 records") and W.table(df.limit(0)) == "(no records)"
    edges = spark.createDataFrame([('W"S', "host", 3, 2)], "source string, target string, logon_type int, n long")
    assert W.mermaid_logons(edges).splitlines()[1].strip() == 'W_S -->|"type 3 x2"| host'
    nodes = spark.createDataFrame([(1, 2, 'C:\\a "b".exe'), (3, 4, None)], "ppid int, pid int, image string")
    W.write_mermaid(W.mermaid_processes(nodes), f"file://{tmp_path}/graph")
    assert {r["value"] for r in spark.read.text(f"file://{tmp_path}/graph").collect()} == {'PID_1 --> PID_2["C__a _b_.exe"]', 'PID_3 --> PID_4["_"]'}
    assert "| t | n | m |" in W.markdown_report("R", {"S": df}) and "none" in W.markdown_report("R", {"S": df.limit(0)})


def test_streaming(spark, tmp_path):
    on = lambda at: (4624, "Security", {"TargetLogonId": "a"}, at)
    evt = silver(spark, on(0), (4634, "Security", {"TargetLogonId": "a"}, 7), on(4000))
    evt.write.parquet(f"file://{tmp_path}/silver")
    stream = tail.silver_stream(spark, f"file://{tmp_path}/silver")
    for name, df in (("pairs", tail.logon_pairs(stream)), ("freq", tail.frequency_windows(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp-{name}").start()
        q.processAllAvailable()
        q.stop()
    assert [(r["logon_id"], r["logoff_us"] - r["logon_us"]) for r in spark.table("pairs").collect()] == [("a", 7_000_000)]
    assert {(r["event_id"], r["n"]) for r in spark.table("freq").collect()} == {(4624, 1), (4634, 1)}
    assert SILVER.fieldNames()[0] == "source"


def drained(df, tmp_path, name):
    """Run a stream until all that is there has been worked off; rows so far."""
    q = df.writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}-cp").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.read.schema(df.schema).parquet(f"file://{tmp_path}/{name}").collect()


def test_pairs_of_late_events_and_after_a_restart(spark, tmp_path):
    def more(*events):
        rows = silver(spark, *((k, "Security", {"TargetLogonId": i}, at) for i, k, at in events))
        rows.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/silver")

    def pairs():
        evt = tail.silver_stream(spark, f"file://{tmp_path}/silver")
        return sorted((r["logon_id"], r["logon_us"] // 10**6 - start, r["logoff_us"] // 10**6 - start) for r in drained(tail.logon_pairs(evt, "60 seconds", timedelta(seconds=5000)), tmp_path, "pairs"))

    start = int((T0 - datetime(1970, 1, 1)).total_seconds())
    # The logoff comes before its logon, within the time that is waited for.
    more(("a", 4634, 30), ("b", 4624, 5), ("z", 4624, 50))
    assert pairs() == []
    more(("a", 4624, 10), ("z", 4624, 200))
    assert pairs() == [("a", 10, 30)]
    # After a restart b is still open; what is too late is dropped.
    more(("a", 4624, 20), ("b", 4647, 205), ("z", 4624, 400))
    more(("a", 4634, 390), ("z", 4624, 700))
    assert pairs() == [("a", 10, 30), ("b", 5, 205)]
    # An open logon is forgotten in the end.
    more(("z", 4634, 9000), ("y", 4624, 20000))
    assert pairs() == [("a", 10, 30), ("b", 5, 205)]


def test_burst_alarms_are_the_bursts(spark, tmp_path):
    import random

    r = random.Random(5)
    rows = [(f"pc{r.randint(0, 2)}", T0 + timedelta(seconds=r.randint(0, 900)), i, f"s{i}") for i in range(150)] + [("pc0", T0 + timedelta(seconds=99_999), 999, "end")]
    hits = spark.createDataFrame(rows, "computer string, ts timestamp_ntz, record_id long, shown string")
    want = clusters.bursts(hits.withColumn("event_id", F.lit(1)).withColumn("channel", F.lit("c")), 60_000_000, 4, ["computer"]).collect()
    order = sorted(rows, key=lambda x: x[1] + timedelta(seconds=r.randint(0, 100)))
    for k in range(0, len(order), 40):
        spark.createDataFrame(order[k : k + 40], hits.schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/hits")
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/hits")
    got = drained(tail.burst_alarms(stream, 60_000_000, 4, "1000 seconds"), tmp_path, "alarms")
    assert sorted((x["computer"], x["n"], x["record_id"], x["shown"]) for x in got) == sorted((x["computer"], x["n"], x["record_id"], x["shown"]) for x in want) and len(got) > 5


def test_logs_as_a_stream(spark, tmp_path):
    from logloom.container import binxml, evtx

    (tmp_path / "logs").mkdir()
    system = binxml.Element("System", {}, [binxml.Element("EventID", {}, ["4624"])])
    payload = binxml.encode(binxml.Element("Event", {}, [system]), evtx.RECORDS_AT + 24)
    for i in (1, 2):
        (tmp_path / "logs" / f"{i}.evtx").write_bytes(evtx.write_log([(i, 132_700_000_000_000_000, payload)]))
        got = drained(tail.log_stream(spark, f"file://{tmp_path}/logs").select("record_id", "event_id"), tmp_path, "out")
        assert sorted(map(tuple, got)) == [(k, 4624) for k in range(1, i + 1)]
