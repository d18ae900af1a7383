import base64

import pytest
from pyspark.sql import functions as F

from logloom.functions import columns as C


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("path", "name"), [("C:\\Windows\\CMD.exe", "cmd.exe"), ("/usr/bin/Env", "env"), ("plain.EXE", "plain.exe"), ("", "")])
def test_basename(spark, path, name):
    assert one(spark, C.basename(F.col("p")), p=path) == name


@pytest.mark.parametrize(("text", "value"), [("0x1f", 31), ("1F", 31), ("0x0x10", 16), ("zz", 0), (None, 0), ("", 0)])
def test_hex(spark, text, value):
    assert one(spark, C.hex_number(F.col("p")), p=text) == value


@pytest.mark.parametrize(
    ("kind", "host", "ip", "source"),
    [(10, "WS", "10.0.0.1", "10.0.0.1"), (10, "WS", "-", None), (3, "WS", "10.0.0.1", "WS"), (3, "-", "10.0.0.1", "10.0.0.1"), (3, "-", "::1", None), (3, None, "127.0.0.1", None), (3, "", "1.2.3.4", "1.2.3.4")],
)
def test_logon_source(spark, kind, host, ip, source):
    assert one(spark, C.logon_source(F.col("k"), F.col("h"), F.col("i")), k=kind, h=host, i=ip) == source


def encoded(text):
    return base64.b64encode(text.encode("utf-16-le")).decode()


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        (f"powershell -enc {encoded('whoami /all')}", "whoami /all"),
        (f"powershell  -EncodedCommand   {encoded('Grüße 日本')} -x", "Grüße 日本"),
        ("powershell -enc ???", None),
        (f"powershell -enc !! -ec {encoded('second')}", "second"),
        (f"powershell -e {encoded('no')}", None),
        ("nothing", None),
        (None, None),
    ],
)
def test_decoded_command(spark, text, plain):
    assert one(spark, C.decoded_command(F.col("p")), p=text) == plain


@pytest.mark.parametrize("raw", [b"", b"a", b"a\x00b", b"\x3d\xd8\x00\xdea\x00", b"\x00\xdea\x00\x3d\xd8", b"\x3d\xd8\x3d\xd8\x00\xde\x00\xde1", b"\xff\xfea\x00\x00\x00\x0a\x00b\x00", bytes(range(256))])
def test_decoded_bytes(spark, raw):
    text = f"powershell -enc {base64.b64encode(raw).decode()}"
    assert one(spark, C.decoded_command(F.col("p")), p=text) == (raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace") if raw else None)


def test_long_command(spark):
    # The text is looked at once, not once for each of its characters.
    plain = "Get-Item Grüße; " * 20_000
    assert one(spark, C.decoded_command(F.col("p")), p=f"{plain} powershell -enc {base64.b64encode(plain.encode('utf-16-le')).decode()}") == plain


def test_names(spark):
    assert one(spark, C.logon_type_name(F.col("p")), p=10) == "RemoteInteractive"
    assert one(spark, C.logon_type_name(F.col("p")), p=6) == "Unknown"
    assert one(spark, C.failure_reason(F.col("p")), p="0xc000006a") == "Wrong password"
    assert one(spark, C.failure_reason(F.col("p")), p="C0FFEE") is None
    assert one(spark, C.normal_guid(F.col("p")), p=" {ABC-D} ") == "{abc-d}"
    assert one(spark, C.guarded_cell(F.col("p")), p="=1+1") == "'=1+1"
    assert one(spark, C.guarded_cell(F.col("p")), p="safe") == "safe"


def test_volume_serials(spark):
    ntfs = bytearray(512)
    ntfs[3:11], ntfs[0x48:0x50] = b"NTFS    ", (0x36B08F15B08EDAAF).to_bytes(8, "little")
    fat32 = bytearray(512)
    fat32[0x52:0x57], fat32[0x43:0x47] = b"FAT32", (0x12345678).to_bytes(4, "little")
    fat16 = bytearray(512)
    fat16[0x36:0x39], fat16[0x27:0x2B] = b"FAT", (0x9ABCDEF0).to_bytes(4, "little")
    assert one(spark, C.ntfs_serial(F.col("p")), p=ntfs.hex()) == "36B08F15B08EDAAF"
    assert one(spark, C.fat_serial(F.col("p")), p=fat32.hex()) == "12345678"
    assert one(spark, C.fat_serial(F.col("p")), p=fat16.hex()) == "9ABCDEF0"
    assert one(spark, C.ntfs_serial(F.col("p")), p="xyz") is None
