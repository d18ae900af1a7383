"""Scalar functions on columns: paths, numbers written as text, addresses, PowerShell, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values ----
LOGON_TYPES = {
    0: "System",
    2: "Interactive",
    3: "Network",
    4: "Batch",
    5: "Service",
    7: "Unlock",
    8: "NetworkCleartext",
    9: "NewCredentials",
    10: "RemoteInteractive",
    11: "CachedInteractive",
    12: "CachedRemoteInteractive",
    13: "CachedUnlock",
}
FAILURE_CODES = {
    "C000005E": "No logon servers available",
    "C0000064": "User name does not exist",
    "C000006A": "Wrong password",
    "C000006D": "Bad username or authentication info",
    "C000006E": "Account restriction",
    "C000006F": "Logon outside authorized hours",
    "C0000070": "Unauthorized workstation",
    "C0000071": "Password expired",
    "C0000072": "Account disabled",
    "C00000DC": "SAM server in wrong state",
    "C0000133": "Clocks out of sync",
    "C000015B": "User not granted logon type",
    "C000018C": "Trust relationship failure",
    "C0000192": "Netlogon service not started",
    "C0000193": "Account expired",
    "C0000224": "Password must change at next logon",
    "C0000225": "Windows bug — not a risk",
    "C0000234": "Account locked out",
}
LOLBINS = ("wscript.exe", "cscript.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe", "certutil.exe", "msiexec.exe", "bitsadmin.exe", "forfiles.exe", "pcalua.exe")
# Word edges are those of ASCII, so that Java and RE2 agree on texts in any language.
_EDGE_L, _EDGE_R = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
IPV4 = rf"{_EDGE_L}(?:{_OCTET}\.){{3}}{_OCTET}{_EDGE_R}"
SHA256 = rf"{_EDGE_L}[0-9a-fA-F]{{64}}{_EDGE_R}"
SHA1 = rf"{_EDGE_L}[0-9a-fA-F]{{40}}{_EDGE_R}"
MD5 = rf"{_EDGE_L}[0-9a-fA-F]{{32}}{_EDGE_R}"
FILE_PATH = r'[A-Za-z]:\\[^\s"<>|?*\x00-\x1f]{2,}'
# ---- End of fixed values ----


def lookup(key: Column, table: dict, default: str | None = None) -> Column:
    """The value of key in a small constant table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def logon_type_name(code: Column) -> Column:
    return lookup(code.cast("int"), LOGON_TYPES, "Unknown")


def failure_reason(code: Column) -> Column:
    """What an NTSTATUS sub-status means, written with or without 0x and in any case; null if unknown."""
    return lookup(F.upper(F.regexp_replace(F.trim(code), "^0[xX]", "")), FAILURE_CODES)


def basename(path: Column) -> Column:
    """The lower-cased part after the last slash or backslash."""
    return F.lower(F.regexp_extract(path, r"([^\\/]*)$", 1))


def is_lolbin(path: Column) -> Column:
    return F.coalesce(basename(path).isin(*LOLBINS), F.lit(False))


def first_field(data: Column, *names: str) -> Column:
    """The first of several fields that is there."""
    return F.coalesce(*[data[n] for n in names])


def hex_number(text: Column) -> Column:
    """A number in hex with any 0x before it; 0 if it isn't one."""
    digits = F.regexp_replace(F.trim(text), "^(0[xX])+", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(digits, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def decimal_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def unusable_address(a: Column) -> Column:
    return a.isNull() | F.trim(a).isin("", "-", "::1", "127.0.0.1")


def logon_source(logon_type: Column, workstation: Column, ip: Column) -> Column:
    """Where a logon came from: for remote desktops the address, else the workstation and then the address."""
    address = F.when(~unusable_address(ip), ip)
    host = F.when(~(workstation.isNull() | F.trim(workstation).isin("", "-")), workstation)
    return F.when(logon_type == 10, address).otherwise(F.coalesce(host, address))


def decoded_command(text: Column) -> Column:
    """The command in the first decodable -EncodedCommand (or -enc, -ec, -en) argument; null without one.

    Base64 of UTF-16LE; an odd last byte is dropped, and what is malformed doesn't stop the query.
    """
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    # Lists of one item hold what would else be made anew for each token.
    flags = F.get(F.transform(F.array(tokens), lambda ts: F.transform(ts, lambda t, i: F.when((i > 0) & F.lower(F.get(ts, i - 1)).isin("-encodedcommand", "-enc", "-ec", "-en"), t))), 0)
    raw = F.filter(F.transform(F.filter(flags, lambda t: t.isNotNull()), lambda t: F.try_to_binary(t, F.lit("base64"))), lambda b: b.isNotNull())
    return F.get(F.transform(F.slice(raw, 1, 1), _wide_text), 0)


def _wide_text(b: Column) -> Column:
    """Bytes as UTF-16LE; half a pair is a replacement character."""
    units = F.regexp_replace(F.hex(b), "(....)", "$1 ")
    lone = "..D[89AB] (?!..D[C-F] )|(?<!..D[89AB] )..D[C-F] "
    return F.decode(F.unhex(F.regexp_replace(F.regexp_replace(units, lone, "FDFF "), " (..$)?|^..$", "")), "UTF-16LE")


def normal_guid(guid: Column) -> Column:
    """Lower case in braces."""
    return F.concat(F.lit("{"), F.lower(F.regexp_replace(F.trim(guid), r"^\{|\}$", "")), F.lit("}"))


def guarded_cell(text: Column) -> Column:
    """Text for CSV that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def ntfs_serial(vbr: Column) -> Column:
    """Volume serial (hex, as written) of an NTFS boot sector in hex; null for others."""
    h = F.upper(vbr)
    le = F.concat(*[F.substring(h, (0x48 + i) * 2 + 1, 2) for i in reversed(range(8))])
    return F.when(valid_hex(vbr) & (F.substring(h, 7, 16) == "4E54465320202020"), le)


def fat_serial(vbr: Column) -> Column:
    """Volume serial (hex) of a FAT32, FAT16 or FAT12 boot sector in hex; null for others."""
    h = F.upper(vbr)
    at = lambda o: F.concat(*[F.substring(h, (o + i) * 2 + 1, 2) for i in reversed(range(4))])
    fat32 = F.substring(h, 0x52 * 2 + 1, 10) == "4641543332"
    fat16 = F.substring(h, 0x36 * 2 + 1, 6) == "464154"
    return F.when(valid_hex(vbr), F.when(fat32, at(0x43)).when(fat16, at(0x27)))


def valid_hex(text: Column) -> Column:
    return text.rlike("^([0-9A-Fa-f]{2})+$")


def number(content: Column, at: int, size: int) -> Column:
    """A little-endian unsigned number of up to 4 bytes, or 8 as decimal(20,0), in bytes."""
    h = F.hex(F.substring(content, at + 1, size))
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(turned, 16, 10).cast("long" if size <= 4 else "decimal(20,0)")


def number_bytes(n: Column, size: int) -> Column:
    """A number as little-endian bytes, the counterpart of number()."""
    h = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 17 - 2 * i, 2) for i in range(1, size + 1)]))


def overlaid(content: Column, at: int, over: Column, size: int) -> Column:
    """Bytes with others of that size laid over them at an offset."""
    return F.concat(F.substring(content, 1, at), over, F.substring(content, at + size + 1, (1 << 31) - 1))
