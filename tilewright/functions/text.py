"""Labels, names and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names, file extensions, characters that file names may not hold.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
FORMATS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp"}
BAD_IN_NAMES = r'[<>:"/\\|?*]'


def format_bytes(n: Column) -> Column:
    kb, mb = n / 1024.0, n / 1048576.0
    return (
        F.when(n.isNull(), "—")
        .when(n < 0, "0 B")
        .when(n < 1024, F.concat(F.floor(n + 0.5).cast("string"), F.lit(" B")))
        .when(kb < 1000, F.concat(F.floor(kb + 0.5).cast("string"), F.lit(" KB")))
        .when(mb < 10, F.format_string("%.1f MB", mb))
        .when(mb < 1000, F.concat(F.floor(mb + 0.5).cast("string"), F.lit(" MB")))
        .otherwise(F.format_string("%.1f GB", mb / 1024))
    )


def format_dimensions(w: Column, h: Column) -> Column:
    side = lambda v: F.coalesce(F.format_number(v, 0), F.lit("?"))
    return F.concat(side(w), F.lit(" × "), side(h))


def format_megapixels(w: Column, h: Column) -> Column:
    return F.coalesce(F.format_string("%.1f MP", w * h / 1e6), F.lit("—"))


def format_zoom(z: Column) -> Column:
    pct = z * 100
    one = F.floor(pct * 10 + 0.5) / 10
    return F.concat(F.when(pct >= 10, F.floor(pct + 0.5).cast("string")).when(one == F.floor(one), F.floor(one).cast("string")).otherwise(F.format_string("%.1f", one)), F.lit("%"))


def period_label(period: Column) -> Column:
    """"2026-11" as "November 2026"; anything else as it is."""
    year, month = F.get(F.split(period, "-"), F.lit(0)), F.get(F.split(period, "-"), F.lit(1)).try_cast("int")
    name = F.get(F.array(*map(F.lit, MONTHS)), month - 1)
    return F.when((year != "") & name.isNotNull(), F.concat_ws(" ", name, year)).otherwise(period)


def preset_label(scale: Column, mode: Column) -> Column:
    return F.concat(scale.cast("string"), F.lit("× · "), F.upper(F.substring(mode, 1, 1)), F.substring(mode, 2, 100))


def dimensions_label(status: Column, w: Column, h: Column, out_w: Column, out_h: Column) -> Column:
    out = format_dimensions(out_w, out_h)
    unknown = F.when(out_w > 0, F.concat(F.lit("→ "), out)).otherwise("—")
    return F.when(status == "failed", "no output").when((w == 0) | (out_w == 0), unknown).otherwise(F.concat(format_dimensions(w, h), F.lit(" → "), out))


def meter_line(counted: Column, remaining: Column, limit: Column, period: Column) -> Column:
    """The month as one line (fixed values: the three texts)."""
    whole, month = limit.cast("string"), period_label(period)
    return (
        F.when(~counted, F.concat(F.lit("The free plan allows "), whole, F.lit(" enhancements a month — one internet connection sets this month’s count up")))
        .when(remaining <= 0, F.concat(F.lit("All "), whole, F.lit(" free enhancements used in "), month))
        .otherwise(F.concat(remaining.cast("string"), F.lit(" of "), whole, F.lit(" free enhancements left in "), month))
    )


def display_name(path: Column) -> Column:
    last = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.when(last == "", path).otherwise(last)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column, default: str = "image") -> Column:
    """The file's name without its last extension; a leading dot begins no extension."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    bare = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    return F.when(bare == "", default).otherwise(bare)


def format_of(ext: Column) -> Column:
    """The format a known extension names, else null."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.try_element_at(table, F.lower(ext))


def safe_stem(stem: Column, default: str) -> Column:
    clean = F.regexp_replace(F.trim(F.regexp_replace(stem, BAD_IN_NAMES, "_")), r"^\.+|\.+$", "")
    return F.when(clean == "", default).otherwise(clean)


def year_month(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def machine_id(identity: Column) -> Column:
    return F.substring(F.sha2(identity, 256), 1, 32)


def network_id(salt: Column, address: Column) -> Column:
    """Null if either is empty."""
    return F.when((salt != "") & (address != ""), F.concat(F.lit("iph"), F.substring(F.sha2(F.concat(salt, F.lit("|"), address), 256), 1, 40)))


def first_address(direct: Column, forwarded: Column) -> Column:
    return F.coalesce(direct, F.trim(F.get(F.split(forwarded, ","), F.lit(0))))


def clean_log(message: Column) -> Column:
    return F.substring(F.regexp_replace(message, r"\p{Cntrl}", ""), 1, 2000)


def without_space(pasted: Column) -> Column:
    """White space of every script taken out."""
    return F.regexp_replace(pasted, r"\p{IsWhite_Space}", "")


def key_parts(key: Column, prefix: str) -> dict[str, Column]:
    """A pasted licence key: whether it has its prefix and two segments that are not empty, and the decoded payload."""
    bare = without_space(key)
    parts = F.split(F.substring(bare, len(prefix) + 1, 1 << 20), r"\.")
    ok = bare.startswith(prefix) & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    body = F.translate(F.get(parts, F.lit(0)), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    return {"ok": ok, "payload": F.when(ok, F.decode(F.unbase64(padded), "UTF-8"))}


def parse_endpoint(url: Column) -> dict[str, Column]:
    """scheme, host, port, path and an error: only https, or http to this machine."""
    scheme = F.regexp_extract(url, r"^([^:]*)://", 1)
    rest = F.regexp_extract(url, r"^[^:]*://(.*)$", 1)
    authority = F.get(F.split(rest, "/"), F.lit(0))
    has_port = authority.rlike(r"^.+:[^:]*$")
    port = F.when(has_port, F.regexp_extract(authority, r":([^:]*)$", 1).try_cast("int")).otherwise(F.when(scheme == "https", 443).otherwise(80))
    host = F.when(has_port, F.regexp_extract(authority, r"^(.+):[^:]*$", 1)).otherwise(authority)
    path = F.when(F.instr(rest, "/") > 0, F.concat(F.lit("/"), F.regexp_extract(rest, r"^[^/]*/(.*)$", 1))).otherwise("/")
    error = (
        F.when(~url.contains("://"), "missing scheme").when(~scheme.isin("http", "https"), "bad scheme").when(port.isNull() | (port < 1) | (port > 65535), "bad port")
        .when(host == "", "empty host").when((scheme == "http") & ~host.isin("localhost", "127.0.0.1", "[::1]"), "plain http")
    )
    return {"host": host, "port": port, "path": path, "error": error}
