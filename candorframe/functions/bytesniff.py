"""Byte-level checks over a binary content column: container format, out-of-scope formats, foreign signatures, declared length.

Everything is a JVM expression over the whole content; nothing is decoded. Select only the columns that are needed before calling these, so
that the scan reads ``content`` once and carries it no further.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to declared format, per modality, and formats that count as one family.
IMAGE_FORMATS = {
    ".jpg": "jpeg", ".jpeg": "jpeg", ".jpe": "jpeg", ".jfif": "jpeg", ".png": "png", ".gif": "gif", ".webp": "webp", ".bmp": "bmp",
    ".tif": "tiff", ".tiff": "tiff", ".svg": "svg",
}
AUDIO_FORMATS = {
    ".wav": "wav", ".mp3": "mp3", ".aac": "aac", ".flac": "flac", ".ogg": "ogg", ".oga": "ogg", ".opus": "ogg", ".m4a": "m4a", ".aif": "aiff",
    ".aiff": "aiff",
}
VIDEO_FORMATS = {".mp4": "mp4", ".m4v": "mp4", ".mov": "mov", ".avi": "avi", ".mkv": "mkv", ".webm": "mkv", ".3gp": "mp4"}
HEIF_BRANDS = [b"ftypheic", b"ftypheix", b"ftypmif1", b"ftypavif", b"ftyphevc", b"ftypmsf1"]

# How formats show themselves: use, name, and parts (offset, one of these bytes; none: the byte is there) that must all hold.
SIGNATURES = [
    ("image", "jpeg", (0, [b"\xff\xd8\xff"])),
    ("image", "png", (0, [b"\x89PNG\r\n\x1a\n"])),
    ("image", "gif", (0, [b"GIF87a", b"GIF89a"])),
    ("image", "webp", (0, [b"RIFF"]), (8, [b"WEBP"])),
    ("image", "bmp", (0, [b"BM"])),
    ("image", "tiff", (0, [b"II*\x00", b"MM\x00*"])),
    ("image", "heif", (4, HEIF_BRANDS)),
    ("audio", "wav", (0, [b"RIFF"]), (8, [b"WAVE"])),
    ("audio", "flac", (0, [b"fLaC"])),
    ("audio", "ogg", (0, [b"OggS"])),
    ("audio", "aiff", (0, [b"FORM"]), (8, [b"AIFF", b"AIFC"])),
    ("audio", "m4a", (4, [b"ftyp"])),
    ("audio", "midi", (0, [b"MThd"])),
    ("audio", "mp3", (0, [b"ID3"])),
    ("video", "mov", (4, [b"ftyp"]), (8, [b"qt  "])),
    ("video", "mp4", (4, [b"ftyp"]), (11, None)),
    ("video", "mkv", (0, [b"\x1a\x45\xdf\xa3"])),
    ("video", "avi", (0, [b"RIFF"]), (8, [b"AVI "])),
    ("ordinary", "still", (0, [b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF8", b"BM"])),
    ("ordinary", "sound or clip", (0, [b"RIFF", b"OggS", b"fLaC", b"\x1aE\xdf\xa3", b"ID3"])),
    ("ordinary", "base media", (4, [b"ftyp"])),
    ("other", "FITS", (0, [b"SIMPLE  ="])),
    ("other", "DICOM", (128, [b"DICM"])),
    ("other", "OpenEXR", (0, [b"\x76\x2f\x31\x01"])),
    ("other", "HDF5", (0, [b"\x89HDF\r\n\x1a\n"])),
    ("other", "NetCDF", (0, [b"CDF\x01", b"CDF\x02", b"CDF\x05"])),
    ("other", "AEDAT", (0, [b"#!AER-DAT"])),
    ("other", "MIDI", (0, [b"MThd"])),
]
# Signatures of other file types inside media: name, only in trailing bytes, marks that must all be there.
FOREIGN = [
    ("ZIP", False, [b"PK\x03\x04", b"PK\x05\x06"]),
    ("PDF", False, [b"%PDF-"]),
    ("PE executable", False, [b"This program cannot be run in DOS mode"]),
    ("ELF executable", True, [b"\x7fELF"]),
    ("RAR", True, [b"Rar!\x1a\x07"]),
    ("7z", True, [b"7z\xbc\xaf\x27\x1c"]),
]
ACTIVE_MARKUP = r"<(?:script|html)[\s/>]|<\?php\s"

# Credential markers; one of eight characters or more counts alone, a shorter one only next to the box tag.
CREDENTIAL_MARKERS = [
    "urn:c2pa", "c2pa", "c2ma", "c2cs", "application/c2pa", "image/jumd", "http://c2pa.org", "c2pa.claim", "c2pa.assertion",
]
CREDENTIAL_BOX = "jumb"


def raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def starts(content: Column, data: bytes, at: int = 0) -> Column:
    return F.substring(content, at + 1, len(data)) == raw(data)


def any_start(content: Column, options: list[bytes], at: int = 0) -> Column:
    out = starts(content, options[0], at)
    for o in options[1:]:
        out = out | starts(content, o, at)
    return out


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def declared_format(path: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


def named(content: Column, use: str) -> Column:
    """The first format of a use whose signature the content shows, NULL for none."""
    out = F
    for where, name, *parts in SIGNATURES:
        if where == use:
            shown = F.lit(True)
            for at, options in parts:
                shown = shown & (any_start(content, options, at) if options else F.length(content) > at)
            out = out.when(shown, name)
    return out


def _is_svg(content: Column) -> Column:
    """Markup is looked for in the first 2,048 characters after a byte order mark and white space, however long these are."""
    head = F.lower(F.substring(F.regexp_replace(latin1(content), "^[ï»¿ \\t\\r\\n]+", ""), 1, 2048))
    return head.startswith("<?xml") | head.contains("<svg")


def _byte(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("bigint")


def _mpeg_audio(content: Column) -> Column:
    """A bare MPEG or ADTS frame: eleven sync bits, and the layer bits tell which."""
    second = _byte(content, 1)
    frame = starts(content, b"\xff") & (second.bitwiseAND(0xE0) == 0xE0)
    return F.when(frame, F.when(second.bitwiseAND(0xF6) == 0xF0, "aac").otherwise("mp3"))


def sniff_image(content: Column) -> Column:
    return F.coalesce(named(content, "image"), F.when(_is_svg(content), "svg"), F.lit("unknown"))


def sniff_audio(content: Column) -> Column:
    return F.coalesce(named(content, "audio"), _mpeg_audio(content), F.lit("unknown"))


def sniff_video(content: Column) -> Column:
    return F.coalesce(named(content, "video"), F.lit("unknown"))


def format_audit(content: Column, path: Column, modality: str) -> Column:
    """struct(declared, detected, status, severity) of the true container against the extension."""
    sniff, table = {"image": (sniff_image, IMAGE_FORMATS), "audio": (sniff_audio, AUDIO_FORMATS), "video": (sniff_video, VIDEO_FORMATS)}[modality]
    detected, declared = sniff(content), declared_format(path, table)
    if modality == "video":
        same = (detected == declared) | (detected.isin("mp4", "mov") & declared.isin("mp4", "mov"))
    elif modality == "audio":
        same = (detected == declared) | (detected.isin("mp3", "aac") & declared.isin("mp3", "aac"))
    else:
        same = detected == declared
    heif = F.lit(modality == "image") & (detected == "heif") & declared.isin("jpeg", "png")
    unknown = (declared == "unknown") | (detected == "unknown")
    status = F.when(unknown, "INFO").when(heif, "WARN").when(same, "PASS").otherwise("WARN")
    severity = F.when(unknown | heif, "LOW").when(same, "NONE").otherwise("MEDIUM")
    return F.struct(declared.alias("declared"), detected.alias("detected"), status.alias("status"), severity.alias("severity"))


def out_of_scope(content: Column) -> Column:
    """Name of a scientific, medical or symbolic format, NULL for ordinary media, whose magic bytes win over any stray tag."""
    return F.when(named(content, "ordinary").isNull(), named(content, "other"))


def scan_polyglot(content: Column, trailing: Column | None = None) -> Column:
    """Sorted names of foreign signatures in the content; those marked so only in the bytes after the media payload."""
    found = [F.when(F.lower(latin1(content)).rlike(ACTIVE_MARKUP), F.lit("HTML/Script"))]
    for name, only_trailing, marks in FOREIGN:
        where = trailing if only_trailing else content
        if where is not None:
            held = F.lit(True)
            for mark in marks:
                held = held & F.contains(where, raw(mark))
            found.append(F.when(held, F.lit(name)))
    return F.sort_array(F.array_compact(F.array(*found)))


def extract_xmp(content: Column) -> Column:
    """The first XMP packet as text, empty when there is none; one without an end tag is held to 256 KiB."""
    text = latin1(content)
    first, second = F.locate("<x:xmpmeta", text), F.locate("<?xpacket", text)
    start = F.when(first > 0, first).otherwise(second)
    end = F.locate("</x:xmpmeta>", F.substr(text, F.greatest(start, F.lit(1))))
    length = F.when(end > 0, end + len("</x:xmpmeta>") - 1).otherwise(262144)
    packet = F.make_valid_utf8(F.substr(content, F.greatest(start, F.lit(1)), length).cast("string"))
    return F.when(start > 0, packet).otherwise("")


def content_credentials(content: Column) -> Column:
    """struct(present, markers): credential markers anywhere in the content; presence only, nothing is verified."""
    found = F.array_compact(F.array(*[F.when(F.contains(content, raw(m.encode())), F.lit(m)) for m in CREDENTIAL_MARKERS]))
    distinctive = F.exists(found, lambda m: F.length(m) >= 8)
    boxed = F.contains(content, raw(CREDENTIAL_BOX.encode())) & (F.size(found) > 0)
    return F.struct((distinctive | boxed).alias("present"), found.alias("markers"))


def _u32(content: Column, at: int) -> Column:
    return _byte(content, at) + _byte(content, at + 1) * 256 + _byte(content, at + 2) * 65536 + _byte(content, at + 3) * 16777216


def trailing_bytes(content: Column) -> Column:
    """struct(format, declared_end, trailing, status) for WAV, AVI, WebP and BMP headers.

    A WAV or AVI size of 0 or 0xFFFFFFFF declares no end.
    """
    riff = starts(content, b"RIFF")
    fmt = (
        F.when(riff & starts(content, b"WAVE", 8), "wav")
        .when(riff & starts(content, b"AVI ", 8), "avi")
        .when(riff & starts(content, b"WEBP", 8), "webp")
        .when(starts(content, b"BM"), "bmp")
    )
    size = _u32(content, 4)
    open_end = fmt.isin("wav", "avi") & size.isin(0, 0xFFFFFFFF)
    end = F.when(fmt == "bmp", _u32(content, 2)).when(fmt.isNotNull() & ~open_end, size + 8)
    extra = F.octet_length(content) - end
    status = F.when(end.isNull(), "NOT_APPLICABLE").when(extra < 0, "WARN_TRUNCATED").when(extra <= 1, "PASS").otherwise("WARN_TRAILING")
    return F.struct(fmt.alias("format"), end.alias("declared_end"), extra.alias("trailing"), status.alias("status"))
