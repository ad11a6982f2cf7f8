"""Rules over metadata columns: signatures, brands, timestamps, generator text, canvas and screen sizes, re-encoding, limiters, disclosure."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known generator names, in order; the ambiguous ones count only in software-naming fields.
AI_SIGNATURES = [
    "midjourney", "stable diffusion", "dall-e", "novelai", "adobe firefly", "comfyui", "civitai", "automatic1111", "invokeai", "fooocus",
    "bing image creator", "imagen", "gemini", "flux", "runway", "kling", "sora", "pika", "luma", "ideogram", "recraft", "magnific",
    "topaz photo ai", "liveportrait", "ic-light",
]
AMBIGUOUS_SIGNATURES = ["imagen", "gemini", "flux", "runway", "kling", "sora", "pika", "luma"]
VIDEO_SIGNATURES = [
    "bytedance", "jimeng", "kling", "kuaishou", "runway", "gen-2", "gen-3", "sora", "openai", "google veo", "veo 2", "veo 3", "deepmind", "luma",
    "dream machine", "pika labs", "hailuo", "minimax", "tongyi", "wanxiang", "hunyuan", "vidu", "shengshu", "pixverse", "movie gen", "moviegen",
    "firefly", "nova reel", "novareel",
]

# Patterns of audio generators, capture tools, editors and libraries in lower-cased text.
AUDIO_GENERATORS = {
    "elevenlabs": r"\beleven[\s_-]?labs\b",
    "suno": r"\bsuno\b",
    "udio": r"\budio\b",
    "stable-audio": r"\bstable[\s_-]audio[\s_-](?:open|2(?:\.\d)?)\b|\bstable-audio\b|\bstableaudio\b|\bstability[\s_]?ai\b",
    "musicgen": r"\b(?:musicgen|audiocraft)\b",
    "riffusion": r"\briffusion\b",
    "coqui-xtts": r"\b(?:xtts|coqui)\b",
    "lyria": r"\blyria\b",
    "openai-voice": r"\bopenai\b.{0,20}\b(?:tts|voice)\b",
    "playht": r"\bplay\.?ht\b",
    "resemble": r"\bresemble[\s._-]?ai\b",
    "cosyvoice": r"\bcosyvoice\b",
    "chattts": r"\bchattts\b",
    "fish-speech": r"\bfish[\s-]?speech\b",
    "cartesia": r"\bcartesia\b",
    "murf": r"\bmurf\b",
    "wellsaid": r"\bwellsaid\b",
}
CAPTURE_TOOLS = {
    "obs": r"\blibobs\b|\bobs[- ]studio\b|\bobs\b", "streamlabs": r"streamlabs", "manycam": r"manycam", "xsplit": r"xsplit", "droidcam": r"droidcam",
    "snap-camera": r"snap camera", "camtasia": r"camtasia", "screenflow": r"screenflow", "quicktime-screen-recording": r"screen ?recording",
}
EDITORS = {
    "premiere": r"premiere", "davinci": r"davinci", "final-cut": r"final cut", "capcut": r"capcut", "kdenlive": r"kdenlive", "handbrake": r"handbrake",
    "shotcut": r"shotcut", "imovie": r"imovie", "filmora": r"filmora", "inshot": r"inshot",
}
LIBRARIES = {
    "libavformat": r"\blavf\d|libavformat", "libavcodec": r"\blavc\d|libavcodec", "ffmpeg": r"ffmpeg", "gpac": r"\bgpac\b|mp4box",
    "apple-coremedia": r"core media",
}

# Camera brands and the tokens that name them, in order.
BRANDS = {
    "apple": ["apple", "iphone", "ipad"],
    "samsung": ["samsung", "sm-", "galaxy"],
    "google": ["google", "pixel"],
    "canon": ["canon", "eos"],
    "nikon": ["nikon"],
    "sony": ["sony", "ilce", "dsc-", "ilme", "zv-"],
    "fujifilm": ["fujifilm", "fuji", "x-t", "gfx"],
    "panasonic": ["panasonic", "dmc-", "dc-"],
    "olympus": ["olympus", "om system", "e-m"],
    "huawei": ["huawei"],
    "xiaomi": ["xiaomi", "redmi"],
    "oneplus": ["oneplus"],
    "leica": ["leica"],
    "dji": ["dji"],
    "gopro": ["gopro"],
}

# Generator canvas sizes, width and height.
CANVAS_SIZES = [
    (512, 512), (768, 768), (1024, 1024), (1024, 1792), (1792, 1024), (896, 1152), (1152, 896), (896, 1200), (1200, 896), (1344, 768), (768, 1344), (1536, 1024), (1024, 1536),
    (1216, 832), (832, 1216), (1408, 704), (704, 1408), (1280, 720), (720, 1280), (1440, 960), (960, 1440), (1920, 1080), (1080, 1920),
]

# Screen sizes, width and height, and the device that has them.
SCREEN_SIZES = [
    (1080, 2400, "Mobile Phone"), (1080, 2340, "Mobile Phone"), (1080, 1920, "Mobile Phone"), (1170, 2532, "Mobile Phone"), (1179, 2556, "Mobile Phone"),
    (1290, 2796, "Mobile Phone"), (1284, 2778, "Mobile Phone"), (1242, 2688, "Mobile Phone"), (828, 1792, "Mobile Phone"), (750, 1334, "Mobile Phone"),
    (1440, 3120, "Mobile Phone"), (1440, 3088, "Mobile Phone"), (1440, 3200, "Mobile Phone"), (720, 1600, "Mobile Phone"), (720, 1560, "Mobile Phone"),
    (2048, 1536, "Tablet"), (2732, 2048, "Tablet"), (2388, 1668, "Tablet"), (2360, 1640, "Tablet"), (2560, 1600, "Tablet / Laptop"), (1920, 1200, "Tablet / Laptop"),
    (2880, 1920, "Tablet / Laptop"), (1920, 1080, "Laptop / Desktop"), (2560, 1440, "Desktop / Laptop"), (3840, 2160, "Desktop"), (1366, 768, "Laptop"),
    (1600, 900, "Laptop / Desktop"), (1280, 720, "Laptop / Monitor"), (2880, 1800, "Laptop"), (3024, 1964, "Laptop"), (3456, 2234, "Laptop"), (2560, 1080, "Desktop"),
    (3440, 1440, "Desktop"),
]

# Re-encoding and reliability limits.
PLATFORM_EDGES = [720, 960, 1080, 1280, 1440, 1600, 2048]
PLATFORM_VIDEO_SIZES = [(1080, 1920), (720, 1280), (1920, 1080), (1280, 720), (640, 360), (854, 480), (480, 854), (360, 640)]
LOSSY_AUDIO = ["mp3", "aac", "ogg", "m4a"]


def _whole_word(name: str) -> str:
    return rf"(?<![a-z0-9]){re.escape(name)}(?![a-z0-9])"


def ai_signature(everywhere: Column, software: Column) -> Column:
    """First known generator named as a whole word; ambiguous short names count only in the software text."""
    anywhere, soft = F.lower(everywhere), F.lower(software)
    out = F
    for name in AI_SIGNATURES:
        out = out.when((soft if name in AMBIGUOUS_SIGNATURES else anywhere).rlike(_whole_word(name)), name)
    return out


def needed_literals(rx: str) -> list[str]:
    """Texts of which each match of the pattern holds at least one; of those that its parse tree offers, the ones whose shortest is longest."""

    def of(tree) -> list[str]:
        options, run = [], ""
        for op, arg in [*tree, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(arg)
                continue
            if run:
                options.append([run])
            run = ""
            if op is _parser.SUBPATTERN:
                options.append(of(arg[3]))
            elif op is _parser.BRANCH:
                ways = [of(way) for way in arg[1]]
                options.append([x for way in ways for x in way] if all(ways) else [])
        return max((o for o in options if o), key=lambda o: min(map(len, o)), default=[])

    return of(_parser.parse(rx))


def holds_pattern(text: Column, rx: str) -> Column:
    """Whether the text matches, in either case. A plain search for what the pattern cannot do without goes first and spares most texts the regex."""
    lower, at_all = F.lower(text), needed_literals(rx)
    hits = [lower.contains(x) for x in at_all]
    return reduce(or_, hits) & text.rlike("(?i)" + rx) if hits else text.rlike("(?i)" + rx)


def first_pattern(text: Column, patterns: dict[str, str]) -> Column:
    out = F
    for name, rx in patterns.items():
        out = out.when(holds_pattern(text, rx), name)
    return out


def all_patterns(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(holds_pattern(text, rx), F.lit(name)) for name, rx in patterns.items()]))


def tools_named(text: Column) -> Column:
    """struct(generator, capture_tools, editors, libraries) named in free text."""
    generators = {name: rf"\b{re.escape(name)}\b" for name in VIDEO_SIGNATURES}
    return F.struct(
        first_pattern(text, generators).alias("video_generator"),
        first_pattern(text, AUDIO_GENERATORS).alias("audio_generator"),
        all_patterns(text, CAPTURE_TOOLS).alias("capture_tools"),
        all_patterns(text, EDITORS).alias("editors"),
        all_patterns(text, LIBRARIES).alias("libraries"),
    )


def _pair(w: Column, h: Column) -> Column:
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(w.cast("bigint").alias("w"), h.cast("bigint").alias("h")))


def _is_size(w: Column, h: Column, sizes: list[tuple[int, int]]) -> Column:
    """Width and height together are one of ``sizes``."""
    return _pair(w, h).isin([_pair(F.lit(a), F.lit(b)) for a, b in sizes])


def canonical_canvas(w: Column, h: Column, has_camera: Column, is_scanned: Column) -> Column:
    """struct(is_canonical, is_square, term): a generator canvas adds 0.45 when there is no camera and no scan."""
    canonical = _is_size(w, h, CANVAS_SIZES)
    square = (w == h) & w.isin(512, 768, 1024, 1536, 2048)
    return F.struct(
        canonical.alias("is_canonical"), square.alias("is_square"), F.when((canonical | square) & ~has_camera & ~is_scanned, 0.45).alias("term")
    )


def screen_device(w: Column, h: Column) -> Column:
    """Device named by the exact size in either orientation, else by aspect band and orientation, else 'None'."""
    table = F.create_map(*[x for a, b, device in SCREEN_SIZES for x in (_pair(F.lit(a), F.lit(b)), F.lit(device))])
    exact = F.coalesce(F.try_element_at(table, _pair(w, h)), F.try_element_at(table, _pair(h, w)))
    ratio = F.greatest(w, h) / F.greatest(F.lit(1.0), F.least(w, h).cast("double"))
    guess = (
        F.when(ratio.between(1.75, 2.35) & (h > w), "Mobile Phone")
        .when((ratio.between(1.25, 1.85) | ratio.between(2.30, 2.45)) & (w > h), "Laptop / Desktop")
        .when(ratio.between(1.30, 1.65), "Tablet")
        .otherwise("None")
    )
    return F.coalesce(exact, guess)


def brand_of(text: Column) -> Column:
    low, out = F.lower(text), F
    for brand, tokens in BRANDS.items():
        hit = low.contains(tokens[0])
        for t in tokens[1:]:
            hit = hit | low.contains(t)
        out = out.when(hit, brand)
    return out


def exif_brand_conflict(make: Column, model: Column, other_tags: list[Column]) -> Column:
    """struct(status, llr): WARN +0.25 when both brands are known and differ, PASS with every tag, INFO otherwise."""
    present = [F.coalesce(make != "", F.lit(False)), F.coalesce(model != "", F.lit(False)), *other_tags]
    any_, all_ = present[0], present[0]
    for p in present[1:]:
        any_, all_ = any_ | p, all_ & p
    conflict = F.coalesce(brand_of(make) != brand_of(model), F.lit(False))
    status = F.when(~any_, "INFO").when(conflict, "WARN").when(all_, "PASS").otherwise("INFO")
    return F.struct(status.alias("status"), F.when(conflict, 0.25).alias("llr"))


def exif_time(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss"))


def timestamp_paradox(original: Column, digitised: Column, modified: Column, gps_date: Column, now: Column) -> Column:
    """struct(status, paradoxes, llr) of timestamps and a GPS date; any paradox is WARN +0.15, no timestamp at all NOT_APPLICABLE."""
    slack, day = F.expr("INTERVAL 60 SECONDS"), F.expr("INTERVAL 1 DAY")
    rows = [
        (digitised < original - slack, "digitised_before_original"),
        (modified < original - slack, "modified_before_original"),
        (original > now + day, "original_in_future"),
        (digitised > now + day, "digitised_in_future"),
        (modified > now + day, "modified_in_future"),
        (F.abs(F.datediff(original, gps_date)) > 1, "gps_date_disagrees"),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rows]))
    none = original.isNull() & digitised.isNull() & modified.isNull() & gps_date.isNull()
    status = F.when(none, "NOT_APPLICABLE").when(F.size(found) > 0, "WARN").otherwise("PASS")
    return F.struct(status.alias("status"), found.alias("paradoxes"), F.when(F.size(found) > 0, 0.15).alias("llr"))


def generator_from_text(fields: Column) -> Column:
    """Generator that text chunks (a map of name to text) declare about themselves, NULL when none."""
    parameters = F.coalesce(F.try_element_at(fields, F.lit("parameters")), F.lit(""))
    markers = sum((F.contains(parameters, F.lit(m)).cast("int") for m in ("Steps:", "Sampler:", "CFG scale:")), F.lit(0))
    nodes = F.from_json(F.try_element_at(fields, F.lit("prompt")), "map<string,string>")
    prompt = F.exists(F.map_values(nodes), lambda v: F.get_json_object(v, "$.class_type").isNotNull())
    workflow = F.array_contains(F.json_object_keys(F.try_element_at(fields, F.lit("workflow"))), "nodes")
    novel = F.lower(F.trim(F.try_element_at(fields, F.lit("Software")))) == "novelai"
    return (
        F.when(markers >= 2, "Stable Diffusion (A1111/Forge)")
        .when(prompt | workflow, "ComfyUI")
        .when(novel, "NovelAI")
        .when(F.map_contains_key(fields, "invokeai_metadata") | F.map_contains_key(fields, "sd-metadata"), "InvokeAI")
    )


def _scored(rows: list[tuple[Column, float, str]]) -> Column:
    """struct(likelihood, level, cues) of additive weighted cues, the sum held to 1 and rounded to two decimals."""
    total = F.lit(0.0)
    for cond, weight, _ in rows:
        total = total + F.when(cond, weight).otherwise(0.0)
    likelihood = F.round(F.least(F.lit(1.0), total), 2)
    cues = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, _, code in rows]))
    level = F.when(likelihood >= 0.6, "HIGH").when(likelihood >= 0.35, "MODERATE").otherwise("LOW")
    return F.struct(likelihood.alias("likelihood"), level.alias("level"), cues.alias("cues"))


def reencode_image(c: dict[str, Column]) -> Column:
    """``c``: is_jpeg, has_camera, w, h, quality (NULL = unknown tables), subsampled."""
    j = c["is_jpeg"]
    return _scored(
        [
            (j & ~c["has_camera"], 0.35, "camera_tags_stripped"),
            (j & F.greatest(c["w"], c["h"]).isin(PLATFORM_EDGES), 0.25, "platform_edge"),
            (j & c["quality"].between(40, 88), 0.25, "standard_tables"),
            (j & c["subsampled"], 0.15, "chroma_subsampled"),
        ]
    )


def reencode_audio(c: dict[str, Column]) -> Column:
    """``c``: format, size_bytes, duration_s, narrowband, band_limited, hires_verdict, lowpass_hz."""
    lossy = c["format"].isin(LOSSY_AUDIO)
    odd = c["hires_verdict"].isin("POSSIBLE_LOSSY_ORIGIN", "UPSAMPLED_FROM_LOWER_RATE")
    return _scored(
        [
            (lossy, 0.30, "lossy_container"),
            (lossy & (c["duration_s"] > 0) & (c["size_bytes"] * 8 / c["duration_s"] / 1000 <= 96.0), 0.25, "low_bitrate"),
            (c["narrowband"], 0.30, "narrowband"),
            (~c["narrowband"] & c["band_limited"], 0.15, "band_limited"),
            (c["format"].isin("wav", "flac") & odd, 0.30, "lossy_origin"),
            ((c["format"] == "mp3") & (c["lowpass_hz"] > 0) & (c["lowpass_hz"] <= 16500), 0.20, "encoder_lowpass"),
        ]
    )


def bits_per_pixel(c: dict[str, Column]) -> Column:
    px = c["w"] * c["h"] * c["fps"] * c["duration_s"]
    return F.when(px > 0, c["size_bytes"] * 8.0 / px).otherwise(0.0)


def reencode_video(c: dict[str, Column]) -> Column:
    """``c``: w, h, fps, duration_s, size_bytes, is_isobmff, faststart, software_encoder, metadata_stripped."""
    bpp = bits_per_pixel(c)
    platform = _is_size(c["w"], c["h"], PLATFORM_VIDEO_SIZES) & ((c["h"] > c["w"]) | _is_size(c["w"], c["h"], [(640, 360), (854, 480)]))
    return _scored(
        [
            ((bpp > 0) & (bpp < 0.05), 0.30, "very_low_bitrate"),
            ((bpp >= 0.05) & (bpp < 0.10), 0.15, "low_bitrate"),
            (platform, 0.20, "platform_size"),
            (c["is_isobmff"] & c["faststart"] & c["software_encoder"], 0.25, "web_export"),
            (c["is_isobmff"] & c["metadata_stripped"], 0.15, "metadata_stripped"),
        ]
    )


def confidence_limiters(rows: list[tuple[Column, str]]) -> Column:
    """struct(level, limiters): NORMAL without any, LOW from three, else REDUCED. Each row is (condition, code)."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rows]))
    level = F.when(F.size(found) == 0, "NORMAL").when(F.size(found) < 3, "REDUCED").otherwise("LOW")
    return F.struct(level.alias("level"), found.alias("limiters"))


def image_limiters(c: dict[str, Column]) -> Column:
    side = F.least(c["w"], c["h"])
    return confidence_limiters(
        [
            ((side > 0) & (side < 256), "low_resolution"), (c["quality"] < 70, "heavy_compression"), (c["reencode"] >= 0.6, "platform_reencode"),
            (c["is_screenshot"], "screenshot"),
        ]
    )


def audio_limiters(c: dict[str, Column]) -> Column:
    return confidence_limiters(
        [
            ((c["duration_s"] > 0) & (c["duration_s"] < 3.0), "very_short"), (c["narrowband"], "narrowband"),
            (~c["narrowband"] & c["band_limited"], "band_limited"), (c["clipping_ratio"] > 0.01, "clipping"), (c["reencode"] >= 0.6, "transcoded"),
        ]
    )


def video_limiters(c: dict[str, Column]) -> Column:
    side, bpp = F.least(c["w"], c["h"]), bits_per_pixel(c)
    return confidence_limiters(
        [
            ((side > 0) & (side < 360), "low_resolution"), ((c["duration_s"] > 0) & (c["duration_s"] < 2.0), "very_short"),
            ((bpp > 0) & (bpp < 0.05), "heavy_compression"), (c["combed"], "combed"),
            (c["cadence"].isin("HEAVY_DUPLICATION", "REGULAR_DUPLICATION", "PULLDOWN_3_2"), "duplicated_frames"), (c["variable_rate"], "variable_frame_rate"),
            (c["reencode"] >= 0.6, "transcoded"),
        ]
    )


def disclosure_findings(media: DataFrame) -> DataFrame:
    """(media_id, check_id, status, severity): three to five advisory rows per media.

    Input: media_id, modality, rights (bool), location (bool), faces (int), speech (bool), ai_pct, labelled (bool).
    """
    c = F.col
    lean = c("ai_pct") >= 60.0

    def row(check: str, status: Column, severity: Column, when: Column | None = None) -> Column:
        s = F.struct(F.lit(check).alias("check_id"), status.alias("status"), severity.alias("severity"))
        return s if when is None else F.when(when, s)

    sound = c("modality") == "audio"
    rows = F.array_compact(
        F.array(
            row("rights_notice", F.lit("INFO"), F.when(c("rights"), "LOW").otherwise("NONE")),
            row("location_privacy", F.when(c("location"), "WARN").otherwise("PASS"), F.when(c("location"), "LOW").otherwise("NONE"), ~sound),
            row("biometric_notice", F.when(c("faces") > 0, "INFO").otherwise("NOT_APPLICABLE"), F.when(c("faces") > 0, "MEDIUM").otherwise("NONE"), ~sound),
            row("voice_biometric_notice", F.when(c("speech"), "INFO").otherwise("NOT_APPLICABLE"), F.when(c("speech"), "MEDIUM").otherwise("NONE"), sound),
            row(
                "ai_disclosure_label", F.when(~lean, "NOT_APPLICABLE").when(c("labelled"), "PASS").otherwise("WARN"),
                F.when(lean & ~c("labelled"), "LOW").otherwise("NONE"),
            ),
            row("synthetic_voice_advisory", F.when(lean & c("speech"), "WARN").otherwise("NOT_APPLICABLE"), F.when(lean & c("speech"), "LOW").otherwise("NONE"), sound),
        )
    )
    return media.select("media_id", F.explode(rows).alias("r")).select("media_id", "r.*")
