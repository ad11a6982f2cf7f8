"""Which generator a file declares: cue rows, ranked shares, and a name only for what the file itself declares."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

# Catalogue keys in order, per modality.
IMAGE_GENERATORS = [
    "google_imagen", "midjourney", "openai_dalle3", "flux1", "stable_diffusion", "topaz_photo_ai", "ideogram2", "recraft_v3", "magnific_ai",
    "adobe_firefly", "canva", "leonardo_ai", "grok_imagine", "google_nano_banana", "bytedance_seedream", "tencent_hunyuan_image",
    "alibaba_qwen_image", "kuaishou_kolors", "openai_gpt_image", "remini",
]
AUDIO_GENERATORS = [
    "elevenlabs", "cosyvoice", "chat_tts", "suno_ai", "udio", "openai_voice", "google_gemini_audio", "meta_audiocraft", "hume_ai", "cartesia", "playht",
    "resemble_ai", "coqui_xtts",
]
VIDEO_GENERATORS = [
    "bytedance_seedance", "kuaishou_kling", "openai_sora", "runway_gen", "google_veo", "luma_dream_machine", "pika", "minimax_hailuo", "alibaba_wan",
    "tencent_hunyuan", "vidu", "pixverse", "meta_movie_gen", "adobe_firefly_video", "amazon_nova_reel",
]

# Fixed values: (whole words in the software text, generator, weight), first match wins.
IMAGE_SOFTWARE = [
    (["midjourney"], "midjourney", 1.2),
    (["dall-e", "dalle"], "openai_dalle3", 1.2),
    (["stable diffusion", "automatic1111", "comfyui"], "stable_diffusion", 1.2),
    (["ideogram"], "ideogram2", 1.5),
    (["recraft"], "recraft_v3", 1.5),
    (["magnific"], "magnific_ai", 1.5),
    (["firefly"], "adobe_firefly", 1.5),
    (["leonardo"], "leonardo_ai", 1.5),
    (["grok", "xai"], "grok_imagine", 1.5),
    (["nano banana", "gemini 2.5 flash image"], "google_nano_banana", 1.5),
    (["seedream"], "bytedance_seedream", 1.5),
    (["hunyuan"], "tencent_hunyuan_image", 1.5),
    (["qwen"], "alibaba_qwen_image", 1.5),
    (["kolors"], "kuaishou_kolors", 1.5),
    (["gpt-image", "gpt image"], "openai_gpt_image", 1.5),
    (["remini"], "remini", 1.5),
]

# Native output sizes (width, height) per generator.
IMAGE_SIZES = {
    "google_imagen": [(896, 1152), (896, 1200), (896, 1184), (864, 1232), (1792, 2368), (1024, 1024), (928, 1120), (717, 947), (1280, 896), (896, 1280)],
    "midjourney": [(1024, 1024), (1456, 816), (816, 1456), (1792, 1024), (1024, 1792)],
    "openai_dalle3": [(1024, 1024), (1792, 1024), (1024, 1792)],
    "flux1": [(1024, 1024), (1344, 768), (768, 1344), (1216, 832), (832, 1216)],
    "stable_diffusion": [(512, 512), (768, 768), (1024, 1024), (1152, 896), (896, 1152)],
    "ideogram2": [(1024, 1024), (1280, 720), (720, 1280), (1440, 960), (960, 1440)],
    "recraft_v3": [(1024, 1024), (1820, 1024), (1024, 1820)],
    "magnific_ai": [(2048, 2048), (4096, 4096)],
    "adobe_firefly": [(2048, 2048), (1792, 1024), (1024, 1792)],
}

# Words in audio metadata and vendor strings in video containers, first match wins.
AUDIO_WORDS = [
    (["elevenlabs", "eleven labs"], "elevenlabs"), (["suno"], "suno_ai"), (["udio"], "udio"), (["lyria"], "google_gemini_audio"),
    (["audiocraft", "musicgen", "voicebox"], "meta_audiocraft"), (["hume"], "hume_ai"), (["cartesia", "sonic"], "cartesia"),
    (["play.ht", "playht"], "playht"), (["resemble ai", "resemble.ai", "resembleai"], "resemble_ai"), (["coqui", "xtts"], "coqui_xtts"),
    (["realtime api", "advanced voice mode"], "openai_voice"),
]
VIDEO_VENDORS = [
    (["bytedance", "jimeng"], "bytedance_seedance"), (["kling", "kuaishou"], "kuaishou_kling"), (["runway", "gen-2", "gen-3"], "runway_gen"),
    (["sora", "openai"], "openai_sora"), (["veo", "deepmind"], "google_veo"), (["luma", "dream machine"], "luma_dream_machine"), (["pika"], "pika"),
    (["hailuo", "minimax"], "minimax_hailuo"), (["tongyi", "wanxiang"], "alibaba_wan"), (["hunyuan"], "tencent_hunyuan"), (["vidu", "shengshu"], "vidu"),
    (["pixverse"], "pixverse"), (["movie gen", "moviegen"], "meta_movie_gen"), (["firefly"], "adobe_firefly_video"),
    (["nova reel", "novareel"], "amazon_nova_reel"),
]
VENDOR_WEIGHT = 0.85
FLOOR = 0.05
NAMING_SHARE = 0.25


def _word(text: Column, names: list[str]) -> Column:
    """Whether one of the names stands in the lower-cased text as a word. The plain search spares most texts the regex."""
    alternatives = "|".join(re.escape(n) for n in names)
    return reduce(or_, [text.contains(n) for n in names]) & text.rlike(rf"(?<![a-z0-9])(?:{alternatives})(?![a-z0-9])")


# Taxonomy states of a camera capture; such an image gets no generator.
AUTHENTIC_STATES = ["AUTHENTIC_REAL_PHOTOGRAPH", "AUTHENTIC_RECAPTURED_SCREEN", "AUTHENTIC_SCREENSHOT", "AUTHENTIC_EDITED"]


def _chain(conditions: list[tuple[Column, str]]) -> list[tuple[Column, str]]:
    """The conditions made exclusive: the first that holds wins."""
    out, before = [], F.lit(False)
    for cond, key in conditions:
        out.append((cond & ~before, key))
        before = before | cond
    return out


def _rows(df: DataFrame, cues: list[tuple[Column, str, float]], declared: bool) -> DataFrame:
    """Cue rows (media_id, model_key, weight, declared) of the cues that hold."""
    each = [F.when(cond, F.struct(F.lit(key).alias("model_key"), F.lit(float(weight)).alias("weight"))) for cond, key, weight in cues]
    return _unpacked(df, F.array_compact(F.array(*each)), declared)


def _first_named(df: DataFrame, cues: list[tuple[Column, str]]) -> DataFrame:
    """The cue row of the first condition that holds; no row when none does."""
    first = F
    for cond, key in cues:
        first = first.when(cond, F.struct(F.lit(key).alias("model_key"), F.lit(VENDOR_WEIGHT).alias("weight")))
    return _unpacked(df, F.array(first), True)


def _unpacked(df: DataFrame, held: Column, declared: bool) -> DataFrame:
    # explode_outer keeps Spark from evaluating the whole array of cues once more as a filter.
    return df.select("media_id", F.explode_outer(held).alias("c")).where("c IS NOT NULL").select("media_id", "c.*", F.lit(declared).alias("declared"))


def _image_cues() -> tuple[list[tuple[Column, str, float]], list[tuple[Column, str, float]]]:
    """What an image declares, and what its signals suggest."""
    soft, tool = F.lower(F.coalesce("software", F.lit(""))), F.lower(F.coalesce("creator_tool", F.lit("")))
    w, h = C("w").cast("int"), C("h").cast("int")
    weights = {key: weight for _, key, weight in IMAGE_SOFTWARE}
    declared = [
        (C("watermark"), "google_imagen", 1.2), (C("ai_label"), "google_imagen", 1.5),
        (soft.contains("topaz photo ai") | tool.contains("topaz"), "topaz_photo_ai", 1.5), (soft.contains("canva") | tool.contains("canva"), "canva", 1.5),
        *[(cond, key, weights[key]) for cond, key in _chain([(_word(soft, names), key) for names, key, _ in IMAGE_SOFTWARE])],
    ]

    def canvas(sizes: list[tuple[int, int]]) -> Column:
        out = F.lit(False)
        for x, y in sizes:
            out = out | (w == x) & (h == y) | (w == y) & (h == x)
        return out

    signals = [
        (C("c2pa_present"), "openai_dalle3", 0.35), (C("c2pa_present"), "google_imagen", 0.30), (C("c2pa_present"), "adobe_firefly", 0.40),
        *[(canvas(sizes), key, 0.25) for key, sizes in IMAGE_SIZES.items()],
        (C("slope_alpha") < 1.65, "midjourney", 0.25), (C("slope_alpha") < 1.65, "flux1", 0.20), (C("slope_alpha") > 2.30, "stable_diffusion", 0.20),
        (C("smoothness") < 2.0, "openai_dalle3", 0.15), (C("is_art"), "google_imagen", 0.40), (C("is_art"), "openai_dalle3", 0.20), (C("is_art"), "midjourney", 0.15),
    ]
    return declared, signals


def audio_declared(tags: DataFrame) -> DataFrame:
    """Cue rows of what recordings declare. Input: media_id, tag_text, one row per metadata value; each value counts."""
    tags, text = tags.withColumn("_text", F.lower(F.coalesce("tag_text", F.lit("")))), C("_text")
    spoken = [(_word(text, names), key) for names, key in AUDIO_WORDS]
    spoken.insert(4, (_word(text, ["gemini"]) & _word(text, ["audio"]), "google_gemini_audio"))
    spoken.append((_word(text, ["gpt-4o"]) & _word(text, ["voice"]), "openai_voice"))
    return _first_named(tags, spoken)


def audio_signals(media: DataFrame) -> DataFrame:
    """Cue rows of signals. Input: one row per recording: media_id, has_vocoder_cutoff, cutoff_hz, spectral_flatness, silence_ratio."""
    low = C("has_vocoder_cutoff") & C("cutoff_hz").between(7200, 8200)
    high = C("has_vocoder_cutoff") & C("cutoff_hz").between(15000, 16500)
    flat, quiet = C("spectral_flatness") < 0.002, C("silence_ratio") > 0.12
    cues = [
        (low, "elevenlabs", 0.35), (low, "cosyvoice", 0.30), (high, "elevenlabs", 0.40), (flat, "elevenlabs", 0.20), (flat, "openai_voice", 0.20),
        (quiet, "elevenlabs", 0.15), (quiet, "chat_tts", 0.25),
    ]
    return _rows(media, cues, False)


def video_declared(tags: DataFrame) -> DataFrame:
    """Cue rows of what clips declare. Input: media_id, vendor_text, one row per container string; each string counts."""
    tags, text = tags.withColumn("_text", F.lower(F.coalesce("vendor_text", F.lit("")))), C("_text")
    named = []
    for names, key in VIDEO_VENDORS:
        hit = F.lit(False)
        for n in names:
            hit = hit | text.contains(n)
        named.append((hit, key))
    return _first_named(tags, named)


def video_signals(media: DataFrame) -> DataFrame:
    """Cue rows of signals. Input: one row per clip: media_id, c2pa_present, motion_variance, has_flicker."""
    wild, calm = C("motion_variance") > 140.0, (C("motion_variance") > 5.0) & (C("motion_variance") < 30.0)
    cues = [
        (C("c2pa_present"), "openai_sora", 0.45), (C("c2pa_present"), "google_veo", 0.35), (wild, "luma_dream_machine", 0.25), (wild, "runway_gen", 0.20),
        (calm, "bytedance_seedance", 0.20), (calm, "google_veo", 0.20), (C("has_flicker"), "pika", 0.25), (C("has_flicker"), "kuaishou_kling", 0.20),
    ]
    return _rows(media, cues, False)


def _named(df: DataFrame, weights: Column, declared_keys: Column, catalogue: list[str]) -> DataFrame:
    """The rank from the array of cue weights by catalogue position and the array of declared keys, within the row."""
    keys = F.array(*[F.lit(k) for k in catalogue])
    x = df.select("media_id", weights.alias("weights"), F.coalesce(declared_keys, F.array().cast("array<string>")).alias("declared_keys"))
    total = F.aggregate("weights", F.lit(FLOOR * len(catalogue)), lambda acc, v: acc + v)
    ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct((-(F.get("weights", i) + FLOOR) / total).alias("share"), i.alias("at"), k.alias("key"))))
    declared = F.size("declared_keys") > 0
    x = x.withColumn("ranked", F.when(declared, ranked))
    x = x.withColumn("best", F.get(F.filter("ranked", lambda r: F.array_contains(C("declared_keys"), r["key"])), F.lit(0)))
    share = F.round(-C("best.share") + 1e-9, 2)
    top = F.transform(F.slice("ranked", 1, 3), lambda r: F.concat(r["key"], F.lit("="), F.format_number(F.round(-r["share"] + 1e-9, 2), 2)))
    return x.select(
        "media_id", F.when(declared & (-C("best.share") >= NAMING_SHARE), C("best.key")).otherwise("unknown").alias("model_key"),
        F.when(declared, share).otherwise(0.0).alias("confidence"), F.when(declared, top).otherwise(F.array().cast("array<string>")).alias("top_candidates"),
    )


def image_attribution(images: DataFrame) -> DataFrame:
    """(media_id, model_key, confidence, top_candidates) of images, row by row without a shuffle.

    Input: media_id, taxonomy_state, software, creator_tool, watermark, ai_label, c2pa_present, w, h, slope_alpha, smoothness, is_art. A camera
    state has the key ``none_authentic`` and no candidates, whatever the file declares.
    """
    declared, signals = _image_cues()
    by_key = {k: [F.when(cond, float(weight)).otherwise(0.0) for cond, key, weight in declared + signals if key == k] for k in IMAGE_GENERATORS}
    weights = F.array(*[sum(by_key[k][1:], by_key[k][0]) if by_key[k] else F.lit(0.0) for k in IMAGE_GENERATORS])
    named = {k: [cond for cond, key, _ in declared if key == k] for k in IMAGE_GENERATORS}
    said = [F.when(F.coalesce(F.greatest(*(c.cast("int") for c in [*conds, F.lit(False)])) == 1, F.lit(False)), F.lit(k)) for k, conds in named.items() if conds]
    camera = F.coalesce(C("taxonomy_state").isin(AUTHENTIC_STATES), F.lit(False))
    ranked = _named(images.where(~camera), weights, F.array_compact(F.array(*said)), IMAGE_GENERATORS)
    none = images.where(camera).select(
        "media_id", F.lit("none_authentic").alias("model_key"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("top_candidates")
    )
    return ranked.unionByName(none)


def attribution_rank(media: DataFrame, cues: DataFrame, catalogue: list[str]) -> DataFrame:
    """(media_id, model_key, confidence, top_candidates) of recordings or clips, from cue rows (media_id, model_key, weight, declared).

    Cues are summed per (media, generator) before they are gathered, so at most one entry per catalogue key is gathered per media. A
    generator is named only when the file declares it with a share of at least a quarter; without a declaration the candidates are withheld.
    """
    summed = cues.groupBy("media_id", "model_key").agg(F.sum("weight").alias("w"), F.bool_or("declared").alias("d"))
    packed = summed.groupBy("media_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model_key", "w"))).alias("by_key"), F.collect_set(F.when(C("d"), C("model_key"))).alias("declared_keys")
    )
    weights = F.array(*[F.coalesce(F.try_element_at("by_key", F.lit(k)), F.lit(0.0)) for k in catalogue])
    return _named(media.select("media_id").join(packed, "media_id", "left"), weights, C("declared_keys"), catalogue)
