"""Lookups and parsed texts around a job: voices, media probes, caption styles, scene cuts, speaker maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions import text as T


def voices(catalog: DataFrame) -> DataFrame:
    """(language, name, voice) of catalogues (content): JSON of language to display name to voice."""
    by_lang = catalog.select(F.explode(F.from_json("content", "map<string, map<string, string>>")).alias("language", "v"))
    return by_lang.select("language", F.explode("v").alias("name", "voice"))


def search_voices(rows: DataFrame, query: str, language: str | None = None, first: tuple[str, ...] = ("zh", "en")) -> DataFrame:
    """Voices whose name or id holds the query, in any case; languages in `first` lead, then by language and name."""
    hit = F.contains(F.lower("name"), F.lit(query.lower())) | F.contains(F.lower("voice"), F.lit(query.lower()))
    rows = rows.where(hit & (F.col("language") == language if language else F.lit(True)))
    rank = F.coalesce(*(F.when(F.col("language").startswith(x), i) for i, x in enumerate(first)), F.lit(len(first)))
    return rows.orderBy(rank, "language", "name")


def normalize_voices(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """voice by aliases (provider, alias, target), whatever its case; others stay. aliases is a small table of its own."""
    keyed = aliases.select("provider", F.lower("alias").alias("_alias"), F.col("target").alias("_target")).dropDuplicates(["provider", "_alias"])
    joined = rows.withColumn("_alias", F.lower(F.trim("voice"))).join(keyed, ["provider", "_alias"], "left")
    return joined.withColumn("voice", F.coalesce("_target", "voice")).drop("_alias", "_target")


def speaker_map(texts: DataFrame) -> DataFrame:
    """(provider, speaker, voice) of JSON texts (content): provider to speaker to voice; blanks are left out."""
    rows = texts.select(F.explode(F.from_json("content", "map<string, map<string, string>>")).alias("provider", "v")).select("provider", F.explode("v").alias("speaker", "voice"))
    rows = rows.select(F.lower(F.trim("provider")).alias("provider"), F.trim("speaker").alias("speaker"), F.trim("voice").alias("voice"))
    return rows.where("provider <> '' and speaker <> '' and voice <> ''")


def media_probe(texts: DataFrame) -> DataFrame:
    """duration_s, bitrate_kbps, video and audio properties from what a media tool prints (track_id, content)."""
    part = lambda pattern, k=1: F.nullif(F.regexp_extract("content", pattern, k), F.lit(""))
    clock = r"Duration:\s*([0-9]+):([0-9]+):([0-9.]+)"
    seconds = part(clock, 1).try_cast("double") * 3600 + part(clock, 2).try_cast("double") * 60 + part(clock, 3).try_cast("double")
    audio = F.regexp_extract_all("content", F.lit(r"Stream #[0-9]+:[0-9]+(?:\[[^\]]*\])?(?:\(([a-z]*)\))?: Audio"), F.lit(1))
    return texts.select(
        "track_id",
        seconds.alias("duration_s"),
        part(r"bitrate:\s*([0-9]+) kb/s").try_cast("long").alias("bitrate_kbps"),
        part(r"Video:\s*([A-Za-z0-9]+)").alias("video_codec"),
        part(r"Video:.*?([0-9]{2,5})x([0-9]{2,5})", 1).try_cast("int").alias("width"),
        part(r"Video:.*?([0-9]{2,5})x([0-9]{2,5})", 2).try_cast("int").alias("height"),
        part(r"([0-9.]+)\s*fps").try_cast("double").alias("fps"),
        part(r"Audio:\s*([A-Za-z0-9]+)").alias("audio_codec"),
        audio.alias("audio_languages"),
    )


def ass_styles(texts: DataFrame) -> DataFrame:
    """(track_id, play_res_x, play_res_y, style): each Style row as a map by the names of its Format row."""
    size = lambda k, d: F.coalesce(F.nullif(F.regexp_extract("content", rf"(?m)^{k}:\s*([0-9]+)", 1), F.lit("")).try_cast("int"), F.lit(d))
    names = F.transform(F.split(F.regexp_extract("content", r"(?m)^Format:\s*(Name,.*)$", 1), ","), lambda x: F.trim(x))
    rows = texts.withColumns({"play_res_x": size("PlayResX", 384), "play_res_y": size("PlayResY", 288), "_names": names})
    rows = rows.select("track_id", "play_res_x", "play_res_y", "_names", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^Style:\s*(.*)$"), F.lit(1))).alias("_s"))
    values = F.transform(F.split("_s", ","), lambda x: F.trim(x))
    return rows.where(F.size(F.split("_s", ",")) == F.size("_names")).select("track_id", "play_res_x", "play_res_y", F.map_from_arrays("_names", values).alias("style"))


def scene_shots(cuts: DataFrame, min_shot_s: float = 0.0) -> DataFrame:
    """(track_id, shot, start_s, end_s) of tracks (track_id, cuts, duration_s).

    Cuts near the ends, or less than min_shot_s behind the one kept before, are left out, and the last if what follows
    is too short. A track's cuts are one short list, folded in place.
    """
    inner = F.filter(F.array_sort(F.array_distinct("cuts")), lambda t: (t > 0.05) & (t < F.col("duration_s") - 0.05))
    before = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(0.0))
    kept = F.aggregate(inner, F.array().cast("array<double>"), lambda acc, t: F.when(t - before(acc) >= min_shot_s, F.concat(acc, F.array(t))).otherwise(acc))
    rows = cuts.withColumn("_k", kept)
    short = (F.size("_k") > 0) & (F.col("duration_s") - before(F.col("_k")) < min_shot_s)
    rows = rows.withColumn("_k", F.when(short, F.slice("_k", 1, F.greatest(F.size("_k") - 1, F.lit(0)))).otherwise(F.col("_k")))
    ends = F.concat(F.array(F.lit(0.0)), F.col("_k"), F.array("duration_s"))
    pairs = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.struct(F.element_at(ends, i).alias("a"), F.element_at(ends, i + 1).alias("b")))
    return rows.select("track_id", F.posexplode(pairs).alias("shot", "p")).select("track_id", "shot", F.col("p.a").alias("start_s"), F.col("p.b").alias("end_s"))


def mirror_runs(shots: DataFrame, seed: int = 0) -> DataFrame:
    """Seeded mirror flags of shots, equal neighbours merged: (track_id, start_s, end_s) of the mirrored stretches."""
    flag = F.pmod(F.xxhash64(F.lit(seed), "track_id", "shot"), F.lit(2)) == 1
    order = Window.partitionBy("track_id").orderBy("shot")
    rows = shots.withColumn("_f", flag).withColumn("_new", (~F.col("_f").eqNullSafe(F.lag("_f").over(order))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_f").groupBy("track_id", "_run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("_run")


def timing_preset(speed: Column, duck: Column, preset: str = "balanced") -> tuple[Column, Column]:
    """Speed limit and background gain of a preset: natural at most 1.25, strict at least 2.0 with gain at most 0.12."""
    if preset == "natural":
        return F.least(speed, F.lit(1.25)), duck
    if preset == "strict":
        return F.greatest(speed, F.lit(2.0)), F.least(duck, F.lit(0.12))
    return speed, duck


def by_suffix(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Files (path, modificationTime) of the given suffixes, sorted by lower-case name."""
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    return files.where(F.regexp_extract(name, r"\.([^.]*)$", 1).isin(*(s.lower().lstrip(".") for s in suffixes))).orderBy(name)


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", "modificationTime").alias("path"))


def lines_of(texts: DataFrame, width: int) -> DataFrame:
    """Text (track_id, seg_idx, text) in as few lines of at most width units as words allow, nearly equal in length.

    A wide character counts two units; words are put in lines by the rounded share of the text before them.
    """
    units = lambda x: F.length(x) + F.regexp_count(x, F.lit("[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦]"))
    word = F.regexp_extract_all("text", F.lit(r"[⺀-鿿가-힯]|[^\s⺀-鿿가-힯]+\s*"), F.lit(0))
    rows = texts.select("track_id", "seg_idx", "text", F.posexplode(word).alias("k", "w")).withColumn("_u", units(F.col("w")))
    row = Window.partitionBy("track_id", "seg_idx")
    rows = rows.withColumns({"_all": F.sum("_u").over(row), "_upto": F.sum("_u").over(row.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_all") / width)))
    rows = rows.withColumn("line", F.least(F.floor((F.col("_upto") - F.col("_u") / 2) * F.col("_n") / F.col("_all")), F.col("_n") - 1))
    parts = rows.groupBy("track_id", "seg_idx", "line").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), "")).alias("t"))
    return parts.groupBy("track_id", "seg_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))


#: Codes of languages by service, in the order google, bing, deeplx; None where the service has none.
LANGUAGE_CODES = {
    "simplified_chinese": ("zh-CN", "zh-Hans", "zh-Hans"), "traditional_chinese": ("zh-TW", "zh-Hant", "zh-Hant"),
    "english": ("en", "en", "en"), "english_us": ("en", "en", "en-US"), "english_uk": ("en", "en", "en-GB"),
    "japanese": ("ja", "ja", "ja"), "korean": ("ko", "ko", "ko"), "cantonese": ("yue", "yue", None), "thai": ("th", "th", None), "vietnamese": ("vi", "vi", None),
    "indonesian": ("id", "id", "id"), "malay": ("ms", "ms", None), "tagalog": ("tl", "fil", None),
    "french": ("fr", "fr", "fr"), "german": ("de", "de", "de"), "spanish": ("es", "es", "es"), "spanish_latam": ("es", "es", None), "russian": ("ru", "ru", "ru"),
    "portuguese": ("pt", "pt", "pt"), "portuguese_br": ("pt", "pt", "pt-BR"), "portuguese_pt": ("pt", "pt-PT", "pt-PT"), "italian": ("it", "it", "it"),
    "dutch": ("nl", "nl", "nl"), "polish": ("pl", "pl", "pl"), "turkish": ("tr", "tr", "tr"), "greek": ("el", "el", "el"), "czech": ("cs", "cs", "cs"),
    "swedish": ("sv", "sv", "sv"), "danish": ("da", "da", "da"), "finnish": ("fi", "fi", "fi"), "norwegian": ("no", "nb", "nb"), "hungarian": ("hu", "hu", "hu"),
    "romanian": ("ro", "ro", "ro"), "bulgarian": ("bg", "bg", "bg"), "ukrainian": ("uk", "uk", "uk"), "arabic": ("ar", "ar", "ar"), "hebrew": ("he", "he", None), "persian": ("fa", "fa", None),
}
SERVICES = ("google", "bing", "deeplx")


def language_code(language: Column, service: Column) -> Column:
    """The code that a translation service has for a language; simplified Chinese where it has none."""
    entries = [(f"{s}:{name}", codes[i]) for i, s in enumerate(SERVICES) for name, codes in LANGUAGE_CODES.items() if codes[i]]
    table = F.create_map(*(F.lit(x) for e in entries for x in e))
    return F.coalesce(F.try_element_at(table, F.concat(service, F.lit(":"), language)), F.try_element_at(table, F.concat(service, F.lit(":simplified_chinese"))), F.lit("zh-CN"))


def presets_for(rows: DataFrame, provider: str) -> DataFrame:
    """Presets of a provider, and those without one."""
    return rows.where(T.is_blank(F.col("provider")) | (F.lower("provider") == provider.lower()))


def voice_problems(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (provider, voice) with problem where the provider doesn't have the voice, or there is none; known: (provider, voice)."""
    own = known.select("provider", "voice").distinct().withColumn("_known", F.lit(True))
    out = rows.join(own, ["provider", "voice"], "left")
    return out.withColumn("problem", F.when(T.is_blank(F.col("voice")), "no voice").when(F.col("_known").isNull(), F.concat(F.lit("unknown voice: "), "voice"))).drop("_known")


def replace_provider(maps: DataFrame, provider: str, voices_: dict[str, str]) -> DataFrame:
    """maps (voices: provider to speaker to voice) with one provider's part replaced."""
    own = F.create_map(*(F.lit(x) for e in voices_.items() for x in e)) if voices_ else F.create_map().cast("map<string,string>")
    rest = F.map_filter("voices", lambda k, _: k != provider.lower())
    return maps.withColumn("voices", F.map_concat(rest, F.create_map(F.lit(provider.lower()), own)))
