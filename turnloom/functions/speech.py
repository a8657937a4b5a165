"""Rules over caption and transcript texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sounds that are not words.
VOCABLES = ("ah", "ba", "baa", "bah", "da", "daa", "duh", "dum", "er", "erm", "hm", "hmm", "huh", "la", "mmm", "na", "oh", "pfft", "uh", "um")
#: Credits that a recogniser makes up, as normalised text, and the rule of each.
CREDITS = {
    "subtitles by the amara org community": "credit_amara_community",
    "transcription by castingwords": "credit_castingwords",
    "transcript emily beynon": "credit_emily_beynon",
    "closed captioning provided by the imperial news network": "credit_imperial_news_network",
    "subtitles by steamteamextra": "credit_steamteamextra",
    "transcription by eso translation by": "credit_eso",
    "transcribed by eso translated by": "credit_eso_variant",
    "closed captioning provided by muhsen": "credit_muhsen",
    "captions by nicosubs": "credit_nicosubs",
    "captions by gettranscribed com": "credit_gettranscribed",
    "captioned by cotter captioning services": "credit_cotter",
    "closed captioning by kris brandhagen com": "credit_kris_brandhagen",
    "subtitles by subtitle workshop": "credit_subtitle_workshop",
    "bf watch tv 2021": "credit_bf_watch_tv",
    "tanya cushman reviewer": "credit_tanya_cushman",
    "tanya cushman reviewer s": "credit_tanya_cushman_variant",
}
#: Topic and pattern, the first that fits names a meeting.
TOPICS = (
    ("Parking", r"parking|car park"),
    ("Staff morale", r"morale|sickness|appraisal"),
    ("IT and systems", r"\bit\b|power|electricity|mainframe"),
    ("Training", r"training|software"),
    ("Finance", r"financial|balance|revenue|black|red"),
    ("Cleanliness", r"cleanliness|kitchen|shower|dishwasher"),
)


def normalized(text: Column) -> Column:
    """Lower-cased letters and digits, everything else one space. Compatibility forms are not folded."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def evidence_text(text: Column) -> Column:
    """Unicode words, lower-cased, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}\p{M}_]+)")), " ")


def stage_direction(text: Column) -> Column:
    return text.rlike(r"(?<![A-Za-z])(?:LAUGHTER|APPLAUSE|CHEERING)(?![A-Za-z])")


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+(?:['’]\p{L}+)*)"))


def content_words(text: Column) -> Column:
    return F.filter(letter_words(text), lambda w: ~w.isin(*VOCABLES))


def worth_embedding(text: Column) -> Column:
    """Whether a text has enough words that are more than sounds or a tune."""
    words, content = F.size(letter_words(text)), F.size(content_words(text))
    tune = text.rlike("[\u266a\u266b]") & (content <= 2)
    sounds = (words >= 4) & ((words - content) * 10 >= words * 6)
    return F.coalesce((content > 0) & ~tune & ~sounds, F.lit(False))


def ellipsis_parts(text: Column) -> Column:
    """Parts that end at an ellipsis with letters or digits on both sides."""
    dots = "(?:\\.{3,}|\u2026)"
    marked = F.regexp_replace(text, f"(?<=[\\p{{L}}\\p{{N}}])([^\\p{{L}}\\p{{N}}]*?{dots})(?=.*[\\p{{L}}\\p{{N}}])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def sentence_case(text: Column) -> Column:
    """The first letter in upper case, unless the one after it already is."""
    at = F.length(F.regexp_extract(text, r"^([^\p{L}]*)", 1)) + 1
    first, second = F.substr(text, at, F.lit(1)), F.substr(text, at + 1, F.lit(1))
    small = (first != F.upper(first)) & ~((second != F.lower(second)) & second.rlike(r"\p{L}"))
    return F.when(small, F.concat(F.substr(text, F.lit(1), at - 1), F.upper(first), F.substr(text, at + 1))).otherwise(text)


def mapped_words(words: Column) -> Column:
    """(word, start, end) of each word in the text that joins them, without a space before closing punctuation."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<word:string,start:int,end:int>>").alias("out"))

    def add(a: Column, w: Column) -> Column:
        gap = F.when((F.size(a["out"]) == 0) | F.substring(w, 1, 1).isin(*".,?!;:%)]}…"), 0).otherwise(1)
        at = a["n"] + gap
        end = at + F.length(w)
        return F.struct(end.alias("n"), F.concat(a["out"], F.array(F.struct(w.alias("word"), at.cast("int").alias("start"), end.cast("int").alias("end")))).alias("out"))

    return F.aggregate(words, start, add, lambda a: a["out"])


def promotional(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"))

    def has(*found: str) -> Column:
        return F.arrays_overlap(words, F.array(*map(F.lit, found)))

    return F.coalesce(has("subscribe") | (has("youtube") & has("like", "watch", "catch", "channel")) | (has("notification") & has("bell")), F.lit(False))


def made_up(text: Column, start_s: Column, media_s: Column, base: float = 0.5) -> Column:
    """Struct of rule, risk, suspicion and verification: the first rule for stock phrases that fits; null if none does."""
    t = normalized(text)
    padded = F.concat(F.lit(" "), t, F.lit(" "))

    def has(words: str) -> Column:
        return F.contains(padded, F.lit(f" {words} "))

    def rule(name: Column, risk: Column, suspicion: Column, verification: Column) -> Column:
        return F.struct(name.alias("rule"), risk.cast("int").alias("risk"), F.greatest(suspicion, F.lit(base)).alias("suspicion"), F.greatest(verification, F.lit(base)).alias("verification"))

    credit = F.create_map(*(F.lit(x) for pair in CREDITS.items() for x in pair))[t]
    alone = t.isin("thanks for watching", "thank you for watching")
    early, late = start_s <= 3, (media_s > 0) & (start_s >= media_s * 0.9)
    watching = rule(F.when(alone, F.lit("thanks_for_watching")).otherwise(F.lit("thanks_for_watching_in_context")), F.when(alone, 85).otherwise(60), F.when(early, 0.82).when(late, 0.60).otherwise(0.72), F.when(early, 0.62).when(late, 0.48).otherwise(0.56))
    named = rule(F.lit("amara_org"), F.lit(60), F.lit(0.80), F.lit(0.65))
    return F.when(credit.isNotNull(), rule(credit, F.lit(100), F.lit(0.90), F.lit(0.70))).when(has("amara") & has("org"), named).when(has("thanks for watching") | has("thank you for watching"), watching).when(has("amara"), rule(F.lit("amara_name"), F.lit(30), F.lit(0.50), F.lit(base)))


def repaired(text: Column) -> Column:
    """Without control characters other than line ends and tabs."""
    return F.regexp_replace(text, "[\u0000-\u0008\u000b\u000c\u000e-\u001f]", "")


def topic(text: Column) -> Column:
    """The first topic whose pattern occurs; null if none does."""
    out = None
    for name, pattern in TOPICS:
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def language_code(value: Column) -> Column:
    """The language's two letters from a code, a regional code or a name; null for others."""
    key = F.regexp_replace(F.lower(F.trim(value)), "_", "-")
    short = F.regexp_extract(key, "^([a-z]{2,3})(?:-[a-z0-9-]+)?$", 1)
    names = {"english": "en", "eng": "en", "german": "de", "deutsch": "de", "deu": "de", "ger": "de", "french": "fr", "francais": "fr", "fra": "fr", "fre": "fr", "spanish": "es", "espanol": "es", "spa": "es"}
    known = F.create_map(*(F.lit(x) for pair in {**names, **{v: v for v in names.values()}}.items() for x in pair))
    return F.coalesce(known[key], known[F.nullif(short, F.lit(""))])


def speaker_of_key(key: Column) -> Column:
    """S3 for speaker3 or s3, else null."""
    n = F.regexp_extract(F.lower(F.trim(key)), "^(?:speaker|s)_?([0-9]+)$", 1)
    return F.when(n != "", F.concat(F.lit("S"), n.cast("int").cast("string")))


def without_fence(text: Column) -> Column:
    """The body of a fenced code block, or the text itself, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```[A-Za-z]*\\s*", ""), "\\s*```$", ""))
