"""Names, slugs and messages as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a log message says of its agent, first match first in any case of letters, and the agent of any other message.
AGENTS = [
    ("Parsing intent", "intent"),
    ("Building world contract", "contract"),
    ("Planning .* scenario", "scenarios"),
    ("repair|violate|dropping .* scenario", "validator"),
    ("Compiling prompts", "compiler"),
    ("Generating canvas|start frame|Visual anchors", "canvas"),
]
OTHER_AGENT = "pipeline"

# Words of a prompt and the skill they stand for, and the skill where there is no vocabulary at all.
SKILL_WORDS = {
    "pick": "grasp", "picking": "grasp", "grab": "grasp", "grasp": "grasp",
    "lift": "lift", "lower": "lower", "place": "place", "put": "place",
    "push": "push", "pull": "pull", "open": "open", "close": "close",
    "pour": "pour", "wave": "reach", "waves": "reach", "reach": "reach",
    "walk": "walk", "walking": "walk", "turn": "turn", "rotate": "rotate",
    "press": "press", "wipe": "wipe", "cut": "cut", "fold": "fold",
    "hold": "hold", "insert": "insert", "remove": "remove", "release": "release",
}
NO_SKILL = "idle"


def episode_id(source: Column, index: Column) -> Column:
    return F.format_string("%s_%06d", source, index)


def slug(value: Column, most: int = 80, default: str = "item") -> Column:
    """Runs of other characters than letters, digits, _ and - as one _; none at the ends."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), 1, most)
    return F.when(s == "", default).otherwise(s)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def titleize(value: Column) -> Column:
    """A scenario's id without its number; underscores as spaces, the first letter in upper case."""
    s = F.trim(F.regexp_replace(F.regexp_replace(value, "^sc_?[0-9]+_?", ""), "[_-]+", " "))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def normal(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[_-]", " "))


def terms(value: Column, least: int = 3) -> Column:
    """Distinct words of ``least`` letters and more, in order."""
    return F.array_distinct(F.filter(F.split(normal(value), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


def agent_of(message: Column) -> Column:
    out = F
    for pattern, agent in AGENTS:
        out = out.when(message.rlike(f"(?i){pattern}"), agent)
    return out.otherwise(OTHER_AGENT)


def level_of(message: Column) -> Column:
    """error, unless the message tells of a failure or a skip, which is a warning."""
    m = F.lower(message)
    return F.when(m.rlike("failed|skipped"), "warn").when(m.startswith("error"), "error").otherwise("info")


def batch_of(job_id: Column) -> Column:
    """The batch in a job's id, else its first twelve characters; null of nothing."""
    found = F.regexp_extract(job_id, r"^(.*)-job-\d+$", 1)
    return F.when(found != "", found).when(F.length(job_id) > 0, F.substring(job_id, 1, 12))


def skills_of(prompt: Column, verbs: list[str]) -> Column:
    """Skills of the vocabulary that a prompt's words stand for, in order of first use; without any, its last verb."""
    table = F.create_map(*[x for k, v in SKILL_WORDS.items() if v in verbs for x in (F.lit(k), F.lit(v))])
    words = F.split(F.translate(F.lower(F.coalesce(prompt, F.lit(""))), ",.", "  "), r"\s+")
    found = F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda s: s.isNotNull()))
    return F.when(F.size(found) == 0, F.array(F.lit(verbs[-1] if verbs else NO_SKILL))).otherwise(found)


def seconds_text(s: Column) -> Column:
    """"42s" below 90 seconds, else "3m 05s"."""
    whole = F.floor(s + 0.5).cast("long")
    return F.when(s < 90, F.concat(whole.cast("string"), F.lit("s"))).otherwise(F.format_string("%dm %02ds", F.floor(whole / 60).cast("long"), whole % 60))


def rate_text(value: Column) -> Column:
    """Whole numbers with separators from 10 on, else one decimal; 0 for what is no number."""
    good = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return F.when(good.isNull(), "0").when(good >= 10, F.format_number(F.floor(good + 0.5), 0)).otherwise(F.format_number(good, 1))


def cam_spec(spec: Column) -> Column:
    """Camera and path of "camera:path", parted at the first colon; null without one."""
    parts = F.split(spec, ":", 2)
    return F.when(F.contains(spec, F.lit(":")), F.struct(F.trim(F.get(parts, F.lit(0))).alias("cam_id"), F.trim(F.get(parts, F.lit(1))).alias("path")))


def job_id(prompt: Column, at: Column) -> Column:
    """A job's id: 24 characters of the prompt, and six of the SHA-256 of prompt and time (Spark has no BLAKE2, so ids made elsewhere
    by that hash differ)."""
    s = F.left(F.regexp_replace(F.regexp_replace(F.lower(prompt), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(24))
    return F.concat_ws("_", F.coalesce(F.nullif(s, F.lit("")), F.lit("job")), F.left(F.sha2(F.concat_ws(":", prompt, at), 256), F.lit(6)))


def variant_prompt(base: Column, camera: Column, lighting: Column, time_of_day: Column) -> Column:
    """An event's prompt from a camera's view: sentences without dots at their ends, then how it is lit and shot."""
    bare = lambda c: F.regexp_replace(c, r"[. ]+$", "")
    view = F.when(F.length(F.coalesce(camera, F.lit(""))) > 0, F.concat(F.lit(". "), bare(camera))).otherwise("")
    return F.concat(bare(base), view, F.lit(". "), lighting, F.lit(", "), time_of_day, F.lit(". Static camera, single continuous shot."))


def json_of_reply(text: Column) -> Column:
    """The JSON object in a model's reply: what stands between the first { and the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
