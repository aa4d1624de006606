"""Text to a validated plan: normalise, read filters and actions, bind them to one selection, guard, resolve.

Dates are resolved against the latest day of the data, never the wall clock; weeks begin on Monday.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quillon.operators import filters
from quillon.operators.filters import PhotoQuery

# Fixed values.
MOST_STEPS, CONFIRM_FROM = 8, 500
NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
HAN = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2}
SPACES = "，。！？、；：（）「」『』“”《》,!?;()\"[]{}"
ISSUE_WORDS = {"blurry": r"blur(?:ry|red)?|out of focus|模糊|虚焦", "closed_eyes": r"closed eyes|eyes closed|blink\w*|闭眼", "overexposed": r"overexposed|too bright|过曝", "underexposed": r"underexposed|too dark|欠曝", "noisy": r"noisy|噪点", "tilted": r"tilted|crooked|倾斜"}
SCENE_WORDS = {"portrait": r"portraits?|人像", "group": r"group (?:photos?|shots?)|合影", "landscape": r"landscapes?|风景", "night": r"night|夜景"}
TOOLS = ("filter", "set_rating", "set_flag", "accept_ai", "group_keep_top", "scene_keep_top", "apply_preset", "auto_adjust", "adjust_sliders", "apply_profiles", "besttake_auto", "remove_bystanders", "export", "describe", "suggest_edits")
DESTRUCTIVE = ("set_flag", "group_keep_top", "scene_keep_top", "remove_bystanders")


@dataclass(frozen=True)
class Call:
    tool: str
    args: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    calls: tuple[Call, ...]
    needs_confirmation: bool = False


def han_number(text: str) -> int | None:
    """A number below a thousand in Chinese numerals."""
    if not text or not set(text) <= set(HAN) | {"十", "百"}:
        return None
    total, now = 0, None
    for c in text:
        if c in HAN:
            now = HAN[c]
        else:
            total += (1 if now is None else now) * (10 if c == "十" else 100)
            now = None
    return total + (now or 0)


def normalize(text: str) -> str:
    """Lower case, full-width letters and digits narrowed, punctuation to spaces, number words to digits."""
    wide = {0x3000: " "} | {i: chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)}
    narrow = text.translate(str.maketrans({**{c: " " for c in SPACES}, "‘": "'", "’": "'"})).translate(wide)
    narrow = narrow.translate(str.maketrans({c: " " for c in SPACES})).lower()
    unit = r"(?=\s*(?:stars?|photos?|pictures?|per|best|people|persons?|days?|weeks?))"
    narrow = re.sub(r"\b(" + "|".join(NUMBERS) + r")\b" + unit, lambda m: str(NUMBERS[m[1]]), narrow)
    narrow = re.sub(r"\b(top|best) (" + "|".join(NUMBERS) + r")\b", lambda m: f"{m[1]} {NUMBERS[m[2]]}", narrow)
    narrow = re.sub(r"([零一二两三四五六七八九十百]+)(?=星|张|个|天|周|分)", lambda m: str(han_number(m[1])), narrow)
    return " ".join(narrow.split())


def day_range(text: str, latest: dt.date) -> tuple[dt.date, dt.date] | None:
    """First and last day that a phrase names, relative to the latest day of the data."""
    day = dt.timedelta(days=1)
    monday = latest - day * latest.weekday()
    if m := re.search(r"(\d{4})-(\d{2})-(\d{2})(?:\s*(?:to|-|~|到|至)\s*(\d{4})-(\d{2})-(\d{2}))?", text):
        try:
            first = dt.date(*map(int, m.groups()[:3]))
            return first, dt.date(*map(int, m.groups()[3:])) if m[4] else first
        except ValueError:
            return None
    for words, span in ((r"\btoday\b|今天", (latest, latest)), (r"\byesterday\b|昨天", (latest - day, latest - day)), (r"\bthis week\b|(?:这|本)周", (monday, monday + 6 * day)), (r"\blast week\b|上周", (monday - 7 * day, monday - day))):
        if re.search(words, text):
            return span
    if m := re.search(r"(?:last|past) (\d+) days|(?:最近|过去)(\d+)天", text):
        n = int(m[1] or m[2])
        return latest - (n - 1) * day, latest
    first = latest.replace(day=1)
    if re.search(r"\bthis month\b|(?:这|本)个?月", text):
        return first, (first + 32 * day).replace(day=1) - day
    if re.search(r"\blast month\b|上个?月", text):
        return (first - day).replace(day=1), first - day
    if re.search(r"\bthis year\b|今年", text):
        return dt.date(latest.year, 1, 1), dt.date(latest.year, 12, 31)
    if re.search(r"\blast year\b|去年", text):
        return dt.date(latest.year - 1, 1, 1), dt.date(latest.year - 1, 12, 31)
    return None


def edit_distance_within(a: str, b: str, most: int) -> bool:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= most


def match_people(text: str, people: dict[int, str]) -> tuple[list[int], str]:
    """Ids of people named in a text, in order, a typo in longer names allowed; and the text without the names."""
    found = []
    for person, name in people.items():
        plain = normalize(name)
        at = re.search(rf"(?<!\w){re.escape(plain)}(?!\w)" if plain.isascii() else re.escape(plain), text) if plain else None
        if at is None and plain.isascii() and len(plain) >= 5:
            at = next((m for m in re.finditer(r"[\w'-]+", text) if abs(len(m[0]) - len(plain)) <= 1 and edit_distance_within(m[0], plain, 1)), None)
        if at is not None:
            found.append((at.start(), person, at.span()))
    for _, _, (a, b) in found:
        text = text[:a] + " " * (b - a) + text[b:]
    return [p for _, p, _ in sorted(found)], text


def read_filter(text: str, latest: dt.date | None = None, people: dict[int, str] | None = None) -> dict:
    """Fields of a photo query that a normalised text names."""
    out: dict = {}
    named, text = match_people(text, people or {})
    if named:
        out["persons"] = tuple(named)
        if len(named) > 1 and re.search(r"\band\b|\btogether\b|和|与", text):
            out["person_mode"] = "all"
    stars = re.search(r"(?:(?:at least|over|above|>=?|不低于|至少)\s*)(\d)\s*(?:stars?|星)|(\d)\s*(?:\+|stars? (?:and|or) (?:up|above|more|better)|星(?:及)?以上)|\b(\d)[- ]stars?\b|(\d)星", text)
    if stars:
        n = min(5, int(next(g for g in stars.groups() if g)))
        ai = re.search(r"\bai\b|智能", text[max(0, stars.start() - 8) : stars.start()])
        out["ai_rating_gte" if ai else "rating_gte"] = float(n) if ai else n
    for flag, words in (("not_rejected", r"not rejected|未(?:被)?淘汰"), ("unflagged", r"unflagged|undecided|未(?:标记|选)"), ("rejected", r"\brejected\b|\brejects\b|已淘汰"), ("picked", r"\bpicked\b|\bpicks\b|\bflagged\b|已选")):
        if re.search(words, text):
            out["flag"] = flag
            break
    if m := re.search(r"\b(red|yellow|green|blue|purple)\b(?= label|$| )|([红黄绿蓝紫])(?:色)?标", text):
        out["color_label"] = m[1] or {"红": "red", "黄": "yellow", "绿": "green", "蓝": "blue", "紫": "purple"}[m[2]]
    if re.search(r"\bunedited\b|not edited|未编辑", text):
        out["has_edits"] = False
    elif re.search(r"\bedited\b|已编辑", text):
        out["has_edits"] = True
    issues = []
    for name, words in ISSUE_WORDS.items():
        for m in re.finditer(words, text):
            if re.search(r"(?:\bnot?|\bno|\bwithout|n't|不|没|无)\s*$", text[: m.start()]):
                out["issues_none"] = True
            elif name not in issues:
                issues.append(name)
    if re.search(r"no issues|without (?:any )?(?:issues|problems)|没有问题", text):
        out["issues_none"] = True
    if issues:
        out.pop("issues_none", None)
        out["issues_any"] = tuple(issues)
    for scene, words in SCENE_WORDS.items():
        if re.search(words, text):
            out["scene_type"] = scene
            break
    if m := re.search(r"(?:at least |more than )?(\d+) (?:or more )?(?:people|persons)|(\d+)个?人(?:以上)?", text):
        out["faces_min"] = int(m[1] or m[2])
    elif re.search(r"\bnobody\b|no people|没有人", text):
        out["faces_max"] = 0
    states = [s for s, words in (("smiling", r"smil\w+|微笑|笑"), ("eyes_open", r"eyes open|睁眼"), ("looking", r"looking at (?:the )?camera|看镜头")) if re.search(words, text)]
    if states:
        out["person_state"] = tuple(states)
    if re.search(r"best of (?:each|every) (?:burst|group)|每组最好", text):
        out["burst_best_only"] = True
    if re.search(r"\bduplicates?\b|重复", text):
        out["duplicates"] = True
    if latest and (span := day_range(text, latest)):
        epoch = dt.date(1970, 1, 1)
        out["taken_from"], out["taken_to"] = (span[0] - epoch).days * 86_400_000, (span[1] - epoch).days * 86_400_000 + 86_399_999
    return out


def read_actions(text: str) -> list[Call]:
    """Tool calls that a normalised text asks for."""
    out = []
    if m := re.search(r"(?:keep|pick|保留)(?: the)?(?: (?:top|best))? (\d+)(?: best)?(?: photos?)? (?:per|of each|in each|from each) (burst|group|scene)|每(组|场景)保留(\d+)张", text):
        scene = "scene" in (m[2] or "") or m[3] == "场景"
        out.append(Call("scene_keep_top" if scene else "group_keep_top", {"n": int(m[1] or m[4]), "reject_rest": bool(re.search(r"reject the (?:rest|others)|其余淘汰", text))}))
    if m := re.search(r"(?:rate|set rating|give)\D{0,20}(\d) ?stars?|评(\d)星", text):
        out.append(Call("set_rating", {"rating": min(5, int(m[1] or m[2]))}))
    elif re.search(r"accept (?:the )?ai|采纳", text):
        out.append(Call("accept_ai"))
    if re.search(r"(?:^|then |and )(?:reject|discard|delete)\b|(?:淘汰|删除)(?!了)", text) and not out:
        out.append(Call("set_flag", {"flag": -1}))
    elif re.search(r"(?:^|then |and )(?:pick|flag)\b(?! the top| \d)", text) and not out:
        out.append(Call("set_flag", {"flag": 1}))
    for tool, words in (("export", r"\bexport\b|导出"), ("auto_adjust", r"auto[- ]?adjust|自动调整"), ("remove_bystanders", r"remove (?:the )?(?:bystanders|strangers)|去除路人"), ("describe", r"\bdescribe\b|描述"), ("suggest_edits", r"suggest (?:some )?edits|修图建议")):
        if re.search(words, text):
            out.append(Call(tool))
    return out


def parse(message: str, latest: dt.date | None = None, people: dict[int, str] | None = None) -> Plan:
    """A filter, if any, and the actions on what it selects."""
    text = normalize(message)
    actions, wanted = read_actions(text), read_filter(text, latest, people)
    if actions and actions[0].tool == "set_rating":
        wanted.pop("rating_gte", None)
    if actions and actions[0].tool == "set_flag":
        wanted.pop("flag", None)
    calls = ([Call("filter", wanted)] if wanted or not actions else []) + [Call(c.tool, {**c.args, "target": "current_filter"}) for c in actions]
    return validate(calls)


def validate(calls: list[Call]) -> Plan:
    """The plan, if every tool exists, there are not too many and a filter comes first; destructive ones ask first."""
    if not 1 <= len(calls) <= MOST_STEPS:
        raise ValueError(f"a plan has 1 to {MOST_STEPS} steps")
    for i, c in enumerate(calls):
        if c.tool not in TOOLS:
            raise ValueError(f"unknown tool: {c.tool}")
        if c.tool == "filter":
            if i:
                raise ValueError("the filter comes first")
            PhotoQuery(**c.args)
        if c.tool.endswith("keep_top") and not c.args.get("n", 0) >= 1:
            raise ValueError("n must be at least 1")
    return Plan(tuple(calls), any(c.tool in DESTRUCTIVE for c in calls))


def bind(plan: Plan, current: PhotoQuery) -> PhotoQuery:
    """The selection that a plan's steps act on: its own filter within the session, else the current one."""
    if plan.calls[0].tool == "filter":
        return PhotoQuery(session_id=current.session_id, **plan.calls[0].args)
    return current


def resolve(plan: Plan, catalog: filters.Catalog, current: PhotoQuery) -> tuple[DataFrame, int, bool]:
    """Selected photos, how many, and whether to ask before acting on them."""
    chosen = filters.filtered(catalog, bind(plan, current)).select("photo_id")
    n = chosen.count()
    acts = any(c.tool != "filter" for c in plan.calls)
    return chosen, n, plan.needs_confirmation or (acts and n >= CONFIRM_FROM)


def run_step(call: Call, photos: DataFrame, planned: int) -> DataFrame:
    """photos (the selection's rows) with a step's change; refuses a selection that grew since it was planned."""
    from pyspark.sql import functions as F

    from quillon.operators import ranking

    if photos.count() > planned:
        raise ValueError("the selection has grown since the plan was made")
    if call.tool == "set_rating":
        return photos.withColumn("user_rating", F.lit(call.args["rating"]))
    if call.tool == "set_flag":
        return photos.withColumn("flag", F.lit(call.args["flag"]))
    if call.tool == "accept_ai":
        return photos.withColumn("user_rating", F.coalesce(F.round("ai_rating").cast("int"), "user_rating"))
    if call.tool == "group_keep_top":
        kept = ranking.keep_in_bursts(photos, call.args["n"]).select("photo_id", "kept")
        rest = F.lit(-1) if call.args.get("reject_rest") else F.col("flag")
        return photos.join(kept, "photo_id", "left").withColumn("flag", F.when(F.col("kept"), 1).when(~F.col("kept"), rest).otherwise(F.col("flag"))).drop("kept")
    return photos
