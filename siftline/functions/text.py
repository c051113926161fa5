"""Hashes, cleaning and extraction over text columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

#: White space in the sense of Unicode, for engines whose \s is ASCII.
WHITE = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


WHITE_BUT_BLANK = "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: The characters of WHITE.
WHITE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARACTERS))


def collapse_ws(c: Column) -> Column:
    """White space as single blanks; a text in which it is so already is only looked at."""

    def collapsed(x: Column) -> Column:
        return F.when(x.rlike(f"  |{WHITE_BUT_BLANK}"), F.regexp_replace(x, f"{WHITE}+", " ")).otherwise(x)

    return trim_ws(let(c, collapsed))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def content_sha256(title: Column, content: Column) -> Column:
    """Of ``title|content`` on one line, trimmed; null is as empty."""
    line = F.replace(F.concat(or_empty(title), F.lit("|"), or_empty(content)), F.lit("\n"), F.lit(" "))
    return F.sha2(F.replace(trim_ws(line), F.lit("\r"), F.lit("")), 256)


def content_md5(title: Column, content: Column, cut: int | None = None) -> Column:
    """Of title and content, cut first, then trimmed and lower-cased; null is as empty."""
    both = F.concat(or_empty(title), or_empty(content))
    return F.md5(F.lower(trim_ws(F.substring(both, 1, cut) if cut else both)))


def edge_hash(c: Column) -> Column:
    """A text under ten bytes itself; else its length in bytes, and its first and last five characters."""
    n = F.octet_length(c)
    ends = F.concat_ws("_", n.cast("string"), F.substring(c, 1, 5), F.right(c, F.lit(5)))
    return F.when(n < 10, c).when(n >= 10, ends)


def strip_html(c: Column) -> Column:
    """Scripts and styles go, tags become blanks, white space is collapsed."""
    without = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    without = F.regexp_replace(without, r"(?is)<style[^>]*>.*?</style>", "")
    tagless = F.when(F.contains(c, F.lit("<")), F.regexp_replace(without, r"<[^>]+>", " ")).otherwise(c)
    return F.trim(F.regexp_replace(tagless, r"\s+", " "))


def _head(pattern: str) -> str:
    """The letters that every match of a pattern begins with, in lower case."""
    found = re.match(r"[^\W_]*", pattern)[0]
    return (found[:-1] if pattern[len(found) :][:1] in ("*", "?", "{") else found).lower()


def _without(c: Column, patterns: list[str], by: str) -> Column:
    """Patterns replaced one after the other; a text is only searched for those of which it holds the beginning."""
    heads = F.array(*(F.lit(h) for h in sorted({_head(p) for p in patterns})))

    def step(text: Column, p: str) -> Column:
        head = F.lit(_head(p))
        return let(text, lambda x: F.when(F.contains(F.lower(x), head), F.regexp_replace(x, f"(?i){p}", by)).otherwise(x))

    def all_steps(text: Column) -> Column:
        held = let(F.lower(text), lambda low: F.exists(heads, lambda h: F.contains(low, h)))
        return F.when(held, reduce(step, patterns, text)).otherwise(text)

    return let(c, all_steps)


def clean_content(c: Column, platform: Column) -> Column:
    """Plain text without page noise, the platform's own noise last; under ten characters become none."""

    def by_platform(general: Column) -> Column:
        found = F.when(F.lit(False), general)
        for name, noise in V.PLATFORM_NOISE.items():
            found = found.when(platform == name, _without(general, noise, " "))
        return collapse_ws(found.otherwise(general))

    cleaned = let(_without(strip_html(c), V.NOISE, " "), by_platform)
    return let(cleaned, lambda x: F.when(F.char_length(x) < 10, F.lit("")).otherwise(x))


def clean_bilibili(c: Column) -> Column:
    return clean_content(_without(c, V.BILIBILI_SPANS, ""), F.lit("bilibili"))


def clean_title(c: Column) -> Column:
    return collapse_ws(F.regexp_replace(c, V.TITLE_SUFFIX, ""))


def break_lines(c: Column) -> Column:
    """Line breaks of HTML become blanks; other tags stay."""
    return collapse_ws(F.regexp_replace(c, r"<br\s*/?>", "\n"))


def text_lines(c: Column) -> Column:
    """The parts of a text between line ends and double blanks, trimmed, one a line."""
    parts = F.transform(F.split(c, "\n|  "), trim_ws)
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _mentions(c: Column, pattern: str) -> Column:
    return F.transform(_all(c, pattern), lambda x: F.concat(F.lit("@"), x))


HASHTAG = r"#([^#\s]+)#?"


def hashtags(c: Column) -> Column:
    """Hashtags, then mentions with their @, distinct in order of appearance, ten at most."""
    return F.slice(F.array_distinct(F.concat(_all(c, HASHTAG), _mentions(c, r"@([^\s@]+)"))), 1, 10)


def topics(c: Column) -> Column:
    """What stands between two # signs, trimmed, without empty ones."""
    return F.filter(F.transform(_all(c, "#([^#]+)#"), trim_ws), lambda x: x != "")


def platform_tags(c: Column, platform: str) -> Column:
    """Tags by the platform's own rule, distinct in order of appearance, ten at most."""
    if platform == "xiaohongshu":
        known = F.filter(F.array(*map(F.lit, V.XHS_TAG_WORDS)), lambda k: F.contains(c, k))
        found = F.concat(topics(c), known)
    elif platform == "bilibili":
        named = [_all(c, p) for p in (HASHTAG, *V.BILIBILI_CATEGORIES)]
        found = F.concat(F.array(*map(F.lit, V.BILIBILI_TAGS)), *named)
    else:
        found = F.concat(topics(c), _mentions(c, r"@([^\s]+)"))
    return F.slice(F.array_distinct(found), 1, 10)


def author(c: Column, url: Column, platform: str) -> Column:
    """The first of the platform's patterns that is found; else the id in the URL; else the platform's default."""
    patterns, in_url, before, default = V.AUTHORS[platform]
    found = [_first(c, p) for p in patterns]
    if in_url:
        found.append(F.concat(F.lit(before), _first(url, in_url)))
    return F.coalesce(*found, F.lit(default))


def bilibili_video(c: Column, url: Column) -> Column:
    """The first video address in a text, ids made addresses; else the page's own if it is a video's."""
    site = F.lit("https://www.bilibili.com/video/")
    found = [
        F.when(F.startswith(x, F.lit("http")), x).otherwise(F.concat(site, x))
        for x in (_first(c, p, 0) for p in V.BILIBILI_VIDEOS)
    ]
    return F.coalesce(*found, F.when(F.contains(url, F.lit("/video/")), url))


def image_urls(c: Column, most: int = 5) -> Column:
    """Whole image addresses in a text, distinct in order of appearance."""
    return F.slice(F.array_distinct(_all(c, f"(?i){V.IMAGE_URL}", 0)), 1, most)


def page_title(html: Column) -> Column:
    return collapse_ws(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def compact_number(n: Column) -> Column:
    """1.2M, 3.4K or the whole number itself; tenths are rounded half up."""

    def tenths(unit: int, mark: str) -> Column:
        t = F.floor((n + unit // 20) / (unit // 10))
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(mark))

    return F.when(n >= 1_000_000, tenths(1_000_000, "M")).when(n >= 1_000, tenths(1_000, "K")).otherwise(n.cast("string"))


def minutes_seconds(seconds: Column) -> Column:
    text = F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit("未知")).otherwise(text)


def engagement_bucket(rate: Column) -> Column:
    return F.when(rate >= 5, "high").when(rate >= 3, "medium").otherwise("low")


def interval_label(ms: Column, cron: Column, once: Column) -> Column:
    minutes = (ms / 60_000).cast("long")
    return (
        F.when(once, F.lit("一次性"))
        .when(cron.isNotNull() & (cron != ""), cron)
        .when(minutes >= 60, F.concat(F.lit("每"), (minutes / 60).cast("long").cast("string"), F.lit("小时")))
        .otherwise(F.concat(F.lit("每"), minutes.cast("string"), F.lit("分钟")))
    )


# How the platforms' own extraction begins its tag lists, and its patterns of video addresses.
LEADING_TAGS = {"weibo": ["微博", "社交媒体"], "bilibili": ["B站", "视频"], "xiaohongshu": ["小红书", "生活分享", "种草"], "douyin": ["抖音", "短视频"], "news": ["新闻", "资讯"]}
VIDEO_URLS = [
    r"https?://[^\s]+\.(mp4|avi|mov|wmv|flv|webm)",
    r"https?://v\.douyin\.com/[^\s]+",
    r"https?://www\.bilibili\.com/video/[^\s]+",
    r"https?://video\.weibo\.com/[^\s]+",
]


def leading_tags(c: Column, query: Column, platform: str) -> Column:
    """The platform's tags, the query, then hashtags; distinct in order of appearance, without a limit."""
    own = F.array(*map(F.lit, LEADING_TAGS[platform]))
    return F.array_distinct(F.concat(own, F.array(query), _all(c, r"#([^#\s]+)#?")))


def video_url(c: Column) -> Column:
    """The first address of a video file in a text, else of a video page of each site in turn."""
    return F.coalesce(*(_first(c, f"(?i){p}", 0) for p in VIDEO_URLS))


def result_video(url: Column, platform: Column) -> Column:
    """A search result's own address, if its platform is one of videos and the address is that platform's or a video's."""
    of_site = F.contains(F.lower(url), F.lit("video")) | F.contains(url, F.lit("bilibili.com")) | F.contains(url, F.lit("douyin.com"))
    return F.when(platform.isin("douyin", "bilibili") & of_site, url).otherwise(F.lit(""))


def best_content(cleaned_html: Column, markdown: Column, html: Column) -> Column:
    """Cleaned HTML of over 50 characters, else Markdown of over 50, else stripped HTML; the raw beginning if that is short."""
    found = F.when(F.char_length(cleaned_html) > 50, cleaned_html).when(F.char_length(markdown) > 50, markdown).otherwise(strip_html(html))
    return let(found, lambda x: F.when(F.char_length(x) < 100, F.substring(html, 1, 3000)).otherwise(x))


def best_title(given: Column, html: Column) -> Column:
    """The given title, else the page's if the given one has under five characters, else a default; cleaned."""
    found = F.when(F.char_length(given) >= 5, given).otherwise(F.nullif(page_title(html), F.lit("")))
    return clean_title(F.coalesce(found, F.lit("未知标题")))
