"""Rules over URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

CJK = "[一-鿿]"

# What a URL must hold to belong to a platform, in the order in which it is asked.
PLATFORM_HOSTS = [
    ("weibo", ["weibo.com"]),
    ("bilibili", ["bilibili.com", "b23.tv"]),
    ("xiaohongshu", ["xiaohongshu.com", "xhs.cn"]),
    ("douyin", ["douyin.com", "tiktok.com"]),
]
SERVICE_HOSTS = [
    ("weibo", ["weibo.com", "weibo.cn"]),
    ("bilibili", ["bilibili.com", "b23.tv"]),
    ("xiaohongshu", ["xiaohongshu.com", "xhslink.com"]),
    ("douyin", ["douyin.com", "iesdouyin.com"]),
]
DEFAULT_QUERIES = {"weibo": "热门微博", "bilibili": "精彩视频", "xiaohongshu": "生活分享", "douyin": "热门短视频"}
SEARCH_ENGINES = {
    "baidu": "https://www.baidu.com/s?wd=",
    "sogou": "https://www.sogou.com/web?query=",
    "bing": "https://www.bing.com/search?q=",
}
SITES = {"weibo": "weibo.com", "bilibili": "bilibili.com", "xiaohongshu": "xiaohongshu.com", "douyin": "douyin.com"}


def has_any(c: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(c, F.lit(p))
    return found


def _by_host(url: Column, hosts: list[tuple[str, list[str]]], default: str) -> Column:
    low = F.lower(url)
    found = F.when(F.lit(False), F.lit(""))
    for name, parts in hosts:
        found = found.when(has_any(low, parts), F.lit(name))
    return found.otherwise(F.lit(default))


def platform_of(url: Column) -> Column:
    return _by_host(url, PLATFORM_HOSTS, "news")


def service_of(url: Column) -> Column:
    return _by_host(url, SERVICE_HOSTS, "general")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_type(url: Column) -> Column:
    """A label by platform and kind of page."""
    low = F.lower(url)

    def on(site: str, *parts: str) -> Column:
        held = F.contains(low, F.lit(site))
        return held & has_any(low, list(parts)) if parts else held

    return (
        F.when(on("weibo.com", "/home", "tabtype=feed", "is_all=1"), "微博动态页面")
        .when(on("weibo.com", "/u/", "/n/"), "微博用户页面")
        .when(on("weibo.com"), "微博首页或其他页面")
        .when(on("bilibili.com", "/video/"), "B站视频页面")
        .when(on("bilibili.com", "/space/"), "B站用户空间")
        .when(on("bilibili.com"), "B站首页或其他页面")
        .when(on("xiaohongshu.com", "/explore/", "/user/"), "小红书动态页面")
        .when(on("xiaohongshu.com"), "小红书首页或其他页面")
        .when(on("douyin.com", "/user/", "/video/"), "抖音动态页面")
        .when(on("douyin.com"), "抖音首页或其他页面")
        .otherwise("未知平台页面")
    )


def is_dynamic_url(url: Column) -> Column:
    return ~url.rlike("(?i)" + "|".join(V.STATIC_URLS))


def is_valid_url(url: Column) -> Column:
    """Of http or https, its host with a dot; on weibo.com not the root and none of the closed paths."""
    path = F.lower(url_path(url))
    closed = path.rlike("^(" + "|".join(V.WEIBO_FORBIDDEN) + ")") | path.isin("", "/")
    fine = url.rlike("^https?://") & F.contains(url_host(url), F.lit("."))
    return F.coalesce(fine & ~(F.contains(url_host(url), F.lit("weibo.com")) & closed), F.lit(False))


def is_image_url(url: Column) -> Column:
    low = F.lower(url)
    return F.coalesce(has_any(low, V.IMAGE_PARTS) | low.rlike(V.IMAGE_PATH), F.lit(False))


def absolute(href: Column, base: Column) -> Column:
    """A link seen from its page: //x gets https, /x gets the page's scheme and host."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .otherwise(href)
    )


def query_of(url_or_query: Column, platform: str) -> Column:
    """What to search for: a plain input itself, of a URL its first telling part, else the platform's default."""
    stop = ["http:", "https:", "www", platform, "com"]
    parts = F.filter(F.split(url_or_query, "/"), lambda x: (F.char_length(x) > 2) & ~x.isin(stop))
    default = F.lit(DEFAULT_QUERIES.get(platform, "热点新闻"))
    found = F.when(F.startswith(url_or_query, F.lit("http")), F.get(parts, F.lit(0))).otherwise(F.nullif(url_or_query, F.lit("")))
    return F.coalesce(found, default)


def news_query(url: Column) -> Column:
    """The first segment of the path that has over two characters."""
    return F.get(F.filter(F.split(url_path(url), "/"), lambda x: F.char_length(x) > 2), F.lit(0))


def chinese_query(url: Column, default: str) -> Column:
    """The first part with a Chinese character, over two characters and not a number."""
    parts = F.filter(F.split(url, "/"), lambda x: (F.char_length(x) > 2) & ~x.rlike(r"^\d+$") & x.rlike(CJK))
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(default))


def weibo_identifier(given: Column) -> Column:
    """The user that an address, a name or an @ or # mark points to; null if there is none."""
    text = F.trim(given)
    path = F.regexp_replace(url_path(text), "^/+|/+$", "")
    first, second = F.get(F.split(path, "/"), F.lit(0)), F.get(F.split(path, "/"), F.lit(1))
    in_url = (
        F.when(F.startswith(path, F.lit("u/")), F.when(second.rlike(r"^\d+$"), second))
        .when(F.startswith(path, F.lit("n/")), F.nullif(F.try_url_decode(second), F.lit("")))
        .when((path != "") & ~path.rlike("^(home|hot|search|login|register)"), F.try_url_decode(first))
    )
    plain = F.trim(F.regexp_replace(text, "^[@#]+", ""))
    cleaned = F.regexp_replace(plain, "[^a-zA-Z0-9_-]", "")
    named = F.when(plain.rlike("^[a-zA-Z0-9_-]+$") | plain.rlike(CJK), plain).when(F.char_length(cleaned) >= 3, cleaned)
    return F.when(
        text.rlike("^https?://"), F.when(F.contains(url_host(text), F.lit("weibo.com")), in_url)
    ).otherwise(named)


def weibo_pages(identifier: Column) -> Column:
    """Candidate addresses of a weibo user: by nickname, or by name of 3 to 30 characters that isn't reserved."""
    site = F.lit("https://weibo.com/")
    nick = F.regexp_replace(identifier, "[^a-zA-Z0-9_一-鿿-]", "")
    by_nick = F.array(F.concat(site, F.lit("n/"), nick), F.concat(site, nick, F.lit("?tabtype=feed")), F.concat(site, nick))
    by_name = F.array(
        F.concat(site, identifier, F.lit("?tabtype=feed")),
        F.concat(site, F.lit("u/"), identifier, F.lit("?tabtype=feed")),
        F.concat(site, identifier, F.lit("?is_all=1")),
    )
    named = F.char_length(identifier).between(3, 30) & ~F.lower(identifier).isin(V.RESERVED_NAMES)
    return F.when(identifier.rlike("[^a-zA-Z0-9_-]"), F.when(nick != "", by_nick)).when(named, by_name)


def platform_pages(creator: Column, platform: Column) -> Column:
    """The addresses to read for a creator: its own if it is a URL of a dynamic page, else the platform's, valid ones only."""

    def of(*parts: str | Column) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    number = creator.rlike(r"^\d+$")
    weibo = "https://weibo.com/"
    cleaned = F.regexp_replace(creator, "[^a-zA-Z0-9_一-鿿-]", "")
    fallback = F.when(cleaned != "", F.array(of(weibo, cleaned, "?tabtype=feed"), of(weibo, "n/", cleaned), of(weibo, cleaned)))
    handle = F.substring(creator, 2, 1 << 20)
    candidates = (
        F.when(F.startswith(creator, F.lit("http")), F.when(is_dynamic_url(creator), F.array(creator)))
        .when(
            (platform == "weibo") & number,
            F.array(of(weibo, "u/", creator, "/home"), of(weibo, "u/", creator, "?tabtype=feed"), of(weibo, creator, "?is_all=1")),
        )
        .when(platform == "weibo", F.coalesce(weibo_pages(weibo_identifier(creator)), fallback))
        .when(
            (platform == "bilibili") & number,
            F.array(*(of("https://space.bilibili.com/", creator, x) for x in ("/dynamic", "/video", ""))),
        )
        .when(
            platform == "bilibili",
            F.array(
                F.lit("https://www.bilibili.com/v/popular/all"),
                F.lit("https://t.bilibili.com"),
                F.lit("https://www.bilibili.com/v/popular/weekly"),
            ),
        )
        .when(
            (platform == "xiaohongshu") & creator.rlike(r"^(xiaohongshu|xhslink)\.com"), F.array(creator)
        )
        .when(
            platform == "xiaohongshu",
            F.array(
                F.lit("https://www.xiaohongshu.com/explore"),
                F.lit("https://www.xiaohongshu.com/explore/homefeed.json"),
                F.when(creator != "", of("https://www.xiaohongshu.com/user/profile/", creator)).otherwise(
                    "https://www.xiaohongshu.com/explore"
                ),
            ),
        )
        .when(
            (platform == "douyin") & F.startswith(creator, F.lit("@")),
            F.array(of("https://www.douyin.com/@", handle), of("https://www.douyin.com/user/", handle)),
        )
        .when(
            platform == "douyin",
            F.array(
                F.lit("https://www.douyin.com/recommend"),
                F.lit("https://www.douyin.com/hot"),
                F.when(creator != "", of("https://www.douyin.com/search/", creator)).otherwise("https://www.douyin.com/recommend"),
            ),
        )
        .otherwise(
            F.array(
                F.lit("https://www.zhihu.com/hot"),
                F.lit("https://weibo.com/hot/search"),
                F.lit("https://www.bilibili.com/v/popular/all"),
            )
        )
    )
    return F.filter(F.coalesce(candidates, F.array().cast("array<string>")), is_valid_url)


def search_addresses(query: Column, platform: str) -> Column:
    """One address for each search engine, kept to the platform's site."""
    wanted = F.concat(query, F.lit(f" site:{SITES[platform]}")) if platform in SITES else query
    return F.array(*(F.concat(F.lit(x), F.url_encode(wanted)) for x in SEARCH_ENGINES.values()))


def scroll_rounds(url: Column, rounds: int = 10, most: int = 50) -> Column:
    """Pages of searches, topics and hashtags are scrolled twice as far, up to a limit."""
    return F.when(F.lower(url).rlike("search|topic|hashtag"), F.least(F.lit(2 * rounds), F.lit(most))).otherwise(F.lit(rounds))
