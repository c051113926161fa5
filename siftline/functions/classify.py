"""Rule classification and scores. Each rule becomes one expression; lower-cased text is given once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import let, trim_ws
from .urls import has_any


def count_of(words: list[str], *columns: Column) -> Column:
    """How many of the words stand in one of the columns."""
    total = F.lit(0)
    for w in words:
        held = F.lit(False)
        for c in columns:
            held = held | F.contains(c, F.lit(w))
        total = total + held.cast("int")
    return total.cast("long")


def first_of(words: list[str], *columns: Column) -> Column:
    """The first of the words, in their order, that stands in one of the columns; null without any."""
    def held(k: Column) -> Column:
        found = F.lit(False)
        for c in columns:
            found = found | F.contains(c, k)
        return found

    return F.get(F.filter(F.array(*map(F.lit, words)), held), F.lit(0))


def worth_processing(title: Column, content: Column) -> Column:
    low_title, low_content = F.lower(title), F.lower(content)
    long_enough = (F.char_length(trim_ws(title)) >= 3) & (F.char_length(trim_ws(content)) >= 20)
    error = has_any(low_title, V.REJECT_WORDS) | has_any(low_content, V.REJECT_WORDS)
    login = has_any(low_title, V.LOGIN_WORDS) & (F.char_length(trim_ws(content)) < 200)
    return long_enough & ~error & ~login


def page_error(title: Column, content: Column, platform: Column) -> Column:
    """struct(kind, indicator) of the first group that fits, or nulls. Login words count in the title only."""
    low_title, low_content = F.lower(title), F.lower(content)
    missing = first_of(V.MISSING_USER, low_title, low_content)
    access = first_of(V.ACCESS_ERROR, low_title, low_content)
    http = first_of(V.HTTP_ERROR, low_title, low_content)
    login = first_of(V.LOGIN_ERROR, low_title)
    kind = (
        F.when(missing.isNotNull() & (platform == "weibo"), "微博用户不存在")
        .when(missing.isNotNull(), "用户不存在")
        .when(access.isNotNull(), "页面访问错误")
        .when(http.isNotNull(), "HTTP错误")
        .when(login.isNotNull(), "需要登录")
        .when(F.char_length(trim_ws(content)) < 50, "内容过短")
    )
    return F.struct(kind.alias("kind"), F.coalesce(missing, access, http, login).alias("indicator"))


def crawl_error(message: Column, platform: Column) -> Column:
    """struct(type, severity, strategy, suggestion) of an error message, by the first group that fits."""

    def group(low: Column) -> Column:
        found = F.when(F.lit(False), F.lit(0))
        for k, (*_, phrases) in enumerate(V.CRAWL_ERRORS):
            found = found.when(has_any(low, phrases), F.lit(k))
        return found.otherwise(F.lit(len(V.CRAWL_ERRORS)))

    def result(k: Column) -> Column:
        groups = [*(x[:3] for x in V.CRAWL_ERRORS), ("unknown", "medium", "default_retry")]
        return _error(*(F.get(F.array(*(F.lit(x[at]) for x in groups)), k) for at in range(3)), platform)

    return let(let(F.lower(message), group), result)


def _error(kind: Column, severity: Column, strategy: Column, platform: Column) -> Column:
    hints = F.create_map(*(F.lit(x) for (p, t), text in V.SUGGESTIONS.items() for x in (f"{p}/{t}", text)))
    hint = F.coalesce(F.try_element_at(hints, F.concat(platform, F.lit("/"), kind)), F.lit(V.DEFAULT_SUGGESTION))
    return F.struct(kind.alias("type"), severity.alias("severity"), strategy.alias("strategy"), hint.alias("suggestion"))


def retry_wait(strategy: Column, attempt: Column) -> Column:
    """Seconds to wait before an attempt; attempts from the third on wait as long as the third."""
    waits = F.create_map(*(x for k, v in V.RETRY_WAITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    default = F.array(*map(F.lit, V.RETRY_WAITS["default_retry"]))
    return F.get(F.coalesce(F.try_element_at(waits, strategy), default), F.least(attempt, F.lit(2)))


def retry_limits(kind: Column, attempt: Column, platform: Column) -> Column:
    """struct(timeout_ms, delay_s) of a retry by the kind of error; longer for platforms that are slow."""
    timeout, delay = (F.when(F.lit(False), F.lit(x)) for x in (0, 0.0))
    for name, (first, more, wait, longer) in V.RETRY_TIMEOUTS.items():
        timeout = timeout.when(kind == name, first + more * attempt)
        delay = delay.when(kind == name, (wait + longer * attempt).cast("double"))
    step = F.least(attempt, F.lit(len(V.OTHER_TIMEOUTS) - 1))
    timeout = timeout.otherwise(F.get(F.array(*(F.lit(t) for t, _ in V.OTHER_TIMEOUTS)), step))
    delay = delay.otherwise(F.get(F.array(*(F.lit(float(d)) for _, d in V.OTHER_TIMEOUTS)), step))
    slow = platform.isin(V.SLOW_PLATFORMS)
    return F.struct(
        F.when(slow, F.floor(timeout * V.SLOW_TIMEOUT)).otherwise(timeout).cast("long").alias("timeout_ms"),
        F.when(slow, delay * V.SLOW_DELAY).otherwise(delay).alias("delay_s"),
    )


def content_type(title: Column, content: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    static, dynamic, weibo = (count_of(w, *low).cast("string") for w in (V.STATIC_TYPE, V.DYNAMIC_TYPE, V.WEIBO_TYPE))

    def label(name: str, a: str, x: Column, b: str, y: Column) -> Column:
        return F.concat(F.lit(f"{name} ({a}:"), x, F.lit(f", {b}:"), y, F.lit(")"))

    s, d, w = static.cast("int"), dynamic.cast("int"), weibo.cast("int")
    return (
        F.when(s > d, label("静态页面", "静态特征", static, "动态特征", dynamic))
        .when((d > 0) | (w > 0), label("动态内容", "动态特征", dynamic, "微博特征", weibo))
        .otherwise(label("未知内容类型", "静态特征", static, "动态特征", dynamic))
    )


def feature_score(title: Column, content: Column, platform: str) -> Column:
    return count_of(V.FEATURES[platform][0], F.lower(title), F.lower(content))


def has_features_in(low_title: Column, low_content: Column, platform: str) -> Column:
    """``has_features`` of a title and content that are in lower case already."""
    return count_of(V.FEATURES[platform][0], low_title, low_content) >= V.FEATURES[platform][1]


def has_features(title: Column, content: Column, platform: str) -> Column:
    return feature_score(title, content, platform) >= V.FEATURES[platform][1]


def valid_dynamic(title: Column, content: Column, url: Column) -> Column:
    """No critical error, 30 characters, and what the page's host asks for."""
    low_title, low_content, low_url = F.lower(title), F.lower(content), F.lower(url)
    user_page = has_any(low_url, ["/u/", "/n/", "/profile"])
    by_host = F.when(F.contains(low_url, F.lit("weibo.com")) & user_page, F.char_length(content) > 30)
    for host, words in V.HOST_DYNAMIC.items():
        by_host = by_host.when(F.contains(low_url, F.lit(host)), has_any(low_content, words))
    soft = has_any(low_title, V.SOFT_STATIC) & (F.char_length(content) < 200)
    by_host = by_host.otherwise(~soft & has_any(low_content, V.GENERIC_DYNAMIC))
    critical = has_any(low_title, V.CRITICAL_WORDS) | has_any(low_content, V.CRITICAL_WORDS)
    return ~critical & (F.char_length(trim_ws(content)) >= 30) & by_host


def basic_quality(title: Column, content: Column) -> Column:
    lengths = (F.char_length(title) >= 3) & (F.char_length(content) >= 10)
    return lengths & (trim_ws(title) != "") & (trim_ws(content) != "")


# The least lengths of title and content on each platform, and what its URL or content must hold.
PLATFORM_QUALITY = {
    "weibo": (5, 20, [], ""),
    "douyin": (3, 8, ["douyin", "tiktok"], "抖音"),
    "xiaohongshu": (3, 10, ["xiaohongshu", "xhs"], "小红书"),
    "bilibili": (5, 15, ["bilibili", "b23.tv"], "bilibili"),
}


def platform_quality(title: Column, content: Column, url: Column, platform: Column) -> Column:
    blank = (trim_ws(title) == "") | (trim_ws(content) == "")
    found = F.when(F.lit(False), F.lit(False))
    for name, (least_title, least_content, in_url, in_content) in PLATFORM_QUALITY.items():
        fine = (F.char_length(title) >= least_title) & (F.char_length(content) >= least_content) & ~blank
        if in_url:
            fine = fine & (has_any(F.lower(url), in_url) | F.contains(F.lower(content), F.lit(in_content)))
        found = found.when(platform == name, fine)
    return F.coalesce(found.otherwise(basic_quality(title, content)), F.lit(False))


def relevance(title: Column, content: Column, query: str) -> Column:
    """3 and 1 for the whole query in title and content, 2 and 1 for each of its words."""
    low_title, low_content = F.lower(title), F.lower(content)
    total = F.lit(0)
    for text, in_title, in_content in [(query.lower(), 3, 1), *((w, 2, 1) for w in query.lower().split())]:
        total = total + F.when(F.contains(low_title, F.lit(text)), in_title).otherwise(0)
        total = total + F.when(F.contains(low_content, F.lit(text)), in_content).otherwise(0)
    return total.cast("long")


def related(title: Column, description: Column, query: str, keywords: list[str]) -> Column:
    both = F.lower(F.concat_ws(" ", title, description))
    return has_any(both, [query.lower(), *keywords])


def news_related(title: Column, description: Column, query: str) -> Column:
    """A title of 11 to 199 bytes; the query, and no excluded word, in title and description."""
    both = F.lower(F.concat_ws(" ", title, description))
    size = F.octet_length(title)
    return ~has_any(both, V.NEWS_EXCLUDED) & (size > 10) & (size < 200) & F.contains(both, F.lit(query.lower()))


#: By platform: static words, static parts of addresses, whether a site's root is static, dynamic words, how many at
#: least, and what stands between title and description.
RESULT_RULES = {
    "weibo": (V.RESULT_STATIC, V.RESULT_PATHS, True, V.RESULT_DYNAMIC, 1, " "),
    "douyin": (V.DOUYIN_STATIC, V.DOUYIN_PATHS, True, V.DOUYIN_DYNAMIC, 2, " "),
    "xiaohongshu": (V.NOTE_STATIC, V.NOTE_PATHS, False, V.XHS_DYNAMIC, 1, ""),
    "bilibili": (V.NOTE_STATIC, V.NOTE_PATHS, False, V.BILIBILI_DYNAMIC, 1, ""),
}


def dynamic_result(title: Column, description: Column, url: Column, platform: str = "weibo") -> Column:
    """A search result with no static word or address and enough dynamic words, by the platform's own lists."""
    both = F.lower(F.concat(title, F.lit(RESULT_RULES[platform][5]), description))
    return dynamic_result_in(both, F.lower(url), url, platform)


def dynamic_result_in(both: Column, low_url: Column, url: Column, platform: str) -> Column:
    """The same of what is already in lower case: title and description, with what the platform puts between them, and the address."""
    static_words, paths, root, dynamic_words, least, _ = RESULT_RULES[platform]
    static = has_any(both, static_words) | has_any(low_url, paths)
    if root:
        static = static | url.rlike("^https?://[^/]+/?$")
    return ~F.coalesce(static, F.lit(False)) & (count_of(dynamic_words, both) >= least)


def valid_html(html: Column, least: int = 100, tags: tuple[str, ...] = ("html", "body")) -> Column:
    fine = F.char_length(html) >= least
    for t in tags:
        fine = fine & html.rlike(f"(?i)<{t}")
    return F.coalesce(fine, F.lit(False))


def fallback_service(first: Column, first_failed: Column) -> Column:
    """struct(service, fallback_from): the other service after the first one failed, and which that was."""
    other = F.when(first == "browser", "local").otherwise("browser")
    return F.struct(
        F.when(first_failed, other).otherwise(first).alias("service"), F.when(first_failed, first).alias("fallback_from")
    )


def login_state(html: Column, url: Column, user_selectors: list[str], login_words: list[str], login_paths: list[str]) -> Column:
    """logged_in, logged_out or unknown, by ordered rules: what only users see, what asks to log in, then the address."""
    return (
        F.when(has_any(html, user_selectors), "logged_in")
        .when(has_any(html, login_words) | has_any(F.lower(url), login_paths), "logged_out")
        .otherwise("unknown")
    )


def fetch_service(needs_script: Column, selector: Column, host: Column, wait: Column, script_hosts: list[str]) -> Column:
    """Which service a page is asked from first."""
    browser = needs_script | (F.coalesce(selector, F.lit("")) != "") | host.isin(script_hosts) | (F.coalesce(wait, F.lit("")) != "")
    return F.when(F.coalesce(browser, F.lit(False)), "browser").otherwise("local")
