"""Search results: found on pages, judged by platform, and made records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import classify, html, times
from siftline.functions import vocabulary as V
from siftline.functions.urls import has_any

RESULTS = "array<struct<title:string,url:string,snippet:string>>"
MOST_TITLE, MOST_TEXT, MOST_TAGS = 200, 800, 3
MOST_NEWS_TITLE, MOST_NEWS_TEXT, LONGEST_SOURCE = 250, 1000, 50
HASHTAG = r"#([^#\s]+)#?"


def results_of(pages: DataFrame, engine: str) -> DataFrame:
    """(page_id, rank, title, url, snippet): the results on an engine's pages, in their order, those with address and title."""
    item, title, snippet = V.ENGINE_RESULTS[engine]
    found = html.per_page(pages, lambda page, _: html.results(page, item, title, snippet), RESULTS)
    listed = found.select("page_id", F.posexplode("found").alias("rank", "r")).select("page_id", "rank", "r.*")
    return listed.filter((F.col("title") != "") & (F.col("url") != ""))


def linked_titles(page: Column, most: int = 10) -> Column:
    """array of struct(title, url, snippet): headings that are links, each with the next text of 20 to 200 characters.

    Without any of them the first ``most`` links of 5 to 100 characters, but for navigation.
    """
    heading = r'<h[2-4][^>]*><a[^>]*href="([^"]*)"[^>]*>([^<]+)</a></h[2-4]>'
    link = r'href="([^"]*)"[^>]*>([^<]{5,100})</a>'

    def pairs(pattern: str) -> Column:
        found = (F.regexp_extract_all(page, F.lit(pattern), F.lit(k)) for k in (1, 2))
        return F.transform(F.arrays_zip(*(x.alias(n) for x, n in zip(found, ("url", "title"), strict=True))), trimmed)

    def trimmed(x: Column) -> Column:
        return F.struct(F.trim(x["url"]).alias("url"), F.trim(x["title"]).alias("title"))

    def described(x: Column) -> Column:
        # what follows the first place of the title from which such a text can be reached on the same line
        quoted = F.replace(x["title"], F.lit("\\E"), F.lit("\\E\\\\E\\Q"))  # a quotation ends at \E, wherever it stands
        after = F.concat(F.lit("\\Q"), quoted, F.lit("\\E.*?<[^>]*>([^<]{20,200})<"))
        text = F.call_function("regexp_extract", page, after, F.lit(1))
        return F.struct(x["title"].alias("title"), x["url"].alias("url"), F.trim(text).alias("snippet"))

    def plain(x: Column) -> Column:
        return F.struct(x["title"].alias("title"), x["url"].alias("url"), F.lit(V.RESULT_TEXT).alias("snippet"))

    def useful(x: Column) -> Column:
        return (F.octet_length(x["title"]) > 5) & (F.octet_length(x["title"]) < 100) & ~has_any(F.lower(x["title"]), V.RESULT_NAVIGATION)

    headed = F.filter(pairs(heading), lambda x: (x["title"] != "") & (x["url"] != ""))
    linked = F.filter(F.slice(pairs(link), 1, most), useful)
    return F.when(F.size(headed) > 0, F.transform(headed, described)).otherwise(F.transform(linked, plain))


def service_author(title: Column, description: Column, platform: Column) -> Column:
    """The first name with an @ in title or description, on one platform a name marked as such, else the platform's own."""
    both = F.concat(title, F.lit(" "), description)
    at, marked = F.regexp_extract(both, r"@([^@\s]+)", 0), F.regexp_extract(both, r"UP主([^：\s]*)", 0)
    named = F.create_map(*(F.lit(x) for pair in V.SERVICE_AUTHORS.items() for x in pair))
    default = F.coalesce(F.try_element_at(named, platform), F.lit(V.SERVICE_AUTHOR))
    return F.when(at != "", at).when((platform == "bilibili") & (marked != ""), marked).otherwise(default)


def title_author(title: Column, platform: str) -> Column:
    """The author that a result's title names, else the platform's own."""
    pattern = r"@[^@\s]+|UP主[^：\s]*" if platform == "bilibili" else r"@[^@\s]+"
    return F.coalesce(F.nullif(F.regexp_extract(title, pattern, 0), F.lit("")), F.lit(V.RESULT_AUTHORS[platform]))


def page_author(pages: DataFrame) -> DataFrame:
    """(page_id, author): the first place of an author with a text of under 50 characters, else by the page's address."""

    def author(page: str, url: str) -> str:
        root = html.Tree(page).root
        hits = (next(html.select(root, s), None) for s in V.AUTHOR_SELECTORS)
        named = (x for n in hits if n is not None and 0 < len(x := html.joined_text(n)) < 50)
        by_url = (name for part, name in V.URL_AUTHORS.items() if part in url)
        return next(named, None) or next(by_url, V.URL_AUTHOR)

    return html.per_page(pages, author, "string").withColumnRenamed("found", "author")


def url_title(url: Column, platform: str) -> Column:
    """A title made of an address: the platform's own for kinds of paths, else with the last part that is no number."""
    path = F.coalesce(F.try_url_decode(F.parse_url(url, F.lit("PATH"))), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.rlike(r"^\d+$"))
    name = F.concat(F.lit(f"{platform}内容 - "), F.substring(F.get(parts, F.size(parts) - 1), 1, 20))
    found = F.when(F.lit(False), F.lit(""))
    for part, title in V.URL_TITLES.get(platform, []):
        found = found.when(F.contains(path, F.lit(part)), title)
    return found.when(F.size(parts) > 0, name).otherwise(f"{platform}内容")


def posts_of(results: DataFrame, platform: str, query: str) -> DataFrame:
    """Results of one platform as records. Columns: title, url, snippet and any others, which stay.

    A time is not made up: ``published_at`` is null until records get their default times.
    """
    title, text, url = (F.coalesce(c, F.lit("")) for c in ("title", "snippet", "url"))
    # generated columns are worked out once, plain ones for every word that is sought
    both = F.concat(title, F.lit(classify.RESULT_RULES[platform][5]), text)
    low = {"__both": F.lower(both), "__all": F.lower(F.concat(title, text)), "__url": F.lower(url)}
    judged = results.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in low.items())))))
    wanted = judged.filter(classify.dynamic_result_in(F.col("__both"), F.col("__url"), url, platform))
    if platform in V.RESULT_WORDS:
        wanted = wanted.filter(has_any(F.col("__all"), [*V.RESULT_WORDS[platform], query.lower()]))
    tags = F.array(*map(F.lit, [*V.RESULT_TAGS[platform], query]))
    if platform != "bilibili":
        tags = F.concat(tags, F.slice(F.regexp_extract_all(F.concat(title, text), F.lit(HASHTAG), F.lit(1)), 1, MOST_TAGS))
    is_video = F.contains(F.lower(url), F.lit("video"))
    video = {"douyin": is_video, "bilibili": is_video | F.contains(url, F.lit("bilibili.com"))}.get(platform, F.lit(False))
    return wanted.withColumns(
        {
            "author": title_author(title, platform),
            "content": F.substring(F.when(text != "", text).otherwise(F.concat(F.lit(V.RESULT_LEADS[platform]), title)), 1, MOST_TEXT),
            "tags": F.array_distinct(tags),
            "platform": F.lit(platform),
            "video_url": F.when(video, url),
            "published_at": F.lit(None).cast("timestamp_ntz"),
            "title": F.substring(title, 1, MOST_TITLE),
        }
    ).drop("snippet", *low)


def news_posts(results: DataFrame, query: str, as_of: Column) -> DataFrame:
    """News results as records, without advertisements. Columns: title, url, snippet, source, time and any others."""
    title, text, source = (F.coalesce(c, F.lit("")) for c in ("title", "snippet", "source"))
    named = F.when(F.char_length(source) > LONGEST_SOURCE, V.NEWS_SOURCES["too_long"]).when(source == "", V.NEWS_SOURCES["without"]).otherwise(source)
    return results.filter((F.char_length(title) > 10) & ~has_any(F.lower(title), V.NEWS_EXCLUDED)).withColumns(
        {
            "author": named,
            "content": F.substring(F.when(text != "", text).otherwise(F.concat(F.lit(V.RESULT_LEADS["news"]), title)), 1, MOST_NEWS_TEXT),
            "tags": F.array(*map(F.lit, [*V.RESULT_TAGS["news"], query])),
            "platform": F.lit("news"),
            "published_at": times.relative_time(F.col("time"), as_of),
            "title": F.substring(title, 1, MOST_NEWS_TITLE),
        }
    ).drop("snippet", "source", "time")


def news_links(pages: DataFrame, query: str, most: int = 5) -> DataFrame:
    """(page_id, rank, title, url): of a site's first links those that name the query in 11 to 99 characters."""

    def links(page: str, _: str) -> list[dict[str, str]]:
        hits = [n for n in html.Tree(page).root.walk() if n.tag == "a" and "href" in n.attrs][:most]
        return [{"title": html.joined_text(n), "url": n.attrs["href"], "snippet": ""} for n in hits]

    found = html.per_page(pages, links, RESULTS).join(pages.select("page_id", F.col("url").alias("__site")), "page_id")
    listed = found.select("page_id", "__site", F.posexplode("found").alias("rank", "r")).select("page_id", "__site", "rank", "r.title", "r.url")
    size, url = F.char_length("title"), F.col("url")
    absolute = F.when(F.startswith(url, F.lit("/")), F.concat(F.regexp_extract("__site", r"^([A-Za-z]+://[^/?#]*)", 1), url)).otherwise(url)
    fits = (size > 10) & (size < 100) & F.contains(F.lower("title"), F.lit(query.lower())) & (F.contains(url, F.lit("http")) | F.startswith(url, F.lit("/")))
    return listed.filter(fits).select("page_id", "rank", "title", absolute.alias("url"))


def all_posts(results: DataFrame, query: str) -> DataFrame:
    """Results of several platforms, told apart by their column ``platform``, as records."""
    parts = [posts_of(results.filter(F.col("platform") == p), p, query) for p in classify.RESULT_RULES]
    return reduce(DataFrame.unionByName, parts)
