"""Queries that edit pages by selectors, and pick elements of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import markup
from siftline.operators.logins import Sign, Signs, login_states
from siftline.plans.registry import query
from siftline.sources.tables import table

#: By the first part of a page's host: what is kept and what is dropped. Pages of other hosts are of ``site``; those of ``www`` have no rules.
RULES = {
    "blog": (["article > h1", ".none", "footer"], ["nav", ".ad"]),
    "m": (["nav li:not(:first-child) > a"], ["footer"]),
    "site": (["footer, .ad", "html > head > title"], ["article", "nav ul"]),
}

#: Text of a page once it is read and written again.
READ_SQL = "replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"
PARTS_SQL = rf"""parts AS (SELECT page_id, url, html, regexp_extract(url, '^https?://(blog|m|www)\.', 1) AS first,
    {READ_SQL.format("regexp_extract(html, '(?s)<h1>.*?</h1>')")} AS h1, {READ_SQL.format("regexp_extract(html, '(?s)<footer>.*?</footer>')")} AS footer,
    {READ_SQL.format('''regexp_extract(html, '(?s)<div class="ad">.*?</div>')''')} AS ad, {READ_SQL.format("regexp_extract(html, '(?s)<title>.*?</title>')")} AS title,
    regexp_extract_all({READ_SQL.format("regexp_extract(html, '(?s)<nav>.*?</nav>')")}, '(?s)<li>(<a .*?</a>)</li>', 1) AS links,
    regexp_extract(html, '(?s)<article>.*</article>') AS article FROM pages)"""


def with_platform(pages: DataFrame) -> DataFrame:
    first = F.regexp_extract("url", r"^https?://(blog|m|www)\.", 1)
    return pages.withColumn("platform", F.when(first == "", "site").otherwise(first))


@query(
    f"""WITH {PARTS_SQL} SELECT page_id, CASE first WHEN 'www' THEN html WHEN 'blog' THEN '<html><body>' || h1 || footer || '</body></html>'
      WHEN 'm' THEN CASE WHEN len(links) > 1 THEN '<html><body>' || array_to_string(links[2:], '') || '</body></html>' ELSE html END
      ELSE '<html><body>' || ad || footer || title || '</body></html>' END AS html,
      CAST(CASE first WHEN 'www' THEN 0 WHEN 'blog' THEN 2 WHEN 'm' THEN greatest(len(links) - 1, 0) ELSE 3 END AS BIGINT) AS n_kept FROM parts"""
)
def page_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of what their platform's selectors keep; the others as they are."""
    return markup.edited_pages(with_platform(table(spark, sf_dir, "pages")), RULES).select("page_id", "html", "n_kept")


TEXT_SQL = "replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&amp;', '&')"


@query(
    f"""WITH {PARTS_SQL} SELECT page_id, trim({TEXT_SQL.format('h1')}) AS heading, coalesce(trim({TEXT_SQL.format('links[2]')}), '') AS second,
      CAST(greatest(len(links) - 1, 0) AS BIGINT) AS n_later, CAST((len(links) + 1) // 2 AS BIGINT) AS n_odd, CAST(1 AS BIGINT) AS n_scripts,
      CAST(len(regexp_extract_all(article, '<p>')) AS BIGINT) AS n_paragraphs, coalesce(trim({TEXT_SQL.format('links[-1]')}), '') AS last FROM parts"""
)
def page_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by their parents, siblings and places."""
    found = markup.picked(
        table(spark, sf_dir, "pages"),
        {
            "heading": "article > h1:first-child",
            "second": "nav > ul > li:nth-child(2) a",
            "later": "nav li ~ li",
            "odd": "nav li:nth-child(odd)",
            "scripts": "head style + script",
            "paragraphs": "article p",
            "last": "ul li:last-child > a[href^='/']",
        },
    )
    one = {x: F.coalesce(F.get(F.col("found")[x], F.lit(0)), F.lit("")).alias(x) for x in ("heading", "second", "last")}
    size = [F.size(F.col("found")[x]).cast("long").alias(f"n_{x}") for x in ("later", "odd", "scripts", "paragraphs")]
    return found.select("page_id", one["heading"], one["second"], *size, one["last"])


#: The footer names the user of a blog; a host for phones shows a login by its address; others ask to log in where there is a box.
PAGE_SIGNS = {
    "blog": Signs((Sign("menu", "there", (".user-menu",)), Sign("named", "name", (".none", "nav > .none", "footer")))),
    "m": Signs((Sign("address", "address", ("/fr/", "/de/")),), (".ad",)),
    "site": Signs((Sign("avatar", "avatar", ("nav a", "img")), Sign("there", "there", ("nav li:nth-child(6)",), ("nav li:nth-child(6)",))), (".none", "div.ad")),
}


@query(
    f"""WITH {PARTS_SQL}, s AS (SELECT *, first = 'm' AND (contains(url, '/fr/') OR contains(url, '/de/')) AS user_path, first = '' AND len(links) > 5 AS sixth FROM parts)
    SELECT page_id, first = 'blog' OR user_path OR sixth AS is_logged_in, CASE WHEN first = 'blog' THEN trim({TEXT_SQL.format('footer')}) WHEN sixth THEN trim({TEXT_SQL.format('links[6]')}) END AS login_user,
      first IN ('m', '') AND NOT user_path AND NOT sixth AS has_login_button,
      CASE WHEN first = 'blog' THEN 'named:footer' WHEN user_path THEN 'address:' || url WHEN sixth THEN 'there:nav li:nth-child(6)' END AS detection_method FROM s"""
)
def page_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages show a login, by signs of their platform in order."""
    return login_states(with_platform(table(spark, sf_dir, "pages")), PAGE_SIGNS)
