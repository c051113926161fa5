"""Selectors against a plain recursive version, edited pages, and pages that can't be read."""

import random

import pytest

from siftline.functions import html, markup
from siftline.functions.selectors import matcher
from siftline.operators import logins, search, store

PAGE = """<!DOCTYPE html><html><body><nav><ul><li><a href="/1">a</a></li><li class="x  y">b<li>c</ul></nav><!-- ad -->
<div class="WB_text">T &amp; <b title='say "x"'>bold</b><br>x<span class="WB_expand">no</span></div><p>1<p>2</p><script>if(a<b&&c)</script></body></html>"""


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("ul > li", ["a", "bc"]),
        ("li:not(:first-child)", ["bc"]),
        ("li:nth-child(2) li, a", ["a", "c"]),
        ("nav li ~ li", ["bc"]),
        ("nav + div > *:not(span, br)", ["bold"]),
        ("[class~=y]", ["bc"]),
        ("a[href^='/'], b[title$=\"x\\\"\"]", ["a"]),
        ("LI:NTH-CHILD(1)", None),
        ("li:nth-child(-n+1)", ["a", "c"]),
        ("a:only-child", ["a"]),
        ("span:nth-last-child(odd)", ["no"]),
    ],
)
def test_selectors(selector, texts):
    if texts is None:
        with pytest.raises(ValueError, match="no such selector"):
            matcher((selector,))
    else:
        assert [html.joined_text(n) for n in matcher((selector,)).hits(markup.Page(PAGE).root)[0]] == texts


@pytest.mark.parametrize("wrong", ["a:hover", "a >", "", "a,,b", "p:nth-child(x)", "a{b", ":not(a b)"])
def test_selectors_that_are_refused(spark, wrong):
    with pytest.raises(ValueError, match="no such"):
        matcher((wrong,))
    pages = spark.createDataFrame([(1, "u", "x", "p")], "page_id long, url string, html string, platform string")
    with pytest.raises(ValueError, match="no such"):
        markup.edited_pages(pages, {"p": ([wrong], [])})


def plain_fits(node, steps):
    """Steps from the last to the first, by trying every way back."""
    how, test = steps[-1]
    if not test(node):
        return False
    if len(steps) == 1:
        return True
    elder = [x for x in node.parent.children if not isinstance(x, str)]
    elder = elder[: [id(x) for x in elder].index(id(node))]
    above = []
    while (node := node.parent) is not None and node.tag:
        above.append(node)
    return any(plain_fits(x, steps[:-1]) for x in {" ": above, ">": above[:1], "+": elder[-1:], "~": elder}[how])


def test_the_matcher_against_every_way_back():
    rng = random.Random(4)

    def tree(depth):
        return "".join(f'<{(t := rng.choice("abc"))} class="{rng.choice("xyz")}">{tree(depth - 1)}</{t}>' for _ in range(rng.randrange(4))) if depth else ""

    for _ in range(60):
        root = markup.Page(tree(5)).root
        nodes = [n for n in root.walk() if n.tag]
        chosen, want = [], []
        for _ in range(5):
            steps, text = [], ""
            for k in range(rng.randrange(1, 5)):
                how, tag, cls = rng.choice(" >+~") if k else "", rng.choice(["a", "b", "c", "*"]), rng.choice(["", ".x", ".y"])
                steps.append((how, lambda n, tag=tag, cls=cls: tag in ("*", n.tag) and (not cls or n.attrs["class"] == cls[1:])))
                text += f"{how}{tag}{cls}" if how in ("", " ") else f" {how} {tag}{cls}"
            chosen.append(text)
            want.append([id(n) for n in nodes if plain_fits(n, steps)])
        assert [[id(n) for n in found] for found in matcher(tuple(chosen)).hits(root)] == want, chosen


def test_edited_pages(spark):
    rules = {"weibo": ([".WB_detail .WB_text", ".WB_text", "li:nth-child(2)", "script, li.x, b"], [".WB_expand", "br"]), "other": ([".none"], ["p"]), "bare": ([], ["p"])}
    rows = [(k, "u", p, h) for k, (p, h) in enumerate([("weibo", PAGE), ("other", PAGE), ("bare", PAGE), (None, PAGE), ("weibo", None), ("weibo", ""), ("weibo", "<![x[a"), ("weibo", "<b>1" * 4000)])]
    found = {r["page_id"]: (r["html"], r["n_kept"]) for r in markup.edited_pages(spark.createDataFrame(rows, "page_id long, url string, platform string, html string"), rules).collect()}
    edited = """<html><body><div class="WB_text">T &amp; x</div><li class="x y">b<li>c</li></li><b title='say "x"'>bold</b><script>if(a<b&&c)</script></body></html>"""
    assert found[0] == (edited, 4)
    assert [found[k] for k in range(1, 6)] == [(PAGE, 0), (PAGE, 0), (PAGE, 0), (None, 0), ("", 0)]
    assert found[6] == (None, None)
    assert found[7] == (f"<html><body>{'<b>1</b>' * 4000}</body></html>", 4000)


@pytest.mark.parametrize("text", ["The&a", "a&amp;&", "AT&T &amp; x&amp", "&#38", "1 & 2 &lt; 3"])
def test_references_that_were_cut_off_are_written_as_they_stood(text):
    page = f"<html><body><b title='a&amp;b'>{text}</b><script>a&b</script></body></html>"
    want = page.replace("'", '"')
    assert markup.edited(page, ("b, script",), ()) == (want, 2)


def test_picked_texts_read_whole_references_only(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x&amp;&amp;&amp</p><p>&a</p><p>&lt;b&gt; &#65;&#x42; &am</p><a href='?a=1&copy=2'>q</a>")], "page_id long, url string, html string")
    found = markup.picked(pages, {"p": "p", "a": "[href='?a=1&copy=2']"}).first()["found"]
    assert found == {"p": ["x&&&amp", "&a", "<b> AB &am"], "a": ["q"]}


def test_what_is_dropped_first_changes_what_is_first():
    assert markup.edited("<p class=a>1</p><p>2</p><p>3</p>", ("p",), (".a", "p:first-child")) == ("<html><body><p>3</p></body></html>", 1)


def test_pages_that_cannot_be_read_or_are_deep(spark):
    deep, bad = "<div>" * 3000 + "x", "<![x[a"
    pages = spark.createDataFrame([(1, "u", deep), (2, "u", bad), (3, "u", "<h1>a</h1><p>b <b>c</b></p>"), (4, None, None)], "page_id long, url string, html string")
    assert [r["markdown"] for r in html.page_markdown(pages).orderBy("page_id").collect()] == ["x", None, "# a\n\nb **c**", ""]
    assert [r["title"] for r in html.page_extract(pages, css="p > b").orderBy("page_id").collect()] == ["", None, "", ""]
    assert [r["content"] for r in html.page_extract(pages, css="p > b").orderBy("page_id").collect()] == ["x", None, "c", ""]
    assert markup.picked(pages, {"b": "b"}).filter("page_id = 2").first()["found"] is None


def test_titles_that_end_a_quotation(spark):
    page = r"<h2><a href=/q>x\E(y</a></h2> <h2><a href=" + '"/q"' + r">x\E(y</a></h2><p>some words that describe it well</p>"
    (row,) = spark.createDataFrame([(page,)], "page string").select(search.linked_titles("page").alias("found")).collect()
    assert [(r["title"], r["snippet"]) for r in row["found"]] == [(r"x\E(y", "some words that describe it well")]


def test_updates_that_repeat_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, status string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "", 0)], "id long, status string, at long")
    assert sorted(map(tuple, store.updated(old, new, "id", ["status"], order="at").collect())) == [(1, "y"), (2, "b")]


def test_login_states_by_platform(spark):
    pages = [
        ("weibo", "u", "<a class=login>in</a><b class='gn_name x'> Li </b>", (True, "Li", False, "selector:.gn_name")),
        ("weibo", "u", "<b class=WB_miniblog>x</b><b class=gn_usercard></b>", (True, None, False, "selector:.WB_miniblog")),
        ("weibo", "u", "<a class=login>in</a>", (False, None, True, None)),
        ("xiaohongshu", "u", "<i class=user-avatar><img src=/avatar/1></i><b class=username>w</b>", (True, None, False, "avatar_detected:.user-avatar img")),
        ("xiaohongshu", "u", "<i class=user-avatar><img src=/avatar/Default></i><b class=user-name> </b><b class=username>w</b>", (True, "w", False, "username_detected:.username")),
        ("xiaohongshu", "u", "<i class=account-menu></i><a href=/login>", (True, None, False, "menu_detected:.account-menu")),
        ("xiaohongshu", "h/user/1", "<a href=/login>", (True, None, False, "url_pattern_detected:h/user/1")),
        ("xiaohongshu", "u", "<p class='a-user b-info'>", (True, None, False, 'indicator:[class*="user"][class*="info"]')),
        ("xiaohongshu", "u", "<a href=/login>", (False, None, True, None)),
        ("other", "u", "<b class=gn_name>x</b>", (False, None, False, None)),
        ("weibo", None, None, (False, None, False, None)),
        ("weibo", "u", "<![x[a", (None, None, None, None)),
    ]
    df = spark.createDataFrame([(k, p, u, h) for k, (p, u, h, _) in enumerate(pages)], "page_id int, platform string, url string, html string")
    found = {r[0]: tuple(r)[1:] for r in logins.login_states(df).collect()}
    assert found == {k: x[3] for k, x in enumerate(pages)}


def test_requests_against_what_is_stored(spark):
    videos = spark.createDataFrame([("v1", "completed"), ("v2", "pending"), ("v2", None), ("v3", "pending"), ("v3", "completed")], "id string, status string")
    kind = "k int, video_id string, platforms array<string>, description string"
    asked = spark.createDataFrame([(0, "v1", ["weibo"], "d"), (1, "v2", ["weibo"], "d"), (2, "v9", ["weibo"], "d"), (3, "v9", [], "d"), (4, "v3", ["weibo"], "d"), (5, None, ["weibo"], "d")], kind)
    found = {r["k"]: r["error"] for r in store.with_publish_errors(asked, videos, ["weibo"]).collect()}
    assert found == {0: None, 1: "video_unfinished", 2: "video_missing", 3: "platform_required", 4: None, 5: "video_required"}
    users = spark.createDataFrame([("ann", "a@b.c"), ("b@b.c", None), ("ann", "x@y.z")], "username string, email string")
    kind = "k int, username string, email string, password string, confirm string"
    asked = spark.createDataFrame([(k, n, e, "abc123", "abc123") for k, (n, e) in enumerate([("ann", "a@b.c"), ("bob", "x@y.z"), ("a@b.c", "n@n.n"), ("new", "b@b.c"), ("new", "n@n.n"), ("x", "a@b.c"), (None, None)])], kind)
    found = {r["k"]: r["wrong"] for r in store.with_registration_errors(asked, users).collect()}
    taken = lambda field: {field: "taken"}
    assert found == {0: taken("username"), 1: taken("email"), 2: taken("email"), 3: taken("email"), 4: {}, 5: {"username": "too_short"}, 6: {"username": "too_short", "email": "malformed"}}
